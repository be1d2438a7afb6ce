"""AES-128 and HKDF for QUIC Initial packets, whose keys anyone can derive from the packet itself.

Only what reading such packets takes: one block, counter mode as in GCM (the tag
is checked), and HKDF labels.  The tables are built from the cipher's rules.
"""

from __future__ import annotations

import hashlib
import hmac
from functools import lru_cache


def _double(x: int) -> int:
    return (x << 1) ^ (0x11B if x & 0x80 else 0)


@lru_cache(maxsize=1)
def _sbox() -> tuple[int, ...]:
    """Inverses in GF(2**8), then the affine map."""
    power, log = [1], {1: 0}
    for i in range(1, 255):
        power.append(power[-1] ^ _double(power[-1]))
        log[power[-1]] = i
    out = []
    for x in range(256):
        b = power[-log[x] % 255] if x else 0
        y = 0x63
        for shift in range(5):
            y ^= (b << shift | b >> (8 - shift)) & 0xFF
        out.append(y)
    return tuple(out)


@lru_cache(maxsize=256)
def _round_keys(key: bytes) -> tuple[bytes, ...]:
    sbox, words, turn = _sbox(), [key[i : i + 4] for i in range(0, 16, 4)], 1
    for i in range(4, 44):
        last = words[-1]
        if i % 4 == 0:
            last = bytes(sbox[b] for b in last[1:] + last[:1])
            last = bytes([last[0] ^ turn]) + last[1:]
            turn = _double(turn)
        words.append(bytes(a ^ b for a, b in zip(words[-4], last, strict=True)))
    return tuple(b"".join(words[i : i + 4]) for i in range(0, 44, 4))


def encrypt_block(key: bytes, block: bytes) -> bytes:
    sbox, keys = _sbox(), _round_keys(key)
    s = [a ^ b for a, b in zip(block, keys[0], strict=True)]
    for r in range(1, 11):
        s = [sbox[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]  # with rows turned
        if r < 10:
            mixed = []
            for c in range(0, 16, 4):
                col = s[c : c + 4]
                every = col[0] ^ col[1] ^ col[2] ^ col[3]
                mixed += [col[k] ^ every ^ _double(col[k] ^ col[(k + 1) % 4]) for k in range(4)]
            s = mixed
        s = [a ^ b for a, b in zip(s, keys[r], strict=True)]
    return bytes(s)


def _times(x: int, y: int) -> int:
    z = 0
    for i in range(127, -1, -1):
        if x >> i & 1:
            z ^= y
        y = y >> 1 ^ (0xE1 << 120 if y & 1 else 0)
    return z


def gcm_decrypt(key: bytes, iv: bytes, data: bytes, extra: bytes) -> bytes | None:
    """The plain text, or None if the tag (the last 16 bytes of ``data``) doesn't fit."""
    text, tag = data[:-16], data[-16:]
    h = int.from_bytes(encrypt_block(key, bytes(16)))
    y = 0
    pad = lambda b: b + bytes(-len(b) % 16)
    whole = pad(extra) + pad(text) + (len(extra) * 8).to_bytes(8) + (len(text) * 8).to_bytes(8)
    for i in range(0, len(whole), 16):
        y = _times(y ^ int.from_bytes(whole[i : i + 16]), h)
    mask = int.from_bytes(encrypt_block(key, iv + b"\0\0\0\1"))
    if y ^ mask != int.from_bytes(tag):
        return None
    stream = b"".join(encrypt_block(key, iv + (2 + i).to_bytes(4)) for i in range((len(text) + 15) // 16))
    return bytes(a ^ b for a, b in zip(text, stream, strict=False))


def hkdf_extract(salt: bytes, secret: bytes) -> bytes:
    return hmac.digest(salt, secret, hashlib.sha256)


def hkdf_label(secret: bytes, label: str, size: int) -> bytes:
    """HKDF-Expand-Label of TLS 1.3 without a context, for up to 32 bytes."""
    name = b"tls13 " + label.encode()
    return hmac.digest(secret, size.to_bytes(2) + bytes([len(name)]) + name + b"\0\1", hashlib.sha256)[:size]
