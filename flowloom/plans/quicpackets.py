"""Sealed QUIC packets, for the query and the tests."""

from __future__ import annotations

from flowloom.functions.aes import _times, encrypt_block
from flowloom.operators.walkers import initial_keys

def quic_packet(host: str) -> bytes:
    """A sealed QUIC version 1 Initial packet whose ClientHello has the server name."""
    name = host.encode()
    entry = b"\0\0" + (len(name) + 5).to_bytes(2) + (len(name) + 3).to_bytes(2) + b"\0" + len(name).to_bytes(2) + name
    body = b"\3\3" + bytes(32) + b"\0" + b"\0\2\x13\1" + b"\1\0" + len(entry).to_bytes(2) + entry
    hello = b"\1" + len(body).to_bytes(3) + body
    plain = b"\6\0" + (0x4000 | len(hello)).to_bytes(2) + hello + bytes(60)
    dcid = bytes.fromhex("8394c8f03e515708")
    key, iv, protect = initial_keys(dcid)
    size = 4 + len(plain) + 16
    head = b"\xc3\0\0\0\1\x08" + dcid + b"\0\0" + (0x4000 | size).to_bytes(2)
    number = b"\0\0\0\2"
    nonce = (int.from_bytes(iv) ^ 2).to_bytes(12)
    stream = b"".join(encrypt_block(key, nonce + (2 + i).to_bytes(4)) for i in range(len(plain) // 16 + 1))
    sealed = bytes(a ^ b for a, b in zip(plain, stream, strict=False)) + _tag(key, nonce, plain, stream, head + number)
    mask = encrypt_block(protect, sealed[:16])
    return bytes([head[0] ^ mask[0] & 15]) + head[1:] + bytes(a ^ b for a, b in zip(number, mask[1:], strict=False)) + sealed


def _tag(key: bytes, nonce: bytes, plain: bytes, stream: bytes, extra: bytes) -> bytes:
    data = bytes(a ^ b for a, b in zip(plain, stream, strict=False))
    pad = lambda b: b + bytes(-len(b) % 16)
    y, h = 0, int.from_bytes(encrypt_block(key, bytes(16)))
    whole = pad(extra) + pad(data) + (len(extra) * 8).to_bytes(8) + (len(data) * 8).to_bytes(8)
    for i in range(0, len(whole), 16):
        y = _times(y ^ int.from_bytes(whole[i : i + 16]), h)
    return (y ^ int.from_bytes(encrypt_block(key, nonce + b"\0\0\0\1"))).to_bytes(16)
