"""Header compression of HTTP/2 (RFC 7541): integers, Huffman strings, and the two tables."""

from __future__ import annotations

from functools import lru_cache

# The static table, and the symbols of each code length; the code is canonical, so codes follow from lengths.
STATIC = [
    (":authority", ""), (":method", "GET"), (":method", "POST"), (":path", "/"), (":path", "/index.html"), (":scheme", "http"), (":scheme", "https"), (":status", "200"), (":status", "204"), (":status", "206"), (":status", "304"),
    (":status", "400"), (":status", "404"), (":status", "500"), ("accept-charset", ""), ("accept-encoding", "gzip, deflate"), ("accept-language", ""), ("accept-ranges", ""), ("accept", ""), ("access-control-allow-origin", ""), ("age", ""),
    ("allow", ""), ("authorization", ""), ("cache-control", ""), ("content-disposition", ""), ("content-encoding", ""), ("content-language", ""), ("content-length", ""), ("content-location", ""), ("content-range", ""), ("content-type", ""),
    ("cookie", ""), ("date", ""), ("etag", ""), ("expect", ""), ("expires", ""), ("from", ""), ("host", ""), ("if-match", ""), ("if-modified-since", ""), ("if-none-match", ""), ("if-range", ""), ("if-unmodified-since", ""), ("last-modified", ""),
    ("link", ""), ("location", ""), ("max-forwards", ""), ("proxy-authenticate", ""), ("proxy-authorization", ""), ("range", ""), ("referer", ""), ("refresh", ""), ("retry-after", ""), ("server", ""), ("set-cookie", ""),
    ("strict-transport-security", ""), ("transfer-encoding", ""), ("user-agent", ""), ("vary", ""), ("via", ""), ("www-authenticate", ""),
]
_BY_TEXT = {5: "012aceiost", 6: " %-./3456789=A_bdfghlmnpru", 7: ":BCDEFGHIJKLMNOPQRSTUVWYjkqvwxyz", 8: "&*,;XZ", 10: '!"()?', 11: "'+|", 12: "#>", 13: "\0$@[]~", 14: "^}", 15: "<`{"}
_BY_NUMBER = {
    19: "92 195 208",
    20: "128 130 131 162 184 194 224 226",
    21: "153 161 167 172 176 177 179 209 216 217 227 229 230",
    22: "129 132 133 134 136 146 154 156 160 163 164 169 170 173 178 181 185 186 187 189 190 196 198 228 232 233",
    23: "1 135 137 138 139 140 141 143 147 149 150 151 152 155 157 158 165 166 168 174 175 180 182 183 188 191 197 231 239",
    24: "9 142 144 145 148 159 171 206 215 225 236 237",
    25: "199 207 234 235",
    26: "192 193 200 201 202 205 210 213 218 219 238 240 242 243 255",
    27: "203 204 211 212 214 221 222 223 241 244 245 246 247 248 250 251 252 253 254",
    28: "2 3 4 5 6 7 8 11 12 14 15 16 17 18 19 20 21 23 24 25 26 27 28 29 30 31 127 220 249",
    30: "10 13 22 256",
}


class HpackError(ValueError):
    pass


@lru_cache(maxsize=1)
def codes() -> dict[tuple[int, int], int]:
    """Symbol by (length, code)."""
    lengths = {n: sorted(map(ord, s)) for n, s in _BY_TEXT.items()} | {n: sorted(map(int, s.split())) for n, s in _BY_NUMBER.items()}
    out, code, last = {}, 0, 0
    for n in sorted(lengths):
        code <<= n - last
        last = n
        for symbol in lengths[n]:
            out[n, code] = symbol
            code += 1
    return out


def huffman(data: bytes) -> bytes:
    table, out, code, n = codes(), bytearray(), 0, 0
    for byte in data:
        for k in range(7, -1, -1):
            code, n = code << 1 | (byte >> k & 1), n + 1
            symbol = table.get((n, code))
            if symbol is not None:
                if symbol == 256:
                    raise HpackError("end of string inside")
                out.append(symbol)
                code = n = 0
            elif n > 30:
                raise HpackError("no such code")
    if n > 7 or code != (1 << n) - 1:
        raise HpackError("bad padding")
    return bytes(out)


def integer(data: bytes, at: int, prefix: int) -> tuple[int, int]:
    if at >= len(data):
        raise HpackError("cut off")
    most = (1 << prefix) - 1
    value, at = data[at] & most, at + 1
    if value < most:
        return value, at
    for shift in range(0, 35, 7):
        if at >= len(data):
            raise HpackError("cut off")
        b, at = data[at], at + 1
        value += (b & 0x7F) << shift
        if b < 0x80:
            return value, at
    raise HpackError("too long")


def string(data: bytes, at: int) -> tuple[str, int]:
    coded = at < len(data) and data[at] >= 0x80
    size, at = integer(data, at, 7)
    if at + size > len(data):
        raise HpackError("cut off")
    raw = data[at : at + size]
    return (huffman(raw) if coded else raw).decode("latin-1"), at + size


class Decoder:
    """One direction of a connection; ``missed`` says that an entry was asked for that this side never saw."""

    def __init__(self, size: int = 4096):
        self.limit = self.size = size
        self.table: list[tuple[str, str]] = []
        self.missed = False

    def resize(self, size: int) -> None:
        self.size = size
        self._evict()

    def _evict(self) -> None:
        total = lambda: sum(len(a) + len(b) + 32 for a, b in self.table)
        while self.table and total() > self.size:
            self.table.pop()

    def _entry(self, index: int) -> tuple[str, str]:
        if index == 0:
            raise HpackError("index zero")
        if index <= len(STATIC):
            return STATIC[index - 1]
        if index - len(STATIC) > len(self.table):
            self.missed = True
            return "", ""
        return self.table[index - len(STATIC) - 1]

    def decode(self, block: bytes) -> list[tuple[str, str]]:
        self.missed = False
        out, at = [], 0
        while at < len(block):
            b = block[at]
            if b >= 0x80:
                index, at = integer(block, at, 7)
                out.append(self._entry(index))
            elif 0x20 <= b < 0x40:
                size, at = integer(block, at, 5)
                self.resize(size)
            else:
                kept = b >= 0x40
                index, at = integer(block, at, 6 if kept else 4)
                name, at = (self._entry(index)[0], at) if index else string(block, at)
                value, at = string(block, at)
                out.append((name, value))
                if kept:
                    self.table.insert(0, (name, value))
                    self._evict()
        return out
