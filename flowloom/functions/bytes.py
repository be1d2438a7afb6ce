"""Byte access and formatting as Column expressions.

Offsets and sizes count from 0 and may be ints or Columns.  There is no Python on
the data path.  What folds or maps over an array (``bind``, ``tlvs``, ``entropy``,
``checksum16``) is evaluated by Spark's interpreter, the rest in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = int | Column


def _col(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cut(data: Column, offset: Num, size: Num) -> Column:
    """``size`` bytes from ``offset``, fewer at the end."""
    return F.substring(data, _col(offset + 1), _col(size))


def length(data: Column) -> Column:
    return F.octet_length(data)


def be(data: Column, offset: Num, size: int) -> Column:
    """An unsigned big-endian number of up to 7 bytes."""
    return F.conv(F.hex(cut(data, offset, size)), 16, 10).cast("long")


def le(data: Column, offset: Num, size: int) -> Column:
    """An unsigned little-endian number."""
    out = be(data, offset, 1)
    for k in range(1, size):
        out = out + be(data, offset + k, 1) * (1 << (8 * k))
    return out


def bits(value: Column, shift: int, mask: int) -> Column:
    """``mask`` bits of a number after a shift to the right."""
    return F.shiftright(value, shift).bitwiseAND(F.lit(mask)) if shift else value.bitwiseAND(F.lit(mask))


def flag(value: Column, mask: int) -> Column:
    """``true`` or ``false``, as text, by whether any bit of the mask is set."""
    return F.when(value.bitwiseAND(F.lit(mask)) != 0, "true").otherwise("false")


def text(data: Column, offset: Num = 0, size: Num | None = None) -> Column:
    """Bytes as ISO-8859-1 text, one character each."""
    return F.decode(data if size is None else cut(data, offset, size), "ISO-8859-1")


def hexed(data: Column, offset: Num, size: Num) -> Column:
    return F.lower(F.hex(cut(data, offset, size)))


def number(value: Column) -> Column:
    return value.cast("string")


def as_hex(value: Column, digits: int) -> Column:
    """0x and a number of hexadecimal digits."""
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(value.cast("long")), digits, "0")))


def ipv4(data: Column, offset: Num) -> Column:
    return F.concat_ws(".", *(be(data, offset + k, 1) for k in range(4)))


def ipv4_number(value: Column) -> Column:
    """Dotted form of a 32-bit number."""
    return F.concat_ws(".", *(bits(value, 24 - 8 * k, 255) for k in range(4)))


def mac(data: Column, offset: Num) -> Column:
    return F.concat_ws(":", *(hexed(data, offset + k, 1) for k in range(6)))


def ipv6(data: Column, offset: Num) -> Column:
    """Canonical text: groups without leading zeros, the first longest run of two or more zero groups as ``::``."""
    joined = F.concat_ws(":", *(F.lower(F.conv(F.hex(cut(data, offset + 2 * k, 2)), 16, 16)) for k in range(8)))

    def shorten(groups):
        # runs of zero groups, longest first; the earliest of equal ones is found first
        out = groups
        for n in range(2, 9):
            run = ":".join(["0"] * n)
            out = F.when(groups.rlike(rf"(?:^|:){run}(?:$|:)"), F.regexp_replace(F.regexp_replace(groups, rf"^(.*?)(?:^|(?<=:)){run}(?=$|:)(.*)$", "$1|$2"), r":?\|:?", "::")).otherwise(out)
        return out

    return bind(joined, shorten)


def checksum16(data: Column) -> Column:
    """One's-complement sum of 16-bit words; an odd last byte is the high half of its word."""
    even = F.when(length(data) % 2 == 0, data).otherwise(F.concat(data, F.lit(b"\x00")))
    words = F.when(length(data) > 0, F.sequence(F.lit(0), F.floor((length(data) + 1) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    fold = lambda x: x % 65536 + F.floor(x / 65536)
    total = F.aggregate(words, F.lit(0).cast("long"), lambda s, i: (s + be(even, i * 2, 2)).cast("long"))
    return F.when(data.isNotNull(), (F.lit(65535) - fold(fold(total))).cast("long"))


def entropy(data: Column) -> Column:
    """Shannon entropy in bits of a byte string; empty: 0."""
    chars = F.sort_array(F.split(F.hex(data), "(?<=\\G..)", -1))
    # ends of runs in the sorted list give counts
    n = length(data)
    sizes = F.aggregate(
        chars,
        F.struct(F.lit("").alias("c"), F.lit(0).alias("k"), F.lit(0.0).alias("h")),
        lambda s, c: F.struct(
            c.alias("c"),
            F.when(c == s["c"], s["k"] + 1).otherwise(1).alias("k"),
            (s["h"] + F.when((c != s["c"]) & (s["k"] > 0) & (s["c"] != ""), s["k"] * F.log2(s["k"].cast("double"))).otherwise(0.0)).alias("h"),
        ),
        lambda s: s["h"] + F.when((s["k"] > 0) & (s["c"] != ""), s["k"] * F.log2(s["k"].cast("double"))).otherwise(0.0),
    )
    return F.when(n > 0, F.greatest(F.log2(n.cast("double")) - sizes / n, F.lit(0.0))).otherwise(0.0)


def name_of(value: Column, names: dict, otherwise: str | None = "Unknown") -> Column:
    """The name of a number."""
    out = None
    for k, v in names.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(F.lit(otherwise))


def tlvs(data: Column, start: Num, end: Num, *, kind: int, size: int, whole: bool = False, pad: int = 1, limit: int | None = None, skip: int | None = None, stop: int | None = None, little: bool = False) -> Column:
    """Type-length-value items from ``start`` to ``end`` as array<struct<t, at, n>>: type, offset and length of the value.

    kind, size: bytes of the type and of the length; whole: the length counts
    the header; pad: values fill a multiple of so many bytes; skip: a type of one
    byte without a length; stop: a type that ends the list.  The walk ends at
    an item that doesn't fit.  It takes as many steps as items can fit, or
    ``limit`` where a protocol's own bound is to hold.
    """
    head = kind + size
    end = _col(end)
    start = _col(start).cast("int")
    none = F.array().cast("array<struct<t:long,at:int,n:int>>")

    def step(s, _):
        pos = s["pos"]
        t = be(data, pos, kind)
        raw = le(data, pos + kind, size) if little else be(data, pos + kind, size)
        n = (raw - head if whole else raw).cast("int")
        padded = n if pad == 1 else (F.ceil((n + (head if whole else 0)) / pad) * pad - (head if whole else 0)).cast("int")
        fits = (pos + head <= end) & (n >= 0) & (pos + head + n <= end)
        more = F.struct((pos + head + padded).cast("int").alias("pos"), F.lit(False).alias("done"), F.concat(s["out"], F.array(F.struct(t.alias("t"), (pos + head).cast("int").alias("at"), n.alias("n")))).alias("out"))
        over = F.struct(pos.alias("pos"), F.lit(True).alias("done"), s["out"].alias("out"))
        out = F.when(fits, more).otherwise(over)
        if skip is not None:
            out = F.when((t == skip) & (pos < end), F.struct((pos + 1).cast("int").alias("pos"), F.lit(False).alias("done"), s["out"].alias("out"))).otherwise(out)
        if stop is not None:
            out = F.when((t == stop) | (pos >= end), over).otherwise(out)
        return F.when(s["done"], s).otherwise(out)

    first = F.struct(start.alias("pos"), F.lit(False).alias("done"), none.alias("out"))
    least = head if skip is None and stop is None else 1
    most = F.least(F.greatest(F.ceil((end - start) / least), F.lit(1)), F.lit(65536)) if limit is None else F.lit(limit)
    return F.aggregate(F.sequence(F.lit(1), F.coalesce(most, F.lit(1)).cast("int")), first, step, lambda s: s["out"])


def item(items: Column, kind: int, test=None) -> Column:
    """The first item of a type, or null."""
    return F.get(F.filter(items, lambda x: (x["t"] == kind) & (test(x) if test else F.lit(True))), F.lit(0))


def from_item(data: Column, x: Column, read) -> Column:
    """``read(data, offset, length)`` for an item that is there."""
    return F.when(x.isNotNull(), read(data, x["at"], x["n"]))


def between_zeros(data: Column, offset: Num) -> Column:
    """Text from ``offset`` to the next zero byte; null if there is none."""
    rest = text(cut(data, offset, length(data)))
    return F.when(F.instr(rest, "\0") > 0, F.substring_index(rest, "\0", 1))
