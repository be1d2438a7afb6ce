"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is removed if an earlier line of the corpus is equal to it or within one
edit (a character put in, left out or replaced) of it; earlier is by doc_id,
then by a hash of the row, then by line number, and is judged on the input, so an
earlier line counts whether or not it is itself removed.

Equal lines are combined first, by a 128-bit hash.  Of the different lines only
those are taken further that share a half, and in a second step three
quarters, with another line whose length differs by one at most: an edit lies in
one half and in one quarter, so no pair within the bound is lost.  Each line left
emits the hashes of its variants with one character of the open quarter left out;
equal variants with the same place are joined to the earliest line of their
group, and variants equal to a whole line to that line, which are as many rows
as variants, never all pairs of a group.  The hash of a variant is made of two
sums over prefixes of the line, so all variants of a line take time in
proportion to its length.  Of each pair found the edit is verified: what is left of
both without the character is compared.

Defined results: null text stays null; lines shorter than ``min_chars``, empty
ones among them, are always kept, and lines shorter than ``min_edit_chars`` only
match equal ones (with ``min_chars`` 1, as op2 and the pipeline have it, all but
empty lines take part); a null doc_id comes before all others; rows equal in id and
text are at the same place, so each keeps what the other does; an empty table
gives an empty result.  Columns of ``docs`` are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import drop_staged, stage, unused, with_members, without_members

_ID = ["h1", "h2"]

#: Primes and bases of the two polynomial hashes of a line, and characters that are summed at a time.
_PRIMES = (2147483647, 2147483629)
_BASES = (1000003, 16777619)
_BLOCK = 64


def _less(line: Column, start: Column, end: Column) -> Column:
    """The line without its characters start (from 0) to end."""
    return F.concat(F.substring(line, F.lit(1), start), F.substring(line, end + 1, F.length(line)))


def _parts(line: Column, n: int) -> Column:
    """Keys of the line less one of n parts, for its own length and for the length less one.

    A line of length b and one of length b or b + 1 that are within one edit are
    the same but for the part, cut by b, that holds the edit.
    """
    size = F.length(line)
    keys = []
    for base in (size, size - 1):
        for k in range(n):
            start, end = F.floor(base * k / n).cast("int"), F.floor(base * (k + 1) / n).cast("int")
            # what follows the part is counted from the end of the line
            rest = _less(line, start, end + (size - base))
            keys.append(F.struct(F.xxhash64(F.lit(n), F.lit(k), base, rest).alias("key"), start.alias("start"), (end + (size - base)).alias("end")))
    return F.array(*keys)


def _with_halves(rows: DataFrame, least: int) -> DataFrame:
    """``_parts`` for n = 2, of lines of ``least`` characters or more, as the columns k1 to k4.

    Less one half, a line is its other half; lengths and bounds are columns of
    their own, so that each is worked out once.
    """
    size, h, g = F.col("size"), F.col("h"), F.col("g")
    sized = rows.withColumn("size", F.length("line")).withColumn("h", F.shiftright("size", 1)).withColumn("g", F.shiftright(F.col("size") - 1, 1))
    key = lambda side, base, start, n: F.when(size >= least, F.xxhash64(F.lit(side), base, F.substring("line", start, n)))
    keys = {"k1": key(0, size, h + 1, size), "k2": key(1, size, F.lit(1), h), "k3": key(0, size - 1, g + 2, size), "k4": key(1, size - 1, F.lit(1), g)}
    return sized.select(*rows.columns, *(v.alias(k) for k, v in keys.items()))


def _packed(x: Column, y: Column) -> Column:
    return x * (1 << 31) + y


def prefix_hashes(line: Column) -> Column:
    """array<long>, one longer than the line: both hashes of each of its prefixes, the sums of code point * base ** place, in one word."""
    # bound once, by a lambda over an array of one
    return F.get(F.transform(F.array(F.split(line, "", F.length(line))), _sums), F.lit(0))


def _sums(chars: Column) -> Column:
    kind = "struct<x:bigint,y:bigint,v:bigint,w:bigint,out:array<{}>>"
    one, many = kind.format("bigint"), kind.format("array<bigint>")
    (p, q), (b, c) = _PRIMES, _BASES
    empty = lambda of: F.array().cast(f"array<{of}>")

    def add(s, char):
        code = F.ascii(char).cast("long")
        x, y = (s["x"] + code * s["v"]) % p, (s["y"] + code * s["w"]) % q
        return F.struct(x.alias("x"), y.alias("y"), (s["v"] * b % p).alias("v"), (s["w"] * c % q).alias("w"), F.concat(s["out"], F.array(_packed(x, y))).alias("out")).cast(one)

    def add_block(s, i):
        start = F.struct(s["x"].alias("x"), s["y"].alias("y"), s["v"].alias("v"), s["w"].alias("w"), empty("bigint").alias("out")).cast(one)
        done = F.aggregate(F.slice(chars, i * _BLOCK + 1, F.lit(_BLOCK)), start, add)
        return F.get(F.transform(F.array(done), lambda d: F.struct(d["x"].alias("x"), d["y"].alias("y"), d["v"].alias("v"), d["w"].alias("w"), F.concat(s["out"], F.array(d["out"])).alias("out"))), F.lit(0)).cast(many)

    first = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(1).alias("v"), F.lit(1).alias("w"), empty("array<bigint>").alias("out")).cast(many)
    blocks = F.sequence(F.lit(0), F.floor((F.size(chars) - 1) / _BLOCK).cast("int"))
    return F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.aggregate(blocks, first, add_block, lambda s: s["out"])))


def variant_hash(prefixes: Column, place: Column) -> Column:
    """The hash of a line without the character at ``place``, from ``prefix_hashes``; as ``whole_hash`` of what is left."""
    size = F.size(prefixes) - 1
    at, after, end = F.get(prefixes, place), F.get(prefixes, place + 1), F.get(prefixes, size)
    parts = []
    for prime, base, part in ((_PRIMES[0], _BASES[0], lambda v: F.shiftright(v, 31)), (_PRIMES[1], _BASES[1], lambda v: v.bitwiseAND(F.lit((1 << 31) - 1)))):
        parts.append((part(at) + F.pmod(part(end) - part(after), F.lit(prime)) * pow(base, -1, prime)) % prime)
    return F.xxhash64(size - 1, _packed(*parts))


def whole_hash(prefixes: Column) -> Column:
    size = F.size(prefixes) - 1
    return F.xxhash64(size, F.get(prefixes, size))


def _shared(keyed: DataFrame) -> DataFrame:
    """Keys that more than one different line has."""
    return keyed.groupBy("key").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("key")


def line_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, uid, line_no, line) for every line."""
    body = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return body.select("doc_id", _uid(F.col("doc_id"), F.col("text")).alias("uid"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _uid(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"), text.cast("string"))


def near_lines(firsts: DataFrame, texts: DataFrame) -> DataFrame:
    """Of different lines (h1, h2, first, k1 to k4), those with an earlier line within one edit: h1, h2.

    texts: (doc_id, uid, text) of all documents.
    """
    keyed = firsts.select(*_ID, F.explode(F.array("k1", "k2", "k3", "k4")).alias("key"))
    open_lines = with_members(keyed, F.col("key"), _shared(keyed), F.col("key")).select(*_ID).distinct()
    # the text of a line is in the document where it stands first
    open_firsts = stage(firsts.join(open_lines, _ID).select(*_ID, "first", F.col("first.uid").alias("first_uid")))
    lines = with_members(texts, F.col("uid"), open_firsts, F.col("first_uid")).join(open_firsts, (F.col("uid") == F.col("first_uid")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    lines = stage(lines.select(*_ID, "first", F.get(F.split("text", "\n", -1), F.col("first.line_no")).alias("line")).dropDuplicates(_ID))
    quarters = stage(lines.select(*_ID, F.explode(_parts(F.col("line"), 4)).alias("part")).select(*_ID, "part.*"))
    held = with_members(quarters, F.col("key"), _shared(quarters), F.col("key")).join(_shared(quarters), "key", "left_semi")
    # places in the open quarters of a line
    places = F.array_distinct(F.flatten(F.transform("parts", lambda x: F.when(x["end"] > x["start"], F.sequence(x["start"], x["end"] - 1)).otherwise(F.array().cast("array<int>")))))
    held = held.groupBy(*_ID).agg(F.collect_set(F.struct("start", "end")).alias("parts")).withColumn("places", places)
    held = held.select(*_ID, "places").join(lines, _ID).withColumn("prefixes", prefix_hashes(F.col("line")))
    # variants with one character left out, by place; and the lines themselves, without a place
    variant = F.transform("places", lambda i: F.struct(i.alias("place"), variant_hash(F.col("prefixes"), i).alias("variant")))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("place"), whole_hash(F.col("prefixes")).alias("variant")))
    every = stage(held.select(*_ID, "first", F.explode(F.concat(variant, whole)).alias("v")).select(*_ID, "first", "v.*"))
    variants = every.where("place is not null")
    # the earliest line of those that become equal by leaving out the character at the same place
    least = variants.groupBy("variant", "place").agg(F.min(F.struct("first", *_ID)).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    id_of = lambda x: F.struct(*(F.col(f"{x}.{c}") for c in _ID))
    replaced = variants.join(least, ["variant", "place"]).where(F.col("least.first") < F.col("first")).select(F.struct(*_ID).alias("a"), id_of("least").alias("b"), F.col("place").alias("at"), F.col("place").alias("bt"))
    other = every.where("place is null").select("variant", F.struct("first", *_ID).alias("whole"))
    left_out = variants.select("variant", "place", F.struct("first", *_ID).alias("one")).join(other, "variant")
    none = F.lit(None).cast("int")
    later = left_out.where("one.first > whole.first").select(id_of("one").alias("a"), id_of("whole").alias("b"), F.col("place").alias("at"), none.alias("bt"))
    earlier = left_out.where("one.first < whole.first").select(id_of("whole").alias("a"), id_of("one").alias("b"), none.alias("at"), F.col("place").alias("bt"))
    pairs = replaced.unionByName(later).unionByName(earlier)
    # verify the edit: both are the same without the characters left out
    named = lines.select(F.struct(*_ID).alias("id"), "line")
    both = pairs.join(named.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(named.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    rest = lambda line, place: F.when(F.col(place).isNull(), F.col(line)).otherwise(_less(F.col(line), F.col(place), F.col(place) + 1))
    return both.where(rest("x", "at") == rest("y", "bt")).select("a.*").distinct()


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 8, min_edit_chars: int = 20, max_edits: int = 1, removed_col: str | None = None) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``.

    max_edits: 1, or 0 for equal lines only.
    removed_col: adds the numbers (from 0) of the lines that were removed.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    rows = line_rows(docs, doc_id, text).where(F.length("line") >= min_chars)
    halves = ["k1", "k2", "k3", "k4"] if max_edits else []
    rows = _with_halves(rows, min_edit_chars).select(F.struct("doc_id", "uid", "line_no").alias("place"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), *halves)
    firsts = rows.groupBy(*_ID).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), *(F.first(k).alias(k) for k in halves))
    again = firsts.where("n > 1").select(*_ID, "first")
    if max_edits:
        firsts = stage(firsts)
        again = firsts.where("n > 1").select(*_ID, "first")
        body = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), _uid(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("uid"), F.col(f"`{text}`").cast("string").alias("text"))
        near = near_lines(firsts.where("k1 is not null"), body)
        # where an earlier line is near, the first occurrence goes too
        again = again.join(near.withColumn("near", F.lit(True)), _ID, "full").select(*_ID, "first", F.coalesce("near", F.lit(False)).alias("near"))
    else:
        again = again.withColumn("near", F.lit(False))
    again = stage(again)
    if max_edits:
        drop_staged(firsts)
    # names that no column of the documents has
    uid_, id_, own_, gone_, text_, lines_, bounds_, kept_ = unused([*docs.columns, removed_col or text], "uid", "id", "own", "gone", "whole", "lines", "bounds", "kept")
    gone = with_members(rows.select("place", *_ID), F.col("h1"), again, F.col("h1")).join(again, _ID).where(F.col("near") | (F.col("place") > F.col("first")))
    gone = stage(gone.groupBy(F.col("place.doc_id").alias(id_), F.col("place.uid").alias(uid_)).agg(F.array_sort(F.collect_set("place.line_no")).alias(gone_)))
    # texts without a removed line don't shuffle
    body = F.col(f"`{text}`").cast("string")
    keyed = docs.withColumn(own_, _uid(F.col(f"`{doc_id}`"), body))
    same = (F.col(own_) == F.col(uid_)) & F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(id_))
    cut = with_members(keyed, F.col(own_), gone, F.col(uid_)).join(gone, same, "left")
    whole = without_members(keyed, F.col(own_), gone, F.col(uid_)).withColumn(gone_, F.lit(None).cast("array<int>"))
    names = [F.col(f"`{c}`") for c in docs.columns if c not in (text, removed_col)]
    # the lines between one removed line and the next; the bounds are columns, so that they are worked out once
    cut = cut.select(*names, body.alias(text_), gone_, F.split(body, "\n", -1).alias(lines_))
    cut = cut.select("*", F.concat(F.array(F.lit(-1)), gone_, F.array(F.size(lines_))).alias(bounds_))
    between = F.transform(F.sequence(F.lit(0), F.size(gone_)), lambda i: F.slice(lines_, F.get(bounds_, i) + 2, F.get(bounds_, i + 1) - F.get(bounds_, i) - 1))
    kept = F.when(F.col(gone_).isNull(), F.col(text_)).otherwise(F.array_join(F.flatten(between), "\n"))
    cut = cut.select(*names, kept.alias(kept_), gone_)
    both = cut.unionByName(whole.select(*names, body.alias(kept_), gone_))
    out = [F.col(kept_).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != removed_col]
    if removed_col:
        out.append(F.coalesce(gone_, F.array().cast("array<int>")).alias(removed_col))
    return both.select(*out)
