"""Suffix-array dedup: longest-previous-factor arrays over text bytes.

A repeated byte string of at least ``length`` is found in two steps.

1. Each document is cut into overlapping segments by minimizers: the window of
   ``length`` bytes at each position belongs to the smallest hash of its
   ``ANCHOR``-byte strings, and neighbouring windows with the same smallest
   hash form a segment.  Equal windows have equal hashes wherever they occur,
   so a window can only recur in segments with its hash.  Equal segments are
   combined by a hash of their bytes before anything else looks at them.
2. Different segments that share a hash are laid end to end and sorted into a
   suffix array (to the depth of ``length`` bytes; nothing beyond matters).
   Previous and next smaller positions in suffix order give each position its
   longest previous factor; the same from the other end gives its longest later
   one.

Only the keys of segments are shuffled; the bytes are fetched for those that
share a hash with a different one.  A hash with more segments, or longer ones,
than are sorted at once is dealt out as pairs of tiles, so no group is gathered whole.

Defined results: null text is empty; texts shorter than ``length`` keep every
byte; a null doc_id is an id like any other; rows that are equal, or have the
same doc_id, are different documents and match each other; an empty table gives
an empty result.  Columns besides id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import Rolling, binary_array, chunks, cover, drop_staged, partitions, runs, stage, text_bytes, with_members, without_members

#: Bytes of the strings whose smallest hash a window belongs to.
ANCHOR = 48
#: Bytes of segments that are sorted at once, and segments in a tile of a large group.
SORT_BYTES = 1 << 20
TILE = 1024


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by running minima of blocks from both ends."""
    n = len(x)
    if n < width:
        return x[:0]
    pad = -n % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int, rolling: Rolling) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows and hash of each segment, and whether the hash occurs in it more than once."""
    k = min(ANCHOR, length)
    n, width = len(data), length - k + 1
    if n < length:
        return (*(np.zeros(0, np.int64),) * 4, np.zeros(0, bool))
    at = np.arange(n - k + 1)
    value = rolling.spans(rolling.prefix(data), at, at + k)
    least = sliding_minimum(value, width)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = row[: len(least)] == row[length - 1 :]
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (least[1:] != least[:-1]) | (row[1 : len(least)] != row[: len(least) - 1])
    last = whole.copy()
    last[:-1] &= ~whole[1:] | new[1:]
    start, windows = np.flatnonzero(new), np.flatnonzero(last) - np.flatnonzero(new) + 1
    # places whose value is the smallest of some window, and how many of those in a segment have its hash
    highest = ~sliding_minimum(~np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width)
    anchors = np.flatnonzero(value == highest)
    lo, hi = np.searchsorted(anchors, start), np.searchsorted(anchors, start + windows + width - 1)
    owner = np.repeat(np.arange(len(start)), hi - lo)
    near = np.arange(len(owner)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    same = np.bincount(owner[value[anchors[near]] == least[start][owner]], minlength=len(start))
    return row[start], start - offsets[row[start]], windows, least[start].view(np.int64), same > 1


def rank_levels(data: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(m, rank of each position by its next m bytes) for m = 7, 14, ... and at last ``depth``; bytes beyond the end are smallest."""
    n = len(data)
    padded = np.concatenate([data.astype(np.uint16) + 1, np.zeros(depth + 8, np.uint16)])
    width, step = 1, padded.astype(np.int64)
    out = []
    while width < min(7, depth):  # seven bytes of 9 bits in a word
        step = (step[:-1] << np.int64(9)) | padded[width : width + len(step) - 1]
        width += 1
    rank = np.unique(step, return_inverse=True)[1].astype(np.int64)
    out.append((width, rank[:n].astype(np.int32)))
    while width < depth:
        more = min(width, depth - width)
        wide = len(rank) - more
        pair = rank[:wide] * np.int64(rank.max() + 1) + rank[more:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        width += more
        out.append((width, rank[:n].astype(np.int32)))
    return out


def common_prefix(levels: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at i and j share, up to the deepest level; -1 for an absent one (j < 0)."""
    n = len(levels[0][1])
    out = np.where(j < 0, -1, 0)
    live = j >= 0
    full, rank = levels[-1]
    same = live & (rank[i] == rank[np.maximum(j, 0)])
    out[same] = full
    live &= ~same
    for width, rank in reversed(levels[:-1]):
        a, b = i + out, j + out
        ok = live & (a < n) & (b < n)
        ok[ok] = rank[a[ok]] == rank[b[ok]]
        out[ok] += width
    # fewer than the least width are left
    return out


def nearest_smaller(order: np.ndarray) -> np.ndarray:
    """For each index, the nearest one before it whose value is smaller, or -1."""
    at = np.arange(len(order)) - 1
    todo = np.flatnonzero((at >= 0) & (order[np.maximum(at, 0)] > order))
    while len(todo):
        at[todo] = at[at[todo]]
        todo = todo[(at[todo] >= 0) & (order[np.maximum(at[todo], 0)] > order[todo])]
    return at


def factors(positions: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Longest previous factor of each of ``positions``, which are in suffix order, as an array in that order.

    The two candidates are the nearest entries, before and after in suffix
    order, that stand at a smaller position.  For the longest later factor,
    compare negated positions (see ``repeated_starts``).
    """
    n = len(positions)
    before = nearest_smaller(positions)
    after = nearest_smaller(positions[::-1])[::-1]
    after = np.where(after < 0, -1, n - 1 - after)
    at = np.abs(positions)
    return np.maximum(*(common_prefix(levels, at, np.where(x < 0, -1, at[x])) for x in (before, after)))


def repeated_starts(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Over texts laid end to end: flags of the positions whose window recurs earlier, and later.

    Windows that cross the end of a text take no part.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.flatnonzero(np.arange(len(data)) + length <= np.repeat(np.cumsum(sizes), sizes))
    flags = np.zeros((2, len(data)), dtype=bool)
    if len(starts):
        levels = rank_levels(data, length)
        order = starts[np.lexsort((starts, levels[-1][1][starts]))]
        for k, positions in enumerate((order, -order)):
            flags[k, order[factors(positions, levels) >= length]] = True
    return flags[0], flags[1]


_SEGS = "uid long, doc_id long, first long, windows long, again boolean, low long, c1 long, c2 long"


def dedup_suffixes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 400, keep_first: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, spans (removed bytes, from and to), kept (binary).

    Removed is each byte covered by a string of ``length`` bytes that also
    starts earlier (in the order of doc_id, null first, then of a hash of the
    row, then of the place); with ``keep_first=False``, anywhere else.  Of rows
    equal in id and text, ``keep_first`` keeps the first place in each.
    """
    parts = partitions(docs.sparkSession)
    body = F.coalesce(F.encode(F.col(f"`{text}`").cast("string"), "UTF-8"), F.lit(b""))
    keyed = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("data")).withColumn("uid", F.xxhash64("doc_id", "data"))

    def keys(batches):
        rolling = Rolling(3)
        for batch in chunks(batches, "data"):
            data, offsets = text_bytes(batch.column("data"))
            row, first, windows, low, again = segments(data, offsets, length, rolling)
            raw = memoryview(np.ascontiguousarray(data))
            at = offsets[row] + first
            content = b"".join(xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(at.tolist(), (at + windows + length - 1).tolist(), strict=True))
            content = np.frombuffer(content, np.int64).reshape(-1, 2)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("uid").take(row), batch.column("doc_id").take(row), *map(pa.array, (first, windows, again, low, content[:, 0].copy(), content[:, 1].copy()))], names=[x.split()[0] for x in _SEGS.split(", ")])

    kind = ["low", "c1", "c2"]
    segs = stage(keyed.mapInArrow(keys, _SEGS))
    kinds = segs.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "uid", "first")).alias("one"), F.first("windows").alias("windows"), F.first("again").alias("again"))
    # a table of its own: a join on a hash that very many kinds share can then be split
    groups = kinds.groupBy("low").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("windows") + length - 1).alias("bytes"), F.max("again").alias("any_again")).where("kinds > 1 or any_again")
    groups = stage(groups.select("low", F.ceil(F.greatest(F.col("kinds") / TILE, F.col("bytes") / SORT_BYTES)).cast("int").alias("tiles")))
    # kinds that may match another or themselves, and those that occur more than once; few beside all segments
    shared = stage(with_members(kinds, F.col("low"), groups, F.col("low")).join(groups, "low").select(*kind, "one", F.col("one.uid").alias("uid"), F.col("windows").alias("size"), "tiles"))
    drop_staged(groups)
    whole = kinds.where("n > 1").select(*kind, F.lit(0).cast("long").alias("from"), F.col("windows").alias("to"), "one")

    # the bytes of one segment of each kind; a large group goes to every pair of its tiles
    texts = with_members(keyed.select("uid", "doc_id", "data"), F.col("uid"), shared, F.col("uid"))
    fetched = shared.join(texts, (shared["uid"] == texts["uid"]) & texts["doc_id"].eqNullSafe(F.col("one.doc_id"))).withColumn("data", F.substring("data", (F.col("one.first") + 1).cast("int"), (F.col("size") + length - 1).cast("int")))
    tile = F.pmod("c1", F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.least(t, tile).cast("long") * (1 << 31) + F.greatest(t, tile))
    dealt = fetched.select(*kind, "one", "data", F.explode(pairs).alias("pair")).withColumn("part", F.pmod(F.xxhash64("low", "pair"), F.lit(parts)).cast("int"))

    def sort_out(group: list[dict]) -> pa.RecordBatch | None:
        # a kind comes more than once where equal rows have its segment
        group = list({(r["low"], r["pair"], r["c1"], r["c2"]): r for r in group}.values())
        place = lambda r: (r["low"], r["pair"], r["one"]["doc_id"] is not None, r["one"]["doc_id"] or 0, r["one"]["uid"], r["one"]["first"])
        group.sort(key=place)
        flags = repeated_starts([r["data"] for r in group], length)
        out, at = [], 0
        for r in group:
            to = at + len(r["data"])
            for earlier in (True, False):
                for s, e in zip(*runs(flags[not earlier][at:to]), strict=True):
                    out.append((r["low"], r["c1"], r["c2"], earlier, int(s), int(e)))
            at = to
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[*kind, "earlier", "from", "to"]) if out else None

    def sorted_out(batches):
        group, size, last = [], 0, None
        for batch in batches:
            for r in batch.to_pylist():
                key = r["low"], r["pair"]
                # two pairs of one hash have segments in common, which would recur in themselves
                if last is not None and key != last and (size >= SORT_BYTES or key[0] == last[0]):
                    if (b := sort_out(group)) is not None:
                        yield b
                    group, size = [], 0
                group.append(r)
                size += len(r["data"])
                last = key
        if group and (b := sort_out(group)) is not None:
            yield b

    found = dealt.repartitionById(parts, "part").sortWithinPartitions("low", "pair").mapInArrow(sorted_out, "low long, c1 long, c2 long, earlier boolean, `from` long, `to` long")
    if keep_first:
        found = found.where("earlier")
    marks = stage(whole.unionByName(found.select(*kind, "from", "to", F.lit(None).cast(kinds.schema["one"].dataType).alias("one"))))
    hits = with_members(segs, F.col("c1"), marks, F.col("c1")).join(marks, kind)
    if keep_first:
        hits = hits.where(F.col("one").isNull() | ~F.struct("doc_id", "uid", "first").eqNullSafe(F.col("one")))
    spans = stage(hits.groupBy("uid", F.col("doc_id").alias("id")).agg(F.collect_list(F.struct((F.col("first") + F.col("from")).alias("from"), (F.col("first") + F.col("to") + length - 1).alias("to"))).alias("spans")))
    uid = F.col("uid")
    mine = with_members(keyed, uid, spans, uid)
    cut = mine.join(spans, (mine["uid"] == spans["uid"]) & mine["doc_id"].eqNullSafe(F.col("id")), "left").select("doc_id", "data", "spans")
    left = without_members(keyed, uid, spans, uid).select("doc_id", "data", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return cut.unionByName(left).mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<`from`:long,`to`:long>>, kept binary")


def _cut(batches):
    """Take the spans out of the bytes of each row."""
    span = pa.struct([("from", pa.int64()), ("to", pa.int64())])
    for batch in chunks(batches, "data"):
        data, offsets = text_bytes(batch.column("data"))
        lists = batch.column("spans")
        count = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        flat = lists.flatten()
        base = np.repeat(offsets[:-1], count)
        gone = cover(len(data), base + np.asarray(flat.field(0)), base + np.asarray(flat.field(1)))
        # a run ends where its row does
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        inside = np.concatenate([[False], gone, [False]])
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        first = np.searchsorted(starts, offsets)
        base = np.repeat(offsets[:-1], np.diff(first))
        spans = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], fields=list(span)))
        kept = np.concatenate([[0], np.cumsum(~gone)])[offsets]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), spans, binary_array(data[~gone], kept)], names=["doc_id", "n_bytes", "spans", "kept"])
