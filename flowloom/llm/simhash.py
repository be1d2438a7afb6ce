"""SimHash near-dedup: tiled exact comparison of 64-bit fingerprints.

Equal fingerprints are first combined.  The different ones are dealt into
tiles by their number of set bits; two tiles whose counts differ by more than
the radius can't hold a link and are never brought together.  A pair of tiles is
compared in numpy by exclusive-or and bit counts, and inside it the same rule,
applied to the set bits of each quarter of the fingerprint, skips blocks
whose quarters differ by more than the radius in all.  Each pair of tiles emits
a spanning forest of its links, so a dense group gives as many rows as it has
members, not pairs; the forests are then joined into components by repeated
star contraction over DataFrames, cut by tables in the shared folder.

The number of comparisons grows with the square of the number of different
fingerprints, times the share that the counts don't skip (some 5 %).

Defined results: null and empty texts, and texts of separators, have
fingerprint zero and link like any other; a null doc_id is ignored as a
component's name unless all of its rows have none; repeated rows each give a
row; an empty table gives an empty result.  Columns besides id and text are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import SPACE, binary_array, chunks, drop_staged, give_back, join_words, lower_ascii, mix64, partitions, small_batches, stage, text_bytes, unused, with_members, without_members, word_spans

SEED = 42
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

#: Fingerprints in a tile at most, about; and comparisons made at once.
TILE = 1 << 18
_AT_ONCE = 1 << 20

#: Shingles of the sample that tells rare from common ones, about; and bits of the hash by which it counts.
SAMPLED = 1 << 23
CELL_BITS = 24


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_short(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of spans of fewer than 32 bytes each, all at once."""
    padded = np.concatenate([data, np.zeros(40, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    h = np.uint64(seed) + _P5 + sizes.astype(np.uint64)
    at = starts.copy()
    left = sizes.copy()
    for _ in range(3):
        m = np.flatnonzero(left >= 8)
        if not len(m):
            break
        lane = np.ascontiguousarray(words[at[m]]).view("<u8").ravel()
        h[m] = _rotl(h[m] ^ (_rotl(lane * _P2, 31) * _P1), 27) * _P1 + _P4
        at[m] += 8
        left[m] -= 8
    m = np.flatnonzero(left >= 4)
    lane = np.ascontiguousarray(words[at[m], :4]).view("<u4").ravel().astype(np.uint64)
    h[m] = _rotl(h[m] ^ (lane * _P1), 23) * _P2 + _P3
    at[m] += 4
    left[m] -= 4
    for _ in range(3):
        m = np.flatnonzero(left > 0)
        if not len(m):
            break
        h[m] = _rotl(h[m] ^ (padded[at[m]].astype(np.uint64) * _P5), 11) * _P1
        at[m] += 1
        left[m] -= 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def xxh64_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of spans of a byte buffer."""
    long = np.flatnonzero(sizes >= 32)
    out = xxh64_short(data, starts, np.where(sizes < 32, sizes, 0), seed)
    raw = memoryview(np.ascontiguousarray(data))
    out[long] = [xxhash.xxh64_intdigest(raw[s:e], seed) for s, e in zip(starts[long].tolist(), (starts[long] + sizes[long]).tolist(), strict=True)]
    return out


def shingle_hashes(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """XXH64 of each row's shingles of words, their number in each row, and the joined words (bytes and offsets)."""
    data, offsets = text_bytes(column)
    data = lower_ascii(data)
    starts, ends, before = word_spans(data, offsets, SPACE)
    # the words of each row with one space between, so that a shingle is a span
    flat, offsets = text_bytes(join_words(data, offsets, starts, ends))
    starts, ends, before = word_spans(flat, offsets, SPACE)
    words = np.diff(before)
    count = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    first = np.repeat(before[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    last = np.minimum(first + shingle - 1, np.repeat(before[1:], count) - 1)
    return xxh64_spans(flat, starts[first], ends[last] - starts[first]), count, (flat, offsets)


def distinct_hashes(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's different hashes, ascending, and their number in each row."""
    own = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[new], np.bincount(own[new], minlength=len(count))


def majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each row's hashes, a word with the bits that are set in over half of them; no hashes: zero."""
    out = np.zeros(len(count), np.uint64)
    rows = np.flatnonzero(count)
    sums = np.zeros((len(count), 64), np.int32)
    step, owner = 1 << 16, np.repeat(np.arange(len(count)), count)
    for i in range(0, len(h), step):
        bits = np.unpackbits(h[i : i + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[i : i + step]
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sums[own[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int32)
    over = sums[rows] * 2 > count[rows, None]
    out[rows] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(column: pa.Array, shingle: int = 3) -> np.ndarray:
    """64-bit SimHash of each text."""
    h, count, _ = shingle_hashes(column, shingle)
    return majority(h, count)


def quarters(x: np.ndarray) -> np.ndarray:
    """Set bits in each 16-bit quarter."""
    return np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16)


class Forest:
    """Sets of indexes, joined; the joins that changed something are its edges."""

    def __init__(self, n: int):
        self.name = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        name = self.name
        while name[i] != i:
            name[i] = name[name[i]]
            i = name[i]
        return int(i)

    def flatten(self) -> None:
        while True:
            up = self.name[self.name]
            if (up == self.name).all():
                return
            self.name = up

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        self.flatten()
        new = self.name[i] != self.name[j]
        if not new.any():
            return
        i, j = i[new], j[new]
        _, one = np.unique(self.name[i].astype(np.int64) * len(self.name) + self.name[j], return_index=True)
        for a, b in zip(i[one].tolist(), j[one].tolist(), strict=True):
            x, y = self.find(a), self.find(b)
            if x != y:
                self.name[max(x, y)] = min(x, y)
                self.edges.append((a, b))


def close_pairs(a: np.ndarray, b: np.ndarray | None, radius: int):
    """Blocks (i, j, distance) of the pairs within the radius, inside ``a`` (b None; i below j) or between ``a`` and ``b``.

    Both have a row of 64-bit words for each fingerprint.  A small radius skips
    blocks by the set bits of each quarter of a word, a larger one by all set bits.
    """
    own = b is None
    b = a if own else b
    counts = lambda x: quarters(x).reshape(len(x), -1) if radius <= 8 else np.bitwise_count(x).sum(axis=1, dtype=np.int16)[:, None]
    qa, qb = counts(a), counts(b)
    order_a, order_b = np.lexsort(qa.T), np.lexsort(qb.T)
    qa, qb, xa, xb = qa[order_a], qb[order_b], a[order_a], b[order_b]
    new = lambda q: np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]).any(axis=1)])) if len(q) else np.zeros(0, int)
    sa, sb = new(qa), new(qb)
    ea, eb = np.append(sa[1:], len(xa)), np.append(sb[1:], len(xb))
    for s, e in zip(sa, ea, strict=True):
        near = np.flatnonzero(np.abs(qb[sb] - qa[s]).sum(axis=1) <= radius)
        if own:
            near = near[sb[near] >= s]
        if not len(near):
            continue
        sizes = eb[near] - sb[near]
        others = np.repeat(sb[near] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        theirs = xb[others]
        step = max(1, _AT_ONCE // len(others))
        for at in range(s, e, step):
            mine = np.arange(at, min(e, at + step))
            d = np.zeros((len(mine), len(others)), np.uint8 if a.shape[1] < 4 else np.uint16)
            for w in range(a.shape[1]):
                d += np.bitwise_count(xa[mine, w][:, None] ^ theirs[None, :, w])
            i, j = np.nonzero(d <= radius)
            d = d[i, j]
            i, j = mine[i], others[j]
            if own:
                below = i < j
                i, j, d = i[below], j[below], d[below]
            if len(i):
                yield order_a[i], order_b[j], d


def tile_forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within a tile or between two, by least distance: indexes into ``a`` then ``b``."""
    n = len(a) + (0 if b is None else len(b))
    kept = np.zeros((3, 0), np.int64)
    for i, j, d in close_pairs(a, b, radius):
        new = np.stack([i, j + (0 if b is None else len(a)), d]).astype(np.int64)
        kept = np.concatenate([kept, new], axis=1)
        forest, edges = Forest(n), []
        for level in np.unique(kept[2]):
            before = len(forest.edges)
            at = kept[:2, kept[2] == level]
            forest.join(at[0], at[1])
            edges += [(x, y, int(level)) for x, y in forest.edges[before:]]
        kept = np.array(edges, dtype=np.int64).reshape(-1, 3).T
    return kept[0], kept[1]


def links(prints: DataFrame, radius: int, words: list[str]) -> DataFrame:
    """Edges (a, b) between values of ``node``, whose fingerprints are the columns ``words``: a spanning forest for each pair of tiles."""
    spark = prints.sparkSession
    parts = partitions(spark)
    pop = sum((F.bit_count(w) for w in words[1:]), F.bit_count(words[0]))
    counted = prints.withColumn("pop", pop)
    sizes = {r["pop"]: r["count"] for r in counted.groupBy("pop").count().collect()}  # 64 rows for each word, and one
    if not sizes:
        return prints.select(F.col("node").alias("a"), F.col("node").alias("b")).where("false")
    # a tile has a range of counts, or a share of those with one count
    most = min(TILE, max(1024, -(-sum(sizes.values()) // 16)))
    first, blocks, tile_pops, held = {}, {}, [], 0
    for p in sorted(sizes):
        blocks[p] = -(-sizes[p] // most)
        if blocks[p] > 1 or held == 0 or held + sizes[p] > most:
            first[p] = len(tile_pops)
            tile_pops += [[p, p] for _ in range(blocks[p])]
            held = sizes[p] if blocks[p] == 1 else 0
        else:
            first[p] = len(tile_pops) - 1
            tile_pops[-1][1] = p
            held += sizes[p]
    # tiles are in order of their counts, so those within the radius are neighbours: one row for each tile
    lows, highs = (np.array(x) for x in zip(*tile_pops, strict=True))
    bounds = {"own": np.arange(len(lows)), "first_other": np.searchsorted(highs, lows - radius), "last_other": np.searchsorted(lows, highs + radius, side="right") - 1}
    # an Arrow table is read by the JVM; a list of rows would start Python workers of its own
    near = F.broadcast(spark.createDataFrame(pa.table({k: pa.array(v, pa.int32()) for k, v in bounds.items()})))
    lookup = lambda values: F.array(*(F.lit(v) for v in values))
    by_pop = lambda values: F.get(lookup([values.get(p, 0) for p in range(64 * len(words) + 1)]), F.col("pop"))
    own = by_pop(first) + F.pmod(F.xxhash64("node"), by_pop(blocks)).cast("int")
    others = F.explode(F.sequence("first_other", "last_other"))
    dealt = counted.withColumn("own", own).join(near, "own").select("node", *words, "own", others.alias("other"))
    dealt = dealt.select("node", *words, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("second"))
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("x", "y"), F.lit(parts)).cast("int"))

    def compare(batches):
        def done(key, sides):
            tables = [np.concatenate(side) if side else np.zeros((0, 1 + len(words)), np.int64) for side in sides]
            a, b = (t[:, 1:].view(np.uint64) for t in tables)
            b = None if key[0] == key[1] else b
            ids = np.concatenate([t[:, 0] for t in tables])
            yield tuple(ids[x] for x in tile_forest(a, b, radius))

        def all_done():
            sides: tuple[list, list] = ([], [])
            last = None
            for batch in batches:
                x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
                rows = np.stack([batch.column(c).to_numpy() for c in ("node", *words)], axis=1)
                second = batch.column("second").to_numpy(zero_copy_only=False)
                bounds = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]), [True]]))
                for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                    key = int(x[s]), int(y[s])
                    if last is not None and key != last:
                        yield from done(last, sides)
                        sides = ([], [])
                    last = key
                    for side, flag in ((sides[0], ~second[s:e]), (sides[1], second[s:e])):
                        side.append(rows[s:e][flag])
            if last is not None:
                yield from done(last, sides)

        for a, b in all_done():
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        give_back()

    return dealt.repartitionById(parts, "task").sortWithinPartitions("x", "y").drop("task").mapInArrow(compare, "a long, b long")


#: Members of a bucket of equal blocks in a tile at most, about.
BUCKET = 1 << 13


def whole_groups(batches, columns: list[str], keys: int):
    """Rows (numbers of ``columns``; and the other columns of the batch, as arrays) of sorted batches, cut where the first ``keys`` columns change."""
    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], axis=1)
        rest = pa.Table.from_batches([batch.drop_columns(columns)])
        if left is not None:
            rows, rest = np.concatenate([left[0], rows]), pa.concat_tables([left[1], rest])
        # the last group may go on in the next batch
        other = np.flatnonzero((rows[:, :keys] != rows[-1, :keys]).any(axis=1))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield rows[:cut], rest.slice(0, cut)
        left = rows[cut:], rest.slice(cut)
    if left is not None and len(left[0]):
        yield left


def later_rows(after: np.ndarray, last: np.ndarray, limit: int):
    """Blocks (i, j) of each row i with all rows from ``after[i]`` to before ``last[i]``, of some ``limit`` pairs each."""
    number = last - after
    done = np.cumsum(number)
    at = 0
    while at < len(after):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + limit, side="right")))
        n = number[at:to]
        if n.any():
            yield np.repeat(np.arange(at, to), n), np.repeat(after[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = to


def group_ends(rows: np.ndarray, columns: int) -> np.ndarray:
    """For each row, where its run of equal first columns ends."""
    start = np.flatnonzero(np.concatenate([[True], (rows[1:, :columns] != rows[:-1, :columns]).any(axis=1)]))
    end = np.append(start[1:], len(rows))
    return np.repeat(end, end - start)


def block_links(prints: DataFrame, radius: int, words: list[str]) -> DataFrame:
    """Edges (a, b) between values of ``node`` whose fingerprints, the columns ``words``, are within the radius and equal in a block of 16 bits.

    Every pair that differs in fewer bits than there are blocks is equal in one,
    of more distant ones a share; what is missed is for a later step to find.
    Nodes meet in buckets, one for each block and its value, so comparisons are
    one in 65,536 of all pairs for each block.  A large bucket is dealt into pairs of tiles.
    Each gives a spanning forest of its links, by least distance.
    """
    parts = partitions(prints.sparkSession)
    blocks = F.array(*(F.shiftright(w, 16 * k).bitwiseAND(F.lit(0xFFFF)) for w in words for k in range(4)))
    rows = prints.select("node", *words, F.posexplode(blocks).alias("block", "value")).select("node", *words, (F.col("block") * 65536 + F.col("value")).cast("int").alias("bucket"))
    large = stage(rows.groupBy("bucket").count().where(F.col("count") > BUCKET).select("bucket", F.ceil(F.col("count") / BUCKET).cast("int").alias("tiles")))
    dealt = rows.join(F.broadcast(large), "bucket", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own, other = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = dealt.select("bucket", "node", *words, own.alias("own"), other.alias("other"))
    dealt = dealt.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("second"), "node", *words)

    def compare(batches):
        for rows, _ in whole_groups(batches, ["bucket", "x", "y", "second", "node", *words], 3):
            bits = rows[:, 5:].view(np.uint64)
            last, side = group_ends(rows, 3), group_ends(rows, 4)
            # inside a tile each row meets the later ones, between two those of the first side meet the second
            across = rows[:, 1] != rows[:, 2]
            after = np.where(across, side, np.arange(len(rows)) + 1)
            kept = np.zeros((3, 0), np.int64)

            def forest(kept):
                kept = kept[:, np.lexsort((rows[kept[1], 4], rows[kept[0], 4], kept[2]))]
                joined, edges = Forest(len(rows)), []
                for level in np.unique(kept[2]):
                    before = len(joined.edges)
                    joined.join(*kept[:2, kept[2] == level])
                    edges += [(a, b, int(level)) for a, b in joined.edges[before:]]
                return np.array(edges, dtype=np.int64).reshape(-1, 3).T

            for i, j in later_rows(after, last, _AT_ONCE):
                d = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
                near = d <= radius
                kept = np.concatenate([kept, np.stack([i[near], j[near], d[near]])], axis=1)
                if kept.shape[1] > _AT_ONCE:
                    kept = forest(kept)
            a, b, _ = forest(kept)
            yield pa.RecordBatch.from_arrays([pa.array(rows[a, 4]), pa.array(rows[b, 4])], names=["a", "b"])
        give_back()

    held = dealt.repartition(parts, "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "second")
    found = held.mapInArrow(compare, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


#: Bits of a sketch, at least and at most; between, twice the number of shingles or more.
SKETCH = (128, 1 << 14)


def sketch_bits(count: np.ndarray) -> np.ndarray:
    return np.clip(1 << np.ceil(np.log2(np.maximum(2 * count, 1))).astype(np.int64), *SKETCH)


def sketches(h: np.ndarray, count: np.ndarray) -> pa.Array:
    """Of each row's different hashes, a sketch: of every bit, whether an odd number of hashes fall on it.

    Two sketches differ in as many bits as their sets have elements that the
    other lacks, at most.  Halves put together by exclusive-or are the sketch of half as many bits.
    """
    bits = sketch_bits(count)
    offsets = np.concatenate([[0], np.cumsum(bits >> 6)])
    own = np.repeat(np.arange(len(count)), count)
    at = (mix64(h) & (bits[own] - 1).astype(np.uint64)).astype(np.int64)
    words = np.zeros(offsets[-1], np.uint64)
    np.bitwise_xor.at(words, offsets[own] + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return binary_array(words.view(np.uint8), offsets * 8)


def within(sketch: pa.Array, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of the pairs (i, j) of rows, whether their sketches differ in ``most`` bits or fewer, as sets that differ in no more do."""
    data, offsets = text_bytes(sketch)
    data, offsets = np.ascontiguousarray(data).view(np.uint64), offsets // 8
    size = np.diff(offsets)
    narrow = np.minimum(size[i], size[j])
    ok = np.zeros(len(i), bool)
    for n in np.unique(narrow):
        pairs = np.flatnonzero(narrow == n)
        rows, at = np.unique(np.concatenate([i[pairs], j[pairs]]), return_inverse=True)
        table = np.zeros((len(rows), n), np.uint64)
        for wide in np.unique(size[rows]):
            own = np.flatnonzero(size[rows] == wide)
            for part in range(0, wide, n):
                table[own] ^= data[offsets[rows[own]][:, None] + part + np.arange(n)]
        x, y = at[: len(pairs)], at[len(pairs) :]
        step = max(1, _AT_ONCE // n)
        for s in range(0, len(pairs), step):
            d = np.bitwise_count(table[x[s : s + step]] ^ table[y[s : s + step]]).sum(axis=1, dtype=np.int64)
            ok[pairs[s : s + step]] = d <= most[pairs[s : s + step]]
    return ok


#: Shares into which the rows of one node are dealt in a join.
SALTS = 8


def _with_least(edges: DataFrame, node: str, salt: str, least: DataFrame) -> DataFrame:
    """``edges`` with ``m`` from ``least`` (node, m) for the node in column ``node``; null where there is none.

    A node with very many edges is dealt into ``SALTS`` shares by its neighbour.
    """
    salted = edges.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    every = least.select(F.col("node").alias(node), "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return salted.join(every, [node, "salt"], "left").select("a", "b", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, least) for every node of the edges (a, b) but the smallest of each component: the smallest node it is joined to.

    Edges lead from the larger to the smaller node.  Two contractions alternate
    until every component is a star: the larger neighbours of a node go to the
    smallest node it has, then a node's smaller neighbours and itself do.  A
    round's edges are a table in the shared folder.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    least_of = lambda d: d.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    while True:
        # a star: no node leads to two others, and none that leads to another is led to
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.where("up > 1 or up = 1 and down = 1").agg(F.count(F.lit(1))).first()[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("least"))
        large = stage(_with_least(edges, "b", "a", least_of(edges)).select("a", F.coalesce("m", "b").alias("b")))
        drop_staged(edges)
        least = least_of(large)
        small = _with_least(large, "a", "b", least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct())
        drop_staged(large)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """Per document: doc_id, fp (64-bit fingerprint as a long) and component_id, the smallest doc_id reachable by links."""
    small_batches(docs.sparkSession)

    def hashed(batches):
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(batch.column("text"), shingle).view(np.int64))], names=["doc_id", "fp"])

    body = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    prints = stage(body.mapInArrow(hashed, "doc_id long, fp long"))
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = components(links(classes.select(F.col("fp").alias("node"), "fp"), radius, ["fp"]))
    return _named(prints, classes.withColumnRenamed("fp", "node"), joined, "fp").select("doc_id", "fp", "component_id")


def _named(prints: DataFrame, classes: DataFrame, joined: DataFrame, node: str) -> DataFrame:
    """``prints`` with component_id: the smallest document of a component, whatever its nodes are called."""
    rooted = classes.join(joined, "node", "left").select("node", "first", F.coalesce("least", "node").alias("root"))
    roots = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(roots, "root").select(F.col("node").alias(node), "component_id"), node)


def group_pairs(batches, similarity: float):
    """Pairs of nodes of different parts and one key, among rows (key, part, node, size, sketch) in that order, that by size and sketch may be similar."""
    for rows, more in whole_groups(batches, ["key", "part", "node", "size"], 1):
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
        rows, sketch = rows[new], more.column("sketch").combine_chunks().filter(pa.array(new))
        for i, j in later_rows(group_ends(rows, 2), group_ends(rows, 1), _AT_ONCE // 4):
            x, y = rows[i, 3], rows[j, 3]
            near = np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-6
            i, j, x, y = i[near], j[near], x[near], y[near]
            near = within(sketch, i, j, x + y - 2 * np.ceil(similarity / (1 + similarity) * (x + y) - 1e-6).astype(np.int64))
            i, j = i[near], j[near]
            swap = rows[i, 2] > rows[j, 2]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (rows[i, 2], rows[j, 2], rows[i, 3], rows[j, 3])], names=["a", "b", "na", "nb"])
    give_back()


def rare_pairs(body: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes in different parts: all with a Jaccard ``similarity`` or more, and some others.

    body: (uid, text); nodes: (node, uid, size, part), size the number of different shingles.

    A text of n shingles shares at least similarity * n with any that is similar
    enough, so the two have one among the first n - similarity * n + 1 of each, in
    whatever order all texts keep to.  The order is by frequency in a sample,
    rare ones first, and then by hash: the sample bears on speed only.  Of the pairs
    of a group with one such shingle those go, before they leave it, whose sizes differ too much or whose
    sketches differ in more bits than similar sets can have elements apart; then
    those that share so few of their first shingles that the others can't make up for it.
    """
    spark = body.sparkSession
    total = nodes.agg(F.sum("size")).first()[0] or 0
    uid = F.col("uid")
    texts = with_members(body.select("uid", "text"), uid, nodes, uid)
    step = -(-total // SAMPLED) or 1

    def cells(batches):
        for batch in chunks(batches, "text"):
            h, _ = distinct_hashes(*shingle_hashes(batch.column("text"), shingle)[:2])
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(64 - CELL_BITS)).astype(np.int32))], names=["cell"])

    often = texts.where(F.pmod(F.xxhash64("uid"), F.lit(step)) == 0).mapInArrow(cells, "cell int").groupBy("cell").count().where("count > 1")
    often = often.select("cell", F.least("count", F.lit(255)).cast("int").alias("count")).toArrow()  # half as many rows as shingles in the sample, at most
    table = np.zeros(1 << CELL_BITS, np.uint8)
    table[np.asarray(often.column("cell"))] = np.asarray(often.column("count"))
    table = spark.sparkContext.broadcast(table)
    least = lambda n: np.ceil(similarity * n - 1e-6).astype(np.int64)

    def first_ones(batches):
        for batch in chunks(batches, "text"):
            h, count = distinct_hashes(*shingle_hashes(batch.column("text"), shingle)[:2])
            own = np.repeat(np.arange(len(count)), count)
            order = np.lexsort((h, table.value[h >> np.uint64(64 - CELL_BITS)], own))
            taken = np.where(count > 0, count - least(count) + 1, 0)
            at = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
            keys = h[order][at < taken[own]].view(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(taken)]).astype(np.int32)), pa.array(keys))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), keys, sketches(h, count)], names=["uid", "keys", "sketch"])

    first = texts.mapInArrow(first_ones, "uid long, keys array<long>, sketch binary").join(nodes, "uid")
    first = stage(first.select("node", "part", "size", "sketch", "keys")).select("node", "part", "size", "sketch", F.explode("keys").alias("key"))
    # only shingles that are in several parts are shuffled
    key = F.col("key")
    shared = stage(first.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("key"))
    held = with_members(first, key, shared, key).repartition(partitions(spark), "key").sortWithinPartitions("key", "part", "node")

    found = held.select("key", "part", "node", "size", "sketch").mapInArrow(lambda batches: group_pairs(batches, similarity), "a long, b long, na long, nb long").groupBy("a", "b", "na", "nb").count()
    rest = lambda n: F.ceil(similarity * F.col(n) - 1e-6) - 1
    needed = F.ceil(similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-6)
    return found.where(F.col("count") + F.greatest(rest("na"), rest("nb")) >= needed).select("a", "b")


def _similar(docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, uid, node) and, for every node but the first of its group, (node, least); see ``similar_documents``."""
    small_batches(docs.sparkSession)

    def hashed(batches):
        for batch in chunks(batches, "text"):
            h, count, (flat, offsets) = shingle_hashes(batch.column("text"), shingle)
            h, count = distinct_hashes(h, count)
            raw = memoryview(np.ascontiguousarray(flat))
            content = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), np.int64).reshape(-1, 2)
            fps = [majority(h, count), majority(mix64(h ^ np.uint64(0x9E3779B97F4A7C15)), count)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), *(pa.array(content[:, k].copy()) for k in (0, 1)), *(pa.array(x.view(np.int64)) for x in fps), pa.array(count)], names=["doc_id", "uid", "c1", "c2", "f0", "f1", "size"])

    body = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    prints = stage(body.mapInArrow(hashed, "doc_id long, uid long, c1 long, c2 long, f0 long, f1 long, size long"))
    # texts with the same words in the same order are one node, named by one of their rows
    nodes = stage(prints.groupBy("c1", "c2").agg(F.min("uid").alias("node"), F.first("f0").alias("f0"), F.first("f1").alias("f1"), F.first("size").alias("size")))

    def compared(batches):
        for batch in chunks(batches, "x"):
            same = []
            for column in ("x", "y"):
                h, count, _ = shingle_hashes(batch.column(column), shingle)
                same.append(np.split(h, np.cumsum(count)[:-1]))
            ok = []
            for x, y in zip(*same, strict=True):
                x, y = np.unique(x), np.unique(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    uid = F.col("uid")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = stage(pairs)
        texts = with_members(body.select("uid", "text"), uid, pairs.select(F.explode(F.array("a", "b")).alias("uid")), uid)
        both = pairs.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("uid").alias("b"), F.col("text").alias("y")), "b")
        done = stage(both.select("a", "b", "x", "y").mapInArrow(compared, "a long, b long, ok boolean"))
        drop_staged(pairs)
        return done

    def merged(parts: DataFrame, pairs: DataFrame) -> DataFrame:
        """(node, uid, size, part) with the parts that the pairs join made one, each named by its least; the joins are of parts only."""
        name = parts.select("node", "part")
        ends = pairs.join(name.withColumnsRenamed({"node": "a", "part": "x"}), "a").join(name.withColumnsRenamed({"node": "b", "part": "y"}), "b")
        joined = components(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        return stage(parts.join(joined.withColumnRenamed("node", "part"), "part", "left").select("node", "size", F.coalesce("least", "part").alias("part")))

    proposed = verify(block_links(nodes, radius, ["f0", "f1"]))
    joined = components(proposed.where("ok").select("a", "b"))
    parts = stage(nodes.join(joined, "node", "left").select("node", "size", F.coalesce("least", "node").alias("part")))
    extra = verify(rare_pairs(body, parts.withColumn("uid", F.col("node")), shingle, similarity)).where("ok").select("a", "b")
    if not extra.isEmpty():
        parts = merged(parts, extra)
    return prints.join(nodes.select("c1", "c2", "node"), ["c1", "c2"]).select("doc_id", "uid", "node"), parts.where("node <> part").select("node", F.col("part").alias("least"))


def similar_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 28) -> DataFrame:
    """Per document: doc_id, uid (a hash of id and text), component_id and first, by links of Jaccard ``similarity`` or more over sets of word shingles.

    component_id is the smallest doc_id of a group; first says of one row of
    each group, the one with that id (null ids count as largest, ties go by uid),
    that it stands for it.  Rows that are equal in id and text are one to this
    operator: all have the same answers.

    Fingerprints of 128 bits over the different shingles of a text propose
    pairs (``block_links``): at a similarity of 0.8 they differ in 19 bits on average, and
    within 28 bits two unrelated ones are once in ten thousand million pairs.  (The radius goes with a similarity of 0.8.)  The
    shingles of each proposed pair are then compared.  What is left between
    different components is proposed by ``rare_pairs``, which misses none, so the
    components are exact.
    """
    rows, joined = _similar(docs, doc_id, text, shingle, similarity, radius)
    # nodes are few beside rows that share one: the group's name is worked out by node, and a node's rows meet it last
    own = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("own")
    firsts = rows.groupBy("node").agg(own).join(joined, "node", "left").select("node", "own", F.coalesce("least", "node").alias("root"))
    roots = firsts.groupBy("root").agg(F.min("own").alias("head"))
    named = firsts.join(roots, "root").select("node", "head")
    is_first = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("uid") == F.col("head.uid"))
    return rows.join(named, "node").select("doc_id", "uid", F.col("head.doc_id").alias("component_id"), is_first.alias("first"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs``, all columns, with one row of each group of ``similar_documents``.

    The row with the smallest id stays (null ids count as largest, ties go by a
    hash of the row); of rows that are equal in id and text any one does, whatever
    their other columns.  Rows of a group alone are not shuffled.
    """
    found = stage(similar_documents(docs, doc_id=doc_id, text=text, **options))
    again = found.groupBy("doc_id", "uid").agg(F.count(F.lit(1)).alias("n"), F.first("first").alias("first"))
    uid_, other_, id_, first_ = unused(docs.columns, "uid", "other", "id", "first")
    touched = stage(again.where("n > 1 or not first").select(F.col("uid").alias(other_), F.col("doc_id").alias(id_), F.col("first").alias(first_)))
    own = F.col(f"`{doc_id}`").cast("long")
    keyed = docs.withColumn(uid_, F.xxhash64(own, F.col(f"`{text}`").cast("string")))
    uid = F.col(uid_)
    names = [F.col(f"`{c}`") for c in docs.columns]
    alone = without_members(keyed, uid, touched, F.col(other_)).select(*names)
    some = with_members(keyed, uid, touched, F.col(other_)).join(touched, (uid == F.col(other_)) & own.eqNullSafe(F.col(id_)), "left").where(F.coalesce(first_, F.lit(True)))
    return alone.unionByName(some.dropDuplicates([uid_, doc_id]).select(*names))
