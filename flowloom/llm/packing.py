"""Best-fit packing of tokenised documents by bin completion.

Only the lengths of pieces decide how they pack, and there are at most
``capacity`` different lengths, so the search runs on the histogram of
lengths, which is small whatever the corpus.

The first incumbent takes the largest piece left and the filling around it that
wastes least (best fit, where that wastes nothing; else found by the set of sums
that can be reached, so no branch is a dead end), as often as the counts allow.
If it has more sequences than a lower bound (of the sums, and of the pieces that
can't share a sequence), bin completion goes on: the last 1, 2, 4, ... sequences
are taken apart and packed anew by branch and bound, which enumerates the
fillings around the largest piece in order of waste, leaves out dominated ones
(where a longer piece that is left could stand for one or two of theirs), and
prunes by the waste that fewer sequences allow.  ``nodes`` bounds this second part
only: what is found by then is a whole packing, and is the best there is where
the search ended before (``plan`` says which).

Every piece finds its sequence by its rank among the pieces of its length:
ranks come from counts of salted groups, so a length that a third of all
pieces share is numbered in many tasks.  Documents are tokenised once, in place; only
lengths and numbers are shuffled.

Defined results: null and empty texts are a document of the end id alone;
repeated rows are packed each; a null doc_id is kept; an empty table gives an
empty result.  Columns besides id and text are not read.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import chunks, int_column, partitions, small_batches, stage

CAPACITY = 2048
END_ID = 0

#: How a byte-level vocabulary writes each byte: printable ones as themselves, the others from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


@lru_cache(maxsize=2)
def encoder(path: str):
    """An encoder with the vocabulary and the ids of a byte-level ``tokenizer.json``.

    The merge order of such a file is the order of its ids, which is all that
    tiktoken needs; it gives the same ids in a fifth of the time.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    others = [b for b in range(256) if b not in set(_PRINTABLE)]
    byte = {chr(b): b for b in _PRINTABLE} | {chr(0x100 + i): b for i, b in enumerate(others)}
    ranks = {}
    for piece, i in model["vocab"].items():
        if all(c in byte for c in piece):
            ranks[bytes(byte[c] for c in piece)] = i
    ranks.pop(b"<|endoftext|>", None)
    # the pattern of byte-level pre-tokenisers: contractions, words, numbers, other signs and white space
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    return tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def with_added(path: str):
    """The library's own encoder for ``path``, and the added tokens of the file."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        return Tokenizer.from_file(path), [t["content"] for t in json.load(f)["added_tokens"]]


def tokens(text: str | None, path: str, added: bool = False) -> np.ndarray:
    """Ids of a text and the end id, as unsigned 32-bit numbers.

    added: tokens that the file adds to its vocabulary, such as ``<|endoftext|>``,
    get their own ids where a text holds them, as in the library's default mode;
    otherwise they are plain text.
    """
    if added and text and any(t in text for t in with_added(path)[1]):
        ids = with_added(path)[0].encode(text, add_special_tokens=False).ids
    else:
        ids = encoder(path).encode_ordinary(text) if text else []
    ids.append(END_ID)
    return np.array(ids, dtype="<u4")


def pieces(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; if it is cut, the first takes what the full ones leave."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def reachable(sizes: list[int], counts: np.ndarray, room: int) -> list[int]:
    """For each place in ``sizes``, and the end, the sums up to ``room`` that the sizes from there on can make, as bits of a number."""
    mask = (1 << room + 1) - 1
    out = [1]
    for s in reversed(sizes):
        sums, left, step = out[-1], min(int(counts[s]), room // s), 1
        while left:
            step = min(step, left)
            sums |= sums << s * step & mask
            left -= step
            step *= 2
        out.append(sums)
    return out[::-1]


def fillings(room: int, counts: np.ndarray, most_waste: int):
    """Lists of lengths, largest first, that fill ``room`` but for ``most_waste`` at most, in order of waste; of one waste, those with longer pieces first."""
    sizes = [int(s) for s in np.flatnonzero(counts)[::-1] if s <= room]
    sums = reachable(sizes, counts, room)

    def exact(left: int):
        # walked with a list, not by recursion: there may be more sizes to pass over than Python has frames
        taken: list[tuple[int, int]] = []  # place of a size and how many of it, where there are any
        at, most = 0, left
        while True:
            while left:
                s = sizes[at]
                n = next((n for n in range(min(int(counts[s]), left // s, most), -1, -1) if sums[at + 1] >> left - n * s & 1), None)
                if n is None:
                    break
                if n:
                    taken.append((at, n))
                at, left, most = at + 1, left - n * s, room
            else:
                yield [sizes[k] for k, n in taken for _ in range(n)]
            if not taken:
                return
            at, n = taken.pop()
            left, most = left + n * sizes[at], n - 1

    for waste in range(min(most_waste, room) + 1):
        if sums[0] >> room - waste & 1:
            yield from exact(room - waste)


def best_filling(room: int, counts: np.ndarray) -> list[int]:
    """Lengths that fill ``room`` with the least waste there can be, largest first, from the histogram ``counts``."""
    best, left = [], room
    for s in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        n = min(int(counts[s]), left // s)
        best += [s] * n
        left -= n * s
    # best fit without waste can't be beaten
    return next(fillings(room, counts, room)) if left else best


def dominated(filling: list[int], room: int, counts: np.ndarray) -> bool:
    """Whether a longer piece beside the filling could take the place of one or two of its pieces."""
    left = counts.copy()
    np.subtract.at(left, filling, 1)
    longer = np.flatnonzero(left[: room + 1])
    waste = room - sum(filling)
    sums = {a for a in filling} | {a + b for i, a in enumerate(filling) for b in filling[i + 1 :]}
    alone = set(filling)
    for s in sums:
        # as long as two together is as good as they are, and leaves shorter pieces to go elsewhere
        at = np.searchsorted(longer, s + 1 if s in alone else s)
        if at < len(longer) and longer[at] <= s + waste:
            return True
    return False


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: by the sum of all pieces, and for each least length by the pieces of at least that which can't share one."""
    sizes = np.arange(len(counts))
    number, weight = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, counts * sizes))
    span = lambda total, low, high: total[high + 1] - total[low]  # noqa: E731  lengths low to high
    half = capacity // 2
    least = np.arange(half + 1)
    big, middle = span(number, capacity - least + 1, capacity), span(number, half + 1, capacity - least)
    room = middle * capacity - span(weight, half + 1, capacity - least)
    over = np.maximum(span(weight, least, half) - room, 0)
    return int(max(-(-weight[-1] // capacity), (big + middle + -(-over // capacity)).max()))


def repack(counts: np.ndarray, capacity: int, below: int, nodes: int) -> tuple[list[list[int]] | None, int]:
    """A packing of all pieces into fewer than ``below`` sequences, if there is one, and the nodes that are left (0: the search did not end)."""
    counts = counts.copy()
    chosen: list[list[int]] = []
    total = int((counts * np.arange(len(counts))).sum())

    def children(counts: np.ndarray, slack: int):
        nonlocal nodes
        largest = int(np.flatnonzero(counts)[-1])
        counts[largest] -= 1
        for f in fillings(capacity - largest, counts, slack):
            nodes -= 1
            if nodes <= 0:
                return
            if not dominated(f, capacity - largest, counts):
                yield [largest, *f]

    def put(filling: list[int], sign: int) -> None:
        nonlocal total
        np.add.at(counts, filling, sign)
        total += sign * sum(filling)

    slack = lambda: (below - 1 - len(chosen)) * capacity - total
    stack = [children(counts.copy(), slack())] if slack() >= 0 else []
    while stack:
        filling = next(stack[-1], None)
        if filling is None:
            stack.pop()
            if chosen:
                put(chosen.pop(), 1)
            continue
        chosen.append(filling)
        put(filling, -1)
        if not total:
            return chosen, nodes
        if slack() >= 0 and len(chosen) + lower_bound(counts, capacity) < below:
            stack.append(children(counts.copy(), slack()))
        else:
            put(chosen.pop(), 1)
    return None, max(nodes, 0)


def plan(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = 20_000) -> tuple[list[tuple[list[int], int]], bool]:
    """Fillings and how often each is used, for a histogram of lengths up to ``capacity``; and whether no packing has fewer sequences."""
    left = counts = counts.astype(np.int64)
    left = left.copy()
    out: list[tuple[list[int], int]] = []
    while left.any():
        largest = int(np.flatnonzero(left)[-1])
        left[largest] -= 1
        filling = [largest, *best_filling(capacity - largest, left)]
        left[largest] += 1
        kinds, need = np.unique(filling, return_counts=True)
        times = int((left[kinds] // need).min())
        left[kinds] -= need * times
        out.append((filling, times))
    least, total, tail = lower_bound(counts, capacity), sum(n for _, n in out), 1
    while total > least and nodes > 0:
        # the last sequences are taken apart
        rest, kept = min(tail, total), list(out)
        loose = np.zeros(capacity + 1, np.int64)
        while rest:
            filling, times = kept.pop()
            n = min(times, rest)
            np.add.at(loose, filling, n)
            rest -= n
            if times > n:
                kept.append((filling, times - n))
        better, nodes = repack(loose, capacity, min(tail, total), nodes)
        if better is not None:
            out = kept + [(f, 1) for f in better]
            total, tail = sum(n for _, n in out), 1
        elif tail >= total:
            return out, nodes > 0
        else:
            tail *= 2
    return out, total == least


def slots(fillings: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, ranks, copies in a sequence, first sequence, offset), sorted, of a plan."""
    rows, ranks, sequence = [], {}, 0
    for filling, times in fillings:
        at = 0
        for s in sorted(set(filling), reverse=True):
            copies = filling.count(s)
            rows.append((s, ranks.get(s, 0), copies * times, copies, sequence, at))
            ranks[s] = ranks.get(s, 0) + copies * times
            at += copies * s
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    tokenizer: path of a byte-level ``tokenizer.json``, there on every machine.
    """
    spark = docs.sparkSession
    small_batches(spark)
    salts = partitions(spark)

    def cut(batches):
        for batch in chunks(batches, "text"):
            out: list[tuple] = []
            for i, t in enumerate(batch.column("text").to_pylist()):
                ids = tokens(t, tokenizer, added=True)
                for k, (start, length) in enumerate(pieces(len(ids), capacity)):
                    out.append((i, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            row, piece, start, length, crc = (np.array(c, dtype=np.int64) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    body = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    cuts = body.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")
    done = stage(cuts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")))
    groups = done.groupBy("length", "salt").count()
    counts = np.zeros(capacity + 1, np.int64)
    for r in groups.groupBy("length").agg(F.sum("count").alias("n")).collect():  # a row for each length, 2048 at most
        counts[r["length"]] = r["n"]
    table = spark.sparkContext.broadcast(slots(plan(counts, capacity)[0]))
    # pieces of a length in salted groups of a common number; an offset for each group
    from pyspark.sql import Window

    base = groups.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = done.withColumn("number", number).join(base.select("length", "salt", F.coalesce("base", F.lit(0)).alias("base")), ["length", "salt"])

    def place(batches):
        rows = table.value
        # one ascending key for (length, first rank); ranks stay below 2**48
        keys = rows[:, 0] << 48 | rows[:, 1]
        for batch in batches:
            length, rank = int_column(batch.column("length"), 0), int_column(batch.column("rank"), 0)
            at = rows[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            nth = rank - at[:, 1]
            sequence, offset = at[:, 4] + nth // at[:, 3], at[:, 5] + nth % at[:, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("number")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
