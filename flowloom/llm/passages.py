"""Substring dedup: Rabin-Karp hashes of every window of ``window`` words.

Every window's hash goes to a bucket, dealt by another hash.  There the smallest
document id of each hash is found, and the windows that start in a document
with a larger id are sent back to their document, where they merge into maximal
removal intervals.

What is shuffled is packed: a map task sends each bucket one binary row of
hashes and places rather than a row per window, and first combines the windows
it has seen itself, so a window that a third of all documents share reaches
its bucket a few times per map task only.  The number of buckets follows
``spark.sql.shuffle.partitions``.  Texts cross the network once.

Hashes have 64 bits, and only those of a bucket meet; among n windows in b
buckets a wrong match is expected n * n / (b * 2**65) times (4e-6 at 120 million
windows in 100 buckets, one at 2 million million in 100,000).

Defined results: null and empty texts have no words; a text shorter than the
window keeps all of its words; a null doc_id ranks behind all others, and null
ids are equal; rows with the same doc_id are one document's (their windows
don't remove each other), each with a row of its own; an empty table gives an
empty result.  Columns besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import SPACE, Rolling, chunks, cover, int_column, join_words, mix64, partitions, runs, text_bytes, word_spans

NULL_ID = np.iinfo(np.int64).max
_STEP, _DEAL = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
#: Windows that a map task gathers before it combines and sends them.
_FLUSH = 1 << 20

# kind 0: marked windows for a document's part; 1: hashes for a bucket (uid: bytes of the packed head); 2: a document
_ROWS = "part int, kind int, uid long, doc_id long, data binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("data", pa.binary())])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, compressed."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), ord(a.dtype.char)))], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8), 8 + 16 * n, []
    for size, kind in head.reshape(n, 2):
        dtype = np.dtype(chr(kind))
        out.append(np.frombuffer(raw, dtype, int(size), at))
        at += int(size) * dtype.itemsize
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def window_hashes(data: np.ndarray, offsets: np.ndarray, window: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, 32 bits of another hash (for the bucket), row and place of each window of words."""
    starts, ends, before = word_spans(data, offsets, SPACE)
    word = rolling.spans(rolling.prefix(data), starts, ends)
    n = max(0, len(word) - window + 1)
    h, g = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(window):
        h *= _STEP
        h += word[k : k + n]
        g *= _DEAL
        g += word[k : k + n]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    whole = np.flatnonzero(row[:n] == row[len(row) - n :])
    row = row[whole]
    return mix64(h[whole]), (mix64(g[whole]) >> np.uint64(32)).astype(np.uint32), row, whole - before[row]


def _smallest(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each entry, the smallest document id among the entries with its hash."""
    order = np.argsort(h)
    new = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]])) if len(h) else np.zeros(0, int)
    least = np.empty(len(h), np.int64)
    if len(h):
        least[order] = np.repeat(np.minimum.reduceat(doc[order], new), np.diff(np.append(new, len(h))))
    return least


def _marks(uid: np.ndarray, place: np.ndarray, parts: int) -> Iterator[tuple]:
    """Rows that carry marked windows to the part of their document."""
    part = np.mod(uid, parts)
    order = np.lexsort((place, uid, part))
    part, uid, place = part[order], uid[order], place[order]
    for at in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1) if len(part) else ():
        new = np.flatnonzero(np.concatenate([[True], uid[at][1:] != uid[at][:-1]]))
        count = np.diff(np.append(new, len(at))).astype(np.uint32)
        step = np.diff(place[at], prepend=0)
        step[new] = place[at][new]
        yield int(part[at[0]]), 0, 0, 0, _pack(uid[at][new], count, step.astype(np.uint32))


def _send(h: np.ndarray, deal: np.ndarray, uid: np.ndarray, doc: np.ndarray, place: np.ndarray, parts: int) -> Iterator[tuple]:
    """Combine the windows a task has gathered; rows for the buckets (kind 1) and, known already, for the documents (kind 0)."""
    known = doc > _smallest(h, doc)
    yield from _marks(uid[known], place[known], parts)
    left = ~known
    h, deal, uid, doc, place = h[left], deal[left], uid[left], doc[left], place[left]
    part = (deal * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts < 65536 else np.int64)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        at = order[bounds[p] : bounds[p + 1]]
        if not len(at):
            continue
        own = uid[at]
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        count = np.diff(np.append(new, len(at)))
        step = np.diff(place[at], prepend=0)
        step[new] = place[at][new]
        small = np.uint16 if step.max(initial=0) < 65536 else np.uint32
        head = _pack(own[new], doc[at][new], count.astype(np.uint32), step.astype(small))
        yield p, 1, len(head), 0, head + h[at].tobytes()


def _places(step: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.cumsum(step.astype(np.int64))
    first = np.cumsum(count.astype(np.int64)) - count
    base = total[first] - step[first].astype(np.int64) if len(first) else total
    return total - np.repeat(base, count)


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Batches sorted by part, as one iterator of batches for each part."""
    rest: list = []

    def next_batch():
        return rest.pop() if rest else next(batches, None)

    def one(part):
        while (b := next_batch()) is not None:
            parts = b.column("part").to_numpy()
            n = int(np.searchsorted(parts, part, side="right"))
            if n < b.num_rows:
                rest.append(b.slice(n))
                if n:
                    yield b.slice(0, n)
                return
            yield b

    while True:
        b = next_batch()
        if b is None:
            return
        if b.num_rows:
            rest.append(b)
            own = one(part := int(b.column("part")[0].as_py()))
            yield part, own
            for _ in own:
                pass


def _emit(rows: Iterator[tuple], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[4])
        if size > most:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def repeated_windows(docs: DataFrame, doc_id: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """The documents as rows of ``_ROWS`` (kind 2), and the marked windows of each part of them (kind 0)."""
    parts = partitions(docs.sparkSession)
    body = F.col(f"`{text}`").cast("string")
    uid = F.xxhash64(F.col(f"`{doc_id}`").cast("long"), body)
    rows = docs.select(
        F.pmod(uid, F.lit(parts)).cast("int").alias("part"),
        F.lit(2).alias("kind"),
        uid.alias("uid"),
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.encode(body, "UTF-8").alias("data"),
    )

    def hashed(batches):
        rolling = Rolling()
        held: list[tuple] = []

        def gathered():
            yield from _send(*(np.concatenate(x) for x in zip(*held, strict=True)), parts)

        size = 0
        for batch in chunks(batches, "data"):
            data, offsets = text_bytes(batch.column("data"))
            h, deal, row, place = window_hashes(data, offsets, window, rolling)
            held.append((h, deal, int_column(batch.column("uid"), 0)[row], int_column(batch.column("doc_id"), NULL_ID)[row], place))
            size += len(h)
            if size >= _FLUSH:
                yield from _emit(gathered())
                held, size = [], 0
        if size:
            yield from _emit(gathered())

    def counted(batches):
        for _, own in _parted(batches):
            cols: list[list[np.ndarray]] = [[], [], [], []]

            def done():
                for b in own:
                    for r in b.to_pylist():
                        if r["kind"] == 0:
                            yield r["part"], 0, 0, 0, r["data"]
                        else:
                            uids, ids, count, step = _unpack(r["data"][: r["uid"]])
                            for into, x in zip(cols, (np.frombuffer(r["data"][r["uid"] :], np.uint64), np.repeat(uids, count), np.repeat(ids, count), _places(step, count)), strict=True):
                                into.append(x)
                if cols[0]:
                    h, uids, ids, place = (np.concatenate(c) for c in cols)
                    again = ids > _smallest(h, ids)
                    yield from _marks(uids[again], place[again], parts)

            yield from _emit(done())

    sent = rows.mapInArrow(hashed, _ROWS).repartitionById(parts, "part").sortWithinPartitions("part", "kind")
    return rows, sent.mapInArrow(counted, _ROWS)


def dedup_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """Per document: doc_id, n_words, spans (removed words, from and to), kept_text (kept words joined by a space).

    Removed is each word covered by a window that also starts in a document
    with a smaller id, judged on the input.
    """
    rows, marks = repeated_windows(docs, doc_id, text, window)
    parts = partitions(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("kept_text", pa.binary())])

    def applied(batches):
        for _, own in _parted(batches):
            marked: dict[int, list[np.ndarray]] | None = None
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for b in own:
                kinds = b.column("kind").to_numpy()
                n = int(np.searchsorted(kinds, 2))
                for data in b.slice(0, n).column("data").to_pylist():
                    held.append(tuple(_unpack(data)))
                if n == b.num_rows:
                    continue
                if marked is None:
                    marked = {}
                    for uids, count, step in held:
                        for u, x in zip(uids.tolist(), np.split(_places(step, count), np.cumsum(count)[:-1]), strict=True):
                            marked.setdefault(u, []).append(x)
                    held = []
                for c in chunks(iter([b.slice(n)]), "data"):
                    data, offsets = text_bytes(c.column("data"))
                    starts, ends, before = word_spans(data, offsets, SPACE)
                    gone = np.zeros(len(starts), dtype=bool)
                    spans: list[list[dict]] = [[] for _ in range(c.num_rows)]
                    for i, u in enumerate(c.column("uid").to_pylist()):
                        if places := marked.get(u):
                            at = slice(before[i], before[i + 1])
                            where = np.concatenate(places)
                            gone[at] = cover(before[i + 1] - before[i], where, where + window)
                            spans[i] = [{"from": int(x), "to": int(y)} for x, y in zip(*runs(gone[at]), strict=True)]
                    kept = join_words(data, offsets, starts[~gone], ends[~gone])
                    yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(np.diff(before)), pa.array(spans, out.field(2).type), kept], schema=out)

    both = marks.unionByName(rows).repartitionById(parts, "part").sortWithinPartitions("part", "kind")
    return both.mapInArrow(applied, "doc_id long, n_words long, spans array<struct<`from`:long,`to`:long>>, kept_text binary").withColumn("kept_text", F.decode("kept_text", "UTF-8"))
