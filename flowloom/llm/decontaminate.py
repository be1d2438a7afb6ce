"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of consecutive words of the test items.  A shift
table over blocks of words skips positions at which no pattern can end, a
bucket of the hashed end block selects patterns, of which only those with the
text's first block are taken, and a direct comparison confirms an occurrence.
The items are searched in blocks of bounded size, each broadcast.  Documents
never shuffle: of several blocks each is a pass of its own over the documents,
with its tables alone in memory, and hands its findings on in the shared folder.

Defined results: null text has no words; items without words match nothing; a
null item id is named ``null``; items that share an id count as one; repeated
documents give a row each; an empty table on either side gives no hits.
Columns besides id and text are not read; with ``keep`` all come back as they
were, whatever their names, but for one named ``contaminated``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import chunks, drop_staged, small_batches, stage, unused

#: ASCII digits and letters, and everything beyond ASCII, make words.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """The words of a text after A-Z have been lower-cased."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


@dataclass
class WuManber:
    """Search tables for patterns that all have ``length`` words."""

    length: int
    block: int = 2
    shift: dict = field(default_factory=dict)
    #: by last block, then by first block: the patterns and who owns them
    bucket: dict = field(default_factory=lambda: defaultdict(lambda: defaultdict(dict)))

    def __post_init__(self):
        self.block = min(self.block, self.length)

    def add(self, pattern: tuple[bytes, ...], owner) -> None:
        b, m = self.block, self.length
        for end in range(b, m + 1):
            key = pattern[end - b : end]
            self.shift[key] = min(self.shift.get(key, m - b + 1), m - end)
        self.bucket[pattern[m - b :]][pattern[:b]].setdefault(pattern, set()).add(owner)

    def closed(self) -> WuManber:
        """The same with plain tables, for broadcasting."""
        self.bucket = {end: {start: list(own.items()) for start, own in by.items()} for end, by in self.bucket.items()}
        return self

    def search(self, text: list[bytes]):
        """(start, owners) of every occurrence."""
        m, b, n = self.length, self.block, len(text)
        shift, bucket, far = self.shift.get, self.bucket, m - b + 1
        at = m
        while at <= n:
            key = tuple(text[at - b : at])
            step = shift(key, far)
            if step:
                at += step
                continue
            for pattern, owners in bucket[key].get(tuple(text[at - m : at - m + b]), ()):
                if pattern == tuple(text[at - m : at]):
                    yield at - m, owners
            at += 1


def build(items: list[tuple[str, str | None]], window: int) -> list[WuManber]:
    """A searcher for each length of window among the items."""
    by: dict[int, WuManber] = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            by.setdefault(m, WuManber(m)).add(tuple(w[i : i + m]), item)
    return [s.closed() for s in by.values()]


def scan(text: str | None, searchers: list[WuManber]) -> tuple[int, np.ndarray, set[str]]:
    """Number of words, flags of the words that are hit (None: none), and the items found."""
    w = words(text)
    hit, items = None, set()
    for s in searchers:
        for start, owners in s.search(w):
            if hit is None:
                hit = np.zeros(len(w), dtype=bool)
            hit[start : start + s.length] = True
            items |= owners
    return len(w), hit, items


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int):
    """The items in lists of bounded size, read one partition at a time."""
    block, size = [], 0
    for r in items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")), F.col(f"`{text}`").cast("string")).toLocalIterator():
        own = len((r[1] or "").encode("utf-8", "surrogatepass"))
        if block and size + own > block_bytes:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += own
    yield block


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 8 << 20, keep: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted ids), contaminated.

    keep: instead return ``docs``, all columns, with ``contaminated`` added.
    Search tables take some 60 bytes for each byte of a block, and a block has
    ``block_bytes`` or one item; each further block is a pass of its own.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "contaminated"] if keep else [doc_id]
    text_, hit_, items_, n_ = unused([*docs.columns, "contaminated"], "whole", "hit", "items", "n")
    kept = [F.col(f"`{c}`") for c in names]
    found = docs.select(*kept, F.col(f"`{text}`").cast("string").alias(text_), F.lit(None).cast("binary").alias(hit_), F.array().cast("array<string>").alias(items_), F.lit(0).cast("long").alias(n_))
    schema = found.schema

    def searching(tables):
        def run(batches):
            for batch in chunks(batches, text_):
                ns, hits, owners = [], [], []
                for t, before, known in zip(*(batch.column(c).to_pylist() for c in (text_, hit_, items_)), strict=True):
                    n, hit, own = scan(t, tables.value)
                    if before is not None:
                        old = np.frombuffer(before, dtype=bool)
                        hit = old if hit is None else hit | old
                    ns.append(n)
                    hits.append(None if hit is None else hit.tobytes())
                    owners.append(sorted(own.union(known)))
                own = [batch.column(i) for i in range(len(names) + 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(hits, pa.binary()), pa.array(owners, pa.list_(pa.string())), pa.array(ns, pa.int64())], names=schema.names)

        return run

    staged = tables = None
    for block in item_blocks(items, item_id, item_text, block_bytes):
        if tables is not None:
            # another block: the pass before it is done, and its tables go
            done = stage(found)
            tables.destroy()
            if staged is not None:
                drop_staged(staged)
            found = staged = done
        tables = docs.sparkSession.sparkContext.broadcast(build(block, window))
        found = found.mapInArrow(searching(tables), schema)
    if keep:
        return found.select(*kept, F.col(hit_).isNotNull().alias("contaminated"))
    # the flags are a byte for each word, 0 or 1
    n_hit = F.coalesce(F.length(F.replace(F.decode(hit_, "ISO-8859-1"), F.lit("\x00"), F.lit(""))), F.lit(0)).cast("long")
    return found.select(F.col(f"`{doc_id}`"), F.col(n_).alias("n_words"), n_hit.alias("n_hit"), F.col(items_).alias("items"), F.col(hit_).isNotNull().alias("contaminated"))


def items_digest(items):
    """Lower-case hex SHA-256 of the comma-joined ids."""
    return F.sha2(F.array_join(items, ","), 256)
