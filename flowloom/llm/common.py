"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; temporaries are some 20 times as large.
CHUNK_BYTES = 1 << 20

#: Bytes of an Arrow batch that an executor hands to a Python worker; both hold it, once for each task.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions, by which a cluster sizes its tasks to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session have ``BATCH_BYTES`` or one row, unless it has a setting of its own.

    Spark's default, 64 MB, takes a multiple of that outside the heap while
    columns of text grow to it.  Results don't depend on batches.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    The session's own setting is used.  Only where none is set and all is one
    process (local tests), a folder of this machine takes its place; on a cluster
    that would part the tables by machine, so it is an error there.
    """
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def unused(taken: list[str], *names: str) -> list[str]:
    """Each of ``names``, lengthened until it is no column of ``taken`` (names are equal whatever their case)."""
    known = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in known:
            name += "_"
        known.add(name.lower())
        out.append(name)
    return out


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so that a result used more than once is computed once
    and survives the loss of executors.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete what ``stage`` wrote for ``df``; it must not be read again."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(conf).delete(path, True)


#: Bits of a member filter: 8 MB however many members there are.
FILTER_BITS = 1 << 26
_PAGE = 1 << 15


def with_members(df: DataFrame, hashed: Column, members: DataFrame, member: Column) -> DataFrame:
    """The rows of ``df`` whose 64-bit ``hashed`` may be among ``members``; all that are, and few others.

    A bitmap of fixed size, made of the members in pages and broadcast, drops
    rows before a shuffle.  Once members far outnumber its bits it drops none.
    """
    return _member_test(df, hashed, members, member, True)


def without_members(df: DataFrame, hashed: Column, members: DataFrame, member: Column) -> DataFrame:
    """The other rows of ``with_members``."""
    return _member_test(df, hashed, members, member, False)


def _member_test(df: DataFrame, hashed: Column, members: DataFrame, member: Column, keep: bool) -> DataFrame:
    at_, page, bits = unused(df.columns, "at", "page", "bits")
    own = F.pmod(member, F.lit(FILTER_BITS))
    pages = members.select(own.alias(at_)).groupBy(F.floor(F.col(at_) / _PAGE).alias(page)).agg(F.bitmap_construct_agg(F.pmod(at_, F.lit(_PAGE))).alias(bits))
    names = [F.col(f"`{c}`") for c in df.columns]
    marked = df.withColumn(at_, F.pmod(hashed, F.lit(FILTER_BITS))).join(F.broadcast(pages), F.floor(F.col(at_) / _PAGE) == F.col(page), "left")
    byte = F.conv(F.hex(F.substring(bits, (F.floor(F.pmod(at_, F.lit(_PAGE)) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, F.pmod(at_, F.lit(8)).cast("int")) == 1, F.lit(False))
    return marked.where(found if keep else ~found).select(*names)


def give_back() -> None:
    """Return freed memory to the system: a Python worker is used again, and what one task freed would count beside the next one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` (string or binary) has about ``limit`` bytes in each.

    A row is never cut; a longer one comes alone.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        at = 0
        while at < n:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the n + 1 offsets of its rows; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def int_column(column: pa.Array, null: int) -> np.ndarray:
    return np.asarray(pc.fill_null(column.cast(pa.int64()), null), dtype=np.int64)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased and nothing else changed."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each row (n + 1 values).

    ``is_sep`` says of each of the 256 bytes whether it parts words; so does
    the end of a row.
    """
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    np.logical_not(is_sep[data], out=inside[1:-1])
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets, side="left")


#: Separators of white-space words: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Polynomial hashes modulo 2**64 of any span of a byte buffer, from one prefix sum."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, seed: int = 1):
        self.table = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)
        self.power = self.inverse = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.power) < n + 1:
            self.power = np.full(n + 1, self.BASE, np.uint64)
            self.power[0] = 1
            np.multiply.accumulate(self.power, out=self.power)
            self.inverse = np.full(n + 1, pow(self.BASE, -1, 1 << 64), np.uint64)
            self.inverse[0] = 1
            np.multiply.accumulate(self.inverse, out=self.inverse)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[:n], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((prefix[ends] - prefix[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    padded = np.zeros(len(flags) + 2, dtype=np.int8)
    padded[1:-1] = flags
    step = np.diff(padded)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags of n positions: those inside any of the spans."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def between(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags of n positions inside spans that are in order and don't overlap."""
    step = np.zeros(n + 1, dtype=np.int8)
    step[starts] += 1
    step[ends] -= 1
    return np.cumsum(step[:-1], dtype=np.int8).view(bool)


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from its bytes and n + 1 offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def join_words(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given words of each row, joined by one space."""
    row = np.searchsorted(offsets, starts, side="right")
    more = np.append(row[1:] == row[:-1], False) if len(row) else np.zeros(0, bool)
    data = data.copy()
    data[ends[more]] = 0x20
    kept = between(len(data), starts, ends + more)
    total = np.concatenate([[0], np.cumsum(kept)])
    return binary_array(data[kept], total[offsets])
