"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams are summed in Spark into one row of ``2**bits``
counters per language; the log-probability matrix, whose size depends on the
number of languages only, is broadcast, and batches are scored in numpy.

Defined results: null text and text without a letter give ``und`` with score
0.  Texts are read whole.  Rows that repeat each give a row.  An empty table
gives an empty result; with nothing to learn from, every row is ``und``.
Equal scores go to the language that sorts first.  Columns besides the named
ones are kept by ``predict`` unless they bear a result's name, which the result
then takes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import chunks, small_batches, unused

UNDETERMINED = "und"

#: One odd multiplier for each place in an n-gram.
_PLACES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def ngram_buckets(texts: list[str | None], orders: tuple[int, ...], bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each order, the bucket of every n-gram of the lower-cased texts and each text's number of them."""
    points = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points], dtype=np.int64)
    flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(len(points)), sizes)
    buckets, counts = [], []
    for n in orders:
        m = max(0, len(flat) - n + 1)
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = (h ^ flat[k : k + m]) * _PLACES[k]
            h ^= h >> np.uint32(15)
        whole = row[:m] == row[n - 1 : n - 1 + m]
        buckets.append((h[whole] >> np.uint32(32 - bits)).astype(np.int64))
        counts.append(np.maximum(sizes - n + 1, 0))
    return buckets, counts


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """Log-probabilities of n-gram buckets (languages x 2**bits) and of the languages."""

    languages: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15

    @classmethod
    def fit(cls, df: DataFrame, text: str = "text", lang: str = "lang", *, orders: tuple[int, ...] = (1, 2, 3), bits: int = 15, max_rows: int = 50_000, smoothing: float = 0.5) -> LanguageModel:
        """Learn from the rows of ``df`` that have a text and a language.

        max_rows: about so many labelled rows are learned from; of more, a
        fixed pseudo-random share by a hash of the text is taken.
        """
        small_batches(df.sparkSession)
        rows = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
        n = rows.count()
        if n > max_rows:
            rows = rows.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 20)) < int(max_rows / n * (1 << 20)))

        def count(batches):
            total: dict[str, np.ndarray] = {}
            seen: dict[str, int] = {}
            for batch in chunks(batches, "text"):
                langs = np.array(batch.column("lang").to_pylist())
                texts = batch.column("text").to_pylist()
                for x in np.unique(langs):
                    own = [t for t, y in zip(texts, langs, strict=True) if y == x]
                    buckets, _ = ngram_buckets(own, orders, bits)
                    into = total.setdefault(x, np.zeros(1 << bits, np.int64))
                    seen[x] = seen.get(x, 0) + len(own)
                    for b in buckets:
                        into += np.bincount(b, minlength=1 << bits)
            if total:
                yield pa.RecordBatch.from_pydict({"lang": list(total), "docs": [seen[x] for x in total], "counts": [v.tobytes() for v in total.values()]})

        def add(batches):
            total: dict[str, tuple[int, np.ndarray]] = {}
            for batch in batches:
                for x, docs, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "docs", "counts")), strict=True):
                    old = total.get(x, (0, 0))
                    total[x] = old[0] + docs, old[1] + np.frombuffer(counts, np.int64)
            if total:
                yield pa.RecordBatch.from_pydict({"lang": list(total), "docs": [v[0] for v in total.values()], "counts": [v[1].tobytes() for v in total.values()]})

        kind = "lang string, docs long, counts binary"
        # a part for each task and language, then one for each of sixteen salts and language
        parts = rows.mapInArrow(count, kind).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16))).repartition("salt").drop("salt").mapInArrow(add, kind)
        found: dict[str, tuple[int, np.ndarray]] = {}
        for r in parts.toLocalIterator():
            old = found.get(r["lang"], (0, 0))
            found[r["lang"]] = old[0] + r["docs"], old[1] + np.frombuffer(bytes(r["counts"]), np.int64)
        languages = sorted(found)
        if not languages:
            return cls([], np.zeros((0, 1 << bits), np.float32), np.zeros(0, np.float32), orders, bits)
        counts = np.stack([found[x][1] for x in languages]) + smoothing
        docs = np.array([found[x][0] for x in languages], dtype=np.float64)
        return cls(languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32), np.log(docs / docs.sum()).astype(np.float32), orders, bits)

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The most probable language of each text and its posterior probability."""
        k = len(self.languages)
        total = np.tile(self.log_prior.astype(np.float64), (len(texts), 1))
        if k:
            for buckets, counts in zip(*ngram_buckets(texts, self.orders, self.bits), strict=True):
                full = np.flatnonzero(counts)
                at = (np.cumsum(counts) - counts)[full]
                for j in range(k):
                    if len(full):
                        total[full, j] += np.add.reduceat(self.log_prob[j][buckets], at, dtype=np.float64)
        known = np.array([bool(k) and has_letter(t) for t in texts], dtype=bool)
        best = total.argmax(axis=1) if k else np.zeros(len(texts), int)
        top = total.max(axis=1, keepdims=True) if k else np.zeros((len(texts), 1))
        sure = 1 / np.exp(total - top).sum(axis=1) if k else np.zeros(len(texts))
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, known, strict=True)], np.where(known, sure, 0.0)

    def predict(self, df: DataFrame, text: str = "text", *, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
        """``df`` with the predicted language and its probability."""
        small_batches(df.sparkSession)
        model = df.sparkSession.sparkContext.broadcast(self)
        keep = [f for f in df.schema.fields if f.name not in (lang_col, score_col)]
        schema = T.StructType([*keep, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

        whole = unused(schema.names, "whole")[0]

        def run(batches):
            for batch in chunks(batches, whole):
                langs, scores = model.value.score(batch.column(whole).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

        return df.select(*(F.col(f"`{f.name}`") for f in keep), F.col(f"`{text}`").cast("string").alias(whole)).mapInArrow(run, schema)


def held_out(doc_id, folds: int = 5):
    """Whether a document belongs to the fold that nothing is learned from; a null id does."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(True))
