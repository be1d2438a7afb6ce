"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has the sign of each component.  Codes are cut into segments, and
each segment is an index from its value to the codes that have it.  For radius
0, 1, 2, ... each query looks up the values that differ from its own in
exactly that many bits, in every segment, and the codes found are verified
by their whole Hamming distance.  A code within distance m * (r + 1) - 1 agrees with the
query to r bits in one of m segments at least, so a query is done once its k-th
distance is no more than that; only the others go on.

Equal codes are one code with the k + 1 smallest ids, found with a partial limit
before the shuffle, so a vector that a third of all rows share is looked up once.

Defined results: rows with a null or empty vector or a null id are neither
queries nor neighbours; a null or NaN component counts as not positive; the
query itself is no neighbour of its own; ties in distance go to the smaller id;
rows that repeat an id count as one; fewer than k others give fewer rows; an
empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import json
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.common import drop_staged, stage


def sign_codes(df: DataFrame, id_col: str, vector: str, bits: int = 64) -> DataFrame:
    """(id, code): the signs of the components, ``bits`` (64 at most) or fewer, as a long; a wider vector is an error."""

    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            size = np.asarray(lists.value_lengths().fill_null(0))
            if size.max(initial=0) > min(bits, 64):
                raise ValueError(f"a vector has {size.max()} components, a code {min(bits, 64)} bits")
            start = np.cumsum(size) - size
            value = np.nan_to_num(np.asarray(lists.flatten().fill_null(0.0).cast(pa.float32())), nan=0.0)
            code = np.zeros(len(size), np.uint64)
            for b in range(bits):
                has = np.flatnonzero(size > b)
                code[has] |= (value[start[has] + b] > 0).astype(np.uint64) << np.uint64(b)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(code.view(np.int64))], names=["id", "code"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<float>").alias("v")).where("id is not null and size(v) > 0")
    return rows.mapInArrow(run, "id long, code long")


def _segment(code: Column, k: int, width: int) -> Column:
    return F.shiftrightunsigned(code, k * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for bits in combinations(range(width), radius)]


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, *, bits: int = 64, segments: int = 4) -> DataFrame:
    """(query_id, rank, neighbor_id, distance) of the k nearest of ``codes`` (id, code) for each of ``queries`` (id, code)."""
    width = -(-bits // segments)
    # the k + 1 smallest ids of each code; the limit by rank is applied before the shuffle too
    rank = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    few = codes.distinct().withColumn("rank", rank).where(F.col("rank") <= k + 1)
    known = stage(few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    asked = stage(queries.select(F.col("code").alias("q")).distinct())
    parts = [F.struct(F.lit(s).alias("s"), _segment(F.col("code"), s, width).alias("v")) for s in range(segments)]
    index = known.select("code", F.explode(F.array(*parts)).alias("at")).select("code", "at.s", "at.v")

    nearest = None
    live = asked
    for radius in range(width + 1):
        masks = F.from_json(F.lit(json.dumps(_masks(width, radius))), "array<int>")
        own = [F.struct(F.lit(s).alias("s"), _segment(F.col("q"), s, width).alias("w")) for s in range(segments)]
        probes = live.select("q", F.explode(F.array(*own)).alias("at")).select("q", "at.s", "at.w", F.explode(masks).alias("mask")).select("q", "s", F.col("w").bitwiseXOR(F.col("mask")).alias("v"))
        # the probes are many more than their few queries let Spark expect: neither side is to be broadcast
        found = probes.hint("merge").join(index, ["s", "v"]).select("q", "code").distinct()
        found = found.select("q", "code", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).alias("distance"))
        # only the best can matter; their ids are looked up after that, by code
        first = F.row_number().over(Window.partitionBy("q").orderBy("distance", "least"))
        found = found.hint("merge").join(known.select("code", F.get("ids", F.lit(0)).alias("least")), "code").withColumn("n", first).where(F.col("n") <= k + 1).select("q", "code", "distance")
        found = found.hint("merge").join(known, "code").select("code", "q", "distance", "ids")
        if nearest is not None:
            found = found.unionByName(nearest.join(live, "q", "left_semi")).dropDuplicates(["q", "code"])
        # a code gives one id at least, so the k + 1 best codes hold the k + 1 best ids
        best = F.row_number().over(Window.partitionBy("q").orderBy("distance", F.get("ids", F.lit(0))))
        now = found.withColumn("best", best).where(F.col("best") <= k + 1).drop("best")
        old = nearest
        if old is not None:
            now = now.unionByName(old.join(live, "q", "left_anti"))
        nearest = stage(now)
        if old is not None:
            drop_staged(old)
        # done: k + 1 ids (the query may be one) within the distance that is covered
        within = nearest.where(F.col("distance") <= segments * (radius + 1) - 1).groupBy("q").agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") > k)
        live_next = stage(live.join(within, "q", "left_anti"))
        if live is not asked:
            drop_staged(live)
        live = live_next
        if live.isEmpty():
            break
    by_query = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).distinct().join(nearest, "q").select("query_id", "distance", F.explode("ids").alias("neighbor_id")).where("neighbor_id <> query_id")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return by_query.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", F.col("distance").cast("int").alias("distance"))
