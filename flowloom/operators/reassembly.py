"""Fragments and TCP segments put together again.

What needs no bytes (order, gaps, what is complete) is expressed with windows.
The byte-exact result, where overlaps follow a policy, reads rows sorted by
flow in ``mapInPandas``, no more than ``DEPTH`` bytes of each flow's payload: what
lies beyond the depth is cut before the shuffle, so an elephant flow stays small.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of each direction that are inspected.
DEPTH = 16384
MODULUS = 1 << 32

TCP_KEY = ["ip_version", "src_ip", "dst_ip", "src_port", "dst_port"]


def with_offsets(segments: DataFrame, key: list[str] | None = None, seq: str = "seq", order: str = "pkt_no") -> DataFrame:
    """``segments`` with ``off``: bytes from the first sequence number seen in the flow, modulo 2**32."""
    base = F.first(seq).over(Window.partitionBy(*(key or TCP_KEY)).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return segments.withColumn("off", F.pmod(F.col(seq) - base, F.lit(MODULUS)))


def out_of_order(segments: DataFrame, key: list[str] | None = None, order: str = "pkt_no", depth: int = DEPTH) -> DataFrame:
    """Rows (off, len) with ``out_of_order``: whether a segment starts below the highest byte seen before; null beyond the depth."""
    before = F.max(F.when(F.col("off") < depth, F.least(F.col("off") + F.col("len"), F.lit(depth)))).over(Window.partitionBy(*(key or TCP_KEY)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return segments.withColumn("out_of_order", F.when(F.col("off") < depth, F.coalesce(F.col("off") < before, F.lit(False))))


def _islands(rows: DataFrame, key: list[str]) -> DataFrame:
    """Ranges (start, stop) with ``island``: a number for each run without a gap, from 0."""
    w = Window.partitionBy(*key).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") > reach, 1).otherwise(0)
    return rows.withColumn("__new", new).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def contiguous_prefix(segments: DataFrame, key: list[str] | None = None, depth: int = DEPTH) -> DataFrame:
    """Per flow: contiguous_end, the bytes from the start without a gap, of segments (off, len)."""
    key = key or TCP_KEY
    rows = segments.where(F.col("off") < depth).select(*key, F.col("off").alias("start"), F.least(F.col("off") + F.col("len"), F.lit(depth)).alias("stop"))
    first = _islands(rows, key).where("island = 0").groupBy(*key).agg(F.min("start").alias("s"), F.max("stop").alias("e"))
    return first.select(*key, F.when(F.col("s") == 0, F.col("e")).otherwise(0).cast("long").alias("contiguous_end"))


def holes(segments: DataFrame, key: list[str] | None = None, depth: int = DEPTH) -> DataFrame:
    """Gaps (hole_start, hole_end) between the bytes seen of each flow."""
    key = key or TCP_KEY
    rows = segments.where(F.col("off") < depth).select(*key, F.col("off").alias("start"), F.least(F.col("off") + F.col("len"), F.lit(depth)).alias("stop"))
    runs = _islands(rows, key).groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    before = F.coalesce(F.lag("stop").over(Window.partitionBy(*key).orderBy("island")), F.lit(0))
    return runs.withColumn("hole_start", before).where(F.col("start") > F.col("hole_start")).select(*key, "hole_start", F.col("start").alias("hole_end"))


class Stream:
    """The bytes of one direction and what happened to them; also the state of the streaming operator."""

    def __init__(self, last_wins: bool = False, depth: int = DEPTH):
        self.buffer, self.seen = bytearray(depth), bytearray(depth)
        self.base: int | None = None
        self.high = self.delivered = self.out_of_order = self.retransmit_bytes = self.overlap_bytes = self.segments = self.retransmit_segments = self.overlap_segments = 0
        self.last_wins, self.depth = last_wins, depth

    def insert(self, seq: int, data: bytes) -> bytes:
        """What the segment makes deliverable: new contiguous bytes."""
        if self.base is None:
            self.base = seq
        at = (seq - self.base) % MODULUS
        self.segments += 1
        if at >= self.depth or not data:
            return b""
        data = data[: self.depth - at]
        if at < self.high:
            self.out_of_order += 1
        old, known = self.buffer[at : at + len(data)], self.seen[at : at + len(data)]
        if any(known):
            same = sum(1 for a, b, k in zip(old, data, known, strict=True) if k and a == b)
            differ = sum(known) - same
            self.retransmit_bytes += same
            self.overlap_bytes += differ
            self.retransmit_segments += same > 0
            self.overlap_segments += differ > 0
            if not self.last_wins:
                data = bytes(a if k else b for a, b, k in zip(old, data, known, strict=True))
        self.buffer[at : at + len(data)] = data
        self.seen[at : at + len(data)] = b"\1" * len(data)
        self.high = max(self.high, at + len(data))
        end = self.seen.find(0, self.delivered)
        end = self.depth if end < 0 else end
        fresh = bytes(self.buffer[self.delivered : end])
        self.delivered = end
        return fresh


_REASSEMBLED = (
    "data binary, contiguous_end long, segments long, out_of_order long, retransmit_bytes long, overlap_bytes long, retransmit_segments long, overlap_segments long, evasion boolean"
)


def reassemble(segments: DataFrame, key: list[str] | None = None, *, policy: str = "first", depth: int = DEPTH) -> DataFrame:
    """Per directional flow of segments (seq, payload, pkt_no): the contiguous bytes and the counts.

    policy: ``first`` or ``last`` to come wins where segments overlap and differ.
    """
    key = key or TCP_KEY

    def finish(head: tuple, s: Stream, _: list) -> list[tuple]:
        return [(*head, bytes(s.buffer[: s.delivered]), s.delivered, s.segments, s.out_of_order, s.retransmit_bytes, s.overlap_bytes, s.retransmit_segments, s.overlap_segments, s.overlap_bytes > 0)]

    return _by_flow(segments, key, policy, depth, finish, _REASSEMBLED)


def _by_flow(segments: DataFrame, key: list[str], policy: str, depth: int, finish, out: str) -> DataFrame:
    """Run the segments of each flow, in order, through a ``Stream``; ``finish`` makes rows of (key, stream, deliveries).

    Rows are dealt out and sorted by flow and read one after the other, so a
    flow's segments are never gathered, and small flows cost no call each.
    """
    last_wins = {"first": False, "last": True}[policy]
    body = segments.select(*key, "seq", F.substring("payload", 1, depth).alias("payload"), "pkt_no")
    schema = body.select(*key).limit(0).schema.simpleString().removeprefix("struct<").removesuffix(">")

    def run(batches):
        head, stream, fresh, rows = None, None, [], []
        names = [*key, *(x.split()[0].strip("`") for x in out.split(", "))]

        def batch():
            return pd.DataFrame(rows, columns=names)

        for b in batches:
            for r in zip(*(b[c] for c in (*key, "pkt_no", "seq", "payload")), strict=True):
                own = r[: len(key)]
                if own != head:
                    if stream is not None:
                        rows += finish(head, stream, fresh)
                    head, stream, fresh = own, Stream(last_wins, depth), []
                first = stream.delivered == 0
                if got := stream.insert(int(r[-2]), bytes(r[-1]) if r[-1] is not None else b""):
                    fresh.append((r[-3], got, first))
                if len(rows) >= 4096:
                    yield batch()
                    rows = []
        if stream is not None:
            rows += finish(head, stream, fresh)
        if rows:
            yield batch()

    return body.repartition(*key).sortWithinPartitions(*key, "pkt_no").mapInPandas(run, ", ".join(schema.replace(":", " ").split(",")) + ", " + out)


def deliveries(segments: DataFrame, key: list[str] | None = None, *, policy: str = "first", depth: int = DEPTH) -> DataFrame:
    """Per segment that makes bytes deliverable: pkt_no, data (the new contiguous bytes) and is_first_delivery."""
    def finish(head: tuple, _: Stream, fresh: list) -> list[tuple]:
        return [(*head, *f) for f in fresh]

    return _by_flow(segments, key or TCP_KEY, policy, depth, finish, "pkt_no long, data binary, is_first_delivery boolean")


def fragments_complete(fragments: DataFrame, key: list[str]) -> DataFrame:
    """Per datagram of fragments (offset, len, more_fragments): n_fragments, total_len (null without a last fragment) and complete."""
    rows = fragments.select(*key, F.col("offset").cast("long").alias("start"), (F.col("offset") + F.col("len")).cast("long").alias("stop"), "more_fragments")
    total = F.max(F.when(~F.col("more_fragments"), F.col("stop")))
    marked = _islands(rows, key)
    found = marked.groupBy(*key).agg(F.count(F.lit(1)).alias("n_fragments"), total.alias("total_len"), F.min("start").alias("__s"), F.max(F.when(F.col("island") == 0, F.col("stop"))).alias("__e"))
    done = F.coalesce((F.col("__s") == 0) & (F.col("__e") >= F.col("total_len")), F.lit(False))
    return found.select(*key, "n_fragments", "total_len", done.alias("complete"))


def defragment(fragments: DataFrame, key: list[str]) -> DataFrame:
    """Per complete datagram: its payload. A byte sent twice has the value sent last.

    A datagram has 65,535 bytes at most, so no group grows beyond that but by
    repetition; equal fragments are dropped before the shuffle's groups are built.
    """
    kinds = {f.name: f.dataType.simpleString() for f in fragments.schema.fields}
    last = fragments.groupBy(*key, "offset", "payload", "more_fragments").agg(F.max("pkt_no").alias("pkt_no"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pkt_no")
        ends = [o + len(p) for o, p, m in group[["offset", "payload", "more_fragments"]].itertuples(index=False) if not m]
        columns = [*key, "payload"]
        if not ends or ends[-1] > 65535:
            return pd.DataFrame([], columns=columns)
        data, seen = bytearray(ends[-1]), bytearray(ends[-1])
        for o, p in group[["offset", "payload"]].itertuples(index=False):
            p = bytes(p)[: max(0, len(data) - o)]
            data[o : o + len(p)] = p
            seen[o : o + len(p)] = b"\1" * len(p)
        if not all(seen):
            return pd.DataFrame([], columns=columns)
        return pd.DataFrame([[*(group[k].iloc[0] for k in key), bytes(data)]], columns=columns)

    return last.groupBy(*key).applyInPandas(one, ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", payload binary")


def http2_flows(deliveries_: DataFrame) -> DataFrame:
    """HTTP/2 fields of each delivery (TCP key, pkt_no, data), with the header tables of both directions of a connection.

    A connection's deliveries meet in one group, keyed on both directions.
    """
    from flowloom.operators.flows import with_flow_key
    from flowloom.operators.walkers import Http2Flow, http2_segment

    keyed = with_flow_key(deliveries_).select("ip_version", "lo_ip", "lo_port", "hi_ip", "hi_port", "src_ip", "src_port", "dst_ip", "dst_port", "pkt_no", "data")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        flows: dict[tuple, Http2Flow] = {}
        rows = []
        for r in group.sort_values("pkt_no").itertuples(index=False):
            own, back = (r.src_ip, r.src_port), (r.dst_ip, r.dst_port)
            fields = http2_segment(bytes(r.data), flows.setdefault(own, Http2Flow()), flows.setdefault(back, Http2Flow()))
            rows.append([r.ip_version, r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.pkt_no, fields])
        return pd.DataFrame(rows, columns=["ip_version", "src_ip", "dst_ip", "src_port", "dst_port", "pkt_no", "fields"])

    return keyed.groupBy("ip_version", "lo_ip", "lo_port", "hi_ip", "hi_port").applyInPandas(one, "ip_version int, src_ip string, dst_ip string, src_port int, dst_port int, pkt_no long, fields map<string,string>")


def retransmitted_bytes(segments: DataFrame, key: list[str]) -> DataFrame:
    """Per flow: bytes of segments (off, len, pkt_no) that an earlier segment covers already, counted once for each segment."""
    w = Window.partitionBy(*key).orderBy("pkt_no").rowsBetween(Window.unboundedPreceding, -1)
    # ranges seen before, as a merged list kept in order of start
    before = F.collect_list(F.struct(F.col("off").alias("s"), (F.col("off") + F.col("len")).alias("e"))).over(w)
    start, stop = F.col("off"), F.col("off") + F.col("len")

    def merge(acc: Column, x: Column) -> Column:
        at = F.greatest(acc["at"], x["s"], start)
        to = F.least(x["e"], stop)
        return F.when(to > at, F.struct(to.alias("at"), (acc["n"] + to - at).alias("n"))).otherwise(acc)

    covered = F.aggregate(F.array_sort("__before"), F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("n")), lambda a, x: merge(a, x).cast("struct<at:bigint,n:bigint>"), lambda a: a["n"])
    return segments.withColumn("__before", before).withColumn("__n", covered).groupBy(*key).agg(F.sum("__n").cast("long").alias("retransmit_bytes"))

