"""Flows, sessions and TCP streams over unbounded input, by event time."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowloom.operators.flows import FLOW_KEY, with_flow_key
from flowloom.operators.reassembly import DEPTH, TCP_KEY, Stream

IDLE = "60 seconds"


def session_flows(packets: DataFrame, idle: str = IDLE, late: str = IDLE) -> DataFrame:
    """One row per flow and burst: a flow that is idle for ``idle`` ends; rows later than ``late`` are not counted."""
    keyed = with_flow_key(packets.withWatermark("ts", late))
    first = F.min_by(F.struct("src_ip", "dst_ip", "src_port", "dst_port"), "pkt_no").alias("o")
    found = keyed.groupBy(F.session_window("ts", idle).alias("w"), *FLOW_KEY).agg(first, F.min("ts").alias("ts_start"), F.max("ts").alias("ts_last"), F.sum("payload_bytes").cast("long").alias("bytes_total"), F.count(F.lit(1)).alias("packets_total"))
    return found.select("o.src_ip", "o.dst_ip", "o.src_port", "o.dst_port", "protocol", "ts_start", "ts_last", "bytes_total", "packets_total")


def windowed_counts(packets: DataFrame, size: str = "1 minute", late: str = IDLE) -> DataFrame:
    """Packets and bytes of each protocol in windows of ``size``."""
    return packets.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "protocol").agg(F.count(F.lit(1)).alias("packets"), F.sum("payload_bytes").cast("long").alias("bytes")).select("w.start", "w.end", "protocol", "packets", "bytes")


class TcpStreams(StatefulProcessor):
    """Keeps a ``Stream`` for each directional flow, and forgets it after an idle time."""

    def __init__(self, last_wins: bool = False, depth: int = DEPTH, idle_ms: int = 60_000):
        self.last_wins, self.depth, self.idle_ms = last_wins, depth, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stream", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stream = pickle.loads(self.state.get()[0]) if self.state.exists() else Stream(self.last_wins, self.depth)
        out = []
        for frame in rows:
            for r in frame.sort_values("pkt_no").itertuples(index=False):
                first = stream.delivered == 0
                if fresh := stream.insert(int(r.seq), bytes(r.payload)):
                    out.append([*key, int(r.pkt_no), fresh, first, stream.out_of_order, stream.retransmit_bytes, stream.overlap_bytes])
        self.state.update((pickle.dumps(stream),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=[*TCP_KEY, "pkt_no", "data", "is_first_delivery", "out_of_order", "retransmit_bytes", "overlap_bytes"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=[*TCP_KEY, "pkt_no", "data", "is_first_delivery", "out_of_order", "retransmit_bytes", "overlap_bytes"])

    def close(self) -> None:
        pass


def stream_deliveries(segments: DataFrame, *, policy: str = "first", depth: int = DEPTH, idle_ms: int = 60_000) -> DataFrame:
    """Deliveries of a stream of segments (TCP key, seq, payload, pkt_no); the session needs the RocksDB state store."""
    schema = "ip_version int, src_ip string, dst_ip string, src_port int, dst_port int, pkt_no long, data binary, is_first_delivery boolean, out_of_order long, retransmit_bytes long, overlap_bytes long"
    return segments.groupBy(*TCP_KEY).transformWithStateInPandas(TcpStreams(policy == "last", depth, idle_ms), schema, "Append", "processingTime")
