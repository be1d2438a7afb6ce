"""Flow records: both directions of a five-tuple in one row, and their JSON form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_flow_key(df: DataFrame, src: str = "src_ip", dst: str = "dst_ip", sport: str = "src_port", dport: str = "dst_port") -> DataFrame:
    """``df`` with lo_ip, lo_port, hi_ip, hi_port: the ends of a row in one order whatever its direction."""
    a, b = F.struct(F.col(src).alias("ip"), F.col(sport).alias("port")), F.struct(F.col(dst).alias("ip"), F.col(dport).alias("port"))
    lo, hi = F.least(a, b), F.greatest(a, b)
    return df.withColumns({"lo_ip": lo["ip"], "lo_port": lo["port"], "hi_ip": hi["ip"], "hi_port": hi["port"]})


FLOW_KEY = ["lo_ip", "lo_port", "hi_ip", "hi_port", "protocol"]


def aggregate_flows(packets: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per flow of packets (src_ip, dst_ip, src_port, dst_port, protocol, ts, payload_bytes, pkt_no).

    The first packet tells the originator.  All of it is a partial aggregate, so
    an elephant flow is summed where its packets are.  extra: more aggregates.
    """
    first = F.min_by(F.struct("src_ip", "dst_ip", "src_port", "dst_port"), "pkt_no").alias("o")
    found = with_flow_key(packets).groupBy(*FLOW_KEY).agg(first, F.min("ts").alias("ts_start"), F.max("ts").alias("ts_last"), F.sum("payload_bytes").cast("long").alias("bytes_total"), F.count(F.lit(1)).alias("packets_total"), *(c.alias(k) for k, c in (extra or {}).items()))
    duration = F.round((F.unix_micros(F.col("ts_last").cast("timestamp")) - F.unix_micros(F.col("ts_start").cast("timestamp"))) / 1000).cast("long")
    return found.select("o.src_ip", "o.dst_ip", "o.src_port", "o.dst_port", "protocol", "ts_start", "ts_last", "bytes_total", "packets_total", duration.alias("duration_ms"), *(extra or {}))


def last_l7(protocol: str = "l7_protocol", confidence: str = "l7_confidence", fields: str = "l7", order: str = "pkt_no") -> Column:
    """Aggregate: the last dissection of a flow."""
    return F.max_by(F.struct(protocol, confidence, fields), F.when(F.col(protocol).isNotNull(), F.col(order)))


def flow_flags(evasion: Column, dga: Column, vpn: Column, dot: Column, doh: Column) -> Column:
    """Names of what stands out: evasion, and scores above 0.5."""
    tests = {"tcp_evasion": evasion, "dga_suspected": dga > 0.5, "vpn_detected": vpn > 0.5, "dns_over_tls": dot > 0.5, "dns_over_https": doh > 0.5}
    return F.array_compact(F.array(*(F.when(t, k) for k, t in tests.items())))


def flow_id(counter: Column) -> Column:
    """Eight hexadecimal digits of a number's low half, a hyphen, and four of the next sixteen bits."""
    return F.concat(F.lower(F.lpad(F.hex(counter.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), F.lit("-"), F.lower(F.lpad(F.hex(F.shiftright(counter, 32).bitwiseAND(F.lit(0xFFFF))), 4, "0")))


def iso_micros(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def l7_object(protocol: Column, fields: Column) -> Column:
    """struct(name, fields): fields whose keys all share the part up to the first ``_`` nest under it without it; else under the protocol's name."""
    first = F.concat(F.substring_index(F.get(F.map_keys(fields), F.lit(0)), "_", 1), F.lit("_"))
    shared = F.coalesce(F.forall(F.map_keys(fields), lambda k: k.startswith(first)), F.lit(False)) & (F.size(fields) > 0)
    plain = F.regexp_replace(F.lower(protocol), "[^a-z0-9]", "")
    return F.struct(F.when(shared, F.regexp_replace(first, "_$", "")).otherwise(plain).alias("name"), F.when(shared, F.transform_keys(fields, lambda k, v: F.substring(k, F.length(first) + 1, F.length(k)))).otherwise(fields).alias("fields"))


def flow_json(flows: DataFrame) -> DataFrame:
    """``flows`` with ``json``: one nested record each; a null field is left out."""
    l7 = l7_object(F.col("l7_protocol"), F.col("l7"))
    known = [c for c in ("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "l7_confidence", "bytes_total", "packets_total", "duration_ms", "reassembly", "flags", "sni", "category", "app_name", "dga_score", "vpn_score", "vpn_protocol", "dot_score", "doh_score") if c in flows.columns]
    base = F.to_json(F.struct(iso_micros(F.col("ts_start")).alias("ts_start"), iso_micros(F.col("ts_last")).alias("ts_last"), F.coalesce("l7_protocol", F.lit("unknown")).alias("l7_protocol"), *known))
    with_l7 = F.concat(F.substring(base, F.lit(1), F.length(base) - 1), F.lit(","), F.substring(F.to_json(F.create_map(l7["name"], l7["fields"])), F.lit(2), F.length(F.to_json(F.create_map(l7["name"], l7["fields"])))))
    return flows.withColumn("json", F.when(F.size("l7") > 0, with_l7).otherwise(base))


def arp_conflicts(arp: DataFrame, ip: str = "sender_ip", mac: str = "sender_mac", order: str = "pkt_no") -> DataFrame:
    """``arp`` with previous_mac and conflict: whether an address was last seen with another MAC."""
    before = F.lag(mac).over(Window.partitionBy(ip).orderBy(order))
    return arp.withColumn("previous_mac", before).withColumn("conflict", F.coalesce(F.col("previous_mac") != F.col(mac), F.lit(False)))


def with_sessions(df: DataFrame, key: list[str], ts: str = "ts", idle_seconds: int = 60, order: str | None = None) -> DataFrame:
    """``df`` with ``session``: a number from 0 that rises after an idle time of more than ``idle_seconds``."""
    w = Window.partitionBy(*key).orderBy(ts, *([order] if order else []))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)
    new = F.when(gap > idle_seconds * 1_000_000, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def evict_oldest(flows: DataFrame, by: list[str]) -> DataFrame:
    """Of each table of flows (``by``) the one idle longest: the first to be emitted from a full table."""
    return flows.groupBy(*by).agg(F.min_by(F.struct(*[c for c in flows.columns if c not in by]), F.struct("ts_last", "flow_no")).alias("__f")).select(*by, "__f.*")
