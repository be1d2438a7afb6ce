"""Queries over the synthetic tables, one for each operator, and the same in SQL.

Events stand for packets (user_id as source, event_type as destination, value as
bytes) and line items for segments and fragments; hosts come from the URLs of pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.functions.bytes import checksum16, entropy
from flowloom.operators import appid, flows, frames, reassembly, rules, scores
from flowloom.plans.quicpackets import quic_packet
from flowloom.plans.linkframes import DOT11_SQL, FRAMES, dot11_roundtrip, link_roundtrip, link_sql
from flowloom.plans.registry import classify
from flowloom.plans.roundtrip import CASES, UDP_IN_IP, A, B, C, Q, W, ip, k, n8, n16, n32, raw, roundtrip, roundtrip_sql, s

# test rules: (line, suffix, category, name)
RULES = [
    (1, "example.com", "web", "Example"),
    (2, "m.example.com", "mobile", "Mobile"),
    (3, "example.net", "vpn_proxy", "Tunnel"),
    (4, "www.example.org", "dns_over_https", "Resolver"),
    (5, "EXAMPLE.com", "late", "Duplicate"),
    (6, "-", "bad", "Too short"),
    (7, "nodot", "bad", "One label"),
    (8, "a..b", "bad", "Empty label"),
    (9, "org", "bad", "One label"),
    (10, "m.ththth.example.net", "mobile", "Longer"),
]
_VALUES = ", ".join(f"({n}, '{suffix}', '{c}', '{a}')" for n, suffix, c, a in RULES)
_RULES = f"(SELECT * FROM (VALUES {_VALUES}) AS t(line_no, suffix, category, app_name))"
_HOSTS = "(SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages)"
_VALID = "length(suffix) BETWEEN 3 AND 127 AND regexp_matches(suffix, '^[A-Za-z0-9_-]+([.][A-Za-z0-9_-]+)+$')"
_KEPT = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(suffix) ORDER BY line_no) AS n FROM {_RULES} WHERE {_VALID}) WHERE n = 1)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rules(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM (VALUES {_VALUES}) AS t(line_no, suffix, category, app_name)")


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select(F.parse_url("url", F.lit("HOST")).alias("host")).distinct()


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets; every second one goes back."""
    e = _table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    user, kind = F.concat(F.lit("10.0.0."), F.col("user_id")), F.col("event_type")
    back = F.col("event_id") % 2 == 1
    return e.select(
        F.when(back, kind).otherwise(user).alias("src_ip"),
        F.when(back, user).otherwise(kind).alias("dst_ip"),
        F.when(back, 443).otherwise(1024).alias("src_port"),
        F.when(back, 1024).otherwise(443).alias("dst_port"),
        F.lit("TCP").alias("protocol"),
        "ts",
        F.floor(F.abs("value")).cast("long").alias("payload_bytes"),
        F.col("event_id").alias("pkt_no"),
    )


_PACKETS = """(SELECT CASE WHEN event_id % 2 = 1 THEN event_type ELSE '10.0.0.' || user_id END AS src_ip, CASE WHEN event_id % 2 = 1 THEN '10.0.0.' || user_id ELSE event_type END AS dst_ip,
CASE WHEN event_id % 2 = 1 THEN 443 ELSE 1024 END AS src_port, CASE WHEN event_id % 2 = 1 THEN 1024 ELSE 443 END AS dst_port, 'TCP' AS protocol, ts, CAST(floor(abs(value)) AS BIGINT) AS payload_bytes, event_id AS pkt_no, user_id, event_type FROM events)"""


@query(f"SELECT host FROM {_HOSTS}")
def host_extract(spark, sf_dir):
    return _hosts(spark, sf_dir)


@query(f"SELECT line_no, {_VALID} AS valid FROM {_RULES}")
def rule_validate(spark, sf_dir):
    return _rules(spark).select("line_no", rules.valid_suffix(F.col("suffix")).alias("valid"))


@query(f"SELECT line_no, suffix, category, app_name FROM {_KEPT}")
def rule_dedupe(spark, sf_dir):
    return rules.dedupe_rules(_rules(spark))


_CLASSIFIED = f"""(SELECT h.host, coalesce(arg_max(r.category, length(r.suffix)), 'unclassified') AS category, arg_max(r.app_name, length(r.suffix)) AS app_name, CASE WHEN max(length(r.suffix)) IS NULL THEN 'low' ELSE 'high' END AS match_confidence
FROM {_HOSTS} h LEFT JOIN {_KEPT} r ON lower(h.host) = lower(r.suffix) OR ends_with(lower(h.host), '.' || lower(r.suffix)) GROUP BY h.host)"""


@query(f"SELECT host, category, app_name, match_confidence FROM {_CLASSIFIED}")
def domain_classify(spark, sf_dir):
    return rules.classify_hosts(_hosts(spark, sf_dir), rules.dedupe_rules(_rules(spark)))


_LABEL = "left(split_part(host, '.', 1), 63)"
_BIGRAMS = ", ".join(f"'{x}'" for x in scores.BIGRAMS)
_PARTS = f"""(SELECT host, label,
(SELECT least(-sum(p * log2(p)) / 5.17, 1.0) FROM (SELECT count(*) / length(label)::DOUBLE AS p FROM (SELECT unnest(string_split(lower(label), '')) AS c) GROUP BY c)) AS entropy,
coalesce(1.0 - len(list_filter(pairs, lambda x: x IN ({_BIGRAMS})))::DOUBLE / nullif(len(pairs), 0), 0.5) AS bigram,
least(list_max(list_transform(string_split_regex(lower(label), '[^b-df-hj-np-tv-z]'), lambda x: length(x))) / 6.0, 1.0) AS consonant,
least((0.4 * length(regexp_replace(label, '[^0-9]', '', 'g')) + 0.6 * len(list_filter(range(1, length(label)), lambda i: (label[i] BETWEEN '0' AND '9') <> (label[i + 1] BETWEEN '0' AND '9')))) / length(label), 1.0) AS digit
FROM (SELECT host, label, list_filter(list_transform(range(1, length(label)), lambda i: lower(label[i:i + 1])), lambda x: regexp_matches(x, '^[a-z][a-z]$')) AS pairs FROM (SELECT host, {_LABEL} AS label FROM {_HOSTS})))"""
_SHORT = "length(label) < 4"
_DGA = f"(SELECT host, label, CASE WHEN {_SHORT} THEN 0 ELSE entropy END AS entropy, CASE WHEN {_SHORT} THEN 0 ELSE bigram END AS bigram, CASE WHEN {_SHORT} THEN 0 ELSE consonant END AS consonant, CASE WHEN {_SHORT} THEN 0 ELSE digit END AS digit FROM {_PARTS})"
_SCORE = "0.35 * entropy + 0.35 * bigram + 0.15 * consonant + 0.15 * digit"
_VERDICT = f"CASE WHEN {_SCORE} >= 0.7 THEN 'high' WHEN {_SCORE} >= 0.4 THEN 'medium' ELSE 'low' END"


def _dga_part(part: str):
    def run(spark, sf_dir):
        return _hosts(spark, sf_dir).select("host", F.round(scores.dga(F.col("host"))[part].cast("double"), 6).alias(part))

    return run


for _part in ("entropy", "bigram", "consonant", "digit"):
    QUERIES[f"dga_{_part}"] = _dga_part(_part)
    SQL[f"dga_{_part}"] = f"SELECT host, round({_part}::DOUBLE, 6) AS {_part} FROM {_DGA}"


@query(f"SELECT host, round(({_SCORE})::DOUBLE, 6) AS score, {_VERDICT} AS verdict FROM {_DGA}")
def dga_score(spark, sf_dir):
    d = scores.dga(F.col("host"))
    return _hosts(spark, sf_dir).select("host", d.alias("d")).select("host", F.round("d.score", 6).alias("score"), "d.verdict")


@query(f"SELECT category, verdict, count(*) AS hosts, round(avg(score)::DOUBLE, 6) AS avg_score FROM (SELECT d.host, category, {_SCORE} AS score, {_VERDICT} AS verdict FROM {_DGA} d JOIN {_CLASSIFIED} c ON c.host = d.host) GROUP BY category, verdict")
def host_report(spark, sf_dir):
    """The flagship: hosts by category and by how generated their names look."""
    found = rules.classify_hosts(_hosts(spark, sf_dir), rules.dedupe_rules(_rules(spark))).withColumn("d", scores.dga(F.col("host")))
    return found.groupBy("category", F.col("d.verdict").alias("verdict")).agg(F.count(F.lit(1)).alias("hosts"), F.round(F.avg("d.score"), 6).alias("avg_score"))


_PORT = "CASE l_linenumber WHEN 1 THEN 51820 WHEN 2 THEN 1194 WHEN 3 THEN 500 WHEN 4 THEN 4500 WHEN 5 THEN 1723 WHEN 6 THEN 853 ELSE 443 END"
_L4 = "CASE WHEN l_linenumber >= 5 THEN 'TCP' ELSE 'UDP' END"
_KIND = "(l_orderkey % 4)"


@query(f"""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber = 7 AND l_orderkey % 5 = 0 THEN greatest(s, 0.9) ELSE s END, 6) AS score, CASE WHEN l_linenumber = 7 AND l_orderkey % 5 = 0 AND p = 'none' THEN 'commercial_vpn_app' ELSE p END AS protocol FROM (
SELECT *, least(best + 0.3 * CASE l_linenumber WHEN 1 THEN 0.5 WHEN 2 THEN 0.4 WHEN 3 THEN 0.3 WHEN 4 THEN 0.3 WHEN 5 THEN 0.5 ELSE 0 END, 1.0)::DOUBLE AS s FROM (
SELECT l_orderkey, l_linenumber, CASE {_KIND} WHEN 0 THEN 0.95 WHEN 1 THEN 0.3 WHEN 2 THEN CASE WHEN l_linenumber = 3 THEN 0.7 WHEN l_linenumber = 4 THEN 0 ELSE 0.3 END ELSE 0 END AS best, CASE {_KIND} WHEN 0 THEN 'wireguard' WHEN 1 THEN 'openvpn' WHEN 2 THEN CASE WHEN l_linenumber = 4 THEN 'none' ELSE 'ike' END ELSE 'none' END AS p FROM lineitem))""")
def vpn_score(spark, sf_dir):
    payload = f"unhex(CASE {_KIND} WHEN 0 THEN concat('01000000', repeat('77', 144)) WHEN 1 THEN '1603010010' WHEN 2 THEN concat(repeat('f0', 17), '20', repeat('00', 10)) ELSE repeat('ff', 10) END)"
    category = F.expr("CASE WHEN l_linenumber = 7 AND l_orderkey % 5 = 0 THEN 'vpn_proxy' END")
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(payload).alias("p"), F.expr(_PORT).alias("port"), F.expr(_L4).alias("l4"), category.alias("c"))
    v = scores.vpn(F.col("p"), F.col("port"), F.col("l4"), F.col("c"))
    return rows.select("l_orderkey", "l_linenumber", v.alias("v")).select("l_orderkey", "l_linenumber", F.round(F.col("v.score").cast("double"), 6).alias("score"), "v.protocol")


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber >= 5 AND {_KIND} = 1 THEN CASE WHEN l_linenumber = 6 THEN 0.85 ELSE 0.15 END ELSE 0 END::DOUBLE AS dot, CASE WHEN l_linenumber = 1 THEN 0.9 ELSE 0 END::DOUBLE AS doh FROM lineitem")
def dot_doh_score(spark, sf_dir):
    payload = F.expr(f"unhex(CASE WHEN {_KIND} = 1 THEN '160301001000' ELSE '170301001000' END)")
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", payload.alias("p"), F.expr(_PORT).alias("port"), F.expr(_L4).alias("l4"))
    return rows.select("l_orderkey", "l_linenumber", scores.dot(F.col("p"), F.col("port"), F.col("l4")).cast("double").alias("dot"), scores.doh(F.when(F.col("l_linenumber") == 1, "dns_over_https").otherwise("web")).cast("double").alias("doh"))


_FLOWS = f"""(SELECT arg_min(src_ip, pkt_no) AS src_ip, arg_min(dst_ip, pkt_no) AS dst_ip, arg_min(src_port, pkt_no) AS src_port, arg_min(dst_port, pkt_no) AS dst_port, min(ts) AS ts_start, max(ts) AS ts_last, CAST(sum(payload_bytes) AS BIGINT) AS bytes_total, count(*) AS packets_total FROM {_PACKETS} GROUP BY user_id, event_type)"""


@query(f"SELECT src_ip, dst_ip, src_port, dst_port, bytes_total, packets_total, CAST(round((epoch_us(ts_last) - epoch_us(ts_start)) / 1000.0) AS BIGINT) AS duration_ms FROM {_FLOWS}")
def flow_aggregate(spark, sf_dir):
    return flows.aggregate_flows(_packets(spark, sf_dir)).select("src_ip", "dst_ip", "src_port", "dst_port", "bytes_total", "packets_total", "duration_ms")


@query(f"SELECT src_ip, dst_ip, strftime(ts_start, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts_start, strftime(ts_last, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts_last FROM {_FLOWS}")
def iso_micros(spark, sf_dir):
    found = flows.aggregate_flows(_packets(spark, sf_dir))
    return found.select("src_ip", "dst_ip", flows.iso_micros(F.col("ts_start")).alias("ts_start"), flows.iso_micros(F.col("ts_last")).alias("ts_last"))


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_linenumber = 1 THEN 'tcp_evasion' END, CASE WHEN l_discount * 10 > 0.5 THEN 'dga_suspected' END, CASE WHEN l_tax * 10 > 0.5 THEN 'vpn_detected' END, CASE WHEN l_linenumber = 2 THEN 'dns_over_tls' END, CASE WHEN l_linenumber = 3 THEN 'dns_over_https' END], lambda x: x IS NOT NULL), ',') AS flags FROM lineitem")
def flow_flags(spark, sf_dir):
    n = F.col("l_linenumber")
    got = flows.flow_flags(n == 1, F.col("l_discount") * 10, F.col("l_tax") * 10, F.when(n == 2, 0.85).otherwise(0.15), F.when(n == 3, 0.9).otherwise(0.0))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(got, ",").alias("flags"))


@query("SELECT o_orderkey, printf('%08x-%04x', (o_orderkey * 1000003) % 4294967296, ((o_orderkey * 1000003) // 4294967296) % 65536) AS flow_id FROM orders")
def flow_id_format(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", flows.flow_id(F.col("o_orderkey") * 1000003).alias("flow_id"))


@query(f"SELECT src_ip, dst_ip, ts_last, bytes_total FROM (SELECT *, row_number() OVER (PARTITION BY split_part(CASE WHEN src_port = 443 THEN dst_ip ELSE src_ip END, '.', 4) ORDER BY ts_last, CASE WHEN src_port = 443 THEN src_ip ELSE dst_ip END) AS n FROM {_FLOWS}) WHERE n = 1")
def evict_oldest(spark, sf_dir):
    found = flows.aggregate_flows(_packets(spark, sf_dir))
    own = F.col("src_port") == 443
    named = found.withColumn("user", F.when(own, F.col("dst_ip")).otherwise(F.col("src_ip"))).withColumn("flow_no", F.when(own, F.col("src_ip")).otherwise(F.col("dst_ip")))
    return flows.evict_oldest(named, ["user"]).select("src_ip", "dst_ip", F.col("ts_last").cast("timestamp_ntz").alias("ts_last"), "bytes_total")


@query("""SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, CAST(round(sum(value), 2) AS DOUBLE) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 86400000000 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, session""")
def session_timeout(spark, sf_dir):
    found = flows.with_sessions(_table(spark, sf_dir, "events"), ["user_id"], idle_seconds=86400, order="event_id")
    return found.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT event_id, lag(mac) OVER (PARTITION BY ip ORDER BY event_id) AS previous_mac, coalesce(lag(mac) OVER (PARTITION BY ip ORDER BY event_id) <> mac, false) AS conflict FROM (SELECT event_id, user_id % 20 AS ip, event_type AS mac FROM events)")
def arp_conflict(spark, sf_dir):
    arp = _table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("ip"), F.col("event_type").alias("mac"))
    return flows.arp_conflicts(arp, "ip", "mac", "event_id").select("event_id", "previous_mac", "conflict")


# line items as segments: an order is a flow, the line number the order of arrival
_OFF = "((l_partkey % 7) * 3)"
_LEN = "(1 + l_suppkey % 9)"
_SEGS = f"(SELECT l_orderkey AS flow, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pkt_no, l_partkey, {_OFF} AS off, {_LEN} AS len FROM lineitem)"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    # several line items of an order can have one line number: each is a segment, and the number of arrival is made unique
    arrival = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return rows.select(F.col("l_orderkey").alias("flow"), arrival.alias("pkt_no"), F.expr(_OFF).alias("off"), F.expr(_LEN).alias("len"))


@query(f"SELECT flow, pkt_no, coalesce(off < max(off + len) OVER (PARTITION BY flow ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS out_of_order FROM {_SEGS}")
def tcp_out_of_order(spark, sf_dir):
    return reassembly.out_of_order(_segments(spark, sf_dir), ["flow"]).select("flow", "pkt_no", "out_of_order")


_ISLANDS = f"(SELECT *, sum(new) OVER (PARTITION BY flow ORDER BY off, e) AS island FROM (SELECT flow, off, off + len AS e, CASE WHEN off > max(off + len) OVER (PARTITION BY flow ORDER BY off, off + len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM {_SEGS}))"


@query(f"SELECT flow, CAST(CASE WHEN min(off) = 0 THEN max(e) ELSE 0 END AS BIGINT) AS contiguous_end FROM {_ISLANDS} WHERE island = 0 GROUP BY flow")
def tcp_contiguous_prefix(spark, sf_dir):
    return reassembly.contiguous_prefix(_segments(spark, sf_dir), ["flow"])


@query(f"SELECT flow, hole_start, hole_end FROM (SELECT flow, coalesce(lag(e) OVER (PARTITION BY flow ORDER BY island), 0) AS hole_start, s AS hole_end FROM (SELECT flow, island, min(off) AS s, max(e) AS e FROM {_ISLANDS} GROUP BY flow, island)) WHERE hole_end > hole_start")
def tcp_holes(spark, sf_dir):
    return reassembly.holes(_segments(spark, sf_dir), ["flow"])


@query(f"SELECT flow, CAST(sum(n) AS BIGINT) AS retransmit_bytes FROM (SELECT a.flow, a.pkt_no, (SELECT count(DISTINCT x) FROM (SELECT unnest(range(greatest(a.off, b.off), least(a.off + a.len, b.off + b.len))) AS x FROM {_SEGS} b WHERE b.flow = a.flow AND b.pkt_no < a.pkt_no AND b.off < a.off + a.len AND b.off + b.len > a.off)) AS n FROM {_SEGS} a) GROUP BY flow")
def tcp_retransmit_bytes(spark, sf_dir):
    return reassembly.retransmitted_bytes(_segments(spark, sf_dir), ["flow"])


# bytes differ between segments that overlap, in one of five places
_BYTE = "(97 + (off + x) % 23 + CASE WHEN (off + x + pkt_no) % 5 = 0 THEN 1 ELSE 0 END)"
_BYTES = f"""(SELECT flow, pkt_no, off - base + x AS pos, {_BYTE} AS byte FROM (SELECT *, unnest(range(len)) AS x, first_value(off) OVER (PARTITION BY flow ORDER BY pkt_no) AS base FROM {_SEGS}) WHERE off >= base)"""
_KNOWN = f"(SELECT *, first_value(byte) OVER w AS kept, row_number() OVER w AS nth FROM {_BYTES} WINDOW w AS (PARTITION BY flow, pos ORDER BY pkt_no))"


@query(f"""SELECT flow, contiguous_end, data_hex, segments, CAST(retransmit_bytes AS BIGINT) AS retransmit_bytes, CAST(overlap_bytes AS BIGINT) AS overlap_bytes, overlap_bytes > 0 AS evasion
FROM (SELECT flow, count(*) AS segments FROM {_SEGS} GROUP BY flow)
JOIN (SELECT flow, count(*) FILTER (WHERE nth > 1 AND byte = kept) AS retransmit_bytes, count(*) FILTER (WHERE nth > 1 AND byte <> kept) AS overlap_bytes FROM {_KNOWN} GROUP BY flow) USING (flow)
JOIN (SELECT flow, count(*) AS contiguous_end, string_agg(printf('%02X', byte), '' ORDER BY pos) AS data_hex FROM (SELECT *, row_number() OVER (PARTITION BY flow ORDER BY pos) AS n FROM {_KNOWN} WHERE nth = 1) WHERE pos = n - 1 GROUP BY flow) USING (flow)""")
def tcp_reassemble(spark, sf_dir):
    """Byte-exact, relative to the first segment seen; what comes before it is beyond the depth, and of bytes that differ the first stay."""
    text = f"array_join(transform(sequence(0, cast(len as int) - 1), x -> char({_BYTE})), '')"
    segs = _segments(spark, sf_dir).select("flow", F.col("off").cast("long").alias("seq"), F.expr(f"cast({text} as binary)").alias("payload"), F.col("pkt_no").cast("long").alias("pkt_no"))
    got = reassembly.reassemble(segs, ["flow"])
    return got.select("flow", "contiguous_end", F.hex("data").alias("data_hex"), "segments", "retransmit_bytes", "overlap_bytes", "evasion")


@query(f"SELECT flow, count(*) AS n_fragments, coalesce(max(CASE WHEN last THEN e END), -1) AS total_len, coalesce(min(off) = 0 AND max(CASE WHEN island = 0 THEN e END) >= max(CASE WHEN last THEN e END), false) AS complete FROM (SELECT *, sum(new) OVER (PARTITION BY flow ORDER BY off, e) AS island FROM (SELECT flow, off, off + len AS e, l_partkey % 3 = 0 AS last, CASE WHEN off > max(off + len) OVER (PARTITION BY flow ORDER BY off, off + len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM {_SEGS})) GROUP BY flow")
def frag_complete(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    frags = rows.select(F.col("l_orderkey").alias("flow"), F.expr(_OFF).alias("offset"), F.expr(_LEN).alias("len"), (F.col("l_partkey") % 3 != 0).alias("more_fragments"))
    return reassembly.fragments_complete(frags, ["flow"]).withColumn("total_len", F.coalesce("total_len", F.lit(-1)))


_KINDS = ["modbus", "http1", "dns", "ntp", "ssh", "stun", "gre"]


@query("SELECT l_orderkey, l_linenumber, " + "CASE l_linenumber % 7 " + " ".join(f"WHEN {i} THEN '{CASES[n].protocol}'" for i, n in enumerate(_KINDS)) + " END AS protocol, CASE l_linenumber % 7 " + " ".join(f"WHEN {i} THEN {CASES[n].score}" for i, n in enumerate(_KINDS)) + " END::DOUBLE AS confidence FROM lineitem")
def registry_argmax(spark, sf_dir):
    from flowloom.plans.registry import REGISTRY, dissectors
    from flowloom.plans.roundtrip import payload_sql

    dissectors()
    case = lambda f: "CASE l_linenumber % 7 " + " ".join(f"WHEN {i} THEN {f(CASES[n])}" for i, n in enumerate(_KINDS)) + " END"
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(case(payload_sql)).alias("payload"), F.expr(case(lambda c: c.port)).alias("dst_port"), F.expr(case(lambda c: f"'{REGISTRY[c.protocol].l4[0]}'")).alias("l4_proto"))
    return classify(rows).select("l_orderkey", "l_linenumber", "protocol", F.round("confidence", 6).alias("confidence"))


@query("SELECT n_name, coalesce(enabled, true) AS enabled FROM nation LEFT JOIN (VALUES ('ALGERIA', false), ('BRAZIL', true), ('CHINA', false)) AS c(name, enabled) ON lower(n_name) = lower(name)")
def protocol_toggle(spark, sf_dir):
    config = spark.sql("SELECT * FROM (VALUES ('algeria', false), ('Brazil', true), ('china', false)) AS c(name, enabled)")
    return rules.with_enabled(_table(spark, sf_dir, "nation").select("n_name"), config, "n_name")


@query("SELECT l_orderkey, l_linenumber, 65535 - (t % 65536 + t // 65536) AS checksum FROM (SELECT l_orderkey, l_linenumber, (l_orderkey % 65536) + (l_partkey % 65536) + (l_suppkey % 256) * 256 AS t FROM lineitem)")
def checksum16_words(spark, sf_dir):
    payload = F.expr(f"unhex(concat({n16(A)}, {n16(B)}, {n8(C)}))")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", checksum16(payload).alias("checksum"))


@query("SELECT doc_id, round(CASE WHEN octet_length(encode(text)) > 0 THEN (SELECT -sum(p * log2(p)) FROM (SELECT count(*) / length(h)::DOUBLE * 2 AS p FROM (SELECT unnest(list_transform(range(1, length(h), 2), lambda i: h[i:i + 1])) AS c) GROUP BY c)) ELSE 0 END, 4) AS entropy FROM (SELECT doc_id, text, hex(encode(text)) AS h FROM documents)")
def byte_entropy_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.round(entropy(F.encode("text", "UTF-8")), 4).alias("entropy"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'dns' ELSE 'http11' END AS name, CASE WHEN l_linenumber % 2 = 0 THEN 'qname,qtype' ELSE 'dns_qname,sni' END AS keys FROM lineitem")
def json_nest_prefix(spark, sf_dir):
    even = F.col("l_linenumber") % 2 == 0
    fields = F.when(even, F.create_map(F.lit("dns_qname"), F.lit("x"), F.lit("dns_qtype"), F.lit("1"))).otherwise(F.create_map(F.lit("dns_qname"), F.lit("x"), F.lit("sni"), F.lit("y")))
    o = flows.l7_object(F.when(even, "DNS").otherwise("HTTP/1.1"), fields)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", o.alias("o")).select("l_orderkey", "l_linenumber", "o.name", F.array_join(F.map_keys("o.fields"), ",").alias("keys"))


_FRAME = f"unhex(concat('020000000001', '020000000002', {raw('8100')}, {n16(f'{A} % 4096')}, {raw('8100')}, {n16(W)}, {raw('0800')}, {', '.join(UDP_IN_IP)}))"


@query(f"SELECT l_orderkey, l_linenumber, CAST({A} % 4096 AS INTEGER) AS vlan_outer, CAST(l_linenumber AS INTEGER) AS vlan_inner, 'ipv4' AS l3_kind, '10.0.0.1' AS src, {ip(Q)} AS dst, CAST({A} AS INTEGER) AS src_port, CAST({B} AS INTEGER) AS dst_port, 'ABCD' AS payload FROM lineitem")
def frame_decode(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(1).alias("link_type"), F.expr(_FRAME).alias("data"))
    got = frames.decode_frames(rows)
    return got.select("l_orderkey", "l_linenumber", "vlan_outer", "vlan_inner", "l3_kind", F.col("ip.src").alias("src"), F.col("ip.dst").alias("dst"), "src_port", "dst_port", F.hex("payload").alias("payload"))


@query(f"SELECT l_orderkey, l_linenumber, {s(A)} AS mss, {s('l_linenumber')} AS window_scale, true AS sack_permitted, {s(Q)} AS sack_left, {k('CAFE')} AS payload FROM lineitem")
def tcp_options(spark, sf_dir):
    parts = ", ".join([n16(A), n16(B), n32(Q), n32(Q), raw("b0 10"), n16(A), raw("0000 0000 0204"), n16(A), raw("03 03"), n8(W), raw("04 02 01 05 0a"), n32(Q), n32(A), raw("00000000"), raw("cafe")])
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(f"unhex(concat({parts}))").alias("segment"))
    # the bytes are a column of their own: what is written into the parser is worked out for each byte it looks at
    rows = rows.select("l_orderkey", "l_linenumber", frames.parse_tcp(F.col("segment")).alias("t"))
    return rows.select("l_orderkey", "l_linenumber", F.col("t.mss").cast("string").alias("mss"), F.col("t.window_scale").cast("string").alias("window_scale"), "t.sack_permitted", F.get("t.sack_blocks", F.lit(0))["left"].cast("string").alias("sack_left"), F.hex("t.payload").alias("payload"))


def _only(*names: str) -> dict[str, bool]:
    """A protocol configuration that leaves the named dissectors on."""
    from flowloom.plans.registry import dissectors

    return {d.key: d.name in names for d in dissectors()}


_SUPPLIER_HOST = "'s' || s_suppkey || '.example.net'"


@query(f"SELECT s_suppkey, {_SUPPLIER_HOST} AS sni, 'QUIC' AS l7_protocol, 'high' AS l7_confidence, 'vpn_proxy' AS category, 'Tunnel' AS app_name FROM supplier")
def quic_names(spark, sf_dir):
    """Sealed QUIC packets, opened, and the server name looked up in the rules."""

    def sealed(batches):
        for b in batches:
            yield b.assign(payload=[quic_packet(h) for h in b["host"]])[["s_suppkey", "payload"]]

    hosts = _table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("s"), F.col("s_suppkey"), F.lit(".example.net")).alias("host"))
    rows = hosts.mapInPandas(sealed, "s_suppkey long, payload binary").select("s_suppkey", "payload", F.lit(443).alias("dst_port"), F.lit("UDP").alias("l4_proto"))
    return appid.classify_flows(rows, rules.dedupe_rules(_rules(spark)), _only("QUIC")).select("s_suppkey", "sni", "l7_protocol", "l7_confidence", "category", "app_name")


for _name in CASES:
    QUERIES[f"{_name}_roundtrip"] = roundtrip(_name)
    SQL[f"{_name}_roundtrip"] = roundtrip_sql(_name)
for _name in FRAMES:
    QUERIES[f"{_name}_frame"] = link_roundtrip(_name)
    SQL[f"{_name}_frame"] = link_sql(_name)
QUERIES["dot11_frame"], SQL["dot11_frame"] = dot11_roundtrip, DOT11_SQL
