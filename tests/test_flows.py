import itertools
import struct

import pytest
from pyspark.sql import functions as F

from flowloom.operators import flows, reassembly, rules, scores
from flowloom.sources.captures import read_captures, register

KEY = "ip_version int, src_ip string, dst_ip string, src_port int, dst_port int, seq long, payload binary, pkt_no long"


def segments(spark, rows):
    return spark.createDataFrame([(4, "a", "b", 1, 2, seq, data, no) for no, (seq, data) in enumerate(rows)], KEY)


@pytest.mark.parametrize(
    ("rows", "policy", "data", "ooo", "again", "overlap"),
    [
        ([(100, b"AAAA"), (104, b"BBBB")], "first", b"AAAABBBB", 0, 0, 0),
        ([(100, b"AAAA"), (108, b"CCCC"), (104, b"BBBB")], "first", b"AAAABBBBCCCC", 1, 0, 0),
        ([(100, b"AAAA"), (100, b"AAAA")], "first", b"AAAA", 1, 4, 0),
        ([(100, b"AAAA"), (102, b"XXBB")], "first", b"AAAABB", 1, 0, 2),
        ([(100, b"AAAA"), (102, b"XXBB")], "last", b"AAXXBB", 1, 0, 2),
        ([(0xFFFFFFFE, b"AAAA"), (2, b"BBBB")], "first", b"AAAABBBB", 0, 0, 0),
        ([(100, b"AAAA"), (96, b"ZZZZ")], "first", b"AAAA", 0, 0, 0),
        ([(0, b"A"), (2, b"CC"), (6, b"GG"), (1, b"B"), (4, b"EE")], "first", b"ABCCEEGG", 2, 0, 0),
    ],
)
def test_reassembly_vectors(spark, rows, policy, data, ooo, again, overlap):
    r = reassembly.reassemble(segments(spark, rows), policy=policy).first()
    assert (bytes(r["data"]), r["out_of_order"], r["retransmit_bytes"], r["overlap_bytes"], r["evasion"]) == (data, ooo, again, overlap, overlap > 0)


def test_any_order_gives_the_same_bytes():
    parts = [(0, b"ab"), (2, b"c"), (3, b"defg"), (7, b"h")]
    for order in itertools.permutations(parts):
        s = reassembly.Stream()
        s.base = 0
        assert b"".join(s.insert(*p) for p in order) == b"abcdefgh"


def test_deliveries_tell_the_first(spark):
    got = reassembly.deliveries(segments(spark, [(100, b"AAAA"), (108, b"CCCC"), (104, b"BBBB")])).orderBy("pkt_no").collect()
    assert [(r["pkt_no"], bytes(r["data"]), r["is_first_delivery"]) for r in got] == [(0, b"AAAA", True), (2, b"BBBBCCCC", False)]


def test_defragment_in_any_order(spark):
    rows = [(1, 8, b"cd", False, 0), (1, 0, b"abababab", True, 1), (2, 0, b"x", True, 2)]
    df = spark.createDataFrame(rows, "k int, offset int, payload binary, more_fragments boolean, pkt_no long")
    assert [(r["k"], bytes(r["payload"])) for r in reassembly.defragment(df, ["k"]).collect()] == [(1, b"ababababcd")]


@pytest.mark.parametrize(
    ("host", "score", "verdict"),
    [("instagram.com", 0.493304, "medium"), ("www.google.com", 0.0, "low"), ("example.com", 0.537377, "medium"), ("a1b2c3d4e5f6.info", 0.555196, "medium"), ("xj3k9qz7vw2p.net", 0.722696, "high"), ("qzxkvbwtrplm.biz", 0.742696, "high")],
)
def test_dga_vectors(spark, host, score, verdict):
    r = spark.createDataFrame([(host,)], "h string").select(scores.dga(F.col("h")).alias("d")).first()["d"]
    assert r["score"] == pytest.approx(score, abs=1e-6)
    assert r["verdict"] == verdict


@pytest.mark.parametrize(
    ("data", "port", "l4", "category", "score", "protocol"),
    [
        (b"\1\0\0\0" + b"w" * 144, 51820, "UDP", None, 1.0, "wireguard"),
        (bytes.fromhex("1603010010") + bytes(16), 443, "TCP", None, 0.3, "openvpn"),
        (bytes.fromhex("1603010010") + bytes(16), 443, "TCP", "vpn_proxy", 0.9, "openvpn"),
        (b"\xff" * 10, 1723, "TCP", None, 0.15, "none"),
        (bytes(17) + b"\x20" + bytes(10), 500, "UDP", None, 0.79, "ike"),
    ],
)
def test_vpn_vectors(spark, data, port, l4, category, score, protocol):
    df = spark.createDataFrame([(data, port, l4, category)], "p binary, d int, t string, c string")
    r = df.select(scores.vpn(F.col("p"), F.col("d"), F.col("t"), F.col("c")).alias("v")).first()["v"]
    assert float(r["score"]) == pytest.approx(score)
    assert r["protocol"] == protocol


def test_longest_suffix_on_a_label_boundary(spark):
    known = spark.createDataFrame([(1, "example.com", "web", "A"), (2, "m.example.com", "mobile", "B")], "line_no int, suffix string, category string, app_name string")
    hosts = spark.createDataFrame([("x.m.EXAMPLE.com",), ("notexample.com",), (None,)], "host string")
    got = {r["host"]: (r["category"], r["match_confidence"]) for r in rules.classify_hosts(hosts, known).collect()}
    assert got == {"x.m.EXAMPLE.com": ("mobile", "high"), "notexample.com": ("unclassified", "low"), None: ("unknown", "none")}


def test_rule_and_switch_files(spark, tmp_path):
    (tmp_path / "r.ini").write_text("# c\n[web]\nexample.com = Example\nEXAMPLE.com=Again\nbad\n[vpn_proxy]\nv.example.net = Tunnel\n")
    got = rules.read_domain_rules(spark, str(tmp_path / "r.ini")).orderBy("line_no").collect()
    assert [(r["suffix"], r["category"], r["app_name"]) for r in got] == [("example.com", "web", "Example"), ("v.example.net", "vpn_proxy", "Tunnel")]
    (tmp_path / "p.ini").write_text("dns = FALSE\nftp=1\nssh=maybe\n")
    assert rules.read_protocol_config(spark, str(tmp_path / "p.ini")) == {"dns": False, "ftp": True}


def capture(order="<", nano=False):
    magic = {("<", False): b"\xd4\xc3\xb2\xa1", (">", False): b"\xa1\xb2\xc3\xd4", ("<", True): b"\x4d\x3c\xb2\xa1"}[order, nano]
    out = magic + struct.pack(f"{order}HHIIII", 2, 4, 0, 0, 65535, 1)
    for i in range(3):
        out += struct.pack(f"{order}4I", 10 + i, 5000 if nano else 5, 20, 20) + bytes([i] * 20)
    return out + struct.pack(f"{order}4I", 1, 1, 99, 99) + b"cut"


@pytest.mark.parametrize(("order", "nano"), [("<", False), (">", False), ("<", True)])
def test_classic_captures(spark, tmp_path, order, nano):
    (tmp_path / "a.pcap").write_bytes(capture(order, nano))
    register(spark)
    for df in (read_captures(spark, str(tmp_path)), spark.read.format("capture").load(str(tmp_path))):
        got = df.orderBy("pkt_no").select("pkt_no", F.unix_micros("ts").alias("t"), "link_type", "captured_len").collect()
        assert [tuple(r) for r in got] == [(i, (10 + i) * 1_000_000 + 5, 1, 20) for i in range(3)]


def test_block_captures_honour_resolution(spark, tmp_path):
    def block(kind, body):
        body += bytes(-len(body) % 4)
        return struct.pack("<2I", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    section = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    iface = block(1, struct.pack("<HHI", 101, 0, 0) + struct.pack("<HHB3x", 9, 1, 9) + struct.pack("<HH", 0, 0))
    packet = block(6, struct.pack("<5I", 0, 0, 3_000_000_000, 4, 4) + b"abcd")
    (tmp_path / "a.pcapng").write_bytes(section + iface + packet + section + iface + packet)
    got = read_captures(spark, str(tmp_path)).select(F.unix_micros("ts").alias("t"), "link_type", "data").collect()
    assert [(r["t"], r["link_type"], bytes(r["data"])) for r in got] == [(3_000_000, 101, b"abcd")] * 2


def test_flow_json(spark):
    df = spark.sql("SELECT timestamp'2024-01-01' AS ts_start, timestamp'2024-01-01 00:00:01.5' AS ts_last, 'DNS' AS l7_protocol, map('dns_qname', 'a\"b') AS l7, 7L AS bytes_total")
    assert flows.flow_json(df).first()["json"] == '{"ts_start":"2024-01-01T00:00:00.000000Z","ts_last":"2024-01-01T00:00:01.500000Z","l7_protocol":"DNS","bytes_total":7,"dns":{"qname":"a\\"b"}}'
