"""Round-trip queries of link-layer frames: built from columns, sent through frame decoding, and dissected by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators.frames import decode_frames
from flowloom.operators.link import KINDS, dot11
from flowloom.plans.roundtrip import HOST, MAC, MAC_RAW, A, B, C, Q, W, hx, k, n8, n16, n24, n32, raw, s, sized, txt, x

_ETHER = "020000000001020000000002"

#: Name: (kind, bytes after the addresses, fields).
FRAMES: dict[str, tuple[str, list[str], dict[str, str]]] = {
    "stp": ("stp", [raw("0026 424203 0000 02 02 3c"), n16(A), *MAC_RAW, n32(Q), n16(B), *MAC_RAW, n16(A), n16(f"{C} * 256"), raw("1400 0200 0f00 00")], {"stp_version": k("2"), "stp_root_priority": s(A), "stp_root_mac": MAC, "stp_root_path_cost": s(Q), "stp_bridge_priority": s(B), "stp_port_id": x(A, 4), "stp_message_age_sec": f"printf('%.2f', {C}::DOUBLE)", "stp_max_age_sec": k("20.00")}),
    "appletalk": ("appletalk", [raw("0020 aaaa03 080007 809b"), n16(f"{W} * 1024 + 13"), n16(A), n16(B), n16(A), n8(C), n8(W), raw("01 02 01")], {"ddp_hop_count": s(W), "ddp_length": k("13"), "ddp_checksum": x(A, 4), "ddp_dst_network": s(B), "ddp_dst_node": s(C), "ddp_type": k("RTMP Response/Data")}),
    "cdp": ("cdp", [raw("0040 aaaa03 00000c 2000 02"), n8(C), n16(A), raw("0001"), n16(f"length({HOST}) + 4"), txt(HOST), raw("000a 0006"), n16(B), raw("000b 0005 01")], {"cdp_version": k("2"), "cdp_ttl_sec": s(C), "cdp_checksum": x(A, 4), "cdp_device_id": HOST, "cdp_native_vlan": s(B), "cdp_duplex": k("full")}),
    "eapol": ("eapol", [raw("888e 01 00 0005 02"), n8(C), n16(A), raw("01")], {"eapol_type": k("EAP-Packet"), "eap_code": k("Response"), "eap_identifier": s(C), "eap_length": s(A), "eap_type": k("Identity")}),
    "lacp": ("lacp", [raw("8809 0101 0114"), n16(A), *MAC_RAW, n16(B), n16(C), n16(W), raw("3d 000000"), raw("0214"), n16(B), *MAC_RAW, n16(A), n16(W), n16(C), raw("01 000000"), raw("0000")], {"lacp_actor_system_priority": s(A), "lacp_actor_system_mac": MAC, "lacp_actor_key": s(B), "lacp_actor_port": s(W), "lacp_actor_state_distributing": k("true"), "lacp_actor_state_timeout": k("false"), "lacp_partner_key": s(A)}),
    "pppoe_discovery": ("pppoe_discovery", [raw("8863 11 09 0000"), n16("length(concat('s', l_orderkey)) + 12"), raw("0101"), sized("concat('s', l_orderkey)", 2), raw("0103 0004"), n32(Q)], {"pppoe_stage": k("Discovery"), "pppoe_code": k("PADI"), "pppoe_service_name": "concat('s', l_orderkey)", "pppoe_host_uniq_hex": hx(Q, 8)}),
    "pppoe_session": ("pppoe_session", [raw("8864 11 00"), n16(A), raw("0006 c021 01"), n8(C), n16(B)], {"pppoe_session_id": x(A, 4), "pppoe_ppp_protocol": k("LCP"), "pppoe_ppp_code": k("Configure-Request"), "pppoe_ppp_identifier": s(C), "pppoe_ppp_length": s(B)}),
    "macsec": ("macsec", [raw("88e5 2e"), n8(f"{C} % 64"), n32(Q), *MAC_RAW, n16(A)], {"macsec_sci_present": k("true"), "macsec_encrypted": k("true"), "macsec_association_number": k("2"), "macsec_short_length": s(f"{C} % 64"), "macsec_packet_number": s(Q), "macsec_sci": f"concat({MAC}, '/', {A})"}),
    "homeplugav": ("homeplugav", [raw("88e1 01"), n16(A), raw("00b052")], {"homeplugav_mm_version": k("1"), "homeplugav_mm_type": x(A, 4), "homeplugav_oui": k("00:b0:52")}),
    "nsh": ("nsh", [raw("894f 0f c6 01 03"), n24(f"{Q} % 16777216"), n8(C)], {"nsh_ttl": k("63"), "nsh_length_bytes": k("24"), "nsh_next_protocol": k("Ethernet"), "nsh_service_path_id": s(f"{Q} % 16777216"), "nsh_service_index": s(C)}),
    "decnet": ("decnet", [raw("6003"), f"repeat('00', cast({W} as int))"], {"decnet_phase": k("IV"), "decnet_length": s(W)}),
    "vines": ("vines", [raw("0bae"), f"repeat('00', cast({W} as int))"], {"vines_subtype": k("Loopback"), "vines_length": s(W)}),
    "ethloopback": ("ethloopback", [raw("9000"), f"repeat('00', cast({W} as int))"], {"loopback_length": s(W)}),
}
#: An 802.11 beacon with a network's name.
BEACON = [raw("8000 0000 ffffffffffff"), *MAC_RAW, *MAC_RAW, n8(f"({A} % 16) * 16"), n8(C), raw("00" * 12), raw("00"), sized("concat('net', l_suppkey)")]
BEACON_FIELDS = {"dot11_type": k("Management"), "dot11_subtype": k("Beacon"), "dot11_addr2": MAC, "dot11_seq_num": s(f"{C} * 16 + {A} % 16"), "dot11_beacon_ssid": "concat('net', l_suppkey)"}


def link_roundtrip(name: str):
    kind, parts, fields = FRAMES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.lit(1).alias("link_type"), F.expr(f"unhex(concat('{_ETHER}', {', '.join(parts)}))").alias("data"))
        got = decode_frames(rows)
        found = got.select("l_orderkey", "l_linenumber", (F.col("l3_kind") == kind).alias("known"), KINDS[kind][1](F.col("payload"), F.col("ethertype")).alias("d"))
        return found.select("l_orderkey", "l_linenumber", "known", F.lit(KINDS[kind][0]).alias("protocol"), *(F.col("d")[f].alias(f) for f in fields))

    return run


def link_sql(name: str) -> str:
    kind, _, fields = FRAMES[name]
    return f"SELECT l_orderkey, l_linenumber, true AS known, '{KINDS[kind][0]}' AS protocol, " + ", ".join(f"{v} AS {f}" for f, v in fields.items()) + " FROM lineitem"


def dot11_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.expr(f"unhex(concat({', '.join(BEACON)}))").alias("frame"))
    # the bytes are a column of their own: what is written into the dissector is worked out for each field
    rows = rows.select("l_orderkey", "l_linenumber", dot11(F.col("frame")).alias("f"))
    return rows.select("l_orderkey", "l_linenumber", *(F.col("f")[f].alias(f) for f in BEACON_FIELDS))


DOT11_SQL = "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{v} AS {f}" for f, v in BEACON_FIELDS.items()) + " FROM lineitem"
