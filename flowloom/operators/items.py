"""Dissectors of type-length-value formats and of packets inside packets, in Column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.functions.bytes import as_hex, be, bind, bits, cut, flag, from_item, hexed, ipv4, ipv4_number, length, mac, name_of, number, text, tlvs
from flowloom.operators.frames import inner_map, parse_ip, parse_ipv6
from flowloom.plans.registry import dissector, field_map

# Names of codes, from the protocols' specifications.
RADIUS_CODES = {1: "Access-Request", 2: "Access-Accept", 3: "Access-Reject", 4: "Accounting-Request", 5: "Accounting-Response", 11: "Access-Challenge"}
DHCP_TYPES = {1: "DHCPDISCOVER", 2: "DHCPOFFER", 3: "DHCPREQUEST", 4: "DHCPDECLINE", 5: "DHCPACK", 6: "DHCPNAK", 7: "DHCPRELEASE", 8: "DHCPINFORM"}
DHCP6_TYPES = {1: "SOLICIT", 2: "ADVERTISE", 3: "REQUEST", 4: "CONFIRM", 5: "RENEW", 6: "REBIND", 7: "REPLY", 8: "RELEASE", 9: "DECLINE", 10: "RECONFIGURE", 11: "INFORMATION-REQUEST", 12: "RELAY-FORW", 13: "RELAY-REPL"}
STUN_TYPES = {
    0x0001: "Binding Request", 0x0101: "Binding Success Response", 0x0111: "Binding Error Response", 0x0011: "Binding Indication", 0x0003: "Allocate Request", 0x0103: "Allocate Success Response", 0x0113: "Allocate Error Response",
    0x0004: "Refresh Request", 0x0104: "Refresh Success Response", 0x0006: "Send Indication", 0x0007: "Data Indication", 0x0008: "CreatePermission Request", 0x0108: "CreatePermission Success Response", 0x0009: "ChannelBind Request",
    0x0109: "ChannelBind Success Response",
}
EIGRP_OPCODES = {1: "Update", 2: "Request", 3: "Query", 4: "Reply", 5: "Hello", 6: "IPX SAP", 7: "Probe", 10: "SIA-Query", 11: "SIA-Reply"}
PIM_TYPES = {0: "Hello", 1: "Register", 2: "Register Stop", 3: "Join/Prune", 4: "Bootstrap", 5: "Assert", 6: "Graft", 7: "Graft-Ack", 8: "Candidate RP Advertisement", 9: "State Refresh", 10: "DF Election"}
SCTP_CHUNKS = {0: "DATA", 1: "INIT", 2: "INIT_ACK", 3: "SACK", 4: "HEARTBEAT", 5: "HEARTBEAT_ACK", 6: "ABORT", 7: "SHUTDOWN", 8: "SHUTDOWN_ACK", 9: "ERROR", 10: "COOKIE_ECHO", 11: "COOKIE_ACK", 14: "SHUTDOWN_COMPLETE"}
SCTP_PPIDS = {1: "IUA", 2: "M2UA", 3: "M3UA", 4: "SUA", 5: "M2PA"}
LDP_TYPES = {
    0x0001: "Notification", 0x0100: "Hello", 0x0200: "Initialization", 0x0201: "KeepAlive", 0x0300: "Address", 0x0301: "Address Withdraw", 0x0400: "Label Mapping", 0x0401: "Label Request", 0x0402: "Label Withdraw", 0x0403: "Label Release",
    0x0404: "Label Abort Request",
}
BGP_TYPES = {1: "OPEN", 2: "UPDATE", 3: "NOTIFICATION", 4: "KEEPALIVE", 5: "ROUTE-REFRESH"}
AH_INNER = {89: "OSPF", 47: "GRE", 2: "IGMP", 88: "EIGRP", 50: "ESP"}
_ASP = {1: "ASPUP", 2: "ASPDN", 3: "BEAT", 4: "ASPUP_ACK", 5: "ASPDN_ACK", 6: "BEAT_ACK"}
M3UA_MESSAGES = {
    0: ("MGMT", {0: "ERR", 1: "NTFY"}),
    1: ("Transfer", {1: "DATA"}),
    2: ("SSNM", {1: "DUNA", 2: "DAVA", 3: "DAUD", 4: "SCON", 5: "DUPU", 6: "DRST"}),
    3: ("ASPSM", _ASP),
    4: ("ASPTM", {1: "ASPAC", 2: "ASPIA", 3: "ASPAC_ACK", 4: "ASPIA_ACK"}),
    9: ("RKM", {1: "REG_REQ", 2: "REG_RSP", 3: "DEREG_REQ", 4: "DEREG_RSP"}),
}
M2UA_MESSAGES = {
    0: ("MGMT", {0: "Error", 1: "Notify"}),
    3: ("ASPSM", {1: "ASP_Up", 2: "ASP_Down", 3: "Heartbeat", 4: "ASP_Up_Ack", 5: "ASP_Down_Ack", 6: "Heartbeat_Ack"}),
    4: ("ASPTM", {1: "ASP_Active", 2: "ASP_Inactive", 3: "ASP_Active_Ack", 4: "ASP_Inactive_Ack"}),
    6: ("MAUP", {
        1: "Data", 2: "Establish_Request", 3: "Establish_Confirm", 4: "Release_Request", 5: "Release_Confirm", 6: "Release_Indication", 7: "State_Request", 8: "State_Confirm", 9: "State_Indication", 10: "Data_Retrieval_Request",
        11: "Data_Retrieval_Confirm", 12: "Data_Retrieval_Indication", 13: "Data_Retrieval_Complete_Indication", 14: "Congestion_Indication", 15: "Data_Acknowledge",
    }),
    10: ("IIM", {1: "Register_Request", 2: "Register_Response", 3: "Deregister_Request", 4: "Deregister_Response"}),
}


def _messages(table: dict) -> dict:
    return {c << 8 | t: f"{name}/{x}" for c, (name, types) in table.items() for t, x in types.items()}


def when(test, value):
    return F.when(test, value)


def last(items, kind: int, test=None):
    own = F.filter(items, lambda x: (x["t"] == kind) & (test(x) if test else F.lit(True)))
    return F.element_at(F.when(F.size(own) > 0, own), -1)


def stopped(items, start, end, whole_at: int = 0):
    """Whether a walk ended before ``end`` (None: nothing of it was walked)."""
    x = F.element_at(F.when(F.size(items) > 0, items), -1)
    return F.coalesce(x["at"] + x["n"], F.lit(start) if isinstance(start, int) else start) < end


@dissector("RADIUS", "radius", 1, "UDP", (1812, 1645, 1813, 1646), (0.6, 0.9))
class Radius:
    def detect(p, port, l4):
        size = be(p, 2, 2)
        return (length(p) >= 20) & (be(p, 0, 1).between(1, 5) | be(p, 0, 1).isin(11, 40, 41, 42, 43)) & size.between(20, 4096) & (size <= length(p))

    def fields(p, port, l4):
        end = F.least(be(p, 2, 2), length(p)).cast("int")
        return {"*": bind(tlvs(p, 20, end, kind=1, size=1, whole=True), lambda a: field_map(Radius._of(p, a, end)))}

    def _of(p, a, end):
        whole = lambda d, at, n: text(d, at, n)
        four = lambda x: x["n"] == 4
        left = end - F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1)["at"] + F.element_at(F.when(F.size(a) > 0, a), -1)["n"], F.lit(20))
        return {
            "radius_code": name_of(be(p, 0, 1), RADIUS_CODES),
            "radius_identifier": number(be(p, 1, 1)),
            "parse_warning": when((left >= 2) & (F.size(a) < 128), F.lit("malformed_attribute_truncated")),
            "user_name": from_item(p, last(a, 1), whole),
            "user_password_present": when(last(a, 2).isNotNull(), F.lit("true")),
            "nas_ip_address": from_item(p, last(a, 4, four), lambda d, at, n: ipv4(d, at)),
            "calling_station_id": from_item(p, last(a, 31), whole),
            "acct_status_type": from_item(p, last(a, 40, four), lambda d, at, n: number(be(d, at, 4))),
        }


@dissector("DHCP", "dhcp", 9, "UDP", (67, 68), (0.7, 0.9))
class Dhcp:
    def detect(p, port, l4):
        return (length(p) >= 240) & be(p, 0, 1).isin(1, 2) & (be(p, 236, 4) == 0x63825363)

    def fields(p, port, l4):
        return {"*": bind(tlvs(p, 240, length(p), kind=1, size=1, skip=0, stop=255), lambda o: field_map(Dhcp._of(p, o)))}

    def _of(p, o):
        sized = lambda n: lambda x: x["n"] == n
        whole = lambda d, at, n: text(d, at, n)
        auth = last(o, 90, lambda x: x["n"] >= 11)
        relay = bind(last(o, 82), lambda x: F.when(x.isNotNull(), tlvs(p, x["at"], x["at"] + x["n"], kind=1, size=1)))
        shown = lambda d, at, n: F.when(text(d, at, n).rlike(r"^[\x20-\x7e]+$"), text(d, at, n)).otherwise(hexed(d, at, n))
        return {
            "dhcp_op": F.when(be(p, 0, 1) == 1, "BOOTREQUEST").otherwise("BOOTREPLY"),
            "dhcp_message_type": from_item(p, last(o, 53, sized(1)), lambda d, at, n: name_of(be(d, at, 1), DHCP_TYPES)),
            "dhcp_requested_ip": from_item(p, last(o, 50, sized(4)), lambda d, at, n: ipv4(d, at)),
            "dhcp_hostname": from_item(p, last(o, 12), whole),
            "dhcp_vendor_class": from_item(p, last(o, 60), whole),
            "dhcp_auth_protocol": from_item(p, auth, lambda d, at, n: number(be(d, at, 1))),
            "dhcp_auth_algorithm": from_item(p, auth, lambda d, at, n: F.when(be(d, at + 1, 1) == 1, "HMAC-MD5").otherwise("Unknown")),
            "dhcp_auth_rdm": from_item(p, auth, lambda d, at, n: F.when(be(d, at + 2, 1) == 0, "Monotonically Increasing Counter").otherwise("Unknown")),
            "dhcp_auth_replay_detection_hex": from_item(p, auth, lambda d, at, n: hexed(d, at + 3, 8)),
            "dhcp_auth_info_hex": from_item(p, auth, lambda d, at, n: F.when(n > 11, hexed(d, at + 11, n - 11))),
            "*": bind(relay, lambda subs: field_map({"dhcp_relay_agent_circuit_id": from_item(p, last(subs, 1), shown), "dhcp_relay_agent_remote_id": from_item(p, last(subs, 2), shown)})),
        }


@dissector("DHCPv6", "dhcpv6", 69, "UDP", (546, 547), (0.5, 0.85))
class Dhcp6:
    def detect(p, port, l4):
        return (length(p) >= 4) & be(p, 0, 1).between(1, 11)

    def fields(p, port, l4):
        o = tlvs(p, 4, length(p), kind=2, size=2)
        direct = ~be(p, 0, 1).isin(12, 13)
        some = direct & (F.size(o) > 0)
        return {
            "dhcp6_message_type": name_of(be(p, 0, 1), DHCP6_TYPES),
            "dhcp6_transaction_id": when(direct, as_hex(be(p, 1, 3), 6)),
            "dhcp6_options_count": when(some, number(F.size(o))),
            "dhcp6_first_option_code": when(some, number(F.get(o, F.lit(0))["t"])),
        }


@dissector("STUN", "stun", 19, "UDP TCP", (3478,), (0.85, 0.95))
class Stun:
    def detect(p, port, l4):
        size = be(p, 2, 2)
        return (length(p) >= 20) & (be(p, 0, 1) < 64) & (be(p, 4, 4) == 0x2112A442) & (size % 4 == 0) & (size + 20 <= length(p))

    def fields(p, port, l4):
        end = be(p, 2, 2) + 20
        return {"*": bind(tlvs(p, 20, F.least(end, length(p)), kind=2, size=2, pad=4), lambda a: field_map(Stun._of(p, a, end)))}

    def _of(p, a, end):
        v4 = lambda x: (x["n"] >= 8) & (be(p, x["at"] + 1, 1) == 1)
        mapped = last(a, 0x20, v4)
        x = F.element_at(F.when(F.size(a) > 0, a), -1)
        left = end - F.coalesce(x["at"] + F.ceil(x["n"] / 4) * 4, F.lit(20))
        return {
            "stun_message_type": name_of(be(p, 0, 2), STUN_TYPES),
            "stun_transaction_id": hexed(p, 8, 12),
            "parse_warning": when((left >= 4) & (F.size(a) < 32), F.lit("stun_attribute_exceeds_message")),
            "stun_username": from_item(p, last(a, 6), lambda d, at, n: text(d, at, n)),
            "stun_xor_mapped_address": from_item(p, mapped, lambda d, at, n: ipv4_number(be(d, at + 4, 4).bitwiseXOR(F.lit(0x2112A442)))),
            "stun_xor_mapped_port": from_item(p, mapped, lambda d, at, n: number(be(d, at + 2, 2).bitwiseXOR(F.lit(0x2112)))),
        }


@dissector("LLDP", "lldp", 46, "LLDP")
class Lldp:
    def detect(p, port, l4):
        return when((length(p) >= 2) & (bits(be(p, 0, 2), 9, 127) == 1), F.lit(0.85)).otherwise(0.0)

    def _items(p):
        """Items with a type of 7 bits and a length of 9."""
        none = F.array().cast("array<struct<t:long,at:int,n:int>>")

        def step(s, _):
            head = be(p, s["pos"], 2)
            t, n = bits(head, 9, 127), bits(head, 0, 511).cast("int")
            fits = (s["pos"] + 2 <= length(p)) & (s["pos"] + 2 + n <= length(p))
            end = ~fits
            more = F.struct((s["pos"] + 2 + n).alias("pos"), (t == 0).alias("done"), (s["bad"] & F.lit(False)).alias("bad"), F.concat(s["out"], F.array(F.struct(t.alias("t"), (s["pos"] + 2).alias("at"), n.alias("n")))).alias("out"))
            over = F.struct(s["pos"].alias("pos"), F.lit(True).alias("done"), (s["pos"] + 2 <= length(p)).alias("bad"), s["out"].alias("out"))
            return F.when(s["done"], s).when(end, over).otherwise(more)

        first = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("done"), F.lit(False).alias("bad"), none.alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(32)), first, step)

    def fields(p, port, l4):
        return {"*": bind(Lldp._items(p), lambda walked: field_map(Lldp._of(p, walked)))}

    def _of(p, walked):
        a = walked["out"]
        chassis, portid = last(a, 1, lambda x: x["n"] >= 1), last(a, 2, lambda x: x["n"] >= 1)
        some = lambda x: x["n"] > 0
        shown = lambda d, at, n: F.when((n > 1) & text(d, at + 1, n - 1).rlike(r"^[\x20-\x7e]+$"), text(d, at + 1, n - 1))
        return {
            "parse_warning": when(walked["bad"], F.lit("lldp_tlv_len_exceeds_buffer")),
            "lldp_chassis_id_subtype": from_item(p, chassis, lambda d, at, n: number(be(d, at, 1))),
            "lldp_chassis_id_mac": from_item(p, chassis, lambda d, at, n: F.when((be(d, at, 1) == 4) & (n == 7), mac(d, at + 1))),
            "lldp_port_id_subtype": from_item(p, portid, lambda d, at, n: number(be(d, at, 1))),
            "lldp_port_id": from_item(p, portid, shown),
            "lldp_ttl": from_item(p, last(a, 3, lambda x: x["n"] >= 2), lambda d, at, n: number(be(d, at, 2))),
            "lldp_port_description": from_item(p, last(a, 4, some), lambda d, at, n: text(d, at, n)),
            "lldp_system_name": from_item(p, last(a, 5, some), lambda d, at, n: text(d, at, n)),
            "lldp_management_address": from_item(p, last(a, 8, lambda x: (x["n"] >= 6) & (be(p, x["at"] + 1, 1) == 1)), lambda d, at, n: ipv4(d, at + 2)),
        }


@dissector("EIGRP", "eigrp", 38, "EIGRP")
class Eigrp:
    def detect(p, port, l4):
        return when((length(p) >= 20) & (be(p, 0, 1) == 2) & be(p, 1, 1).isin(1, 2, 3, 4, 5, 6, 7, 10, 11), F.lit(0.9)).otherwise(0.0)

    def fields(p, port, l4):
        a = tlvs(p, 20, length(p), kind=2, size=2, whole=True)
        x = F.element_at(F.when(F.size(a) > 0, a), -1)
        left = length(p) - F.coalesce(x["at"] + x["n"], F.lit(20))
        return {
            "eigrp_version": number(be(p, 0, 1)),
            "eigrp_opcode": name_of(be(p, 1, 1), EIGRP_OPCODES),
            "eigrp_init_flag": flag(be(p, 4, 4), 1),
            "eigrp_sequence": number(be(p, 8, 4)),
            "eigrp_ack": number(be(p, 12, 4)),
            "eigrp_asn": number(be(p, 18, 2)),
            "parse_warning": when((left >= 4) & (F.size(a) < 32), F.lit("eigrp_tlv_len_inconsistent")),
            "eigrp_first_tlv_type": as_hex(F.get(a, F.lit(0))["t"], 4),
            "eigrp_tlv_count": number(F.size(a)),
        }


@dissector("PIM", "pim", 58, "PIM")
class Pim:
    def detect(p, port, l4):
        return when((length(p) >= 4) & (bits(be(p, 0, 1), 4, 15) == 2) & (bits(be(p, 0, 1), 0, 15) <= 10), F.lit(0.8)).otherwise(0.0)

    def fields(p, port, l4):
        t = bits(be(p, 0, 1), 0, 15)
        hello = t == 0
        a = tlvs(p, 4, length(p), kind=2, size=2)
        hold, delay = last(a, 1, lambda x: x["n"] == 2), last(a, 20, lambda x: x["n"] == 4)
        return {
            "pim_version": number(bits(be(p, 0, 1), 4, 15)),
            "pim_type": name_of(t, PIM_TYPES),
            "pim_hello_holdtime_sec": when(hello, from_item(p, hold, lambda d, at, n: number(be(d, at, 2)))),
            "pim_hello_lan_prune_delay_tbit": when(hello, from_item(p, delay, lambda d, at, n: flag(be(d, at, 1), 128))),
            "pim_hello_propagation_delay_ms": when(hello, from_item(p, delay, lambda d, at, n: number(bits(be(d, at, 2), 0, 0x7FFF)))),
            "pim_hello_override_interval_ms": when(hello, from_item(p, delay, lambda d, at, n: number(be(d, at + 2, 2)))),
        }


def _user_adaptation(name: str, table: dict, score: float):
    names = _messages(table)

    def detect(p, port, l4):
        return F.when((length(p) >= 8) & (be(p, 0, 1) == 1) & be(p, 2, 2).isin(*names) & (be(p, 4, 4) == length(p)), score).otherwise(0.0)

    def parts(p):
        return name_of(be(p, 2, 2), names), tlvs(p, 8, length(p), kind=2, size=2, whole=True, pad=4)

    return detect, parts


_M3UA_DETECT, _m3ua = _user_adaptation("M3UA", M3UA_MESSAGES, 0.9)
_M2UA_DETECT, _m2ua = _user_adaptation("M2UA", M2UA_MESSAGES, 0.85)


@dissector("M3UA", "m3ua", 55, "SCTP-DATA", (3,))
class M3ua:
    detect = _M3UA_DETECT

    def fields(p, port, l4):
        name, a = _m3ua(p)
        word = lambda d, at, n: as_hex(be(d, at, 4), 8)
        four = lambda x: x["n"] >= 4
        return {
            "m3ua_message": name,
            "m3ua_network_appearance": from_item(p, last(a, 0x0200, four), word),
            "m3ua_routing_context": from_item(p, last(a, 0x0006, four), word),
            "m3ua_protocol_data_hex": from_item(p, last(a, 0x0210), lambda d, at, n: hexed(d, at, n)),
        }


@dissector("M2UA", "m2ua", 57, "SCTP-DATA", (2,))
class M2ua:
    detect = _M2UA_DETECT

    def fields(p, port, l4):
        name, a = _m2ua(p)
        return {
            "m2ua_message": name,
            "m2ua_interface_id": from_item(p, last(a, 0x0001, lambda x: x["n"] >= 4), lambda d, at, n: number(be(d, at, 4))),
            "m2ua_mtp2_data_hex": from_item(p, last(a, 0x0300), lambda d, at, n: hexed(d, at, n)),
        }


@dissector("SCTP", "sctp", 54, "SCTP")
class Sctp:
    def detect(p, port, l4):
        size = be(p, 14, 2)
        return when((length(p) >= 16) & (size >= 4) & (size + 12 <= length(p)) & be(p, 12, 1).isin(*SCTP_CHUNKS), F.lit(0.85)).otherwise(0.0)

    def chunks(p):
        """Chunks as type (with flags, two bytes), offset of the value and its length."""
        return tlvs(p, 12, length(p), kind=2, size=2, whole=True, pad=4)

    def fields(p, port, l4):
        """Fields of every chunk; each chunk's are a map, and the maps are joined."""
        out = {"sctp_src_port": number(be(p, 0, 2)), "sctp_dst_port": number(be(p, 2, 2)), "sctp_verification_tag": as_hex(be(p, 4, 4), 8)}
        numbered = F.transform(Sctp.chunks(p), lambda x, i: F.transform(F.map_entries(field_map(Sctp.chunk(p, x, "#"))), lambda e: F.struct(F.replace(e["key"], F.lit("#"), i.cast("string")).alias("key"), e["value"].alias("value"))))
        return out | {"*": F.map_from_entries(F.flatten(numbered))}

    def chunk(p, x, i):
        t, at = bits(x["t"], 8, 255), x["at"]
        data, sack = (t == 0) & (x["n"] >= 12), (t == 3) & (x["n"] >= 12)
        inner = cut(p, at + 12, x["n"] - 12)
        found = F.when(_M3UA_DETECT(inner, None, None) > 0, "M3UA").when(_M2UA_DETECT(inner, None, None) > 0, "M2UA")
        k = f"sctp_chunk_{i}"
        return {
            f"{k}_type": name_of(t, SCTP_CHUNKS),
            f"{k}_tsn": when(data, number(be(p, at, 4))),
            f"{k}_stream_id": when(data, number(be(p, at + 4, 2))),
            f"{k}_stream_seq": when(data, number(be(p, at + 6, 2))),
            f"{k}_ppid": when(data, name_of(be(p, at + 8, 4), SCTP_PPIDS)),
            f"{k}_inner_protocol": when(data & (x["n"] > 12), found),
            f"{k}_cum_tsn_ack": when(sack, number(be(p, at, 4))),
            f"{k}_a_rwnd": when(sack, number(be(p, at + 4, 4))),
            f"{k}_gap_ack_blocks": when(sack, number(be(p, at + 8, 2))),
            f"{k}_dup_tsns": when(sack, number(be(p, at + 10, 2))),
        }


@dissector("LDP", "ldp", 37, "TCP UDP", (646,), (0.7, 0.9))
class Ldp:
    def detect(p, port, l4):
        return (length(p) >= 14) & (be(p, 0, 2) == 1) & (be(p, 2, 2) >= 6) & (be(p, 2, 2) + 4 <= length(p) + 8)

    def fields(p, port, l4):
        return {"ldp_router_id": ipv4(p, 4), "ldp_label_space": number(be(p, 8, 2)), "*": bind(tlvs(p, 10, length(p), kind=2, size=2), lambda x: Ldp._messages(p, x))}

    def _messages(p, every):
        """Fields of the messages, and of the first label mapping among them."""
        short = F.array_position(F.transform(every, lambda x: x["at"] + 4 > length(p)), True)
        whole = F.when(short > 0, F.slice(every, F.lit(1), (short - 1).cast("int"))).otherwise(every)
        kind = lambda x: bits(x["t"], 0, 0x7FFF)

        def named(m):
            end = F.element_at(F.when(F.size(m) > 0, m), -1)
            left = length(p) - F.coalesce(end["at"] + end["n"], F.lit(10))
            mapping = F.get(F.filter(m, lambda x: (kind(x) == 0x0400) & (x["n"] >= 4)), F.lit(0))
            return field_map(
                {
                    "parse_warning": when((left >= 8) & (F.size(m) < 16), F.lit("ldp_message_len_exceeds_buffer")),
                    "ldp_message_type": when(F.size(m) > 0, name_of(kind(F.get(m, F.lit(0))), LDP_TYPES)),
                    "ldp_message_count": number(F.size(m)),
                    "*": bind(mapping, lambda x: F.when(x.isNotNull(), bind(tlvs(p, x["at"] + 4, x["at"] + x["n"], kind=2, size=2), lambda a: Ldp._mapping(p, a)))),
                }
            )

        return bind(whole, named)

    def _mapping(p, a):
        v4 = lambda x: (x["n"] >= 4) & (be(p, x["at"], 1) == 2) & (be(p, x["at"] + 1, 2) == 1) & (F.ceil(be(p, x["at"] + 3, 1) / 8) + 4 <= x["n"])

        def prefix(d, at, n):
            size = F.ceil(be(d, at + 3, 1) / 8).cast("int")
            octet = lambda k: F.when(size > k, be(d, at + 4 + k, 1)).otherwise(0)
            return F.concat(F.concat_ws(".", *(octet(k) for k in range(4))), F.lit("/"), be(d, at + 3, 1))

        fec, label = last(a, 0x0100, v4), last(a, 0x0200, lambda x: x["n"] >= 4)
        return field_map({"ldp_label_mapping_fec": bind(fec, lambda x: from_item(p, x, prefix)), "ldp_label_mapping_label": bind(label, lambda x: from_item(p, x, lambda d, at, n: number(bits(be(d, at, 4), 0, 0xFFFFF))))})


@dissector("BGP", "bgp", 25, "TCP", (179,), (0.7, 0.95))
class Bgp:
    def detect(p, port, l4):
        return (length(p) >= 19) & (hexed(p, 0, 16) == "f" * 32) & (be(p, 16, 2) >= 19) & (be(p, 16, 2) <= length(p)) & be(p, 18, 1).between(1, 5)

    def messages(p):
        """struct(out, warning): (type, offset and length of the body) of up to 32 messages."""
        none = F.array().cast("array<struct<t:long,at:int,n:int>>")

        def step(s, _):
            at = s["pos"]
            size = be(p, at + 16, 2).cast("int")
            marker = hexed(p, at, 16) == "f" * 32
            end = (at + 19 > length(p)) | s["done"]
            bad = F.when(~marker, "bgp_marker_not_all_ones").when((size < 19) | (at + size > length(p)), "bgp_message_len_inconsistent")
            more = F.struct((at + size).alias("pos"), F.lit(False).alias("done"), F.lit(None).cast("string").alias("warning"), F.concat(s["out"], F.array(F.struct(be(p, at + 18, 1).alias("t"), (at + 19).alias("at"), (size - 19).alias("n")))).alias("out"))
            over = F.struct(at.alias("pos"), F.lit(True).alias("done"), F.coalesce(s["warning"], F.when(~s["done"] & (at + 19 <= length(p)), bad)).alias("warning"), s["out"].alias("out"))
            return F.when(end | bad.isNotNull(), over).otherwise(more)

        first = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("done"), F.lit(None).cast("string").alias("warning"), none.alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(32)), first, step)

    def fields(p, port, l4):
        return {"*": bind(Bgp.messages(p), lambda walked: field_map(Bgp._of(p, walked)))}

    def _of(p, walked):
        m = walked["out"]
        first = lambda t: F.get(F.filter(m, lambda x: x["t"] == t), F.lit(0))
        opened, update, notice = first(1), first(2), last(m, 3)
        o = opened["at"]
        has = opened["n"] >= 10
        return {
            "bgp_open_version": when(has, number(be(p, o, 1))),
            "bgp_open_my_as": when(has, number(be(p, o + 1, 2))),
            "bgp_open_hold_time": when(has, number(be(p, o + 3, 2))),
            "bgp_open_router_id": when(has, ipv4(p, o + 5)),
            "bgp_notification_error_code": when(notice["n"] >= 2, number(be(p, notice["at"], 1))),
            "bgp_notification_error_subcode": when(notice["n"] >= 2, number(be(p, notice["at"] + 1, 1))),
            "parse_warning": walked["warning"],
            "bgp_message_count": number(F.size(m)),
            "bgp_type": when(F.size(m) > 0, name_of(F.get(m, F.lit(0))["t"], BGP_TYPES)),
            "*": bind(update, lambda x: F.when(x["n"] >= 4, Bgp._update(p, x["at"], x["n"]))),
        }

    def _update(p, u, un):
        """Fields of an UPDATE of ``un`` bytes at ``u``."""
        gone = be(p, u, 2)
        ok = gone + 2 <= un
        attrs = u + gone + 4
        size = be(p, attrs - 2, 2)
        fits = ok & (gone + 4 <= un) & (gone + 4 + size <= un)
        warning = F.when(~ok, "bgp_update_withdrawn_len_exceeds_buffer").when((gone + 4 <= un) & ~fits, "bgp_update_path_attr_len_exceeds_buffer")
        head = field_map({"parse_warning": warning, "bgp_update_withdrawn_routes_len": when(ok, number(gone))})
        inside = bind(F.struct(attrs.cast("int").alias("at"), (attrs + size).cast("int").alias("end")), lambda x: Bgp._attributes(p, x["at"], x["end"], u + un))
        return F.map_concat(head, F.coalesce(F.when(fits, inside), F.create_map().cast("map<string,string>")))

    def _attributes(p, start, end, stop):
        none = F.array().cast("array<struct<t:long,at:int,n:int>>")

        def attribute(s, _):
            at = s["at"]
            wide = bits(be(p, at, 1), 4, 1) == 1
            n = F.when(wide, be(p, at + 2, 2)).otherwise(be(p, at + 2, 1)).cast("int")
            first = (at + F.when(wide, 4).otherwise(3)).cast("int")
            good = (first <= end) & (first + n <= end)
            return F.when(good & (at < end), F.struct((first + n).alias("at"), F.concat(s["out"], F.array(F.struct(be(p, at + 1, 1).alias("t"), first.alias("at"), n.alias("n")))).alias("out"))).otherwise(s)

        walked = F.aggregate(F.sequence(F.lit(1), F.lit(24)), F.struct(start.alias("at"), none.alias("out")), attribute, lambda s: s["out"])
        four = lambda x: x["n"] >= 4

        def prefix(s, _):
            at = s["at"]
            width = be(p, at, 1)
            k = F.ceil(width / 8).cast("int")
            octet = lambda i: F.when(k > i, be(p, at + 1 + i, 1)).otherwise(0)
            good = (at < stop) & (width <= 32) & (at + 1 + k <= stop)
            return F.when(good, F.struct((at + 1 + k).alias("at"), F.concat(s["out"], F.array(F.concat(F.concat_ws(".", *(octet(i) for i in range(4))), F.lit("/"), width))).alias("out"))).otherwise(s)

        def named(a):
            return field_map(
                {
                    "bgp_update_origin": from_item(p, last(a, 1, lambda x: x["n"] >= 1), lambda d, at, n: name_of(be(d, at, 1), {0: "IGP", 1: "EGP", 2: "INCOMPLETE"})),
                    "bgp_update_as_path_len": from_item(p, last(a, 2), lambda d, at, n: number(n)),
                    "bgp_update_next_hop": from_item(p, last(a, 3, four), lambda d, at, n: ipv4(d, at)),
                    "bgp_update_med": from_item(p, last(a, 4, four), lambda d, at, n: number(be(d, at, 4))),
                    "bgp_update_local_pref": from_item(p, last(a, 5, four), lambda d, at, n: number(be(d, at, 4))),
                }
            )

        nlri = F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.struct(end.alias("at"), F.array().cast("array<string>").alias("out")), prefix, lambda s: s["out"])
        routes = bind(nlri, lambda x: F.map_from_entries(F.transform(x, lambda v, i: F.struct(F.concat(F.lit("bgp_update_nlri_"), i).alias("key"), v.alias("value")))))
        return F.map_concat(bind(walked, named), routes)


@dissector("GRE", "gre", 22, "GRE")
class Gre:
    def detect(p, port, l4):
        v = be(p, 0, 2)
        return F.when(length(p) < 4, 0.0).when((bits(v, 3, 31) != 0) | (bits(v, 0, 7) != 0), 0.3).otherwise(0.9)

    def _head(p):
        v = be(p, 0, 2)
        check, key, seq = (v.bitwiseAND(F.lit(m)) != 0 for m in (0x8000, 0x2000, 0x1000))
        size = F.lit(4) + F.when(check, 4).otherwise(0) + F.when(key, 4).otherwise(0) + F.when(seq, 4).otherwise(0)
        return v, check, key, seq, size

    def fields(p, port, l4):
        v, check, key, seq, size = Gre._head(p)
        ok = (length(p) >= 4) & (size <= length(p))
        kind = be(p, 2, 2)
        at = F.when(check, 8).otherwise(4)
        inner = cut(p, size, length(p))
        into = ok & kind.isin(0x0800, 0x86DD) & (length(inner) >= 1)
        version = bits(be(inner, 0, 1), 4, 15)
        return {
            "parse_warning": when(~ok, F.lit("gre_header_truncated")),
            "gre_version": when(ok, F.when(bits(v, 0, 7) == 0, "0").otherwise("unknown_nonzero")),
            "gre_checksum_present": when(ok, F.when(check, "true").otherwise("false")),
            "gre_key_present": when(ok, F.when(key, "true").otherwise("false")),
            "gre_sequence_present": when(ok, F.when(seq, "true").otherwise("false")),
            "gre_key": when(ok & key, as_hex(be(p, at, 4), 8)),
            "gre_sequence": when(ok & seq, number(be(p, at + F.when(key, 4).otherwise(0), 4))),
            "gre_protocol_type": when(ok, as_hex(kind, 4)),
            "gre_erspan_detected": when(ok & (kind == 0x22EB), F.lit("true")),
            "gre_keepalive_likely": when(ok & (kind == 0) & (length(inner) == 0), F.lit("true")),
            "*": when(into, bind(inner, Gre._inside)),
        }

    def _inside(inner):
        """Fields of the packet inside; another tunnel in it is opened once more."""
        version = bits(be(inner, 0, 1), 4, 15)
        yes = F.lit("true")

        def opened(ip):
            nested = (version == 4) & (ip["proto"] == 47)
            deeper = bind(ip["payload"], lambda g: cut(g, Gre._head(g)[4], length(g)))
            own = F.when(nested, F.map_concat(F.create_map(F.lit("gre_nested_tunnel_detected"), yes), F.coalesce(bind(deeper, lambda d: F.when(bind(parse_ip(d), lambda x: x["proto"] == 47), F.create_map(F.lit("gre_nested_tunnel_depth_limit_reached"), yes)).otherwise(inner_map(d, "gre_inner"))), F.create_map().cast("map<string,string>")))).otherwise(inner_map(inner, "gre_inner"))
            failed = F.create_map(F.lit("gre_inner_packet_parse_failed"), yes)
            return F.when(ip.isNull(), failed).otherwise(own)

        unknown = F.create_map(F.lit("gre_inner_packet_unknown_ip_version"), yes)
        return F.when(~version.isin(4, 6), unknown).otherwise(bind(parse_ip(inner), opened))


@dissector("MPLS", "mpls", 23, "MPLS")
class Mpls:
    def detect(p, port, l4):
        return when(length(p) >= 4, F.lit(0.9)).otherwise(0.0)

    def fields(p, port, l4):
        depth = None
        for k in range(8):
            test = (length(p) >= 4 * k + 4) & (bits(be(p, 4 * k + 2, 1), 0, 1) == 1)
            depth = F.when(test, k + 1) if depth is None else depth.when(test, k + 1)
        ok = depth.isNotNull()
        inner = cut(p, depth * 4, length(p))
        version = bits(be(inner, 0, 1), 4, 15)
        some = ok & (length(inner) > 0)
        return {
            "parse_warning": when(~ok, F.lit("mpls_stack_truncated_or_too_deep")),
            "mpls_stack_depth": when(ok, number(depth)),
            "mpls_top_label": when(ok, number(bits(be(p, 0, 3), 4, 0xFFFFF))),
            "mpls_top_ttl": when(ok, number(be(p, 3, 1))),
            "mpls_bottom_label": when(ok & (depth > 1), number(bits(be(p, depth * 4 - 4, 3), 4, 0xFFFFF))),
            "mpls_inner_protocol": when(some, F.when(version == 4, "IPv4").when(version == 6, "IPv6").otherwise("unknown")),
            "*": when(some, inner_map(inner, "mpls_inner", ("src_ip", "dst_ip", "dst_port", "sni"))),
        }


@dissector("6in4", "sixin4", 35, "6in4")
class SixInFour:
    def detect(p, port, l4):
        return when((length(p) >= 40) & (bits(be(p, 0, 1), 4, 15) == 6) & (be(p, 4, 2) + 40 <= length(p)), F.lit(0.9)).otherwise(0.0)

    def fields(p, port, l4):
        bad = parse_ipv6(p).isNull()
        return {"parse_warning": when(bad, F.lit("sixin4_inner_ipv6_parse_failed")), "*": when(~bad, inner_map(p, "sixin4_inner"))}


@dissector("AH", "ah", 41, "AH")
class Ah:
    def detect(p, port, l4):
        size = (be(p, 1, 1) + 2) * 4
        return when((length(p) >= 12) & (size >= 12) & (size <= length(p)), F.lit(0.85)).otherwise(0.0)

    def fields(p, port, l4):
        size = (be(p, 1, 1) + 2) * 4
        ok = (size >= 12) & (size <= length(p))
        nxt, inner = be(p, 0, 1), cut(p, size, length(p))
        some = ok & (length(inner) > 0)
        from flowloom.plans.registry import REGISTRY

        fits = lambda k: REGISTRY[k].detect(inner, F.lit(0), F.lit(k)) > 0.3
        named = None
        for k, v in AH_INNER.items():
            test = (nxt == k) & fits(v)
            named = F.when(test, v) if named is None else named.when(test, v)
        named = named.when(nxt == 6, "TCP").when(nxt == 17, "UDP").when(~nxt.isin(*AH_INNER), "other")
        ospf = REGISTRY["OSPF"].fields(inner, F.lit(0), F.lit("OSPF"))["ospf_type"]
        return {
            "parse_warning": when(~ok, F.lit("ah_len_inconsistent")),
            "ah_spi": when(ok, as_hex(be(p, 4, 4), 8)),
            "ah_sequence": when(ok, number(be(p, 8, 4))),
            "ah_next_header": when(ok, number(nxt)),
            "ah_authenticated_not_encrypted": when(ok, F.lit("true")),
            "ah_inner_protocol": when(some, named),
            "ah_inner_summary": when(some & (nxt == 89) & fits("OSPF"), ospf),
        }


@dissector("L2TPv3", "l2tpv3", 48, "L2TPv3")
class L2tp:
    def detect(p, port, l4):
        return when((length(p) >= 18) & be(p, 16, 2).isin(0x0800, 0x86DD, 0x8847, 0x9000), F.lit(0.6)).otherwise(0.0)

    def fields(p, port, l4):
        ok, kind = length(p) >= 18, be(p, 16, 2)
        v4 = ok & (kind == 0x0800)
        return {
            "l2tpv3_session_id": when(ok, as_hex(be(p, 0, 4), 8)),
            "l2tpv3_inner_dst_mac": when(ok, mac(p, 4)),
            "l2tpv3_inner_src_mac": when(ok, mac(p, 10)),
            "l2tpv3_inner_protocol": when(ok, F.when(kind == 0x86DD, "IPv6").when(kind == 0x8847, "MPLS").when(kind == 0x9000, "Loopback/ECTP")),
            "*": when(v4, inner_map(cut(p, 18, length(p)), "l2tpv3_inner", ("src_ip", "dst_ip", "sni"))),
        }



