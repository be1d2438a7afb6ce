"""Dissectors of formats with fields at fixed offsets, all in Column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.functions.bytes import as_hex, be, between_zeros, bind, bits, checksum16, cut, flag, hexed, ipv4, ipv4_number, ipv6, le, length, mac, name_of, number, text
from flowloom.plans.registry import dissector, field_map

#: Dissectors that look at no transport of their own; they compete everywhere in compatibility mode.
UNGATED = {"DNS", "SIP", "STUN", "IGMP", "ESP", "6in4", "LDP", "EIGRP", "AH", "LLDP", "L2TPv3", "Syslog", "WoL"}

# Names of codes, from the protocols' specifications.
NTP_MODES = {1: "Symmetric Active", 2: "Symmetric Passive", 3: "Client", 4: "Server", 5: "Broadcast", 6: "NTP Control Message", 7: "Private"}
MODBUS_FUNCTIONS = {
    1: "Read Coils", 2: "Read Discrete Inputs", 3: "Read Holding Registers", 4: "Read Input Registers", 5: "Write Single Coil", 6: "Write Single Register", 7: "Read Exception Status", 8: "Diagnostics", 15: "Write Multiple Coils",
    16: "Write Multiple Registers", 17: "Report Server ID", 20: "Read File Record", 21: "Write File Record", 22: "Mask Write Register", 23: "Read/Write Multiple Registers", 24: "Read FIFO Queue", 43: "Encapsulated Interface Transport",
}
MODBUS_EXCEPTIONS = {1: "Illegal Function", 2: "Illegal Data Address", 3: "Illegal Data Value", 4: "Server Device Failure", 5: "Acknowledge", 6: "Server Device Busy", 8: "Memory Parity Error", 10: "Gateway Path Unavailable", 11: "Gateway Target Device Failed to Respond"}
DNP3_PRIMARY = {0: "RESET_LINK_STATES", 2: "TEST_LINK_STATES", 3: "CONFIRMED_USER_DATA", 4: "UNCONFIRMED_USER_DATA", 9: "REQUEST_LINK_STATUS"}
DNP3_SECONDARY = {0: "ACK", 1: "NACK", 11: "LINK_STATUS", 15: "NOT_SUPPORTED"}
DNP3_APPLICATION = {1: "READ", 2: "WRITE", 3: "SELECT", 4: "OPERATE", 5: "DIRECT_OPERATE", 6: "DIRECT_OPERATE_NO_ACK", 13: "COLD_RESTART", 14: "WARM_RESTART", 129: "RESPONSE", 130: "UNSOLICITED_RESPONSE"}
ICMP_TYPES = {
    0: "Echo Reply", 3: "Destination Unreachable", 4: "Source Quench", 5: "Redirect", 8: "Echo Request", 9: "Router Advertisement", 10: "Router Solicitation", 11: "Time Exceeded", 12: "Parameter Problem",
    13: "Timestamp Request", 14: "Timestamp Reply", 15: "Information Request", 16: "Information Reply", 17: "Address Mask Request", 18: "Address Mask Reply",
}
ICMP6_TYPES = {
    1: "Destination Unreachable", 2: "Packet Too Big", 3: "Time Exceeded", 4: "Parameter Problem", 128: "Echo Request", 129: "Echo Reply", 133: "Router Solicitation", 134: "Router Advertisement", 135: "Neighbor Solicitation",
    136: "Neighbor Advertisement", 137: "Redirect",
}
IGMP_TYPES = {0x11: "Membership Query", 0x12: "v1 Membership Report", 0x16: "v2 Membership Report", 0x17: "Leave Group", 0x22: "v3 Membership Report"}
IGMP_RECORDS = {1: "MODE_IS_INCLUDE", 2: "MODE_IS_EXCLUDE", 3: "CHANGE_TO_INCLUDE_MODE", 4: "CHANGE_TO_EXCLUDE_MODE", 5: "ALLOW_NEW_SOURCES", 6: "BLOCK_OLD_SOURCES"}
OSPF_TYPES = {1: "Hello", 2: "Database Description", 3: "Link State Request", 4: "Link State Update", 5: "Link State Acknowledgment"}
RIP_COMMANDS = {1: "Request", 2: "Response", 3: "Traceon (obsolete)", 4: "Traceoff (obsolete)", 5: "Sun poll (obsolete)"}
HSRP_OPCODES = {0: "Hello", 1: "Coup", 2: "Resign"}
HSRP_STATES = {0: "Initial", 1: "Learn", 2: "Listen", 4: "Speak", 8: "Standby", 16: "Active"}
IKE_EXCHANGES = {
    0: "None", 1: "Base", 2: "Identity Protection (Main Mode)", 3: "Authentication Only", 4: "Aggressive", 5: "Informational", 32: "Quick Mode", 33: "New Group Mode", 34: "IKE_SA_INIT / New Group Mode", 35: "IKE_AUTH",
    36: "CREATE_CHILD_SA", 37: "INFORMATIONAL (IKEv2)",
}
S7_ROSCTR = {1: "Job Request", 2: "Ack", 3: "Ack-Data", 7: "Userdata"}
S7_FUNCTIONS = {4: "Read Var", 5: "Write Var", 0xF0: "Setup Communication", 0x1A: "Request Download", 0x1B: "Download Block", 0x1C: "Download Ended", 0x1D: "Start Upload", 0x1E: "Upload", 0x1F: "End Upload", 0x28: "PLC Control (e.g. Start/Stop)", 0x29: "PLC Stop"}
TFTP_OPCODES = {1: "RRQ", 2: "WRQ", 3: "DATA", 4: "ACK", 5: "ERROR", 6: "OACK"}
OPENVPN_OPCODES = {
    1: "P_CONTROL_HARD_RESET_CLIENT_V1", 2: "P_CONTROL_HARD_RESET_SERVER_V1", 3: "P_CONTROL_SOFT_RESET_V1", 4: "P_CONTROL_V1", 5: "P_ACK_V1", 6: "P_DATA_V1", 7: "P_CONTROL_HARD_RESET_CLIENT_V2", 8: "P_CONTROL_HARD_RESET_SERVER_V2",
    9: "P_DATA_V2",
}
SOCKS4_COMMANDS = {1: "CONNECT", 2: "BIND"}
SOCKS4_REPLIES = {90: "request granted", 91: "request rejected or failed", 92: "rejected: no identd response", 93: "rejected: userid mismatch"}
SOCKS5_METHODS = {0: "No Authentication Required", 1: "GSSAPI", 2: "Username/Password", 255: "No Acceptable Methods"}
SOCKS5_COMMANDS = {1: "CONNECT", 2: "BIND", 3: "UDP_ASSOCIATE"}
SOCKS5_REPLIES = {0: "succeeded", 1: "general SOCKS server failure", 2: "connection not allowed by ruleset", 3: "network unreachable", 4: "host unreachable", 5: "connection refused", 6: "TTL expired", 7: "command not supported", 8: "address type not supported"}
SMB1_COMMANDS = {
    0x00: "Create Directory", 0x01: "Delete Directory", 0x04: "Close", 0x06: "Delete", 0x08: "Get Disk Attributes", 0x24: "Locking AndX", 0x25: "Transaction", 0x2B: "Echo", 0x2D: "Open AndX", 0x2E: "Read AndX", 0x2F: "Write AndX",
    0x32: "Transaction2", 0x71: "Tree Disconnect", 0x72: "Negotiate Protocol", 0x73: "Session Setup AndX", 0x74: "Logoff AndX", 0x75: "Tree Connect AndX", 0xA0: "NT Transact", 0xA2: "NT Create AndX", 0xC0: "Open Print File",
    0xC1: "Write Print File", 0xC2: "Close Print File", 0xC3: "Get Print Queue",
}
MQTT_TYPES = {
    1: "CONNECT", 2: "CONNACK", 3: "PUBLISH", 4: "PUBACK", 5: "PUBREC", 6: "PUBREL", 7: "PUBCOMP", 8: "SUBSCRIBE", 9: "SUBACK", 10: "UNSUBSCRIBE", 11: "UNSUBACK", 12: "PINGREQ", 13: "PINGRESP", 14: "DISCONNECT", 15: "AUTH",
}
AMQP_FRAMES = {1: "METHOD", 2: "HEADER", 3: "BODY", 8: "HEARTBEAT"}
_AMQP = {
    10: ("Connection", {10: "Start", 11: "StartOk", 20: "Secure", 21: "SecureOk", 30: "Tune", 31: "TuneOk", 40: "Open", 41: "OpenOk", 50: "Close", 51: "CloseOk", 60: "Blocked", 61: "Unblocked"}),
    20: ("Channel", {10: "Open", 11: "OpenOk", 20: "Flow", 21: "FlowOk", 40: "Close", 41: "CloseOk"}),
    40: ("Exchange", {10: "Declare", 11: "DeclareOk", 20: "Delete", 21: "DeleteOk"}),
    50: ("Queue", {10: "Declare", 11: "DeclareOk", 20: "Bind", 21: "BindOk", 30: "Purge", 31: "PurgeOk", 40: "Delete", 41: "DeleteOk", 50: "Unbind", 51: "UnbindOk"}),
    60: ("Basic", {10: "Qos", 11: "QosOk", 20: "Consume", 21: "ConsumeOk", 30: "Cancel", 31: "CancelOk", 40: "Publish", 50: "Return", 60: "Deliver", 70: "Get", 71: "GetOk", 72: "GetEmpty", 80: "Ack", 90: "Reject", 110: "Recover", 111: "RecoverOk", 120: "Nack"}),
    90: ("Tx", {10: "Select", 11: "SelectOk", 20: "Commit", 21: "CommitOk", 30: "Rollback", 31: "RollbackOk"}),
}
AMQP_METHODS = {c << 16 | m: f"{name}.{x}" for c, (name, methods) in _AMQP.items() for m, x in methods.items()}
PPTP_MESSAGES = {
    1: "Start-Control-Connection-Request", 2: "Start-Control-Connection-Reply", 3: "Stop-Control-Connection-Request", 4: "Stop-Control-Connection-Reply", 5: "Echo-Request", 6: "Echo-Reply", 7: "Outgoing-Call-Request",
    8: "Outgoing-Call-Reply", 9: "Incoming-Call-Request", 10: "Incoming-Call-Reply", 11: "Incoming-Call-Connected", 12: "Call-Clear-Request", 13: "Call-Disconnect-Notify", 14: "WAN-Error-Notify", 15: "Set-Link-Info",
}
POSTGRES_SPECIAL = {5678: "CancelRequest", 5679: "SSLRequest", 5680: "GSSAPIRequest"}
TDS_TYPES = {1: "SQL_Batch", 2: "Pre_TDS7_Login", 3: "RPC", 4: "Tabular_Result", 6: "Attention_Signal", 7: "Bulk_Load_Data", 14: "Transaction_Manager_Request", 16: "LOGIN7", 18: "PRELOGIN"}
TDS_TOKENS = {0: "version", 1: "encryption", 2: "instopt", 3: "threadid", 4: "mars", 5: "traceid", 6: "fedauthrequired", 7: "nonceopt"}
NBNS_OPCODES = {0: "Query", 5: "Registration", 6: "Release", 7: "WACK", 8: "Refresh"}
NBDS_TYPES = {0x10: "Direct_Unique Datagram", 0x11: "Direct_Group Datagram", 0x12: "Broadcast Datagram", 0x13: "Datagram Error", 0x14: "Datagram Query Request", 0x15: "Datagram Positive Query Response", 0x16: "Datagram Negative Query Response"}


def when(test, value):
    return F.when(test, value)


@dissector("RTP", "rtp", 11, "UDP")
class Rtp:
    def detect(p, port, l4):
        kind = bits(be(p, 1, 1), 0, 127)
        return when((length(p) >= 12) & (bits(be(p, 0, 1), 6, 3) == 2), F.when(kind.between(72, 76), 0.3).otherwise(0.5)).otherwise(0.0)

    def fields(p, port, l4):
        return {
            "rtp_payload_type": number(bits(be(p, 1, 1), 0, 127)),
            "rtp_sequence_number": number(be(p, 2, 2)),
            "rtp_timestamp": number(be(p, 4, 4)),
            "rtp_ssrc": as_hex(be(p, 8, 4), 8),
            "rtp_marker": flag(be(p, 1, 1), 128),
            "rtp_csrc_count": number(bits(be(p, 0, 1), 0, 15)),
        }


@dissector("NTP", "ntp", 17, "UDP", (123,), (0.6, 0.9))
class Ntp:
    def detect(p, port, l4):
        return (length(p) >= 48) & bits(be(p, 0, 1), 3, 7).between(1, 4) & (bits(be(p, 0, 1), 0, 7) != 0)

    def fields(p, port, l4):
        from flowloom.functions.bytes import tlvs

        b, n = be(p, 0, 1), length(p)
        # an extension shorter than 16 bytes ends the list
        every = tlvs(p, 48, n, kind=2, size=2, whole=True)
        short = F.array_position(F.transform(every, lambda x: x["n"] < 12), True)
        ext = F.when(n > 48, F.when(short > 0, F.slice(every, F.lit(1), (short - 1).cast("int"))).otherwise(every))
        end = F.coalesce(F.element_at(F.when(F.size(ext) > 0, ext), -1)["at"] + F.element_at(F.when(F.size(ext) > 0, ext), -1)["n"], F.lit(48))
        out = {
            "ntp_version": number(bits(b, 3, 7)),
            "ntp_mode": name_of(bits(b, 0, 7), NTP_MODES, "Reserved"),
            "ntp_stratum": number(be(p, 1, 1)),
            "ntp_leap_indicator": number(bits(b, 6, 3)),
            "ntp_reference_id_hex": hexed(p, 12, 4),
        }
        for i in range(8):
            x = F.get(ext, F.lit(i))
            out[f"ntp_extension_{i}_type"] = as_hex(x["t"], 4)
            out[f"ntp_extension_{i}_length"] = number(x["n"] + 4)
        out["ntp_extension_count"] = when(F.size(ext) > 0, number(F.size(ext)))
        out["ntp_mac_present"] = when((n > 48) & (end < n), F.lit("true"))
        return out


@dissector("Modbus", "modbus", 20, "TCP", (502,), (0.6, 0.9))
class Modbus:
    def detect(p, port, l4):
        return (length(p) >= 8) & (be(p, 2, 2) == 0) & (be(p, 4, 2) >= 2) & (be(p, 4, 2) + 6 <= length(p))

    def fields(p, port, l4):
        f = be(p, 7, 1)
        size = F.least(be(p, 4, 2) - 2, length(p) - 8)
        plain = f < 128
        read, write = plain & f.between(1, 4) & (size >= 4), plain & f.isin(5, 6) & (size >= 4)
        return {
            "modbus_transaction_id": number(be(p, 0, 2)),
            "modbus_unit_id": number(be(p, 6, 1)),
            "modbus_function": name_of(bits(f, 0, 127), MODBUS_FUNCTIONS),
            "modbus_exception_response": when(~plain, F.lit("true")),
            "modbus_exception_code": when(~plain & (size >= 1), name_of(be(p, 8, 1), MODBUS_EXCEPTIONS)),
            "modbus_request_start_address": when(read, number(be(p, 8, 2))),
            "modbus_request_quantity": when(read, number(be(p, 10, 2))),
            "modbus_write_address": when(write, number(be(p, 8, 2))),
            "modbus_write_value": when(write, number(be(p, 10, 2))),
        }


@dissector("DNP3", "dnp3", 21, "TCP", (20000,), (0.7, 0.9))
class Dnp3:
    def detect(p, port, l4):
        return (length(p) >= 10) & (be(p, 0, 2) == 0x0564) & (be(p, 2, 1) >= 5)

    def fields(p, port, l4):
        c, user = be(p, 3, 1), be(p, 2, 1) - 5
        primary = c.bitwiseAND(F.lit(64)) != 0
        small = (user > 0) & (user <= 16)
        there = small & (user + 10 <= length(p))
        app = there & (user >= 3)
        return {
            "dnp3_direction": F.when(c >= 128, "master_to_outstation").otherwise("outstation_to_master"),
            "dnp3_link_function": F.when(primary, name_of(bits(c, 0, 15), DNP3_PRIMARY)).otherwise(name_of(bits(c, 0, 15), DNP3_SECONDARY)),
            "dnp3_destination": number(le(p, 4, 2)),
            "dnp3_source": number(le(p, 6, 2)),
            "dnp3_fcv": when(primary, flag(c, 16)),
            "dnp3_fcb": when(primary & (bits(c, 4, 1) == 1), flag(c, 32)),
            "dnp3_dfc": when(~primary, flag(c, 16)),
            "dnp3_multi_block_user_data_not_reassembled": when(user > 16, F.lit("true")),
            "parse_warning": when(small & ~there, F.lit("user_data_exceeds_available_length")),
            "dnp3_transport_fir": when(there, flag(be(p, 10, 1), 128)),
            "dnp3_transport_fin": when(there, flag(be(p, 10, 1), 64)),
            "dnp3_transport_sequence": when(there, number(bits(be(p, 10, 1), 0, 63))),
            "dnp3_app_fir": when(app, flag(be(p, 11, 1), 128)),
            "dnp3_app_fin": when(app, flag(be(p, 11, 1), 64)),
            "dnp3_app_sequence": when(app, number(bits(be(p, 11, 1), 0, 63))),
            "dnp3_app_function": when(app, name_of(be(p, 12, 1), DNP3_APPLICATION)),
        }


@dissector("ESP", "esp", 33, "ESP")
class Esp:
    def detect(p, port, l4):
        return when(length(p) >= 8, F.lit(0.85)).otherwise(0.0)

    def fields(p, port, l4):
        return {"esp_spi": as_hex(be(p, 0, 4), 8), "esp_sequence": number(be(p, 4, 4)), "esp_payload_encrypted": F.lit("true")}


@dissector("HSRP", "hsrp", 34, "UDP", (1985,))
class Hsrp:
    def detect(p, port, l4):
        v1 = (length(p) == 20) & (be(p, 1, 1) <= 2)
        return F.when(length(p) < 6, 0.0).when(v1, F.when(port == 1985, 0.9).otherwise(0.6)).otherwise(F.when(port == 1985, 0.8).otherwise(0.5))

    def fields(p, port, l4):
        sized = length(p) == 20
        v1 = sized & (be(p, 1, 1) <= 2)
        one = {f"hsrp_{k}": when(v1, number(be(p, o, 1))) for k, o in (("version", 0), ("hellotime", 3), ("holdtime", 4), ("priority", 5), ("group", 6))}
        return {
            "hsrp_recognized_version": F.when(v1, "v1").otherwise("unrecognized_possibly_v2"),
            "hsrp_unrecognized_length": when(~sized, number(length(p))),
            **one,
            "hsrp_opcode": when(v1, name_of(be(p, 1, 1), HSRP_OPCODES)),
            "hsrp_state": when(v1, name_of(be(p, 2, 1), HSRP_STATES)),
            "hsrp_virtual_ip": when(v1, ipv4(p, 16)),
            "hsrp_auth_data_present": when(v1, F.lit("true")),
        }


@dissector("ISAKMP", "isakmp", 36, "UDP", (500, 4500))
class Isakmp:
    def detect(p, port, l4):
        ok = (length(p) >= 28) & bits(be(p, 17, 1), 4, 15).isin(1, 2)
        return F.when(~ok, 0.0).when(be(p, 24, 4) != length(p), 0.3).otherwise(F.when(port.isin(500, 4500), 0.9).otherwise(0.7))

    def fields(p, port, l4):
        v = be(p, 17, 1)
        return {
            "isakmp_initiator_spi": hexed(p, 0, 8),
            "isakmp_responder_spi": hexed(p, 8, 8),
            "isakmp_version": F.concat_ws(".", bits(v, 4, 15), bits(v, 0, 15)),
            "isakmp_ike_version": F.when(bits(v, 4, 15) == 2, "IKEv2").otherwise("IKEv1"),
            "isakmp_exchange_type": name_of(be(p, 18, 1), IKE_EXCHANGES),
            "isakmp_flags": as_hex(be(p, 19, 1), 2),
            "isakmp_message_id": number(be(p, 20, 4)),
        }


@dissector("ICMP", "icmp", 12, "ICMP")
class Icmp:
    def detect(p, port, l4):
        return when(length(p) >= 8, F.lit(0.9)).otherwise(0.0)

    def fields(p, port, l4):
        t, n = be(p, 0, 1), length(p)
        bare = F.concat(cut(p, 0, 2), F.lit(b"\x00\x00"), cut(p, 4, n))
        echo = t.isin(0, 8) | t.isin(15, 16) & (n >= 12) | t.isin(17, 18) & (n >= 16)
        adv = (t == 9) & (n >= 12)
        orig = t.isin(3, 11) & (n > 8)
        inner = cut(p, 8, n)
        v4 = _ipv4_inside(inner)
        l4_at = bits(be(inner, 0, 1), 0, 15) * 4
        proto = be(inner, 9, 1)
        ports = orig & v4 & proto.isin(6, 17) & (be(inner, 2, 2) - l4_at >= 4)
        return {
            "icmp_type": name_of(t, ICMP_TYPES),
            "icmp_code": number(be(p, 1, 1)),
            "icmp_checksum_valid": F.when(checksum16(bare) == be(p, 2, 2), "true").otherwise("false"),
            "icmp_echo_identifier": when(echo, number(be(p, 4, 2))),
            "icmp_echo_sequence": when(echo, number(be(p, 6, 2))),
            "icmp_redirect_gateway": when(t == 5, ipv4(p, 4)),
            "icmp_router_adv_num_addrs": when(adv, number(be(p, 4, 1))),
            "icmp_router_adv_lifetime_sec": when(adv, number(be(p, 6, 2))),
            "icmp_router_adv_address_0": when(adv & (be(p, 5, 1) == 2) & (n >= 20), ipv4(p, 8)),
            "icmp_address_mask": when(t.isin(17, 18) & (n >= 16), ipv4(p, 8)),
            "icmp_original_packet_present": when(orig, F.lit("true")),
            "icmp_original_src_ip": when(orig & v4, ipv4(inner, 12)),
            "icmp_original_dst_ip": when(orig & v4, ipv4(inner, 16)),
            "icmp_original_src_port": when(ports, number(be(inner, l4_at, 2))),
            "icmp_original_dst_port": when(ports, number(be(inner, l4_at + 2, 2))),
            "icmp_original_protocol": when(ports, F.when(proto == 6, "TCP").otherwise("UDP")),
        }


def _ipv4_inside(p):
    ihl, total, n = bits(be(p, 0, 1), 0, 15) * 4, be(p, 2, 2), length(p)
    return (n >= 20) & (bits(be(p, 0, 1), 4, 15) == 4) & (ihl >= 20) & (ihl <= n) & (total >= ihl) & (total <= n)


@dissector("ICMPv6", "icmpv6", 13, "ICMPv6")
class Icmp6:
    def detect(p, port, l4):
        return when(length(p) >= 8, F.lit(0.9)).otherwise(0.0)

    def fields(p, port, l4):
        t, n = be(p, 0, 1), length(p)
        nd = t.isin(135, 136) & (n >= 24)
        na = nd & (t == 136)
        orig = t.isin(1, 3) & (n > 8)
        inner = cut(p, 8, n)
        v6 = orig & (length(inner) >= 40) & (bits(be(inner, 0, 1), 4, 15) == 6)
        nxt = be(inner, 6, 1)
        ports = v6 & nxt.isin(6, 17) & (length(inner) >= 44)
        echo = t.isin(128, 129)
        return {
            "icmpv6_type": name_of(t, ICMP6_TYPES),
            "icmpv6_code": number(be(p, 1, 1)),
            "icmpv6_echo_identifier": when(echo, number(be(p, 4, 2))),
            "icmpv6_echo_sequence": when(echo, number(be(p, 6, 2))),
            "icmpv6_nd_target_address": when(nd, ipv6(p, 8)),
            "icmpv6_na_router_flag": when(na, flag(be(p, 4, 1), 128)),
            "icmpv6_na_solicited_flag": when(na, flag(be(p, 4, 1), 64)),
            "icmpv6_na_override_flag": when(na, flag(be(p, 4, 1), 32)),
            "icmpv6_original_packet_present": when(orig, F.lit("true")),
            "icmpv6_original_src_ip": when(v6, ipv6(inner, 8)),
            "icmpv6_original_dst_ip": when(v6, ipv6(inner, 24)),
            "icmpv6_original_src_port": when(ports, number(be(inner, 40, 2))),
            "icmpv6_original_dst_port": when(ports, number(be(inner, 42, 2))),
            "icmpv6_original_protocol": when(ports, F.when(nxt == 6, "TCP").otherwise("UDP")),
        }


@dissector("ARP", "arp", 15, "ARP")
class Arp:
    """The conflict of bindings over time is ``flowloom.operators.flows.arp_conflicts``."""

    def detect(p, port, l4):
        shape = (be(p, 0, 2) == 1) & (be(p, 2, 2) == 0x0800) & (be(p, 4, 1) == 6) & (be(p, 5, 1) == 4)
        return F.when(length(p) < 8, 0.0).when(~shape, 0.2).when(be(p, 6, 2).between(1, 4), 0.95).otherwise(0.0)

    def fields(p, port, l4):
        op = be(p, 6, 2)
        full = (be(p, 0, 2) == 1) & (be(p, 4, 1) == 6) & (be(p, 5, 1) == 4) & (length(p) >= 28)
        rest = F.hex(cut(p, 28, length(p)))
        return {
            "arp_opcode": name_of(op, {1: "Request", 2: "Reply", 3: "RARP Request", 4: "RARP Reply"}),
            "arp_sender_mac": when(full, mac(p, 8)),
            "arp_sender_ip": when(full, ipv4(p, 14)),
            "arp_target_mac": when(full, mac(p, 18)),
            "arp_target_ip": when(full, ipv4(p, 24)),
            "arp_reply_with_zero_target_mac": when(full & (op == 2) & (be(p, 18, 6) == 0), F.lit("true")),
            "arp_gratuitous": when(full & (cut(p, 14, 4) == cut(p, 24, 4)), F.lit("true")),
            "arp_padding_non_zero": when(full & rest.rlike("[^0]"), F.lit("true")),
        }


@dissector("IGMP", "igmp", 28, "IGMP")
class Igmp:
    def detect(p, port, l4):
        return when((length(p) >= 8) & be(p, 0, 1).isin(*IGMP_TYPES), F.lit(0.9)).otherwise(0.0)

    def fields(p, port, l4):
        t, n = be(p, 0, 1), length(p)
        query, report = t == 0x11, t == 0x22
        record = report & (be(p, 6, 2) > 0) & (n >= 16)
        return {
            "igmp_type": name_of(t, IGMP_TYPES),
            "igmp_group_address": when(~report, ipv4(p, 4)),
            "igmp_max_resp_time": when(query, number(be(p, 1, 1))),
            "igmp_v3_qrv": when(query & (n >= 12), number(bits(be(p, 8, 1), 0, 7))),
            "igmp_v3_num_sources": when(query & (n >= 12), number(be(p, 10, 2))),
            "igmp_v3_num_group_records": when(report, number(be(p, 6, 2))),
            "igmp_v3_first_record_type": when(record, name_of(be(p, 8, 1), IGMP_RECORDS)),
            "igmp_v3_first_record_mcast_addr": when(record, ipv4(p, 12)),
        }


@dissector("OSPF", "ospf", 24, "OSPF")
class Ospf:
    def detect(p, port, l4):
        v = be(p, 0, 1)
        return when(v.isin(2, 3) & be(p, 1, 1).between(1, 5) & (length(p) >= F.when(v == 2, 24).otherwise(16)), F.lit(0.9)).otherwise(0.0)

    def fields(p, port, l4):
        v, t = be(p, 0, 1), be(p, 1, 1)
        two = v == 2
        head = F.when(two, 24).otherwise(16)
        size = be(p, 2, 2)
        ok = (size >= head) & (size <= length(p))
        hello = ok & (t == 1) & (size - head >= 20)
        b = F.when(two, cut(p, 24, size - 24)).otherwise(cut(p, 16, size - 16))
        near = F.floor((size - head - 20) / 4)
        out = {
            "parse_warning": when(~ok, F.lit("ospf_pkt_len_inconsistent_with_buffer")),
            "ospf_version": when(ok, number(v)),
            "ospf_type": when(ok, name_of(t, OSPF_TYPES)),
            "ospf_router_id": when(ok, ipv4(p, 4)),
            "ospf_area_id": when(ok, ipv4(p, 8)),
            "ospf_autype": when(ok & two, number(be(p, 14, 2))),
            "ospf_instance_id": when(ok & ~two, number(be(p, 14, 1))),
            "ospf_hello_netmask": when(hello & two, ipv4(b, 0)),
            "ospf_hello_interface_id": when(hello & ~two, number(be(b, 0, 4))),
            "ospf_hello_interval": when(hello, number(F.when(two, be(b, 4, 2)).otherwise(be(b, 8, 2)))),
            "ospf_hello_priority": when(hello, number(F.when(two, be(b, 7, 1)).otherwise(be(b, 4, 1)))),
            "ospf_hello_dead_interval": when(hello, number(F.when(two, be(b, 8, 4)).otherwise(be(b, 10, 2)))),
            "ospf_hello_dr": when(hello, ipv4(b, 12)),
            "ospf_hello_bdr": when(hello, ipv4(b, 16)),
            "ospf_hello_neighbor_count": when(hello, number(near)),
        }
        for i in range(4):
            out[f"ospf_hello_neighbor_{i}"] = when(hello & (near > i), ipv4(b, 20 + 4 * i))
        return out


@dissector("RIP", "rip", 29, "UDP", (520, 521))
class Rip:
    def detect(p, port, l4):
        ok = (length(p) >= 4) & be(p, 0, 1).between(1, 5) & be(p, 1, 1).between(1, 2)
        return F.when(~ok, 0.0).when((length(p) - 4) % 20 != 0, 0.3).otherwise(F.when(port.isin(520, 521), 0.9).otherwise(0.7))

    def fields(p, port, l4):
        ng = port == 521
        n = F.floor((length(p) - 4) / 20)
        out = {"rip_command": name_of(be(p, 0, 1), RIP_COMMANDS), "rip_version": number(be(p, 1, 1)), "rip_is_ripng": F.when(ng, "true").otherwise("false"), "rip_entry_count": number(n)}
        for i in range(4):
            at = 4 + 20 * i
            v6 = F.concat(ipv6(p, at), F.lit("/"), be(p, at + 18, 1))
            out[f"rip_entry_{i}_prefix"] = when(n > i, F.when(ng, v6).otherwise(F.concat(ipv4(p, at + 4), F.lit("/"), ipv4(p, at + 8))))
            out[f"rip_entry_{i}_metric"] = when(n > i, number(F.when(ng, be(p, at + 19, 1)).otherwise(be(p, at + 16, 4))))
        return out


@dissector("S7comm", "s7comm", 39, "TCP", (102,), (0.7, 0.9))
class S7:
    def _at(p):
        at = be(p, 4, 1) + 5
        ok = (length(p) >= 7) & (be(p, 0, 1) == 3) & (be(p, 2, 2) == length(p)) & (at < length(p)) & (bits(be(p, 5, 1), 4, 15) == 15)
        return F.when(ok & (be(p, at, 1) == 0x32), at)

    def detect(p, port, l4):
        return S7._at(p).isNotNull()

    def fields(p, port, l4):
        at, n = S7._at(p), length(p)
        ok = at.isNotNull() & (at + 10 <= n)
        r = be(p, at + 1, 1)
        err = F.when(r == 2, at + 8).when((r == 3) & (at + 12 <= n), at + 10)
        f = F.when(r == 3, at + 12).otherwise(at + 10)
        has = ok & (be(p, at + 6, 2) > 0) & (f < n)
        return {
            "s7comm_rosctr": when(ok, name_of(r, S7_ROSCTR)),
            "s7comm_pdu_reference": when(ok, number(be(p, at + 4, 2))),
            "s7comm_param_length": when(ok, number(be(p, at + 6, 2))),
            "s7comm_error_class": when(ok & err.isNotNull(), number(be(p, err, 1))),
            "s7comm_error_code": when(ok & err.isNotNull(), number(be(p, err + 1, 1))),
            "s7comm_data_length": when(ok & ~r.isin(2, 3), number(be(p, at + 8, 2))),
            "s7comm_function_code": when(has, name_of(be(p, f, 1), S7_FUNCTIONS)),
            "s7comm_function_code_raw": when(has, as_hex(be(p, f, 1), 2)),
        }


@dissector("SMB1", "smb1", 45, "TCP", (445, 139), (0.8, 0.9))
class Smb1:
    def detect(p, port, l4):
        return (length(p) >= 37) & (be(p, 0, 1) == 0) & (hexed(p, 4, 4) == "ff534d42")

    def fields(p, port, l4):
        reply = be(p, 13, 1) >= 128
        words = be(p, 36, 1) * 2 + 37
        n = length(p)
        over_words = words + 2 > n
        size = F.when(~over_words, le(p, words, 2))
        over_bytes = words + 2 + size > n
        out = {
            "smb1_command": name_of(be(p, 8, 1), SMB1_COMMANDS),
            "smb1_status": as_hex(le(p, 9, 4), 8),
            "smb1_is_response": F.when(reply, "true").otherwise("false"),
            "smb1_tid": number(le(p, 28, 2)),
            "smb1_pid": number(le(p, 30, 2)),
            "smb1_uid": number(le(p, 32, 2)),
            "smb1_mid": number(le(p, 34, 2)),
            "parse_warning": F.when(over_words, "smb1_word_count_exceeds_buffer").when(over_bytes, "smb1_byte_count_exceeds_buffer"),
        }
        data = text(p, words + 2, F.coalesce(size, F.lit(0)))
        names = F.regexp_extract_all(F.regexp_extract(data, r"^((?:\x02[^\x00]*\x00)*)", 1), F.lit(r"\x02([^\x00]*)\x00"), F.lit(1))
        ask = ~over_words & ~over_bytes & (be(p, 8, 1) == 0x72) & ~reply
        for i in range(12):
            out[f"smb1_dialect_{i}"] = when(ask, F.get(names, F.lit(i)))
        return out


@dissector("TFTP", "tftp", 50, "UDP", (69,), (0.6, 0.85))
class Tftp:
    def detect(p, port, l4):
        return (length(p) >= 4) & be(p, 0, 2).between(1, 6)

    def fields(p, port, l4):
        op = be(p, 0, 2)
        shown = lambda x: F.regexp_replace(x, r"[^\x20-\x7e]", ".")
        name, mode = F.get(F.split(text(p, 2, length(p)), "\0", -1), F.lit(0)), F.split(text(p, 2, length(p)), "\0", -1)
        ask = op.isin(1, 2)
        return {
            "tftp_opcode": name_of(op, TFTP_OPCODES),
            "tftp_filename": when(ask & (F.size(mode) > 1), shown(name)),
            "tftp_mode": when(ask & (F.size(mode) > 2), shown(F.get(mode, F.lit(1)))),
            "tftp_block": when(op.isin(3, 4), number(be(p, 2, 2))),
            "tftp_data_length": when(op == 3, number(length(p) - 4)),
            "tftp_error_code": when(op == 5, number(be(p, 2, 2))),
            "tftp_error_message": when(op == 5, shown(between_zeros(p, 4))),
        }


@dissector("WoL", "wol", 51, "UDP TCP WoL")
class Wol:
    def detect(p, port, l4):
        return when((length(p) >= 102) & (cut(p, 0, 102) == F.concat(F.lit(b"\xff" * 6), *([cut(p, 6, 6)] * 16))), F.lit(0.95)).otherwise(0.0)

    def fields(p, port, l4):
        return {"wol_target_mac": mac(p, 6), "wol_secureon_password_present": when((length(p) - 102).isin(4, 6), F.lit("true"))}


@dissector("OpenVPN", "openvpn", 64, "UDP", (1194,), (0.5, 0.85))
class OpenVpn:
    def detect(p, port, l4):
        return (length(p) >= 1) & bits(be(p, 0, 1), 3, 31).between(1, 9)

    def fields(p, port, l4):
        return {"openvpn_opcode": name_of(bits(be(p, 0, 1), 3, 31), OPENVPN_OPCODES), "openvpn_key_id": number(bits(be(p, 0, 1), 0, 7))}


@dissector("SOCKS4", "socks4", 66, "TCP", (1080,), (0.5, 0.85))
class Socks4:
    def detect(p, port, l4):
        a, b = be(p, 0, 1), be(p, 1, 1)
        return (length(p) >= 9) & ((a == 4) & b.isin(1, 2) | (a == 0) & b.between(90, 93))

    def fields(p, port, l4):
        ask, reply = be(p, 0, 1) == 4, be(p, 0, 1) == 0
        user = between_zeros(p, 8)
        named = ask & (be(p, 4, 3) == 0) & (be(p, 7, 1) != 0)
        return {
            "socks4_message_type": F.when(reply, "reply").when(ask, "request"),
            "socks4_reply_code": when(reply, name_of(be(p, 1, 1), SOCKS4_REPLIES)),
            "socks4_command": when(ask, name_of(be(p, 1, 1), SOCKS4_COMMANDS)),
            "socks4_dst_ip": when(ask, ipv4(p, 4)),
            "socks4_dst_port": when(ask, number(be(p, 2, 2))),
            "socks4_userid": when(ask, user),
            "socks4a_dst_hostname": when(named, between_zeros(p, F.length(user) + 9)),
        }


@dissector("SOCKS5", "socks5", 67, "TCP", (1080,), (0.5, 0.85))
class Socks5:
    def detect(p, port, l4):
        five, n = be(p, 0, 1) == 5, length(p)
        ask = (n >= 6) & be(p, 1, 1).between(1, 3) & (be(p, 2, 1) == 0) & be(p, 3, 1).isin(1, 3, 4)
        return (n >= 3) & five & ((n >= be(p, 1, 1) + 2) | ask)

    def fields(p, port, l4):
        """The direction tells replies from requests: what goes to port 1080 asks."""
        n = length(p)
        long = (n >= 6) & (be(p, 2, 1) == 0) & be(p, 3, 1).isin(1, 3, 4)
        reply = long & ((be(p, 1, 1) == 0) | (port != 1080) & (be(p, 1, 1) > 3))
        kind = be(p, 3, 1)
        size = F.when(kind == 1, 4).when(kind == 3, be(p, 4, 1) + 1).otherwise(16)
        full = long & (n >= size + 6)
        groups = F.concat_ws(":", *(hexed(p, 4 + 2 * k, 2) for k in range(8)))
        talk = ~long & (n >= be(p, 1, 1) + 2)
        return {
            "socks5_message_type": F.when(reply, "reply").when(long, "request").when(talk, "method_negotiation"),
            "socks5_command": when(long & ~reply, name_of(be(p, 1, 1), SOCKS5_COMMANDS)),
            "socks5_reply_code": when(reply, name_of(be(p, 1, 1), SOCKS5_REPLIES)),
            "socks5_dst_addr": when(full, F.when(kind == 1, ipv4(p, 4)).when(kind == 3, text(p, 5, be(p, 4, 1))).otherwise(groups)),
            "socks5_dst_port": when(full, number(be(p, size + 4, 2))),
            "socks5_nmethods": when(talk, number(be(p, 1, 1))),
            "socks5_method_0": when(talk & (be(p, 1, 1) > 0), name_of(be(p, 2, 1), SOCKS5_METHODS)),
        }


@dissector("VXLAN", "vxlan", 68, "UDP", (4789,), (0.4, 0.85))
class Vxlan:
    def detect(p, port, l4):
        return (length(p) >= 8) & (be(p, 0, 4) == 0x08000000) & (be(p, 7, 1) == 0)

    def fields(p, port, l4):
        return {"vxlan_vni": number(be(p, 4, 3)), "vxlan_vni_valid": F.lit("true")}


@dissector("Geneve", "geneve", 70, "UDP", (6081,), (0.4, 0.8))
class Geneve:
    def detect(p, port, l4):
        return (length(p) >= 8) & (be(p, 0, 1) < 64) & (length(p) >= be(p, 0, 1) * 4 + 8)

    def fields(p, port, l4):
        return {
            "geneve_control_packet": flag(be(p, 1, 1), 128),
            "geneve_critical_options_present": flag(be(p, 1, 1), 64),
            "geneve_protocol_type": as_hex(be(p, 2, 2), 4),
            "geneve_inner_is_ethernet": F.when(be(p, 2, 2) == 0x6558, "true").otherwise("false"),
            "geneve_vni": number(be(p, 4, 3)),
            "geneve_options_length_bytes": number(bits(be(p, 0, 1), 0, 63) * 4),
        }


@dissector("MobileIP", "mobileip", 71, "UDP", (434,), (0.4, 0.8))
class MobileIp:
    def detect(p, port, l4):
        return (length(p) >= 2) & ((be(p, 0, 1) == 1) & (length(p) >= 20) | (be(p, 0, 1) == 3))

    def fields(p, port, l4):
        ask = (be(p, 0, 1) == 1) & (length(p) >= 20)
        flags = {"simultaneous_bindings": 128, "broadcast": 64, "colocated_decapsulation": 32, "minimal_encap": 16, "gre_encap": 8, "reverse_tunnel": 2}
        return {
            "mobileip_type": name_of(be(p, 0, 1), {1: "Registration Request", 3: "Registration Reply"}),
            **{f"mobileip_flag_{k}": when(ask, flag(be(p, 1, 1), m)) for k, m in flags.items()},
            "mobileip_lifetime_sec": when(ask, number(be(p, 2, 2))),
            "mobileip_home_address": when(ask, ipv4(p, 4)),
            "mobileip_home_agent": when(ask, ipv4(p, 8)),
            "mobileip_care_of_address": when(ask, ipv4(p, 12)),
        }


@dissector("PPTP", "pptp", 72, "TCP", (1723,), (0.85, 0.95))
class Pptp:
    def detect(p, port, l4):
        return (length(p) >= 12) & (be(p, 2, 2) == 1) & (be(p, 4, 4) == 0x1A2B3C4D) & be(p, 8, 2).between(1, 15)

    def fields(p, port, l4):
        return {"pptp_length": number(be(p, 0, 2)), "pptp_control_message_type": name_of(be(p, 8, 2), PPTP_MESSAGES)}


@dissector("Teredo", "teredo", 73, "UDP", (3544,), (0.3, 0.8))
class Teredo:
    def detect(p, port, l4):
        return (length(p) >= 2) & ((be(p, 0, 2) == 1) | (be(p, 0, 2) == 0) & (length(p) >= 8) | (bits(be(p, 0, 1), 4, 15) == 6))

    def fields(p, port, l4):
        n = length(p)
        auth = (be(p, 0, 2) == 1) & (n >= 4)
        nonce = be(p, 2, 1) + be(p, 3, 1) + 4
        full = auth & (n >= nonce + 9)
        at = F.when(auth, F.when(full, nonce + 9)).otherwise(0)
        origin = (at + 8 <= n) & (be(p, at, 2) == 0)
        inner = at + F.when(origin, 8).otherwise(0)
        six = (inner < n) & (bits(be(p, inner, 1), 4, 15) == 6)
        return {
            "teredo_auth_id_len": when(auth, number(be(p, 2, 1))),
            "teredo_auth_au_len": when(auth, number(be(p, 3, 1))),
            "teredo_auth_nonce_hex": when(full, hexed(p, nonce, 8)),
            "teredo_auth_confirmation_byte": when(full, number(be(p, nonce + 8, 1))),
            "teredo_origin_port": when(origin, number(be(p, at + 2, 2).bitwiseXOR(F.lit(0xFFFF)))),
            "teredo_origin_ipv4": when(origin, ipv4_number(be(p, at + 4, 4).bitwiseXOR(F.lit(0xFFFFFFFF)))),
            "teredo_inner_ipv6_present": when(six, F.lit("true")),
            "teredo_is_bubble": when(six & (be(p, inner + 6, 1) == 59) & (n == inner + 40), F.lit("true")),
        }


@dissector("MQTT", "mqtt", 16, "TCP", (1883, 8883), (0.5, 0.85))
class Mqtt:
    def _rest(p):
        """(remaining length, where it ends), null if malformed."""
        used = None
        for k in (1, 2, 3, 4):
            test = (be(p, k, 1) < 128) & (length(p) > k)
            used = F.when(test, k) if used is None else used.when(test, k)
        value = sum((F.when(used > k, bits(be(p, k + 1, 1), 0, 127) * 128**k).otherwise(0) for k in range(1, 4)), bits(be(p, 1, 1), 0, 127))
        return F.when(used.isNotNull(), value), used + 1

    def detect(p, port, l4):
        rest, at = Mqtt._rest(p)
        return (length(p) >= 2) & (be(p, 0, 1) >= 16) & F.coalesce(at + rest <= length(p), F.lit(False))

    def fields(p, port, l4):
        rest, at = Mqtt._rest(p)
        kind = bits(be(p, 0, 1), 4, 15)
        end = at + rest
        ok = F.coalesce(end <= length(p), F.lit(False))
        connect, publish = ok & (kind == 1), ok & (kind == 3)
        size = be(p, at, 2)
        named = at + 2 + size <= end
        level = F.when(named, at + 2 + size).otherwise(at + 2)
        client = level + 4
        return {
            "mqtt_message_type": name_of(kind, MQTT_TYPES, "Reserved"),
            "parse_warning": F.when(rest.isNull(), "malformed_remaining_length").when(end > length(p), "remaining_length_exceeds_buffer"),
            "mqtt_protocol_name": when(connect & named, text(p, at + 2, size)),
            "mqtt_protocol_level": when(connect & (level + 4 <= end), number(be(p, level, 1))),
            "mqtt_client_id": when(connect & (client + 2 + be(p, client, 2) <= end), text(p, client + 2, be(p, client, 2))),
            "mqtt_qos": when(publish, number(bits(be(p, 0, 1), 1, 3))),
            "mqtt_topic_name": when(publish & named, text(p, at + 2, size)),
        }


@dissector("AMQP", "amqp", 56, "TCP", (5672,))
class Amqp:
    def _hello(p):
        return (length(p) >= 8) & (hexed(p, 0, 5) == "414d515000")

    def _frame(p):
        size = be(p, 3, 4)
        return (length(p) >= 8) & be(p, 0, 1).isin(*AMQP_FRAMES) & (size + 7 < length(p)) & (be(p, size + 7, 1) == 0xCE)

    def detect(p, port, l4):
        return F.when(Amqp._hello(p), 0.9).when(Amqp._frame(p), F.when(port == 5672, 0.9).otherwise(0.6)).otherwise(0.0)

    def fields(p, port, l4):
        hello, n = Amqp._hello(p), length(p)
        frame = ~hello & Amqp._frame(p)
        call = frame & (be(p, 0, 1) == 1) & (be(p, 3, 4) >= 4)
        method = be(p, 7, 2) * 65536 + be(p, 9, 2)
        publish, deliver, declare = (call & (method == k) for k in (60 << 16 | 40, 60 << 16 | 60, 50 << 16 | 10))
        fits = lambda at: at + 1 + be(p, at, 1) <= n
        short = lambda at: text(p, at + 1, be(p, at, 1))
        after = lambda at: at + 1 + be(p, at, 1)
        first = F.lit(13)
        tag = F.lit(11)
        where = F.when(publish, first).when(deliver, after(tag) + 9)
        queue = short(first)
        return {
            "amqp_protocol_version": when(hello, F.concat_ws(".", *(be(p, k, 1) for k in (5, 6, 7)))),
            "amqp_frame_type": F.when(hello, "PROTOCOL_HEADER").when(frame, name_of(be(p, 0, 1), AMQP_FRAMES)),
            "amqp_channel": when(frame, number(be(p, 1, 2))),
            "amqp_method": when(call, name_of(method, AMQP_METHODS)),
            "amqp_consumer_tag": when(deliver & fits(tag), short(tag)),
            "amqp_exchange": when(where.isNotNull() & fits(where), short(where)),
            "amqp_routing_key": when(where.isNotNull() & fits(where) & fits(after(where)), short(after(where))),
            "amqp_queue": when(declare & fits(first), F.when(queue == "", "(server-generated)").otherwise(queue)),
        }


@dissector("MySQL", "mysql", 60, "TCP", (3306,), (0.6, 0.9))
class MySql:
    def detect(p, port, l4):
        return (length(p) >= 5) & (be(p, 3, 1) == 0) & (be(p, 4, 1) == 10) & (le(p, 0, 3) + 4 <= length(p) + 32)

    def fields(p, port, l4):
        ten = be(p, 4, 1) == 10
        version = between_zeros(p, 5)
        at = F.length(version) + 6
        return {
            "mysql_packet_length": number(le(p, 0, 3)),
            "mysql_sequence_id": number(be(p, 3, 1)),
            "mysql_protocol_version": when(ten, F.lit("10")),
            "mysql_server_version": when(ten, version),
            "mysql_connection_id": when(ten & (at + 4 <= length(p)), number(le(p, at, 4))),
            "mysql_capability_flags_lower": when(ten & (at + 15 <= length(p)), as_hex(le(p, at + 13, 2), 4)),
        }


@dissector("PostgreSQL", "postgresql", 61, "TCP", (5432,), (0.6, 0.9))
class Postgres:
    def detect(p, port, l4):
        v = be(p, 4, 4)
        return (length(p) >= 8) & ((v == 196608) | (F.floor(v / 65536) == 1234)) & (be(p, 0, 4) >= 8) & (be(p, 0, 4) <= length(p) + 64)

    def fields(p, port, l4):
        major, minor = be(p, 4, 2), be(p, 6, 2)
        special = major == 1234
        words = F.split(text(p, 8, length(p)), "\0", -1)
        # names and values in turn, up to an empty name; an unfinished pair doesn't count
        pairs = F.filter(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(F.get(words, 2 * i).alias("k"), F.get(words, 2 * i + 1).alias("v"), (2 * i + 2 < F.size(words)).alias("ok"))), lambda x: x["k"].isNotNull())
        stop = F.array_position(F.transform(pairs, lambda x: x["k"]), "")
        used = F.filter(F.when(stop > 0, F.slice(pairs, F.lit(1), (stop - 1).cast("int"))).otherwise(pairs), lambda x: x["ok"])
        value = lambda k: F.get(F.filter(used, lambda x: x["k"] == k), F.lit(0))["v"]
        return {
            "postgresql_message_length": number(be(p, 0, 4)),
            "postgresql_message_type": F.when(special, name_of(minor, POSTGRES_SPECIAL, "UnknownSpecialRequest")).otherwise("StartupMessage"),
            "postgresql_protocol_version": when(~special, F.concat_ws(".", major, minor)),
            "postgresql_user": when(~special, value("user")),
            "postgresql_database": when(~special, value("database")),
        }


@dissector("TDS", "tds", 62, "TCP", (1433,), (0.6, 0.9))
class Tds:
    def detect(p, port, l4):
        return (length(p) >= 8) & be(p, 0, 1).isin(*TDS_TYPES) & (be(p, 1, 1) < 4) & (be(p, 2, 2) >= 8) & (be(p, 2, 2) <= length(p) + 64)

    def fields(p, port, l4):
        body, pre = cut(p, 8, length(p)), be(p, 0, 1).isin(4, 18)
        tokens = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(be(body, i * 5, 1).alias("t"), be(body, i * 5 + 1, 2).alias("at"), be(body, i * 5 + 3, 2).alias("n"), (i * 5 + 5 <= length(body)).alias("ok")))
        stop = F.array_position(F.transform(tokens, lambda x: F.coalesce((x["t"] == 255) | ~x["ok"], F.lit(True))), True)
        used = F.when(stop > 0, F.slice(tokens, F.lit(1), (stop - 1).cast("int"))).otherwise(tokens)
        base = {"tds_type": name_of(be(p, 0, 1), TDS_TYPES), "tds_eom": flag(be(p, 1, 1), 1), "tds_length": number(be(p, 2, 2)), "tds_spid": number(be(p, 4, 2)), "tds_packet_id": number(be(p, 6, 1))}
        return base | {"*": when(pre, bind(used, lambda x: Tds._tokens(body, x)))}

    def _tokens(body, used):
        v = F.get(F.filter(used, lambda x: (x["t"] == 0) & (x["n"] >= 4) & (x["at"] + 4 <= length(body))), F.lit(0))["at"]
        out = {"tds_prelogin_server_version": when(v.isNotNull(), F.concat_ws(".", be(body, v, 1), F.lpad(be(body, v + 1, 1).cast("string"), 2, "0"), be(body, v + 2, 2)))}
        for i in range(16):
            x = F.get(used, F.lit(i))
            out[f"tds_prelogin_token_{i}_name"] = when(x.isNotNull(), name_of(x["t"], TDS_TOKENS, "unknown"))
        return field_map(out)


@dissector("NetBIOS", "netbios", 42, "UDP", (137, 138))
class NetBios:
    def detect(p, port, l4):
        return F.when((port == 137) & (length(p) >= 12), 0.85).when((port == 138) & (length(p) >= 14) & be(p, 0, 1).between(0x10, 0x16), 0.85).otherwise(0.0)

    def _name(p, at):
        """(name, suffix) of a first-level encoded name: two letters A to P for each byte."""
        ok = (be(p, at, 1) == 32) & text(p, at + 1, 32).rlike("^[A-P]{32}$")
        plain = F.unhex(F.translate(text(p, at + 1, 32), "ABCDEFGHIJKLMNOP", "0123456789ABCDEF"))
        return F.when(ok, F.regexp_replace(text(plain, 0, 15), " +$", "")), F.when(ok, as_hex(be(plain, 15, 1), 2))

    def fields(p, port, l4):
        ns, ds = port == 137, (port == 138) & (length(p) >= 14)
        flags = be(p, 2, 2)
        name, suffix = NetBios._name(p, 12)
        asks = ns & (be(p, 4, 2) > 0)
        source, target = NetBios._name(p, 14)[0], NetBios._name(p, 47)[0]
        direct = ds & be(p, 0, 1).between(0x10, 0x12)
        return {
            "nbns_opcode": when(ns, name_of(bits(flags, 11, 15), NBNS_OPCODES)),
            "nbns_is_response": when(ns, flag(flags, 0x8000)),
            "nbns_name": when(asks, name),
            "nbns_name_suffix": when(asks, suffix),
            "nbds_msg_type": when(ds, name_of(be(p, 0, 1), NBDS_TYPES)),
            "nbds_source_ip": when(ds, ipv4(p, 4)),
            "nbds_source_name": when(direct, source),
            "nbds_destination_name": when(direct & source.isNotNull(), target),
        }


@dissector("WoW", "wow", 52, "TCP", (3724,))
class Wow:
    def detect(p, port, l4):
        return F.when((length(p) >= 6) & (be(p, 0, 2) == length(p) - 2) & (port == 3724), 0.5).otherwise(0.0)

    def fields(p, port, l4):
        ok = length(p) >= 10
        session = ok & (le(p, 2, 4) == 493)
        name = F.regexp_extract(text(p, 10, length(p)), r"([\x20-\x7e]{3,})\x00", 1)
        return {
            "wow_opcode": when(ok, F.when(session, "CMSG_AUTH_SESSION").otherwise("Unknown")),
            "wow_client_build": when(session, number(le(p, 6, 4))),
            "wow_account_name": when(session & (name != ""), name),
        }


@dissector("serialnumberd", "serialnumberd", 63, "UDP", (626,), (0.7, 0.9))
class SerialNumber:
    def detect(p, port, l4):
        return (length(p) >= 9) & (text(p, 0, 8) == "SNQUERY:")

    def fields(p, port, l4):
        parts = F.split(text(p, 8, length(p)), ":", -1)
        # a separator at the very end opens no further field
        last = F.size(parts) - 1
        part = lambda i: F.when((last >= i) & ((F.lit(i) < last) | (F.get(parts, F.lit(i)) != "")), F.get(parts, F.lit(i)))
        return {"serialnumberd_message_type": F.lit("SNQUERY"), "serialnumberd_hostname": part(0), "serialnumberd_token": part(1), "serialnumberd_suffix": part(2)}
