"""Round-trip queries: payloads built from columns of ``lineitem``, dissected, and compared with the columns.

A case says how to build the bytes (in Spark) and what each field must be (in
plain SQL over the same columns), so that another engine can tell the expected
result without knowing the protocol.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.plans.registry import REGISTRY, dissect_as, dissectors

# values of a row that fit 16, 16, 8, 3 and 32 bits
A, B, C, W, Q = "(l_orderkey % 65536)", "(l_partkey % 65536)", "(l_suppkey % 256)", "l_linenumber", "((l_orderkey * 7919 + l_partkey) % 4294967296)"
HOST = "concat('h', l_suppkey, '.example.org')"


def n8(x) -> str:
    return f"lpad(hex(cast({x} as bigint)), 2, '0')"


def n16(x) -> str:
    return f"lpad(hex(cast({x} as bigint)), 4, '0')"


def n24(x) -> str:
    return f"lpad(hex(cast({x} as bigint)), 6, '0')"


def n32(x) -> str:
    return f"lpad(hex(cast({x} as bigint)), 8, '0')"


def le16(x) -> str:
    return f"concat({n8(f'({x}) % 256')}, {n8(f'cast(floor(({x}) / 256) as bigint)')})"


def le32(x) -> str:
    return "concat(" + ", ".join(n8(f"cast(floor(({x}) / {256**k}) as bigint) % 256") for k in range(4)) + ")"


def raw(x: str) -> str:
    return f"'{x.replace(' ', '')}'"


def txt(x: str) -> str:
    """Bytes of a text expression."""
    return f"hex({x})"


def sized(x: str, width: int = 1) -> str:
    """A text behind its length."""
    return f"concat(lpad(hex(cast(length({x}) as bigint)), {2 * width}, '0'), hex({x}))"


def say(s: str) -> str:
    """Bytes of a fixed text; \\r, \\n and \\0 are written so."""
    return raw(s.encode().decode("unicode_escape").encode("latin-1").hex())


# what the fields must be, in SQL that DuckDB reads
def s(x) -> str:
    return f"cast({x} as varchar)"


def x(value, digits: int) -> str:
    return f"printf('0x%0{digits}x', {value})"


def hx(value, digits: int) -> str:
    return f"printf('%0{digits}x', {value})"


def ip(v) -> str:
    return f"printf('%d.%d.%d.%d', ({v}) // 16777216, (({v}) // 65536) % 256, (({v}) // 256) % 256, ({v}) % 256)"


def k(text: str) -> str:
    return f"'{text}'"


def yes(test: str) -> str:
    return f"case when {test} then 'true' else 'false' end"


MAC_RAW = ["'0200'", n32(Q)]
MAC = f"printf('02:00:%02x:%02x:%02x:%02x', {Q} // 16777216, ({Q} // 65536) % 256, ({Q} // 256) % 256, {Q} % 256)"
#: An IPv4 header and a UDP datagram of ten bytes inside, between the addresses Q and 10.0.0.1.
UDP_IN_IP = [raw("4500001e00004000401100000a000001"), n32(Q), n16(A), n16(B), raw("000a0000"), raw("abcd")]
#: An IPv6 header with a UDP datagram.
UDP_IN_IP6 = [raw("60000000000a1140" + "20010db8" + "00" * 11 + "01" + "20010db8" + "00" * 8), n32(Q), n16(A), n16(B), raw("000a0000"), raw("abcd")]
IP6 = f"concat('2001:db8::', case when {Q} >= 65536 then printf('%x:', {Q} // 65536) else '' end, printf('%x', {Q} % 65536))"


@dataclass(frozen=True)
class Case:
    protocol: str
    port: int
    parts: list[str]
    fields: dict[str, str]
    score: float


def _inner(prefix: str, six: bool = False) -> dict[str, str]:
    out = {f"{prefix}_src_ip": k("2001:db8::1" if six else "10.0.0.1"), f"{prefix}_protocol": k("UDP"), f"{prefix}_dst_port": s(B)}
    return out | ({} if six else {f"{prefix}_dst_ip": ip(Q)})


DNS_HEAD = [n16(A), raw("8180 0001 0001 0000 0000"), sized(f"concat('h', {C})"), sized("'example'"), sized("'org'"), raw("00 0001 0001")]
_HTTP = f"concat('GET /p/', l_orderkey, ' HTTP/1.1', chr(13), chr(10), 'Host: ', {HOST}, chr(13), chr(10), 'User-Agent: u', l_linenumber, chr(13), chr(10), chr(13), chr(10), 'body')"
_CRLF = ", chr(13), chr(10), "
_SECURE = ["'160301'", n16(f"length({HOST}) + 60"), "'01'", n24(f"length({HOST}) + 56"), raw("0303" + "11" * 32 + "00" + "0002" + "1301" + "01" + "00"), n16(f"length({HOST}) + 13"), raw("0017 0000"), raw("0000"), n16(f"length({HOST}) + 5"), n16(f"length({HOST}) + 3"), raw("00"), sized(HOST, 2)]

CASES: dict[str, Case] = {
    "modbus": Case("Modbus", 502, [n16(A), raw("0000 0006"), n8(W), raw("03"), n16(B), n16(C)], {"modbus_transaction_id": s(A), "modbus_unit_id": s(W), "modbus_function": k("Read Holding Registers"), "modbus_request_start_address": s(B), "modbus_request_quantity": s(C)}, 0.9),
    "rtp": Case("RTP", 5004, [raw("80"), n8(f"96 + {W}"), n16(A), n32(Q), n32(f"{Q} % 1000"), raw("00")], {"rtp_payload_type": s(f"96 + {W}"), "rtp_sequence_number": s(A), "rtp_timestamp": s(Q), "rtp_ssrc": x(f"{Q} % 1000", 8), "rtp_marker": k("false")}, 0.5),
    "ntp": Case("NTP", 123, [raw("23"), n8(W), raw("00" * 10), n32(Q), raw("00" * 32)], {"ntp_version": k("4"), "ntp_mode": k("Client"), "ntp_stratum": s(W), "ntp_reference_id_hex": hx(Q, 8)}, 0.9),
    "dnp3": Case("DNP3", 20000, [raw("0564 08 c4"), le16(A), le16(B), raw("0000 c1 c2 01")], {"dnp3_direction": k("master_to_outstation"), "dnp3_link_function": k("UNCONFIRMED_USER_DATA"), "dnp3_destination": s(A), "dnp3_source": s(B), "dnp3_transport_sequence": k("1"), "dnp3_app_function": k("READ")}, 0.9),
    "esp": Case("ESP", 0, [n32(Q), n32(A), raw("00" * 8)], {"esp_spi": x(Q, 8), "esp_sequence": s(A)}, 0.85),
    "hsrp": Case("HSRP", 1985, [raw("00 00 10"), n8(W), raw("0a"), n8(C), raw("01"), raw("00" * 9), n32(Q)], {"hsrp_recognized_version": k("v1"), "hsrp_state": k("Active"), "hsrp_hellotime": s(W), "hsrp_priority": s(C), "hsrp_virtual_ip": ip(Q)}, 0.9),
    "isakmp": Case("ISAKMP", 500, [raw("00000000"), n32(Q), raw("00" * 8), raw("21 20 22 08"), n32(A), raw("0000001c")], {"isakmp_initiator_spi": hx(Q, 16), "isakmp_version": k("2.0"), "isakmp_exchange_type": k("IKE_SA_INIT / New Group Mode"), "isakmp_message_id": s(A)}, 0.9),
    "icmp": Case("ICMP", 0, [raw("0800 0000"), n16(A), n16(B)], {"icmp_type": k("Echo Request"), "icmp_echo_identifier": s(A), "icmp_echo_sequence": s(B), "icmp_checksum_valid": yes(f"65535 - ((2048 + {A} + {B}) % 65536 + (2048 + {A} + {B}) // 65536) = 0")}, 0.9),
    "icmpv6": Case("ICMPv6", 0, [raw("8000 0000"), n16(A), n16(B)], {"icmpv6_type": k("Echo Request"), "icmpv6_echo_identifier": s(A), "icmpv6_echo_sequence": s(B)}, 0.9),
    "arp": Case("ARP", 0, [raw("0001 0800 06 04 0001"), *MAC_RAW, n32(Q), raw("00" * 6), raw("0a000001")], {"arp_opcode": k("Request"), "arp_sender_mac": MAC, "arp_sender_ip": ip(Q), "arp_target_ip": k("10.0.0.1"), "arp_gratuitous": f"case when {Q} = 167772161 then 'true' end"}, 0.95),
    "igmp": Case("IGMP", 0, [raw("11"), n8(C), raw("0000"), n32(Q)], {"igmp_type": k("Membership Query"), "igmp_max_resp_time": s(C), "igmp_group_address": ip(Q)}, 0.9),
    "ospf": Case("OSPF", 0, [raw("02 01 0030"), n32(Q), raw("00000001 0000 0000" + "00" * 8), raw("ffffff00"), n16(A), raw("00"), n8(C), n32(B), raw("00" * 8), n32(Q)], {"ospf_type": k("Hello"), "ospf_router_id": ip(Q), "ospf_hello_interval": s(A), "ospf_hello_priority": s(C), "ospf_hello_dead_interval": s(B), "ospf_hello_neighbor_count": k("1"), "ospf_hello_neighbor_0": ip(Q)}, 0.9),
    "rip": Case("RIP", 520, [raw("02 02 0000 0002 0000"), n32(Q), raw("ffffff00 00000000"), n32(W)], {"rip_command": k("Response"), "rip_entry_count": k("1"), "rip_entry_0_prefix": f"concat({ip(Q)}, '/255.255.255.0')", "rip_entry_0_metric": s(W)}, 0.9),
    "s7comm": Case("S7comm", 102, [raw("0300 0013 02 f0 80 32 01 0000"), n16(A), raw("0002 0000 04 01")], {"s7comm_rosctr": k("Job Request"), "s7comm_pdu_reference": s(A), "s7comm_function_code": k("Read Var")}, 0.9),
    "smb1": Case("SMB1", 445, [raw("000000ff ff534d42 72"), le32(Q), raw("00" * 15), le16(A), le16(B), le16(C), le16(W), raw("00 0a00 02"), say("NT LM 0\\0")], {"smb1_command": k("Negotiate Protocol"), "smb1_status": x(Q, 8), "smb1_tid": s(A), "smb1_pid": s(B), "smb1_mid": s(W)}, 0.9),
    "tftp": Case("TFTP", 69, [raw("0001"), txt("concat('f', l_orderkey)"), raw("00"), say("octet\\0")], {"tftp_opcode": k("RRQ"), "tftp_filename": "concat('f', l_orderkey)", "tftp_mode": k("octet")}, 0.85),
    "wol": Case("WoL", 9, [raw("ff" * 6), *(MAC_RAW * 16)], {"wol_target_mac": MAC}, 0.95),
    "openvpn": Case("OpenVPN", 1194, [n8(f"56 + {W}"), raw("00" * 8)], {"openvpn_opcode": k("P_CONTROL_HARD_RESET_CLIENT_V2"), "openvpn_key_id": s(W)}, 0.85),
    "socks4": Case("SOCKS4", 1080, [raw("04 01"), n16(A), raw("00000001"), txt("concat('u', l_suppkey)"), raw("00"), txt(HOST), raw("00")], {"socks4_command": k("CONNECT"), "socks4_dst_port": s(A), "socks4_userid": "concat('u', l_suppkey)", "socks4a_dst_hostname": HOST}, 0.85),
    "socks5": Case("SOCKS5", 1080, [raw("05 01 00 03"), sized(HOST), n16(A)], {"socks5_message_type": k("request"), "socks5_command": k("CONNECT"), "socks5_dst_addr": HOST, "socks5_dst_port": s(A)}, 0.85),
    "vxlan": Case("VXLAN", 4789, [raw("08000000"), n24(f"{Q} % 16777216"), raw("00")], {"vxlan_vni": s(f"{Q} % 16777216"), "vxlan_vni_valid": k("true")}, 0.85),
    "geneve": Case("Geneve", 6081, [raw("00 80 6558"), n24(f"{Q} % 16777216"), raw("00")], {"geneve_control_packet": k("true"), "geneve_inner_is_ethernet": k("true"), "geneve_vni": s(f"{Q} % 16777216")}, 0.8),
    "mobileip": Case("MobileIP", 434, [raw("01 42"), n16(A), n32(Q), raw("0a000001 0a000002"), raw("00" * 8)], {"mobileip_flag_broadcast": k("true"), "mobileip_lifetime_sec": s(A), "mobileip_home_address": ip(Q), "mobileip_care_of_address": k("10.0.0.2")}, 0.8),
    "pptp": Case("PPTP", 1723, [n16(A), raw("0001 1a2b3c4d"), n16(W), raw("0000")], {"pptp_length": s(A), "pptp_control_message_type": f"case {W} " + "".join(f"when {i} then '{v}' " for i, v in ((1, "Start-Control-Connection-Request"), (2, "Start-Control-Connection-Reply"), (3, "Stop-Control-Connection-Request"), (4, "Stop-Control-Connection-Reply"), (5, "Echo-Request"), (6, "Echo-Reply"), (7, "Outgoing-Call-Request"))) + "end"}, 0.95),
    "teredo": Case("Teredo", 3544, [raw("0000"), n16(A), n32(Q)], {"teredo_origin_port": s(f"65535 - {A}"), "teredo_origin_ipv4": ip(f"4294967295 - {Q}")}, 0.8),
    "mqtt": Case("MQTT", 1883, [raw("32"), n8("length(concat('t/', l_orderkey)) + 4"), sized("concat('t/', l_orderkey)", 2), n16(A)], {"mqtt_message_type": k("PUBLISH"), "mqtt_qos": k("1"), "mqtt_topic_name": "concat('t/', l_orderkey)"}, 0.85),
    "amqp": Case("AMQP", 5672, [raw("01"), n16(A), n32("length(concat('ex', l_suppkey)) + length(concat('rk', l_orderkey)) + 8"), raw("003c 0028 0000"), sized("concat('ex', l_suppkey)"), sized("concat('rk', l_orderkey)"), raw("ce")], {"amqp_frame_type": k("METHOD"), "amqp_channel": s(A), "amqp_method": k("Basic.Publish"), "amqp_exchange": "concat('ex', l_suppkey)", "amqp_routing_key": "concat('rk', l_orderkey)"}, 0.9),
    "mysql": Case("MySQL", 3306, [raw("200000 00 0a"), txt("concat('8.0.', l_linenumber)"), raw("00"), le32(Q), raw("00" * 9), le16(A)], {"mysql_server_version": "concat('8.0.', l_linenumber)", "mysql_connection_id": s(Q), "mysql_capability_flags_lower": x(A, 4)}, 0.9),
    "postgresql": Case("PostgreSQL", 5432, [n32("length(concat('u', l_suppkey)) + length(concat('d', l_orderkey)) + 25"), raw("00030000"), say("user\\0"), txt("concat('u', l_suppkey)"), say("\\0database\\0"), txt("concat('d', l_orderkey)"), raw("0000")], {"postgresql_message_type": k("StartupMessage"), "postgresql_user": "concat('u', l_suppkey)", "postgresql_database": "concat('d', l_orderkey)"}, 0.9),
    "tds": Case("TDS", 1433, [raw("12 01 0020"), n16(A), n8(W), raw("00"), raw("00 000b 0006 01 0011 0001 ff"), n8(W), raw("02"), n16(B), raw("0000 02")], {"tds_type": k("PRELOGIN"), "tds_spid": s(A), "tds_packet_id": s(W), "tds_prelogin_server_version": f"concat({W}, '.02.', {B})", "tds_prelogin_token_1_name": k("encryption")}, 0.9),
    "netbios": Case("NetBIOS", 137, [n16(A), raw("2900 0001 0000 0000 0000 20"), f"hex(concat(translate(hex(concat('HOST', {W})), '0123456789ABCDEF', 'ABCDEFGHIJKLMNOP'), repeat('CA', 10), 'CA'))", raw("00")], {"nbns_opcode": k("Registration"), "nbns_is_response": k("false"), "nbns_name": f"concat('HOST', {W})", "nbns_name_suffix": k("0x20")}, 0.85),
    "wow": Case("WoW", 3724, [n16("length(concat('ACC', l_orderkey)) + 9"), raw("ed010000"), le32(A), txt("concat('ACC', l_orderkey)"), raw("00")], {"wow_opcode": k("CMSG_AUTH_SESSION"), "wow_client_build": s(A), "wow_account_name": f"case when {A} >= 0 then concat('ACC', l_orderkey) end"}, 0.5),
    "serialnumberd": Case("serialnumberd", 626, [say("SNQUERY:"), txt(HOST), say(":"), txt("concat('t', l_orderkey)"), say(":x")], {"serialnumberd_hostname": HOST, "serialnumberd_token": "concat('t', l_orderkey)", "serialnumberd_suffix": k("x")}, 0.9),
    "http1": Case("HTTP/1.1", 80, [txt(_HTTP)], {"http_method": k("GET"), "http_path": "concat('/p/', l_orderkey)", "http_host": HOST, "http_user_agent": "concat('u', l_linenumber)", "http_body_preview": k("body"), "http_body_length": k("4")}, 0.9),
    "sip": Case("SIP", 5060, [txt(f"concat('INVITE sip:x SIP/2.0'{_CRLF}'i: ', l_orderkey{_CRLF}'From: <sip:', l_suppkey, '>'{_CRLF}'t: <sip:', l_partkey, '>'{_CRLF}chr(13), chr(10))")], {"sip_method": k("INVITE"), "sip_call_id": s("l_orderkey"), "sip_from": "concat('<sip:', l_suppkey, '>')", "sip_to": "concat('<sip:', l_partkey, '>')"}, 0.9),
    "rtsp": Case("RTSP", 554, [txt(f"concat('SETUP rtsp://h/', l_orderkey, ' RTSP/1.0'{_CRLF}'CSeq: ', l_linenumber{_CRLF}'Session: ', l_partkey{_CRLF}chr(13), chr(10))")], {"rtsp_method": k("SETUP"), "rtsp_url": "concat('rtsp://h/', l_orderkey)", "rtsp_cseq": s("l_linenumber"), "rtsp_session": s("l_partkey")}, 0.9),
    "smtp": Case("SMTP", 25, [txt(f"concat('EHLO ', {HOST}{_CRLF}'MAIL FROM:<a', l_suppkey, '@x>'{_CRLF}'RCPT TO:<b', l_partkey, '@y>'{_CRLF}'DATA'{_CRLF}'Subject: s', l_orderkey{_CRLF}chr(13), chr(10))")], {"smtp_ehlo_domain": HOST, "smtp_mail_from": "concat('<a', l_suppkey, '@x>')", "smtp_rcpt_to": "concat('<b', l_partkey, '@y>')", "smtp_data_command_seen": k("true"), "smtp_message_subject": "concat('s', l_orderkey)", "smtp_message_body_begins": k("true")}, 0.9),
    "ftp": Case("FTP", 21, [txt(f"concat('USER u', l_suppkey{_CRLF}'PASS x'{_CRLF}'RETR f', l_orderkey{_CRLF}'AUTH TLS'{_CRLF}'')")], {"ftp_command": k("AUTH"), "ftp_user_arg": "concat('u', l_suppkey)", "ftp_retr_arg": "concat('f', l_orderkey)", "ftp_password_present": k("true"), "ftp_auth_tls_requested": k("true")}, 0.75),
    "pop3": Case("POP3", 110, [txt("concat('RETR ', l_orderkey, chr(13), chr(10))")], {"pop3_command": k("RETR"), "pop3_retr_arg": s("l_orderkey")}, 0.8),
    "msnp": Case("MSNP", 1863, [txt(f"concat('MSG u', l_suppkey, '@x.org n ', l_orderkey{_CRLF}'Content-Type: text/t', l_linenumber{_CRLF}chr(13), chr(10))")], {"msnp_command": k("MSG"), "msnp_msg_sender_email": "concat('u', l_suppkey, '@x.org')", "msnp_msg_length": s("l_orderkey"), "msnp_msg_content_type": "concat('text/t', l_linenumber)"}, 0.8),
    "ssdp": Case("SSDP", 1900, [txt(f"concat('NOTIFY * HTTP/1.1'{_CRLF}'NT: n', l_linenumber{_CRLF}'USN: uuid:', l_orderkey{_CRLF}'Location: http://', {HOST}{_CRLF}chr(13), chr(10))")], {"ssdp_method": k("NOTIFY"), "ssdp_nt": "concat('n', l_linenumber)", "ssdp_usn": "concat('uuid:', l_orderkey)", "ssdp_location": f"concat('http://', {HOST})"}, 0.9),
    "syslog": Case("Syslog", 514, [txt(f"concat('<', {C} % 192, '>1 m', l_orderkey)")], {"syslog_pri": s(f"{C} % 192"), "syslog_severity": f"['Emergency','Alert','Critical','Error','Warning','Notice','Informational','Debug'][({C} % 192) % 8 + 1]", "syslog_rfc5424": k("true"), "syslog_message_preview": "concat('1 m', l_orderkey)", "syslog_message_count": k("1")}, 0.85),
    "whois": Case("WHOIS", 43, [txt(f"concat({HOST}, chr(13), chr(10))")], {"whois_query": HOST}, 0.75),
    "xmpp": Case("XMPP", 5222, [txt(f"concat('<?xml version=\"1.0\"?><stream:stream to=\"', {HOST}, '\" from=\"u', l_suppkey, '\">')")], {"xmpp_stream_to": HOST, "xmpp_stream_from": "concat('u', l_suppkey)", "xmpp_is_response": k("true")}, 0.9),
    "ssh": Case("SSH", 22, [txt("concat('SSH-2.0-Srv_', l_linenumber, ' c', chr(13), chr(10))"), n32("length(concat('kex', l_suppkey)) + 50"), raw("00 14" + "00" * 16), sized("concat('kex', l_suppkey)", 4), raw("00000000" * 7)], {"ssh_protocol_version": k("2.0"), "ssh_software_version": "concat('Srv_', l_linenumber)", "ssh_kexinit_present": k("true"), "ssh_kex_algorithms": "concat('kex', l_suppkey)"}, 0.9),
    "radius": Case("RADIUS", 1812, [raw("01"), n8(C), n16("length(concat('u', l_orderkey)) + 28"), raw("00" * 16), raw("01"), n8("length(concat('u', l_orderkey)) + 2"), txt("concat('u', l_orderkey)"), raw("04 06"), n32(Q)], {"radius_code": k("Access-Request"), "radius_identifier": s(C), "user_name": "concat('u', l_orderkey)", "nas_ip_address": ip(Q)}, 0.9),
    "dhcp": Case("DHCP", 67, [raw("01" + "00" * 235 + "63825363"), raw("35 01 03 32 04"), n32(Q), raw("0c"), sized("concat('h', l_orderkey)"), raw("52 04 01 02"), raw("4142"), raw("ff")], {"dhcp_op": k("BOOTREQUEST"), "dhcp_message_type": k("DHCPREQUEST"), "dhcp_requested_ip": ip(Q), "dhcp_hostname": "concat('h', l_orderkey)", "dhcp_relay_agent_circuit_id": k("AB")}, 0.9),
    "dhcpv6": Case("DHCPv6", 547, [raw("01"), n24(f"{Q} % 16777216"), raw("0008 0002"), n16(A), raw("0001 0000")], {"dhcp6_message_type": k("SOLICIT"), "dhcp6_transaction_id": x(f"{Q} % 16777216", 6), "dhcp6_options_count": k("2"), "dhcp6_first_option_code": k("8")}, 0.85),
    "stun": Case("STUN", 3478, [raw("0101 000c 2112a442"), raw("00" * 8), n32(Q), raw("0020 0008 0001"), n16(A), n32(Q)], {"stun_message_type": k("Binding Success Response"), "stun_transaction_id": hx(Q, 24), "stun_xor_mapped_port": s(f"xor({A}, 8466)"), "stun_xor_mapped_address": ip(f"xor({Q}, 554869826)")}, 0.95),
    "lldp": Case("LLDP", 0, [raw("0207 04"), *MAC_RAW, raw("0403 05"), raw("6531"), raw("0602"), n16(A), raw("0a"), sized("concat('sw', l_suppkey)"), raw("0000")], {"lldp_chassis_id_mac": MAC, "lldp_port_id": k("e1"), "lldp_ttl": s(A), "lldp_system_name": "concat('sw', l_suppkey)"}, 0.85),
    "eigrp": Case("EIGRP", 0, [raw("02 05 0000 00000001"), n32(Q), n32(A), raw("0000"), n16(B), raw("0001 000c 0000000000000000")], {"eigrp_opcode": k("Hello"), "eigrp_init_flag": k("true"), "eigrp_sequence": s(Q), "eigrp_ack": s(A), "eigrp_asn": s(B), "eigrp_first_tlv_type": k("0x0001"), "eigrp_tlv_count": k("1")}, 0.9),
    "pim": Case("PIM", 0, [raw("20 00 0000 0001 0002"), n16(A), raw("0014 0004"), n16(f"{B} % 32768"), n16(C)], {"pim_type": k("Hello"), "pim_hello_holdtime_sec": s(A), "pim_hello_propagation_delay_ms": s(f"{B} % 32768"), "pim_hello_override_interval_ms": s(C)}, 0.8),
    "m3ua": Case("M3UA", 3, [raw("01 00 01 01 0000001c 0200 0008"), n32(Q), raw("0210 0009"), n32(A), raw("05 000000")], {"m3ua_message": k("Transfer/DATA"), "m3ua_network_appearance": x(Q, 8), "m3ua_protocol_data_hex": f"concat({hx(A, 8)}, '05')"}, 0.9),
    "m2ua": Case("M2UA", 2, [raw("01 00 06 01 00000018 0001 0008"), n32(Q), raw("0300 0008"), n32(A)], {"m2ua_message": k("MAUP/Data"), "m2ua_interface_id": s(Q), "m2ua_mtp2_data_hex": hx(A, 8)}, 0.85),
    "sctp": Case("SCTP", 0, [n16(A), n16(B), n32(Q), raw("00000000 00 03 0020"), n32(Q), n16(W), n16(C), raw("00000003"), raw("01 00 01 01 00000010 0006 0008"), n32(A)], {"sctp_src_port": s(A), "sctp_dst_port": s(B), "sctp_chunk_0_type": k("DATA"), "sctp_chunk_0_tsn": s(Q), "sctp_chunk_0_stream_id": s(W), "sctp_chunk_0_ppid": k("M3UA"), "sctp_chunk_0_inner_protocol": k("M3UA")}, 0.85),
    "ldp": Case("LDP", 646, [raw("0001 0022"), n32(Q), raw("0000 0400 0018 00000001 0100 0008 02 0001 18"), n24(f"{Q} % 16777216"), raw("00 0200 0004"), n32(f"{Q} % 1048576")], {"ldp_router_id": ip(Q), "ldp_message_type": k("Label Mapping"), "ldp_label_mapping_fec": f"concat(printf('%d.%d.%d.0', ({Q} // 65536) % 256, ({Q} // 256) % 256, {Q} % 256), '/24')", "ldp_label_mapping_label": s(f"{Q} % 1048576"), "ldp_message_count": k("1")}, 0.9),
    "bgp": Case("BGP", 179, [raw("ff" * 16 + "001d 01 04"), n16(A), n16(B), n32(Q), raw("00"), raw("ff" * 16 + "0015 03"), n8(W), n8(C)], {"bgp_type": k("OPEN"), "bgp_open_my_as": s(A), "bgp_open_hold_time": s(B), "bgp_open_router_id": ip(Q), "bgp_notification_error_code": s(W), "bgp_notification_error_subcode": s(C), "bgp_message_count": k("2")}, 0.95),
    "gre": Case("GRE", 0, [raw("3000 0800"), n32(Q), n32(A), *UDP_IN_IP], {"gre_key": x(Q, 8), "gre_sequence": s(A), "gre_protocol_type": k("0x0800"), **_inner("gre_inner")}, 0.9),
    "mpls": Case("MPLS", 0, [n24(f"({Q} % 1048576) * 16"), raw("40"), n24(f"{A} * 16 + 1"), raw("3f"), *UDP_IN_IP], {"mpls_stack_depth": k("2"), "mpls_top_label": s(f"{Q} % 1048576"), "mpls_bottom_label": s(A), "mpls_inner_dst_ip": ip(Q), "mpls_inner_dst_port": s(B)}, 0.9),
    "sixin4": Case("6in4", 0, UDP_IN_IP6, _inner("sixin4_inner", six=True), 0.9),
    "ah": Case("AH", 0, [raw("59 04 0000"), n32(Q), n32(A), raw("00" * 12), raw("02 01 002c"), n32(Q), raw("00" * 36)], {"ah_spi": x(Q, 8), "ah_sequence": s(A), "ah_next_header": k("89"), "ah_inner_protocol": k("OSPF"), "ah_inner_summary": k("Hello")}, 0.85),
    "l2tpv3": Case("L2TPv3", 0, [n32(Q), *MAC_RAW, *MAC_RAW, raw("0800"), *UDP_IN_IP], {"l2tpv3_session_id": x(Q, 8), "l2tpv3_inner_dst_mac": MAC, "l2tpv3_inner_dst_ip": ip(Q)}, 0.6),
    "gtp": Case("GTPv1-U", 2152, [raw("32 ff 0022"), n32(Q), n16(A), raw("0000"), *UDP_IN_IP], {"gtp_message_type": k("G-PDU"), "gtp_teid": x(Q, 8), "gtp_sequence_number": s(A), **_inner("gtp_inner")}, 0.9),
    "gtpv2": Case("GTPv2-C", 2123, [raw("48 20 0019"), n32(Q), n24(A), raw("00"), raw("01 0002 00 2143 03 0001 00"), n8(C), raw("48 0008 00"), n32(Q), n32(A)], {"gtpv2_message_type": k("Create Session Request"), "gtpv2_teid": x(Q, 8), "gtpv2_sequence_number": s(A), "gtpv2_ie_0_imsi": k("1234"), "gtpv2_ie_1_recovery": s(C), "gtpv2_ie_2_ambr_uplink_kbps": s(Q), "gtpv2_ie_count": k("3")}, 0.9),
    "dns": Case("DNS", 53, [*DNS_HEAD, raw("c00c 0001 0001 0000003c 0004"), n32(Q)], {"dns_is_response": k("true"), "dns_qname": f"concat('h', {C}, '.example.org')", "dns_qtype": k("1"), "dns_answer_0_a": ip(Q), "dns_answer_records_parsed": k("1")}, 0.85),
    "mdns": Case("mDNS", 5353, [*DNS_HEAD[:-1], raw("00 0001 8001"), raw("c00c 0001 0001 0000003c 0004"), n32(Q)], {"dns_qname": f"concat('h', {C}, '.example.org')", "mdns_qu_bit_requested": k("true"), "mdns_qclass_masked": k("1")}, 0.9),
    "snmp": Case("SNMP", 161, [raw("30"), n8("length(concat('c', l_suppkey)) + 31"), raw("02 01 01 04"), sized("concat('c', l_suppkey)"), raw("a2 18 02 04"), n32(f"{Q} % 2147483648"), raw("02 01 00 02 01 00 30 0a 30 08 06 02 2b 06 41 02"), n16(A)], {"snmp_version": k("v2c"), "snmp_community_string": "concat('c', l_suppkey)", "snmp_pdu_type": k("GetResponse"), "snmp_request_id": s(f"{Q} % 2147483648"), "snmp_varbind_0_oid": k("1.3.6"), "snmp_varbind_0_value": s(A), "snmp_varbind_count": k("1")}, 0.9),
    "ldap": Case("LDAP", 389, [raw("30"), n8("length(concat('cn=', l_orderkey)) + 14"), raw("02 02"), n16(f"{A} % 32768"), raw("60"), n8("length(concat('cn=', l_orderkey)) + 8"), raw("02 01 03 04"), sized("concat('cn=', l_orderkey)"), raw("80 01 78")], {"ldap_message_id": s(f"{A} % 32768"), "ldap_operation": k("BindRequest"), "ldap_bind_dn": "concat('cn=', l_orderkey)", "ldap_bind_credential_present": k("true"), "ldap_message_count": k("1")}, 0.9),
    "kerberos": Case("Kerberos", 88, [raw("00000009 7e 07 30 05 a6 03 02 01"), n8("18 + 6 * (l_linenumber % 2)")], {"kerberos_msg_type": k("KRB-ERROR"), "kerberos_error_code": s("18 + 6 * (l_linenumber % 2)"), "kerberos_error_name": "case when l_linenumber % 2 = 1 then 'KDC_ERR_PREAUTH_FAILED' else 'KDC_ERR_CLIENT_REVOKED' end"}, 0.9),
    "bt_dht": Case("BitTorrent-DHT", 6881, [say("d1:ad2:id4:"), n32(Q), say("e1:q4:ping1:t2:"), n16(A), say("1:y1:qe")], {"bt_dht_msg_type": k("query"), "bt_dht_transaction_id": hx(A, 4), "bt_dht_query": k("ping"), "bt_dht_node_id": hx(Q, 8)}, 0.9),
    "telnet": Case("Telnet", 23, [raw("fffb01 fffd18"), txt("concat('u', l_orderkey)")], {"telnet_negotiation_0": k("WILL Echo"), "telnet_negotiation_1": k("DO Terminal Type"), "telnet_negotiation_count": k("2"), "telnet_data_preview": "concat('u', l_orderkey)"}, 0.9),
    "http2": Case("HTTP/2", 443, [say("PRI * HTTP/2.0\\r\\n\\r\\nSM\\r\\n\\r\\n"), raw("000006 04 00 00000000 0001"), n32(A), n24(f"length({HOST}) + 5"), raw("01 05"), n32(f"2 * {W} + 1"), raw("82 84 87 41"), sized(HOST)], {"http2_preface_present": k("true"), "http2_settings_header_table_size": s(A), "http2_authority": HOST, "http2_method": k("GET"), "http2_frames_parsed": k("2"), "http2_max_stream_id": s(f"2 * {W} + 1")}, 0.95),
}


def payload_sql(case: Case) -> str:
    return f"unhex(concat({', '.join(case.parts)}))"


def roundtrip(name: str):
    """The query of a case: (spark, sf_dir) to the fields of every row."""
    case = CASES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        dissectors()
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.expr(payload_sql(case)).alias("payload"))
        known = REGISTRY[case.protocol]
        port, l4 = F.lit(case.port), F.lit(known.l4[0])
        got = rows.select("l_orderkey", "l_linenumber", dissect_as(case.protocol, F.col("payload"), port).alias("f"), F.round(known.detect(F.col("payload"), port, l4), 6).alias("score"))
        return got.select("l_orderkey", "l_linenumber", *(F.col("f")[f].alias(f) for f in case.fields), "score")

    return run


def roundtrip_sql(name: str) -> str:
    case = CASES[name]
    return "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{v} AS {f}" for f, v in case.fields.items()) + f", CAST({case.score} AS DOUBLE) AS score FROM lineitem"
