"""Dissectors of link-layer frames, outside the registry: payload to a map of fields, null if it isn't one.

``KINDS`` has them by the ``l3_kind`` of ``frames.decode_frames``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.functions.bytes import as_hex, be, bind, bits, cut, flag, from_item, hexed, ipv4, le, length, mac, name_of, number, text, tlvs
from flowloom.functions.tls import sni
from flowloom.operators.frames import parse_ipv4
from flowloom.operators.items import last
from flowloom.plans.registry import field_map

# Names of codes, from the protocols' specifications.
DOT11_TYPES = {0: "Management", 1: "Control", 2: "Data"}
DOT11_MANAGEMENT = {
    0: "Association Request", 1: "Association Response", 2: "Reassociation Request", 3: "Reassociation Response", 4: "Probe Request", 5: "Probe Response", 8: "Beacon", 10: "Disassociation", 11: "Authentication", 12: "Deauthentication",
    13: "Action",
}
DOT11_CONTROL = {8: "Block Ack Request", 9: "Block Ack", 11: "RTS", 12: "CTS", 13: "ACK"}
DOT11_DATA = {0: "Data", 4: "Null (no data)", 8: "QoS Data", 12: "QoS Null (no data)"}
EAPOL_TYPES = {0: "EAP-Packet", 1: "EAPOL-Start", 2: "EAPOL-Logoff", 3: "EAPOL-Key", 4: "EAPOL-Encapsulated-ASF-Alert"}
EAP_CODES = {1: "Request", 2: "Response", 3: "Success", 4: "Failure"}
EAP_TYPES = {1: "Identity", 2: "Notification", 3: "Nak", 4: "MD5-Challenge", 13: "EAP-TLS", 25: "PEAP", 26: "MS-EAP-Authentication", 43: "EAP-FAST"}
PPPOE_CODES = {0x09: "PADI", 0x07: "PADO", 0x19: "PADR", 0x65: "PADS", 0xA7: "PADT", 0x00: "Session_Data"}
PPP_PROTOCOLS = {0x0021: "IP", 0x0057: "IPv6", 0x002D: "VJ-Compressed-TCP", 0x002F: "VJ-Uncompressed-TCP", 0xC021: "LCP", 0xC023: "PAP", 0xC223: "CHAP", 0xC025: "LQR", 0x8021: "IPCP", 0x8057: "IPv6CP"}
LCP_CODES = {
    1: "Configure-Request", 2: "Configure-Ack", 3: "Configure-Nak", 4: "Configure-Reject", 5: "Terminate-Request", 6: "Terminate-Ack", 7: "Code-Reject", 8: "Protocol-Reject", 9: "Echo-Request", 10: "Echo-Reply", 11: "Discard-Request",
}
NSH_NEXT = {1: "IPv4", 2: "IPv6", 3: "Ethernet", 4: "NSH", 5: "MPLS"}


def _map(test: Column, fields: dict[str, Column]) -> Column:
    return F.when(test, field_map(fields))


def dot11(p: Column) -> Column:
    a, b = be(p, 0, 1), be(p, 1, 1)
    kind, sub = bits(a, 2, 3), bits(a, 4, 15)
    std = (kind != 1) & (length(p) >= 24)
    ok = (length(p) >= 10) & ((kind == 1) | std)
    body = cut(p, 24, length(p))
    sealed = b.bitwiseAND(F.lit(0x40)) != 0
    beacon, auth, data = std & (kind == 0) & (sub == 8), std & (kind == 0) & (sub == 11), std & (kind == 2) & (sub == 0)
    ssid = bind(body, lambda d: bind(last(tlvs(d, 12, length(d), kind=1, size=1), 0), lambda x: from_item(d, x, lambda e, at, n: text(e, at, n))))
    open_auth = auth & ~sealed & (length(body) >= 6)
    snap = data & ~sealed & (length(body) >= 8) & (hexed(body, 0, 6) == "aaaa03000000")
    ether, inner = be(body, 6, 2), cut(body, 8, length(body))
    arp = snap & (ether == 0x0806) & (length(inner) >= 28) & be(inner, 6, 2).between(1, 4) & (be(inner, 0, 2) == 1)
    packet = F.when(snap & (ether == 0x0800), bind(parse_ipv4(inner), _dot11_packet))
    return field_map(
        {
            "parse_warning": F.when(~ok, "dot11_header_too_short"),
            "dot11_type": F.when(ok, name_of(kind, DOT11_TYPES, "Reserved")),
            "dot11_subtype": F.when(ok, F.when(kind == 0, name_of(sub, DOT11_MANAGEMENT)).when(kind == 1, name_of(sub, DOT11_CONTROL)).otherwise(name_of(sub, DOT11_DATA))),
            "dot11_addr1": F.when(ok, mac(p, 4)),
            "dot11_addr2": F.when(std, mac(p, 10)),
            "dot11_addr3": F.when(std, mac(p, 16)),
            "dot11_seq_num": F.when(std, number(bits(le(p, 22, 2), 4, 0xFFF))),
            "dot11_beacon_ssid": F.when(beacon, ssid),
            "dot11_auth_encrypted": F.when(auth & sealed, "true"),
            "dot11_auth_algorithm": F.when(open_auth, name_of(le(body, 0, 2), {0: "Open System", 1: "Shared Key"})),
            "dot11_auth_seq": F.when(open_auth, number(le(body, 2, 2))),
            "dot11_auth_status": F.when(open_auth, number(le(body, 4, 2))),
            "dot11_data_encrypted": F.when(data & sealed, "true"),
            "dot11_data_arp_opcode": F.when(arp, name_of(be(inner, 6, 2), {1: "Request", 2: "Reply", 3: "RARP Request", 4: "RARP Reply"})),
            "dot11_data_arp_sender_ip": F.when(arp, ipv4(inner, 14)),
            "dot11_data_arp_target_ip": F.when(arp, ipv4(inner, 24)),
            "*": packet,
            "dot11_data_inner_protocol": F.when(snap & (ether == 0x86DD), "IPv6"),
        }
    )


def _dot11_packet(ip: Column) -> Column:
    """Fields of an IPv4 packet in a data frame: addresses, and what its TCP payload asks for."""

    def asked(data):
        t = text(data)
        http = t.rlike("^(?:GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH|CONNECT|TRACE) ")
        host = F.regexp_extract(t, r"(?i)\r\nhost: *([^\r\n]*)", 1)
        return field_map(
            {
                "dot11_data_inner_http_method": F.when(http, F.substring_index(t, " ", 1)),
                "dot11_data_inner_http_path": F.when(http, F.regexp_extract(t, "^[A-Z]+ ([^ ]*)", 1)),
                "dot11_data_inner_http_host": F.when(http & (host != ""), host),
                "dot11_data_inner_sni": sni(data),
            }
        )

    size = bits(be(ip["payload"], 12, 1), 4, 15) * 4
    segment = F.when((ip["proto"] == 6) & (length(ip["payload"]) >= 20), cut(ip["payload"], size, length(ip["payload"])))
    return F.when(ip.isNotNull(), field_map({"dot11_data_inner_src_ip": ip["src"], "dot11_data_inner_dst_ip": ip["dst"], "*": bind(segment, asked)}))


def stp(p: Column) -> Column:
    """Of an 802.2 payload: three bytes of header, then the bridge's message."""
    b = cut(p, 3, length(p))
    v, kind = be(b, 2, 1), be(b, 3, 1)
    name = F.when(kind == 0, "Configuration").when(kind == 0x80, "Topology Change Notification").when((kind == 2) & (v >= 2), "RST (Rapid/Multiple Spanning Tree)")
    full = (kind != 0x80) & (length(b) >= 35)
    seconds = lambda at: F.when(full, F.format_string("%.2f", be(b, at, 2) / 256.0))
    return _map(
        (be(p, 0, 2) == 0x4242) & (length(b) >= 4) & (be(b, 0, 2) == 0) & name.isNotNull(),
        {
            "stp_version": number(v),
            "stp_bpdu_type": name,
            "stp_flags": F.when(full, as_hex(be(b, 4, 1), 2)),
            "stp_root_priority": F.when(full, number(be(b, 5, 2))),
            "stp_root_mac": F.when(full, mac(b, 7)),
            "stp_root_path_cost": F.when(full, number(be(b, 13, 4))),
            "stp_bridge_priority": F.when(full, number(be(b, 17, 2))),
            "stp_bridge_mac": F.when(full, mac(b, 19)),
            "stp_port_id": F.when(full, as_hex(be(b, 25, 2), 4)),
            "stp_message_age_sec": seconds(27),
            "stp_max_age_sec": seconds(29),
            "stp_hello_time_sec": seconds(31),
            "stp_forward_delay_sec": seconds(33),
            "stp_mstp_extensions_present": F.when(full & (v >= 3) & (length(b) > 36), "true"),
        },
    )


def appletalk(p: Column) -> Column:
    d = cut(p, 8, length(p))
    one = lambda at: number(be(d, at, 1))
    return _map(
        (length(d) >= 13) & (be(p, 3, 3) == 0x080007) & (be(p, 6, 2) == 0x809B),
        {
            "ddp_hop_count": number(bits(be(d, 0, 2), 10, 15)),
            "ddp_length": number(bits(be(d, 0, 2), 0, 1023)),
            "ddp_checksum": as_hex(be(d, 2, 2), 4),
            "ddp_dst_network": number(be(d, 4, 2)),
            "ddp_src_network": number(be(d, 6, 2)),
            "ddp_dst_node": one(8),
            "ddp_src_node": one(9),
            "ddp_dst_socket": one(10),
            "ddp_src_socket": one(11),
            "ddp_type": F.when(be(d, 12, 1) == 1, "RTMP Response/Data").otherwise("Unknown"),
        },
    )


def cdp(p: Column) -> Column:
    d = cut(p, 8, length(p))
    def named(a):
        whole = lambda k: from_item(d, last(a, k), lambda x, at, n: text(x, at, n))
        sized = lambda k, least: last(a, k, lambda x: x["n"] >= least)
        return field_map(
            {
                "cdp_device_id": whole(1),
                "cdp_address_count": from_item(d, sized(2, 4), lambda x, at, n: number(be(x, at, 4))),
                "cdp_software_version": whole(5),
                "cdp_platform": whole(6),
                "cdp_vtp_management_domain": whole(9),
                "cdp_native_vlan": from_item(d, sized(10, 2), lambda x, at, n: number(be(x, at, 2))),
                "cdp_duplex": from_item(d, sized(11, 1), lambda x, at, n: F.when(be(x, at, 1) != 0, "full").otherwise("half")),
            }
        )

    head = {"cdp_version": number(be(d, 0, 1)), "cdp_ttl_sec": number(be(d, 1, 1)), "cdp_checksum": as_hex(be(d, 2, 2), 4)}
    ok = (length(d) >= 4) & (be(p, 3, 3) == 0x00000C) & (be(p, 6, 2) == 0x2000)
    return _map(ok, head | {"*": bind(tlvs(d, 4, length(d), kind=2, size=2, whole=True, limit=24), named)})


def eapol(p: Column) -> Column:
    eap = (be(p, 1, 1) == 0) & (length(p) >= 8)
    code = be(p, 4, 1)
    return _map(
        (length(p) >= 4) & be(p, 0, 1).between(1, 3) & (be(p, 1, 1) <= 4),
        {
            "eapol_version": number(be(p, 0, 1)),
            "eapol_type": name_of(be(p, 1, 1), EAPOL_TYPES),
            "eapol_length": number(be(p, 2, 2)),
            "eap_code": F.when(eap, name_of(code, EAP_CODES)),
            "eap_identifier": F.when(eap, number(be(p, 5, 1))),
            "eap_length": F.when(eap, number(be(p, 6, 2))),
            "eap_type": F.when(eap & code.isin(1, 2) & (length(p) >= 9), name_of(be(p, 8, 1), EAP_TYPES)),
        },
    )


def lacp(p: Column) -> Column:
    def side(a, k, who):
        return F.coalesce(bind(last(a, k, lambda i: i["n"] >= 18), lambda x: _lacp_info(p, x, who)), F.create_map().cast("map<string,string>"))

    def named(a):
        return F.map_concat(side(a, 1, "actor"), side(a, 2, "partner"))

    return F.when((length(p) >= 2) & (be(p, 0, 2) == 0x0101), bind(tlvs(p, 2, length(p), kind=1, size=1, whole=True, stop=0), named))


def _lacp_info(p: Column, x: Column, who: str) -> Column:
    at = x["at"]
    out = {
        f"lacp_{who}_system_priority": number(be(p, at, 2)),
        f"lacp_{who}_system_mac": mac(p, at + 2),
        f"lacp_{who}_key": number(be(p, at + 8, 2)),
        f"lacp_{who}_port_priority": number(be(p, at + 10, 2)),
        f"lacp_{who}_port": number(be(p, at + 12, 2)),
    }
    for i, state in enumerate(("activity", "timeout", "aggregation", "synchronization", "collecting", "distributing")):
        out[f"lacp_{who}_state_{state}"] = flag(be(p, at + 14, 1), 1 << i)
    return F.when(x.isNotNull(), field_map(out))


def pppoe(p: Column, discovery: bool) -> Column:
    size = F.least(length(p) - 6, be(p, 4, 2).cast("int"))
    body = cut(p, 6, size)
    out = {
        "pppoe_stage": F.lit("Discovery" if discovery else "Session"),
        "pppoe_code": name_of(be(p, 1, 1), PPPOE_CODES),
        "pppoe_session_id": as_hex(be(p, 2, 2), 4),
        "pppoe_length": number(be(p, 4, 2)),
    }
    if discovery:

        def named(a):
            return field_map(
                {
                    "pppoe_service_name": from_item(body, last(a, 0x0101), lambda d, at, n: text(d, at, n)),
                    "pppoe_ac_name": from_item(body, last(a, 0x0102), lambda d, at, n: text(d, at, n)),
                    "pppoe_host_uniq_hex": from_item(body, last(a, 0x0103), lambda d, at, n: hexed(d, at, n)),
                }
            )

        out["*"] = bind(tlvs(body, 0, length(body), kind=2, size=2), named)
    else:
        proto = be(body, 0, 2)
        control = proto.isin(0xC021, 0x8021, 0x8057) & (length(body) >= 6)
        out |= {
            "pppoe_ppp_protocol": F.when(length(body) >= 2, name_of(proto, PPP_PROTOCOLS)),
            "pppoe_ppp_code": F.when(control, name_of(be(body, 2, 1), LCP_CODES)),
            "pppoe_ppp_identifier": F.when(control, number(be(body, 3, 1))),
            "pppoe_ppp_length": F.when(control, number(be(body, 4, 2))),
        }
    return _map((length(p) >= 6) & (be(p, 0, 1) == 0x11) & be(p, 1, 1).isin(*PPPOE_CODES), out)


def macsec(p: Column) -> Column:
    t = be(p, 0, 1)
    names = {"version": 128, "end_station": 64, "sci_present": 32, "single_copy_broadcast": 16, "encrypted": 8, "changed_text": 4}
    return _map(
        length(p) >= 6,
        {
            **{f"macsec_{k}": flag(t, m) for k, m in names.items()},
            "macsec_association_number": number(bits(t, 0, 3)),
            "macsec_short_length": number(bits(be(p, 1, 1), 0, 63)),
            "macsec_packet_number": number(be(p, 2, 4)),
            "macsec_sci": F.when((bits(t, 5, 1) == 1) & (length(p) >= 14), F.concat(mac(p, 6), F.lit("/"), be(p, 12, 2))),
        },
    )


def homeplugav(p: Column) -> Column:
    return _map(length(p) >= 6, {"homeplugav_mm_version": number(be(p, 0, 1)), "homeplugav_mm_type": as_hex(be(p, 1, 2), 4), "homeplugav_oui": F.concat_ws(":", *(hexed(p, k, 1) for k in (3, 4, 5)))})


def nsh(p: Column) -> Column:
    a, b = be(p, 0, 1), be(p, 1, 1)
    words, kind = bits(b, 0, 63), bits(be(p, 2, 1), 0, 15)
    return _map(
        (length(p) >= 8) & (a < 64) & (words >= 2) & (kind != 0),
        {
            "nsh_version": number(bits(a, 6, 3)),
            "nsh_oam_packet": flag(a, 32),
            "nsh_ttl": number(bits(a, 0, 15) * 4 + bits(b, 6, 3)),
            "nsh_length_bytes": number(words * 4),
            "nsh_md_type": number(kind),
            "nsh_next_protocol": name_of(be(p, 3, 1), NSH_NEXT),
            "nsh_service_path_id": number(be(p, 4, 3)),
            "nsh_service_index": number(be(p, 7, 1)),
        },
    )


def decnet(p: Column) -> Column:
    return field_map({"decnet_phase": F.lit("IV"), "decnet_length": number(length(p))})


def vines(p: Column, ethertype: Column) -> Column:
    return field_map({"vines_subtype": F.when(ethertype == 0x0BAD, "IP").when(ethertype == 0x0BAE, "Loopback").otherwise("Echo"), "vines_length": number(length(p))})


def ethloopback(p: Column) -> Column:
    return field_map({"loopback_length": number(length(p))})


#: By kind: (name of the protocol, function of payload and EtherType).
KINDS = {
    "802.11": ("802.11", lambda p, e: dot11(p)),
    "stp": ("STP", lambda p, e: stp(p)),
    "appletalk": ("AppleTalk", lambda p, e: appletalk(p)),
    "cdp": ("CDP", lambda p, e: cdp(p)),
    "eapol": ("EAPOL", lambda p, e: eapol(p)),
    "lacp": ("LACP", lambda p, e: lacp(p)),
    "pppoe_discovery": ("PPPoE", lambda p, e: pppoe(p, True)),
    "pppoe_session": ("PPPoE", lambda p, e: pppoe(p, False)),
    "macsec": ("MACsec", lambda p, e: macsec(p)),
    "homeplugav": ("HomePlugAV", lambda p, e: homeplugav(p)),
    "nsh": ("NSH", lambda p, e: nsh(p)),
    "decnet": ("DECnet", lambda p, e: decnet(p)),
    "vines": ("BanyanVINES", vines),
    "ethloopback": ("EthernetLoopback", lambda p, e: ethloopback(p)),
}


def dissect_link(kind: Column, payload: Column, ethertype: Column) -> Column:
    """struct(protocol, fields) of a frame of one of ``KINDS``."""
    out = None
    for k, (name, f) in KINDS.items():
        one = F.struct(F.lit(name).alias("protocol"), f(payload, ethertype).alias("fields"))
        out = F.when(kind == k, one) if out is None else out.when(kind == k, one)
    return out
