"""Frames to network and transport headers, in Column expressions.

``decode_frames`` turns captured frames (``link_type``, ``data``) into one row
each with the layers as structs; rows that no rule takes have ``l3_kind`` null.
Of 802.11 frames, with or without a radiotap header, the payload is the frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.bytes import be, bind, bits, checksum16, cut, ipv4, ipv6, length, tlvs
from flowloom.functions.tls import sni

# Link types of capture files, EtherTypes and protocol numbers.
LINK_TYPES = {1: "ethernet", 101: "raw_ip", 105: "802.11", 113: "linux_sll", 127: "radiotap", 274: "mpacket"}
ETHERTYPES = {
    0x0800: "ipv4", 0x86DD: "ipv6", 0x8863: "pppoe_discovery", 0x8864: "pppoe_session", 0x888E: "eapol", 0x8809: "lacp", 0x6003: "decnet", 0x0BAD: "vines", 0x0BAE: "vines", 0x0BAF: "vines", 0x88E5: "macsec", 0x88E1: "homeplugav",
    0x9000: "ethloopback", 0x894F: "nsh", 0x0806: "arp", 0x8035: "arp", 0x8847: "mpls", 0x8848: "mpls", 0x88CC: "lldp", 0x0842: "wol",
}
IP_PROTOCOLS = {1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP", 41: "6in4", 47: "GRE", 50: "ESP", 51: "AH", 58: "ICMPv6", 88: "EIGRP", 89: "OSPF", 103: "PIM", 115: "L2TPv3", 132: "SCTP"}
_VLAN = (0x8100, 0x88A8)


def strip_vlan(ethertype: Column, payload: Column) -> Column:
    """struct(ethertype, payload, vlan_outer, vlan_inner) after up to two tags; null with a third, or where a tag is cut off."""
    one = ethertype.isin(*_VLAN)
    second = be(payload, 2, 2)
    two = one & second.isin(*_VLAN)
    last = F.when(two, be(payload, 6, 2)).when(one, second).otherwise(ethertype)
    size = F.when(two, 8).when(one, 4).otherwise(0)
    ok = (length(payload) >= size) & ~last.isin(*_VLAN)
    vid = lambda at: bits(be(payload, at, 2), 0, 0x0FFF).cast("int")
    return F.when(ok, F.struct(last.alias("ethertype"), cut(payload, size, length(payload)).alias("payload"), F.when(one, vid(0)).alias("vlan_outer"), F.when(two, vid(4)).alias("vlan_inner")))


def parse_ipv4(p: Column) -> Column:
    """struct(src, dst, proto, ident, offset, more_fragments, payload, checksum_valid); null if malformed."""
    n, head, total = length(p), bits(be(p, 0, 1), 0, 15) * 4, be(p, 2, 2)
    # options: a length under 2 or beyond the header is malformed
    options = cut(p, 20, head - 20)
    first = F.struct(F.lit(0).alias("pos"), F.lit(True).alias("ok"))

    def option(s, _):
        kind, size = be(options, s["pos"], 1), be(options, s["pos"] + 1, 1)
        done = (s["pos"] >= length(options)) | (kind == 0) | ~s["ok"]
        bad = (s["pos"] + 2 > length(options)) | (size < 2) | (s["pos"] + size > length(options))
        pos = F.when(done | bad & (kind != 1), s["pos"]).when(kind == 1, s["pos"] + 1).otherwise(s["pos"] + size)
        return F.struct(pos.cast("int").alias("pos"), F.when(done, s["ok"]).otherwise((kind == 1) | ~bad).alias("ok"))

    plain = F.aggregate(F.sequence(F.lit(1), F.lit(40)), first, option, lambda s: s["ok"])
    ok = (n >= 20) & (bits(be(p, 0, 1), 4, 15) == 4) & (head >= 20) & (head <= n) & (total >= head) & (total <= n) & ((head == 20) | plain)
    bare = F.concat(cut(p, 0, 10), F.lit(b"\x00\x00"), cut(p, 12, head - 12))
    place = be(p, 6, 2)
    return F.when(
        ok,
        F.struct(
            ipv4(p, 12).alias("src"),
            ipv4(p, 16).alias("dst"),
            be(p, 9, 1).cast("int").alias("proto"),
            be(p, 4, 2).alias("ident"),
            (bits(place, 0, 0x1FFF) * 8).cast("int").alias("offset"),
            (bits(place, 13, 1) == 1).alias("more_fragments"),
            cut(p, head, total - head).alias("payload"),
            (checksum16(bare) == be(p, 10, 2)).alias("checksum_valid"),
        ),
    )


def parse_ipv6(p: Column) -> Column:
    """The same struct; up to eight extension headers (0, 43, 44, 60) are passed."""
    n, size = length(p), be(p, 4, 2)
    end = size + 40
    first = F.struct(be(p, 6, 1).cast("int").alias("next"), F.lit(40).alias("pos"), F.lit(True).alias("ok"), F.lit(-1).alias("frag"))

    def header(s, _):
        at = s["pos"]
        fragment = s["next"] == 44
        more = F.when(fragment, 8).otherwise((be(p, at + 1, 1) + 1) * 8)
        fits = at + more <= end
        go = s["ok"] & s["next"].isin(0, 43, 44, 60)
        return F.struct(
            F.when(go & fits, be(p, at, 1)).otherwise(s["next"]).cast("int").alias("next"),
            F.when(go & fits, at + more).otherwise(at).cast("int").alias("pos"),
            F.when(go, fits).otherwise(s["ok"]).alias("ok"),
            F.when(go & fragment, at).otherwise(s["frag"]).cast("int").alias("frag"),
        )

    return bind(F.aggregate(F.sequence(F.lit(1), F.lit(8)), first, header), lambda walked: _ipv6_struct(p, n, end, walked))


def _ipv6_struct(p: Column, n: Column, end: Column, walked: Column) -> Column:
    ok = (n >= 40) & (bits(be(p, 0, 1), 4, 15) == 6) & (end <= n) & walked["ok"] & ~walked["next"].isin(0, 43, 44, 60)
    place = be(p, walked["frag"] + 2, 2)
    frag = walked["frag"] >= 0
    return F.when(
        ok,
        F.struct(
            ipv6(p, 8).alias("src"),
            ipv6(p, 24).alias("dst"),
            walked["next"].alias("proto"),
            F.when(frag, be(p, walked["frag"] + 4, 4)).otherwise(0).cast("long").alias("ident"),
            F.when(frag, bits(place, 0, 0xFFF8)).otherwise(0).cast("int").alias("offset"),
            F.coalesce(frag & (bits(place, 0, 1) == 1), F.lit(False)).alias("more_fragments"),
            cut(p, walked["pos"], end - walked["pos"]).alias("payload"),
            F.lit(None).cast("boolean").alias("checksum_valid"),
        ),
    )


def pseudo_header(p: Column, version: int, proto: int, size: Column) -> Column:
    """What a transport checksum covers besides the segment; ``p`` is the network header."""
    if version == 4:
        return F.concat(cut(p, 12, 8), F.unhex(F.lpad(F.hex(F.lit(proto)), 4, "0")), F.unhex(F.lpad(F.hex(size), 4, "0")))
    return F.concat(cut(p, 8, 32), F.unhex(F.lpad(F.hex(size), 8, "0")), F.unhex(F.lpad(F.hex(F.lit(proto)), 8, "0")))


def parse_tcp(p: Column) -> Column:
    """struct(src_port, dst_port, seq, ack, flags, window, mss, window_scale, sack_permitted, ts_value, ts_echo, sack_blocks, payload); null if malformed."""
    n, head = length(p), bits(be(p, 12, 1), 4, 15) * 4
    ok = (n >= 20) & (head >= 20) & (head <= n)
    found = tlvs(p, 20, F.when(ok, head).otherwise(20), kind=1, size=1, whole=True, skip=1, stop=0)
    return bind(found, lambda x: _tcp_struct(p, n, head, ok, x))


def _tcp_struct(p: Column, n: Column, head: Column, ok: Column, found: Column) -> Column:
    one = lambda kind, size: F.get(F.filter(found, lambda x: (x["t"] == kind) & (x["n"] == size)), F.lit(0))["at"]
    sack = F.get(F.filter(found, lambda x: (x["t"] == 5) & (x["n"] % 8 == 0) & (x["n"] > 0)), F.lit(0))
    blocks = F.when(sack.isNotNull(), F.transform(F.sequence(F.lit(0), F.least(F.floor(sack["n"] / 8), F.lit(4)).cast("int") - 1), lambda i: F.struct(be(p, sack["at"] + i * 8, 4).alias("left"), be(p, sack["at"] + i * 8 + 4, 4).alias("right"))))
    return F.when(
        ok,
        F.struct(
            be(p, 0, 2).cast("int").alias("src_port"),
            be(p, 2, 2).cast("int").alias("dst_port"),
            be(p, 4, 4).alias("seq"),
            be(p, 8, 4).alias("ack"),
            be(p, 13, 1).cast("int").alias("flags"),
            be(p, 14, 2).cast("int").alias("window"),
            be(p, one(2, 2), 2).cast("int").alias("mss"),
            be(p, one(3, 1), 1).cast("int").alias("window_scale"),
            one(4, 0).isNotNull().alias("sack_permitted"),
            be(p, one(8, 8), 4).alias("ts_value"),
            be(p, one(8, 8) + 4, 4).alias("ts_echo"),
            F.coalesce(blocks, F.array().cast("array<struct<left:long,right:long>>")).alias("sack_blocks"),
            cut(p, head, n).alias("payload"),
        ),
    )


def parse_udp(p: Column) -> Column:
    """struct(src_port, dst_port, checksum, payload); null if malformed."""
    size = be(p, 4, 2)
    ok = (length(p) >= 8) & (size >= 8) & (size <= length(p))
    return F.when(ok, F.struct(be(p, 0, 2).cast("int").alias("src_port"), be(p, 2, 2).cast("int").alias("dst_port"), be(p, 6, 2).cast("int").alias("checksum"), cut(p, 8, size - 8).alias("payload")))


def transport_checksum_valid(network: Column, version: int, proto: int, segment: Column) -> Column:
    """Whether a segment's checksum fits; a UDP checksum of zero is absent (null) over IPv4 and invalid over IPv6."""
    at = 16 if proto == 6 else 6 if proto == 17 else 2
    stored = be(segment, at, 2)
    bare = F.concat(cut(segment, 0, at), F.lit(b"\x00\x00"), cut(segment, at + 2, length(segment)))
    right = checksum16(F.concat(pseudo_header(network, version, proto, length(segment)), bare)) == stored
    if proto != 17:
        return right
    right = right | (stored == 65535) & (checksum16(F.concat(pseudo_header(network, version, proto, length(segment)), bare)) == 0)
    return F.when(stored == 0, F.lit(None) if version == 4 else F.lit(False)).otherwise(right)


def inner_map(p: Column, prefix: str, keys: tuple[str, ...] = ("src_ip", "dst_ip", "protocol", "dst_port", "sni")) -> Column:
    """Addresses, protocol, port and server name of a packet inside another, as a map of fields with a prefix; empty if it can't be read."""
    from flowloom.plans.registry import field_map

    def fields(ip: Column, v: Column) -> Column:
        proto = ip["proto"]
        port = F.when(proto == 6, be(ip["payload"], 2, 2)).when((proto == 17) & (length(ip["payload"]) >= 8), be(ip["payload"], 2, 2))
        body = cut(ip["payload"], bits(be(ip["payload"], 12, 1), 4, 15) * 4, length(ip["payload"]))
        every = {
            "src_ip": ip["src"],
            "dst_ip": ip["dst"],
            "protocol": F.when(proto == 6, "TCP").when(proto == 17, "UDP").when((proto == 58) & (v == 6), "ICMPv6").otherwise("other"),
            "dst_port": port,
            "sni": F.when((proto == 6) & (length(ip["payload"]) >= 20), bind(body, sni)),
        }
        return field_map({f"{prefix}_{k}": every[k] for k in keys})

    return bind(p, lambda d: bind(parse_ip(d), lambda ip: F.when(ip.isNotNull(), fields(ip, bits(be(d, 0, 1), 4, 15)))))


def parse_ip(p: Column) -> Column:
    """IPv4 or IPv6, by the version."""
    v = bits(be(p, 0, 1), 4, 15)
    return F.when(v == 4, parse_ipv4(p)).when(v == 6, parse_ipv6(p))


def link_payload(link_type: Column, data: Column) -> Column:
    """struct(ethertype, payload): what is inside the frame of each link type; null where there is nothing to read."""
    # below 0x0600 the type is the length of what follows, without the padding
    kind = be(data, 12, 2)
    ethernet = F.when(length(data) >= 14, F.struct(kind.alias("ethertype"), cut(data, 14, F.when(kind < 0x0600, kind.cast("int")).otherwise(length(data))).alias("payload")))
    version = bits(be(data, 0, 1), 4, 15)
    raw = F.when(version.isin(4, 6), F.struct(F.when(version == 4, 0x0800).otherwise(0x86DD).cast("long").alias("ethertype"), data.alias("payload")))
    sll = F.when(length(data) >= 16, F.struct(be(data, 14, 2).alias("ethertype"), cut(data, 16, length(data)).alias("payload")))
    # a preamble ends with the start delimiter, within the first 16 bytes
    at = F.array_position(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: be(data, i, 1) == 0xD5), True)
    frame = cut(data, at, length(data))
    mpacket = F.when((at > 0) & (length(frame) >= 14), F.struct(be(frame, 12, 2).alias("ethertype"), cut(frame, 14, length(frame)).alias("payload")))
    return F.when(link_type == 1, ethernet).when(link_type == 101, raw).when(link_type == 113, sll).when(link_type == 274, mpacket)


def decode_frames(packets: DataFrame, data: str = "data", link_type: str = "link_type") -> DataFrame:
    """``packets`` with vlan_outer, vlan_inner, ethertype, l3_kind, ip (struct), tcp, udp, l4_proto, src_port, dst_port and payload."""
    d = F.col(data)
    one = packets.withColumn("__link", link_payload(F.col(link_type), d)).withColumn("__net", strip_vlan(F.col("__link.ethertype"), F.col("__link.payload")))
    ether, body = F.col("__net.ethertype"), F.col("__net.payload")
    kind = None
    for k, v in ETHERTYPES.items():
        kind = F.when(ether == k, v) if kind is None else kind.when(ether == k, v)
    llc = F.when(be(body, 0, 2) == 0x4242, "stp").when(be(body, 0, 2) == 0xAAAA, F.when((be(body, 3, 3) == 0x00000C) & (be(body, 6, 2) == 0x2000), "cdp").when(be(body, 6, 2) == 0x809B, "appletalk"))
    kind = F.when(F.col(link_type).isin(105, 127), "802.11").when(ether < 0x0600, llc).otherwise(kind)
    two = one.withColumn("vlan_outer", F.col("__net.vlan_outer")).withColumn("vlan_inner", F.col("__net.vlan_inner")).withColumn("ethertype", ether.cast("int")).withColumn("l3_kind", kind)
    three = two.withColumn("ip", F.when(F.col("l3_kind") == "ipv4", parse_ipv4(body)).when(F.col("l3_kind") == "ipv6", parse_ipv6(body)))
    first = F.col("ip.offset") == 0
    whole = first & ~F.col("ip.more_fragments")
    four = three.withColumn("tcp", F.when((F.col("ip.proto") == 6) & whole, parse_tcp(F.col("ip.payload")))).withColumn("udp", F.when((F.col("ip.proto") == 17) & whole, parse_udp(F.col("ip.payload"))))
    named = None
    for k, v in IP_PROTOCOLS.items():
        named = F.when(F.col("ip.proto") == k, v) if named is None else named.when(F.col("ip.proto") == k, v)
    beside = F.when(F.col("l3_kind") == "arp", "ARP").when(F.col("l3_kind") == "mpls", "MPLS").when(F.col("l3_kind") == "lldp", "LLDP").when(F.col("l3_kind") == "wol", "WoL")
    payload = F.coalesce(F.col("tcp.payload"), F.col("udp.payload"), F.when(~F.col("ip.proto").isin(6, 17), F.col("ip.payload")), F.when(F.col(link_type) == 105, d).when(F.col(link_type) == 127, radiotap_payload(d)), F.when(F.col("l3_kind").isin("ipv4", "ipv6"), F.lit(None)).otherwise(body))
    return (
        four.withColumn("l4_proto", F.coalesce(named, beside))
        .withColumn("src_port", F.coalesce("tcp.src_port", "udp.src_port"))
        .withColumn("dst_port", F.coalesce("tcp.dst_port", "udp.dst_port"))
        .withColumn("payload", payload)
        .drop("__link", "__net")
    )


def radiotap_payload(data: Column) -> Column:
    """The 802.11 frame behind a radiotap header, whose length is at byte 2, little-endian."""
    size = be(data, 2, 1) + be(data, 3, 1) * 256
    return F.when(size <= length(data), cut(data, size, length(data)))
