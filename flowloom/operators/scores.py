"""Scores of host names and payloads, in Column expressions: generated names, tunnels, encrypted DNS."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.functions.bytes import be, bits, cut, entropy, length

# Common pairs of letters.
BIGRAMS = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le "
    "ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur"
).split()
MAX_LABEL = 63


def first_label(host: Column) -> Column:
    return F.substring(F.substring_index(host, ".", 1), 1, MAX_LABEL)


def label_entropy(label: Column) -> Column:
    """Shannon entropy over 5.17 bits, the most 36 signs can have; 1 at most."""
    return F.least(entropy(F.encode(F.lower(label), "UTF-8")) / 5.17, F.lit(1.0))


def bigram_rarity(label: Column) -> Column:
    """The share of pairs of letters that aren't common; 0.5 without a pair."""
    low = F.lower(label)
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(2))), lambda x: x.rlike("^[a-z]{2}$"))
    common = F.size(F.filter(pairs, lambda x: x.isin(*BIGRAMS)))
    return F.when(F.size(pairs) > 0, 1.0 - common / F.size(pairs)).otherwise(0.5)


def consonant_run(label: Column) -> Column:
    """The longest run of consonants (y is one) over 6; 1 at most."""
    runs = F.transform(F.split(F.lower(label), "[^b-df-hj-np-tv-z]", -1), F.length)
    return F.least(F.array_max(runs) / 6.0, F.lit(1.0))


def digit_pattern(label: Column) -> Column:
    """0.4 times the share of digits and 0.6 times the changes between digits and others for each character; 1 at most."""
    kinds = F.regexp_replace(F.regexp_replace(label, "[0-9]", "\u0001"), "[^\u0001]", "\u0002")
    n = F.length(label)
    digits = n - F.length(F.replace(kinds, F.lit("\u0001"), F.lit("")))
    changes = F.regexp_count(kinds, F.lit("\u0001(?=\u0002)|\u0002(?=\u0001)"))
    return F.when(n > 0, F.least(0.4 * digits / n + 0.6 * changes / n, F.lit(1.0))).otherwise(0.0)


def dga(host: Column) -> Column:
    """struct(entropy, bigram, consonant, digit, score, verdict) of a host's first label; under four characters: 0 and low."""
    label = first_label(host)
    short = F.length(label) < 4
    parts = [F.when(short, 0.0).otherwise(f(label)) for f in (label_entropy, bigram_rarity, consonant_run, digit_pattern)]
    score = sum((p * w for p, w in zip(parts[1:], (0.35, 0.15, 0.15), strict=True)), parts[0] * 0.35)
    return F.struct(*(p.alias(n) for p, n in zip(parts, ("entropy", "bigram", "consonant", "digit"), strict=True)), score.alias("score"), F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low").alias("verdict"))


def verdict(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.35, "medium").otherwise("low")


def wireguard(p: Column) -> Column:
    n, t = length(p), be(p, 0, 1)
    return F.when((n < 4) | (be(p, 1, 3) != 0), 0.0).when((t == 1) & (n == 148), 0.95).when((t == 2) & (n == 92), 0.95).when((t == 3) & (n == 64), 0.85).when((t == 4) & (n >= 32) & (n % 16 == 0), 0.4).otherwise(0.0)


def openvpn(p: Column) -> Column:
    return F.when((length(p) >= 1) & bits(be(p, 0, 1), 3, 31).between(1, 9), 0.3).otherwise(0.0)


def ike(p: Column, port: Column) -> Column:
    nat = port == 4500
    head = F.when(nat, cut(p, 4, length(p))).otherwise(p)
    version = be(head, 17, 1)
    ok = (length(head) >= 28) & bits(version, 4, 15).isin(1, 2) & (bits(version, 0, 15) == 0) & (~nat | (length(p) >= 4) & (be(p, 0, 4) == 0))
    return F.when(ok, F.when(port.isin(500, 4500), 0.7).otherwise(0.3)).otherwise(0.0)


def known_vpn_port(port: Column, l4: Column) -> Column:
    udp = l4 == "UDP"
    return F.when(udp & (port == 51820), 0.5).when(port == 1194, 0.4).when(udp & port.isin(500, 4500), 0.3).when(~udp & (port == 1723), 0.5).when(udp & (port == 1701), 0.3).otherwise(0.0)


def random_payload(p: Column, port: Column) -> Column:
    """0.25 for 64 bytes or more that look random, where that isn't usual."""
    return F.when(~port.isin(443, 80, 53) & (length(p) >= 64) & (entropy(p) / 8 > 0.97), 0.25).otherwise(0.0)


def vpn(p: Column, port: Column, l4: Column, category: Column | None = None) -> Column:
    """struct(score, protocol, verdict)."""
    w, o, i = wireguard(p), openvpn(p), ike(p, port)
    best = F.greatest(w, o, i)
    name = F.when(best <= 0, "none").when(w == best, "wireguard").when(o == best, "openvpn").otherwise("ike")
    base = best + 0.3 * known_vpn_port(port, l4)
    fallback = random_payload(p, port)
    quiet = base == 0
    score = F.when(quiet, fallback).otherwise(base)
    name = F.when(quiet & (fallback > 0), "unknown").otherwise(name)
    proxy = F.coalesce(category == "vpn_proxy", F.lit(False)) if category is not None else F.lit(False)
    score = F.least(F.when(proxy, F.greatest(score, F.lit(0.9))).otherwise(score), F.lit(1.0))
    name = F.when(proxy & (name == "none"), "commercial_vpn_app").otherwise(name)
    return F.struct(score.alias("score"), name.alias("protocol"), verdict(score).alias("verdict"))


def dot(p: Column, port: Column, l4: Column) -> Column:
    return F.when((l4 == "TCP") & (length(p) >= 6) & (be(p, 0, 1) == 0x16), F.when(port == 853, 0.85).otherwise(0.15)).otherwise(0.0)


def doh(category: Column) -> Column:
    return F.when(category == "dns_over_https", 0.9).otherwise(0.0)
