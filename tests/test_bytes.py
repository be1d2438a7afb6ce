import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowloom.functions import aes, hpack
from flowloom.functions.bytes import be, checksum16, entropy, ipv6, le, tlvs
from flowloom.operators.walkers import initial_keys


def one(spark, data, column):
    return spark.createDataFrame([(data,)], "p binary").select(column(F.col("p")).alias("x")).first()["x"]


def test_numbers_and_checksum(spark):
    head = bytes.fromhex("45000073000040004011" + "0000" + "c0a80001c0a800c7")
    assert one(spark, head, lambda p: be(p, 2, 2)) == 0x73
    assert one(spark, head, lambda p: le(p, 2, 2)) == 0x7300
    assert one(spark, head, checksum16) == 0xB861
    assert one(spark, b"", checksum16) == 0xFFFF
    assert one(spark, None, checksum16) is None


@pytest.mark.parametrize(
    ("hexed", "text"),
    [("0" * 32, "::"), ("20010db8000000000000000000000001", "2001:db8::1"), ("20010db8000000010000000000000001", "2001:db8:0:1::1"), ("00010000000000000001000000000000", "1::1:0:0:0"), ("fe80" + "0" * 28, "fe80::")],
)
def test_ipv6(spark, hexed, text):
    assert one(spark, bytes.fromhex(hexed), lambda p: ipv6(p, 0)) == text


@pytest.mark.parametrize("data", [b"", b"a", b"aaaa", b"hello world", bytes(range(256))])
def test_entropy(spark, data):
    counts = Counter(data)
    assert one(spark, data, entropy) == pytest.approx(-sum(n / len(data) * math.log2(n / len(data)) for n in counts.values()) if data else 0)


def test_items_end_where_they_dont_fit(spark):
    data = bytes.fromhex("350101" + "00" + "0c03616263" + "0509aa")
    got = one(spark, data, lambda p: tlvs(p, 0, F.octet_length(p), kind=1, size=1, skip=0, stop=255))
    assert [(r["t"], r["n"]) for r in got] == [(0x35, 1), (0x0C, 3)]


def test_aes_vectors():
    assert aes.encrypt_block(bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    key, iv, protect = initial_keys(bytes.fromhex("8394c8f03e515708"))
    assert (key.hex(), iv.hex(), protect.hex()) == ("1f369613dd76d5467730efcbe3b1a22d", "fa044b2f42a3fd3b46fb255c", "9f50449e04a0e810283a1e9933adedd2")


def test_hpack_code_is_complete_and_reads_the_examples():
    assert len(hpack.codes()) == 257
    assert sum(2.0**-n for n, _ in hpack.codes()) == 1.0
    d = hpack.Decoder()
    assert d.decode(bytes.fromhex("828684418cf1e3c2e5f23a6ba0ab90f4ff"))[-1] == (":authority", "www.example.com")
    assert d.decode(bytes.fromhex("828684be5886a8eb10649cbf"))[-1] == ("cache-control", "no-cache")
    with pytest.raises(hpack.HpackError):
        d.decode(b"\xff")
