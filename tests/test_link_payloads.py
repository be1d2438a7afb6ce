"""Frames of 802.11, padding, and items beyond any bound."""

from pyspark.sql import functions as F

from flowloom.operators.frames import decode_frames
from flowloom.operators.items import Sctp


def test_80211_frames_and_padding(spark):
    beacon = bytes(24) + b"body"
    rows = [(105, beacon), (127, b"\0\0\x08\0" + bytes(4) + beacon), (1, bytes(12) + b"\0\5" + b"\x42\x42\3\0\0" + bytes(41))]
    got = decode_frames(spark.createDataFrame(rows, "link_type int, data binary")).select("l3_kind", "payload").collect()
    assert [(r["l3_kind"], bytes(r["payload"])) for r in got] == [("802.11", beacon), ("802.11", beacon), ("stp", b"\x42\x42\3\0\0")]


def test_every_chunk_is_given(spark):
    chunk = b"\x03\0\0\x08" + bytes(4)
    df = spark.createDataFrame([(bytes(12) + chunk * 40,)], "p binary")
    assert df.select(F.size(Sctp.chunks(F.col("p")))).first()[0] == 40
