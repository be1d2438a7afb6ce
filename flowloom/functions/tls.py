"""The server name of a TLS ClientHello, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.functions.bytes import be, bind, cut, from_item, item, length, text, tlvs


def client_hello_name(body: Column) -> Column:
    """The host of the first server_name entry of a ClientHello body (from its version on); null if there is none."""

    def name(data, at, size):
        return F.when((size >= 5) & (be(data, at + 2, 1) == 0) & (be(data, at + 3, 2) + 5 <= size) & (be(data, at + 3, 2).between(1, 255)), text(data, at + 5, be(data, at + 3, 2)))

    def extensions(at):
        end = at + 2 + be(body, at, 2)
        ok = end <= length(body)
        found = tlvs(body, F.when(ok, at + 2).otherwise(0), F.when(ok, end).otherwise(0), kind=2, size=2)
        return bind(item(found, 0), lambda x: from_item(body, x, name))

    suites = be(body, 34, 1) + 35
    return bind(suites, lambda a: bind(a + 2 + be(body, a, 2), lambda c: bind(c + 1 + be(body, c, 1), extensions)))


def sni(payload: Column) -> Column:
    """The server name in a TLS record that holds a whole ClientHello, or null."""
    record, hello = be(payload, 3, 2), be(payload, 6, 3)
    whole = (length(payload) >= 9) & (be(payload, 0, 1) == 0x16) & (be(payload, 5, 1) == 1) & (record + 5 <= length(payload)) & (hello + 4 <= record)
    return F.when(whole, bind(cut(payload, 9, hello), client_hello_name))
