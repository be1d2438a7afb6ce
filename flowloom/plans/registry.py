"""The registry of protocol dissectors, and classification by the best score.

A dissector scores a payload with a Column expression and extracts fields with
another (or, where a format needs random access, with one Arrow-batched
function for all such formats).  Scoring is local to a row: the candidates of a
transport are one array, and the best is its maximum, ties to the dissector
registered first.  Only the dissectors that may occur on a row's transport are
evaluated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.bytes import bind

#: A score must be above this to count.
THRESHOLD = 0.3

FIELDS = "map<string,string>"


@dataclass(frozen=True)
class Dissector:
    """name, configuration key, transports it may occur on, place in the order of ties, ports (for documentation), and the two functions of (payload, port, l4)."""

    name: str
    key: str
    l4: tuple[str, ...]
    order: int
    detect: Callable[[Column, Column, Column], Column]
    fields: Callable[[Column, Column, Column], dict[str, Column]] | None
    ports: tuple[int, ...] = ()


REGISTRY: dict[str, Dissector] = {}
#: Names of those whose fields come from ``flowloom.operators.walkers``.
WALKED: set[str] = set()


def dissector(name: str, key: str, order: int, l4: str, ports: tuple[int, ...] = (), scores: tuple[float, float] | None = None):
    """Register ``detect`` and ``fields`` of the decorated class.

    l4: transports, separated by blanks.  With ``scores`` (elsewhere, on one of
    the ports) ``detect`` is only the condition.
    """

    def add(cls):
        found = cls.detect
        if scores:
            off, on = scores
            test = found
            found = lambda p, port, l4: F.when(test(p, port, l4), F.when(port.isin(*ports), on).otherwise(off) if ports else F.lit(off)).otherwise(0.0)
        known = REGISTRY[name] = Dissector(name, key, tuple(l4.split()), order, found, getattr(cls, "fields", None), ports)
        if known.fields is None:
            WALKED.add(name)
        return cls

    return add


def _load() -> list[Dissector]:
    from flowloom.operators import fixed, headers, items, walkers  # noqa: F401  registers its dissectors

    return sorted(REGISTRY.values(), key=lambda d: d.order)


def dissectors(enabled: dict[str, bool] | None = None) -> list[Dissector]:
    """The registered dissectors in order; ``enabled`` turns some off by key (a missing key is on)."""
    return [d for d in _load() if (enabled or {}).get(d.key, True)]


def best_score(payload: Column, port: Column, l4: Column, enabled: dict[str, bool] | None = None, compat: bool = False) -> Column:
    """struct(confidence, order, protocol) of the best dissector; null if none is above the threshold.

    compat: dissectors that don't check the transport compete on every one.
    """
    from flowloom.operators.fixed import UNGATED

    known = dissectors(enabled)
    transports = sorted({x for d in known for x in d.l4})
    out = None
    for t in transports:
        here = [d for d in known if t in d.l4 or compat and d.name in UNGATED]
        scored = F.array(*(F.struct(F.coalesce(d.detect(payload, port, l4), F.lit(0.0)).cast("double").alias("confidence"), F.lit(-d.order).alias("order"), F.lit(d.name).alias("protocol")) for d in here))
        best = F.array_max(F.filter(scored, lambda x: x["confidence"] > THRESHOLD))
        out = F.when(l4 == t, best) if out is None else out.when(l4 == t, best)
    return F.when(payload.isNotNull(), out)


def field_map(fields: dict[str, Column]) -> Column:
    """A map without the fields that are null; ``*`` is a map of further ones."""
    more = fields.get("*")
    if more is not None:
        if len(fields) == 1:
            return F.coalesce(more, F.create_map().cast(FIELDS))
        rest = field_map({k: v for k, v in fields.items() if k != "*"})
        # of a key in both, the further one counts
        return bind(F.coalesce(more, F.create_map().cast(FIELDS)), lambda m: F.map_concat(F.map_filter(rest, lambda k, v: ~F.map_contains_key(m, k)), m))
    pairs = [x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).cast(FIELDS)


def dissect_as(name: str, payload: Column, port: Column, l4: Column | None = None) -> Column:
    """The fields of a payload as one protocol's, whatever its score."""
    _load()
    l4 = F.lit(REGISTRY[name].l4[0]) if l4 is None else l4
    if name in WALKED:
        from flowloom.operators.walkers import walk

        return walk(F.lit(name), payload, port)
    return field_map(REGISTRY[name].fields(payload, port, l4))


def classify(df: DataFrame, payload: str = "payload", port: str = "dst_port", l4: str = "l4_proto", enabled: dict[str, bool] | None = None, compat: bool = False) -> DataFrame:
    """``df`` with ``protocol`` and ``confidence`` (null: none)."""
    best = best_score(F.col(payload), F.col(port), F.col(l4), enabled, compat)
    return df.withColumn("__best", best).withColumn("protocol", F.col("__best.protocol")).withColumn("confidence", F.col("__best.confidence")).drop("__best")


def dissect(df: DataFrame, payload: str = "payload", port: str = "dst_port", l4: str = "l4_proto", enabled: dict[str, bool] | None = None) -> DataFrame:
    """``df`` with ``protocol``, ``confidence`` and ``fields``."""
    from flowloom.operators.walkers import walk

    done = classify(df, payload, port, l4, enabled)
    p, d, t, name = F.col(payload), F.col(port), F.col(l4), F.col("protocol")
    out = None
    for x in dissectors(enabled):
        if x.name not in WALKED:
            one = field_map(x.fields(p, d, t))
            out = F.when(name == x.name, one) if out is None else out.when(name == x.name, one)
    walked = walk(name, F.when(name.isin(*WALKED), p), d)
    return done.withColumn("__walked", walked).withColumn("fields", F.coalesce(*([] if out is None else [out]), F.col("__walked"))).drop("__walked")
