"""What a flow is: server name, rules, dissectors and scores in one row.

Over TCP a server name in a TLS ClientHello decides, by the domain rules; without
one the registry's best dissector names the flow, and a name that its fields give
stands for the application.  Over UDP the dissector comes first, and a server
name among its fields is looked up in the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.tls import sni
from flowloom.operators import rules, scores
from flowloom.plans.registry import dissect

#: Fields that name the application where no server name does, in order.
IDENTITIES = ("http_host", "ssh_software_version", "smtp_helo_domain", "smtp_ehlo_domain")


def classify_flows(df: DataFrame, domain_rules: DataFrame, enabled: dict[str, bool] | None = None) -> DataFrame:
    """``df`` (payload, dst_port, l4_proto) with sni, l7_protocol, l7_confidence, l7, category, app_name and the scores.

    payload: the first bytes of a TCP stream, or a UDP payload.  Without any
    evidence the category is ``unknown``; a server name that no rule holds is
    ``unclassified``, with low confidence.
    """
    tcp = F.col("l4_proto") == "TCP"
    named = df.withColumn("__sni", F.when(tcp, sni(F.col("payload"))))
    found = dissect(named.withColumn("__open", F.when(F.col("__sni").isNull(), F.col("payload"))), payload="__open", enabled=enabled)
    found = found.withColumn("sni", F.coalesce("__sni", F.col("fields")["sni"]))
    ruled = rules.classify_hosts(found, domain_rules, host="sni")
    by_rule = F.col("sni").isNotNull()
    by_dissector = tcp & ~by_rule & F.col("protocol").isNotNull()
    known = F.when(tcp & by_rule, F.col("category"))
    dga = scores.dga(F.col("sni"))
    vpn = scores.vpn(F.col("payload"), F.col("dst_port"), F.col("l4_proto"), known)
    scored = ruled.withColumn("__vpn", vpn).withColumn("__dga", F.when(by_rule, dga))
    return scored.select(
        *(F.col(f"`{c}`") for c in df.columns),
        "sni",
        F.when(F.col("__sni").isNotNull(), "TLS").otherwise(F.col("protocol")).alias("l7_protocol"),
        F.when(by_rule, F.col("match_confidence")).when(F.col("protocol").isNotNull(), "high").otherwise(F.when(tcp, "none").otherwise("low")).alias("l7_confidence"),
        F.col("fields").alias("l7"),
        F.when(by_dissector, F.col("protocol")).otherwise(F.col("category")).alias("category"),
        F.when(by_dissector, F.coalesce(*(F.col("fields")[k] for k in IDENTITIES))).otherwise(F.col("app_name")).alias("app_name"),
        F.coalesce(F.col("__dga.score"), F.lit(0.0)).cast("double").alias("dga_score"),
        F.col("__vpn.score").cast("double").alias("vpn_score"),
        F.col("__vpn.protocol").alias("vpn_protocol"),
        F.when(tcp, scores.dot(F.col("payload"), F.col("dst_port"), F.col("l4_proto"))).otherwise(0.0).cast("double").alias("dot_score"),
        F.when(tcp, F.coalesce(scores.doh(known), F.lit(0.0))).otherwise(0.0).cast("double").alias("doh_score"),
    )
