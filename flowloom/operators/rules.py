"""Domain rules and protocol switches: read, validated, and applied to host names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rules that a broadcast may carry; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def valid_suffix(s: Column) -> Column:
    """3 to 127 characters; labels of letters, digits, ``-`` and ``_``, two at least, none empty."""
    return F.length(s).between(3, 127) & s.rlike(r"^[A-Za-z0-9_\-]+(?:\.[A-Za-z0-9_\-]+)+$")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a small text file, which is read as one row."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n", -1)).alias("line_no", "line")).select((F.col("line_no") + 1).alias("line_no"), F.trim("line").alias("line"))


def dedupe_rules(rules: DataFrame) -> DataFrame:
    """Valid rules (line_no, suffix, category, app_name); of those with the same suffix, in any case, the first stays."""
    first = F.row_number().over(Window.partitionBy(F.lower("suffix")).orderBy("line_no"))
    return rules.where(valid_suffix(F.col("suffix"))).withColumn("__n", first).where("__n = 1").drop("__n")


def read_domain_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a file with ``[category]`` sections and lines ``suffix = name``; ``#`` and ``;`` start comments."""
    lines = _numbered_lines(spark, path).where(~F.col("line").rlike("^$|^[#;]"))
    section = F.when(F.col("line").rlike(r"^\[.*\]$"), F.trim(F.expr("substring(line, 2, length(line) - 2)")))
    inside = F.last(section, ignorenulls=True).over(Window.partitionBy(F.lit(1)).orderBy("line_no"))
    rules = lines.withColumn("category", inside).where(~F.col("line").rlike(r"^\[") & F.col("category").isNotNull())
    cut = F.split("line", "=", 2)
    rules = rules.select("line_no", F.trim(F.get(cut, F.lit(0))).alias("suffix"), "category", F.coalesce(F.nullif(F.trim(F.get(cut, F.lit(1))), F.lit("")), F.trim(F.get(cut, F.lit(0)))).alias("app_name"))
    return dedupe_rules(rules)


def read_protocol_config(spark: SparkSession, path: str) -> dict[str, bool]:
    """Switches by key from lines ``key = true``, ``false``, ``1`` or ``0``; other values are skipped, missing keys are on."""
    cut = F.split("line", "=", 2)
    rows = _numbered_lines(spark, path).where(~F.col("line").rlike(r"^$|^[#;\[]") & F.col("line").contains("=")).select("line_no", F.trim(F.get(cut, F.lit(0))).alias("k"), F.lower(F.trim(F.get(cut, F.lit(1)))).alias("v"))
    return {r["k"]: r["v"] in ("true", "1") for r in rows.where(F.col("v").isin("true", "false", "1", "0")).orderBy(F.desc("line_no")).collect()}


def with_enabled(names: DataFrame, config: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with ``enabled`` from (name, enabled); a name without an entry is on."""
    known = config.select(F.lower("name").alias("__k"), F.col("enabled").alias("__e")).groupBy("__k").agg(F.max("__e").alias("__e"))
    return names.join(known, F.lower(F.col(name)) == F.col("__k"), "left").withColumn("enabled", F.coalesce("__e", F.lit(True))).drop("__k", "__e")


def host_suffixes(host: Column) -> Column:
    """A host name and what follows each of its dots."""
    labels = F.split(F.lower(host), r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def classify_hosts(df: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """``df`` with category, app_name and match_confidence by the longest rule suffix on a label boundary.

    A host that matches no rule is ``unclassified`` with ``low``, a null one ``unknown`` with ``none``.
    Different hosts are classified once each, by an equi-join of their suffixes
    with the rules, which are broadcast while they are few.
    """
    small = rules.select(F.lower("suffix").alias("suffix"), "category", "app_name", "line_no")
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    hosts = df.select(F.col(host).alias("__host")).where("__host is not null").distinct()
    every = hosts.select("__host", F.explode(host_suffixes(F.col("__host"))).alias("suffix"))
    best = every.join(small, "suffix").groupBy("__host").agg(F.max_by(F.struct("category", "app_name"), F.struct(F.length("suffix"), -F.col("line_no"))).alias("__rule"))
    joined = df.join(best, F.col(host) == F.col("__host"), "left")
    none = F.when(F.col(host).isNull(), "unknown").otherwise("unclassified")
    return (
        joined.withColumn("category", F.coalesce("__rule.category", none))
        .withColumn("app_name", F.col("__rule.app_name"))
        .withColumn("match_confidence", F.when(F.col(host).isNull(), "none").when(F.col("__rule").isNull(), "low").otherwise("high"))
        .drop("__host", "__rule")
    )
