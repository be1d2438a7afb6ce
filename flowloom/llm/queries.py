"""The queries of this subpackage, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.simhash import near_duplicates

    found = near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.lines import dedup_lines

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    done = dedup_lines(docs, min_chars=1, removed_col="removed")
    return done.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.pii import pseudonymise

    return pseudonymise(_read(spark, sf_dir, "documents"), "example key: give your own").select("doc_id", "text", "n_replaced")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.decontaminate import decontaminate, items_digest

    found = decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items_digest("items").alias("items_sha256"), "contaminated")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.language import LanguageModel, held_out

    docs = _read(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id"))
    model = LanguageModel.fit(docs.where("not held_out"))
    return model.predict(docs.select("doc_id", "held_out", "text")).select("doc_id", "held_out", "lang_pred", "score")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from flowloom.llm.packing import pack

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.passages import dedup_passages

    done = dedup_passages(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.common import stage
    from flowloom.llm.hamming import sign_codes, top_k

    codes = stage(sign_codes(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return top_k(codes, codes.where("id % 100 = 0"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.suffixes import dedup_suffixes

    done = dedup_suffixes(_read(spark, sf_dir, "documents"), keep_first=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm import chat
    from flowloom.llm.common import stage

    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    hard = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    turns = chat.canonical_turns(chat.conversations_as_records(rows.unionByName(hard)), "record")
    written = stage(chat.format_turns(turns).select("conv_id", "formatted", "loss_spans"))
    back = written.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text("formatted", "loss_spans").alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def queries() -> dict:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from flowloom.llm.oracles import SQL

    return dict(SQL)
