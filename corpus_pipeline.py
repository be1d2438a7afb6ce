"""The corpus pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  All but the last return the columns of ``documents``, further ones too.
An empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import stage
from flowloom.llm.decontaminate import decontaminate
from flowloom.llm.language import UNDETERMINED, LanguageModel, held_out
from flowloom.llm.lines import dedup_lines
from flowloom.llm.packing import pack
from flowloom.llm.simhash import one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that can be told go: null texts and those without a letter.

    Repeated rows each stay; a null id is never learned from.
    """
    model = LanguageModel.fit(docs.where(~held_out("doc_id")))
    return model.predict(docs).where(F.col("lang_pred") != UNDETERMINED).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts, short ones too; empty lines stay, and no document goes.

    Of rows equal in id and text each keeps what the other does.
    """
    return dedup_lines(docs, min_chars=1).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays, that with the smallest id.

    Null ids count as largest and ties go by a hash of the row, so of repeated
    rows one stays too; null and empty texts are a group.
    """
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a test item go; null and empty texts have none, and without items all stay."""
    marked = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=True)
    return marked.where(~F.col("contaminated")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a sequence; null and empty texts are one piece, the end id."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL has no tokenizer, no packing and no trained model; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
