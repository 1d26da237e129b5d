"""A corpus from ``documents`` to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read as the next one's
docs. All but the last give the columns of ``docs``. Rows are judged one by one, those with a null doc_id too, but for
near-dedup, where a row without an id is no copy; rows of equal id and text share their fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontaminate, linededup, neardup, packing, quality
from orrery.llm.common import written


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` less the rows of the ids and texts of ``rejected`` (doc_id, text_hash)."""
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    gone = rejected.select(F.col("doc_id").alias("gone"), "text_hash").distinct()
    return named.join(gone, doc.eqNullSafe(F.col("gone")) & (F.xxhash64(text) == F.col("text_hash")), "left_anti").toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base limit or lie far out of their language and source go."""
    return _without(docs, quality.judged(docs).where("NOT kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the first of each; n_chars follows the text.

    Documents that had lines of four or more tokens and have none left go: other documents keep all they said.
    """
    had = "__had" + "_" * sum(map(len, docs.columns))  # no column of docs is called so
    cut = linededup.without_lines(docs.withColumn(had, linededup.has_lines(docs["text"])))
    cut = cut.where(~F.col(had) | (F.size("__dropped") == 0) | linededup.has_lines(F.col("text")))
    chars = F.when(F.size("__dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    cut = cut.withColumn("n_chars", chars) if "n_chars" in docs.columns else cut
    kept = [c for c in docs.columns if c not in ("__lines", "__dropped")]
    return cut.select(*[cut[f"`{c}`"] for c in kept])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: two-word shingles and similarity 0.8, as in the operator's
    own query; by five words, copies with a changed word in every few dozen are no longer 0.8 alike."""
    return _without(docs, neardup.near_duplicates(docs, size=2, percent=80).where("NOT kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a ten-word window of a benchmark item occurs go."""
    found = decontaminate.search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    kept = [c for c in docs.columns if c not in decontaminate.ADDED.names]
    return found.where(F.size("__items") == 0).select(*[found[f"`{c}`"] for c in kept])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pack", pack),
]

#: SQL expresses neither the robust outliers nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
