"""Registration of queries beside the SQL that gives the same rows, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, n: int = 18) -> DataFrame:
    """Embeddings as stand-ins for geometry: vec_id, label and the first ``n`` numbers as e0, e1, …"""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(n)])


#: The same for SQL: a common table expression ``p``.
POINTS = "p AS (SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(18)) + " FROM embeddings)"


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time as seconds."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0)


TIMED = "e AS (SELECT *, epoch_us(ts) / 1000000.0 AS t FROM events)"


def r6(c, name: str):
    return F.round(c, 6).alias(name)
