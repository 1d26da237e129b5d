"""What the operators of this subpackage share: scratch tables, salted ranks, joins that survive hot keys."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one salt of a rank holds on average, and the salts that there are at least.
ROWS_A_SALT, LEAST_SALTS = 200_000, 256


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that the session names in ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary folder is taken; on a cluster, whose
    machines do not share theirs, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    if not base:
        base = "file://" + os.path.join(tempfile.gettempdir(), "orrery-scratch")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/orrery/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_rank(df: DataFrame, keys: Sequence[str], spread: Sequence[str], out: str, rows: int) -> DataFrame:
    """Adds ``out``: gapless ranks from 0 within ``keys``, whatever share of the rows one key holds.

    Rows of a key are spread over salts by a hash of ``spread``; a rank is the place in the salt plus the rows of
    the key's lower salts. ``rows`` (the number of rows) sets the number of salts, so that no task gets a whole hot
    key. Equal rows share a salt and get different ranks. ``df`` should be a written table: it is read twice.
    """
    salts = LEAST_SALTS + rows // ROWS_A_SALT
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    keys = list(keys)
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy(*keys, "__salt").agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    counts = counts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__salt").alias("__k_salt"), "__base")
    inside = Window.partitionBy(*keys, "__salt").orderBy(*spread)
    ranked = salted.withColumn("__place", F.row_number().over(inside) - 1)
    on = (F.col("__salt") == F.col("__k_salt")) & _all([F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    joined = ranked.join(counts, on)
    return joined.select(*df.columns, (F.col("__base") + F.col("__place")).cast("long").alias(out))


def _all(conditions: Sequence[Column]) -> Column:
    whole = F.lit(True)
    for c in conditions:
        whole = whole & c
    return whole


def shared(text: Column) -> Column:
    """A second grouping key that follows from the first.

    Grouping by ``(key, shared(key))`` and joining on ``key`` alone puts an exchange of its own on both sides of
    the join, which lets Spark split the partition of a hot key.
    """
    return F.pmod(F.xxhash64(text), F.lit(7)).cast("int")


def union_rows(frames: Sequence[DataFrame]) -> DataFrame:
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    return whole
