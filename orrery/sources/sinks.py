"""Writers; Spark's commit protocol makes each output whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, keys in column order."""
    rows.write.mode(mode).json(path)


def by_source(rows: DataFrame, path: str, source: str, mode: str = "errorifexists") -> None:
    """A folder for each source; all of them together are ``path``."""
    rows.write.mode(mode).partitionBy(source).json(path)


def report(metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A one-row report as one JSON document."""
    metrics.coalesce(1).write.mode(mode).json(path)


def audit_groups(audit: DataFrame, label: str, key: str) -> DataFrame:
    """Verdict to the sorted list of its keys with their numbers, as a row each."""
    rest = F.struct(*[c for c in audit.columns if c not in (label, key)])
    return audit.groupBy(label).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("scene"), F.to_json(rest).alias("stats")))).alias("scenes"))
