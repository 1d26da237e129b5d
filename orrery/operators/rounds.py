"""Draws that may be rejected: rounds of draw, judge and draw again over what is still open, with a census of rejects."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the folder that ``spark.checkpoint.dir`` names, read again: lost executors cost a task only.

    Only where the session names none and runs on one machine (tests) a temporary folder is taken.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "orrery-scratch")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/orrery/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _dealt(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows`` over all cores: they are few in bytes, so would be coalesced into a task or two, but each is drawn for often."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, *key)


@dataclass(frozen=True)
class Drawn:
    """``accepted``: the row of each key that was drawn and found sound. ``census``: (round, reason, n), how many draws
    of a round ended for each reason, ``accepted`` among them; the rows of round -1 count keys, ``filled`` and ``open``.
    ``open``: keys without a row, with the reason that most of their draws ended for."""

    accepted: DataFrame
    census: DataFrame
    open: DataFrame


def in_rounds(
    base: DataFrame,
    key: Sequence[str],
    draw: Callable[[DataFrame], DataFrame],
    judge: Callable[[DataFrame, DataFrame | None], DataFrame],
    settle: Callable[[DataFrame], DataFrame] | None = None,
    tries: int = 60,
    each: int = 10,
    alone: bool = False,
) -> Drawn:
    """Draws for every row of ``base`` (``key`` is unique) until one is sound, ``tries`` times at most.

    ``draw`` gets rows of ``base`` with a number ``attempt`` (the next seed) and adds what is drawn; ``judge`` gets
    these and all rows accepted in earlier rounds and adds ``reason``, null for a sound draw. A key's first sound draw of
    a round is its pick; ``settle``, where picks may clash among themselves, adds ``reason`` to the picks, null for those
    that stand. A round makes ``each`` draws for every open key in one job; draws after a key's pick are not looked at.
    Keys with a null are drawn for like others; an empty ``base`` gives empty tables.

    ``alone`` (without ``settle``): ``judge`` looks at nothing but the draw itself. Then a few draws are judged first and
    more only for what is still open; of most draws the reason alone is written, and picks are drawn once more.
    Draws and rounds of the census are the same.
    """
    key = list(key)
    base = kept(_dealt(base, key), "base")
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key]
    if alone:
        accepted, parts, open_ = _alone(base, key, same, draw, judge, tries, each)
        return _drawn(key, same, accepted, parts, open_)
    open_, accepted, parts = base, None, []
    for turn, low in enumerate(range(0, tries, each)):
        attempts = open_.select("*", F.explode(F.sequence(F.lit(low), F.lit(min(low + each, tries) - 1))).alias("attempt"))
        judged = kept(judge(kept(draw(attempts), "drawn"), accepted), "judged")
        sound = judged.where("reason IS NULL").groupBy(*key).agg(F.min("attempt").alias("__first"))
        both = judged.alias("j").join(sound.alias("s"), same("j", "s"), "left").select("j.*", "__first")
        picks = both.where("attempt = __first").drop("__first", "reason")
        picks = kept(settle(picks) if settle else picks.withColumn("reason", F.lit(None).cast("string")), "picks")
        lost = both.where("__first IS NULL OR attempt < __first").select(*key, "reason")
        ended = lost.unionByName(picks.select(*key, F.coalesce("reason", F.lit("accepted")).alias("reason")))
        parts.append(kept(ended.groupBy(*key, "reason").agg(F.count("*").alias("n")).withColumn("round", F.lit(turn)), "ended"))
        won = picks.where("reason IS NULL").drop("reason")
        accepted = won if accepted is None else accepted.unionByName(won)
        open_ = kept(_dealt(open_.alias("o").join(won.alias("w"), same("o", "w"), "left_anti"), key), "open")
        if open_.isEmpty():
            break
    return _drawn(key, same, accepted, parts, open_)


#: Draws of a key that are judged before it is known whether one of them is sound; doubled while keys stay open.
FEW = 4


def _alone(base, key, same, draw, judge, tries: int, each: int) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """What is accepted, (key, reason, n, round) of the draws that were looked at, and what stays open."""
    open_, accepted, parts = base, None, []
    low, few = 0, min(FEW, each)
    while low < tries:
        attempts = open_.select("*", F.explode(F.sequence(F.lit(low), F.lit(min(low + few, tries) - 1))).alias("attempt"))
        judged = kept(judge(draw(attempts), None).select(*key, "attempt", "reason"), "judged")
        first = judged.where("reason IS NULL").groupBy(*key).agg(F.min("attempt").alias("__first"))
        both = judged.alias("j").join(first.alias("s"), same("j", "s"), "left").where("__first IS NULL OR attempt <= __first")
        turn = F.floor(F.col("attempt") / each).cast("int").alias("round")
        counts = both.select(*[F.col(f"j.{k}").alias(k) for k in key], F.coalesce("reason", F.lit("accepted")).alias("reason"), turn)
        parts.append(kept(counts.groupBy(*key, "reason", "round").agg(F.count("*").alias("n")).select(*key, "reason", "n", "round"), "ended"))
        picks = _dealt(open_.alias("o").join(first.alias("s"), same("o", "s")).select("o.*", F.col("__first").alias("attempt")), key)
        won = kept(judge(draw(picks), None).drop("reason"), "picks")
        accepted = won if accepted is None else accepted.unionByName(won)
        open_ = kept(_dealt(open_.alias("o").join(won.alias("w"), same("o", "w"), "left_anti"), key), "open")
        if open_.isEmpty():
            break
        low, few = low + few, min(2 * few, each)
    return accepted, parts, open_


def _drawn(key, same, accepted: DataFrame, parts: list[DataFrame], open_: DataFrame) -> Drawn:
    ended = parts[0]
    for p in parts[1:]:
        ended = ended.unionByName(p)
    counts = ended.groupBy("round", "reason").agg(F.sum("n").alias("n"))
    keys = accepted.agg(F.lit(-1).alias("round"), F.lit("filled").alias("reason"), F.count("*").alias("n"))
    keys = keys.unionByName(open_.agg(F.lit(-1).alias("round"), F.lit("open").alias("reason"), F.count("*").alias("n")))
    why = ended.where("reason != 'accepted'").groupBy(*key, "reason").agg(F.sum("n").alias("n"))
    why = why.groupBy(*key).agg(F.max_by("reason", F.struct("n", "reason")).alias("reason"))
    left = open_.alias("o").join(why.alias("w"), same("o", "w"), "left").select("o.*", "reason")
    return Drawn(accepted, counts.unionByName(keys.where("n > 0")), left)
