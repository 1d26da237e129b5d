"""Rounds of draws that are judged alone against rounds that keep every draw."""

import pytest
from pyspark.sql import functions as F

from orrery.operators import placing, rounds
from orrery.operators.sampling import uniform


@pytest.mark.parametrize("tries,each", [(23, 5), (7, 10)])
def test_lone_draws_end_as_all_others(spark, tries, each):
    base = spark.createDataFrame([(f"k{i}",) for i in range(80)] + [(None,)], "k string")
    draw = lambda rows: rows.withColumn("u", uniform(F.coalesce("k", F.lit("")), F.col("attempt"), seed=2))
    judge = lambda rows, _: rows.withColumn("reason", F.when(F.col("u") < 0.6, "low").when(F.col("u") < 0.85, "middle"))
    one, two = (rounds.in_rounds(base, ["k"], draw, judge, None, tries, each, alone=a) for a in (False, True))
    for a, b in ((one.accepted, two.accepted), (one.census, two.census), (one.open, two.open)):
        columns = sorted(a.columns)
        assert sorted(map(repr, a.select(*columns).collect())) == sorted(map(repr, b.select(*columns).collect()))


def test_sightlines_write_no_draw_that_is_not_picked(spark, monkeypatch):
    written = {}

    def kept(df, name, keep=rounds.kept):
        out = keep(df, name)
        written.setdefault(name, []).append((len(out.columns), out.count()))
        return out

    monkeypatch.setattr(rounds, "kept", kept)
    scenes = spark.createDataFrame([(f"s{k}", -2.0, -1.0, -2.0, 2.0, 1.0, 2.0) for k in range(30)], "scene_id string, lx double, ly double, lz double, hx double, hy double, hz double")
    done = placing.sightlines(scenes, rays=20, tries=20, each=10)
    assert "drawn" not in written and all(wide == 3 for wide, _ in written["judged"])
    assert sum(n for _, n in written["picks"]) == done.accepted.count()


@pytest.mark.parametrize("alone", [False, True])
def test_draws_are_dealt_over_all_cores(spark, alone):
    base = spark.range(400).repartition(1).withColumnRenamed("id", "k")
    parts = []

    def draw(rows):
        parts.append(rows.rdd.getNumPartitions())
        return rows.withColumn("u", uniform(F.col("k"), F.col("attempt"), seed=2))

    judge = lambda rows, _: rows.withColumn("reason", F.when(F.col("u") < 0.9, "low"))
    rounds.in_rounds(base, ["k"], draw, judge, None, 12, 6, alone=alone)
    assert len(parts) >= 2 and min(parts) >= spark.sparkContext.defaultParallelism > 1
