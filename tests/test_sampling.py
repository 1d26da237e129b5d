"""Stratified samples against a sort of every kind."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orrery.operators import sampling


def number(*key, seed):
    return int(hashlib.md5("|".join([*map(str, key), str(seed)]).encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("bits,passes", [(12, 2), (2, 2), (1, 1)])
@pytest.mark.parametrize("n", [0, 7, 150, 5000])
def test_stratified(spark, monkeypatch, n, bits, passes):
    monkeypatch.setattr(sampling, "CELL_BITS", bits)
    monkeypatch.setattr(sampling, "PASSES", passes)
    sizes = {"hot": 400, "b": 60, "c": 59, "one": 1, None: 30}
    rows = [(f"{k}{i}", k) for k, m in sizes.items() for i in range(m)]
    by = defaultdict(list)
    for key, k in rows:
        by[k].append(key)
    ranked = sorted(by, key=lambda k: (-len(by[k]), k is not None, k or ""))
    share = {k: n // len(by) + (i < n % len(by)) for i, k in enumerate(ranked)}
    taken = {x for k, v in by.items() for x in sorted(v, key=lambda x: (number(x, seed=3), x))[: share[k]]}
    rest = sorted((x for x, _ in rows if x not in taken), key=lambda x: (number(x, seed=4), x))
    want = taken | set(rest[: n - len(taken)])
    df = spark.createDataFrame(rows, "key string, kind string").repartition(3)
    got = [r.key for r in sampling.stratified(df, "kind", "key", n, seed=3).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_only_the_cell_of_the_cut_is_ranked(spark):
    df = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("hot").alias("kind"))
    quota = spark.createDataFrame([("hot", 9_000)], "__kind string, q long")
    first, other = sampling.first_of_each(df, "kind", sampling.draw(F.col("key")), "key", quota, "q")
    assert (first.count(), other.count()) == (9_000, 11_000)
    top, low = first.agg(F.max(sampling.draw(F.col("key")))).first()[0], other.agg(F.min(sampling.draw(F.col("key")))).first()[0]
    assert top < low


def farthest(points, n):
    """Row by row, for one group of {id: place}."""
    mean = [sum(p[i] for p in points.values()) / len(points) for i in range(3)]
    square = lambda a, b: sum((u - v) * (u - v) for u, v in zip(a, b))
    chosen = []
    while len(chosen) < min(n, len(points)):
        gap = {k: min(square(p, points[c]) for c in chosen) if chosen else square(p, mean) for k, p in points.items() if k not in chosen}
        chosen.append(min(gap, key=lambda k: (-gap[k], k)))
    return chosen


@pytest.mark.parametrize("n", [1, 4, 40])
def test_farthest_points(spark, n):
    rng = random.Random(5)
    groups = {g: {i: [float(rng.randint(-4, 4)) for _ in range(3)] for i in range(m)} for g, m in (("hot", 60), ("few", 3), ("one", 1), (None, 7))}
    rows = [(g, i, *p, "x") for g, ps in groups.items() for i, p in ps.items()]
    rows += rows[:10]  # repeated rows are one point
    rows += [("hot", None, 1.0, 1.0, 1.0, "x"), ("hot", 900, None, 1.0, 1.0, "x"), ("hot", 901, float("nan"), 0.0, 0.0, "x"), ("bad", 1, float("inf"), 0.0, 0.0, "x")]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double, z double, gap string").repartition(3)
    whole = {g: {i: p for i, p in ps.items()} for g, ps in groups.items()}
    got = {}
    for r in sampling.farthest_points(df, ["g"], n).orderBy("rank").collect():
        got.setdefault(r.g, []).append(r.id)
    assert set(got) == set(groups)
    for g in ("few", "one", None):
        assert got[g] == farthest(whole[g], n)
    assert len(got["hot"]) == min(n, 60) == len(set(got["hot"]))


def test_farthest_points_of_nothing(spark):
    df = spark.createDataFrame([], "g string, id long, x double, y double, z double")
    assert sampling.farthest_points(df, ["g"], 3).count() == 0


def test_shards_share_one_set_of_cuts(spark, monkeypatch):
    """Both uses of the cuts see the same ones, however the quantiles come out when they are made again."""
    made = []
    monkeypatch.setattr(sampling, "kept", lambda df, name, keep=sampling.kept: made.append(name) or keep(df, name))
    rows = spark.range(3_000).select(((F.col("id") * 7919) % 3_000).alias("id")).repartition(5)
    plain = sampling.contiguous_shards(rows, ["id"], 7)
    assert made == ["cuts"] and "percentile" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, r.shard) for r in plain.collect()) == [(i, min(i // (3_000 // 7), 6)) for i in range(3_000)]
