"""Quality rules: plain limits on a text's statistics, then robust multivariate outliers per language and source.

Statistic vectors are transformed and, per group of language and source, the minimum covariance determinant is sought: from
several starts, concentration steps take mean and covariance of the rows that lie nearest by Mahalanobis distance, again
and again, and the start that ends with the smallest determinant is taken. Its distances are made consistent by their
median. A group too small for its own estimate is judged by its language's, or that of all rows. All of it is DataFrame
operations; quantiles come from counts on a fixed grid, so that groups of any size take bounded memory, and groups'
numbers are broadcast to their rows as long as there are few groups, so that a hot group is no task's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import written

SPACE = "[\\x20\\x09-\\x0D]"
#: Words of the windows whose repetition counts, and the base limits.
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
#: Dimensions of the statistic vector.
P = 5
#: Share of a group that the concentration steps keep, their number, and the rows that a group must have to be judged by
#: its own estimate.
SHARE, STEPS, LEAST_ROWS = 0.75, 3, 60
#: Starts of the concentration steps: medians, all rows, and the rows nearest to the medians in their worst dimension.
STARTS = 3
#: Squared Mahalanobis distance, in units of the median one (4.35 is that of normal vectors), beyond which a vector is
#: rejected: statistics of clean texts have long tails, so the cut is far beyond a normal vector's.
CUTOFF = 60.0
#: Groups whose numbers are broadcast at most (some 400 bytes each).
GROUPS_SENT = 20_000
#: Steps of the grid for quantiles: values a unit, distances an octave.
GRID = 64
#: Least spread of a dimension: what is constant in a group must not reject on rounding.
FLOOR = 0.05


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the text's hash and the counts of each row's whole text."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, SPACE + "+"), "")
    t = docs.select("doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"), text.alias("text"), words.alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    t = t.select("doc_id", "lang", "source", "text_hash", "text", lines.alias("lines"), "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    begins = F.sequence(F.lit(1), F.greatest(F.size("h") - WINDOW + 1, F.lit(1)))
    hashes = F.transform(begins, lambda i: F.xxhash64(F.slice("h", i, F.lit(WINDOW))))
    windows = F.when(F.size("h") >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))
    t = t.select(
        "doc_id", "lang", "source", "text_hash",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("g"),
    )
    repeated = F.when(F.size(F.array_distinct("g")) < F.size("g"), _covered(F.col("g"))).otherwise(0)
    return t.select("doc_id", "lang", "source", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.cast("long").alias("n_repeat_words"))


def _covered(g: Column) -> Column:
    """Words in windows whose hash is in ``g`` twice or more."""
    n = F.size(g)
    ranked = F.array_sort(F.arrays_zip(g.alias("h"), F.sequence(F.lit(0), n - 1).alias("i")))
    ends = F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("int").alias("i")))
    after = F.concat(F.slice(ranked, 2, n), ends)
    before = F.concat(ends, F.slice(ranked, 1, n - 1))
    like_next = F.zip_with(ranked, after, lambda a, b: F.when(a["h"] == b["h"], a["i"]))
    like_last = F.zip_with(ranked, before, lambda a, b: F.when(a["h"] == b["h"], a["i"]))
    twice = F.array_sort(F.array_compact(F.zip_with(like_next, like_last, lambda a, b: F.coalesce(a, b))))
    gaps = F.zip_with(twice, F.slice(twice, 2, n), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)


def _vector(base: DataFrame) -> DataFrame:
    n = F.greatest("n_words", F.lit(1)).cast("double")
    parts = (F.log1p("n_words"), F.col("word_chars") / n, F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n))
    return base.withColumns({f"x{i}": x for i, x in enumerate(parts)})


KEYS = ["g0", "g1", "g2"]
_TRIANGLE = [(i, j) for i in range(P) for j in range(i + 1)]


def _grid_quantile(rows: DataFrame, keys: list[str], value: Column, q: float) -> DataFrame:
    """The ``q`` quantile of ``value`` per keys, up to a step of the grid."""
    counts = rows.select(*keys, F.floor(value * GRID).alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("c"))
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    summed = counts.withColumn("up", F.sum("c").over(up)).withColumn("n", F.sum("c").over(whole))
    at = summed.where(F.col("up") >= F.ceil(F.col("n") * q))
    return at.groupBy(*keys).agg(((F.min("bin") + 0.5) / GRID).alias("q"), F.first("n").alias("n"))


def _medians(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """m0.. per group: the medians of the columns."""
    long = rows.select(*KEYS, F.posexplode(F.array(*columns)).alias("dim", "v"))
    by = _grid_quantile(long, [*KEYS, "dim"], F.col("v"), 0.5)
    return by.groupBy(*KEYS).agg(*[F.max(F.when(F.col("dim") == i, F.col("q"))).alias(f"m{i}") for i in range(P)])


def _joined(rows: DataFrame, groups: DataFrame, few: bool, keys: list[str] = KEYS) -> DataFrame:
    """Each row with its group's numbers; they are broadcast where there are few, else Spark may split a hot group."""
    return rows.join(F.broadcast(groups) if few else groups, keys)


def _distance(mean: list[Column], cov: dict[tuple[int, int], Column]) -> Column:
    """Squared Mahalanobis distance of x0.., through the Cholesky factor (columns l_i_j)."""
    solved: list[Column] = []
    for i in range(P):
        rest = reduce(lambda a, j: a - F.col(f"l_{i}_{j}") * solved[j], range(i), F.col(f"x{i}") - mean[i])
        solved.append(rest / F.col(f"l_{i}_{i}"))
    return reduce(lambda a, b: a + b, [s * s for s in solved])


def _factored(groups: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_i_j of the covariance c_i_j, the floor on its diagonal."""
    out = groups
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}") + (FLOOR**2 if i == j else 0.0)
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            value = F.sqrt(F.greatest(rest, F.lit(FLOOR**2 / 4))) if i == j else rest / F.col(f"l_{j}_{j}")
            out = out.withColumn(f"l_{i}_{j}", value)
    return out


def _octave(d: Column) -> Column:
    return F.log2(d + 1e-6)


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """u0.. and c_i_j: mean and covariance of the rows of each group."""
    sums = [F.avg(f"x{i}").alias(f"u{i}") for i in range(P)] + [F.covar_pop(f"x{i}", f"x{j}").alias(f"c_{i}_{j}") for i, j in _TRIANGLE]
    return rows.groupBy(*keys).agg(*sums)


def estimates(fit: DataFrame, few: bool) -> DataFrame:
    """By KEYS: mean u0.., covariance c_i_j, its factor l_i_j, and half the logarithm of its determinant.

    The best of STARTS after STEPS concentration steps, each on the nearest SHARE of the rows of ``fit`` (KEYS, x0..).
    """
    xs, keys = [F.col(f"x{i}") for i in range(P)], [*KEYS, "start"]
    middle = _medians(fit, xs)
    spread = _medians(_joined(fit, middle, few), [F.abs(x - F.col(f"m{i}")) for i, x in enumerate(xs)])
    middle = middle.join(spread.select(*KEYS, *[F.greatest(F.col(f"m{i}") * 1.4826, F.lit(FLOOR)).alias(f"s{i}") for i in range(P)]), KEYS)
    middle = written(middle, "medians")
    worst = F.greatest(*[F.abs(x - F.col(f"m{i}")) / F.col(f"s{i}") for i, x in enumerate(xs)])
    scaled = _joined(fit, middle, few).select(*fit.columns, _octave(worst).alias("d"))
    close = _joined(scaled, _grid_quantile(scaled, KEYS, F.col("d"), 0.5).select(*KEYS, "q"), few).where("d <= q")
    shape = [F.col(f"m{i}").alias(f"u{i}") for i in range(P)]
    shape += [(F.pow(f"s{i}", F.lit(2)) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in _TRIANGLE]
    starts = [middle.select(*KEYS, *shape), _moments(fit, KEYS), _moments(close, KEYS)]
    starts = [x.withColumn("start", F.lit(i)) for i, x in enumerate(starts)]
    groups = written(_factored(starts[0].unionByName(starts[1]).unionByName(starts[2])), "starts")
    distance = _distance([F.col(f"u{i}") for i in range(P)], {})
    for _ in range(STEPS):
        measured = _joined(fit, groups, few).select(*fit.columns, "start", _octave(distance).alias("d"))
        limit = _grid_quantile(measured, keys, F.col("d"), SHARE).select(*keys, "q")
        near = _joined(measured, limit, few, keys).where(F.col("d") <= F.col("q") + 0.5 / GRID)  # the whole step: SHARE at least
        groups = written(_factored(_moments(near, keys)), "groups")
    half = sum((F.log(f"l_{i}_{i}") for i in range(P)), F.lit(0.0))
    columns = [c for c in groups.columns if c not in keys]
    best = groups.withColumn("determinant", half).groupBy(*KEYS).agg(F.min_by(F.struct(*columns, "determinant"), F.struct("determinant", "start")).alias("best"))
    return written(best.select(*KEYS, "best.*"), "estimates")


def outliers(base: DataFrame) -> DataFrame:
    """Adds ``distance``: the squared robust distance in units of the group's median one.

    A group is language and source if it has LEAST_ROWS rows that pass the base limits, else the language if that has
    so many, else all rows. Null only if no row passes the base limits.
    """
    rows = _vector(base).withColumns({"lang_": F.coalesce("lang", F.lit("")), "source_": F.coalesce("source", F.lit(""))})
    passed = rows.where("NOT base_failed")
    cells = written(passed.groupBy("lang_", "source_").agg(F.count("*").alias("n")), "cells")
    every = written(rows.select("lang_", "source_").distinct(), "sources").join(cells, ["lang_", "source_"], "left")
    langs = cells.groupBy("lang_").agg(F.sum("n").alias("n_lang"))
    level = F.when(F.col("n") >= LEAST_ROWS, 2).when(F.col("n_lang") >= LEAST_ROWS, 1).otherwise(0)
    few = every.count() <= GROUPS_SENT
    # the group by which each language and source is judged; g0 keeps the levels' keys apart
    named = [level.alias("g0"), F.when(level > 0, F.col("lang_")).otherwise("").alias("g1"), F.when(level == 2, F.col("source_")).otherwise("").alias("g2")]
    judges = written(every.join(langs, "lang_", "left").select("lang_", "source_", *named), "judges")
    # an estimate is fitted on all rows of its group, whichever of them it judges
    wanted = judges.select(*KEYS).distinct()
    levels = F.array(
        F.struct(F.lit(2).alias("g0"), F.col("lang_").alias("g1"), F.col("source_").alias("g2")),
        F.struct(F.lit(1).alias("g0"), F.col("lang_").alias("g1"), F.lit("").alias("g2")),
        F.struct(F.lit(0).alias("g0"), F.lit("").alias("g1"), F.lit("").alias("g2")),
    )
    members = cells.select("lang_", "source_", F.inline(levels)).join(wanted, KEYS, "left_semi")
    fit = passed.join(F.broadcast(members) if few else members, ["lang_", "source_"]).select(*KEYS, *[f"x{i}" for i in range(P)])
    groups = estimates(fit, few)
    distance = _distance([F.col(f"u{i}") for i in range(P)], {})
    measured = _joined(fit, groups, few).select(*KEYS, _octave(distance).alias("d"))
    middle = _grid_quantile(measured, KEYS, F.col("d"), 0.5).select(*KEYS, "q")
    final = judges.join(groups.join(middle, KEYS), KEYS)
    out = rows.join(F.broadcast(final) if few else final, ["lang_", "source_"], "left")
    return out.select(*base.columns, (distance / F.greatest(F.pow(F.lit(2.0), F.col("q")), F.lit(0.5))).alias("distance"))


def judged(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, text_hash, the base counts, base_failed, distance and kept for each row of ``docs`` (doc_id, text, lang, source).

    base_failed: fewer than 20 words, or more than 30 % of the words in repeated 8-word windows. Other rows are
    rejected where their distance is above ``cutoff`` medians, taken from the language where language and source have
    fewer than LEAST_ROWS rows, and from all rows where the language has fewer too.
    Null texts have no words; null languages and sources form groups of their own; repeated rows are judged each;
    extra columns are ignored; an empty table gives none.
    """
    base = base_statistics(docs)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    base = written(base.withColumn("base_failed", failed), "statistics")
    return outliers(base).withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff))


def op5(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents``, judged within its language and source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
