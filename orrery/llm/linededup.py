"""Line deduplication by a log-template tree of fixed depth.

A line descends by its token count and then its leading tokens, runs of digits masked. In the leaf it ends in, a token
is as frequent as the leaf's distinct lines that have it at its place. Most of a line's tokens are its constants: how
frequent the least frequent of CONSTANT of its tokens is, is the line's measure, and a token at most half as frequent is
a variable field. So a field with many values is generalised however often each value recurs. A line with its variable
fields masked is its template. Templates that recur across documents are boilerplate: their lines are dropped, but for
the first one, so that a group of copies keeps one whole text.

Only leaves with lines that differ are looked at token by token, and equal lines of a leaf count as one there. A
document is a doc_id; lines are told apart by doc_id, text and number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import shared, written

#: Leading tokens that the tree branches on; fewer tokens make no template: such lines recur by chance in prose.
DEPTH, LEAST_TOKENS = 4, 4
#: Share of a line's tokens that are its constants at least.
CONSTANT = 0.7
VARIABLE = "<*>"


def _tokens(line: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(line, "[0-9]+", "0"), "[\\x20\\x09-\\x0D]+"), "")


def has_lines(text: Column) -> Column:
    """Whether a text has a line of tokens enough for a template."""
    return F.coalesce(F.exists(F.split(text, "\n"), lambda x: F.size(_tokens(x)) >= LEAST_TOKENS), F.lit(False))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, line (from 0), tokens of each \\n-split line that has tokens enough for a template."""
    lines = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("line", "l"))
    return lines.select("doc_id", "h", "line", _tokens(F.col("l")).alias("t")).where(F.size("t") >= LEAST_TOKENS)


def _recurring(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hashes of all lines; the distinct lines of each leaf; by row, the lines to look at token by token."""
    leaf = F.xxhash64(F.size("t"), F.slice("t", 1, DEPTH))
    light = written(lines.select("doc_id", "h", "line", leaf.alias("leaf"), F.xxhash64(F.col("t"), F.lit(1)).alias("same")), "lines")
    variants = light.groupBy("leaf", "same").agg(F.min(F.struct("doc_id", "h", "line")).alias("first"), F.max("doc_id").alias("last_doc"))
    variants = written(variants, "variants")
    mixed = variants.groupBy("leaf", shared(F.col("leaf")).alias("__s")).agg(F.count("*").alias("n"), F.min("first.doc_id").alias("a"), F.max("last_doc").alias("b"))
    mixed = mixed.where("n > 1 AND a < b").select("leaf", "n")
    # one line of each variant in a mixed leaf, token by token
    wanted = variants.join(mixed, "leaf").select(F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h"), F.col("first.line").alias("line"), "leaf", "same", "n")
    by_row = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("line", "leaf", "same", "n")).alias("w"))
    return light, variants, by_row


def _templates(docs: DataFrame, by_row: DataFrame) -> DataFrame:
    """same, leaf, template of the variants that ``by_row`` asks for."""
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), "text").join(by_row, ["doc_id", "h"])
    asked = texts.select(F.inline("w"), F.split("text", "\n").alias("lines")).select("leaf", "same", "n", F.get("lines", F.col("line")).alias("l"))
    asked = written(asked.select("leaf", "same", "n", _tokens(F.col("l")).alias("t")).dropDuplicates(["leaf", "same"]), "asked")
    tokens = asked.select("leaf", "same", F.posexplode("t").alias("place", "token")).where(F.col("place") >= DEPTH)
    tokens = tokens.select("same", "place", F.xxhash64("leaf", "place", "token").alias("key"))
    frequent = tokens.groupBy("key", shared(F.col("key")).alias("__s")).agg(F.count("*").alias("f")).where("f > 1").select("key", "f")
    found = tokens.join(frequent, "key").groupBy("same").agg(F.collect_list(F.struct("place", "f")).alias("fs"))
    masked = asked.join(found, "same", "left")
    # how frequent each token is, in the order of places: 1 where nothing else is found, the leaf's lines for leading ones
    size = F.size("t")
    ones = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(i.alias("place"), F.lit(1).cast("bigint").alias("f")))
    ones = F.slice(ones, DEPTH + 1, size - DEPTH)
    pairs = F.array_sort(F.concat(F.coalesce("fs", F.slice(ones, 1, 0)), ones))
    masked = masked.select("leaf", "same", "n", "t", pairs.alias("p"))
    most = F.zip_with("p", F.slice("p", 2, F.size("p")), lambda a, b: F.when(b["place"].isNull() | (b["place"] != a["place"]), a["f"]))
    masked = masked.select("leaf", "same", "t", F.concat(F.array_repeat(F.col("n"), DEPTH), F.array_compact(most)).alias("f"))
    measure = F.get(F.sort_array("f", asc=False), F.ceil(F.size("t") * CONSTANT).cast("int") - 1)
    # bound as a variable, the measure is taken once a line, not once a token
    kept = F.get(F.transform(F.array(measure), lambda r: F.zip_with("t", "f", lambda x, f: F.when(2 * f > r, x).otherwise(VARIABLE))), F.lit(0))
    return masked.select("leaf", "same", F.xxhash64("leaf", kept).alias("template"))


def drops(docs: DataFrame) -> DataFrame:
    """doc_id, text hash (h) and the sorted numbers of the lines to drop."""
    light, variants, by_row = _recurring(lines_of(docs))
    named = _templates(docs, by_row)
    whole = written(variants.join(named, ["leaf", "same"], "left").select("leaf", "same", "first", "last_doc", F.coalesce("template", "same").alias("template")), "templates")
    recurs = whole.groupBy("template", shared(F.col("template")).alias("__s")).agg(F.min("first").alias("keep"), F.max("last_doc").alias("b")).where("keep.doc_id < b").select("template", "keep")
    dropped = whole.join(recurs, "template").select("same", F.col("leaf").alias("leaf_"), "keep")
    lines = light.join(dropped, "same").where("leaf = leaf_ AND struct(doc_id, h, line) != keep")
    return lines.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("line")).alias("dropped"))


def _mask(numbers: str) -> Column:
    """A byte for each line up to the last of the sorted ``numbers``: 1 for those, 0 for others. A look at one byte takes
    as long wherever it is."""
    before = F.concat(F.array(F.lit(-1)), F.col(numbers))
    marks = F.zip_with(before, numbers, lambda a, b: F.when(b.isNotNull(), F.concat(F.repeat(F.lit("0"), b - a - 1), F.lit("1"))).otherwise(""))
    return F.array_join(marks, "").cast("binary")


def without_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring lines cut from ``text``; adds __lines (before) and __dropped (numbers from 0).

    A line's place is its number among the \\n-split lines; the lines that stay are joined by \\n as they were. Null
    and empty texts and rows with a null doc_id come back as they are. Rows with the same doc_id count as one document:
    lines that recur only within them stay; each keeps its own lines, and equal rows are cut alike. Columns named
    __lines or __dropped are replaced, all others pass through; an empty table gives none.
    """
    base = docs.drop("__lines", "__dropped")
    columns = base.columns
    cut = drops(base.select("doc_id", "text")).select(F.col("doc_id").alias("__doc"), F.col("h").alias("__hash"), F.col("dropped").alias("__cut"), _mask("dropped").alias("__mask"))
    named = base.toDF(*[f"c{i}" for i in range(len(columns))])
    doc, body = (F.col(f"c{columns.index(c)}") for c in ("doc_id", "text"))
    both = named.join(cut, (doc == F.col("__doc")) & (F.xxhash64(body) == F.col("__hash")), "left")
    split = F.split(body, "\n")
    left = F.array_join(F.filter(split, lambda x, i: F.coalesce(F.substring("__mask", i + 1, F.lit(1)) != F.lit(b"1"), F.lit(True))), "\n")
    text = F.when(F.col("__cut").isNull(), body).otherwise(left)
    lines = F.when(body.isNull(), 0).otherwise(F.size(split)).cast("long").alias("__lines")
    return both.select(*[text.alias(c) if c == "text" else F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], lines, F.coalesce("__cut", F.array().cast("array<int>")).alias("__dropped"))


def op2(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` without the lines of recurring templates."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_lines(docs).select("doc_id", F.col("__lines").alias("n_lines"), F.size("__dropped").cast("long").alias("n_dropped"), "text")


#: DuckDB's answer to the same question, token by token over every line.
SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, i - 1 AS line, ls[i] AS l FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)),
t AS (
  SELECT doc_id, line, list_filter(string_split_regex(regexp_replace(l, '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+'), lambda s: s <> '') AS t FROM x
), k AS (SELECT doc_id, line, t, len(t) AS n, list_slice(t, 1, 4) AS head FROM t WHERE len(t) >= 4),
mixed AS (SELECT n, head FROM k GROUP BY n, head HAVING count(DISTINCT t) > 1 AND min(doc_id) < max(doc_id)),
v AS (SELECT n, head, t, min(doc_id) AS a, max(doc_id) AS b FROM k JOIN mixed USING (n, head) GROUP BY n, head, t),
leaf AS (SELECT n, head, count(DISTINCT t) AS c FROM v GROUP BY n, head),
tok AS (SELECT n, head, t, i, t[i] AS tok FROM (SELECT n, head, t, unnest(range(5, n + 1)) AS i FROM v)),
fr AS (SELECT n, head, t, i, count(*) OVER (PARTITION BY n, head, i, tok) AS f FROM tok),
fs AS (SELECT n, head, t, list(f ORDER BY i) AS f FROM fr GROUP BY n, head, t),
meas AS (
  SELECT n, head, t, list_concat([c, c, c, c], coalesce(f, [])) AS f,
         list_reverse_sort(list_concat([c, c, c, c], coalesce(f, [])))[CAST(ceil(n * 0.7::DOUBLE) AS INTEGER)] AS r
  FROM v JOIN leaf USING (n, head) LEFT JOIN fs USING (n, head, t)
), named AS (
  SELECT n, head, t, list_transform(range(1, n + 1), lambda i: CASE WHEN 2 * f[i] > r THEN t[i] ELSE '<*>' END) AS tpl FROM meas
), full_ AS (SELECT doc_id, line, coalesce(tpl, t) AS tpl FROM k LEFT JOIN named USING (n, head, t)),
rec AS (SELECT tpl, min({'d': doc_id, 'l': line}) AS keep FROM full_ GROUP BY tpl HAVING min(doc_id) < max(doc_id)),
cut AS (SELECT doc_id, line FROM full_ JOIN rec USING (tpl) WHERE doc_id <> keep.d OR line <> keep.l),
stay AS (
  SELECT x.doc_id, count(*) AS n_lines, count(cut.line) AS n_dropped,
         coalesce(string_agg(CASE WHEN cut.line IS NULL THEN l END, chr(10) ORDER BY x.line), '') AS text
  FROM x LEFT JOIN cut ON cut.doc_id = x.doc_id AND cut.line = x.line GROUP BY x.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE stay.text END AS text
FROM documents d LEFT JOIN stay USING (doc_id)
"""
