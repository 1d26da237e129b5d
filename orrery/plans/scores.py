"""Queries over answer scores and reports. Columns of the driver's tables stand in for predictions and truths."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import boxes, text
from orrery.operators import annotations, joins, ngrams, reports
from orrery.plans.base import POINTS, points, query, r6, table

_TOLERANCES = "[" + ", ".join(map(repr, text.TOLERANCES)) + "]::DOUBLE[]"
_MRA = f"""s AS (SELECT l_returnflag, l_linestatus, l_quantity AS v, l_quantity * (1 + l_tax) - l_discount * 20 AS g FROM lineitem),
m AS (SELECT *, CASE WHEN g = 0 THEN CASE WHEN abs(v) <= 0 THEN 1.0 ELSE 0.0 END
             ELSE len(list_filter({_TOLERANCES}, lambda x: abs(v - g) / abs(g) <= x)) / 10.0 END::DOUBLE AS score FROM s)"""


def _scored(spark, d):
    li = table(spark, d, "lineitem")
    target = F.col("l_quantity") * (1 + F.col("l_tax")) - F.col("l_discount") * 20
    return li.select("l_returnflag", "l_linestatus", text.relative_accuracy(F.col("l_quantity"), target).alias("score"))


@query("mra_score", f"WITH {_MRA} SELECT l_returnflag, l_linestatus, round(avg(score), 6) AS mean, count(*) AS n FROM m GROUP BY ALL")
def mra_score(spark, d):
    """Mean relative accuracy of quantities against quantities with tax and discount."""
    return _scored(spark, d).groupBy("l_returnflag", "l_linestatus").agg(r6(F.avg("score"), "mean"), F.count("*").alias("n"))


@query("macro_official_overall", f"""WITH {_MRA}, t AS (SELECT l_linestatus, l_returnflag, avg(score) AS m FROM m GROUP BY ALL),
f AS (SELECT l_linestatus, avg(m) AS m FROM t GROUP BY ALL) SELECT round(avg(m), 6) AS official_overall FROM f""")
def macro(spark, d):
    out = reports.official_overall(_scored(spark, d), "l_returnflag", "l_linestatus", "score")
    return out.select(r6(F.col("official_overall"), "official_overall"))


@query("pooled_family", f"WITH {_MRA} SELECT l_linestatus, round(avg(score), 6) AS mean, count(*) AS n FROM m GROUP BY ALL")
def pooled(spark, d):
    return reports.pooled(_scored(spark, d), "l_linestatus", "score").select("l_linestatus", r6(F.col("mean"), "mean"), "n")


@query("micro_average", f"WITH {_MRA} SELECT round(avg(score), 6) AS all_questions_average, count(*) AS n FROM m")
def micro(spark, d):
    return reports.micro(_scored(spark, d), "score").select(r6(F.col("all_questions_average"), "all_questions_average"), "n")


@query("display_order", f"""WITH {_MRA}, t AS (SELECT l_returnflag, avg(score) AS mean FROM m GROUP BY ALL)
SELECT l_returnflag, round(mean, 6) AS mean, row_number() OVER (ORDER BY CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END, l_returnflag)::INT AS place FROM t""")
def display_order(spark, d):
    rows = reports.by_type(_scored(spark, d), "l_returnflag", "score").select("l_returnflag", r6(F.col("mean"), "mean"))
    return reports.displayed(rows, "l_returnflag", ["R", "N"])


@query("benchmark_score", """WITH q AS (SELECT l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'object_counting' ELSE 'route_planning' END AS kind,
  l_linenumber::VARCHAR || '. of' AS pred, (l_linenumber % 3 + 1)::VARCHAR AS truth FROM lineitem),
s AS (SELECT kind, CASE WHEN kind = 'route_planning' THEN (rtrim(split_part(trim(pred), ' ', 1), '.') = truth)::INT::DOUBLE
  ELSE len(list_filter(""" + _TOLERANCES + """, lambda x: abs(l_linenumber - truth::DOUBLE) / truth::DOUBLE <= x)) / 10.0 END AS score FROM q)
SELECT kind, round(avg(score), 6) AS mean, count(*) AS n FROM s GROUP BY kind""")
def benchmark(spark, d):
    """Line numbers as answers, routed by question type."""
    li = table(spark, d, "lineitem")
    kind = F.when(F.col("l_linenumber") % 2 == 0, "object_counting").otherwise("route_planning")
    pred, truth = F.concat(F.col("l_linenumber").cast("string"), F.lit(". of")), (F.col("l_linenumber") % 3 + 1).cast("string")
    # equal answers to equal questions score alike: each is scored once and counts as often as it is given
    given = li.select(kind.alias("kind"), pred.alias("pred"), truth.alias("truth")).groupBy("kind", "pred", "truth").agg(F.count("*").alias("times"))
    q = given.select("kind", "times", text.benchmark_score(F.col("pred"), F.col("truth"), F.col("kind")).alias("score"))
    mean = F.sum(F.col("score") * F.col("times")) / F.sum(F.when(F.col("score").isNotNull(), F.col("times")))
    return q.groupBy("kind").agg(r6(mean, "mean"), F.sum("times").alias("n"))


@query("balanced_report", """SELECT o_orderstatus, o_orderpriority, month(o_orderdate)::INT AS m, round(avg((o_totalprice > 150000)::INT), 6) AS mean, count(*) AS n,
grouping_id(o_orderstatus, o_orderpriority, month(o_orderdate)) AS level
FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus, month(o_orderdate)), (o_orderstatus))""")
def balanced(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.month("o_orderdate").alias("m"), (F.col("o_totalprice") > 150000).cast("int").alias("s"))
    out = reports.balanced(o, "o_orderstatus", "o_orderpriority", "m", "s")
    return out.select("o_orderstatus", "o_orderpriority", "m", r6(F.col("mean"), "mean"), "n", F.col("level").cast("long").alias("level"))


@query("regression_stats", """WITH x AS (SELECT l_quantity * p_retailprice / 1000 AS p, l_extendedprice / 1000 AS g FROM lineitem JOIN part ON l_partkey = p_partkey), d AS (SELECT *, abs(p - g) AS e FROM x)
SELECT count(*) AS reg_n, round(avg(e), 6) AS reg_mae, round(median(e), 6) AS reg_medae, round(avg((e <= 0.01)::INT), 6) AS reg_within_1cm,
round(avg((e <= 2.0)::INT), 6) AS reg_within_2_0m, round(avg(p), 6) AS reg_pred_mean, round(stddev_pop(p), 5) AS reg_pred_std, round(avg(g), 6) AS reg_gt_mean, round(corr(p, g), 6) AS reg_pearson_r FROM d""")
def regression(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    s = reports.regression(li, F.col("l_quantity") * F.col("p_retailprice") / 1000, F.col("l_extendedprice") / 1000)
    return s.select("reg_n", *[r6(F.col(c), c) for c in ("reg_mae", "reg_medae", "reg_within_1cm", "reg_within_2_0m", "reg_pred_mean")], F.round("reg_pred_std", 5).alias("reg_pred_std"), r6(F.col("reg_gt_mean"), "reg_gt_mean"), r6(F.col("reg_pearson_r"), "reg_pearson_r"))


def _box(first: int, size: float):
    return F.array(*[F.col(f"e{first + i}") for i in range(3)], *[F.abs(F.col(f"e{first + 3 + i}")) + size for i in range(3)])


_BOXES = "b AS (SELECT *, " + ", ".join(f"e{i} AS ax{i}, e{6 + i} AS bx{i}, abs(e{3 + i}) + 3.0 AS ad{i}, abs(e{9 + i}) + 3.0 AS bd{i}" for i in range(3)) + " FROM p)"
_SPANS = "s AS (SELECT *, " + ", ".join(f"least(ax{i} + ad{i} / 2, bx{i} + bd{i} / 2) - greatest(ax{i} - ad{i} / 2, bx{i} - bd{i} / 2) AS s{i}" for i in range(3)) + ", sqrt((ax0 - bx0) ** 2 + (ax1 - bx1) ** 2 + (ax2 - bx2) ** 2) AS far FROM b)"
_IOU = "i AS (SELECT *, CASE WHEN least(s0, s1, s2) <= 0 THEN 0.0 ELSE s0 * s1 * s2 / (ad0 * ad1 * ad2 + bd0 * bd1 * bd2 - s0 * s1 * s2) END AS iou FROM s)"


@query("iou_pairs", f"WITH {POINTS}, {_BOXES}, {_SPANS}, {_IOU} SELECT vec_id, round(iou, 6) AS iou, round(far, 6) AS distance FROM i")
def iou_pairs(spark, d):
    a, b = _box(0, 3.0), _box(6, 3.0)
    return points(spark, d).select("vec_id", r6(boxes.iou(a, b), "iou"), r6(boxes.centre_distance(a, b), "distance"))


@query("grounding_stats", f"""WITH {POINTS}, {_BOXES}, {_SPANS}, {_IOU} SELECT round(avg((iou >= 0.25)::INT), 6) AS acc_0_25, round(avg((iou >= 0.5)::INT), 6) AS acc_0_5,
round(avg(iou), 6) AS mean_iou, round(median(iou), 6) AS median_iou, count(iou) AS n, count(*) AS total, round(avg(far), 6) AS centre_mean, round(avg((far <= 0.5)::INT), 6) AS within_0_5m FROM i""")
def grounding(spark, d):
    a, b = _box(0, 3.0), _box(6, 3.0)
    s = reports.grounding(points(spark, d), boxes.iou(a, b), boxes.centre_distance(a, b))
    return s.select(*[r6(F.col(c), c) for c in ("acc_0_25", "acc_0_5", "mean_iou", "median_iou")], "n", "total", r6(F.col("centre_mean"), "centre_mean"), r6(F.col("within_0_5m"), "within_0_5m"))


_WORDS = r"""translate(array_to_string(list_transform(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\p{{M}}_]+|[^\p{{L}}\p{{N}}\p{{M}}_]+'),
 lambda w: CASE WHEN w IN ('a', 'an', 'the') THEN ' ' ELSE w END), ''), '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', '')"""
_NORM = "trim(regexp_replace(" + _WORDS + r", '\s+', ' ', 'g'))"


@query("text_normalize", f"SELECT doc_id, md5({_NORM.format('text')}) AS digest FROM documents")
def text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(text.normalized(F.col("text")), "UTF-8")).alias("digest"))


def _turns(spark, d):
    c = table(spark, d, "conversations")
    a = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    return a.join(c.where("role = 'assistant'").select("conv_id", "turn", "text"), ["conv_id", "turn"])


@query("match_scores", f"""WITH t AS (SELECT a.conv_id, a.turn, u.text AS asked, a.text AS reply, trim(split_part(a.text, chr(10), 1)) AS line FROM conversations a
  JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user' WHERE a.role = 'assistant'),
n AS (SELECT conv_id, turn, {_NORM.format('line')} AS p, {_NORM.format('reply')} AS g, {_NORM.format('asked')} AS h FROM t),
b AS (SELECT *, replace(p, ' ', '') AS pb, replace(g, ' ', '') AS gb, replace(h, ' ', '') AS hb FROM n)
SELECT conv_id, turn, (p = g OR p = h)::INT AS em, (pb <> '' AND (gb <> '' AND (contains(gb, pb) OR contains(pb, gb)) OR hb <> '' AND (contains(hb, pb) OR contains(pb, hb))))::INT AS refined FROM b""")
def match_scores(spark, d):
    """The first line of a reply as prediction; the reply and the question as truths."""
    t = _turns(spark, d)
    pred, truths = text.first_line(F.col("text")), F.array("text", "asked")
    return t.select("conv_id", "turn", text.exact_match(pred, truths).alias("em"), text.refined_match(pred, truths).alias("refined"))


@query("fuzzy_first_token", "SELECT conv_id, turn, lower(trim(rtrim(split_part(trim(text), ' ', 1), '.'))) AS token FROM conversations")
def fuzzy(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.first_token(F.col("text")).alias("token"))


@query("turn_sequence_score", """WITH x AS (SELECT o_orderkey, list_transform(range(1, 4), lambda i: CASE WHEN (o_orderkey * i) % 3 = 0 THEN 'turn left' ELSE 'turn right' END) AS g,
 list_transform(range(1, 3 + (o_orderkey % 3)::INT), lambda i: CASE WHEN (o_custkey * i) % 3 = 0 THEN 'turn left' ELSE 'turn right' END) AS p FROM orders)
SELECT o_orderkey, round(len(list_filter(range(1, 4), lambda i: g[i] = p[i])) / 3.0, 6) AS score FROM x""")
def turn_sequence(spark, d):
    o = table(spark, d, "orders")

    def turns(key, n):
        one = lambda i: F.when((F.col(key) * i) % 3 == 0, "Turn Left").otherwise("Turn Right")
        return F.array_join(F.transform(F.sequence(F.lit(1), n), one), ", ")

    score = text.curriculum_score(turns("o_custkey", (F.col("o_orderkey") % 3 + 2).cast("int")), turns("o_orderkey", F.lit(3)))
    return o.select("o_orderkey", r6(score, "score"))


@query("regression_parse", """WITH x AS (SELECT event_id, 'p1=1.0, dist = ' || event_id::VARCHAR || '.5, dist=' || (event_id % 7)::VARCHAR || '.25 m' AS s FROM events)
SELECT event_id, regexp_extract_all(s, 'dist\\s*=\\s*(-?\\d+\\.?\\d*)', 1)[-1]::DOUBLE AS value FROM x""".replace("\\\\", "\\"))
def regression_parse(spark, d):
    s = F.concat(F.lit("p1=1.0, dist = "), F.col("event_id").cast("string"), F.lit(".5, dist="), (F.col("event_id") % 7).cast("string"), F.lit(".25 m"))
    return table(spark, d, "events").select("event_id", text.regression_value(s).alias("value"))


@query("binary_stats", "SELECT count(*) AS binary_n, sum(quality)::BIGINT AS binary_yes, sum(1 - quality)::BIGINT AS binary_no, round(avg(quality), 6) AS yes_frac, round(greatest(avg(quality), 1 - avg(quality)), 6) AS majority FROM labels WHERE quality IS NOT NULL")
def binary_stats(spark, d):
    s = reports.binary(table(spark, d, "labels"), F.when(F.col("quality") == 1, "yes").when(F.col("quality") == 0, "no"))
    return s.select("binary_n", "binary_yes", "binary_no", r6(F.col("yes_frac"), "yes_frac"), r6(F.col("majority"), "majority"))


@query("qa_turn_pairs", """SELECT conv_id, md5(arg_min(text, turn) FILTER (role = 'user')) AS question, md5(coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '')) AS answers, count(*) FILTER (role = 'assistant') AS n
FROM conversations GROUP BY conv_id""")
def qa_turn_pairs(spark, d):
    """First question and all answers of each conversation, by the annotation normaliser."""
    c = table(spark, d, "conversations")
    turn = F.struct(F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise("system").alias("from"), F.col("text").alias("value"))
    items = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]).alias("conversations"))
    raw = annotations.completed(items)
    human = F.get(F.filter("conversations", lambda x: x["from"] == "human"), F.lit(0))["value"]
    return raw.select("conv_id", F.md5(F.encode(human, "UTF-8")).alias("question"), F.md5(F.encode(F.array_join(annotations.answers(), "\n"), "UTF-8")).alias("answers"), F.size(annotations.answers()).cast("long").alias("n"))


@query("question_types", """WITH q AS (SELECT doc_id, upper(substr(w, 1, 1)) || lower(substr(w, 2)) AS f FROM (SELECT doc_id, regexp_extract(text, '^\\s*(\\S+)', 1) AS w FROM documents))
SELECT CASE WHEN f IN ('What', 'Is', 'How', 'Can', 'Which') THEN f ELSE 'Others' END AS question_type, count(*) AS n FROM q GROUP BY 1""".replace("\\\\", "\\"))
def question_types(spark, d):
    rows = annotations.completed(table(spark, d, "documents").select("doc_id", F.col("text").alias("question")))
    return rows.select(annotations.question_type(F.col("question")).alias("question_type")).groupBy("question_type").agg(F.count("*").alias("n"))


@query("answer_tag_extract", "SELECT page_id, trim(regexp_extract(html, '<title>(.*?)</title>', 1)) AS title FROM pages")
def answer_tag(spark, d):
    """Page titles as tagged answers."""
    tagged = F.replace(F.replace("html", F.lit("<title>"), F.lit("<answer>")), F.lit("</title>"), F.lit("</answer>"))
    return table(spark, d, "pages").select("page_id", text.answer_tag(tagged).alias("title"))


_GRAM = r"regexp_extract_all(lower({0}), '[a-z0-9]+')"


@query("rouge1", f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, {_GRAM.format('text')} AS g, {_GRAM.format("split_part(text, chr(10), 1)")} AS p FROM conversations),
gp AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(p) AS w FROM t) GROUP BY ALL), gg AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(g) AS w FROM t) GROUP BY ALL),
h AS (SELECT id, sum(least(gp.n, gg.n)) AS hit FROM gp JOIN gg USING (id, w) GROUP BY id)
SELECT id, round(coalesce(2 * hit / nullif(len(p) + len(g), 0), 0.0), 6) AS rouge1 FROM t LEFT JOIN h USING (id)""")
def rouge1(spark, d):
    """The first line of each turn against the whole turn."""
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.get(F.split("text", "\n"), F.lit(0)).alias("line"))
    return ngrams.rouge_n(c, "id", "line", "text", 1).select("id", r6(F.col("rouge1"), "rouge1"))


@query("rouge_l")
def rouge_l(spark, d):
    """Stemmed longest common subsequence of replies and questions; SQL has no counterpart."""
    t = _turns(spark, d)
    return t.select("conv_id", "turn", ngrams.rouge_l()(ngrams.tokens(F.col("text")), F.array(ngrams.tokens(F.col("asked")))).alias("rouge_l"))


@query("cider_tfidf", f"""WITH t AS (SELECT a.conv_id * 1000 + a.turn AS id, {_GRAM.format('a.text')} AS g, {_GRAM.format('u.text')} AS p FROM conversations a
  JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user' WHERE a.role = 'assistant'),
k AS (SELECT unnest([1, 2, 3, 4]) AS n),
l AS (SELECT id, n, 't' AS side, array_to_string(g[i:i + n - 1], ' ') AS w FROM (SELECT id, n, g, unnest(range(1, len(g) - n + 2)) AS i FROM t, k WHERE len(g) >= n)
  UNION ALL SELECT id, n, 'p', array_to_string(p[i:i + n - 1], ' ') FROM (SELECT id, n, p, unnest(range(1, len(p) - n + 2)) AS i FROM t, k WHERE len(p) >= n)),
f AS (SELECT id, n, w, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 't') AS t FROM l GROUP BY ALL),
df AS (SELECT n, w, count(*) AS df FROM f WHERE t > 0 GROUP BY ALL), z AS (SELECT ln(count(DISTINCT id)) AS logn FROM t),
v AS (SELECT id, n, p * (logn - ln(greatest(coalesce(df, 0), 1))) AS wp, t * (logn - ln(greatest(coalesce(df, 0), 1))) AS wt FROM f LEFT JOIN df USING (n, w), z),
c AS (SELECT id, n, sum(least(wp, wt) * wt) AS dot, sum(wp * wp) AS pp, sum(wt * wt) AS tt FROM v GROUP BY ALL),
s AS (SELECT id, sum(CASE WHEN pp * tt > 0 THEN dot / sqrt(pp * tt) ELSE 0 END) * 10 / 4 AS cider FROM c GROUP BY id)
SELECT id, round(coalesce(cider, 0.0), 5) AS cider FROM t LEFT JOIN s USING (id)""")
def cider(spark, d):
    """Questions as candidates for their replies."""
    t = _turns(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "asked")
    out = ngrams.cider(t.select("id", F.col("asked").alias("x")), t.select("id", F.col("text").alias("x")), "id", "x")
    return out.select("id", F.round("cider", 5).alias("cider"))


def _best_sql(n):
    """The best of two truths: the reply and the question before it; the candidate is the reply's first line."""
    return f"""WITH t AS (SELECT a.conv_id * 1000 + a.turn AS id, {_GRAM.format("split_part(a.text, chr(10), 1)")} AS p, {_GRAM.format("u.text")} AS r1, {_GRAM.format("substr(a.text, length(split_part(a.text, chr(10), 1)) + 1)")} AS r2 FROM conversations a
  JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user' WHERE a.role = 'assistant'),
r AS (SELECT id, 1 AS ref, r1 AS w FROM t UNION ALL SELECT id, 2, r2 FROM t),
gp AS (SELECT id, array_to_string(p[i:i + {n - 1}], ' ') AS g, count(*) AS n FROM (SELECT id, p, unnest(range(1, len(p) - {n} + 2)) AS i FROM t WHERE len(p) >= {n}) GROUP BY ALL),
gr AS (SELECT id, ref, array_to_string(w[i:i + {n - 1}], ' ') AS g, count(*) AS n FROM (SELECT id, ref, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM r WHERE len(w) >= {n}) GROUP BY ALL),
h AS (SELECT id, ref, sum(least(gp.n, gr.n)) AS hit FROM gp JOIN gr USING (id, g) GROUP BY ALL)
SELECT t.id, round(max(coalesce(2 * coalesce(hit, 0) / nullif(greatest(len(p) - {n - 1}, 0) + greatest(len(w) - {n - 1}, 0), 0), 0.0)), 6) AS rouge{n} FROM t JOIN r USING (id) LEFT JOIN h ON h.id = t.id AND h.ref = r.ref GROUP BY t.id"""


def _several(spark, d):
    """Each reply's first line with two truths: the question and the rest of the reply."""
    line = F.get(F.split("text", "\n"), F.lit(0))
    return _turns(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), line.alias("line"), F.array("asked", F.expr("substr(text, length(split(text, '\n')[0]) + 1)")).alias("truths"))


@query("rouge1_best", _best_sql(1))
def rouge1_best(spark, d):
    """Unstemmed, as SQL has no stems; the operator stems where it is not told otherwise."""
    out = ngrams.rouge_best(_several(spark, d), "id", "line", "truths", 1, stemmed=False)
    return out.select("id", r6(F.col("rouge1"), "rouge1"))


@query("rouge2_best", _best_sql(2))
def rouge2_best(spark, d):
    out = ngrams.rouge_best(_several(spark, d), "id", "line", "truths", 2, stemmed=False)
    return out.select("id", r6(F.col("rouge2"), "rouge2"))


@query("rouge_stemmed")
def rouge_stemmed(spark, d):
    """ROUGE-1 and ROUGE-2 by Porter's stems, the best of two truths; SQL has no stems."""
    rows = _several(spark, d)
    one, two = (ngrams.rouge_best(rows, "id", "line", "truths", n) for n in (1, 2))
    return one.join(two, "id").select("id", r6(F.col("rouge1"), "rouge1"), r6(F.col("rouge2"), "rouge2"))


@query("cider_d", f"""WITH t AS (SELECT a.conv_id * 1000 + a.turn AS id, {_GRAM.format('a.text')} AS r1, {_GRAM.format("split_part(a.text, chr(10), 1)")} AS r2, {_GRAM.format('u.text')} AS p FROM conversations a
  JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user' WHERE a.role = 'assistant'),
x AS (SELECT id, 0 AS ref, p AS w FROM t UNION ALL SELECT id, 1, r1 FROM t UNION ALL SELECT id, 2, r2 FROM t), k AS (SELECT unnest([1, 2, 3, 4]) AS n),
f AS (SELECT id, ref, n, array_to_string(w[i:i + n - 1], ' ') AS g, count(*) AS f FROM (SELECT id, ref, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM x, k WHERE len(w) >= n) GROUP BY ALL),
df AS (SELECT n, g, count(DISTINCT id) AS df FROM f WHERE ref > 0 GROUP BY ALL), z AS (SELECT ln(count(DISTINCT id)) AS logn FROM t),
v AS (SELECT id, ref, n, g, f * (logn - ln(greatest(coalesce(df, 1), 1))) AS w FROM f LEFT JOIN df USING (n, g), z),
m AS (SELECT id, ref, n, sqrt(sum(w * w)) AS m FROM v GROUP BY ALL),
d AS (SELECT a.id, a.ref, a.n, sum(least(a.w, b.w) * a.w) AS dot FROM v a JOIN v b ON a.id = b.id AND a.n = b.n AND a.g = b.g AND b.ref = 0 WHERE a.ref > 0 GROUP BY ALL),
s AS (SELECT d.id, d.ref, sum(coalesce(dot / nullif(a.m * b.m, 0), 0)) AS s FROM d JOIN m a ON a.id = d.id AND a.ref = d.ref AND a.n = d.n JOIN m b ON b.id = d.id AND b.ref = 0 AND b.n = d.n GROUP BY ALL),
e AS (SELECT x.id, x.ref, coalesce(s, 0) * exp(-((len(x.w) - len(p.w)) ** 2) / 72.0) AS s FROM x JOIN x p ON p.id = x.id AND p.ref = 0 LEFT JOIN s ON s.id = x.id AND s.ref = x.ref WHERE x.ref > 0)
SELECT id, round(avg(s) * 10 / 4, 5) AS cider FROM e GROUP BY id""")
def cider_d(spark, d):
    """Questions as candidates; replies and their first lines as two truths of each."""
    t = _turns(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "asked")
    line = F.get(F.split("text", "\n"), F.lit(0))
    truths = t.select("id", F.posexplode(F.array("text", line)).alias("ref", "x"))
    return ngrams.cider_d(t.select("id", F.col("asked").alias("x")), truths, "id", "ref", "x").select("id", F.round("cider", 5).alias("cider"))


@query("greedy_f1")
def greedy_f1(spark, d):
    """Boxes of one label as predictions for those of the next vectors; the matching has state, so SQL has none."""
    p = points(spark, d).select("label", (F.col("vec_id") % 50).alias("g"), "vec_id", _box(0, 2.0).alias("a"), _box(6, 2.0).alias("b"))
    lists = p.groupBy("label", "g").agg(*[F.array_sort(F.collect_list(F.struct("vec_id", F.col(c).alias("box"))))["box"].alias(c) for c in "ab"])
    return lists.select("label", "g", F.round(boxes.greedy_f1(0.25)(F.col("a"), F.col("b")), 6).alias("f1_25"), F.round(boxes.greedy_f1(0.5)(F.col("a"), F.col("b")), 6).alias("f1_50"))


@query("box_parse", f"""WITH {POINTS} SELECT vec_id, vec_id % 3 AS form, CASE WHEN vec_id % 3 = 2 THEN 0 ELSE 1 END::INT AS n,
CASE WHEN vec_id % 3 < 2 THEN round((vec_id % 13) + 0.25, 6) END AS cx, CASE WHEN vec_id % 3 < 2 THEN round((vec_id % 7) + 1.5, 6) END AS dz FROM p""")
def box_parse(spark, d):
    """Answers as a JSON list, a tuple with box tokens, and none."""
    p = points(spark, d)
    numbers = F.concat_ws(", ", ((F.col("vec_id") % 13) + 0.25).cast("string"), F.lit("0.0"), F.lit("-1.5"), F.lit("1.0"), F.lit("2.0"), ((F.col("vec_id") % 7) + 1.5).cast("string"))
    form = F.col("vec_id") % 3
    answer = F.when(form == 0, F.concat(F.lit('[{"bbox_3d": ['), numbers, F.lit('], "label": "door"}]'))).when(form == 1, F.concat(F.lit("<|box_start|>("), numbers, F.lit(")<|box_end|>"))).otherwise("None ")
    found = p.select("vec_id", form.alias("form"), boxes.parsed_many(answer).alias("many"), boxes.parsed(answer).alias("one"))
    return found.select("vec_id", "form", F.size("many").alias("n"), r6(F.get("one", F.lit(0)), "cx"), r6(F.get(F.try_element_at("many", F.lit(1)), F.lit(5)), "dz"))


@query("fallback_key_join", """WITH r AS (SELECT user_id, event_type, value, event_id FROM events WHERE value > 90),
f AS (SELECT user_id, event_type, arg_max(value, event_id) AS fv FROM r GROUP BY ALL), p AS (SELECT user_id, arg_max(value, event_id) AS pv FROM r GROUP BY ALL)
SELECT CASE WHEN fv IS NOT NULL THEN 'full' WHEN pv IS NOT NULL THEN 'part' ELSE 'none' END AS matched, count(*) AS n, round(avg(coalesce(fv, pv)), 6) AS mean
FROM events e LEFT JOIN f USING (user_id, event_type) LEFT JOIN p USING (user_id) GROUP BY 1""")
def fallback(spark, d):
    e = table(spark, d, "events")
    out = joins.with_fallback(e.select("event_id", "user_id", "event_type"), e.where("value > 90").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], ["user_id"], "value", "event_id")
    return out.groupBy("matched").agg(F.count("*").alias("n"), r6(F.avg("value"), "mean"))
