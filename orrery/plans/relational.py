"""Queries over joins, samples, sets, audits and streams of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import text
from orrery.operators import annotations, joins, reports, sampling
from orrery.plans.base import POINTS, TIMED, points, query, r6, table, timed
from orrery.streaming import snapshots

_DRAW = "('0x' || substr(md5(concat_ws('|', {0}, '{1}')), 1, 15))::BIGINT"
_UNIFORM = "(" + _DRAW + " / 1152921504606846976.0::DOUBLE)"


@query("left_lookup_last_wins", """WITH p AS (SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT u.user_id, p.value, p.event_id FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN p USING (user_id)""")
def last_wins(spark, d):
    e = table(spark, d, "events")
    last = e.where("event_type = 'purchase'").select("user_id", "value", "event_id")
    return joins.lookup(e.select("user_id").distinct(), last.withColumn("pos", F.col("event_id")), ["user_id"], "pos").select("user_id", "value", "event_id")


@query("first_wins_dedup", "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def first_wins(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("pos", F.col("o_orderkey"))
    return joins.first_wins(o, ["o_custkey"], "pos").drop("pos")


_LISTS = """l AS (SELECT o_orderkey, l_linenumber, l_partkey, p_retailprice AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey),
g AS (SELECT o_orderkey, count(*) FILTER (v IS NULL) AS missed, count(v) AS n, round(avg(v), 6) AS mean FROM l GROUP BY o_orderkey)"""


def _lists(spark, d, whole):
    li = table(spark, d, "lineitem")
    ids = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))["l_partkey"].alias("ids"))
    lists = table(spark, d, "orders").select("o_orderkey").join(ids, "o_orderkey")
    objects = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("price"))
    out = joins.list_lookup(lists, "ids", objects, "part", "price", whole, ["o_orderkey"])
    mean = F.aggregate("found", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("found"), F.lit(0))
    return out.select("o_orderkey", "missed", F.size("found").cast("long").alias("n"), r6(mean, "mean"))


@query("partial_list_lookup", f"WITH {_LISTS} SELECT o_orderkey, missed, n, mean FROM g")
def partial_lookup(spark, d):
    return _lists(spark, d, False)


@query("all_or_nothing_lookup", f"WITH {_LISTS} SELECT o_orderkey, n, mean FROM g WHERE missed = 0")
def whole_lookup(spark, d):
    return _lists(spark, d, True).where("missed = 0").drop("missed")


@query("inner_lookup_skips", "SELECT count(*) FILTER (p_partkey IS NOT NULL) AS found, count(*) FILTER (p_partkey IS NULL) AS skipped FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 40) ON p_partkey = l_partkey")
def inner_lookup(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part").where("p_size > 40")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.agg(F.count("p_partkey").alias("found"), F.count_if(F.col("p_partkey").isNull()).alias("skipped"))


@query("leakage_anti_join", """WITH h AS (SELECT p_partkey FROM part WHERE p_size < 5), m AS (SELECT l_partkey, p_partkey IS NOT NULL AS held FROM lineitem LEFT JOIN h ON p_partkey = l_partkey)
SELECT count(*) FILTER (NOT held) AS kept, count(*) FILTER (held) AS dropped, count(DISTINCT l_partkey) FILTER (NOT held) AS kept_keys, count(DISTINCT l_partkey) FILTER (held) AS dropped_keys FROM m""")
def leakage(spark, d):
    h = table(spark, d, "part").where("p_size < 5").select(F.col("p_partkey").alias("l_partkey"))
    return joins.leakage_report(table(spark, d, "lineitem"), h, "l_partkey")


@query("conditional_anti_join", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25))")
def conditional_anti(spark, d):
    h = table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"))
    return joins.without_leakage(table(spark, d, "lineitem"), h, "l_partkey", F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber")


@query("allowlist_semi", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def allowlist(spark, d):
    ids = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.allowed(table(spark, d, "orders"), ids, "o_custkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("first_existing_file", """WITH w AS (SELECT doc_id % 50 AS k, 'f' || (doc_id % 7)::VARCHAR AS path, doc_id % 7 AS pri FROM documents), l AS (SELECT DISTINCT 'f' || (page_id % 3 * 2)::VARCHAR AS path FROM pages)
SELECT k, arg_min(w.path, pri) FILTER (l.path IS NOT NULL) AS path FROM w LEFT JOIN l ON l.path = w.path GROUP BY k""")
def first_existing(spark, d):
    w = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("k"), F.concat(F.lit("f"), F.col("doc_id") % 7).alias("path"), (F.col("doc_id") % 7).alias("pri"))
    there = table(spark, d, "pages").select(F.concat(F.lit("f"), F.col("page_id") % 3 * 2).alias("path"))
    return joins.first_existing(w, there, "k", "path", "pri")


@query("nearest_pixel_patch", """WITH px AS (SELECT DISTINCT event_id % 20 AS frame, event_id % 9 AS r, event_id % 13 AS c FROM events), pt AS (SELECT DISTINCT event_id % 20 AS frame, event_id % 5 * 2 AS r, event_id % 4 * 3 AS c, event_id % 20 * 100 + event_id % 5 * 4 + event_id % 4 AS idx FROM events WHERE event_id % 20 <> 7)
SELECT px.frame, px.r AS row, px.c AS col, coalesce(arg_min(idx, (greatest(abs(px.r - pt.r), abs(px.c - pt.c)), abs(px.r - pt.r), abs(px.c - pt.c), idx)), 0) AS idx FROM px LEFT JOIN pt ON pt.frame = px.frame GROUP BY ALL""")
def nearest_patch(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    px = e.select((i % 20).alias("frame"), (i % 9).alias("row"), (i % 13).alias("col")).distinct()
    pt = e.where(i % 20 != 7).select((i % 20).alias("frame"), (i % 5 * 2).alias("row"), (i % 4 * 3).alias("col"), (i % 20 * 100 + i % 5 * 4 + i % 4).alias("idx")).distinct()
    return joins.nearest_patch(px, pt, "frame")


@query("nearest_point_sets", f"""WITH {POINTS}, k AS (SELECT x.label AS a_key, y.label AS b_key FROM (SELECT DISTINCT label FROM p) x, (SELECT DISTINCT label FROM p) y WHERE x.label < y.label)
SELECT a_key, b_key, round(sqrt(min((a.e0 - b.e0) ** 2 + (a.e1 - b.e1) ** 2 + (a.e2 - b.e2) ** 2)), 6) AS distance FROM k JOIN p a ON a.label = a_key JOIN p b ON b.label = b_key GROUP BY ALL""")
def nearest_sets(spark, d):
    p = points(spark, d).select("label", *[F.col(f"e{i}").alias(a) for i, a in enumerate("xyz")])
    keys = p.select("label").distinct()
    pairs = keys.select(F.col("label").alias("a_key")).join(keys.select(F.col("label").alias("b_key")), F.col("a_key") < F.col("b_key"))
    return joins.nearest_pair(pairs, p, p, "label").select("a_key", "b_key", r6(F.col("distance"), "distance"))


@query("exact_else_nearest", f"""WITH {TIMED}, l AS (SELECT event_id, user_id, floor(t / 600) * 600 AS t FROM e WHERE event_type = 'view'), r AS (SELECT user_id, floor(t / 600) * 600 AS t, max(event_id) AS v FROM e WHERE event_type <> 'view' GROUP BY ALL),
b AS (SELECT l.event_id, max(r.t) AS bt FROM l JOIN r ON r.user_id = l.user_id AND r.t <= l.t GROUP BY 1), a AS (SELECT l.event_id, min(r.t) AS nt FROM l JOIN r ON r.user_id = l.user_id AND r.t >= l.t GROUP BY 1),
c AS (SELECT l.*, CASE WHEN bt IS NULL OR (nt IS NOT NULL AND nt - l.t <= l.t - bt) THEN nt ELSE bt END AS best FROM l LEFT JOIN b USING (event_id) LEFT JOIN a USING (event_id))
SELECT c.event_id, r.v FROM c LEFT JOIN r ON r.user_id = c.user_id AND r.t = c.best""")
def exact_else_nearest(spark, d):
    """Nearest ten-minute slot of the user, the later one of two."""
    e = timed(spark, d).withColumn("t", F.floor(F.col("t") / 600).cast("double") * 600)
    left = e.where("event_type = 'view'").select("user_id", "t", "event_id")
    right = e.where("event_type <> 'view'").groupBy("user_id", "t").agg(F.max("event_id").alias("v"))
    return joins.nearest(left, right, ["user_id"], "t", "v", later=True).select("event_id", F.col("__value").alias("v"))


@query("stratified_sample", f"""WITH s AS (SELECT source, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, source) AS rank, count(*) OVER () AS k FROM documents GROUP BY source),
a AS (SELECT source, size, 90 // k + (rank <= 90 % k)::INT AS alloc FROM s),
r AS (SELECT doc_id, source, alloc, row_number() OVER (PARTITION BY source ORDER BY {_DRAW.format('doc_id', 0)}, doc_id) AS place FROM documents JOIN a USING (source)),
f AS (SELECT doc_id, source, row_number() OVER (ORDER BY {_DRAW.format('doc_id', 1)}, doc_id) AS i FROM r WHERE place > alloc)
SELECT doc_id, source FROM r WHERE place <= alloc UNION ALL SELECT doc_id, source FROM f WHERE i <= 90 - (SELECT sum(least(alloc, size)) FROM a)""")
def stratified(spark, d):
    return sampling.stratified(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 90)


@query("fraction_sample", f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_DRAW.format('doc_id', 0)}, doc_id) AS i, count(*) OVER () AS n FROM documents) SELECT doc_id FROM r WHERE i <= greatest(1, floor(n * 0.13))""")
def fraction(spark, d):
    return sampling.fraction(table(spark, d, "documents").select("doc_id"), "doc_id", 0.13)


@query("mixture_weights", "SELECT lang, count(*) AS n, round(CASE lang WHEN 'en' THEN 2.0 WHEN 'de' THEN 0.5 ELSE 1.0 END / count(*), 9) AS weight FROM documents GROUP BY lang")
def mixture(spark, d):
    m = sampling.mixture_weights(table(spark, d, "documents"), "lang", {"en": 2.0, "de": 0.5})
    return m.select("lang", "n", F.round("weight", 9).alias("weight"))


@query("weighted_draws", f"""WITH r AS (SELECT doc_id, n_chars::DOUBLE AS w, {_DRAW.format('doc_id', 0)} % 256 AS b FROM documents WHERE n_chars > 0),
i AS (SELECT *, sum(w) OVER (PARTITION BY b ORDER BY doc_id) AS hi FROM r), per AS (SELECT b, sum(w) AS bw FROM r GROUP BY b),
c AS (SELECT b, bw, sum(bw) OVER (ORDER BY b) AS bhi, sum(bw) OVER () AS total FROM per), dr AS (SELECT range AS draw, {_UNIFORM.format('range', 1)} AS u FROM range(1000)),
k AS (SELECT draw, b, u * total - bhi + bw AS x FROM dr JOIN c ON bhi > u * total QUALIFY row_number() OVER (PARTITION BY draw ORDER BY bhi) = 1)
SELECT draw, doc_id FROM k JOIN i USING (b) WHERE x >= hi - w AND x < hi""")
def weighted_draws(spark, d):
    """A thousand draws with replacement by document length; lengths are whole, so sums are the same in every order."""
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("w"))
    return sampling.weighted_draws(docs, "doc_id", "w", 1000)


@query("grouped_draws", f"""WITH d AS (SELECT range AS draw, CASE WHEN {_UNIFORM.format('range', 0)} < 0.5 THEN 'en' WHEN {_UNIFORM.format('range', 0)} < 0.8 THEN 'fr' ELSE 'de' END AS "group" FROM range(500)),
s AS (SELECT lang AS "group", source AS scene, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS s, count(*) OVER (PARTITION BY lang) AS ns FROM (SELECT DISTINCT lang, source FROM documents)),
w AS (SELECT draw, d."group", scene FROM d JOIN s ON s."group" = d."group" AND s.s = floor({_UNIFORM.format('draw', 1)} * s.ns)),
i AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang, source) AS ni FROM documents)
SELECT draw, "group", scene, doc_id AS item FROM w JOIN i ON i.lang = w."group" AND i.source = w.scene AND i.i = floor({_UNIFORM.format('draw', 2)} * i.ni)""")
def grouped_draws(spark, d):
    """Draws of language, then source, then document."""
    items = table(spark, d, "documents").select(F.col("lang").alias("group"), F.col("source").alias("scene"), F.col("doc_id").alias("item"))
    return sampling.grouped_draws(items, {"en": 0.5, "fr": 0.3, "de": 0.2}, 500)


@query("fixed_composition", f"""WITH t AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id), r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic = 1 ORDER BY {_DRAW.format('doc_id', 0)}, doc_id) - 1 AS i FROM t)
SELECT doc_id, CASE WHEN toxic = 1 THEN i // 2 ELSE i // 6 END AS block, CASE WHEN toxic = 1 THEN i % 2 ELSE i % 6 + 2 END AS place FROM r""")
def composition(spark, d):
    t = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return sampling.fixed_composition(t.where("toxic = 1"), t.where("toxic != 1"), "doc_id", 2, 8)


@query("hash_limit", f"SELECT doc_id FROM documents ORDER BY {_DRAW.format('doc_id', 7)}, doc_id LIMIT 50")
def hash_limit(spark, d):
    return sampling.hash_limit(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


@query("frame_linspace", f"""WITH {TIMED}, r AS (SELECT user_id, event_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS t FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id FROM r WHERE t <= 8 OR list_contains(list_transform(range(8), lambda k: CASE WHEN k = 7 THEN t - 1 ELSE trunc(k * ((t - 1)::DOUBLE / 7))::BIGINT END), i)""")
def linspace(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    return sampling.linspace_rows(e, ["user_id"], ["ts", "event_id"], 8).select("user_id", "event_id")


@query("bucket_random_frames", f"""WITH r AS (SELECT user_id, event_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, least(floor(i * 5 / t), 4) AS run FROM r), p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY {_DRAW.format('event_id', 0)}, event_id) AS k FROM b) SELECT user_id, event_id FROM p WHERE k = 1""")
def bucket_random(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    return sampling.bucket_random(e, ["user_id"], ["ts", "event_id"], 5, "event_id").select("user_id", "event_id")


@query("compacted_ids", "SELECT user_id, event_type, dense_rank() OVER (PARTITION BY user_id ORDER BY min(event_id), event_type)::INT - 1 AS index FROM events GROUP BY user_id, event_type")
def compacted(spark, d):
    return sampling.compacted(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("remapped_time", """WITH s AS (SELECT user_id, event_id, min(event_id) OVER w AS lo, max(event_id) OVER w - min(event_id) OVER w AS spread FROM events WINDOW w AS (PARTITION BY user_id))
SELECT user_id, event_id, least(greatest(round_even(CASE WHEN spread <= 999 THEN (event_id - lo)::DOUBLE ELSE (event_id - lo) * 999 / greatest(spread, 1) END, 0)::INT, 0), 999) AS t FROM s""")
def remapped(spark, d):
    return sampling.remapped_time(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 999)


@query("contiguous_shards", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT least(i // greatest(n // 7, 1), 6)::INT AS shard, count(*) AS n, min(o_orderkey) AS first FROM r GROUP BY 1")
def shards(spark, d):
    out = sampling.contiguous_shards(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 7)
    return out.groupBy("shard").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("budget_split")
def budget_split(spark, d):
    """A budget of 40 over the event types of each user, drawn without replacement; a random draw, so no SQL."""
    c = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("pool")).agg(F.count("*").alias("n"))
    return sampling.hypergeometric_split(c, "user_id", 40)


@query("set_operations", """WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_linestatus = 'O' AND l_discount > 0.09)
SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'difference', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'intersection', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)""")
def sets(spark, d):
    li = table(spark, d, "lineitem")
    a = li.where("l_returnflag = 'R' AND l_quantity > 49").select(F.col("l_suppkey").alias("k")).distinct()
    b = li.where("l_linestatus = 'O' AND l_discount > 0.09").select(F.col("l_suppkey").alias("k")).distinct()
    parts = [x.agg(F.count("*").alias("n")).select(F.lit(n).alias("op"), "n") for n, x in (("union", a.union(b).distinct()), ("difference", a.exceptAll(b)), ("intersection", a.intersect(b)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("ragged_concat", "SELECT kind, count(*) AS n, count(qty) AS with_qty, count(price) AS with_price FROM (SELECT 'l' AS kind, l_quantity AS qty, NULL AS price FROM lineitem UNION ALL SELECT 'o', NULL, o_totalprice FROM orders) GROUP BY kind")
def ragged(spark, d):
    a = table(spark, d, "lineitem").select(F.lit("l").alias("kind"), F.col("l_quantity").alias("qty"))
    b = table(spark, d, "orders").select(F.lit("o").alias("kind"), F.col("o_totalprice").alias("price"))
    return annotations.concatenated([a, b]).groupBy("kind").agg(F.count("*").alias("n"), F.count("qty").alias("with_qty"), F.count("price").alias("with_price"))


@query("asset_reasons", """WITH i AS (SELECT doc_id, 'r' || (doc_id % 5)::VARCHAR AS root, source AS scene FROM documents), c AS (SELECT CASE WHEN root = 'r4' THEN 'missing_root' WHEN scene IN ('src1', 'src2') THEN 'missing_scene_dir' WHEN scene IN ('src3') THEN 'missing_images' END AS kind FROM i)
SELECT kind, count(*) AS n FROM c GROUP BY kind""")
def asset_reasons(spark, d):
    """Why items lack files, against listings made from sources."""
    i = table(spark, d, "documents").select("doc_id", F.concat(F.lit("r"), F.col("doc_id") % 5).alias("data_path"), F.col("source").alias("scene_id"))
    roots = i.where("data_path != 'r4'")
    dirs, images = i.where("scene_id NOT IN ('src1', 'src2')"), i.where("scene_id NOT IN ('src1', 'src2', 'src3')")
    return reports.histogram(annotations.available(i, roots, dirs, images), "reason")


@query("consistency_audit", """WITH e AS (SELECT DISTINCT user_id, event_id % 7 AS stem FROM events WHERE event_id % 2 = 0), a AS (SELECT DISTINCT user_id, event_id % 7 AS stem FROM events WHERE event_id % 3 = 0),
f AS (SELECT coalesce(e.user_id, a.user_id) AS user_id, e.stem AS es, a.stem AS st FROM e FULL JOIN a ON a.user_id = e.user_id AND a.stem = e.stem),
g AS (SELECT user_id, count(*) FILTER (st IS NULL) AS missing, count(*) FILTER (es IS NULL) AS extra FROM f GROUP BY user_id) SELECT user_id, missing, extra, CASE WHEN missing + extra = 0 THEN 'OK' ELSE 'BAD' END AS status FROM g""")
def consistency(spark, d):
    e = table(spark, d, "events").withColumn("stem", F.col("event_id") % 7)
    return reports.consistency(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), "user_id", "stem").select("user_id", "missing", "extra", "status")


@query("natural_sort_topk", "SELECT c_name, row_number() OVER (ORDER BY regexp_extract(c_name, '(\\d+)$', 1)::DOUBLE DESC, c_name DESC)::INT AS rank FROM customer QUALIFY rank <= 20")
def natural_sort(spark, d):
    top = table(spark, d, "customer").select("c_name", text.natural_key(F.col("c_name")).alias("k")).orderBy(F.col("k").desc()).limit(20)
    from pyspark.sql.window import Window

    return top.select("c_name", F.row_number().over(Window.orderBy(F.col("k").desc())).alias("rank"))


@query("registry_names", """WITH n AS (SELECT DISTINCT 'set' || (l_linenumber)::VARCHAR || CASE l_linenumber % 3 WHEN 0 THEN '@0.5' WHEN 1 THEN '%25' ELSE '' END AS name FROM lineitem)
SELECT name, regexp_replace(name, '(@[\\d.]+|%\\d+)$', '') AS base, nullif(regexp_extract(name, '@([\\d.]+)$', 1), '')::DOUBLE AS weight, nullif(regexp_extract(name, '%(\\d+)$', 1), '')::INT AS percent FROM n""")
def registry_names(spark, d):
    k = F.col("l_linenumber")
    end = F.when(k % 3 == 0, "@0.5").when(k % 3 == 1, "%25").otherwise("")
    n = table(spark, d, "lineitem").select(F.concat(F.lit("set"), k, end).alias("name")).distinct()
    return n.select("name", annotations.registry_name(F.col("name")).alias("r")).select("name", "r.*")


@query("checked_count", "SELECT count(*) AS n FROM nation")
def checked_count(spark, d):
    return reports.checked_count(table(spark, d, "nation"), 25)


@query("events_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def events_windows(spark, d):
    """The batch side of the windowed stream."""
    w = snapshots.windowed(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value", "1 day", "1 hour")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


@query("ledger_dedup", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def ledger(spark, d):
    return snapshots.ledger(table(spark, d, "events"), ["user_id", "event_type"], "ts", "1 hour").agg(F.count("*").alias("n"))
