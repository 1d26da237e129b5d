"""Queries over how items are asked and answered: labels, templates, boxes as text, counts by side, lines of centres."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import boxes, relations, text
from orrery.operators import annotations, canvas, curriculum, joins, reports, sampling
from orrery.plans.base import POINTS, points, query, r6, table

_DRAW = "('0x' || substr(md5(concat_ws('|', {0}, '{1}')), 1, 15))::BIGINT"
_UNIFORM = "(" + _DRAW + " / 1152921504606846976.0::DOUBLE)"
_OBJECTS = f"{POINTS}, o AS (SELECT (vec_id % 40)::VARCHAR AS scene_id, vec_id AS object_id, label, e0 AS x, e1 AS z, e2, e3, e4 FROM p)"
_TOLERANCES = "[" + ", ".join(map(repr, text.TOLERANCES)) + "]::DOUBLE[]"


def _objects(spark, d):
    p = points(spark, d)
    return p.select((F.col("vec_id") % 40).cast("string").alias("scene_id"), F.col("vec_id").alias("object_id"), "label", F.col("e0").alias("x"), F.col("e1").alias("z"), "e2", "e3", "e4")


_TEMPLATES = ["Where is the {}?", "Point at the {}.", "Is a {} in the room?"]
_TYPES = {"ECONOMY": "ECONOMIES", "PROMO": "PROMOS", "STANDARD": "STANDARDS"}


@query("template_questions", f"""SELECT p_partkey, replace(['{"', '".join(_TEMPLATES)}'][{_DRAW.format('p_partkey', 0)} % 3 + 1], '{{}}', p_name) AS question,
CASE p_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items())} ELSE p_type || 's' END AS kinds FROM part""")
def template_questions(spark, d):
    """A question for each part by its label, the plural of its kind; inner columns do not go on."""
    parts = table(spark, d, "part").withColumns({"_size": F.col("p_size"), "price": F.col("p_retailprice")})
    asked = parts.withColumns({"question": annotations.template_question(F.col("p_name"), F.col("p_partkey"), _TEMPLATES), "kinds": text.plural(F.col("p_type"), _TYPES)})
    return annotations.stripped(asked, ["price", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])


@query("short_labels", r"""WITH t AS (SELECT conv_id, turn, regexp_extract(text, '["'']([^"'']+)["'']', 1) AS quoted,
regexp_extract(lower(text), '(?:the|a|an)\s+(?:\w+\s+)*?(\w+)(?:\s+(?:is|in|on|at|with|that|which|near|by|of)\b|[.,;?!]|$)', 1) AS head FROM conversations)
SELECT conv_id, turn, substr(CASE WHEN quoted <> '' THEN quoted WHEN head <> '' THEN head ELSE 'object' END, 1, 32) AS label FROM t""")
def short_labels(spark, d):
    """A label for each turn of a conversation."""
    return table(spark, d, "conversations").select("conv_id", "turn", text.short_label(F.coalesce("text", F.lit(""))).alias("label"))


@query("box_texts", f"""WITH {POINTS}, f AS (SELECT vec_id, list_transform([e0, e1, e2, e3, e4, e5], lambda v: printf('%.2f', v)) AS t FROM p)
SELECT vec_id, '(' || array_to_string(t, ', ') || ')' AS written, list_sum(list_transform(t, lambda v: abs(v::DOUBLE))) > 0 AS solid, round(list_sum(list_transform(t, lambda v: v::DOUBLE)), 6) + 0.0 AS total FROM f""")
def box_texts(spark, d):
    """Boxes written as text and read again."""
    p = points(spark, d).select("vec_id", boxes.formatted(F.array(*[f"e{i}" for i in range(6)])).alias("written"))
    box = p.withColumn("box", boxes.parsed(F.col("written")))
    add = lambda f: F.aggregate("box", F.lit(0.0), lambda a, v: a + f(v))
    return box.select("vec_id", "written", (add(F.abs) > 0).alias("solid"), (F.round(add(lambda v: v), 6) + F.lit(0.0)).alias("total"))


@query("near_to_far_boxes", f"""WITH {POINTS}, r AS (SELECT label, vec_id, e0 * e0 + e1 * e1 + e2 * e2 AS d FROM p WHERE e0 + e1 + e2 IS NOT NULL)
SELECT label, list(vec_id ORDER BY d, vec_id) AS ids FROM r GROUP BY label""")
def near_to_far(spark, d):
    """Boxes of each label by distance; the fourth number of a box is its id here."""
    p = points(spark, d).where("e0 + e1 + e2 IS NOT NULL").withColumn("b", F.array("e0", "e1", "e2", F.col("vec_id").cast("double")))
    by = p.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "b"))), lambda x: x["b"]).alias("b"))
    return by.select("label", F.transform(boxes.nearest_first(F.col("b")), lambda b: F.get(b, F.lit(3)).cast("long")).alias("ids"))


@query("points_in_boxes", f"""WITH {_OBJECTS} SELECT a.object_id AS box_id, b.object_id AS point_id FROM o a JOIN o b USING (scene_id)
WHERE abs(b.x - a.x) <= 0.15 AND abs(b.z - a.z) <= 0.2 AND abs(b.e2 - a.e2) <= 0.25""")
def points_in_boxes(spark, d):
    """Objects of a scene inside the inflated, unturned boxes around its objects."""
    o = _objects(spark, d)
    box = F.array("x", "z", "e2", F.lit(0.2), F.lit(0.3), F.lit(0.4), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    held = joins.inside_boxes(o.select("scene_id", F.col("object_id").alias("point_id"), "x", "z", "e2"), o.select("scene_id", F.col("object_id").alias("box_id"), box.alias("box")), "scene_id", "box", ["x", "z", "e2"], 0.05)
    return held.select("box_id", "point_id")


@query("count_sides", f"""WITH {_OBJECTS}, v AS (SELECT scene_id, min(object_id) AS v FROM o GROUP BY scene_id),
w AS (SELECT o.scene_id, o.x AS vx, o.z AS vz, o.e3 AS hx, o.e4 AS hz FROM v JOIN o ON o.object_id = v.v),
c AS (SELECT o.scene_id, count(*) FILTER (sqrt(hx * hx + hz * hz) >= 0.001 AND sqrt((x - vx) ** 2 + (z - vz) ** 2) >= 0.001 AND hx * (z - vz) - hz * (x - vx) > 0) AS n, count(*) AS total FROM o JOIN w USING (scene_id) GROUP BY o.scene_id)
SELECT scene_id, n, total FROM c WHERE n > 0 AND n < total""")
def count_sides(spark, d):
    """Objects to the left of a scene's first object, which looks along two of its numbers."""
    o = _objects(spark, d)
    viewer = o.groupBy("scene_id").agg(F.min_by(F.struct("x", "z", "e3", "e4"), "object_id").alias("v"))
    viewer = viewer.select("scene_id", F.col("v.x").alias("vx"), F.col("v.z").alias("vz"), F.col("v.e3").alias("hx"), F.col("v.e4").alias("hz"))
    return curriculum.count_side(o, viewer, "left")


@query("counted_kinds", f"""WITH {_OBJECTS}, c AS (SELECT scene_id, label, count(*) AS n, max(greatest(abs(e2), abs(e3), abs(e4))) AS m FROM o GROUP BY ALL)
SELECT scene_id, label, n, CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, n % 3 AS mod3, round_even(m * 100, 0)::INT AS longest FROM c""")
def counted_kinds(spark, d):
    """Objects of each kind in a scene, whether they are even in number, and the longest side among them."""
    o = _objects(spark, d)
    longest = o.groupBy(F.col("scene_id").alias("s"), F.col("label").alias("l")).agg(F.max(relations.longest_cm(F.abs("e2"), F.abs("e3"), F.abs("e4"))).alias("longest"))
    both = curriculum.counted(o).join(longest, F.col("scene_id").eqNullSafe(F.col("s")) & F.col("label").eqNullSafe(F.col("l")))
    return both.select("scene_id", "label", "n", "parity", "mod3", "longest")


@query("floor_areas", f"WITH {_OBJECTS} SELECT scene_id, round(sum(abs(x) * abs(z)), 6) AS area FROM o GROUP BY scene_id")
def floor_areas(spark, d):
    rects = _objects(spark, d).select("scene_id", F.abs("x").alias("dx"), F.abs("z").alias("dz"))
    return curriculum.floor_area(rects).select("scene_id", r6(F.col("area"), "area"))


@query("colinear_centres", f"""WITH {_OBJECTS}, a AS (SELECT scene_id, min(x) AS x, min(z) AS z, max(e3) AS angle FROM o GROUP BY scene_id),
k AS (SELECT *, unnest(range(1, 6)) AS k FROM a), g AS (SELECT *, sum(0.4::DOUBLE + {_UNIFORM.format("scene_id, k", 2)} * (1.5::DOUBLE - 0.4::DOUBLE)) OVER (PARTITION BY scene_id ORDER BY k) AS along FROM k)
SELECT scene_id, k, round(x + along * cos(angle), 6) AS x, round(z + along * sin(angle), 6) AS z FROM g""")
def colinear_centres(spark, d):
    """Five centres on a line from each scene's corner, drawn gaps apart."""
    anchors = _objects(spark, d).groupBy("scene_id").agg(F.min("x").alias("x"), F.min("z").alias("z"), F.max("e3").alias("angle"))
    return curriculum.colinear(anchors, 5, 0.4, 1.5).select("scene_id", F.col("k").cast("long").alias("k"), r6(F.col("x"), "x"), r6(F.col("z"), "z"))


@query("spread_frames", f"""WITH v AS (SELECT user_id AS object_id, list_sort(list(DISTINCT hour(ts)::BIGINT)) AS frames FROM events WHERE event_type = 'view' GROUP BY user_id),
b AS (SELECT user_id AS object_id, event_id AS point, frames, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events JOIN v ON v.object_id = user_id)
SELECT object_id, point, CASE WHEN r = 1 THEN frames[1] ELSE frames[{_DRAW.format("object_id, point", 7)} % len(frames) + 1] END AS frame FROM b""")
def spread_frames(spark, d):
    """An hour for each event from those in which its user was seen."""
    e = table(spark, d, "events")
    hours = F.array_sort(F.collect_set(F.hour(F.col("ts").cast("timestamp")).cast("long")))
    visible = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("object_id")).agg(hours.alias("frames"))
    return curriculum.spread_times(e.select(F.col("user_id").alias("object_id"), F.col("event_id").alias("point")), visible)


@query("inner_frames", """WITH n AS (SELECT user_id, count(*) AS t FROM events GROUP BY user_id)
SELECT user_id, list_transform(range(1, 9), lambda i: trunc(i * ((t - 1)::DOUBLE / 9))::BIGINT) AS frames FROM n""")
def inner_frames(spark, d):
    """Eight even places of each user's events without both ends."""
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("t"))
    return n.select("user_id", sampling.inner_linspace(F.col("t"), 8).alias("frames"))


@query("supported_keys", """SELECT user_id, count(*) AS patches, count(DISTINCT event_type) AS frames FROM events GROUP BY user_id HAVING count(*) >= 8 AND count(DISTINCT event_type) >= 3""")
def supported_keys(spark, d):
    """Users with enough events of enough kinds."""
    return canvas.supported(table(spark, d, "events").select("user_id", F.col("event_type").alias("frame_idx")), ["user_id"], 8, 3)


@query("cell_features", """WITH g AS (SELECT user_id AS scene_id, event_id AS valid_index FROM events), f AS (SELECT user_id AS scene_id, event_id AS valid_index, value FROM events WHERE event_type = 'purchase')
SELECT scene_id, valid_index, [value, 2 * value] AS features FROM g JOIN f USING (scene_id, valid_index)""")
def cell_features(spark, d):
    """Cells that have features, with them."""
    g = table(spark, d, "events").select(F.col("user_id").alias("scene_id"), F.col("event_id").alias("valid_index"), "event_type", "value")
    f = g.where("event_type = 'purchase'").select("scene_id", "valid_index", F.array(F.col("value"), 2 * F.col("value")).alias("features"))
    return canvas.with_features(g.select("scene_id", "valid_index"), f)


@query("image_folders", """WITH n AS (SELECT DISTINCT event_type || CASE hour(ts) % 3 WHEN 0 THEN '' WHEN 1 THEN '_' || user_id || 'x' || hour(ts) ELSE '_' || user_id END AS name FROM events)
SELECT name, regexp_full_match(name, 'view(_[0-9]+x[0-9]+)?') AS folder FROM n""")
def image_folders(spark, d):
    """Names that are the folder of frames, with a size or without."""
    hour = F.hour(F.col("ts").cast("timestamp"))
    end = F.when(hour % 3 == 0, "").when(hour % 3 == 1, F.concat(F.lit("_"), "user_id", F.lit("x"), hour.cast("string"))).otherwise(F.concat(F.lit("_"), "user_id"))
    names = table(spark, d, "events").select(F.concat("event_type", end).alias("name")).distinct()
    return names.select("name", annotations.image_folder(F.col("name"), "view").alias("folder"))


@query("curriculum_scores", f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS kind, CASE WHEN l_linenumber % 5 = 0 THEN 0.0 ELSE l_quantity END AS g, round(l_discount * 20, 0) * (1 + l_tax) AS v, l_returnflag AS f, l_linestatus AS t FROM lineitem),
c AS (SELECT *, CASE kind WHEN 0 THEN (t = 'O')::INT / 2.0 + (f = 'R')::INT / 2.0
  WHEN 1 THEN CASE WHEN g = 0 THEN CASE WHEN abs(v) <= 1e-6 THEN 1.0 ELSE 0.0 END ELSE len(list_filter({_TOLERANCES}, lambda x: abs(v - g) / abs(g) <= x)) / 10.0 END
  ELSE (f = 'A')::INT END::DOUBLE AS score FROM s)
SELECT kind, count(*) AS n, round(avg(score), 6) AS mean FROM c GROUP BY kind""")
def curriculum_scores(spark, d):
    """Scores of turns, numbers (zero among the truths) and choices."""
    li = table(spark, d, "lineitem").withColumns({"kind": F.col("l_linenumber") % 3})
    value = F.round(F.col("l_discount") * 20, 0) * (1 + F.col("l_tax"))
    goal = F.when(F.col("l_linenumber") % 5 == 0, F.lit(0.0)).otherwise(F.col("l_quantity"))
    turns = F.concat(F.when(F.col("l_linestatus") == "O", "Turn Left").otherwise("Turn Back"), F.lit(", "), F.when(F.col("l_returnflag") == "R", "turn right").otherwise("Turn Left"))
    said = F.when(F.col("kind") == 0, turns).when(F.col("kind") == 1, value.cast("string")).otherwise(F.concat("l_returnflag", F.lit(". that one")))
    truth = F.when(F.col("kind") == 0, F.lit("Turn Left, Turn Right")).when(F.col("kind") == 1, goal.cast("string")).otherwise(F.lit("A"))
    scored = li.select("kind", text.curriculum_score(said, truth).alias("score"))
    return scored.groupBy("kind").agg(F.count("*").alias("n"), r6(F.avg("score"), "mean"))


@query("scene_slice", "SELECT user_id::VARCHAR AS scene_id, count(*) AS n FROM events GROUP BY user_id ORDER BY scene_id LIMIT 20 OFFSET 10")
def scene_slice(spark, d):
    """The eleventh to thirtieth scene in the order of their names as text: a slice is the feature."""
    n = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("scene_id")).agg(F.count("*").alias("n"))
    return sampling.sliced(n, ["scene_id"], 10, 20)


@query("displayed_overall", """WITH f AS (SELECT l_returnflag, round(avg(l_discount), 3) AS mean FROM lineitem GROUP BY l_returnflag) SELECT round(avg(mean), 6) AS official_overall FROM f""")
def displayed_overall(spark, d):
    """Mean of the family means as a table shows them, to three digits."""
    out = reports.displayed_overall(table(spark, d, "lineitem"), "l_returnflag", "l_discount", 3)
    return out.select(r6(F.col("official_overall"), "official_overall"))
