"""Queries over placements, corridors and what can be seen. Numbers of embeddings stand in for scenes and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import boxes
from orrery.operators import cells, curriculum, floors, placing, routes, tasks
from orrery.operators.components import component_colours
from orrery.plans.base import POINTS, points, query, table

BOX_TASKS = tasks.NAMES

_U = "(('0x' || substr(md5({0} || '|' || {1} || '|' || {2} || '|{3}|8'), 1, 15))::BIGINT / 1152921504606846976.0 - 0.5)"


@query("corridor_hits", f"""WITH {POINTS}, m AS (SELECT a.vec_id, a.e0 AS x, a.e1 AS y, a.e2 AS z, b.e3 AS px, b.e4 AS py, b.e5 AS pz, b.e6 - b.e3 AS dx, b.e7 - b.e4 AS dy, b.e8 - b.e5 AS dz, abs(a.e9) / 8 + abs(b.e10) / 16 AS reach
 FROM p a JOIN p b ON a.label = b.label), t AS (SELECT *, greatest(0, least(1, ((x - px) * dx + (y - py) * dy + (z - pz) * dz) / nullif(dx * dx + dy * dy + dz * dz, 0))) AS t FROM m)
SELECT DISTINCT vec_id FROM t WHERE sqrt((x - px - t * dx) ** 2 + (y - py - t * dy) ** 2 + (z - pz - t * dz) ** 2) < reach""")
def corridor_hits(spark, d):
    """Spheres that come nearer than both radii to a path of their label."""
    p = points(spark, d)
    spheres = p.select("vec_id", "label", *[F.col(f"e{i}").alias(a) for i, a in enumerate("xyz")], (F.abs("e9") / 8).alias("r"))
    paths = p.select("label", *[F.col(f"e{3 + i + 3 * e}").alias(f"{a}{e}") for e in (0, 1) for i, a in enumerate("xyz")], (F.abs("e10") / 16).alias("radius"))
    return cells.near_paths(spheres, paths, "label", 0.25, 0.0625).select("vec_id")


_SLABS = [(f"((o.e{i} - 0.04 - v.m{i}) / (v.q{i} - v.m{i}))", f"((o.e{i} + 0.04 - v.m{i}) / (v.q{i} - v.m{i}))") for i in range(3)]


@query("seen_shares", f"""WITH {POINTS}, c AS (SELECT label, avg(e0) * 3 AS m0, avg(e1) * 3 AS m1, avg(e2) * 3 + 1.5 AS m2 FROM p GROUP BY label),
v AS (SELECT p.label, p.vec_id, k, m0, m1, m2, {", ".join(f"e{i} + {_U.format('p.label', 'p.vec_id', 'k', a)} * 0.08 AS q{i}" for i, a in enumerate("xyz"))} FROM p JOIN c USING (label), (SELECT unnest(range(12)) AS k)),
h AS (SELECT v.vec_id, k, bool_or(greatest({", ".join(f"least({a}, {b})" for a, b in _SLABS)}) < least({", ".join(f"greatest({a}, {b})" for a, b in _SLABS)}) AND least({", ".join(f"greatest({a}, {b})" for a, b in _SLABS)}) > 0 AND greatest({", ".join(f"least({a}, {b})" for a, b in _SLABS)}) < 1) FILTER (o.vec_id <> v.vec_id) AS hit
 FROM v JOIN p o ON o.label = v.label GROUP BY v.vec_id, k), f AS (SELECT vec_id, count(*) FILTER (NOT coalesce(hit, false)) AS free FROM h GROUP BY vec_id)
SELECT vec_id, free, round(free / 12.0, 6) AS fraction, CASE WHEN free / 12.0 >= 0.1 THEN 'yes' ELSE 'no' END AS answer FROM f""")
def seen_shares(spark, d):
    """Every box of a label as seen from one place above them, past all others: twelve rays each."""
    p = points(spark, d)
    eye = p.groupBy("label").agg(*[(F.avg(f"e{i}") * 3 + (1.5 if i == 2 else 0)).alias(a) for i, a in enumerate("xyz")])
    views = eye.select(F.col("label").alias("scene_id"), F.col("label").alias("view"), *"xyz")
    centre = [F.col(f"e{i}").alias(a) for i, a in enumerate("xyz")]
    targets = p.select(F.col("label").alias("scene_id"), F.col("label").alias("view"), F.col("vec_id").alias("target"), *centre, *[F.lit(0.08).alias("d" + a) for a in "xyz"])
    boxes = p.select(F.col("label").alias("scene_id"), F.col("vec_id").alias("target"), *[(F.col(f"e{i}") + k * 0.04).alias(e + a) for e, k in (("l", -1), ("h", 1)) for i, a in enumerate("xyz")])
    out = placing.seen_shares(views, targets, boxes, rays=12, cell=0.0625)
    return out.select(F.col("target").alias("vec_id"), F.col("free").cast("long").alias("free"), F.round("fraction", 6).alias("fraction"), "answer")


def _scenes(p):
    """Every vector as a scene of its own."""
    return p.select(F.col("vec_id").cast("string").alias("scene_id"), *[F.lit(v).alias(e + a) for e, v in (("l", -2.0), ("h", 2.0)) for a in "xyz"])


@query("distractor_boxes")
def distractor_boxes(spark, d):
    """Distractors of each scene clear of three boxes, a way between two of them and a guarded box: rounds, so no SQL."""
    p = points(spark, d)
    key = F.col("vec_id").cast("string").alias("scene_id")
    box = lambda k: [(F.col(f"e{3 * k + i}") * 6).alias(a) for i, a in enumerate("xyz")]
    boxes = p.select(key, *box(0), *[F.lit(0.4).alias("d" + a) for a in "xyz"])
    for k in (1, 2):
        boxes = boxes.unionByName(p.select(key, *box(k), *[F.lit(0.4).alias("d" + a) for a in "xyz"]))
    paths = p.select(key, *[(F.col(f"e{3 * e + i}") * 6).alias(f"{a}{e}") for e in (0, 1) for i, a in enumerate("xyz")], F.lit(0.3).alias("radius"))
    guards = p.select(key, *[(F.col(f"e{9 + i}") * 6 + s).alias(e + a) for e, s in (("l", 0.0), ("h", 0.8)) for i, a in enumerate("xyz")])
    done = placing.distractors(_scenes(p), boxes, paths, guards)
    placed = done.accepted.select("scene_id", "slot", *[F.round(c, 6).alias(c) for c in (*"xyz", "dx", "dy", "dz", "yaw")], F.lit(None).cast("string").alias("reason"))
    return placed.unionByName(done.open, allowMissingColumns=True)


@query("placement_census")
def placement_census(spark, d):
    """How many draws of each round ended for which reason; draws of rounds, so no SQL."""
    p = points(spark, d)
    key = F.col("vec_id").cast("string").alias("scene_id")
    boxes = p.select(key, *[(F.col(f"e{i}") * 6).alias(a) for i, a in enumerate("xyz")], *[F.lit(1.2).alias("d" + a) for a in "xyz"])
    return placing.distractors(_scenes(p), boxes, seed=3).census


@query("sightline_scenes")
def sightline_scenes(spark, d):
    """A viewer, a target and what may stand between for each vector; drawn in rounds, so no SQL."""
    done = placing.sightlines(_scenes(points(spark, d)))
    return done.accepted.select("scene_id", "mode", "answer", F.round("fraction", 6).alias("fraction"), *[F.round(c, 6).alias(c) for c in ("d", "s", "along", "off")])


@query("box_distances")
def box_distances(spark, d):
    """Exact distance of two oriented boxes of each vector: faces, edges and corners, tested against a minimisation."""
    p = points(spark, d)
    one = F.array(*[F.col(f"e{i}") * 3 for i in range(3)], *[F.abs(f"e{i}") + 0.2 for i in range(3, 6)], *[F.col(f"e{i}") * 4 for i in range(6, 9)])
    two = F.array(*[F.col(f"e{9 + i}") * 3 for i in range(3)], *[F.abs(f"e{12 + i}") + 0.2 for i in range(3)], *[F.col(f"e{15 + i}") * 4 for i in range(3)])
    return p.select("vec_id", F.round(boxes.box_distance()(one, two), 6).alias("distance"))


@query("box_questions")
def box_questions(spark, d):
    """How far two boxes are apart, and which of four is nearest to a fifth, for each vector; drawn in rounds, so no SQL."""
    scenes = _scenes(points(spark, d))
    parts = [placing.box_sets(scenes, n).accepted.select("scene_id", F.lit(kind).alias("task"), "answer", F.transform("distances", lambda x: F.round(x, 6)).alias("distances")) for n, kind in ((2, "dist_box"), (5, "rel_dist_box"))]
    return parts[0].unionByName(parts[1])


def _sweep_sql(a, b):
    return f"""SELECT label, sum(w * greatest(0, h{b} - greatest(l{b}, coalesce(before, l{b})))) AS area, sum(CASE WHEN before IS NULL OR l{b} > before THEN 2 * w ELSE 0 END) AS edges FROM (
 SELECT r.label, nxt - edge AS w, l{b}, h{b}, max(h{b}) OVER (PARTITION BY r.label, edge ORDER BY l{b}, h{b} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
 FROM r JOIN (SELECT label, edge, lead(edge) OVER (PARTITION BY label ORDER BY edge) AS nxt FROM (SELECT label, l{a} AS edge FROM r UNION SELECT label, h{a} FROM r)) s ON s.label = r.label AND nxt IS NOT NULL AND l{a} <= edge AND h{a} >= nxt) GROUP BY label"""


@query("floor_unions", f"""WITH {POINTS}, r AS (SELECT DISTINCT label, e0 AS lx, e1 AS lz, e0 + abs(e2) / 2 + 0.01 AS hx, e1 + abs(e3) / 2 + 0.01 AS hz FROM p), x AS ({_sweep_sql("x", "z")}), z AS ({_sweep_sql("z", "x")})
SELECT label, round(x.area, 6) AS area, round(x.edges + z.edges, 6) AS outline FROM x JOIN z USING (label)""")
def floor_unions(spark, d):
    """Area and outline of a label's rectangles, what overlaps counted once."""
    r = points(spark, d).select(F.col("label").alias("scene_id"), F.col("e0").alias("lx"), F.col("e1").alias("lz"), (F.col("e0") + F.abs("e2") / 2 + 0.01).alias("hx"), (F.col("e1") + F.abs("e3") / 2 + 0.01).alias("hz"))
    return floors.unions(r).select(F.col("scene_id").alias("label"), F.round("area", 6).alias("area"), F.round("outline", 6).alias("outline"))


@query("action_turns", """WITH RECURSIVE a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_type = 'view' AS face, value AS x, (event_id % 97)::DOUBLE AS z FROM events),
w AS (SELECT user_id, event_id, k, x, z, NULL::DOUBLE AS hx, NULL::DOUBLE AS hz, NULL::VARCHAR AS turn, NOT face AS stands, face FROM a WHERE k = 1
 UNION ALL SELECT a.user_id, a.event_id, a.k, CASE WHEN a.face THEN w.x ELSE a.x END, CASE WHEN a.face THEN w.z ELSE a.z END,
  CASE WHEN w.stands THEN a.x - w.x ELSE NULL END, CASE WHEN w.stands THEN a.z - w.z ELSE NULL END,
  CASE WHEN NOT w.stands OR w.hx IS NULL THEN NULL WHEN sqrt(w.hx ** 2 + w.hz ** 2) < 1e-3 OR sqrt((a.x - w.x) ** 2 + (a.z - w.z) ** 2) < 1e-3 THEN 'Turn Right'
   WHEN (w.hx * (a.x - w.x) + w.hz * (a.z - w.z)) / (sqrt(w.hx ** 2 + w.hz ** 2) * sqrt((a.x - w.x) ** 2 + (a.z - w.z) ** 2)) < cos(radians(135)) THEN 'Turn Back'
   WHEN w.hx * (a.z - w.z) - w.hz * (a.x - w.x) > 0 THEN 'Turn Left' ELSE 'Turn Right' END, w.stands OR NOT a.face, a.face FROM w JOIN a ON a.user_id = w.user_id AND a.k = w.k + 1)
SELECT user_id, event_id, turn FROM w""")
def action_turns(spark, d):
    """Each user's events as a route: views look somewhere, all others go there."""
    e = table(spark, d, "events")
    a = e.select("user_id", "event_id", F.when(F.col("event_type") == "view", "face").otherwise("move").alias("kind"), F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("z"))
    return routes.action_turns(a, ["user_id"], "event_id", 4096.0).select("user_id", "event_id", "turn")


@query("drawn_routes")
def drawn_routes(spark, d):
    """Routes of one to three turns, plain, with a reface and over objects, for each vector; drawn in rounds, so no SQL."""
    p = points(spark, d)
    scenes = _scenes(p)
    things = p.select(F.col("vec_id").cast("string").alias("scene_id"), F.posexplode(F.array(*[F.abs(f"e{i}") for i in range(6)])).alias("k", "radius")).select("scene_id", F.concat(F.lit("kind "), F.col("k")).alias("label"), "radius")
    forms = [("plain", 2, False, None), ("reface", 2, True, None), ("objects", 1, True, things)]
    parts = [routes.drawn_routes(scenes, n, face, o).accepted.select("scene_id", F.lit(name).alias("form"), F.array_join("turns", ", ").alias("turns"), F.transform("places", lambda x: F.struct(x["kind"], F.round(x["x"], 6), F.round(x["z"], 6), x["label"])).cast("string").alias("places")) for name, n, face, o in forms]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("feature_colours")
def feature_colours(spark, d):
    """Every vector's three first components as a colour; an eigen step, so no SQL, tested against numpy."""
    out, _ = component_colours(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")
    return out.select("vec_id", *[F.round(c, 5).alias(c) for c in "rgb"])


@query("class_grounding", f"""WITH {POINTS}, o AS (SELECT vec_id // 20 AS scene, vec_id AS id, label, e0, e1, e2, e0 > -0.15 AS seen FROM p),
c AS (SELECT scene, label, count(*) AS n FROM o GROUP BY ALL HAVING bool_and(seen) AND count(*) <= 8),
k AS (SELECT scene, label, n, row_number() OVER (PARTITION BY scene ORDER BY ('0x' || substr(md5(scene || '|' || label || '|14'), 1, 15))::BIGINT) AS k FROM c)
SELECT scene, k.label, n, string_agg(id::VARCHAR, ',' ORDER BY e0 * e0 + e1 * e1 + e2 * e2, id) AS ids FROM k JOIN o USING (scene, label) WHERE k = 1 GROUP BY scene, k.label, n""")
def class_grounding(spark, d):
    """A class to find in each run of twenty vectors; the sides of a box carry its vector's number."""
    p = points(spark, d)
    side = lambda v: F.lit(v)
    o = p.select(F.floor(F.col("vec_id") / 20).alias("scene_id"), F.col("vec_id").alias("object_id"), "label", F.array("e0", "e1", "e2", side(0.5), side(0.5), F.col("vec_id").cast("double")).alias("box"))
    out = placing.class_grounding(o, p.where("e0 > -0.15").select(F.floor(F.col("vec_id") / 20).alias("scene_id"), F.col("vec_id").alias("object_id")))
    ids = F.array_join(F.transform("boxes", lambda b: F.get(b, F.lit(5)).cast("bigint").cast("string")), ",")
    return out.select(F.col("scene_id").alias("scene"), "label", "n", ids.alias("ids"))


@query("box_tasks")
def box_tasks(spark, d):
    """The tasks over drawn boxes, routes and floors in scenes of twenty vectors each; drawn in rounds, so no SQL."""
    o = points(spark, d).select(F.floor(F.col("vec_id") / 20).cast("string").alias("scene_id"), F.col("vec_id").alias("object_id"), "label", (F.col("e0") * 20).alias("x"), (F.col("e1") * 20).alias("z"))
    return curriculum.dispatched(o, [n for n in sorted(curriculum.TASKS) if n in BOX_TASKS])
