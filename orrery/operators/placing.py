"""Boxes placed in scenes with exclusions, and what can be seen from where.

Draws come from a hash of scene, slot and attempt; exclusions are joins by grid cells; a draw that is rejected is drawn
again in the next round over what is still open (``rounds.in_rounds``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import boxes as box_functions
from orrery.functions import geometry
from orrery.operators import cells, joins
from orrery.operators.rounds import Drawn, in_rounds
from orrery.operators.sampling import draw, uniform

#: Sides of a distractor are log-uniform between SMALL (0.2 for the longest) and LARGE; gaps in metres.
SMALL, LONGEST, LARGE, AIR = 0.10, 0.20, 1.0, 0.05
#: The largest bounding radius that a distractor can have.
REACH = math.sqrt(3.0) * LARGE / 2
AXES = cells.AXES


def between(low: Column, high: Column, *key: Column, seed: int) -> Column:
    return low + uniform(*key, seed=seed) * (high - low)


def log_between(low: Column, high: Column, *key: Column, seed: int) -> Column:
    return F.exp(between(F.log(low), F.log(high), *key, seed=seed))


def _drawn_box(rows: DataFrame, key: Sequence[Column], seed: int) -> DataFrame:
    """Adds sides (dx, dy, dz), bounding radius r, yaw and a centre (x, y, z) inside lx..hz."""
    u = lambda name, lo, hi, f=between: f(lo, hi, *key, F.lit(name), seed=seed)
    rows = rows.withColumn("__a", u("a", F.lit(LONGEST), F.lit(LARGE), log_between))
    rows = rows.withColumns({f"__{n}": u(n, F.lit(SMALL), F.col("__a"), log_between) for n in "bc"})
    order = F.array_sort(F.array(*[F.struct(draw(*key, F.lit("turn" + n), seed=seed).alias("at"), F.col(f"__{n}").alias("v")) for n in "abc"]))
    rows = rows.withColumn("__sides", order)
    rows = rows.withColumns({f"d{a}": F.get("__sides", F.lit(i))["v"] for i, a in enumerate(AXES)})
    rows = rows.withColumns({"r": F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2) / 2, "yaw": u("yaw", F.lit(0.0), F.lit(2 * math.pi))})
    return rows.withColumns({a: u(a, F.col("l" + a), F.col("h" + a)) for a in AXES}).drop("__a", "__b", "__c", "__sides")


def _as_paths(spheres: DataFrame, *more: str) -> DataFrame:
    """Spheres (x, y, z, radius) as paths of no length."""
    return spheres.select("scene_id", *[F.col(a).alias(a + e) for e in "01" for a in AXES], "radius", *more)


def distractors(scenes: DataFrame, boxes: DataFrame, paths: DataFrame | None = None, guards: DataFrame | None = None, low: int = 1, high: int = 4, seed: int = 1, tries: int = 60, each: int = 10) -> Drawn:
    """Boxes that no question asks for, clear of everything that an answer depends on.

    ``scenes`` (scene_id, unique; lx..lz, hx..hz: where centres may lie) each get ``low`` to ``high`` slots, by a hash.
    A draw is rejected, for the first of these reasons that holds, where its bounding sphere meets that of one of
    ``boxes`` (scene_id, x, y, z, dx, dy, dz) or of a distractor placed in an earlier round (``box``); lies nearer to
    one of the ``guards`` (scene_id, lx..hz: boxes that an answer is read off) than its radius (``guard``); or comes
    nearer than its radius, the path's and 5 cm to a line of sight or a walked way of ``paths`` (scene_id, x0..z0 to
    x1..z1, radius) (``corridor``). Of picks of one round that meet, the lowest slot stays (``clash``).

    Gives one row a filled slot (scene_id, slot, x, y, z, dx, dy, dz, yaw, r, attempt), the census, and in ``open`` one
    row with a reason for every slot that ``tries`` draws did not fill: none is missing without a word. Scenes with a
    null or a number that is not finite, and boxes, guards and paths with one, take no part.
    """
    sound = scenes.where(F.col("scene_id").isNotNull() & cells.finite([F.col(e + a).cast("double") for e in "lh" for a in AXES]))
    slots = low + (draw(F.col("scene_id"), F.lit("slots"), seed=seed) % (high - low + 1)).cast("int")
    base = sound.select("scene_id", *[e + a for e in "lh" for a in AXES], F.explode(F.sequence(F.lit(1), slots)).alias("slot")) if high > 0 else sound.select("scene_id", *[e + a for e in "lh" for a in AXES], F.lit(1).alias("slot")).limit(0)
    radius = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2) / 2
    there = _as_paths(boxes.select("scene_id", *AXES, radius.alias("radius")))
    key = ["scene_id", "slot", "attempt"]

    def drawn(open_: DataFrame) -> DataFrame:
        return _drawn_box(open_, [F.col(k) for k in key], seed)

    def judge(rows: DataFrame, placed: DataFrame | None) -> DataFrame:
        spheres = rows.select(*key, *AXES, "r")
        taken = there if placed is None else there.unionByName(_as_paths(placed.select("scene_id", *AXES, F.col("r").alias("radius"))))
        found = [(1, "box", cells.near_paths(spheres, taken, "scene_id", REACH))]
        if guards is not None:
            found.append((2, "guard", cells.near_boxes(spheres, guards, "scene_id", REACH)))
        if paths is not None:
            wide = paths.select("scene_id", *[a + e for e in "01" for a in AXES], (F.col("radius") + AIR).alias("radius"))
            found.append((3, "corridor", cells.near_paths(spheres, wide, "scene_id", REACH)))
        marks = [f.select(*key, F.struct(F.lit(n).alias("n"), F.lit(name).alias("reason")).alias("why")) for n, name, f in found]
        every = marks[0]
        for m in marks[1:]:
            every = every.unionByName(m)
        first = every.groupBy(*key).agg(F.min("why").alias("why"))
        return rows.join(first, key, "left").withColumn("reason", F.col("why.reason")).drop("why")

    def settle(picks: DataFrame) -> DataFrame:
        others = _as_paths(picks.select("scene_id", *AXES, F.col("r").alias("radius"), F.col("slot").alias("__slot")), "__slot")
        met = cells.near_paths(picks.select("scene_id", "slot", *AXES, "r"), others, "scene_id", REACH, also=F.col("o.__slot") < F.col("p.slot"))
        return picks.join(met.select("scene_id", "slot", F.lit("clash").alias("reason")), ["scene_id", "slot"], "left")

    done = in_rounds(base, ["scene_id", "slot"], drawn, judge, settle, tries, each)
    columns = ["scene_id", "slot", *AXES, "dx", "dy", "dz", "yaw", "r", "attempt"]
    return Drawn(done.accepted.select(*columns), done.census, done.open.select("scene_id", "slot", "reason"))


def box_sets(scenes: DataFrame, count: int, seed: int = 10, least: float = 0.05, tries: int = 30, each: int = 10) -> Drawn:
    """``count`` boxes in each scene (scene_id, lx..hz) and how far the first is from the others, by their surfaces.

    A draw is rejected where two bounding spheres meet (``overlap``) or the answer would be too close to call
    (``margin``): with two boxes, where they are no more than ``least`` apart; with more, where the nearest leads the
    next by less. Gives (scene_id, boxes: centre, sides and turns of each; distances; answer: metres of two, else the
    nearest one's letter; attempt).
    """
    sound = scenes.where(F.col("scene_id").isNotNull() & cells.finite([F.col(e + a).cast("double") for e in "lh" for a in AXES]))
    base = sound.select("scene_id", *[e + a for e in "lh" for a in AXES])

    def drawn(rows: DataFrame) -> DataFrame:
        each_ = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("box"))
        made = _drawn_box(each_, [F.col(k) for k in ("scene_id", "box", "attempt")], seed)
        box = F.array(*AXES, "dx", "dy", "dz", "yaw", F.lit(0.0), F.lit(0.0))
        whole = made.groupBy("scene_id", "attempt").agg(F.array_sort(F.collect_list(F.struct("box", box.alias("b"), "r"))).alias("s"))  # count rows
        return rows.join(whole, ["scene_id", "attempt"])

    def judge(rows: DataFrame, _: DataFrame | None) -> DataFrame:
        at = lambda i: F.get("s", F.lit(i))
        meet = F.lit(False)
        for i in range(count):
            for j in range(i):
                meet = meet | (box_functions.centre_distance(at(i)["b"], at(j)["b"]) < at(i)["r"] + at(j)["r"])
        far = box_functions.box_distance()
        rows = rows.withColumn("distances", F.array(*[far(at(0)["b"], at(j)["b"]) for j in range(1, count)]))
        order = F.array_sort("distances")
        lead = F.get(order, F.lit(0)) if count == 2 else F.get(order, F.lit(1)) - F.get(order, F.lit(0))
        return rows.withColumn("reason", F.when(meet, "overlap").when((lead <= least) if count == 2 else (lead < least), "margin"))

    done = in_rounds(base, ["scene_id"], drawn, judge, None, tries, each, alone=True)
    nearest = F.array_position("distances", F.array_min("distances")).cast("int")
    answer = F.round(F.get("distances", F.lit(0)), 2).cast("string") if count == 2 else F.get(F.array(*[F.lit(chr(65 + k)) for k in range(count - 1)]), nearest - 1)
    return Drawn(done.accepted.select("scene_id", F.transform("s", lambda x: x["b"]).alias("boxes"), "distances", answer.alias("answer"), "attempt"), done.census, done.open.select("scene_id", "reason"))


# --- seeing


def seen_shares(views: DataFrame, targets: DataFrame, occluders: DataFrame, rays: int = 60, seed: int = 8, cell: float = 0.25, least: float = 0.10) -> DataFrame:
    """How much of each target can be seen from where: (view, target, rays, free, fraction, answer).

    ``views`` (scene_id, view, x, y, z) look at every target of ``targets`` (scene_id, view, target, x, y, z, dx, dy, dz)
    that names them, at ``rays`` points drawn in its box by a hash of view, target and number. A ray is blocked where an
    axis-aligned box of ``occluders`` (scene_id, target, lx..hz) other than the target's own cuts it; rays meet boxes by
    grid cells. ``answer`` is yes from a free share of ``least`` on. A target, a view or a box with a null or a number
    that is not finite: no row for such a target or view, and such a box blocks nothing. Repeated views or targets
    count as one.
    """
    eye = views.select("scene_id", "view", *[F.col(a).cast("double").alias(a + "0") for a in AXES]).distinct()
    t = targets.select("scene_id", "view", "target", *[F.col(c).cast("double").alias("__" + c) for c in (*AXES, "dx", "dy", "dz")]).distinct()
    both = eye.join(t, ["scene_id", "view"])
    both = both.where(cells.finite([F.col(a + "0") for a in AXES] + [F.col("__" + c) for c in (*AXES, "dx", "dy", "dz")]))
    each = both.select("*", F.explode(F.sequence(F.lit(0), F.lit(rays - 1))).alias("ray"))
    q = {a + "1": F.col("__" + a) + (uniform(F.col("view"), F.col("target"), F.col("ray"), F.lit(a), seed=seed) - 0.5) * F.col("__d" + a) for a in AXES}
    each = each.withColumns(q).select("scene_id", "view", "target", "ray", *[a + e for e in "01" for a in AXES])
    free = joins.unblocked(each, occluders, "scene_id", cell, own="target").groupBy("scene_id", "view", "target").agg(F.count("*").alias("free"))
    out = both.select("scene_id", "view", "target").join(free, ["scene_id", "view", "target"], "left").withColumns({"rays": F.lit(rays), "free": F.coalesce("free", F.lit(0))})
    share = F.col("free") / F.col("rays")
    return out.select("scene_id", "view", "target", "rays", "free", share.alias("fraction"), F.when(share >= least, "yes").otherwise("no").alias("answer"))


def sightlines(scenes: DataFrame, seed: int = 9, rays: int = 60, side: float = 0.30, tries: int = 150, each: int = 25) -> Drawn:
    """A viewer, a target of ``side`` and one box that may stand between them, for each scene (scene_id, lx..hz).

    Whether the target is to be seen (``answer``), and if so wholly or in part (``mode``), is drawn first, evenly. The
    distance (2.5 to 5 m), the box's side (0.3 to 0.7 m) and its place along the line come from one distribution for
    all; only how far it stands off the line depends on the answer. A draw is rejected where the box would touch viewer
    or target (``room``), is too small to hide the target from its place (``small``), or where the share of free
    rays to points drawn in the target does not bear the answer out (``share``): under 0.05 for no, from 0.95 for clear,
    0.10 to 0.80 for partial.
    """
    sound = scenes.where(F.col("scene_id").isNotNull() & cells.finite([F.col(e + a).cast("double") for e in "lh" for a in AXES]))
    u = lambda name, lo=0.0, hi=1.0, *more: between(F.lit(lo), F.lit(hi), F.col("scene_id"), *more, F.lit(name), seed=seed)
    yes, clear = u("answer") < 0.5, u("mode") < 0.5
    mode = F.when(~yes, "blocked").when(clear, "clear").otherwise("partial")
    base = sound.select("scene_id", *[e + a for e in "lh" for a in AXES], mode.alias("mode"))
    half, attempt = side / 2, F.col("attempt")

    def drawn(rows: DataFrame) -> DataFrame:
        v = lambda name, lo=0.0, hi=1.0: u(name, lo, hi, attempt)
        rows = rows.withColumns({f"p{a}": between(F.col("l" + a), F.col("h" + a), F.col("scene_id"), attempt, F.lit("p" + a), seed=seed) for a in AXES})
        rows = rows.withColumns({"d": v("d", 2.5, 5.0), "__th": v("th", 0.0, 2 * math.pi), "__cos": 1 - 2 * v("phi"), "s": v("s", 0.30, 0.70), "__turn": v("turn", 0.0, 2 * math.pi)})
        sin = F.sqrt(1 - F.col("__cos") ** 2)
        rows = rows.withColumns({"__ux": sin * F.cos("__th"), "__uy": sin * F.sin("__th"), "__uz": F.col("__cos")})
        # two directions across the line: from up, or from x where the line itself is nearly upright
        steep = F.abs("__uy") >= 0.9
        dot = F.when(steep, F.col("__ux")).otherwise(F.col("__uy"))
        across = {a: F.when(steep, float(a == "x")).otherwise(float(a == "y")) - dot * F.col(f"__u{a}") for a in AXES}
        rows = rows.withColumns({f"__w{a}": c for a, c in across.items()})
        norm = F.sqrt(F.col("__wx") ** 2 + F.col("__wy") ** 2 + F.col("__wz") ** 2)
        rows = rows.withColumns({f"__w{a}": F.col(f"__w{a}") / norm for a in AXES})
        cross = {a: F.col(f"__u{b}") * F.col(f"__w{c}") - F.col(f"__u{c}") * F.col(f"__w{b}") for a, b, c in ("xyz", "yzx", "zxy")}
        rows = rows.withColumns({f"__v{a}": c for a, c in cross.items()})
        reach = math.sqrt(3.0) / 2 * F.col("s")
        rows = rows.withColumns({
            "__low": F.greatest((0.087 + reach + AIR) / F.col("d"), F.lit(0.25)),
            "__high": F.least(1 - (math.sqrt(3.0) * half + reach + AIR) / F.col("d"), F.lit(0.75)),
        })
        rows = rows.withColumn("along", between(F.col("__low"), F.col("__high"), F.col("scene_id"), attempt, F.lit("along"), seed=seed))
        edge, margin = F.col("s") / 2, F.greatest(F.lit(0.02), half * F.col("along"))
        rows = rows.withColumn("__most", edge - 1.2 * margin)
        off = F.when(F.col("mode") == "blocked", v("off") * F.col("__most")).when(F.col("mode") == "clear", edge + 1.5 * margin + 0.3 + 1.5 * v("off")).otherwise(edge + (v("off") - 0.5) * margin)
        rows = rows.withColumn("off", off)
        side_ = {a: F.cos("__turn") * F.col(f"__w{a}") + F.sin("__turn") * F.col(f"__v{a}") for a in AXES}
        rows = rows.withColumns({f"q{a}": F.col(f"p{a}") + F.col("d") * F.col(f"__u{a}") for a in AXES})
        return rows.withColumns({f"o{a}": F.col(f"p{a}") + F.col("along") * F.col("d") * F.col(f"__u{a}") + F.col("off") * c for a, c in side_.items()})

    def judge(rows: DataFrame, _: DataFrame | None) -> DataFrame:
        bare = F.when(F.col("__high") - F.col("__low") < 0.05, "room").when((F.col("mode") == "blocked") & (F.col("__most") <= 0.01), "small")
        rows = rows.withColumn("__bare", bare)
        # each draw has one box, which its own rays meet: no grid, no joins of rays
        scene = F.concat_ws("/", "scene_id", "attempt")
        ends = [n + a for n in "pqo" for a in AXES]
        rays_ = rows.where("__bare IS NULL").select(scene.alias("__view"), *ends, "s", F.explode(F.sequence(F.lit(0), F.lit(rays - 1))).alias("__ray"))
        to = [F.col("q" + a) + (uniform(F.col("__view"), F.col("__view"), F.col("__ray"), F.lit(a), seed=seed) - 0.5) * F.lit(side) for a in AXES]
        rays_ = rays_.select("__view", "__ray", *ends, "s", *[t.alias("t" + a) for t, a in zip(to, AXES, strict=True)])
        wall = [[F.col("o" + a) + k * F.col("s") / 2 for a in AXES] for k in (-1, 1)]
        cut = geometry.segment_hits_box(*[[F.col(n + a) for a in AXES] for n in "pt"], *wall)
        shares = rays_.groupBy("__view").agg((F.count_if(~cut) / F.lit(rays)).alias("fraction"))
        both = rows.join(shares, scene == F.col("__view"), "left").drop("__view")
        f = F.col("fraction")
        fits = F.when(F.col("mode") == "blocked", f < 0.05).when(F.col("mode") == "clear", f >= 0.95).otherwise((f >= 0.10) & (f <= 0.80))
        return both.withColumn("reason", F.coalesce("__bare", F.when(~fits, "share")))

    done = in_rounds(base, ["scene_id"], drawn, judge, None, tries, each, alone=True)
    columns = ["scene_id", *[p + a for p in "pqo" for a in AXES], "d", "s", "along", "off", "mode", F.when(F.col("mode") == "blocked", "no").otherwise("yes").alias("answer"), "fraction", "attempt"]
    return Drawn(done.accepted.select(*columns), done.census, done.open.select("scene_id", "mode", "reason"))


def class_grounding(objects: DataFrame, seen: DataFrame, most: int = 8, seed: int = 14) -> DataFrame:
    """For each scene one class to find, and the boxes of all its instances as the answer, nearest first.

    ``objects`` (scene_id, object_id, label, box: centre and sides), ``seen`` (scene_id, object_id: those in view, repeated
    or not). A class can be asked for where every instance of it in the scene is in view and there are ``most`` at most: else
    the answer would name what cannot be seen, or be a list without end. Of those a scene's class is the first by a hash;
    scenes without one have no row. Gives (scene_id, label, n, boxes, answer: a JSON list that ``boxes.parsed_many`` reads).
    Objects with a null, or a box that is not six finite numbers, are no instances.
    """
    sound = (F.size("box") == 6) & F.forall("box", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    o = objects.where("scene_id IS NOT NULL AND object_id IS NOT NULL AND label IS NOT NULL").where(sound).dropDuplicates(["scene_id", "object_id"])
    marked = o.join(seen.select("scene_id", "object_id").distinct().withColumn("__in", F.lit(1)), ["scene_id", "object_id"], "left")
    classes = marked.groupBy("scene_id", "label").agg(F.count("*").alias("n"), F.count("__in").alias("__seen")).where((F.col("n") == F.col("__seen")) & (F.col("n") <= most))
    pick = classes.groupBy("scene_id").agg(F.min(F.struct(draw(F.col("scene_id"), F.col("label"), seed=seed).alias("at"), "label", "n")).alias("c"))
    chosen = pick.select("scene_id", "c.label", "c.n")
    far = sum((F.get("box", F.lit(i)) ** 2 for i in range(3)), F.lit(0.0))
    lists = o.join(chosen, ["scene_id", "label"]).groupBy("scene_id", "label", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct(far.alias("d"), "object_id", "box"))), lambda x: x["box"]).alias("boxes"))  # most rows
    rounded = F.transform("boxes", lambda b: F.transform(b, lambda v: F.round(v, 2)))
    answer = F.concat(F.lit("["), F.array_join(F.transform(rounded, lambda b: F.concat(F.lit('{"bbox_3d": ['), F.array_join(F.transform(b, lambda v: v.cast("string")), ", "), F.lit("]}"))), ", "), F.lit("]"))
    return lists.select("scene_id", "label", "n", "boxes", answer.alias("answer"))
