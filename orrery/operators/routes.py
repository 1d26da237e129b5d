"""Routes: turns of an ordered list of moves and refaces, and routes drawn for scenes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import relations
from orrery.operators import cells
from orrery.operators.placing import between
from orrery.operators.rounds import Drawn, in_rounds
from orrery.operators.sampling import draw

KINDS = ["Turn Left", "Turn Right", "Turn Back"]


def last_before(rows: DataFrame, key: Sequence[str], order: str, value: Column, out: str, width: float) -> DataFrame:
    """Adds ``out``: the last ``value`` that is not null of the rows of a key before each row, by ``order``.

    Rows are looked at in spans of ``width`` (in the unit of ``order``); a span's last value is passed on through a table
    with a row a span, so a key with most of the rows is many tasks' work.
    """
    key = list(key)
    r = rows.withColumns({"__span": F.floor(F.col(order) / width), "__value": value})
    inside = Window.partitionBy(*key, "__span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("__near", F.last("__value", True).over(inside))
    ends = r.groupBy(*key, "__span").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(order))).alias("__end"))
    past = F.last("__end", True).over(Window.partitionBy(*key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*[F.col(k).alias(f"__k_{k}") for k in key], F.col("__span").alias("__k_span"), past.alias("__past"))
    both = r.join(ends, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in key] + [F.col("__span") == F.col("__k_span")])
    return both.select(*rows.columns, F.coalesce("__near", "__past").alias(out))


def action_turns(actions: DataFrame, key: Sequence[str], order: str, width: float = 10_000.0) -> DataFrame:
    """The turn that each action of a key asks for: ``actions`` with a column ``turn``.

    ``actions`` (key, ``order``: a number, unique in its key; kind; x, z). A move goes to (x, z), a ``face`` looks there
    from where one stands; both leave the heading that they took. The first action of a key is where one stands, the
    second gives the first heading: both have a null turn. From a place to itself there is no heading, and the turn is
    the one that vectors too short have; after a heading with a null the turn is null. A null kind counts as a move;
    other columns pass.
    """
    x, z = F.col("x").cast("double"), F.col("z").cast("double")
    stood = last_before(actions, key, order, F.when(~F.coalesce(F.col("kind") == "face", F.lit(False)), F.struct(x.alias("x"), z.alias("z"))), "__at", width)
    heading = F.when(F.col("__at").isNotNull(), F.struct((x - F.col("__at.x")).alias("x"), (z - F.col("__at.z")).alias("z")))
    faced = last_before(stood.withColumn("__to", heading), key, order, F.col("__to"), "__from", width)
    turn = relations.turn(F.col("__from.x"), F.col("__from.z"), F.col("__to.x"), F.col("__to.z"))
    known = F.col("__from.x").isNotNull() & F.col("__from.z").isNotNull() & F.col("__to").isNotNull()
    return faced.select(*actions.columns, F.when(known, turn).alias("turn"))


def _angle(kind: Column, share: Column, side: Column) -> Column:
    """An angle well inside a kind of turn: 60 to 120 degrees to a side, 150 to 180 for back."""
    aside, back = math.radians(60) * (1 + share), math.radians(150) + math.radians(30) * share
    return F.when(kind == KINDS[0], aside).when(kind == KINDS[1], -aside).otherwise(F.when(side < 0.5, back).otherwise(-back))


def drawn_routes(scenes: DataFrame, turns: int, reface: bool = False, objects: DataFrame | None = None, seed: int = 13, tries: int = 100, each: int = 10) -> Drawn:
    """A route of ``turns`` turns in each scene (scene_id, lx..hz: where it may start), kinds drawn before angles.

    Every turn goes left or right; with ``reface`` one looks at a place off the way first, and the turn at the start,
    which may be back, comes on top. With ``objects`` (scene_id, label, radius) each place is that of another object,
    drawn by hash from those of its scene, and no two may meet: steps are as long as the two largest radii at least
    (``meet``). A route that comes within 0.1 m of the origin is drawn anew (``origin``); scenes with too few objects of
    different labels end in ``open`` with the reason ``objects``.

    Gives (scene_id, turns: what is to be filled in, places: kind, x, y, z, label and radius of each in order, attempt).
    """
    sound = scenes.where(F.col("scene_id").isNotNull() & cells.finite([F.col(e + a).cast("double") for e in "lh" for a in cells.AXES]))
    sound = sound.select("scene_id", *[e + a for e in "lh" for a in cells.AXES])
    legs, count = turns + 1, turns + 2 + reface
    key = F.col("scene_id")
    if objects is None:
        base = sound.withColumn("named", F.array_repeat(F.struct(F.lit(None).cast("string").alias("label"), F.lit(0.0).alias("radius")), count))
    else:
        one = objects.where("scene_id IS NOT NULL AND label IS NOT NULL AND radius IS NOT NULL").groupBy("scene_id", "label").agg(F.max("radius").cast("double").alias("radius"))
        order = Window.partitionBy("scene_id").orderBy(draw(key, F.col("label"), seed=seed), "label")  # labels of a scene, not objects
        some = one.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= count)
        named = some.groupBy("scene_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "label", "radius"))), lambda v: F.struct(v["label"].alias("label"), v["radius"].alias("radius"))).alias("named"))
        base = sound.join(named, "scene_id", "left").withColumn("named", F.coalesce("named", F.array().cast("array<struct<label:string,radius:double>>")))
    widest = F.array_max(F.transform("named", lambda v: v["radius"]))
    base = base.withColumns({"__short": F.coalesce(2 * widest + 0.1, F.lit(0.0)) if objects is not None else F.lit(0.6)})
    base = base.withColumn("__long", (F.col("__short") + 0.5) if objects is not None else F.lit(max(0.7, min(3.0, 6.0 / (turns + 1 + reface)))))
    # kinds do not depend on the attempt: a rejected route is drawn again with the same turns
    sides = [draw(key, F.lit(f"kind{k}"), seed=seed) % 2 for k in range(1, turns + 1)]
    kinds = F.array(*[F.when(s == 0, KINDS[0]).otherwise(KINDS[1]) for s in sides])
    if reface:
        kinds = F.concat(F.array(F.get(F.array(*map(F.lit, KINDS)), (draw(key, F.lit("start"), seed=seed) % 3).cast("int"))), kinds)
    base = base.withColumn("turns", kinds)

    def made(rows: DataFrame) -> DataFrame:
        u = lambda name, lo, hi: between(lo, hi, key, F.col("attempt"), F.lit(name), seed=seed)
        zero, one = F.lit(0.0), F.lit(1.0)
        first = {a: u(a, F.col("l" + a), F.col("h" + a)) for a in cells.AXES}
        rows = rows.withColumns({f"__{a}0": c for a, c in first.items()}).withColumn("__h0", u("heading", zero, F.lit(2 * math.pi)))
        place = lambda kind, x, z: F.struct(F.lit(kind).alias("kind"), x.alias("x"), F.col("__y0").alias("y"), z.alias("z"))
        places = [place("move", F.col("__x0"), F.col("__z0"))]
        bent = 0
        if reface:
            far = u("face", F.col("__short"), F.col("__long"))
            places.append(place("face", F.col("__x0") + far * F.cos("__h0"), F.col("__z0") + far * F.sin("__h0")))
        for leg in range(1, legs + 1):  # a few legs: one column each, the heading before them as state
            turned = reface or leg > 1
            angle = _angle(F.get("turns", F.lit(bent)), u(f"bend{leg}", zero, one), u(f"way{leg}", zero, one)) if turned else zero
            bent += turned
            far = u(f"far{leg}", F.col("__short"), F.col("__long"))
            rows = rows.withColumn(f"__h{leg}", F.col(f"__h{leg - 1}") + angle)
            rows = rows.withColumns({f"__x{leg}": F.col(f"__x{leg - 1}") + far * F.cos(f"__h{leg}"), f"__z{leg}": F.col(f"__z{leg - 1}") + far * F.sin(f"__h{leg}")})
            places.append(place("move", F.col(f"__x{leg}"), F.col(f"__z{leg}")))
        own = F.zip_with(F.array(*places), "named", lambda p, n: F.struct(p["kind"].alias("kind"), p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), n["label"].alias("label"), n["radius"].alias("radius")))
        return rows.withColumn("places", own)

    def judge(rows: DataFrame, _: DataFrame | None) -> DataFrame:
        near = F.exists("places", lambda p: F.sqrt(p["x"] ** 2 + p["y"] ** 2 + p["z"] ** 2) <= 0.1)
        at = lambda i: F.get("places", F.lit(i))
        meet = F.lit(False)
        for i in range(count if objects is not None else 0):
            for j in range(i):
                meet = meet | (F.sqrt((at(i)["x"] - at(j)["x"]) ** 2 + (at(i)["z"] - at(j)["z"]) ** 2) < at(i)["radius"] + at(j)["radius"])
        return rows.withColumn("reason", F.when(F.size("named") < count, "objects").when(near, "origin").when(meet, "meet"))

    done = in_rounds(base, ["scene_id"], made, judge, None, tries, each, alone=True)
    return Drawn(done.accepted.select("scene_id", "turns", "places", "attempt"), done.census, done.open.select("scene_id", "reason"))
