"""Tasks over drawn boxes, routes and floors, registered beside those over objects (``curriculum.TASKS``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import floors, placing, routes
from orrery.operators.curriculum import Task, register

#: The tasks of this module.
NAMES = ["dist_box", "rel_dist_box", "visibility_from_pose", "box_floor_area_nonrect", *[f"route_plan_{n}turn{r}_box" for n in (1, 2, 3, 4) for r in ("", "_reface")]]


def scenes_of(objects: DataFrame, height: float = 1.0) -> DataFrame:
    """Where things may be placed in each scene: the middle half of its objects' places, a metre about eye level, and at
    least two metres wide."""
    middle = lambda c: (F.min(c) + F.max(c)) / 2
    half = lambda c: F.greatest((F.max(c) - F.min(c)) / 4, F.lit(1.0))
    sides = [(middle(c) - half(c)).alias("l" + c) for c in "xz"] + [(middle(c) + half(c)).alias("h" + c) for c in "xz"]
    return objects.where("scene_id IS NOT NULL").groupBy(F.col("scene_id").cast("string").alias("scene_id")).agg(*sides).withColumns({"ly": F.lit(-height), "hy": F.lit(height)})


def _route(turns: int, reface: bool) -> Task:
    def question() -> Column:
        steps = []
        for k in range(turns + reface + 1):
            ask = (k < turns + 1) if reface else (0 < k < turns + 1)
            steps += ["[please fill in]"] * ask + [f"Go forward until marker {k + 1 + reface}"] * (k < turns + 1)
        start = f"You are at marker 0 and face marker {1}. " if reface or turns else "You are at marker 0. "
        return F.lit(start + "You want to reach the last marker. " + "; ".join(f"{i}. {s}" for i, s in enumerate(steps, 1)))

    name = f"route_plan_{turns}turn{'_reface' if reface else ''}_box"
    return Task(name, lambda o: routes.drawn_routes(scenes_of(o), turns, reface).accepted, question, lambda: F.array_join("turns", ", "))


register(Task("dist_box", lambda o: placing.box_sets(scenes_of(o), 2).accepted, lambda: F.lit("How far apart are the surfaces of the two boxes, in metres?"), lambda: F.col("answer")))
register(Task("rel_dist_box", lambda o: placing.box_sets(scenes_of(o), 5).accepted, lambda: F.lit("Which of the boxes A, B, C and D is closest to the first box, by their surfaces?"), lambda: F.col("answer")))
register(Task("visibility_from_pose", lambda o: placing.sightlines(scenes_of(o)).accepted, lambda: F.lit("Standing at the first marker, can you see the second one past the box? Answer yes or no."), lambda: F.col("answer")))
register(Task(
    "box_floor_area_nonrect",
    lambda o: floors.two_part_floors(scenes_of(o).select("scene_id", *floors.SIDES)).where("part = 0"),
    lambda: F.lit("What is the size of this room, in square metres? Count the combined space where there are several parts."),
    lambda: F.round("area", 1),
))
for _turns in (1, 2, 3, 4):
    for _reface in (False, True):
        register(_route(_turns, _reface))
