"""Tasks over drawn boxes: every scene is answered, and questions say what is asked."""

from collections import Counter

from orrery.operators import curriculum, tasks


def test_box_tasks(spark):
    rows = [(f"s{k // 5}", k, "kind", float(k % 7), float(k % 5)) for k in range(60)] + [(None, 99, "kind", 0.0, 0.0), ("odd", 100, "kind", None, None)]
    objects = spark.createDataFrame(rows, "scene_id string, object_id long, label string, x double, z double")
    assert set(tasks.NAMES) <= set(curriculum.TASKS)
    wanted = ["dist_box", "box_floor_area_nonrect", "route_plan_1turn_reface_box", "route_plan_2turn_box"]
    got = curriculum.dispatched(objects, wanted).collect()
    assert Counter(r.task for r in got) == dict.fromkeys(wanted, 12)
    for r in got:
        asked = r.question.count("[please fill in]")
        if r.task.startswith("route"):
            assert asked == 2 == len(r.answer.split(", ")) and r.question.count("Go forward") == asked + (r.task == "route_plan_2turn_box")
        else:
            assert float(r.answer) > 0 and not asked
