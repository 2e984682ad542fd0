"""Classification, indexing and history against plain loops on random tasks."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import loops
from trailframe.config import NavConfig
from trailframe.operators import samples, steps

SCHEMA = (
    "root string, task_idx bigint, step int, schema_version int, scene_id string, task_id string, "
    "instruction string, action int, cands array<struct<px: struct<u: bigint, v: bigint>, "
    "world: struct<x: double, y: double, z: double>, vis: int>>, n_pix int, n_world int, n_vis int, "
    "traj_px struct<u: bigint, v: bigint>, traj_world struct<x: double, y: double, z: double>, "
    "traj_status int, goal_distance double, is_endpoint boolean, floor_transition boolean, expert_idx int, "
    "floor_id int, floor_height double"
)


def random_step(rng):
    n = rng.randrange(4)
    lengths = [max(0, n + rng.choice((0, 0, 0, -1))) for _ in range(3)]
    maybe = lambda value, chance=0.2: None if rng.random() < chance else value
    pixel = lambda: (rng.randrange(200), rng.randrange(200))
    point = lambda: tuple(rng.randrange(8) / 2 for _ in range(3))
    return {
        "action": rng.choice((None, 0, 1, 1, 1, 1, 1, 2, 3)),
        "px": [maybe(pixel(), 0.1) for _ in range(lengths[0])],
        "world": [maybe(point(), 0.1) for _ in range(lengths[1])],
        "vis": [rng.choice((None, 0, 0, 1, 2)) for _ in range(lengths[2])],
        "traj_px": maybe(pixel()),
        "traj_world": maybe(point(), 0.4),
        "traj_status": rng.choice((None, 0, 0, 1)),
        "is_endpoint": rng.random() < 0.2,
        "floor_transition": rng.random() < 0.15,
        "expert_idx": maybe(rng.randrange(-1, 5), 0.5),
    }


def rows_of(tasks, version):
    out = []
    for number, task in enumerate(tasks):
        for i, s in enumerate(task):
            size = max(len(s["px"]), len(s["world"]), len(s["vis"]))
            cands = [(loops.at(s["px"], c), loops.at(s["world"], c), loops.at(s["vis"], c)) for c in range(size)]
            out.append(
                ("r", number, i, version, "s", str(number), "go", s["action"], cands, len(s["px"]),
                 len(s["world"]), len(s["vis"]), s["traj_px"], s["traj_world"], s["traj_status"], 1.0,
                 s["is_endpoint"], s["floor_transition"], s["expert_idx"], 0, 0.0)
            )
    return out


@pytest.fixture(scope="module")
def tasks():
    rng = random.Random(7)
    return [[random_step(rng) for _ in range(rng.choice((1, 5, 40, 90)))] for _ in range(60)]


@pytest.mark.parametrize("version", [2, 3])
def test_decisions_match_loops(spark, tasks, version):
    frame = spark.createDataFrame(rows_of(tasks, version), SCHEMA)
    near = steps.classify_steps(frame.withColumn("near", steps.closest_candidate()))
    for row in near.select("task_idx", "step", "near", "mode", "coord_supervised").collect():
        step = tasks[row["task_idx"]][row["step"]]
        index, distance = loops.nearest(step)
        got = row["near"]
        assert (got and got["idx"]) == index
        if index is not None:
            assert got["dist"] == pytest.approx(distance)
        assert row["mode"] == loops.mode(step, version)
        assert row["coord_supervised"] == loops.supervised(step, version)


@pytest.mark.parametrize("version", [2, 3])
@pytest.mark.parametrize("block_rows, gaps", [(65_536, 64), (1, 64), (7, 64), (5, 0)])
@pytest.mark.parametrize("ahead, frames", [(3, 8), (0, 1)])
def test_samples_match_loops(spark, tasks, version, block_rows, gaps, ahead, frames):
    config = NavConfig(max_action_lookahead=ahead, max_history_frames=frames)
    frame = spark.createDataFrame(rows_of(tasks, version), SCHEMA)
    got = samples.sample_history(frame, config, gaps, block_rows=block_rows)
    found = {
        (r["task_idx"], r["step"]): (r["mode"], r["absorbed"], r["emitted"], r["history"])
        for r in got.select("task_idx", "step", "mode", "absorbed", "emitted", "history").collect()
    }
    wanted = {
        (number, step): value
        for number, task in enumerate(tasks)
        for step, value in loops.samples(task, version, ahead, frames).items()
    }
    assert found == wanted


def test_look_up_is_planned_only_where_needed(spark, tasks):
    frame = spark.createDataFrame(rows_of(tasks, 3), SCHEMA)
    assert not samples.has_uncarried_gaps(frame)
    assert samples.has_uncarried_gaps(frame, 3)
    carried = samples.build_samples(frame).select("task_idx", "step", "images")
    joined = samples.build_samples(frame, max_carried_gaps=3).select("task_idx", "step", "images")
    assert carried.exceptAll(joined).isEmpty() and joined.exceptAll(carried).isEmpty()


def test_rows_are_shuffled_by_block_not_by_task(spark, tasks):
    frame = spark.createDataFrame(rows_of(tasks, 3), SCHEMA)
    plan = samples.sample_index(frame)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # Rows and block summaries by block, summaries by task.
    assert sum("block" in line for line in exchanges) <= 3
    assert sum("block" not in line for line in exchanges) == 1


def test_a_long_task_is_split_over_blocks(spark):
    rng = random.Random(3)
    task = [random_step(rng) for _ in range(1500)]
    frame = spark.createDataFrame(rows_of([task], 3), SCHEMA)
    indexed = samples.index_steps(steps.classify_steps(frame), block_rows=100)
    got = samples.with_history(indexed)
    found = {r["step"]: (r["mode"], r["absorbed"], r["emitted"], r["history"]) for r in got.collect()}
    assert found == loops.samples(task, 3)


def test_mode_stats_show_absent_modes(spark):
    frame = spark.createDataFrame([("action",), ("action",)], "mode string")
    assert {r["mode"]: r["samples"] for r in samples.mode_stats(frame).collect()} == {
        "frontier": 0, "target": 0, "action": 2, "stop": 0
    }


def test_threshold_depends_on_the_trajectory_point_alone(spark):
    """A world point without world candidates compares pixels with metres."""
    step = {
        "action": 1, "px": [(10, 10)], "world": [], "vis": [0], "traj_px": (11, 10),
        "traj_world": (0.0, 0.0, 0.0), "traj_status": 0, "is_endpoint": False,
        "floor_transition": False, "expert_idx": None,
    }
    far = {**step, "traj_px": (13, 10)}
    frame = spark.createDataFrame(rows_of([[step, far]], 2), SCHEMA)
    modes = [r["mode"] for r in steps.classify_steps(frame).orderBy("step").collect()]
    assert modes == ["frontier", "action"]


def test_nan_and_infinite_distances_never_match(spark):
    step = {
        "action": 1, "px": [(1, 1), (2, 2), (3, 3)],
        "world": [(float("nan"), 0.0, 0.0), (float("inf"), 0.0, 0.0), (1.0, 0.0, 0.0)], "vis": [0, 0, 0],
        "traj_px": None, "traj_world": (0.0, 0.0, 0.0), "traj_status": 0, "is_endpoint": False,
        "floor_transition": False, "expert_idx": None,
    }
    frame = spark.createDataFrame(rows_of([[step]], 2), SCHEMA)
    row = steps.classify_steps(frame).select("mode", "label").first()
    assert (row["mode"], row["label"]["u"]) == ("frontier", 3)


def test_config_presets():
    assert NavConfig().distance_threshold == 2.0
    assert NavConfig.training().distance_threshold == 3.0
    assert replace(NavConfig(), max_history_frames=4).max_history_frames == 4


def test_prompt_markers_inside_the_instruction(spark):
    from trailframe.functions.text import build_prompt

    frame = spark.createDataFrame(
        [("see <image> then <conjunction> not <history>",)], "instruction string"
    )
    none = F.array().cast("array<struct<u: bigint, v: bigint>>")
    config = NavConfig(image_token="[img]")
    prompt = frame.select(
        build_prompt(F.col("instruction"), none, F.lit(2), F.lit("Now: "), config).alias("p")
    ).first()["p"]
    assert "see [img] then Now:  not <history>. " in prompt
    assert "observations: [img][img]. Now: [img]." in prompt
    empty = frame.select(
        build_prompt(F.lit(None).cast("string"), none, F.lit(0), F.lit("Now: "), config).alias("p")
    ).first()["p"]
    assert "historical" not in empty and "Your task is to . " in empty
