"""Measures: block boundaries, NaN, running and final values, streams."""

import datetime
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailframe.operators import measures
from trailframe.streaming.measures import BlockMeasures, finish_measures, stream_measures, stream_measures_over_gaps

SCHEMA = (
    "episode_id bigint, step int, x double, y double, z double, distance_to_goal double, "
    "success boolean, spl double"
)
NAMES = ["path_length", "oracle_navigation_error", "oracle_success", "oracle_spl", "pl", "steps_taken"]


def random_episodes(seed=5, count=20):
    rng, rows = random.Random(seed), []
    for episode in range(count):
        for step in range(rng.randrange(1, 40)):
            nan = rng.random() < 0.1
            rows.append(
                (episode, step, rng.randrange(40) / 4, rng.randrange(8) / 4, rng.randrange(40) / 4,
                 float("nan") if nan and step else rng.randrange(80) / 8, step > 5,
                 float("nan") if nan else rng.random())
            )
    return rows


def loop(rows):
    """{(episode, step): values} with one running state per episode."""
    out, state = {}, {}
    for e, step, x, y, z, distance, _, spl in rows:
        if step == 0:
            state = {"at": (x, y, z), "path": 0.0, "error": math.inf, "near": 0.0, "spl": 0.0, "start": distance}
        state["path"] += math.dist((x, y, z), state["at"])
        state["at"] = (x, y, z)
        state["error"] = min(state["error"], distance)
        state["near"] = float(state["near"] or distance < 3.0)
        if step:
            state["spl"] = max(state["spl"], spl)
        longest = max(state["start"], state["path"])
        ratio = state["start"] / longest if longest else None
        out[e, step] = (state["path"], state["error"], state["near"], state["spl"], ratio, float(step))
    return out


def same(got, wanted):
    assert got.keys() == wanted.keys()
    for key, values in wanted.items():
        for a, b in zip(got[key], values):
            assert (a is None) == (b is None) and (b is None or a == pytest.approx(b)), key


@pytest.fixture(scope="module")
def episodes(spark):
    rows = random_episodes()
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache(), loop(rows)


@pytest.mark.parametrize("block_rows", [65_536, 1, 6])
def test_running_values(episodes, block_rows):
    frame, wanted = episodes
    got = measures.running_measures(frame, block_rows=block_rows)
    same({(r["episode_id"], r["step"]): [r[n] for n in NAMES] for r in got.collect()}, wanted)


@pytest.mark.parametrize("block_rows", [65_536, 1, 6])
def test_final_values(episodes, block_rows):
    frame, wanted = episodes
    last = {}
    for (episode, step), values in wanted.items():
        last[episode,] = values
    got = measures.measure_table(frame, block_rows=block_rows)
    same({(r["episode_id"],): [r[n] for n in NAMES] for r in got.collect()}, last)


@pytest.mark.parametrize("block_rows", [65_536, 6])
def test_stream_equals_batch_in_any_arrival_order(spark, episodes, tmp_path, block_rows):
    frame, _ = episodes
    frame.repartition(5, F.hash("step")).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    query = (
        stream_measures(source, block_rows)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{tmp_path}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{tmp_path}/out")
    )
    assert query.awaitTermination(120)
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert rows.count() == frame.count()
    batch = measures.measure_table(frame).collect()
    got = finish_measures(rows).collect()
    key = lambda r: (r["episode_id"],)
    same({key(r): [r[n] for n in NAMES] for r in got}, {key(r): [r[n] for n in NAMES] for r in batch})


def test_inputs_are_checked(episodes):
    frame, _ = episodes
    with pytest.raises(ValueError, match="pl needs success"):
        measures.measure_table(frame.drop("success"), ["pl"])
    with pytest.raises(ValueError, match="unknown measures: speed"):
        measures.measure_table(frame, ["speed"])
    assert measures.measure_table(frame.drop("spl"), ["path_length"]).columns == ["episode_id", "path_length"]


def test_position_free_measures_do_not_shuffle_rows(episodes):
    frame, _ = episodes
    plan = measures.measure_table(frame, ["oracle_success"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max" in plan


def test_resting_at_the_goal_has_no_ratio(spark):
    frame = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 0.0, True, 1.0)], SCHEMA)
    row = measures.measure_table(frame).first()
    assert row["pl"] is None and row["steps_taken"] == 0.0 and row["oracle_spl"] == 0.0


def gap_stream(spark, folder, number, rows, **options):
    """One run of the gap stream over a further file; all rows so far."""
    spark.createDataFrame(rows, f"{SCHEMA}, at timestamp").coalesce(1).write.parquet(f"{folder}/in/{number}")
    source = spark.readStream.schema(f"{SCHEMA}, at timestamp").parquet(f"{folder}/in/*")
    query = (
        stream_measures_over_gaps(source, "at", delay="10 seconds", **options)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{folder}/out")
    )
    assert query.awaitTermination(120)
    return spark.read.parquet(f"{folder}/out")


def at(seconds):
    return datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc).replace(tzinfo=None)


def plain_row(episode, step, x, seconds=None, distance=5.0):
    return (episode, step, float(x), 0.0, 0.0, distance, False, 0.5, at(1000 + step if seconds is None else seconds))


def test_waiting_rows_leave_when_the_watermark_passes_a_gap(spark, tmp_path):
    """Step 2 never comes: 3 and 4 wait, leave in step order, and 2 is late afterwards."""
    out = gap_stream(spark, tmp_path, 0, [plain_row(1, s, s) for s in (4, 0, 3, 1)])
    assert sorted(r["step"] for r in out.collect()) == [0, 1]
    # Another episode moves the watermark to 1003, past step 2 but not past steps 3 and 4.
    out = gap_stream(spark, tmp_path, 1, [plain_row(2, 0, 0, 1013)])
    assert sorted(r["step"] for r in out.where("episode_id = 1").collect()) == [0, 1]
    # Nothing younger than step 3 can be missing before it once the watermark is at 1004: step 4 follows at once.
    out = gap_stream(spark, tmp_path, 2, [plain_row(2, 1, 0, 1014)]).where("episode_id = 1 and not late")
    assert [(r["step"], r["path_length"]) for r in out.orderBy("step").collect()] == [(0, 0.0), (1, 1.0), (3, 3.0), (4, 4.0)]
    out = gap_stream(spark, tmp_path, 3, [plain_row(1, 2, 9), plain_row(1, 4, 7), plain_row(1, 5, 5)])
    late = out.where("late").orderBy("step").collect()
    assert [(r["episode_id"], r["step"]) for r in late] == [(1, 2), (1, 4)]
    assert late[0]["path_length"] is None
    final = {r["episode_id"]: r["path_length"] for r in finish_measures(out).collect()}
    assert final == {1: 5.0, 2: 0.0}


def test_idle_blocks_are_dropped_and_may_go_on(spark, tmp_path):
    gap_stream(spark, tmp_path, 0, [plain_row(1, s, s) for s in range(3)], idle="1 minute")
    gap_stream(spark, tmp_path, 1, [plain_row(2, 0, 0, 5000)], idle="1 minute")
    # Its state is gone: step 1 again is behind the watermark, steps from 3 on are a new segment.
    rows = [plain_row(1, 1, 1), plain_row(1, 3, 4, 5001), plain_row(1, 4, 5, 5002), plain_row(2, 1, 1, 9000)]
    gap_stream(spark, tmp_path, 2, rows, idle="1 minute")
    out = gap_stream(spark, tmp_path, 3, [plain_row(3, 0, 0, 9500)], idle="1 minute")
    assert sorted((r["step"], r["segment"], r["late"]) for r in out.where("episode_id = 1").collect()) == [
        (0, 0, False), (1, -1, True), (1, 0, False), (2, 0, False), (3, 3, False), (4, 3, False)]
    assert {r["episode_id"]: r["path_length"] for r in finish_measures(out).collect()}[1] == 5.0
    state = spark.read.format("statestore").option("stateVarName", "totals").load(f"{tmp_path}/checkpoint")
    # Only the episode of the last row still has state.
    assert {r["key"]["episode_id"] for r in state.collect()} == {3}


@pytest.mark.parametrize("block_rows", [65_536, 6])
def test_gap_stream_equals_batch(spark, tmp_path, block_rows):
    rng = random.Random(11)
    rows = [(*r, at(r[1] * 7)) for r in random_episodes() if rng.random() < 0.7]
    rng.shuffle(rows)
    folder = tmp_path
    frame = spark.createDataFrame(rows, f"{SCHEMA}, at timestamp")
    frame.repartition(4).write.parquet(f"{folder}/in/0")
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    query = (
        stream_measures_over_gaps(source, "at", delay="1 day", block_rows=block_rows)
        .writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start(f"{folder}/out")
    )
    assert query.awaitTermination(120)
    end = spark.createDataFrame([(*random_episodes()[0], at(10**9))], frame.schema).withColumn("episode_id", F.lit(-1).cast("bigint"))
    end.write.parquet(f"{folder}/in/1")
    query = (
        stream_measures_over_gaps(source, "at", delay="1 day", block_rows=block_rows)
        .writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start(f"{folder}/out")
    )
    assert query.awaitTermination(120)
    out = spark.read.parquet(f"{folder}/out").where("episode_id >= 0")
    assert out.count() == len(rows) and out.where("late").count() == 0
    batch = measures.measure_table(frame.drop("at")).collect()
    key = lambda r: (r["episode_id"],)
    got = {key(r): [r[n] for n in NAMES] for r in finish_measures(out).collect()}
    same(got, {key(r): [r[n] for n in NAMES] for r in batch})


def test_a_block_costs_one_read_and_one_write_of_its_state():
    """Rows that wait are part of the one value, not an entry of the state each."""
    calls = []

    class Value:
        stored = None

        def get(self):
            calls.append("get")
            return self.stored

        def update(self, value):
            calls.append("update")
            self.stored = value

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    def frame(steps):
        rows = [(s, float(s), 0.0, 0.0, 9.0 - s, 0.5) for s in steps]
        return pd.DataFrame(rows, columns=["step", "x", "y", "z", "distance_to_goal", "spl"])

    processor = BlockMeasures(100)
    processor.init(Handle())
    assert list(processor.handleInputRows((7, 0), iter([frame(range(1, 90))]), None)) == []
    assert calls == ["get", "update"]
    (out,) = processor.handleInputRows((7, 0), iter([frame([0, 95])]), None)
    assert calls == ["get", "update"] * 2
    assert out["step"].tolist() == list(range(90)) and out["path_length"].tolist() == [float(k) for k in range(90)]
    assert out["oracle_navigation_error"].iloc[-1] == -80.0
