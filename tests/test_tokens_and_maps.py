"""Token operators, batches and map operators on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from trailframe.functions import tokens
from trailframe.functions.geometry import spread_index
from trailframe.operators import batches, raster
from trailframe.operators.skew import marked_by_bitmap
from trailframe.plans.queries import QUERIES


def last_place(ids, pattern):
    places = [i for i in range(len(ids) - len(pattern) + 1) if ids[i : i + len(pattern)] == pattern]
    return places[-1] if places else -1


def masked(ids, marker, response, eos):
    start = last_place(ids, marker)
    if start >= 0:
        start += len(marker)
    else:
        start = last_place(ids, response)
        if start < 0:
            start = len(ids) // 2
    labels = [-100] * min(start, len(ids)) + ids[start:]
    ends = [i for i, t in enumerate(ids) if t == eos]
    for i in ends:
        labels[i] = -100
    if ends:
        labels[ends[-1]] = eos
    return labels


def test_subsequence_and_labels(spark):
    rng = random.Random(11)
    rows = [
        (i, [rng.randrange(4) for _ in range(rng.randrange(25))], [rng.randrange(4) for _ in range(rng.randrange(4))])
        for i in range(300)
    ]
    frame = spark.createDataFrame(rows, "k bigint, ids array<int>, response array<int>")
    marker = F.array(F.lit(2), F.lit(2), F.lit(1))
    got = batches.label_samples(frame, marker, F.col("response"), 3).withColumn(
        "at", tokens.last_subsequence(F.col("ids"), F.col("response"))
    )
    for row in got.collect():
        ids = row["ids"]
        assert row["at"] == last_place(ids, row["response"])
        assert row["labels"] == masked(ids, [2, 2, 1], row["response"], 3)
        assert row["attention_mask"] == [1] * len(ids)
    without_end = batches.label_samples(frame, marker, F.col("response"), None, max_length=5)
    assert all(len(r["input_ids"]) <= 5 and len(r["labels"]) <= 5 for r in without_end.collect())


@pytest.mark.parametrize("by_length", [False, True])
def test_batches(spark, by_length):
    frame = spark.range(100).select(
        F.col("id"), F.array_repeat(F.lit(5), (F.col("id") % 9).cast("int")).alias("input_ids")
    )
    frame = frame.select("*", F.col("input_ids").alias("labels"), F.transform("input_ids", lambda t: F.lit(1)).alias("attention_mask"))
    rows = batches.pad_batches(frame, "id", 8, 0, by_length=by_length, rows_per_shard=30).collect()
    assert len(rows) == 100 and len({r["shard"] for r in rows}) == 4
    groups = {}
    for r in rows:
        groups.setdefault((r["shard"], r["batch_id"]), []).append(r)
    for group in groups.values():
        assert len(group) <= 8
        longest = max(r["id"] % 9 for r in group)
        for r in group:
            n = r["id"] % 9
            assert r["input_ids"] == [5] * n + [0] * (longest - n)
            assert r["labels"] == [5] * n + [-100] * (longest - n)
            assert r["attention_mask"] == [1] * n + [0] * (longest - n)


def test_pad_in_portions(spark, monkeypatch):
    """Batches are the same when a task pads few ids at a time."""
    frame = spark.range(60).select("id", F.array_repeat(F.lit(5), (F.col("id") % 9).cast("int")).alias("input_ids"))
    frame = frame.withColumn("labels", F.col("input_ids"))
    whole = {r["id"]: r for r in batches.pad_batches(frame, "id", 8, 0, rows_per_shard=30).collect()}
    monkeypatch.setattr(batches, "PAD_IDS", 10)
    assert {r["id"]: r for r in batches.pad_batches(frame, "id", 8, 0, rows_per_shard=30).collect()} == whole


def test_spread_index_equals_floor_of_even_spacing(spark):
    np = pytest.importorskip("numpy")
    for slots in (1, 2, 8, 15, 23):
        frame = spark.range(1, 400).select(
            F.col("id").cast("int").alias("n"),
            F.transform(
                F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: spread_index(i, F.col("id").cast("int"), slots)
            ).alias("places"),
        )
        for row in frame.collect():
            assert row["places"] == np.linspace(0, row["n"] - 1, slots, dtype=int).tolist()


def points(spark, rows):
    frame = spark.createDataFrame(rows, "map_id int, step int, x double, z double")
    return frame.select(
        "*",
        *[F.lit(v).alias(n) for n, v in (("low_x", 0.0), ("low_z", 0.0), ("high_x", 10.0), ("high_z", 10.0))],
        F.lit(10).alias("n_rows"),
        F.lit(10).alias("n_cols"),
        F.lit(0.25).alias("metres_per_cell"),
    )


def test_grid_cuts_toward_zero(spark):
    got = raster.to_grid(points(spark, [(0, 0, -0.5, 9.9), (0, 1, 3.0, -1.7)])).orderBy("step").collect()
    assert [(r["row"], r["col"]) for r in got] == [(9, 0), (-1, 3)]
    flat = points(spark, [(0, 0, 1.0, 1.0)]).withColumn("high_x", F.lit(0.0))
    assert raster.to_grid(flat).first()["col"] is None


def test_stamps_are_clipped(spark):
    centre = raster.to_grid(points(spark, [(0, 0, 0.0, 0.0)]))
    assert {(r["row"], r["col"]) for r in raster.stamp_square(centre).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    middle = raster.to_grid(points(spark, [(0, 0, 5.0, 5.0)]))
    cells = {(r["row"], r["col"]) for r in raster.stamp_triangle(middle).collect()}
    assert cells == {(4, 5), (5, 5), (6, 4), (6, 5), (6, 6)}


def test_segments(spark):
    frame = spark.createDataFrame([(1, 0, 0, 0, 40), (2, 3, 3, 3, 3)], "k int, row1 int, col1 int, row2 int, col2 int")
    draw = lambda style, gap: {(r["k"], r["row"], r["col"]) for r in raster.densify_segment(frame, style, gap).collect()}
    assert draw("dotted", 15) == {(1, 0, 0), (1, 0, 15), (1, 0, 30)}
    assert draw("dashed", 10) == {(1, 0, c) for c in (*range(0, 11), *range(20, 31))}
    assert draw("filled", 1) == {(1, 0, c) for c in range(41)} | {(2, 3, 3)}
    with pytest.raises(ValueError):
        raster.densify_segment(frame, "wavy")


def test_clipped_segments_keep_the_cells_on_the_map(spark):
    ends = [(1, -90, 4, 200, 50), (2, 3, 3, 3, 3), (3, 10, -70, 10, 300), (4, -9, -9, -2, -9), (5, 63, 0, 0, 63), (6, 5, 200, 90, 2)]
    frame = spark.createDataFrame(ends, "k int, row1 int, col1 int, row2 int, col2 int")
    sized = frame.withColumns({"n_rows": F.lit(64), "n_cols": F.lit(64)})
    inside = "row >= 0 and row < 64 and col >= 0 and col < 64"
    for style, gap in (("dotted", 15), ("dashed", 10), ("filled", 1)):
        cells = [
            {tuple(r) for r in raster.densify_segment(f, style, gap).where(inside).select("k", "row", "col").collect()}
            for f in (frame, sized)
        ]
        assert cells[0] == cells[1] and cells[0]
    far = spark.createDataFrame([(1, 0, 0, 7, 2_000_000_000)], frame.schema).withColumns({"n_rows": F.lit(64), "n_cols": F.lit(64)})
    assert raster.densify_segment(far, "filled").count() < 100


def test_waypoints_on_the_edge(spark):
    edge = points(spark, [(0, 0, 0.0, 5.0)])
    assert raster.waypoint_layer(edge, "prediction").isEmpty()
    assert not raster.waypoint_layer(edge, "oracle").isEmpty()


def test_later_layers_win(spark):
    layer = lambda code, cols: spark.createDataFrame([(0, 0, c, code) for c in cols], "map_id int, row int, col int, code int")
    got = raster.compose_layers([layer(4, [0, 1]), layer(6, [1, 2])]).collect()
    assert {(r["col"], r["code"]) for r in got} == {(0, 4), (1, 6), (2, 6)}


def test_colours(spark):
    cells = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (4, 0), (99, 1)], "code int, fog int")
    got = raster.colorize_cells(cells, raster.default_palette(spark)).collect()
    colour = {(r["code"], r["fog"]): (r["r"], r["g"], r["b"]) for r in got}
    assert colour == {
        (0, 0): (255, 255, 255), (1, 0): (75, 75, 75), (1, 1): (150, 150, 150), (4, 0): (0, 0, 100),
        (99, 1): (None, None, None),
    }


def test_area_resize_keeps_the_type_and_grows(spark):
    frame = spark.createDataFrame([(0, r, c, 2, 2, r * 2 + c) for r in range(2) for c in range(2)],
                                  "map_id int, row int, col int, n_rows int, n_cols int, value int")
    one = raster.resize_area(frame, 1, 1, value_type="int").first()
    assert one["value"] == 1
    assert raster.resize_area(frame, 3, 3).count() == 9


def test_batches_stay_together(spark):
    """A batch lies in one task, in order, also where Arrow batches and shards end inside of it."""
    rng = random.Random(12)
    rows = [(f"k{i}", [rng.randrange(9) for _ in range(rng.randrange(6))]) for i in range(500)]
    frame = spark.createDataFrame(rows, "key string, input_ids array<int>").withColumn("labels", F.transform("input_ids", lambda t: -t))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        padded = batches.pad_batches(frame, "key", 4, 99, shards=3).withColumn("task", F.spark_partition_id())
        plan = padded._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan
        got = padded.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ids = dict(rows)
    assert sorted(r["key"] for r in got) == sorted(ids)
    groups = {}
    for r in got:
        groups.setdefault((r["shard"], r["batch_id"]), []).append(r)
    for (shard, batch), members in groups.items():
        longest = max(len(ids[r["key"]]) for r in members)
        assert len(members) == 4 or batch == max(b for s, b in groups if s == shard)
        assert len({r["task"] for r in members}) == 1
        for r in members:
            own = ids[r["key"]]
            short = longest - len(own)
            assert r["input_ids"] == own + [99] * short and r["labels"] == [-t for t in own] + [-100] * short
            assert r["attention_mask"] == [1] * len(own) + [0] * short


def test_bitmap_marks_every_listed_key(spark):
    rows = spark.range(5000).withColumn("k", F.when(F.col("id") % 50 != 0, F.col("id")))
    listed = rows.where("id % 9 = 0 or k is null").select(F.col("k").alias("l"))
    marked = marked_by_bitmap(rows, listed, [F.col("k")], [F.col("l")], "hit")
    assert marked.columns == ["id", "k", "hit"] and marked.count() == 5000
    hits = {r["id"] for r in marked.where("hit").collect()}
    assert {i for i in range(5000) if i % 9 == 0 or i % 50 == 0} <= hits and len(hits) < 700
    assert marked_by_bitmap(rows, listed.limit(0), [F.col("k")], [F.col("l")], "hit").where("hit").isEmpty()


def test_tasks_of_a_path_layer_grow_with_its_points(spark):
    """A task's cells are bounded, on both sides of the shuffle, whatever the session's partitions."""
    rows = [(k % 3, k // 3, (k * 7 % 80) / 4.0, (k * 11 % 80) / 4.0) for k in range(900)]
    bounds = "0.0 as low_x, 0.0 as low_z, 20.0 as high_x, 20.0 as high_z, 64 as n_rows, 64 as n_cols, 0.125 as metres_per_cell"
    path = spark.createDataFrame(rows, "map_id bigint, step int, x double, z double").selectExpr("*", *bounds.split(", "))
    small, large = (raster.reference_path_layer(path, task_points=n) for n in (90, 10_000))
    assert small.rdd.getNumPartitions() == 10 and large.rdd.getNumPartitions() == 1
    wanted = sorted(map(tuple, large.collect()))
    assert len(set(wanted)) == len(wanted) and sorted(map(tuple, small.collect())) == wanted


def test_loss_start_searches_each_pattern_once(spark):
    rows = [(1, [5, 2, 3, 9, 9], [2, 3], [9]), (2, [5, 9, 4, 9], [2, 3], [9, 4]), (3, [5, 6, 7, 8], [2, 3], [1]),
            (4, [5, 6, 7], [2, 3], None), (5, [], [2, 3], [4]), (6, [1, 2], [], [1])]
    frame = spark.createDataFrame(rows, "id int, ids array<int>, mark array<int>, response array<int>")
    found = frame.select("id", tokens.loss_start(F.col("ids"), F.col("mark"), F.col("response")).alias("start"))
    assert {r["id"]: r["start"] for r in found.collect()} == {1: 3, 2: 1, 3: 2, 4: 1, 5: 0, 6: 2}
    # Two searches, each of which writes ids and pattern as text.
    assert found._jdf.queryExecution().analyzed().toString().count("array_join(") == 4


def test_collate_derives_its_samples_once(spark):
    plan = QUERIES["A4_collate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and "loss_start" not in plan
