"""Documents, rules, conversations and image lookup on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from trailframe.operators import conversations, images, steps, validate
from trailframe.sources import conversations as conversation_source
from trailframe.session import write_through
from trailframe.sources import exploration, json_elements
from trailframe.plans.queries import QUERIES
from trailframe.sources.images import load_image_files

SETTINGS = {name: 1.0 for name in validate.REQUIRED_SETTINGS} | {"endpoint_target_radius_m": 3.0}


def task(n=3, **changes):
    one = {
        "scene_id": "a", "task_id": "t", "instruction": "go", "goal_world": [1, 2, 3],
        "termination_reason": "max_steps", "success": False, "final_geodesic_distance": 9.0,
        "actions": [1] * n, "topdown_coords": [[]] * n, "pixel_coords": [[[5, 6], None]] * n,
        "world_coords": [[[0.5, 0, 1], None]] * n, "visibility_status": [[0, 1]] * n, "history_info": [{}] * n,
        "trajectory_pixel": [[5, 6]] * n, "trajectory_world": [[0, 0, 0]] * n, "trajectory_status": [0] * n,
        "trajectory_goal_distances": [2.0] * n, "trajectory_is_endpoint": [False] * n, "floor_ids": [0] * n,
        "floor_heights": [0.0] * n, "floor_transition": [False] * n, "expert_candidate_indices": [None] * n,
    }
    one.update(changes)
    return {k: v for k, v in one.items() if v != "absent"}


def reached(n=3, **changes):
    done = {"termination_reason": "reached_goal", "success": True, "final_geodesic_distance": 0.5}
    return task(n, **(done | {"actions": [1] * (n - 1) + [0]} | changes))


def document(*tasks, version=3, settings=SETTINGS):
    return {"schema_version": version, "generation_config": settings, "tasks": list(tasks)}


def write(path, doc, pack=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    text = json.dumps(doc, indent=1)
    if pack:
        with gzip.open(path, "wt", encoding="utf-8") as out:
            out.write(text)
    else:
        path.write_text(text, encoding="utf-8")
    return str(path)


def broken(spark, tmp_path, *docs):
    for i, doc in enumerate(docs):
        write(tmp_path / f"r{i}" / "exploration_data.json", doc)
    tasks = exploration.load_tasks(spark, f"{tmp_path}/r*/exploration_data.json")
    return validate.violations(tasks).orderBy("root", "task_idx", "rule_no", "step").collect()


CASES = [
    (2, document(task(), settings={k: 1.0 for k in validate.REQUIRED_SETTINGS[2:]}), "stop_radius_m, waypoint_radius_m"),
    (2, document(task(), settings=None), None),
    (3, document(task(success="absent", trajectory_is_endpoint="absent")), "success, trajectory_is_endpoint"),
    (4, document(task(termination_reason=None)), None),
    (5, document(task(0)), None),
    (6, document(task(floor_ids=[0, 0], history_info="absent")), "history_info, floor_ids"),
    (6, document(task(topdown_coords=None)), "topdown_coords"),
    (7, document(task(success=True)), "max_steps"),
    (8, document(reached(final_geodesic_distance=1.5)), "2"),
    (8, document(reached(final_geodesic_distance=float("nan"))), "2"),
    (8, document(reached(actions=[0, 1, 0])), "0, 2"),
    (9, document(task(actions=[1, 0, 1])), "1"),
    (10, document(task(floor_transition=[False, True, False])), None),
    (11, document(task(trajectory_is_endpoint=[True, False, True], trajectory_goal_distances=[3.0, 9.0, 3.5])), None),
    (11, document(task(trajectory_is_endpoint=[True, False, False], trajectory_goal_distances=[float("inf"), 1.0, 1.0])), None),
    (20, document(task(scene_id="absent")), "scene_id"),
    (21, document(task(trajectory_pixel=[[5.5, 6], None, None])), None),
    (21, document(task(actions=[1, 1.5, 1])), None),
    (22, document(task(pixel_coords=[[None, None]] * 3)), None),
]


@pytest.mark.parametrize("number, doc, detail", CASES)
def test_each_rule_fails_where_it_should(spark, tmp_path, number, doc, detail):
    found = [r for r in broken(spark, tmp_path, doc) if r["rule_no"] == number]
    assert found
    if detail is not None:
        assert found[0]["detail"] == detail


def test_sound_documents_break_no_rule(spark, tmp_path):
    assert broken(spark, tmp_path, document(task(), reached()), document(task(floor_ids=[0]), version=2)) == []


def test_unknown_version(spark, tmp_path):
    assert [r["rule"] for r in broken(spark, tmp_path, document(task(), version=4))] == ["schema_version"]


def test_step_rules_name_the_steps(spark, tmp_path):
    doc = document(task(trajectory_is_endpoint=[True, True, False], trajectory_goal_distances=[3.5, None, 1.0]))
    assert [(r["rule_no"], r["step"]) for r in broken(spark, tmp_path, doc)] == [(11, 0), (11, 1)]


def test_modes_of_validation(spark, tmp_path):
    path = write(tmp_path / "r" / "exploration_data.json", document(task(), task(success=True), task(0)))
    tasks = exploration.load_tasks(spark, path)
    kept, found = validate.validate(tasks)
    assert [r["task_idx"] for r in kept.collect()] == [0] and found.count() == 2
    first = validate.first_errors(tasks).first()
    assert (first["task_idx"], first["rule"]) == (1, "success_mismatch")
    with pytest.raises(ValueError, match="task 1 .*success_mismatch"):
        validate.validate(tasks, "fail")
    assert validate.validate(tasks, "report")[0].count() == 3


def test_legacy_summary(spark, tmp_path):
    doc = document(
        task(actions=[0, None, 0]), task(0), task(trajectory_pixel=[[1, 1], None, None], world_coords=[]), version=1
    )
    tasks = exploration.load_tasks(spark, write(tmp_path / "d.json", doc))
    assert validate.legacy_summary(tasks).first().asDict() == {
        "skipped_stops": 2, "disabled_target_frames": 4, "abnormal_tasks": 2
    }


@pytest.mark.parametrize("pack", [False, True])
def test_plain_and_packed_documents(spark, tmp_path, pack):
    doc = document(task(instruction="dépêche ↑"), task())
    del doc["schema_version"]
    path = write(tmp_path / ("d.json.gz" if pack else "d.json"), doc, pack)
    rows = exploration.load_tasks(spark, path).orderBy("task_idx").collect()
    assert [r["task_idx"] for r in rows] == [0, 1]
    assert rows[0]["instruction"] == "dépêche ↑" and rows[0]["schema_version"] == 1


def test_short_and_missing_arrays_read_as_defaults(spark, tmp_path):
    doc = document(task(trajectory_pixel=[[7, 8]], floor_transition="absent", visibility_status=[None, [0]]), version=2)
    rows = steps.explode_steps(exploration.load_tasks(spark, write(tmp_path / "d.json", doc))).orderBy("step").collect()
    assert [r["traj_px"] and r["traj_px"]["u"] for r in rows] == [7, None, None]
    assert [r["n_vis"] for r in rows] == [0, 1, 0] and [r["n_pix"] for r in rows] == [2, 2, 2]
    assert not any(r["floor_transition"] for r in rows)
    assert rows[1]["cands"][0]["vis"] == 0 and rows[0]["cands"][0]["vis"] is None


def test_union_of_roots(spark, tmp_path):
    for name in ("b", "a"):
        write(tmp_path / name / "exploration_data.json", document(task(task_id=name)))
    roots = [f"{tmp_path}/{n}" for n in ("b", "none", "a")]
    with pytest.warns(UserWarning, match="none"):
        rows = exploration.union_roots(spark, roots).orderBy("root_no").collect()
    assert [(r["root_no"], r["task_id"]) for r in rows] == [(0, "b"), (1, "a")]
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        exploration.union_roots(spark, roots[1:2])


def test_conversations(spark, tmp_path):
    items = [
        {"video": "v", "conversations": [
            {"from": "human", "value": "<video>\nWhat?"}, {"from": "gpt", "value": "one"},
            {"from": "system", "value": "x"}, {"from": "human", "value": " And <video>now?"},
            {"from": "gpt", "value": "two"}]},
        {"id": "k", "image": "i", "conversations": [{"from": "human", "value": "Look"}]},
        {"id": 5, "conversations": []},
    ]
    (tmp_path / "c.json").write_text(json.dumps(items))
    loaded = conversation_source.load_conversations(spark, f"{tmp_path}/c.json")
    rows = conversations.flatten_items(loaded).orderBy("item_idx").collect()
    eight = "<image>" * 8
    assert rows[0]["prompt"] == f"{eight}\nWhat?{eight}\n And now?" and rows[0]["response"] == "two"
    assert [r["item_id"] for r in rows] == ["0", "k", "5"]
    assert [r["n_images"] for r in rows] == [8, 1, 8]
    assert (rows[1]["prompt"], rows[1]["response"], rows[2]["prompt"]) == ("Look", "", "")


def test_content_parts_stop_at_the_last_image(spark):
    frame = spark.createDataFrame([("a", "<image>x<image><image>y", 2)], "k string, prompt string, n int")
    parts = conversations.content_parts(frame, F.col("n")).orderBy("part").collect()
    assert [(p["type"], p["text"], p["image_idx"]) for p in parts] == [
        ("image", None, 0), ("text", "x", None), ("image", None, 1), ("text", "y", None)
    ]


def test_frame_plan_placeholders(spark):
    frame = spark.createDataFrame([("a", 3), ("b", 0), ("c", None)], "video string, total_frames int")
    rows = conversations.video_frame_plan(frame).orderBy("video", "slot").collect()
    assert [r["frame_no"] for r in rows[:8]] == [0, 0, 0, 0, 1, 1, 1, 2]
    assert {(r["video"], r["reason"]) for r in rows} == {("a", None), ("b", "no_frames"), ("c", "not_found")}


def test_image_lookup_order(spark):
    wanted = spark.createDataFrame(
        [("r", "s/t/rgb/a.jpg"), ("r", "s/t/rgb/b.jpg"), ("r", "s/t/c.v2.jpg"), ("r", "top.jpg"), ("r", "s/none.jpg")],
        "root string, rel_path string",
    )
    store = spark.createDataFrame(
        [("*", "s/t/rgb/a.jpg", b"1"), ("s", "s/t/rgb/a", b"2"), ("*", "t/rgb/b", b"3"), ("s", "t/c.v2", b"4"),
         ("s", "s/t/c.v2.jpg", b"5"), ("*", "top", b"6"), ("x", "t/rgb/b", b"7")],
        "store string, key string, bytes binary",
    )
    found = {r["rel_path"]: r["bytes"] and bytes(r["bytes"]) for r in images.resolve_images(wanted, store).collect()}
    assert found == {
        "s/t/rgb/a.jpg": b"2", "s/t/rgb/b.jpg": b"3", "s/t/c.v2.jpg": b"4", "top.jpg": b"6", "s/none.jpg": None
    }


def test_image_tables_do_not_pass_through_the_driver(spark):
    """However small the tables seem, only the bitmap is broadcast."""
    wanted = spark.createDataFrame([("r", "s1/t/a.jpg")], "root string, rel_path string")
    store = spark.createDataFrame([("r", "s1", "t/a", bytearray(b"x"))], "root string, store string, key string, bytes binary")
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    resolved = images.resolve_images(wanted, store)
    assert plan(images.locate_images(wanted, store)).count("BroadcastHashJoin") == 0
    assert plan(resolved).count("BroadcastHashJoin") == 1
    assert [bytes(r["bytes"]) for r in resolved.collect()] == [b"x"]


def test_image_files(spark, tmp_path):
    (tmp_path / "full.jpg").write_bytes(b"x")
    (tmp_path / "empty.jpg").write_bytes(b"")
    listing = load_image_files(spark, str(tmp_path)).select(F.substring_index("path", "/", -1).alias("path"), "length")
    required = spark.createDataFrame([("full.jpg",), ("empty.jpg",), ("gone.jpg",), ("gone.jpg",)], "path string")
    report = {r["path"] for r in images.check_image_files(required, listing).collect()}
    assert report == {"empty.jpg", "gone.jpg"}
    table = spark.createDataFrame([("full.jpg", 1), ("empty.jpg", 0)], "path string, length bigint")
    report = {(r["path"], r["reason"]) for r in images.check_image_files(required, table).collect()}
    assert report == {("empty.jpg", "empty"), ("gone.jpg", "missing")}


@pytest.mark.parametrize("rows_per_bucket", [65_536, 10])
def test_failed_samples_get_good_content(spark, rows_per_bucket):
    frame = spark.range(300).select("id", (F.col("id") * 2).alias("content"))
    failed = F.col("id") % 3 == 0

    def run(partitions):
        kept = images.resample_failed(frame.repartition(partitions), failed, ["id"], rows_per_bucket=rows_per_bucket)
        return {r["id"]: (r["content"], r["from_id"]) for r in kept.collect()}

    got = run(1)
    assert got == run(8) and len(got) == 300
    for key, (content, origin) in got.items():
        assert content == origin * 2 and origin % 3 != 0 and (origin == key or key % 3 == 0)
    assert len({origin for key, (_, origin) in got.items() if key % 3 == 0}) > 50
    assert images.resample_failed(frame, failed, ["id"], on_fail="drop").count() == 200
    with pytest.raises(ValueError):
        images.resample_failed(frame, failed, ["id"], on_fail="fail")
    with pytest.raises(ValueError):
        images.resample_failed(frame, F.lit(True), ["id"])


def test_samples_are_written_by_root(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1), ("b", 2)], "root string, step int")
    exploration.write_samples(frame, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").where("root = 'b'").first()["step"] == 2


@pytest.fixture
def small_splits(spark, monkeypatch):
    """Documents are read in ranges that begin inside strings, escapes and characters; returns their number."""
    counts = []

    def cut_small(frame, purpose):
        if purpose != "fragments":
            return write_through(frame, purpose)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "211")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            counts.append(frame.rdd.getNumPartitions())
            return write_through(frame, purpose)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")

    monkeypatch.setattr(json_elements, "write_through", cut_small)
    return counts


ODD_TEXTS = ['}],"tasks":[{', "grüße } \\ \" {[", "\U0001f600}\U0001f600", '\\"}', "", "a\\\\"]


def same_tasks(spark, path):
    """Read whole and by many tasks; the number of tasks found."""
    columns = [c for c in exploration.load_tasks(spark, path).columns if c != "document"]
    whole = sorted(map(str, exploration.load_tasks(spark, path).select(columns).collect()))
    assert sorted(map(str, exploration.load_large_tasks(spark, path).select(columns).collect())) == whole
    return len(whole)


def test_large_documents_equal_whole_ones(spark, tmp_path, small_splits):
    tasks = [task(2, instruction=t, task_id=f"t{i}") for i, t in enumerate(ODD_TEXTS * 2)]
    doc = document(*tasks)
    later = {"note": ODD_TEXTS, "tasks": tasks, "extra": [{"a": 1}, {"b": [{}]}], "schema_version": 3, "generation_config": SETTINGS}
    write(tmp_path / "a" / "exploration_data.json", doc)
    write(tmp_path / "b+ c" / "exploration_data.json", later)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "exploration_data.json").write_text(json.dumps(doc, ensure_ascii=False) + " \n", encoding="utf-8")
    assert same_tasks(spark, f"{tmp_path}/*/exploration_data.json") == 3 * len(tasks)
    assert small_splits[0] > 50


ODD_DOCUMENTS = [
    json.dumps(document()),
    json.dumps(document(task())),
    json.dumps({"tasks": [task(1), None, 5, "x}", task(1, task_id="u"), [task(1)], task(1)]}),
    json.dumps({"schema_version": 2, "more": {"a": {"b": {}}, "c": {"d": 1}}, "tasks": [task(1), task(1)]}),
    json.dumps(document(task(1), task(1)))[:-40],
    json.dumps(document(task(1), task(1)))[:-1],
    json.dumps(document(task(1), task(1), task(1))).replace('"success": false', '"success": fal', 1),
    '{"tasks": [{"task_id": "1"}, {"task_id": "2"}], "tasks": [{"task_id": "3"}, {"task_id": "4"}]}',
    '["tasks", [{"task_id": "1"}, {"task_id": "2"}]]',
    '{"tasks": {"a": {"task_id": "1"}, "b": {"task_id": "2"}}}',
    '{"a}": "\\\\", "tasks": [{"task_id": "1\\\\\\""}, {"task_id": "}"}  ,\n {}, {"task_id": "{"}]}',
    "{}",
    "[]",
    "",
    "x",
    "}}}",
]


def test_odd_documents_are_read_as_whole_ones(spark, tmp_path, small_splits):
    for k, text in enumerate(ODD_DOCUMENTS):
        (tmp_path / f"r{k}").mkdir()
        (tmp_path / f"r{k}" / "exploration_data.json").write_text(text, encoding="utf-8")
    same_tasks(spark, f"{tmp_path}/*/exploration_data.json")


def test_large_conversation_lists_equal_whole_ones(spark, tmp_path, small_splits):
    items = [
        {"id": f"c{i}" if i % 3 else None, "video": "v" if i % 2 else None,
         "conversations": [{"from": "human", "value": t}, {"from": "gpt", "value": t[::-1]}]}
        for i, t in enumerate(ODD_TEXTS * 3)
    ]
    for name, text in {
        "many": json.dumps(items, indent=1), "flat": json.dumps(items, ensure_ascii=False) + "\n", "one": json.dumps(items[:1]),
        "none": "[]", "mixed": json.dumps([*items[:3], None, 7, *items[3:6]]), "cut": json.dumps(items)[:-9],
        "object": json.dumps({"a": items[0], "b": items[1]}), "empty": "",
    }.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    whole = conversation_source.load_conversations(spark, f"{tmp_path}/*.json")
    large = conversation_source.load_large_conversations(spark, f"{tmp_path}/*.json")
    assert large.columns == whole.columns
    assert sorted(map(str, large.collect())) == sorted(map(str, whole.collect()))


def test_violations_name_the_task_without_a_join(spark, tmp_path):
    write(tmp_path / "r0" / "exploration_data.json", document(task(), task(actions=["x", 1, 1], task_id="odd")))
    tasks = exploration.load_tasks(spark, f"{tmp_path}/r0/exploration_data.json")
    found = validate.violations(tasks, [23], ["task_id"])
    assert [(r["task_idx"], r["task_id"], r["rule"], r["detail"]) for r in found.collect()] == [(1, "odd", "unreadable_field", "actions")]


def test_corrupt_documents_are_parsed_once(spark):
    """One scan lists the unreadable documents, one the unreadable fields; nothing is joined."""
    plan = QUERIES["S1_corrupt_documents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation [") == 2
