"""Nearest node, tracking and map nodes against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trailframe.operators import graph
from trailframe.operators.blocks import rank_rows
from trailframe.operators.skew import salted_join
from trailframe.streaming.nodes import track_stream


def random_graph(seed=1, scenes=3, size=60):
    rng = random.Random(seed)
    nodes, edges = [], []
    for s in range(scenes):
        spread = 10 ** rng.randrange(-3, 2)
        for i in range(size):
            # A tight cluster, a wide field and repeated places.
            scale = spread * (0.001 if i % 3 == 0 else 1)
            x, z = float(rng.randrange(10) * scale), float(rng.randrange(10) * scale)
            nodes.append((f"s{s}", f"n{s}-{i:03d}", s * size + i, x, float(rng.randrange(4)), z))
            for j in {rng.randrange(size) for _ in range(2)} - {i}:
                edges.append((f"s{s}", f"n{s}-{i:03d}", f"n{s}-{j:03d}", len(edges)))
    return nodes, edges


NODES = "scene_id string, node_id string, node_order bigint, x double, y double, z double"
MAPS = "map_id string, low_x double, low_z double, high_x double, high_z double, n_rows int, n_cols int, metres_per_cell double"
EDGES = "scene_id string, src string, dst string, edge_order bigint"
STEPS = "episode_id bigint, scene_id string, step int, x double, z double"


@pytest.fixture(scope="module")
def built(spark):
    nodes, edges = random_graph()
    return nodes, edges, spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


@pytest.mark.parametrize("leaf_nodes", [256, 8, 1])
def test_nearest_node(spark, built, leaf_nodes):
    nodes, _, node_frame, _ = built
    rng = random.Random(2)
    points = [(i, f"s{i % 3}", rng.uniform(-20, 120) * 10 ** rng.randrange(-3, 1), rng.uniform(-1, 10)) for i in range(150)]
    points += [(1000 + i, n[0], n[3], n[5]) for i, n in enumerate(nodes)]
    frame = spark.createDataFrame(points, "id bigint, scene_id string, x double, z double")
    got = graph.nearest_node(frame, node_frame, ["id"], leaf_nodes).collect()
    wanted = {}
    for i, scene, x, z in points:
        ranked = [(math.sqrt((n[3] - x) ** 2 + (n[5] - z) ** 2), n[2], n[1]) for n in nodes if n[0] == scene]
        wanted[i] = min(ranked)[2]
    assert {r["id"]: r["node_id"] for r in got} == wanted and len(got) == len(points)


def walks(seed=3, episodes=8, length=30):
    rng = random.Random(seed)
    return [
        (e, f"s{e % 3}", t, rng.uniform(0, 90), rng.uniform(0, 90)) for e in range(episodes) for t in range(length)
    ]


def tracked(nodes, edges, steps, starts):
    place = {n[1]: (n[3], n[5]) for n in nodes}
    near = {n[1]: [n[1]] for n in nodes}
    for _, a, b, _ in edges:
        near[a].append(b)
        near[b].append(a)
    now, out = dict(starts), {}
    for e, _, t, x, z in sorted(steps, key=lambda s: (s[0], s[2])):
        now[e] = min(near[now[e]], key=lambda n: math.sqrt((place[n][0] - x) ** 2 + (place[n][1] - z) ** 2))
        out[e, t] = now[e]
    return out


def tracked_or_none(nodes, edges, steps, starts):
    """As ``tracked``, with no node for episodes without a start on their scene."""
    known = {n[1] for n in nodes}
    fine = {e: n for e, n in starts if n in known}
    found = tracked(nodes, edges, [s for s in steps if s[0] in fine], fine)
    return {(s[0], s[2]): found.get((s[0], s[2])) for s in steps}


@pytest.mark.parametrize("block_rows", [16_384, 7, 2, 1])
@pytest.mark.parametrize("gaps", [False, True])
def test_track_nearest_node(spark, built, block_rows, gaps):
    nodes, edges, node_frame, edge_frame = built
    steps, starts = walks(), [(e, f"n{e % 3}-{e:03d}") for e in range(8)]
    if gaps:
        # Late starts, single missing steps and whole missing blocks; an unknown start and a missing one.
        steps = [s for s in steps if not (s[2] < s[0] or 9 <= s[2] <= 20 or s[2] % 7 == 5)]
        starts = [(e, "n0-0005" if e == 3 else n) for e, n in starts if e != 6]
    got = graph.track_nearest_node(
        spark.createDataFrame(steps, STEPS), node_frame, edge_frame,
        spark.createDataFrame(starts, "episode_id bigint, node_id string"), block_rows,
    ).collect()
    assert len(got) == len(steps)
    assert {(r["episode_id"], r["step"]): r["node_id"] for r in got} == tracked_or_none(nodes, edges, steps, starts)


def test_tracking_in_portions(spark, built, monkeypatch):
    """The walks on a tile are dealt to several tasks."""
    monkeypatch.setattr(graph, "WALK_ROWS", 50)
    nodes, edges, node_frame, edge_frame = built
    steps, starts = walks(), [(e, f"n{e % 3}-{e:03d}") for e in range(8)]
    got = graph.track_nearest_node(
        spark.createDataFrame(steps, STEPS), node_frame, edge_frame,
        spark.createDataFrame(starts, "episode_id bigint, node_id string"),
    ).collect()
    assert {(r["episode_id"], r["step"]): r["node_id"] for r in got} == tracked(nodes, edges, steps, starts)
    assert len(got) == len(steps)


def test_walks_seldom_change_tiles(spark, monkeypatch):
    """Nodes whose order, but not whose place, follows the edges."""
    written, write = [], graph.write_through
    monkeypatch.setattr(graph, "write_through", lambda frame, purpose: (written.append(purpose), write(frame, purpose))[1])
    rng = random.Random(7)
    nodes = [("s0", f"n{i:03d}", i, rng.uniform(0, 90), 0.0, rng.uniform(0, 90)) for i in range(64)]
    edges = [("s0", f"n{i:03d}", f"n{i + by:03d}", 2 * i + by) for i in range(64) for by in (1, 3) if i + by < 64]
    steps = [(e, "s0", t, rng.uniform(0, 90), rng.uniform(0, 90)) for e in range(6) for t in range(20)]
    starts = [(e, f"n{10 * e:03d}") for e in range(6)]
    got = graph.track_nearest_node(
        spark.createDataFrame(steps, STEPS), spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES),
        spark.createDataFrame(starts, "episode_id bigint, node_id string"), tile_nodes=8,
    ).collect()
    assert {(r["episode_id"], r["step"]): r["node_id"] for r in got} == tracked(nodes, edges, steps, starts)
    assert written.count("walked") <= 2


@pytest.mark.parametrize("tile_nodes, block_rows", [(5, 16_384), (1, 16_384), (20, 10)])
def test_tracking_over_tiles(spark, built, tile_nodes, block_rows):
    """Scenes larger than a tile; one hub whose options no tile takes in as a neighbour's."""
    nodes, edges, node_frame, _ = built
    hub = [("s0", "n0-000", f"n0-{i:03d}", 1000 + i) for i in range(1, 60)]
    lonely = [("s1", "n1-alone", 9999, 5.0, 0.0, 5.0), ("s1", "n1-nowhere", 10_000, None, 0.0, float("nan"))]
    steps = [*walks(episodes=9, length=40), (9, "s1", 0, 1.0, 1.0), (9, "s1", 1, 2.0, 2.0)]
    starts = [(e, f"n{e % 3}-{e:03d}") for e in range(9)] + [(9, "n1-alone")]
    more = spark.createDataFrame(lonely, NODES)
    got = graph.track_nearest_node(
        spark.createDataFrame(steps, STEPS), node_frame.unionByName(more), spark.createDataFrame(edges + hub, EDGES),
        spark.createDataFrame(starts, "episode_id bigint, node_id string"), block_rows, tile_nodes,
    ).collect()
    assert len(got) == len(steps)
    wanted = tracked(nodes + lonely[:1], edges + hub, steps, starts)
    assert {(r["episode_id"], r["step"]): r["node_id"] for r in got} == wanted


def test_no_tile_holds_a_scene(spark, built):
    _, _, node_frame, edge_frame = built
    owners, tiles = graph.graph_tiles(node_frame, edge_frame, 8)
    assert owners.count() == 180 and owners.groupBy("scene_id", "tile").count().agg({"count": "max"}).first()[0] <= 8
    assert tiles.count() >= 3 * 8
    assert tiles.select(F.max(F.size(F.array_distinct("node_ids")))).first()[0] < 60


def test_ranks_of_large_groups_and_ties(spark):
    """One group holds all rows but a few; ranks are those of a sort, made in several tasks."""
    rng = random.Random(9)
    rows = [("big", rng.choice([0.0, 1e300, -5.0, rng.random()]), i) for i in range(4000)] + [(f"g{i % 5}", 1.0, i) for i in range(20)]
    rows += [("nulls", None, 1), ("nulls", 2.0, 0), (None, 1.0, 0), (None, 0.5, 1)]
    frame = spark.createDataFrame(rows, "g string, v double, i int")
    ranked = rank_rows(frame, ["g"], ["v", "i"], "rank")
    wanted = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
        wanted |= {r: k for k, r in enumerate(mine)}
    assert {(r["g"], r["v"], r["i"]): r["rank"] for r in ranked.collect()} == wanted
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan  # the sorted ranges have been written


@pytest.mark.parametrize("leaf_nodes", [256, 4])
def test_points_and_nodes_without_coordinates(spark, built, leaf_nodes):
    nodes, _, _, _ = built
    flawed = [(*n[:3], None if n[2] % 3 == 0 else n[3], n[4], float("nan") if n[2] % 5 == 0 else n[5]) for n in nodes]
    points = [(1, "s0", 1.0, 1.0), (2, "nowhere", 1.0, 1.0), (3, "s1", None, 1.0), (4, "s1", float("nan"), 1.0)]
    got = graph.nearest_node(
        spark.createDataFrame(points, "id bigint, scene_id string, x double, z double"),
        spark.createDataFrame(flawed, NODES), ["id"], leaf_nodes,
    ).collect()
    good = [n for n in nodes if n[0] == "s0" and n[2] % 3 and n[2] % 5]
    nearest = min((math.hypot(n[3] - 1, n[5] - 1), n[2], n[1]) for n in good)
    assert {r["id"]: r["node_id"] for r in got} == {1: nearest[2], 2: None, 3: None, 4: None}


def test_tracking_a_stream_equals_the_batch(spark, built, tmp_path):
    nodes, edges, node_frame, edge_frame = built
    steps = walks(length=9)
    starts = [(e, f"n{e % 3}-{e:03d}") for e in range(8)]
    frame = spark.createDataFrame(steps, STEPS)
    for part in range(3):
        frame.where((F.col("step") / 3).cast("int") == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = track_stream(
        source, node_frame, edge_frame, spark.createDataFrame(starts, "episode_id bigint, node_id string"), str(tmp_path)
    )
    query.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/rows").collect()
    assert {(r["episode_id"], r["step"]): r["node_id"] for r in got} == tracked(nodes, edges, steps, starts)


def test_drawn_squares_make_later_nodes_visible(spark):
    """b stands on an invalid cell that a's square covers; c comes before a."""
    nodes = [("s", "c", 0, 11.0, 0.0, 10.0), ("s", "a", 1, 10.0, 0.0, 10.0), ("s", "b", 2, 12.0, 0.0, 10.0),
             ("s", "far", 3, 30.0, 0.0, 10.0), ("s", "above", 4, 10.0, 1.0, 12.0)]
    starts = spark.createDataFrame([("m", "s", 10.0, 10.0)], "map_id string, scene_id string, x double, z double")
    maps = spark.createDataFrame([("m", 0.0, 0.0, 64.0, 64.0, 64, 64, 0.125)], MAPS)
    cells = spark.createDataFrame([("m", 10, 10, 1), ("m", 12, 10, 1)], "map_id string, row int, col int, code int")
    got = graph.same_floor_nodes(starts, spark.createDataFrame(nodes, NODES), cells, maps).collect()
    square = lambda r, c: {(i, j) for i in range(r - 2, r + 3) for j in range(c - 2, c + 3)}
    assert {(r["row"], r["col"]) for r in got} == square(10, 10) | square(10, 12)
    assert {r["code"] for r in got} == {7}


def drawn_cells(nodes, valid, half, size):
    """Cells of the squares of ``(order, row, col)``, drawn one after the other."""
    cells, open_cells = set(), set(valid)
    for _, row, col in sorted(nodes):
        if (row, col) in open_cells:
            square = {(r, c) for r in range(row - half, row + half + 1) for c in range(col - half, col + half + 1)}
            square = {(r, c) for r, c in square if 0 <= r < size and 0 <= c < size}
            cells |= square
            open_cells |= square
    return cells


@pytest.mark.parametrize("tile_cells", [7, 64, 1024])
def test_nodes_are_drawn_in_order_over_tiles(spark, tile_cells):
    rng = random.Random(5)
    size = 48
    maps, nodes, valid, starts, wanted = [], [], [], [], {}
    for m in ("m1", "m2", "m3"):
        places = [(k, rng.randrange(size), rng.randrange(size)) for k in range(300)]
        first = {places[k][1:] for k in range(0, 300, 60)}
        nodes += [(m, f"{m}-{k}", k, c + 0.5, 0.0, r + 0.5) for k, r, c in places]
        maps.append((m, 0.0, 0.0, float(size), float(size), size, size, 0.125))
        starts.append((m, m, 10.0, 10.0))
        valid += [(m, r, c, 1) for r, c in first]
        wanted[m] = drawn_cells(places, first, 2, size)
    got = graph.same_floor_nodes(
        spark.createDataFrame(starts, "map_id string, scene_id string, x double, z double"),
        spark.createDataFrame(nodes, NODES),
        spark.createDataFrame(valid, "map_id string, row int, col int, code int"),
        spark.createDataFrame(maps, MAPS),
        tile_cells=tile_cells,
    ).collect()
    assert {m: {(r["row"], r["col"]) for r in got if r["map_id"] == m} for m in wanted} == wanted


def test_a_chain_of_nodes_takes_few_rounds(spark, monkeypatch):
    """2,000 nodes, each visible only by the square of the one before."""
    rounds = []
    spread = graph._covers
    monkeypatch.setattr(graph, "_covers", lambda *a: rounds.append(1) or spread(*a))
    size = 4100
    places = [(k, 10, 10 + 2 * k) for k in range(2000)]
    nodes = [("m", f"n{k}", k, c + 0.5, 0.0, r + 0.5) for k, r, c in places]
    got = graph.same_floor_nodes(
        spark.createDataFrame([("m", "m", 10.0, 10.0)], "map_id string, scene_id string, x double, z double"),
        spark.createDataFrame(nodes, NODES),
        spark.createDataFrame([("m", 10, 10, 1)], "map_id string, row int, col int, code int"),
        spark.createDataFrame([("m", 0.0, 0.0, float(size), float(size), size, size, 0.125)], MAPS),
    ).collect()
    assert {(r["row"], r["col"]) for r in got} == drawn_cells(places, {(10, 10)}, 2, size)
    assert len(rounds) <= 8


def test_salted_join_splits_hot_keys(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") < 600, 0).otherwise(F.col("id") % 7).alias("k"))
    right = spark.range(5).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left"):
        got = salted_join(left, right, ["k"], ["id"], 1000, how, min_hot_rows=50).select("id", "k", "v")
        plain = left.join(right, "k", how).select("id", "k", "v")
        assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()


def test_short_episodes_walk_each_row_once(spark, built, monkeypatch):
    """Four blocks: no start of a block is sought, and each round walks one block of an episode."""
    written, write = [], graph.write_through

    def noted(frame, purpose):
        written.append((purpose, write(frame, purpose)))
        return written[-1][1]

    monkeypatch.setattr(graph, "write_through", noted)
    nodes, edges, node_frame, edge_frame = built
    steps = [s for s in walks() if s[0] or s[2] < 3]
    starts = [(e, f"n{e % 3}-{e:03d}") for e in range(7)]
    got = graph.track_nearest_node(
        spark.createDataFrame(steps, STEPS), node_frame, edge_frame,
        spark.createDataFrame(starts, "episode_id bigint, node_id string"), 8,
    ).collect()
    assert len(got) == len(steps)
    assert {(r["episode_id"], r["step"]): r["node_id"] for r in got} == tracked_or_none(nodes, edges, steps, starts)
    assert "guesses" not in [purpose for purpose, _ in written]
    walked = [frame.where("kind = 0").count() for purpose, frame in written if purpose == "walked"]
    assert walked == [3 + 6 * 8, 6 * 8, 6 * 8, 6 * 6]


def test_chained_and_long_episodes(spark, built):
    """Episodes of 1 to 5 blocks: those of up to 3 are chained, the others' starts are sought."""
    nodes, edges, node_frame, edge_frame = built
    steps = [s for s in walks() if s[2] < 4 * (s[0] + 1)]
    starts = [(e, "n0-0005" if e == 3 else f"n{e % 3}-{e:03d}") for e in range(8) if e != 6]
    got = graph.track_nearest_node(
        spark.createDataFrame(steps, STEPS), node_frame, edge_frame,
        spark.createDataFrame(starts, "episode_id bigint, node_id string"), 7, 20, 3,
    ).collect()
    assert len(got) == len(steps)
    assert {(r["episode_id"], r["step"]): r["node_id"] for r in got} == tracked_or_none(nodes, edges, steps, starts)
