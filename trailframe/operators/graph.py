"""Waypoint graphs: nearest node, tracked node, nodes on the start's floor.

Tables: ``nodes(scene_id, node_id, node_order, x, y, z)``, where ``node_order``
is the insertion order that decides ties, and undirected
``edges(scene_id, src, dst, edge_order)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trailframe.functions.geometry import euclidean
from trailframe.operators.blocks import BLOCK, rank_rows, with_block
from trailframe.operators.raster import (
    INVALID,
    NODE_WAYPOINT,
    POINT_PADDING,
    stamp_square,
    to_grid,
)
from trailframe.operators.skew import marked_by_bitmap, salted_join
from trailframe.session import remove_at_exit, shared_folder, write_through

LEAF_NODES = 256
# Cells along a side of a map's tile.
TILE_CELLS = 1024
_TILE_KEYS = ["map_id", "tile_row", "tile_col"]
# Each level splits a square into 4 x 4; 13 levels give 2**26 cells per axis.
MAX_LEVEL = 13


def _cell(value: Column, level: int) -> Column:
    return F.shiftright(value, 2 * (MAX_LEVEL - level))


def _placed(nodes: DataFrame) -> DataFrame:
    """Finest-level cell of each node, by its rank along either axis.

    Ranks fill the cells evenly however the coordinates are spread, so that one
    far outlier does not press all other nodes into one cell.
    """
    sizes = nodes.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n"))
    # A scene of any size is ranked by many tasks.
    ranked = rank_rows(nodes, ["scene_id"], ["x", "node_order"], "_rx")
    ranked = rank_rows(ranked, ["scene_id"], ["z", "node_order"], "_rz")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    sized = salted_join(ranked, sizes, ["scene_id"], ["x", "z"], total)
    cell = lambda rank: F.floor(F.col(rank) / F.col("_n") * F.lit(float(4**MAX_LEVEL))).cast("bigint")
    return sized.withColumns({"_qx": cell("_rx"), "_qz": cell("_rz")}).drop("_rx", "_rz", "_n")


def _is_place(x: str = "x", z: str = "z") -> Column:
    """Both coordinates are numbers."""
    return ~(F.col(x).isNull() | F.col(z).isNull() | F.isnan(x) | F.isnan(z))


def _first_at_each_place(nodes: DataFrame) -> DataFrame:
    """Of the nodes at one place, only the first can be an answer; nodes without a place cannot."""
    return nodes.where(_is_place()).groupBy("scene_id", "x", "z").agg(
        F.min_by("node_id", "node_order").alias("node_id"), F.min("node_order").alias("node_order")
    )


def _nearest_of(nodes: str) -> Column:
    """``struct(distance, node_order, node_id)`` of the nearest listed node."""
    return F.array_min(
        F.transform(
            nodes,
            lambda n: F.struct(
                euclidean([F.col("x"), F.col("z")], [n["x"], n["z"]]).alias("distance"),
                n["node_order"].alias("node_order"),
                n["node_id"].alias("node_id"),
            ),
        )
    )


def _answer(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The hits; a point without a place has none."""
    here = _is_place()
    return found.select(
        *keys,
        F.when(here, F.col("hit.node_id")).alias("node_id"),
        F.when(here, F.col("hit.distance")).alias("distance"),
    )


def _node_tree(distinct: DataFrame, leaf_nodes: int) -> tuple[DataFrame, DataFrame, int]:
    """Squares that hold nodes, leaf squares with their nodes, and the depth.

    A square with more than ``leaf_nodes`` nodes is split further, so a leaf's
    node list is short.
    """
    placed = write_through(_placed(distinct), "nodes")
    levels = F.transform(
        F.sequence(F.lit(0), F.lit(MAX_LEVEL)),
        lambda level: F.struct(
            level.alias("level"),
            F.floor(F.col("_qx") / F.pow(F.lit(4.0), MAX_LEVEL - level)).alias("cx"),
            F.floor(F.col("_qz") / F.pow(F.lit(4.0), MAX_LEVEL - level)).alias("cz"),
        ),
    )
    squares = (
        placed.select("scene_id", "x", "z", F.inline(levels))
        .groupBy("scene_id", "level", "cx", "cz")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("x").alias("x1"),
            F.max("x").alias("x2"),
            F.min("z").alias("z1"),
            F.max("z").alias("z2"),
        )
        .withColumn("is_leaf", (F.col("n") <= leaf_nodes) | (F.col("level") == MAX_LEVEL))
    )
    # Keep a square when its parent was split, or when it is the root.
    split = squares.where("not is_leaf").select(
        "scene_id",
        (F.col("level") + 1).alias("level"),
        F.col("cx").alias("px"),
        F.col("cz").alias("pz"),
    )
    with_parent = squares.withColumns({"px": F.shiftright("cx", 2), "pz": F.shiftright("cz", 2)})
    kept = with_parent.join(split, ["scene_id", "level", "px", "pz"], "left_semi").unionByName(
        with_parent.where("level = 0")
    )
    tree = write_through(kept, "squares")
    depth = tree.agg(F.max("level")).first()[0] or 0
    leaves = tree.where("is_leaf").select("scene_id", "level", "cx", "cz")
    entry = F.struct("x", "z", "node_order", "node_id")
    members = None
    for level in range(depth + 1):
        at_level = placed.select(
            "scene_id",
            F.lit(level).alias("level"),
            _cell(F.col("_qx"), level).alias("cx"),
            _cell(F.col("_qz"), level).alias("cz"),
            entry.alias("node"),
        )
        members = at_level if members is None else members.unionByName(at_level)
    listed = (
        members.join(leaves, ["scene_id", "level", "cx", "cz"], "left_semi")
        .groupBy("scene_id", "level", "cx", "cz")
        .agg(F.collect_list("node").alias("nodes"))
    )
    return tree, listed, depth


def nearest_node(
    points: DataFrame,
    nodes: DataFrame,
    keys: Sequence[str],
    leaf_nodes: int = LEAF_NODES,
) -> DataFrame:
    """``(keys, node_id, distance)``: the node nearest to each point in (x, z).

    Ties go to the first node.  Nodes whose coordinates are null or NaN are no
    candidates.  Every point is answered; without coordinates, or in a scene
    without nodes, its node is null.  Exact for any number of nodes per scene: points
    descend a tree of squares, and at each level drop the squares that lie
    farther off than the farthest corner of another one.  Scenes of up to
    ``leaf_nodes`` nodes are a single leaf and need one join.
    """
    keys = list(keys)
    base = points.select(*keys, "scene_id", "x", "z")
    total = base.count()
    square = ["scene_id", "level", "cx", "cz"]
    distinct = _first_at_each_place(nodes)
    crowd = distinct.groupBy("scene_id").count().agg(F.max("count")).first()[0] or 0
    if crowd <= leaf_nodes:
        leaves = distinct.groupBy("scene_id").agg(F.collect_list(F.struct("x", "z", "node_order", "node_id")).alias("nodes"))
        listed = salted_join(base, leaves, ["scene_id"], keys, total, "left")
        return _answer(listed.select(*keys, "x", "z", _nearest_of("nodes").alias("hit")), keys)
    tree, leaves, depth = _node_tree(distinct, leaf_nodes)
    root = tree.where("level = 0").select("scene_id", "is_leaf")
    # Points are tried only where there is something to compare.
    tried = base.where(_is_place())
    live = salted_join(tried, root, ["scene_id"], keys, total).select(
        "*", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("cx"), F.lit(0).cast("bigint").alias("cz")
    )
    for level in range(1, depth + 1):
        children = (
            tree.where(F.col("level") == level)
            .groupBy("scene_id", "px", "pz")
            .agg(F.collect_list(F.struct("level", "cx", "cz", "is_leaf", "x1", "x2", "z1", "z2")).alias("_kids"))
            .withColumnsRenamed({"px": "cx", "pz": "cz"})
        )
        open_squares = live.where("not is_leaf").drop("level", "is_leaf")
        opened = salted_join(open_squares, children, ["scene_id", "cx", "cz"], keys, total).drop("cx", "cz")
        reached = opened.select(*keys, "scene_id", "x", "z", F.inline("_kids"))
        gap_x = F.greatest(F.col("x1") - F.col("x"), F.col("x") - F.col("x2"), F.lit(0.0))
        gap_z = F.greatest(F.col("z1") - F.col("z"), F.col("z") - F.col("z2"), F.lit(0.0))
        far_x = F.greatest(F.abs(F.col("x") - F.col("x1")), F.abs(F.col("x") - F.col("x2")))
        far_z = F.greatest(F.abs(F.col("z") - F.col("z1")), F.abs(F.col("z") - F.col("z2")))
        measured = reached.select(
            *keys,
            "scene_id",
            "x",
            "z",
            F.struct(
                "level",
                "cx",
                "cz",
                "is_leaf",
                F.sqrt(gap_x * gap_x + gap_z * gap_z).alias("at_least"),
            ).alias("_square"),
            F.sqrt(far_x * far_x + far_z * far_z).alias("_at_most"),
        )
        waiting = live.where("is_leaf").select(
            *keys,
            "scene_id",
            "x",
            "z",
            F.struct("level", "cx", "cz", "is_leaf", F.lit(0.0).alias("at_least")).alias("_square"),
            F.lit(float("inf")).alias("_at_most"),
        )
        # A point's squares number a few; the bound is widened by the rounding
        # of the two distances.
        best = measured.unionByName(waiting).groupBy(*keys, "scene_id", "x", "z").agg(
            F.collect_list("_square").alias("_squares"), F.min("_at_most").alias("_bound")
        )
        bound = F.col("_bound") * F.lit(1.0 + 1e-12)
        live = best.select(
            *keys, "scene_id", "x", "z", F.inline(F.filter("_squares", lambda s: s["at_least"] <= bound))
        ).drop("at_least")
        # Both uses in the next level read the written rows; the plan stays as short.
        live = write_through(live, "descent")
        total = max(total, live.count())
    listed = salted_join(live.drop("is_leaf"), leaves, square, keys, total)
    found = listed.select(*keys, _nearest_of("nodes").alias("hit")).groupBy(*keys).agg(F.min("hit").alias("hit"))
    return _answer(base.select(*keys, "x", "z").join(found, keys, "left"), keys)


# -- tracking ---------------------------------------------------------------


def neighbourhoods(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Where one step may lead: ``(scene_id, node_id, rank, to_id, x, z)``.

    The node itself has rank 0; its neighbours follow in edge order.
    """
    both = edges.select("scene_id", F.col("src").alias("node_id"), F.col("dst").alias("to_id"), "edge_order").unionByName(
        edges.select("scene_id", F.col("dst").alias("node_id"), F.col("src").alias("to_id"), "edge_order")
    )
    ranked = both.select("scene_id", "node_id", (F.col("edge_order") + 1).alias("rank"), "to_id").unionByName(
        nodes.select("scene_id", "node_id", F.lit(0).cast("bigint").alias("rank"), F.col("node_id").alias("to_id"))
    )
    far = F.lit(float("inf"))
    # A node without coordinates is never nearest.
    place = lambda axis: F.coalesce(F.nanvl(F.col(axis).cast("double"), far), far).alias(axis)
    where = nodes.select("scene_id", F.col("node_id").alias("to_id"), place("x"), place("z"))
    return ranked.join(where, ["scene_id", "to_id"])


class _Tile:
    """A tile's neighbourhoods in ragged arrays: each owned node's options in a row, self first."""

    def __init__(self, head: pa.Table):
        nodes, self.to_names, xs, zs = (
            head.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in _GRAPH
        )
        first = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
        self.names = nodes[first]
        self.begin, self.size = first, np.diff(np.r_[first, len(nodes)])
        place = np.minimum(np.searchsorted(self.names, self.to_names), len(self.names) - 1)
        # Options that the tile does not own lead to another tile.
        self.to = np.where(self.names[place] == self.to_names, place, -1)
        self.x, self.z = xs.astype(float), zs.astype(float)

    def move(self, here: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
        """The option that one step takes from each of the nodes ``here``; ties go to the first."""
        size = self.size[here]
        starts = np.cumsum(size) - size
        option = np.repeat(self.begin[here] - starts, size) + np.arange(size.sum())
        dx, dz = self.x[option] - np.repeat(x, size), self.z[option] - np.repeat(z, size)
        distance = np.sqrt(dx * dx + dz * dz)
        distance[np.isnan(distance)] = np.inf
        nearest = distance == np.repeat(np.minimum.reduceat(distance, starts), size)
        hits = np.flatnonzero(nearest)
        return option[hits[np.searchsorted(hits, starts)]]

    def walk(self, starts: np.ndarray, at: np.ndarray, end: np.ndarray, xs: np.ndarray, zs: np.ndarray, keep_steps: bool):
        """Walks from the nodes ``starts`` over the positions ``at`` to ``end``, all at once, until these end or the tile is left.

        Gives the place that each walk goes on from, the last option it took (-1: none), and
        for ``keep_steps`` the walks, positions and options of all steps.
        """
        here, at, last = np.searchsorted(self.names, starts), at.copy(), np.full(len(at), -1)
        going, kept = np.flatnonzero(at < end), []
        while len(going):
            option = self.move(here[going], xs[at[going]], zs[at[going]])
            if keep_steps:
                kept.append((going, at[going], option))
            last[going], here[going] = option, self.to[option]
            at[going] += 1
            going = going[(here[going] >= 0) & (at[going] < end[going])]
        return at, last, [np.concatenate(parts) for parts in zip(*kept)]


TRACK_BLOCK_ROWS = 16_384
#: An episode of up to so many blocks is walked block after block; the starts of a longer one's blocks are sought first.
CHAINED_BLOCKS = 16
#: Nodes per tile; a tile travels as one row with the options of its nodes.
TILE_NODES = 16_384
#: Neighbours with up to so many options are part of a tile too, so that walks along an edge seldom change tiles.
HALO_OPTIONS = 16
#: So many layers of neighbours, the second and later ones while the tile has fewer than HALO_NODES nodes.
HALO_LAYERS = 12
HALO_NODES = 256
#: Rows of walks per task; a tile is repeated for each portion of its walks.
WALK_ROWS = 262_144
_PLACE = "_place"
_GRAPH = ("node_ids", "to_ids", "xs", "zs")
# What a walk gives: the node after a step, a change of tile, the end of a block.
_STEP, _HOP, _END = 0, 1, 2


def graph_tiles(nodes: DataFrame, edges: DataFrame, tile_nodes: int = TILE_NODES) -> tuple[DataFrame, DataFrame]:
    """``owners(scene_id, node_id, tile)`` and ``tiles(scene_id, tile, node_ids, to_ids, xs, zs)``.

    No tile has more than ``tile_nodes`` nodes of its own.  A scene is cut either by place,
    into strips by the rank along x and strips into tiles by the rank along z, or by
    the order of its nodes: whichever cuts fewer of its edges.  A tile holds the options
    of its nodes and of layers of neighbours around them, as far as these have few.
    """
    sizes = nodes.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n"))
    crowd = sizes.agg(F.max("_n"), F.sum("_n")).first()
    options = write_through(neighbourhoods(nodes, edges), "options")
    if (crowd[0] or 0) <= tile_nodes:
        # A scene's neighbours are all its own.
        members = owners = nodes.select("scene_id", "node_id", F.lit(0).cast("bigint").alias("tile"))
    else:
        ranked = rank_rows(nodes, ["scene_id"], ["x", "node_order"], "_rx")
        ranked = rank_rows(ranked, ["scene_id"], ["node_order"], "_ro")
        sized = salted_join(ranked, sizes, ["scene_id"], ["node_id"], crowd[1])
        strips = F.ceil(F.sqrt(F.col("_n") / tile_nodes))
        cut = sized.withColumn("_strip", F.floor(F.col("_rx") * strips / F.col("_n")))
        ranked = rank_rows(cut, ["scene_id", "_strip"], ["z", "node_order"], "_rz")
        by_place = F.shiftleft(F.col("_strip").cast("bigint"), 32) + F.floor(F.col("_rz") / tile_nodes)
        by_order = F.floor(F.col("_ro") / tile_nodes)
        cuts = write_through(ranked.select("scene_id", "node_id", by_place.alias("_place"), by_order.alias("_order")), "cuts")
        owners = write_through(_fewer_cut(cuts, options, crowd[1]), "tile-owners")
        members = _with_halo(owners, options, tile_nodes)
    listed = F.array_sort(F.collect_list(F.struct("node_id", "rank", "to_id", "x", "z")))
    tiles = (
        members.join(options, ["scene_id", "node_id"])
        .groupBy("scene_id", "tile")
        .agg(listed.alias("_o"))
        .select("scene_id", "tile", *[F.col(f"_o.{c}").alias(a) for c, a in zip(("node_id", "to_id", "x", "z"), _GRAPH)])
    )
    return owners, write_through(tiles, "tiles")


def _fewer_cut(cuts: DataFrame, options: DataFrame, n_nodes: int) -> DataFrame:
    """``(scene_id, node_id, tile)``, by that of a scene's two cuts that fewer options cross."""
    far = cuts.withColumnsRenamed({"node_id": "to_id", "_place": "_to_place", "_order": "_to_order"})
    both = options.select("scene_id", "node_id", "to_id").join(cuts, ["scene_id", "node_id"]).join(far, ["scene_id", "to_id"])
    crossed = lambda name: F.count_if(F.col(f"_{name}") != F.col(f"_to_{name}"))
    choice = both.groupBy("scene_id").agg((crossed("order") < crossed("place")).alias("_in_order"))
    tile = F.when(F.col("_in_order"), F.col("_order")).otherwise(F.col("_place"))
    return salted_join(cuts, choice, ["scene_id"], ["node_id"], n_nodes, "left").select("scene_id", "node_id", tile.alias("tile"))


def _with_halo(owners: DataFrame, options: DataFrame, tile_nodes: int) -> DataFrame:
    """The tiles' own nodes and layers of neighbours around them, as far as these have few options."""
    key = ["scene_id", "node_id"]
    degree = options.groupBy(*key).agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") <= HALO_OPTIONS)
    small = write_through(options.join(degree.select(*key), key, "left_semi").select(*key, "to_id"), "small")
    most = max(HALO_NODES, tile_nodes + tile_nodes // 4)
    members = layer = owners
    for _ in range(HALO_LAYERS):
        reached = layer.join(small, key).select("scene_id", F.col("to_id").alias("node_id"), "tile").distinct()
        reached = reached.join(small.select(*key).distinct(), key, "left_semi")
        layer = write_through(reached.join(members, [*key, "tile"], "left_anti"), "layer")
        if layer.isEmpty():
            break
        members = members.unionByName(layer)
        roomy = members.groupBy("scene_id", "tile").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < most)
        layer = layer.join(roomy.select("scene_id", "tile"), ["scene_id", "tile"], "left_semi")
    return members


def track_nearest_node(
    steps: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    starts: DataFrame,
    block_rows: int = TRACK_BLOCK_ROWS,
    tile_nodes: int = TILE_NODES,
    chained_blocks: int = CHAINED_BLOCKS,
) -> DataFrame:
    """``(episode_id, step, node_id)``: the node carried from step to step.

    Each step moves to the nearest of the current node and its neighbours; a
    step without coordinates stays.  ``starts(episode_id, node_id)`` gives the
    node before the first row; ``steps`` has ``episode_id, scene_id, step, x,
    z``.  Every row is answered; the node is null where the episode has no
    start or its start is no node of the scene.

    The recurrence is run per block of an episode and tile of a graph: a walk
    goes on until the block ends or the tile is left, and is then handed to
    the tile that owns its node.  In an episode of up to ``chained_blocks`` blocks a walk that
    has ended a block goes on in the next one, so that each row is walked once.  In a longer episode, every block but the
    last is first run from the nodes where it may start: the node nearest to
    where the block before it ends, the episode's first node, and wherever a run
    of the block before it has led.  Such sets close after as many rounds as walks
    need to meet, since walks that meet stay together.  The blocks' true start
    nodes follow by pointer doubling.  Blocks are chained in the order of
    those that have rows, so steps may be missing, also many in a row.  Rows go
    to the tiles, in portions: a task holds one tile, 40 bytes per option, and some
    ``WALK_ROWS`` rows.
    """
    owners, tiles = graph_tiles(nodes, edges, tile_nodes)
    rows = with_block(steps, "step", block_rows).select("episode_id", BLOCK, "scene_id", "step", "x", "z")
    # One row per block with rows; its place counts only such blocks.
    order = Window.partitionBy("episode_id").orderBy(BLOCK)
    here = F.when(_is_place(), F.struct("step", "x", "z"))
    blocks = write_through(
        rows.groupBy("episode_id", BLOCK)
        .agg(F.first("scene_id").alias("scene_id"), F.max(here).alias("_at"), F.count(F.lit(1)).alias("_rows"))
        .withColumns(
            {
                _PLACE: F.row_number().over(order) - 1,
                "_last": F.count(F.lit(1)).over(Window.partitionBy("episode_id")) - 1,
                "_next": F.lead(BLOCK).over(order),
            }
        ),
        "blocks",
    )
    longest = blocks.agg(F.max("_last")).first()[0] or 0
    begin = blocks.where(F.col(_PLACE) == 0).join(starts, "episode_id").select("episode_id", _PLACE, "node_id")
    chained = F.col("_last") < chained_blocks
    if longest > 0:
        begin = write_through(begin, "begin")
    if longest > 0 and longest >= chained_blocks:
        long = blocks.where(~chained)
        first = begin.join(long.select("episode_id", _PLACE), ["episode_id", _PLACE], "left_semi")
        leads = _leads(rows, long, nodes, first, owners, tiles)
        later = _block_starts(leads, first, longest).where(F.col(_PLACE) > 0)
        begin = begin.unionByName(later)
    tokens = begin.join(blocks, ["episode_id", _PLACE]).select(
        "episode_id", _PLACE, BLOCK, "scene_id", F.col("node_id").alias("from_id"), "node_id", F.lit(None).cast("bigint").alias("after")
    )
    following = blocks.where(chained & F.col("_next").isNotNull()).select("episode_id", BLOCK, "_next")
    walked = _walk(rows, blocks, tokens, owners, tiles, keep_steps=True, following=following)
    path = walked.where(F.col("kind") == _STEP).select("episode_id", BLOCK, F.col("after").alias("step"), "node_id")
    # Blocks that no walk has entered have no node; only their rows are shuffled.
    entered = walked.where(F.col("kind") != _STEP).select("episode_id", BLOCK).distinct()
    never = write_through(blocks.select("episode_id", BLOCK).join(entered, ["episode_id", BLOCK], "left_anti"), "never")
    lost = _rows_of(rows, never).join(never, ["episode_id", BLOCK], "left_semi").select(
        "episode_id", "step", F.lit(None).cast(nodes.schema["node_id"].dataType).alias("node_id")
    )
    return path.select("episode_id", F.col("step").cast(steps.schema["step"].dataType), "node_id").unionByName(lost)


def _leads(rows: DataFrame, blocks: DataFrame, nodes: DataFrame, begin: DataFrame, owners: DataFrame, tiles: DataFrame) -> DataFrame:
    """Where each block but an episode's last leads: ``(episode_id, _place, from_id, to_id)``.

    The starts are those that can be reached from the first guesses.
    """
    inner = blocks.where(F.col(_PLACE) < F.col("_last"))
    ends = inner.select("episode_id", (F.col(_PLACE) + 1).alias(_PLACE), "scene_id", F.col("_at.x").alias("x"), F.col("_at.z").alias("z"))
    near = nearest_node(ends, nodes, ["episode_id", _PLACE]).select("episode_id", _PLACE, "node_id")
    first = blocks.where(F.col(_PLACE) > 0).join(begin.select("episode_id", "node_id"), "episode_id").select("episode_id", _PLACE, "node_id")
    pair = ["episode_id", _PLACE, "node_id"]
    # An episode without a start has nothing to find.
    guesses = near.join(begin.select("episode_id").distinct(), "episode_id", "left_semi").unionByName(first).unionByName(begin)
    place = inner.select("episode_id", _PLACE, BLOCK, "scene_id")
    new = write_through(guesses.where("node_id is not null").distinct().join(place, ["episode_id", _PLACE], "left_semi"), "guesses")
    leads = known = None
    while not new.isEmpty():
        tokens = new.join(place, ["episode_id", _PLACE]).select(
            "episode_id", _PLACE, BLOCK, "scene_id", F.col("node_id").alias("from_id"), "node_id", F.lit(None).cast("bigint").alias("after")
        )
        ended = _walk(rows, blocks, tokens, owners, tiles, keep_steps=False).where(F.col("kind") == _END)
        found = ended.select("episode_id", _PLACE, "from_id", F.col("node_id").alias("to_id"))
        leads = found if leads is None else leads.unionByName(found)
        known = new if known is None else write_through(known.unionByName(new), "known")
        further = found.select("episode_id", (F.col(_PLACE) + 1).alias(_PLACE), F.col("to_id").alias("node_id")).distinct()
        further = further.join(place, ["episode_id", _PLACE], "left_semi")
        new = write_through(further.join(known, pair, "left_anti"), "reached")
    if leads is None:
        return begin.select("episode_id", _PLACE, F.col("node_id").alias("from_id"), F.col("node_id").alias("to_id")).limit(0)
    return write_through(leads, "leads")


def _rows_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the blocks ``wanted(episode_id, block)``, and some others where these are very many; no row moves."""
    key = [F.col("episode_id"), F.col(BLOCK)]
    return marked_by_bitmap(rows, wanted, key, key, "_wanted").where("_wanted").drop("_wanted")


def _walk(
    rows: DataFrame, blocks: DataFrame, tokens: DataFrame, owners: DataFrame, tiles: DataFrame, keep_steps: bool,
    following: DataFrame | None = None,
) -> DataFrame:
    """Run walks to the ends of their blocks, from tile to tile; on to the block ``_next`` of ``following(episode_id, block, _next)``.

    ``tokens`` has ``episode_id, _place, block, scene_id, from_id, node_id, after``:
    the walk that entered the block at ``from_id`` is at ``node_id`` after that
    step.  Walks whose node is not of the scene are dropped.  The result has the
    columns ``episode_id, _place, block, scene_id, kind, from_id, node_id, after``.
    """
    types = {
        "episode_id": rows.schema["episode_id"].dataType.simpleString(), _PLACE: "int", BLOCK: "bigint",
        "scene_id": rows.schema["scene_id"].dataType.simpleString(), "kind": "int",
        "from_id": owners.schema["node_id"].dataType.simpleString(),
        "node_id": owners.schema["node_id"].dataType.simpleString(), "after": "bigint",
    }
    schema = ", ".join(f"{name} {kind}" for name, kind in types.items())
    whole = ["episode_id", _PLACE, BLOCK]

    def walk(moves: pa.Table, heads: pa.Table) -> pa.Table:
        """The walks of one portion of a tile; ``moves`` holds the steps of their blocks, and the walks themselves."""
        if not len(moves) or not len(heads):
            return pa.table({c: pa.array([], t) for c, t in result.items()})
        array = lambda table, c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        is_walk = moves.column("is_walk")
        steps = moves.filter(pc.invert(is_walk)).sort_by([(c, "ascending") for c in ("episode_id", BLOCK, "step")])
        walks = moves.filter(is_walk).sort_by([("episode_id", "ascending"), (BLOCK, "ascending")])
        episode, block, number = (array(steps, c) for c in ("episode_id", BLOCK, "step"))
        edges = np.r_[True, (episode[1:] != episode[:-1]) | (block[1:] != block[:-1])]
        bounds = np.r_[np.flatnonzero(edges), len(number)]
        of, of_block = array(walks, "episode_id"), array(walks, BLOCK)
        # Both are sorted, and hold the same blocks.
        place = np.cumsum(np.r_[False, (of[1:] != of[:-1]) | (of_block[1:] != of_block[:-1])])
        end, after = bounds[place + 1], array(walks, "step")
        at = np.array([a + np.searchsorted(number[a:b], t, "right") for a, b, t in zip(bounds[place], end, after)], np.int64)
        tile = _Tile(heads)
        starts = array(walks, "node_id")
        gone_on, last, kept = tile.walk(starts, at, end, array(steps, "x"), array(steps, "z"), keep_steps)
        reached = np.where(last < 0, starts, tile.to_names[last])
        # A walk that took no step is at its block's end.
        out = [(np.arange(len(at)), np.where(gone_on == end, _END, _HOP), reached, number[gone_on - 1])]
        if kept:
            out.append((kept[0], np.full(len(kept[0]), _STEP), tile.to_names[kept[2]], number[kept[1]]))
        of_walk, kind, node, after = (np.concatenate(parts) for parts in zip(*out))
        taken = walks.select([*whole, "scene_id", "from_id"]).take(pa.array(of_walk))
        columns = {**{c: taken.column(c) for c in taken.column_names}, "kind": kind, "node_id": node, "after": after}
        return pa.table({c: pa.chunked_array(columns[c]).cast(t) if isinstance(columns[c], pa.ChunkedArray) else pa.array(columns[c], t) for c, t in result.items()})

    result = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(schema))}
    tokens = write_through(tokens, "walks")
    sizes = blocks.select("episode_id", BLOCK, "_rows")
    n_blocks = blocks.count()
    out = None
    while True:
        n_tokens = tokens.count()
        if out is not None and not n_tokens:
            return out
        placed = salted_join(tokens, owners, ["scene_id", "node_id"], ["episode_id", _PLACE], n_tokens)
        placed = write_through(placed.join(sizes, ["episode_id", BLOCK]), "placed")
        portions = placed.groupBy("scene_id", "tile").agg(F.ceil(F.sum("_rows") / WALK_ROWS).cast("int").alias("_portions"))
        portions = write_through(portions, "portions")
        portion = F.pmod(F.hash("episode_id", BLOCK), F.col("_portions")).alias("portion")
        dealt = salted_join(placed, portions, ["scene_id", "tile"], ["episode_id", BLOCK], n_tokens).select(
            *tokens.columns, "tile", portion
        )
        none = F.lit(None)
        # A fresh walk begins before all steps.
        walks = dealt.select(
            *whole, "scene_id", "tile", "portion", F.lit(True).alias("is_walk"), "from_id", "node_id",
            F.coalesce("after", F.lit(-(2**62))).alias("step"), none.cast("double").alias("x"), none.cast("double").alias("z"),
        )
        there = dealt.select(*whole, "scene_id", "tile", "portion").distinct()
        # A round of few walks shuffles the rows of their blocks only.
        near = _rows_of(rows, there) if 2 * n_tokens < n_blocks else rows
        steps = near.drop("scene_id").join(there, ["episode_id", BLOCK]).select(
            *whole, "scene_id", "tile", "portion", F.lit(False).alias("is_walk"),
            none.cast(types["from_id"]).alias("from_id"), none.cast(types["node_id"]).alias("node_id"),
            F.col("step").cast("bigint").alias("step"), F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"),
        )
        copies = tiles.join(portions, ["scene_id", "tile"]).select(
            F.col("scene_id").alias("of_scene"), F.col("tile").alias("of_tile"), *_GRAPH,
            F.explode(F.sequence(F.lit(0), F.col("_portions") - 1)).alias("of_portion"),
        )
        moves = walks.unionByName(steps).groupBy("scene_id", "tile", "portion")
        walked = moves.cogroup(copies.groupBy("of_scene", "of_tile", "of_portion")).applyInArrow(walk, schema)
        walked = write_through(walked, "walked")
        out = walked if out is None else out.unionByName(walked)
        tokens = walked.where(F.col("kind") == _HOP).drop("kind")
        if following is not None:
            ended = walked.where(F.col("kind") == _END).join(following, ["episode_id", BLOCK])
            tokens = tokens.unionByName(
                ended.select(
                    "episode_id", (F.col(_PLACE) + 1).cast("int").alias(_PLACE), F.col("_next").alias(BLOCK), "scene_id",
                    F.col("node_id").alias("from_id"), "node_id", F.lit(None).cast("bigint").alias("after"),
                )
            )
        tokens = write_through(tokens, "walks")


def _block_starts(leads: DataFrame, begin: DataFrame, longest: int) -> DataFrame:
    """Start node of every block, from where each block leads.

    After round k the first 2**k starts of an episode are known, and ``jump``
    leads over 2**k blocks; so the rounds grow with the logarithm of the number
    of blocks.
    """
    known, jump, reach = begin, leads, 1
    while True:
        step = jump.select(
            "episode_id", _PLACE, F.col("from_id").alias("node_id"), F.col("to_id").alias("_next")
        )
        further = known.join(step, ["episode_id", _PLACE, "node_id"]).select(
            "episode_id", (F.col(_PLACE) + reach).alias(_PLACE), F.col("_next").alias("node_id")
        )
        known = write_through(known.unionByName(further), "starts")
        if reach >= longest:
            return known
        second = jump.select(
            "episode_id",
            (F.col(_PLACE) - reach).alias(_PLACE),
            F.col("from_id").alias("to_id"),
            F.col("to_id").alias("_far"),
        )
        jump = write_through(
            jump.join(second, ["episode_id", _PLACE, "to_id"]).select(
                "episode_id", _PLACE, "from_id", F.col("_far").alias("to_id")
            ),
            "jumps",
        )
        reach *= 2


# -- nodes on a map ---------------------------------------------------------


def _covers(drawn: DataFrame, tile_cells: int) -> DataFrame:
    """The squares of drawn nodes, once for each tile that they touch."""
    half = (F.lit(POINT_PADDING) / F.col("metres_per_cell")).cast("int")
    at = lambda c, by: F.floor((F.col(c) + by) / F.lit(tile_cells)).cast("int")
    return (
        drawn.where("node_order is not null")
        .select("map_id", "node_order", "row", "col", half.alias("half"))
        .withColumn("tile_row", F.explode(F.sequence(at("row", -F.col("half")), at("row", F.col("half")))))
        .withColumn("tile_col", F.explode(F.sequence(at("col", -F.col("half")), at("col", F.col("half")))))
        .select(*_TILE_KEYS, "node_order", "row", "col", "half")
    )


def _spread(tile_cells: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Waiting nodes that an earlier square covers; rows come by tile, in node order.

    Holds the covered cells of one tile, however many nodes it has.
    """
    tile = last = None
    covered = np.zeros((tile_cells, tile_cells), bool)
    fresh: list[tuple[int, int, int]] = []
    for batch in batches:
        found = []
        columns = [batch.column(c).to_pylist() for c in (*_TILE_KEYS, "node_order", "row", "col", "half", "waits")]
        for k, (map_id, tile_row, tile_col, order, row, col, half, waits) in enumerate(zip(*columns)):
            if (map_id, tile_row, tile_col) != tile:
                tile, last = (map_id, tile_row, tile_col), None
                covered[:] = False
                fresh.clear()
            if order != last:
                # Squares count for later nodes only, not for others of the same place in order.
                for r, c, h in fresh:
                    covered[max(r - h, 0) : max(r + h + 1, 0), max(c - h, 0) : max(c + h + 1, 0)] = True
                fresh.clear()
                last = order
            row, col = row - tile_row * tile_cells, col - tile_col * tile_cells
            if waits:
                if not covered[row, col]:
                    continue
                found.append(k)
            if half is not None:
                fresh.append((row, col, half))
        yield batch.take(pa.array(found, pa.int64())).select(["map_id", "node_order", "row", "col"])


def _drawn_in_order(drawn: DataFrame, waiting: DataFrame, tile_cells: int) -> DataFrame:
    """The nodes ``drawn``, and those ``waiting`` that the square of an earlier drawn node covers.

    A tile is run through in node order.  Squares that reach into another tile
    have it run again, until no node is added; each round is written, so the plan
    does not grow.
    """
    spark = drawn.sparkSession
    half = (F.lit(POINT_PADDING) / F.col("metres_per_cell")).cast("int")
    at = lambda c: F.floor(F.col(c) / F.lit(tile_cells)).cast("int")
    waiting = waiting.where("node_order is not null").withColumns({"tile_row": at("row"), "tile_col": at("col")})
    waiting = write_through(waiting.withColumns({"half": half, "waits": F.lit(True)}), "waiting")
    paths = {name: shared_folder(spark, name) for name in ("drawn", "covers")}
    schemas = {"drawn": drawn.schema, "covers": _covers(drawn, tile_cells).schema}
    for path in paths.values():
        remove_at_exit(spark, path)

    def so_far(name: str) -> DataFrame:
        return spark.read.schema(schemas[name]).parquet(paths[name])

    new, first = write_through(drawn, "placed"), True
    while True:
        new.write.mode("append").parquet(paths["drawn"])
        covers = write_through(_covers(new, tile_cells), "covers")
        covers.write.mode("append").parquet(paths["covers"])
        # A node's own tile has been run with it already, but for the first round.
        reached = covers if first else covers.where((at("row") != F.col("tile_row")) | (at("col") != F.col("tile_col")))
        first = False
        tiles = write_through(waiting.select(*_TILE_KEYS).distinct().join(reached, _TILE_KEYS, "left_semi"), "tiles")
        if tiles.isEmpty():
            return so_far("drawn")
        squares = so_far("covers").withColumn("waits", F.lit(False))
        rows = squares.unionByName(waiting.select(*squares.columns)).join(tiles, _TILE_KEYS, "left_semi")
        in_order = rows.repartition(*_TILE_KEYS).sortWithinPartitions(*_TILE_KEYS, "node_order")
        place = in_order.select("map_id", "node_order", "row", "col").schema
        found = in_order.mapInArrow(partial(_spread, tile_cells), place).distinct()
        key = ["map_id", "node_order", "row", "col"]
        added = waiting.select(*drawn.columns).join(found, key, "left_semi").join(so_far("drawn"), key, "left_anti")
        new = write_through(added, "added")
        if new.isEmpty():
            return so_far("drawn")


def same_floor_nodes(
    starts: DataFrame,
    nodes: DataFrame,
    cells: DataFrame,
    maps: DataFrame,
    height_tolerance: float = 1.0,
    tile_cells: int = TILE_CELLS,
) -> DataFrame:
    """Stamped cells of the nodes on the start's floor: ``(map_id, row, col, code)``.

    ``starts(map_id, scene_id, x, z)`` gives the start of each map,
    ``maps(map_id, low_x, ..., n_rows, n_cols, metres_per_cell)`` its geometry,
    ``cells(map_id, row, col, code)`` its valid cells.  A node is drawn where
    its cell is valid.  Nodes are drawn in their order and a drawn square makes
    its cells valid, so a later node on an invalid cell is drawn as well once a
    square covers it.  Maps are cut into tiles of ``tile_cells`` squared cells; a
    chain of such nodes takes a round per change of tile, not per node.
    """
    at_start = nearest_node(starts, nodes, ["map_id"]).select("map_id", "node_id")
    heights = nodes.select("scene_id", "node_id", F.col("y").alias("_floor"))
    floors = (
        starts.select("map_id", "scene_id").join(at_start, "map_id").join(heights, ["scene_id", "node_id"])
    ).select("map_id", "scene_id", "_floor")
    near = (
        salted_join(nodes, floors, ["scene_id"], ["node_id"], nodes.count())
        .where(F.abs(F.col("y") - F.col("_floor")) < height_tolerance)
        .join(maps, "map_id")
    )
    placed = to_grid(near).select(
        "map_id", "node_order", "row", "col", "n_rows", "n_cols", "metres_per_cell"
    ).where("row >= 0 and row < n_rows and col >= 0 and col < n_cols")
    placed = write_through(placed, "placed")
    valid = cells.where(F.col("code") != INVALID).select("map_id", "row", "col").distinct()
    drawn = placed.join(valid, ["map_id", "row", "col"], "left_semi")
    waiting = placed.join(valid, ["map_id", "row", "col"], "left_anti")
    drawn = _drawn_in_order(drawn, waiting, tile_cells)
    stamped = stamp_square(drawn, POINT_PADDING).select("map_id", "row", "col").distinct()
    return stamped.withColumn("code", F.lit(NODE_WAYPOINT))
