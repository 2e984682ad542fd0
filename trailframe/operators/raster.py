"""Top-down maps as tables of cells.

A map is a long table ``(map_id, row, col, code[, fog])``; what the drawing
operators produce are more such rows, one layer each.  Lines are one cell wide
and cells outside the map are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailframe.functions.geometry import grid_cell
from trailframe.operators.blocks import BLOCK, across_blocks, attach_carry, with_block, within_block

# ---------------------------------------------------------------------------
# Cell codes, their colours, paddings in metres.
# ---------------------------------------------------------------------------
INVALID = 0
SOURCE_POINT = 4
TARGET_POINT = 6
NODE_WAYPOINT = 7
WAYPOINT_PREDICTION = 12
ORACLE_WAYPOINT = 13
SHORTEST_PATH_WAYPOINT = 14
PALETTE = (
    (0, 255, 255, 255),
    (1, 150, 150, 150),
    (2, 50, 50, 50),
    (3, 150, 150, 150),
    (4, 0, 0, 200),
    (5, 150, 150, 150),
    (6, 200, 0, 0),
    (7, 0, 200, 0),
    (8, 245, 150, 150),
    (9, 0, 175, 0),
    (10, 0, 0, 0),
    (11, 0, 0, 0),
    (12, 255, 255, 0),
    (13, 255, 165, 0),
    (14, 0, 150, 0),
)
FOG_DIMMING = 0.5
POINT_PADDING = 0.3
TRIANGLE_PADDING = 0.35
ORACLE_PADDING = 0.2
DOT_GAP = 15
PATH_GAP = 10
#: Points of paths that a task draws; each covers some dozen cells.
TASK_POINTS = 65_536
# ---------------------------------------------------------------------------


def default_palette(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PALETTE), "code INT, r INT, g INT, b INT")


def to_grid(points: DataFrame) -> DataFrame:
    """Add ``row`` (from z) and ``col`` (from x) to points with map bounds.

    Needs ``x, z, low_x, low_z, high_x, high_z, n_rows, n_cols``.  Cut toward
    zero, not clipped; null where the bounds have no extent.
    """
    return points.select(
        "*",
        grid_cell(F.col("z"), F.col("low_z"), F.col("high_z"), F.col("n_rows")).alias("row"),
        grid_cell(F.col("x"), F.col("low_x"), F.col("high_x"), F.col("n_cols")).alias("col"),
    )


def colorize_cells(
    cells: DataFrame, palette: DataFrame, fog: str | None = "fog", dimming: float = FOG_DIMMING
) -> DataFrame:
    """Colour of every cell; fogged cells are dimmed, invalid ones never.

    A code is one byte, so the palette has at most 256 rows and is broadcast.
    """
    colours = palette.where("code between 0 and 255").groupBy("code").agg(
        *[F.first(c).alias(c) for c in "rgb"]
    )
    joined = cells.join(F.broadcast(colours), "code", "left")
    if fog is None:
        return joined
    dim = (F.col("code") != INVALID) & (F.col(fog) == 0)
    return joined.withColumns(
        {c: F.when(dim, (F.col(c) * F.lit(dimming)).cast("int")).otherwise(F.col(c)) for c in "rgb"}
    )


def _inside() -> Column:
    return F.col("row").between(0, F.col("n_rows") - 1) & F.col("col").between(0, F.col("n_cols") - 1)


def stamp_square(centres: DataFrame, padding: float = POINT_PADDING) -> DataFrame:
    """Cells of a square around each ``(row, col)``, clipped to the map."""
    half = (F.lit(padding) / F.col("metres_per_cell")).cast("int")
    return (
        centres.where("row is not null and col is not null")
        .withColumn("_half", half)
        .withColumn("_dr", F.explode(F.sequence(-F.col("_half"), F.col("_half"))))
        .withColumn("_dc", F.explode(F.sequence(-F.col("_half"), F.col("_half"))))
        .withColumns({"row": F.col("row") + F.col("_dr"), "col": F.col("col") + F.col("_dc")})
        .where(_inside())
        .drop("_half", "_dr", "_dc")
    )


def stamp_triangle(centres: DataFrame, padding: float = TRIANGLE_PADDING) -> DataFrame:
    """Cells of an upright triangle around each ``(row, col)``, clipped."""
    half = (F.lit(padding) / F.col("metres_per_cell")).cast("int")
    reach = F.floor((F.col("_dr") + F.col("_half")) / F.lit(2)).cast("int")
    return (
        centres.where("row is not null and col is not null")
        .withColumn("_half", half)
        .withColumn("_dr", F.explode(F.sequence(-F.col("_half"), F.col("_half"))))
        .withColumn("_dc", F.explode(F.sequence(-reach, reach)))
        .withColumns({"row": F.col("row") + F.col("_dr"), "col": F.col("col") + F.col("_dc")})
        .where(_inside())
        .drop("_half", "_dr", "_dc")
    )


def _dot_count(gap: int) -> Column:
    return F.ceil(F.col("_length") / F.lit(float(gap))).cast("int")


def _dot_range(segments: DataFrame, least: int, gap: int) -> tuple[Column, Column]:
    """Numbers of the first and last dot (or dash end) that can lie on the map."""
    low, high = _on_map(segments)
    dots = F.col("_length") / F.lit(float(gap))
    first = F.greatest(F.floor(low * dots).cast("int") - 1, F.lit(least))
    last = F.least(F.ceil(high * dots).cast("int") + 1, _dot_count(gap) - 1)
    return first, F.when(low <= high, last).otherwise(first - 1)


def _with_length(segments: DataFrame) -> DataFrame:
    rows, cols = F.col("row2") - F.col("row1"), F.col("col2") - F.col("col1")
    return segments.withColumn("_length", F.sqrt((rows * rows + cols * cols).cast("double")))


def _dot(a: str, b: str, number: Column, gap: int) -> Column:
    """Coordinate of a dot: the point ``number * gap`` along the segment, rounded."""
    part = (number * F.lit(float(gap))) / F.col("_length")
    return (F.col(a) * (F.lit(1.0) - part) + F.col(b) * part + F.lit(0.5)).cast("int")


def _on_map(lines: DataFrame) -> tuple[Column, Column]:
    """Parts (0 to 1) of a segment between which it can touch its map, two cells more.

    Without the map's size the whole segment.
    """
    if not {"n_rows", "n_cols"} <= set(lines.columns):
        return F.lit(0.0), F.lit(1.0)

    def bounds(a: str, b: str, size: str) -> tuple[Column, Column]:
        start, delta = F.col(a).cast("double"), (F.col(b) - F.col(a)).cast("double")
        enters = F.try_divide(F.lit(-2.0) - start, delta)
        leaves = F.try_divide(F.col(size) + F.lit(2.0) - start, delta)
        near = start.between(-2.0, F.col(size) + 2)
        still = lambda inside, outside: F.when(near, inside).otherwise(outside)
        return (
            F.when(delta == 0, still(0.0, 1.0)).otherwise(F.least(enters, leaves)),
            F.when(delta == 0, still(1.0, 0.0)).otherwise(F.greatest(enters, leaves)),
        )

    (low_r, high_r), (low_c, high_c) = bounds("row1", "row2", "n_rows"), bounds("col1", "col2", "n_cols")
    return F.greatest(low_r, low_c, F.lit(0.0)), F.least(high_r, high_c, F.lit(1.0))


def _draw_lines(lines: DataFrame, others: Sequence[str]) -> DataFrame:
    """Cells of the lines between two cells each, both ends included.

    Where the size of the map is known, cells far outside are never made.
    """
    low, high = _on_map(lines)
    rows, cols = F.col("row2") - F.col("row1"), F.col("col2") - F.col("col1")
    numbered = lines.select(
        *others,
        "row1",
        "col1",
        rows.alias("_rows"),
        cols.alias("_cols"),
        F.greatest(F.abs(rows), F.abs(cols)).alias("_n"),
        low.alias("_low"),
        high.alias("_high"),
    )
    numbered = numbered.where("_low <= _high").select(
        *[c for c in numbered.columns if c not in ("_low", "_high")],
        F.explode(
            F.sequence(F.floor(F.col("_low") * F.col("_n")).cast("int"), F.ceil(F.col("_high") * F.col("_n")).cast("int"))
        ).alias("_k"),
    )

    def along(start: str, delta: str) -> Column:
        part = (F.col(delta) * F.col("_k") * 2 + F.col("_n")) / (F.greatest("_n", F.lit(1)) * 2)
        return (F.col(start) + F.floor(part)).cast("int")

    return numbered.select(*others, along("row1", "_rows").alias("row"), along("col1", "_cols").alias("col"))


def densify_segment(segments: DataFrame, style: str = "dotted", gap: int = DOT_GAP) -> DataFrame:
    """Cells of the segments ``(row1, col1) - (row2, col2)``.

    *dotted*: points every ``gap`` cells; *dashed*: the line pieces that lead
    to every second of those points; *filled*: the whole line.  A segment of no
    length has no dots and no dashes.
    """
    if style not in ("dotted", "dashed", "filled"):
        raise ValueError(f"unknown style {style!r}")
    ends = ("row1", "col1", "row2", "col2")
    others = [c for c in segments.columns if c not in ends]
    if style == "filled":
        return _draw_lines(segments, others)
    measured = _with_length(segments)
    if style == "dotted":
        first, last = _dot_range(measured, 0, gap)
        dots = measured.where((F.col("_length") > 0) & (first <= last)).select(
            "*", F.explode(F.sequence(first, last)).alias("_i")
        )
        return dots.select(
            *others,
            _dot("row1", "row2", F.col("_i"), gap).alias("row"),
            _dot("col1", "col2", F.col("_i"), gap).alias("col"),
        )
    first, last = _dot_range(measured, 1, gap)
    first = first + (first + 1) % 2  # dashes end at odd dots
    dashes = measured.where((_dot_count(gap) > 1) & (first <= last)).select(
        "*", F.explode(F.sequence(first, last, F.lit(2))).alias("_i")
    )
    pieces = dashes.select(
        *others,
        _dot("row1", "row2", F.col("_i") - 1, gap).alias("_r1"),
        _dot("col1", "col2", F.col("_i") - 1, gap).alias("_c1"),
        _dot("row1", "row2", F.col("_i"), gap).alias("_r2"),
        _dot("col1", "col2", F.col("_i"), gap).alias("_c2"),
    )
    # The sizes of the map are among the columns kept.
    named = pieces.withColumnsRenamed({"_r1": "row1", "_c1": "col1", "_r2": "row2", "_c2": "col2"})
    return _draw_lines(named, others)


def _path_segments(path: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Pair every point with the next one of its path.

    ``order`` is a whole number; numbers may be missing.  Points are paired
    within blocks of the path, and a block's last point with the first of the
    next block, so that a long path is not sorted in one task.
    """
    cell = F.struct("row", "col")
    rows = with_block(path, order).withColumn("_next", F.lead(cell).over(within_block(keys, order)))

    def carry(summary: DataFrame) -> DataFrame:
        return summary.select(*keys, BLOCK, F.lead("_head").over(across_blocks(keys)).alias("_after"))

    linked = attach_carry(rows, keys, [F.min_by(cell, order).alias("_head")], carry)
    paired = linked.withColumn("_next", F.coalesce("_next", "_after")).where("_next is not null")
    others = [c for c in path.columns if c not in ("row", "col")]
    return paired.select(
        *others,
        F.col("row").alias("row1"),
        F.col("col").alias("col1"),
        F.col("_next.row").alias("row2"),
        F.col("_next.col").alias("col2"),
    )


def _distinct_cells(cells: DataFrame, keys: Sequence[str], tasks: int) -> DataFrame:
    """The cells, once each, by so many tasks."""
    return cells.select(*keys, "row", "col").repartition(tasks, *keys, "row").distinct()


def reference_path_layer(
    path: DataFrame, keys: Sequence[str] = ("map_id",), order: str = "step", task_points: int = TASK_POINTS
) -> DataFrame:
    """A path as dashed lines between its points and a square at each.

    Points are dealt by path and block, so that a task draws some ``task_points`` of them,
    and drops repeated cells before these are shuffled; the number of tasks grows with the points.
    """
    keys = list(keys)
    tasks = max(1, -(-path.count() // task_points))
    points = to_grid(path).select(*keys, order, "row", "col", "n_rows", "n_cols", "metres_per_cell")
    by_block = [*keys, BLOCK]
    dealt = with_block(points, order, task_points).repartition(tasks, *by_block)
    segments = with_block(_path_segments(points, keys, order), order, task_points).repartition(tasks, *by_block)
    lines = densify_segment(segments, "dashed", PATH_GAP).where(_inside())
    drawn = [cells.select(*by_block, "row", "col").distinct() for cells in (lines, stamp_square(dealt))]
    cells = _distinct_cells(drawn[0].unionByName(drawn[1]), keys, tasks)
    return cells.withColumn("code", F.lit(SHORTEST_PATH_WAYPOINT))


def straight_path_layer(path: DataFrame, keys: Sequence[str] = ("map_id",), order: str = "step") -> DataFrame:
    """A path as plain lines between its points."""
    keys = list(keys)
    points = to_grid(path).select(*keys, order, "row", "col", "n_rows", "n_cols")
    lines = densify_segment(_path_segments(points, keys, order), "filled").where(_inside())
    return lines.select(*keys, "row", "col").distinct().withColumn("code", F.lit(SHORTEST_PATH_WAYPOINT))


def endpoints_layer(starts: DataFrame, goals: DataFrame, keys: Sequence[str] = ("map_id",)) -> DataFrame:
    """Start and first goal of each map as squares; the goal lies on top."""
    first_goal = goals.where("goal_no = 0").drop("goal_no")

    def marked(points: DataFrame, code: int) -> DataFrame:
        return stamp_square(to_grid(points)).select(*keys, "row", "col", F.lit(code).alias("code"))

    return compose_layers([marked(starts, SOURCE_POINT), marked(first_goal, TARGET_POINT)], keys)


def waypoint_layer(waypoints: DataFrame, kind: str = "prediction", keys: Sequence[str] = ("map_id",)) -> DataFrame:
    """Waypoints as triangles.

    A predicted one is drawn only strictly inside the map, an oracle one always.
    """
    placed = to_grid(waypoints)
    if kind == "prediction":
        inside = (
            (F.col("row") > 0)
            & (F.col("row") < F.col("n_rows"))
            & (F.col("col") > 0)
            & (F.col("col") < F.col("n_cols"))
        )
        drawn, code = stamp_triangle(placed.where(inside)), WAYPOINT_PREDICTION
    elif kind == "oracle":
        drawn, code = stamp_triangle(placed, ORACLE_PADDING), ORACLE_WAYPOINT
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return drawn.select(*keys, "row", "col").distinct().withColumn("code", F.lit(code))


def compose_layers(layers: Sequence[DataFrame], keys: Sequence[str] = ("map_id",)) -> DataFrame:
    """Overlay layers given in drawing order: the last code of a cell stays."""
    numbered = [
        layer.select(*keys, "row", "col", "code", F.lit(number).alias("_layer"))
        for number, layer in enumerate(layers)
    ]
    stacked = reduce(DataFrame.unionByName, numbered)
    return stacked.groupBy(*keys, "row", "col").agg(F.max_by("code", "_layer").alias("code"))


def _bins(index: Column, size: Column, wanted: int) -> Column:
    """Output bins that cover an input index."""
    n = F.lit(wanted)
    first = F.floor(index * n / size)
    last = F.ceil((index + 1) * n / size) - 1
    return F.sequence(first, last)


def resize_area(
    raster: DataFrame,
    out_rows: int,
    out_cols: int,
    keys: Sequence[str] = ("map_id",),
    value_type: str | None = None,
) -> DataFrame:
    """Resize by area mean.

    ``keys`` names image, channel and batch columns alike, so every layout is
    the same table.  Needs ``row, col, n_rows, n_cols, value``; ``value_type``
    casts the mean back to the input's type.
    """
    covered = raster.select(
        *keys,
        "value",
        F.explode(_bins(F.col("row"), F.col("n_rows"), out_rows)).alias("out_row"),
        "col",
        "n_cols",
    ).select(
        *keys,
        "value",
        "out_row",
        F.explode(_bins(F.col("col"), F.col("n_cols"), out_cols)).alias("out_col"),
    )
    mean = F.avg(F.col("value").cast("double"))
    if value_type:
        mean = mean.cast(value_type)
    return covered.groupBy(*keys, "out_row", "out_col").agg(mean.alias("value"))
