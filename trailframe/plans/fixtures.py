"""Navigation-shaped tables derived from the star-schema test tables.

Integers and quarters only, so that both engines get the same values.  The SQL
twins of these derivations are in :mod:`trailframe.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.operators.blocks import number_rows
from trailframe.session import land_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their position within the user, as ``step``."""
    events = table(spark, sf_dir, "events").select(
        "user_id",
        "ts",
        F.col("event_id").alias("e"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "value",
    )
    day = F.unix_date(F.to_date("ts")).cast("bigint")
    seconds = ((day * 24 + F.hour("ts")) * 60 + F.minute("ts")) * 60 + F.second("ts")
    return number_rows(events, ["user_id"], ["ts", "e"], seconds, "step")


def _quarters(number: Column) -> Column:
    return F.pmod(number, F.lit(80)) / F.lit(4.0)


def _point(x: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), F.lit(0.0).alias("y"), z.alias("z"))


def _pixel(u: Column, v: Column) -> Column:
    return F.struct(u.cast("bigint").alias("u"), v.cast("bigint").alias("v"))


def nav_steps(spark: SparkSession, sf_dir: str, schema_version: int = 3) -> DataFrame:
    """Exploration steps, one task per user, two roots; landed as a table."""
    landed = land_once(spark, ("steps", sf_dir), lambda: derive_nav_steps(spark, sf_dir), f"{sf_dir}/events.parquet")
    return landed.withColumn("schema_version", F.lit(schema_version))


def derive_nav_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k, step = F.col("e"), F.col("k"), F.col("step")
    action = (
        F.when(k < 3, F.lit(None).cast("int"))
        .when(k < 6, 0)
        .when(k < 75, 1)
        .when(k < 88, 2)
        .otherwise(3)
    )

    def candidate(i: Column) -> Column:
        hidden = F.pmod(e + i, F.lit(9)) == 0
        vis = (
            F.when(hidden, 1)
            .when(F.pmod(e + i, F.lit(10)) == 7, F.lit(None).cast("int"))
            .otherwise(F.pmod(F.pmod(e, F.lit(13)) + i, F.lit(4)).cast("int"))
        )
        pixel = F.when(~hidden, _pixel(F.pmod(e * 13 + i * 131, F.lit(640)), F.pmod(e * 17 + i * 97, F.lit(480))))
        return F.struct(
            pixel.alias("px"),
            _point(_quarters(e * 3 + i * 5 + 3), _quarters(e * 5 + i * 7 + 2)).alias("world"),
            vis.alias("vis"),
        )

    n_cand = F.pmod(F.pmod(e, F.lit(11)), F.lit(4)).cast("int")
    cands = F.transform(
        F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: i < n_cand), candidate
    )
    return numbered_events(spark, sf_dir).select(
        F.concat(F.lit("root"), F.pmod("user_id", F.lit(2)).cast("string")).alias("root"),
        F.col("user_id").alias("task_idx"),
        step,
        F.concat(F.lit("s"), F.pmod("user_id", F.lit(10)).cast("string")).alias("scene_id"),
        F.col("user_id").cast("string").alias("task_id"),
        F.concat(F.lit("walk to room "), F.pmod("user_id", F.lit(7)).cast("string"), F.lit(" and wait")).alias(
            "instruction"
        ),
        action.alias("action"),
        cands.alias("cands"),
        n_cand.alias("n_pix"),
        n_cand.alias("n_world"),
        n_cand.alias("n_vis"),
        F.when(F.pmod(e, F.lit(4)) != 3, _pixel(F.pmod(e * 7, F.lit(640)), F.pmod(e * 11, F.lit(480)))).alias(
            "traj_px"
        ),
        F.when(F.pmod(e, F.lit(5)) != 4, _point(_quarters(e * 3), _quarters(e * 5))).alias("traj_world"),
        F.when(F.pmod(e, F.lit(3)) == 0, 0)
        .when(F.pmod(e, F.lit(3)) == 1, F.pmod(k, F.lit(4)))
        .alias("traj_status"),
        (F.col("value") / 10).alias("goal_distance"),
        (F.pmod(step, F.lit(13)) == 12).alias("is_endpoint"),
        (F.pmod(step, F.lit(23)) >= 20).alias("floor_transition"),
        F.when(F.pmod(k, F.lit(5)) == 0, F.pmod(F.pmod(e, F.lit(17)), F.lit(5)).cast("int")).alias("expert_idx"),
        F.pmod(e, F.lit(3)).cast("int").alias("floor_id"),
        _quarters(e).alias("floor_height"),
    )


def episode_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode traces, one episode per user; landed as a table."""
    return land_once(spark, ("episodes", sf_dir), lambda: derive_episode_steps(spark, sf_dir), f"{sf_dir}/events.parquet")


def derive_episode_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    return numbered_events(spark, sf_dir).select(
        F.col("user_id").alias("episode_id"),
        "step",
        _quarters(e * 3).alias("x"),
        F.lit(0.0).alias("y"),
        _quarters(e * 5).alias("z"),
        (F.col("value") / 10).alias("distance_to_goal"),
        (F.col("value") < 5).alias("success"),
        (F.col("k") / F.lit(100.0)).alias("spl"),
        "e",
    )


# -- exploration documents ---------------------------------------------------

TASKS_PER_DOCUMENT = 100


def _defect() -> Column:
    """Which flaw a task's document gets, by its number."""
    return F.pmod(F.floor(F.col("task_idx") / 4), F.lit(8))


def exploration_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(root, text)``: JSON documents with flawed and sound tasks.

    Roots 0 and 3 are schema 3 (3 lacks two settings), 1 is schema 2, 2 is the
    unknown schema 4.  A root is cut into documents of 100 tasks at most.
    """
    defect, user = _defect(), F.col("task_idx")
    rows = nav_steps(spark, sf_dir).withColumn(
        "_r",
        F.struct(
            "step", "action", "cands", "traj_px", "traj_world", "traj_status", "goal_distance",
            "is_endpoint", "floor_transition", "expert_idx", "floor_id", "floor_height",
        ),
    )
    # Lists do not get shorter before the shuffle, so rows are dealt first and listed once.
    grouped = rows.repartition("task_idx").groupBy("task_idx", "scene_id", "task_id", "instruction").agg(
        F.array_sort(F.collect_list("_r")).alias("all_rows")
    )
    grouped = grouped.withColumn(
        "r", F.when(defect == 2, F.slice("all_rows", 1, 0)).otherwise(F.col("all_rows"))
    )

    def each(make) -> Column:
        return F.transform("r", make)

    sound = defect == 6
    pixel = lambda p: F.when(p.isNotNull(), F.array(p["u"], p["v"]))
    point = lambda p: F.when(p.isNotNull(), F.array(p["x"], p["y"], p["z"]))
    last = F.size("r") - 1
    actions = F.transform(
        "r",
        lambda s, i: F.when(
            sound, F.when(i == last, 0).when(s["action"] == 0, 1).otherwise(s["action"])
        ).otherwise(s["action"]),
    )
    floors = each(lambda s: s["floor_id"])
    task = F.struct(
        "scene_id",
        "task_id",
        "instruction",
        F.when(defect == 0, F.lit(None).cast("string")).when(defect == 1, "__null__").otherwise("goal").alias("goal_world"),
        F.when(defect.isin(5, 6), "reached_goal").otherwise("max_steps").alias("termination_reason"),
        defect.isin(4, 5, 6).alias("success"),
        F.when(defect != 0, F.lit(0.25)).alias("final_geodesic_distance"),
        actions.alias("actions"),
        each(lambda s: F.lit("t")).alias("topdown_coords"),
        each(lambda s: F.lit("h")).alias("history_info"),
        each(lambda s: F.transform(s["cands"], lambda c: pixel(c["px"]))).alias("pixel_coords"),
        each(lambda s: F.transform(s["cands"], lambda c: point(c["world"]))).alias("world_coords"),
        each(lambda s: F.transform(s["cands"], lambda c: c["vis"])).alias("visibility_status"),
        each(lambda s: pixel(s["traj_px"])).alias("trajectory_pixel"),
        each(lambda s: point(s["traj_world"])).alias("trajectory_world"),
        each(lambda s: s["traj_status"]).alias("trajectory_status"),
        each(lambda s: s["goal_distance"]).alias("trajectory_goal_distances"),
        each(lambda s: s["is_endpoint"] & ~sound).alias("trajectory_is_endpoint"),
        each(lambda s: s["expert_idx"]).alias("expert_candidate_indices"),
        F.when(defect == 3, F.slice(floors, 1, F.size("r") - 1)).otherwise(floors).alias("floor_ids"),
        each(lambda s: s["floor_height"]).alias("floor_heights"),
        each(lambda s: s["floor_transition"] & ~sound).alias("floor_transition"),
    )
    text = F.replace(F.to_json(task), F.lit('"__null__"'), F.lit("null"))
    number = F.pmod(user, F.lit(4))
    settings = (
        '"stop_radius_m":1.0,"endpoint_target_radius_m":3.0,"min_unexplored_area_m2":2.0,'
        '"expert_candidate_match_distance_m":2.0,"trajectory_sample_interval_m":0.25'
    )
    full = '{"waypoint_radius_m":1.5,"update_interval":4,' + settings + "}"
    head = F.concat(
        F.lit('{"schema_version":'),
        F.when(number == 1, "2").when(number == 2, "4").otherwise("3"),
        F.lit(',"generation_config":'),
        F.when(number == 3, "{" + settings + "}").otherwise(full),
        F.lit(',"tasks":['),
    )
    return (
        grouped.select(
            F.concat_ws("-", number.cast("string"), F.floor(user / (4 * TASKS_PER_DOCUMENT)).cast("string")).alias("root"),
            head.alias("head"),
            F.struct(user.alias("n"), text.alias("text")).alias("task"),
        )
        .repartition("root")
        .groupBy("root", "head")
        .agg(F.array_sort(F.collect_list("task")).alias("tasks"))
        .select(
            "root",
            F.concat("head", F.array_join(F.transform("tasks", lambda t: t["text"]), ","), F.lit("]}")).alias("text"),
        )
    )


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns: a third of the items with a video, a third with an image."""
    has_video = F.pmod("conv_id", F.lit(3)) == 0
    tagged = (F.col("role") == "user") & has_video & (F.col("turn") <= 1)
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role")).alias("speaker"),
        F.when(tagged, F.concat(F.lit("<video>\n"), F.col("text"))).otherwise(F.col("text")).alias("value"),
        F.when(F.pmod("conv_id", F.lit(3)) == 1, 1).otherwise(8).alias("n_frames"),
    )


def conversation_documents(spark: SparkSession, sf_dir: str, items_per_file: int = 50) -> DataFrame:
    """``(file, text)``: JSON lists of conversation items, 50 to a file.

    Every fifth item has no id.
    """
    conv = F.col("conv_id")
    items = conversation_turns(spark, sf_dir).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "speaker", "value"))).alias("turns")
    )
    text = F.to_json(
        F.struct(
            F.when(F.pmod(conv, F.lit(5)) != 0, F.concat(F.lit("c"), conv.cast("string"))).alias("id"),
            F.when(F.pmod(conv, F.lit(3)) == 0, F.concat(F.lit("v"), conv.cast("string"))).alias("video"),
            F.when(F.pmod(conv, F.lit(3)) == 1, F.concat(F.lit("i"), conv.cast("string"))).alias("image"),
            F.transform(
                "turns", lambda t: F.struct(t["speaker"].alias("from"), t["value"].alias("value"))
            ).alias("conversations"),
        )
    )
    return (
        items.select(F.floor(conv / items_per_file).alias("file"), F.struct("conv_id", text.alias("text")).alias("item"))
        .groupBy("file")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
        .select("file", F.concat(F.lit("["), F.array_join(F.transform("items", lambda i: i["text"]), ","), F.lit("]")).alias("text"))
    )


# -- images, tokens -----------------------------------------------------------


def image_store(paths: DataFrame) -> DataFrame:
    """A key/value store for ``(rel_path, scene_id, step)``.

    Key style by step: below the scene, whole path, whole path with extension,
    missing; every eighth step lies in the common store as well.
    """
    bare = F.regexp_replace("rel_path", r"\.jpg$", "")
    below = F.regexp_replace(bare, "^[^/]*/", "")
    style = F.pmod("step", F.lit(4))
    own = F.struct(
        F.when(style == 1, "*").otherwise(F.col("scene_id")).alias("store"),
        F.when(style == 0, below).when(style == 1, bare).otherwise(F.col("rel_path")).alias("key"),
    )
    spare = F.when(F.pmod("step", F.lit(8)) == 0, F.struct(F.lit("*").alias("store"), F.col("rel_path").alias("key")))
    entries = F.filter(F.array(own, spare), lambda e: e.isNotNull())
    return (
        paths.where(style != 3)
        .select(F.inline(entries))
        .select("store", "key", F.encode(F.concat_ws(":", "store", "key"), "utf-8").alias("bytes"))
    )


def token_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as id lists: the word lengths stand for token ids."""
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", ids.alias("ids"))
        .withColumn(
            "response",
            F.when(F.pmod("doc_id", F.lit(3)) == 0, F.array(F.lit(99), F.lit(98))).otherwise(F.slice("ids", 5, 3)),
        )
    )


# -- graphs and rasters ---------------------------------------------------------


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = lambda i: F.get(F.col("embedding"), F.lit(i)).cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("scene_id"),
        F.col("vec_id").alias("node_id"),
        F.col("vec_id").alias("node_order"),
        axis(0).alias("x"),
        (axis(1) * 5).alias("y"),
        axis(2).alias("z"),
    )


def graph_edges(nodes: DataFrame) -> DataFrame:
    """Each node to the next and the third next of its scene."""
    placed = number_rows(
        nodes.select("scene_id", "node_id"), ["scene_id"], ["node_id"], F.col("node_id"), "place"
    )
    ends = placed.select("scene_id", F.col("place").alias("to_place"), F.col("node_id").alias("dst"))
    hops = placed.select(
        "scene_id",
        F.col("node_id").alias("src"),
        F.inline(
            F.array(
                F.struct((F.col("place") + 1).alias("to_place"), (F.col("node_id") * 2).alias("edge_order")),
                F.struct((F.col("place") + 3).alias("to_place"), (F.col("node_id") * 2 + 1).alias("edge_order")),
            )
        ),
    )
    return hops.join(ends, ["scene_id", "to_place"]).select("scene_id", "src", "dst", "edge_order")


def graph_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode positions within the extent of the graphs."""
    e = F.col("e")
    inside = lambda n: F.pmod(n, F.lit(80)) / F.lit(100.0) - F.lit(0.4)
    return episode_steps(spark, sf_dir).select(
        "episode_id",
        F.pmod("episode_id", F.lit(10)).cast("string").alias("scene_id"),
        "step",
        inside(e * 3).alias("x"),
        inside(e * 5).alias("z"),
    )


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as an 8 x 8 picture."""
    cells = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("map_id"), "label", F.posexplode("embedding").alias("i", "v")
    )
    return cells.select(
        "map_id",
        "label",
        "i",
        F.floor(F.col("i") / 8).cast("int").alias("row"),
        F.pmod("i", F.lit(8)).alias("col"),
        F.lit(8).alias("n_rows"),
        F.lit(8).alias("n_cols"),
        F.col("v").cast("double").alias("value"),
    )


def map_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.abs("value")
    return raster(spark, sf_dir).select(
        "map_id",
        "row",
        "col",
        F.pmod(F.floor(size * 1000), F.lit(16)).cast("int").alias("code"),
        F.pmod(F.floor(size * 10000), F.lit(2)).cast("int").alias("fog"),
    )


def scene_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid cells of one 64 x 64 map per scene."""
    return raster(spark, sf_dir).select(
        F.col("label").cast("string").alias("map_id"),
        F.col("i").alias("row"),
        F.pmod(F.floor(F.abs("value") * 1000), F.lit(64)).cast("int").alias("col"),
        F.lit(1).alias("code"),
    ).distinct()


def map_points(spark: SparkSession, sf_dir: str, shift: float = 0.0) -> DataFrame:
    """Path points on a 64 x 64 map of 20 m x 20 m per episode."""
    return episode_steps(spark, sf_dir).select(
        F.col("episode_id").alias("map_id"),
        "step",
        (F.col("x") + F.lit(shift)).alias("x"),
        (F.col("z") + F.lit(shift)).alias("z"),
        *[F.lit(v).alias(n) for n, v in (("low_x", 0.0), ("low_z", 0.0), ("high_x", 20.0), ("high_z", 20.0))],
        F.lit(64).alias("n_rows"),
        F.lit(64).alias("n_cols"),
        F.lit(0.125).alias("metres_per_cell"),
    )
