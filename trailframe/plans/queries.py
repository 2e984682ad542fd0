"""The registered queries: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailframe.config import NavConfig
from trailframe.functions.geometry import euclidean
from trailframe.functions.text import (
    action_display,
    build_prompt,
    build_response,
    format_coord_list,
    image_path,
    pick_conjunction,
    trainable_ranges,
)
from trailframe.functions.tokens import attention_mask, last_subsequence, truncate_ids
from trailframe.operators import (
    batches,
    conversations,
    corpus,
    counts,
    graph,
    images,
    measures,
    raster,
    samples,
    steps,
    validate,
)
from trailframe.plans import fixtures as fx
from trailframe.session import remove_at_exit, shared_folder, write_through
from trailframe.sources import conversations as conversation_source
from trailframe.sources import exploration
from trailframe.streaming.measures import finish_measures, stream_measures, stream_measures_over_gaps

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CONFIG = NavConfig()
EOS, PAD = 7, 0


def query(name: str):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def joined(values: Column) -> Column:
    return F.array_join(values, ",", "null")


def rounded(name: str | Column, alias: str | None = None) -> Column:
    column = F.col(name) if isinstance(name, str) else name
    return F.round(column, 6).alias(alias or name)


def whole(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def pixel(name: str) -> tuple[Column, Column]:
    return F.col(f"{name}.u").alias(f"{name}_u"), F.col(f"{name}.v").alias(f"{name}_v")


def classified(spark, sf_dir, version=3, config=CONFIG):
    return steps.classify_steps(fx.nav_steps(spark, sf_dir, version), config)


def indexed(spark, sf_dir, version=3):
    return samples.index_steps(classified(spark, sf_dir, version), CONFIG)


# -- sources ------------------------------------------------------------------


def written_documents(spark: SparkSession, sf_dir: str) -> str:
    """Documents derived from the tables, written one per line: a folder per root, few files in each."""
    folder = shared_folder(spark, "documents")
    documents = fx.exploration_documents(spark, sf_dir).withColumn("root", F.substring_index("root", "-", 1))
    documents.write.partitionBy("root").text(folder)
    remove_at_exit(spark, folder)
    return folder


def loaded_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = exploration.load_tasks(spark, f"{written_documents(spark, sf_dir)}/root=*/*.txt", one_per_line=True)
    return tasks.withColumn("root", F.substring_index("root", "=", -1))


@query("S1_load_tasks")
def load_tasks(spark, sf_dir):
    return loaded_tasks(spark, sf_dir).select(
        "root",
        "task_idx",
        "task_id",
        whole("schema_version"),
        F.coalesce(F.size("actions"), F.lit(0)).cast("bigint").alias("n_actions"),
        "goal_world",
        "success",
    )


@query("S1_load_large_tasks")
def load_large_tasks(spark, sf_dir):
    """All tasks of a root in one pretty-printed document, which many tasks read."""
    tasks = fx.exploration_documents(spark, sf_dir).select(
        F.substring_index("root", "-", 1).alias("root"),
        F.split_part("root", F.lit("-"), F.lit(2)).cast("int").alias("n"),
        F.substring_index("text", '"tasks":[', 1).alias("head"),
        F.regexp_replace("text", r'(?s)^.*?"tasks":\[|\]\}$', "").alias("tasks"),
    )
    lists = tasks.groupBy("root", "head").agg(F.array_sort(F.collect_list(F.struct("n", "tasks"))).alias("l"))
    joined_lists = F.array_join(F.transform("l", lambda t: t["tasks"]), " ,\n  ")
    folder = shared_folder(spark, "large")
    # Fields behind the list, with brackets in strings, do not matter.
    text = F.concat("head", F.lit('"tasks" : [\n  '), joined_lists, F.lit('\n], "note": "}],{[ \\" \\\\", "more": [{"a": 1}, {"b": {}}]}\n'))
    lists.select("root", text.alias("text")).write.partitionBy("root").text(folder)
    remove_at_exit(spark, folder)
    loaded = exploration.load_large_tasks(spark, f"{folder}/root=*/*.txt")
    return loaded.select(
        F.substring_index("root", "=", -1).alias("root"),
        "task_idx",
        "task_id",
        whole("schema_version"),
        F.coalesce(F.size("actions"), F.lit(0)).cast("bigint").alias("n_actions"),
        "goal_world",
        "success",
    )


@query("S2_union_roots")
def union_roots(spark, sf_dir):
    folder = shared_folder(spark, "roots")
    number = F.substring_index("root", "-", 1)
    side = F.when(number.isin("0", "2"), "even").otherwise("odd")
    documents = fx.exploration_documents(spark, sf_dir).select(side.alias("root"), "text")
    documents.write.partitionBy("root").text(folder)
    roots = [f"{folder}/root={name}" for name in ("odd", "absent", "even")]
    tasks = exploration.union_roots(spark, roots, document="*.txt", one_per_line=True)
    return tasks.select(
        F.substring_index("root", "=", -1).alias("root"),
        whole("root_no"),
        "task_id",
        whole("schema_version"),
        (F.count(F.lit(1)).over(Window.partitionBy("root", "document", "task_idx")) == 1).alias("unique_key"),
        "task_idx",
    )


@query("S1_corrupt_documents")
def corrupt_documents(spark, sf_dir):
    """Documents of root 1 are cut short; in root 3 actions that begin with 1 hold a word."""
    number = F.substring_index("root", "-", 1)
    cut = F.expr("substring(text, 1, length(text) div 2)")
    flawed = F.when(number == "1", cut).when(
        number == "3", F.replace("text", F.lit('"actions":[1,'), F.lit('"actions":["x",1,'))
    )
    folder = shared_folder(spark, "corrupt")
    documents = fx.exploration_documents(spark, sf_dir).withColumn("text", F.coalesce(flawed, "text"))
    # Grouping has put each document into one task.
    documents.write.partitionBy("root").text(folder)
    loaded = exploration.load_documents(spark, f"{folder}/root=*/*.txt", one_per_line=True)
    broken = validate.document_violations(loaded, [30]).select("root", F.lit(None).cast("string").alias("task_id"), "rule")
    unread = validate.violations(exploration.parse_tasks(loaded), [23], ["task_id"]).select("root", "task_id", "rule")
    return broken.unionByName(unread).withColumn("root", F.substring_index("root", "=", -1))


@query("V1_empty_document")
def empty_documents(spark, sf_dir):
    """Documents whose list of tasks is empty are checked all the same."""
    emptied = fx.exploration_documents(spark, sf_dir).select(
        "root", F.concat(F.substring_index("text", '"tasks":[', 1), F.lit('"tasks":[]}')).alias("text")
    )
    folder = shared_folder(spark, "empty")
    emptied.write.partitionBy("root").text(folder)
    loaded = exploration.load_documents(spark, f"{folder}/root=*/*.txt", one_per_line=True)
    found = validate.document_violations(loaded)
    return found.select(F.substring_index("root", "=", -1).alias("root"), "rule", "detail")


@query("S3_corrupt_items")
def corrupt_items(spark, sf_dir):
    """Every third file of conversations is cut short."""
    documents = fx.conversation_documents(spark, sf_dir)
    cut = F.expr("substring(text, 1, length(text) div 2)")
    documents = documents.withColumn("text", F.when(F.pmod("file", F.lit(3)) == 1, cut).otherwise(F.col("text")))
    folder = shared_folder(spark, "cut")
    documents.repartition("file").write.partitionBy("file").text(folder)
    path = f"{folder}/file=*/*.txt"
    lost = conversation_source.unreadable_conversations(spark, path)
    lost = lost.select("source", F.lit(0).cast("bigint").alias("items"), "reason")
    read = conversation_source.load_conversations(spark, path).groupBy("source").agg(F.count(F.lit(1)).alias("items"))
    both = lost.unionByName(read.withColumn("reason", F.lit(None).cast("string")))
    return both.select(F.regexp_extract("source", r"file=(\d+)/", 1).cast("bigint").alias("file"), "items", "reason")


@query("S3_load_conversations")
def load_conversations(spark, sf_dir):
    folder = shared_folder(spark, "conversations")
    fx.conversation_documents(spark, sf_dir).repartition("file").write.partitionBy("file").text(folder)
    items = conversation_source.load_conversations(spark, f"{folder}/file=*/*.txt")
    return conversations.flatten_items(items).select(
        F.regexp_extract("source", r"file=(\d+)/", 1).cast("bigint").alias("file"),
        "item_idx",
        "item_id",
        "video_path",
        whole("n_images"),
        F.md5("prompt").alias("prompt_md5"),
        F.md5("response").alias("response_md5"),
    )


@query("S3_load_large_conversations")
def load_large_conversations(spark, sf_dir):
    """All items in one list, which many tasks read."""
    lists = fx.conversation_documents(spark, sf_dir).groupBy().agg(F.array_sort(F.collect_list(F.struct("file", "text"))).alias("l"))
    inner = F.transform("l", lambda t: F.substring(t["text"], 2, F.length(t["text"]) - 2))
    folder = shared_folder(spark, "large-conversations")
    lists.select(F.concat(F.lit("[\n"), F.array_join(inner, ",\n"), F.lit("\n]\n")).alias("text")).coalesce(1).write.text(folder)
    remove_at_exit(spark, folder)
    items = conversation_source.load_large_conversations(spark, f"{folder}/*.txt")
    return conversations.flatten_items(items).select(
        "item_idx",
        "video_path",
        whole("n_images"),
        F.md5("prompt").alias("prompt_md5"),
        F.md5("response").alias("response_md5"),
    )


def mixed(spark, sf_dir) -> DataFrame:
    navigation = samples.build_samples(fx.nav_steps(spark, sf_dir), CONFIG)
    flat = conversations.flatten_conversation(fx.conversation_turns(spark, sf_dir))
    items = flat.select(
        F.lit("chat").alias("source"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("item_id"),
        "prompt", "response", "n_images",
    )
    return corpus.mixed_corpus(navigation, items)


@query("S7_mixed_corpus")
def mixed_corpus(spark, sf_dir):
    return mixed(spark, sf_dir).select(
        "kind", "source", "sample_id", F.md5("prompt").alias("prompt_md5"), "response",
        F.array_join("images", " ").alias("images"), whole("n_images"),
    )


@query("A4_collate")
def collate(spark, sf_dir):
    """Samples of both kinds to padded batches; word lengths stand for token ids."""
    ids = lambda name: F.transform(F.split(name, " "), lambda w: F.length(w))
    rows = mixed(spark, sf_dir).select(
        F.concat_ws("/", "kind", "source", "sample_id").alias("key"),
        F.concat(ids("prompt"), F.array(F.lit(2), F.lit(3)), ids("response"), F.array(F.lit(EOS))).alias("ids"),
        ids("response").alias("response"),
    )
    marked = batches.label_samples(
        rows, F.array(F.lit(2), F.lit(3)), F.col("response"), EOS, max_length=CONFIG.max_seq_length
    )
    # Padding reads its rows twice; these are costly to derive.
    marked = write_through(marked.select("key", "input_ids", "labels"), "marked")
    padded = batches.pad_batches(marked, "key", 8, PAD)
    return padded.select(
        "key", whole("shard"), whole("batch_id"),
        *[F.md5(joined(F.col(c))).alias(c) for c in ("input_ids", "labels", "attention_mask")],
    )


def wanted_images(spark, sf_dir) -> DataFrame:
    no_root = F.lit(None).cast("string")
    rel = image_path(no_root, F.col("scene_id"), F.col("task_id"), F.col("step"), CONFIG)
    return steps.valid_steps(fx.nav_steps(spark, sf_dir)).select(
        "root", rel.alias("rel_path"), "scene_id", "step"
    )


@query("S4_resolve_images")
def resolve_images(spark, sf_dir):
    wanted = wanted_images(spark, sf_dir)
    found = images.resolve_images(wanted, fx.image_store(wanted))
    return found.select(
        "root", "rel_path", whole("priority"), "store", "key", F.decode("bytes", "utf-8").alias("content")
    )


@query("S4_two_roots")
def resolve_images_of_two_roots(spark, sf_dir):
    """Both roots hold the same paths and keys, one of them twice."""
    rows = wanted_images(spark, sf_dir)
    wanted = rows.drop("root").withColumn("root", F.explode(F.array(F.lit("a"), F.lit("b"))))
    store = fx.image_store(rows)
    named = lambda root: F.encode(F.concat_ws(":", F.lit(root), "store", "key"), "utf-8")
    parts = [store.withColumns({"root": F.lit(r), "bytes": named(r)}) for r in ("a", "b", "b")]
    found = images.resolve_images(wanted, parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return found.select(
        "root", "rel_path", whole("priority"), "store", "key", F.decode("bytes", "utf-8").alias("content")
    )


@query("S5_check_image_files")
def check_image_files(spark, sf_dir):
    wanted = wanted_images(spark, sf_dir)
    listing = wanted.where(F.pmod("step", F.lit(4)) != 3).select(
        F.col("rel_path").alias("path"), F.pmod("step", F.lit(5)).alias("length")
    )
    return images.check_image_files(wanted.select(F.col("rel_path").alias("path")), listing)


@query("S6_corpus_counts")
def corpus_counts(spark, sf_dir):
    rows = fx.nav_steps(spark, sf_dir)
    tasks = rows.select("root", "task_idx").distinct()
    return counts.corpus_counts(tasks, indexed(spark, sf_dir).where("is_sample")).select(
        F.coalesce("root", F.lit("total")).alias("root"), "tasks", "samples"
    )


# -- projections and filters ------------------------------------------------------


@query("P1_explode_steps")
def explode_steps(spark, sf_dir):
    return steps.explode_steps(loaded_tasks(spark, sf_dir)).select(
        "task_id",
        whole("step"),
        whole("action"),
        whole("n_pix"),
        whole("n_world"),
        whole("n_vis"),
        joined(F.transform("cands", lambda c: c["px"]["u"])).alias("cand_u"),
        joined(F.transform("cands", lambda c: c["vis"])).alias("cand_vis"),
        *pixel("traj_px"),
        F.col("traj_world.x").alias("traj_x"),
        whole("traj_status"),
        "is_endpoint",
        "floor_transition",
        whole("expert_idx"),
        whole("floor_id"),
        "floor_height",
    )


def _valid(version):
    def run(spark, sf_dir):
        return indexed(spark, sf_dir, version).select("task_idx", whole("step"), whole("action"), whole("pos"))

    return run


QUERIES["P2_valid_steps_v2"] = _valid(2)
QUERIES["P2_valid_steps_v3"] = _valid(3)


@query("P3_visible_frontiers")
def visible_frontiers(spark, sf_dir):
    shown = fx.nav_steps(spark, sf_dir).withColumn("f", steps.visible_frontiers())
    return shown.select(
        "task_idx",
        whole("step"),
        F.size("f").cast("bigint").alias("n_frontiers"),
        joined(F.transform("f", lambda p: F.concat_ws(":", p["u"].cast("string"), p["v"].cast("string")))).alias(
            "frontiers"
        ),
    )


@query("P4_image_path")
def image_paths(spark, sf_dir):
    path = image_path(F.col("root"), F.col("scene_id"), F.col("task_id"), F.col("step"), CONFIG)
    far = image_path(F.col("root"), F.col("scene_id"), F.col("task_id"), F.col("step") + 9990, CONFIG)
    return fx.nav_steps(spark, sf_dir).select("task_idx", whole("step"), path.alias("path"), far.alias("far_path"))


@query("P5_action_display")
def action_displays(spark, sf_dir):
    shown = fx.numbered_events(spark, sf_dir).select("e", F.pmod("k", F.lit(6)).alias("code"))
    return shown.select(
        "e",
        action_display(F.col("code"), CONFIG).alias("name"),
        action_display(F.col("code"), NavConfig(use_action_symbols=True)).alias("symbol"),
    )


@query("P6_format_coords")
def format_coords(spark, sf_dir):
    return fx.nav_steps(spark, sf_dir).select(
        "task_idx", whole("step"), format_coord_list(F.transform("cands", lambda c: c["px"])).alias("listed")
    )


@query("P7_build_prompt")
def build_prompts(spark, sf_dir):
    rows = indexed(spark, sf_dir).where("is_sample").withColumn("f", steps.visible_frontiers())
    shown = F.least("pos", F.lit(CONFIG.max_history_frames))
    phrase = pick_conjunction(CONFIG, F.col("root"), F.col("task_idx"), F.col("step"))
    return rows.select(
        "task_idx",
        whole("step"),
        build_prompt(F.col("instruction"), F.col("f"), shown, phrase, CONFIG).alias("prompt"),
    )


@query("P8_build_response")
def build_responses(spark, sf_dir):
    rows = indexed(spark, sf_dir).where("is_sample")
    response = build_response(F.col("mode"), F.col("label"), F.col("action"), F.col("emitted"), CONFIG)
    content_only = NavConfig(prefix_trainable=False)
    rows = rows.select("task_idx", "step", "mode", response.alias("response"))
    whole_range = F.get(trainable_ranges(F.col("mode"), F.col("response"), CONFIG), F.lit(0))
    content = F.get(trainable_ranges(F.col("mode"), F.col("response"), content_only), F.lit(0))
    return rows.select(
        "task_idx",
        whole("step"),
        "response",
        whole_range["end"].cast("bigint").alias("range_end"),
        content["start"].cast("bigint").alias("content_start"),
    )


def _samples(version):
    def run(spark, sf_dir):
        rows = samples.build_samples(fx.nav_steps(spark, sf_dir, version), CONFIG)
        return rows.select(
            "root",
            "task_idx",
            whole("step"),
            "output_mode",
            "prompt",
            "response",
            F.array_join("images", " ").alias("images"),
            *pixel("label_coords"),
            joined(F.col("action_sequence")).alias("action_sequence"),
            "floor_transition",
            whole("floor_id"),
            "floor_height",
        )

    return run


QUERIES["P9_assemble_sample_v2"] = _samples(2)
QUERIES["P9_assemble_sample_v3"] = _samples(3)


@query("P10_content_parts")
def content_parts(spark, sf_dir):
    flat = conversations.flatten_conversation(fx.conversation_turns(spark, sf_dir))
    parts = conversations.content_parts(flat.select("conv_id", "prompt", "n_images"), F.col("n_images"))
    return parts.select("conv_id", whole("part"), "type", "text", whole("image_idx"))


def _endpoints(version):
    def run(spark, sf_dir):
        return fx.nav_steps(spark, sf_dir, version).select(
            "task_idx", whole("step"), steps.endpoint_flag().alias("endpoint")
        )

    return run


QUERIES["P11_endpoint_flag_v2"] = _endpoints(2)
QUERIES["P11_endpoint_flag_v3"] = _endpoints(3)


# -- validation -------------------------------------------------------------------


def parsed_tasks(spark, sf_dir) -> DataFrame:
    """Tasks parsed from the derived documents, without the detour over files."""
    documents = fx.exploration_documents(spark, sf_dir)
    parsed = F.from_json("text", exploration.DOCUMENT_SCHEMA)
    return exploration.parse_tasks(documents.select("root", parsed.alias("d")).select("root", "d.*"))


def _rule(number):
    def run(spark, sf_dir):
        tasks = parsed_tasks(spark, sf_dir)
        found = validate.violations(tasks, [number])
        return found.select("root", "task_idx", whole("step"), "rule", "detail")

    return run


RULES = {
    1: "schema_version",
    2: "generation_config",
    3: "required_keys",
    4: "goal_metadata",
    5: "no_actions",
    6: "array_lengths",
    7: "success_mismatch",
    8: "unverifiable_stop",
    9: "failed_with_stop",
    10: "transition_supervised",
    11: "invalid_endpoint",
}
for _number, _name in RULES.items():
    QUERIES[f"V{_number}_{_name}"] = _rule(_number)


@query("V12_legacy_summary")
def legacy_summary(spark, sf_dir):
    return validate.legacy_summary(parsed_tasks(spark, sf_dir))


# -- decisions ----------------------------------------------------------------------


@query("D1_closest_candidate")
def closest_candidate(spark, sf_dir):
    near = fx.nav_steps(spark, sf_dir).withColumn("near", steps.closest_candidate())
    return near.select(
        "task_idx", whole("step"), F.col("near.idx").cast("bigint").alias("idx"), rounded("near.dist", "dist")
    )


def _modes(version, config=CONFIG):
    def run(spark, sf_dir):
        return classified(spark, sf_dir, version, config).select(
            "task_idx", whole("step"), "mode", *pixel("label"), "coord_supervised"
        )

    return run


QUERIES["D2_output_mode_v2"] = _modes(2)
QUERIES["D2_output_mode_v3"] = _modes(3)
QUERIES["D3_match_threshold_3m_v2"] = _modes(2, NavConfig.training())


def _supervised(version):
    def run(spark, sf_dir):
        rows = classified(spark, sf_dir, version)
        labelled = F.coalesce(F.col("mode").isin("target", "frontier"), F.lit(False))
        return rows.groupBy("task_idx").agg(
            F.count_if("coord_supervised").alias("supervised"),
            F.count_if(labelled).alias("labelled"),
            F.count_if(F.col("coord_supervised") != labelled).alias("different"),
        )

    return run


QUERIES["D4_coord_supervised_v2"] = _supervised(2)
QUERIES["D4_coord_supervised_v3"] = _supervised(3)


# -- windows ------------------------------------------------------------------------


def _sample_index(version):
    def run(spark, sf_dir):
        return (
            indexed(spark, sf_dir, version)
            .where("is_sample")
            .select("root", "task_idx", whole("step"), "mode", whole("absorbed"), whole("emitted"))
        )

    return run


def _sequences(version):
    def run(spark, sf_dir):
        return indexed(spark, sf_dir, version).select(
            "task_idx", whole("step"), joined(samples.action_sequence()).alias("sequence")
        )

    return run


def _history(version, derive=lambda rows: rows):
    def run(spark, sf_dir):
        found = samples.sample_history(derive(fx.nav_steps(spark, sf_dir, version)), CONFIG)
        return found.select(
            "task_idx", whole("step"), F.size("history").cast("bigint").alias("frames"), joined(F.col("history")).alias("history")
        )

    return run


def long_tasks(rows: DataFrame) -> DataFrame:
    """All users of a root as one task; every change of the user is an interruption."""
    user = F.col("task_idx")
    return rows.withColumns(
        {"task_idx": F.pmod(user, F.lit(2)), "step": (user * 1000 + F.col("step")).cast("int")}
    )


for _version in (2, 3):
    QUERIES[f"W1_sample_index_v{_version}"] = _sample_index(_version)
    QUERIES[f"W2_action_sequence_v{_version}"] = _sequences(_version)
    QUERIES[f"W3_history_frames_v{_version}"] = _history(_version)
    QUERIES[f"W3_history_many_gaps_v{_version}"] = _history(_version, long_tasks)


@query("W4_video_frame_plan")
def video_frame_plan(spark, sf_dir):
    texts = fx.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("n"))
    total = F.when(F.pmod("conv_id", F.lit(9)) == 0, None).when(F.pmod("conv_id", F.lit(7)) == 0, 0).when(
        F.pmod("conv_id", F.lit(5)) == 0, F.pmod("n", F.lit(8))
    ).otherwise(F.col("n"))
    plan = conversations.video_frame_plan(texts.select("conv_id", total.cast("int").alias("total_frames")))
    return plan.select("conv_id", whole("slot"), whole("frame_no"), "is_placeholder", "reason")


# -- aggregations ---------------------------------------------------------------------


def _mode_stats(version):
    def run(spark, sf_dir):
        return samples.mode_stats(indexed(spark, sf_dir, version).where("is_sample"))

    return run


QUERIES["A1_mode_stats_v2"] = _mode_stats(2)
QUERIES["A1_mode_stats_v3"] = _mode_stats(3)


@query("A2_flatten_conversation")
def flatten_conversation(spark, sf_dir):
    flat = conversations.flatten_conversation(fx.conversation_turns(spark, sf_dir))
    return flat.select("conv_id", "prompt", "response", whole("n_images"))


def labelled(spark, sf_dir) -> DataFrame:
    marker = F.array(F.lit(2), F.lit(3))
    return batches.label_samples(fx.token_samples(spark, sf_dir), marker, F.col("response"), EOS)


@query("A3_pad_batch")
def pad_batch(spark, sf_dir):
    padded = batches.pad_batches(labelled(spark, sf_dir), "doc_id", 8, PAD)
    return padded.select(
        "doc_id",
        whole("shard"),
        whole("batch_id"),
        joined(F.col("input_ids")).alias("input_ids"),
        joined(F.col("labels")).alias("labels"),
        joined(F.col("attention_mask")).alias("attention_mask"),
    )


# -- tokens ---------------------------------------------------------------------------


@query("T1_last_subsequence")
def last_subsequences(spark, sf_dir):
    marker = F.array(F.lit(2), F.lit(3))
    return fx.token_samples(spark, sf_dir).select(
        "doc_id",
        last_subsequence(F.col("ids"), marker).cast("bigint").alias("marker_at"),
        last_subsequence(F.col("ids"), F.col("response")).cast("bigint").alias("response_at"),
        last_subsequence(F.col("ids"), F.slice("ids", 1, 0)).cast("bigint").alias("empty_at"),
    )


@query("T2_mask_labels")
def mask_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("doc_id", whole("loss_start"), joined(F.col("labels")).alias("labels"))


@query("T3_truncate_ids")
def truncated(spark, sf_dir):
    ids = truncate_ids(F.col("ids"), CONFIG.max_seq_length)
    return fx.token_samples(spark, sf_dir).select(
        "doc_id", F.size(ids).cast("bigint").alias("length"), joined(ids).alias("input_ids")
    )


@query("T4_attention_mask")
def attention(spark, sf_dir):
    return fx.token_samples(spark, sf_dir).select("doc_id", joined(attention_mask(F.col("ids"))).alias("mask"))


# -- measures ---------------------------------------------------------------------------


@query("M0_euclidean")
def euclidean_distance(spark, sf_dir):
    here = [F.col("x"), F.col("y"), F.col("z")]
    there = [F.col("distance_to_goal"), F.col("spl"), F.lit(1.0)]
    return fx.episode_steps(spark, sf_dir).select(
        "episode_id", whole("step"), rounded(euclidean(here, there), "distance")
    )


def _running(name):
    def run(spark, sf_dir):
        rows = measures.running_measures(fx.episode_steps(spark, sf_dir))
        return rows.select("episode_id", whole("step"), rounded(name))

    return run


for _id, _name in enumerate(
    ("path_length", "oracle_navigation_error", "oracle_success", "oracle_spl", "pl_ratio", "steps_taken"), 1
):
    QUERIES[f"M{_id}_{_name}"] = _running("pl" if _name == "pl_ratio" else _name)


@query("M7_measure_table")
def measure_table(spark, sf_dir):
    highest = measures.Measure("farthest_x", ("x",), F.max("x"), lambda p: F.max(p))
    table = measures.measure_table(fx.episode_steps(spark, sf_dir), extra=[highest])
    names = [c for c in table.columns if c != "episode_id"]
    return table.select("episode_id", *[rounded(n) for n in names])


def streamed_measures(spark: SparkSession, rows: DataFrame, files: int = 8) -> DataFrame:
    """Run the streaming operator over ``rows``, cut into files in any order."""
    folder = shared_folder(spark, "stream")
    rows.repartition(files, F.hash("step")).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/in")
    running = (
        stream_measures(source)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .option("path", f"{folder}/out")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("M8_stream_measures")
def streaming_measures(spark, sf_dir):
    table = finish_measures(streamed_measures(spark, fx.episode_steps(spark, sf_dir)))
    names = [c for c in table.columns if c != "episode_id"]
    return table.select("episode_id", *[rounded(n) for n in names])


def streamed_over_gaps(spark: SparkSession, rows: DataFrame, behind: DataFrame) -> DataFrame:
    """The streaming operator over ``rows``, in four files in any order, then over ``behind``, which comes too late.

    One row of a far later time ends the first run, so that the watermark passes all rows.
    """
    folder = shared_folder(spark, "gap-stream")
    end = rows.limit(1).withColumns({"episode_id": F.lit(-1).cast("bigint"), "step": F.lit(0), "at": F.timestamp_seconds(F.lit(10**9))})
    for number, parts in enumerate(((rows.repartition(4, F.hash("step")), end.coalesce(1)), (behind.coalesce(1),))):
        for k, part in enumerate(parts):
            part.write.parquet(f"{folder}/in/{number}-{k}")
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in/*")
        running = (
            stream_measures_over_gaps(source, "at", delay="1 day")
            .writeStream.format("parquet")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .option("path", f"{folder}/out")
            .trigger(availableNow=True)
            .start()
        )
        running.awaitTermination()
    remove_at_exit(spark, folder)
    return spark.read.parquet(f"{folder}/out").where("episode_id >= 0")


@query("M8_stream_measures_gaps")
def streaming_measures_gaps(spark, sf_dir):
    """A sixth of the steps is missing and a tenth comes too late; the rest counts."""
    steps_ = fx.episode_steps(spark, sf_dir).where(F.pmod("e", F.lit(6)) != 1)
    timed = steps_.withColumn("at", F.timestamp_seconds(F.col("step") * 30))
    behind = F.pmod("e", F.lit(10)) == 3
    out = streamed_over_gaps(spark, timed.where(~behind), timed.where(behind))
    table = finish_measures(out)
    names = [c for c in table.columns if c != "episode_id"]
    late = out.groupBy("episode_id").agg(F.count_if("late").alias("late_rows"))
    return late.join(table, "episode_id", "left").select("episode_id", "late_rows", *[rounded(n) for n in names])


# -- maps -----------------------------------------------------------------------------


def cells_of(layer: DataFrame) -> DataFrame:
    return layer.select("map_id", whole("row"), whole("col"), whole("code"))


@query("G1_to_grid")
def grid(spark, sf_dir):
    points = fx.map_points(spark, sf_dir).withColumns(
        {"low_x": F.lit(1.0), "low_z": F.lit(2.0), "high_x": F.lit(17.0), "high_z": F.lit(18.0), "n_rows": F.lit(48)}
    )
    return raster.to_grid(points).select("map_id", whole("step"), whole("row"), whole("col"))


@query("G2_colorize_cells")
def colorize(spark, sf_dir):
    shown = raster.colorize_cells(fx.map_cells(spark, sf_dir), raster.default_palette(spark))
    return shown.select("map_id", whole("row"), whole("col"), whole("r"), whole("g"), whole("b"))


def segments(spark, sf_dir) -> DataFrame:
    """Lines across the map: from each path point to its mirror image."""
    placed = raster.to_grid(fx.map_points(spark, sf_dir))
    return placed.select(
        "map_id",
        "step",
        F.col("row").alias("row1"),
        F.col("col").alias("col1"),
        (63 - F.col("col")).alias("row2"),
        F.col("row").alias("col2"),
    )


def _drawn(style, gap):
    def run(spark, sf_dir):
        cells = raster.densify_segment(segments(spark, sf_dir), style, gap)
        return cells.select("map_id", whole("step"), whole("row"), whole("col"))

    return run


QUERIES["G3_densify_segment_dotted"] = _drawn("dotted", raster.DOT_GAP)
QUERIES["G3_densify_segment_dashed"] = _drawn("dashed", raster.PATH_GAP)
QUERIES["G3_densify_segment_filled"] = _drawn("filled", 1)


@query("G4_stamp_square")
def stamp_squares(spark, sf_dir):
    cells = raster.stamp_square(raster.to_grid(fx.map_points(spark, sf_dir)))
    return cells.select("map_id", whole("step"), whole("row"), whole("col"))


@query("G5_stamp_triangle")
def stamp_triangles(spark, sf_dir):
    cells = raster.stamp_triangle(raster.to_grid(fx.map_points(spark, sf_dir)))
    return cells.select("map_id", whole("step"), whole("row"), whole("col"))


@query("G6_reference_path_layer")
def reference_path(spark, sf_dir):
    return cells_of(raster.reference_path_layer(fx.map_points(spark, sf_dir)))


@query("G7_straight_path_layer")
def straight_path(spark, sf_dir):
    return cells_of(raster.straight_path_layer(fx.map_points(spark, sf_dir)))


def broken_paths(spark, sf_dir) -> DataFrame:
    """Paths with missing steps."""
    return fx.map_points(spark, sf_dir).where((F.pmod("step", F.lit(5)) != 2) & (F.col("step") != 7))


@query("G6_reference_path_gaps")
def reference_path_gaps(spark, sf_dir):
    return cells_of(raster.reference_path_layer(broken_paths(spark, sf_dir)))


@query("G7_straight_path_gaps")
def straight_path_gaps(spark, sf_dir):
    return cells_of(raster.straight_path_layer(broken_paths(spark, sf_dir)))


def end_points(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    points = fx.map_points(spark, sf_dir)
    goals = points.where("step in (5, 7)").withColumn("goal_no", (F.col("step") - 5) / 2)
    return points.where("step = 0"), goals


@query("G8_endpoints_layer")
def endpoints(spark, sf_dir):
    return cells_of(raster.endpoints_layer(*end_points(spark, sf_dir)))


def _waypoints(kind):
    def run(spark, sf_dir):
        return cells_of(raster.waypoint_layer(fx.map_points(spark, sf_dir, shift=-2.5), kind))

    return run


QUERIES["G9_waypoint_layer_prediction"] = _waypoints("prediction")
QUERIES["G9_waypoint_layer_oracle"] = _waypoints("oracle")


@query("G10_nearest_node")
def nearest(spark, sf_dir):
    nodes = fx.graph_nodes(spark, sf_dir)
    points = nodes.select("scene_id", F.col("node_id").alias("point_id"), (F.col("x") + 0.05).alias("x"), "z")
    found = graph.nearest_node(points, nodes, ["point_id"])
    return found.select("point_id", "node_id", rounded("distance"))


@query("G10_nearest_node_deep")
def nearest_deep(spark, sf_dir):
    nodes = fx.graph_nodes(spark, sf_dir)
    points = nodes.select("scene_id", F.col("node_id").alias("point_id"), (F.col("x") + 0.05).alias("x"), "z")
    return graph.nearest_node(points, nodes, ["point_id"], leaf_nodes=1).select("point_id", "node_id", rounded("distance"))


@query("G10_points_without_nodes")
def nearest_of_few(spark, sf_dir):
    nodes, p = fx.graph_nodes(spark, sf_dir), F.col("node_id")
    points = nodes.select(
        F.when(F.pmod(p, F.lit(5)) == 0, "nowhere").otherwise(F.col("scene_id")).alias("scene_id"),
        p.alias("point_id"),
        F.when(F.pmod(p, F.lit(7)) != 0, F.col("x") + 0.05).alias("x"),
        "z",
    )
    flawed = nodes.withColumn("x", F.when(F.pmod(p, F.lit(3)) != 0, F.col("x")))
    found = graph.nearest_node(points, flawed, ["point_id"])
    return found.select("point_id", "node_id", rounded("distance"))


def tracking_inputs(spark, sf_dir):
    nodes, walks = fx.graph_nodes(spark, sf_dir), fx.graph_walks(spark, sf_dir)
    starts = graph.nearest_node(walks.where("step = 0"), nodes, ["episode_id"]).select("episode_id", "node_id")
    return walks, nodes, fx.graph_edges(nodes), starts


@query("G11_track_nearest_node")
def track(spark, sf_dir):
    tracked = graph.track_nearest_node(*tracking_inputs(spark, sf_dir))
    return tracked.select("episode_id", whole("step"), "node_id")


@query("G11_track_tiles")
def track_tiles(spark, sf_dir):
    """Scenes in tiles of 16 nodes and episodes in blocks of 50 rows."""
    tracked = graph.track_nearest_node(*tracking_inputs(spark, sf_dir), block_rows=50, tile_nodes=16)
    return tracked.select("episode_id", whole("step"), "node_id")


@query("G11_track_gaps")
def track_gaps(spark, sf_dir):
    """Late starts, missing steps, whole missing blocks, and episodes without a start."""
    walks, nodes, edges, starts = tracking_inputs(spark, sf_dir)
    e, step = F.col("episode_id"), F.col("step")
    gone = step.between(14, 40) | ((F.pmod(e, F.lit(3)) == 0) & (step < 5)) | (F.pmod(step, F.lit(11)) == 3)
    started = starts.where(F.pmod(e, F.lit(5)) != 4)
    tracked = graph.track_nearest_node(walks.where(~gone), nodes, edges, started, block_rows=8)
    return tracked.select("episode_id", whole("step"), "node_id")


@query("G12_same_floor_nodes")
def same_floor(spark, sf_dir):
    nodes = fx.graph_nodes(spark, sf_dir)
    starts = nodes.groupBy("scene_id").agg(
        (F.min_by("x", "node_order") + 0.05).alias("x"), F.min_by("z", "node_order").alias("z")
    )
    maps = starts.select(
        F.col("scene_id").alias("map_id"),
        *[F.lit(v).alias(n) for n, v in (("low_x", -0.4), ("low_z", -0.4), ("high_x", 0.4), ("high_z", 0.4))],
        F.lit(64).alias("n_rows"),
        F.lit(64).alias("n_cols"),
        F.lit(0.125).alias("metres_per_cell"),
    )
    starts = starts.withColumn("map_id", F.col("scene_id"))
    return cells_of(graph.same_floor_nodes(starts, nodes, fx.scene_cells(spark, sf_dir), maps))


def _resized(rows, cols):
    def run(spark, sf_dir):
        small = raster.resize_area(fx.raster(spark, sf_dir), rows, cols)
        return small.select("map_id", whole("out_row"), whole("out_col"), rounded("value"))

    return run


QUERIES["G13_resize_area_4x4"] = _resized(4, 4)
QUERIES["G13_resize_area_3x5"] = _resized(3, 5)


@query("G14_compose_layers")
def compose(spark, sf_dir):
    points = fx.map_points(spark, sf_dir)
    layers = [
        raster.straight_path_layer(points),
        raster.endpoints_layer(*end_points(spark, sf_dir)),
        raster.waypoint_layer(fx.map_points(spark, sf_dir, shift=-2.5), "oracle"),
    ]
    return cells_of(raster.compose_layers(layers))


# -- recovery ---------------------------------------------------------------------------


@query("R1_resample_failed")
def resample_failed(spark, sf_dir):
    rows = write_through(indexed(spark, sf_dir).where("is_sample").select("task_idx", "step", "mode"), "samples")
    failed = F.pmod("step", F.lit(4)) == 3
    kept = images.resample_failed(rows, failed, ["task_idx", "step"])
    drawn = F.col("task_idx") != F.col("from_task_idx")
    drawn = drawn | (F.col("step") != F.col("from_step"))
    return kept.select(
        "task_idx",
        whole("step"),
        "mode",
        F.col("from_task_idx"),
        whole("from_step"),
        drawn.alias("replaced"),
    )
