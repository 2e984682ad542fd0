"""From classified steps to training samples.

``index_steps`` does all work that needs neighbours of a step (position among
the valid steps, de-duplication, action sequence, history) in one shuffle by
(task, block); see :mod:`trailframe.operators.blocks`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.config import OUTPUT_MODES, STOP_ACTION, NavConfig
from trailframe.functions.geometry import spread_index
from trailframe.functions.text import (
    build_prompt,
    build_response,
    image_path,
    pick_conjunction,
    trainable_ranges,
)
from trailframe.operators.blocks import (
    BLOCK,
    BLOCK_ROWS,
    across_blocks,
    attach_carry,
    preceding,
    running,
    with_block,
    within_block,
)
from trailframe.operators.steps import (
    classify_steps,
    task_keys,
    valid_steps,
    visible_frontiers,
)

# A task whose valid steps have at most this many interruptions carries their
# list in the row; beyond it the history is looked up with a join.
MAX_CARRIED_GAPS = 64


def _run_length(following: Column, goes_on) -> Column:
    """How many rows at the head of ``following`` satisfy ``goes_on``."""
    stop = F.array_position(F.transform(following, goes_on), False)
    return F.when(stop == 0, F.size(following)).otherwise(stop - 1).cast("int")


def index_steps(
    steps: DataFrame,
    config: NavConfig | None = None,
    block_rows: int = BLOCK_ROWS,
    max_carried_gaps: int = MAX_CARRIED_GAPS,
) -> DataFrame:
    """Valid steps with ``pos``, ``is_sample``, ``absorbed``, ``emitted``, ``gaps``
    and ``first_step``, the task's first valid step.

    * ``pos``: position among the task's valid steps.
    * ``is_sample``: false for a step that an earlier *action* step absorbs: it
      takes up to L following steps of mode *action* with the same code.
    * ``absorbed``: steps the sample stands for, itself included.
    * ``emitted``: length of the step's action sequence; it ends at another
      action, another floor-transition flag or a coordinate-supervised step.
    * ``gaps``: where invalid steps lie, ``array<struct<pos, by>>``: from valid
      position ``pos`` on, step numbers run ahead by ``by`` more.  Null for a
      task with more than ``max_carried_gaps``.
    """
    config = config or NavConfig()
    keys, ahead = task_keys(steps), config.max_action_lookahead
    local = within_block(keys, "step")
    state = F.struct(
        "action", "floor_transition", "coord_supervised", (F.col("mode") == "action").alias("moves")
    )
    rows = with_block(valid_steps(steps), "step", block_rows).withColumn("_state", state)

    same_run = lambda a, b: a["moves"] & b["moves"] & (a["action"] == b["action"])
    rows = rows.select(
        "*",
        (F.row_number().over(local) - 1).alias("_lpos"),
        F.lag("_state").over(local).alias("_prev"),
        F.lag("step").over(local).alias("_prev_step"),
        F.collect_list("_state").over(local.rowsBetween(1, ahead)).alias("_next")
        if ahead > 0
        else F.slice(F.array("_state"), 1, 0).alias("_next"),
    )
    new_run = F.col("_prev").isNotNull() & ~same_run(F.col("_prev"), F.col("_state"))
    skipped = F.col("step") - F.col("_prev_step") - 1
    rows = rows.select(
        "*",
        F.when(new_run, F.col("_lpos")).alias("_run_here"),
        F.when(skipped > 0, F.struct(F.col("_lpos").alias("pos"), skipped.alias("by"))).alias("_gap"),
    ).withColumn("_run_start", F.max("_run_here").over(running(keys, "step")))

    first_rows = F.collect_list(
        F.when(F.col("_lpos") < ahead, F.struct(F.col("_lpos"), F.col("_state")))
    )
    aggregates = [
        F.count(F.lit(1)).alias("_n"),
        F.min_by("_state", "step").alias("_head"),
        F.max_by("_state", "step").alias("_tail"),
        F.min("step").alias("_head_step"),
        F.max("step").alias("_tail_step"),
        F.max("_run_here").alias("_last_run"),
        F.transform(F.array_sort(first_rows), lambda r: r["_state"]).alias("_firsts"),
        F.count("_gap").alias("_n_gaps"),
        F.collect_list("_gap").alias("_gaps"),
    ]

    def carry(summary: DataFrame) -> DataFrame:
        ordered = across_blocks(keys)
        whole = Window.partitionBy(*keys)
        spread = ordered.rowsBetween(1, ahead) if ahead > 0 else None
        linked = summary.select(
            "*",
            F.coalesce(F.sum("_n").over(preceding(keys)), F.lit(0)).alias("_offset"),
            F.lag("_tail").over(ordered).alias("_before"),
            F.coalesce(F.lag("_tail_step").over(ordered), F.lit(-1)).alias("_before_step"),
            (F.slice(F.flatten(F.collect_list("_firsts").over(spread)), 1, ahead) if spread is not None else F.slice("_firsts", 1, 0)).alias("_after"),
        )
        joins_on = F.coalesce(same_run(F.col("_before"), F.col("_head")), F.lit(False))
        head_gap = F.col("_head_step") - F.col("_before_step") - 1
        shifted = F.transform(
            "_gaps", lambda g: F.struct((g["pos"] + F.col("_offset")).alias("pos"), g["by"].alias("by"))
        )
        opening = F.when(
            head_gap > 0, F.array(F.struct(F.col("_offset").alias("pos"), head_gap.alias("by")))
        )
        linked = linked.select(
            "*",
            F.when(~joins_on, F.col("_offset")).alias("_opens"),
            F.sum(F.col("_n_gaps") + (head_gap > 0).cast("int")).over(whole).alias("_task_gaps"),
            F.when(head_gap > 0, F.concat(opening, shifted)).otherwise(shifted).alias("_all_gaps"),
        )
        last = F.coalesce(F.col("_offset") + F.col("_last_run"), F.col("_opens"))
        earlier = F.max(last).over(preceding(keys))
        few = F.col("_task_gaps") <= max_carried_gaps
        gathered = F.collect_list(
            F.when(few & (F.size("_all_gaps") > 0), F.col("_all_gaps"))
        ).over(whole)
        return linked.select(
            *keys,
            BLOCK,
            "_offset",
            "_after",
            F.coalesce("_opens", earlier).alias("_carried_start"),
            F.when(few, F.flatten(gathered)).alias("gaps"),
            F.min("_head_step").over(whole).alias("first_step"),
        )

    rows = attach_carry(rows, keys, aggregates, carry)
    start = F.coalesce(F.col("_run_start") + F.col("_offset"), F.col("_carried_start"))
    following = F.slice(F.concat("_next", "_after"), 1, max(ahead, 0))
    here = F.col("_state")
    absorbs = _run_length(following, lambda s: same_run(here, s))
    emits = _run_length(
        following,
        lambda s: (s["floor_transition"] == here["floor_transition"])
        & ~s["coord_supervised"]
        & (s["action"] == here["action"]),
    )
    rows = rows.withColumn("pos", (F.col("_offset") + F.col("_lpos")).cast("int"))
    kept = (F.col("mode") != "action") | (F.pmod(F.col("pos") - start, F.lit(ahead + 1)) == 0)
    return rows.select(
        *[c for c in steps.columns],
        "pos",
        kept.alias("is_sample"),
        F.when(F.col("mode") == "action", absorbs + 1).otherwise(1).alias("absorbed"),
        F.when(F.col("action") == STOP_ACTION, 1).otherwise(emits + 1).alias("emitted"),
        "gaps",
        "first_step",
    )


def action_sequence() -> Column:
    """The step's action, repeated ``emitted`` times."""
    return F.array_repeat("action", F.col("emitted"))


# -- history ----------------------------------------------------------------


def history_positions(config: NavConfig) -> Column:
    """Valid positions to show as history of the step at ``pos``."""
    frames, n = config.max_history_frames, F.col("pos")
    nothing = F.array().cast("array<int>")
    if frames <= 0:
        return nothing
    every = F.sequence(F.lit(0), n - 1)
    thinned = F.transform(
        F.sequence(F.lit(0), F.lit(frames - 1)), lambda slot: spread_index(slot, n, frames)
    )
    return F.when(n == 0, nothing).when(n <= frames, every).otherwise(thinned)


def _step_at(position: Column) -> Column:
    """Step number of a valid position, from the carried gap list."""
    shift = F.aggregate(
        "gaps",
        F.lit(0).cast("bigint"),
        lambda acc, gap: acc + F.when(gap["pos"] <= position, gap["by"]).otherwise(0),
    )
    return (position + shift).cast("int")


def has_uncarried_gaps(steps: DataFrame, max_carried_gaps: int = MAX_CARRIED_GAPS) -> bool:
    """Whether some task has more interruptions than its rows carry.

    Reads key, step and action only, and aggregates before it shuffles.
    """
    numbers = valid_steps(steps).groupBy(*task_keys(steps)).agg(
        (F.max("step") + 1 - F.count(F.lit(1))).alias("missing")
    )
    crowded = numbers.where(F.col("missing") > max_carried_gaps)
    return not crowded.isEmpty()


def _wanted(indexed: DataFrame, config: NavConfig, samples_only: bool) -> DataFrame:
    rows = indexed.where("is_sample") if samples_only else indexed
    return rows.withColumn("_wanted", history_positions(config))


def _carried_history(wanted: DataFrame) -> DataFrame:
    return wanted.withColumn("history", F.transform("_wanted", _step_at)).drop("_wanted")


def with_history(indexed: DataFrame, config: NavConfig | None = None, samples_only: bool = True) -> DataFrame:
    """Add ``history``: the earlier steps shown with a sample, oldest first.

    Rows with a gap list need no lookup.  The others (tasks with very many
    invalid steps) are joined on (task, position); their first position, which
    every row of a task wants, is taken out of the join so that no key is hot.
    """
    config = config or NavConfig()
    keys = task_keys(indexed)
    wanted = _wanted(indexed, config, samples_only)
    easy = _carried_history(wanted.where(F.col("gaps").isNotNull()))
    hard = wanted.where(F.col("gaps").isNull())
    places = indexed.where(F.col("gaps").isNull()).select(*keys, "pos", F.col("step").alias("_at"))
    slots = hard.select(*keys, "step", F.posexplode("_wanted").alias("_slot", "pos")).where("pos > 0")
    found = (
        slots.join(places, [*keys, "pos"])
        .groupBy(*keys, "step")
        .agg(F.array_sort(F.collect_list(F.struct("_slot", "_at"))).alias("_found"))
    )
    rest = F.transform(F.coalesce("_found", F.array().cast(found.schema["_found"].dataType)), lambda s: s["_at"])
    first_slots = F.size(F.filter("_wanted", lambda p: p == 0))
    looked_up = (
        hard.join(found, [*keys, "step"], "left")
        .withColumn("history", F.concat(F.array_repeat("first_step", first_slots), rest))
    )
    return easy.unionByName(looked_up.select(*easy.columns))


def sample_history(
    steps: DataFrame,
    config: NavConfig | None = None,
    max_carried_gaps: int = MAX_CARRIED_GAPS,
    samples_only: bool = True,
    **options,
) -> DataFrame:
    """Classified, indexed steps with their history.

    The interruptions of all tasks are counted first; the lookup is planned
    exactly if some task has more than its rows carry.
    """
    config = config or NavConfig()
    indexed = index_steps(classify_steps(steps, config), config, max_carried_gaps=max_carried_gaps, **options)
    if has_uncarried_gaps(steps, max_carried_gaps):
        return with_history(indexed, config, samples_only)
    return _carried_history(_wanted(indexed, config, samples_only))


# -- samples ----------------------------------------------------------------


def assemble_samples(with_hist: DataFrame, config: NavConfig | None = None) -> DataFrame:
    """The sample table: prompt, response, images, label and metadata."""
    config = config or NavConfig()
    path = lambda step: image_path(
        F.col("root"), F.col("scene_id"), F.col("task_id"), step, config
    )
    keys = [F.col("root"), F.col("task_idx"), F.col("step")]
    return (
        with_hist.withColumn("frontiers", visible_frontiers())
        .withColumn("_says", pick_conjunction(config, *keys))
        .select(
            *task_keys(with_hist),
            "step",
            "scene_id",
            "task_id",
            "instruction",
            F.col("mode").alias("output_mode"),
            build_prompt(
                F.col("instruction"), F.col("frontiers"), F.size("history"), F.col("_says"), config
            ).alias("prompt"),
            build_response(
                F.col("mode"), F.col("label"), F.col("action"), F.col("emitted"), config
            ).alias("response"),
            F.col("label").alias("label_coords"),
            F.when(F.col("mode") == "action", action_sequence()).alias("action_sequence"),
            "history",
            F.concat(F.transform("history", path), F.array(path(F.col("step")))).alias("images"),
            F.transform("cands", lambda c: F.struct(c["px"].alias("px"), c["vis"].alias("vis"))).alias(
                "all_candidates"
            ),
            "traj_px",
            "floor_id",
            "floor_height",
            "floor_transition",
        )
        .withColumn(
            "trainable_ranges", trainable_ranges(F.col("output_mode"), F.col("response"), config)
        )
    )


def mode_stats(samples: DataFrame, column: str = "mode") -> DataFrame:
    """Samples per output mode; the four modes always appear."""
    counts = samples.agg(
        *[F.count_if(F.col(column) == mode).alias(mode) for mode in OUTPUT_MODES]
    )
    pairs = F.array(
        *[F.struct(F.lit(m).alias("mode"), F.col(m).alias("samples")) for m in OUTPUT_MODES]
    )
    return counts.select(F.inline(pairs))


def sample_index(steps: DataFrame, config: NavConfig | None = None, **options) -> DataFrame:
    """Classified, de-duplicated steps: the rows that become samples."""
    return index_steps(classify_steps(steps, config), config, **options).where("is_sample")


def build_samples(steps: DataFrame, config: NavConfig | None = None, **options) -> DataFrame:
    """Steps to finished samples."""
    return assemble_samples(sample_history(steps, config, **options), config)
