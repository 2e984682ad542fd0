"""Load rules for exploration data.

Every rule is a row-wise check of one task (or one step of it).  ``violations``
lists ``(root, task_idx, rule_no, rule, step, detail)``; the number keeps the
order in which a strict loader would meet the rules, so that the first error of
a document is its smallest ``(task_idx, rule_no)``.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.config import CURRENT_SCHEMA, STOP_ACTION
from trailframe.functions.geometry import is_finite
from trailframe.functions.let import bind_all
from trailframe.operators.steps import task_keys

# ---------------------------------------------------------------------------
# What a schema-3 document must hold.
# ---------------------------------------------------------------------------
REQUIRED_SETTINGS = (
    "waypoint_radius_m",
    "stop_radius_m",
    "endpoint_target_radius_m",
    "min_unexplored_area_m2",
    "expert_candidate_match_distance_m",
    "trajectory_sample_interval_m",
    "update_interval",
)
REQUIRED_KEYS = (
    "goal_world",
    "termination_reason",
    "success",
    "final_geodesic_distance",
    "trajectory_goal_distances",
    "trajectory_is_endpoint",
    "expert_candidate_indices",
)
ALIGNED_ARRAYS = (
    "topdown_coords",
    "pixel_coords",
    "world_coords",
    "visibility_status",
    "history_info",
    "trajectory_pixel",
    "trajectory_world",
    "trajectory_status",
    "trajectory_goal_distances",
    "trajectory_is_endpoint",
    "actions",
    "floor_ids",
    "floor_heights",
    "floor_transition",
    "expert_candidate_indices",
)
LEGACY_ARRAYS = (
    "pixel_coords",
    "world_coords",
    "visibility_status",
    "trajectory_pixel",
    "trajectory_world",
    "trajectory_status",
)
REACHED_GOAL = "reached_goal"
# ---------------------------------------------------------------------------


def _names(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _step_count() -> Column:
    return F.coalesce(F.size("actions"), F.lit(0))


def _reached() -> Column:
    return F.coalesce(F.col("termination_reason") == REACHED_GOAL, F.lit(False))


def _stop_steps() -> Column:
    numbered = F.transform("actions", lambda a, i: F.struct(a.alias("a"), i.alias("i")))
    return F.transform(
        F.filter(numbered, lambda s: F.coalesce(s["a"] == STOP_ACTION, F.lit(False))), lambda s: s["i"]
    )


STEP_ARRAYS = (
    "floor_transition",
    "pixel_coords",
    "visibility_status",
    "trajectory_pixel",
    "expert_candidate_indices",
    "trajectory_is_endpoint",
    "trajectory_goal_distances",
)


def _steps_where(condition: Callable[[Column, Column], Column]) -> Column:
    """Step numbers of a task that satisfy ``condition(step, endpoint radius)``.

    The arrays are zipped first, so that a condition reads the fields of its
    own element only.
    """

    def matching(task: Column) -> Column:
        numbered = F.transform(
            F.slice(task["steps"], 1, task["n"]), lambda s, i: F.struct(s.alias("s"), i.alias("i"))
        )
        hits = F.filter(numbered, lambda e: condition(e["s"], task["radius"]))
        return F.transform(hits, lambda e: e["i"])

    empty = [F.coalesce(F.col(a), F.array()).alias(a) for a in STEP_ARRAYS]
    return bind_all(
        matching,
        steps=F.arrays_zip(*empty),
        n=_step_count(),
        radius=F.col("generation_config.endpoint_target_radius_m"),
    )


def _is_true(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def _transition_conflict(step: Column, _: Column) -> Column:
    supervised = (
        _is_true(F.size(step["pixel_coords"]) > 0)
        | step["trajectory_pixel"].isNotNull()
        | step["expert_candidate_indices"].isNotNull()
        | _is_true(step["trajectory_is_endpoint"])
    )
    return _is_true(step["floor_transition"]) & supervised


def _bad_endpoint(step: Column, radius: Column) -> Column:
    distance = step["trajectory_goal_distances"]
    near = is_finite(distance) & _is_true(distance <= radius)
    return _is_true(step["trajectory_is_endpoint"]) & ~near


def _hidden_label(step: Column, _: Column) -> Column:
    """A visible candidate without a pixel, which no sample can use as label."""
    pairs = F.arrays_zip(step["pixel_coords"].alias("px"), step["visibility_status"].alias("vis"))
    return _is_true(F.exists(pairs, lambda c: c["px"].isNull() & _is_true(c["vis"] == 0)))


def _rules() -> list[tuple[int, str, Column, Column, Column | None]]:
    """``(number, name, broken?, detail, steps)``; checked for every task."""
    v3 = F.col("schema_version") == CURRENT_SCHEMA
    n = _step_count()
    stops = _stop_steps()
    missing_settings = F.array_sort(
        F.array_except(_names(REQUIRED_SETTINGS), F.coalesce("config_keys", F.array().cast("array<string>")))
    )
    missing_keys = F.filter(_names(REQUIRED_KEYS), lambda k: ~F.array_contains("keys", k))
    wrong_length = F.filter(
        _names(ALIGNED_ARRAYS), lambda k: F.coalesce(F.col("lengths")[k] != n, F.lit(True))
    )
    final = F.col("final_geodesic_distance")
    stop_radius = F.col("generation_config.stop_radius_m")
    good_stop = (
        (stops == F.array(n - 1)) & is_finite(final) & F.coalesce(final <= stop_radius, F.lit(False))
    )
    unidentified = F.filter(_names(("scene_id", "task_id")), lambda k: ~F.array_contains("keys", k))
    nothing = F.lit(None).cast("string")
    transitions, endpoints = _steps_where(_transition_conflict), _steps_where(_bad_endpoint)
    hidden = _steps_where(_hidden_label)
    return [
        (1, "schema_version", F.col("schema_version") > CURRENT_SCHEMA, F.col("schema_version").cast("string"), None),
        (2, "generation_config", v3 & (F.size(missing_settings) > 0), F.array_join(missing_settings, ", "), None),
        (3, "required_keys", v3 & (F.size(missing_keys) > 0), F.array_join(missing_keys, ", "), None),
        (
            4,
            "goal_metadata",
            v3 & (F.col("goal_world").isNull() | F.col("termination_reason").isNull()),
            nothing,
            None,
        ),
        (5, "no_actions", v3 & (n == 0), nothing, None),
        (6, "array_lengths", v3 & (F.size(wrong_length) > 0), F.array_join(wrong_length, ", "), None),
        (
            7,
            "success_mismatch",
            v3 & (F.coalesce("success", F.lit(False)) != _reached()),
            F.col("termination_reason"),
            None,
        ),
        (8, "unverifiable_stop", v3 & _reached() & ~good_stop, F.array_join(stops, ", "), None),
        (9, "failed_with_stop", v3 & ~_reached() & (F.size(stops) > 0), F.array_join(stops, ", "), None),
        (10, "transition_supervised", v3 & (F.size(transitions) > 0), nothing, transitions),
        (11, "invalid_endpoint", v3 & (F.size(endpoints) > 0), nothing, endpoints),
        (20, "missing_identity", F.size(unidentified) > 0, F.array_join(unidentified, ", "), None),
        (21, "fractional_number", F.col("has_fraction"), nothing, None),
        (22, "visible_without_pixel", F.size(hidden) > 0, nothing, hidden),
        (23, "unreadable_field", F.size("unreadable") > 0, F.array_join("unreadable", ", "), None),
    ]


def _each(steps: Column, entry: Callable[[Column], Column]) -> Column:
    return F.transform(steps, lambda s: entry(s))


def _entries(rules: Collection[int] | None) -> Column:
    """The broken rules of a task; only those asked for are evaluated."""
    entries = []
    for number, name, broken, detail, steps in _rules():
        if rules is not None and number not in rules:
            continue

        def entry(step: Column, number=number, name=name, detail=detail) -> Column:
            return F.struct(
                F.lit(number).alias("rule_no"),
                F.lit(name).alias("rule"),
                step.alias("step"),
                detail.alias("detail"),
            )

        rows = (
            F.array(entry(F.lit(None).cast("int")))
            if steps is None
            else _each(steps, entry)
        )
        entries.append(F.when(_is_true(broken), rows))
    return F.flatten(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def violations(tasks: DataFrame, rules: Collection[int] | None = None, keep: Collection[str] = ()) -> DataFrame:
    """All broken rules, or those of ``rules``; rules 10, 11 and 22 give one row per step.

    The columns ``keep`` of the task follow its keys.
    """
    return tasks.select(*task_keys(tasks), *keep, F.inline(_entries(rules)))


def document_violations(documents: DataFrame, rules: Collection[int] | None = None) -> DataFrame:
    """Broken rules of whole documents: ``root, document, rule_no, rule, detail``.

    ``documents`` as :func:`trailframe.sources.exploration.load_documents` gives
    them.  A document without tasks is checked as well; rule 30 marks one that
    is no readable JSON or has no list of tasks, whose tasks are lost.
    """
    version = F.coalesce("schema_version", F.lit(1))
    keys = F.coalesce(F.json_object_keys("generation_config"), F.array().cast("array<string>"))
    missing = F.array_sort(F.array_except(_names(REQUIRED_SETTINGS), keys))
    unreadable = F.col("corrupt").isNotNull() | F.col("tasks").isNull()
    checks = [
        (1, "schema_version", version > CURRENT_SCHEMA, version.cast("string")),
        (2, "generation_config", (version == CURRENT_SCHEMA) & (F.size(missing) > 0), F.array_join(missing, ", ")),
        (30, "unreadable_document", unreadable, F.lit(None).cast("string")),
    ]
    entries = [
        F.when(
            _is_true(broken if number == 30 else broken & ~unreadable),
            F.struct(F.lit(number).alias("rule_no"), F.lit(name).alias("rule"), detail.alias("detail")),
        )
        for number, name, broken, detail in checks
        if rules is None or number in rules
    ]
    return documents.select("root", "document", F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))


def first_errors(tasks: DataFrame) -> DataFrame:
    """The error at which a strict loader stops, per root."""
    found = violations(tasks)
    return found.groupBy("root").agg(
        F.min(F.struct("task_idx", "rule_no", "step", "rule", "detail")).alias("first")
    ).select("root", "first.*")


def validate(tasks: DataFrame, mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """``(accepted tasks, violations)``.

    ``fail`` raises on the first violation; ``quarantine`` leaves the tasks
    concerned out; ``report`` leaves the tasks as they are.
    """
    if mode not in ("fail", "quarantine", "report"):
        raise ValueError(f"unknown mode {mode!r}")
    found = violations(tasks)
    if mode == "fail":
        first = found.orderBy(*task_keys(tasks), "rule_no", "step").first()
        if first is not None:
            raise ValueError(f"task {first['task_idx']} of {first['root']}: {first['rule']} {first['detail'] or ''}")
    if mode == "quarantine":
        return tasks.where(F.size(_entries(None)) == 0), found
    return tasks, found


def legacy_summary(tasks: DataFrame) -> DataFrame:
    """What older documents lose: one row over all tasks below schema 3."""
    n = _step_count()
    shifted = F.exists(
        _names(LEGACY_ARRAYS), lambda k: F.coalesce(F.col("lengths")[k] != n, F.lit(False))
    )
    targets = F.size(F.filter("trajectory_pixel", lambda p: p.isNotNull()))
    return tasks.where(F.col("schema_version") < CURRENT_SCHEMA).agg(
        F.coalesce(F.sum(F.size(_stop_steps())), F.lit(0)).cast("bigint").alias("skipped_stops"),
        F.coalesce(F.sum(F.greatest(targets, F.lit(0))), F.lit(0)).cast("bigint").alias("disabled_target_frames"),
        F.count_if((n == 0) | shifted).alias("abnormal_tasks"),
    )
