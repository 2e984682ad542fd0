"""Exploration documents: one JSON object with a list of tasks.

A document stays raw JSON until it has been split into tasks, because the
checks need to tell a missing key from a null and from an empty value.  A
multi-line JSON file is read by one task; many roots are read in parallel.
Files that one task cannot hold are read by many with :func:`load_large_tasks`;
documents written one per line (``one_per_line=True``) are split by Spark.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.session import path_exists, write_through
from trailframe.sources.json_elements import json_elements, with_documents

# ---------------------------------------------------------------------------
# Names in the document format.
# ---------------------------------------------------------------------------
DOCUMENT_FILE = "exploration_data.json"
DOCUMENT_SCHEMA = "schema_version INT, generation_config STRING, tasks ARRAY<STRING>, corrupt STRING"
GENERATION_SCHEMA = (
    "waypoint_radius_m DOUBLE, stop_radius_m DOUBLE, endpoint_target_radius_m DOUBLE, "
    "min_unexplored_area_m2 DOUBLE, expert_candidate_match_distance_m DOUBLE, "
    "trajectory_sample_interval_m DOUBLE, update_interval DOUBLE"
)
TASK_SCHEMA = (
    "scene_id STRING, task_id STRING, instruction STRING, goal_world STRING, "
    "termination_reason STRING, success BOOLEAN, final_geodesic_distance DOUBLE, "
    "actions ARRAY<DOUBLE>, topdown_coords ARRAY<STRING>, pixel_coords ARRAY<ARRAY<ARRAY<DOUBLE>>>, "
    "world_coords ARRAY<ARRAY<ARRAY<DOUBLE>>>, visibility_status ARRAY<ARRAY<DOUBLE>>, "
    "history_info ARRAY<STRING>, trajectory_pixel ARRAY<ARRAY<DOUBLE>>, "
    "trajectory_world ARRAY<ARRAY<DOUBLE>>, trajectory_status ARRAY<DOUBLE>, "
    "trajectory_goal_distances ARRAY<DOUBLE>, trajectory_is_endpoint ARRAY<BOOLEAN>, "
    "floor_ids ARRAY<DOUBLE>, floor_heights ARRAY<DOUBLE>, floor_transition ARRAY<BOOLEAN>, "
    "expert_candidate_indices ARRAY<DOUBLE>"
)
# ---------------------------------------------------------------------------
_WHOLE_NUMBERS = ("actions", "trajectory_status", "floor_ids", "expert_candidate_indices")


def _pixel(point: Column) -> Column:
    pixel = F.struct(
        F.get(point, F.lit(0)).cast("bigint").alias("u"), F.get(point, F.lit(1)).cast("bigint").alias("v")
    )
    return F.when(point.isNotNull(), pixel)


def _point(point: Column) -> Column:
    axes = [F.get(point, F.lit(i)).alias(name) for i, name in enumerate("xyz")]
    return F.when(point.isNotNull(), F.struct(*axes))


def _fractional(number: Column) -> Column:
    return F.coalesce(number != F.floor(number), F.lit(False))


def _has_fraction() -> Column:
    """Some action code or pixel is not a whole number."""
    pixels = F.concat(
        F.coalesce(F.flatten(F.flatten("_t.pixel_coords")), F.array().cast("array<double>")),
        F.coalesce(F.flatten(F.filter("_t.trajectory_pixel", lambda p: p.isNotNull())), F.array().cast("array<double>")),
    )
    codes = F.coalesce("_t.actions", F.array().cast("array<double>"))
    return F.exists(F.concat(codes, pixels), _fractional)


def parse_tasks(documents: DataFrame) -> DataFrame:
    """Documents ``(root, document, schema_version, generation_config, tasks)`` to tasks.

    ``task_idx`` is the position in the document, so ``(root, document,
    task_idx)`` is unique; ``document`` is left out if the documents have none.
    ``unreadable`` lists the fields that are present but could not be read.  ``keys`` lists the keys that
    are present, ``lengths`` the length of every array; ``has_fraction`` marks
    codes or pixels that the integer columns cannot hold.
    """
    names = [c for c in ("root", "document") if c != "document" or c in documents.columns]
    split = documents.select(
        *names,
        F.coalesce("schema_version", F.lit(1)).alias("schema_version"),
        F.from_json("generation_config", GENERATION_SCHEMA).alias("generation_config"),
        F.json_object_keys("generation_config").alias("config_keys"),
        F.posexplode("tasks").alias("_idx", "_json"),
    )
    return _typed_tasks(split, names)


def _typed_tasks(split: DataFrame, names: Sequence[str]) -> DataFrame:
    """Tasks of the result of ``parse_tasks`` from their texts ``_json`` at the places ``_idx``."""
    typed = split.select(
        *names,
        F.col("_idx").cast("bigint").alias("task_idx"),
        "schema_version",
        "generation_config",
        "config_keys",
        F.json_object_keys("_json").alias("keys"),
        F.from_json("_json", TASK_SCHEMA).alias("_t"),
        "_json",
    )
    fields = typed.schema["_t"].dataType.fields
    arrays = [f.name for f in fields if f.dataType.typeName() == "array"]
    shaped = {
        "pixel_coords": F.transform("_t.pixel_coords", lambda s: F.transform(s, _pixel)),
        "world_coords": F.transform("_t.world_coords", lambda s: F.transform(s, _point)),
        "visibility_status": F.transform("_t.visibility_status", lambda s: s.cast("array<int>")),
        "trajectory_pixel": F.transform("_t.trajectory_pixel", _pixel),
        "trajectory_world": F.transform("_t.trajectory_world", _point),
        **{name: F.col(f"_t.{name}").cast("array<int>") for name in _WHOLE_NUMBERS},
    }
    lengths = F.create_map(
        *[part for name in arrays for part in (F.lit(name), F.size(F.col(f"_t.{name}")))]
    )
    # A field with a value in the text and none in the row could not be read.
    lost = [
        F.when(
            F.col(f"_t.{f.name}").isNull() & F.get_json_object("_json", f"$.{f.name}").isNotNull(), F.lit(f.name)
        )
        for f in fields
    ]
    return typed.select(
        *names,
        "task_idx",
        "schema_version",
        "generation_config",
        "config_keys",
        "keys",
        F.map_filter(lengths, lambda _, n: n >= 0).alias("lengths"),
        _has_fraction().alias("has_fraction"),
        F.array_compact(F.array(*lost)).alias("unreadable"),
        *[shaped.get(f.name, F.col(f"_t.{f.name}")).alias(f.name) for f in fields],
    )


def load_documents(
    spark: SparkSession,
    paths: str | Sequence[str],
    root: Column | None = None,
    one_per_line: bool = False,
) -> DataFrame:
    """Read documents, plain or gzip by suffix, without splitting them.

    Every document's folder is its root, unless ``root`` gives another name.
    ``document`` names the document within the root: a digest of its file and
    its content, the same in every run.  A document that is no readable JSON
    stays, with its text in ``corrupt``;
    :func:`trailframe.operators.validate.document_violations` lists such ones.
    """
    raw = (
        spark.read.schema(DOCUMENT_SCHEMA)
        .option("multiLine", not one_per_line)
        .option("encoding", "UTF-8")
        .option("columnNameOfCorruptRecord", "corrupt")
        .json(paths if isinstance(paths, str) else list(paths))
    )
    folder = _folder("_metadata.file_path")
    content = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("schema_version", "generation_config", "tasks", "corrupt")]
    document = F.substring(F.md5(F.concat_ws("\n", F.col("_metadata.file_path"), *content)), 1, 16)
    return raw.select((folder if root is None else root).alias("root"), document.alias("document"), "*")


def _folder(path: str) -> Column:
    return F.regexp_extract(F.url_decode(_plus_kept(path)), r"^(?:file:/*(?=/))?(.*)/[^/]*$", 1)


def _plus_kept(path: str) -> Column:
    """Decoding must not take a plus sign for a space."""
    return F.replace(F.col(path), F.lit("+"), F.lit("%2B"))


def load_tasks(
    spark: SparkSession,
    paths: str | Sequence[str],
    root: Column | None = None,
    one_per_line: bool = False,
) -> DataFrame:
    """Read exploration documents as tasks; check :func:`load_documents` for lost ones."""
    return parse_tasks(load_documents(spark, paths, root, one_per_line))


def load_large_tasks(spark: SparkSession, paths: str | Sequence[str], root: Column | None = None) -> DataFrame:
    """``load_tasks`` for plain multi-line files of any size, one document each, read by many tasks.

    Only ``document`` differs: it is a digest of the file's name and of the document
    without the elements of its list.  A document that is no sound JSON, or whose tasks
    are not all objects, is parsed whole, as by ``load_tasks``.
    """
    rest, elements = json_elements(spark, paths, 2, "tasks", lambda text: F.json_object_keys(text).isNotNull())
    read = F.from_json("text", DOCUMENT_SCHEMA, {"columnNameOfCorruptRecord": "corrupt"})
    folder = _folder("file") if root is None else root
    documents = write_through(
        rest.select(
            "file",
            folder.alias("root"),
            F.substring(F.md5(F.concat_ws("\n", "file", "text")), 1, 16).alias("document"),
            read.alias("_d"),
        ).select("file", "root", "document", "_d.*"),
        "large-documents",
    )
    names = ["root", "document"]
    heads = documents.where("tasks is not null").select(
        "file",
        *names,
        F.coalesce("schema_version", F.lit(1)).alias("schema_version"),
        F.from_json("generation_config", GENERATION_SCHEMA).alias("generation_config"),
        F.json_object_keys("generation_config").alias("config_keys"),
    )
    further = elements.select("file", F.col("idx").alias("part"), F.col("text").alias("_json"))
    split = with_documents(further, heads, elements.count()).withColumnRenamed("part", "_idx")
    return parse_tasks(documents).unionByName(_typed_tasks(split, names))


def union_roots(
    spark: SparkSession,
    roots: Sequence[str],
    document: str = DOCUMENT_FILE,
    one_per_line: bool = False,
) -> DataFrame:
    """All tasks of several roots; ``root`` is the path given, ``root_no`` its order.

    Each root is read by the name it was given, whatever scheme or characters
    its path has.  A root without a document is skipped with a warning; none
    left is an error.
    """
    present = []
    for root in dict.fromkeys(r.rstrip("/") for r in roots):
        if path_exists(spark, f"{root}/{document}"):
            present.append(root)
        else:
            warnings.warn(f"no {document} in {root}; root skipped", stacklevel=2)
    if not present:
        raise ValueError("no root holds an exploration document")
    parts = [load_documents(spark, f"{root}/{document}", F.lit(root), one_per_line) for root in present]
    documents = parts[0]
    for part in parts[1:]:
        documents = documents.unionByName(part)
    numbers = F.create_map(*[x for k, root in enumerate(present) for x in (F.lit(root), F.lit(k))])
    return parse_tasks(documents).withColumn("root_no", numbers[F.col("root")])


def write_samples(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store samples as Parquet, one folder per root."""
    samples.write.mode(mode).partitionBy("root").parquet(path)
