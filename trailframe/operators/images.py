"""Image lookup, missing-file report and replacement of failed samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.functions.choice import seeded_choice, seeded_number
from trailframe.operators.skew import marked_by_bitmap, salted_join, shuffled_join
from trailframe.session import write_through
from trailframe.sources.images import ANY_SCENE


def _without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"([^/])\.[^./]*$", "$1")


def lookup_keys(rel_path: Column) -> Column:
    """Where an image may be stored, best place first.

    ``array<struct<priority, store, key>>``: in the scene's own store, then in
    the common one, by the path below the scene without extension, the whole
    path without extension, the whole path.
    """
    scene = F.substring_index(rel_path, "/", 1)
    nested = F.contains(rel_path, F.lit("/"))
    below = F.when(nested, F.regexp_replace(rel_path, r"^[^/]*/", ""))
    keys = [_without_extension(below), _without_extension(rel_path), rel_path]
    places = [(F.when(nested, scene), key) for key in keys] + [(F.lit(ANY_SCENE), key) for key in keys]
    entries = [
        F.struct(F.lit(rank).alias("priority"), store.alias("store"), key.alias("key"))
        for rank, (store, key) in enumerate(places)
    ]
    return F.filter(F.array(*entries), lambda e: e["store"].isNotNull() & e["key"].isNotNull())


def _places(images: DataFrame) -> list[str]:
    """What names a stored image; a store may belong to one data root."""
    return [c for c in ("root", "store", "key") if c != "root" or c in images.columns]


def locate_images(wanted: DataFrame, images: DataFrame, on: Sequence[str] = ("root", "rel_path")) -> DataFrame:
    """The stored key of every distinct wanted path; null where there is none.

    Paths are made distinct first (a task's first frame is wanted by all of its
    samples), and only keys are read and shuffled here, never image bytes.  If
    ``images`` has a column ``root``, a path is looked up in the stores of its
    own root only.
    """
    paths = wanted.select(*on).distinct()
    tries = paths.select(*on, F.inline(lookup_keys(F.col(on[-1]))))
    stored = images.select(*_places(images)).distinct()
    hits = (
        shuffled_join(tries, stored, _places(images))
        .groupBy(*on)
        .agg(F.min(F.struct("priority", "store", "key")).alias("hit"))
    )
    return shuffled_join(paths, hits, on, "left").select(
        *on, F.col("hit.priority").alias("priority"), F.col("hit.store").alias("store"), F.col("hit.key").alias("key")
    )


def resolve_images(wanted: DataFrame, images: DataFrame, on: Sequence[str] = ("root", "rel_path")) -> DataFrame:
    """``locate_images`` plus the bytes; only those of wanted images are shuffled, once.

    The keys that were found are marked in a bitmap of a fixed size.  Images outside
    of it are dropped where they are read.  A key stored twice counts once, with the smaller
    content.
    """
    places = _places(images)
    found = write_through(locate_images(wanted, images, on), "located")
    keys = [F.col(c) for c in places]
    listed = found.where("key is not null").select(*places)
    asked = marked_by_bitmap(images.select(*places, "bytes"), listed, keys, keys, "_asked").where("_asked")
    single = asked.groupBy(*places).agg(F.min("bytes").alias("bytes"))
    return shuffled_join(found, single, places, "left").select(*on, "priority", "store", "key", "bytes")


def check_image_files(required: DataFrame, listing: DataFrame) -> DataFrame:
    """Required paths that have no file, or an empty one."""
    sizes = listing.groupBy("path").agg(F.max("length").alias("length"))
    joined = required.select("path").distinct().join(sizes, "path", "left")
    reason = F.when(F.col("length").isNull(), "missing").when(F.col("length") == 0, "empty")
    return joined.select("path", reason.alias("reason")).where("reason is not null")


def resample_failed(
    samples: DataFrame,
    failed: Column,
    keys: Sequence[str],
    seed: int = 42,
    on_fail: str = "substitute",
    rows_per_bucket: int = 65_536,
) -> DataFrame:
    """Give every failed sample the content of a good one, drawn by its key.

    Good samples are numbered without a global sort: position in a hash bucket
    plus the number of good rows in the buckets before it.  A failed sample
    draws one number below the total and meets the good one in an equi-join.
    The result has the columns of ``samples`` and ``from_<key>``, the key of
    the sample whose content the row holds.
    """
    columns = [c for c in samples.columns if c not in keys]
    origin = [F.col(k).alias(f"from_{k}") for k in keys]
    marked = samples.withColumn("_failed", F.coalesce(failed, F.lit(False)))
    good = marked.where(~F.col("_failed")).drop("_failed")
    if on_fail == "drop":
        return good.select(*keys, *columns, *origin)
    n_good, n_failed = marked.agg(
        F.count_if(~F.col("_failed")), F.count_if("_failed")
    ).first()
    if n_failed and (on_fail == "fail" or n_good == 0):
        raise ValueError(f"{n_failed} samples failed, {n_good} are good")

    # One summary row per bucket; a bucket is one task's rows.
    buckets = max(1, -(-n_good // rows_per_bucket))
    number = seeded_number(seed, *[F.col(k) for k in keys])
    placed = good.select(*keys, number.alias("_number")).withColumn(
        "_bucket", F.pmod("_number", F.lit(buckets))
    )
    inside = Window.partitionBy("_bucket").orderBy("_number", *keys)
    placed = placed.withColumn("_local", F.row_number().over(inside))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_bucket")
        .count()
        .select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    )
    ranked = placed.join(offsets, "_bucket").select(
        (F.col("_before") + F.col("_local") - 1).alias("_rank"), *origin
    )
    drawn = seeded_choice(seed + 1, F.lit(n_good), *[F.col(k) for k in keys])
    lost = marked.where("_failed").select(*keys, drawn.alias("_rank"))
    # Few good samples may serve very many failed ones.
    pairs = salted_join(lost, ranked, ["_rank"], keys, n_failed).drop("_rank")
    donors = good.select(*origin, *columns)
    replaced = pairs.join(donors, [f"from_{k}" for k in keys]).select(
        *keys, *columns, *[f"from_{k}" for k in keys]
    )
    return good.select(*keys, *columns, *origin).unionByName(replaced)
