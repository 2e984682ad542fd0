"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import hot_join
from trailframe.session import write_through


def components(links: DataFrame) -> DataFrame:
    """``v, root`` for every end of ``links(u, v)``; equal roots, same component.

    In each round every vertex merges into the neighbour (or itself) that draws
    the smallest hash, and the links are mapped to the merged vertices.  The
    draws change from round to round, so that a constant share of the vertices
    vanishes whatever the shape; long chains and hubs take a logarithmic number
    of rounds.  Merges are written per round and resolved backwards.  No round
    gathers a component: minima are pre-aggregated, and hubs are joined by
    ``hot_join``.
    """
    links = write_through(links.where("u <> v").select("u", "v").distinct(), "links")
    merges: list[tuple[DataFrame, int]] = []
    total = links.count()
    while total:
        ends = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        draw = F.struct(F.xxhash64("v", F.lit(len(merges))).alias("draw"), F.col("v").alias("p"))
        own = F.struct(F.xxhash64("u", F.lit(len(merges))).alias("draw"), F.col("u").alias("p"))
        chosen = ends.groupBy("u").agg(F.min(draw).alias("best"), F.count(F.lit(1)).alias("n"))
        merge = write_through(chosen.select("u", F.least("best", own)["p"].alias("p"), "n"), "merge")
        merges.append((merge.select(F.col("u").alias("v"), "p"), merge.count()))
        left = hot_join(links, merge.select("u", F.col("p").alias("pu"), "n"), ["u"], "n", total)
        left = write_through(left.select("pu", "v"), "half")
        both = hot_join(left, merge.select(F.col("u").alias("v"), F.col("p").alias("pv"), "n"), ["v"], "n", total)
        mapped = both.where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
        links = write_through(mapped.distinct(), "links")
        total = links.count()
    roots = None
    for merge, size in reversed(merges):
        if roots is None:
            roots = merge.withColumnRenamed("p", "root")
            continue
        children = merge.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
        # A vertex that met no link in the later rounds is a root itself.
        targets = children.join(roots.withColumnRenamed("v", "p"), "p", "left")
        targets = targets.select("p", "n", F.coalesce("root", "p").alias("root"))
        resolved = hot_join(merge, targets, ["p"], "n", size)
        roots = write_through(resolved.select("v", "root"), "roots")
    return links.select("v", F.col("u").alias("root")) if roots is None else roots
