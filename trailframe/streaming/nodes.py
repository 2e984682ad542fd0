"""Node tracking over a stream of steps.

Each micro-batch runs the batch operator from the nodes that the previous one
left behind.  Both its rows and the new nodes are written under the batch
number, so a batch that is replayed reads the same state and replaces its own
output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailframe.operators.graph import track_nearest_node


def track_stream(
    steps: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    starts: DataFrame,
    folder: str,
    **trigger,
) -> StreamingQuery:
    """Start tracking; rows land in ``folder/rows/batch=N``.

    Every batch must continue the episodes where the last one ended; a row at
    or before the step already reached fails the batch.
    """
    spark = steps.sparkSession
    initial = starts.select("episode_id", "node_id", F.lit(-1).alias("step"))

    def advance(batch: DataFrame, number: int) -> None:
        state = initial if number == 0 else spark.read.parquet(f"{folder}/state/{number - 1}")
        late = batch.join(
            state.select("episode_id", F.col("step").alias("_reached")), "episode_id"
        ).where(F.col("step") <= F.col("_reached"))
        if not late.isEmpty():
            raise ValueError(f"batch {number} holds steps that lie before the tracked ones")
        tracked = track_nearest_node(batch, nodes, edges, state.select("episode_id", "node_id"))
        target = f"{folder}/rows/batch={number}"
        tracked.write.mode("overwrite").parquet(target)
        newest = spark.read.schema(tracked.schema).parquet(target)
        reached = newest.groupBy("episode_id").agg(
            F.max_by("node_id", "step").alias("node_id"), F.max("step").alias("step")
        )
        idle = state.join(reached, "episode_id", "left_anti")
        idle.unionByName(reached).write.mode("overwrite").parquet(f"{folder}/state/{number}")

    return (
        steps.writeStream.foreachBatch(advance)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
