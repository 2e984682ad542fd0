"""Navigation measures over a stream of steps.

State is kept per (episode, block of steps), never per episode alone, so no
key grows without bound.  Rows of a block may arrive in any order: a row waits
in the state until its predecessor is there.  The output rows carry the values
within the block; :func:`finish_measures` adds what came before the block, with
the merge that the batch operator uses.

Where steps can be missing, :func:`stream_measures_over_gaps` lets rows wait
until the watermark has passed them: what has not come by then is missing.  State
of a block that has been idle for long is dropped; a block that goes on afterwards
starts a new segment, which the same merge links to the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trailframe.operators.blocks import BLOCK, BLOCK_ROWS, with_block
from trailframe.operators.measures import (
    ORACLE_SUCCESS_DISTANCE,
    Measure,
    merge_partials,
    standard_measures,
)
from trailframe.session import STATE_STORE

_COLUMNS = ("step", "x", "y", "z", "distance_to_goal", "spl")
_STEP = "step INT, x DOUBLE, y DOUBLE, z DOUBLE, distance_to_goal DOUBLE, spl DOUBLE"
_OUTPUT = (
    f"{BLOCK} BIGINT, step INT, path_length DOUBLE, oracle_navigation_error DOUBLE, "
    "oracle_success DOUBLE, oracle_spl DOUBLE, steps_taken DOUBLE, start DOUBLE, "
    "first_x DOUBLE, first_y DOUBLE, first_z DOUBLE, last_x DOUBLE, last_y DOUBLE, last_z DOUBLE"
)
_STATE = (
    "next_step INT, path DOUBLE, error DOUBLE, near DOUBLE, spl DOUBLE, moves DOUBLE, start DOUBLE, "
    "first_x DOUBLE, first_y DOUBLE, first_z DOUBLE, last_x DOUBLE, last_y DOUBLE, last_z DOUBLE"
)
#: Fields of the totals, in front of any other.
_TOTALS = len(_STATE.split(", "))


class BlockMeasures(StatefulProcessor):
    """Running measures of one block of one episode.

    The state of a block is one value, with its waiting rows in bytes: a block is read
    and written once per batch, however many of its rows wait.
    """

    columns = _COLUMNS
    fields = _STATE

    def __init__(self, block_rows: int):
        self.block_rows = block_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.block = handle.getValueState("block", f"{self.fields}, waiting BINARY")

    def _arrived(self, rows: Iterator[pd.DataFrame]) -> np.ndarray:
        return np.concatenate([np.column_stack([frame[c].to_numpy(float) for c in self.columns]) for frame in rows])

    def _load(self) -> tuple[list, np.ndarray]:
        """The fields of the state, null at first, and the waiting rows."""
        stored = self.block.get()
        if stored is None:
            return [None] * len(self.fields.split(", ")), np.empty((0, len(self.columns)))
        return list(stored[:-1]), np.frombuffer(stored[-1], float).reshape(-1, len(self.columns))

    def _store(self, state: list, waiting: np.ndarray) -> None:
        self.block.update((*state, waiting.tobytes()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, held = self._load()
        ready, early = self._in_order(self._next_step(key, state), np.concatenate([held, self._arrived(rows)]))
        out = [self._advance(key, state, ready)] if len(ready) else []
        if len(ready) or len(early) != len(held):
            self._store(state, early)
        yield from out

    def _next_step(self, key, state: list) -> int:
        """The step that the block goes on with."""
        return int(key[1]) * self.block_rows if state[0] is None else state[0]

    def _advance(self, key, state: list, ready: np.ndarray) -> pd.DataFrame:
        """Take rows in step order into the totals of ``state``; their values so far."""
        step, at, distance, spl = ready[:, 0], ready[:, 1:4], ready[:, 4], ready[:, 5]
        if state[0] is None:
            start = distance[0] if step[0] == 0 else np.nan
            state[:_TOTALS] = [0, 0.0, np.inf, 0.0, 0.0, 0.0, start, *at[0], *at[0]]
        legs = np.sqrt((np.diff(np.vstack([np.array(state[10:13], float), at]), axis=0) ** 2).sum(axis=1))
        near = (distance < ORACLE_SUCCESS_DISTANCE).astype(float)
        moved = step > 0
        running = {
            "path_length": state[1] + np.cumsum(legs),
            "oracle_navigation_error": np.fmin.accumulate(np.r_[state[2], distance])[1:],
            "oracle_success": np.maximum.accumulate(np.r_[state[3], near])[1:],
            "oracle_spl": np.fmax.accumulate(np.r_[state[4], np.where(moved, spl, np.nan)])[1:],
            "steps_taken": state[5] + np.cumsum(moved),
        }
        state[:_TOTALS] = [
            int(step[-1]) + 1,
            *[float(values[-1]) for values in running.values()],
            float(state[6]),
            *[float(v) for v in state[7:10]],
            *[float(v) for v in at[-1]],
        ]
        return pd.DataFrame(
            {
                "episode_id": key[0],
                BLOCK: key[1],
                "step": step.astype(np.int32),
                **running,
                "start": state[6],
                **{f"first_{axis}": state[7 + i] for i, axis in enumerate("xyz")},
                **{f"last_{axis}": at[:, i] for i, axis in enumerate("xyz")},
            }
        )

    def _in_order(self, next_step: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that continue the block, and those that wait; the first row of a step counts."""
        rows = rows[rows[:, 0] >= next_step]
        rows = rows[np.unique(rows[:, 0], return_index=True)[1]]
        in_place = rows[:, 0] == next_step + np.arange(len(rows))
        return rows[in_place], rows[~in_place]

    def close(self) -> None:
        pass


class GapBlockMeasures(BlockMeasures):
    """Running measures of one block whose steps may be missing, come late or twice.

    A row leaves at once if it is the next step.  Others wait, with a timer at
    their event time: predecessors are no younger than they are, so a predecessor
    that has not come when the watermark passes is missing.  The waiting rows
    that the watermark has passed then leave in step order.  Rows that come after
    a later step has left, again, or after their block was dropped, are reported as late.
    """

    columns = (*_COLUMNS, "at_ms")
    # Also the step at which the totals begin, the latest event time, and the one timer that is set.
    fields = f"{_STATE}, first_step INT, latest_ms BIGINT, timer_ms BIGINT"

    def __init__(self, block_rows: int, idle_ms: int):
        super().__init__(block_rows)
        self.idle_ms = idle_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, held = self._load()
        arrived = self._arrived(rows)
        if state[0] is None and not len(held):
            closed = arrived[:, -1] < timerValues.getCurrentWatermarkInMs()
        else:
            closed = arrived[:, 0] < self._next_step(key, state)
        late, arrived = arrived[closed], arrived[~closed]
        rows_now = np.concatenate([held, arrived])
        # The first row of a step counts, a second one is reported.
        first = np.unique(rows_now[:, 0], return_index=True)[1]
        again = np.ones(len(rows_now), bool)
        again[first] = False
        late, rows_now = np.concatenate([late, rows_now[again]]), rows_now[first]
        out = [self._late(key, late)] if len(late) else []
        if len(rows_now):
            here = rows_now[:, 0] == self._next_step(key, state) + np.arange(len(rows_now))
            count = int(here.sum())
            out += self._leave(key, state, rows_now[:count])
            self._set_timer(state, rows_now[count:], float(arrived[:, -1].max()) if len(arrived) else None)
            self._store(state, rows_now[count:])
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        state, held = self._load()
        state[-1] = None  # the timer that was set is this one
        passed = np.flatnonzero(held[:, -1] < watermark)
        out, count = [], 0
        if len(passed):
            # Everything up to the last passed row, and what follows it without a gap.
            upto = int(passed[-1]) + 1
            after = held[upto:, 0] == held[upto - 1, 0] + 1 + np.arange(len(held) - upto)
            count = upto + int(after.sum())
            out = self._leave(key, state, held[:count])
        if count == len(held) and watermark > state[-2] + self.idle_ms:
            self.block.clear()
        else:
            self._set_timer(state, held[count:], None)
            self._store(state, held[count:])
        yield from out

    def _leave(self, key, state: list, rows: np.ndarray) -> list[pd.DataFrame]:
        """Rows that go into the totals."""
        if not len(rows):
            return []
        if state[_TOTALS] is None:
            state[_TOTALS] = int(rows[0, 0])
        out = self._advance(key, state, rows[:, : len(_COLUMNS)])
        return [out.assign(segment=state[_TOTALS], late=False)]

    def _late(self, key, rows: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame({"episode_id": key[0], BLOCK: key[1], "step": rows[:, 0].astype(np.int32)})
        values = {c.split()[0]: np.nan for c in _OUTPUT.split(", ")[2:]}
        return out.assign(**values, segment=-1, late=True)

    def _set_timer(self, state: list, waiting: np.ndarray, newest: float | None) -> None:
        """One timer: at the first waiting row, or where the block has been idle for long."""
        latest, old = state[-2] or 0, state[-1]
        latest = latest if newest is None else max(latest, int(newest))
        # The watermark has passed a time when it is beyond it.
        timer = (int(waiting[:, -1].min()) if len(waiting) else latest + self.idle_ms) + 1
        if timer != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timer)
        state[-2:] = [latest, timer]


def stream_measures_over_gaps(
    steps: DataFrame,
    event_time: str,
    delay: str = "1 minute",
    idle: str = "1 hour",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Streaming form for episodes with missing steps, in append mode.

    ``event_time`` is a timestamp that does not fall from step to step of an
    episode, and ``delay`` how much later than younger rows a row may come.  Every input
    row gives one output row.  ``late`` rows (see :class:`GapBlockMeasures`) have no
    values and no part in the measures; a timestamp that is null is late as well.  State
    is dropped when the watermark is ``idle`` past the latest row of a block.
    """
    spark = steps.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    idle_ms = int(spark.sql(f"select unix_millis(timestamp_seconds(0) + interval '{idle}')").first()[0])
    key_type = steps.schema["episode_id"].dataType.simpleString()
    # The operator gets plain milliseconds: rows behind the watermark are reported, not dropped unseen.
    timed = steps.withWatermark(event_time, delay).select(
        "episode_id", *_COLUMNS, F.coalesce(F.unix_millis(event_time), F.lit(-1)).alias("at_ms")
    )
    return (
        with_block(timed, "step", block_rows)
        .groupBy("episode_id", BLOCK)
        .transformWithStateInPandas(
            statefulProcessor=GapBlockMeasures(block_rows, idle_ms),
            outputStructType=f"episode_id {key_type}, {_OUTPUT}, segment INT, late BOOLEAN",
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def stream_measures(steps: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Streaming form: one output row per input row, in append mode.

    A row whose predecessor never arrives waits for it, with all later rows of
    its block; :func:`stream_measures_over_gaps` is for episodes with missing steps.
    """
    steps.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    key_type = steps.schema["episode_id"].dataType.simpleString()
    keyed = with_block(
        steps.select("episode_id", "step", "x", "y", "z", "distance_to_goal", "spl"), "step", block_rows
    )
    return keyed.groupBy("episode_id", BLOCK).transformWithStateInPandas(
        statefulProcessor=BlockMeasures(block_rows),
        outputStructType=f"episode_id {key_type}, {_OUTPUT}",
        outputMode="Append",
        timeMode="None",
    )


def _point(prefix: str):
    return F.struct(*[F.col(f"{prefix}_{a}").alias(a) for a in "xyz"])


def _nan_as_missing(name: str):
    return F.when(~F.isnan(name), F.col(name))


def finish_measures(emitted: DataFrame) -> DataFrame:
    """Final measures per episode from the rows a stream has written.

    The row with the highest step of a block, or of a segment of a block, holds
    its totals.  Late rows are left out.
    """
    if "segment" in emitted.columns:
        # Segments follow each other by their first steps, in a block and across blocks.
        emitted = emitted.where("not late").withColumn(BLOCK, F.col("segment").cast("bigint"))
    known: dict[str, Measure] = standard_measures()
    order = ["path_length", "oracle_navigation_error", "oracle_success", "oracle_spl", "pl", "steps_taken"]
    latest = emitted.groupBy("episode_id", BLOCK).agg(
        *[
            F.max_by(c, "step").alias(c)
            for c in ("path_length", "oracle_navigation_error", "oracle_success", "oracle_spl", "steps_taken")
        ],
        F.struct(
            F.max_by(_nan_as_missing("start"), "step").alias("start"),
            F.max_by("path_length", "step").alias("path"),
        ).alias("pl"),
        F.max_by(_point("first"), "step").alias("_first"),
        F.max_by(_point("last"), "step").alias("_last"),
    )
    return merge_partials(latest, ["episode_id"], [known[name] for name in order])
