"""Anchor gate: when may a record serve as the reference the monitor trusts?

Per contiguous run of an episode: no decision until ``history`` records have
been seen; a record scoring at most ``enter`` opens a candidate; the candidate
falls when a later record scores above ``exit`` and becomes the anchor after
``delay`` further records; a new candidate may open ``reanchor`` records after
the anchor; an anchor older than ``max_age`` is stale. A change of stage or a
jump of the index starts over.

:func:`gate_step` is that rule for one record and drives the stream.
:func:`gate_batch` gets the same rows from window functions, without walking an
episode in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from plantmon.operators.clean import run_columns
from plantmon.plans import fold_groups, over_frames, running, stage
from plantmon.plans.ordered import BLOCK_ROWS

WARMUP, CANDIDATE, PROTECTED, STALE = "WARMUP", "CANDIDATE", "PROTECTED", "STALE"


@dataclass(frozen=True)
class GateRule:
    history: int
    delay: int
    enter: float
    exit: float
    reanchor: int
    max_age: int

    def __post_init__(self) -> None:
        if self.exit < self.enter:
            raise ValueError("exit must not lie below enter")
        if not 1 <= self.delay <= self.max_age:
            raise ValueError("delay lies between 1 and max_age")
        if self.history < 1 or self.reanchor < 0:
            raise ValueError("history is positive and reanchor not negative")

    @property
    def step(self) -> int:
        """Least distance between the starts of two successive anchors."""
        return max(self.delay + 1, self.reanchor)


@dataclass
class GateState:
    """What one episode remembers between records."""

    last_index: int = -1
    stage: str = ""
    seen: int = 0
    candidate: int = -1
    anchor: int = -1
    resets: int = 0
    started: bool = False


def gate_step(s: GateState, rule: GateRule, index: int, stage_name: str, score: float) -> str:
    """Advance ``s`` by one record and return the resulting mode."""
    if s.started and (index != s.last_index + 1 or stage_name != s.stage):
        s.seen, s.candidate, s.anchor = 0, -1, -1
        s.resets += 1
    s.started, s.last_index, s.stage = True, index, stage_name
    warming, s.seen = s.seen < rule.history, min(s.seen + 1, rule.history)
    if warming:
        return WARMUP
    if s.candidate >= 0:
        if score > rule.exit:
            s.candidate = -1
        elif index - s.candidate >= rule.delay:
            s.anchor, s.candidate = s.candidate, -1
    elif score <= rule.enter and (s.anchor < 0 or index - s.anchor >= rule.reanchor):
        s.candidate = index
    if s.candidate >= 0:
        return CANDIDATE
    if s.anchor < 0:
        return WARMUP
    return STALE if index - s.anchor > rule.max_age else PROTECTED


def _modes(at: np.ndarray, anchor: np.ndarray, candidate: np.ndarray, rule: GateRule) -> np.ndarray:
    """Mode of every record that is past the warm-up."""
    settled = np.where(at - anchor > rule.max_age, STALE, PROTECTED).astype(object)
    return np.where(candidate, CANDIDATE, np.where(anchor < 0, WARMUP, settled))


def gate_walk(
    s: GateState, rule: GateRule, index: np.ndarray, stages: np.ndarray, score: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Advance ``s`` by many records at once: (mode, anchor or -1, resets) of each.

    Same answers as :func:`gate_step` for one record after the other. Between two
    breakpoints nothing but the age changes, so the walk goes from one to the
    next: a break of the run, the opening of a candidate, and what ends it, the
    first score above ``exit`` or the delay. Each is found by bisection in the
    places of low and of high scores, and what lies between is filled in one go.
    """
    n = len(index)
    anchor, resets = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    warm, open_ = np.zeros(n, bool), np.zeros(n, bool)
    if not n:
        return np.empty(0, object), anchor, resets
    low, high = np.flatnonzero(score <= rule.enter), np.flatnonzero(score > rule.exit)
    broken = np.append(True, (np.diff(index) != 1) | (stages[1:] != stages[:-1]))
    if s.started:
        broken[0] = index[0] != s.last_index + 1 or stages[0] != s.stage
    # The first run goes on from the state, unless it is broken off there.
    starts = np.unique(np.append(0, np.flatnonzero(broken)))
    for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
        if broken[begin]:
            s.resets += int(s.started or begin > 0)
            s.seen, s.candidate, s.anchor = 0, -1, -1
        resets[begin:end] = s.resets
        ready = min(end, begin + rule.history - s.seen)
        warm[begin:ready] = True
        s.seen = min(rule.history, s.seen + end - begin)
        first, at = int(index[begin]), ready  # a place of the run and its index differ by a constant

        def next_of(places: np.ndarray, start: int, stop: int = end) -> int:
            k = int(np.searchsorted(places, start))
            return int(places[k]) if k < len(places) and places[k] < stop else stop

        while at < end:
            if s.candidate < 0:
                free = at if s.anchor < 0 else max(at, begin + s.anchor + rule.reanchor - first)
                opens = next_of(low, free)
                anchor[at:opens] = s.anchor
                at = opens
                if at == end:
                    break
                s.candidate = first + at - begin
                open_[at], anchor[at] = True, s.anchor
                at += 1
                continue
            falls, holds = next_of(high, at), begin + s.candidate + rule.delay - first
            stop = min(falls, holds, end)
            open_[at:stop], anchor[at:stop] = True, s.anchor
            at = stop
            if at < end:
                if falls > holds:
                    s.anchor = s.candidate
                s.candidate = -1
                anchor[at] = s.anchor
                at += 1
    s.started, s.last_index, s.stage = True, int(index[-1]), str(stages[-1])
    mode = np.where(warm, WARMUP, _modes(index, anchor, open_, rule))
    return mode, np.where(warm, -1, anchor), resets


# --- batch twin --------------------------------------------------------------
#
# A candidate is "good" when the ``delay`` records after it exist and none
# exceeds ``exit``. A candidate that is not good delays no good one: every
# record it could block lies before the exceedance that ends it. So the anchors
# of a run are the greedy chain over good records: take the first, then the
# first at least ``step`` later, and so on.
#
# The chain crosses block borders only through "earliest allowed offset into
# the next block", a number below ``step``. Each block therefore becomes a small
# map from entry offset to exit offset; maps are composed up a tree with a fixed
# fan-out, and entries handed back down. No task sees more than one block of
# records or one fan-out of maps.


def _exits(good: np.ndarray, low: int, size: int, step: int) -> np.ndarray:
    """Exit offset of a block for each entry offset 0..step-1."""
    high = low + size
    out = np.zeros(len(good) + 1, dtype=np.int64)
    after = np.searchsorted(good, good + step)
    for i in range(len(good) - 1, -1, -1):
        out[i] = max(0, good[i] + step - high) if after[i] == len(good) else out[after[i]]
    return out[np.searchsorted(good, low + np.arange(step))]


def _chain(good: np.ndarray, first: int, step: int) -> list[int]:
    picked, i = [], int(np.searchsorted(good, first))
    while i < len(good):
        picked.append(int(good[i]))
        i = int(np.searchsorted(good, good[i] + step))
    return picked


def _choose_anchors(
    rows: DataFrame, run: list[str], index: str, step: int, size: int, fan_out: int
) -> DataFrame:
    """Start index of every accepted anchor. ``rows`` carries ``good``.

    Blocks are numbered from the one a run starts in. Runs that fit one block
    need no maps.
    """
    size = max(size, step)
    key_fields = [f for f in rows.schema if f.name in run]
    blk = F.expr(f"`{index}` div {size} - run_start div {size}").alias("blk")
    blocked = rows.select(*run, index, "good", blk)
    wide = [StructField("blk", LongType())]
    map_schema = StructType([*key_fields, *wide, StructField("exits", ArrayType(LongType()))])
    entry_schema = StructType([*key_fields, *wide, StructField("entry", LongType())])
    pick_schema = StructType([*key_fields, StructField("anchor", LongType())])
    start = run.index("run_start")
    last = blocked.agg(F.max("blk")).first()[0] or 0

    def low(key: tuple) -> int:
        return (int(key[start]) // size + int(key[-1])) * size

    def to_map(key: tuple, cols: dict[str, np.ndarray]) -> list[tuple]:
        good = cols[index][cols["good"].astype(bool)].astype(np.int64)
        return [(*key, _exits(good, low(key), size, step).tolist())]

    def compose(key: tuple, cols: dict[str, np.ndarray]) -> list[tuple]:
        at = np.arange(step)
        for exits in cols["exits"]:
            at = np.asarray(exits)[at]
        return [(*key, at.tolist())]

    def hand_down(key: tuple, cols: dict[str, np.ndarray]) -> list[tuple]:
        at, out = int(cols["entry"][0]), []
        for b, exits in zip(cols["blk"], cols["exits"], strict=True):
            out.append((*key[:-1], int(b), at))
            at = int(exits[at])
        return out

    def pick(key: tuple, cols: dict[str, np.ndarray]) -> list[tuple]:
        good = cols[index].astype(np.int64)
        return [(*key[:-1], c) for c in _chain(good, low(key) + int(cols["entry"][0]), step)]

    good_rows = blocked.where("good")
    if not last:
        entered = good_rows.withColumn("entry", F.lit(0).cast("long"))
        return fold_groups(entered, [*run, "blk"], [index], pick, pick_schema)

    levels = [stage(fold_groups(blocked, [*run, "blk"], [index], to_map, map_schema), "maps")]
    while last:
        up = levels[-1].withColumn("_up", F.expr(f"blk div {fan_out}"))
        up = fold_groups(up, [*run, "_up"], ["blk"], compose, map_schema)
        levels.append(stage(up, "maps"))
        last //= fan_out
    entries = levels[-1].select(*run, "blk", F.lit(0).cast("long").alias("entry"))
    for level in reversed(levels[:-1]):
        above = entries.withColumnRenamed("blk", "_up")
        children = level.withColumn("_up", F.expr(f"blk div {fan_out}")).join(above, [*run, "_up"])
        entries = stage(fold_groups(children, [*run, "_up"], ["blk"], hand_down, entry_schema), "entries")
    entered = good_rows.join(entries, [*run, "blk"])
    return fold_groups(entered, [*run, "blk"], [index], pick, pick_schema)


def gate_batch(
    df: DataFrame, rule: GateRule, episode: str = "episode", stage_col: str = "stage",
    index: str = "raw_index", score: str = "score", *, size: int = BLOCK_ROWS, fan_out: int = 1024,
) -> DataFrame:
    """Mode, anchor, its age and the reset count of every record."""
    slim = df.select(episode, stage_col, index, score)
    counted = run_columns(slim, [episode], index, [stage_col], number="reset_count", size=size)
    run = [episode, "run_start"]
    delay = rule.delay

    def ahead(w):
        return {"_reach": F.lead(index, delay).over(w), "_worst": F.max(score).over(w.rowsBetween(1, delay))}

    seen = over_frames(counted, run, index, 0, delay, ahead, size=size)
    ready = F.col(index) - F.col("run_start") >= rule.history
    enters = ready & (F.col(score) <= rule.enter)
    good = enters & F.coalesce(
        (F.col("_reach") == F.col(index) + delay) & (F.col("_worst") <= rule.exit), F.lit(False)
    )
    flagged = stage(
        seen.withColumn("ready", ready).withColumn("good", good)
        .withColumn("bad", enters & ~good).drop("_reach", "_worst"),
        "flagged",
    )
    anchors = stage(_choose_anchors(flagged, run, index, rule.step, size, fan_out), "anchors")
    # The start and the acceptance of an anchor never fall on the same record
    # as another anchor's, so both fit one table of marks.
    none = F.lit(None).cast("long")
    marks = anchors.select(*run, F.col("anchor").alias(index), F.col("anchor").alias("_opened"), none.alias("_accepted"))
    marks = marks.unionByName(anchors.select(
        *run, (F.col("anchor") + delay).alias(index), none.alias("_opened"), F.col("anchor").alias("_accepted")
    ))
    marked = flagged.join(marks, [*run, index], "left")
    at = F.col(index)
    carried = running(
        marked, run, index,
        {
            "anchor_index": ("max", F.col("_accepted")),
            "_open": ("max", F.col("_opened")),
            "_weak": ("max", F.when(F.col("bad"), at)),
            "_fall": ("max", F.when(F.col(score) > rule.exit, at)),
        },
        size=size,
    )
    age = at - F.col("anchor_index")
    confirming = F.coalesce(at < F.col("_open") + delay, F.lit(False))
    free = F.col("anchor_index").isNull() | (F.col("_weak") >= F.col("anchor_index") + rule.step)
    weak = F.col("_weak").isNotNull() & free & (F.col("_weak") > F.coalesce("_fall", F.lit(-1)))
    mode = (
        F.when(~F.col("ready"), F.lit(WARMUP))
        .when(confirming | weak, F.lit(CANDIDATE))
        .when(F.col("anchor_index").isNull(), F.lit(WARMUP))
        .when(age > rule.max_age, F.lit(STALE))
        .otherwise(F.lit(PROTECTED))
    )
    return carried.select(
        episode, stage_col, index, score, mode.alias("mode"), "anchor_index",
        age.alias("anchor_age"), "reset_count",
    )


# --- stream ------------------------------------------------------------------

GATE_FIELDS = "mode string, anchor_index bigint, anchor_age bigint, reset_count bigint"
_STATE = ("last_index bigint, stage string, seen bigint, candidate bigint, anchor bigint, "
          "resets bigint, started boolean")
PIECE = 4_096  # records of a history row


@dataclass(frozen=True)
class Idle:
    """When an episode counts as ended and its state goes.

    ``time`` is the event time column. Records may be ``late`` milliseconds behind
    the newest one; an episode ends once that mark has passed its last record by
    ``after`` milliseconds. A record that still comes begins it anew.
    """

    time: str
    after: int
    late: int = 0

    def marked(self, records: DataFrame) -> DataFrame:
        return records.withWatermark(self.time, f"{self.late} milliseconds")

    def restart(self, handle, times: pd.Series) -> None:
        """Move the episode's timer behind its newest record."""
        for timer in list(handle.listTimers()):
            handle.deleteTimer(timer)
        stamp = times.max()
        if stamp is not None and stamp == stamp:
            handle.registerTimer(int(pd.Timestamp(stamp).value // 1_000_000) + self.after)


def _sorted(rows: Iterator[pd.DataFrame], index: str) -> pd.DataFrame:
    parts = list(rows)
    whole = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    at = whole[index].to_numpy()
    return whole if (at[1:] >= at[:-1]).all() else whole.take(np.argsort(at, kind="stable"))


def gate_stream(
    records: DataFrame, rule: GateRule, episode: str = "episode", stage_col: str = "stage",
    index: str = "raw_index", score: str = "score", idle: Idle | None = None,
) -> DataFrame:
    """The gate over a live feed, one small state value per episode.

    Records of an episode are sorted inside each micro-batch; a record older
    than the last one counts as an index break, like any other jump. The
    trigger's file or offset limit bounds what one episode brings at a time.
    With ``idle`` a timer in event time removes the state of an episode that has
    ended; without, it stays. Needs the RocksDB state store provider.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    names = [episode, stage_col, index, score]
    schema = records.select(*names).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    class Gate(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self._handle = handle
            self._memory = handle.getValueState("gate", _STATE)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            kept = self._memory.get()
            s = GateState(*kept) if kept is not None else GateState()
            batch = _sorted(rows, index)
            at = batch[index].to_numpy(np.int64)
            scores, stages = batch[score].to_numpy(float), batch[stage_col].astype(str).to_numpy()
            mode, anchor, resets = gate_walk(s, rule, at, stages, scores)
            self._memory.update((s.last_index, s.stage, s.seen, s.candidate, s.anchor, s.resets, s.started))
            if idle is not None:
                idle.restart(self._handle, batch[idle.time])
            # One frame from plain arrays: an episode brings few records, so the making of frames is most of the cost.
            none = anchor < 0
            yield pd.DataFrame({
                **{n: batch[n].to_numpy() for n in names}, score: scores, "mode": mode,
                "anchor_index": pd.arrays.IntegerArray(anchor, none), "anchor_age": pd.arrays.IntegerArray(at - anchor, none), "reset_count": resets,
            })

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            self._memory.clear()
            return iter([])

        def close(self) -> None:
            pass

    used = records.select(*names) if idle is None else idle.marked(records.select(*names, idle.time))
    return used.groupBy(episode).transformWithStateInPandas(
        Gate(), f"{ddl}, {GATE_FIELDS}", "Append", "None" if idle is None else "EventTime"
    )


def history_stream(
    records: DataFrame, length: int, episode: str = "episode", index: str = "raw_index",
    value: str = "score", idle: Idle | None = None,
) -> DataFrame:
    """The last ``length`` values of an episode with each record, oldest first.

    The list is cleared where the index jumps. Python hands on an episode's
    values as they are, PIECE records a row, with the place where each record's
    history begins; the histories are cut out of them by the JVM. ``idle`` ends
    the state of an episode as in :func:`gate_stream`.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    kind = dict(records.dtypes)[episode]

    class History(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self._handle = handle
            self._past = handle.getListState("past", "at bigint, v double")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            past = list(self._past.get()) if self._past.exists() else []
            batch = _sorted(rows, index)
            if idle is not None:
                idle.restart(self._handle, batch[idle.time])
            # The stored tail stands in front; a run begins where the index jumps.
            at = np.concatenate([[r[0] for r in past], batch[index]]).astype(np.int64)
            values = np.concatenate([[r[1] for r in past], batch[value]]).astype(float)
            place = np.arange(len(at))
            jump = np.concatenate([[True], np.diff(at) != 1])
            first = np.maximum(np.maximum.accumulate(np.where(jump, place, 0)), place - length + 1)
            self._past.put(list(zip(at[first[-1] :].tolist(), values[first[-1] :].tolist(), strict=True)))
            cuts = range(len(past), len(at), PIECE)
            low = [int(first[c]) for c in cuts]
            yield pd.DataFrame({
                episode: [key[0]] * len(cuts), "at": [at[c : c + PIECE] for c in cuts],
                "values": [values[a : c + PIECE] for a, c in zip(low, cuts, strict=True)],
                "first": [first[c : c + PIECE] - a for a, c in zip(low, cuts, strict=True)],
                "ahead": [c - a for a, c in zip(low, cuts, strict=True)],
            })

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            self._past.clear()
            return iter([])

        def close(self) -> None:
            pass

    names = [episode, index, value]
    used = records.select(*names) if idle is None else idle.marked(records.select(*names, idle.time))
    pieces = used.groupBy(episode).transformWithStateInPandas(
        History(), f"`{episode}` {kind}, at array<bigint>, values array<double>, first array<bigint>, ahead bigint",
        "Append", "None" if idle is None else "EventTime",
    )
    # The record i of a piece is value ``ahead + i``; its history begins at ``first[i]``.
    cut = F.transform("at", lambda x, i: F.struct(
        x.alias("at"),
        F.slice("values", (F.get("first", i) + 1).cast("int"), (F.col("ahead") + i - F.get("first", i) + 1).cast("int")).alias("history"),
    ))
    one = pieces.select(episode, F.explode(cut).alias("_r"))
    return one.select(episode, F.col("_r.at").alias(index), F.col("_r.history").alias("history"))
