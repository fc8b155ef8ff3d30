"""Batch gate against the record-by-record rule, with blocks far smaller than a run."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantmon.streaming import live
from plantmon.streaming.gate import (
    CANDIDATE, PROTECTED, STALE, WARMUP, GateRule, GateState, Idle, gate_batch, gate_step, gate_stream, gate_walk,
    history_stream,
)


def walk(rows, rule):
    states, out = {}, {}
    for ep, stage, i, x in sorted(rows, key=lambda r: (r[0], r[2])):
        s = states.setdefault(ep, GateState())
        mode = gate_step(s, rule, i, stage, x)
        has = s.anchor >= 0
        out[ep, i] = (mode, s.anchor if has else None, i - s.anchor if has else None, s.resets)
    return out


def trace(scores, rule, start=0):
    s = GateState()
    return [gate_step(s, rule, start + i, "a", x) for i, x in enumerate(scores)], s


def test_acceptance_waits_for_the_delay():
    rule = GateRule(history=2, delay=2, enter=0.2, exit=0.4, reanchor=100, max_age=3)
    modes, s = trace([0.1] * 5, rule)
    assert modes == [WARMUP, WARMUP, CANDIDATE, CANDIDATE, PROTECTED]
    assert (s.anchor, s.candidate, s.resets) == (2, -1, 0)
    assert gate_step(s, rule, 20, "a", 0.1) == WARMUP
    assert (s.anchor, s.resets) == (-1, 1)


def test_old_anchor_stays_until_the_next_is_accepted():
    rule = GateRule(history=2, delay=1, enter=0.2, exit=0.4, reanchor=2, max_age=3)
    modes, s = trace([0.1] * 6, rule)
    assert modes[3:] == [PROTECTED, CANDIDATE, PROTECTED]
    assert s.anchor == 4


def test_hysteresis_and_stale():
    rule = GateRule(history=1, delay=2, enter=0.2, exit=0.4, reanchor=50, max_age=3)
    modes, _ = trace([0.1, 0.1, 0.3, 0.3, 0.9, 0.9, 0.9], rule)
    assert modes == [WARMUP, CANDIDATE, CANDIDATE, PROTECTED, PROTECTED, STALE, STALE]
    modes, s = trace([0.1, 0.1, 0.9, 0.3], rule)
    assert modes == [WARMUP, CANDIDATE, WARMUP, WARMUP] and s.anchor == -1


def test_rule_is_validated():
    with pytest.raises(ValueError):
        GateRule(2, 2, 0.4, 0.2, 1, 3)
    with pytest.raises(ValueError):
        GateRule(2, 4, 0.1, 0.2, 1, 3)


@pytest.mark.parametrize(
    "rule,size,fan_out",
    [
        (GateRule(3, 2, 0.3, 0.7, 5, 9), 8, 2),
        (GateRule(1, 1, 0.2, 0.9, 0, 4), 4, 3),
        (GateRule(2, 4, 0.6, 0.8, 25, 12), 16, 2),
        (GateRule(2, 3, 0.5, 0.95, 7, 20), 65_536, 1024),
    ],
)
def test_batch_equals_the_sequential_rule(spark, rule, size, fan_out):
    rng = random.Random(size + rule.delay)
    rows = []
    for ep, n in [(1, 260), (2, 9), (3, 70)]:
        for i in range(n):
            if rng.random() > 0.02:
                rows.append((ep, "a" if (i // 90) % 2 == 0 else "b", i + 3, rng.random()))
    df = spark.createDataFrame(rows, "episode bigint, stage string, raw_index bigint, score double").repartition(6)
    got = gate_batch(df, rule, size=size, fan_out=fan_out).collect()
    want = walk(rows, rule)
    assert len(got) == len(rows)
    for r in got:
        assert (r.mode, r.anchor_index, r.anchor_age, r.reset_count) == want[r.episode, r.raw_index], r


@pytest.mark.parametrize("seed", range(6))
def test_walking_breakpoints_equals_the_rule_record_by_record(seed):
    rng = random.Random(seed)
    for _ in range(60):
        rule = GateRule(rng.randint(1, 4), (d := rng.randint(1, 4)), (a := rng.uniform(0.1, 0.6)), a + rng.uniform(0, 0.4), rng.randint(0, 8), d + rng.randint(0, 9))
        plain, walked, i, stage = GateState(), GateState(), rng.randint(0, 5), "a"
        for _ in range(rng.randint(1, 6)):  # batches
            index, stages, score = [], [], []
            for _ in range(rng.randint(1, 25)):
                i = max(0, i + (1 if rng.random() > 0.06 else rng.choice([3, 0, -4])))
                stage = stage if rng.random() > 0.05 else rng.choice("ab")
                index.append(i)
                stages.append(stage)
                score.append(rng.random() if rng.random() > 0.03 else float("nan"))
            want = []
            for x in zip(index, stages, score):
                mode = gate_step(plain, rule, *x)
                want.append((mode, plain.anchor, plain.resets))
            got = gate_walk(walked, rule, np.array(index), np.array(stages, object), np.array(score))
            assert list(zip(*[g.tolist() for g in got])) == want
            assert walked == plain
    assert [len(x) for x in gate_walk(GateState(), rule, np.empty(0, int), np.empty(0, object), np.empty(0))] == [0, 0, 0]


def episodes(spark):
    """Three episodes in event time; the first two end early."""
    rows = [(e, "a", i, i % 7 / 7, i) for e, n in ((1, 30), (2, 45), (3, 300)) for i in range(n)]
    rows += [(1, "a", i, 0.1, i) for i in range(280, 300)]  # one comes back
    df = spark.createDataFrame(rows, "episode long, stage string, raw_index long, score double, sec long")
    return df.withColumn("ts", F.timestamp_seconds(F.col("sec") + 1_700_000_000)).drop("sec")


def test_state_of_an_ended_episode_is_removed(spark, tmp_path):
    live.use_rocksdb(spark)
    rule, idle = GateRule(2, 2, 0.3, 0.9, 5, 20), Idle("ts", after=30_000)
    for name, make in (("gate", lambda r, i: gate_stream(r, rule, idle=i)), ("past", lambda r, i: history_stream(r, 4, idle=i))):
        for kept in (None, idle) if name == "gate" else (idle,):
            df = episodes(spark).where("raw_index < 280")
            replay = live.Replay(df, "raw_index", slices=3)
            marks, out = str(tmp_path / f"marks-{name}-{kept is None}"), str(tmp_path / f"out-{name}-{kept is None}")
            stream = make(replay.records, kept)
            live.run_to_end(lambda: stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks), replay)
            state = spark.read.format("statestore").option("stateVarName", name).load(marks)
            left = {r[0][0] for r in state.select("key").distinct().collect()}
            assert left == ({1, 2, 3} if kept is None else {3})
            assert spark.read.schema(stream.schema).parquet(out).count() == df.count()


def test_an_episode_that_comes_back_begins_anew(spark):
    live.use_rocksdb(spark)
    rule = GateRule(2, 2, 0.3, 0.9, 5, 20)
    counts = []
    for idle in (None, Idle("ts", after=30_000)):
        replay = live.Replay(episodes(spark), "raw_index", slices=3)
        out = live.drain(gate_stream(replay.records, rule, idle=idle), replay, "gate")
        counts.append({r["reset_count"] for r in out.where("episode = 1 and raw_index >= 280").collect()})
        assert out.count() == episodes(spark).count()
    assert counts == [{1}, {0}]
