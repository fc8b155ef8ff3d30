"""Block, rank and quantile plans against plain Python on small, skewed tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantmon.plans import (
    exact_quantiles, grouped_quantiles, hash_rank, lookup, over_frames, positions, rank_across, rank_within, running, stage,
)
from plantmon.plans import joins, ranking


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = []
    for ep, n in [(1, 200), (2, 7), (3, 1), (4, 33)]:
        kept = sorted(rng.sample(range(3 * n), n))
        rows += [(ep, i, rng.choice([None, rng.random() * 10])) for i in kept]
    return rows, spark.createDataFrame(rows, "episode bigint, raw_index bigint, v double").repartition(5)


def by_episode(rows):
    out = {}
    for ep, i, v in rows:
        out.setdefault(ep, []).append((i, v))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("size", [1, 3, 16, 1000])
def test_running_matches_a_plain_scan(table, size):
    rows, df = table
    got = running(
        df, ["episode"], "raw_index",
        {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v")),
         "n": ("next", F.col("v")), "lo": ("min", F.col("v"))},
        size=size,
    ).collect()
    want = {}
    for ep, items in by_episode(rows).items():
        for k, (i, _) in enumerate(items):
            seen = [v for _, v in items[: k + 1] if v is not None]
            after = [v for _, v in items[k:] if v is not None]
            want[ep, i] = (sum(seen) if seen else None, max(seen, default=None),
                           seen[-1] if seen else None, after[0] if after else None, min(seen, default=None))
    assert len(got) == len(rows)
    for r in got:
        s, m, last, nxt, low = want[r.episode, r.raw_index]
        assert (r.m, r.l, r.n, r.lo) == (m, last, nxt, low)
        assert r.s == pytest.approx(s) if s is not None else r.s is None


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_frames_reach_into_neighbour_blocks(table, size):
    rows, df = table
    placed = positions(df, ["episode"], "raw_index", size=size)

    def cols(w):
        return {"near": F.collect_list("raw_index").over(w.rowsBetween(-2, 3))}

    got = over_frames(placed, ["episode"], "pos", 2, 3, cols, size=size).collect()
    for r in got:
        items = [i for i, _ in by_episode(rows)[r.episode]]
        k = items.index(r.raw_index)
        assert r.pos == k
        assert r.near == items[max(0, k - 2): k + 4]
    assert len(got) == len(rows)


def test_ranks_do_not_depend_on_partitioning(spark, table):
    rows, df = table
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = rank_within(df, ["episode"], [F.col("raw_index").desc()], size_name="n")
        parts = ranked.select(F.col("pos"), "episode", "raw_index", "n").collect()
        whole = rank_within(df, [], ["episode", "raw_index"], "g").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for r in parts:
        items = [i for i, _ in by_episode(rows)[r.episode]][::-1]
        assert items[r.pos] == r.raw_index and r.n == len(items)
    flat = sorted((ep, i) for ep, i, _ in rows)
    assert [(r.episode, r.raw_index) for r in sorted(whole, key=lambda r: r.g)] == flat


def test_hash_rank_is_a_permutation_per_group(table):
    rows, df = table
    got = hash_rank(df, ["episode", "raw_index"], 7, by=["episode"], digits=1, size_name="n").collect()
    for ep, items in by_episode(rows).items():
        draws = sorted(r.draw for r in got if r.episode == ep)
        assert draws == list(range(len(items)))


@pytest.mark.parametrize("limit,accuracy", [(100_000, 10_000), (20, 50), (5, 20)])
def test_exact_quantiles_with_ties_and_narrow_limits(spark, limit, accuracy):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=700), np.repeat(0.25, 400), np.repeat(-3.0, 100)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(4)
    probs = [0.0, 0.05, 0.25, 0.5, 0.77, 0.95, 1.0]
    got = exact_quantiles(df, {"x": F.col("x")}, probs, limit=limit, accuracy=accuracy)["x"]
    assert got == pytest.approx(np.percentile(x, [100 * p for p in probs]).tolist())


def test_grouped_quantiles(table):
    rows, df = table
    got = {r.episode: r for r in grouped_quantiles(df, ["episode"], "v", {"a": 0.5, "b": 0.9}).collect()}
    for ep, items in by_episode(rows).items():
        vals = [v for _, v in items if v is not None]
        if vals:
            assert got[ep].a == pytest.approx(np.percentile(vals, 50))
            assert got[ep].b == pytest.approx(np.percentile(vals, 90))


def test_lookup_agrees_beyond_the_broadcast_bound(spark, table):
    _, df = table
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "episode bigint, name string")
    order = ["episode", "raw_index"]
    small = lookup(df, dim, "episode").orderBy(*order).collect()
    for share in (None, 0.5, 0.01, 0.0):
        big = lookup(df, dim, "episode", broadcast_rows=1, salt_by=["raw_index"], hot_share=share)
        assert big.orderBy(*order).collect() == small
    inner = lookup(df, dim, "episode", "inner", broadcast_rows=1, hot_share=0.1)
    assert inner.count() == sum(r.name is not None for r in small) and joins.SALTS > 1


def _nested(rows):
    groups = {}
    for k, v in rows:
        groups.setdefault(k, []).append(v)
    return {(k, v, i, len(vs)) for k, vs in groups.items() for i, v in enumerate(sorted(vs))}


@pytest.mark.parametrize("most", [0, 50, 1_000])
def test_rank_within_splits_large_groups_and_keeps_null_ones(spark, monkeypatch, most):
    monkeypatch.setattr(ranking, "GROUP_ROWS", most)
    rows = [(k, 3 * v % 1009) for k, n in ((1, 200), (2, 7), (3, 1), (None, 60)) for v in range(n)]
    df = spark.createDataFrame(rows, "k bigint, v bigint").repartition(5)
    got = rank_within(df, ["k"], ["v"], "at", size_name="n")
    assert got.columns == ["k", "v", "at", "n"]
    assert {tuple(r) for r in got.collect()} == _nested(rows) and got.count() == len(rows)


def test_rank_within_moves_a_row_once_without_a_join(spark, monkeypatch):
    df = spark.range(3_000).select((F.col("id") % 700).alias("k"), "id")
    monkeypatch.setattr(ranking, "stage", lambda table, label="stage": table if label == "ranked" else stage(table, label))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = rank_within(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_rank_across_orders_all_rows_by_group_and_place(spark):
    rows = [(k, i) for k, n in ((5, 9), (1, 30), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k bigint, i bigint").repartition(4)
    got = sorted(tuple(r) for r in rank_across(df, ["k"], "i", "at").collect())
    assert got == [(k, i, at) for at, (k, i) in enumerate(sorted(rows))]
