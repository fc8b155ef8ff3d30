"""Missing scores, missing partners, empty tables and ties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantmon.operators import calibrate, isolate, labels, metrics, outliers, scores, splits
from plantmon.plans import rank_within

NAN, INF = float("nan"), float("inf")


def test_missing_scores_raise_no_alarm(spark):
    rows = [(0.1, 0), (NAN, 0), (NAN, 1), (None, 1), (2.0, 1)]
    got = scores.detection_metrics(spark.createDataFrame(rows, "s double, y int"), "s", 1.0, "y").first()
    assert (got["far"], got["missed"]) == (0.0, 2) and got["fdr"] == pytest.approx(1 / 3)


def test_missing_scores_do_not_spoil_thresholds(spark):
    normal = spark.createDataFrame([(float(i),) for i in range(100)] + [(NAN,), (None,)], "s double")
    assert scores.percentile_threshold(normal, "s", 0.05) == pytest.approx(94.05)
    assert math.isfinite(scores.inequality_threshold(normal, "s", 0.05))
    assert scores.inequality_threshold(normal.where("s is null"), "s", 0.05) == INF
    assert scores.fit_t2(normal, ["s"]).center[0] == pytest.approx(49.5)


def test_disabled_threshold_never_alarms(spark):
    df = spark.createDataFrame([(NAN, 1.0, INF, 1.0)], "statistic double, gamma_anchor double, radius double, scale double")
    calibration = spark.createDataFrame([(1.0, "ready")], "quantile double, status string")
    row = calibrate.dynamic_threshold(df, calibration).first()
    assert (row["threshold"], row["threshold_status"], row["alarm"]) == (INF, "disabled", False)


def test_streams_without_partner(spark):
    long = spark.createDataFrame([("a", 2.0), ("b", 3.0), ("b", NAN)], "score_name string, score double")
    limits = spark.createDataFrame([("a", 1.0)], "score_name string, threshold double")
    rows = {(r["score_name"], r["threshold"], r["alarm"]) for r in calibrate.apply_thresholds(long, limits).collect()}
    assert rows == {("a", 1.0, True), ("b", INF, False)}
    with pytest.raises(Exception, match="no threshold for stream b"):
        calibrate.apply_thresholds(long, limits, strict=True).collect()
    maxima = spark.createDataFrame([("a", 1.0)], "score_name string, max_score double")
    with pytest.raises(Exception, match="not declared"):
        calibrate.conformal_thresholds(maxima, 0.1, streams=["b"]).collect()
    got = calibrate.conformal_thresholds(maxima.where("false"), 0.1, streams=["b"]).first()
    assert (got["episodes"], got["rank"], got["threshold"], got["finite"]) == (0, 1, INF, False)


def test_empty_calibration_and_horizon(spark):
    row = calibrate.conformal_status(spark.createDataFrame([], "max_score double"), 0.1).first()
    assert (row["episodes"], row["resolution"], row["status"]) == (0, 1.0, "insufficient_resolution")
    none = spark.createDataFrame([], "step long, a double, b double")
    assert metrics.horizon_rmse(none, "step", "a", "b").count() == 0


def test_labels_must_cover_outputs(spark):
    outputs = spark.createDataFrame([(1, 0.5), (2, 0.6)], "k long, score double")
    truth = spark.createDataFrame([(1, 0)], "k long, y int")
    with pytest.raises(Exception, match="has no label"):
        labels.bind_truth(outputs, truth, ["k"], "y").collect()
    twice = truth.unionByName(truth).unionByName(spark.createDataFrame([(2, 1)], "k long, y int"))
    with pytest.raises(Exception, match="several labels"):
        labels.bind_truth(outputs, twice, ["k"], "y").collect()


@pytest.mark.parametrize(("a", "b", "same"), [(1.0, NAN, False), (INF, -INF, False), (NAN, None, True), (INF, INF, True), (1.0, 1.0, True)])
def test_replay_compares_kinds(spark, a, b, same):
    left, right = (spark.createDataFrame([(1, x)], "k long, score double") for x in (a, b))
    assert labels.replay_compare(left, right, ["k"]).first()["matches"] is same


def test_family_needs_a_radius(spark):
    scored = spark.createDataFrame([(1, "F0", 0.5), (1, "F1", 0.5)], "o long, family_id string, score double")
    radii = spark.createDataFrame([("F0", 1.0)], "family_id string, radius double")
    with pytest.raises(Exception, match="no radius for family F1"):
        isolate.feasible_families(scored, radii).collect()


def test_tail_rule_defaults_and_switches(spark):
    rows = [(0, i, float(i), "train" if i < 200 else "test") for i in range(240)]
    df = spark.createDataFrame(rows, "episode long, raw_index long, x double, split string")
    rule = outliers.OutlierRule("tail_percent", max_removal_ratio=1.0)
    flagged = outliers.fit_apply_outliers(df, ["x"], rule, ["episode"], "raw_index")
    assert flagged.where("removed").count() == 4
    with pytest.raises(ValueError, match="half"):
        outliers.fit_outliers(df, ["x"], outliers.OutlierRule("tail_percent", tail_percent=1.0))
    kept = outliers.fit_apply_outliers(df, ["x"], rule, ["episode"], "raw_index", remove_train=False, mark_elsewhere=False)
    assert kept.where("removed").count() == 0 and kept.where("marked and split = 'test'").count() == 0
    assert kept.where("marked").count() == 4


def test_removal_cap_needs_no_join(spark):
    df = spark.createDataFrame([(i, float(i % 7), True) for i in range(100)], "k long, severity double, marked boolean")
    out = outliers.cap_removals(df, ["k"], 0.2)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    want = sorted(range(100), key=lambda i: (-(i % 7), i))[:20]
    assert sorted(r["k"] for r in out.where("removed").collect()) == sorted(want)


def test_fingerprint_sees_every_digit(spark):
    def of(x):
        df = spark.createDataFrame([(0, x), (1, 1.0)], "at long, x double")
        return splits.table_fingerprint(df, [], ["at"], ["x"]).first()["fingerprint"]

    values = [1e-7, 2e-7, NAN, None, INF, -INF, 1.0, math.nextafter(1.0, 2.0)]
    assert len({of(x) for x in values}) == len(values)


def test_tied_values_are_spread_over_the_sort(spark):
    df = spark.range(0, 40_000, 1, 8).select((F.col("id") % 10 == 0).cast("int").alias("v"), "id")
    ranked = rank_within(df, [], ["v"], "k")
    assert ranked.agg(F.count_distinct("k"), F.max("k")).first()[:] == (40_000, 39_999)
    tied = df.withColumn("t", F.monotonically_increasing_id()).orderBy("v", "t")
    sizes = [r["count"] for r in tied.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)
    assert ranked.where("v = 1 and k < 36000").count() == 0


@pytest.mark.parametrize("by", [["episode"], []])
def test_sparse_index_runs_in_groups(spark, by):
    """An index with a large step: no window holds all the blocks of a key."""
    from plantmon.plans import running

    rows = [(i % 2, i * 10_000_000, float(i % 5) if i % 3 else None) for i in range(1_000)]
    df = spark.createDataFrame(rows, "episode long, i long, x double")
    got = running(df, by, "i", {
        "s": ("sum", F.col("x")), "m": ("max", F.col("x")), "l": ("last", F.col("x")), "n": ("next", F.col("x"))
    }, size=100).collect()
    for key in ([0, 1] if by else [None]):
        mine = sorted((r for r in got if key is None or r["episode"] == key), key=lambda r: r["i"])
        total, best, last = None, None, None
        after = [r["x"] for r in mine]
        for at, r in enumerate(mine):
            if r["x"] is not None:
                total = (total or 0.0) + r["x"]
                best = r["x"] if best is None else max(best, r["x"])
                last = r["x"]
            following = next((x for x in after[at:] if x is not None), None)
            assert (r["s"], r["m"], r["l"], r["n"]) == (total, best, last, following)


def test_steadily_improving_runs_need_no_rounds(spark, monkeypatch):
    from plantmon.operators import runs

    rows = [(0, i, 10_000.0 - i, 0.5) for i in range(10_000)] + [(1, i, 5.0 - i * 0.001, float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, i long, rmse double, r2 double")
    staged = []
    real = runs.stage
    monkeypatch.setattr(runs, "stage", lambda frame, label="stage": staged.append(label) or real(frame, label))
    got = {r["k"]: (r["i"], r["rmse"]) for r in runs.best_run(df, ["k"], "i", eps=0.01, size=10).collect()}
    cur = None
    for _, i, a, b in rows[10_000:]:
        if cur is None or a < cur[1] - 0.01 or (abs(a - cur[1]) <= 0.01 and b > cur[2] + 0.01):
            cur = (i, a, b)
    assert got == {0: (9_999, 1.0), 1: cur[:2]}
    assert staged.count("folded") <= 6


def test_runs_that_win_again_and_again_take_one_round(spark, monkeypatch):
    from plantmon.operators import runs

    rows = [(0, i, 1.0 + i % 3 * 0.004, 0.1 * (i + i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, i long, rmse double, r2 double")
    cur = rows[0]
    for row in rows:
        if row[2] < cur[2] - 0.01 or (abs(row[2] - cur[2]) <= 0.01 and row[3] > cur[3] + 0.01):
            cur = row
    staged = []
    real = runs.stage
    monkeypatch.setattr(runs, "stage", lambda frame, label="stage": staged.append(label) or real(frame, label))
    assert [r["i"] for r in runs.best_run(df, ["k"], "i", eps=0.01, size=50).collect()] == [cur[1]]
    assert staged.count("folded") == 1
    assert [r["i"] for r in runs.best_run(df, ["k"], "i", eps=0.01, size=50, fold_rows=100).collect()] == [cur[1]]
    assert staged.count("folded") == 4


def test_block_mask_hides_and_shows_something(spark):
    from plantmon.operators import masks

    df = spark.range(50).select(F.lit(0).alias("episode"), F.col("id").alias("i"), F.col("id").cast("double").alias("x"))
    for rate in (0.001, 1.0):
        hidden = masks.mask_block(df, ["episode"], "i", ["x"], rate, 3, 1).where("mask_x").count()
        assert 1 <= hidden <= 49


def test_shared_length_counts_each_position_once(spark):
    spans = [("a", 0, 10), ("a", 5, 12), ("b", 11, 20), ("c", 30, 40), ("a", 35, 36), ("b", 35, 50)]
    df = spark.createDataFrame(spans, "o string, s long, e long")
    owners = {}
    for o, s, e in spans:
        for p in range(s, e):
            owners.setdefault(p, set()).add(o)
    want = sum(len(v) > 1 for v in owners.values())
    assert splits.shared_length(df, "o", "s", "e").first()["shared"] == want
    assert splits.shared_length(df.where("false"), "o", "s", "e").first()["shared"] == 0


def test_spans_and_items_that_lie_close_together_move_as_words(spark):
    import random

    random.seed(4)
    spans = [(random.choice("abc"), s, s + random.choice([0, 1, 6, 36, 63, 64, 65, 200])) for s in random.sample(range(-700, 2_000), 60)]
    df = spark.createDataFrame(spans, "o string, s long, e long")
    owners = {}
    for o, s, e in spans:
        for p in range(s, e):
            owners.setdefault(p, set()).add(o)
    depth, covered = {}, {(o, p) for p, found in owners.items() for o in found}
    for r in splits.span_ends(df, "o", "s", "e").collect():
        depth.setdefault(r["o"], []).append((r["at"], r["step"]))
    for o, steps in depth.items():
        for p in range(-800, 2_300):
            assert ((o, p) in covered) == (sum(step for at, step in steps if at <= p) > 0)
    found = df.where("s >= 0")
    owners = {}
    for o, s, e in spans:
        for p in range(s, e) if s >= 0 else ():
            owners.setdefault(p, set()).add(o)
    assert splits.shared_length(found, "o", "s", "e").first()["shared"] == sum(len(v) > 1 for v in owners.values())
    windows = spark.range(0, 64_000, 2).select(F.lit("a").alias("o"), F.col("id").alias("s"), (F.col("id") + 6).alias("e"))
    assert splits.span_ends(windows, "o", "s", "e").count() <= 2_100

    items = [(random.choice("abcd"), random.choice([None, *range(-100, 200)])) for _ in range(400)]
    df = spark.createDataFrame([*items, ("a", None), ("b", None), (None, 1_000), ("a", 1_000)], "o string, i int")
    want = splits.overlaps(df, "i", "o").count()
    assert splits.shared_items(df, "i", "o").first()["shared"] == want
    assert splits.shared_items(df.where("false"), "i", "o").first()["shared"] == 0
    assert splits.shared_items(df.withColumn("i", F.col("i") / 2), "i", "o").first()["shared"] == want


def test_staged_tables_of_a_chain_are_released(spark):
    from plantmon.plans import released, stage

    kept = stage(spark.range(3))
    with released(spark):
        inside = stage(spark.range(5))
        assert inside.count() == 5
        files = inside.inputFiles()
    assert kept.count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_replay_bounds_its_batches(spark):
    from plantmon.streaming.live import Replay, drain

    df = spark.range(1000).withColumnRenamed("id", "i")
    replay = Replay(df, "i", slices=1, batch_rows=100)
    assert max(p.count() for p in replay._parts) <= 100 and len(replay._parts) == 10
    empty = Replay(df.where("false"), "i", slices=1)
    assert drain(empty.records, empty).count() == 0


def test_replay_slices_follow_the_longest_episode(spark):
    from plantmon.streaming.live import Replay

    df = spark.range(4000).selectExpr("id div 40 AS e", "id % 40 AS i")
    replay = Replay(df, "i", slices=3, batch_rows=20)
    assert len(replay._parts) == 3 and sum(p.count() for p in replay._parts) == 4000
    assert max(r["count"] for p in replay._parts for r in p.groupBy("e").count().collect()) <= 20


def test_row_count_and_covariance_method_are_checked(spark, tmp_path):
    from plantmon.plans import stage
    from plantmon.sources import manifest

    path = str(tmp_path / "out")
    spark.range(7).write.json(path)
    index = stage(manifest.file_manifest(spark, path, "part-*").select("name", "sha256"))
    assert manifest.verify_outputs(spark, path, index, rows=7).count() == 0
    assert [r["problem"] for r in manifest.verify_outputs(spark, path, index, rows=8).collect()] == ["row count differs"]
    normal = spark.createDataFrame([(1.0,), (2.0,)], "s double")
    assert scores.fit_procedures(normal, ["lv-t2-kde"], 0.1, latent=["s"], covariance_method="pinv")
    with pytest.raises(ValueError, match="covariance"):
        scores.fit_procedures(normal, ["lv-t2-kde"], 0.1, latent=["s"], covariance_method="full")


def test_wide_moments_in_one_scan(spark):
    from plantmon.operators import metrics

    draw = np.random.default_rng(2)
    p, n = 1_000, 400
    base = draw.normal(size=(n, p)) * draw.uniform(0.1, 5, p) + draw.uniform(-1e5, 1e5, p)
    df = spark.createDataFrame([(x.tolist(),) for x in base], "v array<double>").repartition(11)
    m = metrics.estimate_moments(df, [F.get("v", F.lit(i)) for i in range(p)], [f"c{i}" for i in range(p)])
    assert m.n == n and np.allclose(m.mean, base.mean(axis=0), rtol=1e-12)
    assert np.allclose(m.covariance, np.cov(base.T, bias=True), rtol=1e-6, atol=1e-6)


def test_wide_moments_leave_missing_pairs_out(spark):
    from plantmon.operators import metrics

    draw = np.random.default_rng(3)
    values = draw.normal(size=(60, 9)) + 1e4
    gone = draw.random((60, 9)) < 0.2
    gone[:20] = False
    rows = [tuple(None if g else float(x) for x, g in zip(v, m)) for v, m in zip(values, gone)]
    names = [f"c{i}" for i in range(9)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5)
    wide = metrics.estimate_moments(df, names)
    want = df.agg(*[F.covar_pop(a, b).alias(f"{a}{b}") for a in names for b in names], *[F.avg(a).alias(a) for a in names]).first()
    assert wide.n == 60
    assert np.allclose(wide.mean, [want[a] for a in names], rtol=1e-12)
    assert np.allclose(wide.covariance, [[want[a + b] for b in names] for a in names], rtol=1e-6, atol=1e-9)
    assert metrics.estimate_moments(df.where("false"), names).n == 0


def test_leaderboard_sorts_once(spark, monkeypatch):
    from plantmon.operators import runs

    sorts = []
    real = runs.rank_within
    monkeypatch.setattr(runs, "rank_within", lambda *a, **k: (sorts.append(1), real(*a, **k))[1])
    draw = np.random.default_rng(4)
    rows = [(int(t), float(draw.integers(0, 5)), None if draw.random() < 0.3 else float(draw.normal()), float("nan")) for t in draw.integers(0, 4, 300)]
    rows += [(9, None, 1.0, 2.0), (8, None, None, None)]
    df = spark.createDataFrame(rows, "t int, a double, b double, c double")
    got = {r["t"]: r for r in runs.leaderboard(df, ["t"], ["a", "b", "c"]).collect()}
    assert len(sorts) == 1 and set(got) == {0, 1, 2, 3, 8, 9}
    for t, r in got.items():
        for k, m in ((1, "a"), (2, "b"), (3, "c")):
            x = [v[k] for v in rows if v[0] == t and v[k] is not None and v[k] == v[k]]
            assert r[f"{m}_count"] == len(x)
            assert r[f"{m}_median"] == (pytest.approx(np.median(x)) if x else None)


@pytest.mark.parametrize("rate", [0.0, 0.07, 0.5, 0.97, 1.0])
def test_exact_block_mask_hides_the_target_count(spark, rate):
    from plantmon.operators import masks

    rows = [(e, i, "test" if i % 90 > 60 else "train", 1.0, 2.0) for e in (1, 2) for i in range(180) if i % 17]
    df = spark.createDataFrame(rows, "e int, i long, split string, a double, b double")
    out = masks.mask_block_exact(df, ["e"], "i", ["a", "b"], rate, 7, 3, split="split").collect()
    assert len(out) == len(rows)
    for s in ("train", "test"):
        cells = [r[f"mask_{c}"] for r in out if r["split"] == s for c in "ab"]
        assert sum(cells) == min(max(1, round(len(cells) * rate)), len(cells) - 1)
    if rate == 0.07:
        # All but the last stretch are whole: few cells stand alone.
        hidden = {(r["e"], r["split"], r["i"]) for r in out if r["mask_a"]}
        alone = [x for x in hidden if not {(x[0], x[1], x[2] + d) for d in (-2, -1, 1, 2)} & hidden]
        assert len(alone) <= 4


def test_passes_write_no_rows_and_find_the_same(spark, monkeypatch):
    from plantmon.operators import outliers

    staged = []
    real = outliers.stage
    monkeypatch.setattr(outliers, "stage", lambda df, label="stage": (staged.append(label), real(df, label))[1])
    draw = np.random.default_rng(5)
    x = draw.normal(size=400)
    x[::40] += 30
    x[5::50] += 6
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "e int, i long, x double")
    rule = outliers.OutlierRule(method="zscore", max_removal_ratio=0.5)
    got = {r["i"]: r["severity"] for r in outliers.multipass_outliers(df, ["x"], rule, ["e"], "i", passes=4).where("marked").collect()}
    alive, want = np.ones(400, bool), {}
    for _ in range(4):
        z = np.abs((x - x[alive].mean()) / x[alive].std()) - rule.z_threshold
        fall = np.flatnonzero(alive & (z > 0))
        want |= {int(i): z[i] for i in fall}
        alive[fall] = False
        if not len(fall):
            break
    assert len(want) > 10 and got == pytest.approx(want)
    assert staged == ["rows"]


def test_fingerprint_cells_do_not_reach_into_each_other(spark):
    def prints(rows):
        df = spark.createDataFrame([(0, *r) for r in rows], "g int, i int, a string, b string")
        return splits.table_fingerprint(df, ["g"], ["i"], ["a", "b"]).first()["fingerprint"]

    assert len({prints([(0, *r)]) for r in (("a|b", "c"), ("a", "b|c"), ("a|b|c", ""), ("null", "c"), (None, "c"), ("-", "c"), ("1:x", "c"))}) == 7


def test_too_many_classes_are_refused(spark, monkeypatch):
    monkeypatch.setattr(metrics, "MOST_CLASSES", 3)
    df = spark.createDataFrame([(i, i % 2) for i in range(4)], "t int, p int")
    with pytest.raises(ValueError, match="confusion_counts"):
        metrics.confusion_matrix(df, "t", "p")


def test_score_files_follow_the_rows(spark, tmp_path):
    from plantmon.sources import sinks

    df = spark.range(1_000).select(F.when(F.col("id") < 900, "a").when(F.col("id") < 950, "b").alias("stage"), "id")
    path = str(tmp_path / "scores")
    sinks.write_scores(df, path, files_per_stage=2, file_rows=100)
    back = spark.read.parquet(path).withColumn("file", F.input_file_name())
    files = {r["stage"]: r["n"] for r in back.groupBy("stage").agg(F.countDistinct("file").alias("n")).collect()}
    assert files["a"] > 2 and files["b"] <= 2 and files[None] <= 2
    assert sorted(r["id"] for r in back.collect()) == list(range(1_000))
