"""Known answers on small literal tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantmon.operators import (
    calibrate, cell_tree, clean, isolate, labels, masks, metrics, outliers, reports, roles, runs, scale, scores,
    splits, windows,
)
from plantmon.plans import hash_rank

NAN, INF = float("nan"), float("inf")


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def series(spark, values, name="x", episode=0):
    return frame(spark, [(episode, i, float(v)) for i, v in enumerate(values)],
                 f"episode bigint, raw_index bigint, {name} double").repartition(3)


def removed(df):
    return sorted(r.raw_index for r in df.where("removed").collect())


# --- cleaning ----------------------------------------------------------------


def test_missing_values_are_interpolated_then_repeated_at_the_edge(spark):
    df = frame(spark, [(0, 0, 1.0, 0.0), (0, 1, NAN, 1.0), (0, 2, 3.0, 2.0), (0, 3, INF, 3.0)],
               "episode bigint, raw_index bigint, x double, y double")
    for size in (1, 2, 65_536):
        out = clean.handle_missing(df, ["episode"], "raw_index", ["x", "y"], size=size)
        assert [r.x for r in out.orderBy("raw_index").collect()] == [1.0, 2.0, 3.0, 3.0]
    summary = clean.missing_summary(df, out, ["x", "y"], "interpolate_then_drop").first()
    assert (summary.original_rows, summary.removed_rows, summary.remaining_non_finite_rows) == (4, 0, 0)


def test_a_channel_without_any_value_is_dropped(spark):
    df = frame(spark, [(0, 0, None), (0, 1, NAN), (1, 0, 5.0)], "episode bigint, raw_index bigint, x double")
    out = clean.handle_missing(df, ["episode"], "raw_index", ["x"])
    assert [tuple(r) for r in out.collect()] == [(1, 0, 5.0)]
    with pytest.raises(ValueError):
        clean.handle_missing(df, ["episode"], "raw_index", ["x"], "guess")


def test_interpolation_counts_rows_not_index_values(spark):
    df = frame(spark, [(0, 0, 0.0), (0, 10, None), (0, 11, 4.0)], "episode bigint, raw_index bigint, x double")
    out = clean.fill_gaps(df, ["episode"], "raw_index", ["x"]).orderBy("raw_index").collect()
    assert [r.x for r in out] == [0.0, 2.0, 4.0]


# --- outliers ----------------------------------------------------------------


def test_mad_finds_the_global_outlier(spark):
    df = series(spark, [20.0 if i == 10 else 1.0 for i in range(30)])
    rule = outliers.OutlierRule("mad", max_removal_ratio=0.2)
    assert removed(outliers.multipass_outliers(df, ["x"], rule, ["episode"], "raw_index", 1)) == [10]


@pytest.mark.parametrize("size", [4, 65_536])
def test_local_rule_finds_the_spike(spark, size):
    x = np.linspace(0, 1, 40)
    x[20] += 5
    local = outliers.LocalRule(radius=4, mad_threshold=6.0, min_side=2, min_abs=0.5)
    rule = outliers.OutlierRule("zscore", z_threshold=99.0, max_removal_ratio=0.1, local=local)
    out = outliers.multipass_outliers(series(spark, x), ["x"], rule, ["episode"], "raw_index", 1, size=size)
    assert 20 in removed(out)


def test_removals_are_capped_worst_first(spark):
    rule = outliers.OutlierRule("tail_percent", tail_percent=40, max_removal_ratio=0.1)
    assert removed(outliers.multipass_outliers(series(spark, range(20)), ["x"], rule, ["episode"], "raw_index", 1)) == [0, 19]


def test_test_rows_are_marked_never_removed(spark):
    rows = [(0, i, 50.0 if i == 4 else (100.0 if i >= 15 else 0.0), "test" if i >= 15 else "train") for i in range(20)]
    df = frame(spark, rows, "episode bigint, raw_index bigint, x double, split string")
    rule = outliers.OutlierRule("zscore", z_threshold=2.0, max_removal_ratio=0.2)
    out = outliers.fit_apply_outliers(df, ["x"], rule, ["episode"], "raw_index")
    report = {r.split: r for r in outliers.outlier_report(out, rule, ["split"]).collect()}
    assert report["train"].removed_rows == 1 and report["train"].marked_rows == 1
    assert report["test"].marked_rows == 5 and report["test"].removed_rows == 0


def test_too_few_rows_left_is_an_error(spark):
    rule = outliers.OutlierRule("tail_percent", tail_percent=40, max_removal_ratio=1.0, min_remaining_rows=19)
    with pytest.raises(ValueError):
        outliers.multipass_outliers(series(spark, range(20)), ["x"], rule, ["episode"], "raw_index", 1)


# --- scaling -----------------------------------------------------------------


def test_minmax_is_fitted_on_train_and_inverts(spark):
    train = frame(spark, [(0.0, 2.0), (2.0, 2.0), (4.0, 2.0)], "a double, b double")
    model = scale.fit_scaler(train, ["a", "b"], "minmax")
    assert [r.a for r in model.transform(train).orderBy("a").collect()] == [0.0, 0.5, 1.0]
    test = frame(spark, [(6.0, 2.0)], "a double, b double")
    assert model.transform(test).first().a == 1.5
    assert tuple(model.inverse_transform(model.transform(test)).first()) == (6.0, 2.0)
    assert model.summary(spark).first().constant_columns == 1


def test_changing_test_rows_leaves_the_fit_alone(spark):
    train = series(spark, range(10))
    a = scale.fit_scaler(train, ["x"])
    b = scale.fit_scaler(train.unionByName(series(spark, [1e9], episode=1)).where("episode = 0"), ["x"])
    assert a.center == b.center and a.scale == b.scale


# --- roles -------------------------------------------------------------------


def test_roles_choose_inputs_and_targets(spark):
    df = roles.with_roles(frame(spark, [(0.0, 1.0, 2.0, 0)], "time double, u double, y double, label int"),
                          {"time": "time", "u": "control", "y": "output", "label": "label"})
    assert roles.task_targets(df, "prediction") == ["y"]
    assert roles.task_inputs(df, "prediction", ["control", "output"]) == ["u", "y"]
    view = roles.task_view(df, "reconstruction", inputs=["control", "output"])
    assert view.columns == ["in_u", "in_y", "out_u", "out_y"]
    with pytest.raises(ValueError):
        roles.resolve(df, ["nothing"])


def test_labels_unseen_at_fit_time_fail(spark):
    seen = frame(spark, [("normal",), ("b",), ("a",)], "label string")
    mapping = roles.label_mapping(seen, "label", "normal")
    assert {r.label: r.class_id for r in mapping.collect()} == {"normal": 0, "a": 1, "b": 2}
    new = frame(spark, [("c",)], "label string")
    assert roles.unseen_labels(new, "label", mapping).count() == 1
    with pytest.raises(Exception, match="unknown label"):
        roles.encode_labels(new, "label", mapping).collect()


# --- windows -----------------------------------------------------------------


def two_segments(spark, n, cut):
    rows = [(int(i >= cut), i, float(i), 10.0 * i, 20.0 + i, 40.0 + i, 60.0 + i) for i in range(n)]
    return frame(spark, rows, "segment int, raw_index bigint, u double, y double, o double, c double, r double")


def starts(df):
    return sorted(r.start for r in df.collect())


@pytest.mark.parametrize("size", [2, 65_536])
def test_window_starts_stay_inside_segments(spark, size):
    df = two_segments(spark, 10, 5)
    out = windows.window_dynamic(df, ["segment"], "raw_index", ["u"], ["y"], 2, 1, size=size)
    assert starts(out) == [0, 1, 2, 5, 6, 7]
    first = out.orderBy("start").first()
    assert first.history == [0.0, 0.0, 1.0, 10.0] and first.future == [2.0, 20.0] and first.target == [20.0]


def test_sequence_tasks(spark):
    df = two_segments(spark, 12, 6).withColumn("y", F.col("u") + 100)
    by, args = ["segment"], ("raw_index", ["u"], ["y"], 3)
    one = windows.window_sequence(df, by, *args, "n_to_1")
    assert starts(one) == [0, 1, 2, 6, 7, 8]
    assert one.orderBy("start").first().target == [[103.0]]
    assert starts(windows.window_sequence(df, by, *args, "n_to_n")) == [0, 1, 2, 3, 6, 7, 8, 9]
    assert starts(windows.window_sequence(df, by, *args, "n_to_m", target_length=2)) == [0, 1, 6, 7]
    with pytest.raises(ValueError):
        windows.window_sequence(df, by, *args, "n_to_x")


def test_control_windows(spark):
    df = two_segments(spark, 12, 6)
    out = windows.window_mpc(df, ["segment"], "raw_index", state=["u"], output=["o"], control=["c"], reference=["r"],
                             past=2, prediction=2, control_steps=1)
    assert starts(out) == [0, 1, 2, 6, 7, 8]
    first = out.orderBy("start").first()
    assert first.past == [[0.0, 20.0, 40.0, 60.0], [1.0, 21.0, 41.0, 61.0]] and first.control_future == [[42.0]]


# --- splits ------------------------------------------------------------------


def test_stratified_counts(spark):
    rows = [(i, i % 2) for i in range(24)]
    out = splits.split_stratified(frame(spark, rows, "id bigint, label int"), ["id"], "label", 0.25, 1)
    got = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert got == {(0, "train"): 9, (0, "test"): 3, (1, "train"): 9, (1, "test"): 3}
    with pytest.raises(ValueError):
        splits.split_stratified(frame(spark, [(1, 0)], "id bigint, label int"), ["id"], "label", 0.25, 1)


def test_groups_stay_whole(spark):
    df = frame(spark, [(g, i) for g in range(5) for i in range(6)], "g bigint, i bigint")
    sides = splits.split_group(df, "g", 0.4, 3).groupBy("g").agg(F.countDistinct("split").alias("n"), F.first("split").alias("s"))
    rows = sides.collect()
    assert len(rows) == 5 and all(r.n == 1 for r in rows)
    assert sum(r.s == "test" for r in rows) == 2


def test_random_split_does_not_depend_on_row_order(spark):
    df = frame(spark, [(i,) for i in range(101)], "id bigint")
    a = {r.id for r in splits.split_random(df, ["id"], 0.25, 9).where("split = 'test'").collect()}
    b = {r.id for r in splits.split_random(df.orderBy(F.desc("id")).repartition(7), ["id"], 0.25, 9).where("split = 'test'").collect()}
    assert a == b and len(a) == round(101 * 0.25)
    assert hash_rank(df, ["id"], 9, "d").agg(F.max("d")).first()[0] == 100


def test_five_stages_and_gaps():
    plan = splits.plan_stages(1000, minimum_gap=10, span=5, episode_length=24)
    assert [b - a for _, a, b in plan.stages] == [528, 144, 96, 96, 96]
    assert plan.gaps == ((528, 538), (682, 692), (788, 798), (894, 904))
    assert splits.minimum_episodes(0.5) == 1 and splits.minimum_episodes(0.1) == 9
    with pytest.raises(ValueError):
        splits.plan_stages(40, minimum_gap=10, span=5, episode_length=24)


def test_fault_rows_do_not_change_the_train_fingerprint(spark):
    df = frame(spark, [(i, float(i), "train" if i < 5 else "fault") for i in range(10)], "i bigint, x double, stage string")
    changed = df.withColumn("x", F.when(F.col("stage") == "fault", F.col("x") + 1).otherwise(F.col("x")))
    a, b = ({r.stage: r.fingerprint for r in splits.table_fingerprint(d, ["stage"], ["i"], ["x"]).collect()} for d in (df, changed))
    assert a["train"] == b["train"] and a["fault"] != b["fault"]
    swapped = df.withColumn("x", F.when(F.col("i") == 0, 1.0).when(F.col("i") == 1, 0.0).otherwise(F.col("x")))
    c = {r.stage: r.fingerprint for r in splits.table_fingerprint(swapped, ["stage"], ["i"], ["x"]).collect()}
    assert c["train"] != a["train"]


@pytest.mark.parametrize("nodes", [(16, 1_024), (2, 3)])
def test_holdout_slices_match_an_exhaustive_greedy(spark, monkeypatch, nodes):
    monkeypatch.setattr(splits, "NODES", nodes)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(0, 9, 40), rng.integers(5, 20, 40), rng.integers(0, 20, 43)]).astype(float)
    y = rng.normal(size=len(x)) * np.linspace(1, 3, len(x))
    y[rng.random(len(x)) < 0.1] = np.nan
    df = frame(spark, [(i, float(a), None if i % 50 == 7 else float(b)) for i, (a, b) in enumerate(zip(x, y))], "pos bigint, x double, y double")
    y[7::50] = np.nan
    length, ratio = 10, 0.3
    ids = np.minimum(np.arange(len(x)) // length, 11)
    goal = max(1, round(len(x) * ratio))

    def describe(v):
        return np.concatenate([[f(v, axis=0) for f in (np.nanmean, np.nanstd, np.nanmin, np.nanmax)], np.nanpercentile(v, [10, 25, 50, 75, 90], axis=0)]).ravel()

    for names, data in ((["x"], x[:, None]), (["x", "y"], np.stack([x, y], axis=1))):
        chosen = []
        while np.isin(ids, chosen).sum() < goal:
            best = None
            for s in sorted(set(ids) - set(chosen)):
                held = np.isin(ids, [*chosen, s])
                gap = np.linalg.norm(describe(data[held]) - describe(data[~held]))
                span = (np.nanmax(data[held], axis=0) - np.nanmin(data[held], axis=0)) / (np.nanmax(data, axis=0) - np.nanmin(data, axis=0))
                cost = gap + abs(held.sum() - goal) / goal + np.mean(np.maximum(0.0, 1 - span))
                best = min(best or (math.inf, -1), (cost, s))
            chosen.append(int(best[1]))
        out = splits.split_dynamic(df, "pos", names, length=length, test_ratio=ratio)
        got = sorted({r.slice for r in out.where("split = 'test'").select("slice").distinct().collect()})
        assert got == sorted(chosen)
    assert splits.choose_holdout(splits.slice_ids(df.where("false"), "pos", 10), "x", 5) == []


def test_holdout_reads_few_jobs_however_many_slices_it_takes(spark, monkeypatch):
    monkeypatch.setattr(splits, "NODES", (2, 16))
    rng = np.random.default_rng(8)
    df = frame(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.normal(size=600), rng.integers(0, 40, 600)))], "pos bigint, x double, y double")
    sliced = splits.slice_ids(df, "pos", 10)

    def chosen(rows):
        group = f"holdout-{rows}-{rng.random()}"
        spark.sparkContext.setJobGroup(group, "holdout")
        try:
            return splits.choose_holdout(sliced, ["x", "y"], rows), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    few, many = chosen(20), chosen(160)
    assert len(many[0]) == 16 and many[1] <= few[1] + 10
    monkeypatch.setattr(splits, "HELD_VALUES", 0)
    read = splits.choose_holdout(sliced, ["x", "y"], 60)
    monkeypatch.undo()
    assert splits.choose_holdout(sliced, ["x", "y"], 60) == read


def test_holdout_brings_counts_to_the_driver_in_parts(spark, monkeypatch):
    monkeypatch.setattr(splits, "NODES", (2, 16))
    rng = np.random.default_rng(9)
    df = frame(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))], "pos bigint, x double, y double")
    sliced = splits.slice_ids(df, "pos", 10)
    whole = splits.choose_holdout(sliced, ["x", "y"], 60)
    monkeypatch.setattr(splits, "FETCHED", 150, raising=False)
    rows, tables, kind = [], [], type(df)
    collect, arrow = kind.collect, kind.toArrow

    def collected(self):
        out = collect(self)
        rows.append(len(out))
        return out

    def read(self):
        out = arrow(self)
        tables.append(out.num_rows)
        return out

    monkeypatch.setattr(kind, "collect", collected)
    monkeypatch.setattr(kind, "toArrow", read)
    assert splits.choose_holdout(sliced, ["x", "y"], 60) == whole
    # Per slice and target at most; there are about 1,000 counts per range.
    assert max(rows) <= 120 and max(tables) <= 150 and sum(tables) > 600


def test_dynamic_split_keeps_a_train_slice_and_refuses_too_many(spark, monkeypatch):
    df = frame(spark, [(i, float(i % 7)) for i in range(40)], "pos bigint, x double")
    out = splits.split_dynamic(df, "pos", "x", length=10, test_ratio=0.95)
    assert out.where("split = 'train'").count() == 10
    monkeypatch.setattr(splits, "SUMMARY_NUMBERS", 10)
    with pytest.raises(ValueError, match="longer slices"):
        splits.split_dynamic(df, "pos", "x", length=10)


# --- detection ---------------------------------------------------------------


def test_percentile_alarm_finds_all_faults(spark):
    normal = frame(spark, [(v,) for v in (0.1, 0.2, 0.15, 0.18, 0.12)], "s double")
    cut = scores.percentile_threshold(normal, "s", 0.2)
    assert cut == pytest.approx(np.percentile([0.1, 0.2, 0.15, 0.18, 0.12], 80))
    test = frame(spark, [(0.1, 0), (0.25, 0), (2.0, 1), (3.0, 1)], "s double, y int")
    row = scores.detection_metrics(test, "s", cut, "y").first()
    assert row.fdr == 1.0 and row.false_alarms == 1


def test_procedure_names():
    assert scores.parse_procedure(" re-T2-KDE ").name == "re-T2-kde"
    for bad in ("re-T2", "xx-T2-kde", "re-XX-kde", "re-T2-mean"):
        with pytest.raises(ValueError):
            scores.parse_procedure(bad)


def test_class_metrics(spark):
    logits = [[2.0, 0.0], [0.0, 1.0], [3.0, 1.0], [1.0, 0.0]]
    df = frame(spark, list(zip([0, 1, 1, 0], logits)), "t bigint, z array<double>").withColumn("p", metrics.predicted_class("z"))
    assert [r.p for r in df.collect()] == [0, 1, 0, 0]
    assert metrics.classification_metrics(df, "t", "p").first().accuracy == 0.75
    assert metrics.confusion_matrix(df, "t", "p").count() == 2


def test_contributions(spark):
    df = frame(spark, [(1.0, -2.0, 0.0, 1.0), (3.0, -4.0, 0.5, 0.0)], "a double, b double, c double, d double")
    row = metrics.contribution_metrics(df, ["a", "b"], ["c", "d"]).where("dimension IS NULL").first()
    assert (row.first_mean_abs, row.second_mean_abs, row.sparsity) == (2.5, 0.375, 0.5)
    assert row.ratio == pytest.approx(0.15) and row.fm_mean_abs == row.cross_mean_abs == 0.375


def test_best_run_prefers_r2_inside_the_tolerance(spark):
    df = frame(spark, [("t", 1, 1.0, 0.5), ("t", 2, 1.1, 0.9), ("t", 3, 1.0, 0.7), ("t", 4, NAN, 9.0)],
               "k string, at bigint, rmse double, r2 double")
    assert runs.best_run(df, ["k"], "at").first().at == 3
    for size in (1, 2, 100):
        assert runs.best_run(df, ["k"], "at", eps=1e-9, size=size).first().at == 3
    drift = frame(spark, [("t", i, 1.0 + 0.05 * i, 0.2 * i) for i in range(9)] + [("u", 0, 2.0, None), ("u", 1, 2.0, 0.1)],
                  "k string, at bigint, rmse double, r2 double")
    got = {r.k: r.at for r in runs.best_run(drift, ["k"], "at", eps=0.06, size=2).collect()}
    assert got == {"t": 8, "u": 1}


# --- calibration -------------------------------------------------------------


def test_rank_is_attainable_or_infinite(spark):
    maxima = frame(spark, [("s", float(i)) for i in range(1, 10)], "score_name string, max_score double")
    got = calibrate.conformal_thresholds(maxima, 0.1).first()
    assert (got["rank"], got.threshold, got.finite) == (9, 9.0, True)
    got = calibrate.conformal_thresholds(maxima, 0.05).first()
    assert (got["rank"], got.threshold, got.finite) == (10, INF, False)
    assert calibrate.conformal_status(maxima, 0.05).first().status == calibrate.INSUFFICIENT
    broken = maxima.unionByName(frame(spark, [("s", INF)], "score_name string, max_score double"))
    row = calibrate.conformal_status(broken, 0.2).first()
    assert row.status == calibrate.INCOMPLETE and row.quantile == INF


def test_unresolved_thresholds_never_alarm(spark):
    df = frame(spark, [(5.0, 1.0, 1.0, 1.0), (5.0, 1.0, INF, 1.0)], "statistic double, gamma_anchor double, radius double, scale double")
    none = calibrate.dynamic_threshold(df, None).collect()
    assert all(r.threshold == INF and r.alarm is False for r in none)
    ready = frame(spark, [(0.5, "ready")], "quantile double, status string")
    got = calibrate.dynamic_threshold(df, ready).orderBy("threshold").collect()
    assert (got[0].threshold, got[0].alarm) == (2.5, True)
    assert (got[1].threshold, got[1].alarm, got[1].reason) == (INF, False, "radius unsupported")


def test_age_curve_rejects_holes(spark):
    ok = frame(spark, [(0, 3.0), (1, 1.0), (2, 5.0)], "age bigint, v double")
    curve = calibrate.age_envelope(ok, "age", "v", 0.9).orderBy("age").collect()
    assert [r.envelope for r in curve] == [3.0, 3.0, 5.0]
    with pytest.raises(Exception, match="without a hole"):
        calibrate.age_envelope(ok.where("age <> 1"), "age", "v", 0.9).collect()


# --- labels and isolation ----------------------------------------------------


def test_intervals_with_hot_episode_and_small_blocks(spark):
    df = frame(spark, [(e, i) for e, n in ((1, 60), (2, 5)) for i in range(n)], "episode bigint, raw_index bigint")
    spans = frame(spark, [(1, 3, 5, 7), (1, 20, 41, 8), (2, 0, 0, 9)], "episode bigint, start bigint, stop bigint, fault_id int")
    for size in (4, 65_536):
        got = {(r.episode, r.raw_index): r.fault_label for r in labels.label_by_interval(df, spans, "episode", "raw_index", size=size).collect()}
        want = {(e, i): (7 if e == 1 and 3 <= i <= 5 else 8 if e == 1 and 20 <= i <= 41 else 9 if (e, i) == (2, 0) else 0) for e, i in got}
        assert got == want and len(got) == 65


def test_undeclared_fault_fails(spark):
    families = frame(spark, [(1, "sensor")], "fault_id int, family string")
    df = frame(spark, [(0,), (1,)], "fault_id int")
    assert {r.family for r in labels.fault_family(df, "fault_id", families).collect()} == {"normal", "sensor"}
    with pytest.raises(Exception, match="undeclared fault id"):
        labels.fault_family(frame(spark, [(4,)], "fault_id int"), "fault_id", families).collect()


def test_cell_library_larger_than_one_batch(spark, monkeypatch):
    rng = np.random.default_rng(0)
    cells = [(f"F{i % 3}", rng.normal(size=4).tolist(), [0.5] * 4) for i in range(11)]
    obs = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    c = frame(spark, cells, "family_id string, center array<double>, scale array<double>")
    o = frame(spark, obs, "id bigint, f array<double>")
    monkeypatch.setattr(cell_tree, "PART_BYTES", 200)
    got = {(r.id, r.family_id): r.score for r in isolate.family_scores(o, "f", c, ["id"]).collect()}
    for i, f in obs:
        for k in range(3):
            near = [max(abs(a - b) / s for a, b, s in zip(f, ctr, sc)) for fam, ctr, sc in cells if fam == f"F{k}"]
            assert got[i, f"F{k}"] == pytest.approx(min(near))


def test_radius_is_closed_and_outcomes_follow_the_set(spark):
    s = frame(spark, [(0, "N", 9.0), (0, "A", 1.0), (1, "N", 9.0), (1, "A", 1.5), (2, "N", 0.1), (2, "A", 0.2),
                      (3, "N", 9.0), (3, "A", 0.2), (3, "B", 0.1)], "id bigint, family_id string, score double")
    radii = frame(spark, [("N", 1.0), ("A", 1.0), ("B", 1.0)], "family_id string, radius double")
    obs = frame(spark, [(i, 5.0) for i in range(4)], "id bigint, detection_excess double")
    sets = isolate.candidate_sets(isolate.feasible_families(s, radii), obs, ["id"], normal="N", detection_quantile=1.0)
    got = {r.id: (r.isolation_outcome, r.reported_family) for r in isolate.isolation_outcome(sets, "N").collect()}
    assert got == {0: ("singleton", "A"), 1: ("Out-of-model", None), 2: ("Normal-compatible", None), 3: ("Nonunique", None)}
    unsure = isolate.candidate_sets(isolate.feasible_families(s, radii), obs, ["id"], normal="N", detection_quantile=1.0, calibration_ready=False)
    assert {r.isolation_outcome for r in isolate.isolation_outcome(unsure, "N").collect()} == {"Normal-compatible"}
    with pytest.raises(ValueError):
        isolate.normal_calibration(s, ["id"], "N", 0.2, 0.1)


def test_onset_after_the_last_row(spark):
    df = frame(spark, [(1, i, i == 3) for i in range(5)], "episode bigint, raw_index bigint, alarm boolean")
    on = frame(spark, [(1, 9, 2)], "episode bigint, onset bigint, fault_id bigint")
    row = reports.episode_detection_report(df, on, "episode", "raw_index").first()
    assert (row.pre_fault_alarm_count, row.post_onset_row_count, row.detection_delay_steps) == (1, 0, None)


# --- masks, whitening, pca ---------------------------------------------------


def test_masks_keep_one_cell_on_each_side(spark):
    df = series(spark, range(6))
    none = masks.mask_random(df, ["episode", "raw_index"], ["x"], 0.0, 1)
    every = masks.mask_random(df, ["episode", "raw_index"], ["x"], 1.0, 1)
    assert none.where("mask_x").count() == 1 and every.where("NOT mask_x").count() == 1


def test_whitening_falls_back_to_identity(spark):
    df = frame(spark, [(1.0, 2.0), (2.0, 1.0)], "a double, b double")
    w = scores.fit_whitening(df, ["a", "b"])
    assert not w.stable and np.array_equal(w.operator, np.eye(2)) and "fewer" in w.reason


def test_whitening_matches_a_direct_shrinkage(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) @ np.array([[2, 0.3, 0], [0, 1, 0.4], [0, 0, 0.5]])
    df = frame(spark, [tuple(map(float, r)) for r in x], "a double, b double, c double")
    w = scores.fit_whitening(df, ["a", "b", "c"], ridge=0.0)
    z = x - x.mean(axis=0)
    cov = z.T @ z / len(z)
    mu = np.trace(cov) / 3
    d2 = ((cov - mu * np.eye(3)) ** 2).sum() / 3
    b2 = sum(((np.outer(r, r) - cov) ** 2).sum() for r in z) / 3 / len(z) ** 2
    shrink = min(b2, d2) / d2
    assert w.shrinkage == pytest.approx(shrink)
    full = (1 - shrink) * cov + shrink * mu * np.eye(3)
    assert w.operator @ full @ w.operator.T == pytest.approx(np.eye(3), abs=1e-9)


def test_pca_scores_match_a_direct_decomposition(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4))
    df = frame(spark, [tuple(map(float, r)) for r in x], "a double, b double, c double, d double").coalesce(1)
    got = np.array([(r.hotelling_t2, r.spe_q) for r in scores.pca_scores(df, scores.fit_pca(df, list("abcd"))).collect()])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    latent = z @ v[:2].T
    t2 = (latent**2 / (s[:2] ** 2 / 49)).sum(axis=1)
    q = ((z - latent @ v[:2]) ** 2).sum(axis=1)
    assert got == pytest.approx(np.column_stack([t2, q]))


def test_constant_target_has_no_r2(spark):
    df = frame(spark, [("t", 1.0, 1.0), ("t", 1.0, 2.0)], "k string, y double, p double")
    assert all(math.isnan(r.r2) for r in metrics.regression_metrics(df, "k", "y", "p").collect())


# --- chains --------------------------------------------------------------------


def test_preparing_keeps_order_and_summaries(spark):
    from plantmon.operators.prepare import prepare

    rows = [(0, i, None if i == 2 else float(i % 5), "b" if i > 15 else "a") for i in range(20)]
    df = frame(spark, rows, "episode bigint, raw_index bigint, x double, label string")
    out = prepare(
        df, ["episode"], "raw_index", ["x"], label="label",
        split=lambda d: splits.split_sequential(d, ["episode"], "raw_index", 0.25),
        outlier_rule=outliers.OutlierRule("zscore", z_threshold=9.0),
        mask=lambda d: masks.mask_random(d, ["episode", "raw_index"], ["x"], 0.3, 1, split="split"),
    )
    assert out.data.count() == 20 and out.data.where("split = 'test'").count() == 5
    assert set(out.summaries) == {"missing", "split", "labels", "outliers", "removed", "scaler", "masks"}
    stats = out.data.where("split = 'train'").agg(F.avg("x"), F.stddev_pop("x")).first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[1] == pytest.approx(1)


def test_protocol_alarms_use_the_detection_threshold(spark):
    from plantmon.operators.prepare import normal_protocol

    rng = np.random.default_rng(8)
    rows = [(i, i + (i > 300), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(1000, 2)))]
    df = frame(spark, rows, "pos bigint, raw bigint, a double, b double")
    plan = splits.plan_stages(1000, minimum_gap=10, span=5, episode_length=8)
    out = normal_protocol(df, "pos", "raw", ["a", "b"], plan, 0.1)
    cut = {r.score_name: r.threshold for r in out.detection.collect()}
    assert set(cut) == {"hotelling_t2", "spe_q"}
    for r in out.scores.collect():
        assert r.threshold == cut[r.score_name] and r.alarm == (r.score > r.threshold)
    late = normal_protocol(df.withColumn("a", F.when(F.col("pos") >= 904, 50.0).otherwise(F.col("a"))), "pos", "raw", ["a", "b"], plan, 0.1)
    assert {r.score_name: r.threshold for r in late.detection.collect()} == cut


def test_evaluators_by_name(spark):
    from plantmon.operators import evaluators

    df = frame(spark, [("t", 1.0, 2.0), ("t", 3.0, 3.0)], "k string, y double, p double")
    assert evaluators.evaluate("regression", df, target="k", y_true="y", y_pred="p").count() == 2
    with pytest.raises(ValueError):
        evaluators.register_evaluator("regression", metrics.regression_metrics)
    with pytest.raises(ValueError):
        evaluators.evaluate("none", df)
