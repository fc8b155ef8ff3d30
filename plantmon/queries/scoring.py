"""Monitoring statistics, thresholds and detection metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantmon.functions.vectors import l2, pack
from plantmon.operators import calibrate, clean, evaluators, outliers, prepare, scores, splits
from plantmon.plans import lookup
from plantmon.queries import views as v
from plantmon.queries.registry import query
from plantmon.queries.splitting import EPISODE, EPISODES, OPTIONS, STAGED

KEYS = ["episode", "raw_index"]
TRAIN = "raw_index % 4 <> 3"
NORMAL = f"{TRAIN} AND fault = 0"

SPLIT = """SELECT w.*, w.raw_index < 0.8 * n.n AS train FROM proc_wide w JOIN (SELECT episode, count(*) AS n FROM proc_wide GROUP BY episode) n ON w.episode = n.episode"""
FLAGSHIP = f"""WITH parted AS ({SPLIT}), s AS (SELECT avg(x0) AS m0, var_pop(x0) AS v0, avg(x1) AS m1, var_pop(x1) AS v1 FROM parted WHERE train),
    scored AS (SELECT p.*, (x0 - m0) * (x0 - m0) / v0 + (x1 - m1) * (x1 - m1) / v1 AS t2 FROM parted p, s),
    cut AS (SELECT quantile_cont(t2, 0.95) AS threshold FROM scored WHERE train AND fault = 0),
    c AS (SELECT threshold, count(*) FILTER (t2 > threshold AND fault = 0) AS false_alarms, count(*) FILTER (NOT t2 > threshold AND fault = 1) AS missed,
    count(*) FILTER (t2 > threshold AND fault = 1) AS detected, count(*) FILTER (fault = 0) AS normal_rows, count(*) FILTER (fault = 1) AS fault_rows
    FROM scored, cut WHERE NOT train GROUP BY threshold)
    SELECT *, false_alarms / greatest(normal_rows, 1) AS far, missed / greatest(fault_rows, 1) AS mdr, detected / greatest(fault_rows, 1) AS fdr FROM c"""


@query("flagship_detection", f"SELECT * FROM ({FLAGSHIP})", views=["proc_wide"], rounded=["threshold", "far", "mdr", "fdr"])
def _flagship(spark, sf):
    """Split each recording, fit on its first 80 %, calibrate, alarm, report."""
    wide = v.proc_wide(spark, sf).select(*KEYS, "x0", "x1", "fault")
    counts = wide.groupBy("episode").agg(F.count("*").alias("n"))
    parted = lookup(wide, counts, "episode", "inner", salt_by=KEYS).withColumn("train", F.col("raw_index") < 0.8 * F.col("n"))
    train = parted.where("train")
    t2 = scores.fit_t2(train, ["x0", "x1"]).score(["x0", "x1"])
    threshold = scores.percentile_threshold(train.where("fault = 0"), t2, 0.05)
    report = scores.detection_metrics(parted.where("NOT train"), t2, threshold, "fault")
    return report.withColumn("threshold", F.lit(threshold))


@query("reconstruction_score", "SELECT episode, raw_index, ((x0 - x2) * (x0 - x2) + (x0 - x3) * (x0 - x3)) / 2 AS score FROM proc_wide", views=["proc_wide"], rounded=["score"])
def _reconstruction(spark, sf):
    return v.proc_wide(spark, sf).select(*KEYS, scores.reconstruction_score(["x0", "x0"], ["x2", "x3"]).alias("score"))


T2 = f"""(SELECT avg(x0) AS m0, greatest(var_pop(x0), 1e-8) AS v0, avg(x1) AS m1, greatest(var_pop(x1), 1e-8) AS v1 FROM proc_wide WHERE {NORMAL})"""
T2_SCORE = "(x0 - m0) * (x0 - m0) / v0 + (x1 - m1) * (x1 - m1) / v1"


@query("t2_diag", f"SELECT episode, raw_index, {T2_SCORE} AS t2 FROM proc_wide, {T2}", views=["proc_wide"], rounded=["t2"])
def _t2(spark, sf):
    df = v.proc_wide(spark, sf)
    model = scores.fit_t2(df.where(NORMAL), ["x0", "x1"])
    return df.select(*KEYS, model.score(["x0", "x1"]).alias("t2"))


@query("q_spe", "SELECT episode, raw_index, (x0 * x0 + x2 * x2) / 2 AS q FROM proc_wide", views=["proc_wide"], rounded=["q"])
def _q(spark, sf):
    return v.proc_wide(spark, sf).select(*KEYS, scores.q_score(["x0", "x2"]).alias("q"))


@query("threshold_percentile", f"SELECT quantile_cont({T2_SCORE}, 0.9) AS threshold FROM proc_wide, {T2} WHERE {NORMAL}", views=["proc_wide"], rounded=["threshold"])
def _percentile(spark, sf):
    normal = v.proc_wide(spark, sf).where(NORMAL)
    cut = scores.percentile_threshold(normal, scores.fit_t2(normal, ["x0", "x1"]).score(["x0", "x1"]), 0.1)
    return spark.createDataFrame([(cut,)], "threshold double")


@query("threshold_ineq", f"SELECT avg(s) + stddev_pop(s) * sqrt(0.9 / 0.1) AS threshold FROM (SELECT {T2_SCORE} AS s FROM proc_wide, {T2} WHERE {NORMAL})",
       views=["proc_wide"], rounded=["threshold"])
def _ineq(spark, sf):
    normal = v.proc_wide(spark, sf).where(NORMAL)
    cut = scores.inequality_threshold(normal, scores.fit_t2(normal, ["x0", "x1"]).score(["x0", "x1"]), 0.1)
    return spark.createDataFrame([(cut,)], "threshold double")


PROC = f"""WITH ref AS (SELECT avg(x0 - x2) AS m0, var_pop(x0 - x2) AS v0, avg(x1 - x3) AS m1, var_pop(x1 - x3) AS v1, avg(x2) AS m2, var_pop(x2) AS v2
      FROM proc_wide WHERE {NORMAL}),
    s AS (SELECT w.*, (x0 - x2 - m0) * (x0 - x2 - m0) / v0 + (x1 - x3 - m1) * (x1 - x3 - m1) / v1 AS a,
      ((x0 - x2) * (x0 - x2) + (x1 - x3) * (x1 - x3)) / 2 AS b, (x2 - m2) * (x2 - m2) / v2 AS c, x3 AS d FROM proc_wide w, ref),
    long AS (SELECT raw_index, fault, 're-T2-kde' AS procedure, a AS score FROM s UNION ALL SELECT raw_index, fault, 're-Q-ineq', b FROM s
      UNION ALL SELECT raw_index, fault, 'lv-T2-pdf', c FROM s UNION ALL SELECT raw_index, fault, 'custom-CUSTOM-kde', d FROM s),
    cut AS (SELECT procedure, CASE WHEN procedure LIKE '%ineq' THEN avg(score) + stddev_pop(score) * sqrt(0.9 / 0.1) ELSE quantile_cont(score, 0.9) END AS threshold
      FROM long WHERE {NORMAL} GROUP BY procedure),
    n AS (SELECT procedure, threshold, count(*) FILTER (score > threshold AND fault = 0) AS false_alarms, count(*) FILTER (NOT score > threshold AND fault = 1) AS missed,
      count(*) FILTER (score > threshold AND fault = 1) AS detected, count(*) FILTER (fault = 0) AS normal_rows, count(*) FILTER (fault = 1) AS fault_rows
      FROM long JOIN cut USING (procedure) WHERE raw_index % 4 = 3 GROUP BY 1, 2)
    SELECT *, false_alarms / greatest(normal_rows, 1) AS far, missed / greatest(fault_rows, 1) AS mdr, detected / greatest(fault_rows, 1) AS fdr FROM n"""
RATES = {"threshold": 3, "far": 6, "mdr": 6, "fdr": 6}


def _procedures(spark, sf):
    df = v.proc_wide(spark, sf)
    fitted = scores.fit_procedures(
        df.where(NORMAL), ["re-T2-kde", "re-Q-ineq", "lv-T2-pdf", "custom-custom-kde"], 0.1,
        true=["x0", "x1"], pred=["x2", "x3"], latent=["x2"], custom="x3")
    return scores.evaluate_procedures(df.where("raw_index % 4 = 3"), fitted, "fault")


@query("procedures", f"SELECT * FROM ({PROC})", views=["proc_wide"], rounded=RATES)
def _procs(spark, sf):
    return _procedures(spark, sf)


@query("detection_aggregate", f"SELECT avg(far) AS afar, avg(mdr) AS amdr, avg(fdr) AS afdr FROM ({PROC})", views=["proc_wide"], rounded=["afar", "amdr", "afdr"])
def _aggregate(spark, sf):
    return scores.detection_aggregate(_procedures(spark, sf))


@query("detection_metrics", """SELECT label, count(*) FILTER (x0 > 40 AND fault = 0) AS false_alarms, count(*) FILTER (x0 <= 40 AND fault = 1) AS missed,
    count(*) FILTER (x0 > 40 AND fault = 1) AS detected, count(*) FILTER (fault = 0) AS normal_rows, count(*) FILTER (fault = 1) AS fault_rows,
    count(*) FILTER (x0 > 40 AND fault = 0) / greatest(count(*) FILTER (fault = 0), 1) AS far, count(*) FILTER (x0 <= 40 AND fault = 1) / greatest(count(*) FILTER (fault = 1), 1) AS mdr,
    count(*) FILTER (x0 > 40 AND fault = 1) / greatest(count(*) FILTER (fault = 1), 1) AS fdr FROM proc_wide GROUP BY label""",
       views=["proc_wide"], rounded=["far", "mdr", "fdr"])
def _metrics(spark, sf):
    return scores.detection_metrics(v.proc_wide(spark, sf), "x0", 40.0, "fault", ["label"])


FARS = (0.01, 0.05, 0.1)
SWEEP = " UNION ALL ".join(f"SELECT '{n}@{far}' AS procedure, {e} AS score, fault, raw_index FROM proc_wide"
                           for n, e in (("load", "x0"), ("price", "x1")) for far in FARS)


@query("detection_sweep", f"""SELECT * FROM (WITH long AS ({SWEEP}), cut AS (SELECT procedure, quantile_cont(score, 0.99) AS a, quantile_cont(score, 0.95) AS b, quantile_cont(score, 0.9) AS c
      FROM long WHERE {NORMAL} GROUP BY procedure),
    n AS (SELECT l.procedure, CASE WHEN l.procedure LIKE '%0.01' THEN a WHEN l.procedure LIKE '%0.05' THEN b ELSE c END AS threshold, l.score, l.fault FROM long l JOIN cut USING (procedure)),
    k AS (SELECT procedure, threshold, count(*) FILTER (score > threshold AND fault = 0) AS false_alarms, count(*) FILTER (NOT score > threshold AND fault = 1) AS missed,
      count(*) FILTER (score > threshold AND fault = 1) AS detected, count(*) FILTER (fault = 0) AS normal_rows, count(*) FILTER (fault = 1) AS fault_rows FROM n GROUP BY 1, 2)
    SELECT *, false_alarms / normal_rows AS far, missed / fault_rows AS mdr, detected / fault_rows AS fdr FROM k)""",
       views=["proc_wide"], rounded=RATES)
def _sweep(spark, sf):
    df = v.proc_wide(spark, sf)
    return scores.sweep(df, scores.fit_sweep(df.where(NORMAL), {"load": F.col("x0"), "price": F.col("x1")}, FARS), "fault")


# Two standardised channels have the eigenvectors (1, 1) and (1, -1) over sqrt 2
# and the eigenvalues 1 + r and 1 - r, so SQL can state the components.
PCA = f"""(SELECT avg(x0) AS m0, stddev_pop(x0) AS s0, avg(x1) AS m1, stddev_pop(x1) AS s1, corr(x0, x1) AS r, count(*) AS n FROM proc_wide WHERE {TRAIN})"""
Z0, Z1 = "((x0 - m0) / s0)", "((x1 - m1) / s1)"


@query("pca_fit", f"SELECT abs(r) + 1 AS correlation, (1 + abs(r)) * n / (n - 1) AS eigenvalue, m0 AS mean0, s1 AS scale1 FROM {PCA}", views=["proc_wide"],
       rounded={"correlation": 6, "eigenvalue": 6, "mean0": 4, "scale1": 4})
def _pca_fit(spark, sf):
    model = scores.fit_pca(v.proc_wide(spark, sf).where(TRAIN), ["x0", "x1"])
    n = model.scaler.rows
    top = float(model.eigenvalues[0])
    return spark.createDataFrame([(top * (n - 1) / n, top, model.scaler.center["x0"], model.scaler.scale["x1"])],
                                 "correlation double, eigenvalue double, mean0 double, scale1 double")


@query("pca_score", f"""SELECT episode, raw_index, ({Z0} + sign(r) * {Z1}) * ({Z0} + sign(r) * {Z1}) / 2 / ((1 + abs(r)) * n / (n - 1)) AS hotelling_t2,
    ({Z0} - sign(r) * {Z1}) * ({Z0} - sign(r) * {Z1}) / 2 AS spe_q FROM proc_wide, {PCA}""", views=["proc_wide"], rounded=["hotelling_t2", "spe_q"])
def _pca(spark, sf):
    df = v.proc_wide(spark, sf)
    model = scores.fit_pca(df.where(TRAIN), ["x0", "x1"])
    return scores.pca_scores(df, model).select(*KEYS, "hotelling_t2", "spe_q")


PAIRS = """(SELECT episode, raw_index, lag(x1) OVER w AS x1_now, lag(x0) OVER w AS x0_now, x1 AS x1_next, lag(raw_index) OVER w AS b FROM proc_gaps
    WINDOW w AS (PARTITION BY episode ORDER BY raw_index))"""


def _pairs(spark, sf):
    return clean.one_step_pairs(v.proc_gaps(spark, sf).select(*KEYS, "x0", "x1"), ["episode"], "raw_index", ["x0", "x1"])


@query("one_step_error", f"SELECT episode, raw_index, (x1_next - x1_now) * (x1_next - x1_now) AS score FROM {PAIRS} WHERE b = raw_index - 1", views=["proc_gaps"], rounded={"score": 5})
def _one_step(spark, sf):
    pairs = _pairs(spark, sf)
    return pairs.select(*KEYS, scores.one_step_error(pairs, ["x1_now"], ["x1_next"]).alias("score"))


@query("linear_forecast", f"""SELECT episode, raw_index, i + s * x1_now AS prediction FROM {PAIRS},
    (SELECT regr_slope(x1_next, x1_now) AS s, regr_intercept(x1_next, x1_now) AS i FROM {PAIRS} WHERE b = raw_index - 1 AND {TRAIN}) WHERE b = raw_index - 1""",
       views=["proc_gaps"], rounded={"prediction": 4})
def _forecast(spark, sf):
    pairs = _pairs(spark, sf)
    model = scores.fit_linear(pairs.where(TRAIN), ["x1_now"], ["x1_next"])
    return pairs.select(*KEYS, model.predict("x1_next").alias("prediction"))


@query("eligibility_score", f"""SELECT episode, raw_index, sqrt((pow((x0 - m0) / s0, 2) + pow((x1 - m1) / s1, 2)) / 2) AS score FROM proc_wide, {PCA}""",
       views=["proc_wide"], rounded=["score"])
def _eligibility(spark, sf):
    df = v.proc_wide(spark, sf)
    return df.select(*KEYS, scores.fit_eligibility(df.where(TRAIN), ["x0", "x1"])().alias("score"))


@query("residual_norm_score", "SELECT episode, raw_index, sqrt((x0 - x2) * (x0 - x2) + (x1 - x3) * (x1 - x3)) AS score FROM proc_wide", views=["proc_wide"], rounded={"score": 4})
def _residual(spark, sf):
    return v.proc_wide(spark, sf).select(*KEYS, scores.residual_norm(pack(["x0", "x1"]), pack(["x2", "x3"])).alias("score"))


@query("guard_score", """SELECT episode, raw_index, CASE WHEN p THEN 0 ELSE sqrt((x0 - x1 / 2000) * (x0 - x1 / 2000)) / 5 END AS score,
    CASE WHEN p THEN 'infinity'::DOUBLE ELSE 0.5 + 0.25 + 2 + (0.1 + 3 * (abs(x2) + abs(x3))) END AS threshold,
    NOT p AND sqrt((x0 - x1 / 2000) * (x0 - x1 / 2000)) / 5 > 0.5 + 0.25 + 2 + (0.1 + 3 * (abs(x2) + abs(x3))) AS alarm
    FROM (SELECT *, raw_index % 17 = 0 AS p FROM proc_wide)""", views=["proc_wide"], rounded=["score", "threshold"])
def _guard(spark, sf):
    predicted = F.when(F.col("raw_index") % 17 != 0, F.array(F.col("x1") / 2000))
    df = v.proc_wide(spark, sf).withColumn("p", predicted)
    score = scores.guard_score(pack(["x0"]), F.col("p"), 5.0)
    limit = scores.guard_threshold(F.col("p"), pack(["x2", "x3"]), floor=0.5, anchor=0.25, intercept=0.1, input_weight=3.0, quantile=2.0)
    out = df.select(*KEYS, score.alias("score"), limit.alias("threshold"))
    return out.withColumn("alarm", F.col("score") > F.col("threshold"))


# Shrinkage and eigenvalues of a 2 x 2 covariance have a closed form, and the
# whitened norm is the distance under the inverse covariance.
WHITEN = f"""(SELECT *, (c00 + c11) / 2 + sqrt((c00 - c11) * (c00 - c11) / 4 + c01 * c01) AS l1, (c00 + c11) / 2 - sqrt((c00 - c11) * (c00 - c11) / 4 + c01 * c01) AS l2 FROM (
    SELECT m0, m1, shrink, (1 - shrink) * v0 + shrink * mu + 1e-6 AS c00, (1 - shrink) * v1 + shrink * mu + 1e-6 AS c11, (1 - shrink) * k AS c01 FROM (
    SELECT *, (v0 + v1) / 2 AS mu, least((fourth - (v0 * v0 + v1 * v1 + 2 * k * k)) / (2 * n), ((v0 * v0 + v1 * v1 + 2 * k * k) - 2 * pow((v0 + v1) / 2, 2)) / 2)
      / (((v0 * v0 + v1 * v1 + 2 * k * k) - 2 * pow((v0 + v1) / 2, 2)) / 2) AS shrink FROM (
    SELECT m0, m1, v0, v1, k, n, avg(pow((x0 - m0) * (x0 - m0) + (x3 - m1) * (x3 - m1), 2)) AS fourth FROM proc_wide,
      (SELECT avg(x0) AS m0, avg(x3) AS m1, var_pop(x0) AS v0, var_pop(x3) AS v1, covar_pop(x0, x3) AS k, count(*) AS n FROM proc_wide WHERE {TRAIN})
      WHERE {TRAIN} GROUP BY ALL))))"""


@query("whitening_fit", f"SELECT shrink AS shrinkage, l1 AS eigen1, l2 AS eigen2, l1 / l2 AS condition, true AS stable FROM {WHITEN}", views=["proc_wide"],
       rounded={"shrinkage": 6, "eigen1": 4, "eigen2": 6, "condition": 3})
def _whiten_fit(spark, sf):
    w = scores.fit_whitening(v.proc_wide(spark, sf).where(TRAIN), ["x0", "x3"])
    return spark.createDataFrame([(w.shrinkage, float(w.eigenvalues[0]), float(w.eigenvalues[1]), w.condition, w.stable)],
                                 "shrinkage double, eigen1 double, eigen2 double, condition double, stable boolean")


@query("whitened_norm", f"""SELECT episode, raw_index, sqrt((c11 * a * a - 2 * c01 * a * b + c00 * b * b) / (c00 * c11 - c01 * c01)) AS norm
    FROM (SELECT episode, raw_index, x0 - m0 AS a, x3 - m1 AS b, c00, c01, c11 FROM proc_wide, {WHITEN})""", views=["proc_wide"], rounded={"norm": 5})
def _whitened(spark, sf):
    df = v.proc_wide(spark, sf)
    w = scores.fit_whitening(df.where(TRAIN), ["x0", "x3"])
    return df.select(*KEYS, l2(F.array(*w.whitened())).alias("norm"))


BRANCHES = [scores.Branch("a", ((1.0, 0.0), (0.0, 2.0))), scores.Branch("b", ((0.5, -1.0),)), scores.Branch("off", ((9.0, 9.0),), enabled=False)]


@query("branch_scores", "SELECT episode, raw_index, sqrt(x0 * x0 + 4 * x2 * x2) AS score_a, abs(0.5 * x0 - x2) AS score_b FROM proc_wide", views=["proc_wide"], rounded=["score_a", "score_b"])
def _branches(spark, sf):
    df = v.proc_wide(spark, sf).select(*KEYS, "x0", "x2")
    return scores.branch_scores(df, ["x0", "x2"], BRANCHES).drop("x0", "x2")


@query("custom_score", "SELECT episode, raw_index, ln(1 + x0) * x1 AS score, ln(1 + x0) * x1 > 100000 AS alarm FROM proc_wide", views=["proc_wide"], rounded={"score": 4})
def _custom(spark, sf):
    df = v.proc_wide(spark, sf).select(*KEYS, (F.log1p("x0") * F.col("x1")).alias("score"))
    return df.withColumn("alarm", F.col("score") > 100000)


@query("alarm_predicate", "SELECT episode, raw_index, x1 AS score, 1000 * x0 AS threshold, x1 > 1000 * x0 AS alarm FROM proc_wide", views=["proc_wide"])
def _alarm(spark, sf):
    df = v.proc_wide(spark, sf).select(*KEYS, F.col("x1").alias("score"), (1000 * F.col("x0")).alias("threshold"))
    return df.withColumn("alarm", calibrate.alarm())


@query("evaluator_registry", """SELECT count(*) FILTER (x0 > 30 AND fault = 0) AS false_alarms, count(*) FILTER (x0 <= 30 AND fault = 1) AS missed,
    count(*) FILTER (x0 > 30 AND fault = 1) AS detected FROM proc_wide""", views=["proc_wide"])
def _evaluator(spark, sf):
    out = evaluators.evaluate("fault_detection", v.proc_wide(spark, sf), score="x0", threshold=30.0, label="fault")
    return out.select("false_alarms", "missed", "detected")


# --- whole chains --------------------------------------------------------------

PREPARED = f"""WITH kept AS (SELECT * FROM proc_missing WHERE x0 IS NOT NULL AND x1 IS NOT NULL),
    parted AS (SELECT *, CASE WHEN k > n - greatest(1, round_even(n * 0.25::DOUBLE, 0)) THEN 'test' ELSE 'train' END AS split FROM (
      SELECT *, row_number() OVER (PARTITION BY episode ORDER BY raw_index) AS k, count(*) OVER (PARTITION BY episode) AS n FROM kept)),
    z AS (SELECT avg(x0) AS a0, stddev_pop(x0) AS s0, avg(x1) AS a1, stddev_pop(x1) AS s1 FROM parted WHERE split = 'train'),
    sev AS (SELECT p.episode, p.raw_index, p.x0, p.x1, p.split, greatest(abs((x0 - a0) / s0) - 1.6, abs((x1 - a1) / s1) - 1.6, 0) AS sv FROM parted p, z),
    ranked AS (SELECT *, sv > 0 AS marked, split = 'train' AND sv > 0 AND row_number() OVER (PARTITION BY split ORDER BY sv DESC, episode, raw_index)
      <= floor(count(*) OVER (PARTITION BY split) * 0.02) AS removed FROM sev),
    f AS (SELECT avg(x0) AS m0, stddev_pop(x0) AS d0, avg(x1) AS m1, stddev_pop(x1) AS d1 FROM ranked WHERE split = 'train' AND NOT removed)
    SELECT episode, raw_index, (x0 - m0) / d0 AS x0, (x1 - m1) / d1 AS x1, split, marked FROM ranked, f WHERE NOT removed"""


@query("prepare_dataset", f"SELECT * FROM ({PREPARED})", views=["proc_missing"], rounded=["x0", "x1"])
def _prepare(spark, sf):
    """Drop gaps, split each recording, remove train outliers, scale."""
    return prepare.prepare(
        v.proc_missing(spark, sf), ["episode"], "raw_index", ["x0", "x1"], missing="drop",
        split=lambda d: splits.split_sequential(d, ["episode"], "raw_index", 0.25),
        outlier_rule=outliers.OutlierRule("zscore", z_threshold=1.6, max_removal_ratio=0.02),
    ).data


RISK = 0.1
SCALED = f"""WITH staged AS ({STAGED}), m AS (SELECT avg(x0) AS m0, stddev_pop(x0) AS s0, avg(x1) AS m1, stddev_pop(x1) AS s1, corr(x0, x1) AS r, count(*) AS n FROM staged WHERE stage = 'train'),
    raw_scores AS (SELECT pos, raw, stage, a, ({Z0} + sign(r) * {Z1}) * ({Z0} + sign(r) * {Z1}) / 2 / ((1 + abs(r)) * n / (n - 1)) AS t2,
      ({Z0} - sign(r) * {Z1}) * ({Z0} - sign(r) * {Z1}) / 2 AS q FROM staged, m WHERE stage <> 'train'),
    unit AS (SELECT sqrt(avg(t2 * t2)) AS u, sqrt(avg(q * q)) AS w FROM raw_scores WHERE stage = 'estimate'),
    long AS (SELECT pos, raw, stage, a, 'hotelling_t2' AS score_name, t2 / u AS score FROM raw_scores, unit WHERE stage <> 'estimate'
      UNION ALL SELECT pos, raw, stage, a, 'spe_q', q / w FROM raw_scores, unit WHERE stage <> 'estimate'),
    tops AS (SELECT l.stage, l.score_name, e.stage_episode, max(l.score) AS x FROM long l JOIN ({EPISODES}) e
      ON e.stage = l.stage AND e.stage_episode = (l.pos - l.a) // {EPISODE} WHERE e.complete GROUP BY 1, 2, 3),
    cut AS (SELECT stage, score_name, count(*) AS episodes, ceil((count(*) + 1) * (1 - {RISK}::DOUBLE))::BIGINT AS rank,
      CASE WHEN ceil((count(*) + 1) * (1 - {RISK}::DOUBLE)) <= count(*) THEN list_sort(list(x))[ceil((count(*) + 1) * (1 - {RISK}::DOUBLE))::BIGINT] ELSE 'infinity'::DOUBLE END AS threshold
      FROM tops WHERE stage <> 'frozen_normal_test' GROUP BY 1, 2)"""


def _protocol(spark, sf):
    df = v.timeline(spark, sf)
    plan = splits.plan_stages(df.count(), **OPTIONS)
    return prepare.normal_protocol(df, "pos", "raw", ["x0", "x1"], plan, RISK)


@query("normal_protocol", f"""SELECT * FROM ({SCALED} SELECT l.pos, l.raw, l.stage, l.score_name, l.score, c.threshold, l.score > c.threshold AS alarm
    FROM long l JOIN cut c ON c.score_name = l.score_name AND c.stage = 'detection_calibration')""", views=["timeline"], rounded=["score", "threshold"])
def _normal(spark, sf):
    return _protocol(spark, sf).scores.select("pos", "raw", "stage", "score_name", "score", "threshold", "alarm")


@query("normal_protocol_thresholds", f"SELECT * FROM ({SCALED} SELECT stage, score_name, episodes, rank, threshold FROM cut)", views=["timeline"], rounded=["threshold"])
def _normal_cuts(spark, sf):
    p = _protocol(spark, sf)
    both = [t.withColumn("stage", F.lit(s)) for s, t in (("detection_calibration", p.detection), ("attribution_calibration", p.attribution))]
    return both[0].unionByName(both[1]).select("stage", "score_name", "episodes", "rank", "threshold")
