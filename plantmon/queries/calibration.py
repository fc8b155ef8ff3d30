"""Episode calibration, envelopes and dynamic thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantmon.operators import calibrate, windows
from plantmon.queries import views as v
from plantmon.queries.registry import query

KEYS = ["episode", "raw_index"]
MAXIMA = "SELECT episode, score_name, max(score) AS max_score FROM scores GROUP BY 1, 2"


@query("episode_max", MAXIMA, views=["scores"], rounded=["max_score"])
def _max(spark, sf):
    return calibrate.episode_max(v.scores(spark, sf), ["episode"])


def _conformal(risk):
    return f"""SELECT score_name, m AS episodes, r AS rank, coalesce(max(max_score) FILTER (k = r), 'infinity'::DOUBLE) AS threshold, r <= m AS finite FROM (
        SELECT *, row_number() OVER (PARTITION BY score_name ORDER BY max_score) AS k, count(*) OVER (PARTITION BY score_name) AS m,
        ceil((count(*) OVER (PARTITION BY score_name) + 1) * (1 - {risk}::DOUBLE))::BIGINT AS r FROM ({MAXIMA})) GROUP BY 1, 2, 3"""


@query("conformal_threshold", _conformal(0.1), views=["scores"], rounded=["threshold"])
def _threshold(spark, sf):
    return calibrate.conformal_thresholds(calibrate.episode_max(v.scores(spark, sf), ["episode"]), 0.1)


@query("conformal_unresolved", _conformal(0.0001), views=["scores"], rounded=["threshold"])
def _unresolved(spark, sf):
    return calibrate.conformal_thresholds(calibrate.episode_max(v.scores(spark, sf), ["episode"]), 0.0001)


@query("kth_order_statistic", f"""SELECT score_name, episode, max_score FROM (SELECT *, row_number() OVER (PARTITION BY score_name ORDER BY max_score, episode) AS k
    FROM ({MAXIMA})) WHERE k = 5""", views=["scores"], rounded=["max_score"])
def _kth(spark, sf):
    from plantmon.plans import rank_within

    maxima = calibrate.episode_max(v.scores(spark, sf), ["episode"])
    return rank_within(maxima, ["score_name"], ["max_score", "episode"], "k").where("k = 4").drop("k")


def _status(risk):
    return f"""SELECT m AS episodes, r AS rank, 1.0::DOUBLE / (m + 1) AS resolution, CASE WHEN r > m THEN 'insufficient_resolution' ELSE 'ready' END AS status,
        CASE WHEN r > m THEN 'infinity'::DOUBLE ELSE list_sort(xs)[r] END AS quantile FROM (SELECT count(*) AS m, list(max_score) AS xs,
        ceil((count(*) + 1) * (1 - {risk}::DOUBLE))::BIGINT AS r FROM ({MAXIMA}) WHERE score_name = 'rate')"""


@query("conformal_status", f"{_status(0.2)} UNION ALL {_status(0.0001)}", views=["scores"], rounded=["resolution", "quantile"])
def _conformal_status(spark, sf):
    maxima = calibrate.episode_max(v.scores(spark, sf).where("score_name = 'rate'"), ["episode"])
    return calibrate.conformal_status(maxima, 0.2).unionByName(calibrate.conformal_status(maxima, 0.0001))


COORDS = "(SELECT DISTINCT label, fault FROM proc_wide)"


@query("score_coverage", f"""SELECT e.episode, (SELECT count(*) FROM {COORDS} WHERE label <> 'A' OR fault = 0) - count(*) FILTER (d.label IS NOT NULL) AS missing,
    count(*) FILTER (e.n > 1) AS repeated, count(*) FILTER (d.label IS NULL) AS undeclared
    FROM (SELECT episode, label, fault, count(*) AS n FROM proc_wide WHERE (episode + fault * 3 + ascii(label)) % 5 <> 0 GROUP BY ALL) e
    LEFT JOIN (SELECT * FROM {COORDS} WHERE label <> 'A' OR fault = 0) d ON e.label = d.label AND e.fault = d.fault GROUP BY e.episode""", views=["proc_wide"])
def _coverage(spark, sf):
    df = v.proc_wide(spark, sf)
    # Some coordinates of each episode are taken out, and one that occurs is not declared.
    kept = df.where((F.col("episode") + F.col("fault") * 3 + F.ascii("label")) % 5 != 0)
    declared = df.select("label", "fault").distinct().where("label <> 'A' or fault = 0")
    return calibrate.score_coverage(kept, "episode", declared)


@query("expected_coordinates", f"SELECT s_suppkey AS episode, label, fault FROM supplier, {COORDS}", views=["proc_wide"])
def _expected(spark, sf):
    episodes = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("episode"))
    return calibrate.expected_coordinates(episodes, v.proc_wide(spark, sf).select("label", "fault").distinct(), "episode")


AGES = "(SELECT raw_index % 20 AS age, x1 FROM proc_wide)"
AGE_CURVE = f"""SELECT age, samples, raw, max(raw) OVER (ORDER BY age) AS envelope FROM (SELECT age, count(*) AS samples,
    max(x1) FILTER (k = ceil(0.9::DOUBLE * (n - 1)) + 1) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY age ORDER BY x1) AS k,
    count(*) OVER (PARTITION BY age) AS n FROM {AGES}) GROUP BY age)"""


def _age_curve(spark, sf):
    samples = v.proc_wide(spark, sf).select((F.col("raw_index") % 20).alias("age"), "x1")
    return calibrate.age_envelope(samples, "age", "x1", 0.9, 3)


@query("age_envelope", AGE_CURVE, views=["proc_wide"])
def _age(spark, sf):
    return _age_curve(spark, sf)


@query("age_lookup", f"""SELECT w.episode, w.raw_index, w.raw_index % 25 AS age, a.envelope IS NOT NULL AS age_supported, coalesce(a.envelope, 'infinity'::DOUBLE) AS age_envelope
    FROM proc_wide w LEFT JOIN ({AGE_CURVE}) a ON a.age = w.raw_index % 25""", views=["proc_wide"])
def _age_lookup(spark, sf):
    df = v.proc_wide(spark, sf).select(*KEYS, (F.col("raw_index") % 25).alias("age"))
    return calibrate.age_lookup(df, _age_curve(spark, sf), "age")


NORM_SQL = """(SELECT episode, raw_index, label, abs(x0) AS input_norm, CASE WHEN b = raw_index - 1 THEN abs(x0 - p) ELSE 0 END AS input_delta_norm,
    CASE WHEN b = raw_index - 1 THEN abs(x3 - q) ELSE 0 END AS exogenous_delta_norm FROM (SELECT *, lag(raw_index) OVER w AS b, lag(x0) OVER w AS p, lag(x3) OVER w AS q
    FROM proc_gaps WINDOW w AS (PARTITION BY episode ORDER BY raw_index)))"""
SUPPORT = f"""SELECT label, count(*) AS samples, min(input_norm) AS min_input_norm, max(input_norm) AS max_input_norm, min(input_delta_norm) AS min_input_delta_norm,
    max(input_delta_norm) AS max_input_delta_norm, min(exogenous_delta_norm) AS min_exogenous_delta_norm, max(exogenous_delta_norm) AS max_exogenous_delta_norm
    FROM {NORM_SQL} WHERE raw_index % 3 = 0 AND label <> 'A' GROUP BY label HAVING count(*) >= 20"""
BOUNDS = {f"{s}_{n}": 6 for s in ("min", "max") for n in calibrate.NORMS}


def _norms(spark, sf):
    df = v.proc_gaps(spark, sf).select(*KEYS, "label", "x0", "x3")
    return windows.delta_norms(df, ["episode"], "raw_index", ["x0"], ["x3"]).drop("x0", "x3")


def _support(norms):
    return calibrate.region_support(norms.where("raw_index % 3 = 0 AND label <> 'A'"), "label", 20)


@query("region_support", SUPPORT, views=["proc_gaps"], rounded=BOUNDS)
def _region(spark, sf):
    return _support(_norms(spark, sf))


INSIDE = " AND ".join(f"n.{c} BETWEEN s.min_{c} AND s.max_{c}" for c in calibrate.NORMS)


@query("envelope_lookup", f"""SELECT n.episode, n.raw_index, n.label, s.samples IS NOT NULL AS input_supported,
    CASE WHEN s.samples IS NOT NULL THEN 0.5 + s.samples / 1000.0 + 0.1 * input_norm + 0.2 * input_delta_norm + 3 * exogenous_delta_norm ELSE 'infinity'::DOUBLE END AS input_envelope
    FROM {NORM_SQL} n LEFT JOIN ({SUPPORT}) s ON s.label = n.label AND {INSIDE}""", views=["proc_gaps"], rounded=["input_envelope"])
def _envelope(spark, sf):
    norms = _norms(spark, sf)
    support = _support(norms)
    coefficients = support.select("label", (0.5 + F.col("samples") / 1000.0).alias("c0"), F.lit(0.1).alias("c1"), F.lit(0.2).alias("c2"), F.lit(3.0).alias("c3"))
    return calibrate.input_envelope(norms, support, coefficients, "label").drop(*calibrate.NORMS)


STEPS = "(SELECT episode, raw_index // 10 AS win, CASE WHEN (episode + raw_index) % 211 = 0 THEN 'infinity'::DOUBLE ELSE x2 END AS a, x3 AS b, x0 AS norm FROM proc_wide)"


@query("deterministic_radius", f"""SELECT episode, win, count(*) AS steps, CASE WHEN bool_or(isinf(a)) THEN 'infinity'::DOUBLE ELSE sum(CASE WHEN isinf(a) THEN 0 ELSE (a + b) * norm END) END AS radius
    FROM {STEPS} GROUP BY 1, 2""", views=["proc_wide"], rounded=["radius"])
def _radius(spark, sf):
    lost = (F.col("episode") + F.col("raw_index")) % 211 == 0
    steps = v.proc_wide(spark, sf).select(
        "episode", F.expr("raw_index div 10").alias("win"), F.when(lost, F.lit(float("inf"))).otherwise(F.col("x2")).alias("a"),
        F.col("x3").alias("b"), F.col("x0").alias("norm"))
    return calibrate.deterministic_radius(steps, ["episode", "win"], "a", "b", "norm")


DETECT = """(SELECT episode, raw_index, label, x0 AS statistic, x2 * 10 AS gamma_anchor, CASE WHEN raw_index % 31 = 0 THEN 'infinity'::DOUBLE ELSE x3 * 100 END AS radius,
    1 + x3 AS scale FROM proc_wide)"""


def _detect(spark, sf):
    return v.proc_wide(spark, sf).select(
        *KEYS, "label", F.col("x0").alias("statistic"), (F.col("x2") * 10).alias("gamma_anchor"),
        F.when(F.col("raw_index") % 31 == 0, F.lit(float("inf"))).otherwise(F.col("x3") * 100).alias("radius"), (1 + F.col("x3")).alias("scale"))


@query("normalized_excess", f"SELECT episode, raw_index, CASE WHEN isinf(radius) THEN 'infinity'::DOUBLE ELSE greatest(0, statistic - gamma_anchor - radius) / scale END AS excess FROM {DETECT}",
       views=["proc_wide"], rounded=["excess"])
def _excess(spark, sf):
    return _detect(spark, sf).select(*KEYS, calibrate.normalized_excess("statistic", "gamma_anchor", "radius", "scale").alias("excess"))


@query("dynamic_threshold", f"""SELECT *, statistic > threshold AS alarm, CASE WHEN reason IS NULL THEN 'ready' ELSE 'disabled' END AS threshold_status FROM (
    SELECT episode, raw_index, label, statistic, reason, CASE WHEN reason IS NULL THEN greatest(12, gamma_anchor + radius + scale * q) ELSE 'infinity'::DOUBLE END AS threshold FROM (
    SELECT d.*, c.q, CASE WHEN isinf(radius) THEN 'radius unsupported' WHEN c.status IS NULL THEN 'calibration missing' WHEN c.status <> 'ready' THEN c.status END AS reason
    FROM {DETECT} d LEFT JOIN (SELECT label, avg(x0) AS q, CASE WHEN label = 'N' THEN 'incomplete_evidence' ELSE 'ready' END AS status FROM proc_wide WHERE label <> 'A' GROUP BY label) c
    ON c.label = d.label))""", views=["proc_wide"], rounded=["threshold"])
def _dynamic(spark, sf):
    fitted = v.proc_wide(spark, sf).where("label <> 'A'").groupBy("label").agg(F.avg("x0").alias("quantile")).withColumn(
        "status", F.when(F.col("label") == "N", "incomplete_evidence").otherwise("ready"))
    out = calibrate.dynamic_threshold(_detect(spark, sf), fitted, ["label"], floor=12.0)
    return out.drop("gamma_anchor", "radius", "scale")
