"""Scores with gaps, streams without thresholds, and replays that differ in kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantmon.operators import calibrate, labels, scores
from plantmon.queries import views as v
from plantmon.queries.registry import query

KEYS = ["episode", "raw_index"]
GAPS = """(SELECT *, CASE WHEN (episode + raw_index) % 11 = 0 THEN 'nan'::DOUBLE WHEN (episode + raw_index) % 11 = 1 THEN NULL ELSE x0 END AS s FROM proc_wide)"""
ALARM = "coalesce(NOT isnan(s) AND s > {0}, false)"


def _gaps(spark, sf):
    place = (F.col("episode") + F.col("raw_index")) % 11
    return v.proc_wide(spark, sf).withColumn(
        "s", F.when(place == 0, F.lit(float("nan"))).when(place != 1, F.col("x0"))
    )


@query("detection_missing_scores", f"""SELECT label, count(*) FILTER (a AND fault = 0) AS false_alarms, count(*) FILTER (NOT a AND fault = 1) AS missed,
    count(*) FILTER (a AND fault = 1) AS detected, count(*) FILTER (fault = 0) AS normal_rows, count(*) FILTER (fault = 1) AS fault_rows,
    count(*) FILTER (a AND fault = 0) / greatest(count(*) FILTER (fault = 0), 1) AS far, count(*) FILTER (NOT a AND fault = 1) / greatest(count(*) FILTER (fault = 1), 1) AS mdr,
    count(*) FILTER (a AND fault = 1) / greatest(count(*) FILTER (fault = 1), 1) AS fdr FROM (SELECT *, {ALARM.format(40)} AS a FROM {GAPS}) GROUP BY label""",
       views=["proc_wide"], rounded=["far", "mdr", "fdr"])
def _detection(spark, sf):
    return scores.detection_metrics(_gaps(spark, sf), "s", 40.0, "fault", ["label"])


KNOWN = f"(SELECT s FROM {GAPS} WHERE fault = 0 AND s IS NOT NULL AND NOT isnan(s))"


@query("threshold_missing_scores", f"""SELECT quantile_cont(s, 0.95) AS percentile, avg(s) + sqrt(0.95 / 0.05) * stddev_pop(s) AS inequality,
    avg(s) AS center FROM {KNOWN}""", views=["proc_wide"], rounded=["percentile", "inequality", "center"])
def _limits(spark, sf):
    normal = _gaps(spark, sf).where("fault = 0")
    row = (scores.percentile_threshold(normal, "s", 0.05), scores.inequality_threshold(normal, "s", 0.05),
           scores.fit_t2(normal, ["s"]).center[0])
    # The fitted numbers beside the data they came from: one row, like the SQL.
    return normal.agg(F.lit(row[0]).alias("percentile"), F.lit(row[1]).alias("inequality"), F.lit(row[2]).alias("center"))


@query("dynamic_threshold_missing", f"""SELECT episode, raw_index, CASE WHEN label = 'N' THEN 'infinity'::DOUBLE ELSE 30.0::DOUBLE END AS threshold,
    CASE WHEN label = 'N' THEN false ELSE {ALARM.format(30)} END AS alarm, CASE WHEN label = 'N' THEN 'radius unsupported' END AS reason,
    CASE WHEN label = 'N' THEN 'disabled' ELSE 'ready' END AS threshold_status FROM {GAPS}""", views=["proc_wide"])
def _dynamic(spark, sf):
    radius = F.when(F.col("label") == "N", F.lit(float("inf"))).otherwise(F.lit(4.0))
    df = _gaps(spark, sf).select(
        *KEYS, F.col("s").alias("statistic"), F.lit(1.0).alias("gamma_anchor"), radius.alias("radius"), F.lit(5.0).alias("scale")
    )
    ready = spark.createDataFrame([(5.0, "ready")], "quantile double, status string")
    out = calibrate.dynamic_threshold(df, ready)
    return out.select(*KEYS, "threshold", "alarm", "reason", "threshold_status")


@query("apply_thresholds_undeclared", """SELECT s.episode, s.raw_index, s.score_name, s.score, coalesce(t.threshold, 'infinity'::DOUBLE) AS threshold,
    coalesce(s.score > t.threshold, false) AS alarm FROM scores s LEFT JOIN
    (SELECT score_name, max(score) * 0.75 AS threshold FROM scores WHERE score_name <> 'price' GROUP BY 1) t ON s.score_name = t.score_name""", views=["scores"])
def _undeclared(spark, sf):
    long = v.scores(spark, sf)
    limits = long.where("score_name <> 'price'").groupBy("score_name").agg((F.max("score") * 0.75).alias("threshold"))
    return calibrate.apply_thresholds(long, limits).select(*KEYS, "score_name", "score", "threshold", "alarm")


@query("conformal_no_episodes", """SELECT n.score_name, coalesce(m.c, 0) AS episodes, CASE WHEN m.c IS NULL THEN 1 ELSE ceil((m.c + 1) * (1 - 0.1::DOUBLE))::BIGINT END AS rank,
    coalesce(m.xs[ceil((m.c + 1) * (1 - 0.1::DOUBLE))::BIGINT], 'infinity'::DOUBLE) AS threshold, m.xs[ceil((m.c + 1) * (1 - 0.1::DOUBLE))::BIGINT] IS NOT NULL AS finite
    FROM (VALUES ('load'), ('price'), ('rate'), ('spare')) n(score_name) LEFT JOIN (SELECT score_name, count(*) AS c, list(x ORDER BY x) AS xs
    FROM (SELECT episode, score_name, max(score) AS x FROM scores WHERE score_name <> 'price' GROUP BY 1, 2) GROUP BY 1) m ON n.score_name = m.score_name""",
       views=["scores"], rounded=["threshold"])
def _no_episodes(spark, sf):
    maxima = calibrate.episode_max(v.scores(spark, sf).where("score_name <> 'price'"), ["episode"])
    return calibrate.conformal_thresholds(maxima, 0.1, streams=["load", "price", "rate", "spare"])


@query("replay_compare_nan", f"""SELECT count(*) FILTER (a.raw_index IS NULL) AS only_actual, count(*) FILTER (b.raw_index IS NULL) AS only_expected,
    coalesce(max(abs(CASE WHEN NOT isnan(a.s) THEN a.s END - b.x0)), 0) AS max_abs_delta,
    count(*) FILTER ((a.s IS NULL OR isnan(a.s)) <> (b.x0 IS NULL)) = 0 AS matches
    FROM {GAPS} a FULL JOIN proc_wide b ON a.episode = b.episode AND a.raw_index = b.raw_index""", views=["proc_wide"])
def _replay(spark, sf):
    expected = _gaps(spark, sf).select(*KEYS, F.col("s").alias("score"))
    actual = v.proc_wide(spark, sf).select(*KEYS, F.col("x0").alias("score"))
    return labels.replay_compare(expected, actual, KEYS)
