"""Aggregated metrics and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantmon.operators import metrics, runs
from plantmon.queries import views as v
from plantmon.queries.registry import query

KEYS = ["episode", "raw_index"]


@query("label_counts", """SELECT CASE WHEN raw_index % 4 = 3 THEN 'test' ELSE 'train' END AS split, label, count(*) AS "rows" FROM proc_wide GROUP BY 1, 2""",
       views=["proc_wide"])
def _label_counts(spark, sf):
    part = F.when(F.col("raw_index") % 4 == 3, "test").otherwise("train")
    return metrics.label_counts(v.proc_wide(spark, sf).withColumn("split", part), "split", "label")


@query("split_rows", """SELECT label AS split, fault::BIGINT AS segment, grouping_id(label, fault) AS level, count(*) AS "rows" FROM proc_wide GROUP BY ROLLUP (label, fault)""",
       views=["proc_wide"])
def _split_rows(spark, sf):
    df = v.proc_wide(spark, sf).select(F.col("label").alias("split"), F.col("fault").cast("long").alias("segment"))
    return metrics.split_inventory(df, "split", "segment")


REGRESSION = """SELECT target, sum(n)::BIGINT AS "rows", sum(sse) / sum(n) AS mse, sqrt(sum(sse) / sum(n)) AS rmse, sum(sae) / sum(n) AS mae,
    1 - sum(sse) / sum(sst) AS r2, max(top) AS max_abs FROM (SELECT target, count(*) AS n, sum((y_pred - y_true) * (y_pred - y_true)) AS sse,
    sum(abs(y_pred - y_true)) AS sae, var_pop(y_true) * count(*) AS sst, max(abs(y_pred - y_true)) AS top FROM pred GROUP BY target)
    GROUP BY GROUPING SETS ((target), ())"""
DIGITS = {"mse": 1, "rmse": 4, "mae": 4, "r2": 6}


@query("regression_metrics", f"SELECT target, \"rows\", mse, rmse, mae, r2 FROM ({REGRESSION})", views=["pred"], rounded=DIGITS)
def _regression(spark, sf):
    return metrics.regression_metrics(v.pred(spark, sf), "target", "y_true", "y_pred")


@query("reconstruction_metrics", REGRESSION, views=["pred"], rounded=DIGITS | {"max_abs": 4})
def _reconstruction(spark, sf):
    return metrics.reconstruction_metrics(v.pred(spark, sf), "target", "y_true", "y_pred")


@query("horizon_rmse", """SELECT step, rmse, rmse / f AS ratio_to_first, m / f AS max_ratio FROM (SELECT step, rmse, first_value(rmse) OVER (ORDER BY step) AS f,
    max(rmse) OVER () AS m FROM (SELECT step, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse FROM pred GROUP BY step))""",
       views=["pred"], rounded={"rmse": 4, "ratio_to_first": 6, "max_ratio": 6})
def _horizon(spark, sf):
    return metrics.horizon_rmse(v.pred(spark, sf), "step", "y_true", "y_pred")


@query("weighted_horizon_loss", """SELECT 'all' AS mode, avg(abs(y_pred - y_true)) AS loss FROM pred UNION ALL
    SELECT 'last', avg(abs(y_pred - y_true)) FROM pred WHERE step = 7 UNION ALL
    SELECT 'weighted', avg(abs(y_pred - y_true) * (1 + (step - 1) * (3.0 - 1) / 6) / 2.0) FROM pred""", views=["pred"], rounded={"loss": 4})
def _weighted(spark, sf):
    df, out = v.pred(spark, sf), None
    for name, mode in (("all", "all_time"), ("last", "last_only"), ("weighted", "weighted_last")):
        part = metrics.weighted_horizon_loss(df, "step", "y_true", "y_pred", 7, mode, 3.0, "mae").select(F.lit(name).alias("mode"), "loss")
        out = part if out is None else out.unionByName(part)
    return out


@query("confusion_matrix", """SELECT c.c AS true_class, count(*) FILTER (y_pred = 0) AS pred_0, count(*) FILTER (y_pred = 1) AS pred_1
    FROM (SELECT DISTINCT y_true AS c FROM cls UNION SELECT y_pred FROM cls) c LEFT JOIN cls ON cls.y_true = c.c GROUP BY 1""", views=["cls"])
def _confusion(spark, sf):
    return metrics.confusion_matrix(v.cls(spark, sf), "y_true", "y_pred")


CLASS = """SELECT c AS class, tp / greatest(p, 1) AS precision, tp / greatest(a, 1) AS recall,
    2 * (tp / greatest(p, 1)) * (tp / greatest(a, 1)) / greatest(tp / greatest(p, 1) + tp / greatest(a, 1), 1e-12) AS f1
    FROM (SELECT c, count(*) FILTER (y_true = c AND y_pred = c)::DOUBLE AS tp, count(*) FILTER (y_pred = c)::DOUBLE AS p, count(*) FILTER (y_true = c)::DOUBLE AS a
    FROM cls, (SELECT DISTINCT y_true AS c FROM cls UNION SELECT y_pred FROM cls) GROUP BY c)"""


@query("class_metrics", CLASS, views=["cls"], rounded=["precision", "recall", "f1"])
def _class(spark, sf):
    return metrics.class_metrics(v.cls(spark, sf), "y_true", "y_pred")


@query("classification_metrics", f"SELECT (SELECT avg((y_true = y_pred)::INT) FROM cls) AS accuracy, (SELECT avg(f1) FROM ({CLASS})) AS macro_f1",
       views=["cls"], rounded=["accuracy", "macro_f1"])
def _classification(spark, sf):
    return metrics.classification_metrics(v.cls(spark, sf), "y_true", "y_pred")


@query("class_union", "SELECT y_true AS class FROM cls UNION SELECT y_pred FROM cls", views=["cls"])
def _union(spark, sf):
    return metrics.class_union(metrics.confusion_counts(v.cls(spark, sf), "y_true", "y_pred"))


@query("argmax_logits", """SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS predicted FROM embeddings""")
def _argmax(spark, sf):
    return v.table(spark, sf, "embeddings").select("vec_id", metrics.predicted_class("embedding").alias("predicted"))


@query("contribution_metrics", """SELECT NULL::INT AS dimension, avg(x0 + x1) / 2 AS first_mean_abs, avg(x2 + x3) / 2 AS second_mean_abs,
    avg(x2 + x3) / avg(x0 + x1) AS ratio, avg(((x2 <= 0.02)::INT + (x3 <= 0.02)::INT) / 2.0) AS sparsity, 0.0::DOUBLE AS diagonal_mean_abs,
    avg(x2 + x3) / 2 AS fm_mean_abs, avg(x2 + x3) / 2 AS cross_mean_abs FROM proc_wide UNION ALL
    SELECT 0, avg(x0), avg(x2), avg(x2) / avg(x0), avg((x2 <= 0.02)::INT), NULL, NULL, NULL FROM proc_wide UNION ALL
    SELECT 1, avg(x1), avg(x3), avg(x3) / avg(x1), avg((x3 <= 0.02)::INT), NULL, NULL, NULL FROM proc_wide""", views=["proc_wide"],
       rounded=["first_mean_abs", "second_mean_abs", "ratio", "sparsity", "diagonal_mean_abs", "fm_mean_abs", "cross_mean_abs"])
def _contribution(spark, sf):
    return metrics.contribution_metrics(v.proc_wide(spark, sf), ["x0", "x1"], ["x2", "x3"], sparsity_threshold=0.02)


@query("channel_contribution", """SELECT 'x0' AS channel, avg(abs(x0)) AS magnitude FROM proc_wide UNION ALL SELECT 'x1', avg(abs(x1)) FROM proc_wide
    UNION ALL SELECT 'x2', avg(abs(x2)) FROM proc_wide ORDER BY magnitude DESC""", views=["proc_wide"], rounded={"magnitude": 4})
def _channel(spark, sf):
    return metrics.channel_contribution(v.proc_wide(spark, sf), ["x0", "x1", "x2"])


@query("histogram", """SELECT b.bin, lo + b.bin * w AS lower, lo + (b.bin + 1) * w AS upper, count(h.x) AS "rows"
    FROM (SELECT unnest(range(24)) AS bin) b CROSS JOIN (SELECT min(x) AS lo, (max(x) - min(x)) / 24 AS w FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)) s
    LEFT JOIN (SELECT x, least(floor((x - lo) / w), 23) AS bin FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings),
      (SELECT min(x) AS lo, (max(x) - min(x)) / 24 AS w FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings))) h ON h.bin = b.bin
    GROUP BY b.bin, lo, w""", rounded=["lower", "upper"])
def _histogram(spark, sf):
    flat = v.table(spark, sf, "embeddings").select(F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    return metrics.histogram(flat, "x")


BOARD = """SELECT trial_id, avg(rmse) AS rmse_mean, stddev_samp(rmse) AS rmse_std, min(rmse) AS rmse_min, max(rmse) AS rmse_max, count(rmse) AS rmse_count,
    avg(r2) AS r2_mean, stddev_samp(r2) AS r2_std, min(r2) AS r2_min, max(r2) AS r2_max, count(r2) AS r2_count,
    quantile_cont(rmse, 0.5) AS rmse_median, 1.96 * coalesce(stddev_samp(rmse), 0) / sqrt(greatest(count(rmse), 1)) AS rmse_ci95,
    quantile_cont(r2, 0.5) AS r2_median, 1.96 * coalesce(stddev_samp(r2), 0) / sqrt(greatest(count(r2), 1)) AS r2_ci95,
    count(rmse) AS completed, count(*) FILTER (repeat_id % 10 = 0) AS failed FROM runs GROUP BY trial_id"""
BOARD_DIGITS = {f"{m}_{s}": 4 for m in ("rmse", "r2") for s in ("mean", "std", "median", "ci95")}


def _board(spark, sf):
    df = v.runs(spark, sf)
    return runs.leaderboard(df, ["trial_id"], ["rmse", "r2"], df.where("repeat_id % 10 = 0"))


@query("leaderboard", BOARD, views=["runs"], rounded=BOARD_DIGITS)
def _leaderboard(spark, sf):
    return _board(spark, sf)


@query("rank_trials", f"SELECT trial_id, rmse_mean, r2_mean FROM ({BOARD}) WHERE r2_mean >= 0 AND rmse_mean < 1e9 ORDER BY rmse_mean, r2_mean DESC",
       views=["runs"], rounded={"rmse_mean": 4, "r2_mean": 4})
def _rank(spark, sf):
    ranked = runs.rank_trials(_board(spark, sf), "rmse", "min", [("r2", "max")], [("r2", ">=", 0), ("rmse", "<", 1e9)])
    return ranked.select("trial_id", "rmse_mean", "r2_mean")


@query("best_trial", f"SELECT trial_id, r2_mean FROM ({BOARD}) ORDER BY r2_mean DESC LIMIT 1", views=["runs"], rounded={"r2_mean": 4})
def _best_trial(spark, sf):
    return runs.best_trial(_board(spark, sf), "r2", "max").select("trial_id", "r2_mean")


@query("best_run", """SELECT trial_id, repeat_id, rmse, r2 FROM (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY rmse, r2 DESC, repeat_id) AS k FROM runs) WHERE k = 1""",
       views=["runs"])
def _best(spark, sf):
    return runs.best_run(v.runs(spark, sf), ["trial_id"], "repeat_id")


@query("best_run_tolerance", """SELECT trial_id, f.repeat_id, f.rmse, f.r2 FROM (SELECT trial_id,
    list_reduce(list({'repeat_id': repeat_id, 'rmse': rmse, 'r2': r2} ORDER BY repeat_id),
      lambda cur, x: CASE WHEN x.rmse < cur.rmse - 300 OR (abs(x.rmse - cur.rmse) <= 300 AND x.r2 > cur.r2 + 300) THEN x ELSE cur END) AS f
    FROM runs GROUP BY trial_id)""", views=["runs"])
def _best_tolerance(spark, sf):
    return runs.best_run(v.runs(spark, sf), ["trial_id"], "repeat_id", eps=300.0, size=256)


@query("estimate_moments", """SELECT a AS "left", b AS "right", n AS "rows", ma AS left_mean, mb AS right_mean, c AS covariance FROM (
    SELECT 'x0' AS a, 'x0' AS b, count(*) AS n, avg(x0) AS ma, avg(x0) AS mb, covar_pop(x0, x0) AS c FROM proc_wide UNION ALL
    SELECT 'x0', 'x1', count(*), avg(x0), avg(x1), covar_pop(x0, x1) FROM proc_wide UNION ALL
    SELECT 'x1', 'x1', count(*), avg(x1), avg(x1), covar_pop(x1, x1) FROM proc_wide)""", views=["proc_wide"],
       rounded={"left_mean": 4, "right_mean": 4, "covariance": 2})
def _moments(spark, sf):
    return metrics.moments_frame(spark, metrics.estimate_moments(v.proc_wide(spark, sf), ["x0", "x1"]))


@query("estimate_moments_wide", """SELECT 'e' || a AS "left", 'e' || b AS "right", count(*) AS "rows", avg(embedding[a]::DOUBLE) AS left_mean, avg(embedding[b]::DOUBLE) AS right_mean,
    covar_pop(embedding[a]::DOUBLE, embedding[b]::DOUBLE) AS covariance FROM embeddings, (SELECT unnest(range(1, 65)) AS a), (SELECT unnest(range(1, 65)) AS b) WHERE a <= b GROUP BY a, b""",
       rounded=["left_mean", "right_mean", "covariance"])
def _moments_wide(spark, sf):
    names = [f"e{i + 1}" for i in range(64)]
    wide = v.table(spark, sf, "embeddings").select(*[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    return metrics.moments_frame(spark, metrics.estimate_moments(wide, names))


@query("score_summary", "SELECT label, avg(x0) AS mean_score, max(x0) AS max_score FROM proc_wide GROUP BY label", views=["proc_wide"], rounded=["mean_score"])
def _summary(spark, sf):
    return metrics.score_summary(v.proc_wide(spark, sf), ["label"], "x0")


@query("grouped_quantiles", """SELECT episode, quantile_cont(x1, 0.5) AS p50, quantile_cont(x1, 0.9) AS p90 FROM proc_wide GROUP BY episode""", views=["proc_wide"],
       rounded={"p50": 4, "p90": 4})
def _quantiles(spark, sf):
    from plantmon.plans import grouped_quantiles

    return grouped_quantiles(v.proc_wide(spark, sf), ["episode"], "x1", {"p50": 0.5, "p90": 0.9})
