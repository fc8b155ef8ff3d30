"""Scaling, fitted on train rows only."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantmon.operators import scale, windows
from plantmon.plans import lookup
from plantmon.queries.registry import query
from plantmon.queries.views import proc_gaps, proc_wide, scores

KEYS = ["episode", "raw_index"]
TRAIN = "raw_index % 4 <> 3"
CHANNELS = ["x0", "x1", "x2"]


def _fit(spark, sf, method, **kw):
    df = proc_wide(spark, sf).select(*KEYS, *CHANNELS)
    return df, scale.fit_scaler(df.where(TRAIN), CHANNELS, method, **kw)


STANDARD = "\nUNION ALL ".join(
    f"SELECT '{c}' AS channel, 'standard' AS method, avg({c}) AS center, stddev_pop({c}) AS scale, false AS constant FROM proc_wide WHERE {TRAIN}"
    for c in CHANNELS)
MINMAX = STANDARD.replace("standard'", "minmax'").replace("avg(", "min(")
for _c in CHANNELS:
    MINMAX = MINMAX.replace(f"stddev_pop({_c})", f"max({_c}) - min({_c})")


@query("fit_standard", STANDARD, views=["proc_wide"], rounded=["center", "scale"])
def _standard(spark, sf):
    return _fit(spark, sf, "standard")[1].to_frame(spark)


@query("fit_minmax", MINMAX, views=["proc_wide"], rounded=["center", "scale"])
def _minmax(spark, sf):
    return _fit(spark, sf, "minmax")[1].to_frame(spark)


STATS = ", ".join(f"avg({c}) AS a{c}, stddev_pop({c}) AS s{c}, min({c}) AS l{c}, max({c}) - min({c}) AS r{c}" for c in CHANNELS)


@query("transform_standard", f"SELECT episode, raw_index, {', '.join(f'({c} - a{c}) / s{c} AS {c}' for c in CHANNELS)} FROM proc_wide, (SELECT {STATS} FROM proc_wide WHERE {TRAIN})",
       views=["proc_wide"], rounded=CHANNELS)
def _transform(spark, sf):
    df, model = _fit(spark, sf, "standard")
    return model.transform(df)


@query("transform_minmax", f"SELECT episode, raw_index, {', '.join(f'({c} - l{c}) / r{c} * 2 - 1 AS {c}' for c in CHANNELS)} FROM proc_wide, (SELECT {STATS} FROM proc_wide WHERE {TRAIN})",
       views=["proc_wide"], rounded=CHANNELS)
def _transform_range(spark, sf):
    df, model = _fit(spark, sf, "minmax", feature_range=(-1.0, 1.0))
    return model.transform(df)


@query("inverse_transform", "SELECT episode, raw_index, x0, x1, x2 FROM proc_wide", views=["proc_wide"], rounded=CHANNELS)
def _inverse(spark, sf):
    df, model = _fit(spark, sf, "minmax", feature_range=(-1.0, 1.0))
    return model.inverse_transform(model.transform(df))


@query("scaler_summary", f"""SELECT 'standard' AS method, count(*) AS "rows", 2::BIGINT AS channels, 1::BIGINT AS constant_columns FROM proc_wide WHERE {TRAIN}""",
       views=["proc_wide"])
def _summary(spark, sf):
    df = proc_wide(spark, sf).where(TRAIN).select("x0", F.lit(3.5).alias("flat"))
    return scale.fit_scaler(df, ["x0", "flat"]).summary(spark)


COVERED = """SELECT DISTINCT w.episode, w.raw_index, w.x0 FROM proc_gaps w JOIN (
    SELECT episode, raw_index AS s FROM (SELECT episode, raw_index, lead(raw_index, 5) OVER (PARTITION BY episode ORDER BY raw_index) AS e FROM proc_gaps)
    WHERE e = raw_index + 5 AND raw_index % 40 < 20) t ON w.episode = t.episode AND w.raw_index BETWEEN t.s AND t.s + 5"""


def _window_rows(spark, sf):
    df = proc_gaps(spark, sf).select(*KEYS, "x0")
    starts = windows.cut_windows(df, ["episode"], "raw_index", {"w": (["x0"], 0, 6)}).where("raw_index % 40 < 20")
    flagged = df.join(starts.select(*KEYS, F.lit(True).alias("start")), KEYS, "left")
    rows = windows.covered_rows(flagged, ["episode"], "raw_index", F.coalesce("start", F.lit(False)), 6)
    return rows.select(*KEYS, "x0")


@query("covered_rows", COVERED, views=["proc_gaps"])
def _covered(spark, sf):
    return _window_rows(spark, sf)


@query("fit_window_rows", f"""SELECT 'x0' AS channel, 'standard' AS method, avg(x0) AS center, stddev_pop(x0) AS scale, false AS constant FROM ({COVERED})""",
       views=["proc_gaps"], rounded=["center", "scale"])
def _fit_rows(spark, sf):
    return scale.fit_scaler(_window_rows(spark, sf), ["x0"]).to_frame(spark)


@query("score_rms_scale", f"""SELECT s.episode, s.raw_index, s.score_name, s.score / r.scale AS score FROM scores s
    JOIN (SELECT score_name, sqrt(avg(score * score)) AS scale FROM scores WHERE {TRAIN} GROUP BY score_name) r
    ON s.score_name = r.score_name""", views=["scores"], rounded=["score"])
def _rms(spark, sf):
    long = scores(spark, sf)
    fitted = scale.fit_stream_scale(long.where(TRAIN))
    return lookup(long, fitted, "score_name", "inner").select(*KEYS, "score_name", (F.col("score") / F.col("scale")).alias("score"))
