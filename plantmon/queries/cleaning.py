"""Projections, missing values and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantmon.operators import clean, masks, outliers, roles
from plantmon.queries.registry import query
from plantmon.queries.views import proc_gaps, proc_missing, proc_wide, scores, table

KEYS = ["episode", "raw_index"]
ROLES = {"episode": "episode", "raw_index": "raw_index", "x0": "control", "x1": "input", "x2": "output",
         "x3": "input", "label": "label", "fault": "fault_id"}


def _roled(spark, sf):
    return roles.with_roles(proc_wide(spark, sf), ROLES, unit={"x1": "kPa"})


@query("select_roles", "SELECT x0, x2, raw_index FROM proc_wide", views=["proc_wide"])
def _select_roles(spark, sf):
    return roles.select_roles(_roled(spark, sf), ["control", "output", "raw_index", "x0"])


@query("task_inputs", "SELECT raw_index, x0, x1, x3 FROM proc_wide", views=["proc_wide"])
def _task_inputs(spark, sf):
    df = _roled(spark, sf)
    return df.select(*roles.task_inputs(df, "prediction"))


@query("task_targets", """SELECT fault AS classification, x2 AS prediction, x2 AS mpc, label AS labelled
    FROM proc_wide""", views=["proc_wide"])
def _task_targets(spark, sf):
    df = _roled(spark, sf)
    pick = {t: roles.task_targets(df, t)[0] for t in ("classification", "prediction", "mpc")}
    pick["labelled"] = roles.task_targets(df, "any", label="label")[0]
    return df.select(*[F.col(c).alias(t) for t, c in pick.items()])


@query("task_view", """SELECT episode, raw_index, x0 AS in_x0, x1 AS in_x1, x2 AS in_x2, x3 AS in_x3, x0 AS out_x0,
    x1 AS out_x1, x2 AS out_x2, x3 AS out_x3 FROM proc_wide""", views=["proc_wide"])
def _task_view(spark, sf):
    return roles.task_view(_roled(spark, sf), "reconstruction", keys=KEYS, inputs=["x0", "x1", "x2", "x3"])


@query("drop_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem")
def _drop(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_shipdate")
    return roles.drop_columns(df, ["l_tax", -1, "no_such"])[0]


@query("to_numeric", "SELECT s_suppkey, s_acctbal FROM supplier")
def _to_numeric(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").cast("string"))
    return roles.to_numeric(df, ["s_acctbal"])


@query("split_xy", "SELECT x0 AS in_0, x1 AS in_1, x3 AS out_0 FROM proc_wide", views=["proc_wide"])
def _split_xy(spark, sf):
    df = proc_wide(spark, sf).select("x0", "x1", "x3")
    xs, ys = roles.split_xy(df)
    return df.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(xs)], *[F.col(c).alias(f"out_{i}") for i, c in enumerate(ys)])


CLASSES = """SELECT label, row_number() OVER (ORDER BY CASE WHEN label = 'N' THEN 0 ELSE 1 END, label) - 1 AS class_id
    FROM (SELECT DISTINCT label FROM proc_wide)"""


@query("encode_labels", f"""SELECT w.episode, w.raw_index, w.label, c.class_id FROM proc_wide w
    JOIN ({CLASSES}) c ON w.label = c.label""", views=["proc_wide"])
def _encode(spark, sf):
    return roles.encode_labels(proc_wide(spark, sf).select(*KEYS, "label"), "label", normal="N")


@query("concat_vectors", "SELECT episode, raw_index, x0 AS v0, x1 AS v1, x2 AS v2 FROM proc_wide", views=["proc_wide"])
def _concat(spark, sf):
    df = proc_wide(spark, sf).select(*KEYS, roles.concat_vectors("v", ["x0", "x1"], ["x2"]))
    return df.select(*KEYS, *[F.get("v", F.lit(i)).alias(f"v{i}") for i in range(3)])


@query("wide_to_long", """SELECT episode, raw_index, 'x0' AS score_name, x0 AS score FROM proc_wide
    UNION ALL SELECT episode, raw_index, 'x1', x1 FROM proc_wide""", views=["proc_wide"])
def _long(spark, sf):
    return roles.wide_to_long(proc_wide(spark, sf), KEYS, ["x0", "x1"])


@query("long_to_wide", "SELECT episode, raw_index, x0 AS load, x1 / 1000 AS price, x2 + x3 AS rate FROM proc_wide", views=["proc_wide"])
def _wide(spark, sf):
    return roles.long_to_wide(scores(spark, sf), KEYS, ["load", "price", "rate"])


@query("finite_rows", "SELECT * FROM proc_missing WHERE x0 IS NOT NULL AND x1 IS NOT NULL", views=["proc_missing"])
def _finite(spark, sf):
    df = proc_missing(spark, sf).withColumn("x0", F.coalesce("x0", F.lit(float("inf"))))
    return clean.finite_rows(df, ["x0", "x1"])


@query("drop_label_values", "SELECT episode, raw_index, label FROM proc_wide WHERE label NOT IN ('R', 'A')", views=["proc_wide"])
def _drop_labels(spark, sf):
    return clean.drop_label_values(proc_wide(spark, sf).select(*KEYS, "label"), "label", ["R", "A"])[0]


@query("drop_label_report", """SELECT 'R' AS value, count(*) FILTER (label = 'R') AS dropped_rows, true AS column_found FROM proc_wide
    UNION ALL SELECT 'Z', count(*) FILTER (label = 'Z'), true FROM proc_wide""", views=["proc_wide"])
def _drop_report(spark, sf):
    return clean.drop_label_values(proc_wide(spark, sf), "label", ["R", "Z"])[1]


@query("missing_drop", "SELECT * FROM proc_missing WHERE x0 IS NOT NULL AND x1 IS NOT NULL", views=["proc_missing"])
def _missing_drop(spark, sf):
    return clean.handle_missing(proc_missing(spark, sf), ["episode"], "raw_index", ["x0", "x1"], "drop")


@query("missing_none", "SELECT * FROM proc_missing", views=["proc_missing"])
def _missing_none(spark, sf):
    return clean.handle_missing(proc_missing(spark, sf), ["episode"], "raw_index", ["x0", "x1"], "none")


def _interp(c):
    return f"""coalesce({c}, p{c} + (n{c} - p{c}) / nullif(ni{c} - pi{c}, 0) * (pos - pi{c}), p{c}, n{c})"""


FILL = """SELECT *, row_number() OVER (PARTITION BY episode ORDER BY raw_index) - 1 AS pos FROM proc_missing"""
BOUNDS = f"""SELECT *, {', '.join(
    f'''last_value({c} IGNORE NULLS) OVER before AS p{c}, first_value({c} IGNORE NULLS) OVER after AS n{c},
    last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER before AS pi{c},
    first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) OVER after AS ni{c}''' for c in ('x0', 'x1'))}
    FROM ({FILL}) WINDOW before AS (PARTITION BY episode ORDER BY raw_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    after AS (PARTITION BY episode ORDER BY raw_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


@query("missing_interpolate", f"SELECT episode, raw_index, {_interp('x0')} AS x0, {_interp('x1')} AS x1 FROM ({BOUNDS})",
       views=["proc_missing"], rounded=["x0", "x1"])
def _interpolate(spark, sf):
    return clean.handle_missing(proc_missing(spark, sf), ["episode"], "raw_index", ["x0", "x1"])


@query("missing_ffill_bfill", f"SELECT episode, raw_index, coalesce(x0, px0, nx0) AS x0, coalesce(x1, px1, nx1) AS x1 FROM ({BOUNDS})",
       views=["proc_missing"])
def _ffill(spark, sf):
    return clean.handle_missing(proc_missing(spark, sf), ["episode"], "raw_index", ["x0", "x1"], "ffill_bfill_then_drop")


@query("nan_to_zero", "SELECT episode, raw_index, coalesce(x0, 0) AS x0 FROM proc_missing", views=["proc_missing"])
def _nan(spark, sf):
    df = proc_missing(spark, sf).select(*KEYS, F.coalesce("x0", F.when(F.col("raw_index") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))).alias("x0"))
    return clean.nan_to_zero(df, ["x0"])


@query("missing_summary", """SELECT 'drop' AS strategy, count(*) AS original_rows,
    count(*) FILTER (x0 IS NULL OR x1 IS NULL) AS removed_rows, 0::BIGINT AS remaining_non_finite_rows FROM proc_missing""",
       views=["proc_missing"])
def _missing_summary(spark, sf):
    df = proc_missing(spark, sf)
    return clean.missing_summary(df, clean.handle_missing(df, ["episode"], "raw_index", ["x0", "x1"], "drop"), ["x0", "x1"], "drop")


@query("contiguous_pairs", """SELECT episode, raw_index, x0, prev_x0 FROM (SELECT episode, raw_index, x0, lag(x0) OVER w AS prev_x0, lag(raw_index) OVER w AS b FROM proc_gaps
    WINDOW w AS (PARTITION BY episode ORDER BY raw_index)) WHERE b = raw_index - 1""",
       views=["proc_gaps"])
def _contiguous(spark, sf):
    return clean.contiguous_pairs(proc_gaps(spark, sf).select(*KEYS, "x0"), ["episode"], "raw_index", ["x0"])


# --- artificial gaps ---------------------------------------------------------


def _uniform(seed, *parts):
    text = " || '|' || ".join([f"'{seed}'", *parts])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


EP, RI = "episode::VARCHAR", "raw_index::VARCHAR"


@query("mask_random", f"""SELECT episode, raw_index, {_uniform(7, EP, RI, "'x0'")} < 0.1 AS mask_x0,
    {_uniform(7, EP, RI, "'x1'")} < 0.1 AS mask_x1 FROM proc_wide""", views=["proc_wide"])
def _mask_random(spark, sf):
    return masks.mask_random(proc_wide(spark, sf).select(*KEYS, "x0", "x1"), KEYS, ["x0", "x1"], 0.1, 7).drop("x0", "x1")


@query("mask_block", f"""SELECT episode, raw_index, max(CASE WHEN {_uniform(7, EP, RI, "'x0'")} < {1 - 0.8 ** (1 / 6)!r}::DOUBLE
    THEN 1 ELSE 0 END) OVER (PARTITION BY episode ORDER BY raw_index RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) = 1 AS mask_x0
    FROM proc_gaps""", views=["proc_gaps"])
def _mask_block(spark, sf):
    return masks.mask_block(proc_gaps(spark, sf).select(*KEYS, "x0"), ["episode"], "raw_index", ["x0"], 0.2, 6, 7).drop("x0")


def _hidden_sql(c):
    return f"""SELECT episode, raw_index, '{c}' AS channel, min({_uniform(7, EP, RI, f"'{c}'")}) OVER (PARTITION BY episode ORDER BY raw_index RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS h FROM proc_gaps"""


@query("mask_block_exact", f"""SELECT episode, raw_index, bool_or(hidden) FILTER (channel = 'x0') AS mask_x0, bool_or(hidden) FILTER (channel = 'x1') AS mask_x1 FROM (
    SELECT *, row_number() OVER (ORDER BY h, episode, raw_index, channel) <= round_even(count(*) OVER () * 0.15::DOUBLE, 0) AS hidden FROM ({_hidden_sql("x0")} UNION ALL {_hidden_sql("x1")}))
    GROUP BY 1, 2""", views=["proc_gaps"])
def _mask_block_exact(spark, sf):
    df = proc_gaps(spark, sf).select(*KEYS, "x0", "x1")
    return masks.mask_block_exact(df, ["episode"], "raw_index", ["x0", "x1"], 0.15, 6, 7).drop("x0", "x1")


def _keep(i):
    lost = f"floor({_uniform(3, EP, RI, chr(39) + 'channel' + chr(39))} * 2)"
    mode = _uniform(3, EP, RI, "'mode'")
    own = _uniform(3, EP, RI, f"'x{i}'")
    return f"CASE WHEN {mode} < 0.5 THEN true WHEN {mode} < 0.5 + 0.3 THEN {lost} <> {i} ELSE {own} >= 0.4 END"


@query("mask_channels", f"SELECT episode, raw_index, {_keep(0)} AS keep_x0, {_keep(1)} AS keep_x1 FROM proc_wide", views=["proc_wide"])
def _mask_channels(spark, sf):
    return masks.mask_channels(proc_wide(spark, sf).select(*KEYS), KEYS, ["x0", "x1"], 3, 0.5, 0.3, 0.4)


@query("impute_target", f"""SELECT episode, raw_index, CASE WHEN m THEN -1.0::DOUBLE ELSE x0 END AS corrupted_x0, x0 AS target_x0,
    NOT m AS observed_x0 FROM (SELECT *, {_uniform(7, EP, RI, "'x0'")} < 0.1 AS m FROM proc_wide)""", views=["proc_wide"])
def _impute(spark, sf):
    masked = masks.mask_random(proc_wide(spark, sf).select(*KEYS, "x0"), KEYS, ["x0"], 0.1, 7)
    return masks.impute_target(masked, ["x0"], -1.0).drop("x0", "mask_x0")


@query("mask_summary", f"""SELECT count(*) AS "rows", sum(m)::BIGINT AS masked_entries, count(*) AS total_entries, sum(m) / count(*) AS actual_missing_rate
    FROM (SELECT CASE WHEN {_uniform(7, EP, RI, "'x0'")} < 0.1 THEN 1 ELSE 0 END AS m FROM proc_wide)""", views=["proc_wide"])
def _mask_summary(spark, sf):
    return masks.mask_summary(masks.mask_random(proc_wide(spark, sf).select(*KEYS, "x0"), KEYS, ["x0"], 0.1, 7), ["x0"])


# --- outliers ----------------------------------------------------------------

TRAIN = "raw_index % 4 <> 3"


def _score(spark, sf, rule):
    df = proc_wide(spark, sf).select(*KEYS, "x0", "x1")
    model = outliers.fit_outliers(df.where(TRAIN), ["x0", "x1"], rule)
    return df.select(*KEYS, model.severity().alias("severity"))


def _severity(stats, a, b):
    return f"""SELECT episode, raw_index, greatest({a}, {b}, 0) AS severity FROM proc_wide,
        (SELECT {stats} FROM proc_wide WHERE {TRAIN}) AS s"""


IQR = ", ".join(f"quantile_cont({c}, 0.25) AS a{c}, quantile_cont({c}, 0.75) AS b{c}" for c in ("x0", "x1"))


def _iqr(c, k=1.5):
    return f"greatest((a{c} - {c}) / greatest(b{c} - a{c}, 1e-12), ({c} - b{c}) / greatest(b{c} - a{c}, 1e-12)) - {k}"


@query("outlier_iqr", _severity(IQR, _iqr("x0", 0.5), _iqr("x1", 0.5)), views=["proc_wide"], rounded=["severity"])
def _o_iqr(spark, sf):
    return _score(spark, sf, outliers.OutlierRule("iqr", iqr_multiplier=0.5))


ZS = ", ".join(f"avg({c}) AS a{c}, stddev_pop({c}) AS b{c}" for c in ("x0", "x1"))


@query("outlier_zscore", _severity(ZS, *[f"abs(({c} - a{c}) / greatest(b{c}, 1e-12)) - 1.5" for c in ("x0", "x1")]),
       views=["proc_wide"], rounded=["severity"])
def _o_z(spark, sf):
    return _score(spark, sf, outliers.OutlierRule("zscore", z_threshold=1.5))


@query("outlier_mad", f"""SELECT episode, raw_index, greatest({', '.join(
    f'0.6745 * abs({c} - a{c}) / greatest(b{c}, 1e-12) - 1' for c in ('x0', 'x1'))}, 0) AS severity FROM proc_wide,
    (SELECT ax0, ax1, quantile_cont(abs(x0 - ax0), 0.5) AS bx0, quantile_cont(abs(x1 - ax1), 0.5) AS bx1 FROM proc_wide,
      (SELECT quantile_cont(x0, 0.5) AS ax0, quantile_cont(x1, 0.5) AS ax1 FROM proc_wide WHERE {TRAIN})
     WHERE {TRAIN} GROUP BY ax0, ax1)""", views=["proc_wide"], rounded=["severity"])
def _o_mad(spark, sf):
    return _score(spark, sf, outliers.OutlierRule("mad", mad_threshold=1.0))


TAIL = ", ".join(f"quantile_cont({c}, 0.05) AS a{c}, quantile_cont({c}, 0.95) AS b{c}" for c in ("x0", "x1"))


@query("outlier_tail", _severity(TAIL, _iqr("x0", 0), _iqr("x1", 0)), views=["proc_wide"], rounded=["severity"])
def _o_tail(spark, sf):
    return _score(spark, sf, outliers.OutlierRule("tail_percent", tail_percent=5))


@query("outlier_severity", f"""SELECT count(*) FILTER (severity > 0) AS marked, max(severity) AS worst
    FROM ({_severity(TAIL, _iqr('x0', 0), _iqr('x1', 0))})""", views=["proc_wide"], rounded=["worst"])
def _o_sev(spark, sf):
    df = _score(spark, sf, outliers.OutlierRule("tail_percent", tail_percent=0.05))
    return df.agg(F.count(F.when(F.col("severity") > 0, 1)).alias("marked"), F.max("severity").alias("worst"))


def _median(v):
    return f"(list_sort({v})[(len({v}) + 1) // 2] + list_sort({v})[len({v}) // 2 + 1]) / 2"


@query("outlier_local", f"""SELECT episode, raw_index, CASE WHEN l >= 2 AND r >= 2 AND s > 3.0 AND off >= 5 THEN s ELSE 0 END AS local_severity FROM (
    SELECT *, 0.6745 * off / greatest({_median('devs')}, 1e-12) AS s FROM (
    SELECT *, abs(x0 - m) AS off, list_transform(near, lambda v: abs(v - m)) AS devs FROM (
    SELECT *, {_median('near')} AS m FROM (
    SELECT episode, raw_index, x0, list(x0) OVER a || list(x0) OVER b AS near, count(*) OVER a AS l, count(*) OVER b AS r FROM proc_gaps
    WINDOW a AS (PARTITION BY episode ORDER BY raw_index ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
    b AS (PARTITION BY episode ORDER BY raw_index ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)) WHERE l >= 2 AND r >= 2
    )))
    UNION ALL SELECT episode, raw_index, 0 FROM (SELECT episode, raw_index, count(*) OVER a AS l, count(*) OVER b AS r FROM proc_gaps
    WINDOW a AS (PARTITION BY episode ORDER BY raw_index ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
    b AS (PARTITION BY episode ORDER BY raw_index ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)) WHERE l < 2 OR r < 2""",
       views=["proc_gaps"], rounded=["local_severity"])
def _o_local(spark, sf):
    rule = outliers.LocalRule(radius=4, mad_threshold=3.0, min_side=2, min_abs=5.0)
    df = outliers.local_severity(proc_gaps(spark, sf).select(*KEYS, "x0"), ["episode"], "raw_index", ["x0"], rule)
    return df.drop("x0")


CAPPED = f"""SELECT *, severity > 0 AS marked,
    severity > 0 AND row_number() OVER (ORDER BY severity DESC, episode, raw_index) <= floor(count(*) OVER () * 0.01) AS removed
    FROM (SELECT episode, raw_index, greatest((ax1 - x1) / (bx1 - ax1), (x1 - bx1) / (bx1 - ax1), 0) AS severity FROM proc_wide,
    (SELECT {TAIL} FROM proc_wide WHERE {TRAIN}))"""


@query("removal_cap", f"SELECT episode, raw_index, marked, removed FROM ({CAPPED})", views=["proc_wide"])
def _cap(spark, sf):
    df = proc_wide(spark, sf).select(*KEYS, "x1")
    model = outliers.fit_outliers(df.where(TRAIN), ["x1"], outliers.OutlierRule("tail_percent", tail_percent=5))
    scored = outliers.score_outliers(df, model, ["episode"], "raw_index")
    return outliers.cap_removals(scored, KEYS, 0.01).select(*KEYS, "marked", "removed")


SPLIT_SQL = "CASE WHEN raw_index % 4 = 3 THEN 'test' ELSE 'train' END"
FIT_APPLY = f"""SELECT episode, raw_index, split, severity > 0 AS marked, split = 'train' AND severity > 0 AND
    row_number() OVER (PARTITION BY split ORDER BY severity DESC, episode, raw_index) <= floor(count(*) OVER (PARTITION BY split) * 0.02) AS removed
    FROM (SELECT episode, raw_index, {SPLIT_SQL} AS split, greatest(abs((x1 - a) / b) - 1.6, 0) AS severity FROM proc_wide,
    (SELECT avg(x1) AS a, stddev_pop(x1) AS b FROM proc_wide WHERE {TRAIN}))"""
RULE = outliers.OutlierRule("zscore", z_threshold=1.6, max_removal_ratio=0.02)


def _fit_apply(spark, sf):
    part = F.when(F.col("raw_index") % 4 == 3, "test").otherwise("train")
    df = proc_wide(spark, sf).select(*KEYS, "x1", part.alias("split"))
    return outliers.fit_apply_outliers(df, ["x1"], RULE, ["episode"], "raw_index")


@query("outlier_fit_apply", FIT_APPLY, views=["proc_wide"])
def _o_apply(spark, sf):
    return _fit_apply(spark, sf).select(*KEYS, "split", "marked", "removed")


@query("outlier_report", f"""SELECT split, 'zscore' AS method, count(*) AS original_rows, count(*) FILTER (marked) AS marked_rows,
    count(*) FILTER (removed) AS removed_rows, count(*) FILTER (NOT removed) AS remaining_rows FROM ({FIT_APPLY}) GROUP BY split""",
       views=["proc_wide"])
def _o_report(spark, sf):
    return outliers.outlier_report(_fit_apply(spark, sf), RULE, ["split"])


@query("removed_ids", f"SELECT episode, raw_index FROM ({FIT_APPLY}) WHERE removed", views=["proc_wide"])
def _o_ids(spark, sf):
    return outliers.removed_ids(_fit_apply(spark, sf), KEYS).drop("severity")


def _pass(source):
    return f"""SELECT episode, raw_index, x1, greatest(abs((x1 - a) / b) - 1.6, 0) AS severity FROM {source},
        (SELECT avg(x1) AS a, stddev_pop(x1) AS b FROM {source})"""


@query("outlier_multipass", f"""SELECT episode, raw_index, severity FROM ({_pass('proc_wide')}) WHERE severity > 0 UNION ALL
    SELECT episode, raw_index, severity FROM ({_pass(f"(SELECT episode, raw_index, x1 FROM ({_pass('proc_wide')}) WHERE severity = 0)")}) WHERE severity > 0""",
       views=["proc_wide"], rounded=["severity"])
def _o_multi(spark, sf):
    rule = outliers.OutlierRule("zscore", z_threshold=1.6, max_removal_ratio=1.0)
    df = proc_wide(spark, sf).select(*KEYS, "x1")
    out = outliers.multipass_outliers(df, ["x1"], rule, ["episode"], "raw_index", passes=2)
    return out.where("removed").select(*KEYS, "severity")
