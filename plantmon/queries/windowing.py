"""Windowed samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantmon.operators import clean, reports, windows
from plantmon.plans import positions, running
from plantmon.queries.registry import query
from plantmon.queries.views import onsets, proc_gaps, proc_wide, timeline

KEYS = ["episode", "raw_index"]
W = "(PARTITION BY episode ORDER BY raw_index)"


def _lead(col, k):
    fn = "lead" if k >= 0 else "lag"
    return f"{fn}({col}, {abs(k)}) OVER {W}"


def _sql(cols, first, last, extra="", where="", index="raw_index AS start", source="proc_gaps"):
    body = ", ".join(f"{_lead(c, k)} AS {name}" for name, (c, k) in cols.items())
    keep = ", ".join(cols)
    return f"""SELECT episode, {index}, {keep}{extra} FROM (SELECT *, {body}, {_lead('raw_index', last)} AS w_last,
        {_lead('raw_index', first)} AS w_first FROM {source}) WHERE w_last = raw_index + {last} AND w_first = raw_index + {first} {where}"""


def _get(array, i):
    return F.get(array, F.lit(i))


DYN = {f"h{2 * r + j}": (c, r) for r in range(3) for j, c in enumerate(("x0", "x1"))}
DYN |= {f"f{2 * r + j}": (c, 3 + r) for r in range(2) for j, c in enumerate(("x0", "x1"))}
DYN |= {f"t{r}": ("x1", 3 + r) for r in range(2)}


@query("window_dynamic", _sql(DYN, 0, 4), views=["proc_gaps"])
def _dynamic(spark, sf):
    df = windows.window_dynamic(proc_gaps(spark, sf), ["episode"], "raw_index", ["x0"], ["x1"], 3, 2)
    return df.select("episode", "start", *[_get("history", i).alias(f"h{i}") for i in range(6)],
                     *[_get("future", i).alias(f"f{i}") for i in range(4)], *[_get("target", i).alias(f"t{i}") for i in range(2)])


def _sequence(spark, sf, task, **kw):
    return windows.window_sequence(proc_gaps(spark, sf), ["episode"], "raw_index", ["x0"], ["x1"], 3, task, **kw)


def _rows(df, x, t):
    return df.select("episode", "start", "target_start", *[_get(_get("x", i), 0).alias(f"x_{i}") for i in range(x)],
                     *[_get(_get("target", i), 0).alias(f"y_{i}") for i in range(t)])


XS = {f"x_{i}": ("x0", i) for i in range(3)}


@query("window_n_to_1", _sql(XS | {"y_0": ("x1", 3)}, 0, 3, ", raw_index + 3 AS target_start"), views=["proc_gaps"])
def _n1(spark, sf):
    df = _sequence(spark, sf, "many-to-one", squeeze=True)
    return df.select("episode", "start", "target_start", *[_get(_get("x", i), 0).alias(f"x_{i}") for i in range(3)], _get("target", 0).alias("y_0"))


@query("window_n_to_n", _sql(XS | {f"y_{i}": ("x1", i) for i in range(3)}, 0, 2, ", raw_index AS target_start"), views=["proc_gaps"])
def _nn(spark, sf):
    return _rows(_sequence(spark, sf, "n_to_n"), 3, 3)


@query("window_n_to_m", _sql(XS | {f"y_{i}": ("x1", 4 + i) for i in range(2)}, 0, 5, ", raw_index + 4 AS target_start"), views=["proc_gaps"])
def _nm(spark, sf):
    return _rows(_sequence(spark, sf, "future", target_length=2, offset=1), 3, 2)


GLOBAL = "(SELECT *, row_number() OVER (ORDER BY episode, raw_index) - 1 AS row_number FROM proc_gaps)"


@query("window_stride", _sql(XS | {"y_0": ("x1", 3)}, 0, 3, ", raw_index + 3 AS target_start", "AND row_number % 4 = 0", source=GLOBAL), views=["proc_gaps"])
def _stride(spark, sf):
    numbered = windows.global_positions(proc_gaps(spark, sf).select(*KEYS, "x0", "x1"), KEYS)
    df = windows.window_sequence(numbered, ["episode"], "raw_index", ["x0"], ["x1"], 3, "n_to_1", stride=4, stride_on="row_number")
    return _rows(df, 3, 1)


MPC = {f"p{4 * r + j}": (c, r) for r in range(2) for j, c in enumerate(("x0", "x1", "x2", "x3"))}
MPC |= {f"t{i}": ("x1", 2 + i) for i in range(2)} | {"c0": ("x2", 2)} | {f"r{i}": ("x3", 2 + i) for i in range(2)}


@query("window_mpc", _sql(MPC, 0, 3), views=["proc_gaps"])
def _mpc(spark, sf):
    df = windows.window_mpc(proc_gaps(spark, sf), ["episode"], "raw_index", state=["x0"], output=["x1"], control=["x2"],
                            reference=["x3"], past=2, prediction=2, control_steps=1)
    return df.select("episode", "start", *[_get(_get("past", i // 4), i % 4).alias(f"p{i}") for i in range(8)],
                     *[_get(_get("target_future", i), 0).alias(f"t{i}") for i in range(2)],
                     _get(_get("control_future", 0), 0).alias("c0"), *[_get(_get("reference_future", i), 0).alias(f"r{i}") for i in range(2)])


MULTI = {"now": ("x1", 2)} | {f"u{s}{k}": ("x0", s + 1 + k - 1) for s in range(2) for k in range(3)} | {f"t{i}": ("x1", 3 + i) for i in range(2)}


@query("window_multi_horizon", _sql(MULTI, 0, 4, index="raw_index + 3 AS anchor_index"), views=["proc_gaps"])
def _multi(spark, sf):
    df = windows.window_multi_horizon(proc_gaps(spark, sf), ["episode"], "raw_index", ["x0"], ["x1"], 3, 2)
    return df.select("episode", "anchor_index", _get("current_y", 0).alias("now"),
                     *[_get(_get(_get("target_past_u", s), k), 0).alias(f"u{s}{k}") for s in range(2) for k in range(3)],
                     *[_get(_get("target_future", i), 0).alias(f"t{i}") for i in range(2)])


@query("window_targets", _sql({"t0": ("x1", 3), "t1": ("x1", 4)}, 0, 4), views=["proc_gaps"])
def _targets(spark, sf):
    df = windows.window_dynamic(proc_gaps(spark, sf), ["episode"], "raw_index", ["x0"], ["x1"], 3, 2)
    return windows.window_targets(df).select("episode", "start", _get("target", 0).alias("t0"), _get("target", 1).alias("t1"))


@query("window_summary", f"""SELECT count(*) AS samples, 3::BIGINT AS input_length, 1::BIGINT AS input_dim, 1::BIGINT AS target_length, 1::BIGINT AS target_dim
    FROM ({_sql({'y_0': ('x1', 3)}, 0, 3)})""", views=["proc_gaps"])
def _summary(spark, sf):
    return windows.window_summary(_sequence(spark, sf, "n_to_1"), "x", "target")


@query("row_index", f"SELECT episode, raw_index, row_number() OVER {W} - 1 AS pos FROM proc_gaps", views=["proc_gaps"])
def _row_index(spark, sf):
    return positions(proc_gaps(spark, sf).select(*KEYS), ["episode"], "raw_index", size=128)


@query("lag_lead_pairs", f"""SELECT episode, raw_index, x0_now, x0_next FROM (SELECT episode, raw_index, lag(x0) OVER {W} AS x0_now, x0 AS x0_next,
    lag(raw_index) OVER {W} AS b FROM proc_gaps) WHERE b = raw_index - 1""", views=["proc_gaps"])
def _pairs(spark, sf):
    return clean.one_step_pairs(proc_gaps(spark, sf).select(*KEYS, "x0"), ["episode"], "raw_index", ["x0"])


BREAKS = f"""SELECT *, CASE WHEN lag(raw_index) OVER {W} = raw_index - 1 AND lag(fault) OVER {W} = fault THEN 0 ELSE 1 END AS brk FROM proc_gaps"""


@query("run_ids", f"SELECT episode, raw_index, fault, sum(brk) OVER {W}::BIGINT - 1 AS run_id FROM ({BREAKS})", views=["proc_gaps"])
def _runs(spark, sf):
    return clean.run_ids(proc_gaps(spark, sf).select(*KEYS, "fault"), ["episode"], "raw_index", ["fault"], size=100)


@query("run_starts", f"SELECT episode, raw_index, fault, max(CASE WHEN brk = 1 THEN raw_index END) OVER {W} AS run_start FROM ({BREAKS})", views=["proc_gaps"])
def _starts(spark, sf):
    return clean.run_starts(proc_gaps(spark, sf).select(*KEYS, "fault"), ["episode"], "raw_index", ["fault"], size=100)


@query("ar_regressors", _sql({"d0": ("x0", -2), "d1": ("x1", -2), "d2": ("x0", -1), "d3": ("x1", -1), "d4": ("x2", 0), "y0": ("x0", 0), "y1": ("x1", 0)}, -2, 0, index="raw_index"),
       views=["proc_gaps"])
def _ar(spark, sf):
    df = windows.ar_regressors(proc_gaps(spark, sf), ["episode"], "raw_index", ["x0", "x1"], 2, ["x2"])
    return df.select(*KEYS, *[_get("design", i).alias(f"d{i}") for i in range(5)], *[_get("target", i).alias(f"y{i}") for i in range(2)])


@query("delta_norms", f"""SELECT episode, raw_index, sqrt(x0 * x0 + x2 * x2) AS input_norm,
    CASE WHEN b = raw_index - 1 THEN sqrt((x0 - p0) * (x0 - p0) + (x2 - p2) * (x2 - p2)) ELSE 0 END AS input_delta_norm,
    CASE WHEN b = raw_index - 1 THEN abs(x3 - p3) ELSE 0 END AS exogenous_delta_norm
    FROM (SELECT *, lag(raw_index) OVER {W} AS b, lag(x0) OVER {W} AS p0, lag(x2) OVER {W} AS p2, lag(x3) OVER {W} AS p3 FROM proc_gaps)""",
       views=["proc_gaps"], rounded=["input_norm", "input_delta_norm", "exogenous_delta_norm"])
def _norms(spark, sf):
    df = proc_gaps(spark, sf).select(*KEYS, "x0", "x2", "x3")
    return windows.delta_norms(df, ["episode"], "raw_index", ["x0", "x2"], ["x3"]).drop("x0", "x2", "x3")


ANCHORED = "(SELECT *, raw_index - raw_index % 50 AS anchor FROM proc_gaps)"
STACK = _sql({f"s{2 * (k + 2) + j}": (c, k) for k in (-2, -1, 0) for j, c in enumerate(("x0", "x2"))}, -2, 0, ", anchor", index="raw_index", source=ANCHORED)


@query("stack_residuals", STACK.replace("PARTITION BY episode", "PARTITION BY episode, anchor"), views=["proc_gaps"])
def _stack(spark, sf):
    df = proc_gaps(spark, sf).withColumn("anchor", F.col("raw_index") - F.col("raw_index") % 50)
    out = windows.stack_residuals(df, ["episode", "anchor"], "raw_index", ["x0", "x2"], 3)
    return out.select("episode", "raw_index", "anchor", *[_get("stacked", i).alias(f"s{i}") for i in range(6)])


@query("cumulative_max", f"SELECT episode, raw_index, max(x1) OVER {W} AS envelope FROM proc_gaps", views=["proc_gaps"])
def _cummax(spark, sf):
    df = proc_gaps(spark, sf).select(*KEYS, "x1")
    return running(df, ["episode"], "raw_index", {"envelope": ("max", F.col("x1"))}, size=100).drop("x1")


@query("first_alarm", """SELECT w.episode, min(CASE WHEN x0 > 45 AND raw_index >= onset THEN raw_index END) AS first_alarm FROM proc_wide w
    JOIN onsets o ON w.episode = o.episode GROUP BY w.episode""", views=["onsets"])
def _first(spark, sf):
    from plantmon.plans import lookup

    df = lookup(proc_wide(spark, sf).select(*KEYS, "x0"), onsets(spark, sf), "episode", "inner")
    return reports.first_alarm(df, ["episode"], "raw_index", F.col("x0") > 45, F.col("onset"))


@query("timeline", "SELECT pos, raw, episode, x0, x1, fault FROM timeline", views=["timeline"])
def _timeline(spark, sf):
    return timeline(spark, sf)
