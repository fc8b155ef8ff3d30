"""Set-valued isolation and episode reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantmon.operators import isolate, reports
from plantmon.operators.cell_tree import nearest_cells
from plantmon.plans import stage
from plantmon.queries import views as v
from plantmon.queries.registry import query

KEYS = ["episode", "raw_index"]
CELL = "list_max(list_transform(list_zip(o.features, c.center, c.scale), lambda p: abs(p[1]::DOUBLE - p[2]) / p[3]))"
FAMILY = f"SELECT obs_id, episode, family_id, min(s) AS score FROM (SELECT o.obs_id, o.episode, c.family_id, {CELL} AS s FROM observations o, cells c) GROUP BY 1, 2, 3"


@query("cell_score", f"SELECT obs_id, arg_min(cell_id, {{'s': s, 'i': cell_id}}) AS cell_id, min(s) AS score FROM (SELECT o.obs_id, c.cell_id, {CELL} AS s FROM observations o, cells c) GROUP BY obs_id",
       views=["observations", "cells"], rounded=["score"])
def _cell(spark, sf):
    return nearest_cells(v.observations(spark, sf), "features", v.cells(spark, sf), ["obs_id"], family=())


def _family(spark, sf):
    return isolate.family_scores(v.observations(spark, sf), "features", v.cells(spark, sf), ["obs_id", "episode"])


@query("family_score", FAMILY, views=["observations", "cells"], rounded=["score"])
def _family_score(spark, sf):
    return _family(spark, sf)


RADIUS = "(CASE family_id WHEN 'F0' THEN 2.2 WHEN 'F1' THEN 2.3 WHEN 'F2' THEN 2.4 WHEN 'F3' THEN 2.5 ELSE 2.6 END)"
SURE = f"SELECT obs_id, episode, family_id, score, {RADIUS}::DOUBLE AS radius, score <= {RADIUS} AS feasible, true AS certified FROM ({FAMILY})"
FEASIBLE = f"{SURE} UNION ALL SELECT obs_id, episode, 'F9', 0, 'infinity'::DOUBLE, true, false FROM observations"


def _feasible(spark, sf, uncertified=()):
    fam = _family(spark, sf)
    radii = fam.select("family_id").distinct().withColumn("radius", F.round(2.2 + 0.1 * F.substring("family_id", 2, 1).cast("int"), 1))
    return isolate.feasible_families(fam, radii, uncertified)


@query("feasible_families", SURE, views=["observations", "cells"], rounded=["score", "radius"])
def _feasible_query(spark, sf):
    return _feasible(spark, sf)


@query("feasible_uncertified", FEASIBLE, views=["observations", "cells"], rounded=["score", "radius"])
def _uncertified(spark, sf):
    return _feasible(spark, sf, ["F9"])


REFINE = """(SELECT l_suppkey AS obs, l_partkey % 40 AS cell, l_orderkey AS level, min(l_discount) AS lo, max(l_discount) + min(l_tax) AS hi FROM lineitem GROUP BY 1, 2, 3)"""


def _refinements(spark, sf):
    return v.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("obs"), (F.col("l_partkey") % 40).alias("cell"), F.col("l_orderkey").alias("level")).agg(
        F.min("l_discount").alias("lo"), (F.max("l_discount") + F.min("l_tax")).alias("hi"))


@query("cell_bounds", f"""SELECT obs, min(lo) AS outer_score, count(*) FILTER (lo <= 0.05 AND 0.05 < hi) AS unresolved_cells, min(lo) <= 0.05 AS feasible
    FROM (SELECT obs, cell, arg_max(lo, level) AS lo, arg_max(hi, level) AS hi FROM {REFINE} GROUP BY 1, 2) GROUP BY obs""", rounded=["outer_score"])
def _bounds(spark, sf):
    return isolate.cell_bounds(_refinements(spark, sf), ["obs"], "cell", "level", "lo", "hi", 0.05)


@query("refinement_violations", f"""SELECT obs, cell, level, lo, hi FROM (SELECT *, lag(lo) OVER w AS a, lag(hi) OVER w AS b FROM {REFINE}
    WINDOW w AS (PARTITION BY obs, cell ORDER BY level)) WHERE lo < a OR hi > b""", rounded=["hi"])
def _violations(spark, sf):
    return isolate.refinement_violations(_refinements(spark, sf), ["obs"], "cell", "level", "lo", "hi")


RADII = [k / 200 for k in range(20)]


@query("cell_bounds_radii", f"""SELECT obs, radius, min(lo) AS outer_score, count(*) FILTER (lo <= radius AND radius < hi) AS unresolved_cells, min(lo) <= radius AS feasible
    FROM (SELECT obs, cell, arg_max(lo, level) AS lo, arg_max(hi, level) AS hi FROM {REFINE} GROUP BY 1, 2), (SELECT unnest({RADII})::DOUBLE AS radius) GROUP BY obs, radius""", rounded=["outer_score", "radius"])
def _bounds_radii(spark, sf):
    last = _refinements(spark, sf).groupBy("obs", "cell").agg(F.max_by("lo", "level").alias("lo"), F.max_by("hi", "level").alias("hi"))
    return isolate.bounds_over_radii(last, ["obs"], "lo", "hi", RADII)


# Bounds around a value of the cell that halve from level to level.
NESTED = """(SELECT DISTINCT l_suppkey AS obs, l_partkey % 40 AS cell, l_linenumber AS level, (l_suppkey * 31 + l_partkey % 40 * 17) % 64 / 64.0::DOUBLE - 1.0::DOUBLE / (1 << l_linenumber::INT) AS lo,
    (l_suppkey * 31 + l_partkey % 40 * 17) % 64 / 64.0::DOUBLE + 1.0::DOUBLE / (1 << l_linenumber::INT) AS hi FROM lineitem)"""


@query("refinement_merge", f"SELECT obs, cell, max(level) AS level, arg_max(lo, level) AS lo, arg_max(hi, level) AS hi FROM {NESTED} GROUP BY 1, 2", rounded=["lo", "hi"])
def _merged(spark, sf):
    cell, width = F.col("l_partkey") % 40, F.lit(1.0) / F.expr("shiftleft(1, cast(l_linenumber as int))")
    middle = (F.col("l_suppkey") * 31 + cell * 17) % 64 / 64.0
    rows = v.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("obs"), cell.alias("cell"), F.col("l_linenumber").alias("level"), (middle - width).alias("lo"), (middle + width).alias("hi")).distinct()
    names = (["obs"], "cell", "level", "lo", "hi")
    first = stage(isolate.merge_refinements(None, rows.where("level <= 3"), *names), "refined")
    return isolate.merge_refinements(first, rows.where("level > 3"), *names)


def _candidate_sql(feasible):
    return f"""SELECT o.obs_id, o.episode, o.excess, f.certified, CASE WHEN o.excess <= 0.2 OR f.normal THEN list_concat(['F0'], f.faults) ELSE f.faults END AS cand
    FROM (SELECT obs_id, episode, abs(features[1]::DOUBLE) AS excess FROM observations) o JOIN (SELECT obs_id, list_sort(coalesce(list(DISTINCT family_id) FILTER (feasible AND family_id <> 'F0'), [])) AS faults,
    coalesce(bool_or(feasible) FILTER (family_id = 'F0'), false) AS normal, bool_and(certified) AS certified FROM ({feasible}) GROUP BY obs_id) f ON o.obs_id = f.obs_id"""


def _outcome_sql(feasible):
    return f"""SELECT obs_id, episode, excess, array_to_string(cand, ',') AS candidates, outcome AS isolation_outcome, CASE WHEN outcome = 'singleton' THEN cand[1] END AS reported_family,
    CASE WHEN outcome = 'singleton' THEN true WHEN outcome = 'Uncertified' THEN false ELSE certified END AS isolation_certified, cand FROM (
    SELECT *, CASE WHEN list_contains(cand, 'F0') THEN 'Normal-compatible' WHEN len(cand) = 0 THEN 'Out-of-model' WHEN len(cand) > 1 THEN 'Nonunique'
    WHEN certified THEN 'singleton' ELSE 'Uncertified' END AS outcome FROM ({_candidate_sql(feasible)}))"""


def _decided(spark, sf, uncertified=()):
    obs = v.observations(spark, sf).select("obs_id", "episode", F.abs(F.get("features", F.lit(0))).alias("detection_excess"))
    sets = isolate.candidate_sets(_feasible(spark, sf, uncertified).drop("episode"), obs, ["obs_id"], normal="F0", detection_quantile=0.2)
    return isolate.isolation_outcome(sets, "F0")


# Each decision twice over all rows: with certified families only, and with one that has no certified cell.
VARIANTS = [("", SURE, ()), ("_uncertified", FEASIBLE, ("F9",))]


def _candidate_query(suffix, feasible, uncertified):
    @query(f"candidate_set{suffix}", f"SELECT obs_id, array_to_string(cand, ',') AS candidates FROM ({_candidate_sql(feasible)})", views=["observations", "cells"])
    def _candidates(spark, sf):
        return _decided(spark, sf, uncertified).select("obs_id", F.array_join("candidates", ",").alias("candidates"))


def _outcome_query(suffix, feasible, uncertified):
    @query(f"isolation_outcome{suffix}", f"SELECT obs_id, candidates, isolation_outcome, reported_family, isolation_certified FROM ({_outcome_sql(feasible)})", views=["observations", "cells"])
    def _outcome(spark, sf):
        return _decided(spark, sf, uncertified).select("obs_id", F.array_join("candidates", ",").alias("candidates"), "isolation_outcome", "reported_family", "isolation_certified")


for _variant in VARIANTS:
    _candidate_query(*_variant)
    _outcome_query(*_variant)


@query("normal_calibration", f"""SELECT m AS episodes, r AS rank, 1.0::DOUBLE / (m + 1) AS resolution, 'ready' AS status, list_sort(xs)[r] AS quantile FROM (
    SELECT count(*) AS m, list(x) AS xs, ceil((count(*) + 1) * (1 - 0.05::DOUBLE))::BIGINT AS r FROM (SELECT episode, max(score) AS x FROM ({FAMILY}) WHERE family_id = 'F0' GROUP BY episode))""",
       views=["observations", "cells"], rounded=["resolution", "quantile"])
def _normal(spark, sf):
    return isolate.normal_calibration(_family(spark, sf), ["episode"], "F0", 0.05, 0.1)


def _decision_query(suffix, feasible, uncertified):
    text = f"""SELECT obs_id, CASE WHEN obs_id % 7 = 0 THEN 'alarm_without_exceedance' ELSE 'suppressed_without_reason' END AS violation FROM ({_outcome_sql(feasible)})
    WHERE (obs_id % 7 = 0 AND NOT excess > 0.5) OR (obs_id % 7 <> 0 AND obs_id % 5 = 0 AND excess > 0.5)"""

    @query(f"decision_consistency{suffix}", text, views=["observations", "cells"])
    def _decision(spark, sf):
        i = F.col("obs_id")
        over = F.col("detection_excess") > 0.5
        df = _decided(spark, sf, uncertified).withColumns({
            "score": F.col("detection_excess"), "threshold": F.lit(0.5),
            "alarm": F.when(i % 7 == 0, F.lit(True)).when(i % 5 == 0, F.lit(False)).otherwise(over),
            "suppression_reason": F.lit(None).cast("string")})
        return isolate.decision_violations(df, "F0").select("obs_id", "violation")


for _variant in VARIANTS:
    _decision_query(*_variant)


REPORT = """SELECT w.episode, o.fault_id, o.onset, count(*) AS row_count, count(*) FILTER (raw_index < onset) AS pre_fault_row_count, count(*) FILTER (raw_index >= onset) AS post_onset_row_count,
    count(*) FILTER (raw_index < onset AND x0 > 45) AS pre_fault_alarm_count, count(*) FILTER (raw_index >= onset AND x0 > 45) AS post_onset_alarm_count,
    min(raw_index) FILTER (raw_index >= onset AND x0 > 45) AS first_post_onset_alarm,
    CASE WHEN count(*) FILTER (raw_index < onset) > 0 THEN count(*) FILTER (raw_index < onset AND x0 > 45) / count(*) FILTER (raw_index < onset) ELSE 0 END AS pre_fault_alarm_rate,
    CASE WHEN count(*) FILTER (raw_index >= onset) > 0 THEN count(*) FILTER (raw_index >= onset AND x0 > 45) / count(*) FILTER (raw_index >= onset) END AS post_onset_alarm_rate,
    min(raw_index) FILTER (raw_index >= onset AND x0 > 45) - onset AS detection_delay_steps FROM proc_wide w JOIN onsets o ON w.episode = o.episode GROUP BY 1, 2, 3"""
RATES = ["pre_fault_alarm_rate", "post_onset_alarm_rate"]


@query("episode_detection_report", REPORT, views=["onsets"], rounded=RATES)
def _report(spark, sf):
    df = v.proc_wide(spark, sf).select(*KEYS, (F.col("x0") > 45).alias("alarm"))
    return reports.episode_detection_report(df, v.onsets(spark, sf), "episode", "raw_index")


def _report_query(suffix, feasible, uncertified):
    outcome = _outcome_sql(feasible)

    @query(f"episode_isolation_report{suffix}", f"""SELECT a.*, coalesce(b.candidate_ids, '[]') AS candidate_ids FROM (SELECT episode,
    {', '.join(f"count(*) FILTER (isolation_outcome = '{o}') AS " + chr(34) + o + chr(34) for o in isolate.OUTCOMES)},
    count(*) FILTER (isolation_certified) AS certified_row_count,
    '[' || coalesce(string_agg(DISTINCT '"' || reported_family || '"', ',' ORDER BY '"' || reported_family || '"'), '') || ']' AS reported_families FROM ({outcome}) GROUP BY episode) a
    LEFT JOIN (SELECT episode, '[' || string_agg(DISTINCT '"' || c || '"', ',' ORDER BY '"' || c || '"') || ']' AS candidate_ids FROM (SELECT episode, unnest(cand) AS c FROM ({outcome})) GROUP BY episode) b
    ON a.episode = b.episode""", views=["observations", "cells"])
    def _isolation_report(spark, sf):
        return reports.episode_isolation_report(_decided(spark, sf, uncertified), ["episode"])


for _variant in VARIANTS:
    _report_query(*_variant)


@query("score_trajectory", """SELECT episode, raw_index, x0 AS score, CASE WHEN raw_index % 9 = 0 THEN 'infinity' ELSE '40.0' END AS threshold,
    '["' || label || '"]' AS candidates FROM proc_wide""", views=["proc_wide"])
def _trajectory(spark, sf):
    df = v.proc_wide(spark, sf).select(*KEYS, F.col("x0").alias("score"), F.when(F.col("raw_index") % 9 == 0, F.lit(float("inf"))).otherwise(F.lit(40.0)).alias("threshold"),
                                       F.array("label").alias("candidates"))
    return reports.score_trajectory(df, df.columns, lists=["candidates"])


TRACE = """(SELECT pos, episode, CASE WHEN fault = 1 THEN 'b' ELSE 'a' END AS stage, raw AS raw_index, raw // 50 AS reset_count, 'm' || raw // 3000 AS monitor_identity FROM timeline)"""


@query("trace_check", f"""SELECT * FROM (WITH t AS (SELECT *, lag(episode) OVER w AS e,
    lag(stage) OVER w AS s, lag(raw_index) OVER w AS i, lag(reset_count) OVER w AS r, lag(monitor_identity) OVER w AS m
    FROM {TRACE} WINDOW w AS (ORDER BY pos)) SELECT pos, violation FROM (SELECT pos, 'reset_step' AS violation FROM t WHERE reset_count - r NOT IN (0, 1) UNION ALL
    SELECT pos, 'reset_mismatch' FROM t WHERE (episode <> e OR stage <> s OR raw_index <> i + 1) <> (reset_count > r) UNION ALL
    SELECT pos, 'identity_changed' FROM t WHERE monitor_identity <> m))""", views=["timeline"])
def _trace(spark, sf):
    df = v.timeline(spark, sf).select(
        "pos", "episode", F.when(F.col("fault") == 1, "b").otherwise("a").alias("stage"), F.col("raw").alias("raw_index"),
        F.expr("raw div 50").alias("reset_count"), F.concat(F.lit("m"), F.expr("raw div 3000")).alias("monitor_identity"))
    return reports.trace_violations(df, [], "pos").select("pos", "violation")
