"""Live monitoring: file feeds run to completion, checked like any batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantmon.operators import scale
from plantmon.queries import views as v
from plantmon.queries.isolation import RATES, REPORT
from plantmon.queries.registry import query
from plantmon.streaming import gate, live

KEYS = ["episode", "raw_index"]
TRAIN = "raw_index % 4 <> 3"
RULE = gate.GateRule(history=4, delay=2, enter=0.03, exit=0.07, reanchor=8, max_age=15)

RECORDS = """SELECT episode, raw_index, x2 AS score, CASE WHEN (raw_index // 150) % 2 = 0 THEN 'a' ELSE 'b' END AS stage,
    row_number() OVER (PARTITION BY episode ORDER BY raw_index) AS k FROM proc_gaps"""
# The gate as a recursion over the k-th record of every episode.
GATE = f"""SELECT episode, stage, raw_index, score, mode, anchor AS anchor_index, raw_index - anchor AS anchor_age, resets AS reset_count FROM (
    WITH RECURSIVE r AS ({RECORDS}), walk AS (
      SELECT episode, raw_index, score, stage, k, 1 AS seen, NULL::BIGINT AS cand, NULL::BIGINT AS anchor, 0::BIGINT AS resets, 'WARMUP' AS mode FROM r WHERE k = 1
      UNION ALL
      SELECT episode, raw_index, score, stage, k, seen, cand, anchor, resets, CASE WHEN warm THEN 'WARMUP' WHEN cand IS NOT NULL THEN 'CANDIDATE' WHEN anchor IS NULL THEN 'WARMUP'
          WHEN raw_index - anchor > {RULE.max_age} THEN 'STALE' ELSE 'PROTECTED' END FROM (
        SELECT episode, raw_index, score, stage, k, least(seen0 + 1, {RULE.history}) AS seen, resets, seen0 < {RULE.history} AS warm,
          CASE WHEN seen0 < {RULE.history} THEN NULL WHEN cand0 IS NOT NULL THEN CASE WHEN score > {RULE.exit} OR raw_index - cand0 >= {RULE.delay} THEN NULL ELSE cand0 END
            WHEN score <= {RULE.enter} AND (anchor0 IS NULL OR raw_index - anchor0 >= {RULE.reanchor}) THEN raw_index END AS cand,
          CASE WHEN seen0 < {RULE.history} THEN NULL WHEN cand0 IS NOT NULL AND score <= {RULE.exit} AND raw_index - cand0 >= {RULE.delay} THEN cand0 ELSE anchor0 END AS anchor FROM (
          SELECT n.episode, n.raw_index, n.score, n.stage, n.k, w.resets + b AS resets, CASE WHEN b = 1 THEN 0 ELSE w.seen END AS seen0,
            CASE WHEN b = 0 THEN w.cand END AS cand0, CASE WHEN b = 0 THEN w.anchor END AS anchor0
          FROM (SELECT w.*, n.k AS nk, CASE WHEN n.raw_index = w.raw_index + 1 AND n.stage = w.stage THEN 0 ELSE 1 END AS b FROM walk w JOIN r n ON n.episode = w.episode AND n.k = w.k + 1) w
          JOIN r n ON n.episode = w.episode AND n.k = w.nk)))
    SELECT * FROM walk)"""


def _records(spark, sf):
    name = F.when(F.expr("raw_index div 150") % 2 == 0, "a").otherwise("b")
    return v.proc_gaps(spark, sf).select(*KEYS, name.alias("stage"), F.col("x2").alias("score"))


def _replay(df):
    return live.Replay(df, "raw_index")


@query("anchor_gate_batch", f"SELECT * FROM ({GATE})", views=["proc_gaps"])
def _gate(spark, sf):
    return gate.gate_batch(_records(spark, sf), RULE)


@query("anchor_gate_stream", f"SELECT * FROM ({GATE})", views=["proc_gaps"])
def _gate_stream(spark, sf):
    live.use_rocksdb(spark)
    replay = _replay(_records(spark, sf))
    return live.drain(gate.gate_stream(replay.records, RULE), replay, "gate")


@query("anchor_gate_expiring", f"SELECT * FROM ({GATE})", views=["proc_gaps"])
def _gate_expiring(spark, sf):
    """One record a second; an episode whose last one is 40 s behind the feed loses its state."""
    live.use_rocksdb(spark)
    replay = _replay(_records(spark, sf).withColumn("ts", F.timestamp_seconds(F.col("raw_index") + 1_700_000_000)))
    return live.drain(gate.gate_stream(replay.records, RULE, idle=gate.Idle("ts", after=40_000)), replay, "gate")


@query("boundary_reset_stream", f"SELECT episode, max(reset_count) AS resets FROM ({GATE}) GROUP BY episode", views=["proc_gaps"])
def _resets(spark, sf):
    live.use_rocksdb(spark)
    replay = _replay(_records(spark, sf))
    out = live.drain(gate.gate_stream(replay.records, RULE), replay, "gate")
    return out.groupBy("episode").agg(F.max("reset_count").alias("resets"))


@query("history_stream", """SELECT episode, raw_index, len(h) AS n, h[1] AS oldest, h[-1] AS newest FROM (SELECT episode, raw_index, list(x2) OVER (PARTITION BY episode, run
    ORDER BY raw_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS h FROM (SELECT *, sum(b) OVER (PARTITION BY episode ORDER BY raw_index) AS run FROM (SELECT *,
    CASE WHEN lag(raw_index) OVER (PARTITION BY episode ORDER BY raw_index) = raw_index - 1 THEN 0 ELSE 1 END AS b FROM proc_gaps)))""", views=["proc_gaps"])
def _history(spark, sf):
    live.use_rocksdb(spark)
    replay = _replay(_records(spark, sf))
    out = live.drain(gate.history_stream(replay.records, 3), replay, "history")
    return out.select(*KEYS, F.size("history").cast("long").alias("n"), F.get("history", F.lit(0)).alias("oldest"),
                      F.element_at("history", -1).alias("newest"))


@query("threshold_stream", """SELECT s.episode, s.raw_index, s.score_name, s.score, t.threshold, s.score > t.threshold AS alarm FROM scores s
    JOIN (SELECT score_name, max(score) * 0.75 AS threshold FROM scores GROUP BY 1) t ON s.score_name = t.score_name""", views=["scores"])
def _threshold(spark, sf):
    long = v.scores(spark, sf)
    limits = long.groupBy("score_name").agg((F.max("score") * 0.75).alias("threshold"))
    replay = _replay(long)
    out = live.drain(live.live_threshold(replay.records, limits), replay, "alarms")
    return out.select(*KEYS, "score_name", "score", "threshold", "alarm")


@query("detection_report_stream", REPORT, views=["onsets"], rounded=RATES)
def _report(spark, sf):
    df = v.proc_wide(spark, sf).select(*KEYS, (F.col("x0") > 45).alias("alarm"))
    return live.live_report(_replay(df), v.onsets(spark, sf))


@query("scale_stream", f"""SELECT episode, raw_index, (x0 - a) / s AS x0 FROM proc_wide, (SELECT avg(x0) AS a, stddev_pop(x0) AS s FROM proc_wide WHERE {TRAIN})""",
       views=["proc_wide"], rounded=["x0"])
def _scale(spark, sf):
    df = v.proc_wide(spark, sf).select(*KEYS, "x0")
    model = scale.fit_scaler(df.where(TRAIN), ["x0"])
    replay = _replay(df)
    return live.drain(live.live_scale(replay.records, model), replay, "scaled")
