"""Labels, provenance, truth and other key joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantmon.operators import calibrate, labels
from plantmon.queries.registry import query
from plantmon.queries.views import onsets, proc_gaps, proc_wide, runs, scores, table

KEYS = ["episode", "raw_index"]


@query("attach_provenance", """SELECT g.episode, g.raw_index, g.x0, w.label, w.x3 AS source_tax FROM proc_gaps g
    LEFT JOIN proc_wide w ON g.episode = w.episode AND g.raw_index = w.raw_index""", views=["proc_gaps"])
def _provenance(spark, sf):
    origin = proc_wide(spark, sf).select(*KEYS, "label", F.col("x3").alias("source_tax"))
    return labels.attach_provenance(proc_gaps(spark, sf).select(*KEYS, "x0"), origin, KEYS)


@query("attach_groups", """SELECT g.episode, g.raw_index, 'G' || w.raw_index // 100 AS grp FROM proc_gaps g JOIN proc_wide w
    ON g.episode = w.episode AND g.raw_index = w.raw_index""", views=["proc_gaps"])
def _groups(spark, sf):
    groups = proc_wide(spark, sf).select(*KEYS, F.concat(F.lit("G"), F.expr("raw_index div 100")).alias("grp"))
    return labels.attach_groups(proc_gaps(spark, sf).select(*KEYS), groups, KEYS)


@query("label_lookup", """SELECT c.c_custkey, n.n_name FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def _lookup(spark, sf):
    from plantmon.plans import lookup

    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return lookup(table(spark, sf, "customer"), nation, "c_nationkey").select("c_custkey", "n_name")


@query("fault_family_lookup", """SELECT c_custkey, CASE WHEN c_nationkey % 6 = 0 THEN 'normal' ELSE r_name END AS family FROM customer
    LEFT JOIN region ON r_regionkey = c_nationkey % 6 - 1""")
def _family(spark, sf):
    families = table(spark, sf, "region").select((F.col("r_regionkey") + 1).alias("fault_id"), F.col("r_name").alias("family"))
    df = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 6).alias("fault_id"))
    return labels.fault_family(df, "fault_id", families).select("c_custkey", "family")


@query("label_by_onset", """SELECT w.episode, w.raw_index, (CASE WHEN w.raw_index >= o.onset THEN o.fault_id ELSE 0 END)::BIGINT AS fault_label
    FROM proc_wide w LEFT JOIN (SELECT * FROM onsets WHERE episode % 4 <> 0) o ON w.episode = o.episode""", views=["onsets"])
def _onset(spark, sf):
    return labels.label_by_onset(proc_wide(spark, sf).select(*KEYS), onsets(spark, sf).where("episode % 4 <> 0"), "episode", "raw_index")


INTERVALS = """(SELECT episode, onset + 40 * k AS start, onset + 40 * k + 15 AS stop, fault_id + k AS fault_id FROM onsets, (SELECT unnest([0, 1, 2]) AS k))"""


def _intervals(spark, sf):
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    return onsets(spark, sf).select("*", k.alias("k")).select(
        "episode", (F.col("onset") + 40 * F.col("k")).alias("start"), (F.col("onset") + 40 * F.col("k") + 15).alias("stop"),
        (F.col("fault_id") + F.col("k")).alias("fault_id"))


@query("label_by_interval", f"""SELECT w.episode, w.raw_index, coalesce(max(i.fault_id), 0)::BIGINT AS fault_label FROM proc_wide w LEFT JOIN {INTERVALS} i
    ON w.episode = i.episode AND w.raw_index BETWEEN i.start AND i.stop GROUP BY 1, 2""", views=["onsets"])
def _interval(spark, sf):
    return labels.label_by_interval(proc_wide(spark, sf).select(*KEYS), _intervals(spark, sf), "episode", "raw_index", size=64)


@query("rows_in_episodes", f"""SELECT s.episode, s.raw_index, s.x1, i.fault_id FROM proc_gaps s JOIN {INTERVALS} i
    ON s.episode = i.episode AND s.raw_index >= i.start AND s.raw_index < i.stop""", views=["onsets", "proc_gaps"])
def _rows_in(spark, sf):
    spans = _intervals(spark, sf).select("episode", F.col("start").alias("raw_start"), F.col("stop").alias("raw_stop"), "fault_id")
    return labels.rows_in_episodes(proc_gaps(spark, sf).select(*KEYS, "x1"), spans, ["episode"], "raw_index")


@query("scores_outside_stage", "SELECT w.episode, w.raw_index, w.x0 FROM proc_wide w WHERE (episode * 31 + raw_index) % 97 = 0", views=["proc_wide"])
def _outside(spark, sf):
    return labels.scores_outside(proc_wide(spark, sf).select(*KEYS, "x0"), proc_gaps(spark, sf), KEYS)


@query("bind_truth", "SELECT g.episode, g.raw_index, g.x0 AS score, w.fault FROM proc_gaps g JOIN proc_wide w ON g.episode = w.episode AND g.raw_index = w.raw_index",
       views=["proc_gaps"])
def _truth(spark, sf):
    outputs = proc_gaps(spark, sf).select(*KEYS, F.col("x0").alias("score"))
    return labels.bind_truth(outputs, proc_wide(spark, sf), KEYS, "fault")


@query("truth_coverage", """SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS matched, count(*) FILTER (b.k IS NULL) AS unlabelled,
    count(*) FILTER (a.k IS NULL) AS unscored FROM (SELECT episode || '-' || raw_index AS k FROM proc_gaps) a
    FULL JOIN (SELECT episode || '-' || raw_index AS k FROM proc_wide WHERE raw_index > 3) b ON a.k = b.k""", views=["proc_gaps"])
def _coverage(spark, sf):
    return labels.truth_coverage(proc_gaps(spark, sf), proc_wide(spark, sf).where("raw_index > 3"), KEYS)


@query("attach_failures", """SELECT c.c_custkey, count(o.o_orderkey) AS failed FROM customer c
    LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey""")
def _failures(spark, sf):
    failed = table(spark, sf, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return labels.attach_counts(table(spark, sf, "customer").select("c_custkey"), failed, "c_custkey", "failed")


@query("apply_thresholds", """SELECT s.episode, s.raw_index, s.score_name, s.score, t.threshold, s.score > t.threshold AS alarm FROM scores s
    JOIN (SELECT score_name, max(score) * 0.75 AS threshold FROM scores GROUP BY 1) t ON s.score_name = t.score_name""", views=["scores"])
def _thresholds(spark, sf):
    long = scores(spark, sf)
    limits = long.groupBy("score_name").agg((F.max("score") * 0.75).alias("threshold"))
    return calibrate.apply_thresholds(long, limits).select(*KEYS, "score_name", "score", "threshold", "alarm")


@query("anchor_asof", """SELECT episode, raw_index, a AS anchor_index, raw_index - a AS anchor_age FROM (SELECT episode, raw_index,
    max(CASE WHEN x2 <= 0.01 THEN raw_index END) OVER (PARTITION BY episode ORDER BY raw_index) AS a FROM proc_gaps)""", views=["proc_gaps"])
def _asof(spark, sf):
    df = proc_gaps(spark, sf).select(*KEYS, "x2")
    return labels.anchor_asof(df, ["episode"], "raw_index", F.col("x2") <= 0.01, size=100).drop("x2")


@query("replay_compare", """SELECT count(*) FILTER (a.x0 IS NULL) AS only_actual, count(*) FILTER (b.x0 IS NULL) AS only_expected,
    max(abs(a.x0 - b.x0)) AS max_abs_delta, false AS matches FROM (SELECT * FROM proc_gaps) a
    FULL JOIN (SELECT episode, raw_index, CASE WHEN raw_index = 5 THEN x0 + 1.0 / 4096 ELSE x0 END AS x0 FROM proc_wide WHERE raw_index > 0) b
    ON a.episode = b.episode AND a.raw_index = b.raw_index""", views=["proc_gaps"], rounded=["max_abs_delta"])
def _replay(spark, sf):
    expected = proc_gaps(spark, sf).select(*KEYS, F.col("x0").alias("score"))
    shifted = F.when(F.col("raw_index") == 5, F.col("x0") + 1.0 / 4096).otherwise(F.col("x0"))
    return labels.replay_compare(expected, proc_wide(spark, sf).where("raw_index > 0").select(*KEYS, shifted.alias("score")), KEYS)


@query("union_segments", """SELECT episode, raw_index, x0, NULL::DOUBLE AS x3 FROM proc_gaps UNION ALL SELECT episode, raw_index, NULL, x3 FROM proc_wide WHERE fault = 1""",
       views=["proc_gaps"])
def _union(spark, sf):
    from plantmon.operators.roles import union_segments

    return union_segments(proc_gaps(spark, sf).select(*KEYS, "x0"), proc_wide(spark, sf).where("fault = 1").select(*KEYS, "x3"))


@query("set_difference", "SELECT w.episode, w.raw_index FROM proc_wide w ANTI JOIN proc_gaps g ON w.episode = g.episode AND w.raw_index = g.raw_index", views=["proc_gaps"])
def _difference(spark, sf):
    return proc_wide(spark, sf).select(*KEYS).join(proc_gaps(spark, sf).select(*KEYS), KEYS, "left_anti")


@query("intersection", "SELECT o_custkey AS id FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def _intersection(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return a.intersect(table(spark, sf, "customer").where("c_acctbal > 5000").select("c_custkey"))


@query("runs_union", "SELECT trial_id, repeat_id, rmse, r2 FROM runs", views=["runs"])
def _runs_union(spark, sf):
    from plantmon.operators.runs import runs_union
    from plantmon.plans.staging import new_path

    root = new_path(spark, "runs")
    df = runs(spark, sf)
    df.where("repeat_id % 2 = 0").write.json(f"{root}/a")
    df.where("repeat_id % 2 <> 0").write.json(f"{root}/b")
    return runs_union(spark, [f"{root}/a", f"{root}/b"], "trial_id string, repeat_id bigint, rmse double, r2 double").drop("source")
