"""Splits, stages, fingerprints and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantmon.operators import splits
from plantmon.plans import rank_within
from plantmon.queries.registry import query
from plantmon.queries.views import proc_events, proc_gaps, proc_wide, table, timeline

KEYS = ["episode", "raw_index"]
HASH = "md5('7|' || episode || '|' || raw_index)"


@query("split_random", f"""SELECT episode, raw_index, CASE WHEN row_number() OVER (ORDER BY {HASH}) <= greatest(1, round_even(count(*) OVER () * 0.2::DOUBLE, 0))
    THEN 'test' ELSE 'train' END AS split FROM proc_wide""", views=["proc_wide"])
def _random(spark, sf):
    return splits.split_random(proc_wide(spark, sf).select(*KEYS), KEYS, 0.2, 7)


@query("split_sequential", """SELECT episode, raw_index, CASE WHEN row_number() OVER (PARTITION BY episode ORDER BY raw_index) >
    n - greatest(1, round_even(n * 0.2::DOUBLE, 0)) THEN 'test' ELSE 'train' END AS split
    FROM (SELECT *, count(*) OVER (PARTITION BY episode) AS n FROM proc_gaps)""", views=["proc_gaps"])
def _sequential(spark, sf):
    return splits.split_sequential(proc_gaps(spark, sf).select(*KEYS), ["episode"], "raw_index", 0.2)


@query("split_sequential_rows", """SELECT raw, CASE WHEN pos >= (SELECT count(*) - greatest(1, round_even(count(*) * 0.3::DOUBLE, 0)) FROM timeline)
    THEN 'test' ELSE 'train' END AS split FROM timeline""", views=["timeline"])
def _sequential_rows(spark, sf):
    return splits.split_sequential(timeline(spark, sf).select("raw"), [], "raw", 0.3)


@query("split_sequential_windows", """SELECT pos, CASE WHEN pos >= least(n - 1, greatest(1, round_even(n * 0.7::DOUBLE, 0)) + round_even(n * 0.1::DOUBLE, 0)) THEN 'test'
    WHEN pos >= greatest(1, round_even(n * 0.7::DOUBLE, 0)) THEN 'eval' ELSE 'train' END AS split
    FROM (SELECT pos, count(*) OVER () AS n FROM timeline)""", views=["timeline"])
def _sequential_windows(spark, sf):
    return splits.split_sequential_windows(timeline(spark, sf).select("pos"), "pos", 0.7, 0.1)


@query("split_stratified", f"""SELECT episode, raw_index, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {HASH}) <=
    least(greatest(1, round_even(n * 0.25::DOUBLE, 0)), n - 1) THEN 'test' ELSE 'train' END AS split
    FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM proc_wide)""", views=["proc_wide"])
def _stratified(spark, sf):
    return splits.split_stratified(proc_wide(spark, sf).select(*KEYS, "label"), KEYS, "label", 0.25, 7)


GROUPS = """SELECT episode, n AS "rows", CASE WHEN before < greatest(1, round_even(total * 0.3::DOUBLE, 0)) AND h <> last THEN 'test' ELSE 'train' END AS split
    FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(n) OVER () AS total, max(h) OVER () AS last
    FROM (SELECT episode, count(*) AS n, md5('5|' || episode) AS h FROM proc_wide GROUP BY episode))"""


@query("split_group_table", GROUPS, views=["proc_wide"])
def _group_table(spark, sf):
    return splits.group_split_table(proc_wide(spark, sf), "episode", 0.3, 5)


@query("split_group", f"SELECT w.episode, w.raw_index, g.split FROM proc_wide w JOIN ({GROUPS}) g ON w.episode = g.episode", views=["proc_wide"])
def _group(spark, sf):
    return splits.split_group(proc_wide(spark, sf).select(*KEYS), "episode", 0.3, 5)


@query("split_official", """SELECT episode, raw_index, x0, 'train' AS split FROM proc_wide WHERE fault = 0
    UNION ALL SELECT episode, raw_index, x0, 'test' FROM proc_wide WHERE fault = 1""", views=["proc_wide"])
def _official(spark, sf):
    df = proc_wide(spark, sf)
    return splits.split_official({"train": df.where("fault = 0").select(*KEYS, "x0"), "test": df.where("fault = 1").select(*KEYS, "x0")})


SLICED = """SELECT *, least(pos // 1500, CASE WHEN n - ((n + 1499) // 1500 - 1) * 1500 < 750 AND n > 1500
    THEN (n + 1499) // 1500 - 2 ELSE (n + 1499) // 1500 - 1 END) AS slice FROM (SELECT *, count(*) OVER () AS n FROM timeline)"""


@query("slice_summary", f"""SELECT slice::BIGINT AS slice, min(pos) AS start, max(pos) + 1 AS stop, count(*) AS "rows", avg(x1) AS mean, stddev_pop(x1) AS std,
    min(x1) AS min, quantile_cont(x1, 0.5) AS p50, max(x1) AS max FROM ({SLICED}) GROUP BY slice""", views=["timeline"],
       rounded={"mean": 4, "std": 4, "p50": 4})
def _slices(spark, sf):
    return splits.slice_summary(splits.slice_ids(timeline(spark, sf), "pos", 1500), "pos", "x1")


@query("distribution_summary", """SELECT split, count(*) AS "rows", avg(x1) AS mean, stddev_pop(x1) AS std, min(x1) AS min,
    quantile_cont(x1, 0.1) AS p10, quantile_cont(x1, 0.25) AS p25, quantile_cont(x1, 0.5) AS p50, quantile_cont(x1, 0.75) AS p75,
    quantile_cont(x1, 0.9) AS p90, max(x1) AS max FROM (SELECT x1, CASE WHEN raw_index % 5 = 0 THEN 'test' WHEN raw_index % 5 = 1 THEN 'eval'
    ELSE 'train' END AS split FROM proc_wide) GROUP BY split""", views=["proc_wide"],
       rounded={c: 4 for c in ("mean", "std", "p10", "p25", "p50", "p75", "p90")})
def _distribution(spark, sf):
    m = F.col("raw_index") % 5
    part = F.when(m == 0, "test").when(m == 1, "eval").otherwise("train")
    return splits.distribution_summary(proc_wide(spark, sf).select("x1", part.alias("split")), "x1")


def _dynamic_sql(length: str, targets: list[str], test: float, evals: float) -> str:
    """The greedy choice as a recursion over the list of chosen slices."""
    parts = {"n": "count({v}) FILTER ({w})", "m": "avg({v}) FILTER ({w})", "d": "stddev_pop({v}) FILTER ({w})", "a": "min({v}) FILTER ({w})", "b": "max({v}) FILTER ({w})",
             "q": "quantile_cont({v}, [0.1, 0.25, 0.5, 0.75, 0.9]) FILTER ({w})"}
    cols = ", ".join(f"{f.format(v=t, w=w)} AS {t}_{k}{i}" for t in targets for i, w in enumerate(("mine", "NOT mine")) for k, f in parts.items())
    gaps = " + ".join([f"({t}_{k}0 - {t}_{k}1) ** 2" for t in targets for k in "mdab"] + [f"list_sum(list_transform(list_zip({t}_q0, {t}_q1), lambda p: (p[1] - p[2]) ** 2))" for t in targets])
    span = " + ".join(f"greatest(0, 1 - ({t}_b0 - {t}_a0) / greatest(greatest({t}_b0, {t}_b1) - least({t}_a0, {t}_a1), 1e-12))" for t in targets)
    return f"""SELECT pos, slice, CASE WHEN NOT held THEN 'train' WHEN sum(held::INT) OVER (ORDER BY pos) <= evals THEN 'eval' ELSE 'test' END AS split FROM (
      WITH RECURSIVE size AS (SELECT count(*) AS total, greatest(1, round_even(count(*) * ({evals}::DOUBLE + {test}::DOUBLE), 0)) AS goal, round_even(count(*) * {evals}::DOUBLE, 0) AS evals, {length} AS len FROM timeline),
      sliced AS MATERIALIZED (SELECT pos, {', '.join(targets)}, least(pos // len, CASE WHEN total - (ceil(total / len) - 1) * len < greatest(1, len // 2) AND ceil(total / len) > 1 THEN ceil(total / len) - 2 ELSE ceil(total / len) - 1 END)::BIGINT AS slice FROM timeline, size),
      sizes AS MATERIALIZED (SELECT slice, count(*) AS n, md5('42|' || slice) AS h FROM sliced GROUP BY slice),
      pick(chosen, taken) AS (SELECT []::BIGINT[], 0::BIGINT UNION ALL SELECT list_append(chosen, best.slice), taken + best.n FROM (
        SELECT chosen, taken, arg_min({{'slice': slice, 'n': n}}, {{'cost': sqrt({gaps}) + abs(taken + n - goal) / goal + ({span}) / {len(targets)}, 'h': h}}) AS best FROM (
          SELECT p.chosen, p.taken, c.slice, c.n, c.h, {cols} FROM pick p JOIN sizes c ON NOT list_contains(p.chosen, c.slice) AND p.taken < (SELECT goal FROM size) AND len(p.chosen) + 1 < (SELECT count(*) FROM sizes),
            sliced r, LATERAL (SELECT r.slice = c.slice OR list_contains(p.chosen, r.slice) AS mine) GROUP BY ALL), size GROUP BY chosen, taken)),
      held AS (SELECT chosen FROM pick ORDER BY len(chosen) DESC LIMIT 1)
      SELECT pos, slice, list_contains(chosen, slice) AS held, evals FROM sliced, held, size)"""


@query("split_dynamic", _dynamic_sql("greatest(1, count(*) // 20)", ["x0"], 0.2, 0.1), views=["timeline"])
def _dynamic(spark, sf):
    df = timeline(spark, sf).select("pos", "x0")
    n = df.count()
    return splits.split_dynamic(df, "pos", "x0", length=max(1, n // 20), test_ratio=0.2, eval_ratio=0.1).select("pos", "slice", "split")


@query("split_dynamic_targets", _dynamic_sql("4000", ["x0", "x1"], 0.25, 0.1), views=["timeline"])
def _dynamic_targets(spark, sf):
    df = timeline(spark, sf).select("pos", "x0", "x1")
    return splits.split_dynamic(df, "pos", ["x0", "x1"], length=4000, test_ratio=0.25, eval_ratio=0.1).select("pos", "slice", "split")


# --- five stages ------------------------------------------------------------------

SPAN, GAP, EPISODE = 6, 10, 24
OPTIONS = {"minimum_gap": GAP, "span": SPAN, "episode_length": EPISODE, "stride": 2}
RATIOS = splits.STAGE_RATIOS


def _stage_sql():
    shares = ", ".join(f"free * {r}::DOUBLE AS e{i}" for i, r in enumerate(RATIOS))
    # Largest remainders first; equal remainders keep the stage order.
    floors = " + ".join(f"floor(e{i})" for i in range(5))
    extra = []
    for i in range(5):
        ahead = " + ".join(
            f"(CASE WHEN e{j} - floor(e{j}) {'>=' if j < i else '>'} e{i} - floor(e{i}) THEN 1 ELSE 0 END)"
            for j in range(5) if j != i)
        extra.append(f"(floor(e{i}) + CASE WHEN {ahead} < free - ({floors}) THEN 1 ELSE 0 END)::BIGINT AS c{i}")
    bounds = []
    for i, name in enumerate(splits.STAGES):
        start = " + ".join([f"c{j} + {GAP}" for j in range(i)]) or "0"
        bounds.append(f"SELECT '{name}' AS stage, {start} AS a, {start} + c{i} AS b FROM sizes")
    return f"""WITH base AS (SELECT count(*) - 4 * {GAP} AS free FROM timeline), shares AS (SELECT free, {shares} FROM base),
        sizes AS (SELECT {', '.join(extra)} FROM shares) {' UNION ALL '.join(bounds)}"""


STAGES = _stage_sql()
STAGED = f"SELECT t.*, s.stage, s.a, s.b FROM timeline t JOIN ({STAGES}) s ON t.pos >= s.a AND t.pos < s.b"
EPISODES = f"""SELECT stage, (pos - a) // {EPISODE} AS stage_episode, min(pos) AS start, max(pos) + 1 AS stop, min(raw) AS raw_start,
    max(raw) + 1 AS raw_stop, count(*) AS "rows", count(*) = {EPISODE} AND max(raw) - min(raw) = {EPISODE - 1} AS complete
    FROM ({STAGED}) GROUP BY 1, 2"""
WINDOWS = f"""SELECT stage, start, raw_start, CASE WHEN stage LIKE '%calibration' THEN stage_episode END AS stage_episode FROM (
    SELECT w.stage, w.pos AS start, w.raw AS raw_start, (w.pos - w.a) // {EPISODE} AS stage_episode, e.complete,
    (w.pos + {SPAN - 1} - w.a) // {EPISODE} AS end_episode
    FROM (SELECT *, lead(raw, {SPAN - 1}) OVER (PARTITION BY stage ORDER BY pos) AS last_raw FROM ({STAGED})) w
    JOIN ({EPISODES}) e ON e.stage = w.stage AND e.stage_episode = (w.pos - w.a) // {EPISODE}
    WHERE last_raw - raw = {SPAN - 1} AND (w.pos - w.a) % 2 = 0)
    WHERE stage NOT LIKE '%calibration' OR (complete AND end_episode = stage_episode)"""


def _staged(spark, sf):
    df = timeline(spark, sf)
    return splits.split_five_stage(df, "pos", **OPTIONS)


@query("split_five_stage", f"SELECT pos, raw, stage FROM ({STAGED})", views=["timeline"])
def _five(spark, sf):
    return _staged(spark, sf)[0].where("stage IS NOT NULL").select("pos", "raw", "stage")


@query("stage_plan", f"SELECT 'stage' AS kind, stage AS name, a::BIGINT AS start, b::BIGINT AS stop FROM ({STAGES})", views=["timeline"])
def _plan(spark, sf):
    return _staged(spark, sf)[1].to_frame(spark).where("kind = 'stage'")


@query("stage_episodes", EPISODES, views=["timeline"])
def _episodes(spark, sf):
    staged, plan = _staged(spark, sf)
    return splits.stage_episodes(staged, "pos", "raw", plan)


@query("stage_resolution", f"""SELECT stage, count(*) FILTER (complete) AS complete_episodes, 9::BIGINT AS required, count(*) FILTER (complete) >= 9 AS enough
    FROM ({EPISODES}) WHERE stage LIKE '%calibration' GROUP BY stage""", views=["timeline"])
def _resolution(spark, sf):
    staged, plan = _staged(spark, sf)
    return splits.check_resolution(splits.stage_episodes(staged, "pos", "raw", plan), 0.1)


@query("stage_windows", WINDOWS, views=["timeline"])
def _windows(spark, sf):
    staged, plan = _staged(spark, sf)
    return splits.stage_windows(staged, "pos", "raw", plan)


def _twice(items, item):
    return f"SELECT count(*) AS shared FROM (SELECT {item} FROM ({items}) GROUP BY {item} HAVING count(DISTINCT stage) > 1)"


# Planted overlaps: some rows belong to a second stage, windows reach over the
# gap behind their stage, and episodes last longer than they should.
LONG, LATE = SPAN + 3 * GAP, 2 * GAP
PLANTED = f"SELECT pos, raw, stage FROM ({STAGED}) UNION ALL SELECT pos, raw, 'second' FROM ({STAGED}) WHERE pos % 97 = 0"


@query("check_disjoint", f"""SELECT 'positions' AS kind, shared FROM ({_twice(PLANTED, 'pos')}) UNION ALL SELECT 'raw_rows', shared FROM ({_twice(PLANTED, 'raw')})
    UNION ALL SELECT 'window_rows', shared FROM ({_twice(f"SELECT DISTINCT stage, unnest(generate_series(raw_start, raw_start + {LONG - 1})) AS r FROM ({WINDOWS})", 'r')})
    UNION ALL SELECT 'episode_rows', shared FROM ({_twice(f"SELECT DISTINCT stage, unnest(generate_series(start, stop + {LATE - 1})) AS r FROM ({EPISODES}) WHERE complete", 'r')})""",
       views=["timeline"])
def _disjoint(spark, sf):
    staged, plan = _staged(spark, sf)
    episodes = splits.stage_episodes(staged, "pos", "raw", plan)
    found = splits.stage_windows(staged, "pos", "raw", plan, episodes)
    rows = staged.where("stage is not null").select("pos", "raw", "stage")
    planted = rows.unionByName(rows.where("pos % 97 = 0").withColumn("stage", F.lit("second")))
    longer = episodes.withColumn("stop", F.col("stop") + LATE)
    return splits.check_disjoint(planted, "pos", "raw", found, longer, LONG)


@query("check_disjoint_clean", "SELECT unnest(['positions', 'raw_rows', 'window_rows', 'episode_rows']) AS kind, 0::BIGINT AS shared")
def _disjoint_clean(spark, sf):
    staged, plan = _staged(spark, sf)
    episodes = splits.stage_episodes(staged, "pos", "raw", plan)
    found = splits.stage_windows(staged, "pos", "raw", plan, episodes)
    return splits.check_disjoint(staged, "pos", "raw", found, episodes, SPAN)


@query("table_fingerprint", f"""SELECT stage, count(*) AS "rows", sha256(sum(('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT)::VARCHAR || '|' || sum(('0x' || substr(h, 17, 16))::UBIGINT::HUGEINT)::VARCHAR)
    AS fingerprint FROM (SELECT stage, md5(length(pos::VARCHAR) || ':' || pos || length(x0::VARCHAR) || ':' || x0 || length(x1::VARCHAR) || ':' || x1) AS h FROM ({STAGED})) GROUP BY stage""", views=["timeline"])
def _fingerprint(spark, sf):
    staged, _ = _staged(spark, sf)
    return splits.table_fingerprint(staged.where("stage IS NOT NULL"), ["stage"], ["pos"], ["x0", "x1"])


PURPOSES = list(splits.FIT_POLICY)


def _access_log(spark, sf):
    names = F.array(*[F.lit(p) for p in [*PURPOSES, "undeclared"]])
    stages = F.array(*[F.lit(s) for s in splits.STAGES])
    return proc_events(spark, sf).select(
        F.col("episode").alias("ledger"), F.col("raw_index").alias("seq"),
        F.get(names, (F.col("raw_index") * 3 % 11).cast("int")).alias("purpose"),
        F.get(stages, (F.col("raw_index") % 5).cast("int")).alias("stage"),
        F.concat(F.lit("o"), F.col("raw_index") % 17).alias("object_id"),
    )


def _values(pairs):
    return ", ".join(f"('{a}', {b!r})" for a, b in pairs.items())


AUDIT = f"""WITH log AS (SELECT episode AS ledger, raw_index AS seq,
        list_extract([{', '.join(repr(p) for p in [*PURPOSES, 'undeclared'])}], raw_index * 3 % 11 + 1) AS purpose,
        list_extract([{', '.join(repr(s) for s in splits.STAGES)}], raw_index % 5 + 1) AS stage, 'o' || raw_index % 17 AS object_id FROM proc_events),
    policy(purpose, allowed) AS (VALUES {_values(splits.FIT_POLICY)}), phases(purpose, phase) AS (VALUES {_values(splits.PHASE)}),
    tagged AS (SELECT l.*, p.allowed, f.phase FROM log l LEFT JOIN policy p ON p.purpose = l.purpose LEFT JOIN phases f ON f.purpose = l.purpose),
    seen AS (SELECT *, max(phase) OVER w AS top, max(CASE WHEN phase = 1 THEN 1 ELSE 0 END) OVER w AS d, max(CASE WHEN phase = 2 THEN 1 ELSE 0 END) OVER w AS t,
        min(seq) OVER (PARTITION BY ledger, object_id) AS f FROM tagged WINDOW w AS (PARTITION BY ledger ORDER BY seq))
    SELECT ledger, seq, purpose, stage, object_id, violation FROM (
        SELECT *, 'unknown_purpose' AS violation FROM seen WHERE allowed IS NULL UNION ALL SELECT *, 'stage_not_allowed' FROM seen WHERE allowed <> stage
        UNION ALL SELECT *, 'phase_reopened' FROM seen WHERE phase < top UNION ALL SELECT *, 'detection_missing' FROM seen WHERE phase = 2 AND d = 0
        UNION ALL SELECT *, 'attribution_missing' FROM seen WHERE phase = 3 AND t = 0 UNION ALL SELECT *, 'refitted_object' FROM seen WHERE seq > f)"""


@query("fit_access_audit", f"SELECT * FROM ({AUDIT})", views=["proc_events"])
def _audit(spark, sf):
    return splits.fit_access_audit(_access_log(spark, sf), ["ledger"], "seq", "purpose", "stage", "object_id")


@query("split_overlaps", """SELECT doc_id, min(source) AS first_owner, max(source) AS last_owner FROM
    (SELECT doc_id, 'documents' AS source FROM documents UNION ALL SELECT doc_id, 'labels' FROM labels) GROUP BY doc_id HAVING count(DISTINCT source) > 1""")
def _overlaps(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.lit("documents").alias("source"))
    labels = table(spark, sf, "labels").select("doc_id", F.lit("labels").alias("source"))
    return splits.overlaps(docs.unionByName(labels), "doc_id", "source")


@query("rank_within_order", """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey
    ORDER BY l_orderkey DESC, l_linenumber, l_partkey, l_extendedprice) - 1 AS place FROM lineitem""")
def _rank(spark, sf):
    df = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return rank_within(df, ["l_suppkey"], [F.col("l_orderkey").desc(), "l_linenumber", "l_partkey", "l_extendedprice"], "place").drop("l_extendedprice")
