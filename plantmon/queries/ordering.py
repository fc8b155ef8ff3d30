"""Sorting, limits and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantmon.functions import numeric, text, vectors
from plantmon.plans import rank_within
from plantmon.queries import views as v
from plantmon.queries.registry import query

KEYS = ["episode", "raw_index"]


@query("sort_mixed", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def _sort(spark, sf):
    df = v.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return df.orderBy("o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey")


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _top(spark, sf):
    df = v.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return df.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("top_k_per_group", """SELECT episode, raw_index, x1 FROM (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY x1 DESC, raw_index) AS k FROM proc_wide) WHERE k <= 3""",
       views=["proc_wide"])
def _top_group(spark, sf):
    df = v.proc_wide(spark, sf).select(*KEYS, "x1")
    return rank_within(df, ["episode"], [F.col("x1").desc(), "raw_index"], "k").where("k < 3").drop("k")


@query("best_row", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")
def _best(spark, sf):
    return v.table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(1)


@query("scalar_math", """SELECT episode, raw_index, abs(x0 - 25) AS a, sqrt(x1) AS r, greatest(least(x0, 40), 10) AS clipped, round_even(x0 / 2, 0)::BIGINT AS half_even,
    x2 / greatest(x3, 0.01) AS share FROM proc_wide""", views=["proc_wide"], rounded=["r", "share"])
def _math(spark, sf):
    return v.proc_wide(spark, sf).select(
        *KEYS, F.abs(F.col("x0") - 25).alias("a"), F.sqrt("x1").alias("r"), F.greatest(F.least("x0", F.lit(40.0)), F.lit(10.0)).alias("clipped"),
        numeric.half_even(F.col("x0") / 2).alias("half_even"), numeric.ratio(F.col("x2"), F.col("x3"), 0.01).alias("share"))


@query("scalar_vector", """SELECT vec_id, list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS l1, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l2,
    list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS linf FROM embeddings""", rounded=["l1", "l2", "linf"])
def _vector(spark, sf):
    e = F.col("embedding").cast("array<double>")
    return v.table(spark, sf, "embeddings").select("vec_id", vectors.l1(e).alias("l1"), vectors.l2(e).alias("l2"), vectors.linf(e).alias("linf"))


@query("scalar_array", """SELECT vec_id, len(embedding[2:9]) AS n, list_sort(embedding[2:9])[1]::DOUBLE AS low, (list_sort(embedding[2:9])[4]::DOUBLE + list_sort(embedding[2:9])[5]::DOUBLE) / 2 AS mid,
    len(list_distinct(list_transform(embedding, lambda x: floor(x::DOUBLE * 2)))) AS kinds FROM embeddings""", rounded=["low", "mid"])
def _array(spark, sf):
    e = F.col("embedding").cast("array<double>")
    part = F.slice(e, 2, 8)
    return v.table(spark, sf, "embeddings").select(
        "vec_id", F.size(part).cast("long").alias("n"), F.get(F.array_sort(part), F.lit(0)).alias("low"), vectors.median(part).alias("mid"),
        F.size(F.array_distinct(F.transform(e, lambda x: F.floor(x * 2)))).cast("long").alias("kinds"))


@query("scalar_string", """SELECT p_partkey, replace(lower(trim(p_type)), '-', '_') AS kind, string_split(p_brand, '#')[2] AS brand,
    CASE WHEN regexp_replace(p_brand, '[^0-9]', '', 'g') = '' THEN 0 ELSE right(regexp_replace(p_brand, '[^0-9]', '', 'g'), 2)::BIGINT END AS digits FROM part""")
def _string(spark, sf):
    return v.table(spark, sf, "part").select(
        "p_partkey", text.normal_name("p_type").alias("kind"), F.get(F.split("p_brand", "#"), F.lit(1)).alias("brand"), text.fault_id_from_name("p_brand").alias("digits"))


@query("scalar_json", """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'infinity' ELSE 'finite' END AS limit_text, '["' || event_type || '","' || user_id || '"]' AS ids,
    json_extract_string(props, '$.k') AS k FROM events""")
def _json(spark, sf):
    limit = F.when(F.col("event_id") % 9 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    shown = numeric.infinity_text(limit)
    return v.table(spark, sf, "events").select(
        "event_id", F.when(shown == "infinity", shown).otherwise(F.lit("finite")).alias("limit_text"),
        F.to_json(F.array("event_type", F.col("user_id").cast("string"))).alias("ids"), F.get_json_object("props", "$.k").alias("k"))


@query("trial_id", """SELECT o_orderkey, substr(sha256('{"priority": "' || o_orderpriority || '", "seed": ' || o_custkey || '}'), 1, 8) AS trial_id FROM orders""")
def _trial(spark, sf):
    body = text.canonical_json({"seed": F.col("o_custkey"), "priority": F.concat(F.lit('"'), "o_orderpriority", F.lit('"'))})
    return v.table(spark, sf, "orders").select("o_orderkey", text.short_id(body).alias("trial_id"))


@query("prepare_wide", "SELECT episode, raw_index, x0, x1, x2, x3, label, fault FROM proc_wide", views=["proc_wide"])
def _prepare_wide(spark, sf):
    """What other queries read as a prepared table, built anew."""
    return v.build_wide(spark, sf)


@query("prepare_timeline", "SELECT pos, raw, episode, x0, x1, fault FROM timeline", views=["timeline"])
def _prepare_timeline(spark, sf):
    return v.build_timeline(v.proc_wide(spark, sf))
