"""The registered corpus queries against their SQL, and the pipeline against plain code."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from check_queries import compare, connect  # noqa: E402
from plantmon.llm.queries import QUERIES, SQL  # noqa: E402


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    text, _, ok = compare(spark, connect(sf), sf, name, QUERIES[name], SQL[name])
    assert ok, text


def test_all_are_registered():
    known = entry.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(known)
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()


def test_pipeline_equals_plain_code(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    rows = [(i, t) for i, _, _, t in brute.line_dedup(rows, 40, 5)]
    groups = brute.near_duplicates(rows)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i, _, hit, _ in brute.decontaminate(rows, items, 10) if not hit}
    rows = {i: t for i, t in rows if i in clean}

    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows.items()}
    out = corpus_pipeline.run(spark, sf)
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == want
    held = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert held.where("n > 2048 or n <> m").count() == 0


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("more", F.lit(1))
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (9_000, "", "xx", None, 0, 1)], docs.schema)
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs.unionByName(odd), sf)
        assert out.columns == docs.columns[:5], name
        assert out.count() > 0
        assert function(spark, docs.where("false"), sf).count() == 0
