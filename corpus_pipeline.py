"""From raw documents to packed sequences, stage by stage.

Each stage takes all rows its predecessor kept; all but the last return the
columns of ``documents`` with ``n_chars`` counted anew where the text changed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantmon.llm import decontaminate, jaccard, language_id, line_dedup, packing
from plantmon.llm.common import read_table
from plantmon.plans.staging import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set ``lang`` by the network; documents without any language go.

    Those are null texts and texts without a letter. Everything else is kept,
    however unsure the network is.
    """
    network = language_id.fit_language_id(docs.where(language_id.fold("doc_id", 3) != 1))
    found = language_id.predict_language(docs.select(COLUMNS), network, "text", "_lang", "_score")
    if network is None:  # nothing to learn from: no decision either
        return docs.select(COLUMNS)
    kept = found.where(F.col("_lang") != language_id.UNKNOWN)
    return kept.withColumn("lang", F.col("_lang")).select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents stay in one of them only."""
    out = line_dedup.drop_repeated_lines(docs.select(COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays: the smallest id, then the smallest hash of the text.

    Documents without an id, and those without words, are in no group.
    """
    groups = stage(jaccard.near_duplicate_groups(docs), "groups").where("n_shingles > 0")
    fate = stage(
        groups.groupBy(F.col("doc_id").alias("_id")).agg(
            F.max(F.col("component_id") != F.col("doc_id")).alias("_copy"), F.count(F.lit(1)).alias("_rows")
        ).where("_copy or _rows > 1"), "fate",
    )
    docs = docs.select(COLUMNS)
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = docs.join(fate, (docs["doc_id"] == fate["_id"]) & words, "left_anti")
    repeated = fate.where("not _copy")
    if repeated.isEmpty():
        return kept
    rows = docs.where(words).join(repeated, docs["doc_id"] == repeated["_id"])
    one = rows.groupBy("_id").agg(F.min_by(F.struct(*COLUMNS), F.struct(F.xxhash64("text"), "text")).alias("_row"))
    return kept.unionByName(one.select("_row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    found = decontaminate.search_benchmark(docs.select(COLUMNS), read_table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hit_words") == 0).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
# Language identification is trained and packing needs a tokenizer; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next one."""
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
