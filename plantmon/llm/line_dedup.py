"""Line dedup: lines found in many documents stay in one of them only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantmon.llm.common import SPACE, lower_ascii, shield
from plantmon.plans.staging import stage


def drop_repeated_lines(
    docs: DataFrame,
    min_chars: int = 40,
    min_docs: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Drop lines whose key occurs in ``min_docs`` documents or more.

    A line's key is the line without ASCII white space at its ends and with A-Z
    lower-cased; keys under ``min_chars`` code points never count. A repeated
    key keeps its lines in the document with the largest id that holds it, and
    there every one of them.

    Returns the input columns with the kept lines joined by a newline in
    ``text_col``, plus ``n_lines`` (before) and ``n_dropped``. Null and empty
    texts are one empty line. Rows without id count for no document and never
    are the largest one, so they lose every repeated line. Rows that repeat an
    id count once. An empty table gives an empty table.

    Only digests move in the counting; the documents move once, to their own
    dropped positions. Counts combine before the shuffle, a hot line is one row
    per task there, and the join back is one that Spark splits when skewed.
    """
    docs, back = shield(docs, [id_col, text_col])
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    source = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != text_col],
        lines.alias("_lines"),
        F.xxhash64(text_col).alias("_hash"),
    )
    exploded = source.select(F.col(id_col).alias("_id"), "_hash", F.posexplode("_lines").alias("_pos", "_line"))
    trimmed = exploded.where(F.char_length("_line") >= min_chars).select(
        "_id", "_hash", "_pos", F.btrim("_line", F.lit(SPACE)).alias("_line")
    )
    keyed = trimmed.where(F.char_length("_line") >= min_chars).select(
        "_id", "_hash", "_pos", F.unhex(F.md5(lower_ascii(F.col("_line")))).alias("_key")
    )
    # A written table, not the aggregate itself: Spark splits a hot key only
    # where both sides of the join are plain exchanges.
    repeated = stage(
        keyed.groupBy("_key")
        .agg(F.count_distinct("_id").alias("_docs"), F.max("_id").alias("_last"))
        .where(F.col("_docs") >= min_docs)
        .select("_key", "_last"),
        "repeated",
    )
    dropped = (
        keyed.join(repeated, "_key")
        .where(~F.col("_id").eqNullSafe(F.col("_last")))
        .groupBy("_id", F.col("_hash").alias("_of"))
        .agg(F.collect_set("_pos").alias("_drop"))
    )
    joined = source.join(
        dropped, source[id_col].eqNullSafe(dropped["_id"]) & (source["_hash"] == dropped["_of"]), "left"
    )
    # ``_lines`` is a column of the join's input, so the look-ups by position
    # below read an array that exists and split nothing again.
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    text = F.when(F.col("_drop").isNull(), F.array_join("_lines", "\n")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")
    )
    results = {
        text_col: text,
        "n_lines": F.size("_lines").cast("long"),
        "n_dropped": F.coalesce(F.size("_drop"), F.lit(0)).cast("long"),
    }
    kept_columns = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return back(joined.select(*kept_columns, *[v.alias(c) for c, v in results.items()]), ["n_lines", "n_dropped"])


def query(docs: DataFrame) -> DataFrame:
    out = drop_repeated_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, u.pos, u.line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) d,
       LATERAL (SELECT unnest(generate_series(1, len(a))) AS pos, unnest(a) AS line) u
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS dropped
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
