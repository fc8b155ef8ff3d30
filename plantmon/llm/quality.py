"""Quality rules whose thresholds come from quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantmon.llm.common import SPACE, WordHasher, gram_hashes, map_arrow, mixed, set_columns, shield, slices
from plantmon.plans.staging import stage

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
GRAM = 3
BATCH_BYTES = 4_000_000
BITS = 8  # leading bits of a value that its bucket keeps


@dataclass(frozen=True)
class Rule:
    """A value in thousandths, and how far from its group's median it may lie.

    The distance is ``width`` times that of the quartile on the same side and at
    least ``least``, so that a group where nearly all agree drops nobody for a
    trifle. ``below`` says whether low values fail as well.
    """

    name: str
    part: str
    whole: str
    least: int
    width: int = 8
    below: bool = False

    @property
    def value(self) -> Column:
        return F.expr(f"{self.part} * 1000 div greatest({self.whole}, 1)")


RULES = (
    Rule("symbols", "n_symbols", "n_words", 100),
    Rule("word_length", "word_chars", "n_words", 2_000, below=True),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 400),
    Rule("repeated_words", "n_repeat_words", "n_words", 400),
)


class Measure:
    """The counts of many texts at once, straight from Arrow's buffers."""

    def __init__(self) -> None:
        self.words = WordHasher(lower=False)
        space, symbol = (np.isin(np.arange(256), list(s.encode())) for s in (SPACE, SYMBOLS))
        inner = (np.arange(256) & 0xC0) == 0x80  # not the first byte of a code point
        self.solid = (~space & ~inner).astype(np.int32)
        self.symbol = symbol.astype(np.int32)

    def __call__(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """COUNTS of every text; null counts as empty."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        n = len(texts)

        def total(table: np.ndarray) -> np.ndarray:
            sums = np.append(0, np.cumsum(table[data], dtype=np.int64))
            return np.diff(sums[offsets])

        out = {"word_chars": total(self.solid), "n_symbols": total(self.symbol)}
        # Words, and the windows of GRAM words that lie within one text.
        hashes, counts = self.words(texts)
        of = np.repeat(np.arange(n), counts)
        grams = gram_hashes(hashes, GRAM)
        inside = np.flatnonzero(of[: len(grams)] == of[GRAM - 1 :])
        found = np.zeros(len(hashes), bool)
        again = inside[_repeated_windows(grams[inside], of[inside])]
        for k in range(GRAM):
            found[again + k] = True
        out["n_words"] = counts
        out["n_repeat_words"] = np.bincount(of[found], minlength=n)
        # Lines: as texts of their own they are compared by their bytes.
        lines = pc.split_pattern(texts, "\n")
        owner = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
        flat = lines.flatten()
        worded = np.flatnonzero(pc.match_substring_regex(flat, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False))
        out["n_lines"] = np.bincount(owner[worded], minlength=n)
        codes = flat.take(pa.array(worded)).dictionary_encode().indices.to_numpy().astype(np.int64)
        pairs = owner[worded] * (codes.max(initial=0) + 1) + codes
        first = np.unique(pairs, return_index=True)[1]
        out["n_dup_lines"] = out["n_lines"] - np.bincount(owner[worded][first], minlength=n)
        return {c: out[c].astype(np.int64) for c in COUNTS}


def _repeated_windows(grams: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places of windows that occur again in their text."""
    # The text is mixed into the key, so one sort of plain numbers is enough.
    keys = mixed(grams ^ mixed(of.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.append(False, ranked[1:] == ranked[:-1])
    return order[same | np.append(same[1:], False)] if len(keys) else order


def measure(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the counts of every whole text, see :class:`Measure`.

    Null counts as empty. A batch is taken in runs of about BATCH_BYTES.
    """
    kept = [f for f in docs.schema.fields if f.name not in COUNTS and (keep_text or f.name != text_col)]
    schema = T.StructType(kept + [T.StructField(c, T.LongType()) for c in COUNTS])
    place = docs.columns.index(text_col)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        count = Measure()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(place)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            parts = [count(texts.slice(s.start, s.stop - s.start)) for s in slices(sizes, BATCH_BYTES)]
            found = {c: pa.array(np.concatenate([p[c] for p in parts])) for c in COUNTS}
            return set_columns(batch, found).select([f.name for f in schema.fields])

        return run

    return map_arrow(docs, schema, make)


def bucket(value: Column) -> Column:
    """The least value of the bucket that a value >= 0 falls into: its BITS leading bits, then zeros."""
    drop = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketch(measured: DataFrame, groups: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """(``groups``, rule, bucket, n): how many values of a group fall into each bucket.

    A bucket spans less than a 128th of its values, whatever their size, and there
    are at most some 7,000 of them for a rule, so a sketch is bounded. Counts are
    summed before the shuffle and do not depend on the order of the rows; a hot
    group is one row for each task and bucket.
    """
    values = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), r.value.alias("value")) for r in rules])).alias("x")
    rows = measured.select(*groups, values).select(*groups, "x.rule", bucket(F.col("x.value")).alias("bucket"))
    return rows.groupBy(*groups, "rule", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One sketch for each of ``groups``, which may be fewer columns than before or none; union to add tables."""
    return sketches.groupBy(*groups, "rule", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, groups: Sequence[str], shares: dict[str, tuple[int, int]]) -> DataFrame:
    """(``groups``, rule, total, a column for each share): the bucket that holds the value of that rank.

    A share is a fraction (numerator, denominator) of the total, its rank rounded up.
    """
    by = Window.partitionBy(*groups, "rule")
    so_far = F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = sketches.select("*", so_far.alias("upto"), F.sum("n").over(by).alias("total"))
    found = [F.min(F.when(F.col("upto") * b >= F.col("total") * a, F.col("bucket"))).alias(c) for c, (a, b) in shares.items()]
    return counted.groupBy(*groups, "rule").agg(F.max("total").alias("total"), *found)


def thresholds(sketches: DataFrame, groups: Sequence[str], rules: Sequence[Rule] = RULES, min_docs: int = 50) -> DataFrame:
    """(``groups``, least_<rule>, most_<rule>, ..): what each group allows.

    A group of fewer than ``min_docs`` documents takes the quartiles of the merged
    sketch of its first column, or of all groups if that is small too.
    """
    quartiles = {"q1": (1, 4), "q2": (1, 2), "q3": (3, 4)}
    own = quantiles(sketches, groups, quartiles)
    for i, wider in enumerate([list(groups[:1]), []] if len(groups) > 1 else [[]]):
        more = quantiles(merge(sketches, wider), wider, quartiles)
        more = more.toDF(*[f"{c}~{i}" for c in more.columns])
        met = reduce(lambda a, b: a & b, [own[c].eqNullSafe(more[f"{c}~{i}"]) for c in [*wider, "rule"]])
        small = F.col("total") < min_docs
        own = own.join(more, met).select(
            *groups, "rule", *[F.when(small, F.col(f"{c}~{i}")).otherwise(F.col(c)).alias(c) for c in ("total", *quartiles)]
        )
    columns = []
    for r in rules:
        this = F.col("rule") == r.name
        far = [F.col("q2") - F.col("q1"), F.col("q3") - F.col("q2")]
        reach = [F.greatest(d * r.width, F.lit(r.least)) for d in far]
        if r.below:
            columns.append(F.max(F.when(this, F.col("q2") - reach[0])).alias(f"least_{r.name}"))
        columns.append(F.max(F.when(this, F.col("q2") + reach[1])).alias(f"most_{r.name}"))
    return own.groupBy(*groups).agg(*columns)


def quality_rules(
    docs: DataFrame, rules: Sequence[Rule] = RULES, min_words: int = 50, most_repeated: int = 50, min_docs: int = 50,
    text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep_text: bool = True,
) -> DataFrame:
    """Judge every document by what is usual for its language and source.

    Returns the input columns (without the text if not ``keep_text``) and COUNTS,
    ``base_failed`` (fewer than ``min_words`` words, or more than
    ``most_repeated`` hundredths of them in windows of GRAM words that recur in the
    text), ``failed_rules`` and ``kept``: false if the base failed or a rule did.
    A result replaces an extra column of its name. Filter on ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+``; null text has none and fails the base. A
    null language or source is a group like any other. Rows that repeat count as
    often as they occur. An empty table gives an empty table. Texts of any length
    count whole.

    The texts are read once: measured rows are written, every document that
    passes the base adds to the sketches of its language and source, their
    quartiles give thresholds, and these are joined to the documents. Thresholds
    are one row a group; where they are many, Spark splits a hot group in the
    join, as both of its sides are written tables.
    """
    docs, back = shield(docs, [text_col, lang_col, source_col])
    groups = [lang_col, source_col]
    low = F.expr(f"n_words < {int(min_words)} OR 100 * n_repeat_words > {int(most_repeated)} * n_words")
    measured = stage(measure(docs, text_col, keep_text).withColumn("base_failed", low), "measured")
    sketches = stage(sketch(measured.where("not base_failed"), groups, rules), "sketches")
    allowed = stage(thresholds(sketches, groups, rules, min_docs), "thresholds")
    allowed = allowed.withColumnsRenamed({c: f"{c}~" for c in groups})
    met = [measured[c].eqNullSafe(allowed[f"{c}~"]) for c in groups]
    judged = measured.join(allowed, met[0] & met[1], "left")
    broken = []
    for r in rules:
        fails = r.value > F.col(f"most_{r.name}")
        if r.below:
            fails = fails | (r.value < F.col(f"least_{r.name}"))
        broken.append(F.when(fails & ~F.col("base_failed"), F.lit(r.name)))
    judged = judged.withColumn("failed_rules", F.array_compact(F.array(*broken)))
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return back(judged, [*COUNTS, "base_failed", "failed_rules", "kept"])


def query(docs: DataFrame) -> DataFrame:
    out = quality_rules(docs.select("doc_id", "text", "lang", "source"), keep_text=False)
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select("doc_id", *base, "n_lines", F.array_join("failed_rules", ",").alias("failed_rules"))


_SQL_RULES = "\nUNION ALL ".join(
    f"SELECT row, '{r.name}' AS rule, {r.part} * 1000 // greatest({r.whole}, 1) AS v, {r.least} AS least, {r.width} AS width, "
    f"{str(r.below).lower()} AS below FROM base" for r in RULES
)
SQL = rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), words AS MATERIALIZED (
  SELECT row, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM docs
), windows AS (
  SELECT row, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k:k + 2])) AS g FROM words
), again AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT row, count(DISTINCT p) AS n_repeat_words FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY row
), lines AS (
  SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row
), counted AS (
  SELECT d.row, d.doc_id, d.lang, d.source, len(w.w) AS n_words,
         coalesce(CAST(list_sum(list_transform(w.w, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs d JOIN words w USING (row) LEFT JOIN covered USING (row) LEFT JOIN lines USING (row)
), base AS MATERIALIZED (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
), valued AS MATERIALIZED (
  SELECT x.*, b.lang, b.source, (v >> greatest(length(bin(v)) - {BITS}, 0)) << greatest(length(bin(v)) - {BITS}, 0) AS bucket
  FROM ({_SQL_RULES}) x JOIN base b USING (row) WHERE NOT base_failed
), own AS (
  SELECT lang, source, rule, count(*) AS n, quantile_disc(bucket, [0.25, 0.5, 0.75]) AS q FROM valued GROUP BY lang, source, rule
), wide AS (
  SELECT lang, rule, count(*) AS n, quantile_disc(bucket, [0.25, 0.5, 0.75]) AS q FROM valued GROUP BY lang, rule
), whole AS (
  SELECT rule, quantile_disc(bucket, [0.25, 0.5, 0.75]) AS q FROM valued GROUP BY rule
), allowed AS (
  SELECT o.lang, o.source, o.rule, CASE WHEN o.n >= 50 THEN o.q WHEN w.n >= 50 THEN w.q ELSE a.q END AS q
  FROM own o JOIN wide w ON o.rule = w.rule AND o.lang IS NOT DISTINCT FROM w.lang JOIN whole a ON o.rule = a.rule
), failed AS (
  SELECT v.row, list(v.rule) AS rules
  FROM valued v JOIN allowed a ON v.rule = a.rule AND v.lang IS NOT DISTINCT FROM a.lang AND v.source IS NOT DISTINCT FROM a.source
  WHERE v.v > q[2] + greatest(width * (q[3] - q[2]), least) OR below AND v.v < q[2] - greatest(width * (q[2] - q[1]), least)
  GROUP BY v.row
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rules IS NULL AS kept, n_lines,
       array_to_string(list_filter({[r.name for r in RULES]}, lambda x: list_contains(coalesce(rules, []), x)), ',') AS failed_rules
FROM base LEFT JOIN failed USING (row)
"""
