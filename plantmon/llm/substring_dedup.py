"""Substring dedup: windows of words are counted in super-k-mer buckets.

A window's minimiser is the least hash of the short word grams in it. Windows
that are equal have the same minimiser, and neighbours mostly share theirs, so a
run of them travels as one packed string (a super-k-mer) to the minimiser's
bucket and the windows are taken apart and sorted only there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantmon.llm.common import WordHasher, gram_hashes, map_arrow, set_columns, shield, slices, with_columns
from plantmon.plans.staging import stage

GRAM = 8  # words in a minimiser gram
RUN = 256  # windows in one packed string at most
BATCH_BYTES = 1_000_000


def _windowed_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return np.empty(0, values.dtype)
    least, size = values, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(values) - width + 1], least[rest : rest + len(values) - width + 1])


def _runs(hashes: np.ndarray, sizes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimiser: (text, start in text, windows, minimiser)."""
    stops = np.cumsum(sizes)
    starts = stops - sizes
    least = _windowed_least(gram_hashes(hashes, gram), window - gram + 1)
    text = np.searchsorted(stops, np.arange(len(least)), side="right")
    inside = np.arange(len(least)) + window <= stops[text]
    at = np.flatnonzero(inside)
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none, none, none
    mins, owner = least[at], text[at]
    place = at - starts[owner]
    new = np.ones(len(at), bool)
    new[1:] = (mins[1:] != mins[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    # Long runs are cut every RUN windows.
    since = np.arange(len(at)) - np.repeat(head, np.diff([*head, len(at)]))
    head = np.flatnonzero(since % RUN == 0)
    length = np.diff([*head, len(at)])
    return owner[head], place[head], length, mins[head].view(np.int64)


def super_kmers(docs: DataFrame, window: int, gram: int, id_col: str, text_col: str, packed: bool) -> DataFrame:
    """One row per super-k-mer: minimiser, id, hash of the text, start, windows.

    With ``packed`` the rows come only for the starts listed in ``_starts`` and
    carry the words as one string.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"minimiser long, `{id_col}` {kind}, of long, start int, windows int"
    schema += ", packed binary, digest binary" if packed else ""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        words_of = WordHasher(lower=False)

        def part_of(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column(batch.schema.names.index(text_col))
            hashes, sizes = words_of(column)
            words = [text.encode().split() if text else [] for text in column.to_pylist()] if packed else []
            owner, start, length, minimiser = _runs(hashes, sizes, window, gram)
            if packed:
                wanted = batch.column(batch.schema.names.index("_starts")).to_pylist()
                keys = {(i, s) for i, some in enumerate(wanted) for s in some}
                keep = np.asarray(
                    [(i, s) in keys for i, s in zip(owner.tolist(), start.tolist(), strict=True)], bool
                )
                owner, start, length, minimiser = (x[keep] for x in (owner, start, length, minimiser))
            rows = pa.array(owner)
            arrays = [
                pa.array(minimiser), batch.column(batch.schema.names.index(id_col)).take(rows),
                batch.column(batch.schema.names.index("of")).take(rows),
                pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)),
            ]
            if packed:
                strings = [
                    b" ".join(words[i][s : s + n + window - 1])
                    for i, s, n in zip(owner.tolist(), start.tolist(), length.tolist(), strict=True)
                ]
                arrays += [pa.array(strings, pa.binary()), pa.array([_digest(x) for x in strings], pa.binary())]
            return arrays

        names = ["minimiser", id_col, "of", "start", "windows"] + ["packed", "digest"] * packed

        def kmers(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(batch.schema.names.index(text_col))
            sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)) + 1
            parts = [part_of(batch.slice(s.start, s.stop - s.start)) for s in slices(sizes, BATCH_BYTES)]
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([p[i] for p in parts]) for i in range(len(names))], names=names
            )

        return kmers

    return map_arrow(docs, schema, make)


def _digest(window: bytes) -> bytes:
    return xxhash.xxh3_128_digest(window)


def _unpacked(packed: bytes, window: int) -> list[bytes]:
    """The windows of a packed string."""
    words = packed.split(b" ")
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    return [packed[starts[i] : ends[i + window - 1] - 1] for i in range(len(words) - window + 1)]


def _as_runs(firsts: list[int]) -> list[dict]:
    """Runs of equal values as (off, len, first)."""
    runs: list[dict] = []
    for i, first in enumerate(firsts):
        if runs and runs[-1]["first"] == first:
            runs[-1]["len"] += 1
        else:
            runs.append({"off": i, "len": 1, "first": first})
    return runs


_RUNS = "array<struct<off: int, len: int, first: long>>"


def _count_buckets(distinct: DataFrame, window: int) -> DataFrame:
    """Smallest id per window, from rows (minimiser, packed, first) sorted by minimiser."""

    def solve(rows: list[tuple[bytes, bytes, int]]) -> list[list[int]]:
        if len(rows) == 1:  # all copies of this string are one row
            return [[rows[0][2]] * len(_unpacked(rows[0][0], window))]
        parts = [_unpacked(packed, window) for packed, _, _ in rows]
        listed = sorted(
            (w, first, r, i) for r, ((_, _, first), part) in enumerate(zip(rows, parts, strict=True))
            for i, w in enumerate(part)
        )
        firsts = [[0] * len(part) for part in parts]
        least, last = 0, None
        for w, first, r, i in listed:
            if w != last:  # sorted, so the first of equal windows has the smallest id
                last, least = w, first
            firsts[r][i] = least
        return firsts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held = None, []

        def closed(group: list) -> tuple[list, list, list]:
            firsts = solve([(p, d, f) for p, d, f in group])
            return [open_key] * len(group), [d for _, d, _ in group], [_as_runs(x) for x in firsts]

        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for key, packed, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != open_key:
                    if held:
                        for a, b in zip(out, closed(held), strict=True):
                            a.extend(b)
                    open_key, held = key, []
                held.append((packed, digest, first))
            if out[0]:
                yield _firsts_batch(*out)
        if held:
            yield _firsts_batch(*closed(held))

    return distinct.select("minimiser", "packed", "digest", "first").mapInArrow(
        run, f"minimiser long, digest binary, runs {_RUNS}"
    )


def _firsts_batch(keys: list, digests: list, runs: list) -> pa.RecordBatch:
    item = pa.struct([("off", pa.int32()), ("len", pa.int32()), ("first", pa.int64())])
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(digests, pa.binary()), pa.array(runs, pa.list_(item))],
        names=["minimiser", "digest", "runs"],
    )


def _count_windows(distinct: DataFrame, window: int) -> DataFrame:
    """The same for crowded buckets: every window is a row of its own.

    Windows combine before the shuffle, so no bucket meets in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(np.full(batch.num_rows, 1), 500):
                some = batch.slice(part.start, part.stop - part.start)
                keys, packed, digests, firsts = (c.to_pylist() for c in some.columns)
                rows = [
                    (k, d, i, w, f)
                    for k, p, d, f in zip(keys, packed, digests, firsts, strict=True)
                    for i, w in enumerate(_unpacked(p, window))
                ]
                k, d, i, w, f = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k, pa.int64()), pa.array(d, pa.binary()), pa.array(i, pa.int32()),
                     pa.array(w, pa.binary()), pa.array(f, pa.int64())],
                    names=["minimiser", "digest", "off", "window", "first"],
                )

    spread = distinct.select("minimiser", "packed", "digest", "first").mapInArrow(
        run, "minimiser long, digest binary, off int, window binary, first long"
    )
    least = spread.groupBy("window").agg(F.min("first").alias("first"))
    piece = F.struct("off", F.lit(1).alias("len"), "first")
    return (
        spread.drop("first").join(least, "window")
        .groupBy("minimiser", "digest").agg(F.collect_list(piece).cast(_RUNS).alias("runs"))
    )


def repeated_spans(
    docs: DataFrame,
    window: int = 50,
    gram: int = GRAM,
    crowded: int = 2_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Word spans covered by windows that also start in a document with a smaller id.

    Returns (id, hash of the text, spans), spans as arrays of (from, to) word
    positions that may overlap, for the documents that have any.

    A minimiser met in one document only cannot bring two documents together, so
    the minimisers are counted first (two numbers a row) and only super-k-mers
    with a shared one are packed and sent. Equal strings are one row with their
    smallest id, so a group of copies costs one row a string. Buckets with more
    than ``crowded`` distinct strings are counted window by window instead.
    """
    source = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        id_col, text_col, F.xxhash64(text_col).alias("of")
    )
    skeleton = super_kmers(source, window, gram, id_col, text_col, packed=False)
    # Written, so that Spark can split a hot minimiser in the join below.
    shared = stage(
        skeleton.groupBy("minimiser")
        .agg(F.min(id_col).alias("least"), F.max(id_col).alias("most"))
        .where("least < most").select("minimiser"),
        "shared",
    )
    wanted = (
        skeleton.join(shared, "minimiser", "left_semi")
        .groupBy(id_col, "of").agg(F.collect_set("start").alias("_starts"))
    )
    chosen = source.join(stage(wanted, "starts"), [id_col, "of"])
    packed = stage(super_kmers(chosen, window, gram, id_col, text_col, packed=True), "kmers")
    distinct = packed.groupBy("minimiser", "digest", "packed").agg(F.min(id_col).cast("long").alias("first"))
    distinct = stage(distinct, "distinct")
    hot = distinct.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowded).select("minimiser")
    hot = stage(hot, "crowded")
    bucketed = distinct.join(hot, "minimiser", "left_anti").repartition("minimiser").sortWithinPartitions("minimiser")
    firsts = _count_buckets(bucketed, window).unionByName(
        _count_windows(distinct.join(hot, "minimiser", "left_semi"), window)
    )
    marked = packed.select("minimiser", "digest", id_col, "of", "start").join(firsts, ["minimiser", "digest"])
    spans = F.transform(
        F.filter("runs", lambda r: r["first"] < F.col(id_col)),
        lambda r: F.struct(
            (F.col("start") + r["off"]).alias("a"),
            (F.col("start") + r["off"] + r["len"] + F.lit(window - 1)).alias("b"),
        ),
    )
    marked = marked.select(id_col, "of", spans.alias("spans")).where(F.size("spans") > 0)
    return marked.groupBy(id_col, "of").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts without the words in ``spans``, kept words joined by one space."""
    fields = [(text_col, T.StringType()), ("n_words", T.LongType()), ("n_removed", T.LongType())]
    schema = with_columns(fields, docs)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
            names = batch.schema.names
            texts = batch.column(names.index(text_col)).to_pylist()
            marks = batch.column(names.index("_spans")).to_pylist()
            kept, n_words, n_removed = [], [], []
            for text, some in zip(texts, marks, strict=True):
                words = text.encode().split() if text else []
                total = len(words)
                if some:
                    edge = np.zeros(total + 1, np.int64)
                    np.add.at(edge, [s["a"] for s in some], 1)
                    np.add.at(edge, [s["b"] for s in some], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                kept.append(b" ".join(words).decode())
                n_words.append(total)
                n_removed.append(total - len(words))
            values = {
                text_col: pa.array(kept, pa.string()),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
            }
            return set_columns(batch.drop_columns(["_spans"]), values)

        return cut

    spans = spans.select(F.col(id_col).alias("_id"), F.col("of").alias("_of"), F.col("spans").alias("_spans"))
    left = docs.withColumn("_hash", F.xxhash64(text_col))
    joined = left.join(spans, (left[id_col] == spans["_id"]) & (left["_hash"] == spans["_of"]), "left")
    return map_arrow(joined.drop("_id", "_of", "_hash"), schema, make)


def drop_repeated_substrings(
    docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", **more: int
) -> DataFrame:
    """Remove every word inside a window that also starts in a document with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; a window is ``window``
    consecutive words of one document. Windows are judged on the input. Returns
    the input columns with the kept words joined by one space in ``text_col``,
    plus ``n_words`` (before) and ``n_removed``. Null and empty texts have no
    words. Rows without id lose nothing and take nothing from others. Rows that
    repeat an id are no smaller than each other. An empty table gives an empty
    table.
    """
    docs, back = shield(docs, [id_col, text_col])
    spans = repeated_spans(docs, window, id_col=id_col, text_col=text_col, **more)
    return back(remove_spans(docs, spans, id_col, text_col), ["n_words", "n_removed"])


def query(docs: DataFrame) -> DataFrame:
    out = drop_repeated_substrings(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(w[s : s + 49], ' ') AS win
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS s FROM words)
), firsts AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(s, s + 49)) AS p
  FROM windows JOIN firsts USING (win) WHERE first < doc_id
), flat AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS p, unnest(w) AS word FROM words)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words d LEFT JOIN (
  SELECT f.doc_id, count(g.p) AS n_removed, string_agg(f.word, ' ' ORDER BY f.p) FILTER (WHERE g.p IS NULL) AS kept
  FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.p = g.p GROUP BY f.doc_id
) k USING (doc_id)
"""
