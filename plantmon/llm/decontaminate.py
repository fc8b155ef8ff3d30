"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantmon.llm.common import LOWER_BYTES, lower_ascii, map_arrow, set_columns, shield, slices, with_columns
from plantmon.plans.staging import stage

# Words are runs of digits, lower-case letters and whatever is not ASCII.
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TO_WORDS = bytes(LOWER_BYTES[b] if LOWER_BYTES[b] in _WORD_BYTES else 0x20 for b in range(256))

BLOCK = 2  # words in a shift block
LANE = 512  # window starts that one lane of the search covers
BATCH_WORDS = 1_000_000
PASSES = 4


def benchmark_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; none for null."""
    return text.encode().translate(_TO_WORDS).split() if text else []


class Patterns:
    """Wu-Manber tables for word sequences of one length.

    ``shift`` says, by hash of the last block of a window, how far the window may
    move without passing an occurrence; where it says 0, the bucket of that hash
    lists the sequences to compare word by word.
    """

    def __init__(self, windows: np.ndarray):
        self.windows = windows
        self.length = windows.shape[1]
        self.block = min(BLOCK, self.length)
        self.bits = max(12, int(len(windows) * self.length).bit_length() + 3)
        longest = self.length - self.block + 1
        self.shift = np.full(1 << self.bits, longest, np.int32)
        for end in range(self.block, self.length + 1):
            hashes = self.hash(*[windows[:, end - self.block + j] for j in range(self.block)])
            np.minimum.at(self.shift, hashes, self.length - end)
        tail = self.hash(*[windows[:, self.length - self.block + j] for j in range(self.block)])
        order = np.argsort(tail, kind="stable")
        self.rows, sorted_tail = order, tail[order]
        self.first = np.searchsorted(sorted_tail, np.arange(1 << self.bits))
        self.last = np.searchsorted(sorted_tail, np.arange(1 << self.bits), side="right")

    def hash(self, *words: np.ndarray) -> np.ndarray:
        total = np.zeros(len(words[0]), np.uint64)
        for word in words:
            total = (total + word.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return (total >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, row of ``windows``) of all occurrences inside the given texts.

        ``ids`` holds all texts, ``starts`` and ``stops`` their bounds. Long texts
        are cut into lanes that overlap by a window less a word; all lanes move at
        the same time, each by its own shift.
        """
        lane_from, lane_to = [], []
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            last = b - self.length
            if last >= a:
                heads = np.arange(a, last + 1, LANE)
                lane_from.append(heads)
                lane_to.append(np.minimum(heads + LANE - 1, last))
        if not lane_from:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, end = np.concatenate(lane_from), np.concatenate(lane_to)
        found_at, found = [], []
        while len(at):
            tail = at + self.length - self.block
            hashes = self.hash(*[ids[tail + j] for j in range(self.block)])
            step = self.shift[hashes]
            hit = np.flatnonzero(step == 0)
            if len(hit):
                low, high = self.first[hashes[hit]], self.last[hashes[hit]]
                times = high - low
                places = np.repeat(at[hit], times)
                entry = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                rows = self.rows[entry]
                same = np.ones(len(rows), bool)
                for j in range(self.length):
                    same &= ids[places + j] == self.windows[rows, j]
                found_at.append(places[same])
                found.append(rows[same])
                step = np.maximum(step, 1)
            at = at + step
            going = at <= end
            at, end = at[going], end[going]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found_at), np.concatenate(found)


class Block:
    """A bounded part of the benchmark's windows, ready to search."""

    def __init__(self, rows: list[tuple[list[str], list[int]]]):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[list[int], list[int]]]] = {}
        for words, items in rows:
            ids = [self.vocabulary.setdefault(w.encode(), len(self.vocabulary) + 1) for w in words]
            by_length.setdefault(len(ids), []).append((ids, items))
        self.patterns = [Patterns(np.asarray([ids for ids, _ in group], np.int64)) for group in by_length.values()]
        self.items = [[items for _, items in group] for group in by_length.values()]

    def hits(self, texts: list[str | None]) -> list[tuple[int, list[int], list]]:
        """Number of words, covered word positions and items of every text."""
        get = self.vocabulary.get
        words = [benchmark_words(text) for text in texts]
        sizes = np.asarray([len(w) for w in words], np.int64)
        stops = np.cumsum(sizes)
        starts = stops - sizes
        ids = np.fromiter((get(w, 0) for one in words for w in one), np.int64, int(stops[-1]))
        covered = np.zeros(len(ids) + 1, np.int64)
        items: list[set] = [set() for _ in texts]
        for pattern, owners in zip(self.patterns, self.items, strict=True):
            at, rows = pattern.search(ids, starts, stops)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + pattern.length, -1)
            texts_hit = np.searchsorted(stops, at, side="right")
            for text, row in set(zip(texts_hit.tolist(), rows.tolist(), strict=True)):
                items[text].update(owners[row])
        covered = np.cumsum(covered) > 0
        return [
            (b - a, np.flatnonzero(covered[a:b]).tolist() if items[i] else [], sorted(items[i]))
            for i, (a, b) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True))
        ]


def benchmark_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows of the benchmark with the items they start in."""
    # Java's pattern sees code points, so the class is the same as for bytes.
    words = F.filter(
        F.split(lower_ascii(F.col(text_col)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != ""
    )
    items = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), words.alias("words"))
    items = items.where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    spread = items.select("item", "words", F.explode(starts).alias("start"))
    return (
        spread.groupBy(F.slice("words", F.col("start"), window).alias("window"))
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def search_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    block_windows: int = 100_000,
    id_col: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """Find every benchmark window in the documents.

    A window is ``window`` consecutive words of an item, or the whole of a
    shorter one. Returns the input columns plus ``n_words``, ``hit_words``
    (positions from 0 of the words inside any occurrence) and ``hit_items`` (ids
    of the items with a window that occurs, sorted). Null and empty texts have
    no words. Items without id or words take no part; items that share an id
    count as one; repeated document rows get equal results.

    The documents are scanned where they are and never move. The benchmark goes
    to the tasks in blocks of at most about ``block_windows`` windows, cut by
    hash; each block is one more pass over the rows, up to PASSES in one stage.
    """
    windows = benchmark_windows(benchmark, window, id_col, text_col)
    count = windows.count()
    windows = stage(windows, "windows") if count > block_windows else windows
    parts = max(1, -(-count // block_windows))
    item_type = dict(benchmark.dtypes)[id_col]
    fields = [
        ("n_words", T.LongType()),
        ("hit_words", T.ArrayType(T.LongType())),
        ("hit_items", T.ArrayType(benchmark.schema[id_col].dataType)),
    ]
    out, back = shield(docs, [text_col])
    empty = F.array().cast(f"array<{item_type}>")
    out = out.withColumns({"n_words": F.lit(0).cast("long"), "hit_words": F.array().cast("array<long>"), "hit_items": empty})
    for part in range(parts):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part).collect()
        out = _search_block(out, Block([(r["window"], r["items"]) for r in rows]), fields, text_col)
        if part % PASSES == PASSES - 1 and part < parts - 1:
            out = stage(out, "searched")  # so that few blocks are in memory at a time
    return back(out, [name for name, _ in fields])


def _search_block(docs: DataFrame, block: Block, fields: list, text_col: str) -> DataFrame:
    schema = with_columns(fields, docs)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def search(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(batch.schema.names.index(text_col))
            sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0)) // 4 + 1
            found = []
            for part in slices(sizes, BATCH_WORDS):
                found += block.hits(column[part].to_pylist())
            names = batch.schema.names
            old_words = batch.column(names.index("hit_words")).to_pylist()
            old_items = batch.column(names.index("hit_items")).to_pylist()
            kinds = {name: batch.schema.field(name).type for name in ("hit_words", "hit_items")}
            values = {
                "n_words": pa.array([n for n, _, _ in found], pa.int64()),
                "hit_words": pa.array(
                    [sorted({*a, *w}) if a and w else a or w for a, (_, w, _) in zip(old_words, found, strict=True)],
                    kinds["hit_words"],
                ),
                "hit_items": pa.array(
                    [sorted({*a, *i}) if a and i else a or i for a, (_, _, i) in zip(old_items, found, strict=True)],
                    kinds["hit_items"],
                ),
            }
            return set_columns(batch, values)

        return search

    return map_arrow(docs, schema, make)


def joined_ids(items: Column) -> Column:
    """The ids sorted as strings, with commas between them."""
    return F.array_join(F.sort_array(F.transform(items, lambda i: i.cast("string"))), ",")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = search_benchmark(docs.select("doc_id", "text"), benchmark)
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(joined_ids(F.col("hit_items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


SQL = r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, w[s : s + least(len(w), 10) - 1] AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM items WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
starts AS (
  SELECT doc_id, s, n, w[s : s + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM doc_words, lengths)
), found AS (
  SELECT t.doc_id, t.s, t.n, v.item_id FROM starts t JOIN windows v ON t.n = v.n AND t.win = v.win
), words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM found) GROUP BY doc_id
), items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
       coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN words_hit h USING (doc_id) LEFT JOIN items_hit i USING (doc_id)
"""
