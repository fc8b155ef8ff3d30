"""Hard negatives by a vertical scan of columnar blocks (branch and bound on decomposed vectors)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantmon.plans.staging import stage

BLOCK_ROWS = 32_768  # rows of a block at most, about
LEAST_ROWS = 1_024
BLOCKS = 16  # blocks that a small table is cut into
ANCHORS = 4_096  # anchors that meet a block together, about
STEP = 8  # dimensions between two looks at the bounds
MOST_TASKS = 20_000

_BLOCK = T.StructType([
    T.StructField("dim", T.IntegerType()), T.StructField("block", T.LongType()),
    T.StructField("rows", T.BinaryType()), T.StructField("ids", T.BinaryType()),
    T.StructField("labels", T.BinaryType()), T.StructField("names", T.ArrayType(T.StringType())),
    T.StructField("columns", T.ArrayType(T.BinaryType())),
    T.StructField("least", T.ArrayType(T.LongType())), T.StructField("most", T.ArrayType(T.LongType())),
])
_FOUND = "row long, other long, score long"


class Block:
    """The rows of one block, a column for each dimension and what the dimension spans."""

    def __init__(self, record: dict):
        self.ids = np.frombuffer(record["ids"], np.int64)
        self.rows = np.frombuffer(record["rows"], np.int64)
        self.labels = np.frombuffer(record["labels"], np.int32)
        self.names = {name: i for i, name in enumerate(record["names"])}
        self.columns = [np.frombuffer(c, np.int32 if len(c) == 4 * len(self.ids) else np.int64) for c in record["columns"]]
        self.least = np.asarray(record["least"], np.int64)
        self.most = np.asarray(record["most"], np.int64)

    @staticmethod
    def record(dim: int, block: int, table: pa.Table) -> dict[str, list]:
        values = np.asarray(table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.int64)
        values = values.reshape(table.num_rows, dim)
        narrow = not values.size or np.abs(values).max() < 1 << 31
        names = table.column("label").combine_chunks().dictionary_encode()
        return {
            "dim": [dim], "block": [block],
            "rows": [table.column("row").to_numpy().astype(np.int64).tobytes()],
            "ids": [table.column("id").to_numpy().astype(np.int64).tobytes()],
            "labels": [names.indices.to_numpy().astype(np.int32).tobytes()],
            "names": [names.dictionary.to_pylist()],
            "columns": [[values[:, d].astype(np.int32 if narrow else np.int64).tobytes() for d in range(dim)]],
            "least": [values.min(axis=0).tolist() if dim else []],
            "most": [values.max(axis=0).tolist() if dim else []],
        }

    def scan(self, anchor: np.ndarray, rows: np.ndarray, shrink: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores of those ``rows`` (places in the block) that ``shrink`` leaves.

        Dimensions are read in the order of the anchor's magnitude. After each
        STEP of them the remaining ones add between ``low`` and ``high`` to every
        row, whatever it holds there; ``shrink`` gets both bounds of the score of
        each row and says which rows stay.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * self.least, anchor * self.most])[:, order]
        low = np.append(np.cumsum(ends.min(axis=0)[::-1])[::-1], 0)
        high = np.append(np.cumsum(ends.max(axis=0)[::-1])[::-1], 0)
        score = np.zeros(len(rows), np.int64)
        for start in range(0, len(order), STEP):
            whole = len(rows) == len(self.ids)
            for d in order[start : start + STEP].tolist():
                column = self.columns[d] if whole else self.columns[d].take(rows)
                score += column * anchor[d]
            end = min(start + STEP, len(order))
            kept = shrink(score + low[end], score + high[end])
            if not kept.all():
                rows, score = rows[kept], score[kept]
            if not len(rows):
                break
        return rows, score


def _best(score: np.ndarray, k: int) -> int:
    """The k-th largest score."""
    return int(np.partition(score, len(score) - k)[len(score) - k])


def _first(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def nearest_alike(block: Block, anchor: np.ndarray, row: int, label: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the first ``k`` rows of the anchor's label in a block, itself left out."""
    rows = np.flatnonzero((block.labels == block.names.get(label, -1)) & (block.rows != row))

    def shrink(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= _best(low, k) if len(low) > k else np.ones(len(low), bool)

    rows, score = block.scan(anchor, rows, shrink)
    first = _first(block.ids[rows], score, k)
    return rows[first], score[first]


def nearest_inside(
    block: Block, anchor: np.ndarray, label: str, windows: list[tuple[int, int]], k: int
) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of rows of other labels that are among the first ``k`` of a window of scores."""
    rows = np.flatnonzero(block.labels != block.names.get(label, -1))

    def shrink(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        needed = np.zeros(len(low), bool)
        for least, most in windows:
            may = (high >= least) & (low <= most)
            sure = low[may & (low >= least) & (high <= most)]
            needed |= may & (high >= _best(sure, k)) if len(sure) >= k else may
        return needed

    rows, score = block.scan(anchor, rows, shrink)
    taken = np.zeros(len(rows), bool)
    for least, most in windows:
        inside = np.flatnonzero((score >= least) & (score <= most))
        taken[inside[_first(block.ids[rows[inside]], score[inside], k)]] = True
    return rows[taken], score[taken]


def _pack(rows: DataFrame) -> DataFrame:
    """Blocks: one record for each, column by column."""
    out_schema = _BLOCK

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        record = Block.record(key[0].as_py(), key[1].as_py(), table)
        kinds = {"dim": pa.int32(), "block": pa.int64(), "names": pa.list_(pa.string()), "columns": pa.list_(pa.binary()),
                 "least": pa.list_(pa.int64()), "most": pa.list_(pa.int64())}
        return pa.table({n: pa.array(v, kinds.get(n, pa.binary())) for n, v in record.items()})

    return rows.groupBy("dim", "block").applyInArrow(pack, out_schema)


def _meet(
    anchors: DataFrame, blocks: DataFrame, tasks: int,
    search: Callable[[Block, np.ndarray, int, str, list[int]], tuple[np.ndarray, np.ndarray]],
) -> DataFrame:
    """(row, other, score): what ``search`` finds for every anchor in every block of its dimension.

    ``anchors`` has (row, label, vec, scores, dim, group, blocks), ``blocks`` the
    packed blocks and the number of anchor groups. A block goes to every group
    of anchors and an anchor to every block, so a cell holds one block and one
    group and nothing is joined row by row. Cells are small in bytes and large in
    work, hence the number of tasks is given and not left to their size.
    """
    asks = anchors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    held = blocks.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            block = Block(right.to_pylist()[0])
            dim = len(block.columns)
            vectors = np.asarray(left.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.int64)
            vectors = vectors.reshape(left.num_rows, dim)
            rest = zip(*(left.column(c).to_pylist() for c in ("row", "label", "scores")), strict=True)
            for vector, (row, label, scores) in zip(vectors, rest, strict=True):
                places, score = search(block, vector, row, label, scores)
                out.append((np.full(len(places), row), block.ids[places], score))
        parts = [np.concatenate(p).astype(np.int64) if p else np.empty(0, np.int64) for p in zip(*out)] or [np.empty(0, np.int64)] * 3
        return pa.table(dict(zip(("row", "other", "score"), parts, strict=True)))

    keys = ["dim", "block", "group"]
    asks, held = asks.repartition(tasks, *keys), held.repartition(tasks, *keys)
    return asks.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(find, _FOUND)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """For every anchor and each of its positives, the best rows of other labels within a window of scores.

    A component x counts as floor(``scale`` * x); a score is the integer inner
    product with the anchor, ties go to the smaller id. Positives are an anchor's
    first ``positives`` other rows of its label. A negative's score lies between
    ``low`` and ``high`` hundredths of the positive's; a negative positive score
    has none. Returns (``anchor_id``, ``positive_id``, ``rank`` from 1,
    ``negative_id``, ``positive_score``, ``negative_score``); fewer rows than asked
    for are all returned, an anchor without any has no row.

    Rows without id, label or vector, and those with a null or non-finite
    component, take no part. Every other row does: rows that repeat an id are
    rows of their own, a repeat is another row than its anchor, and an anchor
    that repeats has its rows as often. Vectors meet those of their length
    only; empty ones score 0. Extra columns are left out. An empty table gives an
    empty table. Scores that a long cannot hold raise an error.

    Rows lie in blocks of about BLOCK_ROWS, a column for each dimension. Within a
    block a bitmap starts with the rows of the right labels and loses what the
    bounds rule out (see :meth:`Block.scan`): rows that cannot be among the first
    positives, rows that can reach no window or fall behind ``negatives`` sure rows
    of each window they can reach. A block returns a few rows an anchor, and their
    order is decided over all blocks. Labels are a bitmap and not a key, so a
    frequent one makes no task larger.
    """
    spark = vectors.sparkSession
    whole = F.transform(F.col(vec_col).cast("array<double>"), lambda x: x * F.lit(float(scale)))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), whole.alias("vec"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ).where("id is not null and label is not null and vec is not null").where(~odd)
    largest = F.coalesce(F.array_max(F.transform("vec", lambda x: F.abs(F.floor(x)).cast("double"))), F.lit(0.0))
    rows = stage(
        rows.select(
            "id", "label", "anchor", F.size("vec").alias("dim"), largest.alias("largest"),
            F.transform("vec", lambda x: F.floor(x)).alias("vec"), F.monotonically_increasing_id().alias("row"),
        ), "vectors",
    )
    kinds = dict(vectors.dtypes)
    names = f"anchor_id {kinds[id_col]}, positive_id {kinds[id_col]}, rank int, negative_id {kinds[id_col]}, positive_score long, negative_score long"
    reach = rows.agg(F.max(F.col("largest") * F.col("largest") * F.greatest("dim", F.lit(1)))).first()[0]
    if reach is None:
        return spark.createDataFrame([], names)
    if reach >= 2.0**55:  # a hundred times a score fits too
        raise ValueError("components too large: a score would not fit a long")

    # One row for each length of vectors.
    sizes = stage(
        rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("a")).select(
            "dim",
            F.greatest(F.ceil(F.col("n") / F.greatest(F.least(F.col("n") / BLOCKS, F.lit(BLOCK_ROWS)), F.lit(LEAST_ROWS))), F.lit(1)).cast("long").alias("blocks"),
            F.greatest(F.ceil(F.col("a") / ANCHORS), F.lit(1)).cast("long").alias("groups"),
        ), "sizes",
    )
    cells = sizes.agg(F.sum(F.col("blocks") * F.col("groups"))).first()[0]
    tasks = max(1, min(int(cells), MOST_TASKS))
    placed = rows.drop("largest").join(sizes, "dim")
    spread = F.xxhash64("row", F.lit(3))
    blocks = stage(_pack(placed.withColumn("block", F.pmod(spread, "blocks")).select("dim", "block", "row", "id", "label", "vec")), "blocks")
    blocks = blocks.join(sizes.select("dim", "groups"), "dim")
    anchors = placed.where("anchor").select(
        "row", "id", "label", "vec", "dim", "blocks", F.pmod(F.xxhash64("row", F.lit(5)), "groups").alias("group")
    )
    none = F.array().cast("array<long>")

    def alike(block: Block, vector: np.ndarray, row: int, label: str, scores: list[int]) -> tuple[np.ndarray, np.ndarray]:
        return nearest_alike(block, vector, row, label, positives)

    near = _meet(anchors.withColumn("scores", none), blocks, tasks, alike)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "other")
    pairs = stage(
        near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).select(
            "row", "place", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")
        ), "positives",
    )
    asked = anchors.join(
        pairs.where("positive_score >= 0").groupBy("row").agg(F.sort_array(F.collect_set("positive_score")).alias("scores")), "row"
    )

    def inside(block: Block, vector: np.ndarray, row: int, label: str, scores: list[int]) -> tuple[np.ndarray, np.ndarray]:
        return nearest_inside(block, vector, label, [(-(-low * s // 100), high * s // 100) for s in scores], negatives)

    far = stage(_meet(asked, blocks, tasks, inside), "negatives").withColumnRenamed("score", "negative_score")
    met = pairs.join(far, "row").where(
        (low * F.col("positive_score") <= 100 * F.col("negative_score")) & (100 * F.col("negative_score") <= high * F.col("positive_score"))
    )
    best = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "other")
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    own = anchors.select("row", F.col("id").alias("anchor_id"))
    return ranked.join(own, "row").select(
        F.col("anchor_id").cast(kinds[id_col]), F.col("positive_id").cast(kinds[id_col]), "rank",
        F.col("other").cast(kinds[id_col]).alias("negative_id"), "positive_score", "negative_score",
    )


def query(embeddings: DataFrame) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, len(embedding) AS dim,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS other, a.label = b.label AS alike,
         CASE WHEN a.dim = 0 THEN 0 ELSE CAST(list_inner_product(a.vec, b.vec) AS BIGINT) END AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r AND a.dim = b.dim
), positives AS (
  SELECT * FROM (
    SELECT ar, anchor_id, other AS positive_id, score AS positive_score,
           row_number() OVER (PARTITION BY ar ORDER BY score DESC, other) AS place
    FROM scored WHERE alike) WHERE place <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, s.other AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.ar, p.place ORDER BY s.score DESC, s.other) AS rank
  FROM positives p JOIN scored s ON p.ar = s.ar AND NOT s.alike
   AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 5
"""
