"""Approximate nearest neighbours by an adaptive dimension scan of probed lists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantmon.llm.common import map_arrow
from plantmon.plans.staging import stage

COLUMNS = 16  # rotated dimensions in a block
CONFIDENCE = 2.1  # how many deviations an estimate must exceed its limit by
LIST_ROWS = 256
MOST_LISTS = 4_096
SAMPLE_ROWS = 32_768
TRIALS = 256
CELL_ROWS = 8_192
CELL_QUERIES = 16_384  # query and list pairs of a cell
PAIRS = 500_000  # pairs that are looked at together
SPARSE = 0.1  # share of live pairs below which they are followed one by one


@dataclass
class Index:
    """Rotation and list centres, for vectors of one dimension.

    A vector is lengthened by one coordinate that gives all the same norm, so the
    nearest by distance is the largest by inner product.
    """

    norm: float
    rotation: np.ndarray
    centres: np.ndarray
    probes: int = 1

    def rotated(self, vectors: np.ndarray, is_query: bool) -> np.ndarray:
        rest = np.zeros(len(vectors)) if is_query else np.sqrt(np.maximum(self.norm**2 - (vectors**2).sum(axis=1), 0))
        return np.concatenate([vectors, rest[:, None]], axis=1) @ self.rotation

    def distances(self, rotated: np.ndarray) -> np.ndarray:
        return (rotated**2).sum(axis=1)[:, None] + (self.centres**2).sum(axis=1) - 2 * rotated @ self.centres.T


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def usable(vec: Column) -> Column:
    """No null or non-finite component, and not all of them zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def fit_index(
    vectors: DataFrame, dim: int, rows: int, norm: float, k: int, recall: float, seed: int = 11, rounds: int = 8
) -> Index:
    """Fit list centres on a sample of at most SAMPLE_ROWS rows, drawn by hash.

    How many lists to probe is measured there too: up to TRIALS sample rows are
    queries, and the lists of their true neighbours in the sample are to be found
    in the share ``recall`` of cases. With more rows than the sample neighbours
    are nearer, so the measured number errs on the safe side.
    """
    drawn = vectors.orderBy(F.xxhash64("id"), "id", "row").limit(SAMPLE_ROWS).select("vec").toArrow()
    sample = matrix(drawn.column("vec").combine_chunks(), dim)
    draw = np.random.default_rng(seed)
    rotation = np.linalg.qr(draw.normal(size=(dim + 1, dim + 1)))[0]
    lists = int(np.clip(round(rows / LIST_ROWS), 1, min(MOST_LISTS, len(sample))))
    index = Index(norm, rotation, np.empty((0, dim + 1)))
    points = index.rotated(sample, is_query=False)
    index.centres = points[draw.permutation(len(points))[:lists]]
    for _ in range(rounds):
        nearest = np.concatenate([index.distances(p).argmin(axis=1) for p in np.array_split(points, max(1, len(points) // 4096))])
        sums = np.zeros_like(index.centres)
        np.add.at(sums, nearest, points)
        filled = np.bincount(nearest, minlength=lists)
        index.centres = np.where(filled[:, None] > 0, sums / np.maximum(filled, 1)[:, None], index.centres)
    nearest = np.concatenate([index.distances(p).argmin(axis=1) for p in np.array_split(points, max(1, len(points) // 4096))])
    turns = []
    for i in range(min(TRIALS, len(sample))):
        products = sample @ sample[i]
        products[i] = -np.inf
        true = np.argsort(-products)[: min(k, len(sample) - 1)]
        order = index.distances(index.rotated(sample[i : i + 1], True))[0].argsort()
        place = np.empty(lists, np.int64)
        place[order] = np.arange(lists)
        turns.append(place[nearest[true]])
    turns = np.sort(np.concatenate(turns)) if turns else np.empty(0)
    index.probes = int(turns[min(len(turns) - 1, int(recall * len(turns)))]) + 1 if len(turns) else 1
    return index


def scan(
    index: Index, queries: np.ndarray, query_rows: np.ndarray, probed: list[np.ndarray], vectors: np.ndarray,
    rows: np.ndarray, ids: np.ndarray, lists: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of ``vectors`` in the probed lists of every query, as (query, place, score).

    A query first scores its nearest list here, which gives a k-th best distance.
    In the others rotated coordinates are taken block by block. After each block
    the partial distance, scaled up, estimates the whole one; a pair whose
    estimate exceeds the query's k-th best distance by more than chance allows is
    abandoned. While many pairs are alive a block is one matrix product, after
    that they are followed one by one. The survivors are scored exactly, on the
    original vectors. Ties go to the smaller id; a query never meets its own row.
    """
    q, x = index.rotated(queries, True), index.rotated(vectors, False)
    dims = q.shape[1]
    base = (queries**2).sum(axis=1) + index.norm**2
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(q)
    limit = np.full(len(q), np.inf)
    asking = np.repeat(np.arange(len(q)), [len(p) for p in probed])
    wanted = np.concatenate(probed) if probed else np.empty(0, np.int64)
    order = np.argsort(lists, kind="stable")
    names, heads = np.unique(lists[order], return_index=True)
    held = dict(zip(names.tolist(), np.split(order, heads[1:]), strict=True))
    here = np.isin(wanted, names)
    asking, wanted = asking[here], wanted[here]
    # The nearest of each query's lists, by its place among the pairs.
    far = ((q[asking] - index.centres[wanted]) ** 2).sum(axis=1)
    by_far = np.lexsort((far, asking))
    first = np.zeros(len(asking), bool)
    first[by_far[np.unique(asking[by_far], return_index=True)[1]]] = True
    for name, pairs in [(n, first & (wanted == n)) for n in held] + [(n, ~first & (wanted == n)) for n in held]:
        have, mine = held[name], asking[pairs]
        step = max(1, PAIRS // max(1, len(have)))
        for begin in range(0, len(mine), step):
            ask = mine[begin : begin + step]
            ceiling = limit[ask][:, None]
            partial, alive, e = np.zeros((len(ask), len(have))), None, 0
            while e < dims:
                d, e = e, min(dims, e + COLUMNS)
                slack = (1 + CONFIDENCE / np.sqrt(e)) ** 2 * (e / dims) if e < dims else 1 + 1e-9
                if alive is None:
                    left, right = q[ask, d:e], x[have, d:e]
                    partial += (left**2).sum(axis=1)[:, None]
                    partial += (right**2).sum(axis=1)
                    partial -= (2 * left) @ right.T
                    seen = partial <= ceiling * slack + 1e-9
                    if e == dims or np.count_nonzero(seen) < SPARSE * seen.size:
                        alive = np.nonzero(seen)
                        partial = partial[alive]
                else:
                    at, cols = alive
                    partial = partial + ((q[ask[at], d:e] - x[have[cols], d:e]) ** 2).sum(axis=1)
                    seen = partial <= ceiling[at, 0] * slack + 1e-9
                    alive, partial = (at[seen], cols[seen]), partial[seen]
            at, cols = ask[alive[0]], have[alive[1]]
            other = query_rows[at] != rows[cols]
            at, cols = at[other], cols[other]
            scores = np.einsum("ij,ij->i", queries[at], vectors[cols])
            cuts = np.searchsorted(at, ask), np.searchsorted(at, ask, side="right")
            for i, a, b in zip(ask.tolist(), cuts[0].tolist(), cuts[1].tolist(), strict=True):
                if a == b:
                    continue
                score = np.concatenate([best[i][0], scores[a:b]])
                which = np.concatenate([best[i][1], cols[a:b]])
                keep = np.lexsort((rows[which], ids[which], -score))[:k]
                best[i] = (score[keep], which[keep])
                if len(keep) == k:
                    limit[i] = base[i] - 2 * score[keep[-1]]
    found = [np.full(len(b[0]), i) for i, b in enumerate(best)]
    return (
        np.concatenate(found) if found else np.empty(0, np.int64),
        np.concatenate([b[1] for b in best]) if best else np.empty(0, np.int64),
        np.concatenate([b[0] for b in best]) if best else np.empty(0),
    )


def _with_list(rows: DataFrame, index: Index, dim: int) -> DataFrame:
    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
            nearest = index.distances(index.rotated(matrix(batch.column(2), dim), False)).argmin(axis=1)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32))], names=["row", "id", "vec", "list"])

        return assign

    return map_arrow(rows.select("row", "id", "vec"), "row long, id long, vec array<double>, list int", make)


@dataclass
class Cells:
    """Where lists are searched: small ones share a cell, large ones have several.

    ``first`` and ``parts`` are the cells of each list; ``turns`` says how many
    parts the queries of a list's cells are cut into.
    """

    first: np.ndarray
    parts: np.ndarray
    turns: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, asked: np.ndarray, order: np.ndarray) -> Cells:
        first, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // CELL_ROWS))
        cell, room = -1, 0
        for i in order.tolist():
            if parts[i] > 1:
                first[i], room = cell + 1, 0
                cell += int(parts[i])
            else:
                if sizes[i] > room:
                    cell, room = cell + 1, CELL_ROWS
                first[i], room = cell, room - sizes[i]
        total = np.bincount(first, asked, minlength=cell + 1)
        return cls(first, parts, np.maximum(1, -(-total[first] // CELL_QUERIES)).astype(np.int64))


def _probe_counts(chosen: np.ndarray, sizes: np.ndarray, probes: int, enough: int) -> np.ndarray:
    """Which places of each row of ``chosen`` (lists, nearest first) are probed."""
    held = np.cumsum(sizes[chosen], axis=1)
    return ((np.arange(chosen.shape[1]) < probes) | (held - sizes[chosen] < enough)) & (sizes[chosen] > 0)


def _probed(queries: DataFrame, index: Index, dim: int, sizes: np.ndarray, enough: int) -> DataFrame:
    """(row, vec, lists): the nearest lists of every query.

    As many as the index says, and more until they hold ``enough`` rows.
    """

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def choose(batch: pa.RecordBatch) -> pa.RecordBatch:
            near = index.distances(index.rotated(matrix(batch.column(1), dim), True)).argsort(axis=1)
            taken = _probe_counts(near, sizes, index.probes, enough)
            heads = np.concatenate([[0], np.cumsum(taken.sum(axis=1))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(heads), pa.array(near[taken].astype(np.int32)))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["row", "vec", "lists"])

        return choose

    return map_arrow(queries.select("row", "vec"), "row long, vec array<double>, lists array<int>", make)


def _asks(asked: DataFrame, cells: Cells, dim: int) -> DataFrame:
    """(row, vec, cell, turn, lists): one row for each cell a query has to visit."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def visit(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, where, turn, what = [], [], [], []
            for i, (name, lists) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                visits: dict[int, list[int]] = {}
                for one in lists:
                    for part in range(int(cells.parts[one])):
                        visits.setdefault(int(cells.first[one]) + part, []).append(one)
                for cell, some in visits.items():
                    rows.append(i)
                    where.append(cell)
                    turn.append((name * 0x9E3779B97F4A7C15 >> 40) % int(cells.turns[some[0]]))
                    what.append(some)
            picked = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(picked), batch.column(1).take(picked), pa.array(where, pa.int64()),
                 pa.array(turn, pa.int64()), pa.array(what, pa.list_(pa.int32()))],
                names=["row", "vec", "cell", "turn", "lists"],
            )

        return visit

    return map_arrow(asked, "row long, vec array<double>, cell long, turn long, lists array<int>", make)


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.97, id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """The ``k`` rows with the largest inner product to every query row, as far as probed.

    Queries are the rows for which ``is_query`` holds; candidates are all rows
    but the query's own. Returns (``query_id``, ``rank`` from 1, the id column,
    ``score``), ties to the smaller id; scores are exact, in double precision.
    Vectors that are null, empty, zero, or hold null or non-finite components
    take no part, nor do rows without id. Rows that repeat an id are rows of
    their own: each is a candidate, also of the other, and each query among them
    has its answers. An inner product needs vectors of one length, so a query
    meets the candidates of its length, and there is one index for each length.
    Fewer than ``k`` candidates are all returned; extra columns are left out. An
    empty table gives an empty table.

    Every row is in one of up to MOST_LISTS lists, whose centres come from a
    sample of SAMPLE_ROWS rows. A query goes to its nearest lists, as many as
    found the share ``recall`` of true neighbours in the sample (and on until they
    hold 4 k rows). Neighbouring lists share a cell of about CELL_ROWS rows, and a
    larger list has several, so one with a third of all rows is many tasks; the
    queries of a crowded cell take turns. A cell returns ``k`` rows a query.
    """
    kind = dict(vectors.dtypes)[id_col]
    schema = f"query_id {kind}, rank int, `{id_col}` {kind}, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v))
    rows = stage(rows.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("vec"), "norm": norm}), "vectors")
    facts = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("rows"), F.max("norm").alias("norm"), F.max("q").alias("asked")).orderBy("dim")
    parts = [_of_one_length(rows.where(F.col("dim") == f["dim"]), f["dim"], f["rows"], f["norm"], k, recall) for f in facts.collect() if f["asked"]]
    if not parts:
        return vectors.sparkSession.createDataFrame([], schema)
    near = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    own = rows.where("q").select(F.col("row").alias("query"), F.col("id").cast(kind).alias("query_id"))
    return ranked.join(own, "query").select("query_id", "rank", F.col("id").cast(kind).alias(id_col), "score")


def _of_one_length(rows: DataFrame, dim: int, count: int, norm: float, k: int, recall: float) -> DataFrame:
    """(query, row, id, score): the best of every cell for each query; both are rows of length ``dim``."""
    spark = rows.sparkSession
    index = fit_index(rows, dim, count, norm, k, recall)
    listed = stage(_with_list(rows, index, dim), "lists")
    counts = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}
    sizes = np.asarray([counts.get(i, 0) for i in range(len(index.centres))])
    asked = stage(_probed(rows.where("q"), index, dim, sizes, 4 * k + 1), "probes")
    wanted = {r["list"]: r["count"] for r in asked.select(F.explode("lists").alias("list")).groupBy("list").count().collect()}
    centred = index.centres - index.centres.mean(axis=0)
    along = np.linalg.svd(centred, full_matrices=False)[2][0]
    cells = Cells.of(sizes, np.asarray([wanted.get(i, 0) for i in range(len(sizes))]), np.argsort(centred @ along))
    # One row a list, MOST_LISTS at most.
    places = F.broadcast(spark.createDataFrame(
        [(i, *map(int, x)) for i, x in enumerate(zip(cells.first, cells.parts, cells.turns, strict=True))],
        "list int, first long, parts long, turns long",
    ))
    whole = listed.join(places, "list").withColumn("cell", F.col("first") + F.pmod(F.xxhash64("row"), "parts"))
    held = whole.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
    asks = _asks(asked, cells, dim)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.float64() if c == "score" else pa.int64()) for c in ("query", "row", "id", "score")})
        have = matrix(right.column("vec").combine_chunks(), dim)
        ask_rows, first, which = np.unique(left.column("row").to_numpy(), return_index=True, return_inverse=True)
        ask = matrix(left.column("vec").combine_chunks().take(pa.array(first)), dim)
        lists = left.column("lists").to_pylist()
        probed = [np.empty(0, np.int64)] * len(ask_rows)
        for i, some in zip(which.tolist(), lists, strict=True):
            probed[i] = np.union1d(probed[i], some).astype(np.int64)
        names = [right.column(c).to_numpy() for c in ("row", "id", "list")]
        at, found, score = scan(index, ask, ask_rows, probed, have, *names, k)
        found = found.astype(np.int64)
        return pa.table({"query": ask_rows[at.astype(np.int64)], "row": names[0][found], "id": names[1][found], "score": score})

    keys = ["cell", "turn"]
    return asks.groupBy(*keys).cogroup(held.select("row", "id", "vec", "list", *keys).groupBy(*keys)).applyInArrow(
        search, "query long, row long, id long, score double"
    )


def query(embeddings: DataFrame) -> DataFrame:
    return nearest_neighbours(embeddings, F.col("vec_id") % 20 == 0)
