"""A tree of boxes over a library of cells, searched for the nearest cell of each family.

The score of a cell with centre c and scale s is ``max_i |f_i - c_i| / s_i``. A
box holds the range of some cells' centres and their largest scales; the same
formula on the box never exceeds the score of a cell inside, so a box whose bound
is above the best score so far is skipped with all it holds.

The tree has three levels, all of them tables: cells sorted along a space-filling
curve are cut into *parts* of bounded size, a part is cut into *leaves* of a few
cells by median splits, and every family of a part has one box at the top.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantmon.plans import rank_within, stage

PART_BYTES = 8 * 1024 * 1024
TOP_BYTES = 32 * 1024 * 1024
LEAF = 32
TURN = 16_384  # visits of a part that one task answers
CURVE = (6, 10)  # dimensions and bits of the space-filling curve
CHUNK = 2_000_000  # numbers that are looked at together


def _bounds(values: np.ndarray, low: np.ndarray, high: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Least possible score of each row of ``values`` in each box."""
    out = np.zeros((len(values), len(low)))
    for i in range(values.shape[1]):
        v = values[:, i, None]
        np.maximum(out, np.maximum(low[:, i] - v, v - high[:, i]) / scale[:, i], out=out)
    return out


def _split(centers: np.ndarray, scales: np.ndarray, members: np.ndarray) -> Iterator[np.ndarray]:
    """Leaves of at most LEAF members, halved along the widest dimension."""
    todo = [members]
    while todo:
        m = todo.pop()
        if len(m) <= LEAF:
            yield m
            continue
        wide = int(np.argmax(np.ptp(centers[m], axis=0) / scales[m].max(axis=0)))
        order = m[np.argsort(centers[m, wide], kind="stable")]
        todo += [order[len(order) // 2 :], order[: len(order) // 2]]


class Part:
    """Cells with their leaves; ``order`` ranks their ids."""

    def __init__(self, dim: int, centers: bytes, scales: bytes, codes: bytes, order: bytes):
        self.centers = np.frombuffer(centers).reshape(-1, dim)
        self.scales = np.frombuffer(scales).reshape(-1, dim)
        self.codes = np.frombuffer(codes, np.int32)
        self.order = np.frombuffer(order, np.int64)
        self.leaves: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def family(self, code: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Members (filled up with -1) and boxes of the leaves of a family."""
        if code not in self.leaves:
            leaves = list(_split(self.centers, self.scales, np.flatnonzero(self.codes == code)))
            members = np.full((len(leaves), LEAF), -1)
            for row, leaf in zip(members, leaves, strict=True):
                row[: len(leaf)] = leaf
            boxes = [np.stack([f(x[leaf], axis=0) for leaf in leaves]) for f, x in ((np.min, self.centers), (np.max, self.centers), (np.max, self.scales))]
            self.leaves[code] = (members, *boxes)
        return self.leaves[code]

    def nearest(self, values: np.ndarray, code: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Least score up to ``limit`` and its cell (-1: none) for each row, and the pairs compared.

        Each row walks its leaves from the least bound on and stops at the first
        that cannot improve it; rows walk in step, so every step is one array
        operation. Of equal scores the cell with the smallest id counts.
        """
        members, low, high, scale = self.family(code)
        best, cell, compared = limit.copy(), np.full(len(values), -1), 0
        step = max(1, CHUNK // max(1, len(members)))
        for start in range(0, len(values), step):
            rows = np.arange(start, min(start + step, len(values)))
            bound = _bounds(values[rows], low, high, scale)
            walk = np.argsort(bound, axis=1, kind="stable")
            for j in range(len(members)):
                leaf = walk[rows - start, j]
                may = bound[rows - start, leaf] <= best[rows]
                rows, leaf = rows[may], leaf[may]
                if not len(rows):
                    break
                width = max(1, CHUNK // (LEAF * values.shape[1]))
                for a in range(0, len(rows), width):
                    r, m = rows[a : a + width], members[leaf[a : a + width]]
                    score = (np.abs(values[r, None, :] - self.centers[m]) / self.scales[m]).max(axis=2)
                    score = np.where(m < 0, np.inf, score)
                    compared += int((m >= 0).sum())
                    least = score.min(axis=1)
                    rank = np.where((score == least[:, None]) & (m >= 0), self.order[m], np.iinfo(np.int64).max)
                    pick = rank.argmin(axis=1)
                    at = np.arange(len(r))
                    older = np.where(cell[r] >= 0, self.order[cell[r]], np.iinfo(np.int64).max)
                    wins = (m[at, pick] >= 0) & ((least < best[r]) | ((least == best[r]) & (rank[at, pick] < older)))
                    best[r[wins]], cell[r[wins]] = least[wins], m[at, pick][wins]
        return best, cell, compared


@dataclass
class CellTree:
    """``parts``: one packed record a part; ``tops``: (part, family, box) arrays; ``families`` in the order of their codes.

    A library of one part is kept as its ``record``.
    """

    families: list
    dim: int
    cell_type: T.DataType
    family_type: T.DataType
    record: dict | None = None
    parts: DataFrame | None = None
    tops: dict[str, np.ndarray] | None = None


def _curve(cells: DataFrame, dim: int) -> Column:
    """Place of a cell's centre on a space-filling curve over its widest dimensions."""
    dims, bits = CURVE
    per = cells.select(F.posexplode(F.arrays_zip("center", "scale")).alias("i", "x")).groupBy("i").agg(
        F.min("x.center").alias("low"), F.max("x.center").alias("high"), (F.stddev_pop("x.center") / F.avg("x.scale")).alias("spread")
    ).collect()  # one row a feature
    wide = sorted((r for r in per if r["high"] > r["low"]), key=lambda r: (-r["spread"], r["i"]))[:dims]
    key = F.lit(0).cast("long")
    if not wide:
        return key
    steps = [
        F.least(((F.get("center", F.lit(r["i"])) - r["low"]) / (r["high"] - r["low"]) * (1 << bits)).cast("long"), F.lit((1 << bits) - 1).cast("long"))
        for r in wide
    ]
    for b in range(bits - 1, -1, -1):
        for s in steps:
            key = F.shiftleft(key, 1).bitwiseOR(F.shiftright(s, b).bitwiseAND(F.lit(1).cast("long")))
    return key


def build_cell_tree(cells: DataFrame, family: Sequence[str] = ("family_id",), cell: str = "cell_id") -> CellTree:
    """The tree over ``cells``: ``cell``, ``family`` (at most one column), ``center`` and ``scale`` arrays.

    The library stays in Spark: it is sorted along the curve, cut and packed
    there. Only the boxes at the top reach the driver, one for each part and
    family, and parts grow where those would exceed TOP_BYTES.
    """
    name = F.col(family[0]) if family else F.lit("")
    rows = cells.select(name.alias("family"), F.col(cell).alias("cell"), "center", "scale")
    rows = stage(rows.withColumns({c: F.col(c).cast("array<double>") for c in ("center", "scale")}), "cells")
    shape = rows.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.least(F.size("center"), F.size("scale"))).alias("a"), F.max(F.greatest(F.size("center"), F.size("scale"))).alias("b")
    ).first()
    if not shape["n"]:
        raise ValueError("the cell library is empty")
    if shape["a"] != shape["b"]:
        raise ValueError("centres and scales differ in length")
    n, dim = shape["n"], shape["a"]
    kinds = dict(zip(rows.columns, [f.dataType for f in rows.schema.fields], strict=True))
    bytes_each = 16 * max(1, dim)
    if n * bytes_each <= PART_BYTES:
        table = rows.toArrow()
        names = sorted(set(table.column("family").to_pylist()))
        return CellTree(names, dim, kinds["cell"], kinds["family"], record=_packed(table, dim, {f: i for i, f in enumerate(names)}))
    size = max(LEAF, PART_BYTES // bytes_each, -(-n * 24 * max(1, dim) // TOP_BYTES))
    ranked = rank_within(rows.withColumn("curve", _curve(rows, dim)), [], ["family", "curve", "cell"], "pos")
    ranked = ranked.withColumn("part", F.expr(f"pos div {int(size)}L"))
    names = [r["family"] for r in rows.select("family").distinct().orderBy("family").collect()]
    if len(names) * 24 * max(1, dim) > TOP_BYTES:
        raise ValueError("too many families: every observation has a score for each of them")
    code_of = {name: i for i, name in enumerate(names)}
    box = T.StructType([T.StructField("family", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("low", "high", "scale")]])
    schema = T.StructType([
        T.StructField("part", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("centers", "scales", "codes", "order")],
        T.StructField("ids", T.ArrayType(kinds["cell"])), T.StructField("boxes", T.ArrayType(box)),
    ])

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        record = _packed(table, dim, code_of)
        box_type = pa.struct([("family", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("scale", pa.binary())])
        return pa.table({
            "part": pa.array([key[0].as_py()], pa.int64()), **{c: pa.array([record[c]], pa.binary()) for c in ("centers", "scales", "codes", "order")},
            "ids": pa.array([record["ids"]], pa.list_(table.schema.field("cell").type)), "boxes": pa.array([record["boxes"]], pa.list_(box_type)),
        })

    parts = stage(ranked.select("part", "family", "cell", "center", "scale").groupBy("part").applyInArrow(pack, schema), "parts")
    tops = parts.select("part", F.explode("boxes").alias("b")).select("part", "b.*").orderBy("part", "family").collect()  # TOP_BYTES at most
    arrays = {c: np.stack([np.frombuffer(r[c]) for r in tops]) for c in ("low", "high", "scale")}
    arrays |= {"part": np.array([r["part"] for r in tops]), "family": np.array([r["family"] for r in tops])}
    return CellTree(names, dim, kinds["cell"], kinds["family"], parts=parts, tops=arrays)


def _packed(table: pa.Table, dim: int, code_of: dict) -> dict:
    """One part as binary arrays, with the box of each of its families."""
    centers, scales = (np.asarray(table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim) for c in ("center", "scale"))
    codes = np.array([code_of[f] for f in table.column("family").to_pylist()], np.int32)
    ids = table.column("cell").to_pylist()
    order = np.empty(len(ids), np.int64)
    order[sorted(range(len(ids)), key=lambda i: ids[i])] = np.arange(len(ids))
    boxes = [
        {"family": int(f), "low": centers[codes == f].min(axis=0).tobytes(), "high": centers[codes == f].max(axis=0).tobytes(), "scale": scales[codes == f].max(axis=0).tobytes()}
        for f in np.unique(codes)
    ]
    return {"centers": centers.tobytes(), "scales": scales.tobytes(), "codes": codes.tobytes(), "order": order.tobytes(), "ids": ids, "boxes": boxes}


def _values(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Features as a matrix; a missing component or a missing vector is NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    if not column.null_count and not flat.null_count and (np.diff(column.offsets.to_numpy()) == dim).all():
        return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    rows = column.to_pylist()
    out = np.full((len(rows), dim), np.nan)
    for i, row in enumerate(rows):
        if row is not None:
            if len(row) != dim:
                raise ValueError(f"an observation has {len(row)} features, the cells have {dim}")
            out[i] = [np.nan if x is None else x for x in row]
    return out


def _answer(record: dict, tree_dim: int, rows: np.ndarray, values: np.ndarray, asks: list[list[tuple[int, float]]], kind: pa.DataType) -> pa.Table:
    """(row, family, score, cell, compared) for the families each row asks for."""
    part = Part(tree_dim, *[record[c] for c in ("centers", "scales", "codes", "order")])
    by: dict[int, list[tuple[int, float]]] = {}
    for i, wanted in enumerate(asks):
        for code, limit in wanted:
            by.setdefault(code, []).append((i, limit))
    out: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64))]
    for code, some in by.items():
        at, limit = np.array([i for i, _ in some]), np.array([x for _, x in some])
        best, cell, compared = part.nearest(values[at], code, limit)
        best = np.where(np.isnan(values[at]).any(axis=1), np.nan, best)
        count = np.zeros(len(at), np.int64)
        count[0] = compared
        out.append((rows[at], np.full(len(at), code, np.int32), best, cell, count))
    row, family, score, cell, compared = (np.concatenate(x) for x in zip(*out, strict=True))
    ids = pa.array(record["ids"], kind).take(pa.array(cell, mask=cell < 0))
    return pa.table({"row": row, "family": family, "score": score, "cell": ids, "compared": compared})


def _result(tree: CellTree) -> T.StructType:
    return T.StructType([
        T.StructField("row", T.LongType()), T.StructField("family", T.IntegerType()), T.StructField("score", T.DoubleType()),
        T.StructField("cell", tree.cell_type), T.StructField("compared", T.LongType()),
    ])


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _visit(tree: CellTree, asks: DataFrame) -> DataFrame:
    """Answers to (row, vec, part, wanted): a task holds one part and a bounded share of its visits."""
    dim, kind = tree.dim, _arrow(tree.cell_type)
    turns = asks.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / TURN).cast("long").alias("turns"))
    turns = stage(turns, "turns")  # one row a part
    asked = asks.join(turns, "part").withColumn("turn", F.pmod(F.xxhash64("row"), "turns")).drop("turns")
    copies = turns.select(F.col("part").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("copy"))
    held = tree.parts.drop("boxes").join(copies, F.col("part") == F.col("of")).drop("of")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _answer({"centers": b"", "scales": b"", "codes": b"", "order": b"", "ids": []}, dim or 1, np.empty(0, np.int64), np.empty((0, dim)), [], kind)
        wanted = [[(w["family"], w["limit"]) for w in some] for some in left.column("wanted").to_pylist()]
        return _answer(right.to_pylist()[0], dim, left.column("row").to_numpy(), _values(left.column("vec"), dim), wanted, kind)

    return asked.groupBy("part", "turn").cogroup(held.groupBy("part", "copy")).applyInArrow(answer, _result(tree))


def search(tree: CellTree, rows: DataFrame) -> DataFrame:
    """(row, family, score, cell, compared) for every row of (row, vec) and every family of a tree of several parts.

    A row first visits, for each family, the part whose box is nearest, which
    gives a limit; then all further parts whose box is within it. Visits are
    equi-joins on the part's number, crowded parts take them in turns, and the
    answers meet in a minimum.
    """
    dim, tops = tree.dim, tree.tops
    codes = list(range(len(tree.families)))
    top_rows = [np.flatnonzero(tops["family"] == c) for c in codes]
    ask = "row long, vec array<double>, part long, wanted array<struct<family:int,limit:double>>"

    def asking(choose: Callable[[np.ndarray, pa.RecordBatch, int], list[dict[int, list[dict]]]]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                step = max(1, CHUNK // len(tops["part"]))
                for start in range(0, batch.num_rows, step):
                    some = batch.slice(start, step)
                    bound = tree_bounds(_values(some.column(1), dim))
                    visits = choose(bound, some, some.num_rows)
                    at = [i for i, v in enumerate(visits) for _ in v]
                    picked = pa.array(at, pa.int64())
                    wanted = [w for v in visits for w in v.values()]
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0).take(picked), some.column(1).take(picked), pa.array([p for v in visits for p in v], pa.int64()),
                         pa.array(wanted, pa.list_(pa.struct([("family", pa.int32()), ("limit", pa.float64())])))],
                        names=["row", "vec", "part", "wanted"],
                    )

        return run

    def tree_bounds(values: np.ndarray) -> np.ndarray:
        return _bounds(values, tops["low"], tops["high"], tops["scale"])

    def nearest(bound: np.ndarray, batch: pa.RecordBatch, n: int) -> list[dict[int, list[dict]]]:
        visits: list[dict[int, list[dict]]] = [{} for _ in range(n)]
        for c, mine in enumerate(top_rows):
            first = mine[bound[:, mine].argmin(axis=1)]
            for v, p in zip(visits, tops["part"][first].tolist(), strict=True):
                v.setdefault(p, []).append({"family": c, "limit": np.inf})
        return visits

    def further(bound: np.ndarray, batch: pa.RecordBatch, n: int) -> list[dict[int, list[dict]]]:
        visits: list[dict[int, list[dict]]] = [{} for _ in range(n)]
        limits = np.array([[s[c] for c in codes] for s in batch.column(2).to_pylist()])
        for c, mine in enumerate(top_rows):
            near = bound[:, mine] <= limits[:, c, None]
            near[np.arange(n), bound[:, mine].argmin(axis=1)] = False  # seen already
            for i, t in zip(*np.nonzero(near), strict=True):
                visits[i].setdefault(int(tops["part"][mine[t]]), []).append({"family": c, "limit": float(limits[i, c])})
        return visits

    rows = stage(rows.select("row", "vec"), "observations")
    seeds = stage(_visit(tree, rows.mapInArrow(asking(nearest), ask)), "seeds")
    limits = seeds.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("family", "score"))), lambda x: x["score"]).alias("limits"))
    more = _visit(tree, rows.join(limits, "row").mapInArrow(asking(further), ask))
    best = F.min_by(F.struct("score", "cell"), F.struct("score", F.col("cell").isNull(), "cell"))
    met = seeds.unionByName(more).groupBy("row", "family").agg(best.alias("best"), F.sum("compared").alias("compared"))
    return met.select("row", "family", "best.score", "best.cell", "compared")


def nearest_cells(
    observations: DataFrame, features: str, cells: DataFrame, keys: Sequence[str], family: Sequence[str] = ("family_id",), cell: str = "cell_id",
) -> DataFrame:
    """(``keys``, ``family``, ``cell``, score): the nearest cell of every family, or of all cells without ``family``.

    The score is ``max_i |f_i - c_i| / s_i``; of equal ones the smallest cell id
    counts. An observation with a missing feature, or without any, has the score
    NaN and no cell. Every observation has a row for each family, rows that
    repeat keep theirs. An empty library raises an error.
    """
    tree = build_cell_tree(cells, family, cell)
    asked = observations.select(*keys, F.col(features).cast("array<double>").alias("vec"))
    names = pa.array(tree.families, _arrow(tree.family_type))
    out = [asked.schema[k] for k in keys] + [T.StructField(f, tree.family_type) for f in family]
    out += [T.StructField(cell, tree.cell_type), T.StructField("score", T.DoubleType())]
    if tree.record is not None:
        record, dim, kind, codes = tree.record, tree.dim, _arrow(tree.cell_type), range(len(tree.families))

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    asks = [[(c, np.inf) for c in codes]] * batch.num_rows
                    got = _answer(record, dim, np.arange(batch.num_rows), _values(batch.column(len(keys)), dim), asks, kind).combine_chunks()
                    columns = [batch.column(i).take(got.column("row")) for i in range(len(keys))]
                    columns += [names.take(got.column("family")) for _ in family] + [got.column("cell"), got.column("score")]
                    flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
                    yield pa.RecordBatch.from_arrays(flat, names=[f.name for f in out])

        return asked.mapInArrow(local, T.StructType(out))
    rows = stage(asked.withColumn("row", F.monotonically_increasing_id()), "asked")
    found = search(tree, rows)
    named = F.array(*[F.lit(f).cast(tree.family_type) for f in tree.families])
    found = found.select("row", *[F.get(named, F.col("family")).alias(f) for f in family], F.col("cell").alias(cell), "score")
    return rows.select(*keys, "row").join(found, "row").select(*keys, *family, cell, "score")
