"""Leakage-free splits, five-stage timelines, fingerprints and access audits."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from plantmon.functions.numeric import half_even
from plantmon.plans import exact_quantiles, grouped_quantiles, hash_rank, lookup, over_frames, positions, rank_within, running, stage
from plantmon.plans.ordered import BLOCK_ROWS
from plantmon.plans.ranking import hash_key


def _test_size(n: int, ratio: float) -> int:
    size = max(1, round(n * ratio))
    if n - size <= 0:
        raise ValueError(f"test ratio {ratio} leaves no train row out of {n}")
    return size


def split_random(df: DataFrame, key: Sequence[str], ratio: float, seed: int) -> DataFrame:
    """Exact-size random test split by a seeded hash of the unique key."""
    drawn = hash_rank(df, key, seed, "_draw", size_name="_n")
    test = F.greatest(F.lit(1), half_even(F.col("_n") * F.lit(ratio)))
    return drawn.withColumn(
        "split", F.when(F.col("_draw") < test, "test").otherwise("train")
    ).drop("_draw", "_n")


def split_sequential(
    df: DataFrame, by: Sequence[str], index: str, ratio: float, *, size: int = BLOCK_ROWS
) -> DataFrame:
    """The last rows of each key (or of the whole table, with no key) are test."""
    by = list(by)
    placed = positions(df, by, index, "_pos", size=size)
    if not by:
        n = df.count()
        first_test = F.lit(n - _test_size(n, ratio))
        cut = F.col("_pos") >= first_test
        return placed.withColumn("split", F.when(cut, "test").otherwise("train")).drop("_pos")
    counts = df.groupBy(*by).agg(F.count("*").alias("_n"))
    joined = lookup(placed, counts, by, "inner", salt_by=[*by, index])
    test = F.greatest(F.lit(1), half_even(F.col("_n") * F.lit(ratio)))
    return joined.withColumn(
        "split", F.when(F.col("_pos") >= F.col("_n") - test, "test").otherwise("train")
    ).drop("_pos", "_n")


def split_sequential_windows(
    samples: DataFrame, rank: str, train_ratio: float, eval_ratio: float = 0.0
) -> DataFrame:
    """Train, eval and test samples by their place in the sample order.

    ``rank`` is the dense 0-based sample number.
    """
    n = samples.count()
    if n < 3:
        raise ValueError(f"a sequential split needs at least 3 samples, got {n}")
    train_end = max(1, round(n * train_ratio))
    test_start = min(n - 1, train_end + round(n * eval_ratio))
    part = (
        F.when(F.col(rank) >= test_start, "test")
        .when(F.col(rank) >= train_end, "eval")
        .otherwise("train")
    )
    return samples.withColumn("split", part)


def split_stratified(
    df: DataFrame, key: Sequence[str], label: str, ratio: float, seed: int
) -> DataFrame:
    """Test rows per class: round(n_class * ratio), at least 1, never all."""
    small = df.groupBy(label).agg(F.count("*").alias("n")).where("n < 2").take(1)
    if small:
        raise ValueError(f"class {small[0][label]!r} has fewer than two rows")
    drawn = hash_rank(df, key, seed, "_draw", by=[label], size_name="_n")
    want = F.greatest(F.lit(1), half_even(F.col("_n") * F.lit(ratio)))
    test = F.least(want, F.col("_n") - 1)
    return drawn.withColumn(
        "split", F.when(F.col("_draw") < test, "test").otherwise("train")
    ).drop("_draw", "_n")


def group_split_table(df: DataFrame, group: str, ratio: float, seed: int) -> DataFrame:
    """``(group, rows, split)``: whole groups join test until it has enough rows.

    The group drawn last always stays in train.
    """
    counts = stage(df.groupBy(group).agg(F.count("*").alias("rows")), "groups")
    head = counts.agg(F.count("*").alias("groups"), F.sum("rows").alias("rows"),
                      F.max(hash_key(seed, [group])).alias("last")).first()
    if head["groups"] < 2:
        raise ValueError("a group split needs at least two groups")
    target = max(1, round(head["rows"] * ratio))
    drawn = hash_rank(counts, [group], seed, "_before", weight=F.col("rows"))
    test = (F.col("_before") < target) & (hash_key(seed, [group]) != F.lit(head["last"]))
    return drawn.select(group, "rows", F.when(test, "test").otherwise("train").alias("split"))


def split_group(df: DataFrame, group: str, ratio: float, seed: int) -> DataFrame:
    table = group_split_table(df, group, ratio, seed).drop("rows")
    return lookup(df, table, group, "inner")


def split_official(splits: Mapping[str, DataFrame]) -> DataFrame:
    """Keep the splits the files declare."""
    out = None
    for name, df in splits.items():
        part = df.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# --- contiguous slices -------------------------------------------------------


def slice_ids(
    df: DataFrame, pos: str, length: int, min_length: int | None = None, n: int | None = None
) -> DataFrame:
    """Number contiguous slices of ``length`` rows; a short tail joins its neighbour."""
    n = df.count() if n is None else n
    least = min_length or max(1, length // 2)
    slices = max(1, math.ceil(n / length))
    tail = n - (slices - 1) * length
    last = slices - 2 if tail < least and slices > 1 else slices - 1
    raw = F.expr(f"`{pos}` div {int(length)}")
    return df.withColumn("slice", F.least(raw, F.lit(last).cast("long")))


def slice_summary(sliced: DataFrame, pos: str, value: str) -> DataFrame:
    """Per slice: range, moments and median."""
    table = sliced.groupBy("slice").agg(
        F.min(pos).alias("start"),
        (F.max(pos) + 1).alias("stop"),
        F.count("*").alias("rows"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return table.join(grouped_quantiles(sliced, ["slice"], value, {"p50": 0.5}), "slice", "left")


_PROBS = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def distribution_summary(df: DataFrame, value: str, split: str = "split",
                         names: Sequence[str] = ("train", "eval", "test")) -> DataFrame:
    """Per split: count, moments, extremes and exact percentiles."""
    rows = []
    for name in names:
        part = df.where(F.col(split) == name)
        r = part.agg(
            F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
            F.min(value).alias("min"), F.max(value).alias("max"),
        ).first()
        if r["n"] == 0:
            rows.append((name, 0) + (None,) * 9)
            continue
        q = exact_quantiles(part, {"v": F.col(value)}, list(_PROBS.values()))["v"]
        rows.append((name, r["n"], r["mean"], r["std"], float(r["min"]), *q, float(r["max"])))
    return df.sparkSession.createDataFrame(
        rows,
        "split string, rows bigint, mean double, std double, min double, "
        + ", ".join(f"{p} double" for p in _PROBS) + ", max double",
    )


_SHARES = np.array([0.10, 0.25, 0.50, 0.75, 0.90])
SUMMARY_NUMBERS = 16_000_000  # counts of all slices together that the driver may hold
HELD_VALUES = 8_000_000  # values of the ranges in question that the driver may hold; more are read in jobs
FETCHED = 1_000_000  # counts or values that one read brings to the driver
NODES = (16, 1_024)  # least and largest number of value ranges
CHUNK = 65_536  # candidates times targets described at a time
FIRST = 16  # candidates looked up at first, then twice as many at a time
_MINE, _REST = 0, 1


class _Holdout:
    """Distribution of any union of slices, and of what it leaves, for several targets.

    All values of a target are sorted once and cut into ranges of equal depth.
    For each slice the driver holds its moments, its extremes and how many of its
    values lie in each range or below, all of which merge by addition. A
    percentile of a union is then known up to its range; :meth:`resolve` finds
    the exact value. Percentiles move little from one choice to the next, so the
    few ranges they lie in are read once and kept, up to ``HELD_VALUES`` values.
    """

    def __init__(self, sliced: DataFrame, values: Sequence[str]):
        # A slice is a number, and there are as many as its length makes them.
        known = {r["slice"]: r["n"] for r in sliced.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.slices = np.array(sorted(known), np.int64)
        self.rows = np.array([known[i] for i in self.slices.tolist()])
        targets, count = len(values), len(self.slices)
        nodes = min(NODES[1], SUMMARY_NUMBERS // max(1, targets * count))
        if nodes < NODES[0]:
            raise ValueError(f"{count} slices of {targets} targets are too many: take longer slices")
        pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(c).cast("double").alias("v")) for t, c in enumerate(values)]))
        long = sliced.select("slice", pairs.alias("p")).select("slice", "p.target", "p.v").where(F.col("v").isNotNull() & ~F.isnan("v"))
        ranked = rank_within(long, ["target"], ["v"], "rank", size_name="size")
        self.sorted = stage(ranked.select("target", "slice", "v", F.expr(f"rank * {nodes} div size").alias("node")), "sorted")
        centre = {r["target"]: r["m"] for r in self.sorted.groupBy("target").agg(F.avg("v").alias("m")).collect()}
        self.centre = np.array([centre.get(t, 0.0) for t in range(targets)])
        middle = F.get(F.array(*[F.lit(float(c)) for c in self.centre]), F.col("target"))
        off = F.col("v") - middle
        self.n, self.s, self.q = (np.zeros((count, targets)) for _ in range(3))
        self.low, self.high = np.full((count, targets), np.inf), np.full((count, targets), -np.inf)
        at = {v: i for i, v in enumerate(self.slices.tolist())}
        moments = self.sorted.groupBy("slice", "target").agg(F.count("v"), F.sum(off), F.sum(off * off), F.min("v"), F.max("v"))
        for slice_, t, *x in moments.collect():
            for table, number in zip((self.n, self.s, self.q, self.low, self.high), x, strict=True):
                table[at[slice_], t] = number
        self.upto = np.zeros((count, targets, nodes), np.int32 if self.rows.max(initial=0) < 2**31 else np.int64)
        spans = self.sorted.groupBy("target", "node").agg(F.min("v"), F.max("v"))
        self.least, self.most = np.zeros((targets, nodes)), np.zeros((targets, nodes))
        for t, node, a, b in spans.collect():
            self.least[t, node], self.most[t, node] = a, b
        cells = stage(self.sorted.groupBy("slice", "target", "node").agg(F.count(F.lit(1)).alias("n")), "cells")
        step = max(1, FETCHED // (targets * nodes))
        for first in range(0, count, step):
            part = self.slices[first:first + step].tolist()
            read = cells.where(F.col("slice").between(part[0], part[-1])).toArrow()
            slices, t, node, n = (read.column(c).to_numpy() for c in ("slice", "target", "node", "n"))
            self.upto[np.searchsorted(self.slices, slices), t, node] = n
        self.depth = self.upto.sum(axis=0, dtype=np.int64)
        np.cumsum(self.upto, axis=2, out=self.upto)
        self.whole = self.depth.cumsum(axis=1)
        self.kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.reach = np.maximum(self.high.max(axis=0, initial=-np.inf) - self.low.min(axis=0, initial=np.inf), 1e-12)

    def _plain(self, chosen: list[int], new: np.ndarray) -> list[np.ndarray]:
        """Mean, deviation and extremes with each of ``new``, by target, and of what is left: arrays (new, 4, target)."""
        member = np.zeros(len(self.slices), bool)
        member[chosen] = True
        rest = np.flatnonzero(~member)
        mine, left = ([x[m].sum(axis=0) for x in (self.n, self.s, self.q)] for m in (member, ~member))
        extremes = [[
            np.minimum(self.low[new], self.low[member].min(axis=0, initial=np.inf)),
            np.maximum(self.high[new], self.high[member].max(axis=0, initial=-np.inf)),
        ], []]
        for x in (self.low, -self.high):
            first, second = np.sort(x[rest], axis=0)[:2]
            extremes[_REST].append(np.where(x[new] == first, second, first))
        extremes[_REST][1] = -extremes[_REST][1]
        out = []
        for side, sums, sign in ((_MINE, mine, 1), (_REST, left, -1)):
            n, s, q = (total + sign * x[new] for total, x in zip(sums, (self.n, self.s, self.q), strict=True))
            mean = s / n
            out.append(np.stack([mean + self.centre, np.sqrt(np.maximum(q / n - mean * mean, 0.0)), *extremes[side]], axis=1))
        return out

    def _places(self, base: np.ndarray, sign: int, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(range, offset in it, weight) of the two neighbours of each percentile: arrays (new, target, share, 2)."""
        c, t = new[:, None, None, None], np.arange(len(base))[None, :, None, None]

        def upto(node: np.ndarray) -> np.ndarray:
            return base[t, node] + sign * self.upto[c, t, node]

        last = base.shape[1] - 1
        rank = (upto(np.full((1, 1, 1, 1), last))[..., 0] - 1) * _SHARES
        sides = np.stack([np.floor(rank), np.ceil(rank)], axis=3).astype(np.int64)
        low, high = np.zeros_like(sides), np.full_like(sides, last)
        while (low < high).any():
            middle = (low + high) // 2
            beyond = upto(middle) > sides
            low, high = np.where(beyond, low, middle + 1), np.where(beyond, middle, high)
        before = np.where(low > 0, upto(np.maximum(low - 1, 0)), 0)
        return low, sides - before, rank - np.floor(rank)

    def describe(self, chosen: list[int], taken: np.ndarray, new: np.ndarray) -> dict:
        """What is known without reading values when each of the slices ``new`` joins the ``chosen``, whose counts are ``taken``."""
        places = [self._places(taken, 1, new), self._places(self.whole - taken, -1, new)]
        t = np.arange(len(taken))[None, :, None]
        spans = [
            [x[t, node[..., 0]] * (1 - share) + x[t, node[..., 1]] * share for x in (self.least, self.most)]
            for node, _, share in places
        ]
        return {"plain": self._plain(chosen, new), "places": places, "spans": spans, "rows": self.rows[chosen].sum() + self.rows[new]}

    def _keep(self, asked: set[tuple[int, int]]) -> bool:
        """Read the ranges that are not kept yet; false if the driver may not hold them."""
        fresh = asked - self.kept.keys()
        if not fresh:
            return True
        more = sum(int(self.depth[r]) for r in fresh)
        if more + sum(int(self.depth[r]) for r in self.kept) > HELD_VALUES:
            self.kept.clear()
            fresh = asked
            if sum(int(self.depth[r]) for r in fresh) > HELD_VALUES:
                return False
        part: list[tuple[int, int]] = []
        for r in sorted(fresh):
            if part and sum(int(self.depth[x]) for x in (*part, r)) > FETCHED:
                self._read_ranges(part)
                part = []
            part.append(r)
        self._read_ranges(part)
        return True

    def _read_ranges(self, fresh: list[tuple[int, int]]) -> None:
        """Read the values of some ranges in one job."""
        wanted = F.lit(False)
        for t in sorted({t for t, _ in fresh}):
            wanted = wanted | ((F.col("target") == t) & F.col("node").isin(sorted(n for at, n in fresh if at == t)))
        read = self.sorted.where(wanted).select("target", "node", "slice", "v").toArrow()
        target, node, slices, v = (read.column(c).to_numpy() for c in read.column_names)
        order = np.lexsort((v, node, target))
        target, node, v = target[order], node[order], v[order]
        owner = np.searchsorted(self.slices, slices[order]).astype(np.int32)
        starts = np.flatnonzero(np.r_[True, (target[1:] != target[:-1]) | (node[1:] != node[:-1])])
        for a, b in zip(starts, [*starts[1:], len(v)], strict=True):
            grouped = np.argsort(owner[a:b], kind="stable").astype(np.int32)
            bounds = np.searchsorted(owner[a:b][grouped], np.arange(len(self.slices) + 1)).astype(np.int32)
            self.kept[int(target[a]), int(node[a])] = (v[a:b], owner[a:b], grouped, bounds)

    def _kept_values(self, chosen: list[int], needs: list[tuple[int, int, int, int, int]]) -> dict:
        """The values of the needed places, out of the ranges kept here."""
        held = np.zeros(len(self.slices), bool)
        held[chosen] = True
        sides: dict[tuple[int, int, int], np.ndarray] = {}
        got = {}
        for need in needs:
            new, t, side, node, offset = need
            v, owner, grouped, bounds = self.kept[t, node]
            if (t, side, node) not in sides:
                sides[t, side, node] = np.flatnonzero(held[owner] == (side == _MINE))
            others, own = sides[t, side, node], grouped[bounds[new]:bounds[new + 1]]
            at, count = np.searchsorted(others, own), np.arange(len(own))
            if side == _MINE:
                # Ranks of the slice's own values among those held.
                before = np.searchsorted(at + count, offset)
                mine = before < len(own) and at[before] + before == offset
                got[need] = v[own[before] if mine else others[offset - before]]
            else:
                # Its own values are among the others, and leave.
                got[need] = v[others[offset + np.searchsorted(at - count, offset, side="right")]]
        return got

    def _read_values(self, chosen: list[int], needs: list[tuple[int, int, int, int, int]]) -> dict:
        """The values of the needed places, one job for all of them."""
        asked = self.sorted.sparkSession.createDataFrame(
            [(new, int(self.slices[new]), t, side, node, offset) for new, t, side, node, offset in needs],
            "new int, joins long, target int, side int, node long, offset long",
        )  # at most 20 a target and candidate
        held = F.col("slice").isin([int(self.slices[c]) for c in chosen]) if chosen else F.lit(False)
        places = F.broadcast(asked.select("new", "joins", "target", "side", "node").distinct())
        rows = self.sorted.join(places, ["target", "node"])
        rows = rows.where((held | (F.col("slice") == F.col("joins"))) == (F.col("side") == _MINE))
        keys = ["new", "target", "side", "node"]
        order = Window.partitionBy(*keys).orderBy("v")
        ranked = rows.select(*keys, "v", (F.row_number().over(order) - 1).cast("long").alias("offset"))
        found = ranked.join(F.broadcast(asked), [*keys, "offset"]).collect()
        return {(r["new"], r["target"], r["side"], r["node"], r["offset"]): r["v"] for r in found}

    def resolve(self, chosen: list[int], new: np.ndarray, places: list[tuple]) -> list[np.ndarray]:
        """The exact percentiles of the described candidates ``new``: arrays (new, target, share).

        A range of one value needs no reading.
        """
        which = np.broadcast_to(new[:, None, None, None], places[_MINE][0].shape)
        targets = np.broadcast_to(np.arange(len(self.depth))[None, :, None, None], which.shape)
        needs = set()
        for side in (_MINE, _REST):
            node, offset, _ = places[side]
            open_ = self.least[targets, node] < self.most[targets, node]
            needs.update(zip(*(x[open_].tolist() for x in (which, targets)), [side] * int(open_.sum()), *(x[open_].tolist() for x in (node, offset)), strict=True))
        needs = sorted(needs)
        read = self._kept_values if self._keep({(t, node) for _, t, _, node, _ in needs}) else self._read_values
        got = read(chosen, needs)
        out = []
        for side in (_MINE, _REST):
            node, offset, share = places[side]
            exact = self.least[targets, node]
            for i in np.argwhere(exact < self.most[targets, node]):
                i = tuple(i)
                exact[i] = got[int(which[i]), int(targets[i]), side, int(node[i]), int(offset[i])]
            out.append(exact[..., 0] + (exact[..., 1] - exact[..., 0]) * share)
        return out


def choose_holdout(
    sliced: DataFrame,
    value: str | Sequence[str],
    holdout_rows: int,
    *,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    seed: int = 42,
) -> list[int]:
    """Greedy choice of holdout slices whose distribution resembles the rest.

    Each step takes the slice after which holdout and rest differ least: by mean,
    deviation, extremes and five percentiles of every target, by size, and by the
    range that the holdout covers. The driver holds counts and moments of the
    slices, and of their values only those of some ranges; they bound the cost of
    each candidate, and only those that may be the best have their exact
    percentiles looked up. Each step looks at every slice left.
    Missing values are left out. A slice that would leave either side without a
    value of some target is not taken, nor the last one. Equal costs are decided
    by a hash.
    """
    values = [value] if isinstance(value, str) else list(value)
    held = _Holdout(sliced, values)
    if not len(held.slices):
        return []
    spark = sliced.sparkSession
    draws = spark.createDataFrame([(int(i),) for i in held.slices], "slice long").select("slice", hash_key(seed, ["slice"]).alias("h"))
    draw = {r["slice"]: r["h"] for r in draws.collect()}
    chosen: list[int] = []

    def cost(d: dict, gap: np.ndarray) -> np.ndarray:
        off = np.abs(d["rows"] - holdout_rows) / max(holdout_rows, 1)
        span = (d["plain"][_MINE][:, 3] - d["plain"][_MINE][:, 2]) / held.reach
        return weights[0] * gap + weights[1] * off + weights[2] * np.maximum(0.0, 1.0 - span).mean(axis=1)

    def bounds(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = held.describe(chosen, taken, part)
        fixed = ((d["plain"][_MINE] - d["plain"][_REST]) ** 2).sum(axis=(1, 2))
        (a, b), (c, e) = d["spans"]
        near = np.maximum(0.0, np.maximum(a - e, c - b))
        far = np.maximum(np.abs(a - e), np.abs(b - c))
        return tuple(cost(d, np.sqrt(fixed + (x**2).sum(axis=(1, 2)))) for x in (near, far))

    def exact(part: np.ndarray) -> np.ndarray:
        d = held.describe(chosen, taken, part)
        mine, rest = held.resolve(chosen, part, d["places"])
        plain = ((d["plain"][_MINE] - d["plain"][_REST]) ** 2).sum(axis=(1, 2))
        return cost(d, np.sqrt(plain + ((mine - rest) ** 2).sum(axis=(1, 2))))

    step = max(1, CHUNK // len(values))
    total, taken = held.n.sum(axis=0), np.zeros_like(held.whole)
    while held.rows[chosen].sum() < holdout_rows and len(chosen) + 1 < len(held.slices):
        joined = held.n[chosen].sum(axis=0) + held.n
        legal = ~((joined == 0) | (joined == total)).any(axis=1)
        legal[chosen] = False
        new = np.flatnonzero(legal)
        if not len(new):
            break
        least, most = (np.concatenate(x) for x in zip(*(bounds(new[i:i + step]) for i in range(0, len(new), step)), strict=True))
        close = least <= most.min() + 1e-9 * abs(most.min())
        new, least, most = new[close], least[close], most[close]
        if (least < most).any() and len(new) > 1:
            # Lowest bound first, until no bound is left below the best cost found.
            order = np.argsort(least, kind="stable")
            new, least = new[order], least[order]
            costs, done, batch = np.full(len(new), np.inf), 0, min(FIRST, step)
            while done < len(new) and least[done] <= costs.min() + 1e-9 * abs(costs.min()):
                costs[done:done + batch] = exact(new[done:done + batch])
                done, batch = done + batch, min(2 * batch, step)
            least = costs
        first = min(range(len(new)), key=lambda i: (least[i], draw[int(held.slices[new[i]])]))
        chosen.append(int(new[first]))
        taken += held.upto[new[first]]
    return sorted(int(held.slices[c]) for c in chosen)


def split_dynamic(
    df: DataFrame, pos: str, value: str | Sequence[str], *, length: int, test_ratio: float = 0.2,
    eval_ratio: float = 0.0, min_length: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0), seed: int = 42,
) -> DataFrame:
    """Whole slices become holdout; its first rows are eval, the rest test. ``value`` names one target or several."""
    n = df.count()
    sliced = slice_ids(df, pos, length, min_length, n)
    goal = max(1, round(n * (eval_ratio + test_ratio)))
    chosen = choose_holdout(sliced, value, goal, weights=weights, seed=seed)
    held = F.col("slice").isin(chosen)
    evals = round(n * eval_ratio)
    if not evals:
        return sliced.withColumn("split", F.when(held, "test").otherwise("train"))
    place = running(sliced, [], pos, {"_held": ("sum", held.cast("long"))})
    part = F.when(~held, "train").when(F.col("_held") <= evals, "eval").otherwise("test")
    return place.withColumn("split", part).drop("_held")


# --- five chronological stages ----------------------------------------------

# Stage names in order, their default shares and what may be
# fitted on each.
STAGES = (
    "train",
    "estimate",
    "detection_calibration",
    "attribution_calibration",
    "frozen_normal_test",
)
STAGE_RATIOS = (0.55, 0.15, 0.10, 0.10, 0.10)
CALIBRATION_STAGES = ("detection_calibration", "attribution_calibration")
FIT_POLICY = {
    "model_parameters": "train",
    "structure_selection": "estimate",
    "monitoring_score_scaler": "estimate",
    "envelope": "estimate",
    "covariance": "estimate",
    "branch_library": "estimate",
    "state_machine": "estimate",
    "detection_quantile": "detection_calibration",
    "attribution_quantile": "attribution_calibration",
    "frozen_normal_diagnostic": "frozen_normal_test",
}
PHASE = {p: 0 for p, s in FIT_POLICY.items() if s in ("train", "estimate")} | {
    "detection_quantile": 1,
    "attribution_quantile": 2,
    "frozen_normal_diagnostic": 3,
}


@dataclass(frozen=True)
class StagePlan:
    """Half-open stage and gap ranges over row positions."""

    stages: tuple[tuple[str, int, int], ...]
    gaps: tuple[tuple[int, int], ...]
    span: int
    episode_length: int
    stride: int = 1

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [("stage", n, a, b) for n, a, b in self.stages]
        rows += [("gap", f"gap_{i}", a, b) for i, (a, b) in enumerate(self.gaps)]
        return spark.createDataFrame(rows, "kind string, name string, start bigint, stop bigint")


def plan_stages(
    n: int, *, minimum_gap: int, span: int, episode_length: int,
    ratios: Sequence[float] = STAGE_RATIOS, stride: int = 1,
) -> StagePlan:
    """Share out the rows left after four gaps, largest remainders first."""
    gap = max(minimum_gap, span)
    free = n - gap * (len(STAGES) - 1)
    shares = [free * r for r in ratios]
    sizes = [math.floor(s) for s in shares]
    by_remainder = sorted(range(len(shares)), key=lambda i: (sizes[i] - shares[i], i))
    for i in by_remainder[: free - sum(sizes)]:
        sizes[i] += 1
    if free <= 0 or min(sizes) <= 0:
        raise ValueError(f"{n} rows are too few for five stages with gaps of {gap}")
    stages, gaps, at = [], [], 0
    for i, name in enumerate(STAGES):
        stages.append((name, at, at + sizes[i]))
        at += sizes[i]
        if i < len(STAGES) - 1:
            gaps.append((at, at + gap))
            at += gap
    return StagePlan(tuple(stages), tuple(gaps), span, episode_length, stride)


def assign_stage(df: DataFrame, pos: str, plan: StagePlan) -> DataFrame:
    """Add ``stage`` and ``stage_start``; rows inside a gap get null."""
    name, start = F.lit(None).cast("string"), F.lit(None).cast("long")
    for label, a, b in plan.stages:
        inside = (F.col(pos) >= a) & (F.col(pos) < b)
        name = F.when(inside, F.lit(label)).otherwise(name)
        start = F.when(inside, F.lit(a).cast("long")).otherwise(start)
    return df.withColumn("stage", name).withColumn("stage_start", start)


def split_five_stage(df: DataFrame, pos: str, **options) -> tuple[DataFrame, StagePlan]:
    plan = plan_stages(df.count(), **options)
    return assign_stage(df, pos, plan), plan


def minimum_episodes(risk: float) -> int:
    """Episodes needed before the finite-sample rank can reach the risk level."""
    return max(1, math.ceil(1.0 / risk) - 1)


def stage_episodes(staged: DataFrame, pos: str, raw: str, plan: StagePlan) -> DataFrame:
    """Fixed-length episodes per stage with their raw range and completeness.

    An episode is complete when it has every row and no raw index is skipped;
    the unused tail of a stage shows up as an incomplete last episode.
    """
    number = F.expr(f"(`{pos}` - stage_start) div {int(plan.episode_length)}")
    grouped = staged.where(F.col("stage").isNotNull()).groupBy("stage", number.alias("stage_episode"))
    table = grouped.agg(
        F.min(pos).alias("start"), (F.max(pos) + 1).alias("stop"),
        F.min(raw).alias("raw_start"), (F.max(raw) + 1).alias("raw_stop"),
        F.count("*").alias("rows"),
    )
    complete = (F.col("rows") == plan.episode_length) & (
        F.col("raw_stop") - F.col("raw_start") == plan.episode_length
    )
    return table.withColumn("complete", complete)


def check_resolution(episodes: DataFrame, risk: float) -> DataFrame:
    """Complete episodes per calibration stage against the least number needed."""
    need = minimum_episodes(risk)
    return (
        episodes.where(F.col("stage").isin(list(CALIBRATION_STAGES)))
        .groupBy("stage")
        .agg(F.count(F.when(F.col("complete"), 1)).alias("complete_episodes"))
        .withColumn("required", F.lit(need).cast("long"))
        .withColumn("enough", F.col("complete_episodes") >= need)
    )


def stage_windows(
    staged: DataFrame, pos: str, raw: str, plan: StagePlan, episodes: DataFrame | None = None,
    *, size: int = BLOCK_ROWS,
) -> DataFrame:
    """Legal window starts: inside one stage, no raw index skipped, on the stride.

    In a calibration stage the window also lies inside one complete episode.
    """
    span = plan.span

    def frames(w):
        return {
            "_last_raw": F.lead(raw, span - 1).over(w),
            "_last_stage": F.lead("stage", span - 1).over(w),
        }

    framed = over_frames(staged, [], pos, 0, span - 1, frames, size=size)
    legal = framed.where(
        F.col("stage").isNotNull()
        & (F.col("stage") == F.col("_last_stage"))
        & (F.col("_last_raw") - F.col(raw) == span - 1)
        & ((F.col(pos) - F.col("stage_start")) % plan.stride == 0)
    ).drop("_last_raw", "_last_stage")
    number = F.expr(f"(`{pos}` - stage_start) div {int(plan.episode_length)}")
    inside = F.expr(f"(`{pos}` + {span - 1} - stage_start) div {int(plan.episode_length)}")
    legal = legal.withColumn("stage_episode", number).withColumn("_end_episode", inside)
    calibration = F.col("stage").isin(list(CALIBRATION_STAGES))
    if episodes is None:
        episodes = stage_episodes(staged, pos, raw, plan)
    whole = episodes.where("complete").select("stage", "stage_episode", F.lit(True).alias("_whole"))
    marked = lookup(legal, whole, ["stage", "stage_episode"], hot_share=None)
    kept = marked.where(
        ~calibration
        | (F.coalesce(F.col("_whole"), F.lit(False)) & (F.col("_end_episode") == F.col("stage_episode")))
    )
    return kept.select(
        "stage", F.col(pos).alias("start"), F.col(raw).alias("raw_start"),
        F.when(calibration, F.col("stage_episode")).alias("stage_episode"),
    )


def overlaps(members: DataFrame, item: str, owner: str) -> DataFrame:
    """Items claimed by more than one owner; empty when owners are disjoint.

    An item keeps only its smallest and largest owner, so no list grows.
    """
    ends = members.groupBy(item).agg(F.min(owner).alias("first_owner"), F.max(owner).alias("last_owner"))
    return ends.where(F.col("first_owner") != F.col("last_owner"))


def span_ends(spans: DataFrame, owner: str, start: str, stop: str) -> DataFrame:
    """(owner, at, step): +1 where half-open spans begin, -1 where they end.

    Spans of up to 64 positions are bits of two words of 64 positions. Bits of an
    owner's word are united before the shuffle, so spans that lie close together
    move as one row, and only the ends of what they cover together are left.
    """
    a, b = f"CAST(`{start}` AS BIGINT)", f"CAST(`{stop}` AS BIGINT)"
    bounds = spans.select(owner, F.expr(a).alias("_a"), F.expr(b).alias("_b"))
    bits = "shiftrightunsigned(-1L, CAST(64 - (_b - _a) AS INT))"
    low, word, none = "CAST(_a & 63 AS INT)", "shiftright(_a, 6)", "CAST(NULL AS BIGINT)"
    over = f"CASE WHEN {low} = 0 THEN 0L ELSE shiftrightunsigned({bits}, 64 - {low}) END"

    def row(word: str, bits: str, at: str, step: int) -> str:
        return f"named_struct('_word', {word}, '_bits', {bits}, 'at', {at}, 'step', {step})"

    short = f"array({row(word, f'shiftleft({bits}, {low})', none, 0)}, {row(f'{word} + 1', over, none, 0)})"
    long = f"array({row(none, '0L', '_a', 1)}, {row(none, '0L', '_b', -1)})"
    pieces = bounds.select(owner, F.expr(f"inline(CASE WHEN _b > _a AND _b - _a <= 64 THEN {short} ELSE {long} END)"))
    united = pieces.groupBy(owner, "_word", "at").agg(F.bit_or("_bits").alias("_bits"), F.sum("step").alias("step"))

    def edges(bits: str, at: str, step: int) -> str:
        places = f"filter(sequence(0, 63), i -> shiftright({bits}, i) & 1 = 1)"
        return f"transform({places}, i -> named_struct('at', {at}, 'step', {step}L))"

    begin = edges("_bits & ~shiftleft(_bits, 1)", "_word * 64 + i", 1)
    end = edges("_bits & ~shiftrightunsigned(_bits, 1)", "_word * 64 + i + 1", -1)
    kept = "array(named_struct('at', at, 'step', step))"
    return united.select(owner, F.expr(f"inline(CASE WHEN _word IS NULL THEN {kept} ELSE concat({begin}, {end}) END)"))


def shared_items(members: DataFrame, item: str, owner: str) -> DataFrame:
    """How many integer items two or more owners claim, one row; counts :func:`overlaps`.

    Items are bits of words, one row for an owner and word; an item without a
    value is one of its own. Items of other types are grouped as they are.
    """
    if not isinstance(members.schema[item].dataType, IntegralType):
        return overlaps(members, item, owner).agg(F.count(F.lit(1)).alias("shared"))
    place = F.col(item).cast("long")
    bit = F.coalesce(F.expr("shiftleft(1L, CAST(_item & 63 AS INT))"), F.lit(1).cast("long"))
    words = members.where(F.col(owner).isNotNull()).select(owner, place.alias("_item")).groupBy(owner, F.shiftright("_item", 6).alias("_word")).agg(
        F.bit_or(bit).alias("_bits")
    )
    earlier = Window.partitionBy("_word").orderBy(owner).rowsBetween(Window.unboundedPreceding, -1)
    twice = words.select("_word", F.col("_bits").bitwiseAND(F.bit_or("_bits").over(earlier)).alias("_twice"))
    per_word = twice.groupBy("_word").agg(F.bit_or("_twice").alias("_twice"))
    return per_word.agg(F.coalesce(F.sum(F.bit_count("_twice")), F.lit(0)).cast("long").alias("shared"))


def window_rows(windows: DataFrame, start: str, span: int) -> DataFrame:
    """Every raw row a window depends on, once per window."""
    return windows.withColumn(
        "row", F.explode(F.sequence(F.col(start), F.col(start) + F.lit(span - 1)))
    )


def shared_length(spans: DataFrame, owner: str, start: str, stop: str, *, size: int = BLOCK_ROWS) -> DataFrame:
    """How many positions the half-open spans of two or more owners cover, one row.

    Span ends are put on one line and counted, first per owner, so that its own
    overlapping spans become one, then over all owners. A long span costs two rows
    whatever its length; short ones, such as windows that overlap each other, are
    first laid over one another, see :func:`span_ends`. Ends that meet cancel.
    """
    ends = span_ends(spans, owner, start, stop)
    steps = ends.groupBy(owner, "at").agg(F.sum("step").alias("step")).where("step != 0")
    depth = running(steps, [owner], "at", {"depth": ("sum", F.col("step"))}, size=size)
    turn = (F.col("depth") > 0).cast("int") - (F.col("depth") - F.col("step") > 0).cast("int")
    turns = depth.select("at", turn.alias("step")).groupBy("at").agg(F.sum("step").alias("step"))
    owners = running(turns, [], "at", {"owners": ("sum", F.col("step"))}, size=size)
    # A stretch adds where it ends and subtracts where it begins.
    edge = (F.col("owners") - F.col("step") >= 2).cast("long") - (F.col("owners") >= 2).cast("long")
    return owners.agg(F.coalesce(F.sum(F.col("at") * edge), F.lit(0).cast("long")).alias("shared"))


def check_disjoint(staged: DataFrame, pos: str, raw: str, windows: DataFrame,
                   episodes: DataFrame, span: int) -> DataFrame:
    """Shared items per kind: positions, raw rows, window dependencies, episode rows."""
    rows = staged.where(F.col("stage").isNotNull())
    dependencies = windows.select("stage", F.col("raw_start").alias("_a"), (F.col("raw_start") + span).alias("_b"))
    kinds = {
        "positions": shared_items(rows, pos, "stage"),
        "raw_rows": shared_items(rows, raw, "stage"),
        "window_rows": shared_length(dependencies, "stage", "_a", "_b"),
        "episode_rows": shared_length(episodes.where("complete"), "stage", "start", "stop"),
    }
    out = None
    for kind, found in kinds.items():
        part = found.select(F.lit(kind).alias("kind"), "shared")
        out = part if out is None else out.unionByName(part)
    return out


def table_fingerprint(df: DataFrame, by: Sequence[str], order: Sequence[str],
                      columns: Sequence[str]) -> DataFrame:
    """Order-sensitive content hash per group, built from partial sums.

    Values count with all their digits; null, NaN and both infinities have marks
    of their own, in the order columns as well. The length of a cell stands in
    front of it, so no value can reach into the next one.

    Each row hashes its position together with its values; the sum of the row
    hashes changes when any value or any position changes and needs neither a
    sort nor a collected group.
    """
    texts = [F.col(c).cast("string") for c in [*order, *columns]]
    cells = [F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    digest = F.md5(F.concat(*cells))
    halves = [F.sum(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(38,0)")) for at in (1, 17)]
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.sha2(F.concat_ws("|", *[h.cast("string") for h in halves]), 256).alias("fingerprint"),
    )


def fit_access_audit(log: DataFrame, by: Sequence[str], seq: str, purpose: str, stage_col: str,
                     object_id: str, *, size: int = BLOCK_ROWS) -> DataFrame:
    """Violations in an access log: wrong stage, phase reopened, phase skipped, refit.

    ``by`` names one ledger, ``seq`` orders its entries. The running maxima are
    taken in blocks, so one huge ledger does not land in one task.
    """
    policy = F.create_map(*[F.lit(x) for kv in FIT_POLICY.items() for x in kv])
    phase_of = F.create_map(*[F.lit(x) for kv in PHASE.items() for x in kv])
    tagged = log.withColumn("_allowed", F.try_element_at(policy, F.col(purpose))).withColumn(
        "_phase", F.try_element_at(phase_of, F.col(purpose))
    )
    seen = running(
        tagged, by, seq,
        {
            "_top": ("max", F.col("_phase")),
            "_detection": ("max", (F.col("_phase") == 1).cast("int")),
            "_attribution": ("max", (F.col("_phase") == 2).cast("int")),
        },
        size=size,
    )
    first_use = log.groupBy(*by, object_id).agg(F.min(seq).alias("_first_seq"))
    joined = lookup(seen, first_use, [*by, object_id], "inner", salt_by=[*by, seq])
    checks = {
        "unknown_purpose": F.col("_allowed").isNull(),
        "stage_not_allowed": F.col("_allowed") != F.col(stage_col),
        "phase_reopened": F.col("_phase") < F.col("_top"),
        "detection_missing": (F.col("_phase") == 2) & (F.col("_detection") == 0),
        "attribution_missing": (F.col("_phase") == 3) & (F.col("_attribution") == 0),
        "refitted_object": F.col(seq) > F.col("_first_seq"),
    }
    found = F.filter(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]),
        lambda v: v.isNotNull(),
    )
    return joined.select(*by, seq, purpose, stage_col, object_id, F.explode(found).alias("violation"))


def latest(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Last row per key by an aggregate, without a window."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])


