"""Ordered work on ``(key, index)`` tables without one task per key.

A key may hold a third of all rows, so nothing here partitions a window by the
key alone. Rows are cut into blocks of ``size`` consecutive index values; since
``(key, index)`` is unique a block never exceeds ``size`` rows.

* :func:`over_frames` evaluates bounded frames; each block also receives the
  few rows of its neighbours that its frames reach into.
* :func:`running` evaluates unbounded running values in two levels: inside the
  block, plus a carry computed on the table of block totals.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from plantmon.plans.staging import stage

BLOCK_ROWS = 65_536
_BLOCK = "_block"
_HOME = "_home"
_GROUP = "_group"


def block_of(index: str, size: int = BLOCK_ROWS, shift: int = 0) -> Column:
    return F.expr(f"greatest(cast(`{index}` as bigint) + {int(shift)}L, 0L) div {int(size)}L")


def over_frames(
    df: DataFrame,
    by: Sequence[str],
    index: str,
    before: int,
    after: int,
    columns: Callable[[WindowSpec], Mapping[str, Column]],
    *,
    size: int = BLOCK_ROWS,
    keep_block: bool = False,
) -> DataFrame:
    """Add window columns that look at most ``before``/``after`` index steps away.

    ``columns`` receives a spec ordered by ``index`` and must bound its own
    frames. Index values are non-negative and unique per key. With
    ``keep_block`` the block column stays, so that a :func:`running` of the same
    size finds its rows already partitioned and sorted.
    """
    reach = F.sequence(block_of(index, size, -after), block_of(index, size, before))
    spread = df.withColumn(_BLOCK, F.explode(reach)).withColumn(
        _HOME, F.col(_BLOCK) == block_of(index, size)
    )
    spec = Window.partitionBy(*by, _BLOCK).orderBy(index)
    added = columns(spec)
    out = spread.select("*", *[c.alias(n) for n, c in added.items()])
    home = out.where(F.col(_HOME)).drop(_HOME)
    return home if keep_block else home.drop(_BLOCK)


def _total(kind: str, col: Column, index: str) -> Column:
    """What a group of rows hands on: a sum, an extreme, or its last or first value."""
    if kind in ("sum", "max", "min"):
        return getattr(F, kind)(col)
    pick = F.max_by if kind == "last" else F.min_by
    return pick(col, F.when(col.isNotNull(), F.col(index)))


def _before(kind: str, total: str, earlier: WindowSpec, later: WindowSpec) -> Column:
    """The same over all groups that come before this one."""
    if kind in ("sum", "max", "min"):
        return getattr(F, kind)(total).over(earlier)
    return F.last(total, True).over(earlier if kind == "last" else later)


def _joined(kind: str, near: Column, far: Column) -> Column:
    """The carry of the near groups, completed by that of the far ones."""
    if kind == "sum":
        return F.coalesce(near + far, near, far)
    if kind in ("max", "min"):
        return (F.greatest if kind == "max" else F.least)(near, far)
    return F.coalesce(near, far)


def _carries(totals: DataFrame, by: Sequence[str], kinds: Mapping[str, str], size: int) -> DataFrame:
    """For each block what the blocks before it hand on, as ``_c`` + the total's name.

    Blocks are grouped once more in the same way. A sparse index has as many
    blocks as rows; within a group there are at most ``size`` of them, and a
    window over a whole key sees the groups only.
    """
    rest = [Window.unboundedPreceding, -1]

    def windows(keys: Sequence[str], order: str) -> tuple[WindowSpec, WindowSpec]:
        base = Window.partitionBy(*keys)
        return base.orderBy(order).rowsBetween(*rest), base.orderBy(F.col(order).desc()).rowsBetween(*rest)

    grouped = totals.withColumn(_GROUP, F.expr(f"`{_BLOCK}` div {int(max(size, 2))}L"))
    inside = windows([*by, _GROUP], _BLOCK)
    near = grouped.select(
        *by, _GROUP, _BLOCK, *[_before(k, t, *inside).alias(f"_n{t}") for t, k in kinds.items()]
    )
    across = windows(by, _GROUP)
    tops = grouped.groupBy(*by, _GROUP).agg(*[_total(k, F.col(t), _BLOCK).alias(t) for t, k in kinds.items()])
    far = tops.select(*by, _GROUP, *[_before(k, t, *across).alias(f"_f{t}") for t, k in kinds.items()])
    both = near.join(far, [*by, _GROUP], "left")
    return both.select(
        *by, _BLOCK, *[_joined(k, F.col(f"_n{t}"), F.col(f"_f{t}")).alias(f"_c{t}") for t, k in kinds.items()]
    )


def running(
    df: DataFrame,
    by: Sequence[str],
    index: str,
    values: Mapping[str, tuple[str, Column]],
    *,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Add running values per key, inclusive of the current row.

    ``values`` maps a name to ``(kind, column)``; kind is ``sum``, ``max``,
    ``min``, ``last`` (latest non-null so far) or ``next`` (first non-null from
    here on). A block column left by :func:`over_frames` is used up.
    """
    names = list(values)
    blocked = df if _BLOCK in df.columns else df.withColumn(_BLOCK, block_of(index, size))
    inputs = {n: f"_in_{i}" for i, n in enumerate(names)}
    blocked = blocked.select("*", *[values[n][1].alias(inputs[n]) for n in names])

    forward = Window.partitionBy(*by, _BLOCK).orderBy(index).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # The reverse direction sorts descending: a frame that ends at "unbounded
    # following" would be re-read for every row.
    backward = Window.partitionBy(*by, _BLOCK).orderBy(F.col(index).desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local, totals, kinds = [], [], {}
    for n in names:
        kind, col = values[n][0], F.col(inputs[n])
        total = f"_t_{inputs[n]}"
        if kind in ("sum", "max", "min"):
            fn = getattr(F, kind)
            local.append(fn(col).over(forward).alias(f"_l_{inputs[n]}"))
        elif kind == "last":
            local.append(F.last(col, True).over(forward).alias(f"_l_{inputs[n]}"))
        elif kind == "next":
            local.append(F.last(col, True).over(backward).alias(f"_l_{inputs[n]}"))
        else:
            raise ValueError(f"unknown running kind {kind!r}")
        totals.append(_total(kind, col, index).alias(total))
        kinds[total] = kind
    inner = blocked.select("*", *local)
    carried = _carries(blocked.groupBy(*by, _BLOCK).agg(*totals), by, kinds, size)
    joined = inner.join(carried, [*by, _BLOCK], "left")
    out = []
    for n in names:
        here, carry = F.col(f"_l_{inputs[n]}"), F.col(f"_c_t_{inputs[n]}")
        kind = values[n][0]
        if kind == "sum":
            out.append(F.coalesce(here + carry, here, carry).alias(n))
        elif kind == "max":
            out.append(F.greatest(here, carry).alias(n))
        elif kind == "min":
            out.append(F.least(here, carry).alias(n))
        else:
            out.append(F.coalesce(here, carry).alias(n))
    kept = [c for c in df.columns if c not in values and c != _BLOCK]
    return joined.select(*kept, *out)


def positions(
    df: DataFrame, by: Sequence[str], index: str, name: str = "pos", *, size: int = BLOCK_ROWS
) -> DataFrame:
    """Dense 0-based position of each row within its key, in index order."""
    counted = running(df, by, index, {name: ("sum", F.lit(1).cast("long"))}, size=size)
    return counted.withColumn(name, F.col(name) - F.lit(1).cast("long"))


def gapless(df: DataFrame, by: Sequence[str], index: str) -> bool:
    """Whether the index of every key counts its rows without a hole.

    One scan of the key columns with partial aggregates, far less than numbering
    the rows.
    """
    spans = df.groupBy(*by).agg(
        (F.max(index) - F.min(index) + 1 != F.count(F.lit(1))).alias("_hole")
    )
    return not spans.where("_hole").take(1)


def row_positions(
    df: DataFrame, by: Sequence[str], index: str, name: str, *, size: int = BLOCK_ROWS
) -> DataFrame:
    """A column that counts the rows of each key, for use as an index in turn.

    A gapless index serves as it is. Otherwise rows are numbered and staged, so
    that what follows does not number them again for each of its branches.
    """
    if gapless(df, by, index):
        return df.withColumn(name, F.col(index).cast("long"))
    return stage(positions(df, by, index, name, size=size), "numbered")
