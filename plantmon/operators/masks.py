"""Artificial gaps for imputation tasks, drawn by hash so that a rerun repeats them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantmon.plans import over_frames, stage
from plantmon.plans.ordered import BLOCK_ROWS

# Fixed value: the test split draws from a seed this far from the train seed.
TEST_SEED_OFFSET = 10_000
_SPACE = float(16**8)


def uniform(seed: int | Column, *parts: str | Column) -> Column:
    """Number in [0, 1) from the first eight hex digits of an md5."""
    seed_text = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws("|", seed_text, *[
        (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts
    ])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(_SPACE)


def split_seed(seed: int, split: str | None, test: str = "test") -> Column:
    if split is None:
        return F.lit(seed)
    return F.when(F.col(split) == test, F.lit(seed + TEST_SEED_OFFSET)).otherwise(F.lit(seed))


def _guard(df: DataFrame, masks: Sequence[str], keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """At least one hidden and one visible cell per split."""
    hidden = sum((F.col(m).cast("long") for m in masks[1:]), F.col(masks[0]).cast("long"))
    row = df.groupBy(*by).agg(
        F.sum(hidden).alias("hidden"), F.count("*").alias("rows"), F.min(F.struct(*keys)).alias("first")
    )
    for r in row.where((F.col("hidden") == 0) | (F.col("hidden") == F.col("rows") * len(masks))).collect():
        first = F.lit(True)
        for k in keys:
            first = first & (F.col(k) == F.lit(r["first"][k]))
        for b in by:
            first = first & (F.col(b) == F.lit(r[b]))
        df = df.withColumn(masks[0], F.when(first, F.lit(r["hidden"] == 0)).otherwise(F.col(masks[0])))
    return df


def mask_random(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], rate: float, seed: int,
    *, split: str | None = None, guard: bool = True,
) -> DataFrame:
    """Hide each cell with probability ``rate``; adds ``mask_<channel>``."""
    if not 0.0 <= rate <= 1.0:
        raise ValueError("rate lies between 0 and 1")
    draw = split_seed(seed, split)
    out = df.withColumns(
        {f"mask_{c}": uniform(draw, *keys, F.lit(c)) < F.lit(rate) for c in columns}
    )
    by = [split] if split else []
    return _guard(out, [f"mask_{c}" for c in columns], keys, by) if guard else out


def mask_block(
    df: DataFrame, by: Sequence[str], index: str, columns: Sequence[str], rate: float,
    length: int, seed: int, *, split: str | None = None, guard: bool = True, size: int = BLOCK_ROWS,
) -> DataFrame:
    """Hide stretches of ``length`` rows in one channel at a time.

    A stretch starts at each cell with the probability that hides ``rate`` of
    all cells in expectation; overlapping stretches merge. With ``guard`` at
    least one cell per split is hidden and one visible.
    """
    if length <= 0:
        raise ValueError("length is positive")
    start = 1.0 - (1.0 - rate) ** (1.0 / length)
    draw = split_seed(seed, split)
    starts = df.withColumns(
        {f"_start_{c}": (uniform(draw, *by, index, F.lit(c)) < F.lit(start)).cast("int") for c in columns}
    )

    def frames(w):
        back = w.rangeBetween(-(length - 1), 0)
        return {f"mask_{c}": F.max(f"_start_{c}").over(back) == 1 for c in columns}

    framed = over_frames(starts, by, index, length - 1, 0, frames, size=size)
    out = framed.drop(*[f"_start_{c}" for c in columns])
    keys = [*by, index]
    return _guard(out, [f"mask_{c}" for c in columns], keys, [split] if split else []) if guard else out


def _kth(rows: DataFrame, value: Column, k: int) -> tuple[int, int]:
    """The k-th smallest of a value below 2**16, and how many places it is past the smaller ones."""
    counted = rows.groupBy(value.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = counted.withColumn("_below", below).where((F.col("_below") < k) & (F.col("_below") + F.col("_n") >= k)).first()
    return held["_v"], k - held["_below"]


def _hidden_first(drawn: DataFrame, columns: Sequence[str], keys: Sequence[str], goal: int) -> dict[str, Column]:
    """For each channel, whether a cell is among the ``goal`` cells with the smallest ``_draw_``.

    The last draw is found by counting its upper and then its lower sixteen bits,
    two scans for any number of rows. Cells that share it, those of one stretch
    as a rule, go in the order of their keys.
    """
    cells = drawn.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(i).alias("_c"), F.col(f"_draw_{c}").alias("_d")) for i, c in enumerate(columns)
    ])).alias("_x")).select(*keys, "_x.*")
    if goal <= 0:
        return {c: F.lit(False) for c in columns}
    upper, left = _kth(cells, F.shiftright("_d", 16), goal)
    near = cells.where(F.shiftright("_d", 16) == upper)
    lower, left = _kth(near, F.col("_d").bitwiseAND((1 << 16) - 1), left)
    edge = (upper << 16) + lower
    last = near.where(F.col("_d") == edge).orderBy(*keys, "_c").limit(left).orderBy(*[F.desc(k) for k in [*keys, "_c"]]).first()
    types = dict(cells.dtypes)
    bound = F.struct(*[F.lit(last[k]).cast(types[k]).alias(k) for k in [*keys, "_c"]])
    out = {}
    for i, c in enumerate(columns):
        place = F.struct(*keys, F.lit(i).alias("_c"))
        out[c] = (F.col(f"_draw_{c}") < edge) | ((F.col(f"_draw_{c}") == edge) & (place <= bound))
    return out


def mask_block_exact(
    df: DataFrame, by: Sequence[str], index: str, columns: Sequence[str], rate: float,
    length: int, seed: int, *, split: str | None = None, size: int = BLOCK_ROWS,
) -> DataFrame:
    """Hide stretches of ``length`` rows in one channel at a time, ``round(rate x cells)`` cells of each split.

    Every cell may begin a stretch, in the order of its draw. A cell is hidden
    once a stretch that covers it has begun, so it carries the smallest draw of
    the ``length`` places behind it, and the cells with the smallest of these are
    hidden. Only the last stretch may be cut short. At least one cell of a split
    is hidden and one visible.
    """
    if length <= 0:
        raise ValueError("length is positive")
    if not 0.0 <= rate <= 1.0:
        raise ValueError("rate lies between 0 and 1")
    draw = split_seed(seed, split)
    starts = df.withColumns(
        {f"_start_{c}": (uniform(draw, *by, index, F.lit(c)) * F.lit(_SPACE)).cast("long") for c in columns}
    )

    def frames(w):
        back = w.rangeBetween(-(length - 1), 0)
        return {f"_draw_{c}": F.min(f"_start_{c}").over(back) for c in columns}

    keys = [*by, index]
    parted = [*by, split] if split else list(by)
    framed = over_frames(starts, parted, index, length - 1, 0, frames, size=size)
    drawn = stage(framed.drop(*[f"_start_{c}" for c in columns]), "drawn")
    sizes = drawn.groupBy(*([split] if split else [])).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a split
    masks = {c: F.lit(False) for c in columns}
    for r in sizes:
        mine = F.col(split).eqNullSafe(F.lit(r[split])) if split else F.lit(True)
        cells = r["n"] * len(columns)
        goal = min(max(1, round(cells * rate)), cells - 1)
        found = _hidden_first(drawn.where(mine), columns, keys, goal)
        masks = {c: F.when(mine, found[c]).otherwise(m) for c, m in masks.items()}
    return drawn.withColumns({f"mask_{c}": m for c, m in masks.items()}).drop(*[f"_draw_{c}" for c in columns])


def mask_channels(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], seed: int,
    all_pass: float, single: float, drop: float,
) -> DataFrame:
    """Keep-flags ``keep_<channel>`` per sample: keep all, lose one, or lose some."""
    mode = uniform(seed, *keys, F.lit("mode"))
    lost = F.floor(uniform(seed, *keys, F.lit("channel")) * F.lit(len(columns)))
    out = df.withColumn("_mode", mode).withColumn("_lost", lost)
    keep = {}
    for i, c in enumerate(columns):
        independent = uniform(seed, *keys, F.lit(c)) >= F.lit(drop)
        keep[f"keep_{c}"] = (
            F.when(F.col("_mode") < all_pass, F.lit(True))
            .when(F.col("_mode") < all_pass + single, F.col("_lost") != i)
            .otherwise(independent)
        )
    return out.withColumns(keep).drop("_mode", "_lost")


def impute_target(
    df: DataFrame, columns: Sequence[str], fill: float = 0.0, append_mask: bool = False
) -> DataFrame:
    """Corrupted value, target and observed flag per masked channel.

    With ``append_mask`` an array ``features`` holds the corrupted values
    followed by the observed flags.
    """
    out = {}
    for c in columns:
        out[f"corrupted_{c}"] = F.when(F.col(f"mask_{c}"), F.lit(float(fill))).otherwise(F.col(c))
        out[f"target_{c}"] = F.col(c)
        out[f"observed_{c}"] = ~F.col(f"mask_{c}")
    built = df.withColumns(out)
    if append_mask:
        parts = [F.col(f"corrupted_{c}") for c in columns]
        parts += [F.col(f"observed_{c}").cast("double") for c in columns]
        built = built.withColumn("features", F.array(*parts))
    return built


def mask_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    hidden = sum((F.col(f"mask_{c}").cast("long") for c in columns[1:]), F.col(f"mask_{columns[0]}").cast("long"))
    agg = df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(hidden).alias("masked_entries"))
    total = F.col("rows") * len(columns)
    return agg.select(
        *by, "rows", "masked_entries", total.alias("total_entries"),
        (F.col("masked_entries") / total).alias("actual_missing_rate"),
    )
