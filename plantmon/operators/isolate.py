"""Set-valued fault isolation: which hypotheses fit an observation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmon.functions.numeric import INF
from plantmon.functions.vectors import subtract
from plantmon.operators.calibrate import conformal_status
from plantmon.operators.cell_tree import nearest_cells
from plantmon.plans import lookup, over_frames, rank_within

# The possible outcomes of an isolation.
OUTCOMES = ("Normal-compatible", "Out-of-model", "Nonunique", "Uncertified", "singleton")


def cell_score(features: Column, center: Column, scale: Column) -> Column:
    """Largest absolute deviation in units of the cell's scale."""
    off = F.zip_with(F.transform(subtract(features, center), F.abs), scale, lambda d, s: d / s)
    return F.array_max(off)


def family_scores(
    observations: DataFrame, features: str, cells: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Smallest cell score of every family, long: one row per observation and family.

    See :func:`plantmon.operators.cell_tree.nearest_cells`.
    """
    if "cell_id" not in cells.columns:
        cells = cells.withColumn("cell_id", F.monotonically_increasing_id())
    return nearest_cells(observations, features, cells, keys).drop("cell_id")


def feasible_families(scores: DataFrame, radii: DataFrame, uncertified: Sequence = ()) -> DataFrame:
    """Mark families whose score is at most their radius (closed).

    ``radii`` has ``family_id`` and ``radius``; a scored family without one fails
    the job. A family without any certified
    cell is feasible but not certified.
    """
    keys = [c for c in scores.columns if c not in ("family_id", "score")]
    table = radii.select("family_id", F.col("radius").cast("double").alias("_radius"))
    missing = F.raise_error(F.concat(F.lit("no radius for family "), F.col("family_id"))).cast("double")
    known = lookup(scores, table, "family_id").withColumn("radius", F.coalesce("_radius", missing)).drop("_radius")
    out = known.withColumn("feasible", F.col("score") <= F.col("radius")).withColumn("certified", F.lit(True))
    if uncertified:
        extra = F.explode(F.array(*[F.lit(u) for u in uncertified]))
        ids = scores.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, extra.alias("family_id"))
        out = out.unionByName(ids.select(
            *keys, "family_id", F.lit(0.0).alias("score"), F.lit(INF).alias("radius"),
            F.lit(True).alias("feasible"), F.lit(False).alias("certified"),
        ))
    return out


def cell_bounds(refinements: DataFrame, query: Sequence[str], cell: str, level: str,
                lower: str, upper: str, radius: float) -> DataFrame:
    """Outer score and unresolved cells from the latest refinement of each cell."""
    last = refinements.groupBy(*query, cell).agg(
        F.max_by(F.struct(F.col(lower).alias("lo"), F.col(upper).alias("hi")), F.col(level)).alias("b")
    )
    open_cell = (F.col("b.lo") <= radius) & (F.lit(radius) < F.col("b.hi"))
    return last.groupBy(*query).agg(
        F.min("b.lo").alias("outer_score"),
        F.count(F.when(open_cell, 1)).alias("unresolved_cells"),
        (F.min("b.lo") <= radius).alias("feasible"),
    )


def _with_predecessor(refinements: DataFrame, by: Sequence[str], level: str, lower: str, upper: str) -> tuple[DataFrame, Column]:
    """Refinements with those one level below in ``_l``, ``_lo``, ``_hi``, and whether they do not nest."""
    placed = rank_within(refinements, by, [level, lower, upper], "_at")

    def before(w):
        return {"_l": F.lag(level).over(w), "_lo": F.lag(lower).over(w), "_hi": F.lag(upper).over(w)}

    seen = over_frames(placed, by, "_at", 1, 0, before)
    return seen, (F.col(level) <= F.col("_l")) | (F.col(lower) < F.col("_lo")) | (F.col(upper) > F.col("_hi"))


def refinement_violations(refinements: DataFrame, query: Sequence[str], cell: str, level: str,
                          lower: str, upper: str) -> DataFrame:
    """Refinements that widen their predecessor's bounds or repeat its level."""
    seen, bad = _with_predecessor(refinements, [*query, cell], level, lower, upper)
    return seen.where(bad).drop("_at", "_l", "_lo", "_hi")


def merge_refinements(state: DataFrame | None, new: DataFrame, query: Sequence[str], cell: str, level: str,
                      lower: str, upper: str) -> DataFrame:
    """The latest refinement of every cell, after ``new`` ones were laid upon ``state``.

    ``state`` is what an earlier merge returned, None at the beginning; ``new`` may
    hold several levels of a cell. A level that does not rise, or bounds that
    widen, fail the job: answers given from the earlier bounds would be void.
    """
    by = [*query, cell]
    rows = new.select(*by, level, lower, upper)
    rows = rows if state is None else state.select(*by, level, lower, upper).unionByName(rows)
    seen, bad = _with_predecessor(rows, by, level, lower, upper)
    where = F.concat_ws("/", *[F.col(c).cast("string") for c in by])
    failed = F.raise_error(F.concat(F.lit("refinement does not nest: "), where)).cast("double")
    bounds = F.struct(F.when(bad, failed).otherwise(F.col(lower)).alias(lower), F.col(upper))
    last = seen.groupBy(*by).agg(F.max_by(bounds, F.col(level)).alias("_b"), F.max(level).alias(level))
    return last.select(*by, level, f"_b.{lower}", f"_b.{upper}")


def bounds_over_radii(latest: DataFrame, query: Sequence[str], lower: str, upper: str, radii: Sequence[float]) -> DataFrame:
    """:func:`cell_bounds` for many radii at once: (``query``, radius, outer_score, unresolved_cells, feasible).

    ``latest`` has one row a cell. A cell is open from its lower bound up to,
    not including, its upper one, so the cells open at a radius are those begun
    less those ended by then. Both are counted per gap between two radii, which
    combines before the shuffle, and one sweep over the gaps of a query answers
    every radius; cells are read once, however many radii there are.
    """
    points = sorted({float(r) for r in radii})
    if not points or any(r != r for r in points):
        raise ValueError("radii must be numbers, one at least")
    line = F.array(*[F.lit(r) for r in points])
    steps = F.array(*[F.lit(1 << b) for b in range(len(points).bit_length() - 1, -1, -1)])

    def gap(value: Column) -> Column:
        """Radii below ``value``, by bisection."""
        return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(line, at + s - 1) < value, at + s).otherwise(at))

    opens = F.col(lower) < F.col(upper)
    begun = F.struct(gap(F.col(lower)).alias("gap"), F.when(opens, 1).otherwise(0).alias("change"), F.col(lower).cast("double").alias("least"))
    ended = F.struct(gap(F.col(upper)).alias("gap"), F.when(opens, -1).otherwise(0).alias("change"), F.lit(None).cast("double").alias("least"))
    events = latest.select(*query, F.explode(F.array(begun, ended)).alias("_e")).select(*query, "_e.*")
    counted = events.groupBy(*query, "gap").agg(F.sum("change").alias("change"), F.min("least").alias("least"))
    whole = counted.groupBy(*query).agg(
        F.collect_list(F.struct("gap", "change")).alias("_gaps"), F.min("least").alias("outer_score")
    )  # at most one entry a gap
    at = F.posexplode(line).alias("_k", "radius")
    open_cells = F.aggregate("_gaps", F.lit(0).cast("long"), lambda n, e: n + F.when(e["gap"] <= F.col("_k"), e["change"]).otherwise(0))
    return whole.select(*query, "_gaps", "outer_score", at).select(
        *query, "radius", "outer_score", open_cells.alias("unresolved_cells"), (F.col("outer_score") <= F.col("radius")).alias("feasible"),
    )


def candidate_sets(
    feasible: DataFrame, observations: DataFrame, keys: Sequence[str], *, normal: str,
    detection_quantile: float, calibration_ready: bool = True, excess: str = "detection_excess",
) -> DataFrame:
    """Candidate families per observation as a sorted array.

    Normal stays a candidate when the detection excess is within its quantile,
    when its family is feasible, or while the calibration is unresolved.
    """
    families = feasible.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.when(F.col("feasible") & (F.col("family_id") != normal), F.col("family_id")))).alias("_faults"),
        F.max(F.when(F.col("family_id") == normal, F.col("feasible"))).alias("_normal"),
        F.min("certified").alias("certified"),
    )
    joined = observations.join(families, list(keys), "left")
    stays = (
        (F.col(excess) <= F.lit(detection_quantile))
        | F.coalesce(F.col("_normal"), F.lit(False))
        | F.lit(not calibration_ready)
    )
    faults = F.coalesce(F.col("_faults"), F.array().cast("array<string>"))
    candidates = F.when(stays, F.concat(F.array(F.lit(normal)), faults)).otherwise(faults)
    return joined.withColumn("candidates", candidates).drop("_faults", "_normal")


def isolation_outcome(df: DataFrame, normal: str, *, singleton_enabled: bool = True,
                      certified: str = "certified") -> DataFrame:
    """Outcome, reported family and certification of every candidate set."""
    c, n = F.col("candidates"), F.size("candidates")
    sure = F.coalesce(F.col(certified), F.lit(False))
    single = (n == 1) & sure & F.lit(singleton_enabled)
    outcome = (
        F.when(F.array_contains(c, normal), F.lit("Normal-compatible"))
        .when(n == 0, F.lit("Out-of-model"))
        .when(n > 1, F.lit("Nonunique"))
        .when(single, F.lit("singleton"))
        .otherwise(F.lit("Uncertified"))
    )
    out = df.withColumn("isolation_outcome", outcome)
    named = F.when(F.col("isolation_outcome") == "singleton", F.get(c, F.lit(0)))
    kept = F.when(F.col("isolation_outcome") == "singleton", F.lit(True)).when(
        F.col("isolation_outcome") == "Uncertified", F.lit(False)
    ).otherwise(sure)
    return out.withColumn("reported_family", named).withColumn("isolation_certified", kept)


def normal_calibration(scores: DataFrame, episode: Sequence[str], normal: str, beta: float,
                       alpha: float) -> DataFrame:
    """Conformal quantile of the episode maxima of the Normal family score."""
    if beta >= alpha:
        raise ValueError("beta must be smaller than alpha")
    maxima = scores.where(F.col("family_id") == normal).groupBy(*episode).agg(F.max("score").alias("max_score"))
    return conformal_status(maxima, beta)


def decision_violations(df: DataFrame, normal: str, *, score: str = "score",
                        threshold: str = "threshold", alarm: str = "alarm",
                        suppression: str = "suppression_reason") -> DataFrame:
    """Decisions that contradict themselves; expected empty."""
    over = F.col(score) > F.col(threshold)
    n = F.size("candidates")
    has_normal = F.array_contains("candidates", normal)
    unnamed = F.col("reported_family").isNull()
    sure = F.col("isolation_certified")
    outcome = F.col("isolation_outcome")
    fits = (
        F.when(outcome == "Normal-compatible", has_normal & unnamed)
        .when(outcome == "Out-of-model", (n == 0) & unnamed)
        .when(outcome == "Nonunique", (n > 1) & ~has_normal & unnamed)
        .when(outcome == "singleton", (n == 1) & ~has_normal & sure
              & F.coalesce(F.col("reported_family") == F.get("candidates", F.lit(0)), F.lit(False)))
        .when(outcome == "Uncertified", (n == 1) & ~has_normal & unnamed & ~sure)
        .otherwise(F.lit(False))
    )
    checks = {
        "alarm_without_exceedance": F.col(alarm) & ~over,
        "suppressed_without_reason": ~F.col(alarm) & over & F.col(suppression).isNull(),
        "duplicate_candidates": F.size(F.array_distinct("candidates")) != n,
        "outcome_mismatch": ~fits,
    }
    found = F.filter(
        F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in checks.items()]),
        lambda v: v.isNotNull(),
    )
    return df.withColumn("violation", F.explode(found))

