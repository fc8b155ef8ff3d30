"""Joins of fact rows with a dimension table whose size is checked first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantmon.plans.staging import stage

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 64
# A key is hot when it holds more than this share of the facts, so there are
# fewer than its inverse of them.
HOT_SHARE = 0.001
_SALT, _HOT = "_salt", "_hot"


def fits(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the whole table stays under the row and byte bounds."""
    text = F.octet_length(F.to_json(F.struct(*table.columns)))
    size = table.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(text), F.lit(0)).alias("bytes")).first()
    return size["rows"] <= rows and size["bytes"] <= BROADCAST_BYTES


def _hot_keys(facts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Keys holding more than ``share`` of the rows: fewer than ``1 / share``."""
    counts = stage(facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), "keys")
    limit = (counts.agg(F.sum("_rows")).first()[0] or 0) * share
    return stage(counts.where(F.col("_rows") > limit).select(*keys, F.lit(True).alias(_HOT)), "hot")


def lookup(
    facts: DataFrame,
    table: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    *,
    salt_by: Sequence[str] | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_share: float | None = HOT_SHARE,
) -> DataFrame:
    """Join ``facts`` with one table row per key.

    The table is staged, so its row count and bytes are known before the plan
    is chosen. Up to the bound it is broadcast and the facts do not move.
    Beyond it both sides are shuffled on the key. Keys holding a large share of
    the facts are found first; their facts are spread by a salt taken from the
    row (from ``salt_by`` if given), and only their table rows are copied once
    per salt. ``hot_share=None`` says that no key can be hot.
    """
    keys = [on] if isinstance(on, str) else list(on)
    table = stage(table, "lookup")
    if fits(table, broadcast_rows):
        return facts.join(F.broadcast(table), keys, how)
    if hot_share is None:
        return facts.join(table, keys, how)
    hot = F.broadcast(_hot_keys(facts, keys, hot_share))
    spread = list(salt_by or [c for c, t in facts.dtypes if not t.startswith("map")])
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    salted = facts.join(hot, keys, "left").withColumn(
        _SALT, F.when(F.col(_HOT), salt).otherwise(F.lit(0))
    ).drop(_HOT)
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    copies = table.join(hot, keys, "left").withColumn(
        _SALT, F.explode(F.when(F.col(_HOT), every).otherwise(F.array(F.lit(0))))
    ).drop(_HOT)
    return salted.join(copies, [*keys, _SALT], how).drop(_SALT)
