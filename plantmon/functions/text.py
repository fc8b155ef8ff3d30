"""Names, identifiers and JSON text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantmon.functions.numeric import col


def fault_id_from_name(name: str | Column) -> Column:
    """Last two digits of a file or array name, its only digit, or 0."""
    digits = F.regexp_replace(col(name), r"\D", "")
    last_two = F.when(F.length(digits) > 0, F.right(digits, F.lit(2)))
    return F.coalesce(last_two.cast("long"), F.lit(0).cast("long"))


def normal_name(c: str | Column) -> Column:
    """Trimmed lower case with ``-`` read as ``_``."""
    return F.regexp_replace(F.lower(F.trim(col(c))), "-", "_")


def canonical_json(fields: Mapping[str, str | Column]) -> Column:
    """JSON object with sorted keys and ``", "`` / ``": "`` separators.

    Values are given as JSON fragments already (numbers, quoted strings).
    """
    parts = []
    for key in sorted(fields):
        parts.append(F.concat(F.lit(f'"{key}": '), col(fields[key]).cast("string")))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def short_id(canonical: Column) -> Column:
    """First eight hex characters of the SHA-256 of a canonical text."""
    return F.substring(F.sha2(canonical, 256), 1, 8)
