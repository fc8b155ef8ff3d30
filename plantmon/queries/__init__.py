"""Every operator as a query over the given tables, with its SQL twin."""

from plantmon.queries import (  # noqa: F401
    calibration, cleaning, files, fitting, isolation, joining, live, measures, missing, ordering,
    scoring, splitting, windowing,
)
from plantmon.queries.registry import QUERIES

__all__ = ["QUERIES"]
