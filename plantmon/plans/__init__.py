"""Physical building blocks: staging, ordered blocks, ranks, quantiles, lookups."""

from plantmon.plans.groups import fold_groups
from plantmon.plans.joins import lookup
from plantmon.plans.ordered import over_frames, positions, row_positions, running
from plantmon.plans.quantiles import exact_quantiles, grouped_quantiles
from plantmon.plans.ranking import hash_rank, rank_across, rank_within
from plantmon.plans.staging import released, stage, staging_root

__all__ = [
    "exact_quantiles",
    "fold_groups",
    "grouped_quantiles",
    "hash_rank",
    "lookup",
    "over_frames",
    "positions",
    "rank_across",
    "rank_within",
    "released",
    "row_positions",
    "running",
    "stage",
    "staging_root",
]
