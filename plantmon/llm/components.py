"""Connected components by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantmon.plans.staging import stage


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node reached.

    Alternates two steps on the whole edge table until it is a set of stars:
    every larger neighbour is tied to the smallest one, then every smaller one.
    Each step is one shuffle and a window-free aggregate join, the number of
    rounds grows with the logarithm of the component's diameter, and only a
    count reaches the driver. Each round is written to the shared folder.
    """
    stars = stage(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        ).distinct(), "edges",
    )
    # A checksum of all edges tells whether a round changed anything.
    mark = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")))
    last = stars.agg(mark).first()[0]
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A written table, so that Spark can split the edges of a hub in the join.
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(small, "u")
        after = stage(
            tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges",
        )
        stars, before, last = after, last, after.agg(mark).first()[0]
        if last == before:
            break
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
