"""Balanced label propagation: linked documents share shards, shards stay even."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmon.plans.ranking import rank_within
from plantmon.plans.staging import stage

LEVELS = 40


def _shard_counts(links: DataFrame, labels: DataFrame, shards: int) -> DataFrame:
    """How many linked neighbours each node has in every shard, as array ``near``."""
    # Written, so that Spark can split a hot group in the join below.
    per_group = stage(
        links.join(labels, "node").groupBy("group")
        .agg(F.array(*[F.count(F.when(F.col("shard") == s, 1)) for s in range(shards)]).alias("near")),
        "groups",
    )
    spread = links.join(per_group, "group")
    return spread.groupBy("node").agg(
        F.array(*[F.sum(F.get("near", F.lit(s))) for s in range(shards)]).alias("near"), F.min("group").alias("tie")
    )


def _fullest(near: str, tie: str, shards: int) -> Column:
    """The shard with the largest count in ``near``; a hash of ``tie`` decides between equals."""
    each = [F.struct(F.get(near, F.lit(s)), F.xxhash64(tie, F.lit(s)), F.lit(s).alias("s")) for s in range(shards)]
    return F.array_max(F.array(*each))["s"]


def _proposals(near: DataFrame, labels: DataFrame, shards: int) -> DataFrame:
    """(node, shard, to, level): the shard with most neighbours, ties by a hash that a group shares."""
    # A node counts itself, so of two lone partners one stays and one follows;
    # what a move gains leaves the node itself out.
    wished = near.join(labels, "node").select(
        "node", "shard", _fullest("near", "tie", shards).alias("to"),
        (F.array_max("near") - F.get("near", F.col("shard")) + 1).alias("gain"),
    )
    level = F.least(F.floor(F.log2("gain")), F.lit(LEVELS - 1)).cast("int")
    return wished.where(F.col("to") != F.col("shard")).select("node", "shard", "to", level.alias("level"))


def admitted(
    flows: dict[tuple[int, int, int], int], sizes: list[int], quota: float
) -> dict[tuple[int, int, int], float]:
    """Which share of each flow (from, to, level) may move under the quota.

    Flows with more gain go first. What leaves a shard makes room in it, so the
    flows of a level are gone through until none can add anything.
    """
    left, room = dict(flows), [quota - s for s in sizes]
    for level in sorted({k[2] for k in flows}, reverse=True):
        moving = True
        while moving:
            moving = False
            for key in sorted(k for k in left if k[2] == level and left[k] > 0):
                amount = min(left[key], max(0, int(room[key[1]])))
                if amount:
                    left[key] -= amount
                    room[key[1]] -= amount
                    room[key[0]] += amount
                    moving = True
    return {k: 1 - left[k] / n for k, n in flows.items()}


def propagate_labels(
    nodes: DataFrame, links: DataFrame, shards: int, rounds: int = 4, slack: float = 0.25
) -> DataFrame:
    """Labels (node, shard) after ``rounds`` of moves towards neighbours.

    ``links`` holds (node, group); nodes of one group are each other's
    neighbours. Nodes start where a hash puts them. In each round every node
    asks for the shard that holds most of its neighbours; one count per pair of
    shards and power of two of the gain reaches the driver, and the quota, a
    share ``slack`` above the even size, decides how much of each may move. Who
    moves is drawn by hash. Labels are written in every round.
    """
    labels = stage(nodes.select("node", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard")), "labels")
    for turn in range(rounds):
        wished = stage(_proposals(_shard_counts(links, labels, shards), labels, shards), "wishes")
        flows = {
            (r["shard"], r["to"], r["level"]): r["count"] for r in wished.groupBy("shard", "to", "level").count().collect()
        }
        if not flows:
            break
        sizes = dict(labels.groupBy("shard").count().collect())
        quota = (1 + slack) * sum(sizes.values()) / shards
        share = admitted(flows, [sizes.get(s, 0) for s in range(shards)], quota)
        if not any(share.values()):
            break
        draw = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1_000_003)) / F.lit(1_000_003)
        table = F.create_map(
            *[F.lit(x) for (a, b, c), v in share.items() for x in (f"{a},{b},{c}", v)]
        )
        moved = wished.where(draw < table[F.concat_ws(",", "shard", "to", "level")]).select("node", "to")
        labels = stage(
            labels.join(moved, "node", "left").select("node", F.coalesce("to", "shard").alias("shard")), "labels"
        )
    return labels


def _whole(classes: dict[tuple[int, int], int], even: list[int], stay: bool) -> dict[tuple[int, int], list[int]]:
    """How many groups of each (members, home) go to each shard without any being cut.

    Large groups first: with ``stay`` those that fit remain at home, the others
    go to the fullest shard that has room for them.
    """
    room, given = list(even), {k: [0] * len(even) for k in classes}

    def put(key: tuple[int, int], to: int) -> None:
        n = min(classes[key] - sum(given[key]), room[to] // key[0])
        given[key][to] += n
        room[to] -= n * key[0]

    by_size: dict[int, list[int]] = {}
    for members, home in sorted(classes):
        by_size.setdefault(members, []).append(home)
    for members in sorted(by_size, reverse=True):
        for home in by_size[members] if stay else []:
            put((members, home), home)
        for home in by_size[members]:
            for to in sorted(range(len(even)), key=lambda s: (room[s], s)):
                put((members, home), to)
    return given


def _rows_left(classes: dict[tuple[int, int], int], given: dict[tuple[int, int], list[int]]) -> int:
    return sum(k[0] * (n - sum(given[k])) for k, n in classes.items())


def settle_groups(links: DataFrame, labels: DataFrame, shards: int, even: list[int]) -> DataFrame:
    """(group, home, whole): one shard for each group that fits one.

    A group's home holds most of its members. Groups stay there, largest first,
    while the even size allows it, and else move as one; if that leaves some
    without a place, all are dealt anew. ``whole`` is false for a group for
    which no shard has room left. The driver sees one number per group size and
    shard.
    """
    homes = stage(
        links.join(labels, "node").groupBy("group").agg(
            F.count(F.lit(1)).alias("members"),
            F.array(*[F.count(F.when(F.col("shard") == s, 1)) for s in range(shards)]).alias("near"),
        ).where(F.col("members") <= max(even))
        .select("group", "members", _fullest("near", "group", shards).alias("home")),
        "homes",
    )
    classes = {(r["members"], r["home"]): r["count"] for r in homes.groupBy("members", "home").count().collect()}
    given = _whole(classes, even, stay=True)
    if _rows_left(classes, given):
        given = min(given, _whole(classes, even, stay=False), key=lambda g: _rows_left(classes, g))
    moves = [
        (members, home, sum(to[:s]), sum(to[: s + 1]), s)
        for (members, home), to in given.items() for s in range(shards) if to[s]
    ]
    plan = links.sparkSession.createDataFrame(moves, "members long, home int, first long, stop long, to int")
    spans = plan.groupBy("members", "home").agg(F.collect_list(F.struct("first", "stop", "to")).alias("spans"))
    ranked = rank_within(homes, ["members", "home"], ["group"], "rank").join(spans, ["members", "home"], "left")
    hit = F.get(F.filter("spans", lambda x: (x["first"] <= F.col("rank")) & (F.col("rank") < x["stop"])), F.lit(0))["to"]
    return ranked.select("group", F.coalesce(hit, "home").alias("home"), hit.isNotNull().alias("whole"))


def _step(values: list[int], at: Column) -> Column:
    """``values[at]`` for a list of one number per shard."""
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), at)


def even_slots(labelled: DataFrame, shards: int, keep_first: list[Column | str]) -> DataFrame:
    """Final ``shard`` and ``slot`` with row counts at most one apart.

    Rows are ranked in their shard by ``keep_first``; a shard keeps as many as
    its even share, and the rest fill the shards below theirs, in order, so rows
    that stand together move together. Only one number per shard is collected.
    """
    sizes = dict(labelled.groupBy("shard").count().collect())
    have = [sizes.get(s, 0) for s in range(shards)]
    total = sum(have)
    even = [total // shards + (s < total % shards) for s in range(shards)]
    over = [max(0, h - e) for h, e in zip(have, even, strict=True)]
    lack = [max(0, e - h) for h, e in zip(have, even, strict=True)]
    before_over = [sum(over[:s]) for s in range(shards)]
    before_lack = [sum(lack[:s]) for s in range(shards)]
    ranked = rank_within(labelled, ["shard"], keep_first, "rank")
    share = _step(even, F.col("shard"))
    index = _step(before_over, F.col("shard")) + F.col("rank") - share
    target = reduce(
        lambda rest, s: F.when((index >= before_lack[s]) & (index < before_lack[s] + lack[s]), F.lit(s)).otherwise(rest),
        range(shards), F.lit(None).cast("int"),
    )
    moves = F.col("rank") >= share
    out = ranked.withColumn("_to", F.when(moves, target).otherwise(F.col("shard")).cast("int"))
    slot = F.when(moves, _step(have, F.col("_to")) + index - _step(before_lack, F.col("_to"))).otherwise(F.col("rank"))
    return out.withColumn("slot", slot.cast("long")).withColumn("shard", F.col("_to")).drop("_to", "rank")


def shard_documents(
    docs: DataFrame, shards: int = 8, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Put documents into shards of even row counts, equal texts together.

    Equal texts are linked; label propagation brings them together, groups it
    leaves cut move as one, and the shards are then made exactly even, taking
    documents without links first. Returns (id,
    ``size``: UTF-8 bytes plus one, ``text_crc32``, ``law`` = rows, ``shard``,
    ``slot`` from 0 without gaps, ``grown_shard`` = null). Null texts have no
    bytes, the checksum of no bytes, and no links. Every row, repeated ones and
    those without id too, gets a place of its own. A group is cut only if it is
    larger than a shard or if no shard has room for it once the groups as large
    or larger are placed (best fit). An empty table gives an empty table.

    The text is read once and leaves the scan as a digest. A group's neighbours
    are eight counts, combined before the shuffle, so a group of any size costs
    its members one row each.
    """
    text = F.col(text_col)
    base = stage(
        docs.select(
            F.monotonically_increasing_id().alias("node"), F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("group"),
        ), "documents",
    )
    linked = base.where(F.col("group").isNotNull())
    # Written, so that Spark can split a hot group in the join.
    shared = stage(linked.groupBy("group").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shared")
    links = stage(linked.select("node", "group").join(shared, "group"), "links")
    labels = propagate_labels(base, links.select("node", "group"), shards, rounds)
    n = base.count()
    even = [n // shards + (s < n % shards) for s in range(shards)]
    # Written, so that Spark can split a hot group in the join below.
    homes = stage(settle_groups(links, labels, shards, even), "settled")
    settled = links.join(homes, "group", "left").select("node", "group", "members", "home", "whole")
    known = base.drop("group").join(labels, "node").join(settled, "node", "left")
    known = known.withColumn("shard", F.coalesce("home", "shard")).drop("home")
    # Documents without links go first, then those of groups that no shard holds.
    kind = F.when(F.col("members").isNull(), 2).when(F.coalesce("whole", F.lit(False)), 0).otherwise(1)
    placed = even_slots(known, shards, [kind, F.desc_nulls_last("members"), F.col("group"), F.col("node")])
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(docs: DataFrame) -> DataFrame:
    return shard_documents(docs)
