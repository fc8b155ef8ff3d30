"""The trie of all conversation prefixes, by ROLLUP over positional turn-id columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantmon.plans.ranking import rank_within
from plantmon.plans.staging import stage

WIDTH = 8  # positional columns of a block
SPAN = 1_024  # blocks of a conversation whose prefixes are summed together
NODE = ["depth", "n1", "n2"]


def turn_id(role: Column, text: Column) -> Column:
    """128 bits that stand for a turn; the role's length keeps the two apart."""
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))


def _mark(lane: int, place: Column, turn: Column) -> Column:
    """What a turn at its place adds to one half of a node's name; a name is the XOR of its turns' marks.

    The lane comes first, as it seeds all that follows: the halves are independent.
    """
    return F.xxhash64(F.lit(lane), place, turn)


def ordered_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, pos from 1, tid, chars): the turns of every conversation in their order.

    Order is by turn, null first, then by turn id. A conversation of any length
    is numbered by a distributed sort, and no text takes part in it.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        turn_id(role, text).alias("tid"), F.char_length(text).cast("long").alias("chars"),
    )
    ranked = rank_within(rows, ["conv"], [F.col("turn").asc_nulls_first(), "tid"], "pos")
    return ranked.select("conv", (F.col("pos") + 1).alias("pos"), "tid", "chars")


def with_shared_heads(turns: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """Rebuild every conversation: the first ``heads`` turns of conversation ``base``, then its own after as many.

    ``base`` and ``heads`` are columns over ``conv``; ``heads`` is at most
    ``most``. A base without turns gives none. Returns (conv, pos, tid, chars),
    and for each conversation one row without position.
    """
    all_of = turns.select("conv").distinct().select("conv", base.alias("base"), heads.alias("h"))
    all_of = stage(all_of, "conversations")
    # Only the first turns of conversations that are a base, at most ``most`` of each.
    bases = all_of.select(F.col("base").alias("conv")).distinct()
    entry = F.struct("pos", "tid", "chars")
    first = turns.where(F.col("pos") <= most).join(bases, "conv", "left_semi").groupBy("conv").agg(
        F.sort_array(F.collect_list(entry)).alias("first")
    )
    started = all_of.join(first.select(F.col("conv").alias("base"), "first"), "base", "left").select(
        "conv", "h", F.slice("first", F.lit(1), F.col("h")).alias("first")
    )
    started = stage(started, "heads")
    head = started.select("conv", F.explode("first").alias("x")).select("conv", "x.pos", "x.tid", "x.chars")
    given = started.select("conv", "h", F.coalesce(F.size("first"), F.lit(0)).alias("k"))
    rest = turns.join(given, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "tid", "chars")
    bare = started.select("conv", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("tid"), F.lit(0).cast("long").alias("chars"))
    return head.unionByName(rest).unionByName(bare)


def _blocks(turns: DataFrame, width: int) -> DataFrame:
    """``width`` turns of a conversation a row, keyed by the node they continue.

    (conv, block, p1, p2, t0.., b0.., length, total, e1, e2): ``p1``, ``p2`` name
    the node at the end of the block before, ``t`` are the turn ids and ``b`` the
    conversation's code points before each of them. ``length``, ``total``, ``e1``
    and ``e2`` are turns, code points and last node of the whole conversation.
    Running values of a long conversation are taken in two levels.
    """
    here = F.col("tid").isNotNull()
    placed = turns.select(
        "conv", F.expr(f"coalesce(pos - 1, 0) div {int(width)}L").alias("block"), ((F.col("pos") - 1) % width).alias("slot"), "tid", "chars",
        *[F.when(here, _mark(lane, F.col("pos"), F.col("tid"))).alias(f"x{lane}") for lane in (1, 2)],
    )
    slots = [F.max(F.when(F.col("slot") == k, F.col(c))).alias(f"{c[0]}{k}") for c in ("tid", "chars") for k in range(width)]
    sums = {"length": "sum", "total": "sum", "e1": "bit_xor", "e2": "bit_xor"}
    blocks = stage(
        placed.groupBy("conv", "block").agg(
            *slots, F.count("tid").alias("length"), F.sum("chars").alias("total"),
            *[F.coalesce(F.bit_xor(f"x{lane}"), F.lit(0)).alias(f"e{lane}") for lane in (1, 2)],
        ).withColumn("span", F.expr(f"block div {SPAN}L")), "blocks",
    )
    earlier = [Window.unboundedPreceding, -1]

    def over(f: str, c: str, window: Window) -> Column:
        return F.coalesce(getattr(F, f)(c).over(window), F.lit(0))

    spans = blocks.groupBy("conv", "span").agg(*[getattr(F, f)(c).alias(c) for c, f in sums.items()])
    whole = Window.partitionBy("conv")
    across = whole.orderBy("span").rowsBetween(*earlier)
    spans = spans.select(
        "conv", "span", *[over(f, c, whole).alias(c) for c, f in sums.items()],
        *[over(f, c, across).alias(f"far_{c}") for c, f in sums.items() if c != "length"],
    )
    inside = Window.partitionBy("conv", "span").orderBy("block").rowsBetween(*earlier)
    near = blocks.select("*", *[over(f, c, inside).alias(f"near_{c}") for c, f in sums.items() if c != "length"])
    both = near.drop(*sums).join(spans, ["conv", "span"])
    before = F.col("near_total") + F.col("far_total")
    starts = []
    for k in range(width):
        starts.append(before.alias(f"b{k}"))
        before = before + F.coalesce(F.col(f"c{k}"), F.lit(0))
    return both.select(
        "conv", "block", *[F.col(f"near_e{n}").bitwiseXOR(F.col(f"far_e{n}")).alias(f"p{n}") for n in (1, 2)],
        *[f"t{k}" for k in range(width)], *starts, *sums,
    )


def _rolled_up(blocks: DataFrame, aggregates: dict[str, str], width: int) -> DataFrame:
    """Aggregates of every prefix: (depth, n1, n2, parent1, parent2, upto) and ``aggregates``.

    ROLLUP over the positional columns groups a block by its first 0, 1, .. turns
    at once; the grouping id tells by how many. Groups by a turn that is not there
    are no prefix, and the empty prefix of a later block is the node before it.
    ``upto`` are the code points before the last turn.
    """
    slots = [f"t{k}" for k in range(width)]
    # All members of a prefix agree on what comes before each of its turns.
    sums = [f"{v} AS {n}" for n, v in aggregates.items()] + [f"max(b{k}) AS b{k}" for k in range(width)]
    rolled = blocks.sparkSession.sql(
        f"SELECT block, p1, p2, {', '.join(slots)}, {width} - bit_count(grouping_id()) AS level, {', '.join(sums)} "
        f"FROM {{blocks}} GROUP BY block, p1, p2, ROLLUP ({', '.join(slots)})", blocks=blocks,
    )

    def at(columns: list[str]) -> Column:
        return F.coalesce(*[F.when(F.col("level") == k + 1, F.col(c)) for k, c in enumerate(columns)])

    root = (F.col("level") == 0) & (F.col("block") == 0)
    rolled = rolled.where(root | at(slots).isNotNull())

    def name(lane: int, turns: Column) -> Column:
        out = F.col(f"p{lane}")
        for k, s in enumerate(slots):
            out = out.bitwiseXOR(F.when(turns > k, _mark(lane, F.col("block") * width + (k + 1), F.col(s))).otherwise(F.lit(0)))
        return out

    return rolled.select(
        (F.col("block") * width + F.col("level")).alias("depth"), name(1, F.col("level")).alias("n1"), name(2, F.col("level")).alias("n2"),
        name(1, F.col("level") - 1).alias("parent1"), name(2, F.col("level") - 1).alias("parent2"),
        F.coalesce(at([f"b{k}" for k in range(width)]), F.lit(0)).alias("upto"), *aggregates,
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv) rows to the joined ids of each node in a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes = np.stack([batch.column(i).to_numpy() for i in range(3)])
        heads = np.flatnonzero(np.append(True, (nodes[:, 1:] != nodes[:, :-1]).any(axis=0)))
        ids = pa.ListArray.from_arrays(
            pa.array(np.append(heads, batch.num_rows).astype(np.int32)), batch.column(3).cast(pa.string())
        )
        firsts = pa.array(heads)
        yield pa.RecordBatch.from_arrays(
            [batch.column(i).take(firsts) for i in range(4)] + [pc.binary_join(ids, ",")], names=[*NODE, "first", "ids"]
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one hash a node, which reads its pieces as a stream."""
    node, state = None, None
    for batch in batches:
        done: list[tuple] = []
        columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 4)]
        for *key, ids in zip(*columns, strict=True):
            if key != node:
                if state is not None:
                    done.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip([*NODE, "ends_sha256"], zip(*done, strict=True), strict=True)), schema=_DIGESTS)
    if state is not None:
        yield pa.RecordBatch.from_pylist([dict(zip([*NODE, "ends_sha256"], (*node, state.hexdigest()), strict=True))], schema=_DIGESTS)


_DIGESTS = pa.schema([(c, pa.int64()) for c in NODE] + [("ends_sha256", pa.string())])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the hash of the ids that end at each node, ascending and joined by commas.

    A hash is a chain over its input, so a node's ids pass through one task; they
    do so as joined pieces in sorted order and as a stream, nothing is held.
    """
    order = [*NODE, "conv"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _pieces, "depth long, n1 long, n2 long, first long, ids string"
    )
    chained = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return chained.mapInArrow(_digests, "depth long, n1 long, n2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every distinct prefix of the conversations in ``turns`` (conv, pos, tid, chars), with its subtree's figures.

    Positions of a conversation count from 1 without a gap; a row without position
    makes a conversation without turns known. Returns per node ``conv_id`` (its
    smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. An empty table has no node.

    A node is owned by its smallest member, and who owns a node owns all it has
    below. So a conversation's turns fall into a shared part and one that it
    owns: with S the code points of the shared part, the code points that the
    subtree of a node saves are the sum of S over its members but the owner,
    less what lies before the node for each of them. One more ROLLUP sums this,
    and likewise the leaves, with no walk over the tree.
    """
    blocks = stage(_blocks(turns, width), "keyed")
    first = _rolled_up(blocks, {"conv": "min(conv)", "deepest": "max(length)"}, width)
    owned = stage(
        first.groupBy("conv").agg(
            F.min_by("upto", "depth").alias("shared"), F.max((F.col("deepest") == F.col("depth")).cast("long")).alias("leaf")
        ), "owned",
    )
    members = blocks.join(owned, "conv", "left").withColumns(
        {"shared": F.coalesce("shared", "total"), "leaf": F.coalesce("leaf", F.lit(0))}
    )
    sums = {"conv": "min(conv)", "n_convs": "count(1)", "shared": "sum(shared)", "own": "min_by(shared, conv)", "n_leaves": "sum(leaf)"}
    nodes = stage(_rolled_up(members, sums, width), "nodes")
    parent = {"depth": F.col("depth") - 1, "n1": F.col("parent1"), "n2": F.col("parent2")}
    children = nodes.where("depth > 0").groupBy(*[c.alias(n) for n, c in parent.items()]).agg(F.count(F.lit(1)).alias("n_children"))
    inner = stage(nodes.select(*NODE, "conv").join(children, NODE), "inner")
    ends = blocks.where(F.col("block") == F.expr(f"greatest(length - 1, 0) div {int(width)}L")).select(
        F.col("length").alias("depth"), F.col("e1").alias("n1"), F.col("e2").alias("n2"), "conv"
    )
    # A node with many children is a hot key here; both sides are written tables.
    above = inner.select(
        (F.col("depth") + 1).alias("depth"), F.col("n1").alias("parent1"), F.col("n2").alias("parent2"), F.col("conv").alias("parent_conv")
    )
    out = nodes.join(above, ["depth", "parent1", "parent2"], "left")
    out = out.join(inner.drop("conv"), NODE, "left").join(ends_digest(ends), NODE, "left")
    saved = F.col("shared") - F.col("own") - (F.col("n_convs") - 1) * F.col("upto")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(
    turns: DataFrame, base: Column | None = None, heads: Column | None = None, most: int = 0, width: int = WIDTH,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """The prefix trie of a table of turns, see :func:`prefix_trie`.

    Two turns are the same if role and text are (null counts as empty). Turns are
    ordered by turn, null first; turns of one number by a digest of role and
    text, equal rows are turns of their own. Rows without conversation take no
    part, extra columns are left out. With ``base`` and ``heads`` (columns over
    ``conv``) conversations are rebuilt first, see :func:`with_shared_heads`.
    Texts of any length count whole and do not move. An empty table has no node.
    """
    rows = stage(ordered_turns(turns, conv_col, turn_col, role_col, text_col), "ordered")
    if base is None or heads is None:
        base, heads, most = F.col("conv"), F.lit(0), 0
    return prefix_trie(with_shared_heads(rows, base, heads, most), width)


def query(conversations: DataFrame) -> DataFrame:
    conv = F.col("conv")
    return conversation_trie(conversations, conv - conv % 100, (F.crc32(conv.cast("string")) % 6).cast("int"), 5)


SQL = """
WITH RECURSIVE steps(i, k, v) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8
), crc AS (
  SELECT list(v ORDER BY i) AS tab FROM steps WHERE k = 8
), ordered AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tid) AS pos, tid, chars
  FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS chars,
               md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tid
        FROM conversations WHERE conv_id IS NOT NULL)
), convs AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM ordered) c, crc
), sizes AS (
  SELECT conv_id, count(*) AS n FROM ordered GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, o.pos, o.tid, o.chars FROM convs c JOIN ordered o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL
  SELECT c.conv_id, o.pos - c.h + least(c.h, coalesce(s.n, 0)), o.tid, o.chars
  FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND o.pos > c.h LEFT JOIN sizes s ON s.conv_id = c.base
), paths AS (
  SELECT c.conv_id, coalesce(list(r.tid ORDER BY r.pos) FILTER (WHERE r.pos IS NOT NULL), []) AS path,
         coalesce(list(r.chars ORDER BY r.pos) FILTER (WHERE r.pos IS NOT NULL), []) AS chars
  FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY c.conv_id
), prefixes AS (
  SELECT conv_id, d, path[1:d] AS path, CASE WHEN d = 0 THEN 0 ELSE chars[d] END AS chars, len(path) = d AS ends
  FROM (SELECT *, unnest(generate_series(0, len(path))) AS d FROM paths)
), nodes AS MATERIALIZED (
  SELECT d, path, min(conv_id) AS conv_id, count(*) AS n, max(chars) AS chars,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY d, path
), counted AS MATERIALIZED (
  SELECT v.*, (SELECT count(*) FROM nodes u WHERE u.d = v.d + 1 AND u.path[1:u.d - 1] = v.path) AS n_children FROM nodes v
), below AS (
  SELECT v.d, v.path, sum((u.n - 1) * u.chars) AS saved, count(*) FILTER (WHERE u.n_children = 0) AS leaves
  FROM counted v JOIN counted u ON u.d >= v.d AND u.path[1:v.d] = v.path GROUP BY v.d, v.path
)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children,
       b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM counted v JOIN below b ON b.d = v.d AND b.path = v.path
LEFT JOIN nodes p ON p.d = v.d - 1 AND p.path = v.path[1:v.d - 1]
"""
