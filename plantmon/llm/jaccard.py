"""N-gram Jaccard join by count-vector R-trees.

Shingles are hashed into groups; how many a document has in each group is a
point. The overlap of two documents is at most the sum of the coordinate minima
of their points, and of two boxes of points at most that of their upper corners,
so a tree of boxes finds the pairs that can reach the similarity, and only
those are verified on their shingles.

Group counts of unrelated documents of one size lie close together, so no tree
over all documents could keep them apart. Which documents meet in one tree is
therefore settled first by a rare shingle they share: two sets of similarity t
share one of the first ``n - ceil(t n) + 1`` under any common order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantmon.llm.common import WordHasher, gram_hashes, map_arrow, mixed, slices
from plantmon.llm.components import connected
from plantmon.plans.staging import stage

SHINGLE = 5
LEAST_BITS, MOST_BITS = 4, 13  # of the number of groups
LEAF = 32
BATCH_BYTES = 1_000_000
COMMON_LIMIT = 200_000
ROUNDS = 3


def shingle_sets(texts: pa.Array, words_of: WordHasher, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text.

    A text with fewer words than ``width`` has one shingle, the whole of it; one
    without words has none.
    """
    words, sizes = words_of(texts)
    grams = gram_hashes(words, width)
    sets, at = [], 0
    for n in sizes.tolist():
        if n >= width:
            found = np.sort(grams[at : at + n - width + 1])
            new = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=new[1:])
            sets.append(found[new])
        elif n:
            sets.append(mixed(gram_hashes(words[at : at + n], n) + np.uint64(n)))
        else:
            sets.append(np.empty(0, np.uint64))
        at += n
    return sets


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall into each group.

    Large sets have more groups: with a few shingles in each, the counts of
    unrelated sets differ enough for the bound to tell them apart. Groups are
    leading bits, so two neighbouring groups add up to one of a coarser vector.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (max(1, len(shingles)) - 1).bit_length() - 2))
    groups = (shingles >> np.uint64(64 - bits)).astype(np.int64)
    return np.minimum(np.bincount(groups, minlength=1 << bits), 65_535).astype(np.uint16)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts.astype(np.int32).reshape(groups, -1).sum(axis=1)


def reaches(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap of sets of sizes ``a`` and ``b`` is similar enough."""
    return 100 * overlap >= percent * (a + b - overlap)


class Roots:
    """Union-find over 0..n-1; the root is the smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.parent[max(a, b)] = min(a, b)


def vector_pairs(
    vectors: list[np.ndarray], sizes: np.ndarray, percent: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that can be similar, for count vectors of several lengths.

    One tree for each length holds its rows and those of longer vectors, folded,
    whose sizes are near enough; pairs of two longer ones are left to their own.
    """
    lengths = np.asarray([len(v) for v in vectors])
    for groups in sorted(set(lengths.tolist())):
        own = np.flatnonzero(lengths == groups)
        near = np.flatnonzero((lengths > groups) & (sizes * percent <= sizes[own].max() * 100))
        rows = np.concatenate([own, near])
        if len(rows) > 1:
            points = np.stack([folded(vectors[i], groups) for i in rows.tolist()])
            for i, j in tree_pairs(points, sizes[rows], percent):
                keep = np.minimum(i, j) < len(own)
                yield rows[i[keep]], rows[j[keep]]


def tree_pairs(points: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that can be similar, found by a packed R-tree.

    Points are sorted by size and by their largest spread, cut into leaves of
    ``LEAF``, and levels of boxes built above. A box that cannot reach another
    one is not entered. Each yield holds the pairs of two leaves.
    """
    if len(sizes) <= LEAF:
        overlap = np.minimum(points[:, None, :], points[None, :, :]).sum(axis=2)
        i, j = np.nonzero(np.triu(reaches(overlap, sizes[:, None], sizes[None, :], percent), 1))
        yield i, j
        return
    # Tiles: by size first, then by the most spread coordinate inside a tile.
    order = np.argsort(sizes, kind="stable")
    spread = int(points.var(axis=0).argmax())
    tile = LEAF * max(1, int(np.sqrt(len(order) / LEAF)))
    tiles = np.arange(len(order)) // tile
    order = order[np.lexsort((points[order, spread], tiles))]
    p, s = points[order], sizes[order]
    levels = []
    high, low_size, high_size, width = p, s, s, LEAF
    while True:
        cuts = np.arange(0, len(high), width)
        high = np.maximum.reduceat(high, cuts, axis=0)
        low_size, high_size = np.minimum.reduceat(low_size, cuts), np.maximum.reduceat(high_size, cuts)
        levels.append((high, low_size, high_size))
        if len(high) <= 1:
            break
        width = 8
    top = len(levels) - 1
    for leaf in range(len(levels[0][0])):
        box, least, most = levels[0][0][leaf], levels[0][1][leaf], levels[0][2][leaf]
        level, nodes = top, np.arange(len(levels[top][0]))
        while True:
            high, low_size, high_size = (x[nodes] for x in levels[level])
            # The likeliest pair has the smallest size one side allows, and on
            # the other side the size nearest to what the points have in common.
            floor, other = np.maximum(least, low_size), np.minimum(least, low_size)
            ceiling = np.minimum(np.where(low_size >= least, most, high_size), floor)
            sums = np.minimum(high, box).sum(axis=1)
            size = np.clip(sums, other, ceiling)
            nodes = nodes[reaches(np.minimum(sums, size), size, floor, percent)]
            if level == 0:
                break
            level -= 1
            nodes = (nodes[:, None] * 8 + np.arange(8)).ravel()
            nodes = nodes[nodes < len(levels[level][0])]
        mine = np.arange(leaf * LEAF, min((leaf + 1) * LEAF, len(p)))
        for node in nodes[nodes >= leaf].tolist():
            theirs = np.arange(node * LEAF, min((node + 1) * LEAF, len(p)))
            overlap = np.minimum(p[mine][:, None, :], p[theirs][None, :, :]).sum(axis=2)
            ok = reaches(overlap, s[mine][:, None], s[theirs][None, :], percent)
            i, j = np.nonzero(ok)
            i, j = mine[i], theirs[j]
            keep = i < j
            if keep.any():
                yield order[i[keep]], order[j[keep]]


def candidate_groups(vectors: list[np.ndarray], sizes: np.ndarray, percent: int) -> list[int]:
    """Smallest row each row can be tied to through pairs that can be similar."""
    roots = Roots(len(sizes))
    for i, j in vector_pairs(vectors, sizes, percent):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            roots.join(a, b)
    return [roots.find(i) for i in range(len(sizes))]


def linked_groups(sets: list[np.ndarray], percent: int) -> list[int]:
    """Smallest row each row is tied to through verified pairs.

    Pairs that are tied already are not verified again, so a group of near
    copies costs about one comparison a member.
    """
    sizes = np.asarray([len(x) for x in sets], np.int64)
    roots = Roots(len(sets))
    for i, j in vector_pairs([count_vector(x) for x in sets], sizes, percent):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if roots.find(a) != roots.find(b):
                overlap = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * overlap >= percent * (len(sets[a]) + len(sets[b]) - overlap):
                    roots.join(a, b)
    return [roots.find(i) for i in range(len(sets))]


def _per_batch(batch: pa.RecordBatch, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> pa.RecordBatch:
    """Run ``fn`` on parts of the batch of about BATCH_BYTES bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)) + 1
    parts = [fn(batch.slice(s.start, s.stop - s.start)) for s in slices(sizes, BATCH_BYTES)]
    return pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=None)[0] if any(
        p.num_rows for p in parts
    ) else parts[0]


def describe(source: DataFrame, width: int) -> DataFrame:
    """Per row of (id, text): set key, its 64-bit name, set size, count vector."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        words_of = WordHasher()

        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column(1), words_of, width)
            keys = [set_key(x) for x in sets]
            arrays = [
                batch.column(0), pa.array(keys, pa.binary()),
                pa.array([int.from_bytes(k[:8], "little", signed=True) for k in keys], pa.int64()),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([count_vector(x).tobytes() for x in sets], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["id", "key", "name", "size", "counts"])

        return lambda batch: _per_batch(batch, part)

    return map_arrow(source, "id long, key binary, name long, size long, counts binary", make)


class Order:
    """The common order of shingles: by value, but the listed ones last, rarer ones first.

    Passages that many documents hold would otherwise bring together more rows
    the larger the corpus is. Any order gives right results.
    """

    def __init__(self, listed: np.ndarray | None = None, times: np.ndarray | None = None):
        self.listed = np.empty(0, np.int64) if listed is None else listed
        self.times = np.empty(0, np.int64) if times is None else times
        by_value = np.argsort(self.listed)
        self.listed, self.times = self.listed[by_value], self.times[by_value]
        self.rank = np.empty(len(self.listed), np.int64)
        self.rank[np.lexsort((self.listed, self.times))] = np.arange(len(self.listed))

    def first(self, shingles: np.ndarray, percent: int) -> np.ndarray:
        """The first ``n - ceil(percent n) + 1`` of a sorted set of ``n`` shingles."""
        n = len(shingles)
        values = shingles.view(np.int64)
        if len(self.listed):
            at = np.minimum(np.searchsorted(self.listed, values), len(self.listed) - 1)
            late = self.listed[at] == values
            if late.any():
                last = values[late][np.argsort(self.rank[at[late]])]
                values = np.concatenate([values[~late], last])
        return values[: n - -(-percent * n // 100) + 1]

    def extended(self, shared: DataFrame, crowded: int, common: int) -> Order | None:
        """The order that lists more of ``shared`` (signature, n) if one not listed brings over ``crowded`` rows together."""
        often = shared.where(F.col("n") > common).orderBy(F.desc("n"), "signature").limit(COMMON_LIMIT).toArrow()
        found, times = (often.column(c).to_numpy() for c in ("signature", "n"))
        new = np.flatnonzero(~np.isin(found, self.listed))[: COMMON_LIMIT - len(self.listed)]
        if not (times[new] > crowded).any():
            return None
        return Order(np.concatenate([self.listed, found[new]]), np.concatenate([self.times, times[new]]))


def signatures(source: DataFrame, width: int, percent: int, order: Order) -> DataFrame:
    """(signature, name) rows: the first shingles of each set in the common order."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        words_of = WordHasher()

        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            heads, names = [], []
            for x in shingle_sets(batch.column(1), words_of, width):
                if not len(x):
                    continue
                heads.append(order.first(x, percent))
                names.append(np.full(len(heads[-1]), int.from_bytes(set_key(x)[:8], "little", signed=True)))
            if not heads:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["signature", "name"])
            pairs = np.unique(np.stack([np.concatenate(heads), np.concatenate(names)], axis=1), axis=0) \
                if len(set(n[0] for n in names)) < len(names) \
                else np.stack([np.concatenate(heads), np.concatenate(names)], axis=1)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))],
                names=["signature", "name"],
            )

        return lambda batch: _per_batch(batch, part)

    return map_arrow(source, "signature long, name long", make)


def blocks(source: DataFrame, width: int, percent: int, crowded: int, common: int) -> DataFrame:
    """Signatures that several sets share, one of those that bring the same sets together.

    A signature of more than ``crowded`` rows is mostly a passage that unlike
    documents hold. Where there is one, all of more than ``common`` rows go to
    the end of the order and the signatures are taken again, for some rounds: sets
    that still meet then have little else.
    """
    order = Order()
    for turn in range(ROUNDS):
        signs = signatures(source, width, percent, order)
        # Written, so that Spark can split a hot signature in the joins below.
        shared = stage(
            signs.groupBy("signature").agg(F.min("name").alias("a"), F.max("name").alias("b"), F.count(F.lit(1)).alias("n"))
            .where("a <> b").select("signature", "n"),
            "shared",
        )
        further = order.extended(shared, crowded, common) if turn + 1 < ROUNDS else None
        if further is None:
            break
        order = further
    shared = shared.select("signature")
    members = stage(signs.join(shared, "signature", "left_semi").distinct(), "members")
    prints = members.groupBy("signature").agg(
        F.count(F.lit(1)).alias("rows"), F.min("name").alias("a"), F.max("name").alias("b"),
        F.bit_xor(F.xxhash64("name")).alias("x"), F.bit_xor(F.xxhash64(F.lit("again"), "name")).alias("y"),
    )
    kept = prints.groupBy("rows", "a", "b", "x", "y").agg(F.min("signature").alias("signature"))
    return members.join(stage(kept.select("signature", "rows", "a"), "kept"), "signature")


def _groups_of(
    sorted_rows: DataFrame, keys: int, schema: str, names: list[str],
    solve: Callable[[list[list]], list[list]], limit: int = 20_000,
) -> DataFrame:
    """Apply ``solve`` to each run of rows with equal first ``keys`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        kinds: list[pa.DataType] = []

        def batch_of(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names
            )

        for batch in batches:
            kinds = [pa.int64()] * len(names)
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:keys] != key:
                    if len(held) > 1:
                        out += solve(held)
                    key, held = row[:keys], []
                    if len(out) >= limit:
                        yield batch_of(out)
                        out = []
                held.append(row)
        if len(held) > 1:
            out += solve(held)
        if out:
            yield batch_of(out)

    return sorted_rows.mapInArrow(run, schema)


def _candidates(met: DataFrame, percent: int, crowded: int) -> DataFrame:
    """Edges (a, b) that join names which can be similar, at most one a member of a block.

    In a crowded block all members are taken for candidates of each other, which
    loses none; verification is what splits large groups.
    """

    def solve(rows: list) -> list:
        sizes = np.asarray([r[2] for r in rows], np.int64)
        tied = candidate_groups([np.frombuffer(r[3], np.uint16) for r in rows], sizes, percent)
        return [(rows[i][1], rows[r][1]) for i, r in enumerate(tied) if r != i]

    small = met.where(F.col("rows") <= crowded).select("signature", "name", "size", "counts")
    small = small.repartition("signature").sortWithinPartitions("signature")
    edges = _groups_of(small, 1, "a long, b long", ["a", "b"], solve)
    large = met.where((F.col("rows") > crowded) & (F.col("name") != F.col("a"))).select(F.col("name").alias("b"), "a")
    return edges.unionByName(large)


def _verify(members: DataFrame, width: int, percent: int, chunk: int, load: int) -> DataFrame:
    """Edges between representatives that tie each cluster's linked sets together.

    ``members`` are rows (cluster, id, size, text). Clusters are cut into chunks
    of about ``chunk`` members and ``load`` shingles at most, each linked inside
    its own task. Where a cluster has several chunks, the smallest members of all
    groups meet in further rounds, as long as that ties anything. Members which
    then are outside their cluster's largest group meet every chunk of it, a
    chunk of them at a time, so no link is missed and no task holds more than two
    chunks.
    """

    def solve_on(place: int) -> Callable[[list], list]:
        def solve(rows: list) -> list:
            sets = shingle_sets(pa.array([r[place] for r in rows], pa.string()), WordHasher(), width)
            tied = linked_groups(sets, percent)
            return [(rows[i][place - 1], rows[r][place - 1]) for i, r in enumerate(tied) if r != i]

        return solve

    def link(rows: DataFrame, keys: list[str]) -> DataFrame:
        """Edges inside each group of ``rows`` (keys, id, text), as (a, b)."""
        listed = rows.select(*keys, "id", "text").repartition(*keys).sortWithinPartitions(*keys, "id")
        return _groups_of(listed, len(keys), "a long, b long", ["a", "b"], solve_on(len(keys) + 1))

    def weighed(rows: DataFrame) -> DataFrame:
        """``rows`` with ``parts``, the number of chunks their cluster needs."""
        total = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("load"))
        need = F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("load") / load), F.lit(1))
        # Hashing fills chunks unevenly, so there are twice as many.
        parts = F.when(need > 1, 2 * need).otherwise(1).cast("int")
        return rows.join(total.select("cluster", parts.alias("parts")), "cluster")

    def part(seed: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed)), "parts").cast("int")

    members = stage(weighed(members), "clusters")
    edges = link(members.where("parts = 1"), ["cluster"])
    large = members.where("parts > 1")
    if large.isEmpty():
        return edges
    links = stage(link(large.withColumn("chunk", part(0)), ["cluster", "chunk"]), "links")

    def labelled() -> DataFrame:
        groups = connected(links, "a", "b").select(F.col("node").alias("id"), "root")
        return large.join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))

    turn = 1
    while True:
        heads = weighed(labelled().where(F.col("id") == F.col("root")).drop("parts", "root"))
        more = stage(link(heads.withColumn("chunk", part(turn)), ["cluster", "chunk"]), "links")
        if more.isEmpty():
            break
        links, turn = stage(links.unionByName(more), "links"), turn + 1
    rooted = stage(labelled(), "labelled")
    per_root = rooted.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("rows"))
    main = per_root.groupBy("cluster").agg(F.max_by("root", F.struct("rows", "root")).alias("main"))
    marked = rooted.join(main, "cluster")
    outside = weighed(marked.where(F.col("root") != F.col("main")).drop("parts"))
    if outside.isEmpty():
        return edges.unionByName(links)
    turns = outside.groupBy("cluster").agg(F.max("parts").alias("turns"))
    home = marked.join(turns, "cluster").withColumn("chunk", part(0)).withColumn(
        "turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))
    )
    chunks = marked.groupBy("cluster").agg(F.max("parts").alias("chunks"))
    guests = outside.withColumn("turn", part(0)).join(chunks, "cluster").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    )
    keys = ["cluster", "chunk", "turn"]
    met = home.select(*keys, "id", "text").unionByName(guests.select(*keys, "id", "text"))
    return edges.unionByName(links).unionByName(link(met, keys))


def near_duplicate_groups(
    docs: DataFrame,
    width: int = SHINGLE,
    percent: int = 80,
    crowded: int = 2_000,
    chunk: int = 4_000,
    load: int = 4_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    common: int = 200,
) -> DataFrame:
    """Group documents linked by 100 * intersection >= ``percent`` * union.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document's set is
    its distinct shingles of ``width`` words, or the whole sequence where there
    are fewer. Returns (id, ``n_shingles``, ``component_id``), the component
    being the smallest id that links reach, for every row with an id. Texts
    without words (null ones too) have the empty set and link with nothing.
    Rows that repeat an id are one document in the links, whatever their texts;
    its texts without words stay alone. Rows without id are left out. An empty table gives an empty table. Shingles are compared by
    64-bit hashes.

    Equal sets are one class from the start. Prefix shingles bring classes
    together (two numbers a row; those that meet nobody, and those that bring
    the same classes together as another one, are dropped); in each meeting the
    R-tree of count vectors keeps the pairs that can be similar, as a forest and
    never as all pairs; the texts of the clusters so found move once, and the
    R-tree and the exact overlap verify them.
    """
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    described = stage(describe(source, width), "sets")
    filled = described.where("size > 0")
    classes = stage(
        filled.groupBy("key").agg(
            F.min("id").alias("rep"), F.first("name").alias("name"), F.first("size").alias("size"),
            F.first("counts").alias("counts"),
        ), "classes",
    )
    met = blocks(source, width, percent, crowded, common)
    met = met.join(classes.select("name", "size", "counts"), "name")
    edges = stage(_candidates(met.select("signature", "name", "rows", "a", "size", "counts"), percent, crowded), "edges")
    clusters = connected(edges, "a", "b")
    wanted = classes.join(clusters, classes["name"] == clusters["node"]).select("rep", "key", F.col("root").alias("cluster"))
    # The representative's row; a repeated id may hold several texts.
    rows = described.join(wanted, "key").where(F.col("id") == F.col("rep")).select("id", "key", "cluster", "size").distinct()
    texts = source.join(rows, "id")
    texts = _only_key(texts, width).dropDuplicates(["cluster", "id", "key"])
    links = stage(_verify(texts.select("cluster", "id", "size", "text"), width, percent, chunk, load), "links")
    links = links.select("a", "b").unionByName(_links_by_id(filled, classes))
    groups = connected(links, "a", "b").select(F.col("node").alias("rep"), "root")
    labelled = classes.select("key", "rep").join(groups, "rep", "left").select(
        "key", F.coalesce("root", "rep").alias("component_id")
    )
    out = described.join(labelled, "key", "left")
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"))


def _links_by_id(filled: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes that one id holds, by their smallest members."""
    mark = F.xxhash64("key")
    # Written, so that Spark can split the rows of a hot id in the join below.
    several = stage(
        filled.groupBy("id").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where("a <> b").select("id"), "several"
    )
    held = filled.select("id", "key").join(several, "id").distinct().join(classes.select("key", "rep"), "key")
    least = held.groupBy("id").agg(F.min("rep").alias("a"))
    return held.join(least, "id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()


def _only_key(texts: DataFrame, width: int) -> DataFrame:
    """Rows (id, text, key, cluster) whose text really has the set ``key``."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        words_of = WordHasher()

        def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column(1), words_of, width)
            same = [set_key(x) == k for x, k in zip(sets, batch.column(2).to_pylist(), strict=True)]
            return batch.filter(pa.array(same))

        return lambda batch: _per_batch(batch, keep)

    return map_arrow(
        texts.select("id", "text", "key", "cluster", "size"), "id long, text string, key binary, cluster long, size long", make
    )


def query(docs: DataFrame) -> DataFrame:
    return near_duplicate_groups(docs)


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, least(len(w), 5) || ' ' || array_to_string(w[s : s + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS s FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
), reach AS (
  SELECT doc_id, doc_id AS r FROM words
  UNION
  SELECT links.a, reach.r FROM links JOIN reach ON links.b = reach.doc_id
)
SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.r) AS component_id
FROM reach r LEFT JOIN sizes s ON r.doc_id = s.doc_id GROUP BY r.doc_id
"""
