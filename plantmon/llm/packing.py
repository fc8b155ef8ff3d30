"""Best-fit packing of tokenised documents by linear grouping.

Every document becomes pieces of at most ``capacity`` tokens. How many pieces of
each length there are is a table of at most ``capacity`` rows, whatever the
corpus holds, so the whole packing is planned on counts; the pieces then look up
their places by their rank among the pieces of equal length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantmon.llm.common import map_arrow
from plantmon.plans.staging import stage

# The split rule of byte-level vocabularies, a fixed value.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Letters, digits and blanks mean the same to both libraries up to here.
_LATIN_ONLY = re.compile("[^\x00-\u024f]")


def byte_of_symbol() -> dict[str, int]:
    """Which byte each symbol of a byte-level vocabulary stands for.

    Visible Latin-1 characters stand for themselves, the other bytes for the
    code points from 256 on, in order.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of a text, as an array of unsigned 32-bit numbers.

    ``path`` names a byte-level vocabulary file of the tokenizers library, whose
    ids count. Where that file's merges are in id order, the same ids come
    faster from its entries read as ranks. Texts that hold an added token, or
    characters on whose class the two libraries might differ, always go through
    the tokenizers library.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self.slow = path, None
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"]["".join(pair)] for pair in pairs]
        self.fast = None
        if spec["pre_tokenizer"]["type"] == "ByteLevel" and all(x < y for x, y in zip(ids, ids[1:], strict=False)):
            byte = byte_of_symbol()
            ranks = {
                bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in self.added
            }
            self.fast = tiktoken.Encoding(
                "vocabulary", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}
            )

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and not _LATIN_ONLY.search(text) and not any(t in text for t in self.added):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def tokenized_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ids).

    ``part`` and ``nth`` say which task made the piece and how many pieces of
    this length the task had made before.
    """
    kind = dict(docs.dtypes)[id_col]
    ids = ", ids array<int>" if keep_ids else ""
    schema = (
        f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long{ids}"
    )

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        encode = Encoder(tokenizer)
        end, empty = np.asarray([end_id], "<u4"), np.empty(0, "<u4")
        made = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()

        def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple] = []
            out: list[np.ndarray] = []
            source: list[int] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                tokens = np.concatenate([encode(text) if text else empty, end]).astype("<u4")
                total = len(tokens)
                head = total % capacity or capacity
                for nth, start in enumerate([0, *range(head, total, capacity)]):
                    stop = head if nth == 0 else start + capacity
                    body = tokens[start:stop]
                    rows.append((nth, start, stop - start, zlib.crc32(body.tobytes()), made[stop - start]))
                    made[stop - start] += 1
                    source.append(row)
                    if keep_ids:
                        out.append(body)
            piece, start, length, crc, nth = (np.asarray(x, np.int64) for x in zip(*rows, strict=True))
            arrays = [
                batch.column(0).take(pa.array(source)),
                pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc),
                pa.array(np.full(len(rows), part, np.int32)), pa.array(nth),
            ]
            names = [id_col, "piece", "start", "length", "ids_crc32", "part", "nth"]
            if keep_ids:
                arrays.append(pa.array([x.tolist() for x in out], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        return pieces

    return map_arrow(docs.select(id_col, text_col), schema, make)


@dataclass
class Bins:
    """Equal bins: how many there are, their lengths, the room left in each."""

    count: int
    lengths: list[int] = field(default_factory=list)
    room: int = 0


def optimal_patterns(
    sizes: list[int], demand: list[int], capacity: int, tolerance: float = 1e-3
) -> list[tuple[list[int], float]]:
    """Fractional optimum of the configuration programme by column generation.

    ``sizes`` are the few rounded lengths. Each round prices patterns with the
    current duals through an exact knapsack over the capacity and swaps the best
    one into the basis, until none is worth ``tolerance`` more than a bin.
    """
    k = len(sizes)
    need = np.asarray(demand, float)
    columns = np.diag([capacity // s for s in sizes]).astype(float)
    for _ in range(20 * k):
        inverse = np.linalg.inv(columns)
        amounts = inverse @ need
        duals = inverse.sum(axis=0)
        value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        widths = np.asarray(sizes)
        for room in range(min(sizes), capacity + 1):
            fits = widths <= room
            gain = np.where(fits, value[np.maximum(room - widths, 0)] + duals, -1.0)
            best = int(gain.argmax())
            value[room] = value[room - 1]
            if gain[best] > value[room] + 1e-12:
                value[room], choice[room] = gain[best], best
        if value[capacity] <= 1 + tolerance:
            break
        pattern, room = np.zeros(k), capacity
        while room > 0:
            if choice[room] < 0:
                room -= 1
                continue
            pattern[choice[room]] += 1
            room -= sizes[choice[room]]
        change = inverse @ pattern
        able = change > 1e-9
        ratio = np.where(able, amounts / np.where(able, change, 1), np.inf)
        columns[:, int(ratio.argmin())] = pattern
    amounts = np.linalg.inv(columns) @ need
    return [(columns[:, j].astype(int).tolist(), float(amounts[j])) for j in range(k)]


def _pull(queue: list[list[int]], count: int) -> list[list[int]]:
    """Take ``count`` pieces from a queue of (length, count) runs."""
    taken = []
    while count and queue:
        length, have = queue[0]
        use = min(have, count)
        taken.append([length, use])
        count -= use
        if use == have:
            queue.pop(0)
        else:
            queue[0][1] -= use
    return taken


def plan_packing(histogram: dict[int, int], capacity: int, groups: int = 64, small: int = 4) -> list[Bins]:
    """Plan bins for ``histogram`` (length -> count), by linear grouping.

    Lengths above ``capacity / small`` are large. They are sorted and cut into
    ``groups`` groups of equal cardinality, and each is rounded up to its group's
    largest. The configuration programme over these few sizes is solved; its
    whole patterns become bins, in which actual lengths take the rounded ones'
    places. What is left over, and all small pieces, go best-fit, longest first,
    to the fullest bin with room, else to a new one. Work depends on the number
    of lengths and groups, never on the counts.
    """
    bins = [Bins(histogram[capacity], [capacity])] if histogram.get(capacity) else []
    large = sorted((x for x, n in histogram.items() if capacity // small < x < capacity and n), reverse=True)
    total = sum(histogram[x] for x in large)
    queues: list[list[list[int]]] = []
    if total:
        runs = [[x, histogram[x]] for x in large]
        share, extra = divmod(total, min(groups, total))
        for g in range(min(groups, total)):
            queues.append(_pull(runs, share + (g < extra)))
        # Neighbouring groups with the same largest length are one size.
        merged: list[list[list[int]]] = []
        for queue in queues:
            if merged and merged[-1][0][0] == queue[0][0]:
                merged[-1] += queue
            else:
                merged.append(queue)
        queues = merged
        sizes = [queue[0][0] for queue in queues]
        demand = [sum(n for _, n in queue) for queue in queues]
        for pattern, amount in optimal_patterns(sizes, demand, capacity):
            whole = int(amount + 1e-6)
            for g, times in enumerate(pattern):
                if times:
                    whole = min(whole, sum(n for _, n in queues[g]) // times)
            if not whole:
                continue
            slots = [_pull(queues[g], whole) for g, times in enumerate(pattern) for _ in range(times)]
            while whole:
                step = min(slot[0][1] for slot in slots)
                lengths = [slot[0][0] for slot in slots]
                bins.append(Bins(step, lengths, capacity - sum(lengths)))
                for slot in slots:
                    slot[0][1] -= step
                    if not slot[0][1]:
                        slot.pop(0)
                whole -= step
    left: dict[int, int] = {x: n for x, n in histogram.items() if x <= capacity // small and n}
    for queue in queues:
        for x, n in queue:
            left[x] = left.get(x, 0) + n
    by_room: dict[int, list[Bins]] = {}
    for b in bins:
        by_room.setdefault(b.room, []).append(b)
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            room = next((r for r in range(length, capacity) if by_room.get(r)), None)
            if room is None:
                each = capacity // length
                whole, rest = divmod(count, each)
                new = [Bins(n, [length] * k, capacity - length * k) for n, k in ((whole, each), (1, rest)) if n and k]
                bins += new
                for b in new:
                    by_room.setdefault(b.room, []).append(b)
                break
            b = by_room[room].pop()
            each = min(room // length, count)
            filled = min(b.count, count // each)
            if filled < b.count:
                rest = Bins(b.count - filled, list(b.lengths), b.room)
                bins.append(rest)
                by_room[room].append(rest)
            b.count, b.lengths, b.room = filled, [*b.lengths, *[length] * each], room - each * length
            by_room.setdefault(b.room, []).append(b)
            count -= filled * each
    return bins


def place_table(bins: list[Bins]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted by the first two."""
    rows, taken, sequence = [], {}, 0
    for b in bins:
        offset = 0
        for length in b.lengths:
            rank = taken.get(length, 0)
            rows.append((length, rank, sequence, offset))
            taken[length] = rank + b.count
            offset += length
        sequence += b.count
    return np.asarray(sorted(rows), np.int64).reshape(-1, 4)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    groups: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    ``tokenizer`` is the path of a tokenizer file. A document is its ids without
    special tokens, then ``end_id``; a null or empty text is ``end_id`` alone.
    Only documents longer than ``capacity`` are cut, and only their first piece
    may be shorter. Returns one row per piece: the id column, ``piece``,
    ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset`` (and
    ``ids`` if asked for). Repeated rows and null ids are packed like any other
    row. An empty table gives an empty table.

    The pieces are staged once, and nothing else, with a running number per task
    and length. One row per task and length gives the first rank of each; the plan,
    whose size depends on ``capacity`` and ``groups`` only, goes to all tasks.
    """
    pieces = stage(
        tokenized_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids), "pieces"
    )
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.groupBy("length").agg(F.sum("rows").alias("rows")).collect()  # capacity rows at most
    places = place_table(plan_packing({r["length"]: r["rows"] for r in totals}, capacity, groups))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    # One row a task and length grows with the number of tasks: no broadcast.
    ranked = pieces.join(first.hint("merge"), ["part", "length"]).select(
        *[c for c in pieces.columns if c not in ("part", "nth")], (F.col("first") + F.col("nth")).alias("rank")
    )
    schema = T.StructType(
        [f for f in ranked.schema.fields if f.name != "rank"]
        + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        # Length in the high bits, rank in the low ones: one sorted key.
        keys = (places[:, 0] << 48) + places[:, 1]

        def place(batch: pa.RecordBatch) -> pa.RecordBatch:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(names.index("rank")).to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            arrays = [batch.column(i) for i, n in enumerate(names) if n != "rank"]
            sequence = places[at, 2] + rank - places[at, 1]
            return pa.RecordBatch.from_arrays(
                [*arrays, pa.array(sequence), pa.array(places[at, 3])],
                names=[n for n in names if n != "rank"] + ["sequence_id", "offset"],
            )

        return place

    return map_arrow(ranked, schema, make)


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
