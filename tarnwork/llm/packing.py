"""Best-fit packing by large-item matching.

Texts become token ids with an end id and, if longer than a sequence, are cut. Placing
needs lengths only, and of those only how many pieces have each: at most ``capacity``
counts, whatever the input. From the counts the driver makes a plan, a list of ranges of
ranks for each length; pieces then find their place by length and rank.

The plan: pieces above a third of the capacity, of which two fit a sequence at most, are
paired from the longest down with the longest that still fits. Smaller ones, from the
longest down, go to the fullest sequence that still takes them.

Defined results. Null and empty texts are a piece of the end id alone. Repeated rows
are packed as often as they stand there. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwork.llm.chunks import library_coder, slices
from tarnwork.llm.common import written

#: Pieces of one length whose ranks are counted together, on average.
PART = 100_000


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length`` and ``ids`` (little-endian unsigned
    32-bit) of every text, cut into pieces of at most ``capacity`` ids."""
    schema = "doc_id long, piece int, start long, length long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_coder(vocabulary)
        for batch in batches:
            for begin, end in slices(batch.column("text")):
                part = batch.slice(begin, end - begin)
                ids, counts = coder(part.column("text"))
                yield _pieces(part.column("doc_id"), ids, counts, end_id, capacity)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(run, schema)


def _pieces(
    doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray, end_id: int, capacity: int
) -> pa.RecordBatch:
    ended = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
    lengths = counts + 1
    n = -(-lengths // capacity)
    row = np.repeat(np.arange(len(counts)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = piece * capacity
    length = np.minimum(lengths[row] - start, capacity)
    at = np.append(0, np.cumsum(length)) * 4
    return pa.RecordBatch.from_arrays(
        [
            doc_ids.take(pa.array(row)),
            pa.array(piece.astype(np.int32)),
            pa.array(start.astype(np.int64)),
            pa.array(length.astype(np.int64)),
            pa.Array.from_buffers(
                pa.binary(),
                len(row),
                [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ended.tobytes())],
            ),
        ],
        ["doc_id", "piece", "start", "length", "ids"],
    )


@dataclass(frozen=True)
class Range:
    """Where pieces of one length go: those of rank ``first`` to ``last`` - 1, ``each`` of
    them side by side from ``offset`` on in sequences from ``sequence`` on."""

    length: int
    first: int
    last: int
    sequence: int
    each: int
    offset: int


def plan(counts: dict[int, int], capacity: int) -> list[Range]:
    """Ranges for all pieces, given how many have each length.

    Every step uses up a length or a run of sequences with equal room, so there are in
    proportion to ``capacity`` steps, however many pieces.
    """
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("a piece must have 1 to `capacity` tokens")
    rest = {length: n for length, n in counts.items() if n}
    used = dict.fromkeys(rest, 0)
    out: list[Range] = []
    room: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences: first, how many
    rooms: list[int] = []  # its keys in order
    sequences = 0

    def put(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        out.append(Range(length, used[length], used[length] + n, sequence, each, offset))
        used[length] += n
        rest[length] -= n

    def leave(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in room:
                bisect.insort(rooms, free)
                room[free] = []
            room[free].append((first, n))

    large = sorted(length for length in rest if 3 * length > capacity)
    while large:
        length = large[-1]
        if not rest[length]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - length) - 1
        while at >= 0 and not rest[large[at]]:
            large.pop(at)
            at -= 1
        other = large[at] if at >= 0 else 0
        if other == length and rest[length] >= 2:
            n = rest[length] // 2
            put(length, 2 * n, sequences, 2, 0)
            leave(capacity - 2 * length, sequences, n)
        elif other and other != length:
            n = min(rest[length], rest[other])
            put(length, n, sequences, 1, 0)
            put(other, n, sequences, 1, length)
            leave(capacity - length - other, sequences, n)
        else:  # none fits beside it, or it is the last of its length
            second = at - 1
            while second >= 0 and not rest[large[second]]:
                second -= 1
            n = rest[length]
            if other == length and second >= 0:
                put(length, 1, sequences, 1, 0)
                put(large[second], 1, sequences, 1, length)
                leave(capacity - length - large[second], sequences, 1)
                n = 1
            else:
                put(length, n, sequences, 1, 0)
                leave(capacity - length, sequences, n)
        sequences += n

    for length in sorted((x for x in rest if 3 * x <= capacity), reverse=True):
        while rest[length]:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):  # new sequences
                each = capacity // length
                n = -(-rest[length] // each)
                leave(capacity, sequences, n)
                sequences += n
                continue
            free = rooms[at]
            first, n = room[free].pop()
            if not room[free]:
                del room[free]
                rooms.pop(at)
            each = free // length
            full = min(n, rest[length] // each)
            offset = capacity - free
            if full:
                put(length, full * each, first, each, offset)
                leave(free - each * length, first, full)
            if full < n and rest[length] < each and rest[length]:
                last = rest[length]
                put(length, last, first + full, last, offset)
                leave(free - last * length, first + full, 1)
                full += 1
            leave(free, first + full, n - full)
    return out


def placed(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (``length`` and any other columns) with ``sequence_id`` and ``offset``.

    Each piece is written with a number of its own. By it the pieces of a length are dealt to
    as many parts as their count asks for, whatever their other columns hold; ranks are
    counted within a part, and the parts' sizes are added up before.
    """
    names = pieces.columns
    row = "_row"
    while row in map(str.lower, names):
        row += "_"
    pieces = written(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranges = plan(counts, capacity)
    at: dict[int, list[Range]] = {}
    for r in ranges:
        at.setdefault(r.length, []).append(r)
    columns = {
        length: np.array([(r.first, r.sequence, r.each, r.offset) for r in rs], np.int64)
        for length, rs in at.items()
    }
    parts = F.lit(1)
    for length, n in counts.items():  # few lengths have more than a part holds
        if n > PART:
            parts = F.when(F.col("length") == length, -(-n // PART)).otherwise(parts)
    part = F.pmod(F.xxhash64(row), parts).cast("int").alias("part")
    own = pieces.select(F.col("length").alias("length"), part, F.col(row).alias("row"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("piece"))
    by_part = Window.partitionBy("length").orderBy("part")
    before = (
        own.groupBy("length", "part")
        .agg(F.count("*").alias("n"))
        .select("length", "part", (F.sum("n").over(by_part) - F.col("n")).alias("before"))
    )
    within = Window.partitionBy("length", "part").orderBy("row")
    ranked = own.withColumn("local", F.row_number().over(within) - 1).join(before, ["length", "part"])
    ranked = ranked.select("piece.*", (F.col("before") + F.col("local")).cast("long").alias(row))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != row)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column(row).to_numpy()
            sequence, offset = np.zeros((2, len(ranks)), np.int64)
            order = np.argsort(lengths, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if not len(group):
                    continue
                length = int(lengths[group[0]])
                first, start, each, fill = columns[length].T
                k = np.searchsorted(first, ranks[group], "right") - 1
                within = ranks[group] - first[k]
                sequence[group] = start[k] + within // each[k]
                offset[group] = fill[k] + within % each[k] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from pieces with ``ids`` that have been placed."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # capacity bounds them
    return packed.groupBy("sequence_id").agg(
        F.aggregate(parts, F.lit(b""), lambda all_, x: F.concat(all_, x["ids"])).alias("ids")
    )


def packed_digest(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """A row per piece with the CRC-32 of its ids in place of them, and its place."""
    pieces = tokenized(docs, vocabulary, end_id, capacity).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return placed(pieces, capacity)
