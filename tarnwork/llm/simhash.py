"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint has 64 bits; a bit is set if it is set in over half the XXH64
hashes of the document's three-word shingles, repeats included. Fingerprints that differ in
``RADIUS`` bits or fewer are linked.

Only distinct fingerprints are compared. A fingerprint is cut into fields of 16, 8 or 4
bits, and a tile holds up to ``TILE`` fingerprints whose fields have the same population
counts. If two fingerprints differ in r bits, their fields' counts differ by r at most in
sum, so tile pairs that differ by more are skipped: each tile meets only the tiles within
the radius, found by an equality join on the counts. In a pair of tiles all fingerprints
are compared, by numpy's exclusive-or and bit counts. More fingerprints get narrower
fields; any width gives the same links, only the work differs.

Of the links of a batch of tile pairs, those that join what the batch has not joined yet
go on: at most one per fingerprint, however many copies resemble each other.

Defined results. Null, empty or blank texts have fingerprint zero, which is linked like any
other. Fewer than three words are one shingle. Repeated rows have one fingerprint. Rows
with a null ``doc_id`` get a fingerprint, are linked with nothing, and have no component. An
empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.chunks import _bytes_of, slices
from tarnwork.llm.common import written
from tarnwork.llm.components import components

WORDS = 3
SEED = 42
RADIUS = 2
#: Fingerprints in a tile at most.
TILE = 4096
#: Bits of a field, from this many distinct fingerprints on.
FIELDS = ((0, 16), (1 << 24, 8), (1 << 30, 4))
#: Rows, and bits of shingle hashes, that are compared or added up at once.
ROWS, SHINGLES = 256, 100_000
#: Links after which those found so far are thinned out.
LINKS = 1_000_000

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The fingerprint of each text, unsigned."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    data, at = _bytes_of(texts)
    out = np.zeros(len(texts), np.uint64)
    if not len(data):
        return out
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    solid = ~_BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    first[edges] = solid[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return out
    # Words side by side, a blank after each.
    word = np.cumsum(first, dtype=np.int32)[solid] - 1
    ends = np.cumsum(np.bincount(word)) + np.arange(len(starts))
    joined = np.full(ends[-1], 32, np.uint8)
    joined[np.arange(len(word)) + word] = data[solid]
    begins = np.append(0, ends[:-1] + 1)
    bounds = np.searchsorted(starts, at)
    words = np.diff(bounds)
    some = np.flatnonzero(words)
    n = np.maximum(words[some] - WORDS + 1, 1)
    row = np.repeat(np.arange(len(some)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    low = bounds[some][row] + nth
    high = np.minimum(low + WORDS, bounds[some + 1][row]) - 1
    low, high = begins[low], ends[high]
    held = joined.tobytes()
    counts = np.zeros((len(some), 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(row), SHINGLES):
        pairs = zip(low[k : k + SHINGLES].tolist(), high[k : k + SHINGLES].tolist(), strict=True)
        hashes = np.array([digest(held[a:b], SEED) for a, b in pairs], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = row[k : k + SHINGLES]
        edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for a, b in itertools.pairwise(edges):
            counts[own[a]] += bits[a:b].sum(0, dtype=np.int64)
    majority = 2 * counts > n[:, None]
    out[some] = np.packbits(majority, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``print`` (the fingerprint as a signed number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column("text")):
                rows = batch.slice(begin, end - begin)
                found = fingerprints(rows.column("text")).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(found)], ["doc_id", "print"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, print long")


def field_counts(prints: np.ndarray, width: int) -> np.ndarray:
    """The population count of each field of ``width`` bits, in that field."""
    x = prints.view(np.uint64)
    x = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    low = np.uint64(0x3333333333333333)
    x = (x & low) + ((x >> np.uint64(2)) & low)
    if width > 4:
        x = (x + (x >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)
    if width > 8:
        x = (x + (x >> np.uint64(8))) & np.uint64(0x00FF00FF00FF00FF)
    return x.view(np.int64)


def steps(width: int, radius: int = RADIUS) -> list[int]:
    """What must be added to counts to get those of the tiles to meet, one of each pair.

    A sum that takes a field below zero or above ``width`` equals no tile's counts.
    """
    found = {0}
    for _ in range(radius):
        found |= {x + sign * (1 << at) for x in found for at in range(0, 64, width) for sign in (1, -1)}
    return sorted(x for x in found if x >= 0)


def tiles(prints: DataFrame, width: int) -> DataFrame:
    """``tile`` (its first fingerprint), ``counts`` and ``prints`` of all tiles.

    ``prints`` is one column of distinct fingerprints. They are sorted by their counts, so
    counts that many have are dealt to several tasks.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("print").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("print"), pa.array(field_counts(own, width))], ["print", "counts"]
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((0, 2), np.int64)
        for batch in batches:
            own = np.stack([batch.column(c).to_numpy() for c in ("counts", "print")], axis=1)
            rest = np.concatenate([rest, own])
            if len(rest) > TILE:  # the last counts may go on
                upto = np.searchsorted(rest[:, 0], rest[-1, 0])
                upto += (len(rest) - upto) // TILE * TILE
                yield _tiles_of(rest[:upto])
                rest = rest[upto:]
        yield _tiles_of(rest)

    keyed = prints.mapInArrow(counted, "print long, counts long")
    ordered = keyed.repartitionByRange("counts", "print").sortWithinPartitions("counts", "print")
    return ordered.mapInArrow(cut, "tile long, counts long, prints array<long>")


def _tiles_of(rows: np.ndarray) -> pa.RecordBatch:
    """Tiles of rows sorted by counts (their first column)."""
    counts, prints = rows[:, 0], rows[:, 1]
    run = np.append(0, np.flatnonzero(np.diff(counts)) + 1) if len(rows) else np.zeros(0, int)
    place = np.arange(len(rows)) - np.repeat(run, np.diff(np.append(run, len(rows))))
    starts = np.flatnonzero(place % TILE == 0)
    offsets = pa.array(np.append(starts, len(rows)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(prints[starts]),
            pa.array(counts[starts]),
            pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(prints))),
        ],
        ["tile", "counts", "prints"],
    )


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one link per node that join the same nodes as the links ``a`` to ``b``."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        open_ = low < high
        if not open_.any():
            break
        x, y = x[open_], y[open_]
        np.minimum.at(label, high[open_], low[open_])
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


def links_between(
    a: pa.ListArray, b: pa.ListArray, radius: int = RADIUS
) -> tuple[np.ndarray, np.ndarray]:
    """Links between the members of ``a[i]`` and ``b[i]`` for all i, thinned out."""
    sides = [
        (x.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(pc.list_value_length(x).to_numpy())))
        for x in (a, b)
    ]
    (left, at_left), (right, at_right) = sides
    n, m = np.diff(at_left), np.diff(at_right)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def add(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal held
        out.append((x, y))
        held += len(x)
        if held > LINKS:
            kept = forest(*(np.concatenate(z) for z in zip(*out, strict=True)))
            out[:] = [kept]
            held = len(kept[0])

    small = np.flatnonzero(n * m <= ROWS)
    for k in np.array_split(small, len(small) // 20_000 + 1):  # pairs of small tiles, at once
        size = (n * m)[k]
        pair = np.repeat(k, size)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        x = left[at_left[pair] + nth // m[pair]]
        y = right[at_right[pair] + nth % m[pair]]
        near = (np.bitwise_count(x ^ y) <= radius) & (x != y)
        add(x[near], y[near])
    for k in np.flatnonzero(n * m > ROWS):
        y = right[at_right[k] : at_right[k + 1]]
        for begin in range(at_left[k], at_left[k + 1], ROWS):
            x = left[begin : min(begin + ROWS, at_left[k + 1])]
            i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y) <= radius)
            other = x[i] != y[j]
            add(x[i[other]], y[j[other]])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = forest(*(np.concatenate(z) for z in zip(*out, strict=True)))
    return found[0].view(np.int64), found[1].view(np.int64)


def links(prints: DataFrame, width: int | None = None) -> DataFrame:
    """Links ``a``, ``b`` that join all of the distinct ``prints`` within the radius."""
    if width is None:
        n = prints.count()
        width = [bits for least, bits in FIELDS if n >= least][-1]
    held = written(tiles(prints, width), "tiles")
    meets = F.array(*map(F.lit, steps(width)))
    reach = held.select(F.col("tile").alias("a"), F.explode(meets).alias("step"), "counts").select(
        "a", "step", (F.col("counts") + F.col("step")).alias("counts")
    )
    pairs = (
        reach.join(held.select(F.col("tile").alias("b"), "counts"), "counts")
        .where((F.col("step") > 0) | (F.col("a") <= F.col("b")))
        .select("a", "b")
    )
    left = held.select(F.col("tile").alias("a"), F.col("prints").alias("left"))
    right = held.select(F.col("tile").alias("b"), F.col("prints").alias("right"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = links_between(batch.column("left"), batch.column("right"))
            yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), ["a", "b"])

    both = pairs.join(left, "a").join(right, "b").select("left", "right")
    return both.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int | None = None) -> DataFrame:
    """A row per row of ``docs``: ``doc_id``, ``print`` and ``component_id``."""
    rows = written(fingerprinted(docs), "prints")
    classes = written(
        rows.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("least")),
        "print-classes",
    )
    labels = components(links(classes.select("print"), width))
    named = classes.join(
        labels.select(F.col("node").alias("print"), "component"), "print", "left"
    ).select("print", "least", F.coalesce("component", "print").alias("component"))
    named = written(named, "print-components")
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    # Most components are one class; only the others are joined back.
    large = first.join(
        named.groupBy("component").agg(F.count("*").alias("c")).where("c > 1"), "component", "left_semi"
    )
    of_print = (
        named.join(large, "component", "left")
        .select("print", F.coalesce("component_id", "least").alias("component_id"))
    )
    return (
        rows.join(of_print, "print", "left")
        .select(
            "doc_id",
            "print",
            F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
        )
    )


def as_hex(print_: str = "print") -> Column:
    """The fingerprint as 16 hexadecimal digits in lower case."""
    return F.lower(F.lpad(F.hex(print_), 16, "0"))
