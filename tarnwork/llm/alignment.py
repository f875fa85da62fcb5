"""Alignment of two tokenizers' ids over the same bytes.

A text, with a blank before it, is encoded by A (byte-level BPE) and by B (pieces with byte
fallback). Where a token of A and one of B end at the same byte, a group ends. All A-B pairs
of a group are linked, and an id pair's count is the number of documents that hold it.

Most groups are one token of A and the one of B with the same bytes. Their pair is known
from A's id alone (``identity``, an array over A's ids), so their counts are added up in a
vector as long as A's vocabulary in each task, and sent once. Only pairs of other groups are
sent per slice of texts, each distinct pair once with its number of documents. A pair that
is an identity pair counts in the vector wherever it is found.

Each slice is written as one row: its documents' figures, ids and distinct pairs. Counts of
the pairs go back to the slices that hold them, a row per slice and distinct pair; counts and
maxima per id of A are vectors of the vocabulary's length. So no row per link or per document
and pair is ever shuffled.

Defined results. Texts that are null or empty, or whose joined bytes of A or B differ from
the blank and the text, have no tokens: all figures are 0 and the digest is ''. Names of
special tokens in texts are text. Repeated rows, equal and null ``doc_id`` are documents of
their own. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.chunks import ChunkCoder, _bytes_of, library_coder, slices
from tarnwork.llm.common import written

#: Groups with more pairs than this are counted by their distinct ids.
LARGE = 4096
#: What joins ids in the digest's text.
WITHIN, BETWEEN, AFTER = ",", "|", ";"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Visible characters of Latin-1 stand for themselves; the other bytes, in order, are the
    characters from U+0100 on.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Table:
    """The bytes of every id of a vocabulary."""

    def __init__(self, entries: list[bytes]):
        self.entries = pa.array(entries, pa.binary())
        self.lengths = np.array([len(x) for x in entries], np.int64)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        found = self.entries.take(pa.array(ids)).buffers()[2]
        return np.frombuffer(found, np.uint8)[: self.lengths[ids].sum()] if found else np.zeros(0, np.uint8)


@functools.cache
def a_table(path: str) -> _Table:
    from tokenizers import Tokenizer

    tokenizer, chars = Tokenizer.from_file(path), byte_level()
    entries = []
    for i in range(tokenizer.get_vocab_size()):
        token = tokenizer.id_to_token(i) or ""
        known = all(c in chars for c in token)
        entries.append(bytes(chars[c] for c in token) if known else token.encode())
    return _Table(entries)


@functools.cache
def _pieces(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


@functools.cache
def b_table(path: str) -> _Table:
    model = _pieces(path)
    entries = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        entries.append(bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return _Table(entries)


def blank_cut(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks start: each text, and each blank that follows another character."""
    marks = np.zeros(len(data), bool)
    marks[1:] = (data[1:] == 32) & (data[:-1] != 32)
    marks[starts] = True
    return np.flatnonzero(marks)


@functools.cache
def b_coder(path: str) -> ChunkCoder:
    """Encodes texts that begin with a blank by their chunks, which all do.

    No piece has a blank after another character, so no merge crosses a chunk's start; a
    vocabulary that has one is refused. The library puts a blank before what it encodes:
    the one that is taken away.
    """
    model = _pieces(path)
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if any(a != "▁" and b == "▁" for a, b in zip(piece, piece[1:], strict=False)):
            raise ValueError("a piece goes on after a blank; texts cannot be cut there")
    if model.encode("a  b ", out_type=str)[-1] != "▁" or model.encode("x", out_type=str) != ["▁x"]:
        raise ValueError("the model must keep blanks and put one before a text")
    blank = [model.piece_to_id("▁")]

    def encode(chunks: list[str]) -> list[list[int]]:
        found = model.encode([c[1:] for c in chunks], num_threads=1)
        return [ids if len(c) > 1 else blank for c, ids in zip(chunks, found, strict=True)]

    return ChunkCoder(encode, cut=blank_cut)


@functools.cache
def identity(a_path: str, b_path: str) -> np.ndarray:
    """For each id of A the id of B with the same bytes, or -1; a piece before a byte."""
    model = _pieces(b_path)
    places: dict[bytes, int] = {}
    entries = b_table(b_path).entries.to_pylist()
    for i in sorted(range(len(entries)), key=model.is_byte):
        if not (model.is_control(i) or model.is_unknown(i)):
            places.setdefault(entries[i], i)
    return np.array([places.get(x, -1) if x else -1 for x in a_table(a_path).entries.to_pylist()], np.int64)


@dataclass
class Slice:
    """Some documents' tokens and links.

    ``cells`` are the linked pairs of each document, in ascending order: ``doc * width +
    pair`` (``pair`` is A's id times B's vocabulary size plus B's id), ``times`` how many
    links each stands for.
    """

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    cells: np.ndarray
    times: np.ndarray


def _spaced(texts: pa.Array) -> pa.Array:
    """The texts with a blank before each; null stays empty."""
    some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
    return pc.if_else(some, pc.binary_join_element_wise(" ", texts, ""), "")


def _wrong(ids: np.ndarray, counts: np.ndarray, table: _Table, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts' joined token bytes differ from their own."""
    ends = np.append(0, np.cumsum(table.lengths[ids]))[np.append(0, np.cumsum(counts))]
    own, right = np.diff(ends), np.diff(at)
    wrong = own != right
    joined = table.joined(ids)
    if not wrong.any() and np.array_equal(joined, data):
        return wrong
    for i in np.flatnonzero(~wrong):
        wrong[i] = not np.array_equal(joined[ends[i] : ends[i + 1]], data[at[i] : at[i + 1]])
    return wrong


def aligned(texts: pa.Array, a_path: str, b_path: str) -> Slice:
    """The tokens and links of some texts."""
    tables = a_table(a_path), b_table(b_path)
    spaced = _spaced(texts.cast(pa.string()))
    data, at = _bytes_of(spaced)
    (a, in_a), (b, in_b) = library_coder(a_path)(spaced), b_coder(b_path)(spaced)
    a, b = a.astype(np.int64), b.astype(np.int64)
    wrong = _wrong(a, in_a, tables[0], data, at) | _wrong(b, in_b, tables[1], data, at)
    if wrong.any():
        a, b = a[np.repeat(~wrong, in_a)], b[np.repeat(~wrong, in_b)]
        in_a, in_b = np.where(wrong, 0, in_a), np.where(wrong, 0, in_b)
    ends_a, ends_b = np.cumsum(tables[0].lengths[a]), np.cumsum(tables[1].lengths[b])
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    m, n = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
    doc_a, doc_b = (np.repeat(np.arange(len(texts)), x) for x in (in_a, in_b))
    first_a, first_b = np.cumsum(m) - m, np.cumsum(n) - n
    doc = doc_a[first_a] if len(common) else np.zeros(0, np.int64)
    links = np.bincount(doc, m * n, minlength=len(texts)).astype(np.int64) if len(common) else np.zeros(len(texts), np.int64)
    cells, times = _cells(a, b, doc, m, n, first_a, first_b, len(tables[0].lengths), len(tables[1].lengths))
    return Slice(
        in_a,
        in_b,
        np.bincount(doc, minlength=len(texts)),
        links,
        _digests(a, b, group_a, group_b, m, n, first_a, first_b, doc, len(texts), tables),
        cells,
        times,
    )


def _cells(a, b, doc, m, n, first_a, first_b, size_a: int, size_b: int) -> tuple[np.ndarray, np.ndarray]:
    width = size_a * size_b
    size = m * n
    usual = np.flatnonzero(size <= LARGE)
    s = size[usual]
    ends = np.cumsum(s)
    group = np.repeat(usual, s)
    nth = np.arange(len(group)) - np.repeat(ends - s, s)
    i = first_a[group] + nth // n[group]
    j = first_b[group] + nth % n[group]
    cells, times = np.unique(doc[group] * width + a[i] * size_b + b[j], return_counts=True)
    more = []
    for g in np.flatnonzero(size > LARGE):
        x, of_x = np.unique(a[first_a[g] : first_a[g] + m[g]], return_counts=True)
        y, of_y = np.unique(b[first_b[g] : first_b[g] + n[g]], return_counts=True)
        pairs = doc[g] * width + x[:, None] * size_b + y
        more.append((pairs.ravel(), (of_x[:, None] * of_y).ravel()))
    if more:
        all_, weights = (np.concatenate(z) for z in zip((cells, times), *more, strict=True))
        cells, back = np.unique(all_, return_inverse=True)
        times = np.zeros(len(cells), np.int64)
        np.add.at(times, back, weights)
    return cells, times


@functools.cache
def _decimals(size: int) -> tuple[pa.Array, np.ndarray]:
    """Each id in decimal, followed by each of the three marks."""
    texts = [f"{i}{mark}" for i in range(size) for mark in (WITHIN, BETWEEN, AFTER)]
    return pa.array(texts, pa.binary()), np.array([len(x) for x in texts], np.int64)


def _digests(a, b, group_a, group_b, m, n, first_a, first_b, doc, size: int, tables) -> list[str]:
    """The SHA-256 of each document's groups as text; '' without tokens."""
    texts, lengths = _decimals(max(len(t.lengths) for t in tables))
    # Ids in the order of the text: each group's of A, then its of B.
    at_a = np.arange(len(a)) + first_b[group_a]
    at_b = np.arange(len(b)) + (first_a + m)[group_b]
    items = np.zeros(len(a) + len(b), np.int64)
    last_a = np.arange(len(a)) == (first_a + m - 1)[group_a]
    last_b = np.arange(len(b)) == (first_b + n - 1)[group_b]
    items[at_a] = 3 * a + last_a
    items[at_b] = 3 * b + 2 * last_b
    joined = texts.take(pa.array(items)).buffers()[2] if len(items) else None
    ends = np.append(0, np.cumsum(lengths[items]))
    in_groups = np.append(0, np.cumsum(m + n))
    bounds = np.searchsorted(doc, np.arange(size + 1))
    places = ends[in_groups[bounds]].tolist()
    view = memoryview(joined) if joined else memoryview(b"")
    return [
        hashlib.sha256(view[x : y - 1]).hexdigest() if y > x else ""
        for x, y in zip(places, places[1:], strict=False)
    ]


_SLICES = (
    "slice long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "n_links array<long>, groups_sha256 array<string>, cells binary, pairs array<long>, docs array<long>"
)
_OF_DOC = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on, each in the narrowest type that holds it."""
    out = []
    for x in arrays:
        kind = np.min_scalar_type(int(x.max(initial=0)))
        out += [np.array([kind.itemsize, len(x)], "<i8").tobytes(), x.astype(kind.newbyteorder("<")).tobytes()]
    return b"".join(out)


def _unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        size, n = np.frombuffer(data, "<i8", 2, at).tolist()
        out.append(np.frombuffer(data, f"<u{size}", n, at + 16).astype(np.int64))
        at += 16 + size * n
    return out


def _array(values, kind: pa.DataType) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))


def encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row per slice of documents, and one per task with its counts of identity pairs.

    ``pairs`` are distinct pairs, and ``docs`` the number of documents that hold each. Of a
    slice they are those that are not identity pairs; of a task (``slice`` is null) identity
    pairs. ``cells`` has, for identity pairs and for others, the number of pairs of each
    document, the pairs (as id of A, or as place in ``pairs``), and the links of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, n_b = identity(a_path, b_path), len(b_table(b_path).lengths)
        width = len(same) * n_b
        vector = np.zeros(len(same), np.int64)
        part, number = TaskContext.get().partitionId(), 0

        def row(slice_id, ids, figures, digests, cells, pairs, counts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([slice_id], pa.int64()),
                    _array(ids, pa.int64()),
                    *(_array(x, pa.int64()) for x in figures),
                    _array(digests, pa.string()),
                    pa.array([cells], pa.binary()),
                    _array(pairs, pa.int64()),
                    _array(counts, pa.int64()),
                ],
                [x.split()[0] for x in _SLICES.split(", ")],
            )

        for batch in batches:
            for begin, end in slices(batch.column("text")):
                rows = batch.slice(begin, end - begin)
                found = aligned(rows.column("text"), a_path, b_path)
                doc, pair = np.divmod(found.cells, width)
                of_a = pair // n_b
                known = same[of_a] == pair % n_b
                vector += np.bincount(of_a[known], minlength=len(vector))
                pairs, place, counts = np.unique(pair[~known], return_inverse=True, return_counts=True)
                cells = _packed(
                    np.bincount(doc[known], minlength=len(rows)),
                    of_a[known],
                    found.times[known],
                    np.bincount(doc[~known], minlength=len(rows)),
                    place,
                    found.times[~known],
                )
                figures = found.n_a, found.n_b, found.n_groups, found.n_links
                slice_id = (part << 32) + number
                yield row(slice_id, rows.column("doc_id"), figures, found.digests, cells, pairs, counts)
                number += 1
        some = np.flatnonzero(vector)
        if len(some):
            yield row(None, [], ([],) * 4, [], b"", some * n_b + same[some], vector[some])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(run, _SLICES)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair`` and ``n``, the documents that hold it, of rows of ``encoded``."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x"))
    return each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("n"))


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row per document with its figures; see the module and ``Slice``.

    ``n_best`` are the links whose pair's count is the highest of their id of A, ``count_sum``
    the sum of all links' counts.
    """
    rows = written(encoded(docs, a_path, b_path), "aligned")
    held = rows.where("slice is not null")
    others = written(pair_counts(held), "pair-counts")
    n_a, n_b = len(identity(a_path, b_path)), len(b_table(b_path).lengths)
    # Two vectors as long as A's vocabulary, whatever the input.
    known = np.zeros(n_a, np.int64)
    for r in pair_counts(rows.where("slice is null")).collect():
        known[r["pair"] // n_b] = r["n"]
    highest = known.copy()
    for r in others.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("n").alias("n")).collect():
        highest[r["a"]] = max(highest[r["a"]], r["n"])
    answers = (
        held.select("slice", F.posexplode("pairs").alias("at", "pair"))
        .join(others, "pair")
        .groupBy("slice")
        .agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("found"))  # one slice's pairs
        .select("slice", F.col("found.n").alias("counts"))
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                own = one.column("counts").flatten().to_numpy()
                of_pair = one.column("pairs").flatten().to_numpy() // n_b
                in_same, same, times, in_other, other, more = _unpacked(one.column("cells")[0].as_py())
                size = len(in_same)
                doc = np.concatenate([np.repeat(np.arange(size), x) for x in (in_same, in_other)])
                a = np.concatenate([same, of_pair[other]])
                n = np.concatenate([known[same], own[other]])
                links = np.concatenate([times, more])
                best, total = np.zeros((2, size), np.int64)
                np.add.at(best, doc, np.where(n == highest[a], links, 0))
                np.add.at(total, doc, n * links)
                yield pa.RecordBatch.from_arrays(
                    [*(one.column(c).flatten() for c in _OF_DOC), pa.array(best), pa.array(total)],
                    [*_OF_DOC, "n_best", "count_sum"],
                )

    joined = held.drop("docs").join(answers, "slice", "left")
    return joined.mapInArrow(
        finish,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "n_best long, count_sum long",
    )
