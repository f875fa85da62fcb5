"""Source divergence audit: how far each source's words are from the others of its language.

Terms are counted by sorting pointers. A shard of texts stays in its Arrow buffer; an array
of pointers to the starts of its words is put in order by multikey quicksort, which
compares eight bytes of a word at a time, splits the pointers into smaller, equal and
larger ones, and goes on to the next eight bytes with the equal ones only. Runs of equal
words give, per source, how often a term occurs and in how many documents. Shards send
these counts alone, so no word is a group of its occurrences.

Each language keeps the terms found in at least ``MIN_DOCUMENTS`` of its documents. A
group, a source in a language, gives each of its language's V kept terms
``p = 1 + floor(10**9 * (count + 2) / (N + 2 V))``, N being its counts' sum; so does the
language as a whole. Two p of a term diverge by ``floor((p - q)**2 / (p + q))``. Sums over
all kept terms compare the sources of a language pair by pair (part ``pair``); single terms
compare a source with its language (part ``term``).

Pairs of sources are summed in tiles of source blocks and term buckets, with numpy, so no
term is a group of the pairs it is found in, and a task holds one tile.

Defined results. Null text, language and source are empty strings. Groups without any term
count. Repeated rows count each. A language without kept terms has V = 0: its pairs are 0
and it has no terms. A language of one source has no pairs. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwork.llm.chunks import _bytes_of
from tarnwork.llm.common import written

MIN_DOCUMENTS = 10
TOP_TERMS = 10
SCALE_STEPS = 3  # p is in thousandths of thousandths of thousandths
#: Bytes of text that are sorted at once.
SHARD_BYTES = 8_000_000
#: Pointers that are left to the library's sort.
SMALL = 50_000
#: Sources in a block, and cells (term and source) in a bucket, on average.
BLOCK, BUCKET = 256, 50_000
#: Terms of a tile that are compared at once.
TERMS = 512

_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = True
_TERM[128:] = True


def word_pointers(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms start in ``data`` and how long they are; ``at`` is where texts start."""
    inside = _TERM[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) - starts + 1


def _eight(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of words at ``at`` as a number that sorts like them; a word's
    end is zero bytes, which no word contains. ``data`` goes on for eight bytes."""
    every = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    drop = (np.clip(8 - left, 0, 7) * 8).astype(np.uint64)
    return np.where(left > 0, every[at].astype(np.uint64) >> drop << drop, np.uint64(0))


def sorted_pointers(
    data: np.ndarray, starts: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words in the order of their bytes, equal words in text order, and
    where in that order a new word begins.

    Multikey quicksort on eight bytes at a time. Ranges of more than ``SMALL`` pointers are
    split about a pivot; the small ones of a depth are left to the library's sort together.
    """
    order = np.arange(len(starts))
    new = np.zeros(len(starts) + 1, bool)
    new[[0, -1]] = True
    keys = np.zeros(len(starts), np.uint64)
    lows, highs, depth = np.array([0]), np.array([len(starts)]), 0
    while len(lows):
        at = np.repeat(lows - np.cumsum(highs - lows) + (highs - lows), highs - lows) + np.arange((highs - lows).sum())
        own = order[at]
        keys[at] = _eight(data, starts[own] + 8 * depth, lengths[own] - 8 * depth)
        large = highs - lows > SMALL
        todo = list(zip(lows[large].tolist(), highs[large].tolist(), strict=True))
        small = [(lows[~large], highs[~large])]
        equal = []
        while todo:
            low, high = todo.pop()
            if high - low <= SMALL:
                small.append((np.array([low]), np.array([high])))
                continue
            key, own = keys[low:high], order[low:high]
            pivot = np.sort(key[:: (high - low) // 9])[4]
            parts = [np.flatnonzero(x) for x in (key < pivot, key == pivot, key > pivot)]
            again = np.concatenate(parts)
            order[low:high], keys[low:high] = own[again], key[again]
            a, b = low + len(parts[0]), high - len(parts[2])
            new[[a, b]] = True
            equal.append((a, b))
            todo += [(low, a), (b, high)]
        low, high = (np.concatenate(x) for x in zip(*small, strict=True))
        size = high - low
        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        key, of = keys[at], np.repeat(np.arange(len(low)), size)
        again = np.lexsort((key, of))
        order[at], key = order[at[again]], key[again]
        # A new run begins with a new range or a new key.
        edge = np.ones(len(at), bool)
        edge[1:] = (np.diff(of) > 0) | (key[1:] != key[:-1])
        first = np.flatnonzero(edge)
        new[at[first]] = True
        lows = np.append(at[first], np.array([x for x, _ in equal], int))
        highs = lows + np.append(np.diff(np.append(first, len(at))), np.array([y - x for x, y in equal], int))
        depth += 1
        # The key of a word that ends before has a zero byte, so a run is all of one kind.
        longer = (highs - lows > 1) & (lengths[order[lows]] >= 8 * depth)
        lows, highs = lows[longer], highs[longer]
    return order, np.flatnonzero(new[:-1]) if len(starts) else np.zeros(0, int)


def shard_counts(texts: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """``term``, ``group``, occurrences and documents, a row per term and group in a shard."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    data, at = _bytes_of(texts)
    data = np.append(data, np.zeros(8, np.uint8))
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    starts, lengths = word_pointers(data[:-8], at[:-1])
    if not len(starts):
        none = np.zeros(0, np.int64)
        return pa.array([], pa.string()), none, none, none
    order, begins = sorted_pointers(data, starts, lengths)
    word = np.zeros(len(order), np.int64)
    word[begins[1:]] = 1
    word = np.cumsum(word)
    doc = np.searchsorted(at, starts[order], "right") - 1  # ascending within a run
    newdoc = np.ones(len(order), bool)
    newdoc[1:] = (np.diff(word) > 0) | (np.diff(doc) > 0)
    n_groups = int(group.max()) + 1
    found, cell, counts = np.unique(word * n_groups + group[doc], return_inverse=True, return_counts=True)
    documents = np.bincount(cell[newdoc], minlength=len(found))
    of, group_of = np.divmod(found, n_groups)
    head = order[begins]
    size = lengths[head]
    ends = np.cumsum(size)
    gather = np.repeat(starts[head] - (ends - size), size) + np.arange(ends[-1])
    terms = pa.StringArray.from_buffers(
        len(begins),
        pa.py_buffer(np.append(0, ends).astype(np.int32)),
        pa.py_buffer(np.ascontiguousarray(data[gather])),
    )
    return terms.take(pa.array(of)), group_of, counts, documents


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a partition, in shards of some ``SHARD_BYTES`` of text."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
        ends, begin = np.cumsum(lengths), 0
        while begin < len(batch):
            done = ends[begin - 1] if begin else 0
            end = int(np.searchsorted(ends, done + SHARD_BYTES - size, "right"))
            end = min(max(end, begin + 1), len(batch))
            held.append(batch.slice(begin, end - begin))
            size += int(ends[end - 1] - done)
            begin = end
            if size >= SHARD_BYTES:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``docs`` (documents).

    The term '' stands for the group itself: no occurrence, all documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            keys = [_one(shard, c).dictionary_encode() for c in ("lang", "source")]
            lang, source = (k.indices.to_numpy().astype(np.int64) for k in keys)
            n_sources = len(keys[1].dictionary)
            groups, own, sizes = np.unique(lang * n_sources + source, return_inverse=True, return_counts=True)
            terms, group, counts, documents = shard_counts(_one(shard, "text"), own)
            group = np.append(group, np.arange(len(groups)))
            counts = np.append(counts, np.zeros(len(groups), np.int64))
            documents = np.append(documents, sizes)
            terms = pa.concat_arrays([terms, pa.array([""] * len(groups), pa.string())])
            of_lang, of_source = np.divmod(groups[group], n_sources)
            for k in range(0, len(group), 100_000):
                part = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys[0].dictionary.take(pa.array(of_lang[part])),
                        keys[1].dictionary.take(pa.array(of_source[part])),
                        terms.slice(k, 100_000),
                        pa.array(counts[part]),
                        pa.array(documents[part].astype(np.int64)),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

    rows = docs.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text"))
    )
    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _billionths(count: Column, total: Column) -> Column:
    """``1 + floor(10**9 * count / total)`` in whole numbers, by long division."""
    rest, out = count, F.lit(0).cast("long")
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        out = out * 1000 + _div(rest, total)
        rest = rest % total
    return out + 1


def _div(a: Column, b: Column) -> Column:
    """Whole-number division of what is not negative."""
    return F.call_function("div", a, b)


def _gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``; see the module."""
    counts = written(term_counts(docs), "term-counts")
    terms = counts.where("term != ''")
    kept = written(
        terms.groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"))
        .where(F.col("docs") >= min_documents)
        .select("lang", "term", "lang_n"),
        "kept-terms",
    )
    langs = kept.groupBy("lang").agg(
        F.count("*").alias("v"), F.sum("lang_n").alias("lang_total")
    )
    cells = written(terms.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "term-cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("cells"))
    groups = written(
        counts.where("term = ''")
        .select("lang", "source")
        .join(totals, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select(
            "lang",
            "source",
            *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "cells", "v", "lang_total")),
        ),
        "term-groups",
    )
    return _pair_part(kept, cells, groups).unionByName(_term_part(cells, groups, top))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank")
    )


def _p(n: Column) -> Column:
    return _billionths(n + 2, F.col("total") + 2 * F.col("v"))


def _term_part(cells: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    whole = _billionths(F.col("lang_n") + 2, F.col("lang_total") + 2 * F.col("v"))
    found = (
        cells.join(groups.drop("cells"), ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), _p(F.col("n")).alias("p"), whole.alias("q"))
        .where("p > q")
        .select("lang", "source", "item", _gap(F.col("p"), F.col("q")).alias("value"))
    )
    return _ranked(found, "term").where(F.col("rank") <= top)


def _pair_part(kept: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    """The divergence of all pairs of a language's sources, in tiles.

    A tile is two blocks of sources and a bucket of terms. Its rows have ``p``; sources
    without a term have ``least``, what no occurrence gives. ``terms`` is how many terms the
    bucket has, those that neither block has included.
    """
    spread = groups.groupBy("lang").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"),
        F.greatest(F.ceil(F.sum("cells") / BUCKET), F.lit(1)).cast("int").alias("buckets"),
    )
    block = F.pmod(F.xxhash64("source", F.lit(5)), F.col("blocks")).cast("int").alias("block")
    least = F.when(F.col("v") > 0, _p(F.lit(0).cast("long")))
    placed = groups.join(spread, "lang").select(
        "lang", "source", "total", "v", block, "blocks", "buckets", least.alias("least")
    )
    placed = written(placed, "term-blocks")
    bucket = F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket")
    sizes = kept.join(spread, "lang").groupBy("lang", bucket).agg(F.count("*").alias("terms"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    tiled = [
        *(F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b")),
    ]
    sources = (
        placed.withColumn("other", F.explode(every))
        .withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
        .join(sizes, ["lang", "bucket"], "left")
        .select("lang", "bucket", *tiled, "block", "source", "least", "terms")
    )
    values = (
        cells.join(placed.drop("least"), ["lang", "source"])
        .select(
            "lang",
            bucket,
            "block",
            F.explode(every).alias("other"),
            "source",
            "term",
            _p(F.col("n")).alias("p"),
        )
        .select("lang", "bucket", *tiled, "source", "term", "p")
    )
    key = ["lang", "bucket", "block_a", "block_b"]
    found = (
        sources.groupBy(*key)
        .cogroup(values.groupBy(*key))
        .applyInArrow(_tile, "lang string, source string, item string, value long")
    )
    sums = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.union(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    return _ranked(both, "pair")


def _tile(sources: pa.Table, values: pa.Table) -> pa.Table:
    """Sums over a bucket's terms for the pairs of two blocks, each pair once."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    if not len(sources):
        return schema.empty_table()
    a, b = sources.column("block_a")[0].as_py(), sources.column("block_b")[0].as_py()
    first = np.flatnonzero(sources.column("block").to_numpy() == a)
    rest = np.flatnonzero(sources.column("block").to_numpy() != a)
    names = _one(sources, "source").take(pa.array(np.append(first, rest)))
    least = pc.fill_null(_one(sources, "least"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    least = least[np.append(first, rest)]
    # The other block's sources, or those that come later in the same block.
    after = np.arange(1, len(names) + 1) if a == b else np.full(len(first), len(first))
    sums = np.zeros((len(after), len(names)), np.int64)
    absent = sources.column("terms")[0].as_py()
    if len(values):
        term = _one(values, "term").dictionary_encode()
        absent -= len(term.dictionary)
        row = term.indices.to_numpy()
        column = pc.index_in(_one(values, "source"), value_set=names).to_numpy(zero_copy_only=False)
        order = np.argsort(row, kind="stable")
        row, column = row[order], column[order].astype(np.int64)
        p = values.column("p").to_numpy()[order]
        for begin in range(0, len(term.dictionary), TERMS):
            size = min(TERMS, len(term.dictionary) - begin)
            x, y = np.searchsorted(row, [begin, begin + size])
            dense = np.repeat(least[:, None], size, axis=1)
            dense[column[x:y], row[x:y] - begin] = p[x:y]
            for i, j in enumerate(after):
                gap = dense[j:] - dense[i]
                sums[i, j:] += (gap * gap // (dense[j:] + dense[i])).sum(1)
    i, j = np.nonzero(np.arange(len(names)) >= after[:, None])
    gap = least[i] - least[j]
    # Without kept terms there is no ``least``.
    sums[i, j] += (absent or 0) * (gap * gap // np.maximum(least[i] + least[j], 1))
    langs = pa.array([sources.column("lang")[0].as_py()] * len(i), pa.string())
    return pa.table(
        [langs, names.take(pa.array(i)), names.take(pa.array(j)), pa.array(sums[i, j])], schema=schema
    )
