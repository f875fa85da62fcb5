"""Near-duplicates by bottom-k sketches from one hash function.

A document's set is its distinct five-word shingles, as 64-bit hashes. Its sketch is the
``K`` smallest of them. Documents with equal sets are one class. The sketches' values,
turned round, are lists of the classes that retain them; classes that share lists are
candidates. Of a pair's union sketch, the share that both retain estimates their
similarity; pairs that can still reach the limit are compared on their whole sets.

Which lists are read. A pair over the limit shares at least ``SHARED`` of ``K``
retained values (all but a chance of 1e-8; sets of up to ``K`` shingles are their own
sketch, and there it is exact). So it shares one of the ``K - SHARED + 1`` rarest values of
either, and only those lists are read; values of one class alone come first and need no
list. A passage in a third of all documents is in nobody's rarest values unless it makes up
much of the document. Lists are split by set size: sizes in the limit's ratio meet in one
of two neighbouring steps.

No list is paired out. In a few rounds, each class is compared with one class of another
component, one that stands for the most of its lists; what is similar joins a
component. Lists of one component are done with. For the members of the others, whole sets
are turned round instead of sketches: of these, the rarest quarter must be shared, which
leaves aside what a passage of up to three quarters of a document brings together. Members
of one such list in different components are all compared.

Defined results. Null, empty or blank texts have no shingles and are linked with nothing.
Repeated rows are a class. Rows with a null ``doc_id`` are linked with nothing and kept; their
component is null. An empty table gives no rows.
"""

from __future__ import annotations

import math
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

WORDS = 5
LIMIT = 75  # percent
K = 64
SHARED = 28

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(1 << 63)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, as signed 64-bit numbers."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    data, at = _bytes_of(texts)
    empty = np.zeros(0, np.int64)
    if not len(data):
        return [empty] * len(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    solid = ~_BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    first[edges] = solid[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return [empty] * len(texts)
    packed = data[solid]
    offsets = np.append(np.cumsum(solid)[starts] - 1, len(packed)).astype(np.int32)
    words = pa.StringArray.from_buffers(
        len(starts), pa.py_buffer(offsets), pa.py_buffer(packed)
    ).dictionary_encode()
    distinct = np.fromiter(
        (xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()),
        np.uint64,
        len(words.dictionary),
    )
    h = distinct[words.indices.to_numpy()]
    rolled = np.zeros(max(len(h) - WORDS + 1, 0), np.uint64)
    for k in range(WORDS):
        rolled = rolled * _FACTOR + h[k : k + len(rolled)]
    rolled = (_mixed(rolled) ^ _TOP).view(np.int64)
    bounds = np.searchsorted(starts, at)
    out = []
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - begin >= WORDS:
            out.append(np.unique(rolled[begin : end - WORDS + 1]))
        elif end > begin:
            whole = np.full(1, end - begin, np.uint64)
            for k in range(begin, end):
                whole = whole * _FACTOR + h[k]
            out.append((_mixed(whole) ^ _TOP).view(np.int64))
        else:
            out.append(empty)
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(a) for a in arrays])).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n`` (set size), ``mark`` (digest of the set) and ``sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column("text")):
                rows = batch.slice(begin, end - begin)
                sets = shingle_sets(rows.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        _lists([s[:K] for s in sets]),
                    ],
                    ["doc_id", "n", "mark", "sketch"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n long, mark binary, sketch array<long>")


def whole_sets(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``shingles``, the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column("text")):
                rows = batch.slice(begin, end - begin)
                sets = _lists(shingle_sets(rows.column("text")))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), sets], ["doc_id", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, shingles array<long>")


def shared_lists(classes: DataFrame, whole: bool = False) -> DataFrame:
    """``rep``, ``n``, ``s``, ``value`` and ``step``: the lists to read for each class.

    ``classes`` has ``rep``, ``n`` and ``values``: sketches, or whole sets if ``whole``.
    ``s`` bounds what two classes can have in common whose rarest common value this is: of
    whole sets, the value and all that are less rare.
    """
    values = classes.select("rep", "n", F.size("values").alias("k"), F.explode("values").alias("value"))
    counts = values.groupBy("value").agg(F.count("*").alias("c")).where("c > 1")
    own = (
        values.join(counts, "value")
        .groupBy("rep", "n", "k")
        .agg(F.sort_array(F.collect_list(F.struct("c", "value"))).alias("shared"))  # its own values
    )
    least = F.ceil(F.col("n") * LIMIT / 100)
    common = least if whole else F.least(least, F.lit(SHARED))
    alone = F.col("k") - F.size("shared")
    taken = F.greatest(F.col("k") - common + 1 - alone, F.lit(0)).cast("int")
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / LIMIT) + 1e-9).cast("int")
    opened = own.select(
        "rep",
        "n",
        alone.alias("alone"),
        F.posexplode(F.slice("shared", F.lit(1), taken)).alias("i", "at"),
        step.alias("low"),
    )
    bound = F.col("n") - F.col("alone") - F.col("i") if whole else F.col("n")
    return opened.select(
        "rep",
        "n",
        bound.alias("s"),
        "at.value",
        F.explode(F.array("low", F.col("low") + 1)).alias("step"),
    )


def _sizes_fit(n: str, m: str) -> Column:
    return 100 * F.least(n, m) >= LIMIT * F.greatest(n, m)


def _enough(common: Column, n: str, m: str) -> Column:
    """Whether sets of these sizes with so much in common reach the limit."""
    return (100 + LIMIT) * common >= LIMIT * (F.col(n) + F.col(m))


def _able(lists: DataFrame) -> DataFrame:
    """Members of lists that could reach the limit with a list's smallest member.

    A pair is found in the list of its rarest common value if at all; in the lists of its
    other common values the bound is lower, and it need not be found again.
    """
    # Written, so that the join stands alone and Spark can deal a long list to several tasks.
    least = written(lists.groupBy("value", "step").agg(F.min("n").alias("least")), "list-least")
    return lists.join(least, ["value", "step"]).where(_enough(F.col("s"), "n", "least")).drop("least")


def verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b), those whose sets are as similar as the limit asks."""
    at = [
        sketches.select(F.col("rep").alias(x), F.col("sketch").alias(f"sketch_{x}"))
        for x in ("a", "b")
    ]
    union = F.slice(F.sort_array(F.array_union("sketch_a", "sketch_b")), 1, K)
    estimated = (
        pairs.join(at[0], "a")
        .join(at[1], "b")
        .select("a", "b", union.alias("u"), F.array_intersect("sketch_a", "sketch_b").alias("i"))
        .select("a", "b", F.size("u").alias("u"), F.size(F.array_intersect("u", "i")).alias("i"))
        .where(F.when(F.col("u") < K, 100 * F.col("i") >= LIMIT * F.col("u")).otherwise(F.col("i") >= SHARED))
        .select("a", "b")
    )
    whole = [
        sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"set_{x}")) for x in ("a", "b")
    ]
    both = F.size(F.array_intersect("set_a", "set_b"))
    return (
        estimated.join(whole[0], "a")
        .join(whole[1], "b")
        .select("a", "b", both.alias("i"), (F.size("set_a") + F.size("set_b")).alias("sum"))
        .where(100 * F.col("i") >= LIMIT * (F.col("sum") - F.col("i")))
        .select("a", "b")
    )


def _with_component(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    lists = lists.select("rep", "n", "s", "value", "step")
    if labels is None:
        return lists.withColumn("component", F.col("rep"))
    named = labels.select(F.col("node").alias("rep"), F.col("component").alias("_c"))
    return lists.join(named, "rep", "left").select(
        "rep", "n", "s", "value", "step", F.coalesce("_c", "rep").alias("component")
    )


def _open_lists(lists: DataFrame) -> DataFrame:
    """Members of the lists that hold more than one component."""
    mixed = (
        lists.groupBy("value", "step")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low != high")
        .select("value", "step")
    )
    return lists.join(written(mixed, "mixed-lists"), ["value", "step"])


def _star_pairs(lists: DataFrame, number: int) -> DataFrame:
    """Each class with one of another component: the one that stands for most of its lists.

    A list's first one is its smallest; in later rounds it is another one each time.
    """
    order = F.xxhash64("rep", F.lit(number)) if number else F.col("rep")
    hubs = lists.groupBy("value", "step").agg(
        F.min(F.struct(order.alias("o"), "rep", "component", "n")).alias("hub")
    )
    hubs = written(hubs, "list-hubs")
    return (
        lists.join(hubs, ["value", "step"])
        .where((F.col("hub.component") != F.col("component")) & _sizes_fit("n", "hub.n"))
        .groupBy("rep", F.col("hub.rep").alias("hub"))
        .agg(F.count("*").alias("lists"))
        .groupBy("rep")
        .agg(F.max(F.struct("lists", (-F.col("hub")).alias("hub"))).alias("best"))
        .select((-F.col("best.hub")).alias("hub"), "rep")
        .select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"))
        .distinct()
    )


def _all_pairs_between(lists: DataFrame) -> DataFrame:
    """Pairs of one list in different components, sizes within the limit's ratio.

    Of two components the smaller is written out first, so that the larger one's members
    come in by the join that tests the pairs.
    """
    groups = lists.groupBy("value", "step", "component").agg(F.count("*").alias("c"))
    other = groups.select("value", "step", F.col("component").alias("other"), F.col("c").alias("d"))
    smaller = F.struct("c", "component") < F.struct("d", "other")
    between = groups.join(other, ["value", "step"]).where(smaller).drop("c", "d")
    a, b = (
        lists.select(
            "value",
            "step",
            F.col("component").alias(component),
            F.col("rep").alias(x),
            F.col("n").alias(f"n_{x}"),
            F.col("s").alias(f"s_{x}"),
        )
        for x, component in (("a", "component"), ("b", "other"))
    )
    return (
        between.join(a, ["value", "step", "component"])
        .join(b, ["value", "step", "other"])
        .where(_sizes_fit("n_a", "n_b") & _enough(F.least("s_a", "s_b"), "n_a", "n_b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, star_rounds: int = 2) -> DataFrame:
    """A row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``."""
    rows = written(sketched(docs), "sketches")
    classes = written(
        rows.where("n > 0 and doc_id is not null")
        .groupBy("mark")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")),
        "classes",
    )
    lists = written(shared_lists(classes.withColumnRenamed("sketch", "values")), "lists")
    readers = written(lists.select("rep").distinct(), "readers")
    sketches = classes.select("rep", "sketch").join(readers, "rep", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(
        whole_sets(texts.join(readers.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi"))
        .withColumnRenamed("doc_id", "rep"),
        "sets",
    )
    edges, labels = None, None
    for number in range(star_rounds + 1):
        last = number == star_rounds
        lists = written(_open_lists(_with_component(lists, labels)), "open-lists")
        if last:
            members = sets.join(lists.select("rep").distinct(), "rep", "left_semi")
            values = members.select("rep", F.size("shingles").alias("n"), F.col("shingles").alias("values"))
            able = _able(written(_with_component(shared_lists(values, whole=True), labels), "whole-lists"))
            lists = written(_open_lists(written(able, "able-lists")), "open-lists")
        if lists.isEmpty():
            break
        pairs = _all_pairs_between(lists) if last else _star_pairs(lists, number)
        found = written(verified(pairs, sketches, sets), "links")
        if not found.isEmpty():
            edges = found if edges is None else edges.union(found)
            labels = components(edges)
    reps = classes.select("mark", "rep")
    if labels is not None:
        named = labels.select(F.col("node").alias("rep"), "component")
        reps = reps.join(named, "rep", "left").select(
            "mark", F.coalesce("component", "rep").alias("component")
        )
    else:
        reps = reps.withColumnRenamed("rep", "component")
    linked = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("mark"))
    return (
        rows.select("doc_id", "n", linked.alias("mark"))
        .join(reps, "mark", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "doc_id").alias("component_id"),
            F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
        )
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents but the near-duplicates of one with a smaller ``doc_id``.

    Of rows with the same ``doc_id`` all stay or all go.
    """
    found = near_duplicates(docs)
    gone = "_gone"
    while gone in map(str.lower, docs.columns):
        gone += "_"
    ids = found.where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(ids, F.col("doc_id") == F.col(gone), "left_anti")
