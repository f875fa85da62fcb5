"""Nearest neighbours by cosine from an inverted multi-index.

Vectors are scaled to length one and cut in two halves; each half has a codebook of
centroids of its own, fitted by k-means on a bounded sample. A vector's cell is its pair of
nearest centroids. A query goes through the pairs in the order of their summed distances,
by a heap, until their cells hold a certain share of all vectors; the vectors of these cells
are then ranked by their cosines: a matrix product finds those that can be among the
nearest, and one formula, the same for every pair, ranks them. The share is measured: of vectors of the sample,
the nearest in the sample are found by comparing all, and the share is what holds ``RECALL``
of them. Clustered vectors need a small one, random ones in many dimensions half or more.

All vectors are in the index. Of equal vectors only the ``k`` + 1 with the smallest ids
are: no others can be among ``k`` nearest, where ties go to the smaller id. Equal queries are
searched once. The cells of one first centroid lie together, and are split, with the queries
that read them, into parts of some ``PART`` by ``PART``.

Defined results. Vectors that are null, zero, of another length than most in the sample, or
hold null or non-finite components take no part; neither do null ids. Repeated rows
count once. With no vectors there are no rows; with few, a query gets all there are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwork.llm.common import hash_cut, written

#: Vectors that the codebooks are fitted on at most.
SAMPLE = 20_000
#: Rounds of k-means.
ROUNDS = 12
#: Centroids per half at most; cells are their pairs.
CENTROIDS = 64
#: Share of the nearest that the cells of a query must hold, and of how many vectors of the
#: sample that is measured.
RECALL, MEASURED = 0.96, 400
#: By how much a matrix product may miss a cosine.
ROUNDING = 1e-9
#: Pairs whose cosines are added up at once.
RESCORED = 50_000
#: Queries that one task probes for, on average.
PROBED = 200
#: Vectors, and queries, of a first centroid that are compared at once.
PART = 2_000


def kmeans(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """``k`` centroids of the points, the same ones every time."""
    rng = np.random.default_rng(0)
    distinct = np.unique(points, axis=0)
    k = min(k, len(distinct))
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = _distances(points, centres).argmin(1)
        for c in range(k):
            own = points[near == c]
            centres[c] = own.mean(0) if len(own) else points[rng.integers(len(points))]
    return centres


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)
    return np.maximum(squares, 0)


class Codebooks:
    def __init__(self, sample: np.ndarray, centroids: int):
        self.size = sample.shape[1]
        self.half = self.size // 2
        unit = scaled(sample)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        self.first = kmeans(unit[:, : self.half], centroids)
        self.second = kmeans(unit[:, self.half :], centroids)

    def distances(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit = scaled(vectors)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        return (
            _distances(unit[:, : self.half], self.first),
            _distances(unit[:, self.half :], self.second),
        )

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        first, second = self.distances(vectors)
        return first.argmin(1) * len(self.second) + second.argmin(1)


def share_for(books: Codebooks, points: np.ndarray, k: int, recall: float) -> float:
    """The share of the vectors that a query's first cells must hold, for ``recall`` of the
    ``k`` nearest of the sample ``points`` to be in them."""
    unit = scaled(points)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    asking = unit[:MEASURED]
    cells = books.cells(points)
    counts = np.bincount(cells, minlength=len(books.first) * len(books.second))
    scores = asking @ unit.T
    scores[np.arange(len(asking)), np.arange(len(asking))] = -np.inf
    most = min(k, len(points) - 1)
    if most < 1:
        return 1.0
    near = np.argpartition(-scores, most - 1, axis=1)[:, :most]
    needed = []
    for i, (first, second) in enumerate(zip(*books.distances(points[:MEASURED]), strict=True)):
        order = np.argsort((first[:, None] + second).ravel(), kind="stable")
        seen = np.empty(len(order))
        seen[order] = np.cumsum(counts[order])
        needed.append(seen[cells[near[i]]])
    return float(np.quantile(np.concatenate(needed), recall, method="higher")) / len(points)


def traverse(first: np.ndarray, second: np.ndarray) -> Iterator[int]:
    """All cells, by the sum of their two distances from a query.

    The heap holds the frontier: a pair enters when the pair before it in either order has
    left.
    """
    order = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[order[0]], second[order[1]]
    heap, taken = [(a[0] + b[0], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(order[0][i]) * len(b) + int(order[1][j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in taken:
                taken.add((x, y))
                heapq.heappush(heap, (a[x] + b[y], x, y))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors times powers of two that bring their largest parts near one: exact, and
    no square overflows."""
    _, exponent = np.frexp(np.abs(vectors).max(1))
    return np.ldexp(vectors, -exponent[:, None])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of ``a[i]`` and ``b[i]`` for all i, added up part by part.

    Each depends on its two vectors alone, not on those beside them as in a matrix product;
    that of equal vectors is 1.
    """
    a, b = scaled(a), scaled(b)
    both, of_a, of_b = np.zeros((3, len(a)))
    for x, y in zip(a.T, b.T, strict=True):
        both += x * y
        of_a += x * x
        of_b += y * y
    return np.clip(both / np.sqrt(of_a * of_b), -1.0, 1.0)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``embedding`` (doubles) of the vectors that can take part."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("vec_id is not null and embedding is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("embedding")
    )
    finite = F.forall(
        "embedding",
        lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)),
    )
    return rows.where(finite & F.exists("embedding", lambda x: x != 0))


def nearest(vectors: DataFrame, query_every: int, k: int, share: float | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` nearest found.

    Queries are the vectors whose id is divisible by ``query_every``. ``share`` is measured
    if it is not given.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    same = Window.partitionBy("embedding").orderBy("vec_id")
    rows = written(usable(vectors).distinct(), "vectors")
    hashed = rows.select(F.xxhash64("embedding").alias("h"), "embedding")
    cut = hash_cut(hashed.select("h"), SAMPLE)
    if cut is not None:
        hashed = hashed.where(F.col("h") <= cut)
    sample = hashed.groupBy("h").agg(F.min("embedding").alias("embedding")).orderBy("h").collect()
    if not sample:
        return spark.createDataFrame([], schema)
    lengths = [len(r["embedding"]) for r in sample]
    size = max(set(lengths), key=lambda n: (lengths.count(n), -n)) if len(set(lengths)) > 1 else lengths[0]
    points = np.array([r["embedding"] for r in sample if len(r["embedding"]) == size])
    # A cell for some four vectors of the sample, as far as the bound goes.
    centroids = min(CENTROIDS, max(1, round((len(points) / 4) ** 0.5)))
    books = Codebooks(points, centroids)
    if share is None:
        share = share_for(books, points, k, RECALL)
    rows = rows.where(F.size("embedding") == size)
    held = written(
        rows.withColumn("_nth", F.row_number().over(same)).where(F.col("_nth") <= k + 1).drop("_nth"),
        "distinct-vectors",
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cells = books.cells(_matrix(batch.column("embedding"))).astype(np.int32)
                places = [pa.array(x) for x in np.divmod(cells, np.int32(len(books.second)))]
                columns = [*batch.columns, *places]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "embedding", "first", "second"])

    entries = written(
        held.mapInArrow(assign, "vec_id long, embedding array<double>, first int, second int"),
        "entries",
    )
    counts = {
        r["first"] * len(books.second) + r["second"]: r["count"]
        for r in entries.groupBy("first", "second").count().collect()  # cells
    }
    enough = max(share * sum(counts.values()), k + 1)
    asking = rows.where(F.col("vec_id") % query_every == 0)
    keys = asking.groupBy("embedding").agg(F.min("vec_id").alias("key"))
    queries = written(
        asking.join(keys, "embedding").select("vec_id", "key", "embedding"), "queries"
    )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            first, second = books.distances(_matrix(batch.column("embedding")))
            row, firsts, seconds = [], [], []
            for i in range(len(batch)):
                seen, cells = 0, {}
                for cell in traverse(first[i], second[i]):
                    if n := counts.get(cell, 0):
                        a, b = divmod(cell, len(books.second))
                        cells.setdefault(a, []).append(b)
                        seen += n
                    if seen >= enough:
                        break
                row += [i] * len(cells)
                firsts += cells
                seconds += cells.values()
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(at),
                    batch.column("embedding").take(at),
                    pa.array(firsts, pa.int32()),
                    pa.array(seconds, pa.list_(pa.int32())),
                ],
                ["key", "embedding", "first", "seconds"],
            )

    once = queries.where("vec_id = key").select("key", "embedding")
    # A query file may be one small split, but probing it is work.
    once = once.repartition(max(1, min(keys.count() // PROBED, 10_000)), "key")
    probes = written(
        once.mapInArrow(probe, "key long, embedding array<double>, first int, seconds array<int>"),
        "probes",
    )
    rows_of = {r["first"]: r["count"] for r in entries.groupBy("first").count().collect()}
    asked = {r["first"]: r["count"] for r in probes.groupBy("first").count().collect()}
    parts = spark.createDataFrame(
        [(a, -(-rows_of[a] // PART), -(-n // PART)) for a, n in asked.items()],
        "first int, n_e int, n_q int",
    )

    def split(df: DataFrame, own: str, other: str, key: str) -> DataFrame:
        """Rows in one part of their own side and, repeated, in all of the other's."""
        dealt = df.join(F.broadcast(parts), "first")  # a row per centroid
        return dealt.select(
            *df.columns,
            F.pmod(F.xxhash64(key, F.lit(1)), F.col(f"n_{own}")).cast("int").alias(f"p_{own}"),
            F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(f"p_{other}"),
        )

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = pa.schema([("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not len(left) or not len(right):
            return kinds.empty_table()
        whole = [_matrix(side.column("embedding").combine_chunks()) for side in (left, right)]
        q, e = (scaled(x) for x in whole)
        q, e = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (q, e))
        keys, ids = left.column("key").to_numpy(), right.column("vec_id").to_numpy()
        cell = right.column("second").to_numpy()
        read = left.column("seconds").combine_chunks()
        reader = np.repeat(np.arange(len(q)), pc.list_value_length(read).to_numpy())
        column = read.flatten().to_numpy()
        scores = np.full((len(q), len(e)), -np.inf)
        for b in np.unique(cell):
            of_cell, by = np.flatnonzero(cell == b), reader[column == b]
            scores[np.ix_(by, of_cell)] = q[by] @ e[of_cell].T
        most = min(k + 1, len(ids))
        bound = np.partition(scores, len(ids) - most, axis=1)[:, len(ids) - most]
        row, column = np.nonzero((scores >= bound[:, None] - ROUNDING) & (scores > -np.inf))
        exact = np.zeros(len(row))
        for begin in range(0, len(row), RESCORED):
            part = slice(begin, begin + RESCORED)
            exact[part] = cosines(whole[0][row[part]], whole[1][column[part]])
        order = np.lexsort((ids[column], -exact, row))
        row, column, exact = row[order], column[order], exact[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < most
        return pa.table([keys[row[best]], ids[column[best]], exact[best]], schema=kinds)

    at = ["first", "p_e", "p_q"]
    best = (
        split(probes, "q", "e", "key")
        .groupBy(*at)
        .cogroup(split(entries, "e", "q", "vec_id").groupBy(*at))
        .applyInArrow(rank, "key long, vec_id long, score double")
    )
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = written(
        best.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k + 1).drop("_nth"),
        "found",
    )
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        queries.select(F.col("vec_id").alias("query_id"), "key")
        .join(best, "key")
        .where("query_id != vec_id")
        .withColumn("rank", F.row_number().over(own))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
