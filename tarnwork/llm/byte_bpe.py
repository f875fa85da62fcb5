"""Byte-level BPE by two-tier lookup.

A pre-token that is in the vocabulary has one id, found by a minimal perfect hash: a
displacement per bucket sends every vocabulary entry to a slot of its own, and one
comparison tells entries from strangers. Other pre-tokens are merged: their bytes are
a linked list, and a heap holds the ranks of neighbouring pairs.

Texts are cut into chunks (``chunks``) and each distinct chunk is split by the pattern.

Defined results. Null and empty texts have no tokens; decoded, they are empty.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.chunks import ChunkCoder, slices


class PerfectHash:
    """A minimal perfect hash from byte strings to the numbers they are given with.

    Keys fall into buckets by their hash. From the fullest on, each bucket gets the
    first displacement that sends all its keys to free slots; buckets of one key then
    name one of the slots that are left.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = self.n = len(keys)
        if len(set(keys)) != n:
            raise ValueError("two keys are equal")
        self.buckets = max(1, n // 3)
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        for bucket in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            own = members[bucket]
            if len(own) < 2:
                break
            shift = 0
            while True:
                slots = {self._slot(hashes[i], shift) for i in own}
                if len(slots) == len(own) and all(self.keys[s] is None for s in slots):
                    break
                shift += 1
            self._fill(bucket, shift, own, hashes, keys, values)
        free = iter([s for s in range(n) if self.keys[s] is None])
        for bucket, own in enumerate(members):
            if len(own) == 1:
                self._fill(bucket, -1 - next(free), own, hashes, keys, values)

    def _fill(self, bucket, shift, own, hashes, keys, values) -> None:
        self.shift[bucket] = shift
        for i in own:
            slot = self._slot(hashes[i], shift)
            self.keys[slot], self.values[slot] = keys[i], values[i]

    def _slot(self, h: int, shift: int) -> int:
        if shift < 0:
            return -1 - shift
        mixed = (h ^ shift * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        return (mixed >> 32) % self.n

    def get(self, key: bytes) -> int:
        """The key's number, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        slot = self._slot(h, self.shift[h % self.buckets])
        return self.values[slot] if self.keys[slot] == key else -1


class ByteBpe:
    """A vocabulary of ranked byte strings; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.whole = PerfectHash(list(ranks), list(ranks.values()))
        self.pattern = regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        #: The rank of the token that two tokens merge to.
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left = ranks.get(token[:k])
                if left is not None and (right := ranks.get(token[k:])) is not None:
                    self.pairs[left << 32 | right] = rank

    @classmethod
    @functools.cache  # once for each Python worker
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(a): int(b) for a, b in pairs}, pattern)

    def merge(self, token: bytes) -> list[int]:
        """The ids of a pre-token that is not in the vocabulary as a whole."""
        ids = [self.single[b] for b in token]
        if min(ids) < 0:
            raise ValueError("the vocabulary lacks a byte")
        n, pairs = len(ids), self.pairs
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [
            (rank, i)
            for i in range(n - 1)
            if (rank := pairs.get(ids[i] << 32 | ids[i + 1], -1)) >= 0
        ]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get(ids[i] << 32 | ids[j]) != rank:
                continue  # one of the two has been merged since
            ids[i], ids[j] = rank, -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (more := pairs.get(rank << 32 | ids[j], -1)) >= 0:
                    heappush(heap, (more, i))
            if (h := before[i]) >= 0 and (more := pairs.get(ids[h] << 32 | rank, -1)) >= 0:
                heappush(heap, (more, h))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for match in self.pattern.findall(text):
            token = match.encode()
            rank = self.whole.get(token)
            if rank >= 0:
                out.append(rank)
            else:
                out += self.merge(token)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.cache
def chunk_coder(vocabulary: str, pattern: str) -> ChunkCoder:
    bpe = ByteBpe.from_file(vocabulary, pattern)
    return ChunkCoder(lambda chunks: [bpe.encode(x) for x in chunks])


def encoded(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunk_coder(vocabulary, pattern)
        for batch in batches:
            for begin, end in slices(batch.column("text")):
                rows = batch.slice(begin, end - begin)
                ids, counts = coder(rows.column("text"))
                at = np.append(0, np.cumsum(counts)) * 4
                found = pa.Array.from_buffers(
                    pa.binary(),
                    len(counts),
                    [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids.astype("<u4").tobytes())],
                )
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), found], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decoded(tokens: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``tokens`` (``doc_id``, ``ids``) with ``data``, the bytes the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.from_file(vocabulary, pattern)
        size = max(bpe.bytes_of, default=-1) + 1
        table = pa.array([bpe.bytes_of.get(i, b"") for i in range(size)], pa.binary())
        lengths = np.array([len(bpe.bytes_of.get(i, b"")) for i in range(size)], np.int64)
        for batch in batches:
            for begin, end in slices(batch.column("ids")):
                rows = batch.slice(begin, end - begin)
                values = [np.frombuffer(x.as_buffer() or b"", "<u4") for x in rows.column("ids")]
                flat = np.concatenate(values)
                ends = np.append(0, np.cumsum(lengths[flat]))
                at = ends[np.append(0, np.cumsum([len(v) for v in values]))]
                joined = table.take(pa.array(flat))
                data = pa.Array.from_buffers(
                    pa.binary(),
                    len(rows),
                    [None, pa.py_buffer(at.astype(np.int32)), joined.buffers()[2] or pa.py_buffer(b"")],
                )
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, data], ["doc_id", "ids", "data"]
                )

    return tokens.mapInArrow(run, "doc_id long, ids binary, data binary")


def digest(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """A row per document: ``n_tokens`` and the SHA-256 of its ids and decoded bytes."""
    both = decoded(encoded(docs, vocabulary, pattern), vocabulary, pattern)
    return both.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )
