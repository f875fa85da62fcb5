"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits, the lowest first. Level 0 holds the lowest
chunk of every id, and a bitmap that says which ids go on; level 1 the next chunk of
those that do, and so on. A rank directory, the number of set bits before every 512th,
gives the place of an id's next chunk with one count of at most 512 bits, so any token
is read without decoding others.

A file holds some documents in ascending ``doc_id`` order:

    "TDAC" | version u32 | documents u64 | tokens u64 | levels u32
    doc_id i64 per document | end of the document, in tokens, u64 each
    per level: chunks u64 | chunk u8 each | bitmap | directory u64 each
    CRC-32 of all before, u32

All numbers are little-endian; bit i of a bitmap is bit i % 8 of byte i // 8.

Defined results. Null and empty texts are the end id alone. Rows with equal or null
``doc_id`` are kept, side by side, nulls first. An empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwork.llm.chunks import library_coder, slices
from tarnwork.llm.common import shared_folder, written
from tarnwork.llm.store import read_file, write_file

MAGIC, VERSION = b"TDAC", 1
HEAD = struct.Struct("<4sIQQI")
#: Bits between two entries of a rank directory.
BLOCK = 512
#: Tokens after which a file is closed.
FILE_TOKENS = 4_000_000

_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def dump(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of these documents, ``counts`` ids each."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(_ONES[bitmap], dtype=np.uint64)])
        directory = ones[: len(bitmap) + 1 : BLOCK // 8].astype("<u8")
        levels.append((rest.astype(np.uint8), bitmap, directory))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    out = [
        HEAD.pack(MAGIC, VERSION, len(doc_ids), len(ids), len(levels)),
        doc_ids.astype("<i8").tobytes(),
        np.cumsum(counts).astype("<u8").tobytes(),
    ]
    for chunks, bitmap, directory in levels:
        out += [
            struct.pack("<Q", len(chunks)),
            chunks.tobytes(),
            bitmap.tobytes(),
            directory.tobytes(),
        ]
    body = b"".join(out)
    return body + struct.pack("<I", zlib.crc32(body))


class TokenFile:
    """A file's documents and tokens, from its bytes."""

    def __init__(self, data: bytes):
        if len(data) < HEAD.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("the file is cut short or damaged")
        magic, version, docs, self.tokens, n_levels = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        self._data, self._at = data, HEAD.size
        self.doc_ids = self._take("<i8", docs)
        self.ends = self._take("<u8", docs).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(self._take("<u8", 1)[0])
            bitmap_bytes = -(-n // 8)
            self.levels.append(
                (
                    self._take("u1", n),
                    self._take("u1", bitmap_bytes),
                    self._take("<u8", bitmap_bytes // (BLOCK // 8) + 1),
                )
            )
        if self._at != len(data) - 4 or len(self.levels[0][0]) != self.tokens:
            raise ValueError("the file's lengths do not agree")

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self._data, kind, n, self._at)
        self._at += out.nbytes
        return out

    def token(self, i: int) -> int:
        """Token ``i`` of the file, read without decoding any other."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, directory in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK
            before = bitmap[block * (BLOCK // 8) : i >> 3]
            i = (
                int(directory[block])
                + int(_ONES[before].sum())
                + int(_ONES[bitmap[i >> 3] & ((1 << (i & 7)) - 1)])
            )
            shift += 8
        raise ValueError("an id goes on past the last level")

    def document(self, n: int) -> np.ndarray:
        """The ids of the file's document ``n``."""
        begin = int(self.ends[n - 1]) if n else 0
        return np.array([self.token(i) for i in range(begin, int(self.ends[n]))], np.uint32)

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out = None
        for chunks, bitmap, _ in reversed(self.levels):
            value = chunks.astype(np.uint32)
            if out is not None:
                more = np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)
                value[more] |= out << np.uint32(8)
            out = value
        return out


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> DataFrame:
    """Encode ``text`` and write files to ``folder``; the manifest, a row per file.

    ``part`` and ``number`` order the files as their documents. The manifest is a
    written table.
    """
    schema = "part int, number int, file string, documents long, tokens long, bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_coder(vocabulary)
        part, number, held, tokens = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            doc_ids, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            data = dump(doc_ids, counts, ids)
            name = write_file(folder, ".tdac", [data])
            row = [part, number, name, len(doc_ids), len(ids), len(data)]
            return pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in row],
                ["part", "number", "file", "documents", "tokens", "bytes"],
            )

        for batch in batches:
            for begin, end in slices(batch.column("text")):
                rows = batch.slice(begin, end - begin)
                ids, counts = coder(rows.column("text"))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                held.append((rows.column("doc_id").fill_null(NO_ID).to_numpy(), counts + 1, ids))
                tokens += len(ids)
                if tokens >= FILE_TOKENS:
                    yield _cast(flush(), schema)
                    number, held, tokens = number + 1, [], 0
        if held:
            yield _cast(flush(), schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    # Rows of one ``doc_id``, or without any, are told apart by a number of their own.
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id").drop("_row")
    return written(ordered.mapInArrow(run, schema), "token-manifest")


#: Stands for a null ``doc_id`` in a file.
NO_ID = -(2**63)


def _cast(batch: pa.RecordBatch, schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    pairs = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [batch.column(name).cast(kinds[kind]) for name, kind in pairs], [n for n, _ in pairs]
    )


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per document of the files: ``doc_id``, ``start`` (tokens of all documents
    before it), ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit)."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("_tokens"))
    parts = parts.select("part", F.coalesce(F.sum("_tokens").over(order), F.lit(0)).alias("_part"))
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    files = (
        manifest.withColumn("_file", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
        .join(parts, "part")
        .select("file", (F.col("_part") + F.col("_file")).alias("base"))
    )
    n = min(max(manifest.count(), 1), 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = TokenFile(read_file(folder, name))
                ids = found.all().astype("<u4")
                starts = np.append(0, found.ends)
                for a in range(0, len(found.doc_ids), 2000):
                    b = min(a + 2000, len(found.doc_ids))
                    at = starts[a : b + 1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(found.doc_ids[a:b], mask=found.doc_ids[a:b] == NO_ID),
                            pa.array(base + at[:-1]),
                            pa.array(np.diff(at)),
                            pa.Array.from_buffers(
                                pa.binary(),
                                b - a,
                                [
                                    None,
                                    pa.py_buffer(((at - at[0]) * 4).astype(np.int32)),
                                    pa.py_buffer(ids[at[0] : at[-1]].tobytes()),
                                ],
                            ),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    dealt = files.repartition(n, F.xxhash64("file"))
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """The documents written to new files in the shared folder and read back."""
    folder = shared_folder(docs.sparkSession, "tokens")
    return read(write(docs, folder, vocabulary, end_id), folder)
