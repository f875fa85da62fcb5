import bisect
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tarnwork.llm import packing
from tarnwork.llm.queries import vocabulary

WORDS = vocabulary("word_bpe_49k.json")


def test_plan_places_every_rank_once_without_gaps():
    rng = random.Random(0)
    for trial in range(60):
        capacity = rng.choice([16, 100, 4096])
        counts = {rng.randrange(1, capacity + 1): rng.choice([1, 2, 3, rng.randrange(1, 300)]) for _ in range(40)}
        fill, seen = {}, {}
        for r in packing.plan(counts, capacity):
            for k in range(r.first, r.last):
                at = k - r.first
                fill.setdefault(r.sequence + at // r.each, []).append((r.offset + at % r.each * r.length, r.length))
                assert k not in seen.setdefault(r.length, set())
                seen[r.length].add(k)
        assert {n: len(x) for n, x in seen.items()} == counts
        assert all(x == set(range(len(x))) for x in seen.values())
        for parts in fill.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= capacity
        rooms = []  # best fit decreasing, piece by piece
        for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            i = bisect.bisect_left(rooms, length)
            bisect.insort(rooms, (rooms.pop(i) if i < len(rooms) else capacity) - length)
        assert len(fill) <= 1.05 * len(rooms) + 1, trial


def test_packed_documents_equal_the_library(documents, sample, edges):
    from tokenizers import Tokenizer

    rows = [*sample.items(), *edges]
    docs = documents(rows)
    library = Tokenizer.from_file(WORDS)
    got = packing.packed_digest(docs, WORDS, 1, 300).collect()
    by, sequences = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 300
    for i, text in dict(rows).items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        cut = [ids[a : a + 300] for a in range(0, len(ids), 300)]
        expected = [(k, 300 * k, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[i])
        assert sorted(set(own)) == expected and len(own) % len(expected) == 0
    assert packing.packed_digest(docs.where(F.lit(False)), WORDS, 1, 300).count() == 0


def test_sequences_hold_the_ids(documents, spark):
    docs = documents([(i, "one two three " * i) for i in range(1, 9)])
    pieces = packing.tokenized(docs, WORDS, 1, 16)
    packed = packing.placed(pieces.cache(), 16)
    total = sum(len(r["ids"]) for r in packing.sequences(packed).collect())
    assert total == sum(len(r["ids"]) for r in pieces.collect())
    assert all(len(r["ids"]) <= 64 for r in packing.sequences(packed).collect())


def test_hot_lengths_and_nulls_are_placed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 7)
    rows = [(None, 0, 5)] * 40 + [(1, 0, 5)] * 30 + [(i, 0, 1 + i % 16) for i in range(50)]
    pieces = spark.createDataFrame(rows, "doc_id long, _row int, length long")
    got = packing.placed(pieces, 16)
    assert got.columns == ["doc_id", "_row", "length", "sequence_id", "offset"]
    fill = {}
    for r in got.collect():
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(map(len, fill.values())) == len(rows)
    for parts in fill.values():
        ends = [offset + length for offset, length in sorted(parts)]
        assert [offset for offset, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 16


def test_given_documents_take_hardly_more_sequences_than_their_tokens_fill(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lengths = {}
    for r in packing.packed_digest(docs, WORDS, 1, 4096).collect():
        lengths.setdefault(r["sequence_id"], []).append(r["length"])
    rooms = []  # plain best fit, longest piece first
    for length in sorted((n for own in lengths.values() for n in own), reverse=True):
        i = bisect.bisect_left(rooms, length)
        bisect.insort(rooms, (rooms.pop(i) if i < len(rooms) else 4096) - length)
    least = -(-sum(n for own in lengths.values() for n in own) // 4096)
    assert least <= len(lengths) <= min(len(rooms), least + 2)
