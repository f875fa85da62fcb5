import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tarnwork.llm import simhash as s


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints):
    """Smallest id reachable, from id -> fingerprint."""
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ v) <= 2) + i + 1:
            p, q = root(ids[i]), root(ids[j])
            parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def test_fingerprints_equal_brute_force(sample, edges):
    texts = [*list(sample.values())[:60], *(t for _, t in edges), "A", "a B", "é ñ\x0b 日本 A b", "x" * 99]
    assert s.fingerprints(pa.array(texts)).tolist() == [brute_print(t) for t in texts]
    assert s.fingerprints(pa.array([], pa.string())).tolist() == []
    assert s.fingerprints(pa.array([None, "", " "], pa.string())).tolist() == [0, 0, 0]
    sliced = pa.array(["zzz", *texts]).slice(1)
    assert s.fingerprints(sliced).tolist() == [brute_print(t) for t in texts]


def test_long_texts_are_added_up_in_parts(monkeypatch):
    monkeypatch.setattr(s, "SHINGLES", 7)
    texts = [" ".join(f"w{i * k % 31}" for i in range(100)) for k in range(1, 9)]
    assert s.fingerprints(pa.array(texts)).tolist() == [brute_print(t) for t in texts]


@pytest.mark.parametrize("width", [16, 8, 4])
def test_tiles_within_the_radius_meet_once(width):
    rng = np.random.default_rng(width)
    x = rng.integers(0, 2**64, 300, np.uint64)
    x[:3] = [0, 2**64 - 1, 1]
    counts = s.field_counts(x.view(np.int64), width).view(np.uint64)
    for v, c in zip(x.tolist(), counts.tolist(), strict=True):
        fields = [(v >> k & (1 << width) - 1).bit_count() for k in range(0, 64, width)]
        assert fields == [c >> k & (1 << width) - 1 for k in range(0, 64, width)]
    steps, valid = s.steps(width), s.field_counts
    for v in x.tolist():
        for _ in range(20):
            other = v ^ 1 << int(rng.integers(64)) ^ 1 << int(rng.integers(64))
            a, b = valid(np.array([v, other], np.uint64).view(np.int64), width).tolist()
            assert (b - a in steps) + (a - b in steps) == (2 if a == b else 1)


def test_a_forest_joins_what_the_links_join():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 400, (2, 350))
    x, y = s.forest(a, b)
    assert len(x) < 400
    for ends in ((a, b), (x, y)):
        parent = dict.fromkeys(range(400))
        label = {i: i for i in parent}
        for _ in range(400):
            for p, q in zip(*ends, strict=True):
                label[p] = label[q] = min(label[p], label[q])
        if ends[0] is a:
            right = label
    assert label == right


def cluster(rng, base, n, flips):
    return [base ^ sum(1 << b for b in set(rng.sample(range(64), rng.randrange(flips + 1)))) for _ in range(n)]


@pytest.mark.parametrize(("width", "tile"), [(16, 4096), (16, 5), (8, 5), (4, 4096)])
def test_links_equal_all_pairs(spark, monkeypatch, width, tile):
    monkeypatch.setattr(s, "TILE", tile)
    rng = random.Random(width)
    values = [rng.getrandbits(64) for _ in range(300)] + [0, 1, 3, 7, 2**64 - 1, 2**63]
    for n, flips in ((80, 2), (80, 4), (40, 1)):
        values += cluster(rng, rng.getrandbits(64), n, flips)
    values = list(dict.fromkeys(values))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(v,) for v in signed], "print long")
    cut = s.tiles(rows, width).collect()
    assert sorted(v for r in cut for v in r["prints"]) == sorted(signed)
    found = s.links(rows, width).collect()
    near = dict(zip(signed, values, strict=True))
    parent = {v: v for v in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        p, q = root(r["a"]), root(r["b"])
        parent[max(p, q)] = min(p, q)
    right = roots({v: near[v] for v in signed})
    groups, expected = {}, {}
    for v in signed:
        groups.setdefault(root(v), set()).add(v)
        expected.setdefault(right[v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_large_tiles_are_compared_in_blocks(monkeypatch):
    monkeypatch.setattr(s, "ROWS", 3)
    monkeypatch.setattr(s, "LINKS", 10)
    rng = random.Random(9)
    base = rng.getrandbits(64)
    values = sorted(set(cluster(rng, base, 60, 2)))
    array = pa.array([np.array(values, np.uint64).view(np.int64)])
    a, b = s.links_between(array, array)
    assert len(a) == len(values) - 1  # one component, a link for each but its root
    assert set(a.tolist()) | set(b.tolist()) == set(array[0].as_py())


def test_documents_equal_brute_force(documents, sample, edges):
    rng = random.Random(2)
    rows = [*sample.items(), *edges]
    words = [f"w{rng.randrange(3000)}" for _ in range(900)]
    for i in range(40):  # a chain of small changes
        words[rng.randrange(900)] = f"v{i}"
        rows.append((5000 + i, " ".join(words)))
    docs = documents(rows)
    got = s.near_duplicates(docs).collect()
    prints = [(i, brute_print(t)) for i, t in rows]
    least = {}
    for i, p in prints:
        if i is not None:
            least[p] = min(i, least.get(p, i))
    right = roots({i: p for p, i in least.items()})
    expected = [(i, f"{p:016x}", None if i is None else right[least[p]]) for i, p in prints]
    shown = [(r["doc_id"], f"{r['print'] % 2**64:016x}", r["component_id"]) for r in got]
    assert sorted(shown, key=str) == sorted(expected, key=str)
    hexed = s.near_duplicates(docs).select(s.as_hex().alias("x")).collect()
    assert sorted(r["x"] for r in hexed) == sorted(f"{p:016x}" for _, p in prints)


def test_no_documents_and_only_empty_ones(documents):
    docs = documents([(3, ""), (2, None), (9, " ")])
    assert {r["component_id"] for r in s.near_duplicates(docs).collect()} == {2}
    assert s.near_duplicates(docs.where(F.lit(False))).count() == 0
