import random
import re

from pyspark.sql import functions as F

from tarnwork.llm import near_dedup as n
from tarnwork.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(texts):
    """doc_id -> (set size, smallest id reachable)."""
    sets = {i: shingles(t) for i, t in texts.items() if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = {}
    for i, x in sets.items():
        for s in x:
            lists.setdefault(s, []).append(i)
    for a, b in {(a, b) for x in lists.values() for a in x for b in x if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    return {i: (len(x), root(i)) for i, x in sets.items()}


def check(docs, texts):
    got = n.near_duplicates(docs).collect()
    right = brute(texts)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == right[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    return got


def family(rng, first, size, changes, words=120):
    """Copies of one text with up to so many words changed, and chains of such copies."""
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for i in range(size):
        own = list(base)
        for _ in range(rng.randrange(changes)):
            own[rng.randrange(words)] = f"w{rng.randrange(40)}"
        out.append((first + i, " ".join(own)))
        if i % 7 == 6:
            base = own
    return out


def test_given_documents_equal_brute_force(documents, sample, edges):
    rows = [*sample.items(), *edges]
    got = check(documents(rows), dict(rows))
    assert len(got) == len(rows)
    null = next(r for r in got if r["doc_id"] is None)
    assert null["component_id"] is None and null["kept"]


def test_families_passages_and_chains_equal_brute_force(documents):
    rng = random.Random(4)
    rows = family(rng, 0, 60, 9) + family(rng, 100, 40, 4, 30) + family(rng, 200, 30, 3, 12)
    passage = " ".join(f"p{i}" for i in range(60))
    for i in range(60):  # a passage that makes up a part of each
        rest = " ".join(f"x{rng.randrange(9999)}" for _ in range(rng.randrange(5, 90)))
        rows.append((300 + i, f"{passage} {rest}" if i % 2 else f"{rest} {passage}"))
    rows += [(400 + i, t) for i, (_, t) in enumerate(rows[:50])]
    check(documents(rows), dict(rows))


def test_only_whole_sets_decide_where_star_rounds_do_not(documents):
    rng = random.Random(5)
    rows = family(rng, 0, 50, 12)
    docs = documents(rows)
    right = {i: c for i, (_, c) in brute(dict(rows)).items()}
    for rounds in (0, 1):
        got = n.near_duplicates(docs, star_rounds=rounds).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == right


def test_first_of_each_group_stays(documents, edges):
    docs = documents([(2, "a b c d e f"), (1, "A b c d e f"), (3, "other words"), *edges])
    got = n.keep_first(docs)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert 1 in ids and 2 not in ids and 3 in ids and None in ids
    assert {-1, -2, -3} <= set(ids) and ids.count(-5) == 2 and -4 not in ids
    assert n.near_duplicates(docs.where(F.lit(False))).count() == 0
    assert n.near_duplicates(docs.where("doc_id < -0 and doc_id > -4")).where("kept").count() == 3


def test_components_of_paths_cycles_and_nothing(spark):
    path = list(range(40))
    random.Random(1).shuffle(path)
    edges = [*zip(path, path[1:]), (100, 101), (101, 102), (102, 100), (7, 7), (None, 3)]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    labels = {r["node"]: r["component"] for r in got.collect()}
    assert labels == {**dict.fromkeys(range(40), 0), **dict.fromkeys((100, 101, 102), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
