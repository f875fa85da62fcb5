import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import divergence as d

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, least=10, top=10):
    """The audit's rows, from (text, lang, source)."""
    rows = [(terms(t), lang or "", source or "") for t, lang, source in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for words, lang, source in rows:
        docs[lang].update(set(words))
        counts[lang, source].update(words)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def share(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def gap(p, q):
            return (p - q) ** 2 // (p + q)

        q, p = share(whole), {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pair = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            term = [(-gap(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def audited(spark, rows, **options):
    schema = "text string, lang string, source string, n long, p int, item string"
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], schema)
    got = d.audit(docs, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("small", [9, 40, 50_000])
def test_pointers_sort_like_words(monkeypatch, small):
    monkeypatch.setattr(d, "SMALL", small)
    rng = random.Random(small)
    parts = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefgh" * 3, "é", "日本語日本語", "z" * 40, "abcdefgg"]
    words = [rng.choice(parts) + rng.choice(["", "", "q", "é"]) for _ in range(700)]
    data = np.frombuffer((" ".join(words)).encode() + bytes(8), np.uint8).copy()
    starts, lengths = d.word_pointers(data[:-8], np.array([0]))
    assert len(starts) == 700
    order, begins = d.sorted_pointers(data, starts, lengths)
    assert [words[i] for i in order] == sorted(words, key=str.encode)
    assert order.tolist() == sorted(range(700), key=lambda i: (words[i].encode(), i))
    ordered = [words[i] for i in order]
    assert begins.tolist() == [i for i in range(700) if i == 0 or ordered[i] != ordered[i - 1]]


def test_words_end_with_their_texts():
    texts = ["ab", "cd", "", None, "1x2", "yA", "é", "\x80@[`{"]
    found, group, counts, docs = d.shard_counts(pa.array(texts), np.arange(len(texts)))
    got = sorted(zip(found.to_pylist(), group.tolist(), counts.tolist(), docs.tolist(), strict=True))
    assert got == sorted((t, i, 1, 1) for i, text in enumerate(texts) for t in terms(text))
    empty = d.shard_counts(pa.array(["", "12"]), np.zeros(2, int))
    assert [len(x) for x in empty] == [0, 0, 0, 0]


def made(rng, n=300):
    """Texts with a hot source, ties, rare terms and groups without terms."""
    rows = [(None, None, None), ("", "en", "quiet"), (None, "en", None), ("12 34", "zz", "a"), ("!", "zz", "b")]
    for _ in range(n):
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(7)}"
        low = rng.randrange(20)
        words = [f"word{'abcdefghijklmnopqrstuvwxyz'[(low + rng.randrange(12)) % 26]}" for _ in range(rng.randrange(40))]
        rows.append((" ".join(words).title(), rng.choice(["en", "de"]), source))
    return [*rows, *rows[50:80], ("rare rarer\nrarest é日", "en", "s1")]


def test_audit_equals_brute_force(spark, edges):
    rows = made(random.Random(1)) + [(t, "en", "edge") for _, t in edges]
    assert audited(spark, rows) == brute(rows)
    assert audited(spark, rows, min_documents=1, top=3) == brute(rows, 1, 3)


def test_blocks_buckets_and_shards_change_nothing(spark, monkeypatch):
    rows = made(random.Random(2), 120)
    for name, value in (("BLOCK", 2), ("BUCKET", 20), ("TERMS", 3), ("SHARD_BYTES", 400)):
        monkeypatch.setattr(d, name, value)
    assert audited(spark, rows) == brute(rows)


def test_shares_are_exact_where_a_double_is_not(spark):
    cases = [(2, 3), (7 * 10**13 + 1, 9 * 10**14 + 7), (10**15, 10**15), (1, 9 * 10**15)]
    got = spark.createDataFrame(cases, "n long, total long").select(
        "n", "total", d._billionths(F.col("n"), F.col("total")).alias("p")
    )
    assert all(r["p"] == 1 + 10**9 * r["n"] // r["total"] for r in got.collect())


def test_nothing_and_one_source(spark):
    assert audited(spark, []) == []
    rows = [("same words here", "en", "only")] * 12
    assert audited(spark, rows) == brute(rows)  # no pairs, and no term over its language
    rows = [("a", "en", "x"), ("b", "en", "y")]
    assert audited(spark, rows) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_shards_hold_every_row_once():
    texts = ["x" * n for n in (0, 5, 300, 7, 2, 1000, 0, 3)]
    batches = [pa.record_batch([pa.array(texts[i : i + 3])], ["text"]) for i in range(0, 8, 3)]
    for size in (1, 10, 400, 10**6):
        d_size, d.SHARD_BYTES = d.SHARD_BYTES, size
        try:
            shards = list(d._shards(iter(batches)))
        finally:
            d.SHARD_BYTES = d_size
        assert [t for s in shards for t in s.column("text").to_pylist()] == texts
        assert all(sum(map(len, s.column("text").to_pylist())) <= size + 1000 for s in shards)
