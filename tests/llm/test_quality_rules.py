import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tarnwork.llm import quality_rules as q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(repeated),
        len(words) < 50 or 100 * len(repeated) > 50 * len(words),
    )


def test_statistics_equal_brute_force(documents, sample, edges):
    rows = [*sample.items(), *edges, (-8, "x y # \U0001f600 " * 20 + "\n\n#"), (-9, "a b c a b c d " * 9)]
    got = q.quality(documents(rows), q.DecisionList()).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        found = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert found == brute(texts[r["doc_id"]]), r["doc_id"]
        assert r["kept"] == (not r["base_failed"])


def labelled(spark, rows):
    schema = "bad boolean, held boolean, " + ", ".join(f"{n} double" for n in q.FEATURES)
    full = [(bad, i % 3 == 0, *(x.get(n, 0.0) for n in q.FEATURES)) for i, (bad, x) in enumerate(rows)]
    return spark.createDataFrame(full, schema)


def test_rules_find_a_conjunction_and_an_alternative(spark):
    rows = [(False, {"symbol_ratio": i / 300, "n_words": 100.0 + i % 7}) for i in range(60)]
    rows += [(True, {"symbol_ratio": 0.5 + i / 300, "n_words": 100.0}) for i in range(40)]
    rows += [(True, {"mean_word_chars": 9.0}) for i in range(40)]
    data = labelled(spark, rows)
    rules = q.fit(data)
    judged = data.select("bad", rules.matched().isNotNull().alias("rejected"))
    assert len(rules.rules) == 2 and judged.where("bad != rejected").count() == 0
    assert "reject if" in str(rules) and str(rules).endswith("else keep")


def test_nothing_to_learn_rejects_nothing(spark):
    assert q.fit(labelled(spark, [])).rules == []
    assert q.fit(labelled(spark, [(True, {})] * 30)).rules == []
    assert q.fit(labelled(spark, [(i % 2 == 0, {}) for i in range(60)])).rules == []


def test_learned_from_documents_and_kept_with_their_columns(spark, documents, edges):
    good = [(i, " ".join(f"w{i}x{k}" for k in range(60))) for i in range(60)]
    junk = [(100 + i, " ".join(f"w{i}x{k}###" for k in range(60))) for i in range(60)]
    docs = documents([*good, *junk, *edges])
    labels = spark.createDataFrame(
        [*((i, 1) for i, _ in good), *((i, 0) for i, _ in junk), (None, 0), (5, None), (999, 1)],
        "doc_id long, quality int",
    )
    rules = q.learn(docs, labels)
    kept = q.keep_good(docs, rules)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _ in good]
    assert q.learn(docs, labels, max_labelled=0).rules == []
    assert q.quality(docs.where(F.lit(False)), rules).count() == 0


def plain_fit(rows, cuts=32, max_rules=8, max_conditions=4, min_covered=5, min_precision=0.95):
    """The decision list by plain loops: rules as tuples of (feature, above, threshold)."""
    points = {}
    for name in q.FEATURES:
        found = set()
        for bad in (True, False):
            values = [x[name] for b, _, x in rows if b == bad]
            if values:
                found.update(np.quantile(values, [i / cuts for i in range(cuts + 1)]).tolist())
        ordered = sorted(found)
        points[name] = [(a + b) / 2 for a, b in zip(ordered, ordered[1:])]

    def holds(rule, x):
        return all((x[name] > t) == above for name, above, t in rule)

    rules, rest = [], list(rows)
    while len(rules) < max_rules:
        rule, grown = (), [(b, x) for b, held, x in rest if not held]
        while len(rule) < max_conditions:
            now = [(b, x) for b, x in grown if holds(rule, x)]
            bad = sum(b for b, _ in now)
            best, gain = None, 1e-9
            for name in q.FEATURES if 0 < bad < len(now) else ():
                for t in points[name]:
                    for above in (True, False):
                        own = [b for b, x in now if (x[name] > t) == above]
                        p = sum(own)
                        if p and p * (math.log2(p / len(own)) - math.log2(bad / len(now))) > gain:
                            gain = p * (math.log2(p / len(own)) - math.log2(bad / len(now)))
                            best = (name, above, t), len(own) - p
            if best is None:
                break
            rule += (best[0],)
            if not best[1]:
                break
        if not rule:
            break

        def worth(i, rule=rule):
            own = [b for b, held, x in rest if held and holds(rule[:i], x)]
            return (2 * sum(own) - len(own)) / len(own) if own else -1.0

        cut = max(range(1, len(rule) + 1), key=lambda i: (worth(i), -i))
        rule = rule[:cut]
        held_bad = [b for b, held, x in rest if held and holds(rule, x)]
        covered = sum(b for b, _, x in rest if holds(rule, x))
        if not sum(held_bad) or sum(held_bad) < min_precision * len(held_bad) or covered < min_covered:
            break
        rules.append(rule)
        rest = [r for r in rest if not holds(rule, r[2])]
    return rules


def test_learned_rules_equal_plain_loops(spark):
    learned = 0
    for seed in range(4):
        rng = random.Random(seed)
        rows = []
        for i in range(240):
            x = {name: float(rng.randrange(12)) for name in q.FEATURES}
            bad = x["symbol_ratio"] > 7 and x["n_words"] < 6 or x["shout_ratio"] > 9 or rng.random() < 0.02 * (seed % 2)
            rows.append((bad, i % 3 == 0, x))
        expected = plain_fit(rows)
        got = q.fit(labelled(spark, [(bad, x) for bad, _, x in rows]))
        assert [[(c.feature, c.above, round(c.threshold, 9)) for c in rule] for rule in got.rules] == [
            [(name, above, round(t, 9)) for name, above, t in rule] for rule in expected
        ]
        learned += len(expected)
    assert learned >= 4
