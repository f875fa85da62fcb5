import numpy as np

from tarnwork.llm import multi_index as m
from tests.llm.conftest import SF


def brute(rows, every, k):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], float)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = unit @ unit[i]
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(vectors, every, k, share=None):
    out = {}
    for r in sorted(m.nearest(vectors, every, k, share).collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_traversal_goes_by_summed_distance():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(5)
    cells = list(m.traverse(a, b))
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sorted(cells) == list(range(35)) and sums == sorted(sums)


def recall(got, right):
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in right[q]}) for q in right)
    return hits / sum(map(len, right.values()))


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(3000, 32)).tolist())]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 50, 5)
    right = brute(rows, 50, 5)
    assert got.keys() == right.keys()
    assert recall(got, right) >= 0.9


def test_recall_on_the_given_vectors(spark):
    for sf in (SF, SF.replace("0.001", "0.01"), SF.replace("0.001", "0.1")):
        table = spark.read.parquet(f"{sf}/embeddings.parquet")
        right = brute([(r["vec_id"], r["embedding"]) for r in table.collect()], 50, 5)
        got = found(table, 50, 5)
        assert got.keys() == right.keys() and recall(got, right) >= 0.9
        exact = found(table, 50, 5, share=1.0)
        assert {q: [i for i, _ in x] for q, x in exact.items()} == {q: [i for i, _ in x] for q, x in right.items()}
        assert all(abs(a[1] - b[1]) < 1e-12 for q in right for a, b in zip(exact[q], right[q]))


def test_the_share_is_measured():
    rng = np.random.default_rng(4)
    spread = rng.normal(size=(3000, 64))
    clustered = (rng.normal(size=(60, 64)) * 6)[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 64)) / 4
    shares = [m.share_for(m.Codebooks(x, 27), x, 5, 0.96) for x in (spread, clustered)]
    assert shares[1] < 0.1 < 0.3 < shares[0] < 0.9
    assert m.share_for(m.Codebooks(spread[:1], 1), spread[:1], 5, 0.96) == 1.0


def test_clustered_vectors_are_found_in_a_small_part(spark):
    rng = np.random.default_rng(5)
    points = (rng.normal(size=(80, 64)) * 6)[rng.integers(0, 80, 4000)] + rng.normal(size=(4000, 64)) / 4
    rows = list(enumerate(points.tolist()))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(found(table, 50, 5), brute(rows, 50, 5)) >= 0.9


def test_equal_vectors_have_one_score_and_ascending_ids(spark):
    """Copies of 400 vectors at three offsets of the id lie in other parts and cells' places."""
    given = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet").collect()
    rows = [(r["vec_id"], r["embedding"]) for r in given]
    rows += [(i + offset, v) for offset in (10_000, 20_000, 30_000) for i, v in rows[:400]]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7), 50, 5)
    vectors = {i: tuple(v) for i, v in rows}
    tied = 0
    for query, near in got.items():
        by = {}
        for i, score in near:
            assert score <= 1.0
            by.setdefault(vectors[i], []).append((i, score))
        for same in by.values():
            assert [i for i, _ in same] == sorted(i for i, _ in same) and len({s for _, s in same}) == 1
            tied += len(same) > 1
        copies = sorted(i for i, v in vectors.items() if v == vectors[query] and i != query)
        assert [i for i, _ in near[: len(copies)]] == copies[:5]
        assert all(s == 1.0 for _, s in near[: len(copies)])
    assert tied > 50


def test_cosines_depend_on_their_two_vectors_alone():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 500, 64))
    whole = m.cosines(a, b)
    for n in (1, 2, 7, 64):
        assert (np.concatenate([m.cosines(a[i : i + n], b[i : i + n]) for i in range(0, 500, n)]) == whole).all()
    assert (m.cosines(a, a) == 1.0).all() and (m.cosines(a, -a) == -1.0).all()
    huge = a * 1e200
    assert np.isfinite(m.cosines(huge, b * 1e-200)).all() and (m.cosines(huge, huge) == 1.0).all()


def test_copies_ties_and_vectors_that_take_no_part(spark):
    same = [(i, [1.0, 0.0, 0.0]) for i in range(0, 500)]
    rows = [*same, (500, [0.0, 1.0, 0.0]), (501, [0.0, 2.0, 0.0]), (501, [0.0, 2.0, 0.0])]
    bad = [(600, None), (650, [0.0, 0.0, 0.0]), (700, [1.0, None, 0.0]), (750, [1.0, float("nan"), 0.0]), (800, [1.0, float("inf"), 0.0]), (850, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows + bad], "vec_id long, embedding array<double>, first int, key int")
    got = found(vectors, 50, 5)
    assert sorted(got) == [*range(0, 501, 50)]
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[450]] == [0, 1, 2, 3, 4]
    assert [i for i, _ in got[500]] == [501, 0, 1, 2, 3]
    few = spark.createDataFrame([(50, [1.0, 2.0]), (51, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [i for i, _ in found(few, 50, 5)[50]] == [51]
    assert m.nearest(vectors.where("vec_id = 650"), 50, 5).count() == 0


def test_recall_of_the_default_on_64_dimensions(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(12_000, 64)).tolist())]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8), 50, 5)
    right = brute(rows, 50, 5)
    assert got.keys() == right.keys()
    assert recall(got, right) >= 0.94
