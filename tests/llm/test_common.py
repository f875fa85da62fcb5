import random

import pytest
from pyspark.sql import functions as F

from tarnwork.llm import common


@pytest.mark.parametrize(("rows", "distinct", "n"), [(5000, 5000, 100), (5000, 3000, 1), (300, 300, 300), (20, 20, 21), (4000, 40, 30), (0, 1, 5)])
def test_the_cut_is_the_nth_smallest_hash(spark, rows, distinct, n):
    rng = random.Random(rows)
    values = [rng.getrandbits(64) - 2**63 for _ in range(distinct)]
    held = [values[i % distinct] for i in range(rows)]
    got = common.hash_cut(spark.createDataFrame([(v,) for v in held], "h long").repartition(9), n)
    ordered = sorted(set(held))
    assert got == (ordered[n - 1] if len(ordered) >= n else None)


def test_one_value_that_most_rows_have_does_not_hide_the_others(spark):
    held = [-(2**62)] * 5000 + list(range(-50, 50))
    assert common.hash_cut(spark.createDataFrame([(v,) for v in held], "h long"), 20) == -32
    assert common.hash_cut(spark.range(5).select(F.col("id").alias("h")), 0) is None


@pytest.mark.parametrize("run", [1, 4, 256])
def test_running_sums(spark, monkeypatch, run):
    monkeypatch.setattr(common, "RUN", run)
    rows = [(n, list(range(n, 0, -1))) for n in (0, 1, 3, 4, 5, 16, 17, 300)]
    docs = spark.createDataFrame(rows, "n int, items array<int>")
    sums = common.running(
        F.col("items"), "struct<x:int,at:int>", lambda x: x, lambda a, b: a + b, F.col("n") * 100, F.lit(0),
        lambda x, at: F.struct(x.alias("x"), at.alias("at")),
    )
    for r in docs.select("n", "items", sums.alias("out")).collect():
        before = [100 * r["n"] + sum(r["items"][:i]) for i in range(r["n"])]
        assert [(x["x"], x["at"]) for x in r["out"]] == list(zip(r["items"], before))


def test_a_session_without_a_shared_folder_is_refused():
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session(), "x")
