"""Connected components by contraction: every table is a Spark table, none is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``edges`` (a, b).

    Each round points every node at its smallest neighbour, follows the pointers to
    their ends, and joins what points to the same end; rounds go on while edges between
    different ends are left. Nulls and loops in ``edges`` do not count.
    """
    rest = written(
        edges.where("a is not null and b is not null and a != b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    labels = None
    while not rest.isEmpty():
        both = rest.union(rest.select("b", "a"))
        ends = written(
            both.groupBy(F.col("a").alias("node")).agg(
                F.least(F.min("b"), F.first("a")).alias("end")
            ),
            "pointers",
        )
        while True:
            further = ends.select(F.col("node").alias("end"), F.col("end").alias("next"))
            jumped = written(
                ends.join(further, "end").select(
                    "node", F.col("next").alias("end"), (F.col("next") != F.col("end")).alias("moved")
                ),
                "pointers",
            )
            ends = jumped.select("node", "end")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = ends.select("node", F.col("end").alias("component"))
        else:
            labels = labels.join(
                ends.withColumnRenamed("node", "component"), "component", "left"
            ).select("node", F.coalesce("end", "component").alias("component"))
        labels = written(labels, "labels")
        at_a = ends.select(F.col("node").alias("a"), F.col("end").alias("x"))
        at_b = ends.select(F.col("node").alias("b"), F.col("end").alias("y"))
        rest = written(
            rest.join(at_a, "a")
            .join(at_b, "b")
            .where("x != y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
            "edges",
        )
    if labels is None:
        labels = rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
