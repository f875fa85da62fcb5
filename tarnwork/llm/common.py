"""What several operators share: the shared folder, words, and normal CDFs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder, not yet made, that the driver and all executors can reach.

    It lies under ``spark.checkpoint.dir``, which a session is started with.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError(
            "spark.checkpoint.dir is not set: start the session with a folder there that the "
            "driver and all executors share"
        )
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to the shared folder and read again: it cuts the lineage, and a
    lost executor loses nothing of it."""
    path = shared_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_cut(hashes: DataFrame, n: int) -> int | None:
    """The ``n``-th smallest distinct value of the one column of ``hashes``, 64-bit hashes;
    null if there are fewer.

    Rows are counted first, and only hashes below a bound that some 2 ``n`` rows are
    expected under leave their tasks, each value once per task. So what travels follows
    ``n``, not the number of tasks. If rows are repeated too often for that, the bound is raised.
    """
    (name,) = hashes.columns
    if n < 1:
        return None
    expected = 2 * n
    total = hashes.count()
    while True:
        bound = -(2**63) + 2**64 * expected // max(total, 1)
        within = hashes.where(F.col(name) < bound) if bound < 2**63 else hashes.where(f"`{name}` is not null")
        found = within.distinct().orderBy(name).limit(n).collect()
        if len(found) == n:
            return found[-1][0]
        if bound >= 2**63:
            return None
        expected *= 8


def held_back(df: DataFrame) -> DataFrame:
    """``df`` such that no later filter moves below it.

    A filter that moves through a chain of selects takes the expressions of each into
    itself, and those in a lambda then run once for every element.
    """
    return df.withColumn("_nth", F.monotonically_increasing_id()).where("_nth >= 0").drop("_nth")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once however often ``use`` has it.

    In a lambda, what is no variable of it is computed again for each element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Elements that ``running`` adds up one by one.
RUN = 256


def running(
    items: Column,
    kind: str,
    value: Callable[[Column], Column],
    combine: Callable[[Column, Column], Column],
    first: Column,
    neutral: Column,
    emit: Callable[[Column, Column], Column],
) -> Column:
    """An array of ``emit(x, so_far)``, of type ``kind``, for each ``x`` of ``items``.

    ``so_far`` is ``first`` combined with the values of all elements before. An array grows by
    being copied, so ``items`` are taken in runs of ``RUN``, each from what the runs before
    come to: the work is in proportion to the number of items.
    """
    empty = F.array().cast(f"array<{kind}>")

    def step(state: Column, x: Column) -> Column:
        return F.struct(
            combine(state["at"], value(x)).alias("at"),
            F.concat(state["out"], F.array(emit(x, state["at"]))).alias("out"),
        )

    def in_runs(xs: Column) -> Column:
        last = F.greatest(F.ceil(F.size(xs) / RUN).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(xs, i * RUN + 1, F.lit(RUN)))

    def with_totals(runs: Column) -> Column:
        totals = F.transform(runs, lambda run: F.aggregate(run, neutral, lambda s, x: combine(s, value(x))))
        return F.struct(runs.alias("runs"), totals.alias("totals"))

    def finished(held: Column) -> Column:
        def of(run: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(held["totals"], F.lit(1), i), first, lambda a, b: combine(a, b))
            begin = F.struct(before.alias("at"), empty.alias("out"))
            return F.aggregate(run, begin, step, lambda s: s["out"])

        return F.flatten(F.transform(held["runs"], of))

    return bound(items, lambda xs: bound(in_runs(xs), lambda runs: bound(with_totals(runs), finished)))


def words(text: Column) -> Column:
    """Maximal runs of characters outside ``BLANKS``; an empty array for null."""
    spaced = F.coalesce(text, F.lit(""))
    for blank in BLANKS[1:]:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def count_of(text: Column, pattern: str) -> Column:
    """How many code points of ``text`` lie in matches of ``pattern``."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("bigint")


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    for code in range(ord("A"), ord("Z") + 1):
        text = F.replace(text, F.lit(chr(code)), F.lit(chr(code + 32)))
    return text
