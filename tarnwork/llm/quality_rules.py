"""Quality rules: a decision list learned by sequential covering.

Statistics of each text, the growing and pruning of rules, and the verdict are
DataFrame operations. Only counts per statistic and threshold (a few hundred rows,
whatever the input) reach the driver.

Defined results. Null or empty text: no words, so ``base_failed`` and not kept.
No usable labels, or labels of one class only: no rule is learned and the base rule
alone decides. A document labelled twice counts twice; labels of unknown documents
and null labels do not count. Repeated rows and extra columns pass through unchanged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import BLANKS, count_of, hash_cut, held_back, words, written

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

#: What rules may test.
FEATURES = (
    "n_words",
    "mean_word_chars",
    "symbol_ratio",
    "shout_ratio",
    "dup_line_ratio",
    "repeat_ratio",
)


@dataclass(frozen=True)
class Condition:
    """``feature > threshold``, or ``feature <= threshold`` where ``above`` is false."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value, threshold = F.col(self.feature), F.lit(self.threshold)
        return value > threshold if self.above else value <= threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class DecisionList:
    """Conjunctions in order; the first that holds rejects a document, else it is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def matched(self) -> Column:
        """The number of the first rule that holds, from 1, else null."""
        out = F.lit(None).cast("int")
        for number, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(_all(rule), F.lit(number)).otherwise(out)
        return out

    def __str__(self) -> str:
        lines = [f"reject if {' and '.join(map(str, rule))}" for rule in self.rules]
        return "\n".join([*lines, "else keep"])


def _all(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def with_statistics(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """The columns of ``keep`` (as ``_keep0``, ``_keep1``, ...) and the statistics of each
    ``text``, a row for a row.

    A word is repeated if it lies in a three-word window whose words occur as a
    window twice or more. Most texts have no two windows of equal hash, and are done with
    that. In the others, the windows whose hash has a neighbour when sorted are compared
    as text.
    """
    names = [f"_keep{i}" for i in range(len(keep))]
    base = docs.select(
        *(c.alias(name) for c, name in zip(keep, names, strict=True)),
        F.coalesce(F.col("text"), F.lit("")).alias("_text"),
        words(F.col("text")).alias("_words"),
    )
    counted = base.select(
        *names,
        "_words",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        count_of(F.col("_text"), "[#*$%&|<>]+").alias("n_symbols"),
        (F.length("_text") - F.length(F.replace("_text", F.lit("!"), F.lit("")))).alias("_shouts"),
        F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("_lines"),
        F.slice(
            F.transform(
                "_words",
                lambda x, i: F.xxhash64(x, F.get("_words", i + 1), F.get("_words", i + 2)),
            ),
            F.lit(1),
            F.greatest(F.size("_words") - 2, F.lit(0)),
        ).alias("_windows"),
    )
    tested = counted.select(
        "*", (F.size(F.array_distinct("_windows")) < F.size("_windows")).alias("_twice")
    )
    places = F.transform(
        "_windows", lambda x, i: x.bitwiseAND(F.lit(-(2**32))).bitwiseOR(i.cast("bigint"))
    )
    ordered = tested.select(
        *names,
        "_words",
        "n_words",
        "word_chars",
        "n_symbols",
        "_shouts",
        F.size("_lines").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("_twice"), F.sort_array(places)).alias("_places"),
    )

    def same(x: Column, j: Column) -> Column:
        return F.shiftright(x, 32).eqNullSafe(F.shiftright(F.get("_places", j), 32))

    def spelled(x: Column) -> Column:
        i = x.bitwiseAND(F.lit(2**32 - 1)).cast("int")
        at = [F.get("_words", i + k) for k in range(3)]
        return F.struct(F.concat_ws(" ", *at).alias("words"), i.alias("at"))

    paired = F.filter("_places", lambda x, j: same(x, j - 1) | same(x, j + 1))
    near = ordered.select(
        *names,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "_shouts",
        "_n_lines",
        F.sort_array(F.transform(paired, spelled)).alias("_paired"),
    )

    def equal(x: Column, j: Column) -> Column:
        return x["words"].eqNullSafe(F.get("_paired", j)["words"])

    repeated = F.filter("_paired", lambda x, j: equal(x, j - 1) | equal(x, j + 1))
    covered = F.flatten(
        F.transform(repeated, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2))
    )
    done = near.select(
        *names,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(F.size(F.array_distinct(covered)), F.lit(0))
        .cast("bigint")
        .alias("n_repeat_words"),
        "_shouts",
        "_n_lines",
    )

    def share(part: str, whole: str) -> Column:
        return F.col(part) / F.greatest(F.col(whole), F.lit(1)).cast("double")

    return done.select(
        *names,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (
            (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
        ).alias("base_failed"),
        share("word_chars", "n_words").alias("mean_word_chars"),
        share("n_symbols", "word_chars").alias("symbol_ratio"),
        share("_shouts", "word_chars").alias("shout_ratio"),
        share("n_dup_lines", "_n_lines").alias("dup_line_ratio"),
        share("n_repeat_words", "n_words").alias("repeat_ratio"),
    )


def labelled_statistics(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """Statistics and ``bad`` (quality 0) of at most ``max_labelled`` labelled documents.

    Of more labels, those with the smallest hashes of ``doc_id`` count. Their bound is
    that of the broadcast. A label given many times is counted before it travels.
    """
    usable = labels.where("doc_id is not null and quality is not null").select(
        F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("_bad")
    )
    cut = hash_cut(usable.select(F.xxhash64("_id").alias("h")), max_labelled)
    if cut is not None:
        usable = usable.where(F.xxhash64("_id") <= cut)
    times = F.least(F.count("*"), F.lit(max_labelled)).cast("int")
    sample = (
        usable.groupBy("_id", "_bad")
        .agg(times.alias("_times"))
        .orderBy(F.xxhash64("_id"), "_id", "_bad")
        .limit(max_labelled)
        .select("_id", "_bad", F.explode(F.sequence(F.lit(1), "_times")))
        .select("_id", "_bad")
        .limit(max_labelled)
    )
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(sample), "_id")
    found = with_statistics(rows, [F.col("_id"), F.col("_bad")])
    return found.select(
        F.col("_keep1").alias("bad"),
        (F.pmod(F.xxhash64("_keep0", F.lit(7)), F.lit(3)) == 0).alias("held"),
        "base_failed",
        *(F.col(name).cast("double").alias(name) for name in FEATURES),
    )


def thresholds(rows: DataFrame, cuts: int) -> dict[str, list[float]]:
    """Midpoints between neighbouring quantiles of either class, for each feature."""
    shares = F.array(*(F.lit(i / cuts) for i in range(cuts + 1)))
    stats = rows.groupBy("bad").agg(
        *(F.percentile(name, shares).alias(name) for name in FEATURES)
    )
    points: dict[str, set[float]] = {name: set() for name in FEATURES}
    for row in stats.collect():  # two rows
        for name in FEATURES:
            points[name].update(row[name])
    out = {}
    for name, values in points.items():
        ordered = sorted(values)
        out[name] = [(a + b) / 2 for a, b in zip(ordered, ordered[1:], strict=False)]
    return out


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, int], tuple[int, int]]:
    """(feature, number of its thresholds below the value) -> bad and good rows."""

    def bin_of(name: str) -> Column:
        below = F.filter(F.lit(cuts[name]), lambda threshold: threshold < F.col(name))
        return F.struct(F.lit(name).alias("feature"), F.size(below).alias("bin"))

    bins = [bin_of(name) for name in FEATURES if cuts[name]]
    found = (
        rows.select("bad", F.explode(F.array(*bins)).alias("at"))
        .groupBy("at.feature", "at.bin")
        .agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    )
    return {(r["feature"], r["bin"]): (r["bad"], r["good"]) for r in found.collect()}


def _best(
    counts: dict[tuple[str, int], tuple[int, int]], cuts: dict[str, list[float]]
) -> tuple[Condition, int, int] | None:
    """The condition with the largest information gain for bad rows; ties to the first."""
    best, best_gain = None, 1e-9
    for name in FEATURES:
        per_bin = [counts.get((name, b), (0, 0)) for b in range(len(cuts[name]) + 1)]
        bad, good = (sum(x[k] for x in per_bin) for k in (0, 1))
        if not bad or not good:
            continue
        before = math.log2(bad / (bad + good))
        low_bad = low_good = 0
        for threshold, (b, g) in zip(cuts[name], per_bin, strict=False):
            low_bad, low_good = low_bad + b, low_good + g
            for above, p, n in (
                (True, bad - low_bad, good - low_good),
                (False, low_bad, low_good),
            ):
                if p and (gain := p * (math.log2(p / (p + n)) - before)) > best_gain:
                    best, best_gain = (Condition(name, above, threshold), p, n), gain
    return best


def fit(
    rows: DataFrame,
    cuts: int = 32,
    max_rules: int = 8,
    max_conditions: int = 4,
    min_covered: int = 5,
    min_precision: float = 0.95,
) -> DecisionList:
    """Learn a decision list from ``bad``, ``held`` and ``FEATURES``.

    Two thirds of the rows grow each rule, condition by condition, by information gain;
    the held third cuts it back to the prefix with the best share of bad rows less good
    ones. A rule is taken if the held rows give it ``min_precision`` and it covers
    ``min_covered`` bad ones in all; what it covers is then taken out.
    """
    at = thresholds(rows, cuts)
    found = DecisionList()
    rest = rows
    while len(found.rules) < max_rules and any(at.values()):
        rule: tuple[Condition, ...] = ()
        grown = rest.where("not held")
        while len(rule) < max_conditions:
            best = _best(_counts(grown.where(_all(rule)), at), at)
            if best is None:
                break
            rule += (best[0],)
            if best[2] == 0:
                break
        if not rule:
            break
        prefixes = [rule[:n] for n in range(1, len(rule) + 1)]
        tally = rest.agg(
            *(
                F.count_if(_all(p) & (F.col("bad") == bad) & (F.col("held") == held)).alias(
                    f"c{i}_{int(bad)}_{int(held)}"
                )
                for i, p in enumerate(prefixes)
                for bad in (True, False)
                for held in (True, False)
            )
        ).first()

        def worth(i: int, row=tally) -> float:
            bad, good = row[f"c{i}_1_1"], row[f"c{i}_0_1"]
            return (bad - good) / (bad + good) if bad + good else -1.0

        i = max(range(len(prefixes)), key=lambda k: (worth(k), -k))
        bad, good = tally[f"c{i}_1_1"], tally[f"c{i}_0_1"]
        covered = bad + tally[f"c{i}_1_0"]
        if not bad or bad < min_precision * (bad + good) or covered < min_covered:
            break
        found.rules.append(prefixes[i])
        rest = rest.where(~_all(prefixes[i]))
    return found


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DecisionList:
    """A decision list from a bounded sample of the labelled documents."""
    rows = written(labelled_statistics(docs, labels, max_labelled), "quality-labelled")
    return fit(rows.where("not base_failed"))


def judged(docs: DataFrame, rules: DecisionList, keep: list[Column]) -> DataFrame:
    """Statistics, ``rule`` (number of the rule that rejects, else null) and ``kept``."""
    found = with_statistics(docs, keep)
    return found.select(
        "*",
        rules.matched().alias("rule"),
        (~F.col("base_failed") & rules.matched().isNull()).alias("kept"),
    )


def quality(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """A row per document: ``doc_id``, its statistics, ``rule`` and ``kept``."""
    return judged(docs, rules, [F.col("doc_id")]).withColumnRenamed("_keep0", "doc_id")


def keep_good(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The documents that the list keeps, with the columns they came with."""
    out = judged(docs, rules, [F.struct(*(F.col(f"`{c}`") for c in docs.columns))])
    return held_back(out).where("kept").select("_keep0.*")
