"""Secret scan: known forms, and random-looking tokens by a battery of tests.

Known forms are found by pattern. For the rest, tokens of 16 characters or more are
candidates. Each gets the narrowest encoding it fits (digits, hex, letters, base32, letters
and digits of one or both cases, base64), and its characters' places in that alphabet are
tested:

- chi-squared against a uniform alphabet,
- runs above and below the alphabet's middle,
- serial correlation of neighbours.

A token is random-looking if, corrected for three tests, none speaks against it. Short
text may look random by chance, so the same chi-squared is held against what ordinary
text of that length would give; the lower tail is the token's p-value. Within each class
of lengths (16 to 31, 32 to 63, ...) and of kinds (with a letter and a digit, those under
20 characters apart, and without), Benjamini-Hochberg over all candidates of all
documents picks those to report. It reads a histogram of p-values, of at most
``MAX_BIN`` + 1 rows per class.

Everything is DataFrame expressions; no row leaves the executors but the histogram.

Defined results. Null and empty texts have no spans. Repeated rows are scanned each, and
count each in the histogram. Control characters U+0001 and U+0002 in a text take part
in no span. Spans are in code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import bound, running, written

#: Span kinds in the order that breaks ties between equal starts.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
    r"""([A-Za-z0-9+/_.=-]+)"""
)
MIN_ASSIGNED = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"

LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
DIGITS = "0123456789"
#: Encodings from the narrowest on: pattern, alphabet, and the chance that two
#: characters of ordinary text in that alphabet are equal.
ENCODINGS = (
    (r"^[0-9]+$", DIGITS, 0.11),
    (r"^[0-9a-f]+$", DIGITS + "abcdef", 0.11),
    (r"^[0-9A-F]+$", DIGITS + "ABCDEF", 0.11),
    (r"^[a-z]+$", LOWER, 0.065),
    (r"^[A-Z]+$", UPPER, 0.065),
    (r"^[A-Z2-7]+$", UPPER + "234567", 0.065),
    (r"^[A-Z0-9]+$", UPPER + DIGITS, 0.06),
    (r"^[a-z0-9]+$", LOWER + DIGITS, 0.06),
    (r"^[A-Za-z]+$", UPPER + LOWER, 0.055),
    (r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, 0.055),
    (r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", 0.055),
    (r"^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_", 0.055),
    (r"", UPPER + LOWER + DIGITS + "+/_-", 0.055),
)
#: Share of false ones among the reported, and the level of the battery.
FALSE_DISCOVERY = 0.05
BATTERY_LEVEL = 0.003
#: Added to the class of lengths of mixed tokens under ``SHORT``, and of those not mixed.
SHORT, OF_SHORT, OF_UNMIXED = 20, 100, 200
#: p-values are counted in hundredths of their negative decimal logarithm.
BINS, MAX_BIN = 100, 3000

OPEN, CLOSE, NEUTRAL = "\x01", "\x02", "\x03"
SPAN = "struct<start:int,kind:int,end:int>"
FOUND = "struct<start:int,end:int,match:string>"
#: Code points of a text that are masked at once.
PIECE = 4096


def _found(marked: Column) -> Column:
    """Start, end and text of each part of ``marked`` between ``OPEN`` and ``CLOSE``."""

    def placed(part: Column, at: Column) -> Column:
        match = F.substring_index(part, CLOSE, 1)
        return F.struct(at.alias("start"), (at + F.length(match)).alias("end"), match.alias("match"))

    def of(parts: Column) -> Column:
        return running(
            F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
            FOUND,
            lambda part: F.length(part) - 1,
            lambda a, b: a + b,
            F.length(F.get(parts, F.lit(0))),
            F.lit(0),
            placed,
        )

    return bound(F.split(marked, OPEN), of)


def _marked(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}")


def _phi(z: Column) -> Column:
    """The normal distribution function, within 0.0002."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _tested(token: Column) -> Column:
    """``class`` of lengths and kind, and ``bin`` of the p-value; bin 0 for tokens that fail."""
    n = F.length(token).cast("double")
    last = len(ENCODINGS) - 1

    def chosen(values: list) -> Column:
        out = F.lit(values[last])
        for (pattern, _, _), value in reversed(list(zip(ENCODINGS[:last], values, strict=False))):
            out = F.when(token.rlike(pattern), F.lit(value)).otherwise(out)
        return out

    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    kind = F.when(~mixed, OF_UNMIXED).when(n < SHORT, OF_SHORT).otherwise(0)
    alphabet = chosen([a for _, a, _ in ENCODINGS])
    repeat = chosen([r for _, _, r in ENCODINGS])

    def battery(a: Column) -> Column:
        """All of one token, whose alphabet, symbols and counts are ``a``'s fields."""
        size, x = a["size"], a["symbols"]
        chi = size / n * a["squares"] - n
        df = size - 1
        cubes = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        middle, mean = (size + 1) / 2, a["sum"] / n
        pairs = F.transform(
            F.slice(x, F.lit(2), F.size(x)),
            lambda y, i: F.struct(
                F.when((y > middle) != (F.get(x, i) > middle), 1).otherwise(0).alias("turn"),
                ((y - mean) * (F.get(x, i) - mean)).alias("product"),
            ),
        )
        sums = F.aggregate(
            pairs,
            F.struct(F.lit(0.0).alias("turns"), F.lit(0.0).alias("products")),
            lambda s, p: F.struct(
                (s["turns"] + p["turn"]).alias("turns"),
                (s["products"] + p["product"]).alias("products"),
            ),
        )
        high = F.size(F.filter(x, lambda y: y > middle)).cast("double")
        runs = 2 * high * (n - high) / n + 1
        spread = F.greatest((runs - 1) * (runs - 2) / (n - 1), F.lit(1e-9))
        z_runs = (sums["turns"] + 1 - runs) / F.sqrt(spread)
        around = F.greatest(a["sum_squares"] - n * mean * mean, F.lit(1e-9))
        z_serial = sums["products"] / around * F.sqrt(n)
        least = F.least(
            1 - _phi(cubes), 2 * (1 - _phi(F.abs(z_runs))), 2 * (1 - _phi(F.abs(z_serial)))
        )
        excess = n * F.greatest(repeat * size - 1, F.lit(0.1))
        p = _phi((chi - df - excess) / F.sqrt(2 * (df + 2 * excess)))
        bin_ = F.least(F.floor(-BINS * F.log10(F.greatest(p, F.lit(1e-30)))), F.lit(MAX_BIN))
        return F.struct(
            (F.floor(F.log2(n)) + kind).cast("int").alias("class"),
            F.when(3 * least >= BATTERY_LEVEL, bin_).otherwise(F.lit(0)).cast("int").alias("bin"),
        )

    def prepared(letters: Column) -> Column:
        counts = F.transform(
            F.split(letters, ""), lambda c: n - F.length(F.replace(token, c, F.lit("")))
        )
        symbols = F.transform(F.split(token, ""), lambda c: F.instr(letters, c).cast("double"))
        return F.struct(
            F.length(letters).cast("double").alias("size"),
            F.aggregate(counts, F.lit(0.0), lambda s, k: s + k * k).alias("squares"),
            symbols.alias("symbols"),
            F.aggregate(symbols, F.lit(0.0), lambda s, y: s + y).alias("sum"),
            F.aggregate(symbols, F.lit(0.0), lambda s, y: s + y * y).alias("sum_squares"),
        )

    # One-element arrays bind an intermediate value to a name.
    ready = F.transform(F.array(alphabet), prepared)
    return F.get(F.transform(ready, battery), F.lit(0))


def scanned(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """The columns of ``keep`` (as ``_keep0``, ...), ``base`` (spans of known forms, in
    order) and ``candidates`` (with ``class`` and ``bin``)."""
    names = [f"_keep{i}" for i in range(len(keep))]
    clean = F.coalesce(F.col("text"), F.lit(""))
    for mark in (OPEN, CLOSE):
        clean = F.replace(clean, F.lit(mark), F.lit(NEUTRAL))
    base = docs.select(
        *(c.alias(name) for c, name in zip(keep, names, strict=True)), clean.alias("_clean")
    )
    marked = base.select(
        *names,
        _marked(F.col("_clean"), ASSIGN).alias("_assign"),
        _marked(F.col("_clean"), ACCESS).alias("_access"),
        _marked(F.col("_clean"), HEX).alias("_hex"),
        _marked(F.col("_clean"), CANDIDATE).alias("_token"),
    )
    found = marked.select(
        *names,
        _found(F.col("_assign")).alias("_assign"),
        _found(F.col("_access")).alias("_access"),
        _found(F.col("_hex")).alias("_hex"),
        _found(F.col("_token")).alias("_token"),
    )

    def spans(column: Column, kind: str) -> Column:
        return F.transform(
            column,
            lambda x: F.struct(
                x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")
            ),
        )

    long_enough = F.filter(
        "_assign", lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= MIN_ASSIGNED
    )
    return found.select(
        *names,
        F.sort_array(
            F.concat(
                spans(long_enough, "assign"),
                spans(F.col("_access"), "access"),
                spans(F.col("_hex"), "hex"),
            )
        ).alias("base"),
        F.transform(
            "_token",
            lambda x: F.struct(x["start"], x["end"], _tested(x["match"]).alias("test")),
        ).alias("candidates"),
    )


def discoveries(scans: DataFrame, share: float = FALSE_DISCOVERY) -> dict[int, int]:
    """Class -> the bin from which its candidates are reported."""
    counts: dict[int, dict[int, int]] = {}
    rows = (
        scans.select(F.explode("candidates.test").alias("test"))
        .groupBy("test.class", "test.bin")
        .count()
    )
    for row in rows.collect():  # classes times bins at most
        counts.setdefault(row["class"], {})[row["bin"]] = row["count"]
    out = {}
    for length_class, bins in counts.items():
        tested, above = sum(bins.values()), 0
        for bin_ in sorted(bins, reverse=True):
            above += bins[bin_]
            if bin_ and 10 ** (-bin_ / BINS) <= share * above / tested:
                out[length_class] = bin_
    return out


def _either(x: Column, kind: Column, class_: Column, bin_: Column) -> Column:
    return F.struct(
        x["start"].alias("start"),
        kind.alias("kind"),
        x["end"].alias("end"),
        class_.cast("int").alias("class"),
        bin_.cast("int").alias("bin"),
    )


def reported(scans: DataFrame, cuts: dict[int, int]) -> DataFrame:
    """``scans`` with ``spans``: the base spans and the random tokens, in order.

    A random token inside a base span is not reported again.
    """
    at = F.create_map(*(F.lit(x) for pair in sorted(cuts.items()) for x in pair)) if cuts else None
    # One pass over base spans and candidates in order: a candidate is inside a base span if
    # one that begins before it ends behind it. At one start, base spans come first.
    either = F.sort_array(
        F.concat(
            F.transform("base", lambda b: _either(b, F.lit(0), F.lit(None), F.lit(None))),
            F.transform("candidates", lambda c: _either(c, F.lit(1), c["test"]["class"], c["test"]["bin"])),
        )
    )
    flagged = running(
        either,
        "struct<start:int,end:int,class:int,bin:int,out:boolean>",
        lambda x: F.when(x["kind"] == 0, x["end"]).otherwise(-1),
        F.greatest,
        F.lit(-1),
        F.lit(-1),
        lambda x, upto: F.struct(
            x["start"], x["end"], x["class"], x["bin"], ((x["kind"] == 1) & (x["end"] > upto)).alias("out")
        ),
    )

    def discovered(c: Column) -> Column:
        if at is None:
            return F.lit(False)
        return c["out"] & F.coalesce(c["bin"] >= F.try_element_at(at, c["class"]), F.lit(False))

    random = F.filter(flagged, discovered)
    added = F.transform(
        random,
        lambda c: F.struct(
            c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")
        ),
    )
    return scans.withColumn("spans", F.sort_array(F.concat("base", added)))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans in order, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
        ),
        ",",
    )


def find_secrets(docs: DataFrame) -> DataFrame:
    """A row per document: ``doc_id``, ``base`` and ``spans``."""
    scans = written(scanned(docs, [F.col("doc_id")]), "secret-scans")
    found = reported(scans, discoveries(scans))
    return found.select(F.col("_keep0").alias("doc_id"), "base", "spans")


def _merged(spans: Column) -> Column:
    """Spans in order, those that overlap or touch made one."""
    kind = "struct<start:int,end:int,before:int>"

    def of(rows: Column) -> Column:
        # ``before`` is how far the spans before go; a gap to it begins a new one.
        heads = F.filter(rows, lambda x: x["start"] > x["before"])
        ends = F.concat(
            F.transform(F.slice(heads, F.lit(2), F.greatest(F.size(heads) - 1, F.lit(0))), lambda x: x["before"]),
            F.array(F.array_max(F.transform(rows, lambda x: x["end"]))),
        )
        return F.zip_with(
            heads, ends, lambda x, end: F.struct(x["start"].alias("start"), end.alias("end"))
        )

    rows = running(
        spans,
        kind,
        lambda x: x["end"],
        F.greatest,
        F.lit(-1),
        F.lit(-1),
        lambda x, before: F.struct(x["start"], x["end"], before.alias("before")),
    )
    return F.when(F.size(spans) > 0, bound(rows, of)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _cut_out(text: Column, cuts: Column, mask: str) -> Column:
    """``text`` with each of ``cuts`` (in order, apart) replaced by ``mask``.

    A text is masked piece by piece, as a place in a long text is found by going there from
    its start. ``upto`` says how many cuts end at or before each piece begins.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def with_cuts(pieces: Column) -> Column:
        edges = F.transform(
            F.sequence(F.lit(0), F.size(pieces)), lambda i: F.struct((i * PIECE).alias("at"), F.lit(1).alias("kind"))
        )
        ends = F.transform(cuts, lambda c: F.struct(c["end"].alias("at"), F.lit(0).alias("kind")))
        counted = running(
            F.sort_array(F.concat(ends, edges)),
            "struct<kind:int,n:int>",
            lambda x: 1 - x["kind"],
            lambda a, b: a + b,
            F.lit(0),
            F.lit(0),
            lambda x, n: F.struct(x["kind"], n.alias("n")),
        )
        upto = F.transform(F.filter(counted, lambda x: x["kind"] == 1), lambda x: x["n"])
        return F.struct(pieces.alias("pieces"), upto.alias("upto"))

    def joined(held: Column) -> Column:
        def masked(piece: Column, i: Column) -> Column:
            low, high = F.get(held["upto"], i), F.get(held["upto"], i + 1)
            own = F.slice(cuts, low + 1, high - low + 1)  # and one that goes on, if there is one

            def step(s: Column, c: Column) -> Column:
                start, end = c["start"] - i * PIECE, c["end"] - i * PIECE
                return F.struct(
                    F.concat(
                        s["out"],
                        F.substring(piece, s["at"] + 1, F.least(F.greatest(start, F.lit(0)), F.lit(PIECE)) - s["at"]),
                        F.when((start >= 0) & (start < PIECE), mask).otherwise(""),
                    ).alias("out"),
                    F.least(F.greatest(end, s["at"]), F.lit(PIECE)).alias("at"),
                )

            begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
            rest = F.filter(own, lambda c: c["start"] < (i + 1) * PIECE)
            return F.aggregate(
                rest, begin, step, lambda s: F.concat(s["out"], F.substring(piece, s["at"] + 1, F.lit(PIECE)))
            )

        return F.array_join(F.transform(held["pieces"], masked), "")

    return bound(bound(pieces, with_cuts), joined)


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The documents, with each secret in ``text`` replaced by ``mask``.

    ``n_chars``, where there is one, follows the new text. Documents without secrets
    come out as they were.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    scans = written(scanned(docs, [row]), "secret-scans")
    found = reported(scans, discoveries(scans)).select(
        "_keep0", _merged(F.col("spans")).alias("_cuts"), F.col("_keep0.text").alias("_text")
    )
    text = bound(F.col("_cuts"), lambda cuts: _cut_out(F.col("_text"), cuts, mask))
    masked = found.select(
        "_keep0", F.when(F.size("_cuts") > 0, text).otherwise(F.col("_text")).alias("_masked"),
        (F.size("_cuts") > 0).alias("_changed"),
    )

    def column(name: str) -> Column:
        own = F.col("_keep0").getField(name)
        if name == "text":
            return F.col("_masked").alias(name)
        if name == "n_chars":
            size = F.length("_masked").cast(docs.schema[name].dataType)
            return F.when(F.col("_changed"), size).otherwise(own).alias(name)
        return own.alias(name)

    return masked.select(*(column(name) for name in docs.columns))
