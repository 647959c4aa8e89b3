"""Quality rules as a short-circuit cascade.

Every rule is an expression that is true for a text to reject. Its cost (seconds a row) and its
selectivity (share of rows it rejects) are measured on a bounded sample, and the rules are applied
in the order of rejection per cost, so that a cheap rule that rejects much spares the dear ones.
The order decides only how fast a verdict is found and which of several failing rules is named.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from math import log10
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.llm.common import SPACES, store, text_of, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
SAMPLE_ROWS = 2_000
# How often the sample's rows are repeated to time a rule, runs of each, and the limits of noise.
REPEATS = (1, 16, 128)
RUNS = 3
LEAST_SECONDS = 0.1
LEAST_COST = 1e-6


@dataclass(frozen=True)
class Rule:
    """``rejects`` is built from the columns of :func:`with_counts`."""

    name: str
    rejects: Column


@dataclass(frozen=True)
class Measured:
    rule: Rule
    cost: float
    selectivity: float


def rules() -> list[Rule]:
    """The production rules. All compare whole numbers, so that every engine agrees."""
    capitals = F.regexp_count(F.col("text"), F.lit(r"\p{Lu}"))
    letters = F.regexp_count(F.col("text"), F.lit(r"\p{L}"))
    digits = F.regexp_count(F.col("text"), F.lit("[0-9]"))
    shouts = F.regexp_count(F.col("text"), F.lit("!"))
    words = F.col("words")
    same = F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1)))
    return [
        Rule("symbols", F.col("n_symbols") * 100 > F.col("word_chars") * 5),
        Rule("duplicate lines", F.col("n_dup_lines") * 100 > F.col("n_lines") * 50),
        Rule("short words", F.col("word_chars") < F.col("n_words") * 2),
        Rule("long words", F.col("word_chars") > F.col("n_words") * 20),
        Rule("digits", digits * 100 > F.col("word_chars") * 50),
        Rule("exclamations", shouts * 100 > F.col("n_words") * 50),
        Rule("capitals", capitals * 100 > letters * 60),
        Rule("stutter", F.size(same) * 100 > F.col("n_words") * 30),
    ]


def with_counts(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, text and words with word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    n_repeat_words counts the words in windows of five words that occur twice or more. Windows
    are compared by a 64-bit hash. Where all are distinct the count is 0 without a sort; else the
    positions of equal windows are put in order, and each covers the words up to the next.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    word = F.col("words")
    rows = rows.withColumn("words", words_of(F.col("text")))
    rows = rows.withColumn("n_words", F.size("words").cast("bigint"))
    solid = F.translate("text", SPACES, "")
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    last = (F.col("n_words") - WINDOW).cast("int")
    hashes = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.xxhash64(*[F.get(word, i + k) for k in range(WINDOW)]),
    )
    rows = rows.select(
        "*",
        F.length(solid).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, "")))
        .cast("bigint")
        .alias("n_symbols"),
        lines.alias("_lines"),
        F.when(last >= 0, hashes).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    rows = rows.select(
        "*",
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines")))
        .cast("bigint")
        .alias("n_dup_lines"),
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_sorted"),
    ).drop("_lines", "_windows")
    ordered = F.col("_sorted")
    equal = F.filter(
        ordered,
        lambda x, i: F.coalesce(x["h"] == F.get(ordered, i - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get(ordered, i + 1)["h"], F.lit(False)),
    )
    rows = rows.withColumn(
        "_places", F.when(ordered.isNotNull(), F.sort_array(F.transform(equal, lambda x: x["i"])))
    ).drop("_sorted")
    places = F.col("_places")
    covered = F.aggregate(
        F.transform(
            places,
            lambda p, i: F.least(
                F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))
            ).cast("bigint"),
        ),
        F.lit(0).cast("bigint"),
        lambda total, n: total + n,
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop(
        "_places"
    )


def measure(sample: DataFrame, candidates: list[Rule]) -> list[Measured]:
    """Cost and selectivity of each rule on a stored sample that has the counts.

    The rows are repeated until a rule takes ``LEAST_SECONDS`` longer than counting them, or as often
    as ``REPEATS`` allows; the median of several runs counts. Costs are compared by their power of
    ten, and those below ``LEAST_COST`` are equal, so that the order does not follow the clock's noise.
    """

    def run(repeats: int, column: Column) -> tuple[float, int]:
        rows = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
        took = []
        for _ in range(RUNS):
            begin = time.perf_counter()
            (found,) = rows.agg(column).first()
            took.append(time.perf_counter() - begin)
        return median(took), found

    idle = {repeats: run(repeats, F.count(F.lit(1))) for repeats in REPEATS}
    size = idle[REPEATS[0]][1] // REPEATS[0]
    measured = []
    for rule in candidates:
        for repeats in REPEATS:
            seconds, hits = run(repeats, F.count(F.when(rule.rejects, 1)))
            seconds -= idle[repeats][0]
            if seconds >= LEAST_SECONDS:
                break
        cost = max(seconds / max(size * repeats, 1), LEAST_COST)
        selectivity = (hits / repeats + 0.5) / (size + 1)
        measured.append(Measured(rule, 10.0 ** round(log10(cost)), selectivity))
    return measured


def in_order(measured: list[Measured]) -> list[Rule]:
    """Most rejection per cost first; a tie goes by cost, then by name."""
    ranked = sorted(measured, key=lambda m: (-m.selectivity / m.cost, m.cost, m.rule.name))
    return [m.rule for m in ranked]


def verdict(ordered: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are then not evaluated."""
    found = F.lit(None).cast("string")
    for rule in reversed(ordered):
        found = F.when(rule.rejects, F.lit(rule.name)).otherwise(found)
    return found


def base_failed() -> Column:
    """Fewer than ten words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def judge(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    candidates: list[Rule] | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Every row of ``documents`` with its counts, base_failed, rejected_by and kept.

    About ``sample_rows`` random rows serve to order the rules.

    A null text counts as empty and fails the base rule; nulls in other columns, repeated rows and
    clashing names of other columns do not matter, as only id and text are read. An empty table
    gives no rows.
    """
    counted = with_counts(documents, id_col=id_col, text_col=text_col)
    chosen = rules() if candidates is None else candidates
    # Drawn before anything is counted, so only the sample is counted twice.
    share = min(1.0, sample_rows / max(documents.count(), 1))
    drawn = documents.sample(fraction=share, seed=1)
    sample = store(with_counts(drawn, id_col=id_col, text_col=text_col), "quality-sample")
    ordered = in_order(measure(sample, chosen))
    judged = counted.withColumn("base_failed", base_failed())
    judged = judged.withColumn("rejected_by", F.when(~F.col("base_failed"), verdict(ordered)))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"),
        "rejected_by",
    )
