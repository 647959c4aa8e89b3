"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed 60-bit hash. A histogram of words by source and hash bucket shows the
bucket in which a source's budget runs out; only that bucket is split further, until a single
hash is left. What is below the threshold is taken: a filter, without sorting documents.

A source that is to give more than it has is taken whole, and the documents below its threshold
a second time, so that repeats are a subset of what is taken.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renewlens.llm.common import WORD, free_prefix, small, store, text_of

BITS_A_LEVEL = 12
LEVELS = 5
# Beyond so many sources the table of thresholds is joined by a shuffle instead of a broadcast.
MOST_BROADCAST_SOURCES = 50_000


def document_hash(id_col: str, text_col: str) -> Column:
    """60 bits of the md5 of id and text, so that only fully repeated rows share a hash."""
    whole = F.concat(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text_of(text_col))
    )
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("bigint")


def targets(
    sizes: DataFrame, *, share: float, weights: tuple[int, ...], most: int
) -> DataFrame:
    """One row per source: source_size, target.

    ``sizes`` has one row per source. Sources in code point order, null last, take the weights in
    turn. A source's target stops at ``most`` times its size, and what is cut off goes to the
    others by weight until none is above: with sources ordered by cap per weight, the capped ones
    are a prefix, and the first source below its cap fixes the level for all that follow. The
    windows without a partition see one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    weight = reduce(
        lambda so_far, i: so_far.when(rank == i, weights[i]),
        range(1, len(weights)),
        F.when(rank == 0, weights[0]),
    )
    ranked = sizes.select(
        "source",
        "source_size",
        weight.cast("bigint").alias("weight"),
        (F.col("source_size") * most).alias("cap"),
    )
    ratio = F.col("cap") / F.col("weight")
    order = Window.orderBy(ratio.asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double") * share
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    levels = ranked.select("*", level.alias("level"), ratio.alias("ratio"))
    chosen = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level")))
    levels = levels.withColumn("level", chosen.over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return levels.select(
        "source", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target")
    )


def thresholds(documents: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the hash below which its documents fit its budget.

    ``documents``: source, size, hash; ``budgets``: source, budget. Every level sums words by source
    and bucket of the documents that share the boundary so far, and keeps the first bucket with
    which the budget is exceeded. At the last level a bucket is one hash; it is taken if the
    sum comes closer to the budget with it than without. A source that fits as a whole gets no row.
    """
    state = budgets.select(
        "source", "budget", F.lit(0).cast("bigint").alias("below"), F.lit(0).cast("bigint").alias("prefix")
    )
    rows = documents.select("source", "size", "hash").alias("d")
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, 0
    )
    for level in range(1, LEVELS + 1):
        shift = BITS_A_LEVEL * (LEVELS - level)
        # A prefix holds those of the levels before, so only the last state is joined.
        on_edge = F.col("d.source").eqNullSafe(F.col("t.source"))
        if level > 1:
            on_edge &= F.shiftright("hash", shift + BITS_A_LEVEL) == F.col("prefix")
        rest = rows.join(small(state, MOST_BROADCAST_SOURCES).alias("t"), on_edge).select(
            "d.source", "budget", "below", "size", F.shiftright("hash", shift).alias("bucket")
        )
        sums = rest.groupBy("source", "budget", "below", "bucket").agg(F.sum("size").alias("words"))
        over = sums.withColumn("upto", F.col("below") + F.sum("words").over(running)).filter(
            F.col("upto") > F.col("budget")
        )
        first = over.groupBy("source", "budget").agg(
            F.min(F.struct("bucket", "words", "upto")).alias("first")
        )
        state = store(
            first.select(
                "source",
                "budget",
                (F.col("first.upto") - F.col("first.words")).alias("below"),
                F.col("first.bucket").alias("prefix"),
                F.col("first.words").alias("words"),
            ),
            f"mixing-level-{level}",
        )
    nearer = 2 * (F.col("budget") - F.col("below")) > F.col("words")
    return state.select(
        "source", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("threshold")
    )


def sized(documents: DataFrame, *, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size in words (0 for a null text), hash; stored, as it is read repeatedly."""
    return store(
        documents.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0))
            .cast("bigint")
            .alias("size"),
            document_hash(id_col, text_col).alias("hash"),
        ),
        "mixing-sizes",
    )


def plan(
    sizes: DataFrame,
    *,
    share: float = 1.5,
    weights: tuple[int, ...] = (3, 1, 2),
    most: int = 2,
) -> DataFrame:
    """One row per source: source, source_size, target, rounds, threshold.

    A document is taken ``rounds`` times, and once more if its hash is below ``threshold``.
    """
    if most < 1:
        raise ValueError("most must be at least 1")
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = store(targets(by_source, share=share, weights=weights, most=most), "mixing-targets")
    rounds = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(1)
    aims = aims.withColumn("rounds", rounds.cast("bigint"))
    budget = F.col("target") - F.col("rounds") * F.col("source_size")
    part = aims.select("source", budget.alias("budget")).filter("budget > 0")
    found = thresholds(sizes, part)
    return store(
        aims.alias("a")
        .join(found.alias("f"), F.col("a.source").eqNullSafe(F.col("f.source")), "left")
        .select(
            "a.source",
            "source_size",
            "target",
            "rounds",
            F.coalesce("threshold", F.lit(0)).alias("threshold"),
        ),
        "mixing-plan",
    )


def apply(
    documents: DataFrame, mix: DataFrame, *, source: str, hash_column: Column
) -> DataFrame:
    """The documents with how often each is taken, and its source's row of the plan.

    These columns, ``copies``, ``source``, ``source_size``, ``target``, ``rounds`` and ``threshold``,
    have names that ``added`` gives, so that they clash with none of the documents'.
    """
    name = added(documents)
    renamed = mix.select(
        *[
            F.col(column).alias(name(column))
            for column in ("source", "source_size", "target", "rounds", "threshold")
        ]
    )
    joined = documents.join(
        small(renamed, MOST_BROADCAST_SOURCES),
        F.col(source).cast("string").eqNullSafe(F.col(name("source"))),
    )
    once_more = F.when(hash_column < F.col(name("threshold")), 1).otherwise(0)
    return joined.withColumn(name("copies"), F.col(name("rounds")) + once_more)


def added(documents: DataFrame) -> Callable[[str], str]:
    """Names of what ``apply`` adds to a table."""
    prefix = free_prefix(documents.columns, "_mix_")
    return lambda column: f"{prefix}{column}"


def mix(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    weights: tuple[int, ...] = (3, 1, 2),
    most: int = 2,
) -> DataFrame:
    """Per row of ``documents``: doc_id, size, source_size, target, taken (words, repeats counted).

    Defined for: null text (size 0), null source (a source of its own, last), null id (the text
    tells rows apart), repeated rows (taken or left together), an empty table (no rows) and a source
    without words (taken once, 0 words). Other columns are not read.
    """
    sizes = sized(documents, id_col=id_col, text_col=text_col, source_col=source_col)
    chosen = plan(sizes, share=share, weights=weights, most=most)
    applied = apply(sizes, chosen, source="source", hash_column=F.col("hash"))
    name = added(sizes)
    return applied.select(
        "doc_id",
        "size",
        F.col(name("source_size")).alias("source_size"),
        F.col(name("target")).alias("target"),
        (F.col("size") * F.col(name("copies"))).alias("taken"),
    )


def mixed_documents(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    weights: tuple[int, ...] = (3, 1, 2),
    most: int = 2,
) -> DataFrame:
    """The documents of the mix with all their columns; one that is taken twice is there twice."""
    sizes = sized(documents, id_col=id_col, text_col=text_col, source_col=source_col)
    chosen = plan(sizes, share=share, weights=weights, most=most)
    applied = apply(
        documents, chosen, source=source_col, hash_column=document_hash(id_col, text_col)
    )
    name = added(documents)
    repeated = applied.filter(F.col(name("copies")) > 0).withColumn(
        name("copy"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(name("copies"))))
    )
    return repeated.select(*[repeated[f"`{name}`"] for name in documents.columns])
