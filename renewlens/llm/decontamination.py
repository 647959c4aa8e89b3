"""Benchmark decontamination by SimHash of item-sized windows.

A window of a document, as long as a benchmark item, gets a fingerprint of 128 bits: each bit is the
weighted majority of that bit in the hashes of its shingles. Fingerprints are cut into eight blocks.
If two differ in at most 31 bits, some block differs in at most three, so an index that lists every
item's blocks with all changes of up to three bits finds all items within the radius. What is
found is then compared exactly: the windows' and the item's shingles, weighted by how often each
occurs, must be similar enough (sum of the smaller weights over sum of the larger).

Windows are laid wherever enough shingles of the document are shingles of one item, in any order: a
window that is similar enough shares most of the item's shingles with it, so this loses none. They are
also laid where a shingle is at the same place in both, for items of another length. Text that shares
little with any item gets no further fingerprints.

Everything is DataFrame functions; the documents are read twice and only hashes are shuffled.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.llm.common import MOST_BROADCAST_ROWS, free_prefix, small, store, text_of

RADIUS = 31
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 16, 3
_SECOND = 1  # added to a shingle's hash, it gives the other 64 bits


def normalised_words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(words: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` words in their order; none if there are fewer words."""
    count = F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(0), count - length),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(length)]),
    )
    return F.when(count >= length, hashes).otherwise(F.array().cast("array<bigint>"))


def _half(hashes: Column) -> Column:
    """64 majority bits of an array of 64-bit hashes; a tie is 0."""
    count = F.size(hashes)

    def bit(so_far: Column, place: Column) -> Column:
        ones = F.size(F.filter(hashes, lambda h: F.getbit(h, place) == 1))
        return so_far.bitwiseOR(
            F.when(ones * 2 > count, _power(place)).otherwise(F.lit(0).cast("bigint"))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), bit)


def _power(place: Column) -> Column:
    return F.get(F.array(*[F.lit(_signed(1 << i)) for i in range(64)]), place)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprint(rows: DataFrame, hashes: str) -> DataFrame:
    """Adds high and low, the fingerprint of the shingles in column ``hashes``."""
    rows = rows.withColumn("_other", F.transform(hashes, lambda h: F.xxhash64(h, F.lit(_SECOND))))
    return rows.select(
        "*", _half(F.col(hashes)).alias("high"), _half(F.col("_other")).alias("low")
    ).drop("_other")


def _blocks() -> Column:
    """The eight blocks of a fingerprint as numbered values."""
    halves = [
        F.shiftrightunsigned(half, BLOCK_BITS * i).bitwiseAND((1 << BLOCK_BITS) - 1)
        for half in ("high", "low")
        for i in range(64 // BLOCK_BITS)
    ]
    return F.array(*[half.cast("int") for half in halves])


def _changes() -> list[int]:
    """All changes of up to three bits of a block, from a rule."""
    return [
        sum(1 << place for place in places)
        for count in range(BLOCK_RADIUS + 1)
        for places in combinations(range(BLOCK_BITS), count)
    ]


def _numbered(hashes: str) -> Column:
    """A set that stands for the weighted shingles: the n-th time of a shingle is its own element."""
    ordered = F.sort_array(hashes)
    return F.transform(
        ordered, lambda h, i: F.xxhash64(h, (i + 1 - F.array_position(ordered, h)).cast("bigint"))
    )


def _key(id_col: str, text_col: str) -> Column:
    """Stands for a document: ids may be null or repeated."""
    return F.xxhash64(F.col(id_col).cast("string"), text_of(text_col))


def _starts(words: int, percent: int) -> Column:
    """Starts of all windows of ``n_words`` that hold enough of the spots ``ats``.

    Of two sets of the same size, that many must be common for the similarity.
    """
    length = F.col("n_words") - (words - 1)
    needed = F.ceil(length * (2 * percent) / (100 + percent) - 1e-9).cast("int")
    numbers = F.sequence(F.lit(0), F.size("ats") - needed)
    runs = F.transform(
        numbers,
        lambda i: F.struct(
            (F.get("ats", i + needed - 1) - length + 1).alias("least"), F.get("ats", i).alias("most")
        ),
    )
    close = F.filter(runs, lambda run: run["least"] <= run["most"])
    starts = F.array_distinct(
        F.flatten(F.transform(close, lambda run: F.sequence(run["least"], run["most"])))
    )
    return F.when(F.size("ats") >= needed, starts).otherwise(F.array().cast("array<int>"))


def _similar_windows(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    words: int = 5,
    percent: int = 80,
) -> DataFrame:
    """Every window that is similar enough to an item, with the key of its document."""
    own_words = normalised_words(F.col("text"))
    items = benchmark.select(
        F.col(item_col).alias("item_id"), text_of(item_text_col).alias("text")
    ).withColumn("words", own_words)
    items = items.select(
        "item_id", F.size("words").alias("n_words"), shingles(F.col("words"), words).alias("item_hashes")
    ).filter(F.size("item_hashes") > 0)
    items = store(
        with_fingerprint(items, "item_hashes")
        .withColumn("item", F.monotonically_increasing_id())
        .withColumn("item_set", _numbered("item_hashes")),
        "leaks-items",
    )
    # Items with the same shingles lay the same windows.
    places = items.select(
        "n_words",
        F.xxhash64(F.sort_array("item_hashes")).alias("shape"),
        F.posexplode("item_hashes").alias("place", "hash"),
    )

    # A key that two documents share lays windows on both, which the comparison sorts out.
    rows = documents.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("key", _key("doc_id", "text"))
    hashed = rows.withColumn("words", own_words).select(
        "key", shingles(F.col("words"), words).alias("hashes")
    )
    # The outer form keeps Spark from testing the array beforehand, which would build it twice.
    spots = hashed.select("key", F.posexplode_outer("hashes").alias("at", "hash"))
    shared = (
        spots.join(small(places.distinct()), "hash")
        .groupBy("key", "shape", "n_words")
        .agg(
            F.sort_array(F.collect_set("at")).alias("ats"),
            F.collect_set(F.col("at") - F.col("place")).alias("aligned"),
        )
    )
    windows = shared.select(
        "key", F.explode(F.array_union("aligned", _starts(words, percent))).alias("begin"), "n_words"
    ).distinct()
    by_document = store(
        windows.groupBy(F.col("key").alias("w_key")).agg(
            F.collect_list(F.struct("begin", "n_words")).alias("windows")
        ),
        "leaks-windows",
    )

    # Each row holds all windows of a document, so these are counted.
    n_windows = by_document.agg(F.sum(F.size("windows"))).first()[0] or 0
    few = n_windows <= MOST_BROADCAST_ROWS
    by_document = F.broadcast(by_document) if few else by_document.hint("merge")
    held = rows.join(by_document, F.col("key") == F.col("w_key"))
    held = held.withColumn("words", own_words).withColumn(
        "hashes", shingles(F.col("words"), words)
    )
    laid = held.select(
        "key", "doc_id", "hashes", F.explode("windows").alias("window")
    ).select(
        "key",
        "doc_id",
        "hashes",
        F.col("window.n_words").alias("n_words"),
        (F.col("window.n_words") - (words - 1)).alias("length"),
        F.col("window.begin").alias("begin"),
    )
    last = F.greatest(F.lit(0), F.size("hashes") - F.col("length"))
    laid = laid.withColumn("start", F.greatest(F.lit(0), F.least(F.col("begin"), last)))
    laid = laid.select(
        "key",
        "doc_id",
        "start",
        "n_words",
        F.slice("hashes", F.col("start") + 1, F.col("length")).alias("window_hashes"),
    ).distinct()
    marked = store(
        with_fingerprint(laid, "window_hashes").withColumn(
            "window_set", _numbered("window_hashes")
        ).drop("window_hashes"),
        "leaks-fingerprints",
    )
    probes = marked.select(
        "key", "doc_id", "start", "n_words", "high", "low", "window_set",
        F.posexplode(_blocks()).alias("block", "value"),
    )
    index = items.select(
        "item", "item_id", "item_set", F.col("high").alias("i_high"), F.col("low").alias("i_low"),
        F.posexplode(_blocks()).alias("i_block", "i_value"),
    )
    near = index.select(
        "item", F.col("i_high"), F.col("i_low"), "i_block",
        F.explode(
            F.transform(
                F.array(*[F.lit(change) for change in _changes()]),
                lambda change: change.bitwiseXOR(F.col("i_value")),
            )
        ).alias("i_value"),
    )
    # An item has 8 blocks with 697 values each.
    few = items.count() * BLOCKS * len(_changes()) <= MOST_BROADCAST_ROWS
    near = F.broadcast(near) if few else near.hint("merge")
    distance = F.bit_count(F.col("high").bitwiseXOR(F.col("i_high"))) + F.bit_count(
        F.col("low").bitwiseXOR(F.col("i_low"))
    )
    candidates = (
        probes.join(
            near,
            (F.col("block") == F.col("i_block"))
            & (F.col("value") == F.col("i_value"))
            & (distance <= RADIUS),
        )
        .select("key", "doc_id", "start", "n_words", "window_set", "item")
        .distinct()
    )
    compared = candidates.join(
        small(items.select(F.col("item").alias("c_item"), "item_id", "item_set")),
        F.col("item") == F.col("c_item"),
    )
    common = F.size(F.array_intersect("window_set", "item_set"))
    union = F.size("window_set") + F.size("item_set") - common
    similar = compared.withColumn("common", common).withColumn("union", union)
    return similar.filter(F.col("common") * 100 >= F.col("union") * percent)


def find_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    words: int = 5,
    percent: int = 80,
) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, similarity, start, n_words.

    ``start`` and ``n_words`` give the most similar window in normalised words (the first of equals).
    A document shorter than an item is one window. An item with fewer words than a shingle matches
    nothing, nor does a null or empty text. Null ids are kept as null; rows with the same id give one
    row per item. Repeated items are found one by one. Empty tables give no rows; other columns are
    not read.
    """
    similar = _similar_windows(
        documents,
        benchmark,
        id_col=id_col,
        text_col=text_col,
        item_col=item_col,
        item_text_col=item_text_col,
        words=words,
        percent=percent,
    )
    best = (
        similar.groupBy("doc_id", "item_id", "item")
        .agg(
            F.max(
                F.struct(
                    (F.col("common") / F.col("union")).alias("similarity"),
                    (-F.col("start")).alias("back"),
                    "n_words",
                )
            ).alias("best")
        )
    )
    return best.select(
        "doc_id",
        "item_id",
        F.col("best.similarity").alias("similarity"),
        (-F.col("best.back")).cast("bigint").alias("start"),
        F.col("best.n_words").cast("bigint").alias("n_words"),
    )


def without_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """The documents, with all their columns, that hold no item; each is judged by its own text."""
    found = _similar_windows(documents, benchmark, id_col=id_col, text_col=text_col, **options)
    name = free_prefix(documents.columns, "_leaking")
    leaking = store(found.select(F.col("key").alias(name)).distinct(), "leaks-documents")
    return documents.join(small(leaking), _key(id_col, text_col) == F.col(name), "left_anti")
