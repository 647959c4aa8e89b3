"""Line dedup: explode normalised lines, hash them, count documents per hash, drop, reassemble.

A line's key is the line stripped of white space, A-Z in lower case. Keys are compared by a
128-bit hash. A key found in at least ``min_documents`` documents stays only in the document
with the smallest id that holds it, with all its lines there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.llm.common import SPACES, lower_ascii, small, store, text_of

MOST_BROADCAST_LINES = 500_000


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def dedup_lines(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = 10,
    min_documents: int = 2,
) -> DataFrame:
    """Per row of ``documents``: doc_id, text (what is left), n_lines (before), n_dropped.

    Only hashes travel: each document gives its long keys once, two shuffles count the documents of a
    key and find the first, and the positions to drop come back to the document. Rows with the same
    id are one document for the counts and keep their own lines. A null text is one empty line; a
    null id is the smallest. An empty table gives no rows; other columns are not read.
    """
    rows = documents.select(
        F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")
    ).withColumn("row_key", F.md5("text"))
    keyed = rows.select(
        "doc_id", "row_key", F.posexplode(_lines(F.col("text"))).alias("position", "line")
    ).withColumn("key", line_key(F.col("line")))
    hashes = store(
        keyed.filter(F.length("key") >= min_length).select(
            "doc_id", "row_key", "position", F.unhex(F.md5("key")).alias("hash")
        ),
        "line-hashes",
    )
    # The first step meets a hot key once per document, the second once per task.
    holders = hashes.select("hash", "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"]
    # Stored, so that the join below has two plain sides: a small one is broadcast, and where it is
    # large Spark can split the partition of a hot key.
    repeated = store(
        holders.groupBy("hash")
        .agg(F.count(F.lit(1)).alias("documents"), first.alias("first_id"))
        .filter(F.col("documents") >= min_documents)
        .select("hash", "first_id"),
        "line-repeats",
    )
    dropped = (
        hashes.join(small(repeated, MOST_BROADCAST_LINES), "hash")
        .filter(~F.col("doc_id").eqNullSafe(F.col("first_id")))
        .groupBy(F.col("doc_id").alias("drop_id"), F.col("row_key").alias("drop_key"))
        .agg(F.collect_set("position").alias("drop"))
    )
    joined = rows.join(
        dropped,
        F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("row_key") == F.col("drop_key")),
        "left",
    )
    lines = joined.select(
        "doc_id", "text", "drop", _lines(F.col("text")).alias("lines")
    ).withColumn("n_lines", F.size("lines").cast("bigint"))
    stay = F.array_except(
        F.sequence(F.lit(0), (F.col("n_lines") - 1).cast("int")), F.col("drop")
    )
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    return lines.select(
        "doc_id",
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(left).alias("text"),
        "n_lines",
        F.coalesce(F.size("drop"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
