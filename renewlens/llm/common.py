"""What the operators share: words, ids as text, and tables written to the shared folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.sources.storage import shared_folder

# White space of the contracts, and the letters that are folded.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

# Rows that a broadcast may have.
MOST_BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def few_at_a_time(spark: SparkSession) -> Iterator[None]:
    """Texts are long: Python workers get fewer of them at a time than by default."""
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, min(int(before), 1_000))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def store(df: DataFrame, purpose: str, *, compression: str = "snappy") -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    with few_at_a_time(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_prefix(columns: list[str], wanted: str) -> str:
    """``wanted``, with as many underscores before it as no column begins with it, whatever its case."""
    taken = [name.lower() for name in columns]
    while any(name.startswith(wanted.lower()) for name in taken):
        wanted = f"_{wanted}"
    return wanted


def ids_tell_rows_apart(df: DataFrame, id_col: str) -> bool:
    """Whether every row has an id of its own. Only ids are read."""
    counted = df.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("id").isNull() | (F.col("n") > 1)).isEmpty()


def small(df: DataFrame, most_rows: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """Marked for a broadcast if a count shows that it is small, else for a join by a shuffle.

    For tables of a few narrow columns; the count costs a pass over what ``df`` reads. Without the
    second mark Spark might still broadcast, as it does not foresee the rows of an explode.
    """
    if df.limit(most_rows + 1).count() <= most_rows:
        return F.broadcast(df)
    return df.hint("merge")


def tidy(run: Callable) -> Callable:
    """A function over Arrow batches that gives memory back at its end.

    A Python worker lives on after a task, and what Arrow and the C library hold back, after large
    work of numpy, zstandard or a tokenizer, counts against its executor.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return tidied


def text_of(column: str) -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words as an array; empty for a text without words."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
