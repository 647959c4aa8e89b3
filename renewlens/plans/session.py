"""Session settings for the work of this library."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Adaptive execution merges small shuffle partitions, splits hot ones in joins and turns a join
# into a broadcast only where the measured size of a side allows it. Dates are read in UTC.
BASE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
}
_MIB = 1024 * 1024
_PARTITION = 128 * _MIB
_MOST_SCAN_TASKS = 100_000
# A shuffle moves as many blocks as scan tasks times partitions, so more than this do not pay.
_MOST_PARTITIONS = 50_000
_SHUFFLED_BY_REPORTS = 8  # pruned columns and partial sums leave an eighth of the input or less
_KEY = "spark.sql.shuffle.partitions"


def partitions_for(shuffled_bytes: int) -> int:
    """Shuffle partitions of about 128 MiB, within a bound."""
    return min(max(1, -(-shuffled_bytes // _PARTITION)), _MOST_PARTITIONS)


def settings_for(input_bytes: int, cores: int, present: int = 0) -> dict[str, str]:
    """Settings for a given size of input files.

    Adaptive execution never adds shuffle partitions, so there must be enough to begin with:
    one per 128 MiB that reports shuffle, one per core, and never fewer than the ``present``
    setting. Scan tasks grow from 128 MiB of file to 1 GiB, as a report reads two or three columns
    of it.
    """
    partitions = max(partitions_for(input_bytes // _SHUFFLED_BY_REPORTS), cores, present)
    scan = min(max(_PARTITION, input_bytes // _MOST_SCAN_TASKS), 8 * _PARTITION)
    return {**BASE, _KEY: str(partitions), "spark.sql.files.maxPartitionBytes": str(scan)}


def input_size(spark: SparkSession, paths: list[str]) -> int:
    """Bytes of all files below the paths, from a listing; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.agg(F.sum("length")).first()[0] or 0


def sized(spark: SparkSession, input_bytes: int) -> dict[str, str]:
    """Settings for this session, which keep or raise its number of shuffle partitions."""
    cores = spark.sparkContext.defaultParallelism
    return settings_for(input_bytes, cores, int(spark.conf.get(_KEY)))


@contextmanager
def at_least_partitions(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Raise the shuffle partitions for some work."""
    before = spark.conf.get(_KEY)
    spark.conf.set(_KEY, str(max(int(before), partitions)))
    try:
        yield
    finally:
        spark.conf.set(_KEY, before)


def apply(spark: SparkSession, settings: dict[str, str]) -> None:
    for key, value in settings.items():
        spark.conf.set(key, value)


def local_session(app: str, cores: int | str = "*", **extra: str) -> SparkSession:
    """A single-machine session for tests and measurements."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**BASE, "spark.sql.shuffle.partitions": "8", **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
