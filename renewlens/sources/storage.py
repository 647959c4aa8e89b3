"""Writing results, and scratch folders that survive the loss of an executor."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"
# Says that a path of the scheme ``file`` is a mount that all machines have.
MOUNTED = "spark.renewlens.sharedMount"

_RUN: ContextVar[str | None] = ContextVar("renewlens_run", default=None)
_KEPT: set[str] = set()
_REACHED: dict[tuple[str, str], bool] = {}


def _master(spark: SparkSession) -> str:
    return spark.sparkContext.master


def _file_system(spark: SparkSession, path: str):
    """The store of a path and the path in it, as Spark's own readers and writers see them."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _file_system(spark, path)
    return store.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder with everything below it; a missing one is no error."""
    store, place = _file_system(spark, path)
    store.delete(place, True)


def _tasks_reach(spark: SparkSession, root: str) -> bool:
    """Whether the driver finds what tasks write below a folder; tried once for an application."""
    context = spark.sparkContext
    key = (context.applicationId, root)
    if key not in _REACHED:
        folder, tasks = f"{root}/renewlens-reach-{uuid.uuid4().hex}", context.defaultParallelism
        try:
            spark.range(0, tasks, 1, tasks).write.parquet(folder)
            _REACHED[key] = spark.read.schema("id bigint").parquet(folder).count() == tasks
        finally:
            remove(spark, folder)
    return _REACHED[key]


def shared_root(spark: SparkSession) -> str:
    """The folder that all machines of the cluster share: ``spark.checkpoint.dir``.

    Where that setting is missing, the folder given to ``setCheckpointDir`` is taken. A folder of
    this machine's files is taken only where all of Spark runs on this machine, where the driver
    finds what tasks write there, or where ``spark.renewlens.sharedMount`` says that it is mounted
    everywhere. On YARN, which has a store of its own, it must be named with the scheme ``file``: a
    plain path that falls on the local disk there stands for a folder of that store. Where no folder
    is named, the warehouse serves on one machine; on a cluster the session is refused, since Spark
    fills in a machine-local warehouse for everyone.
    """
    root = spark.conf.get(SHARED, None) or spark.sparkContext.getCheckpointDir()
    master = _master(spark)
    one_machine = master.startswith("local")
    if not root:
        if not one_machine:
            raise ValueError(f"set {SHARED} to a folder every machine can reach")
        root = spark.conf.get("spark.sql.warehouse.dir")
    root = root.rstrip("/")
    if not one_machine and spark.conf.get(MOUNTED, "false") != "true":
        store, place = _file_system(spark, root)
        local = store.getUri().getScheme() == "file"
        meant = place.toUri().getScheme() == "file" or not master.startswith("yarn")
        if local and not (meant and _tasks_reach(spark, root)):
            raise ValueError(
                f"{SHARED} is {root}, a folder of one machine; name a shared one, "
                f"or set {MOUNTED} to true if every machine has it mounted"
            )
    return root


def _session_folder(spark: SparkSession) -> str:
    """A folder of this application, which its driver removes when it ends."""
    folder = f"{shared_root(spark)}/renewlens-{spark.sparkContext.applicationId}"
    if folder not in _KEPT:
        store, place = _file_system(spark, folder)
        store.mkdirs(place)
        store.deleteOnExit(place)
        atexit.register(_removed, store, place)
        _KEPT.add(folder)
    return folder


def _removed(store, place) -> None:
    """Remove a folder before Python ends: the JVM ends later, and on its own."""
    with suppress(Exception):  # The JVM may be gone, and then so is the folder.
        store.delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for one run: everything that the work inside stores is removed at its end.

        with scratch(spark):
            query(spark, tables).write.parquet(result)

    Results are lazy, so read or write them inside. Work outside of any run is stored until the
    application ends.
    """
    folder = f"{shared_root(spark)}/renewlens-run-{uuid.uuid4().hex}"
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        remove(spark, folder)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder that all machines share, for this run or this application."""
    return f"{_RUN.get() or _session_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def export_csv(
    df: DataFrame,
    path: str,
    *,
    header: bool = True,
    quote_all: bool = True,
    line_sep: str = "\n",
    mode: str = "errorifexists",
) -> None:
    """Write CSV files with doubled quotes; ``quote_all`` puts every field in quotes."""
    (
        df.write.mode(mode)
        .option("header", header)
        .option("quoteAll", quote_all)
        .option("escape", '"')
        .option("lineSep", line_sep)
        .csv(path)
    )


def export_parquet(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
