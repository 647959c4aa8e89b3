"""The whole run as one job: land the feeds, keep typed tables and rejects, write the reports.

Everything is written below one folder that all machines can reach:

    judged/<feed>     every row once, typed, or with its text and reasons if it is malformed;
                      partitioned by the verdict
    typed/<table>     listening per user, sums per subscription and per user in buckets, and the
                      status counts of the day
    rejects/<feed>    malformed rows with their reasons, mostly empty
    marts/<mart>      reporting tables as Parquet
    reports/<report>  metrics and figures as CSV
    export/bi_churn_tenure   the churn mart as CSV
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.operators import typed
from renewlens.plans import collapsed, session
from renewlens.plans.reports import FIGURES, METRICS
from renewlens.plans.warehouse import MARTS, STATUS, TYPED, AsOf, Landing, Warehouse
from renewlens.sources import feeds, storage

# How the rows of each feed are typed and judged.
_JUDGED = {
    "users": typed.dim_users,
    "subscriptions": typed.fct_subscriptions,
    "payments": typed.fct_payments,
    "listening": typed.listening_users,
}


def _stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The judged rows of a feed. The schema is given, since an empty feed leaves no files."""
    feed = feeds.all_feeds()[name]
    landed = spark.createDataFrame([], f"{feed.schema.simpleString()[7:-1]}, {feeds.BAD_LINE}:string")
    schema = _JUDGED[name](landed, judged=True).schema
    return spark.read.schema(schema).parquet(f"{folder}/judged/{name}")


def _accepted(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return feeds.accepted_rows(_stored(spark, folder, name))


def stored_warehouse(spark: SparkSession, folder: str, *, as_of: AsOf) -> Warehouse:
    """The relations over what ``run`` stored below a folder.

    Reading the bucketed tables declares them in the session's catalog, see
    ``collapsed.open_folder``; ``forget`` takes them out again.
    """
    given = (partial(_accepted, spark, folder, name) for name in ("users", "subscriptions", "payments"))
    listens = partial(spark.read.parquet, f"{folder}/typed/engagement_per_user")
    status = partial(spark.read.parquet, f"{folder}/typed/{STATUS}")
    stored = collapsed.open_folder(spark, f"{folder}/typed")
    return Warehouse(*given, listens, as_of, status=status, **stored)


def forget(spark: SparkSession, folder: str) -> None:
    """Take the bucketed tables below a folder out of the catalog. The files stay."""
    collapsed.forget_folder(spark, f"{folder}/typed")


def set_up(
    spark: SparkSession,
    landing: Landing,
    folder: str,
    *,
    as_of: AsOf,
    strict: bool = False,
    mode: str = "errorifexists",
) -> dict[str, dict[str, int]]:
    """Read each feed once, judge and type its rows; returns row counts per feed.

    What the reports start from is then summed once from the stored rows: listening per user, the
    collapsed tables, and the status counts as of a day.
    """
    counts = {}
    for name, judge in _JUDGED.items():
        judged = judge(getattr(landing, name), strict=strict, judged=True)
        judged.write.mode(mode).partitionBy("verdict").parquet(f"{folder}/judged/{name}")
        rejected = feeds.rejected_rows(_stored(spark, folder, name))
        storage.export_parquet(rejected, f"{folder}/rejects/{name}", mode=mode)
        counts[name] = {
            "typed": _accepted(spark, folder, name).count(),
            "rejected": spark.read.parquet(f"{folder}/rejects/{name}").count(),
        }
    listens = typed.listens_per_user(_accepted(spark, folder, "listening"))
    storage.export_parquet(listens, f"{folder}/typed/engagement_per_user", mode=mode)
    stored = stored_warehouse(spark, folder, as_of=as_of)
    collapsed.save_folder(
        spark, f"{folder}/typed", {name: getattr(stored, name) for name in TYPED}, mode=mode
    )
    stored.save_status(f"{folder}/typed", stored.fct_subscriptions, mode=mode)
    counts["listening"]["typed"] = spark.read.parquet(f"{folder}/typed/engagement_per_user").count()
    return counts


def write_marts(warehouse: Warehouse, folder: str, *, mode: str = "errorifexists") -> None:
    for name in MARTS:
        storage.export_parquet(getattr(warehouse, name), f"{folder}/marts/{name}", mode=mode)
    # At most five buckets exist, so one file holds them.
    churn = warehouse.bi_churn_tenure.coalesce(1)
    storage.export_csv(churn, f"{folder}/export/bi_churn_tenure", mode=mode)


def write_reports(
    warehouse: Warehouse,
    folder: str,
    names: Iterable[str] | None = None,
    *,
    mode: str = "errorifexists",
) -> None:
    """Write the named reports, or all metrics and figures, as CSV."""
    known = {**METRICS, **FIGURES}
    for name in known if names is None else names:
        storage.export_csv(known[name](warehouse), f"{folder}/reports/{name}", mode=mode)


def run(
    spark: SparkSession,
    landing: Landing,
    folder: str,
    *,
    as_of: AsOf,
    strict: bool = False,
    reports: Iterable[str] | None = None,
    mode: str = "errorifexists",
    input_bytes: int = 0,
) -> dict[str, dict[str, int]]:
    """Set up, then write marts and reports from the stored tables, all as of one day.

    The payments mart shuffles whole rows, so it gets partitions for all of ``input_bytes``.
    """
    if as_of is None:
        as_of = spark.range(1).select(F.current_date()).first()[0]
    try:
        counts = set_up(spark, landing, folder, as_of=as_of, strict=strict, mode=mode)
        warehouse = stored_warehouse(spark, folder, as_of=as_of)
        with session.at_least_partitions(spark, session.partitions_for(input_bytes)):
            write_marts(warehouse, folder, mode=mode)
        write_reports(warehouse, folder, reports, mode=mode)
    finally:
        forget(spark, folder)
    return counts
