"""The four text feeds: landing schema, header removal and quarantine of malformed rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from renewlens.functions.parsing import ID_TYPE, Rule, day, day_if_shaped, day_or_open, integer

# Holds a whole line that has the wrong number of fields, and null for every other line.
BAD_LINE = "bad_line"
ACCEPTED, REJECTED = "accepted", "rejected"


@dataclass(frozen=True)
class Feed:
    """A text feed: its columns in file order, its key and the rule of each typed field."""

    name: str
    columns: tuple[str, ...]
    key: str
    rules: Mapping[str, Rule]

    @property
    def schema(self) -> StructType:
        return StructType([StructField(column, StringType()) for column in self.columns])

    def typed(self, column: str) -> Column:
        return self.rules[column].typed(F.col(column)).alias(column)

    def is_header(self) -> Column:
        """True on a header line that landed as data. A null key is never a header."""
        return F.col(self.key).eqNullSafe(F.lit(self.key))

    def _flags(self, raw: DataFrame) -> list[tuple[Column, str]]:
        """Each thing that can be wrong with a row, and how it is reported."""
        flags = [
            (rule.malformed(F.col(column)), f"{column}: not {rule.expects}")
            for column, rule in self.rules.items()
        ]
        if BAD_LINE in raw.columns:
            flags.insert(0, (F.col(BAD_LINE).isNotNull(), "line: wrong number of fields"))
        return flags

    def is_malformed(self, raw: DataFrame) -> Column:
        return reduce(lambda left, right: left | right, [flag for flag, _ in self._flags(raw)])

    def reasons(self, raw: DataFrame) -> Column:
        found = [F.when(flag, F.lit(reason)) for flag, reason in self._flags(raw)]
        return F.array_compact(F.array(*found))


# The columns of the four feeds are fixed values: names and order of the exported files.
def users_feed(id_type: str = ID_TYPE) -> Feed:
    return Feed(
        "users",
        (
            "row_id", "user_id", "username", "email", "password_hash",
            "first_name", "last_name", "subscription_type", "created_at",
        ),
        "user_id",
        {"user_id": integer(id_type)},
    )


def subscriptions_feed(id_type: str = ID_TYPE) -> Feed:
    return Feed(
        "subscriptions",
        (
            "row_id", "subscription_id", "user_id", "subscription_type",
            "start_date", "end_date", "created_at",
        ),
        "subscription_id",
        {
            "subscription_id": integer(id_type),
            "user_id": integer(id_type),
            "start_date": day(),
            "end_date": day_or_open(),
        },
    )


def payments_feed(id_type: str = ID_TYPE) -> Feed:
    return Feed(
        "payments",
        (
            "row_id", "payment_id", "user_id", "amount",
            "payment_date", "payment_method", "created_at", "subscription_id",
        ),
        "payment_id",
        {
            "payment_id": integer(id_type),
            "user_id": integer(id_type),
            "subscription_id": integer(id_type),
            "amount": integer("int"),
            "payment_date": day_if_shaped(),
        },
    )


def listening_feed(id_type: str = ID_TYPE) -> Feed:
    return Feed(
        "listening",
        ("row_id", "history_id", "user_id", "song_id", "listen_date", "created_at"),
        "history_id",
        {"user_id": integer(id_type)},
    )


def all_feeds(id_type: str = ID_TYPE) -> dict[str, Feed]:
    """The four feeds by name."""
    declared = (users_feed, subscriptions_feed, payments_feed, listening_feed)
    return {feed.name: feed for feed in (declare(id_type) for declare in declared)}


def _file_order(feed: Feed, found: list[str], where: str) -> tuple[str, ...]:
    """The feed's columns in the order of a header line; case does not matter."""
    if not found:
        return feed.columns
    by_name = {column.lower(): column for column in feed.columns}
    if sorted(name.lower() for name in found) != sorted(by_name):
        raise ValueError(
            f"header of {feed.name} in {where}: found {', '.join(found)}; "
            f"expected {', '.join(feed.columns)}, in any order"
        )
    return tuple(by_name[name.lower()] for name in found)


def _files_below(spark: SparkSession, path: str) -> list[str]:
    """Files from a listing; no content is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return sorted(row.path for row in listed.select("path").collect())


def read_feed(
    spark: SparkSession,
    path: str | list[str],
    feed: Feed,
    *,
    header: bool = True,
    by_name: bool = True,
    each_file: bool = False,
    multi_line: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Land CSV files as text columns.

    With ``header`` the first line of every file is skipped and names its columns, which may stand
    in any order. The first header found below a path sets the order for all its files, and a file
    with another one fails the read; several paths may differ from each other, and with
    ``each_file`` so may the files of a path, for the price of a look at each by the driver. Other
    names than the feed's raise an error. ``by_name=False`` takes the columns by position, whatever
    their header says.

    Quotes inside a field are doubled; an empty unquoted field is null and a quoted one is the
    empty string. ``multi_line`` allows line ends inside quotes, at the price that Spark can no
    longer split a large file. A line with the wrong number of fields is kept in the column
    ``bad_line`` and rejected later, or fails the job if ``strict``. Columns are not pruned inside
    the CSV parser, since it counts the fields of a line only when it reads them all.
    """
    reader = spark.read.option("multiLine", multi_line).option("escape", '"')
    paths = [path] if isinstance(path, str) else list(path)
    orders: dict[tuple[str, ...], list[str]] = {}
    if header and by_name:
        if each_file:
            paths = [file for one in paths for file in _files_below(spark, one)]
        for one in paths:
            found = reader.option("header", True).csv(one).columns
            orders.setdefault(_file_order(feed, found, one), []).append(one)
    orders = orders or {feed.columns: paths}
    bad_line = [] if strict else [BAD_LINE]
    landed = [
        spark.read.schema(StructType([StructField(name, StringType()) for name in (*order, *bad_line)]))
        .option("header", header)
        # Every file's header is held against the schema as the file is read.
        .option("enforceSchema", not (header and by_name))
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("nullValue", "\u0000")
        .option("emptyValue", "")
        .option("mode", "FAILFAST" if strict else "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_LINE)
        .option("columnPruning", False)
        .csv(files)
        .select(*feed.columns, *bad_line)
        for order, files in orders.items()
    ]
    return reduce(DataFrame.unionByName, landed)


def strip_header(raw: DataFrame, feed: Feed) -> DataFrame:
    return raw.where(~feed.is_header())


def rejects(raw: DataFrame, feed: Feed) -> DataFrame:
    """Rows that cannot be typed, with every reason. These rows are absent from typed tables."""
    return raw.where(~feed.is_header() & feed.is_malformed(raw)).withColumn(
        "reject_reasons", feed.reasons(raw)
    )


def accepted(raw: DataFrame, feed: Feed, *, strict: bool = False) -> DataFrame:
    """Rows that can be typed. ``strict`` stops the job at the first malformed row instead.

    Header test and row check form one expression, so the check never sees a header row
    however the optimiser orders its filters, and strict mode needs no extra pass.
    """
    if strict:
        message = F.concat(
            F.lit(f"malformed row in {feed.name}: "),
            F.array_join(feed.reasons(raw), "; "),
            F.lit(" | "),
            F.to_json(F.struct(*feed.rules)),
        )
        keep = (
            F.when(feed.is_header(), F.lit(False))
            .when(feed.is_malformed(raw), F.raise_error(message).cast("boolean"))
            .otherwise(F.lit(True))
        )
        return raw.where(keep)
    return raw.where(~feed.is_header() & ~feed.is_malformed(raw))


def typed_rows(
    raw: DataFrame,
    feed: Feed,
    *columns: Column | str,
    strict: bool = False,
    judged: bool = False,
) -> DataFrame:
    """Columns of the rows that can be typed.

    With ``judged`` no row is left out: the column ``verdict`` says ACCEPTED or REJECTED, and a
    rejected row carries its text in ``raw`` and its ``reject_reasons``. One pass over a feed then
    gives both what was typed and what was not.
    """
    if not judged:
        return accepted(raw, feed, strict=strict).select(*columns)
    malformed = feed.is_malformed(raw)
    kept = accepted(raw, feed, strict=True) if strict else strip_header(raw, feed)
    text = F.struct(*raw.columns)
    return kept.select(
        *columns,
        F.when(malformed, text).alias("raw"),
        F.when(malformed, feed.reasons(raw)).alias("reject_reasons"),
        F.when(malformed, REJECTED).otherwise(ACCEPTED).alias("verdict"),
    )


def accepted_rows(judged: DataFrame) -> DataFrame:
    """The typed columns of judged rows that were accepted."""
    return judged.where(F.col("verdict") == ACCEPTED).drop("raw", "reject_reasons", "verdict")


def rejected_rows(judged: DataFrame) -> DataFrame:
    """The text of judged rows that were rejected, with the reasons."""
    return judged.where(F.col("verdict") == REJECTED).select("raw.*", "reject_reasons")
