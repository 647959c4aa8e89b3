"""Feeds in the landed text form, derived from the star-schema tables used for tests and bench.

customer, orders, lineitem and events stand in for users, subscriptions, payments and
listening. Each feed gets one header line as data, as a careless load would leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from renewlens.sources import feeds

# Fixed values of the stand-in feeds.
OFFSET = "33:25.6"
PAYMENT_CREATED = "24:52.6"
DAY_TEXT = "dd-MM-yyyy"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _with_header(df: DataFrame, feed: feeds.Feed) -> DataFrame:
    header = df.sparkSession.range(1).select(*[F.lit(name).alias(name) for name in feed.columns])
    return df.select(*feed.columns).unionByName(header)


def users_raw(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "customer").select(
        _text("c_custkey").alias("row_id"),
        _text("c_custkey").alias("user_id"),
        F.col("c_name").alias("username"),
        F.concat("c_name", F.lit("@example.com")).alias("email"),
        F.lit("x").alias("password_hash"),
        F.lit("first").alias("first_name"),
        F.lit("last").alias("last_name"),
        F.col("c_mktsegment").alias("subscription_type"),
        F.lit(OFFSET).alias("created_at"),
    )
    return _with_header(rows, feeds.users_feed())


def subscriptions_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Every 997th start is null; open orders are open-ended; other ends lie -20 to 499 days on."""
    shift = (F.col("o_orderkey") * 37 % 520 - 20).cast("int")
    end = F.date_add(F.col("o_orderdate").cast("date"), shift)
    rows = _table(spark, folder, "orders").select(
        _text("o_orderkey").alias("row_id"),
        _text("o_orderkey").alias("subscription_id"),
        _text("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("subscription_type"),
        F.when(F.col("o_orderkey") % 997 != 0, F.date_format("o_orderdate", DAY_TEXT)).alias(
            "start_date"
        ),
        F.when(F.col("o_orderstatus") == "O", "NULL")
        .otherwise(F.date_format(end, DAY_TEXT))
        .alias("end_date"),
        F.lit(OFFSET).alias("created_at"),
    )
    return _with_header(rows, feeds.subscriptions_feed())


def payments_raw(spark: SparkSession, folder: str) -> DataFrame:
    """One payment per line item of a known order, paid by the customer of the order.

    Line items do not carry the customer, so the payer is joined in from orders. The first line of
    an order has a creation field that looks like a date; the others hold an offset.
    """
    orders = _table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), _text("o_custkey").alias("user_id")
    )
    lines = _table(spark, folder, "lineitem").join(orders, "l_orderkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    shipped = F.date_format("l_shipdate", DAY_TEXT)
    rows = lines.select(
        _text("l_orderkey").alias("row_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("payment_id"),
        "user_id",
        cents.cast("string").alias("amount"),
        F.when(F.col("l_returnflag") == "N", OFFSET).otherwise(shipped).alias("payment_date"),
        F.col("l_returnflag").alias("payment_method"),
        F.when(F.col("l_linenumber") == 1, shipped).otherwise(PAYMENT_CREATED).alias("created_at"),
        _text("l_orderkey").alias("subscription_id"),
    )
    return _with_header(rows, feeds.payments_feed())


def spoiled(name: str, raw: DataFrame) -> DataFrame:
    """A stand-in feed with part of its rows made malformed, some in every feed."""

    def each(key: str, n: int) -> Column:
        return F.try_to_number(key, F.lit("999999999999")) % n == 0

    def instead(column: str, which: Column, value: Column) -> DataFrame:
        return raw.withColumn(column, F.when(which, value).otherwise(F.col(column)))

    if name == "users":
        return instead("user_id", each("row_id", 11), F.concat(F.lit("u"), "user_id"))
    if name == "subscriptions":
        start = F.col("start_date")
        swapped = F.concat(start.substr(4, 3), start.substr(1, 3), F.substring(start, 7, 4))
        return instead("start_date", each("row_id", 7), swapped)
    if name == "payments":
        raw = instead("payment_date", each("payment_id", 13), F.lit("31-02-2000"))
        return instead("amount", each("payment_id", 17), F.concat("amount", F.lit(".5")))
    return instead("user_id", each("row_id", 5), F.concat("user_id", F.lit("?")))


def listening_raw(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "events").select(
        _text("event_id").alias("row_id"),
        _text("event_id").alias("history_id"),
        _text("user_id").alias("user_id"),
        F.col("event_type").alias("song_id"),
        F.date_format("ts", DAY_TEXT).alias("listen_date"),
        F.lit(OFFSET).alias("created_at"),
    )
    return _with_header(rows, feeds.listening_feed())
