"""Reports over random text feeds with nulls, repeated ids, hot keys, ties and header lines.

DuckDB answers the same questions with row by row joins over the same feeds.
"""

import random

import duckdb
import pyarrow as pa
import pytest

import oracle_queries
from renewlens.plans.reports import CHECKS, FIGURES, METRICS, RELATIONS
from renewlens.plans.warehouse import Landing, Warehouse
from renewlens.sources import feeds

from .conftest import AS_OF
from .helpers import same_rows, text_frame

FEEDS = feeds.all_feeds()
# Shown rows of these are ordered by every column; the SQL orders by fewer.
UNORDERED = {name for name in CHECKS if name.startswith("q01_preview")} | {"q08_payments_at_offset"}
SQL = oracle_queries.sql_over_feeds()


def _feeds(seed):
    rng = random.Random(seed)

    def key(n, hot):
        """A null, a hot id (a third of all rows), or any id, some of them written oddly."""
        roll = rng.random()
        if roll < 0.04:
            return None
        number = str(hot if roll < 0.37 else rng.randrange(n))
        return rng.choice([number] * 12 + ["0" + number, " " + number, number + "x", "1e3"])

    def day():
        return f"{rng.randint(1, 28):02d}-{rng.randint(1, 12):02d}-{rng.randint(1997, 2001)}"

    def plan():
        return rng.choice(["Student", "Family", "Premium", None, ""])

    users = [
        {
            "row_id": str(i), "user_id": key(40, 7), "username": f"u{i}", "email": None,
            "password_hash": "x", "subscription_type": plan(), "created_at": "33:25.6",
        }
        for i in range(60)
    ]
    subscriptions = [
        {
            "row_id": str(i), "subscription_id": key(150, 3), "user_id": key(40, 7),
            "subscription_type": plan(),
            "start_date": rng.choice([None, "31-02-1999", "1999-05-05", *[day() for _ in range(18)]]),
            "end_date": rng.choice(
                ["NULL", None, day(), day(), day(), day(), "01-01-2000", "31-12-1999", "13-13-1999"]
            ),
            "created_at": "24:52.6",
        }
        for i in range(300)
    ]
    payments = [
        {
            "row_id": str(i), "payment_id": str(i), "user_id": key(40, 7),
            "subscription_id": key(160, 3),
            "amount": rng.choice(
                [None, "0", "999", "1999", *[str(rng.randrange(10**6)) for _ in range(8)], "1.5", "-"]
            ),
            "payment_date": rng.choice(
                [None, "33:25.6", day(), day(), day(), day()[1:], day() + "x", "31-04-2000"]
            ),
            "payment_method": rng.choice(["card", "paypal"]),
            "created_at": rng.choice(["24:52.6", "33:25.6", day(), None]),
        }
        for i in range(500)
    ]
    listening = [
        {
            "row_id": str(i), "history_id": str(i), "user_id": key(45, 7), "song_id": "s",
            "listen_date": day(), "created_at": None,
        }
        for i in range(600)
    ]
    found = {
        "users": users, "subscriptions": subscriptions, "payments": payments, "listening": listening,
    }
    for name, feed in FEEDS.items():
        found[name].insert(rng.randrange(50), {column: column for column in feed.columns})
    return found


@pytest.fixture(scope="module", params=[1, 2])
def case(request, spark):
    data = _feeds(request.param)
    con = duckdb.connect()
    frames = {}
    for name, feed in FEEDS.items():
        columns = {c: pa.array([row.get(c) for row in data[name]], pa.string()) for c in feed.columns}
        con.register(f"{name}_raw", pa.table(columns))
        frames[name] = text_frame(spark, feed, data[name]).repartition(3)
    landing = Landing(**frames)
    return landing, Warehouse.from_landing(landing, as_of=AS_OF), con


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_reports(case, setting, broadcast):
    setting(spark__sql__autoBroadcastJoinThreshold=broadcast)
    landing, warehouse, con = case
    reports = {**RELATIONS, **METRICS, **FIGURES}
    named = {name: (lambda report=report: report(warehouse)) for name, report in reports.items()}
    if broadcast == "10m":
        named |= {
            name: (lambda check=check: check(landing, warehouse))
            for name, check in CHECKS.items()
            if name not in UNORDERED
        }
    for name, build in named.items():
        df = build()
        doubles = [c for c, kind in df.dtypes if kind.startswith("decimal")]
        found = [tuple(r) for r in df.withColumns({c: df[c].cast("double") for c in doubles}).collect()]
        cursor = con.execute(SQL[name])
        try:
            same_rows(found, df.columns, cursor.fetchall(), [c[0] for c in cursor.description])
        except AssertionError as problem:
            raise AssertionError(name) from problem
