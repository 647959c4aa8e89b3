import datetime as dt
from decimal import Decimal

import pytest

from renewlens.operators import typed
from renewlens.sources import feeds
from renewlens.sources.storage import export_csv

from .helpers import rows, text_frame


def _subscription(**fields):
    good = {
        "row_id": "1", "subscription_id": "10", "user_id": "7", "subscription_type": "Family",
        "start_date": "01-02-2024", "end_date": "05-03-2024", "created_at": "33:25.6",
    }
    return {**good, **fields}


def _payment(**fields):
    good = {
        "row_id": "1", "payment_id": "5", "user_id": "7", "amount": "1234",
        "payment_date": "33:25.6", "payment_method": "card", "created_at": "24:52.6",
        "subscription_id": "10",
    }
    return {**good, **fields}


def test_landing_schemas_are_text_in_file_order():
    assert feeds.users_feed().schema.simpleString() == (
        "struct<row_id:string,user_id:string,username:string,email:string,password_hash:string,"
        "first_name:string,last_name:string,subscription_type:string,created_at:string>"
    )
    assert feeds.payments_feed().columns[-1] == "subscription_id"
    assert feeds.listening_feed().columns[1] == "history_id"
    assert feeds.subscriptions_feed().columns[4:6] == ("start_date", "end_date")


def test_header_rows_go_and_null_keys_stay(spark):
    feed = feeds.users_feed()
    raw = text_frame(
        spark, feed, [{"user_id": "user_id"}, {"user_id": None, "row_id": "n"}, {"user_id": "7"}]
    )
    assert [row.user_id for row in feeds.strip_header(raw, feed).collect()] == [None, "7"]
    # A null id is absent, not malformed: it stays in the typed table and is no reject.
    assert [row.user_id for row in typed.dim_users(raw).collect()] == [None, 7]
    assert feeds.rejects(raw, feed).count() == 0


def test_password_hash_is_left_out(spark):
    feed = feeds.users_feed()
    assert "password_hash" in feed.columns
    assert "password_hash" not in typed.dim_users(text_frame(spark, feed, [])).columns


def test_subscription_dates(spark):
    feed = feeds.subscriptions_feed()
    raw = text_frame(
        spark,
        feed,
        [
            _subscription(),
            _subscription(subscription_id="11", end_date="NULL"),
            _subscription(subscription_id="12", start_date=None, end_date=None),
            _subscription(subscription_id="13", start_date="1-2-2024"),
        ],
    )
    found = {
        row.subscription_id: (row.start_date, row.end_date)
        for row in typed.fct_subscriptions(raw).collect()
    }
    first = dt.date(2024, 2, 1)
    assert found == {
        10: (first, dt.date(2024, 3, 5)),
        11: (first, None),
        12: (None, None),
        13: (first, dt.date(2024, 3, 5)),
    }


@pytest.mark.parametrize(
    "fields, reason",
    [
        ({"start_date": "NULL"}, "start_date"),
        ({"start_date": ""}, "start_date"),
        ({"start_date": "31-02-2024"}, "start_date"),
        ({"end_date": "null"}, "end_date"),
        ({"end_date": "2024-03-05"}, "end_date"),
        ({"subscription_id": "12.5"}, "subscription_id"),
        ({"user_id": "12x"}, "user_id"),
        ({"user_id": ""}, "user_id"),
    ],
)
def test_malformed_subscriptions_are_set_aside(spark, fields, reason):
    feed = feeds.subscriptions_feed()
    raw = text_frame(spark, feed, [_subscription(), _subscription(row_id="bad", **fields)])
    (reject,) = feeds.rejects(raw, feed).collect()
    assert reject.row_id == "bad"
    assert [found.split(":")[0] for found in reject.reject_reasons] == [reason]
    assert [row.row_id for row in typed.fct_subscriptions(raw).collect()] == ["1"]


def test_every_reason_is_named(spark):
    feed = feeds.subscriptions_feed()
    raw = text_frame(spark, feed, [_subscription(subscription_id="x", start_date="soon")])
    (reject,) = feeds.rejects(raw, feed).collect()
    assert [found.split(":")[0] for found in reject.reject_reasons] == [
        "subscription_id", "start_date",
    ]


def test_payment_dates_and_money(spark):
    feed = feeds.payments_feed()
    raw = text_frame(
        spark,
        feed,
        [
            _payment(payment_id="1", amount="1", payment_date="05-03-2024"),
            _payment(payment_id="2", amount="-250", payment_date="5-3-2024"),
            _payment(payment_id="3", amount="2147483647", payment_date="05-03-2024\n"),
            _payment(payment_id="4", amount=None, payment_date="05-03-20240"),
            _payment(payment_id="5", amount=" 700 ", payment_date=None),
        ],
    )
    found = {
        row.payment_id: (row.amount_cents, row.amount, row.payment_date)
        for row in typed.fct_payments(raw).collect()
    }
    assert found == {
        1: (1, Decimal("0.01"), dt.date(2024, 3, 5)),
        2: (-250, Decimal("-2.50"), None),
        3: (2147483647, Decimal("21474836.47"), None),
        4: (None, None, None),
        5: (700, Decimal("7.00"), None),
    }
    assert feeds.rejects(raw, feed).count() == 0


@pytest.mark.parametrize(
    "fields, reason",
    [
        ({"payment_date": "99-99-2024"}, "payment_date"),
        ({"amount": "12.5"}, "amount"),
        ({"amount": "2147483648"}, "amount"),
        ({"payment_id": "p1"}, "payment_id"),
        ({"subscription_id": "-"}, "subscription_id"),
    ],
)
def test_malformed_payments_are_set_aside(spark, fields, reason):
    feed = feeds.payments_feed()
    raw = text_frame(spark, feed, [_payment(), _payment(row_id="bad", **fields)])
    (reject,) = feeds.rejects(raw, feed).collect()
    assert [found.split(":")[0] for found in reject.reject_reasons] == [reason]
    assert [row.row_id for row in typed.fct_payments(raw).collect()] == ["1"]


def test_ids_are_wide_and_can_be_narrowed(spark):
    feed = feeds.users_feed("int")
    raw = text_frame(spark, feed, [{"user_id": "3000000000"}, {"user_id": "7"}])
    assert rows(typed.dim_users(raw).select("user_id")) == [(3000000000,), (7,)]
    narrow = typed.dim_users(raw, id_type="int")
    assert dict(narrow.dtypes)["user_id"] == "int"
    assert rows(narrow.select("user_id")) == [(7,)]
    assert feeds.rejects(raw, feed).count() == 1


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "Asia/Kolkata"])
def test_dates_do_not_depend_on_the_time_zone(spark, setting, zone):
    """A day whose midnight a zone skipped (15 October 2017 in Sao Paulo) is read like any other."""
    setting(spark__sql__session__timeZone=zone)
    raw = text_frame(
        spark,
        feeds.subscriptions_feed(),
        [_subscription(start_date="15-10-2017", end_date="30-12-2011")],
    )
    (row,) = typed.fct_subscriptions(raw).collect()
    assert (row.start_date, row.end_date) == (dt.date(2017, 10, 15), dt.date(2011, 12, 30))


def test_judged_rows_are_the_accepted_and_the_rejected(spark):
    feed = feeds.payments_feed()
    raw = text_frame(
        spark,
        feed,
        [
            {column: column for column in feed.columns},
            _payment(),
            _payment(row_id="2", amount=None, payment_date="01-01-2020"),
            _payment(row_id="bad", amount="1.5"),
            _payment(row_id="worse", payment_date="99-99-2024", user_id="x"),
        ],
    )
    judged = typed.fct_payments(raw, judged=True)
    assert judged.count() == 4
    assert rows(feeds.accepted_rows(judged)) == rows(typed.fct_payments(raw))
    assert feeds.accepted_rows(judged).dtypes == typed.fct_payments(raw).dtypes
    assert rows(feeds.rejected_rows(judged)) == rows(feeds.rejects(raw, feed))
    assert feeds.rejected_rows(judged).dtypes == feeds.rejects(raw, feed).dtypes


def test_strict_fails_on_a_malformed_row_only(spark):
    feed = feeds.subscriptions_feed()
    header = {column: column for column in feed.columns}
    good = text_frame(spark, feed, [header, _subscription()])
    assert typed.fct_subscriptions(good, strict=True).count() == 1
    bad = text_frame(spark, feed, [header, _subscription(start_date="soon")])
    with pytest.raises(Exception, match="malformed row in subscriptions: start_date"):
        typed.fct_subscriptions(bad, strict=True).count()


def test_strict_survives_constant_folding(spark):
    """Literal rows are folded by the optimiser; the header among them must not trip it."""
    feed = feeds.subscriptions_feed()
    names = ", ".join(f"'{column}' AS {column}" for column in feed.columns)
    values = ", ".join(f"'{value}'" for value in _subscription().values())
    raw = spark.sql(f"SELECT {names} UNION ALL SELECT {values}")
    assert typed.fct_subscriptions(raw, strict=True).where("start_date > '2000-01-01'").count() == 1
    assert typed.fct_subscriptions(raw).where("start_date > '2000-01-01'").count() == 1


CSV_HEADER = "row_id,history_id,user_id,song_id,listen_date,created_at\r\n"


def test_csv_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes((CSV_HEADER + '1,1,7,"a ""q"", b",,""\r\n').encode())
    (tmp_path / "b.csv").write_bytes((CSV_HEADER + '2,2,"8",back\\slash,d,c\r\n').encode())
    feed = feeds.listening_feed()
    raw = feeds.read_feed(spark, str(tmp_path), feed)
    found = sorted(rows(raw.select(*feed.columns)))
    assert found == [
        ("1", "1", "7", 'a "q", b', None, ""),
        ("2", "2", "8", "back\\slash", "d", "c"),
    ]


def test_csv_without_header_option_lands_the_header_as_data(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV_HEADER + "1,1,7,s,d,c\n")
    feed = feeds.listening_feed()
    raw = feeds.read_feed(spark, str(tmp_path), feed, header=False)
    assert raw.count() == 2
    assert feeds.strip_header(raw, feed).count() == 1


def test_csv_lines_with_wrong_field_count_are_rejected(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV_HEADER + "1,1,7,s,d,c\n2,2,8\n3,3,9,s,d,c,extra\n")
    feed = feeds.listening_feed()
    raw = feeds.read_feed(spark, str(tmp_path), feed)
    rejected = feeds.rejects(raw, feed)
    assert sorted(row.bad_line for row in rejected.collect()) == ["2,2,8", "3,3,9,s,d,c,extra"]
    assert {tuple(row.reject_reasons) for row in rejected.collect()} == {
        ("line: wrong number of fields",)
    }
    assert rows(typed.engagement_per_user(raw)) == [(7, 1)]
    with pytest.raises(Exception):
        feeds.read_feed(spark, str(tmp_path), feed, strict=True).select("user_id").collect()


def test_csv_multi_line_field(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV_HEADER + '1,1,7,"two\nlines",d,c\n')
    raw = feeds.read_feed(spark, str(tmp_path), feeds.listening_feed(), multi_line=True)
    assert raw.collect()[0].song_id == "two\nlines"


def test_csv_round_trip_keeps_nulls_quotes_and_empty_text(spark, tmp_path):
    feed = feeds.subscriptions_feed()
    raw = text_frame(
        spark, feed,
        [_subscription(end_date="NULL", start_date=None, subscription_type='a "b", c', created_at="")],
    )
    export_csv(raw, str(tmp_path / "out"), quote_all=False)
    back = feeds.read_feed(spark, str(tmp_path / "out"), feed).select(*feed.columns)
    assert rows(back) == rows(raw)


SWAPPED = ("row_id", "user_id", "email", "username", "password_hash", "first_name", "last_name", "subscription_type", "created_at")


def _users_file(folder, name, columns, number):
    fields = {**dict.fromkeys(columns, "x"), "row_id": str(number), "user_id": str(number)}
    fields |= {"username": f"name{number}", "email": f"mail{number}"}
    folder.mkdir(exist_ok=True)
    lines = [",".join(columns), ",".join(fields[column.lower()] if column.lower() in fields else "x" for column in columns)]
    (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder / name)


def _names(df):
    return sorted((row.user_id, row.username, row.email) for row in df.collect())


BOTH = [("1", "name1", "mail1"), ("2", "name2", "mail2")]


@pytest.mark.parametrize("strict", [False, True])
def test_columns_go_by_the_names_of_the_header(spark, tmp_path, strict):
    feed = feeds.users_feed()
    plain = _users_file(tmp_path / "plain", "a.csv", feed.columns, 1)
    swapped = _users_file(tmp_path / "swapped", "b.csv", SWAPPED, 2)
    for paths in ([plain, swapped], [swapped, plain]):
        assert _names(feeds.read_feed(spark, paths, feed, strict=strict)) == BOTH
    landed = feeds.read_feed(spark, swapped, feed, strict=strict)
    assert landed.columns[: len(feed.columns)] == list(feed.columns)
    # By position, the two columns change places.
    by_place = feeds.read_feed(spark, swapped, feed, strict=strict, by_name=False)
    assert _names(by_place) == [("2", "mail2", "name2")]


@pytest.mark.parametrize("strict", [False, True])
def test_two_files_of_one_folder_in_different_column_order(spark, tmp_path, strict):
    feed, folder = feeds.users_feed(), tmp_path / "users"
    _users_file(folder, "a.csv", feed.columns, 1)
    _users_file(folder, "b.csv", SWAPPED, 2)
    with pytest.raises(Exception, match="(?s)header.*username|username.*header"):
        feeds.read_feed(spark, str(folder), feed, strict=strict).collect()
    assert _names(feeds.read_feed(spark, str(folder), feed, strict=strict, each_file=True)) == BOTH
    assert _names(feeds.read_feed(spark, str(folder), feed, by_name=False)) == [
        ("1", "name1", "mail1"), ("2", "mail2", "name2")
    ]


def test_a_header_with_other_names_is_refused(spark, tmp_path):
    feed = feeds.users_feed()
    renamed = tuple("login" if column == "username" else column for column in feed.columns)
    path = _users_file(tmp_path / "renamed", "a.csv", renamed, 1)
    with pytest.raises(ValueError, match="header of users .* found .*login.* expected .*username"):
        feeds.read_feed(spark, path, feed)
    short = _users_file(tmp_path / "short", "a.csv", feed.columns[:-1], 1)
    twice = _users_file(tmp_path / "twice", "a.csv", (*feed.columns[:-1], "user_id"), 1)
    for wrong in (short, twice):
        with pytest.raises(ValueError, match="header of users"):
            feeds.read_feed(spark, wrong, feed)
    (tmp_path / "later").mkdir()
    _users_file(tmp_path / "later", "a.csv", feed.columns, 1)
    _users_file(tmp_path / "later", "b.csv", renamed, 2)
    with pytest.raises(Exception, match="login"):
        feeds.read_feed(spark, str(tmp_path / "later"), feed).collect()


def test_case_of_a_header_and_files_without_lines(spark, tmp_path):
    feed, folder = feeds.users_feed(), tmp_path / "users"
    upper = tuple(column.upper() for column in SWAPPED)
    _users_file(folder, "b.csv", upper, 2)
    (folder / "a.csv").write_text("")
    for each_file in (False, True):
        assert _names(feeds.read_feed(spark, str(folder), feed, each_file=each_file)) == [BOTH[1]]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "a.csv").write_text("")
    assert feeds.read_feed(spark, str(tmp_path / "empty"), feed).collect() == []
    (tmp_path / "bare").mkdir()
    (tmp_path / "bare" / "a.csv").write_text(",".join(SWAPPED) + "\n")
    assert feeds.read_feed(spark, str(tmp_path / "bare"), feed).collect() == []


def test_quoted_headers_and_bad_lines_under_a_header_in_another_order(spark, tmp_path):
    feed, folder = feeds.users_feed(), tmp_path / "users"
    _users_file(folder, "b.csv", SWAPPED, 2)
    text = (folder / "b.csv").read_text().split("\n")
    quoted = ",".join(f'"{column}"' for column in SWAPPED)
    (folder / "b.csv").write_text("\n".join([quoted, text[1], "3,3,short"]) + "\n")
    landed = feeds.read_feed(spark, str(folder), feed)
    assert [row.bad_line for row in landed.collect() if row.bad_line] == ["3,3,short"]
    (reject,) = feeds.rejects(landed, feed).collect()
    assert reject.reject_reasons[0] == "line: wrong number of fields"
    multi = feeds.read_feed(spark, str(folder), feed, multi_line=True)
    assert ("2", "name2", "mail2") in [(row.user_id, row.username, row.email) for row in multi.collect()]
