import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

from renewlens.operators import typed
from renewlens.plans import reports
from renewlens.plans.session import partitions_for, settings_for
from renewlens.plans.warehouse import MARTS, TYPED, Landing, Warehouse
from renewlens.sources import feeds, storage, tables

from .conftest import AS_OF, SMALL
from .helpers import rows, text_frame

FCT_SUBSCRIPTIONS = {
    "row_id": "string",
    "subscription_id": "bigint",
    "user_id": "bigint",
    "subscription_type": "string",
    "start_date": "date",
    "end_date": "date",
    "created_at": "string",
}


@pytest.fixture(scope="module")
def landing(spark):
    return Landing.from_standins(spark, SMALL)


@pytest.fixture(scope="module")
def warehouse(landing):
    return Warehouse.from_landing(landing, as_of=AS_OF)


@pytest.fixture(scope="module")
def stored(spark, warehouse):
    warehouse.save_tables(spark, "saved_tables")
    return Warehouse.from_tables(spark, "saved_tables", as_of=AS_OF)


def test_namespace_life(spark):
    assert not tables.namespace_exists(spark, "ns_life")
    tables.create_namespace(spark, "ns_life")
    tables.create_namespace(spark, "ns_life")
    assert tables.namespace_exists(spark, "ns_life")
    tables.use_namespace(spark, "ns_life")
    try:
        tables.save_table(spark.range(3), "numbers")
        assert tables.table_exists(spark, "ns_life.numbers")
        tables.empty_table(spark, "ns_life.numbers")
        assert spark.table("ns_life.numbers").count() == 0
        tables.save_table(spark.range(2), "ns_life.numbers")
        assert spark.table("numbers").count() == 2
        tables.drop_table(spark, "ns_life.numbers")
        tables.drop_table(spark, "ns_life.numbers")
        assert not tables.table_exists(spark, "ns_life.numbers")
    finally:
        tables.use_namespace(spark, "default")


def test_column_contract(warehouse):
    assert tables.columns_of(warehouse.fct_subscriptions) == list(FCT_SUBSCRIPTIONS.items())
    tables.check_columns(warehouse.fct_subscriptions, FCT_SUBSCRIPTIONS)
    with pytest.raises(ValueError, match="columns differ"):
        tables.check_columns(
            warehouse.fct_subscriptions.drop("created_at"), FCT_SUBSCRIPTIONS
        )


def test_columns_of_every_relation(warehouse):
    """Names, order and types of the eight relations."""
    found = {name: df.dtypes for name, df in warehouse.relations().items()}
    text, wide = "string", "bigint"
    assert found["dim_users"] == [
        ("row_id", text), ("user_id", wide), ("username", text), ("email", text),
        ("first_name", text), ("last_name", text), ("subscription_type", text),
        ("created_at", text),
    ]
    assert found["fct_payments"] == [
        ("row_id", text), ("payment_id", wide), ("user_id", wide), ("subscription_id", wide),
        ("amount_cents", "int"), ("amount", "decimal(12,2)"), ("payment_date", "date"),
        ("payment_method", text), ("created_at", text),
    ]
    assert found["engagement_per_user"] == [("user_id", wide), ("total_listens", wide)]
    assert found["bi_subscriptions"] == [
        ("subscription_id", wide), ("user_id", wide), ("subscription_type", text),
        ("start_date", "date"), ("end_date", "date"), ("is_active", "boolean"),
        ("is_churned", "boolean"), ("tenure_days", "int"), ("tenure_bucket", text),
    ]
    assert found["bi_payments"] == [
        ("payment_id", wide), ("subscription_id", wide), ("user_id", wide),
        ("subscription_type", text), ("amount_cents", "int"), ("amount", "decimal(12,2)"),
        ("payment_method", text), ("payment_time_raw", "date"), ("created_time_raw", text),
    ]
    assert found["bi_engagement"] == found["engagement_per_user"]
    assert [name for name, _ in found["bi_churn_tenure"]] == [
        "tenure_bucket", "total_subscriptions", "churned_subscriptions", "churn_rate_percent",
    ]
    assert found["fct_subscriptions"] == list(FCT_SUBSCRIPTIONS.items())


def test_views_cover_all_relations_and_are_replaced(spark, warehouse):
    tables.publish_views(warehouse.relations())
    tables.publish_views(warehouse.relations())
    for name in (*TYPED, *MARTS):
        assert spark.catalog.tableExists(name)
    total = spark.sql("SELECT sum(total_subscriptions) FROM bi_churn_tenure").first()[0]
    known = spark.sql("SELECT count(*) FROM fct_subscriptions WHERE start_date IS NOT NULL")
    assert total == known.first()[0]


def test_reports_agree_on_stored_and_landed_data(warehouse, stored):
    for name, report in {**reports.METRICS, **reports.FIGURES}.items():
        # The rows of a page come in no order.
        in_order = sorted if name.endswith("_page") else list
        assert in_order(rows(report(stored))) == in_order(rows(report(warehouse))), name


def test_parquet_folder_holds_the_typed_tables(spark, warehouse):
    folder = storage.shared_folder(spark, "typed")
    warehouse.save_parquet(folder)
    back = Warehouse.from_parquet(spark, folder, as_of=AS_OF)
    assert back.fct_payments.dtypes == warehouse.fct_payments.dtypes
    assert rows(back.bi_churn_tenure) == rows(warehouse.bi_churn_tenure)


def test_feeds_from_csv_give_the_same_reports(spark, landing, warehouse):
    paths = {}
    for name in ("users", "subscriptions", "payments", "listening"):
        paths[name] = storage.shared_folder(spark, name)
        storage.export_csv(getattr(landing, name), paths[name], quote_all=False)
    landed = Landing.from_csv(spark, **paths)
    assert {name: df.count() for name, df in landed.rejects().items()} == dict.fromkeys(paths, 0)
    from_csv = Warehouse.from_landing(landed, as_of=AS_OF)
    for name in ("m06_status_rates_by_plan", "m12_revenue_share_by_plan", "m17_engagement_by_plan"):
        assert rows(reports.METRICS[name](from_csv)) == rows(reports.METRICS[name](warehouse))


def test_churn_mart_export(spark, warehouse, tmp_path):
    """All fields quoted, a header, buckets in order, CRLF line ends on request."""
    mart = warehouse.bi_churn_tenure
    storage.export_csv(mart.coalesce(1), str(tmp_path / "out"), line_sep="\r\n")
    (part,) = (tmp_path / "out").glob("*.csv")
    lines = part.read_bytes().decode().split("\r\n")
    assert lines[0] == (
        '"tenure_bucket","total_subscriptions","churned_subscriptions","churn_rate_percent"'
    )
    assert lines[1:-1] == [
        ",".join(f'"{value}"' for value in row) for row in rows(mart)
    ]
    back = spark.read.schema(mart.schema).option("header", True).csv(str(tmp_path / "out"))
    assert rows(back) == rows(mart)


def test_rejects_can_be_stored(spark):
    feed = feeds.users_feed()
    raw = text_frame(spark, feed, [{"user_id": "x"}, {"user_id": "7"}])
    tables.create_namespace(spark, "quarantine")
    tables.save_table(feeds.rejects(raw, feed), "quarantine.users")
    (row,) = spark.table("quarantine.users").collect()
    assert (row.user_id, row.reject_reasons) == ("x", ["user_id: not a whole number (bigint)"])
    assert typed.dim_users(raw).count() == 1


def test_shared_folder_comes_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    folder = storage.shared_folder(spark, "x")
    assert folder.startswith(f"{root}/renewlens-{spark.sparkContext.applicationId}/x-")
    assert folder != storage.shared_folder(spark, "x")


def test_a_folder_of_one_machine_is_refused_on_a_cluster(spark, setting, monkeypatch):
    """The session's shared folder has no scheme, and files are its default one."""
    assert storage.shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    monkeypatch.setattr(storage, "_master", lambda session: "yarn")
    with pytest.raises(ValueError, match="a folder of one machine"):
        storage.shared_folder(spark, "x")
    with pytest.raises(ValueError, match="a folder of one machine"), storage.scratch(spark):
        pass
    setting(spark__renewlens__sharedMount="true")
    assert storage.shared_root(spark) == spark.conf.get("spark.checkpoint.dir")


def _on_a_cluster(setting, monkeypatch, root):
    """Another setting names the folder, as a running session keeps its own."""
    monkeypatch.setattr(storage, "SHARED", "spark.renewlens.testFolder")
    monkeypatch.setattr(storage, "_master", lambda session: "spark://host:7077")
    setting(spark__renewlens__testFolder=root)


@pytest.mark.parametrize(
    "name", ["s01_users_through_csv", "s04_churn_mart_through_csv", "t01_saved_table_counts"]
)
def test_a_mount_named_with_its_scheme_serves_a_cluster(spark, setting, monkeypatch, name):
    _on_a_cluster(setting, monkeypatch, f"file://{spark.conf.get('spark.checkpoint.dir')}")
    with storage.scratch(spark):
        assert entry.queries()[name](spark, SMALL).collect()


@pytest.mark.parametrize(
    "name",
    ["s01_users_through_csv", "s04_churn_mart_through_csv", "t01_saved_table_counts", "op7_line_dedup"],
)
def test_a_mount_named_by_a_plain_path_serves_a_standalone_cluster(spark, setting, monkeypatch, name):
    """As Spark's defaults often name it: the driver finds what tasks write there."""
    _on_a_cluster(setting, monkeypatch, spark.conf.get("spark.checkpoint.dir"))
    with storage.scratch(spark):
        assert entry.queries()[name](spark, SMALL).collect()


def test_a_plain_path_that_tasks_do_not_reach_is_refused(spark, setting, monkeypatch):
    root = spark.conf.get("spark.checkpoint.dir")
    _on_a_cluster(setting, monkeypatch, root)
    monkeypatch.setattr(storage, "_REACHED", {(spark.sparkContext.applicationId, root): False})
    with pytest.raises(ValueError, match="a folder of one machine"):
        storage.shared_folder(spark, "x")


def test_a_mount_that_tasks_do_not_reach_is_refused(spark, setting, monkeypatch):
    """As where every machine has a folder of that name for itself: the driver finds no files."""
    root = f"file://{spark.conf.get('spark.checkpoint.dir')}"
    _on_a_cluster(setting, monkeypatch, root)
    monkeypatch.setattr(storage, "_REACHED", {(spark.sparkContext.applicationId, root): False})
    with pytest.raises(ValueError, match="a folder of one machine"):
        storage.shared_folder(spark, "x")


def test_the_folder_of_the_context_serves_where_no_setting_does(spark, setting, tmp_path, monkeypatch):
    _on_a_cluster(setting, monkeypatch, "")
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: f"file:{tmp_path}/c")
    assert storage.shared_root(spark) == f"file:{tmp_path}/c"


def test_without_a_setting_only_one_machine_alone_uses_its_warehouse(tmp_path):
    """In a session of its own, which sets no shared folder."""
    work = f"""
import sys
from renewlens.plans.session import local_session
from renewlens.sources import storage
spark = local_session("bare", 1, **{{"spark.sql.warehouse.dir": "{tmp_path}/warehouse"}})
folder = storage.shared_folder(spark, "x")
assert folder.startswith("file:{tmp_path}/warehouse/renewlens-"), folder
spark.range(3).write.parquet(folder)
storage._master = lambda session: "spark://host:7077"
try:
    storage.shared_folder(spark, "x")
except ValueError as refused:
    assert "spark.checkpoint.dir" in str(refused)
else:
    sys.exit("not refused")
"""
    # Nor do the machine's own defaults.
    bare = {**os.environ, "SPARK_CONF_DIR": str(tmp_path)}
    subprocess.run([sys.executable, "-c", work], check=True, timeout=120, env=bare)
    # The application took its folder with it.
    assert [path.name for path in (tmp_path / "warehouse").iterdir()] == []


def _left(spark):
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    return {path for path in root.rglob("*") if path.is_file()}


@pytest.mark.parametrize(
    "name", ["s01_users_through_csv", "s04_churn_mart_through_csv", "t01_saved_table_counts"]
)
def test_a_run_leaves_no_scratch(spark, name):
    before = _left(spark)
    with storage.scratch(spark) as folder:
        found = entry.queries()[name](spark, SMALL).collect()
        assert found and storage.exists(spark, folder) and _left(spark) > before
    assert not storage.exists(spark, folder) and _left(spark) == before


def test_scratch_is_removed_after_a_failure(spark):
    before = _left(spark)
    with pytest.raises(ZeroDivisionError), storage.scratch(spark) as folder:
        spark.range(3).write.parquet(storage.shared_folder(spark, "x"))
        assert storage.exists(spark, folder)
        _ = 1 / 0
    assert _left(spark) == before
    storage.remove(spark, folder)


def test_tasks_and_shuffle_partitions_grow_with_the_input_up_to_a_bound():
    gib = 1024**3
    key, scan = "spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"
    small, large, huge = (settings_for(size * gib, 100) for size in (0, 1024, 100 * 1024))
    assert (small[key], small[scan]) == ("100", str(gib // 8))
    assert (large[key], large[scan]) == ("1024", str(gib // 8))
    assert huge[key] == "50000"
    assert settings_for(0, 100, present=2000)[key] == "2000"
    assert settings_for(1024 * gib, 100, present=90_000)[key] == "90000"
    # A mart shuffles whole rows and gets eight times as many.
    assert partitions_for(1024 * gib) == 8 * partitions_for(128 * gib) == 8192
    assert gib // 8 < int(huge[scan]) <= gib
