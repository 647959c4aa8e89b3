"""Hosts, paths and rules against a plain version; the trees by held-out accuracy."""

import math
import zlib

import pytest
from pyspark.sql import functions as F

from renewlens.llm import queries, url_filter
from renewlens.llm.url_filter import Rule
from tests.conftest import MEDIUM

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@pytest.fixture(scope="module")
def labelled(spark):
    return url_filter.labelled_urls(spark)


@pytest.fixture(scope="module")
def model(labelled):
    return url_filter.fit(labelled)


def plain(url):
    """Host, path and the rule that decides, character by character."""
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [
        (verdict, h + p)
        for verdict, h, p in RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    verdict, rule = max(fits, key=lambda fit: len(fit[1]), default=(None, None))
    return host, path, rule, verdict


URLS = [
    "https://Blog.Example.NET/en/1?x=/de/#f", "http://example.net/en/", "http://example.net/en",
    "http://anet/en/", "http://a.net", "http://a.net?x=/", "http://net/", "http://x.org/fr/1",
    "http://example.com/de/2", "http://my.example.com/DE/2", "http://notexample.com/de/2",
    "x://y://z.net/en/", "://", "http://", "no url", "", None, "HTTP://A.B/\nc?d", "http://a.net:80/",
    "http://a.net./", "http://é.NÉT/É", "ftp://user@x.example.com/de/", "http://x.org#/fr/",
    "http://" + "a" * 100_000 + ".net/" + "b/" * 50_000,
]


def test_hosts_paths_and_rules(spark, model):
    frame = spark.createDataFrame(
        [(i, url, "h", "p", "r", 1.0) for i, url in enumerate(URLS)],
        "page_id int, url string, host string, path string, rule string, depth double",
    )
    found = url_filter.judge(frame, queries.URL_RULES, model)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict", "unwanted_score"]
    for row in found.collect():
        host, path, rule, verdict = plain(URLS[row.page_id])
        assert (row.host, row.path, row.rule) == (host, path, rule), URLS[row.page_id]
        assert row.verdict == (verdict or ("block" if row.unwanted_score >= 0.5 else "allow"))


def test_the_longest_rule_wins_whatever_the_order(spark, model):
    frame = spark.createDataFrame([("a", "http://w.x.example/a/b/c")], "page_id string, url string")
    rules = [Rule("allow", "x.example", "/a/b/"), Rule("block", "example"), Rule("block", "w.x.example", "/a/")]
    for order in (rules, rules[::-1]):
        (row,) = url_filter.judge(frame, order, model).collect()
        assert (row.page_id, row.rule, row.verdict) == ("a", "w.x.example/a/", "block")
    (row,) = url_filter.judge(frame, [], model).collect()
    assert row.rule is None and row.verdict in ("allow", "block")


def test_repeated_null_and_missing_rows(spark, model):
    frame = spark.createDataFrame([(1, "http://a.net/")] * 3 + [(None, None)], "page_id int, url string")
    found = url_filter.judge(frame, queries.URL_RULES, model).collect()
    assert sorted(row.verdict for row in found if row.page_id) == ["block"] * 3 and len(found) == 4
    assert url_filter.judge(frame.where("false"), queries.URL_RULES, model).collect() == []


def test_features_of_a_url(spark):
    url = "http://a-1.b.example/x/y.html?p=1&&q=22#f"
    frame = spark.createDataFrame([(url,), ("",), (None,)], "url string")
    rows = url_filter.with_features(frame, "url", {"example": (3, 8), "net": (1, 2)}).collect()
    full, empty, null = (row.asDict() for row in rows)
    counts = {c: url.count(c) for c in set(url)}
    bits = sum(n / len(url) * math.log2(len(url) / n) for n in counts.values())
    assert full["url_entropy"] == pytest.approx(bits)
    wanted = {
        "url_length": len(url), "host_length": 13, "path_length": 9, "depth": 2, "host_labels": 3,
        "host_digit_share": 1 / 13, "host_hyphens": 1, "longest_host_run": 7, "parameters": 2,
        "suffix_unwanted": 0.4, "suffix_common": 0.8, "digit_share": 4 / len(url),
    }
    assert {name: full[name] for name in wanted} == pytest.approx(wanted)
    assert {**empty, "url": None} == null
    assert all(value is not None for name, value in null.items() if name != "url")


def test_the_model_does_not_depend_on_the_layout(labelled, model):
    again = url_filter.fit(labelled.repartition(7))
    assert again.trees.toDebugString.split("\n")[1:] == model.trees.toDebugString.split("\n")[1:]


def test_held_out_accuracy(labelled):
    """Every third labelled URL is held out."""
    held = F.crc32(F.col("url").cast("binary")) % 3 == 0
    fitted = url_filter.fit(labelled.where(~held))
    rows = url_filter.score(labelled.where(held), fitted).collect()
    assert len(rows) > 25 and {row.unwanted for row in rows} == {0, 1}
    assert all(zlib.crc32(row.url.encode()) % 3 == 0 for row in rows)
    right = sum((row.unwanted_score >= 0.5) == (row.unwanted == 1) for row in rows)
    assert right >= 0.85 * len(rows)


def test_labels_that_cannot_be_fitted(spark, labelled):
    with pytest.raises(ValueError, match="labels 0 and 1"):
        url_filter.fit(labelled.where("unwanted = 1"))
    with pytest.raises(ValueError, match="at most 5 rows"):
        url_filter.fit(labelled, most=5)


def test_query_over_the_whole_table(spark):
    found = queries.queries()["op13_url_filter"](spark, MEDIUM).collect()
    urls = {row.page_id: row.url for row in spark.read.parquet(f"{MEDIUM}/pages.parquet").collect()}
    assert len(found) == len(urls)
    for row in found:
        host, path, rule, verdict = plain(urls[row.page_id])
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == verdict or (verdict is None and row.verdict in ("allow", "block"))
