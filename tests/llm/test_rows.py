"""Operators that pass whole documents on: column names of any kind, ids of any kind, repeated rows."""

import pytest

from renewlens.llm import decontamination, min_max_hash, mixing, toxicity
from renewlens.llm.common import free_prefix, ids_tell_rows_apart

NAMES = (
    "_source", "_copies", "_copy", "_leaking", "_dropped", "_row", "_mix_copies", "__mix_source",
    "_Target", "component_id", "stays", "key", "n",
)
GROUP = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
ITEM = "the quick brown fox jumps over the lazy dog near the river bank today"


def frame(spark, rows, kind="bigint"):
    """Rows of (id, text, source) with a column for each name that an operator might add."""
    extra = tuple(f"v{i}" for i in range(len(NAMES)))
    columns = ", ".join(f"`{name}` string" for name in NAMES)
    return spark.createDataFrame(
        [(*row, *extra) for row in rows], f"doc_id {kind}, text string, source string, {columns}"
    )


def kept(df, spark):
    assert [tuple(row)[3:] for row in df.collect()] == [tuple(f"v{i}" for i in range(len(NAMES)))] * df.count()
    return sorted((str(row.doc_id), row.text or "", row.source) for row in df.collect())


def test_free_names():
    assert free_prefix(["a", "b"], "_x") == "_x"
    assert free_prefix(["_X1", "__x", "b"], "_x") == "___x"


def test_mixed_documents_keep_columns_of_any_name(spark):
    docs = frame(spark, [(i, f"w{i} " * 5, "ab"[i % 2]) for i in range(40)])
    plain = docs.select("doc_id", "text", "source")
    found = mixing.mixed_documents(docs)
    assert found.columns == docs.columns
    expected = sorted((str(r.doc_id), r.text, r.source) for r in mixing.mixed_documents(plain).collect())
    assert kept(found, spark) == expected


def test_documents_without_leaks_keep_columns_of_any_name(spark):
    docs = frame(spark, [(1, f"start {ITEM} end", "a"), (2, "clean words only here", "a"), (None, ITEM, "b"), (None, "x", "b")])
    benchmark = spark.createDataFrame([(7, ITEM)], "item_id bigint, text string")
    found = decontamination.without_leaks(docs, benchmark)
    assert found.columns == docs.columns
    assert kept(found, spark) == [("2", "clean words only here", "a"), ("None", "x", "b")]


def test_toxicity_keeps_columns_of_any_name(spark):
    docs = frame(spark, [(1, "some words", "a"), (2, None, "b")])
    model = toxicity.train([], ["plain text"])
    assert len(kept(toxicity.without_toxic(docs, model), spark)) == 2


@pytest.mark.parametrize("kind", ["bigint", "int", "string"])
def test_one_of_each_with_ids_of_their_own(spark, kind):
    ids = [str(i) if kind == "string" else i for i in range(1, 6)]
    texts = [GROUP, GROUP, f"{GROUP} lambda", "other words of its own", ""]
    docs = frame(spark, [(i, text, "a") for i, text in zip(ids, texts)], kind)
    assert ids_tell_rows_apart(docs, "doc_id")
    found = min_max_hash.one_of_each(docs)
    assert found.columns == docs.columns
    assert [row[0] for row in kept(found, spark)] == ["1", "4", "5"]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_one_row_of_each_group_stays_where_ids_are_null_or_repeated(spark, kind):
    def one(i):
        return None if i is None else str(i) if kind == "string" else i

    rows = [
        (None, GROUP), (None, GROUP), (None, "words that stand alone"), (None, "more words that stand alone"),
        (5, GROUP), (3, f"{GROUP} lambda"), (3, "a text with the same id but other words"),
        (8, "a repeated row of words"), (8, "a repeated row of words"), (9, None), (9, ""), (None, None),
    ]
    docs = frame(spark, [(one(i), text, "a") for i, text in rows], kind)
    assert not ids_tell_rows_apart(docs, "doc_id")
    found = kept(min_max_hash.one_of_each(docs), spark)
    assert found == sorted(
        (str(i), text or "", "a")
        for i, text in [
            (3, f"{GROUP} lambda"), (None, "words that stand alone"), (None, "more words that stand alone"),
            (3, "a text with the same id but other words"), (8, "a repeated row of words"),
            (9, None), (9, ""), (None, None),
        ]
    )


def test_near_duplicates_of_text_ids(spark):
    rows = [("b", GROUP), ("a10", GROUP), ("a9", f"{GROUP} lambda"), ("c", "on its own it stands"), (None, GROUP), ("d", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = {row.doc_id: tuple(row)[1:] for row in min_max_hash.near_duplicates(docs).collect()}
    assert found == {
        "b": (6, "a10", False), "a10": (6, "a10", True), "a9": (7, "a10", False),
        "c": (1, "c", True), None: (6, None, True), "d": (0, "d", True),
    }
    assert min_max_hash.near_duplicates(docs.where("false")).count() == 0
