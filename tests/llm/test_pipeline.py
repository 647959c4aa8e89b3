"""The pipeline against a plain version of every stage, on the small tables."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as pipeline
from renewlens.llm import sql, toxicity
from renewlens.llm.common import fold, store
from tests.conftest import SMALL
from tests.llm.helpers import components
from tests.llm.test_decontamination import best, normal, shingles
from tests.llm.test_token_ids import encode


@pytest.fixture(scope="module")
def steps(spark):
    """What goes into the first stage and what comes out of each."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = [docs]
    for _, stage in pipeline.STAGES:
        docs = store(stage(spark, docs, SMALL), "test-stage")
        found.append(docs)
    return found


def texts(df):
    return {row.doc_id: row.text or "" for row in df.collect()}


def test_stages_keep_the_columns(steps):
    assert len(pipeline.STAGES) == 5
    assert all(df.columns == steps[0].columns for df in steps[1:5])


def test_toxic_documents_go(spark, steps):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.fit(steps[0], labels, fold("doc_id", 5) != 0)
    scored = toxicity.score(steps[0], model).collect()
    assert set(texts(steps[1])) == {row.doc_id for row in scored if row.score < 0.5}


def test_one_of_each_group_stays(steps):
    before = texts(steps[1])
    smallest = components(before, 5)
    assert set(texts(steps[2])) == {i for i in before if smallest[i] == i}
    assert len(texts(steps[2])) < len(before)


def test_documents_with_items_go(spark, steps):
    before = texts(steps[2])
    items = [row.text for row in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    runs = {run for item in items for run in shingles(normal(item))}
    near = {i: text for i, text in before.items() if runs & set(shingles(normal(text)))}
    leaking = {i for i, text in near.items() if any(best(text, item) >= 0.8 for item in items)}
    assert leaking
    assert set(texts(steps[3])) == set(before) - leaking


def test_mix_takes_what_the_sql_takes(steps):
    rows = steps[3].collect()
    con = duckdb.connect()
    con.register(
        "documents",
        pa.table(
            {
                "doc_id": pa.array([row.doc_id for row in rows], pa.int64()),
                "text": pa.array([row.text for row in rows], pa.string()),
                "source": pa.array([row.source for row in rows], pa.string()),
            }
        ),
    )
    taken = con.execute(f"SELECT doc_id, taken // size FROM ({sql.MIXING}) WHERE size > 0").fetchall()
    times = Counter(row.doc_id for row in steps[4].collect())
    assert times == Counter({i: int(n) for i, n in taken if n})


def test_ids_are_those_of_the_mix(steps):
    expected, start = [], 0
    for row in sorted(steps[4].collect(), key=lambda row: row.doc_id):
        ids = encode(row.text)
        digest = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        expected.append((row.doc_id, start, len(ids), digest))
        start += len(ids)
    assert sorted(tuple(row) for row in steps[5].collect()) == sorted(expected)


def test_run_is_all_stages(spark, steps):
    found = sorted(tuple(row) for row in pipeline.run(spark, SMALL).collect())
    assert found == sorted(tuple(row) for row in steps[5].collect())


def test_empty_documents(spark, steps):
    docs = steps[0].limit(0)
    for _, stage in pipeline.STAGES:
        docs = store(stage(spark, docs, SMALL), "test-empty")
        assert docs.count() == 0
