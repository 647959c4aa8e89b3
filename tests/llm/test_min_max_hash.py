import random

import numpy as np
import pytest

from renewlens.llm import min_max_hash as mm
from renewlens.llm.common import store
from tests.llm.helpers import components, documents, shingles


def found(spark, rows, **options):
    return mm.near_duplicates(documents(spark, rows), **options).collect()


def near_copies(base, count, edits):
    out = []
    for _ in range(count):
        words = base.split()
        for _ in range(random.randint(0, edits)):
            words[random.randrange(len(words))] = f"w{random.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("length", [4, 5])
def test_groups_of_copies_against_all_pairs(spark, length):
    random.seed(6)
    texts = []
    for group in range(6):
        base = " ".join(f"g{group}w{random.randrange(4000)}" for _ in range(120))
        texts += near_copies(base, 40, 8)
    texts += [texts[0]] * 20 + ["a b c", "A b C", "a b", "", None, "   ", "x y z v u", "x y z v u t"]
    random.shuffle(texts)
    rows = list(enumerate(texts))
    expected = components(dict(rows), length)
    result = found(spark, rows, words=length)
    assert {row.doc_id: row.component_id for row in result} == expected
    for row in result:
        assert row.n_shingles == len(shingles(texts[row.doc_id], length))
        assert row.kept == (expected[row.doc_id] == row.doc_id)


def test_values_estimate_similarity():
    random.seed(2)
    a = np.arange(1000, dtype=np.uint64)
    sets = [mm._scramble(a), mm._scramble(a[200:])]
    signature = mm.signatures(sets, 400)
    assert abs((signature[0] == signature[1]).mean() - 0.8) < 0.05


def test_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (5, text), (2, text), (None, text), (9, None), (7, text + " " + "tail " * 3000)]
    result = found(spark, rows)
    assert len(result) == len(rows)
    by_id = {row.doc_id: (row.component_id, row.kept) for row in result}
    assert by_id == {5: (2, False), 2: (2, True), None: (None, True), 9: (9, True), 7: (7, True)}
    assert found(spark, []) == []


def test_one_of_each_keeps_columns(spark):
    text = "one two three four five six seven"
    frame = documents(spark, [(1, text), (2, text), (3, "other words are here in this text"), (4, None)])
    left = mm.one_of_each(frame)
    assert left.columns == frame.columns
    assert sorted(row.doc_id for row in left.collect()) == [1, 3, 4]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 3)], "a bigint, b bigint")
    result = {row.id: row.component for row in mm.components(links).collect()}
    assert result == {**dict.fromkeys(range(100, 161), 100), 3: 3, 7: 3}


def test_no_plan_of_a_round_repeats_what_it_reads(spark, monkeypatch):
    """The driver holds and plans again every repetition, whatever the size of the tables."""
    reads = []

    def counted(df, purpose, **options):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        reads.append((purpose, plan.count("Relation [")))
        return store(df, purpose, **options)

    monkeypatch.setattr(mm, "store", counted)
    links = spark.createDataFrame([(i, i + 1) for i in range(10)], "a bigint, b bigint")
    assert {row.component for row in mm.components(links).collect()} == {0}
    assert {purpose for purpose, _ in reads} >= {"minmax-edges", "minmax-components"}
    assert max(n for _, n in reads) <= 4, reads
