import itertools
import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from renewlens.llm import hidden_markov as hm
from renewlens.llm.common import fold
from renewlens.llm.queries import queries
from tests.conftest import MEDIUM
from tests.llm.helpers import documents, folded


@pytest.fixture
def model():
    random = np.random.default_rng(5)
    rows = random.uniform(size=(3, 3))
    emit = random.uniform(size=(4, 3))
    start = random.uniform(size=3)
    return hm.Model(start / start.sum(), rows / rows.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def paths(values, model):
    """(states, probability) of every path."""
    for states in itertools.product(range(3), repeat=len(values)):
        p = model.start[states[0]]
        for t, (state, value) in enumerate(zip(states, values, strict=True)):
            p *= model.emit[value, state] * (model.step[states[t - 1], state] if t else 1)
        yield states, p


def test_forward_sums_all_paths(model):
    texts = [[0], [1, 2, 3], [3, 3, 0, 1, 2], [2, 0]]
    lengths = np.array([len(one) for one in texts])
    flat = np.concatenate(texts)
    found = hm.forward_log10(flat, np.cumsum(lengths) - lengths, lengths, model)
    expected = [math.log10(sum(p for _, p in paths(one, model))) for one in texts]
    assert np.allclose(found, expected)


def test_expected_counts_weigh_all_paths(model):
    texts = [[1, 2, 3, 0], [3, 0], [2, 2, 1]]
    lengths = np.array([len(one) for one in texts])
    found = hm._expected_counts(
        np.concatenate(texts), np.cumsum(lengths) - lengths, lengths, np.ones(3, dtype=bool), model
    )
    start, step, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    for text in texts:
        total = sum(p for _, p in paths(text, model))
        for states, p in paths(text, model):
            start[states[0]] += p / total
            for t, (state, value) in enumerate(zip(states, text, strict=True)):
                emit[value, state] += p / total
                if t:
                    step[states[t - 1], state] += p / total
    for one, other in zip(found, (start, step, emit), strict=True):
        assert np.allclose(one, other)


def test_pieces_of_a_text_count_every_step_and_word_once(model):
    settled = hm._settled(model.step)
    assert np.allclose(settled @ model.step, settled)
    text = np.array([1, 2, 3, 0, 2, 2, 1, 3, 3, 0, 1, 2])
    begins, ends = np.array([0, 3, 7]), np.array([4, 8, 12])
    fresh = np.array([True, False, False])
    start, step, emit = hm._expected_counts(text, begins, ends - begins, fresh, model)
    assert np.isclose(start.sum(), 1) and np.isclose(step.sum(), len(text) - 1)
    assert np.allclose(emit.sum(axis=1), np.bincount(text, minlength=4))
    alone = hm._expected_counts(text, begins[:1], ends[:1], fresh[:1], model)
    assert np.allclose(start, alone[0])


def test_the_most_frequent_words_exactly_are_classes(spark):
    """Also where many words are equally frequent, in the order of words."""
    times = {"a": 9, "b": 5, **{f"w{i:02}": 3 for i in range(30)}, "z": 1}
    text = " ".join(word for word, n in times.items() for _ in range(n))
    counts = hm.count_words(documents(spark, [(1, text)]))
    ranked = sorted(times, key=lambda word: (-times[word], word))
    for frequent in (0, 1, 2, 3, 17, 32, 33, 50):
        classes = hm.choose_classes(counts, 1, frequent=frequent, tail_groups=4)
        wanted = ranked[:frequent]
        assert classes.frequent == {word.encode(): n for n, word in enumerate(wanted, start=1)}
        assert classes.tail_words.sum() == len(times) - len(wanted)
        assert classes.counts.sum() + classes.tail_counts.sum() == sum(times.values()) + 1


def test_text_ids(spark):
    frame = spark.createDataFrame([("x", "a b a"), ("y", None)], "doc_id string, text string")
    found = hm.score(frame, fold("doc_id", 7) < 0, states=2, steps=1)
    assert {row.doc_id: row.n_tokens for row in found.collect()} == {"x": 4, "y": 1}


def test_base_score_against_plain_counts(spark, medium_texts):
    train = Counter()
    tokens = {i: [*folded(text), "\n"] for i, text in medium_texts.items()}
    held = {i: crc32(str(i).encode()) % 7 == 2 for i in tokens}
    for i, found in tokens.items():
        if not held[i]:
            train.update(found)
    total, distinct = sum(train.values()), len(train)
    rows = queries()["op1_hidden_markov"](spark, MEDIUM).collect()
    assert len(rows) == len(tokens)
    for row in rows:
        found = tokens[row.doc_id]
        base = sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in found)
        assert (row.held_out, row.n_tokens, row.train_tokens) == (held[row.doc_id], len(found), total)
        assert row.n_known == sum(train[w] > 0 for w in found)
        assert abs(row.base_score - base) < 1e-8 * abs(base)
    unseen = [row for row in rows if row.held_out]
    assert sum(row.score for row in unseen) > sum(row.base_score for row in unseen)


def test_steps_raise_the_likelihood(spark):
    texts = ["red blue red blue " * 6, "one two three " * 8, "blue red " * 5] * 6
    frame = documents(spark, list(enumerate(texts)))
    scores = [
        sum(
            row.score
            for row in hm.score(
                frame, fold("doc_id", 7) == 2, states=3, steps=steps, frequent=50, strength=0.1
            ).collect()
            if not row.held_out
        )
        for steps in (1, 3, 6)
    ]
    assert scores[0] < scores[1] < scores[2]


def test_odd_rows(spark):
    long_word = "x" * 500
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a"), (3, "a"), (4, "é " + long_word), (5, long_word)]
    found = hm.score(documents(spark, rows), fold("doc_id", 7) == 2, frequent=2).collect()
    assert len(found) == len(rows)
    assert all(math.isfinite(row.score) and math.isfinite(row.base_score) for row in found)
    assert {row.n_tokens for row in found if row.doc_id in (1, 2)} == {1}
    every = fold("doc_id", 7) >= 0
    assert all(row.n_known == 0 for row in hm.score(documents(spark, rows), every).collect())
    assert hm.score(documents(spark, []), every).count() == 0
