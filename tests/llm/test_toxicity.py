import math
import random

import pytest

from renewlens.llm import toxicity
from renewlens.llm.common import fold
from renewlens.llm.queries import queries
from tests.llm.helpers import documents

LARGE = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    scored = queries()["op6_toxicity"](spark, LARGE)
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    toxic = [row for row in rows if row.toxic]
    clean = [row for row in rows if not row.toxic]
    assert sum(row.predicted for row in toxic) / len(toxic) > 0.6
    assert sum(row.predicted for row in clean) / len(clean) < 0.02
    above = sum(a.score > b.score for a in toxic for b in clean)
    assert above / (len(toxic) * len(clean)) > 0.9
    assert all(0 <= row.score <= 1 and row.predicted == (row.score >= 0.5) for row in rows)


def _corpus():
    random.seed(9)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "su", "te") for b in ("ran", "dol", "vis", "pem")]
    rude = ["zwugrat", "fnorple", "blixxon"]
    rows, labels = [], []
    for i in range(400):
        text = random.choices(plain, k=60)
        toxic = i % 5 == 0
        for _ in range(6 if toxic else 0):
            text.insert(random.randrange(len(text)), random.choice(rude))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_new_words_of_toxic_texts_are_learnt(spark):
    rows, labels = _corpus()
    frame = documents(spark, rows)
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(frame, table, fold("doc_id", 5) != 0)
    truth = dict(labels)
    found = toxicity.score(frame, model).collect()
    wrong = sum(row.predicted != truth[row.doc_id] for row in found)
    assert wrong <= 0.05 * len(found)
    left = toxicity.without_toxic(frame, model)
    assert left.columns == frame.columns
    predicted = {row.doc_id for row in found if not row.predicted}
    assert {row.doc_id for row in left.collect()} == predicted


def test_odd_rows(spark):
    rows, labels = _corpus()
    frame = documents(spark, rows)
    odd_labels = [*labels, (None, 1), (1, None), (10**9, 1), (2, 0)]
    table = spark.createDataFrame(odd_labels, "doc_id bigint, toxic int")
    model = toxicity.fit(frame, table, fold("doc_id", 5) != 0)
    odd = [(1, None), (2, ""), (None, "karan lodol"), (3, "x"), (3, "x"), (4, "q" * 5000)]
    found = toxicity.score(documents(spark, odd), model).collect()
    assert len(found) == len(odd)
    assert len({row.score for row in found if row.doc_id in (1, 2)}) == 1
    assert len(toxicity.without_toxic(documents(spark, odd), model).collect()) <= len(odd)
    assert toxicity.score(documents(spark, []), model).count() == 0
    only_clean = spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(frame, only_clean, fold("doc_id", 5) >= 0)
    assert {row.predicted for row in toxicity.score(frame, model).collect()} == {0}


def test_windows_hold_all_words():
    text = "A b\tC " * 50 + "x" * 3000
    joined = b"".join(toxicity.windows(text))
    assert joined.split() == text.encode().lower().split()
    assert max(map(len, toxicity.windows(text))) <= toxicity.LONGEST_WINDOW
    assert toxicity.windows("") == []


def _accuracy(said, quoted=(), each=3):
    """Shares found of toxic and of other texts that the model had not seen."""
    random.seed(4)
    plain = [f"{a}{b}{c}" for a in "klmst" for b in ("ran", "dol", "vis", "pem") for c in "aeiou"]
    toxic, ordinary = [], []
    for i in range(1200):
        text = random.choices(plain, k=random.randint(30, 120))
        for _ in range(each if i % 4 == 0 else 0):
            text.insert(random.randrange(len(text)), random.choice(said))
        if quoted and i % 40 == 1:
            text.insert(3, random.choice(quoted))
        (toxic if i % 4 == 0 else ordinary).append(" ".join(text))
    model = toxicity.train(toxic[:225], ordinary[:675])
    compressors = [toxicity._compressor(one) for one in model.dictionaries]
    return [
        (model.scores(toxicity.features(texts, *compressors)) >= 0.5).mean()
        for texts in (toxic[225:], ordinary[675:])
    ]


def test_rarer_insults_are_learnt():
    """Each of 400 in one or two texts of 225."""
    random.seed(6)
    found, flagged = _accuracy(["".join(random.choices("bcdfghjkqwxz", k=9)) for _ in range(400)])
    assert found > 0.8 and flagged < 0.05


def test_insults_that_ordinary_texts_quote_are_learnt():
    rude = ["zwugrat", "fnorple", "blixxon", "quaxdrem"]
    found, flagged = _accuracy(rude, rude, each=5)
    assert found > 0.8 and flagged < 0.05


def test_phrases_of_ordinary_words_are_learnt():
    phrases = ["krana ldole mvisi", "spemo tranu kdola", "lvise mpemi srano", "tdolu kvisa lpeme"]
    found, flagged = _accuracy(phrases, each=5)
    assert found > 0.5 and flagged < 0.1


def test_overlong_texts_leave_the_sample_whole(spark):
    rows, labels = _corpus()
    truth = dict(labels)
    # The first of each label in the order of the sample, and one in between.
    long = [i for i in range(400) if i % 7 == 0]
    rows = [(i, " ".join([text] * 400) if i in long else text) for i, text in rows]
    frame = documents(spark, [*rows, (5, "another text of the same id"), rows[1], rows[1]])
    table = spark.createDataFrame([*labels, (10**9, 1), (10**9 + 1, 0)], "doc_id bigint, toxic int")
    sample, share = toxicity.sampled_texts(
        frame, table, fold("doc_id", 5) >= 0, id_col="doc_id", text_col="text", label_col="toxic",
        sample_rows=500, sample_chars=400_000,
    )
    toxic, ordinary = toxicity.by_label([tuple(row) for row in sample.collect()])
    assert len(toxic) == sum(truth.values()) + 1 and len(ordinary) == 400 - sum(truth.values())
    assert sum(map(len, toxic)) <= 201_000 and sum(map(len, ordinary)) <= 201_000
    whole = {text for i, text in rows if i not in long}
    assert whole <= {*toxic, *ordinary}
    assert share == sum(truth.values()) / 400
    model = toxicity.fit(frame, table, fold("doc_id", 5) != 0, sample_chars=400_000)
    found = toxicity.score(frame, model).filter("doc_id % 7 != 0").collect()
    assert sum(row.predicted != truth[row.doc_id] for row in found) <= 0.05 * len(found)


def test_one_text_beyond_the_bound(spark):
    frame = documents(spark, [(1, "zwug fnorp " * 3000), (2, "karan lodol " * 3000)])
    table = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    sample, _ = toxicity.sampled_texts(
        frame, table, fold("doc_id", 5) >= 0, id_col="doc_id", text_col="text", label_col="toxic",
        sample_rows=5, sample_chars=20_000,
    )
    toxic, ordinary = toxicity.by_label([tuple(row) for row in sample.collect()])
    assert "zwug" in toxic[0] and "lodol" in ordinary[0]
    assert 8_000 <= len(toxic[0]) <= 10_100


def test_score_against_a_plain_version(spark):
    """Every window compressed alone, twice, and the curve in plain numbers."""
    rows, labels = _corpus()
    frame = documents(spark, rows)
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(frame, table, fold("doc_id", 5) != 0)

    def plain_score(text):
        words = (text or "").encode().lower().split()
        found = [b" " + b" ".join(words[i : i + 8]) + b" " for i in range(0, len(words), 8)]
        found = [one[i : i + 512] for one in found for i in range(0, len(one), 512)]
        gains = []
        for window in found:
            lengths = [
                len(toxicity._compressor(content).compress(toxicity.ANCHOR + window))
                for content in model.dictionaries
            ]
            gains.append(lengths[0] - lengths[1])
        gains = gains or [0]
        above = [sum(gain >= t for gain in gains) for t in (2, 3, 4)]
        values = [math.log1p(count) for count in above]
        values += [max(gains), sum(gains) / len(gains), above[1] / len(gains), math.log1p(len(gains))]
        power = model.weights[-1] + sum(
            weight * (value - middle) / spread
            for weight, value, middle, spread in zip(model.weights, values, model.middle, model.spread)
        )
        return 1 / (1 + math.exp(-power))

    some = [*rows[:12], (1000, None), (1001, "  "), (1002, "x" * 2000 + " blixxon"), (1003, "Ä Blixxon")]
    for row in toxicity.score(documents(spark, some), model).collect():
        assert row.score == pytest.approx(plain_score(dict(some)[row.doc_id]), abs=1e-9)


def test_dictionaries_are_trained_on_texts_of_their_label():
    rows, labels = _corpus()
    truth = dict(labels)
    toxic = [text for i, text in rows if truth[i]]
    ordinary = [text for i, text in rows if not truth[i]]
    found = toxicity.toxic_windows(toxic, ordinary)
    for _, length, text in found:
        assert len(text.split()) == length and any(text in f" {one} ".encode() for one in toxic)
    assert {b" zwugrat ", b" fnorple ", b" blixxon "} <= {text for _, _, text in found}
    special = toxicity.toxic_dictionary(found, 3.3, 3.3)
    assert b"zwug" in special and b"zwug" not in toxicity.ordinary_dictionary(ordinary)
