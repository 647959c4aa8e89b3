import random

from renewlens.llm import common, quality
from tests.llm.helpers import documents, words


def repeats(text):
    found = words(text)
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    covered = {
        i + k for i, window in enumerate(windows) if windows.count(window) > 1 for k in range(5)
    }
    return len(covered)


def test_counts_against_plain_version(spark):
    random.seed(8)
    texts = ["", None, " \n\t", "one", "a b c d e a b c d e", "x " * 30, "l l\nl l\n\nl l", "#$ %&|<>*"]
    texts += [
        "".join(random.choice(["a ", "b ", "c\n", "d ", "#", "\x0b", "é "]) for _ in range(60))
        for _ in range(60)
    ]
    found = {
        row.doc_id: row
        for row in quality.judge(documents(spark, list(enumerate(texts))), sample_rows=20).collect()
    }
    for i, text in enumerate(texts):
        text = text or ""
        row, lines = found[i], [line for line in text.split("\n") if words(line)]
        assert row.n_words == len(words(text))
        assert row.word_chars == sum(map(len, words(text)))
        assert row.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert row.n_dup_lines == len(lines) - len(set(lines))
        assert row.n_repeat_words == repeats(text)
        assert row.base_failed == (row.n_words < 10 or 100 * repeats(text) > 20 * row.n_words)
        assert row.kept == (not row.base_failed and row.rejected_by is None)


def test_order_is_by_rejection_per_cost():
    from pyspark.sql import functions as F

    def rule(name):
        return quality.Rule(name, F.lit(True))

    measured = [
        quality.Measured(rule("dear"), 1.0, 0.9),
        quality.Measured(rule("cheap"), 0.01, 0.1),
        quality.Measured(rule("idle"), 0.01, 0.0),
    ]
    assert [one.name for one in quality.in_order(measured)] == ["cheap", "dear", "idle"]


def test_any_order_gives_the_same_verdict(spark):
    clean = "the quick brown fox jumps over the lazy dog near a quiet river bank"
    rows = [(1, clean), (2, clean.upper()), (3, "a! b! c! d! e! f! g! h! i! j!"), (4, None)]
    counted = quality.with_counts(documents(spark, rows))
    verdicts = [
        {
            row.doc_id: row.name is None
            for row in counted.select("doc_id", quality.verdict(order).alias("name")).collect()
        }
        for order in (quality.rules(), quality.rules()[::-1])
    ]
    assert verdicts[0] == verdicts[1]
    assert verdicts[0][1] and not verdicts[0][2] and not verdicts[0][3]


def test_empty_table(spark):
    assert quality.judge(documents(spark, [])).count() == 0


def test_labels_agree(spark, duck_medium):
    from renewlens.llm.queries import queries
    from tests.conftest import MEDIUM

    kept = {row.doc_id: row.kept for row in queries()["op4_quality_rules"](spark, MEDIUM).collect()}
    labels = duck_medium.execute("SELECT doc_id, quality FROM labels").fetchall()
    good = [kept[i] for i, label in labels if label]
    bad = [kept[i] for i, label in labels if not label]
    assert sum(good) / len(good) > 0.95
    assert sum(bad) / len(bad) < 0.1


def test_order_does_not_follow_the_clock(spark, medium_texts):
    sample = common.store(quality.with_counts(documents(spark, list(medium_texts.items()))), "order")
    orders = [
        [rule.name for rule in quality.in_order(quality.measure(sample, quality.rules()))] for _ in range(3)
    ]
    assert orders[0] == orders[1] == orders[2]
