import json
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from renewlens.llm import token_ids
from renewlens.llm.queries import TOKENIZER, queries
from renewlens.sources.storage import shared_folder
from tests.conftest import MEDIUM
from tests.llm.helpers import documents


def encode(text):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=40))
def test_codes_round_trip(ranks):
    array = np.array(ranks, dtype=np.uint32)
    control, data = token_ids.encode_ranks(array)
    assert len(control) == -(-len(ranks) // 4)
    assert len(data) == sum(max(1, (rank.bit_length() + 7) // 8) for rank in ranks)
    assert token_ids.decode_ranks(control, data, len(ranks)).tolist() == ranks


def test_words_give_the_ids_of_texts():
    letters = list("abcABC zZ  .,;:!?'’éÉèßÑıİΣσς́  \t\n\x0b\x0c\r\x1c\x85²Ⅷ٣漢字🙂#*0123-_") + [
        "<|endoftext|>", "'s", "'LL", "Ǆ", "ﬁ", "é"
    ]
    random.seed(3)
    texts = ["".join(random.choices(letters, k=random.randint(0, 40))) for _ in range(4000)]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    expected = [one.ids for one in tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder = token_ids._Encoder(TOKENIZER, "<u2")
    for _ in range(2):  # new words, then known ones
        counts, ids = encoder(pa.array(texts))
        assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == expected


def test_query_against_the_tokenizer(spark, medium_texts):
    rows = {row.doc_id: row for row in queries()["op8_token_ids"](spark, MEDIUM).collect()}
    assert len(rows) == len(medium_texts)
    start = 0
    for i in sorted(medium_texts):
        ids = encode(medium_texts[i])
        digest = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), digest)
        start += len(ids)


def test_odd_rows_and_whole_ids(spark, monkeypatch):
    monkeypatch.setattr(token_ids, "BLOCK_IDS", 50)
    rows = [(5, "b " * 400), (1, None), (None, "first"), (3, ""), (3, ""), (2, "a b"), (4, "é'll <|endoftext|>")]
    path = shared_folder(spark, "token-test")
    token_ids.write_files(documents(spark, rows), path, tokenizer=TOKENIZER)
    found = token_ids.read_files(spark, path).orderBy("start").collect()
    assert [row.doc_id for row in found] == [None, 1, 2, 3, 3, 4, 5]
    texts = {i: text for i, text in rows}
    start = 0
    for row in found:
        assert row.ids == encode(texts[row.doc_id])
        assert (row.start, row.n_tokens) == (start, len(row.ids))
        start += row.n_tokens
    assert token_ids.round_trip(documents(spark, []), tokenizer=TOKENIZER).count() == 0


def _changed(tmp_path, name, change):
    said = json.loads(Path(TOKENIZER).read_text())
    change(said)
    path = tmp_path / f"{name}.json"
    path.write_text(json.dumps(said))
    return str(path)


def _cased(said):
    said["normalizer"]["normalizers"] = said["normalizer"]["normalizers"][:2]


def _without_accents(said):
    said["normalizer"]["normalizers"] = [{"type": "NFD"}, {"type": "StripAccents"}, {"type": "Lowercase"}]


def _whole_words(said):
    said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\S+"


def _cut_short(said):
    said["truncation"] = {"max_length": 3, "strategy": "LongestFirst", "stride": 0, "direction": "Right"}


@pytest.fixture(scope="module")
def other_tokenizers(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tokenizers")
    made = {
        "cased": _changed(folder, "cased", _cased),
        "accents": _changed(folder, "accents", _without_accents),
        "whole": _changed(folder, "whole", _whole_words),
        "short": _changed(folder, "short", _cut_short),
        "bytes": public_tokenizers.path("byte_bpe_50k.json"),
    }
    plain = {name: Tokenizer.from_file(path) for name, path in made.items()}
    for tokenizer in plain.values():
        tokenizer.no_truncation()
    return {name: (path, plain[name], token_ids._Encoder(path, "<u4")) for name, path in made.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abC dÉé'sL9 \t\n.,!ﬁ🙂", max_size=30), max_size=5))
def test_other_tokenizers_give_their_own_ids(other_tokenizers, texts):
    for _, tokenizer, encoder in other_tokenizers.values():
        expected = [one.ids for one in tokenizer.encode_batch(texts, add_special_tokens=False)]
        counts, ids = encoder(pa.array(texts, pa.string()))
        assert counts.tolist() == [len(one) for one in expected]
        assert ids.tolist() == [i for one in expected for i in one]


def test_cased_tokenizer_through_the_files(spark, other_tokenizers):
    path, _, _ = other_tokenizers["cased"]
    rows = [(1, "Hello World"), (2, "hello world")]
    found = token_ids.round_trip(documents(spark, rows), tokenizer=path, digest=False).collect()
    tokenizer = Tokenizer.from_file(path)
    assert {row.doc_id: row.ids for row in found} == {
        i: [*tokenizer.encode(text, add_special_tokens=False).ids, 1] for i, text in rows
    }
    assert len(set(map(str, (row.ids for row in found)))) == 2


def test_text_ids(spark):
    frame = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, "x"), ("ä", None)], "doc_id string, text string")
    found = token_ids.round_trip(frame, tokenizer=TOKENIZER, digest=False)
    rows = sorted(found.collect(), key=lambda row: row.start)
    assert [row.doc_id for row in rows] == [None, "a", "b", "ä"]
    texts = {row.doc_id: row.text for row in frame.collect()}
    start = 0
    for row in rows:
        assert (row.start, row.ids) == (start, encode(texts[row.doc_id]))
        start += row.n_tokens


def test_rows_of_one_id_are_spread(spark, setting):
    """A third of the rows has no id, and all of these are copies."""
    setting(spark__sql__shuffle__partitions="8", spark__sql__adaptive__coalescePartitions__enabled="false")
    rows = [(None if i % 3 == 0 else i, "same" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    path = shared_folder(spark, "hot-ids")
    token_ids.write_files(documents(spark, rows), path, tokenizer=TOKENIZER)
    blocks = spark.read.parquet(f"{path}/blocks").collect()
    in_shard = Counter()
    for block in blocks:
        in_shard[block.shard] += len(block.doc_ids)
    assert len(in_shard) == 8 and max(in_shard.values()) < 700
    found = token_ids.read_files(spark, path).collect()
    assert len(found) == 3000 and sum(row.doc_id is None for row in found) == 1000
    start = 0
    for row in sorted(found, key=lambda row: row.start):
        assert row.start == start
        start += row.n_tokens
    placed = [row.doc_id for row in sorted(found, key=lambda row: row.start) if row.doc_id is not None]
    assert placed == sorted(placed)


def test_workers_take_few_rows_at_a_time_and_do_not_open_the_file_twice(spark, monkeypatch):
    """All workers of an executor share its memory: none gets 10,000 documents' ids in one batch."""
    key, asked, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", [], []
    before, known = spark.conf.get(key), token_ids._by_words
    rank_ids, export = token_ids.rank_ids, token_ids.export_parquet
    monkeypatch.setattr(token_ids, "_by_words", lambda path: asked.append(path) or known(path))
    monkeypatch.setattr(
        token_ids, "rank_ids", lambda *args: seen.append(int(spark.conf.get(key))) or rank_ids(*args)
    )

    def exported(df, path):
        if path.endswith("/blocks"):
            seen.append(int(spark.conf.get(key)))
        export(df, path)

    monkeypatch.setattr(token_ids, "export_parquet", exported)
    documents = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id bigint, text string")
    found = token_ids.round_trip(documents, tokenizer=TOKENIZER).collect()
    assert [row["doc_id"] for row in found] == [1, 2] and len(asked) == 1
    assert len(seen) == 2 and max(seen) <= 1_000
    assert spark.conf.get(key) == before


def test_a_small_memory_of_words_gives_the_ids_of_the_library(monkeypatch):
    """More words than are remembered, in texts that are longer than a slice."""
    monkeypatch.setattr(token_ids, "_CACHED_WORDS", 50)
    monkeypatch.setattr(token_ids, "_FORGET_AFTER", 2)
    encoder = token_ids._Encoder(TOKENIZER, "<u2", True)
    whole = Tokenizer.from_file(TOKENIZER)
    for start in range(0, 600, 60):
        texts = [" ".join(f"word{i} Été{i}." for i in range(start, start + 60)), "", "a b"]
        counts, ids = encoder(pa.array(texts))
        wanted = [whole.encode(text, add_special_tokens=False).ids for text in texts]
        assert counts.tolist() == [len(one) for one in wanted]
        assert ids.tolist() == [i for one in wanted for i in one]


class _Recorder:
    """Merges that note the pieces of the texts they get."""

    def __init__(self, merges):
        self.merges, self.pieces = merges, []

    def encode_batch_fast(self, texts, **said):
        for text in texts:
            self.pieces += text.split()
        return self.merges.encode_batch_fast(texts, **said)


def test_a_piece_of_many_words_is_merged_once():
    encoder = token_ids._Encoder(TOKENIZER, "<u2", True)
    encoder._merges = _Recorder(encoder._merges)
    texts = ["Spark, spark. SPARK!!", "spark?! Été, (été)", "été ÉTÉ. ... ,", " Straẞe Ⱥb. ⱥb"]
    whole = Tokenizer.from_file(TOKENIZER)
    wanted = [whole.encode(text, add_special_tokens=False).ids for text in texts]
    counts, ids = encoder(pa.array(texts))
    assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == wanted
    most = Counter(encoder._merges.pieces).most_common(1)
    assert most[0][1] == 1 and "spark" in encoder._merges.pieces


def test_python_does_not_take_words_of_ascii_one_by_one():
    encoder = token_ids._Encoder(TOKENIZER, "<u2", True)
    letters = "abcdefghijklmnopqrst"
    words = ["".join(letters[int(digit)] for digit in f"{i:05d}") for i in range(20_000)]
    texts = pa.array([" ".join(f"{word}{'.' * (i % 3)}" for i, word in enumerate(words))])
    calls = Counter()
    sys.setprofile(lambda frame, event, what: calls.update([event]))
    try:
        counts, ids = encoder(texts)
    finally:
        sys.setprofile(None)
    assert ids.tolist() == encode(texts[0].as_py())[:-1] and counts.tolist() == [len(ids)]
    assert calls["call"] + calls["c_call"] < len(words) / 4


def test_letters_of_all_scripts_give_the_ids_of_the_library():
    letters = [chr(i) for i in range(0x110000) if chr(i).isalpha()]
    texts = [
        " ".join(f"{letter} a{letter}B {letter}{letter}.," for letter in letters[i : i + 50])
        for i in range(0, len(letters), 50)
    ]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    encoder = token_ids._Encoder(TOKENIZER, "<u2", True)
    for begin in range(0, len(texts), 100):
        part = texts[begin : begin + 100]
        expected = [one.ids for one in tokenizer.encode_batch(part, add_special_tokens=False)]
        counts, ids = encoder(pa.array(part))
        found = [one.tolist() for one in np.split(ids, np.cumsum(counts)[:-1])]
        assert found == expected, [a for a, b, c in zip(part, found, expected) if b != c][:1]
