"""Token ids in files: frequency-ranked, byte-aligned variable length, separate control bytes.

Ids are ranked by how often the corpus uses them and each rank is written in one to four bytes.
A control byte holds the lengths of four ranks, apart from the data bytes. Reading looks the
lengths up in a table of 256 rows and gathers all ranks of a block with numpy.

The files are a Parquet container, so any store that Spark reaches holds them and Spark's commit
replaces the output of lost tasks. A row is a block of whole documents:

    shard, block     position of the block; shards and blocks ascend with doc_id
    first            ids of the shard before the block
    doc_ids, counts  documents of the block and the number of ids of each
    control, data    the coded ranks

A second folder beside it lists the id of every rank.
"""

from __future__ import annotations

import codecs
import json
import os
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from renewlens.llm.common import SPACES, few_at_a_time, small, store, text_of, tidy
from renewlens.sources.storage import export_parquet, shared_folder

BLOCK_IDS = 1 << 18
# Every worker of an executor holds these at once, so they are small.
_CACHED_WORDS = 100_000
_FORGET_AFTER = 96
_JOINED = 256  # pieces in a text
_AT_ONCE = 8  # such texts in a call
_CACHED_BYTES = 48
_SLICE_BYTES = 1 << 20
# Fixed value: ASCII punctuation but the apostrophe, a run of which is one piece.
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Fixed value: letters whose lower case depends on the library or on neighbours.
_CONTEXT_LOWER = ("\u03a3", "\u0130")
# What a tokenizer file says of how texts become words, where words can be encoded
# one by one and taken apart without the library.
_WORD_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
_WORD_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {
                "Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            },
            "behavior": "Removed",
            "invert": True,
        },
        {
            "type": "ByteLevel",
            "add_prefix_space": False,
            "trim_offsets": True,
            "use_regex": False,
        },
    ],
}

_BLOCKS = (
    "shard int, block int, first bigint, doc_ids array<{kind}>, counts array<bigint>, "
    "control binary, data binary"
)
# Lengths of the four ranks that a control byte describes.
_LENGTHS = (
    (np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3
) + np.uint8(1)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit ranks."""
    ranks = ranks.astype("<u4")
    highest = int(ranks.max(initial=0))
    codes = (ranks > 0xFF).astype(np.uint8)
    for limit in (0xFFFF, 0xFFFFFF):
        if highest > limit:
            codes += ranks > limit
    padded = np.zeros(-(-len(codes) // 4) * 4, dtype=np.uint8)
    padded[: len(codes)] = codes
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    if highest > 0xFFFF:
        raw = ranks.view(np.uint8)
    else:
        raw = ranks.astype("<u2").view(np.uint8)
    used = np.ones((len(ranks), 4 if highest > 0xFFFF else 2), dtype=bool)
    for extra in range(1, used.shape[1]):
        np.greater_equal(codes, extra, out=used[:, extra])
    return control.tobytes(), raw[used.reshape(-1)].tobytes()


def decode_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:count]
    ends = np.cumsum(lengths, dtype=np.int64)
    starts = ends - lengths
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    ranks = raw[starts].astype(np.uint32)
    for extra in range(1, int(lengths.max(initial=0))):
        longer = np.flatnonzero(lengths > extra)
        ranks[longer] |= raw[starts[longer] + extra].astype(np.uint32) << np.uint32(8 * extra)
    return ranks


def _byte_alphabet() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in plain]
    return {byte: chr(byte) for byte in plain} | {
        byte: chr(256 + i) for i, byte in enumerate(others)
    }


# Every byte's character, but a space stays one.
_SPACED_ALPHABET = "".join(_byte_alphabet()[byte] for byte in range(256)).replace(
    _byte_alphabet()[ord(" ")], " "
)


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each string ends, and the bytes of all in a row."""
    _, offsets, raw = strings.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[strings.offset :][: len(strings) + 1]
    begin, upto = int(offsets[0]), int(offsets[-1])
    return offsets[1:].astype(np.int64) - begin, np.frombuffer(raw, dtype=np.uint8)[begin:upto]


def _in_a_row(
    which: np.ndarray, bounds: np.ndarray, ids: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ids of the words ``which``, and those ids; word i has ids[bounds[i]:bounds[i + 1]]."""
    begins = bounds[which]
    sizes = bounds[which + 1] - begins
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    # Narrow numbers where they do: these are the longest arrays.
    place = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
    at = np.repeat((begins - (ends - sizes)).astype(place), sizes)
    at += np.arange(total, dtype=place)
    return sizes, ids[at]


def _by_words(path: str) -> bool:
    """Whether a tokenizer file says exactly what ``_Encoder`` does with words by itself."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    model = said["model"]
    return (
        said["normalizer"] == _WORD_NORMALIZER
        and said["pre_tokenizer"] == _WORD_SPLITTER
        and model["type"] == "BPE"
        and bool(model.get("end_of_word_suffix"))
        and not any(model.get(name) for name in ("dropout", "unk_token", "continuing_subword_prefix"))
        and not any(
            set(token["content"]) & set(SPACES) or token["lstrip"] or token["rstrip"]
            or token["normalized"] or token["single_word"]
            for token in said["added_tokens"]
        )
    )


class _Encoder:
    """Ids of texts, with a bounded memory of words where the tokenizer allows it.

    A tokenizer of the one kind that this class knows (``_by_words``) never looks past ASCII white
    space, so the ids of a text are those of its words in a row; with any other, the library
    encodes every text as it is. Arrow splits a slice of texts and numbers its distinct words, and only words that are not
    known yet are tokenized. Most of them are letters with punctuation at the end. Such pieces
    need no normalising and splitting, which is the dear part: those of many words are joined by
    spaces and go through the vocabulary's merges at once, and the id that ends a piece shows where
    the next begins. All other words are encoded one by one.
    """

    def __init__(self, path: str, dtype: str, words: bool | None = None) -> None:
        """``words``: what ``_by_words`` says of the file, if that is known."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._dtype = np.dtype(dtype)
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._merges = None
        self._words = _by_words(path) if words is None else words
        if self._words:
            suffix = self._tokenizer.model.end_of_word_suffix
            # The same model, which both share, for pieces that are split already.
            self._merges = Tokenizer(self._tokenizer.model)
            self._merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocabulary = self._tokenizer.get_vocab()
            self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self._ends[[one for word, one in vocabulary.items() if word.endswith(suffix)]] = True
        # Frequent words come early; when full it stays as it is until many words were unknown.
        self._forget()

    def _forget(self) -> None:
        self._known = pa.array([], pa.string())
        self._bounds = np.zeros(1, dtype=np.int64)
        self._ids = np.zeros(0, dtype=self._dtype)
        self._unknown = 0

    def _easy(self, words: pa.Array, letters: pa.Array) -> np.ndarray:
        """Which words are ``letters`` and then punctuation, either of which may be missing."""
        easy = np.asarray(
            pc.or_(
                pc.ascii_is_alpha(letters),
                pc.and_(pc.equal(letters, ""), pc.not_equal(words, "")),
            )
        ).copy()
        others = pc.invert(pc.string_is_ascii(letters))
        easy[np.asarray(others)] = [
            word.isalpha()
            and unicodedata.is_normalized("NFC", word)
            and _CONTEXT_LOWER[0] not in word
            and _CONTEXT_LOWER[1] not in word
            for word in letters.filter(others).to_pylist()
        ]
        return easy

    def _merge(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """Numbers of ids of pieces, each of which ends with a space, and the ids of all in a row."""
        ends, text = _bytes_of(pieces)
        begins = np.append(0, ends[:-1])[::_JOINED].tolist()
        uptos = [*begins[1:], int(ends[-1])]
        raw = text.tobytes()
        joined = [
            codecs.charmap_decode(raw[begin:upto], "strict", _SPACED_ALPHABET)[0]
            for begin, upto in zip(begins, uptos, strict=True)
        ]
        found = []
        for i in range(0, len(joined), _AT_ONCE):
            encoded = self._merges.encode_batch_fast(
                joined[i : i + _AT_ONCE], add_special_tokens=False
            )
            found += [np.array(one.ids, dtype=self._dtype) for one in encoded]
        ids = np.concatenate(found)
        last = np.flatnonzero(self._ends[ids]) + 1
        return (np.diff(last, prepend=0), ids) if len(last) == len(pieces) else None

    def _tokenize_easy(self, words: pa.Array, letters: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        ends, raw = _bytes_of(words)
        sizes = np.asarray(pc.binary_length(words), dtype=np.int64)
        letter_sizes = np.asarray(pc.binary_length(letters), dtype=np.int64)
        both = (letter_sizes > 0) & (letter_sizes < sizes)
        cuts = np.sort(np.concatenate([ends, (ends - sizes + letter_sizes)[both]]))
        text = np.insert(raw, cuts, ord(" ")).tobytes().decode().lower().encode()
        # Words in lower case may have other lengths.
        after = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == ord(" ")) + 1
        offsets = np.append(0, after).astype(np.int32)
        pieces = pa.StringArray.from_buffers(
            len(after), pa.py_buffer(offsets.tobytes()), pa.py_buffer(text)
        ).dictionary_encode()
        merged = self._merge(pieces.dictionary)
        if merged is None:
            return None
        counts, ids = merged
        counts, ids = _in_a_row(np.asarray(pieces.indices), np.append(0, np.cumsum(counts)), ids)
        return np.add.reduceat(counts, np.cumsum(1 + both) - 1 - both), ids

    def _tokenize(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of the words, and the ids of all in a row."""
        letters = pc.ascii_rtrim(words, characters=_PUNCTUATION)
        easy = self._easy(words, letters)
        counts = np.zeros(len(words), dtype=np.int64)
        ids = np.zeros(0, dtype=self._dtype)
        if easy.any():
            chosen = pa.array(easy)
            found = self._tokenize_easy(words.filter(chosen), letters.filter(chosen))
            if found is None:
                easy[:] = False
            else:
                counts[easy], ids = found
        if not easy.all():
            encoded = self._tokenizer.encode_batch_fast(
                words.filter(pa.array(~easy)).to_pylist(), add_special_tokens=False
            )
            counts[~easy] = [len(one.ids) for one in encoded]
            # Back into the order of the words.
            whole = np.empty(int(counts.sum()), dtype=self._dtype)
            from_easy = np.repeat(easy, counts)
            whole[~from_easy] = [i for one in encoded for i in one.ids]
            whole[from_easy] = ids
            ids = whole
        return counts, ids

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and the ids of all in a row."""
        if not self._words:
            encoded = self._tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            ids = [np.array(one.ids, dtype=self._dtype) for one in encoded]
            counts = np.array([len(one) for one in ids], dtype=np.int64)
            return counts, np.concatenate([*ids, np.zeros(0, dtype=self._dtype)])
        if self._unknown > _FORGET_AFTER * _CACHED_WORDS:
            self._forget()
        split = pc.ascii_split_whitespace(texts)
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary
        known = pc.index_in(words, value_set=self._known)
        new = words.filter(known.is_null())
        counts, ids = self._tokenize(new)
        all_ids = np.concatenate([self._ids, ids])
        bounds = np.concatenate([self._bounds, self._bounds[-1] + np.cumsum(counts)])
        row = np.asarray(known.fill_null(-1)).copy()
        row[row < 0] = len(self._known) + np.arange(len(new))
        if len(self._known) < _CACHED_WORDS:
            # A word found twice in a slice is likely to come again.
            found = np.bincount(np.asarray(numbered.indices), minlength=len(words))
            short = np.asarray(pc.less_equal(pc.binary_length(new), _CACHED_BYTES))
            short = short & (found[np.asarray(known.is_null())] > 1)
            self._known = pa.concat_arrays([self._known, new.filter(pa.array(short))])
            self._ids = np.concatenate([self._ids, ids[np.repeat(short, counts)]])
            self._bounds = np.append(0, np.cumsum(np.append(np.diff(self._bounds), counts[short])))
        else:
            self._unknown += len(new)

        sizes, flat = _in_a_row(row[np.asarray(numbered.indices)], bounds, all_ids)
        offsets = np.asarray(split.offsets, dtype=np.int64)
        upto = np.append(0, np.cumsum(sizes))[offsets - offsets[0]]
        return np.diff(upto), flat


# The encoder of the last job; a Python worker keeps it from task to task. Only functions of the
# module itself reach this: what is nested gets a copy of its own with every task.
_ENCODERS: dict[str, _Encoder] = {}


def _encoder(job: str, path: str, dtype: str, words: bool) -> _Encoder:
    if job not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[job] = _Encoder(path, dtype, words)
    return _ENCODERS[job]


def _drop_encoders() -> None:
    _ENCODERS.clear()


def _encode_documents(path: str, end_id: int, dtype: str) -> Callable:
    # Asked once, on the driver: the file as Python objects is larger than a task's texts.
    words, job = _by_words(path), uuid.uuid4().hex

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(job, path, dtype, words)
        for batch in batches:
            rows = max(1, batch.num_rows * _SLICE_BYTES // max(batch.nbytes, 1))
            for begin in range(0, batch.num_rows, rows):
                part = batch.slice(begin, rows)
                counts, ids = encode(part.column(1))
                ends = np.cumsum(counts + 1)
                whole = np.full(len(ids) + len(counts), end_id, dtype=dtype)
                inner = np.ones(len(whole), dtype=bool)
                inner[ends - 1] = False
                whole[inner] = ids
                offsets = np.append(0, ends * whole.itemsize).astype(np.int32)
                binary = pa.Array.from_buffers(
                    pa.binary(),
                    len(counts),
                    [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(whole.tobytes())],
                )
                yield pa.RecordBatch.from_arrays([part.column(0), binary], names=["doc_id", "ids"])

    return run


def _count_ids(dtype: str) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_encoders()
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=dtype)
            counts = np.bincount(ids, minlength=len(total))
            counts[: len(total)] += total
            total = counts
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"]
        )

    return run


def rank_ids(tokens: DataFrame, dtype: str) -> np.ndarray:
    """Ids by falling frequency, ties by id. Their number is bounded by the vocabulary."""
    counted = tokens.select("ids").mapInArrow(_count_ids(dtype), "id bigint, n bigint")
    rows = counted.groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect()
    return np.array([row["id"] for row in rows], dtype=np.uint32)


def _write_blocks(ids_by_rank: np.ndarray, dtype: str) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = np.zeros(int(ids_by_rank.max(initial=0)) + 1, dtype=np.uint32)
        rank_of[ids_by_rank] = np.arange(len(ids_by_rank), dtype=np.uint32)
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        documents: list = []
        pieces: list[np.ndarray] = []

        kind: pa.DataType = pa.int64()

        def flush() -> pa.RecordBatch:
            nonlocal block, first
            control, data = encode_ranks(rank_of[np.concatenate(pieces)])
            counts = [len(piece) for piece in pieces]
            columns = {
                "shard": pa.array([shard], pa.int32()),
                "block": pa.array([block], pa.int32()),
                "first": pa.array([first], pa.int64()),
                "doc_ids": pa.array([documents], pa.list_(kind)),
                "counts": pa.array([counts], pa.list_(pa.int64())),
                "control": pa.array([control], pa.binary()),
                "data": pa.array([data], pa.binary()),
            }
            block, first = block + 1, first + sum(counts)
            documents.clear()
            pieces.clear()
            return pa.RecordBatch.from_pydict(columns)

        held = 0
        for batch in batches:
            kind = batch.schema[0].type
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                documents.append(doc_id)
                pieces.append(np.frombuffer(ids.as_py(), dtype=dtype))
                held += len(pieces[-1])
                if held >= BLOCK_IDS:
                    yield flush()
                    held = 0
        if pieces:
            yield flush()

    return run


def _narrowest(tokenizer: str, end_id: int) -> str:
    """Two bytes hold an id if the vocabulary allows, else four."""
    from tokenizers import Tokenizer

    most = max(end_id, *Tokenizer.from_file(tokenizer).get_vocab().values())
    return "<u2" if most < 1 << 16 else "<u4"


def write_files(
    documents: DataFrame,
    path: str,
    *,
    tokenizer: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Tokenize every whole text, append ``end_id`` and write all ids in ascending id order.

    A null text has the end id alone; a null id comes first; rows with the same id follow each
    other, in an order of their token ids. Ids of documents keep their type, numbers or text. A very
    long text is encoded whole and stays in one block. An empty table gives files without blocks.
    Other columns are not read. ``tokenizer`` is a file that every machine can open.
    """
    texts = documents.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    dtype = _narrowest(tokenizer, end_id)
    tokens = store(
        texts.mapInArrow(_encode_documents(tokenizer, end_id, dtype), f"doc_id {kind}, ids binary"),
        "token-ids",
        compression="zstd",
    )
    with few_at_a_time(documents.sparkSession):
        ids_by_rank = rank_ids(tokens, dtype)
    # An id may hold a third of all rows, and those may be copies: digest and row part them.
    order = ["doc_id", "digest", "row"]
    ordered = (
        tokens.withColumns({"digest": F.xxhash64("ids"), "row": F.monotonically_increasing_id()})
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "ids")
    )
    schema = _BLOCKS.format(kind=kind)
    with few_at_a_time(documents.sparkSession):
        blocks = ordered.mapInArrow(_write_blocks(ids_by_rank, dtype), schema)
        export_parquet(blocks, f"{path}/blocks")
    ranks = documents.sparkSession.createDataFrame(
        [(rank, int(one)) for rank, one in enumerate(ids_by_rank)], "rank int, id bigint"
    )
    export_parquet(ranks.coalesce(1), f"{path}/ranks")


def _read_blocks(ids_by_rank: np.ndarray, digest: bool) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = batch.slice(row, 1)
                start, docs, counts, control, data = (
                    column[0].as_py() for column in block.columns
                )
                counts = np.array(counts, dtype=np.int64)
                total = int(counts.sum())
                ids = ids_by_rank[decode_ranks(control, data, total)].astype("<u4")
                ends = np.cumsum(counts)
                begins = ends - counts
                if digest:
                    values = pa.array(
                        [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends, strict=True)],
                        pa.int64(),
                    )
                else:
                    offsets = pa.array(np.append(0, ends), pa.int32())
                    values = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, block.schema.field("doc_ids").type.value_type),
                        pa.array(start + begins, pa.int64()),
                        pa.array(counts, pa.int64()),
                        values,
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    return run


def read_files(spark: SparkSession, path: str, *, digest: bool = False) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, and its ids.

    With ``digest`` the ids are replaced by ids_crc32, the crc32 of them as little-endian 32-bit
    integers. The start of a shard is a running sum over one row per shard.
    """
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    ids_by_rank = np.array([row["id"] for row in ranks], dtype=np.uint32)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    in_block = F.aggregate("counts", F.lit(0).cast("bigint"), lambda total, n: total + n)
    shards = blocks.groupBy("shard").agg(F.sum(in_block).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select(
        F.col("shard").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start")
    )
    placed = blocks.join(small(starts), F.col("shard") == F.col("of")).select(
        (F.col("shard_start") + F.col("first")).alias("start"), "doc_ids", "counts", "control", "data"
    )
    last = "ids_crc32 bigint" if digest else "ids array<bigint>"
    return placed.mapInArrow(
        _read_blocks(ids_by_rank, digest), f"doc_id {kind}, start bigint, n_tokens bigint, {last}"
    )


def round_trip(
    documents: DataFrame, *, tokenizer: str, end_id: int = 1, digest: bool = True
) -> DataFrame:
    """Write files to the shared folder and read them back."""
    path = shared_folder(documents.sparkSession, "token-files")
    write_files(documents, path, tokenizer=tokenizer, end_id=end_id)
    return read_files(documents.sparkSession, path, digest=digest)
