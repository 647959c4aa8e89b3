"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary texts and one on windows of
toxic ones. The toxic texts are mostly made of ordinary words too, and a dictionary of all their
windows compresses every text alike; so the windows it is trained on are those of one to three
words that toxic texts say at a higher rate than ordinary ones, each as often as it occurs times its
evidence. A text is read in windows of eight words, each compressed twice: with the ordinary
dictionary, and with the same one and the toxic dictionary behind it, so that the two differ by
nothing but what the toxic texts taught. A window that is shorter with the latter speaks like them.
Counts of such windows beyond several thresholds, the greatest and the mean difference become a
probability by a logistic curve, calibrated on texts that the dictionaries had not seen. How much
evidence a window needs for training is one of a few values, the one whose curve fits these best.

Dictionaries and curve come from a bounded sample of labelled texts (``sample_rows`` of each label,
``sample_chars`` in all); scoring covers every whole text, and looks at nothing but the text.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from renewlens.llm.common import text_of, tidy

WORDS = 8
LONGEST_WINDOW = 512
ORDINARY_BYTES = 32_768
RUN_WORDS = (1, 2, 3)
# Signed root of the likelihood ratio that a run needs to be a training window: of one word, and of
# more. Many long runs are beyond a low bound by chance. The bounds with the best curve are taken.
BOUNDS = ((2.2, 3.3), (3.3, 3.3), (4.5, 4.5))
# What a trained dictionary has besides its content.
_HEADER_BYTES = 1_024
THRESHOLDS = (2, 3, 4)
# Both dictionaries end with this and every window begins with it. The match keeps a window from
# being stored as it is, as zstandard does when it would save less than two bytes.
ANCHOR = bytes(range(1, 9)) * 5
_PARTS = 4
_PIECE_CHARS = 1_024
_SLICE_BYTES = 2 << 20


@dataclass(frozen=True)
class Model:
    """Raw contents of the ordinary dictionary and of both together, and the curve; no
    dictionaries: a constant score."""

    dictionaries: tuple[bytes, ...]
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # the last is the intercept

    def scores(self, features: np.ndarray) -> np.ndarray:
        scaled = (features - self.middle) / self.spread
        return 1 / (1 + np.exp(-(scaled @ self.weights[:-1] + self.weights[-1])))


def windows(text: str) -> list[bytes]:
    """The words of a text, A-Z folded, eight at a time; very long runs are cut by size."""
    words = text.encode().lower().split()
    joined = [
        b" " + b" ".join(words[i : i + WORDS]) + b" " for i in range(0, len(words), WORDS)
    ]
    if all(len(one) <= LONGEST_WINDOW for one in joined):
        return joined
    return [
        one[i : i + LONGEST_WINDOW] for one in joined for i in range(0, len(one), LONGEST_WINDOW)
    ]


def _numbered(texts: list[str], known: dict[bytes, int]) -> np.ndarray:
    """The words of all texts as numbers from 1, with 0 around each text."""
    numbers = [0]
    for text in texts:
        numbers.extend(known.setdefault(word, len(known) + 1) for word in text.encode().lower().split())
        numbers.append(0)
    return np.array(numbers, dtype=np.uint64)


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    mixed = np.full(len(columns[0]), len(columns), np.uint64)
    for column in columns:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return mixed


def _runs(numbers: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Hash and place of every run of words; the distinct hashes and in how many contexts each is.

    A context is the pair of neighbours, so that copies of a text do not lift their words.
    """
    count = max(len(numbers) - length - 1, 0)
    columns = [numbers[k : k + count] for k in range(length + 2)]
    whole = np.logical_and.reduce([column != 0 for column in columns[1:-1]])
    hashes = _mixed(columns[1:-1])[whole]
    _, first = np.unique(_mixed(columns)[whole], return_index=True)
    return hashes, np.flatnonzero(whole) + 1, *np.unique(hashes[first], return_counts=True)


def _evidence(toxic: np.ndarray, ordinary: np.ndarray, share: float) -> np.ndarray:
    """Signed root of the likelihood ratio that a run's rate among the toxic is above ``share``."""
    both = toxic + ordinary
    ratio = toxic * np.log(toxic / (both * share))
    ratio += ordinary * np.log(np.maximum(ordinary, 1) / (both * (1 - share)))
    return np.where(toxic > both * share, np.sqrt(2 * np.maximum(ratio, 0)), 0)


def toxic_windows(toxic: list[str], ordinary: list[str]) -> list[tuple[float, int, bytes]]:
    """Evidence, words and text of the windows that toxic texts say at a higher rate.

    Every place where one stands is listed; of overlapping ones, that with more evidence. Ordinary
    texts may use them too, at a lower rate.
    """
    known: dict[bytes, int] = {}
    numbers, others = _numbered(toxic, known), _numbered(ordinary, known)
    words, found = list(known), []
    for length in RUN_WORDS:
        hashes, places, distinct, times = _runs(numbers, length)
        _, _, other, other_times = _runs(others, length)
        if not len(distinct) or not len(other):
            continue
        at = np.minimum(np.searchsorted(other, distinct), len(other) - 1)
        shared = np.where(other[at] == distinct, other_times[at], 0)
        share = times.sum() / (times.sum() + other_times.sum())
        evidence = _evidence(times, shared, share)[np.searchsorted(distinct, hashes)]
        least = min(word if length == 1 else run for word, run in BOUNDS)
        found += [(evidence[i], length, int(places[i])) for i in np.flatnonzero(evidence >= least)]
    taken, chosen = np.zeros(len(numbers), dtype=bool), []
    for evidence, length, place in sorted(found, key=lambda one: (-one[0], one[1], one[2])):
        if not taken[place : place + length].any():
            taken[place : place + length] = True
            run = b" ".join(words[int(word) - 1] for word in numbers[place : place + length])
            chosen.append((float(evidence), length, b" " + run + b" "))
    return chosen


def _train(size: int, samples: list[bytes], segment: int) -> bytes:
    """Content of a trained dictionary; of too few samples, the samples themselves."""
    try:
        return zstandard.train_dictionary(
            size, samples, k=segment, d=6, f=20, accel=2, split_point=1.0
        ).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))


def ordinary_dictionary(ordinary: list[str]) -> bytes:
    return _train(ORDINARY_BYTES, [window for text in ordinary for window in windows(text)], 50)


def toxic_dictionary(
    found: list[tuple[float, int, bytes]], least_word: float, least_run: float
) -> bytes:
    """Trained on the windows with that much evidence, each as often as its evidence says.

    There is room for all that differ.
    """
    samples = [
        text
        for evidence, length, text in found
        if evidence >= (least_word if length == 1 else least_run)
        for _ in range(int(evidence))
    ]
    order = np.random.default_rng(11).permutation(len(samples))
    size = sum(map(len, set(samples))) + _HEADER_BYTES
    return _train(size, [samples[i] for i in order], 12)


def _contents(base: bytes, special: bytes) -> tuple[bytes, bytes]:
    """What the two compressors know: places are the same, and the nearest cost least."""
    return base + bytes(len(special)) + ANCHOR, base + special + ANCHOR


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    # Large enough that every place of the dictionary is found.
    log = max(17, len(content).bit_length())
    settings = zstandard.ZstdCompressionParameters.from_level(
        3,
        window_log=log + 1,
        strategy=zstandard.STRATEGY_BTULTRA,
        min_match=3,
        search_log=8,
        hash_log=log,
        chain_log=log,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=0,
        write_checksum=0,
        write_dict_id=0,
    )
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)


def _lengths(compressor: zstandard.ZstdCompressor, pieces: list[bytes]) -> np.ndarray:
    found = compressor.multi_compress_to_buffer([ANCHOR + one for one in pieces], threads=1)
    return np.fromiter((len(one) for one in found), np.int64, len(pieces))


def features(texts: list[str], ordinary, toxic) -> np.ndarray:
    """One row per text; a text without words counts as one window without a difference."""
    pieces = [windows(text) for text in texts]
    flat = [window for one in pieces for window in one]
    sizes = np.array([len(one) for one in pieces])
    ends, empty = np.cumsum(sizes), sizes == 0
    sizes = np.maximum(sizes, 1)
    begins = np.cumsum(sizes) - sizes
    gain = np.zeros(0, dtype=np.int64)
    if flat:
        gain = _lengths(ordinary, flat) - _lengths(toxic, flat)
    gain = np.insert(gain, ends[empty], 0)
    above = [np.add.reduceat((gain >= t).astype(np.int64), begins) for t in THRESHOLDS]
    columns = [
        *[np.log1p(count) for count in above],
        np.maximum.reduceat(gain, begins),
        np.add.reduceat(gain, begins) / sizes,
        above[1] / sizes,
        np.log1p(sizes),
    ]
    return np.stack(columns, axis=1).astype(np.float64)


def _curve(
    rows: np.ndarray, labels: np.ndarray, share: float
) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Logistic regression by Newton's method with a little shrinkage; its loss comes first.

    Texts are weighed so that label 1 has its ``share`` of all labelled texts, not of the sample.
    """
    weight = np.where(labels == 1, share / labels.mean(), (1 - share) / (1 - labels.mean()))
    middle, spread = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    scaled = np.c_[(rows - middle) / spread, np.ones(len(rows))]
    weights = np.zeros(scaled.shape[1])
    for _ in range(50):
        now = 1 / (1 + np.exp(-scaled @ weights))
        slope = scaled.T @ (weight * (now - labels)) + 0.1 * weights
        bend = (scaled * (weight * now * (1 - now))[:, None]).T @ scaled
        bend += 0.1 * np.eye(len(weights))
        weights -= np.linalg.solve(bend, slope)
    sure = np.clip(1 / (1 + np.exp(-scaled @ weights)), 1e-9, 1 - 1e-9)
    loss = -(weight * np.where(labels == 1, np.log(sure), np.log(1 - sure))).sum()
    return loss, (middle, spread, weights)


def _split(texts: list[str], part: int) -> tuple[list[str], list[str]]:
    """Texts to train on and the part that is left out; of a single text, that text as both."""
    return [one for i, one in enumerate(texts) if i % _PARTS != part] or texts, texts[part::_PARTS]


def train(toxic: list[str], ordinary: list[str], share: float | None = None) -> Model:
    """Dictionaries of all texts given; the curve from parts that its dictionaries had not seen.

    ``share`` is that of label 1 among all labelled texts, if these are a sample of them.
    """
    if not toxic or not ordinary:
        share = (len(toxic) + 0.5) / (len(toxic) + len(ordinary) + 1)
        count = len(THRESHOLDS) + 4
        weights = np.append(np.zeros(count), np.log(share / (1 - share)))
        return Model((), np.zeros(count), np.ones(count), weights)
    rows, labels = {bounds: [] for bounds in BOUNDS}, []
    for part in range(_PARTS):
        fit, left = _split(toxic, part)
        fit_ordinary, left_ordinary = _split(ordinary, part)
        base, found = ordinary_dictionary(fit_ordinary), toxic_windows(fit, fit_ordinary)
        for bounds in BOUNDS:
            special = toxic_dictionary(found, *bounds)
            compressors = [_compressor(one) for one in _contents(base, special)]
            rows[bounds] += [features(texts, *compressors) for texts in (left, left_ordinary) if texts]
        labels += [np.full(len(texts), label) for label, texts in ((1, left), (0, left_ordinary))]
    known = np.concatenate(labels)
    curves = {
        bounds: _curve(np.concatenate(found), known, known.mean() if share is None else share)
        for bounds, found in rows.items()
    }
    best = min(BOUNDS, key=lambda bounds: curves[bounds][0])
    special = toxic_dictionary(toxic_windows(toxic, ordinary), *best)
    return Model(_contents(ordinary_dictionary(ordinary), special), *curves[best][1])


def sampled_texts(
    documents: DataFrame,
    labels: DataFrame,
    training: Column,
    *,
    id_col: str,
    text_col: str,
    label_col: str,
    sample_rows: int,
    sample_chars: int,
) -> tuple[DataFrame, float | None]:
    """Labelled texts (``label``, ``place``, ``text``) as far as the bounds go.

    Second comes the share of 1 among all labels of documents. The ids are chosen among these labels
    first, so that no other text is shuffled. Where the texts are too long together, the longest
    give pieces chosen by hash, so every text has its part and no label is left without one.
    """
    ids = documents.select(F.col(id_col).alias("sample_id")).distinct()
    marked = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & training)
        .groupBy(F.col(id_col).alias("sample_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .join(ids, "sample_id", "left_semi")
        .withColumn("place", F.xxhash64("sample_id"))
    )
    chosen = [
        marked.filter(F.col("label") == label).orderBy("place", "sample_id").limit(sample_rows)
        for label in (1, 0)
    ]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most twice sample_rows ids
    found = documents.select(
        F.col(id_col).alias("sample_id"), text_of(text_col).alias("text")
    ).join(few, "sample_id")
    # Where ids repeat, every id has its first text before any has its second.
    digest = F.xxhash64("text")
    same_id = Window.partitionBy("label", "sample_id").orderBy("digest")
    by_label = Window.partitionBy("label").orderBy("nth", "place", "sample_id")
    rows = (
        found.select(
            "sample_id", "label", "place", digest.alias("digest"), F.length("text").alias("size")
        )
        .distinct()
        .withColumn("nth", F.row_number().over(same_id))
        .withColumn("number", F.row_number().over(by_label))
        .filter(F.col("number") <= sample_rows)
        .collect()
    )
    most = {
        label: _most_chars([row["size"] for row in rows if row["label"] == label], sample_chars // 2)
        for label in (1, 0)
    }
    kind = found.schema["sample_id"].dataType.simpleString()
    wanted = documents.sparkSession.createDataFrame(
        [(row["sample_id"], row["digest"], most[row["label"]]) for row in rows],
        f"sample_id {kind}, digest bigint, most bigint",
    )
    texts = (
        found.withColumn("digest", digest)
        .join(F.broadcast(wanted), ["sample_id", "digest"])
        .withColumn("text", _pieces(F.col("text"), F.col("most")))
        .dropDuplicates(["sample_id", "digest"])
    )
    share = marked.agg(F.avg(F.col("label").cast("double"))).first()[0]
    return texts.select("label", "place", "text"), share


def by_label(rows: list[tuple[int, int, str]]) -> tuple[list[str], list[str]]:
    """Texts labelled 1 and 0 of a sample, in the order of the hash of their ids."""
    ordered = sorted(rows, key=lambda row: (row[1], row[2]))
    return tuple([text for one, _, text in ordered if one == label] for label in (1, 0))


def _train_sample(share: float | None) -> Callable:
    """Trains on all rows of a task, which hold the whole sample, and returns the model."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns))]
        model = train(*by_label(rows), share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return run


def _most_chars(sizes: list[int], bound: int) -> int:
    """Characters of each text, so that all together keep to ``bound``."""
    left = bound
    for place, size in enumerate(sorted(sizes)):
        most = left // (len(sizes) - place)
        if size > most:
            return max(most, 1)
        left -= size
    return max(sizes, default=1)


def _pieces(text: Column, most: Column) -> Column:
    """The text, or of a longer one pieces chosen by hash, in their order."""
    size = F.least(F.lit(_PIECE_CHARS), most).cast("int")
    numbers = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    digest = F.xxhash64(text)
    hashed = F.array_sort(
        F.transform(numbers, lambda i: F.struct(F.xxhash64(i, digest).alias("hash"), i.alias("i")))
    )
    first = F.slice(hashed, F.lit(1), F.floor(most / size).cast("int"))
    chosen = F.sort_array(F.transform(first, lambda one: one["i"]))
    pieces = F.transform(chosen, lambda i: F.substring(text, i * size + 1, size))
    return F.when(F.length(text) <= most, text).otherwise(F.array_join(pieces, " "))


def _score(sent) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        compressors = [_compressor(one) for one in model.dictionaries]
        for batch in batches:
            size = max(1, batch.num_rows * _SLICE_BYTES // max(batch.nbytes, 1))
            for begin in range(0, batch.num_rows, size):
                part = batch.slice(begin, size)
                if compressors:
                    rows = features(part.column(1).to_pylist(), *compressors)
                else:
                    rows = np.zeros((part.num_rows, len(model.middle)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(model.scores(rows))], names=["doc_id", "score"]
                )

    return run


def fit(
    documents: DataFrame,
    labels: DataFrame,
    training: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = 1_500,
    sample_chars: int = 12_000_000,
) -> Model:
    """Train on labelled rows for which ``training`` (an expression of the id) holds.

    One task trains on the sample, whose size the bounds limit; the driver gets the model alone.
    """
    texts, share = sampled_texts(
        documents,
        labels,
        training,
        id_col=id_col,
        text_col=text_col,
        label_col=label_col,
        sample_rows=sample_rows,
        sample_chars=sample_chars,
    )
    trained = texts.repartition(1).mapInArrow(_train_sample(share), "model binary").collect()
    return pickle.loads(trained[0]["model"]) if trained else train([], [], share)


def score(
    documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``documents``: doc_id, score (0 to 1) and predicted (1 from 0.5).

    A null text is empty and is scored like one; null ids, repeated rows and other columns do not
    matter. Labels that are null, contradict each other (the larger holds) or have no document are
    allowed; with one label only, the score is that label's share for every text. An empty table
    gives no rows.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    texts = documents.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    scored = texts.mapInArrow(_score(sent), f"doc_id {kind}, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def without_toxic(
    documents: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """The documents, with all their columns, that score below ``threshold``."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = _score(sent)
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            texts = batch.column(place).fill_null("")
            ids = pa.array(np.arange(batch.num_rows))
            alone = pa.RecordBatch.from_arrays([ids, texts], names=["doc_id", "text"])
            scores = np.concatenate([np.asarray(one.column(1)) for one in compute(iter([alone]))])
            yield batch.filter(pa.array(scores < threshold))

    return documents.mapInArrow(run, documents.schema)
