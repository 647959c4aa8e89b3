"""Hidden Markov language model over classes of words, trained by Baum-Welch over the corpus.

Frequent words are classes of their own, the end of a text is one, and the remaining words fall
into a fixed number of classes by their last letters. A state emits a class, and a class a word:

    P(text) = sum over paths of prod P(state' | state) P(class | state)  x  prod P(word | class)

The counts of words cover all training texts and stay distributed; words outside the frequent ones
meet their counts in a join. Each step of Baum-Welch adds the expected counts of all training
texts up, first in a task, then by class. The exact likelihood of a text is one forward
recursion, scaled at every word. All that tasks are sent is bounded by ``frequent`` and ``states``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.llm.common import lower_ascii, store, text_of, tidy, words_of

END = 0  # class of the end of a text
LONGEST_KEY = 64  # longer words are known by a hash, so that keys have a bounded size
_SEGMENT = 512  # training reads a text in pieces of so many words
_BATCH_TOKENS = 1 << 20


@dataclass(frozen=True)
class Classes:
    """Numbering of classes: the end, the frequent words, then the groups of all other words."""

    frequent: dict[bytes, int]
    counts: np.ndarray  # of the end and the frequent words
    tail_groups: int
    tail_counts: np.ndarray
    tail_words: np.ndarray
    tokens: int  # training tokens, N
    vocabulary: int  # distinct training tokens, V

    @property
    def size(self) -> int:
        return len(self.counts) + self.tail_groups

    def group(self, key: bytes) -> int:
        return len(self.counts) + zlib.crc32(key.decode()[-3:].encode()) % self.tail_groups


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # (states,)
    step: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes, states)


def _key(word: Column) -> Column:
    return F.when(F.octet_length(word) <= LONGEST_KEY, word).otherwise(
        F.concat(F.lit(" "), F.md5(word))
    )


def _group(key: Column, groups: int) -> Column:
    return F.crc32(F.right(key, F.lit(3)).cast("binary")) % groups


def count_words(texts: DataFrame) -> DataFrame:
    """key, n over all words of the training texts; stored."""
    words = texts.select(F.explode(words_of(lower_ascii(F.col("text")))).alias("word"))
    counted = words.groupBy(_key(F.col("word")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return store(counted, "lm-counts")


def choose_classes(counts: DataFrame, texts: int, *, frequent: int, tail_groups: int) -> Classes:
    """The most frequent words, at most ``frequent``, are told by a count found in a histogram.

    The histogram has at most eight rows per doubling of the count, so nothing is sorted.
    """
    step = F.floor(F.log2("n") * 8)
    histogram = counts.groupBy(step.alias("step")).agg(
        F.count(F.lit(1)).alias("words"), F.min("n").alias("least"), F.sum("n").alias("n")
    )
    rows = sorted(histogram.collect(), key=lambda row: -row["step"])
    words, least, inside = 0, None, F.lit(False)
    for row in rows:
        if words + row["words"] > frequent:
            # The step where the bound falls: its most frequent words, ties in the order of words.
            here = counts.filter(step == row["step"]).orderBy(F.desc("n"), "key")
            last = here.limit(frequent - words).orderBy("n", F.desc("key")).limit(1).collect()
            for one in last:
                inside = (F.col("n") > one["n"]) | (
                    (F.col("n") == one["n"]) & (F.col("key") <= one["key"])
                )
            break
        words, least = words + row["words"], row["least"]
        inside = F.col("n") >= least
    head = counts.filter(inside).collect()
    head = sorted(((row["key"].encode(), row["n"]) for row in head), key=lambda x: (-x[1], x[0]))
    tail = counts.filter(~inside)
    groups = tail.groupBy(_group(F.col("key"), tail_groups).alias("group")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")
    )
    tail_counts, tail_words = np.zeros(tail_groups), np.zeros(tail_groups)
    for row in groups.collect():
        tail_counts[row["group"]], tail_words[row["group"]] = row["n"], row["words"]
    return Classes(
        frequent={word: number for number, (word, _) in enumerate(head, start=1)},
        counts=np.array([texts, *[n for _, n in head]], dtype=np.float64),
        tail_groups=tail_groups,
        tail_counts=tail_counts,
        tail_words=tail_words,
        tokens=sum(row["n"] for row in rows) + texts,
        vocabulary=sum(row["words"] for row in rows) + (texts > 0),
    )


_ENCODED = (
    "row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, classes array<int>, "
    "tail array<string>"
)


def _encode(broadcast) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: Classes = broadcast.value
        get, group = classes.frequent.get, classes.group
        groups: dict[bytes, int] = {}
        for batch in batches:
            rows = max(1, batch.num_rows * (2 << 20) // max(batch.nbytes, 1))
            for begin in range(0, batch.num_rows, rows):
                part = batch.slice(begin, rows)
                flat, offsets, tails, tail_offsets = [], [0], [], [0]
                for text in part.column(3).to_pylist():
                    words = text.encode().lower().split()
                    numbers = list(map(get, words))
                    if None in numbers:
                        for i, number in enumerate(numbers):
                            if number is None:
                                key = words[i]
                                if len(key) > LONGEST_KEY:
                                    key = b" " + hashlib.md5(key).hexdigest().encode()
                                    if key in classes.frequent:
                                        numbers[i] = classes.frequent[key]
                                        continue
                                found = groups.get(key)
                                if found is None:
                                    if len(groups) > 200_000:
                                        groups = {}
                                    found = groups[key] = group(key)
                                numbers[i] = found
                                tails.append(key.decode())
                    flat += numbers
                    flat.append(END)
                    offsets.append(len(flat))
                    tail_offsets.append(len(tails))
                lengths = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        part.column(2),
                        pa.array(lengths, pa.int64()),
                        pa.ListArray.from_arrays(
                            pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())
                        ),
                        pa.ListArray.from_arrays(
                            pa.array(tail_offsets, pa.int32()), pa.array(tails, pa.string())
                        ),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "classes", "tail"],
                )

    return run


def _sequences(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column without nulls, also of a slice."""
    offsets = np.asarray(column.offsets, dtype=np.int64)
    values = np.asarray(column.values)[offsets[0] : offsets[-1]]
    return values, offsets - offsets[0]


def _in_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Join record batches up to a number of tokens: long runs make wide numpy steps."""
    held, tokens = [], 0
    for batch in batches:
        held.append(batch)
        tokens += len(batch.column(column).values)
        if tokens >= _BATCH_TOKENS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, tokens = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _settled(step: np.ndarray) -> np.ndarray:
    """How likely the states are far from the start of a text."""
    likely = np.full(len(step), 1 / len(step))
    for _ in range(100):
        likely = likely @ step
    return likely / likely.sum()


def _expected_counts(
    values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, fresh: np.ndarray, model: Model
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One E step over sequences side by side, longest first: start, step and emission counts.

    A sequence that is not ``fresh`` goes on in a text. Its first word belongs to the piece before
    it: the step from that word on is counted, the word and a start are not.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, fresh = starts[order], lengths[order], fresh[order]
    begin = np.where(fresh[:, None], model.start, _settled(model.step))
    states, longest = len(model.start), int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    first = np.concatenate([[0], np.cumsum(active)])
    forward = np.empty((first[-1], states))
    likely = np.empty((first[-1], states))
    scale = np.empty(first[-1])
    seen = np.empty(first[-1], dtype=np.int64)
    for t in range(longest):
        n, here = active[t], slice(first[t], first[t + 1])
        seen[here] = values[starts[:n] + t]
        likely[here] = model.emit[seen[here]]
        if t == 0:
            now = likely[here] * begin
        else:
            now = (forward[first[t - 1] : first[t - 1] + n] @ model.step) * likely[here]
        scale[here] = now.sum(axis=1)
        forward[here] = now / scale[here, None]
    step_counts = np.zeros((states, states))
    back = np.ones((active[-1], states))
    gamma = forward.copy()
    for t in range(longest - 2, -1, -1):
        n, later = active[t + 1], slice(first[t + 1], first[t + 2])
        ahead = likely[later] * back / scale[later, None]
        step_counts += forward[first[t] : first[t] + n].T @ ahead
        back = np.ones((active[t], states))
        back[:n] = ahead @ model.step.T
        gamma[first[t] : first[t + 1]] *= back
    gamma[: active[0]][~fresh] = 0
    start_counts = gamma[: active[0]].sum(axis=0)
    emit_counts = np.stack(
        [np.bincount(seen, gamma[:, k], minlength=len(model.emit)) for k in range(states)], axis=1
    )
    return start_counts, step_counts * model.step, emit_counts


def _baum_welch_task(broadcast) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = broadcast.value
        states = len(model.start)
        start, step = np.zeros(states), np.zeros((states, states))
        emit = np.zeros_like(model.emit)
        for batch in _in_batches(batches, 0):
            values, offsets = _sequences(batch.column(0))
            begins = [
                np.arange(a, b, _SEGMENT) for a, b in zip(offsets[:-1], offsets[1:], strict=True)
            ]
            fresh = np.concatenate([np.arange(len(b)) == 0 for b in begins])
            ends = np.repeat(offsets[1:], [len(b) for b in begins])
            begins = np.concatenate(begins)
            ends = np.minimum(begins + _SEGMENT, ends)
            # A piece inside a text begins with the last word of the one before.
            begins = begins - ~fresh
            for part in range(0, len(begins), 1024):
                some = slice(part, part + 1024)
                found = _expected_counts(
                    values, begins[some], ends[some] - begins[some], fresh[some], model
                )
                start += found[0]
                step += found[1]
                emit += found[2]
        used = np.flatnonzero(emit.sum(axis=1))
        # Rows -1 and -2 - state carry the start and the transitions.
        numbers = np.concatenate([used, -1 - np.arange(1 + states)])
        rows = np.concatenate([emit[used], start[None], step])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(numbers, pa.int32()),
                *[pa.array(np.ascontiguousarray(rows[:, k])) for k in range(states)],
            ],
            names=["class", *[f"s{k}" for k in range(states)]],
        )

    return run


def initial_model(classes: Classes, states: int) -> Model:
    """Unigram frequencies, each state's varied by a fixed pseudo-random factor."""
    share = _unigram(classes)
    emit = share[:, None] * np.random.default_rng(7).uniform(0.5, 1.5, (classes.size, states))
    step = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(step, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), step, emit / emit.sum(axis=0))


def _unigram(classes: Classes) -> np.ndarray:
    counts = np.concatenate([classes.counts, classes.tail_counts + classes.tail_words + 1])
    counts = np.maximum(counts, 1)
    return counts / counts.sum()


def baum_welch(encoded: DataFrame, classes: Classes, model: Model, *, strength: float) -> Model:
    """One step over all training texts. ``strength`` unigram tokens are added to each state."""
    states = len(model.start)
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    columns = ", ".join(f"s{k} double" for k in range(states))
    counted = (
        encoded.filter(~F.col("held_out"))
        .select("classes")
        .mapInArrow(_baum_welch_task(sent), f"class int, {columns}")
        .groupBy("class")
        .agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)])
    )
    start, step = np.ones(states), np.ones((states, states))
    emit = _unigram(classes)[:, None] * np.full(states, strength)
    for row in counted.collect():  # at most one row per class, state and the start
        found = np.array(row[1:])
        if row[0] >= 0:
            emit[row[0]] += found
        elif row[0] == -1:
            start += found
        else:
            step[-2 - row[0]] += found
    return Model(
        start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)
    )


def forward_log10(
    values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, model: Model
) -> np.ndarray:
    """log10 likelihood of each sequence of classes, all whole, side by side."""
    order = np.argsort(-lengths, kind="stable")
    starts, sorted_lengths = starts[order], lengths[order]
    longest = int(sorted_lengths[0]) if len(order) else 0
    active = np.searchsorted(-sorted_lengths, -np.arange(longest), side="left")
    total = np.zeros(len(order))
    now = np.empty((0, 0))
    for t in range(longest):
        n = active[t]
        likely = model.emit[values[starts[:n] + t]]
        now = likely * model.start if t == 0 else (now[:n] @ model.step) * likely
        scale = now.sum(axis=1)
        now /= scale[:, None]
        total[:n] += np.log10(scale)
    result = np.empty(len(order))
    result[order] = total
    return result


def _score_task(classes_sent, model_sent) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: Classes = classes_sent.value
        model: Model = model_sent.value
        frequent = len(classes.counts)
        log_counts = np.zeros(classes.size)
        log_counts[:frequent] = np.log10(classes.counts + 1)
        known = np.arange(classes.size) < (frequent if classes.tokens else 0)
        group_size = np.log10(classes.tail_counts + classes.tail_words + 1)
        words_in_class = np.concatenate([np.zeros(frequent), -group_size])
        each = np.log10(classes.tokens + classes.vocabulary + 1)
        for batch in _in_batches(batches, 4):
            values, offsets = _sequences(batch.column(4))
            lengths = np.diff(offsets)
            path = forward_log10(values, offsets[:-1], lengths, model)

            def summed(by_class: np.ndarray, values=values, offsets=offsets) -> np.ndarray:
                return np.add.reduceat(by_class[values], offsets[:-1])

            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(4)],
                    pa.array(summed(known.astype(np.int64)), pa.int64()),
                    pa.array(summed(log_counts) - lengths * each),
                    pa.array(path + summed(words_in_class)),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "model"],
            )

    return run


def score(
    documents: DataFrame,
    held_out: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    states: int = 8,
    steps: int = 4,
    frequent: int = 32_000,
    tail_groups: int = 64,
    strength: float = 20.0,
) -> DataFrame:
    """Score every whole text with a model of the texts that are not ``held_out``.

    Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram, add one) and
    score, both log10. Texts are split at white space, A-Z folded, and end with an end token.
    A null text is empty: its end token alone. Ids keep their type. A null id stays null, and rows with the same id are
    scored one by one. With nothing to learn from, every token counts as unknown. An empty table
    gives no rows. Other columns are not read.
    """
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        text_of(text_col).alias("text"),
    )
    training = rows.filter(~F.col("held_out"))
    counts = count_words(training)
    classes = choose_classes(counts, training.count(), frequent=frequent, tail_groups=tail_groups)
    context = documents.sparkSession.sparkContext
    classes_sent = context.broadcast(classes)
    kind = rows.schema["doc_id"].dataType.simpleString()
    encoded = store(rows.mapInArrow(_encode(classes_sent), _ENCODED.format(kind=kind)), "lm-encoded")

    model = initial_model(classes, states)
    for _ in range(steps):
        model = baum_welch(encoded, classes, model, strength=strength)

    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "classes").mapInArrow(
        _score_task(classes_sent, context.broadcast(model)),
        f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, "
        "base double, model double",
    )
    # Frequent words are gone, so no key of this join is hot.
    tail = encoded.select("row", F.explode("tail").alias("key"))
    tail_sums = (
        tail.join(counts, "key")
        .groupBy(F.col("row").alias("tail_row"))
        .agg(F.sum(F.log10(F.col("n") + 1)).alias("tail_log"), F.count(F.lit(1)).alias("tail_known"))
    )
    none = F.lit(0)
    return scored.join(tail_sums, F.col("row") == F.col("tail_row"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", none)).alias("n_known"),
        F.lit(classes.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_log", none)).alias("base_score"),
        (F.col("model") + F.coalesce("tail_log", none)).alias("score"),
    )
