"""Periodic runs: stretches of words that repeat with a period, found by block convolution.

A run is a stretch of consecutive words with smallest period ``p`` (words ``p`` apart are the same)
and a length of at least ``max(least, 2 * p)`` that no neighbouring word extends with that period.

A text is cut into blocks of two, four, eight ... words. A run with a period from ``2 * b - 1`` on
holds a whole block of ``b`` words whose copy one period on is in the run as well. So each block is
compared with all places of the window from ``2 * b - 1`` to ``4 * b - 2`` words after it (from 1 on
for blocks of two, where ``least`` leaves room). The sum of squared differences between block and
window is a convolution; a number-theoretic transform gives it as an exact integer, and the places
where it is zero are the distances of the block's copies. Words take part as numbers below a bound
that keeps the sums below the modulus, so a copy is never missed, and each zero is confirmed on
the words themselves. Copies of neighbouring blocks at one distance are one seed, which is extended
word by word to both sides. What lies in a shorter period's run already is not sought again.

Two things save transforms without changing any result: a block with a word that does not come
again within the window has no copy there, and a block whose whole window lies in a known run of
period at most half a block has only copies that are that run.

Texts are read in slices of many documents, with a word of its own between two of them; a slice
holds whole texts, so memory follows the longest text and not the table. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from renewlens.llm.common import WORD, tidy

# A prime that has roots of unity of every order up to 2**30, and a generator.
MODULUS = 3 * 2**30 + 1
GENERATOR = 5

LEAST = 12
_SLICE_CHARS = 1 << 21
_ELEMENTS = 1 << 19  # numbers transformed, or words compared, at a time
_FIRST_BLOCK = 2

_WORD = re.compile(WORD)
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _reduced(numbers: np.ndarray) -> np.ndarray:
    return numbers - numbers // np.uint64(MODULUS) * np.uint64(MODULUS)


@lru_cache(maxsize=64)
def _roots(half: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order ``2 * half``, as a column."""
    root = pow(GENERATOR, (MODULUS - 1) // (2 * half), MODULUS)
    root = pow(root, -1, MODULUS) if inverse else root
    powers = np.ones(1, dtype=np.uint64)
    while len(powers) < half:
        further = np.uint64(pow(root, len(powers), MODULUS))
        powers = np.concatenate([powers, _reduced(powers * further)])
    return powers[:, None]


def forward(columns: np.ndarray) -> np.ndarray:
    """Transform of every column, in bit-reversed order; the length is a power of two."""
    size, half = len(columns), len(columns) // 2
    modulus = np.uint64(MODULUS)
    while half:
        pairs = columns.reshape(size // (2 * half), 2, half, -1)
        left, right = pairs[:, 0], pairs[:, 1]
        total, gap = left + right, left + (modulus - right)
        total = np.where(total >= modulus, total - modulus, total)
        gap = np.where(gap >= modulus, gap - modulus, gap)
        columns = np.stack([total, _reduced(gap * _roots(half, False))], axis=1)
        half //= 2
    return columns.reshape(size, -1)


def backward(columns: np.ndarray) -> np.ndarray:
    """The columns whose transform, as ``forward`` orders it, is given."""
    size, half = len(columns), 1
    modulus = np.uint64(MODULUS)
    while half < size:
        pairs = columns.reshape(size // (2 * half), 2, half, -1)
        left, right = pairs[:, 0], _reduced(pairs[:, 1] * _roots(half, True))
        total, gap = left + right, left + (modulus - right)
        total = np.where(total >= modulus, total - modulus, total)
        gap = np.where(gap >= modulus, gap - modulus, gap)
        columns = np.stack([total, gap], axis=1)
        half *= 2
    return _reduced(columns.reshape(size, -1) * np.uint64(pow(size, -1, MODULUS)))


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sum of squared differences of every block at every place of its window, a column each.

    Exact as long as the sums of squares and of products stay below the modulus.
    """
    length, reach = len(blocks), len(windows)
    size = 1 << (reach - 1).bit_length()
    padded = np.zeros((2, size, blocks.shape[1]), dtype=np.uint64)
    # Reversed around zero, so that the product of transforms is a correlation.
    padded[0, (-np.arange(length)) % size] = blocks
    padded[1, :reach] = windows
    products = backward(_reduced(forward(padded[0]) * forward(padded[1])))
    squares = np.zeros((reach + 1, windows.shape[1]), dtype=np.int64)
    np.cumsum(windows.astype(np.int64) ** 2, axis=0, out=squares[1:])
    places = reach - length + 1
    own = (blocks.astype(np.int64) ** 2).sum(axis=0)
    return own + squares[length:] - squares[:places] - 2 * products[:places].astype(np.int64)


def _copies(
    codes: np.ndarray, starts: np.ndarray, block: int, low: int, high: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of blocks and distances at which they come again, for some blocks at a time."""
    reach = high - low + block
    at_once = max(1, _ELEMENTS // (4 * block))
    last = len(codes) - 1
    for first in range(0, len(starts), at_once):
        some = starts[first : first + at_once]
        blocks = codes[some + np.arange(block)[:, None]]
        windows = codes[np.minimum(some + low + np.arange(reach)[:, None], last)]
        distance, column = np.nonzero(squared_differences(blocks, windows) == 0)
        yield some[column], distance + low


def _same(words: np.ndarray, starts: np.ndarray, distances: np.ndarray, length: int) -> np.ndarray:
    """Whether the words of a block equal those at a distance."""
    same = np.zeros(len(starts), dtype=bool)
    at_once = max(1, _ELEMENTS // length)
    for first in range(0, len(starts), at_once):
        some = starts[first : first + at_once, None] + np.arange(length)
        apart = distances[first : first + at_once, None]
        same[first : first + at_once] = (words[some] == words[some + apart]).all(axis=1)
    return same


def _extended(words: np.ndarray, at: np.ndarray, distances: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on, in steps of 1 or -1, equal those at the distance."""
    total, length = np.zeros(len(at), dtype=np.int64), 8
    open_ones = np.arange(len(at))
    while len(open_ones):
        going = []
        at_once = max(1, _ELEMENTS // length)
        for first in range(0, len(open_ones), at_once):
            some = open_ones[first : first + at_once]
            left = (at[some] + step * total[some])[:, None] + step * np.arange(length)
            right = left + distances[some, None]
            inside = (left >= 0) & (right < len(words))
            same = inside & (
                words[np.where(inside, left, 0)] == words[np.where(inside, right, 0)]
            )
            equal = np.where(same.all(axis=1), length, np.argmin(same, axis=1))
            total[some] += equal
            going.append(some[equal == length])
        open_ones, length = np.concatenate(going), min(2 * length, 1 << 16)
    return total


def _shortest(stretches: np.ndarray) -> np.ndarray:
    """One row (start, end, period) for each start and end, that of the smallest period."""
    if not len(stretches):
        return stretches
    order = np.lexsort((stretches[:, 2], stretches[:, 1], stretches[:, 0]))
    ordered = stretches[order]
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = (ordered[1:, :2] != ordered[:-1, :2]).any(axis=1)
    return ordered[new]


def _owners(found: np.ndarray, block: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Period and end of the run that holds a block, for runs of period at most half a block.

    Two such runs never hold the same block: they would share more words than both periods have.
    """
    period, end = np.zeros(blocks, dtype=np.int64), np.zeros(blocks, dtype=np.int64)
    short = found[2 * found[:, 2] <= block]
    first, behind = -(-short[:, 0] // block), short[:, 1] // block
    number = np.maximum(behind - first, 0)
    run = np.repeat(np.arange(len(short)), number)
    held = np.arange(len(run)) - np.repeat(np.cumsum(number) - number, number) + first[run]
    inside = held < blocks
    period[held[inside]], end[held[inside]] = short[run[inside], 2], short[run[inside], 1]
    return period, end


def _gaps(words: np.ndarray) -> np.ndarray:
    """Distance to the next place of the same word; beyond all distances for the last one."""
    gaps = np.full(len(words), np.iinfo(np.int64).max, dtype=np.int64)
    order = np.argsort(words, kind="stable")
    again = words[order[1:]] == words[order[:-1]]
    gaps[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return gaps


def find(words: np.ndarray, longest: int | None = None, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of all runs of a sequence of numbers, by start and period.

    Numbers from 0 on are words; numbers below zero, each but once, part texts from each other.
    ``longest`` is the number of words of the longest text.
    """
    if least < 5:
        raise ValueError("blocks of two words need runs of at least 5")
    longest = len(words) if longest is None else longest
    found, block = np.zeros((0, 3), dtype=np.int64), _FIRST_BLOCK
    widest = _gaps(words)
    widest = widest[: len(widest) // 2 * 2].reshape(-1, 2).max(axis=1)
    while True:
        low = 1 if block == _FIRST_BLOCK else 2 * block - 1
        high = 4 * block - 2
        if 2 * low > longest:
            return found[np.lexsort((found[:, 2], found[:, 0]))]
        period, end = _owners(found, block, len(widest))
        numbers = np.flatnonzero(widest <= high)
        known = (period[numbers] > 0) & ((numbers + 1) * block + high <= end[numbers])
        starts = block * numbers[~known]
        # Codes below this bound keep all sums of a block below the modulus.
        codes = np.where(words < 0, 0, words) % (isqrt((MODULUS - 1) // block) + 1)
        stretches = [found]
        for places, distances in _copies(codes.astype(np.uint64), starts, block, low, high):
            behind = places + distances + block
            own = period[places // block]
            new = (behind <= len(words)) & (
                (own == 0)
                | (distances % np.maximum(own, 1) != 0)
                | (behind > end[places // block])
            )
            places, distances = places[new], distances[new]
            same = _same(words, places, distances, block)
            places, distances = places[same], distances[same]
            order = np.lexsort((places, distances))
            places, distances = places[order], distances[order]
            # Neighbouring blocks at one distance are one seed.
            joined = (np.diff(distances) == 0) & (np.diff(places) == block)
            heads = np.flatnonzero(np.concatenate([[True], ~joined])) if len(places) else []
            tails = np.flatnonzero(np.concatenate([~joined, [True]])) if len(places) else []
            apart, first, last = distances[heads], places[heads], places[tails] + block
            first = first - _extended(words, first - 1, apart, -1)
            last = last + _extended(words, last, apart, 1) + apart
            long = last - first >= np.maximum(least, 2 * apart)
            stretches.append(np.stack([first, last, apart], axis=1)[long])
        found = _shortest(np.concatenate(stretches))
        widest = widest[: len(widest) // 2 * 2].reshape(-1, 2).max(axis=1)
        block *= 2


def repeated(total: int, runs: np.ndarray) -> np.ndarray:
    """Which words some run holds after its first period."""
    steps = np.zeros(total + 1, dtype=np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about a slice's size, one text at least."""
    first, chars = 0, 0
    for at, text in enumerate(texts):
        chars += len(text or "") + 1
        if chars >= _SLICE_CHARS:
            yield first, at + 1
            first, chars = at + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _judged(ids: pa.Array, texts: list[str | None], least: int, names: list[str]) -> pa.RecordBatch:
    found = [_WORD.findall(text or "") for text in texts]
    sizes = np.array([len(words) for words in found], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    numbers = defaultdict(count().__next__)
    sequence = np.empty(int((sizes + 1).sum()), dtype=np.int64)
    for place, (start, words) in enumerate(zip(starts, found, strict=True)):
        end = start + len(words)
        sequence[start:end] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        sequence[end] = -1 - place
    runs = find(sequence, int(sizes.max(initial=0)), least)
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    gone = repeated(len(sequence), runs)
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
    pieces = [runs[:, 0] - starts[owner], runs[:, 1] - runs[:, 0], runs[:, 2]]
    listed = pa.StructArray.from_arrays(
        [pa.array(piece, pa.int64()) for piece in pieces], fields=list(_RUN)
    )
    kept = []
    for start, words in zip(starts, found, strict=True):
        dropped = gone[start : start + len(words)]
        if dropped.any():
            words = [word for word, off in zip(words, dropped.tolist(), strict=True) if not off]
        kept.append(" ".join(words))
    columns = [
        ids,
        pa.array(sizes, pa.int64()),
        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), listed),
        pa.array(kept, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=names)


def runs_of(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST
) -> DataFrame:
    """The runs of every text and the text without its repeats, one row per document.

    Columns: the id, ``n_words``, ``runs`` (start, length and period in words, by start and period)
    and ``collapsed``: the words that no run holds after its first period, joined by spaces.

    A null or empty text has no words, no runs and an empty ``collapsed``. Ids are passed through
    whatever their type; null and repeated ids and repeated rows are judged row by row, and other
    columns are not read. Very long texts are judged whole, in memory that follows their length.
    Runs with equal start and different period are all listed. An empty table gives no rows.
    """
    names = [id_col, "n_words", "runs", "collapsed"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, behind in _slices(texts):
                ids = batch.column(0).slice(first, behind - first)
                yield _judged(ids, texts[first:behind], least, names)

    read = documents.select(
        F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text")
    )
    kind = read.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words bigint, runs {_RUNS}, collapsed string"
    return read.mapInArrow(tidy(judge), schema)
