"""Clustering around centroids with Shallot search, exact in whole numbers.

A vector keeps an upper bound of the distance to its centroid, a lower bound of the distance to
every other, and the number of the second nearest. When centroids have moved, the bounds are
widened by the moves; where they still part, or the own centroid is nearer than half the way to
its nearest neighbour, nothing is compared. Otherwise the distances to own and second centroid are
taken anew and the search starts from the closer one: its neighbours are tried in the order of
their distance from it, as long as one can lie within the ball around it that could hold a nearest
or second nearest. The ball shrinks with every closer centroid found. Bounds are floating-point
numbers with a margin; what survives them is compared in integers, ties to the smaller number.

Each round is one pass over the vectors, whose state is written to the shared folder of the session
and read by the next, and one sum by cluster with partial sums in every task. Only the centroids
themselves, whose number is a parameter, pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.llm.common import store, tidy

# Components beyond this are held at it, so that squared distances stay below 2**63.
LARGEST = 2**27
_WIDER, _NARROWER = 1 + 1e-9, 1 - 1e-9
_ROWS = 4096
_FAR = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Clusters:
    """Vectors with the centroid of each: id, ``vector`` in whole numbers, ``cluster``,
    ``second`` (the second nearest), ``distance`` squared; and the centroids in order."""

    assigned: DataFrame
    centroids: list[list[int]]


def whole_vectors(
    vectors: DataFrame, *, id_col: str, vector_col: str, dimension: int, scale: int
) -> DataFrame:
    """Ids and vectors ``floor(scale * x)`` of the rows that have ``dimension`` finite components.

    Other rows, also null ones, are left out. Components whose integer lies beyond ``LARGEST`` are
    held there.
    """

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    def whole(x: Column) -> Column:
        scaled = F.least(F.greatest(x * float(scale), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))
        return F.floor(scaled).cast("int")

    raw = F.col(vector_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).alias(id_col), raw.alias("_raw")).where(
        (F.size("_raw") == dimension) & F.forall("_raw", finite)
    )
    return kept.select(id_col, F.transform("_raw", whole).alias("vector"))


def first_centroids(whole: DataFrame, number: int, *, id_col: str, seed: int) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes, in their order; equal ids by the vector.

    A null id counts as empty text. Fewer vectors than ``number`` give fewer centroids.
    """
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), text), 256)
    chosen = whole.select(key.alias("_key"), "vector").orderBy("_key", "vector").limit(number)
    return [list(row.vector) for row in chosen.collect()]


def _squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    gap = left - right
    return (gap * gap).sum(axis=-1)


class Search:
    """Nearest and second nearest of some centroids, given where they were before.

    With one centroid alone, it is its own second nearest.
    """

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None = None):
        self.centroids = np.array(centroids, dtype=np.int64)
        number = len(centroids)
        between = np.sqrt(_squared(self.centroids[:, None], self.centroids[None]).astype(float))
        np.fill_diagonal(between, -1.0)  # a centroid comes before all its neighbours
        self.order = np.argsort(between, axis=1, kind="stable")
        self.apart = np.take_along_axis(between, self.order, axis=1)
        self.half = self.apart[:, 1] / 2 if number > 1 else np.full(1, np.inf)
        moved = np.zeros(number)
        if before is not None:
            moved = np.sqrt(_squared(self.centroids, np.array(before, dtype=np.int64)).astype(float))
        self.moved = moved * _WIDER
        ranked = np.argsort(-self.moved, kind="stable")
        self.others_moved = np.full(number, self.moved[ranked[0]])
        self.others_moved[ranked[0]] = self.moved[ranked[1]] if number > 1 else 0.0

    def _distance(self, vectors: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return _squared(vectors, self.centroids[numbers])

    def __call__(
        self,
        vectors: np.ndarray,
        own: np.ndarray,
        second: np.ndarray,
        upper: np.ndarray,
        lower: np.ndarray,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The four of them for the centroids as they are now."""
        own, second = own.copy(), second.copy()
        upper = (upper + self.moved[own]) * _WIDER
        lower = (lower - self.others_moved[own]) * _NARROWER
        if len(self.centroids) == 1:
            return own, second, upper, lower
        bound = np.maximum(lower, self.half[own] * _NARROWER)
        rows = np.flatnonzero(upper >= bound)
        nearest = self._distance(vectors[rows], own[rows])
        upper[rows] = np.sqrt(nearest.astype(float)) * _WIDER
        still = upper[rows] >= bound[rows]
        rows, best = rows[still], nearest[still]
        if not len(rows):
            return own, second, upper, lower
        some = vectors[rows]
        near, far = own[rows], second[rows]
        next_best = self._distance(some, far)
        # The search starts from the closer one of the two that are known.
        swap = (next_best < best) | ((next_best == best) & (far < near))
        near, far = np.where(swap, far, near), np.where(swap, near, far)
        best, next_best = np.where(swap, next_best, best), np.where(swap, best, next_best)
        centre, known = near.copy(), far.copy()
        reach = np.sqrt(best.astype(float)) * _WIDER
        open_ones = np.arange(len(rows))
        for rank in range(1, len(self.centroids)):
            ball = reach[open_ones] + np.sqrt(next_best[open_ones].astype(float)) * _WIDER
            inside = self.apart[centre[open_ones], rank] * _NARROWER <= ball
            open_ones = open_ones[inside]
            if not len(open_ones):
                break
            number = self.order[centre[open_ones], rank]
            new = number != known[open_ones]
            at, number = open_ones[new], number[new]
            distance = self._distance(some[at], number)
            closest = (distance < best[at]) | ((distance == best[at]) & (number < near[at]))
            closer = ~closest & (
                (distance < next_best[at]) | ((distance == next_best[at]) & (number < far[at]))
            )
            first = at[closest]
            next_best[first], far[first] = best[first], near[first]
            best[first], near[first] = distance[closest], number[closest]
            next_best[at[closer]], far[at[closer]] = distance[closer], number[closer]
        own[rows], second[rows] = near, far
        upper[rows] = np.sqrt(best.astype(float)) * _WIDER
        lower[rows] = np.sqrt(next_best.astype(float)) * _NARROWER
        return own, second, upper, lower


def _pass(search: Search, dimension: int, names: list[str], exact: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(first, _ROWS)
                vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                vectors = vectors.reshape(-1, dimension).astype(np.int64)
                state = [column.to_numpy(zero_copy_only=False) for column in batch.columns[2:]]
                own, second, upper, lower = search(vectors, *state)
                columns = [pa.array(own, pa.int32()), pa.array(second, pa.int32())]
                if exact:
                    distance = _squared(vectors, search.centroids[own])
                    columns.append(pa.array(distance, pa.int64()))
                else:
                    columns += [pa.array(upper, pa.float64()), pa.array(lower, pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=names)

    return run


def _assigned(state: DataFrame, search: Search, dimension: int, exact: bool) -> DataFrame:
    bounds = ["distance"] if exact else ["upper", "lower"]
    names = [*state.columns[:2], "cluster", "second", *bounds]
    kind = "bigint" if exact else "double"
    schema = ", ".join(
        [
            f"`{state.columns[0]}` {state.schema[0].dataType.simpleString()}",
            "vector array<int>, cluster int, second int",
            *[f"{name} {kind}" for name in bounds],
        ]
    )
    return state.mapInArrow(tidy(_pass(search, dimension, names, exact)), schema)


def moved_centroids(
    state: DataFrame, centroids: list[list[int]], dimension: int
) -> list[list[int]]:
    """Componentwise floor of the mean of each cluster's vectors; an empty cluster stays."""
    sums = [F.sum(F.col("vector")[place]).alias(f"s{place}") for place in range(dimension)]
    moved = [list(centroid) for centroid in centroids]
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        moved[row["cluster"]] = [row[f"s{place}"] // row["n"] for place in range(dimension)]
    return moved


def cluster(
    vectors: DataFrame,
    *,
    number: int = 16,
    rounds: int = 3,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dimension: int = 64,
    scale: int = 64,
    seed: int = 1,
) -> Clusters:
    """Assign every usable vector to its nearest centroid after some rounds of moving them.

    Rows whose vector is null, has another length or a component that is null or not finite are
    left out; repeated rows and repeated or null ids count row by row. Distances that are equal go
    to the smaller number, also between equal centroids. Without a usable row there is no centroid
    and no row. Other columns of the table are not read.
    """
    whole = store(
        whole_vectors(
            vectors, id_col=id_col, vector_col=vector_col, dimension=dimension, scale=scale
        ),
        "whole-vectors",
    )
    centroids = first_centroids(whole, number, id_col=id_col, seed=seed)
    second = min(1, len(centroids) - 1)
    state = whole.select(
        id_col,
        "vector",
        F.lit(0).alias("cluster"),
        F.lit(max(second, 0)).alias("second"),
        F.lit(float("inf")).alias("upper"),
        F.lit(0.0).alias("lower"),
    )
    before = None
    for _ in range(rounds if centroids else 0):
        state = store(_assigned(state, Search(centroids, before), dimension, False), "clusters")
        before, centroids = centroids, moved_centroids(state, centroids, dimension)
    if not centroids:
        distance = F.lit(0).cast("bigint").alias("distance")
        return Clusters(state.select(id_col, "vector", "cluster", "second", distance), [])
    last = _assigned(state, Search(centroids, before), dimension, True)
    return Clusters(store(last, "clusters"), centroids)


def inertia(assigned: DataFrame) -> dict[int, int]:
    """Squared distances summed by cluster, for the clusters that have vectors."""
    exact = F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")
    return {row.cluster: int(row.total) for row in assigned.groupBy("cluster").agg(exact).collect()}
