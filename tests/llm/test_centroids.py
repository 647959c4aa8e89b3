"""Clusters against a plain search of every centroid."""

import hashlib
import math
import random

import numpy as np

from renewlens.llm import centroids, queries
from renewlens.llm.centroids import LARGEST, Search

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster int, vector string, upper int"


def frame(spark, rows, schema=SCHEMA, partitions=3):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], schema).repartition(partitions)


def plain(rows, number, rounds, scale=64, dimension=64):
    """Clusters of the rows by (id, whole vector), and the centroids, in plain Python."""
    kept = [
        (i, tuple(math.floor(scale * x) for x in v))
        for i, v in rows
        if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)
    ]

    def key(row):
        return hashlib.sha256(f"1:{'' if row[0] is None else row[0]}".encode()).hexdigest(), row[1]

    middles = [list(v) for _, v in sorted(kept, key=key)[:number]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middles))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, group in groups.items():
            middles[n] = [sum(column) // len(group) for column in zip(*group)]
    return sorted((str(i), *nearest(v)[::-1], v) for i, v in kept), middles


def agrees(spark, rows, number=5, rounds=3, dimension=4, scale=8):
    found = centroids.cluster(
        frame(spark, rows), number=number, rounds=rounds, dimension=dimension, scale=scale
    )
    clusters, middles = plain(rows, number, rounds, scale, dimension)
    assert found.centroids == middles
    collected = found.assigned.collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, tuple(r.vector)) for r in collected) == clusters
    return found


def test_small_clouds_with_many_ties(spark):
    source = random.Random(4)
    rows = [(i, [float(source.randint(-2, 2)) for _ in range(4)]) for i in range(300)]
    agrees(spark, rows, number=7, scale=1)
    agrees(spark, rows, number=7, scale=1, rounds=0)


def test_separate_clouds(spark):
    source = random.Random(5)
    centres = [[source.uniform(-9, 9) for _ in range(4)] for _ in range(6)]
    rows = [(i, [x + source.gauss(0, 0.3) for x in centres[i % 6]]) for i in range(400)]
    agrees(spark, [(i, np.float32(v).tolist()) for i, v in rows], number=6, rounds=5)


def test_odd_rows(spark):
    good = [0.5, -0.25, 0.0, 1.0]
    rows = [
        (1, good), (1, good), (None, good), (None, [1.0, 1.0, 1.0, 1.0]), (2, None), (3, []),
        (4, [1.0, 2.0, 3.0]), (5, [1.0, None, 2.0, 3.0]), (6, [math.nan, 1.0, 1.0, 1.0]),
        (7, [math.inf, 1.0, 1.0, 1.0]), (8, [1.0, -math.inf, 1.0, 1.0]), (9, [-0.1, 0.1, -0.0, 9.0]),
    ]
    found = agrees(spark, rows, number=3)
    assert found.assigned.columns == ["vec_id", "vector", "cluster", "second", "distance"]
    # More centroids than vectors, several of them equal; and one centroid alone.
    agrees(spark, rows, number=16)
    agrees(spark, rows, number=1)


def test_empty_tables_and_ids_as_text(spark):
    none = centroids.cluster(frame(spark, [(1, None)]), dimension=4)
    assert none.assigned.collect() == [] and none.centroids == []
    assert centroids.inertia(none.assigned) == {}
    one = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.5])], "key string, v array<double>")
    found = centroids.cluster(one, number=1, id_col="key", vector_col="v", dimension=2, scale=2)
    assert found.centroids == [[2, 4]]
    assert sorted((r.key, r.distance) for r in found.assigned.collect()) == [("a", 0), ("b", 1)]
    assert centroids.inertia(found.assigned) == {0: 1}


def test_components_beyond_the_bound_are_held(spark):
    rows = [(1, [3e38, 0.0, 0.0, 0.0]), (2, [-3e38, 0.0, 0.0, 0.0])]
    found = centroids.cluster(frame(spark, rows), number=1, rounds=0, dimension=4)
    far = {r.vec_id: (r.vector[0], r.distance) for r in found.assigned.collect()}
    assert {value[0] for value in far.values()} == {LARGEST, -LARGEST}
    assert {value[1] for value in far.values()} == {0, (2 * LARGEST) ** 2}


def test_search_agrees_with_all_distances_and_leaves_most_out():
    source = np.random.default_rng(6)
    middles = source.integers(-100, 100, (40, 8))
    vectors = np.repeat(middles, 50, axis=0) + source.integers(-6, 7, (2000, 8))
    own, second = np.zeros(2000, dtype=np.int64), np.ones(2000, dtype=np.int64)
    upper, lower, before, compared = np.full(2000, np.inf), np.zeros(2000), None, []

    class Counted(Search):
        def _distance(self, some, numbers):
            compared[-1] += len(some)
            return super()._distance(some, numbers)

    for _ in range(4):
        search = Counted(middles.tolist(), before)
        compared.append(0)
        own, second, upper, lower = search(vectors, own, second, upper, lower)
        gaps = ((vectors[:, None] - middles[None]) ** 2).sum(axis=2)
        assert (own == gaps.argmin(axis=1)).all()
        assert (np.sqrt(gaps.min(axis=1)) <= upper).all()
        others = gaps.copy()
        others[np.arange(2000), own] = np.iinfo(np.int64).max
        assert (np.sqrt(others.min(axis=1)) >= lower).all()
        before = middles.tolist()
        middles = np.array([vectors[own == n].sum(axis=0) // (own == n).sum() for n in range(40)])
    # The first pass knows no bounds yet.
    assert compared[0] < 2000 * 40 and compared[-1] < 0.05 * 2000 * 40


def test_query_on_odd_rows(spark, tmp_path):
    source = random.Random(7)
    rows = [(i, [source.uniform(-1, 1) for _ in range(64)]) for i in range(40)]
    rows = [(i, np.float32(v).tolist()) for i, v in rows] + [(None, None), (41, [0.5]), (3, rows[3][1])]
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.queries()["op12_centroids"](spark, str(tmp_path)).collect()
    clusters, middles = plain(rows, 16, 3)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found) == [row[:3] for row in clusters]
    total = sum(row[2] for row in clusters)
    for row in found:
        text = ",".join(map(str, middles[row.cluster]))
        assert row.centroid_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert row.inertia == total
        assert row.cluster_inertia == sum(one[2] for one in clusters if one[1] == row.cluster)
