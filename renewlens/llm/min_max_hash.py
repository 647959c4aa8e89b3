"""Near-duplicates by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum,
so that half as many hashes are evaluated. Values are banded; texts that agree in a band are
candidates, and a candidate pair is a link only if the full shingle sets confirm it.

Work on groups is bounded. Texts with the same set are one class, found by aggregation, and only
its representative goes on. In a bucket every member is first compared with one central member
alone: a star. What is connected then needs no further comparison. Where members that share
buckets, directly or through others, are still in several components, all but the largest component
are compared with the whole group, in blocks of bounded size that run as tasks of their own and
give back only links between components. So every two texts of a bucket are either in one component
or compared in full. Components, fingerprints and links stay in tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from renewlens.llm.common import free_prefix, ids_tell_rows_apart, small, store, text_of, tidy

ROWS = 5
BANDS = 32
# A text with more candidate partners than this has its set copied to several tasks.
_PARTNERS_A_TASK = 256
_SLICE_BYTES = 2 << 20
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # splitmix64, fixed values


def _scramble(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that mixes all bits."""
    values = (values ^ (values >> np.uint64(30))) * _MIX[0]
    values = (values ^ (values >> np.uint64(27))) * _MIX[1]
    return values ^ (values >> np.uint64(31))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text.

    A-Z are folded. With fewer words than a shingle has, the whole sequence is one shingle; without
    words the set is empty. The number of words is hashed along, so a short text equals no shingle.
    """
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    length = min(words, len(hashes))
    total = np.full(len(hashes) - length + 1, length, dtype=np.uint64)
    for i in range(length):
        total = _scramble(total + hashes[i : len(hashes) - length + 1 + i])
    return np.unique(total)


def _permutations(count: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(
        0, np.iinfo(np.uint64).max, count, dtype=np.uint64, endpoint=True
    )


def signatures(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """(sets, 2 * permutations): minima, then maxima. Sets must not be empty."""
    flat = np.concatenate(sets)
    begins = np.concatenate([[0], np.cumsum([len(one) for one in sets])[:-1]])
    result = np.empty((len(sets), 2 * permutations), dtype=np.uint64)
    for i, seed in enumerate(_permutations(permutations)):
        # One multiplication keeps order random enough: the input is mixed already.
        values = (flat ^ seed) * _MIX[0]
        values ^= values >> np.uint64(32)
        values *= _MIX[1]
        result[:, i] = np.minimum.reduceat(values, begins)
        result[:, permutations + i] = np.maximum.reduceat(values, begins)
    return result


def bands_of(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit hash a band. A band takes every ``bands``-th value, so never both of a pair."""
    total = np.tile(np.arange(bands, dtype=np.uint64), (len(signature), 1))
    for row in range(rows):
        total = _scramble(total + signature[:, row * bands : (row + 1) * bands])
    return total


_SIGNED = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>"


def _sign(words: int, rows: int, bands: int) -> Callable:
    permutations = -(-rows * bands // 2)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, batch.num_rows * _SLICE_BYTES // max(batch.nbytes, 1))
            for begin in range(0, batch.num_rows, size):
                part = batch.slice(begin, size)
                sets = [shingle_set(text, words) for text in part.column(1).to_pylist()]
                full = [one for one in sets if len(one)]
                offsets = np.zeros(len(sets) + 1, dtype=np.int32)
                offsets[1:] = np.cumsum([bands * (len(one) > 0) for one in sets])
                flat = np.zeros(0, dtype=np.int64)
                if full:
                    flat = bands_of(signatures(full, permutations), rows, bands).reshape(-1)
                digests = [xxhash.xxh3_128_intdigest(one.tobytes()) for one in sets]
                halves = np.array(
                    [(one >> 64, one & 0xFFFFFFFFFFFFFFFF) for one in digests], dtype=np.uint64
                ).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(one) for one in sets], pa.int64()),
                        pa.array(np.ascontiguousarray(halves[:, 0])),
                        pa.array(np.ascontiguousarray(halves[:, 1])),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return run


def _sets(words: int) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, batch.num_rows * _SLICE_BYTES // max(batch.nbytes, 1))
            for begin in range(0, batch.num_rows, size):
                part = batch.slice(begin, size)
                sets = [shingle_set(text, words) for text in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(one) for one in sets])])
                flat = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
                    ],
                    names=["id", "shingles"],
                )

    return run


def _confirm(pairs: DataFrame, texts: DataFrame, *, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; stored.

    Only sets of texts in some pair are built. ``a`` may be the partner of a whole bucket: it is
    then copied, once for every few hundred pairs, and each copy meets its own part of them.
    """
    pairs = store(pairs, "minmax-pairs")
    a_counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners"))
    copies = (F.col("partners") / _PARTNERS_A_TASK).cast("int") + 1
    a_ids = a_counts.select(F.col("a").alias("wanted"), copies.alias("copies"))
    b_ids = pairs.select(F.col("b").alias("wanted")).distinct().withColumn("copies", F.lit(0))
    wanted = a_ids.unionByName(b_ids).groupBy("wanted").agg(F.max("copies").alias("copies"))
    needed = texts.join(small(wanted), F.col("doc_id") == F.col("wanted"), "left_semi")
    sets = store(
        needed.select("doc_id", "text").mapInArrow(_sets(words), "id bigint, shingles array<bigint>"),
        "minmax-sets",
    )
    left = sets.join(a_ids, F.col("id") == F.col("wanted")).select(
        F.col("id").alias("left_id"),
        F.col("shingles").alias("left_set"),
        F.col("copies").alias("left_copies"),
        F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("left_copy"),
    )
    spread = pairs.join(a_ids, F.col("a") == F.col("wanted")).select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy")
    )
    met = spread.join(sets, F.col("b") == F.col("id")).select(
        "a", "b", "copy", F.col("shingles").alias("right_set")
    )
    both = met.join(left, (F.col("a") == F.col("left_id")) & (F.col("copy") == F.col("left_copy")))
    common = F.size(F.array_intersect("left_set", "right_set"))
    union = F.size("left_set") + F.size("right_set") - common
    return store(both.filter(common * 100 >= union * percent).select("a", "b"), "minmax-links")


def _near(left: str, right: str, percent: int) -> Column:
    """Sets of such sizes can be similar enough."""
    return (F.col(left) * 100 >= F.col(right) * percent) & (
        F.col(right) * 100 >= F.col(left) * percent
    )


def _compare(percent: int) -> Callable:
    """Links between components, from the rows to compare (side 0) with the others (side 1)."""

    def run(rows: pa.Table) -> pa.Table:
        side = np.asarray(rows.column("side"))
        ids = np.asarray(rows.column("id"))
        component = np.asarray(rows.column("component"))
        column = rows.column("shingles").combine_chunks()
        offsets = np.asarray(column.offsets, dtype=np.int64)
        flat = np.asarray(column.values)[offsets[0] : offsets[-1]]
        sizes = np.diff(offsets)
        # Only what two sets have can be common. Columns are taken a part at a time.
        _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(ids)), sizes)
        several = times[code] > 1
        order = np.argsort(code[several], kind="stable")
        owner, code = owner[several][order], code[several][order]
        _, code = np.unique(code, return_inverse=True)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        common = np.zeros((len(left), len(right)), dtype=np.float32)
        step = max(1, (2 << 20) // max(len(ids), 1))
        for begin in range(0, int(code[-1]) + 1 if len(code) else 0, step):
            part = slice(*np.searchsorted(code, [begin, begin + step]))
            has = np.zeros((len(ids), step), dtype=np.float32)
            has[owner[part], code[part] - begin] = 1
            common += has[left] @ has[right].T
        union = sizes[left][:, None] + sizes[right][None, :] - common
        linked = (common * 100 >= union * percent) & (
            component[left][:, None] != component[right][None, :]
        )
        # A spanning set of links says all there is to say about components.
        root: dict[int, int] = {}

        def top(one: int) -> int:
            while root.get(one, one) != one:
                one = root[one]
            return one

        found = []
        for i, j in zip(*np.nonzero(linked), strict=True):
            x, y = top(int(component[left[i]])), top(int(component[right[j]]))
            if x != y:
                root[x] = y
                found.append((int(ids[left[i]]), int(ids[right[j]])))
        return pa.table(
            {
                "a": pa.array([one[0] for one in found], pa.int64()),
                "b": pa.array([one[1] for one in found], pa.int64()),
            }
        )

    return run


def _across(
    grouped: DataFrame, found: DataFrame, texts: DataFrame, *, words: int, percent: int
) -> DataFrame:
    """Links between different components of a group; stored.

    ``grouped``: id, group, n_shingles. Sizes fall into levels such that similar sets are on the
    same level or on adjacent ones. On each level the members outside the group's largest component
    (copied to the levels beside their own) meet all members, block by block.
    """
    placed = store(
        grouped.join(found.select(F.col("id").alias("f_id"), "component"), F.col("id") == F.col("f_id"), "left")
        .select(
            "id",
            "group",
            "n_shingles",
            F.coalesce("component", "id").alias("component"),
            F.floor(F.log("n_shingles") / np.log(100 / percent)).cast("int").alias("level"),
        ),
        "minmax-placed",
    )
    largest = (
        placed.groupBy("group", "component")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(F.col("group").alias("o_group"))
        .agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("parts"))
        .filter("parts > 1")
        .select("o_group", "main")
    )
    open_groups = store(
        placed.join(largest, F.col("group") == F.col("o_group")).drop("o_group"), "minmax-open"
    )
    rows_a_block = F.greatest(
        F.lit(16), F.least(F.lit(512), (F.lit(2e6) / F.pow(F.lit(100 / percent), F.col("level"))))
    )
    rest = open_groups.filter(F.col("component") != F.col("main")).withColumn(
        "at", F.explode(F.array(*[F.col("level") + step for step in (-1, 0, 1)]))
    )

    def blocks(rows: DataFrame, level: str, name: str) -> DataFrame:
        counts = rows.withColumn("level", F.col(level)).groupBy("group", "level")
        return counts.agg(F.count(F.lit(1)).alias("n")).select(
            F.col("group").alias(f"{name}_group"),
            F.col("level").alias(f"{name}_level"),
            F.ceil(F.col("n") / rows_a_block).cast("int").alias(f"{name}_blocks"),
        )

    rest_blocks, all_blocks = blocks(rest, "at", "r"), blocks(open_groups, "level", "m")
    both = rest_blocks.join(
        all_blocks,
        (F.col("r_group") == F.col("m_group")) & (F.col("r_level") == F.col("m_level")),
    ).select("r_group", "r_level", "r_blocks", "m_blocks")
    both = small(store(both, "minmax-blocks"))

    def copies(rows: DataFrame, level: str, side: int, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        named = (block.alias("i"), each.alias("j")) if side == 0 else (block.alias("j"), each.alias("i"))
        return rows.join(
            both, (F.col("group") == F.col("r_group")) & (F.col(level) == F.col("r_level"))
        ).select("id", "component", "group", F.col(level).alias("level"), F.lit(side).alias("side"), *named)

    tasks = copies(rest, "at", 0, "r_blocks", "m_blocks").select(
        "id", "component", "group", "level", "side", "i", "j"
    ).unionByName(copies(open_groups, "level", 1, "m_blocks", "r_blocks"))
    needed = open_groups.select(F.col("id").alias("wanted"))
    sets = store(
        texts.join(small(needed), F.col("doc_id") == F.col("wanted"), "left_semi")
        .select("doc_id", "text")
        .mapInArrow(_sets(words), "id bigint, shingles array<bigint>"),
        "minmax-open-sets",
    )
    compared = (
        tasks.join(sets, "id")
        .groupBy("group", "level", "i", "j")
        .applyInArrow(_compare(percent), "a bigint, b bigint")
    )
    return store(compared.distinct(), "minmax-across")


def _fingerprint(edges: DataFrame) -> tuple:
    """Count and two digests of a set of edges; different sets agree with a chance of 2^-64."""
    sums = F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))
    return tuple(edges.agg(F.count(F.lit(1)), *sums).first())


def components(links: DataFrame) -> DataFrame:
    """id, component: the smallest id that links reach, for every id of a link.

    Links (a, b) are rewired, in turn to the smallest neighbour among larger ones and among
    smaller ones, until nothing changes; then every id points to the smallest of its component.
    """
    edges = store(
        links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(),
        "minmax-edges",
    )
    seen = _fingerprint(edges)
    while True:
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(
            edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
        )
        least = both.groupBy(F.col("x").alias("z")).agg(F.least(F.min("y"), F.col("z")).alias("m"))
        # Stored, as a plan that repeats it grows in the driver with every use.
        large = store(
            both.join(least, F.col("x") == F.col("z"))
            .filter(F.col("y") > F.col("x"))
            .select(F.col("y").alias("v"), F.col("m").alias("u"))
            .distinct(),
            "minmax-large",
        )
        floor = large.groupBy(F.col("v").alias("z")).agg(F.min("u").alias("m"))
        moved = large.join(floor, F.col("v") == F.col("z"))
        # An edge (v, u) becomes (v, m), and (u, m) where that is another vertex.
        ends = F.when(F.col("u") != F.col("m"), F.array("v", "u")).otherwise(F.array("v"))
        after = store(
            moved.select(F.explode(ends).alias("v"), F.col("m").alias("u")).distinct(), "minmax-edges"
        )
        before, seen = seen, _fingerprint(after)
        if seen == before:
            roots = after.select(F.col("u").alias("id")).distinct().withColumn("component", F.col("id"))
            return store(
                after.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(roots),
                "minmax-components",
            )
        edges = after


def near_duplicates(
    documents: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    rows: int = ROWS,
    bands: int = BANDS,
) -> DataFrame:
    """Per row of ``documents``: doc_id, n_shingles, component_id, kept.

    Two texts are linked if they share at least ``percent`` of the union of their shingles of
    ``words`` words; the component is the smallest id reachable, and kept marks that document. With
    32 bands of 5 values a pair at the limit is missed with a probability of 3 in a million.

    A null text, or one without words, is linked to nothing. Rows with the same id are one document
    to the links. A null id is in no component and kept. Ids may be whole numbers or text, whose
    order is that of its bytes. Very long texts are compared whole. An empty table gives no rows;
    other columns are not read.
    """
    texts = documents.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    if not isinstance(texts.schema["doc_id"].dataType, IntegralType):
        return _by_number(texts, words=words, percent=percent, rows=rows, bands=bands)
    texts = texts.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    signed = store(texts.mapInArrow(_sign(words, rows, bands), _SIGNED), "minmax-signed")
    same = ["n_shingles", "set_a", "set_b"]
    full = signed.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = store(full.groupBy(*same).agg(F.min("doc_id").alias("class_id")), "minmax-classes")
    on = [F.col(name) == F.col(f"c_{name}") for name in same]
    renamed = classes.select(*[F.col(name).alias(f"c_{name}") for name in same], "class_id")
    heads = full.join(renamed, [*on, F.col("doc_id") == F.col("class_id")], "left_semi")
    buckets = heads.select(
        F.col("doc_id").alias("id"), "n_shingles", F.posexplode("bands").alias("band", "hash")
    )
    shared = store(
        buckets.groupBy("band", "hash")
        .agg(F.count(F.lit(1)).alias("size"))
        .filter("size > 1")
        .select(F.col("band").alias("s_band"), F.col("hash").alias("s_hash"), "size"),
        "minmax-shared",
    )
    same_bucket = (F.col("band") == F.col("s_band")) & (F.col("hash") == F.col("s_hash"))
    members = store(
        buckets.join(shared, same_bucket).select("band", "hash", "id", "n_shingles", "size"),
        "minmax-members",
    )
    # Round one: every member of a bucket against the one with the most companions.
    company = members.groupBy(F.col("id").alias("m_id")).agg(F.sum("size").alias("company"))
    centres = (
        members.join(company, F.col("id") == F.col("m_id"))
        .groupBy(F.col("band").alias("s_band"), F.col("hash").alias("s_hash"))
        .agg(F.max(F.struct("company", "id", "n_shingles")).alias("centre"))
    )
    star = store(
        members.join(centres, same_bucket)
        .filter(F.col("id") != F.col("centre.id"))
        .select(
            F.col("centre.id").alias("a"),
            F.col("id").alias("b"),
            _near("centre.n_shingles", "n_shingles", percent).alias("near"),
        )
        .distinct(),
        "minmax-star",
    )
    links = _confirm(star.filter("near").select("a", "b"), texts, words=words, percent=percent)
    found = components(links)

    # Round two: groups that are still in several components.
    grouped = components(star).select("id", F.col("component").alias("group"))
    sizes = members.select("id", "n_shingles").distinct()
    more = _across(grouped.join(sizes, "id"), found, texts, words=words, percent=percent)
    if not more.isEmpty():
        found = components(links.unionByName(more))

    by_class = classes.join(
        found.select(F.col("id").alias("f_id"), "component"), F.col("class_id") == F.col("f_id"), "left"
    ).select(
        *[F.col(name).alias(f"c_{name}") for name in same],
        F.coalesce("component", "class_id").alias("class_component"),
    )
    every = signed.select("doc_id", *same).join(by_class, on, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return every.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def one_of_each(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The documents, with all their columns, without those that have a smaller one to stand in.

    One row of each group stays: that with the smallest id, a null one last. Where ids do not tell
    rows apart, rows are judged one by one, so of repeated rows one stays, and rows that share an id
    alone are no group. Rows without words all stay.
    """
    if ids_tell_rows_apart(documents, id_col):
        judged = near_duplicates(documents, id_col=id_col, text_col=text_col, **options)
        row, numbered = id_col, documents
        kept = judged.filter("kept")
    else:
        row = free_prefix(documents.columns, "_row")
        numbered = store(documents.withColumn(row, F.monotonically_increasing_id()), "minmax-rows")
        judged = near_duplicates(numbered, id_col=row, text_col=text_col, **options)
        ids = numbered.select(F.col(row).alias("n"), F.col(id_col).alias("id"))
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n"))["n"]
        kept = (
            judged.join(ids, F.col("doc_id") == F.col("n"))
            .groupBy("component_id")
            .agg(first.alias("doc_id"))
        )
    name = free_prefix(documents.columns, "_dropped")
    dropped = store(
        judged.select(F.col("doc_id").alias(name))
        .join(kept.select(F.col("doc_id").alias("stays")), F.col(name) == F.col("stays"), "left_anti")
        .distinct(),
        "minmax-dropped",
    )
    left = numbered.join(small(dropped), F.col(row) == F.col(name), "left_anti")
    return left.select(*[left[f"`{column}`"] for column in documents.columns])


def _by_number(texts: DataFrame, **options) -> DataFrame:
    """``near_duplicates`` of documents whose ids are no whole numbers, by their rank as numbers.

    Sorted partitions are numbered one after the other, so the smaller id has the smaller number.
    """
    ids = texts.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id")).distinct()
    ranked = ids.orderBy("id").withColumn("n", F.monotonically_increasing_id())
    numbers = store(ranked, "minmax-numbers")
    known = texts.join(numbers, F.col("doc_id") == F.col("id"), "left")
    numbered = store(known.select(F.col("n").alias("number"), "text"), "minmax-numbered")
    judged = near_duplicates(numbered, id_col="number", **options)
    own = numbers.select(F.col("n").alias("own"), F.col("id").alias("named"))
    other = numbers.select(F.col("n").alias("other"), F.col("id").alias("component_name"))
    return (
        judged.join(own, F.col("doc_id") == F.col("own"), "left")
        .join(other, F.col("component_id") == F.col("other"), "left")
        .select(
            F.col("named").alias("doc_id"),
            "n_shingles",
            F.col("component_name").alias("component_id"),
            "kept",
        )
    )
