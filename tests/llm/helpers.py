"""Documents for the tests, and plain versions of what the operators compute."""

import re
from collections import defaultdict

# Other columns have names that the operators use themselves.
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "words string, hash bigint, key string, row int, id string, size int, label int"
)


def documents(spark, rows, partitions=2):
    """Rows of (doc_id, text) or (doc_id, text, source)."""
    full = [
        (row[0], row[1], "en", row[2] if len(row) > 2 else "s", 7, "w", 1, "k", 2, "i", 3, 4)
        for row in rows
    ]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def folded(text):
    """Words with A-Z in lower case."""
    return words(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def shingles(text, length):
    found = folded(text)
    if not found:
        return frozenset()
    if len(found) < length:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + length]) for i in range(len(found) - length + 1))


def components(texts, length, percent=80):
    """Smallest id reachable, by comparing all pairs that share a shingle."""
    sets = {i: shingles(text, length) for i, text in texts.items()}
    holders = defaultdict(list)
    for i, one in sets.items():
        for shingle in one:
            holders[shingle].append(i)
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, one in sets.items():
        others = {b for shingle in one for b in holders[shingle] if b > a}
        for b in others:
            if 100 * len(one & sets[b]) >= percent * len(one | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in texts}
