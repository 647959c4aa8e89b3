"""The SQL that queries of this subpackage must agree with, where SQL can express them."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIXING = rf"""
WITH docs AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
           substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15) AS h
    FROM documents),
ranked AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
               WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
    FROM docs GROUP BY source),
levels AS (
    SELECT *, 2 * source_size AS cap, 2 * source_size / weight AS ratio,
           ((sum(source_size) OVER ())::DOUBLE * 1.5
            - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
           / (sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
    FROM ranked),
aims AS (
    SELECT source, source_size,
           coalesce(least(cap::DOUBLE,
               weight * (SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio)), cap::DOUBLE)
           AS target
    FROM levels),
budgets AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 1 END AS rounds
    FROM aims),
summed AS (
    SELECT doc_id, size, source, h,
           sum(size) OVER (PARTITION BY source ORDER BY h) AS upto,
           sum(size) OVER (PARTITION BY source, h) AS tied
    FROM docs)
SELECT doc_id, size, source_size, target,
       (size * (rounds + CASE
           WHEN upto <= target - rounds * source_size THEN 1
           WHEN upto - tied <= target - rounds * source_size
               AND 2 * (target - rounds * source_size - (upto - tied)) > tied THEN 1
           ELSE 0 END))::BIGINT AS taken
FROM summed JOIN budgets ON summed.source IS NOT DISTINCT FROM budgets.source
"""

LINES = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS position
    FROM docs),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACES})")} AS key FROM lines),
repeated AS (
    SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10
    GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (
    SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.first_id AS dropped
    FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (NOT dropped), ''))
       AS kept_sha256
FROM judged GROUP BY doc_id
"""

QUALITY = rf"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda l: trim(l, {_SPACES}) <> '') AS lines
    FROM documents),
windows AS (
    SELECT doc_id, i, words[i:i + 4] AS seen
    FROM docs, unnest(range(1, len(words) - 3)) AS t(i)),
repeated AS (
    SELECT doc_id, i FROM windows
    QUALIFY count(*) OVER (PARTITION BY doc_id, seen) >= 2),
covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
    FROM repeated, unnest(range(0, 5)) AS t(k) GROUP BY doc_id),
counts AS (
    SELECT docs.doc_id, text, words, len(words)::BIGINT AS n_words,
           length(array_to_string(words, ''))::BIGINT AS word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
           len(lines)::BIGINT AS n_lines,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM docs LEFT JOIN covered ON docs.doc_id = covered.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words
            OR n_symbols * 100 > word_chars * 5
            OR n_dup_lines * 100 > n_lines * 50
            OR word_chars < n_words * 2
            OR word_chars > n_words * 20
            OR len(regexp_extract_all(text, '[0-9]')) * 100 > word_chars * 50
            OR len(regexp_extract_all(text, '!')) * 100 > n_words * 50
            OR len(regexp_extract_all(text, '\p{{Lu}}')) * 100
               > len(regexp_extract_all(text, '\p{{L}}')) * 60
            OR len(list_filter(words, lambda w, i: i > 1 AND w = words[i - 1])) * 100 > n_words * 30
           ) AS kept
FROM counts
"""

MIN_MAX_HASH = rf"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS words
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(words) < 4 THEN words ELSE words[i:i + 3] END AS shingle
    FROM docs, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS t(i)
    WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n
    HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reached AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
components AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id,
       documents.doc_id = component_id AS kept
FROM documents JOIN components USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

_NORMAL = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"

DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_NORMAL.format()} AS words FROM documents),
items AS (SELECT item_id, {_NORMAL.format()} AS words FROM benchmark),
spots AS (
    SELECT doc_id, i - 1 AS place, array_to_string(words[i:i + 4], ' ') AS shingle,
           len(words) - 4 AS n
    FROM docs, unnest(range(1, len(words) - 3)) AS t(i)),
item_spots AS (
    SELECT item_id, i - 1 AS place, array_to_string(words[i:i + 4], ' ') AS shingle,
           len(words) AS n_words
    FROM items, unnest(range(1, len(words) - 3)) AS t(i)),
aligned AS (
    SELECT DISTINCT doc_id, n_words, n, s.place - i.place AS begin
    FROM spots s JOIN item_spots i USING (shingle)),
-- Wherever a window holds as many shingles of an item as 80 % of similarity need, in any order.
held AS (
    SELECT DISTINCT doc_id, item_id, n_words, n, s.place
    FROM spots s JOIN item_spots i USING (shingle)),
often AS (
    SELECT doc_id, item_id, n_words, n FROM held GROUP BY ALL
    HAVING count(*) >= (n_words - 4) * 8 / 9.0 - 1e-9),
dense AS (
    SELECT doc_id, item_id, n_words, n, begin
    FROM held JOIN often USING (doc_id, item_id, n_words, n),
         unnest(range(place - (n_words - 4) + 1, place + 1)) AS t(begin)
    GROUP BY ALL HAVING count(*) >= (n_words - 4) * 8 / 9.0 - 1e-9),
windows AS (
    SELECT DISTINCT doc_id, n_words, n, greatest(0, least(begin, n - (n_words - 4))) AS start
    FROM (SELECT doc_id, n_words, n, begin FROM aligned
          UNION ALL SELECT doc_id, n_words, n, begin FROM dense)),
window_shingles AS (
    SELECT w.doc_id, start, n_words, shingle, count(*) AS times
    FROM windows w JOIN spots s
      ON s.doc_id = w.doc_id AND s.place >= start AND s.place < start + n_words - 4
    GROUP BY ALL),
window_sizes AS (
    SELECT doc_id, start, n_words, sum(times) AS size FROM window_shingles GROUP BY ALL),
item_shingles AS (SELECT item_id, shingle, count(*) AS times FROM item_spots GROUP BY ALL),
item_sizes AS (SELECT item_id, sum(times) AS size FROM item_shingles GROUP BY ALL),
shared AS (
    SELECT doc_id, start, n_words, item_id, sum(least(w.times, i.times)) AS common
    FROM window_shingles w JOIN item_shingles i USING (shingle) GROUP BY ALL),
compared AS (
    SELECT shared.*, w.size + i.size - common AS either
    FROM shared JOIN window_sizes w USING (doc_id, start, n_words) JOIN item_sizes i USING (item_id))
SELECT doc_id, item_id, (common / either)::DOUBLE AS similarity, start::BIGINT AS start,
       n_words::BIGINT AS n_words
FROM compared WHERE common * 100 >= either * 80
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id
    ORDER BY common / either DESC, start, n_words DESC) = 1
"""

# Vectors as lists of doubles, which hold these whole numbers and their products exactly.
_NEAREST = """
{assigned} AS (
    SELECT v.row_number, any_value(v.vec_id) AS vec_id, any_value(v.whole) AS whole,
           min({{'distance': list_inner_product(v.whole, v.whole)
                     - 2 * list_inner_product(v.whole, c.whole)
                     + list_inner_product(c.whole, c.whole),
                 'cluster': c.cluster}}) AS best
    FROM vectors v, {centroids} c
    GROUP BY v.row_number
)"""

_MOVED = """
{means} AS (
    SELECT cluster, list(mean ORDER BY place) AS whole
    FROM (
        SELECT cluster, place, floor(sum(x) / count(*)) AS mean
        FROM (
            SELECT best.cluster AS cluster, unnest(whole) AS x,
                   generate_subscripts(whole, 1) AS place
            FROM {assigned}
        )
        GROUP BY cluster, place
    )
    GROUP BY cluster
),
{moved} AS (
    SELECT c.cluster, coalesce(m.whole, c.whole) AS whole
    FROM {centroids} c LEFT JOIN {means} m USING (cluster)
)"""


def centroids(rounds: int = 3) -> str:
    parts = [
        """
vectors AS (
    SELECT row_number() OVER () AS row_number, vec_id,
           list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS whole
    FROM embeddings
    WHERE len(embedding) = 64
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
centroids_0 AS (
    SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), whole) - 1
               AS cluster, whole
    FROM vectors
    ORDER BY cluster LIMIT 16
)"""
    ]
    for n in range(rounds + 1):
        names = {
            "assigned": f"assigned_{n}", "centroids": f"centroids_{n}",
            "means": f"means_{n}", "moved": f"centroids_{n + 1}",
        }
        parts.append(_NEAREST.format(**names))
        if n < rounds:
            parts.append(_MOVED.format(**names))
    return (
        "WITH " + ",".join(parts) + f"""
SELECT a.vec_id, c.cluster::INTEGER AS cluster, best.distance::BIGINT AS distance,
       sum(best.distance) OVER (PARTITION BY c.cluster)::BIGINT AS cluster_inertia,
       sum(best.distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c.whole, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM assigned_{rounds} a JOIN centroids_{rounds} c ON c.cluster = a.best.cluster
"""
    )


CENTROIDS = centroids()
