"""DuckDB SQL for the registered queries that SQL can express.

The others are tested against brute force: op1 hashes n-grams with a function
that DuckDB lacks; op2, op5 and op6 are trained models; op3 and op8 schedule
items one after another; op7's components would need all pairs; op12's damage needs
CRC32 and op13 XXH64, which DuckDB lacks.
"""

_SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4 = f"""
WITH sized AS (
  SELECT doc_id, source, len({_SPACE_WORDS})::BIGINT AS size,
         substr(md5(concat_ws(chr(1), '17', coalesce(doc_id::VARCHAR, chr(2)), coalesce(md5(text), chr(2)))), 1, 15) AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w
  FROM sources
), filled AS (
  -- sources fill up in the order of their room per weight; a level holds for those not yet full
  SELECT *, 2.0::DOUBLE * source_size / w AS full_at, row_number() OVER o AS k,
         (sum(source_size) OVER () * 1.5::DOUBLE - 2.0::DOUBLE * (sum(source_size) OVER o - source_size))
         / (sum(w) OVER () - (sum(w) OVER o - w)) AS level
  FROM ranked WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)
), found AS (
  SELECT min_by(level, k) AS level FROM filled WHERE full_at > level
), goal AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(w * f.level, 2.0::DOUBLE * source_size)) AS target
  FROM ranked, found f
), placed AS (
  SELECT s.*, g.source_size, g.target,
         (sum(size) OVER (PARTITION BY s.source ORDER BY key, s.doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before,
         CASE WHEN g.source_size > 0 THEN floor(floor(g.target) / g.source_size) ELSE 0 END::BIGINT AS epochs
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM placed
"""

OP9 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS pos, w FROM words WHERE len(w) >= 20
), windows AS (
  SELECT doc_id, pos, array_to_string(w[pos:pos + 19], ' ') AS win FROM starts
), later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM windows
  ) WHERE k > 1
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(pos, pos + 20)))) AS places FROM later GROUP BY doc_id
), kept AS (
  SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
         CASE WHEN places IS NULL THEN w ELSE
           list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(places, i)), lambda i: w[i]) END AS left_over
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(left_over, ' ')) AS kept_sha256 FROM kept
"""

_NORMAL = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP10 = f"""
WITH items AS (
  SELECT item_id, {_NORMAL} AS w FROM benchmark
), cut AS (
  SELECT item_id, w, least(len(w), 10) AS size FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[pos:pos + size - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS pos FROM cut)
), docs AS (
  SELECT doc_id, {_NORMAL} AS w FROM documents
), spots AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos
  FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size
), hits AS (
  SELECT s.doc_id, s.pos, s.size, i.item_id
  FROM (SELECT doc_id, pos, size, array_to_string(w[pos:pos + size - 1], ' ') AS win FROM spots) s
  JOIN windows i ON s.win = i.win AND s.size = i.size
), marks AS (
  SELECT doc_id, len(list_distinct(flatten(list(range(pos, pos + size)))))::BIGINT AS n_hit,
         list_sort(list_distinct(list(item_id::VARCHAR))) AS items
  FROM hits GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN marks m ON d.doc_id = m.doc_id
"""



def _kmeans_sql(rounds: int = 10, k: int = 8, dim: int = 64) -> str:
    """Plain k-means: every vector against every centroid in each round, sums by component."""
    parts = [
        f"""
vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), centroids0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v AS w
  FROM vectors ORDER BY sha256('3:' || vec_id), v LIMIT {k}
)"""
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""
assigned{i} AS MATERIALIZED (
  SELECT row_id, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM (
    SELECT row_id, c, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
    FROM vectors, centroids{i}
  ) GROUP BY row_id
)"""
        )
        if i < rounds:
            parts.append(
                f"""
sums{i} AS MATERIALIZED (
  SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM (
    SELECT c, unnest(range(1, {dim} + 1)) AS j, unnest(v) AS x FROM assigned{i} JOIN vectors USING (row_id)
  ) GROUP BY c, j
), means{i} AS MATERIALIZED (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM sums{i} GROUP BY c
), centroids{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(m, w) AS w FROM centroids{i} LEFT JOIN means{i} USING (c)
)"""
            )
    return (
        "WITH"
        + ",".join(parts)
        + f"""
SELECT vec_id, c::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM assigned{rounds} JOIN vectors USING (row_id) JOIN centroids{rounds} USING (c)
"""
    )


OP11 = _kmeans_sql()

ORACLE = {"op4_mixing": OP4, "op9_substring": OP9, "op10_decontaminate": OP10, "op11_shallot": OP11}
