"""SQL for those pN_ queries that SQL can express over whole tables."""

from __future__ import annotations

P2_FOUND = """
WITH c AS (SELECT card_id, any_value(media_id) AS m, any_value(CAST(round(shown_s * 1000000) AS BIGINT)) AS t FROM cards
           WHERE card_id IS NOT NULL AND media_id IS NOT NULL AND shown_s IS NOT NULL GROUP BY card_id),
     s AS (SELECT media_id AS m, CAST(round(from_s * 1000000) AS BIGINT) AS t, min(segment_id) AS id FROM segments
           WHERE segment_id IS NOT NULL AND media_id IS NOT NULL AND from_s IS NOT NULL GROUP BY 1, 2),
     j AS (SELECT card_id, id, abs(c.t - s.t) AS d, row_number() OVER (PARTITION BY card_id ORDER BY abs(c.t - s.t), s.t, id) AS r
           FROM c JOIN s ON c.m = s.m AND s.t BETWEEN c.t - 1000000 AND c.t + 1000000)
SELECT card_id, id AS segment_id FROM j WHERE r = 1
"""

P3_FOUND = r"""
WITH lim AS (SELECT limit_key, max_size FROM size_limits),
     u AS (SELECT DISTINCT 'results' AS unit_kind, result_id AS unit_id, text FROM results WHERE text IS NOT NULL
           UNION ALL SELECT DISTINCT 'chunks', chunk_id, text FROM chunks WHERE text IS NOT NULL),
     l AS (SELECT unit_kind, unit_id, text, max_size FROM u JOIN lim ON limit_key = unit_kind WHERE length(text) > max_size)
SELECT unit_kind, unit_id,
       CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[\s\p{Z}.!?。！？]'), lambda x: length(x))) > max_size
            THEN 'forced' ELSE 'natural' END AS cut_kind
FROM l
"""

P6_FOUND = """
SELECT doc_id FROM documents
WHERE strlen(text) > (SELECT max_size FROM size_limits WHERE limit_key = 'container')
"""

P7_FOUND = """
WITH d AS (SELECT replace(replace(lower(trim(source)), '-', ''), '_', '') AS k, strlen(text) AS n FROM documents WHERE text IS NOT NULL),
     t AS (SELECT source_key, replace(replace(lower(trim(source_key)), '-', ''), '_', '') AS k, target_share, max_repeats FROM mix_targets),
     s AS (SELECT t.source_key, t.target_share, t.max_repeats, coalesce(sum(d.n), 0) AS n FROM t LEFT JOIN d ON d.k = t.k GROUP BY ALL)
SELECT source_key FROM s WHERE n * max_repeats < target_share * (SELECT sum(n) FROM s)
"""

# What every right result has, whichever of several it is.
P1_COVER = r"""
WITH r AS (SELECT result_id, text, coalesce(punct_mode = 'none', false) AS bare, coalesce(diarized, false) AS diarized FROM results),
     u AS (SELECT 'results' AS unit_kind, result_id AS unit_id, text FROM r WHERE NOT bare
           UNION ALL SELECT 'segments', segment_id, content FROM segments WHERE result_id IS NULL OR result_id NOT IN (SELECT result_id FROM r WHERE bare OR diarized)),
     e AS (SELECT unit_kind, unit_id, length(regexp_replace(text, '[\s\p{Z}\x0b\x1c-\x1f\x{85}]+$', '')) AS n FROM u WHERE text IS NOT NULL)
SELECT unit_kind, unit_id, CAST(max(n) AS INTEGER) AS last_end, true AS ascends FROM e WHERE n > 0 GROUP BY 1, 2
"""

P3_WHOLE = """
WITH u AS (SELECT DISTINCT 'results' AS unit_kind, result_id AS unit_id, text FROM results UNION SELECT 'chunks', chunk_id, text FROM chunks)
SELECT unit_kind, unit_id, md5(text) AS text_md5, true AS all_within FROM u JOIN size_limits ON limit_key = unit_kind WHERE length(text) > max_size
"""

P6_PLACED = """
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_tokens, strlen(text) > (SELECT max_size FROM size_limits WHERE limit_key = 'container') AS is_split
FROM documents WHERE text <> ''
"""

P6_FIT = "SELECT CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS n_tokens, CAST(0 AS BIGINT) AS n_over, true AS is_tight FROM documents"

# Apportionment in its other form: the seats go to the highest quotients of all that a source may take.
P7_QUOTAS = """
WITH d AS (SELECT replace(replace(lower(trim(source)), '-', ''), '_', '') AS k, strlen(text) AS n FROM documents WHERE text IS NOT NULL),
     t AS (SELECT source_key, replace(replace(lower(trim(source_key)), '-', ''), '_', '') AS k, target_share, max_repeats FROM mix_targets),
     s AS (SELECT t.source_key, t.k, t.target_share, t.max_repeats, CAST(coalesce(sum(d.n), 0) AS BIGINT) AS n FROM t LEFT JOIN d ON d.k = t.k GROUP BY ALL),
     a AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM s),
     b AS (SELECT total, greatest(1, total // greatest(1, least(1000000, greatest(10000, total // 1048576)))) AS block FROM a),
     c AS (SELECT s.*, b.*, n * max_repeats AS room, least(total // block, (n * max_repeats + block - 1) // block) AS most FROM s, b),
     w AS (SELECT k, row_number() OVER (ORDER BY target_share / (2 * i + 1) DESC, k) AS place, total // block AS seats FROM (SELECT *, unnest(range(most)) AS i FROM c WHERE target_share > 0)),
     g AS (SELECT k, count(*) AS won FROM w WHERE place <= seats GROUP BY 1)
SELECT source_key, target_share, max_repeats, n AS source_tokens, room < target_share * total AS is_short, CAST(least(room, coalesce(won, 0) * block) AS BIGINT) AS quota_tokens
FROM c LEFT JOIN g ON c.k = g.k
"""


def oracle_sql() -> dict[str, str]:
    return {n.lower(): sql for n, sql in globals().items() if n[0] == "P" and n[1:2].isdigit()}
