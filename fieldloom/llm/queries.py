"""The package's queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from fieldloom.llm import abuse, confusables, enrichment, markup, mixing, mojibake, neardup, pagediff, tokenize

QUERIES = {
    "p1_found": neardup.p1_found,
    "p1_groups": neardup.p1_groups,
    "p3_found": markup.p3_found,
    "p3_clean": markup.p3_clean,
    "p3_differenced": pagediff.p3_differenced,
    "p4_found": mojibake.p4_found,
    "p4_restored": mojibake.p4_restored,
    "p5_found": confusables.p5_found,
    "p5_groups": confusables.p5_groups,
    "p7_found": enrichment.p7_found,
    "p7_scores": enrichment.p7_scores,
    "p8_ids": tokenize.p8_ids,
    "p9_mixture": mixing.p9_mixture,
    "p9_shares": mixing.p9_shares,
    "p10_found": abuse.p10_found,
    "p10_scores": abuse.p10_scores,
    "p10_rates": abuse.p10_rates,
}

_P1 = """
WITH k AS (SELECT record_id, regexp_replace(lower(reported_issue || solution), '[^\\p{L}\\p{N}]', '', 'g') AS key FROM work_orders),
 texts AS (SELECT key, row_number() OVER (ORDER BY key) AS t FROM (SELECT DISTINCT key FROM k WHERE length(key) >= 60)),
 g AS (SELECT DISTINCT t, substr(key, i::INT, 3) AS g FROM (SELECT t, key, unnest(range(1, length(key) - 1)) AS i FROM texts)),
 n AS (SELECT t, count(*) AS n FROM g GROUP BY t),
 o AS (SELECT a.t AS ta, b.t AS tb, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.t < b.t GROUP BY 1, 2),
 p AS (SELECT ta, tb FROM o JOIN n x ON x.t = ta JOIN n y ON y.t = tb WHERE o >= 0.6 * (x.n + y.n - o) UNION ALL SELECT t, t FROM texts),
 m AS (SELECT record_id, t FROM k JOIN texts USING (key))
SELECT DISTINCT least(a.record_id, b.record_id) AS record_id_a, greatest(a.record_id, b.record_id) AS record_id_b
FROM p JOIN m a ON a.t = ta JOIN m b ON b.t = tb WHERE a.record_id <> b.record_id
"""
_TERMS = """
 low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM index_documents WHERE text IS NOT NULL),
 words AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '[a-z0-9][a-z0-9_.-]*')), '[._-]+$', '') AS term FROM low),
 runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]{2,}')) AS run FROM low),
 grams AS (SELECT doc_id, substr(run, i::INT, 2) AS term FROM (SELECT doc_id, run, unnest(range(1, length(run))) AS i FROM runs)),
 post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT * FROM words UNION ALL SELECT * FROM grams) GROUP BY ALL),
 stats AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY term)
"""

SQL = {
    "p1_found": _P1,
    "p7_found": f"WITH {_TERMS} SELECT doc_id, term FROM post JOIN stats USING (term) WHERE tf >= 2 AND df BETWEEN 2 AND 5",
}
