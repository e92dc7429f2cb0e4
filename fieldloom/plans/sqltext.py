"""Building blocks of the catalog's SQL: the tokenizer, BM25, and constants as SQL text."""

from __future__ import annotations

from fieldloom.config import BM25_B, BM25_K1, FIELD_WEIGHTS

WEIGHT = "CASE field " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in FIELD_WEIGHTS.items()) + " ELSE 1.0 END"

def codes_of(keys: str, text: str, source: str) -> str:
    """Query (keys, code): the fault codes named in a relation's texts, each once. The engine has no look-around: separators are doubled, so that
    one match doesn't take the next one's, and a code that a letter follows is cut back to before its last hyphen."""
    sep = f"regexp_replace({text}, '([^\\p{{L}}\\p{{N}}_-])', '\\1\\1', 'g')"
    found = f"SELECT {keys}, unnest(regexp_extract_all({sep}, '(?:^|[^\\p{{L}}\\p{{N}}_])([A-Za-z][0-9]{{3,}}[A-Za-z0-9_-]*(?:[^A-Za-z0-9_-]|$))', 1)) AS t FROM {source}"
    cut = "CASE WHEN regexp_matches(right(t, 1), '[\\p{L}\\p{N}_]') AND NOT regexp_matches(right(t, 1), '[A-Za-z0-9_]') THEN regexp_extract(t, '^(.*)-[^-]*$', 1) ELSE regexp_replace(t, '[^A-Za-z0-9_-]$', '') END"
    return f"SELECT DISTINCT {keys}, upper(code) AS code FROM (SELECT {keys}, {cut} AS code FROM ({found})) WHERE regexp_matches(code, '^[A-Za-z][0-9]{{3,}}')"


def CLEAN(c: str) -> str:  # noqa: N802
    """A trimmed text, empty for null."""
    return f"coalesce(regexp_replace({c}, '^[\\s\\x{{A0}}\\x{{3000}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}]+|[\\s\\x{{A0}}\\x{{3000}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}]+$', '', 'g'), '')"


def token_ctes(source: str, keys: str, text: str, name: str = "tok") -> str:
    """CTEs ending in {name}({keys}, term): all token occurrences of a relation's text column."""
    return f"""
 {name}_low AS (SELECT {keys}, lower(translate(replace(replace(replace(coalesce({text}, ''), '﻿', ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '：', ':')) AS t FROM {source}),
 {name}_w AS (SELECT {keys}, regexp_replace(unnest(regexp_extract_all(t, '[A-Za-z0-9][A-Za-z0-9_.-]*')), '^[._-]+|[._-]+$', '', 'g') AS term FROM {name}_low),
 {name}_r AS (SELECT {keys}, unnest(regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fff}}]+')) AS r FROM {name}_low),
 {name}_2 AS (SELECT {keys}, substr(r, i::INT, 2) AS term FROM (SELECT *, unnest(range(1, length(r))) AS i FROM {name}_r)),
 {name}_3 AS (SELECT {keys}, substr(r, i::INT, 3) AS term FROM (SELECT *, unnest(range(1, length(r) - 1)) AS i FROM {name}_r)),
 {name} AS (SELECT * FROM {name}_w WHERE term <> '' UNION ALL SELECT {keys}, r FROM {name}_r WHERE length(r) <= 12 UNION ALL SELECT * FROM {name}_2 UNION ALL SELECT * FROM {name}_3)"""


def field_ctes(docs: str = "index_documents") -> str:
    """CTEs flds(doc_id, doc_type, field, txt), post(..., tf), flen(..., field_length), avgl(field, avg_len)."""
    return f"""
 flds AS (SELECT doc_id, doc_type, unnest(map_keys(fields)) AS field, unnest(map_values(fields)) AS txt FROM {docs}),
 {token_ctes("flds", "doc_id, doc_type, field", "txt")},
 post AS (SELECT doc_id, doc_type, field, term, count(*) AS tf FROM tok GROUP BY ALL),
 tlen AS (SELECT doc_id, field, count(*) AS n FROM tok GROUP BY ALL),
 flen AS (SELECT f.doc_id, f.doc_type, f.field, coalesce(n, 0) AS field_length FROM flds f LEFT JOIN tlen t ON t.doc_id = f.doc_id AND t.field = f.field),
 avgl AS (SELECT field, greatest(avg(greatest(field_length, 1)), 1) AS avg_len FROM flen GROUP BY field)"""


def question_ctes(source: str) -> str:
    """CTEs asked(query_id, query), terms(query_id, term); without the cap of terms, which short questions don't reach."""
    return f"""
 asked AS ({source}),
 {token_ctes("asked", "query_id", "query", "qt")},
 terms AS (SELECT DISTINCT query_id, term FROM qt)"""


def bm25_ctes(doc_type: str, name: str = "bm", docs: str = "index_documents") -> str:
    """CTEs {name}_m with a row per match, {name}(query_id, doc_id, raw)."""
    return f"""
 {name}_n AS (SELECT greatest(count(*), 1) AS n FROM {docs} WHERE doc_type = '{doc_type}'),
 {name}_df AS (SELECT term, count(DISTINCT doc_id) AS df FROM post WHERE doc_type = '{doc_type}' GROUP BY term),
 {name}_m AS (SELECT q.query_id, p.doc_id, p.term, p.field, p.tf, {WEIGHT.replace("field ", "p.field ", 1)} AS w,
   ({WEIGHT.replace("field ", "p.field ", 1)}) * ln(1 + (n - df + 0.5) / (df + 0.5)) * p.tf * ({BM25_K1} + 1)
   / (p.tf + {BM25_K1} * (1 - {BM25_B} + {BM25_B} * greatest(l.field_length, 1) / coalesce(a.avg_len, 1))) AS part
   FROM post p JOIN terms q ON q.term = p.term JOIN {name}_df d ON d.term = p.term JOIN flen l ON l.doc_id = p.doc_id AND l.field = p.field
   LEFT JOIN avgl a ON a.field = p.field CROSS JOIN {name}_n WHERE p.doc_type = '{doc_type}'),
 {name} AS (SELECT query_id, doc_id, sum(part) AS raw FROM {name}_m GROUP BY ALL)"""


def cut_ctes(hits: str, name: str, least: float, most: int) -> str:
    """CTE {name}(query_id, doc_id, score, rank) from hits(query_id, doc_id, score)."""
    return f"""
 {name}_t AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM {hits}),
 {name} AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}_t WHERE top > 0 AND score >= top * {least}) WHERE rank <= {most})"""


def top_ctes(raw: str, name: str, k: int) -> str:
    return f"""
 {name} AS (SELECT query_id, doc_id, round(raw, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, doc_id) AS rank FROM {raw}) WHERE rank <= {k})"""
