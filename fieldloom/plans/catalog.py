"""Named queries of the core, and their SQL."""

from __future__ import annotations

from fieldloom.operators import multivalue, quarantine

_FIELD = '(?:"[^"]*(?:""[^"]*)*"|[^",]*)'
_P2 = f"""
 f AS (SELECT *, CASE WHEN regexp_full_match(line, '(?s){_FIELD}(?:,{_FIELD})*') THEN list_transform(regexp_extract_all(',' || line, '(?s),({_FIELD})', 1),
   lambda x: CASE WHEN x[1] = '"' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) END AS f FROM parse_log),
 p2 AS (SELECT *, CASE WHEN line IS NULL THEN 'column_count' WHEN f IS NULL THEN 'quoting' WHEN len(f) <> 8 THEN 'column_count'
   WHEN f[2] NOT IN ('parsed', 'failed') OR NOT regexp_full_match(f[5], '[0-9]+')
     OR f[6] <> '' AND len(list_filter(string_split(f[6], '|'), lambda w: w NOT IN ('missing_reported_issue', 'missing_solution', 'parts_section_without_structured_parts', 'missing_work_order_id'))) > 0
     OR NOT regexp_full_match(f[8], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]') OR try_cast(f[8] AS TIMESTAMP) IS NULL
   THEN 'invalid_value' END AS reason FROM f)
"""

QUERIES = {
    "p2_found": quarantine.p2_found,
    "p2_valid": quarantine.p2_valid,
    "p2_rates": quarantine.p2_rates,
    "p6_found": multivalue.p6_found,
}

SQL = {
    "p2_found": f"WITH {_P2} SELECT raw_id, reason FROM p2 WHERE reason IS NOT NULL",
    "p2_valid": f"""WITH {_P2} SELECT raw_id, f[1] AS input_path, f[2] AS status, nullif(f[3], '') AS error, nullif(f[4], '') AS work_order_id, try_cast(f[5] AS BIGINT) AS part_count, f[5] AS part_count_text,
        f[6] AS parse_warnings, nullif(f[7], '') AS encoding, f[8]::TIMESTAMP AS finished_at FROM p2 WHERE reason IS NULL""",
    "p2_rates": f"""WITH {_P2} SELECT log_file, count(*) AS lines, count_if(reason = 'quoting') AS quoting, count_if(reason = 'column_count') AS column_count,
        count_if(reason = 'invalid_value') AS invalid_value FROM p2 GROUP BY log_file""",
}

from fieldloom.plans import search  # noqa: E402

QUERIES |= search.QUERIES
SQL |= search.SQL

from fieldloom.plans import upkeep  # noqa: E402

QUERIES |= upkeep.QUERIES
SQL |= upkeep.SQL

from fieldloom.plans import records  # noqa: E402

QUERIES |= records.QUERIES
SQL |= records.SQL
