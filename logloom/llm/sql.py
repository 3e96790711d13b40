"""SQL for the queries that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

from logloom.llm.decontaminate import WINDOW
from logloom.llm.quality import RULES, STOP_WORDS

WORD = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def rule(metric: str, low: float | None, high: float | None, words: int) -> str:
    inside = " AND ".join([*([f"{metric} >= {low}"] if low is not None else []), *([f"{metric} <= {high}"] if high is not None else [])])
    return f"(({inside}) OR n_words < {words})"


QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i + 1:i + 5], ' ') AS v FROM (SELECT rid, ws, unnest(range(0, len(ws) - 4)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, v) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  len(regexp_extract_all(t, '\\p{{Lu}}{{2,}}')) / greatest(len(ws), 1) AS shouted_ratio,
  len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) / greatest(len(ws), 1) AS stop_ratio, len(ls) AS n_lines
  FROM w LEFT JOIN rep USING (rid)),
r AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbol_ratio,
  n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_repeat_words / greatest(n_words, 1) AS repeat_ratio,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(rule(*r[1:]) for r in RULES)} AS kept FROM r
"""

DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWERED}, '{PLAIN}') AS ws FROM documents),
it AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED}, '{PLAIN}') AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item, n, array_to_string(ws[i + 1:i + n], ' ') AS v FROM (SELECT item, ws, least({WINDOW}, len(ws)) AS n, unnest(range(0, len(ws) - least({WINDOW}, len(ws)) + 1)) AS i FROM it WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, n, i, array_to_string(ws[i + 1:i + n], ' ') AS v FROM (SELECT rid, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM d, sizes)),
hit AS (SELECT dw.rid, dw.i, dw.n, iw.item FROM dw JOIN iw USING (n, v)),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

ORACLES = {"op5_quality": QUALITY, "op10_decontaminate": DECONTAMINATE}
