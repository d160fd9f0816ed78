"""SQL twins of the queries that SQL can express (DuckDB dialect)."""
from __future__ import annotations

from veilspark.llm import rules as R
from veilspark.llm.decontaminate import WINDOW


def _quoted(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in sorted(values)) + ")"


_WORD = r"'[^\x20\x09-\x0D]+'"
_RULES = R.Rules()

QUALITY_RULES = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
numbered AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM docs),
lines AS (SELECT doc_id, i, line, regexp_extract_all(line, {_WORD}) AS ws FROM numbered),
judged AS (
  SELECT doc_id, len(ws) AS n, list_sum(list_transform(ws, lambda w: length(w))) AS chars,
         row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again,
         len(list_filter(ws, lambda w: w IN {_quoted(R._SEPARATORS)})) > {_RULES.max_separator_words}::DOUBLE * len(ws)
         OR len(list_filter(ws, lambda w: regexp_matches(w, '[#*$%&|<>]{{2,}}$'))) > {_RULES.max_symbol_words}::DOUBLE * len(ws)
         OR len(list_filter(ws, lambda w: ends_with(w, '!!'))) > {_RULES.max_shouted}::DOUBLE * len(ws)
         OR (len(ws) <= {_RULES.max_boilerplate_words} AND regexp_matches(line, '(?i){R.BOILERPLATE.pattern}'))
         OR (len(ws) < {_RULES.min_words_unended} AND right(ws[-1], 1) NOT IN {_quoted(R.ENDS)}) AS fails
  FROM lines WHERE len(ws) > 0),
summed AS (
  SELECT doc_id, sum(n)::BIGINT AS n_words, sum(chars)::BIGINT AS word_chars, count_if(again) AS n_dup_lines,
         count_if(NOT fails) AS lines_kept, count_if(fails) AS lines_lost,
         coalesce(sum(chars) FILTER (fails), 0)::DOUBLE / sum(chars)::DOUBLE AS lost_share
  FROM judged GROUP BY doc_id),
words AS (
  SELECT doc_id, unnest(regexp_extract_all(text, {_WORD})) AS w, unnest(range(len(regexp_extract_all(text, {_WORD})))) AS p FROM docs),
windows AS (
  SELECT doc_id, p, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
twice AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS c FROM windows WHERE w3 IS NOT NULL),
repeated AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 3)) AS q FROM twice WHERE c > 1) GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lines_kept, 0)::BIGINT AS lines_kept, coalesce(lines_lost, 0)::BIGINT AS lines_lost,
         coalesce(lost_share, 0)::DOUBLE AS lost_share
  FROM docs d LEFT JOIN summed s ON d.doc_id = s.doc_id LEFT JOIN repeated r ON d.doc_id = r.doc_id)
SELECT *, n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words AS base_failed,
       NOT (n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words) AND lost_share <= {_RULES.max_lost} AS kept
FROM counted"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _alnum(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


DECONTAMINATION = f"""
WITH items AS (SELECT item_id, ws, least({WINDOW}, len(ws)) AS size FROM (SELECT item_id, {_alnum('text')} AS ws FROM benchmark) WHERE len(ws) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM items)),
docs AS (SELECT doc_id, {_alnum('text')} AS ws FROM documents),
scanned AS (
  SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS k
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM items) WHERE len(ws) >= size)),
hits AS (SELECT s.doc_id, s.i, s.size, w.item_id FROM scanned s JOIN windows w ON s.k = w.k AND s.size = w.size),
found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN found f ON d.doc_id = f.doc_id LEFT JOIN hit_words h ON d.doc_id = h.doc_id"""
