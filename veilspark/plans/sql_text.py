"""SQL twins of the span operators, as common table expressions."""
from __future__ import annotations

from veilspark.functions import patterns as P


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def entropy_sql(token: str) -> str:
    share = f"((length({token}) - length(replace({token}, ch, ''))) / length({token})::DOUBLE)"
    chars = f"list_sort(list_distinct(regexp_extract_all({token}, '(?s).')))"
    return f"-list_sum(list_transform({chars}, lambda ch: {share} * log2({share})))"


def category_sql(category: str, source: str) -> str:
    """(doc_id, category, priority, value, start, end) of one category over a table (doc_id, text)."""
    names = [name for name, _ in P.DETECTOR_PATTERNS] + [P.ENTROPY_CATEGORY]
    pattern = dict(P.DETECTOR_PATTERNS).get(category, P.ENTROPY_TOKEN)
    regex = quote(P.sql_pattern(pattern))
    spans = f"""
SELECT doc_id, '{category}' AS category, {names.index(category)} AS priority, value,
       (sum(length(gap) + length(value)) OVER (PARTITION BY doc_id ORDER BY i) - length(value))::INT AS start,
       (sum(length(gap) + length(value)) OVER (PARTITION BY doc_id ORDER BY i))::INT AS "end"
FROM (SELECT doc_id, unnest(m) AS value, unnest(list_slice(g, 1, len(m))) AS gap, unnest(range(len(m))) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, {regex}) AS m, string_split_regex(text, {regex}) AS g
            FROM {source} WHERE regexp_matches(text, {regex})))"""
    if category == P.ENTROPY_CATEGORY:
        spans = f"SELECT * FROM ({spans}) WHERE round({entropy_sql('value')}, 9) >= {P.ENTROPY_MIN_BITS}"
    return spans


def detections_cte(source: str) -> str:
    """CTEs up to `detections`; `source` is a table (doc_id, text)."""
    names = [name for name, _ in P.DETECTOR_PATTERNS] + [P.ENTROPY_CATEGORY]
    union = "\nUNION ALL\n".join(category_sql(name, source) for name in names)
    return f"""
all_spans AS ({union}),
detections AS (
  SELECT doc_id, category, priority, value, start, "end" FROM all_spans
  QUALIFY row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY priority) = 1)"""


def merged_cte(source: str) -> str:
    """CTEs up to `merged`: (doc_id, category, start, end), disjoint."""
    return detections_cte(source) + """,
marked_heads AS (
  SELECT *, CASE WHEN start >= coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, priority
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS head FROM detections),
islands AS (
  SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, priority ROWS UNBOUNDED PRECEDING) AS island
  FROM marked_heads),
merged AS (
  SELECT doc_id, first(category ORDER BY start, "end" DESC, priority) AS category, min(start) AS start, max("end") AS "end"
  FROM islands GROUP BY doc_id, island)"""


def marks_cte(source: str, number: str | None = None) -> str:
    """CTEs up to `marks`: merged spans with original text and placeholder."""
    number = number or "row_number() OVER (PARTITION BY doc_id, category ORDER BY start)"
    return merged_cte(source) + f""",
originals AS (
  SELECT m.doc_id, m.category, m.start, m."end", substring(s.text, m.start + 1, m."end" - m.start) AS original
  FROM merged m JOIN {source} s ON m.doc_id = s.doc_id),
marks AS (
  SELECT doc_id, category, original, start, "end", '__' || category || '_' || ({number})::VARCHAR || '__' AS placeholder
  FROM originals)"""


def sanitized_cte(source: str) -> str:
    """CTEs up to `sanitized`: (doc_id, sanitized_text, redaction_count) for every row of the source."""
    return marks_cte(source) + f""",
pieces AS (
  SELECT m.doc_id, m.start, m."end", m.placeholder,
         substring(s.text, lag(m."end", 1, 0) OVER (PARTITION BY m.doc_id ORDER BY m.start) + 1,
                   m.start - lag(m."end", 1, 0) OVER (PARTITION BY m.doc_id ORDER BY m.start)) AS before
  FROM marks m JOIN {source} s ON m.doc_id = s.doc_id),
rebuilt AS (
  SELECT doc_id, string_agg(before || placeholder, '' ORDER BY start) AS head, max("end") AS last, count(*)::INT AS n
  FROM pieces GROUP BY doc_id),
sanitized AS (
  SELECT s.doc_id, CASE WHEN r.doc_id IS NULL THEN s.text ELSE r.head || substring(s.text, r.last + 1) END AS sanitized_text,
         coalesce(r.n, 0)::INT AS redaction_count
  FROM {source} s LEFT JOIN rebuilt r ON s.doc_id = r.doc_id)"""


def rules_sql(rules, source: str, key: str = "doc_id") -> str:
    """(key, rule) of every rule that matches."""
    return "\nUNION ALL\n".join(
        f"SELECT {key}, '{name}' AS rule FROM {source} WHERE regexp_matches(text, {quote(P.sql_pattern(pattern, True))})"
        for name, pattern, _ in rules
    )


def any_rule_sql(rules, text: str = "text") -> str:
    return "(" + " OR ".join(
        f"regexp_matches({text}, {quote(P.sql_pattern(pattern, True))})" for _, pattern, _ in rules
    ) + ")"
