"""The DuckDB SQL of operator 12, from the same ladders of cutoffs."""

from __future__ import annotations

from quirelight.llm.quality_rules import ERROR, LADDERS, RISK


def _step(rule: str) -> str:
    over, under, side, cutoffs = LADDERS[rule]
    sign = ">" if side == "above" else "<"
    broken = " + ".join(f"CASE WHEN 100 * {over} {sign} {t} * {under} THEN 1 ELSE 0 END" for t in cutoffs)
    return f"{len(cutoffs) + 1} - ({broken})"


def _steps() -> str:
    return " UNION ALL ".join(f"SELECT row, '{rule}' AS rule, {len(v[3])} AS last, {_step(rule)} AS step FROM m" for rule, v in LADDERS.items())


SQL = rf"""
WITH w AS (
  SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
places AS (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2),
windows AS (SELECT row, i, count(*) OVER (PARTITION BY row, words[i], words[i + 1], words[i + 2]) AS found FROM places),
covered AS (SELECT row, unnest([i, i + 1, i + 2]) AS place FROM windows WHERE found > 1),
repeated AS (SELECT row, count(DISTINCT place) AS n_repeat_words FROM covered GROUP BY row),
counts AS (
  SELECT row, doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN repeated USING (row)
),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
steps AS ({_steps()}),
told AS (SELECT doc_id FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = 1),
good AS (SELECT lang, rule, last, step FROM m JOIN told USING (doc_id) JOIN steps USING (row) WHERE NOT base_failed),
ladders AS (SELECT lang, rule, last, count(*) AS n, list(step) AS seen FROM good GROUP BY ALL),
climbed AS (
  SELECT lang, rule, n, step, len(list_filter(seen, lambda s: s <= step)) AS r
  FROM (SELECT *, unnest(range(1, last + 1)) AS step FROM ladders)
),
tested AS (
  SELECT lang, rule, step, list_sum(list_transform(range(0, r + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
         + k * ln({RISK / len(LADDERS)}) + (n - k) * ln({1 - RISK / len(LADDERS)})))) AS p
  FROM climbed
),
chosen AS (SELECT lang, rule, max(step) AS cut FROM tested WHERE p <= {ERROR} / (SELECT count(*) FROM ladders) GROUP BY lang, rule),
rejected AS (
  SELECT m.row, min(CASE s.rule {" ".join(f"WHEN '{rule}' THEN {i}" for i, rule in enumerate(LADDERS))} END) AS first
  FROM m JOIN chosen c ON m.lang IS NOT DISTINCT FROM c.lang JOIN steps s ON s.row = m.row AND s.rule = c.rule
  WHERE s.step <= c.cut GROUP BY m.row
)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN 'base' ELSE [{", ".join(f"'{rule}'" for rule in LADDERS)}][first + 1] END AS failed,
       NOT base_failed AND first IS NULL AS kept
FROM m LEFT JOIN rejected USING (row)
"""
