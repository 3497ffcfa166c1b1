"""The DuckDB SQL of operator 13, for vectors of one length that 16 divides."""

from __future__ import annotations


def _assigned(book: str) -> str:
    """Each part with its nearest entry of ``book`` and the squared distance."""
    return f"""
  SELECT vec_id, label, part, v, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d
  FROM (SELECT p.*, b.entry, list_sum(list_transform(range(1, len(p.v) + 1), lambda j: (p.v[j] - b.v[j]) * (p.v[j] - b.v[j])))::BIGINT AS d
        FROM parts p JOIN {book} b USING (part))
  GROUP BY vec_id, label, part, v"""


def _improved(book: str, assigned: str) -> str:
    """Entries replaced by the floor of the mean of their parts; unused ones stay."""
    return f"""
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v
  FROM {book} b LEFT JOIN (
    SELECT part, entry, list(mean ORDER BY j) AS v
    FROM (SELECT part, entry, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS mean
          FROM (SELECT part, entry, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS j FROM {assigned}) GROUP BY ALL)
    GROUP BY part, entry
  ) m USING (part, entry)"""


SQL = f"""
WITH rows AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
parts AS (SELECT vec_id, label, part, x[part * len(x) // 16 + 1 : (part + 1) * len(x) // 16] AS v FROM (SELECT *, unnest(range(16)) AS part FROM rows)),
book0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM parts WHERE vec_id IN (SELECT vec_id FROM rows ORDER BY vec_id LIMIT 64)),
round1 AS ({_assigned("book0")}),
book1 AS ({_improved("book0", "round1")}),
round2 AS ({_assigned("book1")}),
book2 AS ({_improved("book1", "round2")}),
final AS ({_assigned("book2")}),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM final GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, digest
"""
