"""Queries of the core's data quality operators."""

from __future__ import annotations

from ..operators import orphans
from ..sources.tables import table
from .registry import Registry

REG = Registry()

_KEY = r"regexp_replace(lower(regexp_replace(replace(trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '\', '/'), '^[./]+', '')), '\.md$', '')"
_MISSES = f"""
WITH feed AS (
  SELECT {_KEY.format('path')} AS key, upper(trim(status)) AS status, changed_at, arrived_at, change_id FROM changes WHERE path IS NOT NULL),
fate AS (
  SELECT key, min(CASE WHEN status = 'A' THEN changed_at END) AS added,
         arg_max(status, (changed_at, arrived_at, change_id)) AS last
  FROM feed WHERE key <> '' GROUP BY key),
known AS (SELECT DISTINCT {_KEY.format('path')} AS key FROM notes WHERE path IS NOT NULL),
names AS (
  SELECT k.key AS whole, array_to_string(list_slice(string_split(k.key, '/'), i, 99999), '/') AS name, i = 1 AS is_full,
         k.note, coalesce(f.added, TIMESTAMP '1900-01-01') AS since
  FROM (SELECT key, true AS note FROM known WHERE key <> '' UNION ALL SELECT key, false FROM fate WHERE last = 'D' AND key NOT IN (SELECT key FROM known)) k
  LEFT JOIN fate f USING (key), unnest(range(1, len(string_split(k.key, '/')) + 1)) AS t(i)),
parents AS (
  SELECT name AS key, min(since) FILTER (note AND is_full) AS full_at, min(since) FILTER (note) AS any_at,
         coalesce(bool_or(is_full) FILTER (NOT note), false) AS full_gone, coalesce(bool_or(true) FILTER (NOT note), false) AS any_gone
  FROM names GROUP BY name),
refs AS (
  SELECT 'links' AS ref_table, link_id AS row_id, 'src' AS ref_field, {_KEY.format('src')} AS key, false AS suffix_ok, seen_at AS seen FROM links
  UNION ALL SELECT 'links', link_id, 'target_key', {_KEY.format('target_key')}, true, seen_at FROM links
  UNION ALL SELECT 'chunks', chunk_id, 'path', {_KEY.format('path')}, false, indexed_at FROM chunks),
judged AS (
  SELECT r.*, CASE WHEN suffix_ok THEN any_at ELSE full_at END AS since, CASE WHEN suffix_ok THEN any_gone ELSE full_gone END AS gone
  FROM refs r LEFT JOIN parents p ON p.key = r.key WHERE r.key IS NOT NULL AND r.key <> ''),
found AS (
  SELECT DISTINCT ref_table, row_id, ref_field,
         CASE WHEN since IS NOT NULL THEN CASE WHEN since > seen THEN 'late' END WHEN gone THEN 'deleted' ELSE 'missing' END AS reason, seen
  FROM judged)
"""


def _found(spark, d):
    refs = orphans.reference_rows(table(spark, d, "links"), table(spark, d, "chunks"))
    return orphans.orphan_rows(refs, orphans.parent_rows(table(spark, d, "notes"), table(spark, d, "changes")))


@REG.add("p2_found", _MISSES + "SELECT ref_table, row_id, ref_field, reason FROM found WHERE reason IS NOT NULL")
def p2_found(spark, d):
    return _found(spark, d).drop("at")


@REG.add("p2_report", _MISSES + "SELECT ref_table, ref_field, strftime(seen, '%Y-%m') AS month, reason, count(*) AS orphans FROM found WHERE reason IS NOT NULL GROUP BY ALL")
def p2_report(spark, d):
    return orphans.orphan_report(_found(spark, d))
