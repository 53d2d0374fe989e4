"""Queries on what changed between snapshots (p1) and on references to missing records (p4), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeplane.operators import orphans, snapshots
from lodeplane.sources.tables import table


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.workspace_changes({n: table(spark, d, n) for n in snapshots.SNAPSHOT_TABLES})


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).select("tbl", "snapshot_no", "record_key", "change_type")


def p1_fields(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    c = _changes(spark, d).where("change_type = 'changed'")
    return c.select("tbl", "snapshot_no", F.explode("changed_fields").alias("field")).groupBy("tbl", "snapshot_no", "field").agg(F.count("*").alias("records"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.change_counts(_changes(spark, d))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    live = orphans.workspace_deltas(table(spark, d, "apis"), table(spark, d, "repos"))
    refs = orphans.workspace_references(table(spark, d, "ai_review_entry_cursors"), table(spark, d, "cross_repo_http_edges"))
    return orphans.orphan_references(refs, live)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_field", "record_id")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


QUERIES = {"p1_found": p1_found, "p1_fields": p1_fields, "p1_counts": p1_counts, "p4_found": p4_found, "p4_report": p4_report}

_T = "regexp_replace({}, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')"


def _t(c: str) -> str:
    return _T.format(c)


def _state(t: str, edges: bool) -> str:
    mark = f"coalesce(nullif(lower({_t('diff')}), ''), 'unchanged')"
    if edges:
        key = f"lower({_t('source_repo')}) || '|' || lower({_t('target_repo')}) || '|' || upper({_t('method')}) || '|' || {_t('route')}"
        vals = f"'' AS name, '' AS category, {mark} AS diff, '' AS consumers"
    else:
        key = f"lower({_t('provider_id')})"
        members = (
            "list_sort(list_distinct(list_filter(list_transform(coalesce(try_cast(nullif(trim(consumers_json), '') AS JSON[]), []), "
            "lambda e: lower(trim(CASE WHEN json_type(e) = 'OBJECT' THEN json_extract_string(e, '$.repoId') ELSE json_extract_string(e, '$') END))), lambda x: x IS NOT NULL AND x <> '')))"
        )
        vals = f"{_t('name')} AS name, lower({_t('category')}) AS category, {mark} AS diff, CAST({members} AS VARCHAR) AS consumers"
    return (
        f"SELECT '{t}' AS tbl, snapshot_no, record_key, name, category, diff, consumers FROM (SELECT snapshot_no, {key} AS record_key, {vals}, "
        f"row_number() OVER (PARTITION BY snapshot_no, {key} ORDER BY received_at DESC) AS rn FROM {t}) WHERE rn = 1"
    )


_STATES = " UNION ALL ".join(_state(t, t == "cross_repo_http_edges") for t in snapshots.SNAPSHOT_TABLES)
_P1 = f"""
WITH s AS ({_STATES}),
n AS (SELECT tbl, snapshot_no, lag(snapshot_no) OVER (PARTITION BY tbl ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT tbl, snapshot_no FROM s)),
b AS (SELECT s.*, n.prev FROM s JOIN n USING (tbl, snapshot_no)),
a AS (SELECT s.*, n.snapshot_no AS nxt FROM s JOIN n ON n.tbl = s.tbl AND n.prev = s.snapshot_no),
c AS (SELECT coalesce(a.tbl, b.tbl) AS tbl, coalesce(b.snapshot_no, a.nxt) AS snapshot_no, coalesce(a.record_key, b.record_key) AS record_key,
  CASE WHEN a.record_key IS NULL THEN 'added' WHEN b.record_key IS NULL THEN 'removed' ELSE 'changed' END AS change_type,
  a.name IS DISTINCT FROM b.name AS d_name, a.category IS DISTINCT FROM b.category AS d_category, a.diff IS DISTINCT FROM b.diff AS d_diff, a.consumers IS DISTINCT FROM b.consumers AS d_consumers
  FROM (SELECT * FROM a) a FULL JOIN (SELECT * FROM b WHERE prev IS NOT NULL) b ON a.tbl = b.tbl AND a.nxt = b.snapshot_no AND a.record_key = b.record_key),
f AS (SELECT * FROM c WHERE change_type <> 'changed' OR d_name OR d_category OR d_diff OR d_consumers)
"""
_P4 = f"""
WITH w AS (SELECT lower({_t('api_id')}) AS api, lower({_t('repo_id')}) AS repo, lower({_t('method')}) || ':' || lower({_t('route')}) AS entry, first_seen_at AS s, deleted_at AS u FROM apis WHERE snapshot_kind = 'working'),
r AS (SELECT lower({_t('repo_id')}) AS repo, added_at AS s, removed_at AS u FROM repos),
c AS (SELECT DISTINCT cursor_id AS record_id, lower({_t('repo_id')}) AS repo, nullif(lower({_t('api_id')}), '') AS api, nullif(lower({_t('entry_point_id')}), '') AS entry, reviewed_at AS t FROM ai_review_entry_cursors),
e AS (SELECT DISTINCT edge_id AS record_id, nullif(lower({_t('target_repo')}), '') AS repo, snapshot_at AS t FROM cross_repo_http_edges),
f AS (
SELECT 'ai_review_entry_cursors' AS ref_table, 'api_id' AS ref_field, record_id, api AS key, t FROM c WHERE api IS NOT NULL AND NOT EXISTS (SELECT 1 FROM w WHERE w.api = c.api AND w.s <= c.t AND (w.u IS NULL OR w.u > c.t))
UNION ALL
SELECT 'ai_review_entry_cursors', 'entry_point_id', record_id, coalesce(repo, '') || '|' || entry, t FROM c WHERE entry IS NOT NULL AND NOT EXISTS (SELECT 1 FROM w WHERE w.repo = c.repo AND w.entry = c.entry AND w.s <= c.t AND (w.u IS NULL OR w.u > c.t))
UNION ALL
SELECT 'cross_repo_http_edges', 'target_repo', record_id, repo, t FROM e WHERE repo IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r WHERE r.repo = e.repo AND r.s <= e.t AND (r.u IS NULL OR r.u > e.t)))
"""
ORACLE = {
    "p1_found": _P1 + "SELECT tbl, snapshot_no, record_key, change_type FROM f",
    "p1_counts": _P1 + "SELECT tbl, snapshot_no, count(*) FILTER (WHERE change_type = 'added') AS added, count(*) FILTER (WHERE change_type = 'removed') AS removed, count(*) FILTER (WHERE change_type = 'changed') AS changed FROM f GROUP BY 1, 2",
    "p1_fields": _P1 + "SELECT tbl, snapshot_no, field, count(*) AS records FROM (SELECT tbl, snapshot_no, unnest(list_filter([CASE WHEN d_name THEN 'name' END, CASE WHEN d_category THEN 'category' END, CASE WHEN d_diff THEN 'diff' END, CASE WHEN d_consumers THEN 'consumers' END], lambda x: x IS NOT NULL)) AS field FROM f WHERE change_type = 'changed') GROUP BY 1, 2, 3",
    "p4_found": _P4 + "SELECT ref_table, ref_field, record_id FROM f",
    "p4_report": _P4 + "SELECT ref_table, ref_field, strftime(t, '%Y-%m') AS period, count(*) AS orphan_refs, count(DISTINCT key) AS missing_keys FROM f GROUP BY 1, 2, 3",
}
