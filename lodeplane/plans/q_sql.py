"""Queries: the relational dialect through the guarded SQL endpoint (q). Both engines run the same text."""

from __future__ import annotations

from lodeplane.sources.tables import table
from lodeplane.sql import guarded

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "apis", "files", "repos")
TEXTS = {
    "q_inner_join": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "q_using_left_join": "SELECT r.repo_id, count(a.api_id) AS n FROM (SELECT DISTINCT repo_id FROM repos) r LEFT JOIN apis a USING (repo_id) GROUP BY r.repo_id",
    "q_full_outer": "SELECT count(*) AS n, count(c_custkey) AS c, count(s_suppkey) AS s FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey",
    "q_cross_join": "SELECT count(*) AS n FROM region CROSS JOIN nation",
    "q_semi_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "q_anti_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "q_theta_like": "SELECT r_name, count(*) AS n FROM region JOIN nation ON n_name ILIKE concat('%', substr(r_name, 1, 1), '%') GROUP BY r_name",
    "q_group_having": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "q_distinct": "SELECT DISTINCT p_brand, p_size FROM part",
    "q_filter_clause": "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS d, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "q_listagg": "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "q_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "q_windows": "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS q, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS nxt, first_value(o_orderkey) OVER w AS f FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "q_frames": "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS s FROM lineitem",
    "q_percent_rank": "SELECT s_suppkey, round(percent_rank() OVER (ORDER BY s_acctbal, s_suppkey), 6) AS p, round(cume_dist() OVER (ORDER BY s_acctbal, s_suppkey), 6) AS c FROM supplier",
    "q_nulls_order": "SELECT repo_id, technology FROM (SELECT DISTINCT repo_id, technology FROM repos) t ORDER BY technology ASC NULLS LAST, repo_id LIMIT 20 OFFSET 5",
    "q_union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "q_union_all": "SELECT k, count(*) AS n FROM (SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) t GROUP BY k",
    "q_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "q_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "q_cte": "WITH t AS (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY o_custkey), u AS (SELECT * FROM t WHERE m > 1000) SELECT count(*) AS n, round(max(m), 2) AS m FROM u",
    "q_recursive_cte": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t",
    "q_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "q_case_coalesce": "SELECT coalesce(technology, 'none') AS tech, sum(CASE WHEN status = 'ready' THEN 1 ELSE 0 END) AS ready, count(nullif(status, 'ready')) AS other FROM repos GROUP BY coalesce(technology, 'none')",
    "q_strings": "SELECT DISTINCT upper(substr(n_name, 1, 3)) || '-' || lower(n_name) AS a, length(trim(n_name)) AS l, replace(n_name, 'A', '_') AS r, instr(n_name, 'A') AS i FROM nation",
    "q_dates": "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY year(o_orderdate), month(o_orderdate)",
    "q_range_join": "SELECT p.p_partkey, count(*) AS n FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey AND l.l_quantity BETWEEN p.p_size AND p.p_size + 5 GROUP BY p.p_partkey",
    "q_as_of": "SELECT e.event_id, max(p.event_id) AS before FROM events e JOIN events p ON p.user_id = e.user_id AND p.event_type = 'click' AND p.ts < e.ts WHERE e.event_type = 'purchase' GROUP BY e.event_id",
    "q_lateral": "SELECT n.n_name, t.m FROM nation n, LATERAL (SELECT max(s.s_acctbal) AS m FROM supplier s WHERE s.s_nationkey = n.n_nationkey) t",
    "q_bare_columns": "SELECT o_custkey, max(o_totalprice) AS top, max_by(o_orderkey, o_totalprice) AS of FROM orders GROUP BY o_custkey",
    "q_in_between": "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#21')",
}


def _query(text: str):
    def run(spark, d):
        return guarded(spark, text, {n: table(spark, d, n) for n in _TABLES})

    return run


QUERIES = {n: _query(t) for n, t in TEXTS.items()}
ORACLE = TEXTS | {"q_listagg": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"}
