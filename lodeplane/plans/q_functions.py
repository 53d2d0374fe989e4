"""Queries on functions and the calls between them (e1, e2, j17, g1, g4, g6, g11, g13, a7), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeplane.functions import paths
from lodeplane.operators import callgraph, graph
from lodeplane.plans.common import apis, collect, files, sql_apis, sql_files

SQL: dict[str, str] = {}
_K = "(" + ", ".join(f"'{w}'" for w in callgraph.KEYWORDS) + ")"
_SCRIPT = callgraph.SCRIPT


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


_NAME = "CASE " + " ".join(
    f"WHEN regexp_matches(path, '{end}') THEN " + " || ".join(f"regexp_extract(src, '{_q(rule)}', {i})" for i in range(1, 4 if end == _SCRIPT else 2)) for end, rule in callgraph.DEFINES.items()
) + " ELSE '' END"
_LINES = (
    sql_files() + ", l AS (SELECT repo_id, path, unnest(range(1, len(s) + 1)) AS line, unnest(s) AS src FROM (SELECT repo_id, path, string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS s FROM f "
    f"WHERE content IS NOT NULL AND (regexp_matches(path, '{_SCRIPT}') OR regexp_matches(path, '{callgraph.OTHER}')))), "
    f"n AS (SELECT repo_id, path, line, src, CASE WHEN {_NAME} IN {_K} THEN NULL ELSE nullif({_NAME}, '') END AS name FROM l)"
)
_FUNCTIONS = _LINES + ", fn AS (SELECT repo_id, path, name, min(line) AS line FROM n WHERE name IS NOT NULL GROUP BY 1, 2, 3)"
_CALLS = (
    _FUNCTIONS + ", a AS (SELECT *, last_value(name IGNORE NULLS) OVER (PARTITION BY repo_id, path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS caller FROM n), "
    f"c AS (SELECT repo_id, path, line, caller, callee FROM (SELECT repo_id, path, line, name, caller, unnest(regexp_extract_all(src, '{callgraph.CALLED}', 1)) AS callee FROM a) "
    f"WHERE callee NOT IN {_K} AND caller IS NOT NULL AND coalesce(name, '') <> callee)"
)
_STATEMENT = r"^\s*(import|from|export)\b|require\("
_FROM = r"from\s+[\"'']([\w./@-]+)"
_GRAPH = (
    _CALLS + f", m AS (SELECT DISTINCT repo_id, path, regexp_extract(CASE WHEN b <> '' THEN b ELSE a END, '([\\w-]+)$', 1) AS module FROM (SELECT repo_id, path, regexp_extract(src, '{_q(callgraph.IMPORTED)}', 1) AS a, regexp_extract(src, '{_FROM}', 1) AS b FROM l WHERE regexp_matches(src, '{_STATEMENT}'))), "
    "d AS (SELECT DISTINCT repo_id, path, caller, callee FROM c), t AS (SELECT repo_id, path AS target, name AS callee, count(*) OVER (PARTITION BY repo_id, name) AS many, regexp_extract(path, '([^/]+?)(?:\\.\\w+)?$', 1) AS module FROM fn), "
    f"e AS (SELECT repo_id, path || '::' || caller AS src, target || '::' || callee AS dst, CASE WHEN regexp_matches(path, '{_SCRIPT}') THEN 0.9 ELSE 0.85 END AS confidence FROM d JOIN t USING (repo_id, callee) WHERE path = target "
    f"UNION ALL SELECT d.repo_id, d.path || '::' || d.caller, t.target || '::' || t.callee, CASE WHEN regexp_matches(d.path, '{_SCRIPT}') THEN 0.85 ELSE 0.7 END FROM d JOIN m ON m.repo_id = d.repo_id AND m.path = d.path JOIN t ON t.repo_id = d.repo_id AND t.callee = d.callee AND t.module = m.module AND many <= {callgraph.MANY} WHERE d.path <> target), "
    "g AS (SELECT repo_id, src, dst, CAST(max(confidence) AS DOUBLE) AS confidence FROM e WHERE src <> dst GROUP BY 1, 2, 3)"
)


def e1_symbols(spark, d) -> DataFrame:
    """Functions, methods and arrow functions of scripts, with their first line."""
    return callgraph.functions(files(spark, d)).where(F.col("path").rlike(_SCRIPT))


SQL["e1_symbols"] = f"WITH {_FUNCTIONS} SELECT * FROM fn WHERE regexp_matches(path, '{_SCRIPT}')"


def e2_symbols(spark, d) -> DataFrame:
    """Functions and methods of Python, Go and Java files, with their first line."""
    return callgraph.functions(files(spark, d)).where(F.col("path").rlike(callgraph.OTHER))


SQL["e2_symbols"] = f"WITH {_FUNCTIONS} SELECT * FROM fn WHERE regexp_matches(path, '{callgraph.OTHER}')"


def j17_enclosing(spark, d) -> DataFrame:
    """Called names with the function around the call: the last one defined at or before its line."""
    return callgraph.calls(files(spark, d)).groupBy("repo_id", "path", "caller").agg(F.count("*").alias("calls"), F.countDistinct("callee").alias("names"))


SQL["j17_enclosing"] = f"WITH {_CALLS} SELECT repo_id, path, caller, count(*) AS calls, count(DISTINCT callee) AS names FROM c GROUP BY 1, 2, 3"


def a7_symbols_over(spark, d) -> DataFrame:
    """Files with more than five functions (the reference's fifteen count variables too)."""
    return callgraph.functions(files(spark, d)).groupBy("repo_id", "path").agg(F.count("*").alias("symbols")).where("symbols > 5")


SQL["a7_symbols_over"] = f"WITH {_FUNCTIONS} SELECT repo_id, path, count(*) AS symbols FROM fn GROUP BY 1, 2 HAVING count(*) > 5"


def g1_call_edges(spark, d) -> DataFrame:
    """The call graph: edges between functions with the confidence of their resolution."""
    return callgraph.call_graph(files(spark, d)).select("repo_id", "src", "dst", "confidence")


SQL["g1_call_edges"] = f"WITH {_GRAPH} SELECT repo_id, src, dst, confidence FROM g"


def _edges(spark, d, least: float = 0.0) -> DataFrame:
    g = callgraph.call_graph(files(spark, d)).where(F.col("confidence") >= least)
    return g.select(F.concat_ws("/", "repo_id", "src").alias("src"), F.concat_ws("/", "repo_id", "dst").alias("dst"))


_IDS = "x AS (SELECT repo_id || '/' || src AS src, repo_id || '/' || dst AS dst FROM g{where})"


def g4_strong_impact(spark, d) -> DataFrame:
    """Functions that depend, within five steps of confidence 0.8 and more, on each function that is called at all."""
    e = _edges(spark, d, 0.8)
    return graph.reachable(e, e.select(F.col("dst").alias("seed")), 5, reverse=True)


SQL["g4_strong_impact"] = f"WITH RECURSIVE {_GRAPH}, {_IDS.format(where=' WHERE confidence >= 0.8')}, w(seed, node, depth) AS (SELECT DISTINCT dst, src, 1 FROM x UNION SELECT w.seed, x.src, w.depth + 1 FROM w JOIN x ON x.dst = w.node WHERE w.depth < 5) SELECT seed, node, CAST(min(depth) AS INT) AS depth FROM w WHERE seed <> node GROUP BY 1, 2"


def g6_call_paths(spark, d) -> DataFrame:
    """Length of the shortest chain of calls, up to ten, from each function that nobody calls to all that it reaches."""
    e = _edges(spark, d)
    roots = e.select(F.col("src").alias("seed")).join(e.select(F.col("dst").alias("seed")), "seed", "left_anti")
    return graph.reachable(e, roots, 10)


SQL["g6_call_paths"] = f"WITH RECURSIVE {_GRAPH}, {_IDS.format(where='')}, w(seed, node, depth) AS (SELECT DISTINCT src, dst, 1 FROM x WHERE src NOT IN (SELECT dst FROM x) UNION SELECT w.seed, x.dst, w.depth + 1 FROM w JOIN x ON x.src = w.node WHERE w.depth < 10) SELECT seed, node, CAST(min(depth) AS INT) AS depth FROM w WHERE seed <> node GROUP BY 1, 2"


_ENTRY_NAME = r"^(main|init|setup|teardown|constructor|__\w+__|ng[A-Z]\w*|handler|default|test\w*|Test\w*)$"


def g11_dead_functions(spark, d) -> DataFrame:
    """Functions whose name is called nowhere in their repository, other than tests, entry names, exported functions of Go and
    handlers of entry points."""
    f = files(spark, d)
    fn = callgraph.functions(f).where(~F.col("name").rlike(_ENTRY_NAME) & ~F.col("path").rlike(paths.TEST_PATHS["health"]))
    fn = fn.where(~(F.col("path").endswith(".go") & F.col("name").rlike("^[A-Z]")))
    called = callgraph.calls(f).select("repo_id", F.col("callee").alias("name")).distinct()
    handled = apis(spark, d).select("repo_id", F.trim("handler_name").alias("name")).distinct()
    return fn.join(called, ["repo_id", "name"], "left_anti").join(handled, ["repo_id", "name"], "left_anti").select("repo_id", "path", "name", "line")


SQL["g11_dead_functions"] = f"WITH {_CALLS}, {sql_apis()} SELECT repo_id, path, name, line FROM fn WHERE NOT regexp_matches(name, '{_ENTRY_NAME}') AND NOT regexp_matches(path, '{_q(paths.TEST_PATHS['health'])}') AND NOT (suffix(path, '.go') AND regexp_matches(name, '^[A-Z]')) AND NOT EXISTS (SELECT 1 FROM c WHERE c.repo_id = fn.repo_id AND c.callee = fn.name) AND NOT EXISTS (SELECT 1 FROM w WHERE w.repo_id = fn.repo_id AND trim(w.handler_name) = fn.name)"


def g13_health_report(spark, d) -> DataFrame:
    """Per repository: functions, dead ones, files with more than five functions, edges of the call graph and mutual calls."""
    f = files(spark, d)
    fn = callgraph.functions(f).groupBy("repo_id").agg(F.count("*").alias("functions"), F.countDistinct("path").alias("files"))
    dead = g11_dead_functions(spark, d).groupBy("repo_id").agg(F.count("*").alias("dead"))
    large = a7_symbols_over(spark, d).groupBy("repo_id").agg(F.count("*").alias("large"))
    g = callgraph.call_graph(f)
    edges = g.groupBy("repo_id").agg(F.count("*").alias("edges"))
    out = fn.join(dead, "repo_id", "left").join(large, "repo_id", "left").join(edges, "repo_id", "left")
    return out.select("repo_id", "functions", "files", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("dead", "large", "edges")])


SQL["g13_health_report"] = (
    f"WITH {_GRAPH}, {sql_apis()}, dd AS (SELECT repo_id, count(*) AS dead FROM (" + SQL["g11_dead_functions"].split(f"{sql_apis()} ", 1)[1] + ") GROUP BY 1), "
    "lg AS (SELECT repo_id, count(*) AS large FROM (SELECT repo_id, path FROM fn GROUP BY 1, 2 HAVING count(*) > 5) GROUP BY 1), ed AS (SELECT repo_id, count(*) AS edges FROM g GROUP BY 1), "
    "ff AS (SELECT repo_id, count(*) AS functions, count(DISTINCT path) AS files FROM fn GROUP BY 1) SELECT ff.repo_id, functions, files, coalesce(dead, 0) AS dead, coalesce(large, 0) AS large, coalesce(edges, 0) AS edges FROM ff LEFT JOIN dd USING (repo_id) LEFT JOIN lg USING (repo_id) LEFT JOIN ed USING (repo_id)"
)

QUERIES, ORACLE = collect(globals(), SQL)
