"""Queries: rows extracted out of source text (e), call graph (g1), infrastructure files (s14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeplane.plans.common import collect, files, sql_files
from lodeplane.sources import extract

SQL: dict[str, str] = {}
_EXT = "lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1))"


def _case(table, group):
    langs = {"javascript": "('js', 'jsx', 'mjs', 'cjs')", "typescript": "('ts', 'tsx')", "python": "('py')", "java": "('java')", "go": "('go')"}
    return "CASE " + " ".join(f"WHEN {_EXT} IN {langs[k]} THEN regexp_extract_all(content, '{p.replace(chr(39), chr(39) * 2)}', {group})" for k, p in table) + " ELSE [] END"


def e3_routes(spark, d):
    return extract.routes(files(spark, d)).groupBy("repo_id", "method").agg(F.count("*").alias("n"), F.countDistinct("route").alias("routes"))


SQL["e3_routes"] = f"WITH {sql_files()}, x AS (SELECT repo_id, unnest({_case(extract.ROUTES, 1)}) AS m, unnest({_case(extract.ROUTES, 2)}) AS r FROM f WHERE content IS NOT NULL) SELECT repo_id, upper(m) AS method, count(*) AS n, count(DISTINCT r) AS routes FROM x GROUP BY 1, 2"


def e5_first_routes(spark, d):
    return extract.first_routes(extract.routes(files(spark, d)))


SQL["e5_first_routes"] = f"WITH {sql_files()}, x AS (SELECT repo_id, path, unnest({_case(extract.ROUTES, 1)}) AS m, unnest({_case(extract.ROUTES, 2)}) AS route, unnest(range(len({_case(extract.ROUTES, 2)}))) AS pos FROM f WHERE content IS NOT NULL) SELECT repo_id, path, upper(m) AS method, route, min(pos) AS pos FROM x GROUP BY 1, 2, 3, 4"


def e9_imports(spark, d):
    """Imported packages, relative ones left out, and how many files use each."""
    return extract.imports(files(spark, d)).where("not source like '.%'").groupBy("source").agg(F.count("*").alias("files"))


SQL["e9_imports"] = f"WITH {sql_files()}, x AS (SELECT DISTINCT repo_id, path, unnest({_case(extract.IMPORTS, 1)}) AS source FROM f WHERE content IS NOT NULL) SELECT source, count(*) AS files FROM x WHERE source <> '' AND source NOT LIKE '.%' GROUP BY 1"


def j11_resolved_imports(spark, d):
    f = files(spark, d)
    i = extract.imports(f).where("source like './%' or source like '../%'")
    r = extract.resolved_imports(i, f)
    return i.groupBy("repo_id").agg(F.count("*").alias("relative")).join(r.groupBy("repo_id").agg(F.count("*").alias("resolved")), "repo_id", "left").select("repo_id", "relative", F.coalesce("resolved", F.lit(0)).alias("resolved"))


SQL["j11_resolved_imports"] = f"""WITH {sql_files()}, i AS (SELECT DISTINCT repo_id, path, unnest({_case(extract.IMPORTS, 1)}) AS source FROM f WHERE content IS NOT NULL), r AS (SELECT * FROM i WHERE source LIKE './%'),
t AS (SELECT repo_id, path, source, ltrim(regexp_replace(path, '(^|/)[^/]*$', '') || '/' || substr(source, 3), '/') AS b FROM r), h AS (SELECT DISTINCT t.repo_id, t.path, t.source FROM t JOIN f ON f.repo_id = t.repo_id AND f.path IN (b, b || '.ts', b || '.js', b || '.mjs', b || '.py', b || '/index.ts', b || '/index.js', b || '/index.mjs', b || '/index.py'))
SELECT r.repo_id, count(*) AS relative, count(h.source) AS resolved FROM r LEFT JOIN h ON h.repo_id = r.repo_id AND h.path = r.path AND h.source = r.source GROUP BY 1"""


def e10_schema_tables(spark, d):
    return extract.schema_tables(files(spark, d)).groupBy("name").agg(F.count("*").alias("declared"), F.max("columns").alias("columns"))


_CT = r"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)\s*\(([^;]*)\)\s*;"
SQL["e10_schema_tables"] = f"WITH {sql_files()}, x AS (SELECT unnest(regexp_extract_all(content, '{_CT}', 1)) AS n, unnest(regexp_extract_all(content, '{_CT}', 2)) AS c FROM f WHERE ends_with(path, '.sql') AND content IS NOT NULL) SELECT lower(n) AS name, count(*) AS declared, max(len(string_split(c, ','))) AS columns FROM x GROUP BY 1"


def s14_settings(spark, d):
    return extract.settings(files(spark, d)).where("key in ('service', 'replicas')").groupBy("key", "value").agg(F.count("*").alias("n"))


_YK = r"(?m)^([A-Za-z_][\w-]*):[ \t]+([^\s#][^\n#]*?)[ \t\r]*$"
SQL["s14_settings"] = f"WITH {sql_files()}, x AS (SELECT unnest(regexp_extract_all(content, '{_YK}', 1)) AS key, unnest(regexp_extract_all(content, '{_YK}', 2)) AS value FROM f WHERE regexp_matches(path, '\\.ya?ml$') AND content IS NOT NULL) SELECT key, value, count(*) AS n FROM x WHERE key IN ('service', 'replicas') GROUP BY 1, 2"


def s14_headings(spark, d):
    return extract.headings(files(spark, d)).groupBy("level", "title").agg(F.count("*").alias("n"))


_MH = r"(?m)^(#{1,6})[ \t]+([^\n\r]+?)[ \t\r]*$"
SQL["s14_headings"] = f"WITH {sql_files()}, x AS (SELECT length(unnest(regexp_extract_all(content, '{_MH}', 1))) AS level, unnest(regexp_extract_all(content, '{_MH}', 2)) AS title FROM f WHERE ends_with(path, '.md') AND content IS NOT NULL) SELECT level, title, count(*) AS n FROM x GROUP BY 1, 2"


def e13_urls(spark, d):
    return extract.urls(files(spark, d)).groupBy("host").agg(F.count("*").alias("files"))


SQL["e13_urls"] = f"WITH {sql_files()}, x AS (SELECT DISTINCT repo_id, path, unnest(regexp_extract_all(content, 'https?://([A-Za-z0-9.-]+)', 1)) AS host FROM f WHERE content IS NOT NULL) SELECT host, count(*) AS files FROM x GROUP BY 1"


def e14_roots(spark, d):
    return extract.detected_roots(files(spark, d))


SQL["e14_roots"] = f"WITH {sql_files()}, x AS (SELECT DISTINCT repo_id, regexp_replace(path, '(^|/)[^/]*$', '') AS root, regexp_replace(path, '^.*/', '') AS m FROM f WHERE regexp_replace(path, '^.*/', '') IN ('package.json', 'go.mod', 'pom.xml', 'pyproject.toml', '.npmrc', 'package-lock.json', '.env')) SELECT repo_id, root, string_agg(m, ',' ORDER BY m) AS markers FROM x GROUP BY 1, 2"


QUERIES, ORACLE = collect(globals(), SQL)
