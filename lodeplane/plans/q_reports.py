"""Queries: saved views, pages within a budget, joins by route and root, changes of services and reviews of findings (q1, q2, s7, s18, l3,
f9, f12, j6, j13, r4, r13, r16, r17, d9, m3, m5, m7, m9, m11, m15, m18, m19, m22, a17, t6), with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeplane.functions import paths
from lodeplane.functions.text import filled, folded
from lodeplane.plans.common import SQL_EDGES, SQL_REPOS, apis, called_route, collect, files, repo_edges, repos, served_route, sql_apis, sql_called, sql_files, sql_served
from lodeplane.sources.tables import table
from lodeplane.sql import safe_sql

SQL: dict[str, str] = {}

# -- the SQL endpoint -------------------------------------------------------------------------------------------------
_TABLES = ("apis", "files", "repos", "orders", "nation")
_STATEMENTS = {
    "select": ("SELECT n_name FROM nation WHERE n_regionkey = 1", True), "with": ("WITH t AS (SELECT 1 AS a) SELECT a FROM t", True), "empty": ("   ", False), "drop": ("DROP TABLE orders", False), "insert": ("INSERT INTO orders SELECT * FROM orders", False),
    "two": ("SELECT 1; SELECT 2", False), "other_table": ("SELECT * FROM lineitem", False), "long": ("SELECT '" + "x" * 4100 + "'", False), "set": ("SET spark.sql.ansi.enabled = false", False), "file": ("SELECT * FROM parquet.`/tmp/x`", False),
    "nested": ("SELECT * FROM (SELECT repo_id FROM repos WHERE repo_id IN (SELECT c_name FROM customer)) t", False),
}


def q1_read_only_query(spark, d):
    """The result of the read-only endpoint: rows up to its limit of 100, and whether there were more."""
    got = safe_sql(spark, "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey", {n: table(spark, d, n) for n in _TABLES})
    rows = [(r["o_orderkey"], r["o_orderstatus"], got.truncated) for r in got.rows]
    return spark.createDataFrame(rows, "o_orderkey bigint, o_orderstatus string, truncated boolean")


SQL["q1_read_only_query"] = "SELECT o_orderkey, o_orderstatus, (SELECT count(*) > 100 FROM orders) AS truncated FROM orders ORDER BY o_orderkey LIMIT 100"


def q2_guarded_statements(spark, d):
    """Which statements the endpoint lets through: queries over the allowed tables, nothing else."""
    tables = {n: table(spark, d, n) for n in _TABLES}
    return spark.createDataFrame([(k, safe_sql(spark, text, tables).error is None) for k, (text, _) in _STATEMENTS.items()], "statement string, allowed boolean")


SQL["q2_guarded_statements"] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {str(ok).lower()})" for k, (_, ok) in _STATEMENTS.items()) + ") t(statement, allowed)"


def s18_saved_views(spark, d):
    """A saved filter view (a JSON object of wanted values and words) applied to the entry points."""
    view = spark.createDataFrame([('{"method": ["GET", "POST"], "diff": ["added", "modified"], "contains": "/"}',)], "json string")
    v = view.select(F.from_json("json", "method array<string>, diff array<string>, contains string").alias("v")).select("v.*")  # one row
    a = apis(spark, d).join(F.broadcast(v.select(F.col("method").alias("ms"), F.col("diff").alias("ds"), "contains")), F.lit(True))
    return a.where(F.array_contains("ms", F.upper(F.trim("method"))) & F.array_contains("ds", F.lower(F.trim("diff"))) & F.contains("route", "contains")).select("repo_id", "api_id")


SQL["s18_saved_views"] = f"WITH {sql_apis()} SELECT repo_id, api_id FROM w WHERE upper(trim(method)) IN ('GET', 'POST') AND lower(trim(diff)) IN ('added', 'modified') AND contains(route, '/')"


def s7_content_by_key(spark, d):
    """Contents of the files of given keys alone: the filter reaches the scan, nothing else is read."""
    keys = ["go.mod", "package.json", "README.md", "go.sum", "package-lock.json", "yarn.lock", ".npmrc"]
    f = files(spark, d).where(F.element_at(F.split("path", "/"), -1).isin(keys) & F.col("content").isNotNull())
    return f.select("repo_id", "path", F.length("content").alias("chars"))


SQL["s7_content_by_key"] = f"WITH {sql_files()} SELECT repo_id, path, length(content) AS chars FROM f WHERE regexp_replace(path, '^.*/', '') IN ('go.mod', 'package.json', 'README.md', 'go.sum', 'package-lock.json', 'yarn.lock', '.npmrc') AND content IS NOT NULL"


def l3_page_in_budget(spark, d):
    """The second page of 50 entry points of each repository, cut where its routes exceed 400 bytes, with the next cursor."""
    a = apis(spark, d).select("repo_id", "api_id", F.coalesce("route", F.lit("")).alias("route"))
    order = Window.partitionBy("repo_id").orderBy("api_id")
    p = a.withColumn("at", F.row_number().over(order)).where("at > 50 and at <= 100")
    p = p.withColumn("bytes", F.sum(F.octet_length("route")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("bytes <= 400 or at = 51")
    total = a.groupBy("repo_id").agg(F.count("*").alias("total"))
    page = p.groupBy("repo_id").agg(F.count("*").alias("items"), F.max("at").cast("bigint").alias("last"))
    return page.join(total, "repo_id").select("repo_id", "items", "total", F.when(F.col("last") < F.col("total"), F.col("last")).alias("next_cursor"))


SQL["l3_page_in_budget"] = f"WITH {sql_apis()}, a AS (SELECT repo_id, api_id, coalesce(route, '') AS route, row_number() OVER (PARTITION BY repo_id ORDER BY api_id) AS pos FROM w), p AS (SELECT *, CAST(sum(strlen(route)) OVER (PARTITION BY repo_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS bytes FROM a WHERE pos > 50 AND pos <= 100), t AS (SELECT repo_id, count(*) AS total FROM a GROUP BY 1) SELECT repo_id, count(*) AS items, total, CASE WHEN max(pos) < total THEN max(pos) END AS next_cursor FROM p JOIN t USING (repo_id) WHERE bytes <= 400 OR pos = 51 GROUP BY repo_id, total"

# -- joins ------------------------------------------------------------------------------------------------------------
_PARAM = r"\$\{[^}/]*\}|\{[^}/]*\}|<[^>/]*>|:[A-Za-z_]\w*"


def j6_regression_routes(spark, d):
    """Calls across repositories that meet an entry point of the called one: parameters read alike, the method must match."""
    norm = lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), _PARAM, ":p"), r"/+$", ""))
    e = table(spark, d, "cross_repo_http_edges").select(filled("target_repo").alias("repo_id"), F.upper(F.trim("method")).alias("m"), norm(called_route()).alias("r")).where("repo_id is not null").groupBy("repo_id", "m", "r").agg(F.count("*").alias("calls"))
    a = apis(spark, d).select(F.lower(F.trim("repo_id")).alias("repo_id"), F.upper(F.trim("method")).alias("m"), norm(served_route()).alias("r")).distinct()
    return e.join(a, ["repo_id", "m", "r"]).groupBy("repo_id", F.col("m").alias("method")).agg(F.count("*").alias("routes"), F.sum("calls").alias("calls"))


def _norm_sql(c: str) -> str:
    return f"lower(regexp_replace(regexp_replace(trim({c}), '{_PARAM}', ':p', 'g'), '/+$', ''))"


SQL["j6_regression_routes"] = f"WITH {sql_apis()}, e AS (SELECT nullif(lower(trim(target_repo)), '') AS repo_id, upper(trim(method)) AS m, {_norm_sql(sql_called())} AS r, count(*) AS calls FROM cross_repo_http_edges GROUP BY 1, 2, 3), a AS (SELECT DISTINCT lower(trim(repo_id)) AS repo_id, upper(trim(method)) AS m, {_norm_sql(sql_served())} AS r FROM w) SELECT e.repo_id, e.m AS method, count(*) AS routes, CAST(sum(calls) AS BIGINT) AS calls FROM e JOIN a USING (repo_id, m, r) GROUP BY 1, 2"


def j13_shared_imports(spark, d):
    """Modules that files of more than one repository import, with their consumers."""
    from lodeplane.operators import callgraph

    m = callgraph.modules(files(spark, d)).select("module", "repo_id").distinct()
    return m.groupBy("module").agg(F.count("*").alias("repos")).where("repos > 1")


def _modules_sql() -> str:
    from lodeplane.plans.q_functions import _GRAPH

    return _GRAPH


SQL["j13_shared_imports"] = f"WITH {_modules_sql()} SELECT module, count(DISTINCT repo_id) AS repos FROM m WHERE module <> '' GROUP BY 1 HAVING count(DISTINCT repo_id) > 1"


def r17_routed_roots(spark, d):
    """Each repository's root under the longest other root that holds it (with a slash), workspace if none does."""
    r = repos(spark, d).where("root_path is not null").select("repo_id", F.regexp_replace("root_path", "/+$", "").alias("root"))
    up = r.select("repo_id", "root", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("root", "/"))), lambda n: F.array_join(F.slice(F.split("root", "/"), F.lit(1), n), "/"))).alias("holder"))
    known = r.select(F.col("root").alias("holder"), F.col("repo_id").alias("owner"))
    best = up.where("holder <> root and holder <> ''").join(known, "holder").groupBy("repo_id").agg(F.max_by("owner", F.struct(F.length("holder"), "owner")).alias("owner"))
    return r.join(best, "repo_id", "left").groupBy(F.coalesce("owner", F.lit("workspace")).alias("owner")).agg(F.count("*").alias("repos"))


SQL["r17_routed_roots"] = f"WITH {SQL_REPOS}, t AS (SELECT repo_id, regexp_replace(root_path, '/+$', '') AS root FROM r WHERE root_path IS NOT NULL), b AS (SELECT a.repo_id, arg_max(h.repo_id, (length(h.root), h.repo_id)) AS owner FROM t a JOIN t h ON starts_with(a.root, h.root || '/') AND h.root <> '' GROUP BY 1) SELECT coalesce(owner, 'workspace') AS owner, count(*) AS repos FROM t LEFT JOIN b USING (repo_id) GROUP BY 1"

# -- changes ----------------------------------------------------------------------------------------------------------


def d9_changed_services(spark, d):
    """Repositories as services: modified if the number of entry points differs between baseline and working, or a file there
    in both has a new hash; files that come or go alone do not count."""
    n = lambda kind: apis(spark, d, kind).groupBy("repo_id").agg(F.count("*").alias(f"n_{kind}"))
    f = files(spark, d, "baseline").select("repo_id", "path", F.col("hash").alias("h1")).join(files(spark, d).select("repo_id", "path", F.col("hash").alias("h2")), ["repo_id", "path"])
    new = f.groupBy("repo_id").agg(F.count(F.when(F.col("h1") != F.col("h2"), 1)).alias("rehashed"))
    j = n("baseline").join(n("working"), "repo_id", "full").join(new, "repo_id", "left").na.fill(0)
    status = F.when(F.col("n_baseline") == 0, "added").when(F.col("n_working") == 0, "deleted").when((F.col("n_baseline") != F.col("n_working")) | (F.col("rehashed") > 0), "modified").otherwise("unchanged")
    return j.select("repo_id", status.alias("status"))


SQL["d9_changed_services"] = f"WITH {sql_apis('w')}, {sql_apis('b', 'baseline')}, {sql_files('f')}, {sql_files('g', 'baseline')}, nw AS (SELECT repo_id, count(*) AS n FROM w GROUP BY 1), nb AS (SELECT repo_id, count(*) AS n FROM b GROUP BY 1), h AS (SELECT repo_id, count(*) AS c FROM f JOIN g USING (repo_id, path) WHERE f.hash <> g.hash GROUP BY 1) SELECT coalesce(nw.repo_id, nb.repo_id) AS repo_id, CASE WHEN nb.n IS NULL THEN 'added' WHEN nw.n IS NULL THEN 'deleted' WHEN nb.n <> nw.n OR coalesce(h.c, 0) > 0 THEN 'modified' ELSE 'unchanged' END AS status FROM nw FULL JOIN nb ON nw.repo_id = nb.repo_id LEFT JOIN h ON h.repo_id = coalesce(nw.repo_id, nb.repo_id)"


def m3_changed_repositories(spark, d):
    """Repositories marked modified because any file or entry point of theirs is, with what marks them."""
    f = files(spark, d).join(files(spark, d, "baseline").select("repo_id", "path", F.col("hash").alias("old")), ["repo_id", "path"], "left").where("old is null or old <> hash").select("repo_id", F.lit("file").alias("by"))
    a = apis(spark, d).where(F.coalesce(folded("diff"), F.lit("unchanged")).isin("added", "modified")).select("repo_id", F.lit("entry_point").alias("by"))
    return f.unionByName(a).groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_set("by")), ",").alias("marked_by"))


SQL["m3_changed_repositories"] = f"WITH {sql_apis()}, {sql_files('f')}, {sql_files('g', 'baseline')}, x AS (SELECT f.repo_id, 'file' AS k FROM f LEFT JOIN g USING (repo_id, path) WHERE g.repo_id IS NULL OR g.hash IS NULL OR g.hash <> f.hash UNION SELECT repo_id, 'entry_point' FROM w WHERE coalesce(nullif(lower(trim(diff)), ''), 'unchanged') IN ('added', 'modified')) SELECT repo_id, string_agg(DISTINCT k, ',' ORDER BY k) AS marked_by FROM x GROUP BY 1"


def m5_edges_of_producers(spark, d):
    """Consumers of each producer with the producer's and consumer's names, sorted by consumer."""
    r = repos(spark, d).select("repo_id", F.trim("name").alias("name"))
    e = repo_edges(spark, d)
    named = e.join(r.select(F.col("repo_id").alias("dst"), F.col("name").alias("producer")), "dst", "left").join(r.select(F.col("repo_id").alias("src"), F.col("name").alias("consumer")), "src", "left")
    return named.select(F.coalesce("producer", "dst").alias("producer"), F.coalesce("consumer", "src").alias("consumer"), "calls").orderBy("producer", "consumer")


SQL["m5_edges_of_producers"] = f"WITH {SQL_REPOS}, {SQL_EDGES} SELECT coalesce(trim(p.name), dst) AS producer, coalesce(trim(c.name), src) AS consumer, calls FROM e LEFT JOIN r p ON p.repo_id = dst LEFT JOIN r c ON c.repo_id = src"


def m15_change_rank(spark, d):
    """Entry points per method and change, methods in the order of their tabs, changes by rank (added, modified, deleted)."""
    a = apis(spark, d).select(F.upper(F.trim("method")).alias("method"), F.coalesce(filled("diff"), F.lit("unchanged")).alias("diff"))
    rank = F.when(F.col("diff") == "added", 0).when(F.col("diff") == "modified", 1).when(F.col("diff") == "deleted", 2).otherwise(3)
    tab = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in ("GET", "POST", "PUT", "PATCH", "DELETE")]), F.col("method")), F.lit(0))
    return a.groupBy("method", "diff").agg(F.count("*").alias("n")).select("method", "diff", "n", rank.alias("rank"), F.when(tab == 0, 9).otherwise(tab).cast("int").alias("tab"))


SQL["m15_change_rank"] = f"WITH {sql_apis()}, a AS (SELECT upper(trim(method)) AS method, coalesce(nullif(lower(trim(diff)), ''), 'unchanged') AS diff FROM w) SELECT method, diff, count(*) AS n, CASE diff WHEN 'added' THEN 0 WHEN 'modified' THEN 1 WHEN 'deleted' THEN 2 ELSE 3 END AS rank, CASE method WHEN 'GET' THEN 1 WHEN 'POST' THEN 2 WHEN 'PUT' THEN 3 WHEN 'PATCH' THEN 4 WHEN 'DELETE' THEN 5 ELSE 9 END AS tab FROM a GROUP BY 1, 2"


def m11_regression_points(spark, d):
    """Overlay points of changed files: 1 and a warning each, 2 and an error where no test file lies in the same folder."""
    f, b = files(spark, d), files(spark, d, "baseline")
    changed = f.join(b.select("repo_id", "path", F.col("hash").alias("old")), ["repo_id", "path"]).where("old <> hash")
    tested = f.where(paths.is_test(F.col("path"), "health")).select("repo_id").distinct().withColumn("t", F.lit(True))
    p = changed.join(tested, "repo_id", "left").select("repo_id", "path", F.when(F.col("t"), 1).otherwise(2).alias("value"))
    return p.groupBy("repo_id").agg(F.max("value").alias("value"), F.count("*").alias("points")).withColumn("severity", F.when(F.col("value") == 2, "error").otherwise("warning"))


_HEALTH = paths.TEST_PATHS["health"].replace("'", "''")
SQL["m11_regression_points"] = f"WITH {sql_files('f')}, {sql_files('g', 'baseline')}, t AS (SELECT DISTINCT repo_id FROM f WHERE regexp_matches(path, '{_HEALTH}')), p AS (SELECT f.repo_id, CASE WHEN f.repo_id IN (SELECT repo_id FROM t) THEN 1 ELSE 2 END AS value FROM f JOIN g USING (repo_id, path) WHERE g.hash <> f.hash) SELECT repo_id, max(value) AS value, count(*) AS points, CASE WHEN max(value) = 2 THEN 'error' ELSE 'warning' END AS severity FROM p GROUP BY 1"

# -- findings ---------------------------------------------------------------------------------------------------------
#: Words that writers use for a severity (fixed values).
SEVERITIES = {"error": "critical high severe blocker error major bug", "warning": "warning medium moderate minor warn", "info": "info low note nit suggestion style"}


def m7_severities(spark, d):
    """Documents by the severity that the first alias among their words names; none where no word is an alias."""
    words = F.split(F.lower("text"), r"[^a-z]+")
    rank = F.array(*[F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in ws.split()])), F.lit(s)) for s, ws in SEVERITIES.items()])
    t = table(spark, d, "documents").where("text is not null")
    return t.groupBy("doc_kind", F.coalesce(F.get(F.array_compact(rank), F.lit(0)), F.lit("none")).alias("severity")).agg(F.count("*").alias("n"))


_WORDS = "string_split_regex(lower(text), '[^a-z]+')"
SQL["m7_severities"] = "SELECT doc_kind, CASE " + " ".join(f"WHEN list_has_any({_WORDS}, {ws.split()}) THEN '{s}'" for s, ws in SEVERITIES.items()) + " ELSE 'none' END AS severity, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1, 2"


def r4_intents(spark, d):
    """The first route that a text asks about, and the entry points that serve it: named if it is one alone."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_replace(F.regexp_extract("text", _ROUTE, 1), r"[.:]+$", "").alias("route")).where("route <> ''")
    norm = lambda c: F.regexp_replace(c, _PARAM, ":p")
    a = apis(spark, d).select(norm(served_route()).alias("r"), "api_id").groupBy("r").agg(F.count("*").alias("n"), F.min("api_id").alias("api_id"))
    return t.withColumn("r", norm(F.col("route"))).join(a, "r", "left").select("doc_id", "route", F.when(F.col("n") == 1, F.col("api_id")).alias("entry_point"), F.coalesce("n", F.lit(0)).alias("candidates"))


_ROUTE = r"(?:^|\s)(/[a-z]+/[\w/:{}.-]+)"
SQL["r4_intents"] = f"WITH {sql_apis()}, t AS (SELECT doc_id, regexp_replace(regexp_extract(text, '{_ROUTE}', 1), '[.:]+$', '') AS route FROM documents WHERE text IS NOT NULL), a AS (SELECT regexp_replace({sql_served()}, '{_PARAM}', ':p', 'g') AS r, count(*) AS n, min(api_id) AS api_id FROM w GROUP BY 1) SELECT doc_id, route, CASE WHEN n = 1 THEN api_id END AS entry_point, coalesce(n, 0) AS candidates FROM t LEFT JOIN a ON a.r = regexp_replace(route, '{_PARAM}', ':p', 'g') WHERE route <> ''"


def f9_findings_on_changed_files(spark, d):
    """Files named in review findings: kept if their path, or else their base name, is among the changed ones; those on tests go."""
    t = table(spark, d, "documents").where("doc_kind = 'review_finding' and text is not null")
    named = t.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\w-]+(?:/[\w-]+)*/[\w-]+\.[a-z]{1,4})\b"), 1))).alias("path"))
    f, b = files(spark, d), files(spark, d, "baseline")
    new = f.join(b.select("repo_id", "path", F.col("hash").alias("old")), ["repo_id", "path"], "left").where("old is null or old <> hash")
    full, base = new.select("path").distinct().withColumn("by_path", F.lit(True)), new.select(paths.basename(F.col("path")).alias("base")).distinct().withColumn("by_base", F.lit(True))
    j = named.withColumn("base", paths.basename(F.col("path"))).join(full, "path", "left").join(base, "base", "left")
    kept = F.when(paths.is_test(F.col("path"), "review"), "test").when(F.col("by_path"), "path").when(F.col("by_base"), "name").otherwise("off_diff")
    return j.groupBy(kept.alias("kept")).agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("findings"))


_MENTION = r"([\w-]+(?:/[\w-]+)*/[\w-]+\.[a-z]{1,4})\b"
_REVIEW = paths.TEST_PATHS["review"].replace("'", "''")
SQL["f9_findings_on_changed_files"] = f"WITH {sql_files('f')}, {sql_files('g', 'baseline')}, n AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{_MENTION}', 1))) AS path FROM documents WHERE doc_kind = 'review_finding' AND text IS NOT NULL), c AS (SELECT f.path, regexp_replace(f.path, '^.*/', '') AS base FROM f LEFT JOIN g USING (repo_id, path) WHERE g.repo_id IS NULL OR g.hash <> f.hash OR g.hash IS NULL) SELECT CASE WHEN regexp_matches(path, '{_REVIEW}') THEN 'test' WHEN path IN (SELECT path FROM c) THEN 'path' WHEN regexp_replace(path, '^.*/', '') IN (SELECT base FROM c) THEN 'name' ELSE 'off_diff' END AS kept, count(*) AS mentions, count(DISTINCT doc_id) AS findings FROM n GROUP BY 1"


def m9_dropped_by_reason(spark, d):
    """Review findings marked as ignored with the reason, and how many are left: no text, too short, repeated."""
    t = table(spark, d, "documents").where("doc_kind = 'review_finding'")
    first = Window.partitionBy(F.xxhash64("text"), "text").orderBy("doc_id")
    why = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty").when(F.length("text") < 80, "short").when(F.col("rn") > 1, "repeated").otherwise("kept")
    real = t.where("text is not null").withColumn("rn", F.row_number().over(first)).unionByName(t.where("text is null").withColumn("rn", F.lit(1)))
    return real.groupBy(why.alias("reason")).agg(F.count("*").alias("findings"))


SQL["m9_dropped_by_reason"] = "SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN length(text) < 80 THEN 'short' WHEN rn > 1 THEN 'repeated' ELSE 'kept' END AS reason, count(*) AS findings FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents WHERE doc_kind = 'review_finding') GROUP BY 1"


def f12_tour_stops(spark, d):
    """Entry points fit for a tour: not those of tests, constructors or library code, numbered by route within a repository."""
    a = apis(spark, d).select("repo_id", "api_id", F.trim("handler_name").alias("handler"), F.coalesce(F.trim("file_path"), F.lit("")).alias("path"), F.coalesce(F.trim("route"), F.lit("")).alias("route"))
    out = paths.is_test(F.col("path"), "health") | F.coalesce(F.col("handler"), F.lit("")).rlike(r"^(constructor|__init__|new)$") | F.col("path").rlike(r"(^|/)(node_modules|vendor|third_party|lib/internal)/")
    return a.where(~out).select("repo_id", "api_id", F.row_number().over(Window.partitionBy("repo_id").orderBy("route", "api_id")).alias("step"))


SQL["f12_tour_stops"] = f"WITH {sql_apis()} SELECT repo_id, api_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY coalesce(trim(route), ''), api_id) AS INT) AS step FROM w WHERE NOT regexp_matches(coalesce(trim(file_path), ''), '{_HEALTH}') AND NOT regexp_matches(coalesce(trim(handler_name), ''), '^(constructor|__init__|new)$') AND NOT regexp_matches(coalesce(trim(file_path), ''), '(^|/)(node_modules|vendor|third_party|lib/internal)/')"


def m22_catalogue_sections(spark, d):
    """Sections of the architecture document: system, API catalogue, health and changes, as titles with their lines."""
    a, r, e = apis(spark, d), repos(spark, d), repo_edges(spark, d)
    line = lambda section, df, text: df.select(F.lit(section).alias("section"), text.alias("line"))
    return (
        line("system", r.groupBy(F.coalesce(F.trim("technology"), F.lit("unknown")).alias("t")).agg(F.count("*").alias("n")), F.format_string("- %s: %d repositories", "t", "n"))
        .unionByName(line("catalogue", a.groupBy("repo_id").agg(F.count("*").alias("n")), F.format_string("- %s: %d entry points", "repo_id", "n")))
        .unionByName(line("links", e.groupBy("dst").agg(F.count("*").alias("n")), F.format_string("- %s is called by %d repositories", "dst", "n")))
        .unionByName(line("changes", a.groupBy(F.coalesce(filled("diff"), F.lit("unchanged")).alias("k")).agg(F.count("*").alias("n")), F.format_string("- %s: %d", "k", "n")))
    )


SQL["m22_catalogue_sections"] = f"WITH {sql_apis()}, {SQL_REPOS}, {SQL_EDGES} SELECT 'system' AS section, format('- {{}}: {{}} repositories', t, n) AS line FROM (SELECT coalesce(trim(technology), 'unknown') AS t, count(*) AS n FROM r GROUP BY 1) UNION ALL SELECT 'catalogue', format('- {{}}: {{}} entry points', repo_id, n) FROM (SELECT repo_id, count(*) AS n FROM w GROUP BY 1) UNION ALL SELECT 'links', format('- {{}} is called by {{}} repositories', dst, n) FROM (SELECT dst, count(*) AS n FROM e GROUP BY 1) UNION ALL SELECT 'changes', format('- {{}}: {{}}', k, n) FROM (SELECT coalesce(nullif(lower(trim(diff)), ''), 'unchanged') AS k, count(*) AS n FROM w GROUP BY 1)"


def t6_mutations_in_order(spark, d):
    """Events as mutations per user: neighbours of one kind are one, numbered in order; how many are left."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kept = e.withColumn("prev", F.lag("event_type").over(w)).where("prev is null or prev <> event_type")
    return kept.groupBy("user_id").agg(F.count("*").alias("mutations"))


SQL["t6_mutations_in_order"] = "SELECT user_id, count(*) AS mutations FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NULL OR prev <> event_type GROUP BY 1"

QUERIES, ORACLE = collect(globals(), SQL)
