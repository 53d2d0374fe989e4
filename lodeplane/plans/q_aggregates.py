"""Queries: aggregates over findings, overlays and rules (a, r14, m). Orders stand for findings, their lines for bindings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeplane.functions import paths
from lodeplane.operators import entities, findings
from lodeplane.plans.common import SQL_REPOS, apis, collect, files, repos, sql_apis, sql_files
from lodeplane.sources.tables import table

SQL: dict[str, str] = {}
_SEV = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'error' WHEN o_orderpriority = '3-MEDIUM' THEN 'warning' ELSE 'info' END"


def _findings(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey as id", "o_custkey as entry_point", "o_orderstatus as status", f"{_SEV} as severity", "o_orderdate as created_at", "o_totalprice as score")


_F = f"f AS (SELECT o_orderkey AS id, o_custkey AS entry_point, o_orderstatus AS status, {_SEV} AS severity, o_orderdate AS created_at, o_totalprice AS score FROM orders)"


def f2_filtered_findings(spark, d):
    return _findings(spark, d).where("severity = 'error' and status = 'O'").groupBy("entry_point").agg(F.count("*").alias("n"))


SQL["f2_filtered_findings"] = f"WITH {_F} SELECT entry_point, count(*) AS n FROM f WHERE severity = 'error' AND status = 'O' GROUP BY 1"


def f3_findings_of_entity(spark, d):
    """Findings bound to one target (supplier 7)."""
    b = table(spark, d, "lineitem").where("l_suppkey = 7").select(F.col("l_orderkey").alias("id")).distinct()
    return _findings(spark, d).join(b, "id", "left_semi").select("id", "severity", "status")


SQL["f3_findings_of_entity"] = f"WITH {_F} SELECT id, severity, status FROM f WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7)"


def a1_counts(spark, d):
    f = _findings(spark, d).where("status = 'O'")
    return findings.counts(f, "entry_point")


SQL["a1_counts"] = f"WITH {_F} SELECT entry_point, count(*) AS total, count(*) FILTER (WHERE severity = 'error') AS error, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info FROM f WHERE status = 'O' GROUP BY 1"


def a1_by_binding(spark, d):
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_suppkey").alias("bindings"))
    return findings.counts_by_binding(b, "bindings", "id")


SQL["a1_by_binding"] = "SELECT l_suppkey AS target, count(DISTINCT l_orderkey) AS findings FROM lineitem GROUP BY 1"


def a2_by_guideline(spark, d):
    c = table(spark, d, "ai_review_entry_cursors").dropDuplicates(["cursor_id"])
    key = F.coalesce(F.nullif(F.trim("guidelines_hash"), F.lit("")), F.lit("<none>"))
    return findings.first_titles(c.where("entry_point_id is not null"), key, "entry_point_id", "cursor_id")


SQL["a2_by_guideline"] = "WITH c AS (SELECT DISTINCT cursor_id, coalesce(nullif(trim(guidelines_hash), ''), '<none>') AS value, entry_point_id FROM ai_review_entry_cursors WHERE entry_point_id IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY cursor_id) AS rn FROM c) SELECT value, count(*) AS findings, string_agg(entry_point_id, '; ' ORDER BY rn) FILTER (WHERE rn <= 3) AS titles FROM k GROUP BY 1"


def a3_summary(spark, d):
    """The five open errors with the highest scores of each severity, with the counts."""
    w = Window.partitionBy("severity").orderBy(F.desc("score"), "id")
    f = _findings(spark, d).where("status = 'O'").withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return f.select("severity", "rank", "id", F.round("score", 2).alias("score"))


SQL["a3_summary"] = f"WITH {_F}, k AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY score DESC, id) AS rank FROM f WHERE status = 'O') SELECT severity, rank, id, round(score, 2) AS score FROM k WHERE rank <= 5"


def a4_bullets(spark, d):
    """Bullets ranked by severity, then the newest, the text cut to 100 characters: the first 20."""
    t = table(spark, d, "documents").where("doc_kind = 'review_finding' and text is not null")
    rank = F.when(F.col("text").contains("god file"), 0).when(F.col("text").contains("unused"), 1).otherwise(2)
    return t.select("doc_id", rank.alias("rank"), F.substring("text", 1, 100).alias("bullet")).orderBy("rank", "doc_id").limit(20)


SQL["a4_bullets"] = "SELECT doc_id, CASE WHEN contains(text, 'god file') THEN 0 WHEN contains(text, 'unused') THEN 1 ELSE 2 END AS rank, left(text, 100) AS bullet FROM documents WHERE doc_kind = 'review_finding' AND text IS NOT NULL ORDER BY rank, doc_id LIMIT 20"


def a5_totals(spark, d):
    """Totals over all repositories: distinct paths, entry points, technologies; counts of repositories by status."""
    f = files(spark, d).agg(F.countDistinct("repo_id", "path").alias("files"))
    a = apis(spark, d).agg(F.countDistinct("repo_id", "api_id").alias("apis"))
    r = repos(spark, d).agg(F.count("*").alias("repos"), F.countDistinct("technology").alias("technologies"), F.count(F.when(F.col("status") == "ready", 1)).alias("ready"))
    return f.crossJoin(a).crossJoin(r)


SQL["a5_totals"] = f"WITH {sql_files()}, {sql_apis()}, {SQL_REPOS} SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM w) AS apis, count(*) AS repos, count(DISTINCT technology) AS technologies, count(*) FILTER (WHERE status = 'ready') AS ready FROM r"


def a8_near_duplicates(spark, d):
    """First-wins removal among open findings of one day: same customer or same price."""
    f = _findings(spark, d).where("status = 'O'").withColumn("day", F.to_date("created_at"))
    return findings.greedy_distinct(f, "day", ["id"], ["entry_point", "score"]).groupBy("day").agg(F.count("*").alias("kept"))


SQL["a8_near_duplicates"] = f"WITH {_F} SELECT CAST(created_at AS DATE) AS day, count(DISTINCT entry_point) AS kept FROM f WHERE status = 'O' GROUP BY 1"


def a10_coverage(spark, d):
    """Mean of line rates and pooled function rate per repository; a file's rate is the share of its non-blank lines."""
    lines = F.split("content", r"\r?\n|\r")
    f = files(spark, d).where("content is not null").select("repo_id", F.size(lines).alias("found"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).alias("hit"))
    return f.groupBy("repo_id").agg(F.round(F.avg(F.col("hit") / F.col("found")), 6).alias("mean_rate"), F.round(F.sum("hit") / F.sum("found"), 6).alias("pooled_rate"))


SQL["a10_coverage"] = f"WITH {sql_files()}, l AS (SELECT repo_id, string_split_regex(content, '\\r?\\n|\\r') AS x FROM f WHERE content IS NOT NULL), n AS (SELECT repo_id, len(x) AS found, len(list_filter(x, lambda s: trim(s, ' ') <> '')) AS hit FROM l) SELECT repo_id, round(avg(hit / found), 6) AS mean_rate, round(sum(hit) / sum(found), 6) AS pooled_rate FROM n GROUP BY 1"


def a12_cohesion(spark, d):
    """Calls within and out of a group of repositories (the first word of the name), and cohesion in percent."""
    from lodeplane.plans.common import repo_edges

    g = lambda c: F.split(c, "-")[0]
    e = repo_edges(spark, d).select(g(F.col("src")).alias("a"), g(F.col("dst")).alias("b"), "calls")
    both = e.select(F.col("a").alias("grp"), (F.col("a") == F.col("b")).alias("inside"), "calls")
    out = both.groupBy("grp").agg(F.sum(F.when(F.col("inside"), F.col("calls")).otherwise(0)).alias("internal"), F.sum(F.when(~F.col("inside"), F.col("calls")).otherwise(0)).alias("external"))
    return out.withColumn("cohesion", F.round(100 * F.col("internal") / (F.col("internal") + F.col("external"))).cast("int"))


from lodeplane.plans.common import SQL_EDGES  # noqa: E402

SQL["a12_cohesion"] = f"WITH {SQL_EDGES}, g AS (SELECT string_split(src, '-')[1] AS grp, string_split(src, '-')[1] = string_split(dst, '-')[1] AS inside, calls FROM e), s AS (SELECT grp, sum(CASE WHEN inside THEN calls ELSE 0 END) AS internal, sum(CASE WHEN inside THEN 0 ELSE calls END) AS external FROM g GROUP BY 1) SELECT grp, internal, external, CAST(round(100.0 * internal / (internal + external)) AS INT) AS cohesion FROM s"


def a14_majority(spark, d):
    """The language that most files of a repository are in; ties go to the name that comes first."""
    n = files(spark, d).groupBy("repo_id", paths.language("path").alias("language")).agg(F.count("*").alias("n"))
    return entities.latest(n, ["repo_id"], [F.desc("n"), F.asc("language")])


SQL["a14_majority"] = SQL_M = f"WITH {sql_files()}, n AS (SELECT repo_id, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.LANGUAGE_OF.items()) + " ELSE 'other' END AS language, count(*) AS n FROM f GROUP BY 1, 2) SELECT repo_id, language, n FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, language) AS rn FROM n) WHERE rn = 1"


def a15_dominant(spark, d):
    """Methods whose entry points lie to at least 70 percent in one repository group."""
    n = apis(spark, d).groupBy("repo_id", F.upper("method").alias("method")).agg(F.count("*").alias("n"))
    t = n.groupBy("repo_id").agg(F.sum("n").alias("t"))
    return n.join(t, "repo_id").where(F.col("n") >= 0.7 * F.col("t")).select("repo_id", "method")


SQL["a15_dominant"] = f"WITH {sql_apis()}, n AS (SELECT repo_id, upper(method) AS method, count(*) AS n FROM w GROUP BY 1, 2) SELECT repo_id, method FROM (SELECT *, sum(n) OVER (PARTITION BY repo_id) AS t FROM n) WHERE n >= 0.7 * t"


def a16_overlay(spark, d):
    """Event values as points on users, joined to customers; points without one stay under no segment."""
    sev = "case when event_type = 'error' then 'error' when event_type = 'purchase' then 'warn' else 'info' end"
    e = table(spark, d, "events").selectExpr("user_id as c_custkey", "cast(value as string) as value", f"{sev} as severity")
    j = e.join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "left")
    return findings.overlay(j, "c_mktsegment")


SQL["a16_overlay"] = "SELECT c_mktsegment, round(sum(v), 6) AS sum, round(max(v), 6) AS max, round(avg(v), 6) AS avg, CASE max(s) WHEN 3 THEN 'error' WHEN 2 THEN 'warn' ELSE 'info' END AS severity, count(*) AS points FROM (SELECT user_id, coalesce(value, 1.0) AS v, CASE WHEN event_type = 'error' THEN 3 WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS s FROM events) e LEFT JOIN customer ON c_custkey = user_id GROUP BY 1"


def a18_confidence(spark, d):
    """Entry points, distinct methods, and repositories with a technology but without any route."""
    a = apis(spark, d)
    bare = repos(spark, d).where("technology is not null").join(a, "repo_id", "left_anti").agg(F.count("*").alias("without_routes"))
    return a.agg(F.count("*").alias("entry_points"), F.countDistinct("method").alias("methods")).crossJoin(bare)


SQL["a18_confidence"] = f"WITH {sql_apis()}, {SQL_REPOS} SELECT count(*) AS entry_points, count(DISTINCT method) AS methods, (SELECT count(*) FROM r WHERE technology IS NOT NULL AND repo_id NOT IN (SELECT repo_id FROM w)) AS without_routes FROM w"


def a20_histogram(spark, d):
    a = apis(spark, d).groupBy(F.upper("method").alias("method")).agg(F.count("*").alias("n"), F.count(F.when(F.col("auth") == "required", 1)).alias("required"))
    return a.withColumn("share", F.round(F.col("required") / F.col("n"), 6))


SQL["a20_histogram"] = f"WITH {sql_apis()} SELECT upper(method) AS method, count(*) AS n, count(*) FILTER (WHERE auth = 'required') AS required, round(count(*) FILTER (WHERE auth = 'required') / count(*), 6) AS share FROM w GROUP BY 1"


def a21_buckets(spark, d):
    """External providers put into every bucket whose pattern their name matches, else into none; sorted by size."""
    patterns = {"storage": "bucket|record|snapshot", "compute": "cluster|node|batch", "network": "edge|route|header", "queue": "retry|cursor|window"}
    names = table(spark, d, "shared_externals").select(F.lower(F.trim("name")).alias("name")).where("name is not null").distinct()
    hits = F.array_compact(F.array(*[F.when(F.col("name").rlike(p), F.lit(k)) for k, p in patterns.items()]))
    b = names.select("name", F.explode(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("__uncategorized__")))).alias("bucket"))
    return b.groupBy("bucket").agg(F.count("*").alias("names"))


SQL["a21_buckets"] = "WITH n AS (SELECT DISTINCT lower(trim(name)) AS name FROM shared_externals WHERE name IS NOT NULL), h AS (SELECT name, list_filter([CASE WHEN regexp_matches(name, 'bucket|record|snapshot') THEN 'storage' END, CASE WHEN regexp_matches(name, 'cluster|node|batch') THEN 'compute' END, CASE WHEN regexp_matches(name, 'edge|route|header') THEN 'network' END, CASE WHEN regexp_matches(name, 'retry|cursor|window') THEN 'queue' END], lambda x: x IS NOT NULL) AS b FROM n) SELECT bucket, count(*) AS names FROM (SELECT unnest(CASE WHEN len(b) > 0 THEN b ELSE ['__uncategorized__'] END) AS bucket FROM h) GROUP BY 1"


def a22_quality(spark, d):
    """Precision, recall and F1 of the delivered language against the guess 'en if mostly ASCII', per kind of document."""
    t = table(spark, d, "documents").where("text is not null and lang is not null")
    x = t.select("doc_kind", (F.length(F.regexp_replace("text", r"[^\x00-\x7F]", "")) >= 0.985 * F.length("text")).alias("predicted"), (F.lower("lang").startswith("en")).alias("actual"))
    return findings.precision_recall(x, "predicted", "actual", ["doc_kind"])


SQL["a22_quality"] = "WITH x AS (SELECT doc_kind, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) >= 0.985 * length(text) AS p, starts_with(lower(lang), 'en') AS a FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL), c AS (SELECT doc_kind, count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE p) AS predicted, count(*) FILTER (WHERE a) AS actual FROM x GROUP BY 1), r AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS pr, coalesce(tp / nullif(actual, 0), 0) AS rc FROM c) SELECT doc_kind, tp, predicted, actual, round(pr, 6) AS precision, round(rc, 6) AS recall, round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 6) AS f1 FROM r"

RULES = {
    "auth_on_writes": ("warning", "upper(method) in ('POST', 'PUT', 'PATCH', 'DELETE') and coalesce(auth, '') <> 'required' and not coalesce(error, false) and not coalesce(webhook, false) and not exists(coalesce(middlewares, array()), m -> m rlike '(?i)^(auth|jwt|passport)')"),
    "named_handler": ("info", "handler_name is null or handler_name = '<anonymous>'"),
    "webhook_provider": ("error", "coalesce(webhook, false) and webhook_provider is null"),
}


def r14_rules(spark, d):
    return findings.violations(apis(spark, d), RULES, ["repo_id", "api_id"]).groupBy("rule", "severity").agg(F.count("*").alias("n"))


SQL["r14_rules"] = f"""WITH {sql_apis()}, v AS (SELECT 'auth_on_writes' AS rule, 'warning' AS severity FROM w WHERE upper(method) IN ('POST', 'PUT', 'PATCH', 'DELETE') AND coalesce(auth, '') <> 'required' AND NOT coalesce(error, false) AND NOT coalesce(webhook, false) AND len(list_filter(coalesce(middlewares, []), lambda m: regexp_matches(m, '(?i)^(auth|jwt|passport)'))) = 0
UNION ALL SELECT 'named_handler', 'info' FROM w WHERE handler_name IS NULL OR handler_name = '<anonymous>' UNION ALL SELECT 'webhook_provider', 'error' FROM w WHERE coalesce(webhook, false) AND webhook_provider IS NULL)
SELECT rule, severity, count(*) AS n FROM v GROUP BY 1, 2"""


def g27_middleware_kinds(spark, d):
    m = apis(spark, d).select(F.explode("middlewares").alias("name"))
    return m.groupBy(findings.middleware_kind("name").alias("kind")).agg(F.count("*").alias("n"))


SQL["g27_middleware_kinds"] = f"WITH {sql_apis()}, m AS (SELECT lower(unnest(middlewares)) AS n FROM w) SELECT CASE " + " ".join(f"WHEN regexp_matches(n, '{p}') THEN '{k}'" for k, p in findings.MIDDLEWARE_KINDS) + " ELSE 'other' END AS kind, count(*) AS n FROM m GROUP BY 1"


def m2_prioritised_merge(spark, d):
    """Working entities first, baseline ones where none exists."""
    u = apis(spark, d).withColumn("p", F.lit(1)).unionByName(apis(spark, d, "baseline").withColumn("p", F.lit(2)))
    return entities.latest(u, ["repo_id", "api_id"], [F.asc("p")]).groupBy("repo_id", "snapshot_kind").agg(F.count("*").alias("n"))


SQL["m2_prioritised_merge"] = f"WITH {sql_apis()}, {sql_apis('b', 'baseline')} SELECT repo_id, snapshot_kind, count(*) AS n FROM (SELECT repo_id, snapshot_kind, api_id FROM w UNION ALL SELECT repo_id, snapshot_kind, api_id FROM b WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.repo_id = b.repo_id AND w.api_id = b.api_id)) GROUP BY 1, 2"


def m4_coda(spark, d):
    """Consumers of changed edges, the five with the most per target, and how many more there are."""
    from lodeplane.functions.text import filled

    e = table(spark, d, "cross_repo_http_edges").where(F.lower(F.trim("diff")).isin("added", "modified")).select(filled("source_repo").alias("consumer"), filled("target_repo").alias("target"), "edge_id").where("consumer is not null and target is not null").distinct()
    n = e.groupBy("target", "consumer").agg(F.count("*").alias("n"))
    w = Window.partitionBy("target").orderBy(F.desc("n"), "consumer")
    r = n.withColumn("rank", F.row_number().over(w))
    return r.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "consumer")))), lambda x: x["consumer"]), ",").alias("top"), F.count(F.when(F.col("rank") > 5, 1)).alias("more"))


SQL["m4_coda"] = "WITH e AS (SELECT DISTINCT nullif(lower(trim(source_repo)), '') AS consumer, nullif(lower(trim(target_repo)), '') AS target, edge_id FROM cross_repo_http_edges WHERE lower(trim(diff)) IN ('added', 'modified')), n AS (SELECT target, consumer, count(*) AS n FROM e WHERE consumer IS NOT NULL AND target IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY n DESC, consumer) AS rn FROM n) SELECT target, string_agg(consumer, ',' ORDER BY rn) FILTER (WHERE rn <= 5) AS top, count(*) FILTER (WHERE rn > 5) AS more FROM k GROUP BY 1"


def m8_changed_files(spark, d):
    """Changed files by hash: new ones included, deleted ones not."""
    b = files(spark, d, "baseline").select("repo_id", "path", F.col("hash").alias("h0"))
    return files(spark, d).join(b, ["repo_id", "path"], "left").where(F.col("h0").isNull() | (F.col("h0") != F.col("hash"))).groupBy("repo_id").agg(F.count("*").alias("n"))


SQL["m8_changed_files"] = f"WITH {sql_files('b', 'baseline')}, {sql_files('f')} SELECT f.repo_id, count(*) AS n FROM f LEFT JOIN b ON b.repo_id = f.repo_id AND b.path = f.path WHERE b.hash IS NULL OR b.hash <> f.hash GROUP BY 1"


def m12_collections(spark, d):
    """Endpoints of each group sorted by method and route, collections by size."""
    a = apis(spark, d).where("method is not null and route is not null").select("repo_id", F.concat_ws(" ", "method", "route").alias("e")).distinct()
    return a.groupBy("repo_id").agg(F.count("*").alias("size"), F.md5(F.array_join(F.array_sort(F.collect_list("e")), "\n")).alias("digest"))


SQL["m12_collections"] = f"WITH {sql_apis()}, a AS (SELECT DISTINCT repo_id, method || ' ' || route AS e FROM w WHERE method IS NOT NULL AND route IS NOT NULL) SELECT repo_id, count(*) AS size, md5(string_agg(e, chr(10) ORDER BY e)) AS digest FROM a GROUP BY 1"


def m13_json_paths(spark, d):
    """Values at a dotted path of the JSON in events."""
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.max("k").alias("max_k"))


SQL["m13_json_paths"] = "SELECT event_type, count(json_extract_string(props, '$.k')) AS n, max(CAST(json_extract_string(props, '$.k') AS INT)) AS max_k FROM events GROUP BY 1"


def m21_audit_trail(spark, d):
    """An entry per change of status along the deliveries of a repository's marks; repeats add none."""
    from lodeplane.functions.text import filled

    e = table(spark, d, "cross_repo_http_edges").groupBy(filled("source_repo").alias("repo"), "snapshot_no").agg(F.max(F.coalesce(filled("diff"), F.lit("unchanged"))).alias("mark"))
    w = Window.partitionBy("repo").orderBy("snapshot_no")
    changed = e.withColumn("before", F.lag("mark").over(w)).where(~F.col("mark").eqNullSafe(F.col("before")) & F.col("before").isNotNull())
    return changed.groupBy("repo").agg(F.count("*").alias("entries"), F.max(F.struct("snapshot_no", "before", "mark")).alias("x")).select("repo", "entries", F.col("x.before").alias("last_from"), F.col("x.mark").alias("last_to"))


SQL["m21_audit_trail"] = "WITH e AS (SELECT nullif(lower(trim(source_repo)), '') AS repo, snapshot_no, max(coalesce(nullif(lower(trim(diff)), ''), 'unchanged')) AS mark FROM cross_repo_http_edges GROUP BY 1, 2), l AS (SELECT *, lag(mark) OVER (PARTITION BY repo ORDER BY snapshot_no) AS before FROM e), c AS (SELECT * FROM l WHERE before IS NOT NULL AND before <> mark) SELECT repo, count(*) AS entries, arg_max(before, snapshot_no) AS last_from, arg_max(mark, snapshot_no) AS last_to FROM c GROUP BY 1"

QUERIES, ORACLE = collect(globals(), SQL)
