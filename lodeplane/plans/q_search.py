"""Queries: search, similarity and domains (r), redaction and marker counts (f)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeplane.functions import routes
from lodeplane.functions.tokens import STOP_WORDS, tokens
from lodeplane.operators import search
from lodeplane.plans.common import apis, collect, files, sql_apis, sql_files
from lodeplane.sources.tables import table

SQL: dict[str, str] = {}
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _tok(c):
    words = f"list_filter(string_split_regex(coalesce({c}, ''), '[^A-Za-z0-9_]+'), lambda w: w <> '')"
    parts = f"flatten(list_transform({words}, lambda w: string_split_regex(lower(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g')), '[_\\-./\\s]+')))"
    return f"list_distinct(list_filter(list_concat(list_transform({words}, lambda w: lower(w)), {parts}), lambda t: length(t) >= 2 AND t NOT IN ({_STOP})))"


def r1_tokens(spark, d):
    """How many entry points hold each token of handler and route."""
    a = apis(spark, d).select(F.explode(tokens(F.concat_ws(" ", "handler_name", "route"))).alias("token"))
    return a.groupBy("token").agg(F.count("*").alias("n"))


SQL["r1_tokens"] = f"WITH {sql_apis()} SELECT token, count(*) AS n FROM (SELECT unnest({_tok(chr(99) + 'oncat_ws(' + chr(39) + ' ' + chr(39) + ', handler_name, route)')}) AS token FROM w) GROUP BY 1"


def _entities(spark, d):
    a = apis(spark, d).select(F.lit("route").alias("kind"), F.concat_ws("|", "repo_id", "api_id").alias("id"), tokens(F.concat_ws(" ", "handler_name", "route")).alias("primary"), tokens("file_path").alias("secondary"), (F.coalesce("diff", F.lit("unchanged")) != "unchanged").alias("changed"))
    f = files(spark, d).select(F.lit("file").alias("kind"), F.concat_ws("|", "repo_id", "path").alias("id"), tokens(F.element_at(F.split("path", "/"), -1)).alias("primary"), tokens("path").alias("secondary"), F.lit(False).alias("changed"))
    return a.unionByName(f)


def r2_index(spark, d):
    return search.indexed(_entities(spark, d)).groupBy("token", "kind").agg(F.count("*").alias("entities"), F.sum("weight").alias("weight"))


_ENT = f"""ent AS (SELECT 'route' AS kind, repo_id || '|' || api_id AS id, {_tok("concat_ws(' ', handler_name, route)")} AS p, {_tok('file_path')} AS s, coalesce(diff, 'unchanged') <> 'unchanged' AS changed FROM w
UNION ALL SELECT 'file', repo_id || '|' || path, {_tok("regexp_replace(path, '^.*/', '')")}, {_tok('path')}, false FROM f)"""
SQL["r2_index"] = f"WITH {sql_apis()}, {sql_files()}, {_ENT}, x AS (SELECT kind, unnest(p) AS token, 3 AS weight FROM ent UNION ALL SELECT kind, unnest(list_filter(s, lambda t: NOT list_contains(p, t))), 1 FROM ent) SELECT token, kind, count(*) AS entities, sum(weight) AS weight FROM x GROUP BY 1, 2"
_WORDS = ("session", "token", "settle", "invoice")


def r3_search(spark, d):
    return search.search(_entities(spark, d), _WORDS)


_HITS = "[" + ", ".join(f"CASE WHEN list_contains(p, '{w}') THEN 3 WHEN list_contains(s, '{w}') THEN 1 ELSE 0 END" for w in sorted(_WORDS)) + "]"
SQL["r3_search"] = f"""WITH {sql_apis()}, {sql_files()}, {_ENT}, h AS (SELECT kind, id, changed, {_HITS} AS h FROM ent), g AS (SELECT kind, id, list_sum(h) * len(list_filter(h, lambda x: x > 0)) / 4.0 * CASE kind WHEN 'route' THEN 1.6 ELSE 0.8 END * CASE WHEN changed THEN 1.2 ELSE 1.0 END AS raw FROM h)
SELECT kind, id, score FROM (SELECT kind, id, round(CAST(raw AS DOUBLE) / (SELECT max(CAST(raw AS DOUBLE)) FROM g), 3) AS score FROM g WHERE raw > 0) WHERE score >= 0.05 ORDER BY score DESC, kind, id LIMIT 20"""


def r8_similar_routes(spark, d):
    """Entry points like those of webhooks, counted by score."""
    return search.similar_counts(apis(spark, d), F.col("webhook"))


_SHAPE = "array_to_string(list_transform(string_split(route, '/'), lambda s: CASE WHEN starts_with(s, ':') THEN ':p' WHEN regexp_matches(s, '^[A-Za-z0-9_-]+$') THEN 'W' ELSE s END), '/')"
SQL["r8_similar_routes"] = f"""WITH {sql_apis()}, x AS (SELECT repo_id || '|' || api_id AS id, upper(method) AS method, coalesce(middlewares, []) AS m, {_SHAPE} AS s, repo_id || '|' || file_path AS f, webhook FROM w),
p AS (SELECT a.id AS target, round(0.5 * len(list_intersect(a.m, b.m)) / greatest(len(a.m), len(b.m), 1) + 0.3 * CASE WHEN a.s = b.s THEN 1.0 ELSE 0.3 END + 0.2 * CASE WHEN a.f = b.f THEN 0.4 ELSE 0.0 END, 3) AS score FROM x a JOIN x b ON a.method = b.method AND a.id <> b.id WHERE a.webhook)
SELECT target, count(*) AS n, max(score) AS best FROM p WHERE score > 0.2 GROUP BY 1"""


def r9_nearest_vectors(spark, d):
    """The ten vectors most like vector 0."""
    v = table(spark, d, "embeddings")
    first = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return v.crossJoin(F.broadcast(first)).select("vec_id", F.round(search.cosine("embedding", "q"), 4).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(10)


SQL["r9_nearest_vectors"] = "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 4) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 10"


def r10_exact_evidence(spark, d):
    """Lines that define functions in working files and that the baseline of their file holds, blanks squeezed."""
    from lodeplane.operators import callgraph

    n = callgraph.lines(files(spark, d)).where(callgraph.defined("path", "src").isNotNull()).select("repo_id", "path", "src").distinct()
    h = files(spark, d, "baseline").where("content is not null").select("repo_id", "path", "content")
    return search.exact_evidence(n, h, ["repo_id", "path"], "src", "content").groupBy("repo_id").agg(F.count("*").alias("n"))


def _lines_sql() -> str:
    from lodeplane.plans.q_functions import _LINES

    return _LINES


_SQUEEZED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
SQL["r10_exact_evidence"] = f"WITH {_lines_sql()}, {sql_files('b', 'baseline')}, x AS (SELECT DISTINCT repo_id, path, src FROM n WHERE name IS NOT NULL) SELECT x.repo_id, count(*) AS n FROM x JOIN b ON b.repo_id = x.repo_id AND b.path = x.path WHERE length({_SQUEEZED.format('src')}) >= 8 AND contains({_SQUEEZED.format('b.content')}, {_SQUEEZED.format('src')}) GROUP BY 1"


#: Intents by keyword, the first that a route contains wins (fixed values).
DOMAINS = (("auth", "Authenticate users"), ("login", "Authenticate users"), ("session", "Authenticate users"), ("token", "Authenticate users"), ("payment", "Process payments"), ("billing", "Process payments"), ("invoice", "Process payments"), ("checkout", "Process payments"), ("order", "Manage orders"), ("cart", "Manage orders"), ("search", "Search content"), ("query", "Search content"), ("index", "Search content"), ("webhook", "Integrate with external services"), ("user", "Manage profiles"), ("health", "Health & readiness"), ("status", "Health & readiness"), ("file", "Transfer files"), ("catalog", "Manage products"), ("refund", "Process payments"), ("dispute", "Process payments"), ("coupon", "Process payments"))


def r12_domains(spark, d):
    """Entry points and repositories per intent; 0.6 if the route names it, 0.2 if nothing does."""
    dom = search.first_keyword(F.lower("route"), DOMAINS, "Other")
    a = apis(spark, d).where("route is not null").select("repo_id", dom.alias("domain"))
    return a.groupBy("domain").agg(F.count("*").alias("routes"), F.countDistinct("repo_id").alias("repositories"), F.max(F.when(F.col("domain") == "Other", 0.2).otherwise(0.6)).alias("confidence"))


SQL["r12_domains"] = f"WITH {sql_apis()}, x AS (SELECT repo_id, CASE " + " ".join(f"WHEN contains(lower(route), '{k}') THEN '{v}'" for k, v in DOMAINS) + " ELSE 'Other' END AS domain FROM w WHERE route IS NOT NULL) SELECT domain, count(*) AS routes, count(DISTINCT repo_id) AS repositories, max(CAST(CASE WHEN domain = 'Other' THEN 0.2 ELSE 0.6 END AS DOUBLE)) AS confidence FROM x GROUP BY 1"


def r11_tour(spark, d):
    """Thirty entry points to read first: writing ones before reading ones, by the number of callers of their repository."""
    from lodeplane.plans.common import repo_edges

    fan = repo_edges(spark, d).groupBy(F.col("dst").alias("repo")).agg(F.countDistinct("src").alias("fan_in"))
    rank = F.when(F.upper("method") == "POST", 0).when(F.upper("method").isin("PUT", "PATCH"), 1).when(F.upper("method") == "GET", 2).otherwise(3)
    a = apis(spark, d).where("handler_name <> '<anonymous>'").withColumn("repo", F.lower("repo_id")).join(fan, "repo", "left")
    return a.select("repo_id", "api_id", rank.alias("verb_rank"), F.coalesce("fan_in", F.lit(0)).alias("fan_in")).orderBy("verb_rank", F.desc("fan_in"), "repo_id", "api_id").limit(30)


from lodeplane.plans.common import SQL_EDGES  # noqa: E402

SQL["r11_tour"] = f"WITH {SQL_EDGES}, {sql_apis()}, n AS (SELECT dst, count(DISTINCT src) AS fan_in FROM e GROUP BY 1) SELECT repo_id, api_id, CASE WHEN upper(method) = 'POST' THEN 0 WHEN upper(method) IN ('PUT', 'PATCH') THEN 1 WHEN upper(method) = 'GET' THEN 2 ELSE 3 END AS verb_rank, coalesce(fan_in, 0) AS fan_in FROM w LEFT JOIN n ON n.dst = lower(repo_id) WHERE handler_name <> '<anonymous>' ORDER BY verb_rank, fan_in DESC, repo_id, api_id LIMIT 30"


def f12_marker_counts(spark, d):
    """Marks of open work in each file: an overlay of counts."""
    n = F.regexp_count("content", F.lit(r"\b(TODO|FIXME|HACK|XXX)\b"))
    return files(spark, d).where("content is not null").select("repo_id", n.alias("n")).groupBy("repo_id").agg(F.sum("n").alias("marks"))


SQL["f12_marker_counts"] = f"WITH {sql_files()} SELECT repo_id, sum(len(regexp_extract_all(content, '\\b(TODO|FIXME|HACK|XXX)\\b'))) AS marks FROM f WHERE content IS NOT NULL GROUP BY 1"


def j4_template_match(spark, d):
    """Routes called across repositories that match the template of an entry point of the called one; candidates have the same
    first word and number of segments."""
    from lodeplane.functions.text import filled
    from lodeplane.plans.common import called_route, served_route

    word = lambda c: F.split(c, "/")[1]
    c = table(spark, d, "cross_repo_http_edges").select(filled("target_repo").alias("repo"), F.regexp_replace(called_route(), r"/+$", "").alias("call")).where("repo is not null").distinct().withColumn("word", word(F.col("call"))).withColumn("n", F.size(F.split("call", "/")))
    a = apis(spark, d).select(F.lower("repo_id").alias("repo"), F.regexp_replace(served_route(), r"/+$", "").alias("tpl")).distinct().select("repo", word(F.col("tpl")).alias("word"), F.size(F.split("tpl", "/")).alias("n"), routes.template_regex("tpl").alias("tpl"))
    return c.join(a, ["repo", "word", "n"]).where(F.expr("call rlike tpl")).select("repo", "call").distinct().groupBy("repo").agg(F.count("*").alias("matched"))


from lodeplane.plans.common import sql_called, sql_served  # noqa: E402

_TEMPLATE = "'^' || regexp_replace(regexp_replace(tpl, '([.+*?^$|()\\[\\]\\\\])', '\\\\\\1', 'g'), ':[A-Za-z_]\\w*|\\{[A-Za-z_]\\w*\\}|<[A-Za-z_]\\w*>', '[^/]+', 'g') || '$'"
SQL["j4_template_match"] = f"WITH {sql_apis()}, c AS (SELECT DISTINCT nullif(lower(trim(target_repo)), '') AS repo, regexp_replace({sql_called()}, '/+$', '') AS call FROM cross_repo_http_edges), a AS (SELECT DISTINCT lower(repo_id) AS repo, regexp_replace({sql_served()}, '/+$', '') AS tpl FROM w) SELECT repo, count(*) AS matched FROM (SELECT DISTINCT c.repo, call FROM c JOIN a USING (repo) WHERE regexp_matches(call, {_TEMPLATE})) GROUP BY 1"

QUERIES, ORACLE = collect(globals(), SQL)
