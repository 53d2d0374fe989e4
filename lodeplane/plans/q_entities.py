"""Queries: sources and snapshots (s), filters (f), paging (l), windows (w), set operations (u), path joins (j)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeplane.functions import paths, routes
from lodeplane.operators import diffs, entities
from lodeplane.plans.common import SQL_REPOS, apis, collect, files, repos, sql_apis, sql_files, called_route, served_route, sql_called, sql_served
from lodeplane.sources.tables import table

SQL: dict[str, str] = {}


def s1_hashed_files(spark, d):
    """Content hashes of the files of each repository, without the ignored directories."""
    f = files(spark, d).where(~F.col("path").rlike(r"(^|/)(node_modules|\.git|dist|build|\.venv)/"))
    return f.select("repo_id", "path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("chars"))


SQL["s1_hashed_files"] = f"WITH {sql_files()} SELECT repo_id, path, sha256(content) AS sha256, length(content) AS chars FROM f WHERE NOT regexp_matches(path, '(^|/)(node_modules|\\.git|dist|build|\\.venv)/')"


def s2_read_capped(spark, d):
    """Files within the size cap of 5 MB, with their bytes."""
    return files(spark, d).where(F.octet_length("content") <= 5 * 1024 * 1024).groupBy("repo_id").agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes"))


SQL["s2_read_capped"] = f"WITH {sql_files()} SELECT repo_id, count(*) AS files, sum(octet_length(encode(content))) AS bytes FROM f WHERE octet_length(encode(content)) <= 5242880 GROUP BY 1"


def s3_languages(spark, d):
    return files(spark, d).groupBy("repo_id", paths.language("path").alias("language")).agg(F.count("*").alias("files"))


SQL["s3_languages"] = f"WITH {sql_files()} SELECT repo_id, language, count(*) AS files FROM (SELECT repo_id, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.LANGUAGE_OF.items()) + " ELSE 'other' END AS language FROM f) GROUP BY 1, 2"


def s4_snapshot_load(spark, d):
    """All files of both kinds as they are loaded: one row per repository, kind and path."""
    both = files(spark, d, "baseline").unionByName(files(spark, d, "working"))
    return both.groupBy("repo_id", "snapshot_kind").agg(F.count("*").alias("files"), F.count("content").alias("with_content"), F.count("hash").alias("with_hash"))


SQL["s4_snapshot_load"] = f"WITH {sql_files('b', 'baseline')}, {sql_files('w')} SELECT repo_id, snapshot_kind, count(*) AS files, count(content) AS with_content, count(hash) AS with_hash FROM (SELECT * FROM b UNION ALL SELECT * FROM w) GROUP BY 1, 2"


def s6_promoted(spark, d):
    """The working files become the baseline: what the comparison of the two kinds then says (nothing changed)."""
    w = files(spark, d)
    promoted = w.withColumn("snapshot_kind", F.lit("baseline"))
    return diffs.counts(diffs.keyed_diff(promoted, w, ["repo_id", "path"], ["hash", "mtime"]), ["repo_id"])


SQL["s6_promoted"] = f"WITH {sql_files()} SELECT repo_id, 0 AS added, 0 AS deleted, 0 AS modified, count(*) AS unchanged, false AS has_changes FROM f GROUP BY 1"


def s8_content_scan(spark, d):
    return files(spark, d).where("content is not null").select("repo_id", "path", F.length("content").alias("chars"))


SQL["s8_content_scan"] = f"WITH {sql_files()} SELECT repo_id, path, length(content) AS chars FROM f WHERE content IS NOT NULL"


def f1_entry_points(spark, d):
    return entities.entry_points(apis(spark, d), repos(spark, d), method="post", contains="/v1/").select("repo_id", "api_id", "route", "technology")


SQL["f1_entry_points"] = f"WITH {sql_apis()}, {SQL_REPOS} SELECT w.repo_id, api_id, route, technology FROM w LEFT JOIN r USING (repo_id) WHERE upper(method) = 'POST' AND contains(lower(route), '/v1/')"


def f1_changed_entry_points(spark, d):
    return entities.entry_points(apis(spark, d), repos(spark, d), only_changed=True, auth="required").groupBy("repo_id").agg(F.count("*").alias("n"))


SQL["f1_changed_entry_points"] = f"WITH {sql_apis()} SELECT repo_id, count(*) AS n FROM w WHERE coalesce(diff, 'unchanged') <> 'unchanged' AND auth = 'required' GROUP BY 1"


def f4_test_paths(spark, d):
    f = files(spark, d)
    return f.select("repo_id", "path", *[paths.is_test("path", n).alias(n) for n in paths.TEST_PATHS])


SQL["f4_test_paths"] = f"WITH {sql_files()} SELECT repo_id, path, " + ", ".join(f"regexp_matches(path, '{p}') AS {n}" for n, p in paths.TEST_PATHS.items()) + " FROM f"


def f5_clusterable(spark, d):
    with_api = apis(spark, d).select("repo_id", F.col("file_path").alias("path")).distinct().withColumn("has_api", F.lit(True))
    j = files(spark, d).join(with_api, ["repo_id", "path"], "left")
    return j.where(paths.clusterable("path", F.coalesce("has_api", F.lit(False)))).select("repo_id", "path")


_BASE = "regexp_replace(f.path, '^.*/', '')"
SQL["f5_clusterable"] = f"""WITH {sql_apis()}, {sql_files()}, a AS (SELECT DISTINCT repo_id, file_path AS path FROM w)
SELECT f.repo_id, f.path FROM f LEFT JOIN a ON a.repo_id = f.repo_id AND a.path = f.path
WHERE NOT (regexp_matches(f.path, '{paths.TOOL_DIRS}') OR regexp_matches({_BASE}, '{paths.TEST_NAME}') OR regexp_matches({_BASE}, '{paths.CONFIG_NAME}') OR regexp_matches({_BASE}, '{paths.SETUP_NAME}') OR regexp_matches({_BASE}, '[mM]ock'))
AND (a.path IS NOT NULL OR NOT (regexp_matches(f.path, '{paths.SEED_PATH}') OR (len(string_split(f.path, '/')) <= 2 AND regexp_matches({_BASE}, '{paths.ENTRY_NAME}'))))"""


def f6_headline_apis(spark, d):
    """Counts without screens and navigation routes."""
    return apis(spark, d).where(~F.upper("method").isin("SCREEN", "NAV_ROUTE")).groupBy("repo_id").agg(F.count("*").alias("n"))


SQL["f6_headline_apis"] = f"WITH {sql_apis()} SELECT repo_id, count(*) AS n FROM w WHERE upper(method) NOT IN ('SCREEN', 'NAV_ROUTE') GROUP BY 1"


def f7_scoped(spark, d):
    return entities.scoped(files(spark, d), "path", "src").groupBy("repo_id").agg(F.count("*").alias("files"))


SQL["f7_scoped"] = f"WITH {sql_files()} SELECT repo_id, count(*) AS files FROM f WHERE path = 'src' OR starts_with(path, 'src/') GROUP BY 1"


def f8_known_repos_only(spark, d):
    """Entry points whose repository is in the registry and not removed."""
    gone = apis(spark, d).join(repos(spark, d).where("removed_at is null").select("repo_id"), "repo_id", "left_semi")
    return gone.groupBy("repo_id").agg(F.count("*").alias("n"))


SQL["f8_known_repos_only"] = f"WITH {sql_apis()}, {SQL_REPOS} SELECT repo_id, count(*) AS n FROM w WHERE repo_id IN (SELECT repo_id FROM r WHERE removed_at IS NULL) GROUP BY 1"


def l1_page(spark, d):
    return entities.page(apis(spark, d).select("repo_id", "api_id"), [F.col("repo_id"), F.col("api_id")], cursor=100, limit=50)


SQL["l1_page"] = f"WITH {sql_apis()} SELECT repo_id, api_id, position, (SELECT count(*) FROM w) AS total FROM (SELECT repo_id, api_id, row_number() OVER (ORDER BY repo_id, api_id) - 1 AS position FROM w) WHERE position BETWEEN 100 AND 149"


def l2_budget(spark, d):
    """Per repository the routes that fit into 200 tokens."""
    a = apis(spark, d).where("method is not null and route is not null").select("repo_id", "api_id", "method", "route")
    return entities.within_budget(a, [F.col("api_id")], ["method", "route"], 200, partition=["repo_id"]).select("repo_id", "api_id", "bytes_upto")


SQL["l2_budget"] = f"""WITH {sql_apis()}, s AS (SELECT repo_id, api_id, 2 + sum(octet_length(encode('{{"method":"' || method || '","route":"' || route || '"}}')) + 1) OVER (PARTITION BY repo_id ORDER BY api_id ROWS UNBOUNDED PRECEDING) AS bytes_upto FROM w WHERE method IS NOT NULL AND route IS NOT NULL)
SELECT repo_id, api_id, bytes_upto FROM s WHERE bytes_upto <= 800"""


def l4_top_repos(spark, d):
    a = apis(spark, d).groupBy("repo_id").agg(F.count("*").alias("n"))
    return a.orderBy(F.desc("n"), "repo_id").limit(10)


SQL["l4_top_repos"] = f"WITH {sql_apis()} SELECT repo_id, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, repo_id LIMIT 10"


def l5_relevant_first(spark, d):
    """Per repository at most ten entry points, the changed ones first, given back in their own order."""
    from pyspark.sql import Window

    relevant = (F.coalesce("diff", F.lit("unchanged")) != "unchanged").cast("int")
    w = Window.partitionBy("repo_id").orderBy(F.desc(relevant), "api_id")
    return apis(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("repo_id", "api_id", F.row_number().over(Window.partitionBy("repo_id").orderBy("api_id")).alias("position"))


SQL["l5_relevant_first"] = f"""WITH {sql_apis()}, k AS (SELECT repo_id, api_id, row_number() OVER (PARTITION BY repo_id ORDER BY CASE WHEN coalesce(diff, 'unchanged') <> 'unchanged' THEN 0 ELSE 1 END, api_id) AS rk FROM w)
SELECT repo_id, api_id, row_number() OVER (PARTITION BY repo_id ORDER BY api_id) AS position FROM k WHERE rk <= 10"""


def a9_surface(spark, d):
    return entities.surface(apis(spark, d))


SQL["a9_surface"] = f"""WITH {sql_apis()}, k AS (SELECT repo_id, upper(method) AS method, route, coalesce(handler_name, '') AS handler_name, row_number() OVER (PARTITION BY repo_id, upper(method), route ORDER BY CASE WHEN lower(handler_name) IN ('<anonymous>', 'anonymous', 'handler', 'default') THEN 1 WHEN handler_name IS NULL THEN -1 ELSE 0 END, coalesce(handler_name, ''), api_id) AS rn, count(*) OVER (PARTITION BY repo_id, upper(method), route) AS records FROM w)
SELECT repo_id, method, route, handler_name, records FROM k WHERE rn = 1"""


def w2_last_event(spark, d):
    """The last event of each user."""
    e = table(spark, d, "events")
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("x")
    return e.groupBy("user_id").agg(last).select("user_id", F.col("x.event_id").alias("event_id"), F.col("x.event_type").alias("event_type"))


SQL["w2_last_event"] = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"


def w3_first_delivery(spark, d):
    """The first delivery of each entry point."""
    a = table(spark, d, "apis").where("api_id is not null")
    return a.groupBy("snapshot_kind", "repo_id", "api_id").agg(F.min("received_at").alias("first_received"), F.count("*").alias("rows"))


SQL["w3_first_delivery"] = "SELECT snapshot_kind, repo_id, api_id, min(received_at) AS first_received, count(*) AS rows FROM apis WHERE api_id IS NOT NULL GROUP BY 1, 2, 3"


def w4_bounded_log(spark, d):
    """The last ten events of each user and type: a bounded change log."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 10").select("user_id", "event_type", "event_id", "n")


SQL["w4_bounded_log"] = "SELECT user_id, event_type, event_id, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 10"


def u1_compare_workspaces(spark, d):
    """Entry points only in the baseline, only in the working snapshot, and shared, per repository."""
    key = F.concat_ws(" ", F.upper("method"), "route").alias("k")
    b, w = apis(spark, d, "baseline").select("repo_id", key).distinct(), apis(spark, d).select("repo_id", key).distinct()
    j = b.withColumn("b", F.lit(1)).join(w.withColumn("w", F.lit(1)), ["repo_id", "k"], "full_outer")
    return j.groupBy("repo_id").agg(F.count(F.when(F.col("w").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_right"), F.count(F.when(F.col("b").isNotNull() & F.col("w").isNotNull(), 1)).alias("shared"))


SQL["u1_compare_workspaces"] = f"""WITH {sql_apis('b0', 'baseline')}, {sql_apis('w0')}, b AS (SELECT DISTINCT repo_id, upper(method) || ' ' || route AS k, 1 AS b FROM b0), w AS (SELECT DISTINCT repo_id, upper(method) || ' ' || route AS k, 1 AS w FROM w0)
SELECT repo_id, count(*) FILTER (WHERE w IS NULL) AS only_left, count(*) FILTER (WHERE b IS NULL) AS only_right, count(*) FILTER (WHERE b IS NOT NULL AND w IS NOT NULL) AS shared FROM b FULL JOIN w USING (repo_id, k) GROUP BY 1"""


def u2_union_of_graphs(spark, d):
    """One map graph out of those of all repositories: nodes by type."""
    r = repos(spark, d).select(F.lit("repo").alias("type"), F.col("repo_id").alias("id"))
    a = apis(spark, d).select(F.lit("api").alias("type"), F.concat_ws("|", "repo_id", "api_id").alias("id"))
    f = files(spark, d).select(F.lit("file").alias("type"), F.concat_ws("|", "repo_id", "path").alias("id"))
    return r.unionByName(a).unionByName(f).distinct().groupBy("type").agg(F.count("*").alias("nodes"))


SQL["u2_union_of_graphs"] = f"WITH {sql_apis()}, {sql_files()} SELECT 'repo' AS type, count(DISTINCT repo_id) AS nodes FROM repos UNION ALL SELECT 'api', count(DISTINCT repo_id || '|' || api_id) FROM w UNION ALL SELECT 'file', count(DISTINCT repo_id || '|' || path) FROM f"


def u3_merged_index(spark, d):
    """Baseline and working entry points in one index, the later row winning."""
    both = apis(spark, d, "baseline").unionByName(apis(spark, d))
    last = entities.latest(both, ["repo_id", "api_id"], [F.desc_nulls_last("received_at"), F.desc("snapshot_kind")])
    return last.groupBy("snapshot_kind").agg(F.count("*").alias("n"))


SQL["u3_merged_index"] = f"WITH {sql_apis('b', 'baseline')}, {sql_apis()}, k AS (SELECT *, row_number() OVER (PARTITION BY repo_id, api_id ORDER BY received_at DESC NULLS LAST, snapshot_kind DESC) AS rn FROM (SELECT * FROM b UNION ALL SELECT * FROM w)) SELECT snapshot_kind, count(*) AS n FROM k WHERE rn = 1 GROUP BY 1"


def u5_line_multisets(spark, d):
    """Lines added and removed per changed file, as multisets."""
    keys = ["repo_id", "path"]
    b, w = files(spark, d, "baseline").select(*keys, "content", "hash"), files(spark, d).select(*keys, "content", "hash")
    changed = diffs.keyed_diff(b, w, keys, ["hash"]).where("status = 'modified'").select(*keys)
    lines = diffs.line_multiset_diff(b.join(changed, keys, "left_semi"), w.join(changed, keys, "left_semi"), keys, "content")
    return lines.groupBy(*keys, "side").agg(F.count("*").alias("lines"))


_LINES = "SELECT repo_id, path, line, count(*) AS n FROM (SELECT repo_id, path, unnest(string_split_regex(content, '\\r?\\n|\\r')) AS line FROM {t} WHERE (repo_id, path) IN (SELECT (repo_id, path) FROM c)) GROUP BY 1, 2, 3"
SQL["u5_line_multisets"] = f"""WITH {sql_files('b', 'baseline')}, {sql_files('w')}, c AS (SELECT b.repo_id, b.path FROM b JOIN w USING (repo_id, path) WHERE b.hash IS DISTINCT FROM w.hash),
bl AS ({_LINES.format(t='b')}), wl AS ({_LINES.format(t='w')}), j AS (SELECT repo_id, path, coalesce(wl.n, 0) - coalesce(bl.n, 0) AS d FROM bl FULL JOIN wl USING (repo_id, path, line))
SELECT repo_id, path, CASE WHEN d > 0 THEN 'added' ELSE 'removed' END AS side, sum(abs(d)) AS lines FROM j WHERE d <> 0 GROUP BY 1, 2, 3"""


def j1_file_to_group(spark, d):
    """Entry points joined to the group of their file (its directory)."""
    groups = files(spark, d).select("repo_id", F.col("path").alias("file_path"), paths.dirname("path").alias("dir"))
    return apis(spark, d).join(groups, ["repo_id", "file_path"], "left").groupBy("repo_id", "dir").agg(F.count("*").alias("n"))


SQL["j1_file_to_group"] = f"WITH {sql_apis()}, {sql_files()} SELECT w.repo_id, regexp_replace(f.path, '(^|/)[^/]*$', '') AS dir, count(*) AS n FROM w LEFT JOIN f ON f.repo_id = w.repo_id AND f.path = w.file_path GROUP BY 1, 2"


def j2_longest_prefix(spark, d):
    """Files to the service root that owns them: the longest of the directories of depth one and two that hold entry points."""
    roots = apis(spark, d).select(F.explode(F.array(F.array_join(F.slice(F.split("file_path", "/"), 1, 1), "/"), F.array_join(F.slice(F.split("file_path", "/"), 1, 2), "/"))).alias("root")).distinct()
    roots = roots.where(~F.col("root").contains(".")).select("root", F.concat(F.lit("svc:"), "root").alias("id"))
    items = files(spark, d).select("repo_id", "path")
    return entities.owned_by_longest_prefix(items, "path", roots, "root", "id").groupBy("owner").agg(F.count("*").alias("files"))


SQL["j2_longest_prefix"] = f"""WITH {sql_apis()}, {sql_files()}, p AS (SELECT string_split(file_path, '/') AS s FROM w), roots AS (SELECT DISTINCT root FROM (SELECT s[1] AS root FROM p UNION ALL SELECT array_to_string(s[1:2], '/') FROM p) WHERE NOT contains(root, '.')),
o AS (SELECT f.repo_id, f.path, arg_max('svc:' || root, length(root)) AS owner FROM f LEFT JOIN roots ON root = f.path OR starts_with(f.path, root || '/') GROUP BY 1, 2)
SELECT owner, count(*) AS files FROM o GROUP BY 1"""


def j5_canonical_routes(spark, d):
    """Calls across repositories matched with the entry points of the called one on the canonical route; the first verb
    in the order GET, POST, PUT, PATCH, DELETE that has a match wins."""
    from pyspark.sql import Window

    from lodeplane.functions.text import filled

    calls = table(spark, d, "cross_repo_http_edges").select(filled("source_repo").alias("consumer"), filled("target_repo").alias("repo"), routes.canonical(called_route()).alias("canon")).where("consumer is not null and repo is not null").distinct()
    order = F.array_position(F.array(*[F.lit(m) for m in ("GET", "POST", "PUT", "PATCH", "DELETE")]), F.upper("method"))
    served = apis(spark, d).select(F.lower("repo_id").alias("repo"), routes.canonical(served_route()).alias("canon"), F.upper("method").alias("method"), order.alias("verb")).where("verb > 0").distinct()
    w = Window.partitionBy("consumer", "repo", "canon").orderBy("verb")
    return calls.join(served, ["repo", "canon"]).withColumn("rn", F.row_number().over(w)).where("rn = 1").groupBy("repo", "method").agg(F.count("*").alias("calls"), F.countDistinct("consumer").alias("consumers"))


def _canon(c: str) -> str:
    r = f"regexp_replace(regexp_replace({c}, '\\$\\{{[^}}/]*\\}}|\\{{[^}}/]*\\}}|<[^>/]*>|:[A-Za-z_][A-Za-z0-9_]*', ':_', 'g'), '/+', '/', 'g')"
    return f"(CASE WHEN length({r}) > 1 THEN regexp_replace({r}, '/$', '') WHEN {r} = '' THEN '/' ELSE {r} END)"


SQL["j5_canonical_routes"] = f"""WITH {sql_apis()}, c AS (SELECT DISTINCT nullif(lower(trim(source_repo)), '') AS consumer, nullif(lower(trim(target_repo)), '') AS repo, {_canon(sql_called())} AS canon FROM cross_repo_http_edges),
s AS (SELECT DISTINCT lower(repo_id) AS repo, {_canon(sql_served())} AS canon, upper(method) AS method, list_position(['GET', 'POST', 'PUT', 'PATCH', 'DELETE'], upper(method)) AS verb FROM w),
k AS (SELECT consumer, c.repo, method, row_number() OVER (PARTITION BY consumer, c.repo, c.canon ORDER BY verb) AS rn FROM c JOIN s ON s.repo = c.repo AND s.canon = c.canon WHERE verb > 0 AND consumer IS NOT NULL)
SELECT repo, method, count(*) AS calls, count(DISTINCT consumer) AS consumers FROM k WHERE rn = 1 GROUP BY 1, 2"""


def j9_orphan_cursors(spark, d):
    """Review cursors whose entry point is not among the current ones, and entry points without a cursor."""
    c = table(spark, d, "ai_review_entry_cursors").select("repo_id", F.trim("api_id").alias("api_id")).where("api_id <> ''").distinct()
    a = apis(spark, d).select("repo_id", "api_id")
    left = c.join(a, ["repo_id", "api_id"], "left_anti").select(F.lit("cursor").alias("kind"), "repo_id")
    right = a.join(c, ["repo_id", "api_id"], "left_anti").select(F.lit("entry_point").alias("kind"), "repo_id")
    return left.unionByName(right).groupBy("kind", "repo_id").agg(F.count("*").alias("n"))


SQL["j9_orphan_cursors"] = f"""WITH {sql_apis()}, c AS (SELECT DISTINCT repo_id, trim(api_id) AS api_id FROM ai_review_entry_cursors WHERE trim(api_id) <> '')
SELECT 'cursor' AS kind, repo_id, count(*) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.repo_id = c.repo_id AND w.api_id = c.api_id) GROUP BY 1, 2
UNION ALL SELECT 'entry_point', repo_id, count(*) FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE w.repo_id = c.repo_id AND w.api_id = c.api_id) GROUP BY 1, 2"""


def j15_nearest_click(spark, d):
    """Each purchase with the nearest click of the same user within 30 minutes either way, the earlier on a tie."""
    from lodeplane.operators.joins import nearest

    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    right = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return nearest(left, right, ["user_id"], "at", "purchase_id", "click_id", 30 * 60 * 1_000_000).select("purchase_id", "click_id", "distance")


SQL["j15_nearest_click"] = """SELECT purchase_id, click_id, distance FROM (SELECT p.event_id AS purchase_id, c.event_id AS click_id, abs(epoch_us(c.ts) - epoch_us(p.ts)) AS distance,
row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(c.ts) - epoch_us(p.ts)), c.ts, c.event_id) AS rn FROM events p JOIN events c ON c.user_id = p.user_id AND c.event_type = 'click' AND abs(epoch_us(c.ts) - epoch_us(p.ts)) <= 1800000000 WHERE p.event_type = 'purchase') WHERE rn = 1"""


def j16_outside_intervals(spark, d):
    """Events outside every interval of one minute around an error of the same user."""
    from lodeplane.operators.joins import outside

    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    spans = e.where("event_type = 'error'").select("user_id", (F.col("at") - 60_000_000).alias("lo"), (F.col("at") + 60_000_000).alias("hi"))
    return outside(e.where("event_type <> 'error'"), spans, ["user_id"], "at", "lo", "hi").groupBy("event_type").agg(F.count("*").alias("n"))


SQL["j16_outside_intervals"] = """SELECT event_type, count(*) AS n FROM events e WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND abs(epoch_us(x.ts) - epoch_us(e.ts)) <= 60000000) GROUP BY 1"""

QUERIES, ORACLE = collect(globals(), SQL)
