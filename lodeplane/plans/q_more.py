"""Queries: further operators on findings, overlays, groups and maps (r5-r7, j3, j7, a11, a13, g20, g22, m1, m14, t2)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeplane.functions import paths
from lodeplane.functions.text import filled
from lodeplane.plans.common import SQL_EDGES, SQL_REPOS, apis, collect, files, repo_edges, repos, sql_apis, sql_files
from lodeplane.sources.tables import table

SQL: dict[str, str] = {}


def r5_scored_findings(spark, d):
    """Review findings scored for the intent 'module, cycle': 6 for a title hit (first line), else 2 for a text hit, per
    word; 8 for a severe one; up to 5 for recency in days before a fixed instant; the 20 best."""
    t = table(spark, d, "documents").where("doc_kind = 'review_finding' and text is not null")
    title = F.lower(F.substring_index("text", "\n", 1))
    body = F.lower("text")
    words = sum((F.when(title.contains(w), 6).when(body.contains(w), 2).otherwise(0) for w in ("module", "cycle")), F.lit(0))
    age = F.date_diff(F.lit("2026-06-01").cast("date"), F.col("created_at").cast("date"))
    score = words + F.when(body.contains("dead functions"), 8).otherwise(0) + F.greatest(F.lit(0), 5 - age)
    s = t.select("doc_id", score.alias("score")).where("score > 0")
    return s.orderBy(F.desc("score"), "doc_id").limit(20).withColumn("normal", F.round(F.least(F.lit(1.0), F.col("score") / 100), 3))


_T = "lower(string_split(text, chr(10))[1])"
SQL["r5_scored_findings"] = "WITH s AS (SELECT doc_id, " + " + ".join(f"CASE WHEN contains({_T}, '{w}') THEN 6 WHEN contains(lower(text), '{w}') THEN 2 ELSE 0 END" for w in ("module", "cycle")) + " + CASE WHEN contains(lower(text), 'dead functions') THEN 8 ELSE 0 END + greatest(0, 5 - date_diff('day', CAST(created_at AS DATE), DATE '2026-06-01')) AS score FROM documents WHERE doc_kind = 'review_finding' AND text IS NOT NULL) SELECT doc_id, score, round(least(1.0, score / 100), 3) AS normal FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20"


def j3_services_hit(spark, d):
    """Folders of repositories that a root begins with (without a slash: a wider rule than the longest prefix), with their roots."""
    r = repos(spark, d).where("root_path is not null").select("repo_id", "root_path")
    held = r.select(paths.dirname("root_path").alias("folder")).distinct()
    # equal beginnings by equality on every prefix of a root
    p = r.select("repo_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("root_path")), lambda n: F.substring(F.col("root_path"), F.lit(1), n))).alias("folder"))
    return p.join(held, "folder").groupBy("folder").agg(F.count("*").alias("repos"))


SQL["j3_services_hit"] = f"WITH {SQL_REPOS}, h AS (SELECT DISTINCT regexp_replace(root_path, '(^|/)[^/]*$', '') AS folder FROM r WHERE root_path IS NOT NULL) SELECT folder, count(*) AS repos FROM h JOIN r ON starts_with(root_path, folder) WHERE folder <> '' GROUP BY 1"


def j7_anchored_points(spark, d):
    """Review cursors as points: anchored at their entry point, else at the repository of that name, else unresolved."""
    c = table(spark, d, "ai_review_entry_cursors").select("cursor_id", "repo_id", F.trim("api_id").alias("api_id")).dropDuplicates(["cursor_id"])
    a = apis(spark, d).select("repo_id", "api_id", F.lit(True).alias("a"))
    r = repos(spark, d).select("repo_id", F.lit(True).alias("r"))
    j = c.join(a, ["repo_id", "api_id"], "left").join(r, "repo_id", "left")
    return j.groupBy(F.when(F.col("a"), "entry_point").when(F.col("r"), "repository").otherwise("unresolved").alias("anchor")).agg(F.count("*").alias("points"))


SQL["j7_anchored_points"] = f"WITH {sql_apis()}, c AS (SELECT DISTINCT ON (cursor_id) cursor_id, repo_id, trim(api_id) AS api_id FROM ai_review_entry_cursors) SELECT CASE WHEN w.api_id IS NOT NULL THEN 'entry_point' WHEN c.repo_id IN (SELECT repo_id FROM repos) THEN 'repository' ELSE 'unresolved' END AS anchor, count(*) AS points FROM c LEFT JOIN w ON w.repo_id = c.repo_id AND w.api_id = c.api_id GROUP BY 1"


def a11_group_edges(spark, d):
    """Edges between groups of repositories: distinct calls, and the mean weight in percent, single calls counting 0.7."""
    g = lambda c: F.split(c, "-")[0]
    e = repo_edges(spark, d).select(g(F.col("src")).alias("a"), g(F.col("dst")).alias("b"), "calls").where("a <> b")
    return e.groupBy("a", "b").agg(F.sum("calls").alias("calls"), F.round(100 * F.avg(F.when(F.col("calls") > 1, 0.9).otherwise(0.7)), 3).alias("confidence"))


SQL["a11_group_edges"] = f"WITH {SQL_EDGES}, g AS (SELECT string_split(src, '-')[1] AS a, string_split(dst, '-')[1] AS b, calls FROM e) SELECT a, b, CAST(sum(calls) AS BIGINT) AS calls, round(100 * avg(CASE WHEN calls > 1 THEN CAST(0.9 AS DOUBLE) ELSE 0.7 END), 3) AS confidence FROM g WHERE a <> b GROUP BY 1, 2"


def g22_map_nodes(spark, d):
    """The map from repository over directory to entry point: children per level and repository."""
    a = apis(spark, d).select("repo_id", paths.dirname("file_path").alias("dir"), "api_id")
    return a.groupBy("repo_id").agg(F.countDistinct("dir").alias("directories"), F.count("*").alias("entry_points"), F.round(F.count("*") / F.countDistinct("dir"), 6).alias("per_directory"))


SQL["g22_map_nodes"] = f"WITH {sql_apis()}, a AS (SELECT repo_id, regexp_replace(file_path, '(^|/)[^/]*$', '') AS dir FROM w) SELECT repo_id, count(DISTINCT dir) AS directories, count(*) AS entry_points, round(count(*) / count(DISTINCT dir), 6) AS per_directory FROM a GROUP BY 1"


def g24_wiki_links(spark, d):
    """Addresses that documents name, by the repository of the wiki."""
    t = table(spark, d, "documents").where("text is not null and source like 'wiki:%'")
    links = F.regexp_extract_all("text", F.lit(r"([a-z]+(?:/[a-z]+)+\.(?:go|py|ts))"), 1)
    x = t.select(F.substring_index("source", ":", -1).alias("repo"), F.explode(F.array_distinct(links)).alias("target"))
    return x.groupBy("repo").agg(F.count("*").alias("links"), F.countDistinct("target").alias("targets"))


SQL["g24_wiki_links"] = "WITH x AS (SELECT string_split(source, ':')[-1] AS repo, unnest(list_distinct(regexp_extract_all(text, '([a-z]+(?:/[a-z]+)+\\.(?:go|py|ts))', 1))) AS target FROM documents WHERE text IS NOT NULL AND source LIKE 'wiki:%') SELECT repo, count(*) AS links, count(DISTINCT target) AS targets FROM x GROUP BY 1"


def m1_effective_lines(spark, d):
    """Lines of a repository's documents first, then those of the workspace that are not there yet (case and blanks aside)."""
    t = table(spark, d, "documents").where("doc_kind = 'adr' and text is not null")
    lines = t.select(F.substring_index("source", ":", -1).alias("repo"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("trim(line) <> ''")
    key = F.lower(F.regexp_replace(F.trim("line"), r"\s+", " "))
    w = Window.partitionBy("repo", "key").orderBy("doc_id", "pos")
    return lines.withColumn("key", key).withColumn("rn", F.row_number().over(w)).where("rn = 1").groupBy("repo").agg(F.count("*").alias("lines"))


SQL["m1_effective_lines"] = "WITH x AS (SELECT string_split(source, ':')[-1] AS repo, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_kind = 'adr' AND text IS NOT NULL) SELECT repo, count(DISTINCT lower(regexp_replace(trim(line, ' '), '\\s+', ' ', 'g'))) AS lines FROM x WHERE trim(line, ' ') <> '' GROUP BY 1"


def m14_kept_names(spark, d):
    """Names of known ids carried over to the working twin of the shared externals, where it has none of its own."""
    k = filled("provider_id")
    last = lambda t: table(spark, d, t).where(k.isNotNull()).groupBy(k.alias("k")).agg(F.max_by(F.trim("name"), F.struct("snapshot_no", "received_at", "row_id")).alias("name"))
    b, w = last("baseline_shared_externals").withColumnRenamed("name", "old"), last("shared_externals")
    j = w.join(b, "k", "left").select("k", F.coalesce("old", "name").alias("name"), (F.col("old") != F.col("name")).alias("renamed"))
    return j.agg(F.count("*").alias("n"), F.count(F.when(F.col("renamed"), 1)).alias("renamed"), F.count(F.when(F.col("renamed").isNull(), 1)).alias("fresh"))


_LAST = "(SELECT nullif(lower(trim(provider_id)), '') AS k, arg_max(trim(name), struct_pack(a := snapshot_no, b := received_at, c := row_id)) AS name FROM {} WHERE nullif(lower(trim(provider_id)), '') IS NOT NULL GROUP BY 1)"
SQL["m14_kept_names"] = f"SELECT count(*) AS n, count(*) FILTER (WHERE b.name <> w.name) AS renamed, count(*) FILTER (WHERE b.name IS NULL OR w.name IS NULL) AS fresh FROM {_LAST.format('shared_externals')} w LEFT JOIN {_LAST.format('baseline_shared_externals')} b USING (k)"


def t2_cancelled(spark, d):
    """Per user and day the events left when an error cancels what came before it: those after the last error."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "event_type")
    last = e.where("event_type = 'error'").groupBy("user_id", "day").agg(F.max("ts").alias("cut"))
    left = e.join(last, ["user_id", "day"], "left").where("event_type <> 'error' and (cut is null or ts > cut)")
    return left.groupBy("day").agg(F.count("*").alias("left"))


SQL["t2_cancelled"] = "WITH x AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_type, max(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS cut FROM events) SELECT day, count(*) AS left FROM x WHERE event_type <> 'error' AND (cut IS NULL OR ts > cut) GROUP BY 1"


def s5_partition_overwrite(spark, d):
    """What a dynamic overwrite of the working partition leaves: baseline as it was, working replaced."""
    w = files(spark, d)
    kept = files(spark, d, "baseline").unionByName(w)
    return kept.groupBy("snapshot_kind").agg(F.count("*").alias("rows"), F.countDistinct("repo_id").alias("repositories"))


SQL["s5_partition_overwrite"] = f"WITH {sql_files('b', 'baseline')}, {sql_files('w')} SELECT snapshot_kind, count(*) AS rows, count(DISTINCT repo_id) AS repositories FROM (SELECT * FROM b UNION ALL SELECT * FROM w) GROUP BY 1"

QUERIES, ORACLE = collect(globals(), SQL)
