"""Queries: differences between baseline and working snapshot (d)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeplane.functions import paths
from lodeplane.functions.text import filled
from lodeplane.operators import diffs, linediff
from lodeplane.plans.common import apis, collect, files, sql_apis, sql_files
from lodeplane.sources.tables import table

SQL: dict[str, str] = {}
_KEY = ["repo_id", "path"]


def _nodes(spark, d, kind):
    """Entry points as nodes, one per repository, method and route, with the smallest of their contents."""
    best = F.min(F.struct(F.coalesce("handler_name", F.lit("")).alias("h"), F.coalesce("auth", F.lit("")).alias("a"), F.coalesce("file_path", F.lit("")).alias("f"))).alias("b")
    g = apis(spark, d, kind).groupBy("repo_id", F.upper("method").alias("method"), "route").agg(best)
    return g.select("repo_id", "method", "route", F.col("b.h").alias("handler"), F.col("b.a").alias("auth"), F.concat_ws("::", "repo_id", "b.f", "b.h").alias("anchor"))


def _sql_nodes(n, src):
    return f"{n} AS (SELECT repo_id, method, route, b.h AS handler, b.a AS auth, repo_id || '::' || b.f || '::' || b.h AS anchor FROM (SELECT repo_id, upper(method) AS method, route, min(struct_pack(h := coalesce(handler_name, ''), a := coalesce(auth, ''), f := coalesce(file_path, ''))) AS b FROM {src} GROUP BY 1, 2, 3))"


def d1_node_diff(spark, d):
    """Nodes by status, with renames found by anchor."""
    out = diffs.with_renames(_nodes(spark, d, "baseline"), _nodes(spark, d, "working"), ["repo_id", "method", "route"], ["handler", "auth"], "anchor")
    return out.groupBy("repo_id", "status").agg(F.count("*").alias("n"), F.count("renamed_from").alias("renamed"))


SQL["d1_node_diff"] = f"""WITH {sql_apis('b0', 'baseline')}, {sql_apis('w0')}, {_sql_nodes('b', 'b0')}, {_sql_nodes('w', 'w0')},
j AS (SELECT repo_id, method, route, CASE WHEN b.handler IS NULL THEN 'added' WHEN w.handler IS NULL THEN 'deleted' WHEN b.handler = w.handler AND b.auth = w.auth THEN 'unchanged' ELSE 'modified' END AS status, b.anchor AS ba, w.anchor AS wa FROM b FULL JOIN w USING (repo_id, method, route)),
p AS (SELECT ba AS anchor FROM (SELECT ba FROM j WHERE status = 'deleted' GROUP BY 1 HAVING count(*) = 1) JOIN (SELECT wa FROM j WHERE status = 'added' GROUP BY 1 HAVING count(*) = 1) ON ba = wa),
k AS (SELECT repo_id, CASE WHEN status = 'added' AND wa IN (SELECT anchor FROM p) THEN 'renamed' ELSE status END AS s FROM j WHERE NOT (status = 'deleted' AND ba IN (SELECT anchor FROM p)))
SELECT repo_id, CASE WHEN s = 'renamed' THEN 'modified' ELSE s END AS status, count(*) AS n, count(*) FILTER (WHERE s = 'renamed') AS renamed FROM k GROUP BY 1, 2"""


def d2_content_test(spark, d):
    """Files whose content differs, and of these those that differ in white space alone."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    b = files(spark, d, "baseline").select(*_KEY, F.col("content").alias("b"))
    w = files(spark, d).select(*_KEY, F.col("content").alias("w"))
    j = b.join(w, _KEY).where(~F.col("b").eqNullSafe(F.col("w")))
    return j.groupBy("repo_id").agg(F.count("*").alias("differ"), F.count(F.when(flat(F.col("b")) == flat(F.col("w")), 1)).alias("blank_only"))


_FLAT = "trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g'))"
SQL["d2_content_test"] = f"WITH {sql_files('b', 'baseline')}, {sql_files('w')} SELECT b.repo_id, count(*) AS differ, count(*) FILTER (WHERE {_FLAT.format('b.content')} = {_FLAT.format('w.content')}) AS blank_only FROM b JOIN w ON b.repo_id = w.repo_id AND b.path = w.path WHERE b.content IS DISTINCT FROM w.content GROUP BY 1"


def _edge_state(spark, d, last):
    e = table(spark, d, "cross_repo_http_edges")
    no = e.agg(F.max("snapshot_no") if last else F.min("snapshot_no")).withColumnRenamed("max(snapshot_no)" if last else "min(snapshot_no)", "snapshot_no")
    return e.join(F.broadcast(no), "snapshot_no").select(filled("source_repo").alias("src"), filled("target_repo").alias("dst"), F.concat_ws(" ", F.upper(F.trim("method")), F.trim("route")).alias("label")).distinct()


def d3_edge_diff(spark, d):
    """Edges of the last against the first snapshot: added if the pair is new, modified if only the label is, else deleted
    if the pair is gone; edges from or to a node that is gone are dropped from the deleted ones."""
    b, w = _edge_state(spark, d, False), _edge_state(spark, d, True)
    pb, pw = b.select("src", "dst").distinct(), w.select("src", "dst").distinct()
    added = w.join(pb, ["src", "dst"], "left_anti").withColumn("status", F.lit("added"))
    modified = w.join(pb, ["src", "dst"], "left_semi").join(b, ["src", "dst", "label"], "left_anti").withColumn("status", F.lit("modified"))
    nodes = w.select(F.explode(F.array("src", "dst")).alias("n")).distinct()
    deleted = b.join(pw, ["src", "dst"], "left_anti").join(nodes.select(F.col("n").alias("src")), "src", "left_semi").join(nodes.select(F.col("n").alias("dst")), "dst", "left_semi").select("src", "dst", "label").withColumn("status", F.lit("deleted"))
    return added.unionByName(modified).unionByName(deleted).groupBy("status").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"))


def _sql_state(n, f):
    return f"{n} AS (SELECT DISTINCT nullif(lower(trim(source_repo)), '') AS src, nullif(lower(trim(target_repo)), '') AS dst, upper(trim(method)) || ' ' || trim(route) AS label FROM cross_repo_http_edges WHERE snapshot_no = (SELECT {f}(snapshot_no) FROM cross_repo_http_edges))"


SQL["d3_edge_diff"] = f"""WITH {_sql_state('b', 'min')}, {_sql_state('w', 'max')}, n AS (SELECT src AS x FROM w UNION SELECT dst FROM w),
u AS (SELECT w.*, 'added' AS status FROM w WHERE (src, dst) NOT IN (SELECT (src, dst) FROM b)
UNION ALL SELECT w.*, 'modified' FROM w WHERE (src, dst) IN (SELECT (src, dst) FROM b) AND (src, dst, label) NOT IN (SELECT (src, dst, label) FROM b)
UNION ALL SELECT b.*, 'deleted' FROM b WHERE (src, dst) NOT IN (SELECT (src, dst) FROM w) AND src IN (SELECT x FROM n) AND dst IN (SELECT x FROM n))
SELECT status, count(*) AS edges, count(DISTINCT src) AS sources FROM u GROUP BY 1"""


def d4_diff_counts(spark, d):
    b, w = files(spark, d, "baseline"), files(spark, d)
    return diffs.counts(diffs.keyed_diff(b, w, _KEY, ["hash"]), ["repo_id"])


SQL["d4_diff_counts"] = f"""WITH {sql_files('b', 'baseline')}, {sql_files('w')}, j AS (SELECT coalesce(b.repo_id, w.repo_id) AS repo_id, CASE WHEN b.path IS NULL THEN 'added' WHEN w.path IS NULL THEN 'deleted' WHEN b.hash IS NOT DISTINCT FROM w.hash THEN 'unchanged' ELSE 'modified' END AS s FROM b FULL JOIN w ON b.repo_id = w.repo_id AND b.path = w.path)
SELECT repo_id, count(*) FILTER (WHERE s = 'added') AS added, count(*) FILTER (WHERE s = 'deleted') AS deleted, count(*) FILTER (WHERE s = 'modified') AS modified, count(*) FILTER (WHERE s = 'unchanged') AS unchanged, bool_or(s <> 'unchanged') AS has_changes FROM j GROUP BY 1"""


def d5_api_status(spark, d):
    """Status of each entry point: added if new, modified if the hash of its file changed, else unchanged."""
    base = apis(spark, d, "baseline").select("repo_id", "api_id", F.lit(True).alias("known"))
    fb = files(spark, d, "baseline").select("repo_id", F.col("path").alias("file_path"), F.col("hash").alias("hb"), F.lit(True).alias("inb"))
    fw = files(spark, d).select("repo_id", F.col("path").alias("file_path"), F.col("hash").alias("hw"), F.lit(True).alias("inw"))
    j = apis(spark, d).join(base, ["repo_id", "api_id"], "left").join(fb, ["repo_id", "file_path"], "left").join(fw, ["repo_id", "file_path"], "left")
    status = F.when(F.col("known").isNull(), "added").when(F.col("inb") & F.col("inw") & ~F.col("hb").eqNullSafe(F.col("hw")), "modified").otherwise("unchanged")
    return j.groupBy("repo_id", status.alias("status")).agg(F.count("*").alias("n"))


SQL["d5_api_status"] = f"""WITH {sql_apis('b', 'baseline')}, {sql_apis()}, {sql_files('fb', 'baseline')}, {sql_files('fw')}
SELECT w.repo_id, CASE WHEN b.api_id IS NULL THEN 'added' WHEN fb.path IS NOT NULL AND fw.path IS NOT NULL AND fb.hash IS DISTINCT FROM fw.hash THEN 'modified' ELSE 'unchanged' END AS status, count(*) AS n
FROM w LEFT JOIN b ON b.repo_id = w.repo_id AND b.api_id = w.api_id LEFT JOIN fb ON fb.repo_id = w.repo_id AND fb.path = w.file_path LEFT JOIN fw ON fw.repo_id = w.repo_id AND fw.path = w.file_path GROUP BY 1, 2"""


def d6_summary(spark, d):
    """Changed files and entry points of each repository in one table."""
    f = diffs.keyed_diff(files(spark, d, "baseline"), files(spark, d), _KEY, ["hash"]).select("repo_id", F.lit("file").alias("kind"), "status")
    a = diffs.keyed_diff(apis(spark, d, "baseline"), apis(spark, d), ["repo_id", "api_id"], ["handler_name", "auth"]).select("repo_id", F.lit("entry_point").alias("kind"), "status")
    return f.unionByName(a).where("status <> 'unchanged'").groupBy("repo_id", "kind", "status").agg(F.count("*").alias("n"))


SQL["d6_summary"] = f"""WITH {sql_files('fb', 'baseline')}, {sql_files('fw')}, {sql_apis('b', 'baseline')}, {sql_apis()},
u AS (SELECT coalesce(fb.repo_id, fw.repo_id) AS repo_id, 'file' AS kind, CASE WHEN fb.path IS NULL THEN 'added' WHEN fw.path IS NULL THEN 'deleted' WHEN fb.hash IS NOT DISTINCT FROM fw.hash THEN 'unchanged' ELSE 'modified' END AS status FROM fb FULL JOIN fw ON fb.repo_id = fw.repo_id AND fb.path = fw.path
UNION ALL SELECT coalesce(b.repo_id, w.repo_id), 'entry_point', CASE WHEN b.api_id IS NULL THEN 'added' WHEN w.api_id IS NULL THEN 'deleted' WHEN b.handler_name IS NOT DISTINCT FROM w.handler_name AND b.auth IS NOT DISTINCT FROM w.auth THEN 'unchanged' ELSE 'modified' END FROM b FULL JOIN w ON b.repo_id = w.repo_id AND b.api_id = w.api_id)
SELECT repo_id, kind, status, count(*) AS n FROM u WHERE status <> 'unchanged' GROUP BY 1, 2, 3"""


def d7_surface_diff(spark, d):
    return diffs.surface_diff(apis(spark, d, "baseline"), apis(spark, d), ["repo_id", "api_id"])


_EX = "array_to_string(list_sort(list_filter(list_distinct({0}), lambda x: NOT list_contains({1}, x))), ',')"
SQL["d7_surface_diff"] = f"""WITH {sql_apis('b', 'baseline')}, {sql_apis()}, j AS (SELECT coalesce(b.repo_id, w.repo_id) AS repo_id, coalesce(b.api_id, w.api_id) AS api_id, b.api_id IS NULL AS nb, w.api_id IS NULL AS nw, b.auth AS auth_before, w.auth AS auth_after, coalesce(b.middlewares, []) AS mb, coalesce(w.middlewares, []) AS mw FROM b FULL JOIN w ON b.repo_id = w.repo_id AND b.api_id = w.api_id),
k AS (SELECT *, {_EX.format('mw', 'mb')} AS plus, {_EX.format('mb', 'mw')} AS minus FROM j)
SELECT repo_id, api_id, CASE WHEN nb THEN 'added' WHEN nw THEN 'removed' ELSE 'contract' END AS kind, auth_before, auth_after, CASE WHEN NOT nb AND NOT nw THEN plus END AS middlewares_added, CASE WHEN NOT nb AND NOT nw THEN minus END AS middlewares_removed FROM k WHERE nb OR nw OR auth_before IS DISTINCT FROM auth_after OR plus <> '' OR minus <> ''"""


def d8_group_diff(spark, d):
    """Groups of files (directories): modified if a member changed, appeared or went; added and deleted as wholes."""
    f = diffs.keyed_diff(files(spark, d, "baseline"), files(spark, d), _KEY, ["hash"]).withColumn("grp", paths.dirname("path"))
    g = f.groupBy("repo_id", "grp").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("added", "deleted", "unchanged")])
    status = F.when(F.col("added") == F.col("n"), "added").when(F.col("deleted") == F.col("n"), "deleted").when(F.col("unchanged") == F.col("n"), "unchanged").otherwise("modified")
    return g.groupBy("repo_id", status.alias("status")).agg(F.count("*").alias("groups"))


SQL["d8_group_diff"] = f"""WITH {sql_files('b', 'baseline')}, {sql_files('w')}, j AS (SELECT coalesce(b.repo_id, w.repo_id) AS repo_id, regexp_replace(coalesce(b.path, w.path), '(^|/)[^/]*$', '') AS grp, CASE WHEN b.path IS NULL THEN 'added' WHEN w.path IS NULL THEN 'deleted' WHEN b.hash IS NOT DISTINCT FROM w.hash THEN 'unchanged' ELSE 'modified' END AS s FROM b FULL JOIN w ON b.repo_id = w.repo_id AND b.path = w.path),
g AS (SELECT repo_id, grp, CASE WHEN bool_and(s = 'added') THEN 'added' WHEN bool_and(s = 'deleted') THEN 'deleted' WHEN bool_and(s = 'unchanged') THEN 'unchanged' ELSE 'modified' END AS status FROM j GROUP BY 1, 2)
SELECT repo_id, status, count(*) AS groups FROM g GROUP BY 1, 2"""


def d10_line_diff(spark, d):
    """Lines added and deleted per changed file by an exact longest common subsequence."""
    b = files(spark, d, "baseline").select(*_KEY, F.col("content").alias("before"), F.col("hash").alias("hb"))
    w = files(spark, d).select(*_KEY, F.col("content").alias("after"), F.col("hash").alias("hw"))
    return linediff.line_diff(b.join(w, _KEY).where(~F.col("hb").eqNullSafe(F.col("hw"))).select(*_KEY, "before", "after"), _KEY)


SQL["d10_line_diff"] = ""


def d11_propagation(spark, d):
    """Changes of files carried up to directories and on to repositories."""
    f = diffs.keyed_diff(files(spark, d, "baseline"), files(spark, d), _KEY, ["hash"]).withColumn("dir", paths.dirname("path"))
    dirs = f.select("repo_id", "dir").distinct().withColumn("status", F.lit(None).cast("string")).withColumn("node", F.concat_ws("|", "repo_id", "dir"))
    up1 = diffs.upward(f.withColumn("node", F.concat_ws("|", "repo_id", "dir")), "path", "node", "status", dirs)
    repos_ = up1.select("repo_id").distinct().withColumn("status", F.lit(None).cast("string"))
    up2 = diffs.upward(up1, "node", "repo_id", "status", repos_)
    return up1.groupBy("status").agg(F.count("*").alias("n")).withColumn("level", F.lit("directory")).unionByName(up2.groupBy("status").agg(F.count("*").alias("n")).withColumn("level", F.lit("repository")))


SQL["d11_propagation"] = f"""WITH {sql_files('b', 'baseline')}, {sql_files('w')}, j AS (SELECT coalesce(b.repo_id, w.repo_id) AS repo_id, regexp_replace(coalesce(b.path, w.path), '(^|/)[^/]*$', '') AS dir, b.path IS NULL OR w.path IS NULL OR b.hash IS DISTINCT FROM w.hash AS c FROM b FULL JOIN w ON b.repo_id = w.repo_id AND b.path = w.path),
g AS (SELECT repo_id, dir, bool_or(c) AS c FROM j GROUP BY 1, 2), r AS (SELECT repo_id, bool_or(c) AS c FROM g GROUP BY 1)
SELECT CASE WHEN c THEN 'modified' ELSE 'unchanged' END AS status, count(*) AS n, 'directory' AS level FROM g GROUP BY 1 UNION ALL SELECT CASE WHEN c THEN 'modified' ELSE 'unchanged' END, count(*), 'repository' FROM r GROUP BY 1"""


def d13_changed_entities(spark, d):
    """Functions of the files that are new or have another hash, with their first line."""
    from lodeplane.operators import callgraph

    f = diffs.keyed_diff(files(spark, d, "baseline"), files(spark, d), _KEY, ["hash"]).where("status in ('added', 'modified')")
    return callgraph.functions(files(spark, d)).join(f.select("repo_id", "path", "status"), ["repo_id", "path"]).select("repo_id", "path", "name", "line", "status")


def _functions_sql() -> str:
    from lodeplane.plans.q_functions import _FUNCTIONS

    return _FUNCTIONS


SQL["d13_changed_entities"] = f"WITH {_functions_sql()}, {sql_files('b', 'baseline')} SELECT fn.repo_id, fn.path, fn.name, fn.line, CASE WHEN b.path IS NULL THEN 'added' ELSE 'modified' END AS status FROM fn JOIN f ON f.repo_id = fn.repo_id AND f.path = fn.path LEFT JOIN b ON b.repo_id = f.repo_id AND b.path = f.path WHERE b.path IS NULL OR b.hash IS DISTINCT FROM f.hash"


def d14_review_delta(spark, d):
    """What a review has to look at again: entry points without a cursor or with another handler hash (12 hex digits of
    the SHA-256 of repository, id and file hash); the rest can be reused."""
    fw = files(spark, d).select("repo_id", F.col("path").alias("file_path"), "hash")
    h = F.substring(F.sha2(F.concat_ws("\u0001", "repo_id", "api_id", F.coalesce("hash", F.lit(""))), 256), 1, 12)
    now = apis(spark, d).join(fw, ["repo_id", "file_path"], "left").select("repo_id", "api_id", h.alias("now_hash"))
    c = table(spark, d, "ai_review_entry_cursors").where("trim(api_id) <> ''")
    last = c.groupBy("repo_id", F.trim("api_id").alias("api_id")).agg(F.max(F.struct("reviewed_at", "cursor_id", "handler_hash")).alias("c")).select("repo_id", "api_id", F.col("c.handler_hash").alias("seen_hash"), F.lit(True).alias("seen"))
    j = now.join(last, ["repo_id", "api_id"], "left")
    state = F.when(F.col("seen").isNull(), "new").when(F.col("seen_hash").eqNullSafe(F.col("now_hash")), "reused").otherwise("changed")
    return j.groupBy("repo_id", state.alias("state")).agg(F.count("*").alias("n"), F.min("now_hash").alias("least_hash"))


SQL["d14_review_delta"] = f"""WITH {sql_files()}, {sql_apis()}, n AS (SELECT w.repo_id, w.api_id, substr(sha256(w.repo_id || chr(1) || w.api_id || chr(1) || coalesce(f.hash, '')), 1, 12) AS now_hash FROM w LEFT JOIN f ON f.repo_id = w.repo_id AND f.path = w.file_path),
c AS (SELECT repo_id, trim(api_id) AS api_id, handler_hash, row_number() OVER (PARTITION BY repo_id, trim(api_id) ORDER BY reviewed_at DESC, cursor_id DESC) AS rn FROM ai_review_entry_cursors WHERE trim(api_id) <> ''),
l AS (SELECT * FROM c WHERE rn = 1)
SELECT n.repo_id, CASE WHEN l.api_id IS NULL THEN 'new' WHEN l.handler_hash IS NOT DISTINCT FROM n.now_hash THEN 'reused' ELSE 'changed' END AS state, count(*) AS n, min(now_hash) AS least_hash FROM n LEFT JOIN l ON l.repo_id = n.repo_id AND l.api_id = n.api_id GROUP BY 1, 2"""


def d15_transitions(spark, d):
    """Transitions of the delivered mark of shared externals between consecutive snapshots they occur in."""
    mark = F.coalesce(filled("diff"), F.lit("unchanged"))
    e = table(spark, d, "shared_externals").select(filled("provider_id").alias("k"), "snapshot_no", mark.alias("mark"), "received_at", "row_id")
    last = e.groupBy("k", "snapshot_no").agg(F.max(F.struct("received_at", "row_id", "mark")).alias("x")).select("k", "snapshot_no", F.col("x.mark").alias("mark"))
    w = Window.partitionBy("k").orderBy("snapshot_no")
    t = last.withColumn("before", F.coalesce(F.lag("mark").over(w), F.lit("absent"))).where("before <> mark")
    return t.groupBy("before", F.col("mark").alias("after")).agg(F.count("*").alias("n"))


SQL["d15_transitions"] = """WITH e AS (SELECT nullif(lower(trim(provider_id)), '') AS k, snapshot_no, coalesce(nullif(lower(trim(diff)), ''), 'unchanged') AS mark, row_number() OVER (PARTITION BY nullif(lower(trim(provider_id)), ''), snapshot_no ORDER BY received_at DESC, row_id DESC, coalesce(nullif(lower(trim(diff)), ''), 'unchanged') DESC) AS rn FROM shared_externals),
t AS (SELECT mark, coalesce(lag(mark) OVER (PARTITION BY k ORDER BY snapshot_no), 'absent') AS before FROM e WHERE rn = 1)
SELECT before, mark AS after, count(*) AS n FROM t WHERE before <> mark GROUP BY 1, 2"""


def d16_structural_key(spark, d):
    a = apis(spark, d).select("repo_id", F.concat_ws(" ", "method", "route").alias("r"), F.coalesce("handler_name", F.lit("")).alias("h"))
    return diffs.structural_key(a, ["repo_id"], ["r", "h"])


SQL["d16_structural_key"] = f"WITH {sql_apis()} SELECT repo_id, sha256(array_to_string(list_sort(list(DISTINCT method || ' ' || route)), chr(1)) || chr(1) || array_to_string(list_sort(list(DISTINCT coalesce(handler_name, ''))), chr(1))) AS structural_key FROM w GROUP BY 1"


def d17_reanchored(spark, d):
    """Where records anchored in the baseline are found again: same path and hash, else same path, else another path
    with the hash (the smallest), else nowhere."""
    b = files(spark, d, "baseline").select("repo_id", "path", "hash")
    w = files(spark, d).select("repo_id", F.col("path").alias("wp"), F.col("hash").alias("wh"))
    at_path = b.join(w.withColumnRenamed("wp", "path"), ["repo_id", "path"], "left").withColumn("kept", F.col("wh").eqNullSafe(F.col("hash")) & F.col("wh").isNotNull())
    by_hash = w.where("wh is not null").groupBy("repo_id", F.col("wh").alias("hash")).agg(F.min("wp").alias("moved_to"))
    in_work = w.select("repo_id", F.col("wp").alias("path"), F.lit(True).alias("here"))
    j = at_path.join(by_hash, ["repo_id", "hash"], "left").join(in_work, ["repo_id", "path"], "left")
    how = F.when(F.col("kept"), "exact").when(F.col("here"), "path").when(F.col("moved_to").isNotNull(), "moved").otherwise("orphan")
    return j.groupBy("repo_id", how.alias("how")).agg(F.count("*").alias("n"))


SQL["d17_reanchored"] = f"""WITH {sql_files('b', 'baseline')}, {sql_files('w')}, h AS (SELECT DISTINCT repo_id, hash FROM w WHERE hash IS NOT NULL)
SELECT b.repo_id, CASE WHEN w.path IS NOT NULL AND w.hash = b.hash THEN 'exact' WHEN w.path IS NOT NULL THEN 'path' WHEN h.hash IS NOT NULL THEN 'moved' ELSE 'orphan' END AS how, count(*) AS n FROM b LEFT JOIN w ON w.repo_id = b.repo_id AND w.path = b.path LEFT JOIN h ON h.repo_id = b.repo_id AND h.hash = b.hash GROUP BY 1, 2"""

QUERIES, ORACLE = collect(globals(), SQL)
