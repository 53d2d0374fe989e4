"""Queries: graph analytics on the graph of repositories that call each other (g), and functions of functions (r13, u4)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeplane.functions import paths
from lodeplane.operators import diffs, graph
from lodeplane.plans.common import SQL_EDGES, SQL_REPOS, apis, collect, files, repo_edges, repos, sql_apis, sql_files

SQL: dict[str, str] = {}


def _seeds(spark, d):
    return repos(spark, d).where("status = 'failed'").select(F.lower("repo_id").alias("seed"))


_SEEDS = "s AS (SELECT DISTINCT lower(repo_id) AS seed FROM r WHERE status = 'failed')"


def _walk(a, b, depth):
    return f"x AS (SELECT seed, seed AS node, 0 AS depth FROM s UNION SELECT x.seed, e.{b}, x.depth + 1 FROM x JOIN e ON e.{a} = x.node WHERE x.depth < {depth})"


def g2_reachable(spark, d):
    return graph.reachable(repo_edges(spark, d), _seeds(spark, d), 5)


SQL["g2_reachable"] = f"WITH RECURSIVE {SQL_EDGES}, {SQL_REPOS}, {_SEEDS}, {_walk('src', 'dst', 5)} SELECT seed, node, min(depth) AS depth FROM x GROUP BY 1, 2 HAVING min(depth) > 0"


def g3_impact(spark, d):
    return graph.impact(repo_edges(spark, d), _seeds(spark, d), 5)


SQL["g3_impact"] = f"WITH RECURSIVE {SQL_EDGES}, {SQL_REPOS}, {_SEEDS}, {_walk('dst', 'src', 5)} SELECT node, min(depth) AS depth FROM x WHERE node NOT IN (SELECT seed FROM s) GROUP BY 1"


def g5_paths(spark, d):
    """Shortest call paths, up to eight calls, from the repositories that failed to all that they reach."""
    starts = _seeds(spark, d).distinct()
    reached = graph.reachable(repo_edges(spark, d), starts, 8).select(F.col("seed").alias("start"), F.col("node").alias("target"))
    return graph.shortest_paths(repo_edges(spark, d), reached, 8)


SQL["g5_paths"] = ""  # all simple paths are too many for SQL on the whole graph; tests compare with breadth-first search


def g7_impact_summary(spark, d):
    """Direct and further impact with the entry points that lie in the repositories hit."""
    hit = graph.impact(repo_edges(spark, d), _seeds(spark, d), 4)
    n = apis(spark, d).groupBy(F.lower("repo_id").alias("node")).agg(F.count("*").alias("entry_points"))
    return hit.join(n, "node", "left").groupBy("depth").agg(F.count("*").alias("repositories"), F.sum(F.coalesce("entry_points", F.lit(0))).alias("entry_points"))


SQL["g7_impact_summary"] = f"WITH RECURSIVE {SQL_EDGES}, {SQL_REPOS}, {sql_apis()}, {_SEEDS}, {_walk('dst', 'src', 4)}, h AS (SELECT node, min(depth) AS depth FROM x WHERE node NOT IN (SELECT seed FROM s) GROUP BY 1), n AS (SELECT lower(repo_id) AS node, count(*) AS entry_points FROM w GROUP BY 1) SELECT depth, count(*) AS repositories, sum(coalesce(entry_points, 0)) AS entry_points FROM h LEFT JOIN n USING (node) GROUP BY 1"


def a6_fans(spark, d):
    return graph.fans(repo_edges(spark, d), 2)


SQL["a6_fans"] = f"WITH {SQL_EDGES} SELECT src AS node, count(DISTINCT dst) AS n, 'fan_out' AS kind FROM e GROUP BY 1 HAVING count(DISTINCT dst) > 2 UNION ALL SELECT dst, count(DISTINCT src), 'fan_in' FROM e GROUP BY 1 HAVING count(DISTINCT src) > 2"


def g10_two_cycles(spark, d):
    return graph.two_cycles(repo_edges(spark, d))


SQL["g10_two_cycles"] = f"WITH {SQL_EDGES} SELECT x.src AS a, x.dst AS b FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst"


def g10_cyclic_core(spark, d):
    return graph.cyclic_core(repo_edges(spark, d)).agg(F.count("*").alias("edges"))


SQL["g10_cyclic_core"] = ""


def g11_uncalled(spark, d):
    """Repositories with entry points that no other repository calls, without those that face users or schedule themselves."""
    called = repo_edges(spark, d).select(F.col("dst").alias("repo")).distinct()
    mine = apis(spark, d).select(F.lower("repo_id").alias("repo")).distinct().where(~F.col("repo").rlike("-(web|jobs|worker)$"))
    return mine.join(called, "repo", "left_anti")


SQL["g11_uncalled"] = f"WITH {SQL_EDGES}, {sql_apis()} SELECT DISTINCT lower(repo_id) AS repo FROM w WHERE NOT regexp_matches(lower(repo_id), '-(web|jobs|worker)$') AND lower(repo_id) NOT IN (SELECT dst FROM e)"


def g12_orphan_groups(spark, d):
    """Folders of source files that import from no other folder of their repository, from which none imports, and without entry points."""
    from lodeplane.functions import paths
    from lodeplane.operators import callgraph

    f = files(spark, d).where(F.col("path").rlike(callgraph.SCRIPT) | F.col("path").rlike(callgraph.OTHER))
    here = f.select("repo_id", "path", paths.dirname("path").alias("grp"), F.regexp_extract("path", r"([^/]+?)(?:\.\w+)?$", 1).alias("module"))
    link = callgraph.modules(files(spark, d)).select("repo_id", paths.dirname("path").alias("a"), "module").join(here.select("repo_id", "module", F.col("grp").alias("b")), ["repo_id", "module"]).where("a <> b")
    linked = link.select("repo_id", F.explode(F.array("a", "b")).alias("grp")).unionByName(apis(spark, d).select("repo_id", paths.dirname(F.trim("file_path")).alias("grp"))).distinct()
    return here.groupBy("repo_id", "grp").agg(F.count("*").alias("files")).join(linked, ["repo_id", "grp"], "left_anti")


def _graph_sql() -> str:
    from lodeplane.plans.q_functions import _GRAPH

    return _GRAPH


_DIR = "regexp_replace({}, '(^|/)[^/]*$', '')"
SQL["g12_orphan_groups"] = f"WITH {_graph_sql()}, {sql_apis()}, h AS (SELECT repo_id, path, {_DIR.format('path')} AS grp, regexp_extract(path, '([^/]+?)(?:\\.\\w+)?$', 1) AS module FROM f WHERE regexp_matches(path, '\\.(js|mjs|cjs|jsx|ts|tsx|py|go|java)$')), k AS (SELECT m.repo_id, {_DIR.format('m.path')} AS a, h.grp AS b FROM m JOIN h ON h.repo_id = m.repo_id AND h.module = m.module WHERE m.module <> ''), x AS (SELECT repo_id, a AS grp FROM k WHERE a <> b UNION SELECT repo_id, b FROM k WHERE a <> b UNION SELECT repo_id, {_DIR.format('trim(file_path)')} FROM w WHERE file_path IS NOT NULL) SELECT repo_id, grp, count(*) AS files FROM h WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.repo_id = h.repo_id AND x.grp = h.grp) GROUP BY 1, 2"


def _weights(spark, d):
    """Undirected weights: calls, and half a point more within one group."""
    e = repo_edges(spark, d).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "calls").groupBy("src", "dst").agg(F.sum("calls").alias("c"))
    same = F.split("src", "-")[0] == F.split("dst", "-")[0]
    return e.select("src", "dst", (F.col("c") + F.when(same, 0.5).otherwise(0.0)).alias("w"))


_W = "ww AS (SELECT src, dst, c + CASE WHEN string_split(src, '-')[1] = string_split(dst, '-')[1] THEN 0.5 ELSE 0 END AS w FROM (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(calls) AS c FROM e GROUP BY 1, 2))"


def g14_weights(spark, d):
    return _weights(spark, d)


SQL["g14_weights"] = f"WITH {SQL_EDGES}, {_W} SELECT src, dst, CAST(w AS DOUBLE) AS w FROM ww"


def _nodes(spark, d):
    return repo_edges(spark, d).select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def g15_local_moves(spark, d):
    """Communities by local moves, measured by their modularity."""
    w = _weights(spark, d)
    groups = graph.local_moves(w, _nodes(spark, d).withColumn("label", F.col("node")))
    return graph.modularity(w, groups)


SQL["g15_local_moves"] = ""


def g16_modularity(spark, d):
    return graph.modularity(_weights(spark, d), _nodes(spark, d).withColumn("grp", F.split("node", "-")[0]))


SQL["g16_modularity"] = f"""WITH {SQL_EDGES}, {_W}, p AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM ww UNION ALL SELECT dst, src, w FROM ww) GROUP BY 1, 2), k AS (SELECT src AS node, sum(w) AS k FROM p GROUP BY 1), m AS (SELECT CAST(sum(k) AS DOUBLE) AS m2 FROM k)
SELECT round(sum((p.w - a.k * b.k / m2) / m2), 6) AS modularity FROM p JOIN k a ON a.node = p.src JOIN k b ON b.node = p.dst, m WHERE string_split(src, '-')[1] = string_split(dst, '-')[1]"""


def g17_labels(spark, d):
    """The first two rounds, which SQL can follow; ``g17_settled_labels`` goes on."""
    start = _nodes(spark, d).withColumn("label", F.split("node", "-")[0])
    return graph.propagated_labels(_weights(spark, d), start, rounds=2)


def _round(n):
    return f"v{n} AS (SELECT p.src AS node, l.label, sum(p.w) AS v FROM p JOIN l{n - 1} l ON l.node = p.dst GROUP BY 1, 2), t{n} AS (SELECT node, max(v) AS v FROM v{n} GROUP BY 1), b{n} AS (SELECT node, min(label) AS new FROM v{n} JOIN t{n} USING (node, v) GROUP BY 1 HAVING count(*) = 1), l{n} AS (SELECT l.node, coalesce(b.new, l.label) AS label FROM l{n - 1} l LEFT JOIN b{n} b ON b.node = l.node)"


SQL["g17_labels"] = f"WITH {SQL_EDGES}, {_W}, p AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM ww UNION ALL SELECT dst, src, w FROM ww) GROUP BY 1, 2), l0 AS (SELECT DISTINCT src AS node, string_split(src, '-')[1] AS label FROM p), {_round(1)}, {_round(2)} SELECT node, label FROM l2"


def g17_settled_labels(spark, d):
    """The same labels as far as they go: until none changes, at most the reference's twenty sweeps."""
    start = _nodes(spark, d).withColumn("label", F.split("node", "-")[0])
    return graph.propagated_labels(_weights(spark, d), start)


SQL["g17_settled_labels"] = ""  # the number of rounds depends on the tables; tests compare with brute force


def _members(spark, d, kind):
    f = files(spark, d, kind)
    return f.select(F.concat_ws("|", "repo_id", paths.dirname("path")).alias("grp"), F.concat_ws("|", "repo_id", F.coalesce("hash", F.col("path"))).alias("member")).distinct()


_MEMBERS = "{0}m AS (SELECT DISTINCT repo_id || '|' || regexp_replace(path, '(^|/)[^/]*$', '') AS grp, repo_id || '|' || coalesce(hash, path) AS member FROM {0})"


def g19_jaccard_pairs(spark, d):
    return graph.jaccard_pairs(_members(spark, d, "baseline"), _members(spark, d, "working"))


SQL["g19_jaccard_pairs"] = f"""WITH {sql_files('b', 'baseline')}, {sql_files('w')}, {_MEMBERS.format('b')}, {_MEMBERS.format('w')}, nb AS (SELECT grp, count(*) AS n FROM bm GROUP BY 1), nw AS (SELECT grp, count(*) AS n FROM wm GROUP BY 1), c AS (SELECT bm.grp AS l, wm.grp AS r, count(*) AS c FROM bm JOIN wm USING (member) GROUP BY 1, 2)
SELECT l, r, round(c / (nb.n + nw.n - c), 9) AS score FROM c JOIN nb ON nb.grp = l JOIN nw ON nw.grp = r WHERE round(c / (nb.n + nw.n - c), 9) >= 0.3"""


def g19_matched_groups(spark, d):
    """Stable identities of groups: the greedy one-to-one matching of the pairs."""
    return graph.greedy_matching(graph.jaccard_pairs(_members(spark, d, "baseline"), _members(spark, d, "working")))


SQL["g19_matched_groups"] = ""


def g23_shared_files(spark, d):
    """Pairs of methods that share folders, with their number."""
    from lodeplane.functions import paths

    m = apis(spark, d).where("file_path is not null").select(F.upper("method").alias("grp"), F.concat_ws("|", "repo_id", paths.dirname("file_path")).alias("member"))
    return graph.overlaps(m)


SQL["g23_shared_files"] = f"WITH {sql_apis()}, m AS (SELECT DISTINCT upper(method) AS grp, repo_id || '|' || regexp_replace(file_path, '(^|/)[^/]*$', '') AS member FROM w WHERE file_path IS NOT NULL) SELECT a.grp AS a, b.grp AS b, count(*) AS shared FROM m a JOIN m b ON a.member = b.member AND a.grp < b.grp GROUP BY 1, 2"


def g25_api_list(spark, d):
    """Entry points of each directory split by method, and how many of the repository lie elsewhere."""
    a = apis(spark, d).withColumn("dir", paths.dirname("file_path"))
    g = a.groupBy("repo_id", "dir").agg(*[F.count(F.when(F.upper("method") == m, 1)).alias(m.lower()) for m in ("GET", "POST", "PUT", "PATCH", "DELETE")], F.count("*").alias("n"))
    return g.withColumn("elsewhere", F.sum("n").over(Window.partitionBy("repo_id")) - F.col("n")).drop("n")


SQL["g25_api_list"] = f"WITH {sql_apis()}, g AS (SELECT repo_id, regexp_replace(file_path, '(^|/)[^/]*$', '') AS dir, " + ", ".join(f"count(*) FILTER (WHERE upper(method) = '{m}') AS {m.lower()}" for m in ("GET", "POST", "PUT", "PATCH", "DELETE")) + ", count(*) AS n FROM w GROUP BY 1, 2) SELECT * EXCLUDE (n), sum(n) OVER (PARTITION BY repo_id) - n AS elsewhere FROM g"


def g28_dependents(spark, d):
    """For each repository with changed files at most six that call it, the busiest first."""
    changed = diffs.keyed_diff(files(spark, d, "baseline"), files(spark, d), ["repo_id", "path"], ["hash"]).where("status <> 'unchanged'").select(F.lower("repo_id").alias("dst")).distinct()
    w = Window.partitionBy("dst").orderBy(F.desc("calls"), "src")
    return repo_edges(spark, d).join(changed, "dst", "left_semi").withColumn("rank", F.row_number().over(w)).where("rank <= 6").select("dst", "src", "rank")


SQL["g28_dependents"] = f"WITH {SQL_EDGES}, {sql_files('b', 'baseline')}, {sql_files('w')}, c AS (SELECT DISTINCT lower(coalesce(b.repo_id, w.repo_id)) AS dst FROM b FULL JOIN w ON b.repo_id = w.repo_id AND b.path = w.path WHERE b.path IS NULL OR w.path IS NULL OR b.hash IS DISTINCT FROM w.hash), k AS (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY calls DESC, src) AS rank FROM e WHERE dst IN (SELECT dst FROM c)) SELECT dst, src, rank FROM k WHERE rank <= 6"


def g29_regression_scope(spark, d):
    """What a change touches: changed files, test files of the same directory stem to run, entry points, and consumers."""
    ch = diffs.keyed_diff(files(spark, d, "baseline"), files(spark, d), ["repo_id", "path"], ["hash"]).where("status in ('added', 'modified')")
    ch = ch.select("repo_id", "path").withColumn("test", paths.is_test("path", "impact"))
    src = ch.where("not test")
    per = ch.groupBy("repo_id").agg(F.count(F.when(~F.col("test"), 1)).alias("changed"), F.count(F.when(F.col("test"), 1)).alias("tests_changed"))
    hit = apis(spark, d).join(src.select("repo_id", F.col("path").alias("file_path")), ["repo_id", "file_path"], "left_semi").groupBy("repo_id").agg(F.count("*").alias("entry_points"))
    cons = repo_edges(spark, d).groupBy(F.col("dst").alias("repo_id")).agg(F.count("*").alias("consumers"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return per.join(hit, "repo_id", "left").join(cons, "repo_id", "left").select("repo_id", "changed", "tests_changed", z("entry_points"), z("consumers"))


SQL["g29_regression_scope"] = f"""WITH {SQL_EDGES}, {sql_apis('a')}, {sql_files('b', 'baseline')}, {sql_files('w')}, c AS (SELECT w.repo_id, w.path, regexp_matches(w.path, '{paths.TEST_PATHS['impact']}') AS t FROM w LEFT JOIN b ON b.repo_id = w.repo_id AND b.path = w.path WHERE b.path IS NULL OR b.hash IS DISTINCT FROM w.hash),
p AS (SELECT repo_id, count(*) FILTER (WHERE NOT t) AS changed, count(*) FILTER (WHERE t) AS tests_changed FROM c GROUP BY 1), h AS (SELECT repo_id, count(*) AS n FROM a WHERE EXISTS (SELECT 1 FROM c WHERE NOT t AND c.repo_id = a.repo_id AND c.path = a.file_path) GROUP BY 1), k AS (SELECT dst, count(*) AS n FROM e GROUP BY 1)
SELECT p.repo_id, changed, tests_changed, coalesce(h.n, 0) AS entry_points, coalesce(k.n, 0) AS consumers FROM p LEFT JOIN h USING (repo_id) LEFT JOIN k ON k.dst = p.repo_id"""


def g30_neighbours(spark, d):
    """Called and calling repositories of each, as two sorted lists' digests."""
    e = repo_edges(spark, d)
    out = e.groupBy(F.col("src").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("calls"))
    inn = e.groupBy(F.col("dst").alias("node")).agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("called_by"))
    return out.join(inn, "node", "full_outer")


SQL["g30_neighbours"] = f"WITH {SQL_EDGES}, o AS (SELECT src AS node, string_agg(DISTINCT dst, ',' ORDER BY dst) AS calls FROM e GROUP BY 1), i AS (SELECT dst AS node, string_agg(DISTINCT src, ',' ORDER BY src) AS called_by FROM e GROUP BY 1) SELECT coalesce(o.node, i.node) AS node, calls, called_by FROM o FULL JOIN i ON o.node = i.node"

QUERIES, ORACLE = collect(globals(), SQL)
