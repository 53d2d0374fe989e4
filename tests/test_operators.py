"""Small fixtures for thresholds, ties, nulls and empty inputs of the reference operators."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodeplane.functions import paths, routes
from lodeplane.functions.tokens import tokens
from lodeplane.operators import diffs, entities, findings, graph, joins, linediff, search
from lodeplane.sources import extract, formats


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,want", [("getUserById", {"getuserbyid", "get", "user", "id"}), ("the http2Server_name", {"http2server_name", "http", "2server", "server", "name"} - {"2server"} | {"server"}), (None, set()), ("a I", set())])
def test_tokens(spark, text, want):
    got = set(one(spark, text, tokens))
    assert want - {"http", "server"} <= got and "the" not in got


@pytest.mark.parametrize("route,want", [("/a/:id", "/a/:_"), ("/a/{id}/", "/a/:_"), ("/a/${x}", "/a/:_"), ("//a//b/", "/a/b"), ("", "/"), ("/", "/")])
def test_canonical_routes(spark, route, want):
    assert one(spark, route, routes.canonical) == want


def test_route_helpers(spark):
    assert one(spark, "https://h.example/a/b?q=1#f", routes.path_of_url) == "/a/b"
    assert one(spark, "https://h.example", routes.path_of_url) == "/"
    assert one(spark, "/articles/:slug/x", routes.shape) == "/W/:p/W"
    df = spark.createDataFrame([("/a/:id/b", "/a/7/b"), ("/a/{id}", "/a/7/b"), ("/a.c/<x>/", "/a.c/1"), ("/a.c/<x>", "/aXc/1")], "t string, c string")
    assert [r.m for r in df.select(F.expr("1"), F.rlike("c", routes.template_regex("t")).alias("m")).collect()] == [True, False, True, False]


def test_paths(spark):
    df = spark.createDataFrame([("a/b", "../c/./d"), ("", "./x"), ("a", "../../y")], "b string, r string")
    assert [r.y for r in df.select(paths.resolved("b", F.col("r")).alias("y")).collect()] == ["a/c/d", "x", "y"]
    assert one(spark, "a/b/c.ts", paths.prefixes) == ["", "a", "a/b", "a/b/c.ts"] and one(spark, "a/b/c.ts", paths.suffixes) == ["a/b/c.ts", "b/c.ts", "c.ts"]
    c = spark.createDataFrame([("src/a.ts", False), ("tests/a.ts", False), ("main.ts", False), ("main.ts", True), ("db/seeds/x.py", False), ("src/jest.config.js", False), ("src/fooMock.ts", False)], "p string, h boolean")
    assert [r.y for r in c.select(paths.clusterable("p", F.col("h")).alias("y")).collect()] == [True, False, False, True, False, False, False]


def test_longest_prefix_needs_a_slash(spark):
    items = spark.createDataFrame([("api/x",), ("api/v2/y",), ("api-v2/x",), ("api",)], "p string")
    roots = spark.createDataFrame([("", "root"), ("api/", "api"), ("api/v2", "v2")], "r string, i string")
    assert {r.p: r.owner for r in entities.owned_by_longest_prefix(items, "p", roots, "r", "i").collect()} == {"api/x": "api", "api/v2/y": "v2", "api-v2/x": "root", "api": "api"}
    assert {r.owner for r in entities.owned_by_longest_prefix(items, "p", roots.limit(0), "r", "i").collect()} == {None}


def test_pages_and_budget(spark):
    df = spark.range(10).select(F.col("id"))
    got = [r.id for r in entities.page(df, [F.col("id")], -5, 3).orderBy("position").collect()]
    assert got == [0, 1, 2] and entities.page(df, [F.col("id")], 8, 9999).count() == 2 and entities.page(df, [F.col("id")], 0, 0).count() == 1
    sized = spark.createDataFrame([(1, "é"), (2, "x" * 20), (3, "y")], "i int, s string")
    first = len(json.dumps({"s": "é"}, separators=(",", ":"), ensure_ascii=False).encode()) + 1 + 2
    assert first == 13 and [r.i for r in entities.within_budget(sized, [F.col("i")], ["s"], 4).collect()] == [1]
    assert entities.within_budget(sized, [F.col("i")], ["s"], 3).count() == 0 and entities.within_budget(sized, [F.col("i")], ["s"], 0).count() == 3


def test_diff_with_renames(spark):
    b = spark.createDataFrame([("a", "1", "x"), ("b", None, "y"), ("c", "1", "z"), ("g", "1", "w")], "k string, v string, a string")
    w = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y"), ("d", "1", "z"), ("e", "1", None), ("f", "1", "q")], "k string, v string, a string")
    got = {r.k: r.status for r in diffs.with_renames(b, w, ["k"], ["v"], "a").collect()}
    assert got == {"a": "unchanged", "b": "modified", "d": "modified", "e": "added", "f": "added", "g": "deleted"}
    assert {r.status for r in diffs.keyed_diff(b, b, ["k"], ["v"]).collect()} == {"unchanged"}


def test_line_diff(spark):
    a, b = ["x", "same", "old", "end"], ["x", "same", "new", "more", "end"]
    assert [o for o, _, _ in linediff.script(a, b)] == ["=", "=", "-", "+", "+", "="]
    assert "-old" in linediff.unified(a, b) and "+more" in linediff.unified(a, b)
    assert linediff.script([], []) == [] and [o for o, _, _ in linediff.script(["a"], [])] == ["-"]
    df = spark.createDataFrame([(1, "a\nb", "a\r\nc"), (2, None, "x"), (3, "", "")], "k int, before string, after string")
    assert {r.k: (r.added, r.deleted, r.equal) for r in linediff.line_diff(df, ["k"]).collect()} == {1: (1, 1, 1), 2: (1, 0, 0), 3: (0, 0, 0)}
    lines = diffs.line_multiset_diff(df.select("k", F.col("before").alias("t")), df.select("k", F.col("after").alias("t")), ["k"], "t")
    assert {(r.k, r.side, r.line) for r in lines.collect()} == {(1, "removed", "b"), (1, "added", "c"), (2, "added", "x")}


def test_near_duplicates_chain(spark):
    df = spark.createDataFrame([(1, "f", "s1", "t1"), (2, "f", "s1", "t2"), (3, "f", None, "t2"), (4, "f", None, "t1"), (5, "g", "s1", "t1")], "id int, file string, sym string, title string")
    assert sorted(r.id for r in findings.greedy_distinct(df, "file", ["id"], ["sym", "title"]).collect()) == [1, 3, 5]


def test_bindings_rules_and_quality(spark):
    f = spark.createDataFrame([(1, ["g", "g", "h"]), (2, ["g"]), (3, None)], "id int, b array<string>")
    assert {r.target: r.findings for r in findings.counts_by_binding(f, "b", "id").collect()} == {"g": 2, "h": 1}
    p = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "p boolean, a boolean")
    r = findings.precision_recall(p, "p", "a").first()
    assert (r.precision, r.recall, r.f1) == (0.5, 0.5, 0.5)
    assert findings.precision_recall(p.where("not p and not a"), "p", "a").first().f1 == 0.0


EDGES = [("a", "b"), ("b", "c"), ("c", "d"), ("b", "b2"), ("b2", "b"), ("x", "x"), ("d", "c")]


def test_graph_walks(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    s = spark.createDataFrame([("a",), (None,)], "seed string")
    assert {(r.node, r.depth) for r in graph.reachable(e, s, 2).collect()} == {("b", 1), ("c", 2), ("b2", 2)}
    assert graph.reachable(e, s, 0).count() == 0
    assert {(r.node, r.depth) for r in graph.impact(e, spark.createDataFrame([("d",)], "seed string"), 9).collect()} == {("c", 1), ("b", 2), ("a", 3), ("b2", 3)}
    p = spark.createDataFrame([("a", "d"), ("a", "a"), ("d", "a")], "start string, target string")
    assert {(r.start, r.target, r.length, r.path) for r in graph.shortest_paths(e, p).collect()} == {("a", "d", 3, "a>b>c>d"), ("a", "a", 0, "a")}
    assert {(r.a, r.b) for r in graph.two_cycles(e).collect()} == {("b", "b2"), ("c", "d")}
    assert graph.cyclic_core(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")).count() == 0
    assert {(r.src, r.dst) for r in graph.cyclic_core(e).collect()} >= {("b", "b2"), ("b2", "b"), ("c", "d"), ("d", "c")}


def test_communities(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}", 1.0) for i in range(4) for j in range(i + 1, 4)]
    e = spark.createDataFrame([*clique("a"), *clique("b"), ("a0", "b0", 1.0)], "src string, dst string, w double")
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    good = nodes.withColumn("grp", F.substring("node", 1, 1))
    assert graph.modularity(e, good).first().modularity > 0.5 > graph.modularity(e, nodes.withColumn("grp", F.col("node"))).fillna(0.0).first().modularity
    moved = {r.node: r.grp for r in graph.local_moves(e, nodes.withColumn("label", F.col("node")), rounds=6).collect()}
    assert len({moved[f"a{i}"] for i in range(4)}) == 1 and len({moved[f"b{i}"] for i in range(4)}) == 1 and moved["a1"] != moved["b1"]


def weights_of(edges):
    w = defaultdict(lambda: defaultdict(float))
    for a, b, x in edges:
        w[a][b] += x
        w[b][a] += x
    return w


def test_labels_go_on_until_none_changes(spark):
    random.seed(5)
    names = [f"n{i:02}" for i in range(40)]
    edges = [(names[i], names[i + 1], 2.0) for i in range(11)] + [(names[i], names[random.randrange(12, i)], random.choice([1.0, 2.5])) for i in range(13, 40)]
    label = {n: n if n > "n00" else "n01" for n in names}
    start = spark.createDataFrame(list(label.items()), "node string, label string")
    w, rounds = weights_of(edges), 0
    for _ in range(20):
        new = dict(label)
        for n in names:
            votes = defaultdict(float)
            for m, x in w[n].items():
                votes[label[m]] += x
            top = [k for k in votes if votes[k] == max(votes.values())]
            new[n] = top[0] if len(top) == 1 else label[n]
        if new == label:
            break
        label, rounds = new, rounds + 1
    assert rounds > 5
    assert {r.node: r.label for r in graph.propagated_labels(spark.createDataFrame(edges, "src string, dst string, w double"), start).collect()} == label


def test_local_moves_leave_no_better_move(spark):
    random.seed(7)
    names = [f"n{i:02}" for i in range(60)]
    edges = [(*sorted(random.sample(names, 2)), random.choice([1.0, 1.5, 3.0])) for _ in range(150)]
    w = weights_of(edges)
    e = spark.createDataFrame(edges, "src string, dst string, w double")
    group = {r.node: r.grp for r in graph.local_moves(e, spark.createDataFrame([(n, n) for n in w], "node string, label string")).collect()}
    assert set(group) == set(w)
    degree = {n: sum(w[n].values()) for n in w}
    m2 = sum(degree.values())
    for n in w:
        gain = lambda g: sum(x for m, x in w[n].items() if group[m] == g) - degree[n] * sum(degree[m] for m in w if m != n and group[m] == g) / m2  # noqa: E731, B023
        assert max(gain(group[m]) for m in w[n]) <= gain(group[n]) + 1e-6


def test_jaccard_matching(spark):
    l = spark.createDataFrame([("p", i) for i in range(10)] + [("q", i) for i in range(10, 13)], "grp string, member int")
    r = spark.createDataFrame([("x", i) for i in range(3)] + [("y", i) for i in range(2)] + [("z", 10)], "grp string, member int")
    pairs = {(a.l, a.r): a.score for a in graph.jaccard_pairs(l, r).collect()}
    assert ("p", "x") in pairs and ("p", "y") not in pairs and pairs["p", "x"] == 0.3
    m = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.85), ("b", "y", 0.5), ("c", "y", 0.5)], "l string, r string, score double")
    assert {(a.l, a.r) for a in graph.greedy_matching(m).collect()} == {("a", "x"), ("b", "y")}


def test_nearest_and_outside(spark):
    left = spark.createDataFrame([(1, 100, 1), (1, 500, 2), (2, 100, 3), (1, 1000, 4)], "u int, t bigint, p int")
    right = spark.createDataFrame([(1, 90, 11), (1, 110, 12), (1, 560, 13), (1, 560, 10), (3, 100, 14)], "u int, t bigint, c int")
    got = {r.p: (r.c, r.distance) for r in joins.nearest(left, right, ["u"], "t", "p", "c", 60).collect()}
    assert got == {1: (11, 10), 2: (10, 60)}
    spans = spark.createDataFrame([(1, 90, 120), (1, 95, 99)], "u int, lo bigint, hi bigint")
    pts = spark.createDataFrame([(1, 89), (1, 90), (1, 120), (1, 121), (2, 100)], "u int, t bigint")
    assert {(r.u, r.t) for r in joins.outside(pts, spans, ["u"], "t", "lo", "hi").collect()} == {(1, 89), (1, 121), (2, 100)}


def test_search(spark):
    rows = [("route", "r1", ["login"], ["user"], True), ("file", "f1", ["user"], ["login"], False), ("file", "f2", ["other"], [], False)]
    e = spark.createDataFrame(rows, "kind string, id string, primary array<string>, secondary array<string>, changed boolean")
    got = [(r.id, r.score) for r in search.search(e, ["login", "user"]).collect()]
    assert got == [("r1", 1.0), ("f1", round(4 * 0.8 / (4 * 1.6 * 1.2), 3))]
    assert search.search(e, ["login", "nothing"], require_all=True).count() == 0
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [1.0, 1.0])], "vec_id int, embedding array<double>")
    assert [(r.vec_id, r.similarity and round(r.similarity, 4)) for r in search.nearest_vectors(v, [1.0, 0.0], 4).collect()] == [(1, 1.0), (4, 0.7071), (2, None), (3, None)]


def test_similar_routes(spark):
    rows = [("r", "1", "GET", "/a/:x", ["m"], "f"), ("r", "2", "GET", "/b/:y", ["m"], "f"), ("r", "3", "GET", "/c", [], "g"), ("r", "4", "POST", "/a/:x", ["m"], "f")]
    a = spark.createDataFrame(rows, "repo_id string, api_id string, method string, route string, middlewares array<string>, file_path string")
    got = {(r.target, r.id): r.score for r in search.similar_routes(a, a).collect()}
    assert got[("r|1", "r|2")] == 0.88 and not any("r|4" in k or "r|3" in k for k in got)


def api_table(spark, directory, rows):
    kinds = "repo_id string, api_id string, method string, route string, file_path string, middlewares array<string>, webhook boolean"
    rest = {"snapshot_kind": F.lit("working"), **{c: F.lit(None).cast("timestamp_ntz") for c in ("received_at", "first_seen_at", "deleted_at")}, "diff": F.lit(None).cast("string")}
    spark.createDataFrame(rows, kinds).withColumns(rest).coalesce(1).write.parquet(f"{directory}/apis.parquet")


def test_similar_counts_of_odd_rows(spark, tmp_path):
    """Nulls, ids alike over a bar, repeated and missing middlewares, scores halfway between two roundings."""
    from lodeplane.plans import q_search
    from oracle import compare, duck

    rng, many = random.Random(5), [f"m{i}" for i in range(8)]
    mids = [None, [], ["m"], ["m", "m"], ["m", None], [None], ["n", "m"], many, many[:1], [*many[:5], "n", "m", "x"]]
    rows = [(rng.choice(["a", "a", "b", "a|b", None]), rng.choice([f"{i}", f"b|{i - 1}"]), rng.choice(["GET", "get", "PUT", None]), rng.choice(["/a", "/a/:x", "/{y}", "", None]), rng.choice(["f", "g", None]), rng.choice(mids), rng.choice([True, False, None])) for i in range(300)]
    rows += [("a", "b|c", "GET", "/a", "f", ["m"], True), ("a|b", "c", "GET", "/a", "f", ["m"], True)]
    api_table(spark, tmp_path, rows)
    assert compare(spark, duck(str(tmp_path)), str(tmp_path), "r8", q_search.r8_similar_routes, q_search.SQL["r8_similar_routes"]) == ""
    with pytest.raises(ValueError):
        search.similar_counts(spark.read.parquet(f"{tmp_path}/apis.parquet"), F.col("webhook"), 0.05)


def test_similar_counts_shuffle_no_pairs(spark, tmp_path):
    """400 of 4,000 equal entry points have 1.6 million pairs."""
    from lodeplane.plans import q_search

    api_table(spark, tmp_path, [("r", f"{i}", "GET", f"/a/{i}", f"{i}", ["auth", "audit"], i % 10 == 0) for i in range(4000)])
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty(30_000)
        each = context.statusStore().executorList(False)
        return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))

    before = shuffled()
    assert {(r.n, r.best) for r in q_search.r8_similar_routes(spark, str(tmp_path)).collect()} == {(3999, 0.8)}
    assert shuffled() - before < 4_000_000


def test_coverage_and_diff_readers(spark):
    t = spark.createDataFrame([(1, "TN:\nSF:a.ts\nFN:1,f\nFNDA:3,f\nLH:1\nLF:2\nend_of_record\nSF:b.ts\nFNDA:0,g\nLF:0\nLH:0\nend_of_record\n"), (2, "")], "k int, t string")
    f, fn = formats.lcov(t, "k", "t")
    assert {(r.path, r.line_rate) for r in f.collect()} == {("a.ts", 0.5), ("b.ts", 0.0)} and {(r.path, r.name, r.hits) for r in fn.collect()} == {("a.ts", "f", 3), ("b.ts", "g", 0)}
    j = spark.createDataFrame([(1, json.dumps({"total": {"lines": {"total": 1, "covered": 1}}, "a": {"lines": {"total": 4, "covered": 1}}, "b": {"lines": {"total": 0, "covered": 0}}})), (2, "not json")], "k int, t string")
    assert {(r.path, r.line_rate) for r in formats.istanbul(j, "k", "t").collect()} == {("a", 0.25), ("b", 0.0)}
    d = spark.createDataFrame([(1, "--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n a\n-b\n+c\n+d\n--- a/y\n+++ b/y\n@@ -9 +9 @@\n+z")], "k int, t string")
    assert {(r.path, r.line) for r in formats.unified_diff(d, "k", "t").collect()} == {("x", 1), ("x", 2), ("x", 3), ("y", 9)}


def test_extraction(spark):
    rows = [("r", "a.ts", 'import x from "./b";\nrouter.get("/a", f);\nrouter.post(`/b`, g)'), ("r", "b.ts", ""), ("r", "c.py", "from . import y\nimport os\n@router.delete('/c')\ndef f():\n    g()\n\ndef g():\n    pass\n\nclass K: pass\n"), ("r", "d.py", "def (:"), ("r", "e.java", '@GetMapping("/e")'), ("r", "f.ts", None)]
    f = spark.createDataFrame(rows, "repo_id string, path string, content string")
    assert {(r.path, r.method, r.route) for r in extract.routes(f).collect()} == {("a.ts", "GET", "/a"), ("a.ts", "POST", "/b"), ("c.py", "DELETE", "/c"), ("e.java", "GET", "/e")}
    assert {(r.source, r.target) for r in extract.resolved_imports(extract.imports(f), f).collect()} == {("./b", "b.ts")}
    s = extract.python_symbols(f)
    assert {(r.name, r.kind) for r in s.collect()} == {("f", "function"), ("g", "function"), ("K", "class")}
    assert [(r.caller, r.callee, r.confidence) for r in extract.call_edges(s).collect()] == [("f", "g", 0.85)]


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "node_modules/b.py").write_text("x")
    (tmp_path / "src/c.bin").write_bytes(b"1234")
    got = {r.path: r.content for r in formats.scan(spark, str(tmp_path), endings=("py",)).collect()}
    assert got == {"src/a.py": "x = 1\n"}


def test_functions_calls_and_graph(spark):
    from lodeplane.operators import callgraph as C

    py = "import os\nfrom lib.util import pack\n\ndef outer(a):\n    return inner(a) + pack(a)\n\nclass A:\n    async def inner(self):\n        return os.getcwd()\n"
    ts = "import { x } from './util';\nexport const run = async (a: number): Promise<void> => {\n  help(a);\n};\nfunction help(a) {\n  if (a) { return; }\n}\nclass K {\n  private go(b: string): void {\n    run(b);\n  }\n}\n"
    go = "package a\nfunc (t *T) Do(x int) error {\n\treturn step(x)\n}\nfunc step(x int) error { return nil }\n"
    java = "class A {\n    public static int top(int x) {\n        return low(x);\n    }\n    private int low(int x) {\n        return x;\n    }\n}\n"
    rows = [("r", "a.py", py), ("r", "lib/util.py", "def pack(x):\r\n    return x\r\n"), ("r", "b.ts", ts), ("r", "c.go", go), ("r", "D.java", java), ("r", "n.py", None), ("r", None, "def f(): pass"), ("r", "a.py", py)]
    df = spark.createDataFrame(rows, "repo_id string, path string, content string").withColumn("name", F.lit("clash")).withColumn("line", F.lit(1))
    assert sorted((r.path, r.name, r.line) for r in C.functions(df).collect()) == [("D.java", "low", 5), ("D.java", "top", 2), ("a.py", "inner", 8), ("a.py", "outer", 4), ("b.ts", "go", 9), ("b.ts", "help", 5), ("b.ts", "run", 2), ("c.go", "Do", 2), ("c.go", "step", 5), ("lib/util.py", "pack", 1)]
    got = {(r.src, r.dst): r.confidence for r in C.call_graph(df).collect()}
    assert got == {("a.py::outer", "a.py::inner"): 0.85, ("a.py::outer", "lib/util.py::pack"): 0.7, ("b.ts::run", "b.ts::help"): 0.9, ("b.ts::go", "b.ts::run"): 0.9, ("c.go::Do", "c.go::step"): 0.85, ("D.java::top", "D.java::low"): 0.85}
    assert C.call_graph(df.limit(0)).collect() == []
