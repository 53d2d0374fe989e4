"""Graphs as edge tables ``src, dst``: reachability, paths, fans, cycles, communities.

Iterations join a frontier with the edges and drop what was visited; the visited set is written to the shared checkpoint
folder each round, so that plans stay short and a lost executor costs a read. Hot nodes are spread by adaptive execution:
edges are the probe side, frontiers the build side.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeplane.session import materialise


def reachable(edges: DataFrame, seeds: DataFrame, depth: int, *, reverse: bool = False) -> DataFrame:
    """``seed, node, depth``: nodes within ``depth`` steps of each seed (column ``seed``), the least depth, seeds left out.

    Only new pairs go on; the loop ends when a round brings none.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    e = edges.select(F.col(a).alias("node"), F.col(b).alias("_to")).distinct()
    start = seeds.select("seed").distinct().where("seed is not null")
    frontier = start.select("seed", F.col("seed").alias("node"))
    visited = materialise(frontier.withColumn("depth", F.lit(0)))
    for n in range(1, depth + 1):
        step = frontier.join(e, "node").select("seed", F.col("_to").alias("node")).distinct()
        new = materialise(step.join(visited.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(n)))
        if new.isEmpty():
            break
        visited = visited.unionByName(new)
        frontier = new.select("seed", "node")
    return visited.where("depth > 0")


def impact(edges: DataFrame, changed: DataFrame, depth: int = 4) -> DataFrame:
    """Nodes that depend on any changed one (``seed``) within ``depth`` steps against the edges, with the least depth."""
    return reachable(edges, changed, depth, reverse=True).groupBy("node").agg(F.min("depth").alias("depth")).join(changed.select(F.col("seed").alias("node")), "node", "left_anti")


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 8) -> DataFrame:
    """``start, target, length, path`` of a shortest path per pair (columns ``start, target``), the one whose node list
    comes first; equal ends have length 0, unreachable targets give no row. Per start and node one path is carried."""
    e = edges.select(F.col("src").alias("node"), F.col("dst").alias("_to")).distinct()
    starts = pairs.select("start").distinct()
    frontier = materialise(starts.select("start", F.col("start").alias("node"), F.array("start").alias("path")))
    seen = frontier
    for _ in range(depth):
        step = frontier.join(e, "node").select("start", F.col("_to").alias("node"), F.concat("path", F.array("_to")).alias("path"))
        best = step.groupBy("start", "node").agg(F.min("path").alias("path"))
        new = materialise(best.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        if new.isEmpty():
            break
        seen, frontier = materialise(seen.unionByName(new)), new
    hit = pairs.select("start", "target").distinct().join(seen.select("start", F.col("node").alias("target"), "path"), ["start", "target"])
    return hit.select("start", "target", (F.size("path") - 1).alias("length"), F.array_join("path", ">").alias("path"))


def fans(edges: DataFrame, least: int = 10) -> DataFrame:
    """Nodes with more than ``least`` distinct callers or called ones."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("n")).withColumn("kind", F.lit("fan_out"))
    inn = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("n")).withColumn("kind", F.lit("fan_in"))
    return out.unionByName(inn).where(F.col("n") > least)


def two_cycles(edges: DataFrame) -> DataFrame:
    """Pairs that call each other, the smaller name first."""
    e = edges.select("src", "dst").distinct()
    undirected = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up")).where("a <> b")
    return undirected.groupBy("a", "b").agg(F.countDistinct("up").alias("n")).where("n = 2").select("a", "b")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left when nodes without callers or without called ones are taken away again and again; empty if and only if
    the graph has no cycle."""
    e = materialise(edges.select("src", "dst").where("src <> dst").distinct())
    left = e.count()
    while left:  # each round takes an edge away or is the last
        e = materialise(e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        now = e.count()
        if now == left:
            break
        left = now
    return e


def modularity(edges: DataFrame, groups: DataFrame, weight: str = "w") -> DataFrame:
    """Modularity of a partition (``node, grp``) over the existing edges alone: sum of (weight - ki * kj / 2m) / 2m over
    edges within a group, each edge counted in both directions."""
    both = edges.select("src", "dst", F.col(weight).cast("double").alias("w")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col(weight).cast("double").alias("w")))
    pair = both.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    deg = pair.groupBy("src").agg(F.sum("w").alias("k"))
    total = deg.agg(F.sum("k").alias("m2"))
    g = groups.select("node", "grp")
    j = pair.join(g.select(F.col("node").alias("src"), F.col("grp").alias("gs")), "src").join(g.select(F.col("node").alias("dst"), F.col("grp").alias("gd")), "dst").where("gs = gd")
    j = j.join(deg.select("src", F.col("k").alias("ki")), "src").join(deg.select(F.col("src").alias("dst"), F.col("k").alias("kj")), "dst").crossJoin(F.broadcast(total))
    return j.agg(F.round(F.sum((F.col("w") - F.col("ki") * F.col("kj") / F.col("m2")) / F.col("m2")), 6).alias("modularity"))


def propagated_labels(edges: DataFrame, start: DataFrame, weight: str = "w", rounds: int = 20) -> DataFrame:
    """Label propagation in synchronous rounds: a node takes the label with the greatest weight among its neighbours if
    that is a unique winner, else keeps its own. It ends when no label changes, at the latest after ``rounds``."""
    both = edges.select("src", "dst", F.col(weight).cast("double").alias("w")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col(weight).cast("double").alias("w")))
    pair = both.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    label = start.select("node", "label")
    for _ in range(rounds):
        votes = pair.join(label.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.sum("w").alias("v"))
        top = votes.groupBy("node").agg(F.max("v").alias("v"))
        best = votes.join(top, ["node", "v"]).groupBy("node").agg(F.count("*").alias("n"), F.min("label").alias("new")).where("n = 1").select("node", "new")
        step = materialise(label.join(best, "node", "left").select("node", F.coalesce("new", "label").alias("label"), (F.col("new") != F.col("label")).alias("moved")))
        label = step.select("node", "label")
        if step.where("moved").isEmpty():
            break
    return label


def local_moves(edges: DataFrame, start: DataFrame, weight: str = "w", rounds: int = 100) -> DataFrame:
    """Phase one of Louvain as the reference has it: nodes one after another, by name, move to the neighbouring group with
    the greatest gain in modularity, the last name if several have it; it ends when a sweep moves none, at the latest after
    ``rounds``. Moves at the same time would go in circles for ever, so that one task sweeps over the whole edge table."""
    both = edges.select("src", "dst", F.col(weight).cast("double").alias("w")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col(weight).cast("double").alias("w")))
    pair = both.where("src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    links = pair.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list(F.struct("dst", "w"))).alias("links"))
    state = start.select("node", F.col("label").alias("grp")).join(links, "node")

    def sweep(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["node"])
        group = {r["node"]: r["grp"] for r in rows}
        links = {r["node"]: [(x["dst"], x["w"]) for x in r["links"] if x["dst"] in group] for r in rows}
        degree = {r["node"]: sum(x["w"] for x in r["links"]) for r in rows}
        m2 = sum(degree.values())
        total: dict[str, float] = defaultdict(float)
        for node, own in group.items():
            total[own] += degree[node]
        for _ in range(rounds):
            moved = False
            for node, k in degree.items():
                own, to = group[node], defaultdict(float)
                for other, w in links[node]:
                    to[group[other]] += w
                total[own] -= k
                gain = {g: round(to[g] - k * total[g] / m2, 9) for g in [*to, own]}
                most, best = max((v, g) for g, v in gain.items())
                if (most - gain[own]) / m2 > 1e-10:
                    group[node], moved = best, True
                total[group[node]] += k
            if not moved:
                break
        return pa.table({"node": list(group), "grp": list(group.values())}, schema=pa.schema([table.schema.field("node"), table.schema.field("grp")]))

    return state.groupBy().applyInArrow(sweep, state.select("node", "grp").schema)


def jaccard_pairs(left: DataFrame, right: DataFrame, least: float = 0.3) -> DataFrame:
    """``l, r, score`` of groups (``grp, member``) that share members: counted over an inverted index, no cross join."""
    nl, nr = left.groupBy("grp").agg(F.count("*").alias("nl")), right.groupBy("grp").agg(F.count("*").alias("nr"))
    both = left.select(F.col("grp").alias("l"), "member").join(right.select(F.col("grp").alias("r"), "member"), "member").groupBy("l", "r").agg(F.count("*").alias("c"))
    j = both.join(nl.withColumnRenamed("grp", "l"), "l").join(nr.withColumnRenamed("grp", "r"), "r")
    return j.select("l", "r", F.round(F.col("c") / (F.col("nl") + F.col("nr") - F.col("c")), 9).alias("score")).where(F.col("score") >= least)


def greedy_matching(pairs: DataFrame) -> DataFrame:
    """One-to-one matching by descending score, then names. Pairs that are the best left for both their ends are taken in
    rounds, which gives the same as taking them one by one."""
    left, taken = materialise(pairs.select("l", "r", "score")), None
    while True:  # the first pair of all is taken in each round
        order = [F.desc("score"), F.asc("l"), F.asc("r")]
        ranked = left.withColumn("_l", F.row_number().over(Window.partitionBy("l").orderBy(*order))).withColumn("_r", F.row_number().over(Window.partitionBy("r").orderBy(*order)))
        best = materialise(ranked.where("_l = 1 and _r = 1").select("l", "r", "score"))
        taken = best if taken is None else taken.unionByName(best)
        left = materialise(left.join(best.select("l"), "l", "left_anti").join(best.select("r"), "r", "left_anti").select("l", "r", "score"))
        if left.isEmpty():
            break
    return taken


def overlaps(members: DataFrame, keys: Sequence[str] = ("grp", "member")) -> DataFrame:
    """Pairs of groups with the number of members they share."""
    g, m = keys
    a, b = members.select(F.col(g).alias("a"), F.col(m).alias("_m")).distinct(), members.select(F.col(g).alias("b"), F.col(m).alias("_m")).distinct()
    return a.join(b, "_m").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
