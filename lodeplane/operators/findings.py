"""Findings: counts, summaries, near-duplicates, overlays and rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(findings: DataFrame, by: str) -> DataFrame:
    """Findings per value of ``by``, with the share of each severity."""
    return findings.groupBy(by).agg(F.count("*").alias("total"), *[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in ("error", "warning", "info")])


def counts_by_binding(findings: DataFrame, bindings: str, finding_id: str) -> DataFrame:
    """Findings per bound target; a finding bound twice to one target counts once there."""
    return findings.select(finding_id, F.explode(F.array_distinct(bindings)).alias("target")).groupBy("target").agg(F.count("*").alias("findings"))


def first_titles(findings: DataFrame, by: Column, title: str, order: str, n: int = 3) -> DataFrame:
    """Count and the first ``n`` titles per value; the bounded list is kept by a ranked window, not by a whole group's list."""
    keyed = findings.withColumn("_g", by)
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy(order)))
    some = ranked.groupBy("_g").agg(F.count("*").alias("findings"), F.array_sort(F.collect_list(F.when(F.col("_r") <= n, F.struct("_r", F.col(title).alias("t"))))).alias("x"))
    return some.select(F.col("_g").alias("value"), "findings", F.array_join(F.transform("x", lambda s: s["t"]), "; ").alias("titles"))


def greedy_distinct(findings: DataFrame, group: str, order: Sequence[str], same: Sequence[str]) -> DataFrame:
    """First-wins removal of near-duplicates within a group: a finding goes if one of the ``same`` columns equals that of
    an earlier kept one. Each column is an equality, so the first holder of each value decides; chains are resolved by
    rounds in which only findings all of whose values are held by themselves stay, until nothing is undecided."""
    from lodeplane.session import materialise

    todo = findings.withColumn("_id", F.struct(*order))
    kept = None
    while True:
        first = todo
        for i, c in enumerate(same):
            holders = todo.where(F.col(c).isNotNull()).groupBy(F.col(group).alias("_hg"), F.col(c).alias("_hv")).agg(F.min("_id").alias(f"_m{i}"))  # combined on the map side, nulls left out
            first = first.join(holders, F.col(group).eqNullSafe(F.col("_hg")) & (F.col(c) == F.col("_hv")), "left").withColumn(f"_f{i}", F.coalesce(f"_m{i}", F.col("_id"))).drop("_hg", "_hv", f"_m{i}")
        wins = first.where(" and ".join(f"_f{i} = _id" for i in range(len(same)))).select(*todo.columns)
        wins = materialise(wins)
        kept = wins if kept is None else kept.unionByName(wins)
        left = todo.join(wins.select(group, F.col("_id").alias("_w")), (todo[group] == wins[group]) & (todo["_id"] == F.col("_w")), "left_anti")
        for c in same:
            taken = wins.where(F.col(c).isNotNull()).select(F.col(group).alias("_g"), F.col(c).alias("_v")).distinct()
            left = left.join(taken, (F.col(group) == F.col("_g")) & (F.col(c) == F.col("_v")), "left_anti")
        todo = materialise(left)
        if todo.isEmpty():
            return kept.drop("_id")


def overlay(points: DataFrame, by: str, value: str = "value", severity: str = "severity") -> DataFrame:
    """Sum, maximum and mean of values (1 where not a number), the worst severity and the number of points."""
    v = F.coalesce(F.expr(f"try_cast(`{value}` as double)"), F.lit(1.0))
    rank = F.when(F.col(severity) == "error", 3).when(F.col(severity) == "warn", 2).when(F.col(severity) == "info", 1).otherwise(0)
    worst = F.max(rank)
    return points.groupBy(by).agg(F.round(F.sum(v), 6).alias("sum"), F.round(F.max(v), 6).alias("max"), F.round(F.avg(v), 6).alias("avg"), F.when(worst == 3, "error").when(worst == 2, "warn").when(worst == 1, "info").alias("severity"), F.count("*").alias("points"))


def violations(rows: DataFrame, rules: Mapping[str, tuple[str, str]], key: Sequence[str]) -> DataFrame:
    """``rule, severity, key`` of the rows that break a rule; a rule is a severity and a SQL predicate, and all of them are
    evaluated in one pass over the rows."""
    broken = F.array_compact(F.array(*[F.when(F.expr(p), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, (s, p) in rules.items()]))
    return rows.select(*key, F.explode(broken).alias("v")).select("v.rule", "v.severity", *key)


def precision_recall(pairs: DataFrame, predicted: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of a yes/no prediction, 0 where they are undefined."""
    tp = F.count(F.when(F.col(predicted) & F.col(actual), 1))
    p, a = F.count(F.when(F.col(predicted), 1)), F.count(F.when(F.col(actual), 1))
    out = pairs.groupBy(*by).agg(tp.alias("tp"), p.alias("predicted"), a.alias("actual"))
    pr, rc = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("actual")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * pr * rc, pr + rc), F.lit(0.0))
    return out.select(*by, "tp", "predicted", "actual", F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(f1, 6).alias("f1"))


#: Middleware kinds by name, the first pattern that fits wins (fixed values).
MIDDLEWARE_KINDS = (
    ("auth-required", r"(^|\.)auth\.required$|^auth$|^authrequired$|^authmiddleware$|^requireauth$|^isauthenticated$|^ensureauth(enticated)?$|^basicauth$|^bearerauth$|^jwt(auth)?$|(^|\.)passport\.authenticate$|^expressjwt$|^koajwt$|^login_required$|^authenticate_user!?$|guard$|^@preauthorize$|^@permission_required$"),
    ("auth-optional", r"(^|\.)auth\.optional$|^optionalauth$"),
    ("cors", r"^cors$|-cors$"),
    ("rate-limit", r"ratelimit|throttle|rate_limit"),
    ("cache", r"^cache|memoize"),
    ("logging", r"^morgan$|logger|logging"),
    ("validator", r"validator|validate|joi|zod|pipe$"),
    ("parser", r"body-?parser|multer|cookie-?parser|^express-fileupload$"),
    ("compression", r"compression"),
    ("session", r"session"),
    ("csrf", r"csrf|xsrf"),
    ("security", r"^helmet|security"),
    ("transform", r"transform|interceptor"),
    ("error-handler", r"error|exception|errorhandler"),
)


def middleware_kind(name: Column | str) -> Column:
    low = F.lower(F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit("")))
    out = None
    for kind, pattern in MIDDLEWARE_KINDS:
        out = F.when(low.rlike(pattern), kind) if out is None else out.when(low.rlike(pattern), kind)
    return out.otherwise("other")
