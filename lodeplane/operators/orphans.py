"""References to records that do not exist at the time of the reference.

Both sides become change deltas on one key: a target counts +1 when it appears and -1 when it goes, a reference counts
in a column of its own at its time. The running sum of the existence deltas, taken in time order (deltas before
references of the same instant), is the number of live targets; references at an instant with a sum of zero are orphans.

A key may hold a third of all rows, so nothing is summed in one window per key. Deltas and references are first counted
per key and instant (map-side combine). The running sum is then taken in two levels: within slices of a key
(``slice_of``, a day by default) and over the slices' totals, so that a hot key spreads over as many groups as it has
days. The reference rows themselves never enter a window: they are joined, salted, with the instants found wanting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeplane.functions.text import filled, folded

SALTS = 16


def deltas(targets: DataFrame, key: Column, since: str, until: str) -> DataFrame:
    """Existence deltas ``key, at, live`` of targets that live from ``since`` (inclusive) to ``until`` (exclusive, null:
    for ever). Targets without a key or a start never live, and neither do those that end before they start."""
    t = targets.select(key.alias("key"), F.col(since).alias("s"), F.col(until).alias("u")).where("key is not null and s is not null and (u is null or u > s)")
    both = F.array_compact(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("live")), F.when(F.col("u").isNotNull(), F.struct(F.col("u").alias("at"), F.lit(-1).alias("live")))))
    return t.select("key", F.explode(both).alias("d")).select("key", "d.at", "d.live")


def references(rows: DataFrame, key: Column, at: str, record_id: str, *, table: str, field: str) -> DataFrame:
    """``ref_table, ref_field, record_id, key, at`` of the rows that refer to something (``key`` not null)."""
    return rows.select(F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), F.col(record_id).alias("record_id"), key.alias("key"), F.col(at).alias("at")).where("key is not null")


def wanting_instants(refs: DataFrame, live: DataFrame, slice_unit: str = "day") -> DataFrame:
    """The pairs ``key, at`` of references without a live target; a reference without a time has none either."""
    events = refs.where("at is not null").select("key", "at", F.lit(0).alias("live"), F.lit(1).alias("refs")).unionByName(live.select("key", "at", "live", F.lit(0).alias("refs")))
    instants = events.groupBy("key", "at").agg(F.sum("live").alias("live"), F.sum("refs").alias("refs")).withColumn("slice", F.date_trunc(slice_unit, "at"))
    inside = Window.partitionBy("key", "slice").orderBy("at")
    # One row per slice carries the slice's total; the sums before each slice are running sums over these rows alone.
    running = instants.select("key", "at", "slice", "refs", F.sum("live").over(inside).alias("in_slice"))
    totals = instants.groupBy("key", "slice").agg(F.sum("live").alias("total"), F.sum("refs").alias("any"))
    before = totals.select("key", "slice", "any", (F.sum("total").over(Window.partitionBy("key").orderBy("slice")) - F.col("total")).alias("before")).where("`any` > 0")
    found = running.where("refs > 0").join(before.select("key", "slice", "before"), ["key", "slice"]).where(F.col("before") + F.col("in_slice") <= 0)
    return found.select("key", "at")


def orphan_references(refs: DataFrame, live: DataFrame, *, salts: int = SALTS) -> DataFrame:
    """The references without a live target, one row per record however often it was delivered."""
    wanting = wanting_instants(refs, live).select("key", "at", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = refs.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int"))
    timeless = refs.where("at is null").select("ref_table", "ref_field", "record_id", "key", "at")
    found = salted.join(wanting, ["key", "at", "salt"], "left_semi").select("ref_table", "ref_field", "record_id", "key", "at")
    return found.unionByName(timeless).dropDuplicates(["ref_table", "ref_field", "record_id"])


def workspace_deltas(apis: DataFrame, repos: DataFrame) -> DataFrame:
    """Deltas of the three kinds of targets, each under a prefix of its own: api ids, entry points of a repository, repositories."""
    working = apis.where(folded("snapshot_kind") == "working")
    entry = F.concat(F.lit("e|"), folded("repo_id"), F.lit("|"), folded("method"), F.lit(":"), folded("route"))
    return (
        deltas(working, F.concat(F.lit("a|"), filled("api_id")), "first_seen_at", "deleted_at")
        .unionByName(deltas(working, entry, "first_seen_at", "deleted_at"))
        .unionByName(deltas(repos, F.concat(F.lit("r|"), filled("repo_id")), "added_at", "removed_at"))
    )


def workspace_references(cursors: DataFrame, edges: DataFrame) -> DataFrame:
    """The references of the review cursors and of the HTTP edges; null and blank ones are none."""
    entry = F.concat(F.lit("e|"), F.coalesce(folded("repo_id"), F.lit("")), F.lit("|"), filled("entry_point_id"))
    name = "ai_review_entry_cursors"
    return (
        references(cursors, F.concat(F.lit("a|"), filled("api_id")), "reviewed_at", "cursor_id", table=name, field="api_id")
        .unionByName(references(cursors, entry, "reviewed_at", "cursor_id", table=name, field="entry_point_id"))
        .unionByName(references(edges, F.concat(F.lit("r|"), filled("target_repo")), "snapshot_at", "edge_id", table="cross_repo_http_edges", field="target_repo"))
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references and distinct missing keys per table, field and month."""
    return orphans.groupBy("ref_table", "ref_field", F.date_format("at", "yyyy-MM").alias("period")).agg(F.count("*").alias("orphan_refs"), F.countDistinct("key").alias("missing_keys"))
