"""Current entities of a workspace out of delivered rows, and listing, filtering and paging of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeplane.functions import paths


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``; equal rows count once. The columns of the input are kept."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def current_apis(apis: DataFrame, kind: str = "working") -> DataFrame:
    """Entry points of one snapshot kind that are not deleted, each id once (the latest row delivered)."""
    mine = apis.where((F.col("snapshot_kind") == kind) & F.col("api_id").isNotNull())
    last = latest(mine, ["repo_id", "api_id"], [F.desc_nulls_last("received_at"), F.desc_nulls_last("first_seen_at"), F.desc_nulls_last("diff")])
    return last.where("deleted_at is null")


def current_files(files: DataFrame, kind: str) -> DataFrame:
    """Files of one snapshot kind, each path once."""
    mine = files.where((F.col("snapshot_kind") == kind) & F.col("path").isNotNull())
    return latest(mine, ["repo_id", "path"], [F.desc_nulls_last("received_at"), F.desc("file_id")])


def entry_points(apis: DataFrame, repos: DataFrame, *, method: str | None = None, auth: str | None = None, contains: str | None = None, only_changed: bool = False) -> DataFrame:
    """Entry points with the technology of their repository; all given conditions must hold."""
    out = apis
    if method:
        out = out.where(F.upper("method") == method.upper())
    if auth:
        out = out.where(F.col("auth") == auth)
    if contains:
        out = out.where(F.lower("route").contains(contains.lower()))
    if only_changed:
        out = out.where(F.coalesce("diff", F.lit("unchanged")) != "unchanged")
    return out.join(repos.select("repo_id", "technology").dropDuplicates(["repo_id"]), "repo_id", "left")


def page(rows: DataFrame, order: Sequence[Column], cursor: int = 0, limit: int = 50) -> DataFrame:
    """A page over a total order: its rows with ``position`` and ``total``. The cursor is at least 0, the limit 1 to 500."""
    cursor, limit = max(0, cursor), min(500, max(1, limit))
    total = rows.agg(F.count("*").alias("total"))
    # TakeOrdered keeps cursor + limit rows per task; only those reach the single numbering task.
    head = rows.orderBy(*order).limit(cursor + limit)
    numbered = head.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1)
    return numbered.where(F.col("position") >= cursor).crossJoin(F.broadcast(total))


def within_budget(rows: DataFrame, order: Sequence[Column], fields: Sequence[str], tokens: int, *, partition: Sequence[str] = ()) -> DataFrame:
    """The longest prefix whose JSON stays within ``4 * tokens`` bytes (2 for the brackets, 1 per separator); 0 trims nothing."""
    if tokens <= 0:
        return rows
    size = F.octet_length(F.to_json(F.struct(*fields))) + 1
    w = Window.partitionBy(*(partition or [F.lit(1)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("bytes_upto", F.sum(size).over(w) + 2).where(F.col("bytes_upto") <= 4 * tokens)


def owned_by_longest_prefix(items: DataFrame, path: str, roots: DataFrame, root: str, root_id: str) -> DataFrame:
    """Each item with the ``root_id`` of the longest root that is empty, equal to its path, or a directory above it.

    The prefixes of the path are exploded and joined by equality, so no pair of unrelated rows is ever formed.
    """
    # ``monotonically_increasing_id`` would differ between retries; the item's own columns identify it.
    keyed = items.withColumn("_prefix", F.explode(paths.prefixes(path)))
    trimmed = roots.select(F.col(root_id).alias("_owner"), F.regexp_replace(F.col(root), "/+$", "").alias("_prefix"))
    hits = keyed.join(trimmed, "_prefix", "left")
    best = F.max(F.when(F.col("_owner").isNotNull(), F.struct(F.length("_prefix").alias("l"), F.col("_owner").alias("o")))).alias("best")
    return hits.groupBy(*items.columns).agg(best).select(*items.columns, F.col("best.o").alias("owner"))


def scoped(rows: DataFrame, path: str, root: str) -> DataFrame:
    """Rows whose path is the root or lies under it."""
    return rows.where((F.col(path) == root) | F.col(path).startswith(root.rstrip("/") + "/"))


def surface(apis: DataFrame, generic: Sequence[str] = ("<anonymous>", "anonymous", "handler", "default")) -> DataFrame:
    """One entry per repository, method and route: a named handler before a generic one, then the smallest name."""
    order = F.struct(F.lower("handler_name").isin(*generic).cast("int").alias("g"), F.coalesce("handler_name", F.lit("")).alias("h"), F.col("api_id").alias("i"))
    best = F.min(order).alias("b")
    return apis.groupBy("repo_id", F.upper("method").alias("method"), "route").agg(best, F.count("*").alias("records")).select("repo_id", "method", "route", F.col("b.h").alias("handler_name"), "records")
