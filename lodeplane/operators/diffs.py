"""Differences between a baseline and a working side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_diff(base: DataFrame, work: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``keys, status`` of a null-safe full outer comparison: added, deleted, modified or unchanged. Keys must be unique."""
    b = base.select(*keys, F.struct(*values).alias("_b"))
    w = work.select(*keys, F.struct(*values).alias("_w"))
    same = F.col("_b").eqNullSafe(F.col("_w"))
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_w").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return b.join(w, list(keys), "full_outer").select(*keys, status.alias("status"))


def with_renames(base: DataFrame, work: DataFrame, keys: Sequence[str], values: Sequence[str], anchor: str) -> DataFrame:
    """As ``keyed_diff``, but a deleted and an added record with one anchor are one modified record (``renamed_from``).

    Anchors that several deleted or several added records share do not pair; such records stay as they are.
    """
    key = F.to_json(F.struct(*keys))
    d = keyed_diff(base, work, keys, values)
    gone = d.where("status = 'deleted'").join(base.select(*keys, F.col(anchor).alias("_a")), list(keys)).where("_a is not null")
    new = d.where("status = 'added'").join(work.select(*keys, F.col(anchor).alias("_a")), list(keys)).where("_a is not null")
    lone = lambda x, n: x.groupBy("_a").agg(F.count("*").alias("n"), F.min(key).alias(n)).where("n = 1").drop("n")
    pairs = lone(gone, "_from").join(lone(new, "_to"), "_a").select("_from", "_to")
    k = d.withColumn("_k", key)
    k = k.join(pairs.select(F.col("_to").alias("_k"), F.col("_from")), "_k", "left").join(pairs.select(F.col("_from").alias("_k"), F.lit(True).alias("_out")), "_k", "left")
    return k.where("_out is null").select(*keys, F.when(F.col("_from").isNotNull(), "modified").otherwise(F.col("status")).alias("status"), F.col("_from").alias("renamed_from"))


def counts(diff: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Records per status and whether anything changed."""
    kinds = ("added", "deleted", "modified", "unchanged")
    out = diff.groupBy(*by).agg(*[F.count(F.when(F.col("status") == k, 1)).alias(k) for k in kinds])
    return out.withColumn("has_changes", (F.col("added") + F.col("deleted") + F.col("modified")) > 0)


def surface_diff(base: DataFrame, work: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entry points added and removed, and changes of the contract: authentication and the sets of middlewares."""
    b = base.select(*keys, F.lit(True).alias("_b"), F.col("auth").alias("auth_before"), F.coalesce("middlewares", F.array()).alias("_mb"))
    w = work.select(*keys, F.lit(True).alias("_w"), F.col("auth").alias("auth_after"), F.coalesce("middlewares", F.array()).alias("_mw"))
    j = b.join(w, list(keys), "full_outer")
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_w").isNull(), "removed").when(
        ~F.col("auth_before").eqNullSafe(F.col("auth_after")) | (F.size(F.array_except("_mb", "_mw")) > 0) | (F.size(F.array_except("_mw", "_mb")) > 0), "contract"
    )
    more = F.when(kind == "contract", F.array_join(F.array_sort(F.array_except("_mw", "_mb")), ","))
    less = F.when(kind == "contract", F.array_join(F.array_sort(F.array_except("_mb", "_mw")), ","))
    return j.select(*keys, kind.alias("kind"), "auth_before", "auth_after", more.alias("middlewares_added"), less.alias("middlewares_removed")).where("kind is not null")


def numbered_lines(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``keys, pos, line, occ``: the lines of a text with their place and the how-manieth equal line each is."""
    lines = rows.select(*keys, F.posexplode(F.split(text, r"\r?\n|\r")).alias("pos", "line"))
    return lines.withColumn("occ", F.row_number().over(Window.partitionBy(*keys, "line").orderBy("pos")))


def line_multiset_diff(base: DataFrame, work: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Lines that one side has more often than the other: ``keys, side, pos, line``."""
    b, w = numbered_lines(base, keys, text), numbered_lines(work, keys, text)
    on = [*keys, "line", "occ"]
    gone = b.join(w, on, "left_anti").select(*keys, F.lit("removed").alias("side"), "pos", "line")
    return gone.unionByName(w.join(b, on, "left_anti").select(*keys, F.lit("added").alias("side"), "pos", "line"))


def upward(children: DataFrame, child: str, parent: str, status: str, parents: DataFrame) -> DataFrame:
    """Parents with a status of their own keep it; others are modified if any child changed, else unchanged."""
    changed = children.groupBy(F.col(parent)).agg(F.max((F.coalesce(status, F.lit("unchanged")) != "unchanged").cast("int")).alias("_any"))
    own = F.coalesce("status", F.lit("unchanged"))
    return parents.join(changed, parent, "left").withColumn("status", F.when(own != "unchanged", own).when(F.col("_any") == 1, "modified").otherwise("unchanged")).drop("_any")


def structural_key(rows: DataFrame, key: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """A hash per key over the sorted distinct parts: equal as long as the structure is."""
    joined = F.concat_ws("\u0001", *[F.array_join(F.array_sort(F.collect_set(p)), "\u0001") for p in parts])
    return rows.groupBy(*key).agg(F.sha2(joined, 256).alias("structural_key"))
