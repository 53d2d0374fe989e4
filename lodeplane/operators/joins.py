"""Joins on order: nearest match within a tolerance, and points outside of intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, left_id: str, right_id: str, tolerance: int) -> DataFrame:
    """Each left row with the nearest right row of its key within ``tolerance`` either way; ties go to the earlier, then
    the smaller id. Both sides are merged by one sort: the last right row at or before and the first at or after each
    left row are carried along, so that no pairs are formed and a key costs as much as it has rows. A key is split into
    buckets of the tolerance's width; right rows go to their own and both neighbouring buckets, hence no group is larger
    than the rows within three tolerances."""
    width = max(1, int(tolerance))
    ks = [F.col(k) for k in keys]
    bucket = F.floor(F.col(at) / F.lit(width)).cast("long")
    no = F.lit(None)
    ltype, rtype = left.schema[left_id].dataType, right.schema[right_id].dataType
    l = left.select(*ks, F.col(at).alias("_at"), F.col(left_id).alias("_l"), no.cast(rtype).alias("_r"), bucket.alias("_b"))
    r = right.select(*ks, F.col(at).alias("_at"), no.cast(ltype).alias("_l"), F.col(right_id).alias("_r"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    rows = l.unionByName(r)
    hit = F.when(F.col("_r").isNotNull(), F.struct("_at", "_r"))
    part = Window.partitionBy(*keys, "_b").orderBy("_at")
    # Of several right rows at one instant the smallest id counts: it comes last before, and first after.
    before = F.last(hit, ignorenulls=True).over(Window.partitionBy(*keys, "_b").orderBy("_at", F.col("_r").isNull(), F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(hit, ignorenulls=True).over(Window.partitionBy(*keys, "_b").orderBy("_at", F.col("_r").isNotNull(), F.asc("_r")).rowsBetween(0, Window.unboundedFollowing))
    del part
    both = rows.select(*keys, "_at", "_l", before.alias("p"), after.alias("n")).where(F.col("_l").isNotNull())
    dp, dn = F.col("_at") - F.col("p._at"), F.col("n._at") - F.col("_at")
    use_p = F.col("p").isNotNull() & (F.col("n").isNull() | (dp <= dn))
    dist = F.when(use_p, dp).otherwise(dn)
    return both.select(*keys, F.col("_l").alias(left_id), F.when(use_p, F.col("p._r")).otherwise(F.col("n._r")).alias(right_id), dist.alias("distance")).where(F.col("distance") <= tolerance)


def outside(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, lo: str, hi: str) -> DataFrame:
    """Points that lie in none of the closed intervals of their key: a running maximum of the ends seen so far, over one
    sort per key, in place of a join on the range. Points at the start of an interval come after it."""
    kinds = points.select(*points.columns, F.col(at).alias("_t"), F.lit(1).alias("_p"), F.lit(None).cast("long").alias("_hi"))
    starts = spans.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in keys else F.col(f.name) for f in points.schema.fields], F.col(lo).alias("_t"), F.lit(0).alias("_p"), F.col(hi).cast("long").alias("_hi"))
    w = Window.partitionBy(*keys).orderBy("_t", "_p").rowsBetween(Window.unboundedPreceding, 0)
    seen = kinds.unionByName(starts).withColumn("_end", F.max("_hi").over(w))
    return seen.where((F.col("_p") == 1) & (F.col("_end").isNull() | (F.col("_end") < F.col("_t")))).select(*points.columns)
