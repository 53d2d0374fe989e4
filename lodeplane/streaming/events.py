"""Structured Streaming over change events: debounced sessions, last event per key, keyed latest hash, ingest of files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def sessions(events: DataFrame, keys: list[str], ts: str, gap: str, late: str | None = None) -> DataFrame:
    """Debouncing: events of a key less than ``gap`` apart are one session, of which the last event and the count count.
    Works on a stream (give the lateness allowed) and on a table alike."""
    e = events.withColumn("_t", F.col(ts).cast("timestamp"))
    e = e.withWatermark("_t", late) if late else e
    last = F.max_by(F.struct(*[c for c in events.columns if c not in keys]), F.struct("_t", *[c for c in events.columns if c.endswith("_id")])).alias("last")
    return e.groupBy(*keys, F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("events"), last).select(*keys, F.col("w.start").alias("started"), "events", "last.*")


def windows(events: DataFrame, key: str, ts: str, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts in tumbling or sliding windows."""
    e = events.withColumn("_t", F.col(ts).cast("timestamp"))
    e = e.withWatermark("_t", late) if late else e
    w = F.window("_t", width, slide) if slide else F.window("_t", width)
    return e.groupBy(key, w.alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("started"), "events")


def read_files(spark: SparkSession, folder: str, schema: StructType, per_batch: int = 8) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", partition: str | None = None) -> None:
    """Process all that is there and stop; restarting goes on from the checkpoint."""
    w = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (w.partitionBy(partition) if partition else w).start().awaitTermination()


def keep_latest(stream: DataFrame, keys: list[str], order: str, state: str, checkpoint: str) -> None:
    """Keyed state as a table: each micro-batch is merged into versions of a folder, the latest row per key winning.

    A batch writes a new version named by its number and reads the one before, so that a batch that is run again gives
    the same version. ``latest_version`` finds the last.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        before = latest_version(spark, state, below=n)
        rows = batch if before is None else batch.unionByName(before)
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("x"))
        best.select(*keys, "x.*").select(*batch.columns).write.mode("overwrite").parquet(f"{state}/v={n:08d}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_version(spark: SparkSession, state: str, below: int | None = None) -> DataFrame | None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(state)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = sorted(Path(s.getPath().toString()).name for s in fs.listStatus(path))
    names = [n for n in names if n.startswith("v=") and (below is None or int(n[2:]) < below)]
    return spark.read.parquet(f"{state}/{names[-1]}") if names else None


def stale(consumed: DataFrame, latest: DataFrame, keys: list[str], recorded: str, current: str) -> DataFrame:
    """Consumers whose recorded value is not the latest of their key, or whose key is gone."""
    return consumed.join(latest, keys, "left").where(F.col(current).isNull() | (F.col(recorded) != F.col(current)))
