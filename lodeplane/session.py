"""Session settings and the shared folder used for cutting lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.ui.enabled", "false")
    b = b.config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.driver.memory", memory)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    return b.getOrCreate()


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. A session on one machine that names none gets a
    folder of its own; on a cluster that is an error, since no folder of the driver's machine is shared.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if sc.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lodeplane-ckpt-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
