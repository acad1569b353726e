"""Steps of long plans, written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, so that a plan that reads them often is neither planned nor run as often.

    The cluster names the shared folder in spark.checkpoint.dir. Only where that is unset and the master is local, a
    temporary folder takes its place; on a cluster that would be the driver's alone, so it is an error.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint()
