"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one that the driver and all executors share.

    The cluster names it in spark.checkpoint.dir. Only where that is unset and the master is local, a temporary
    folder is made and set as the checkpoint folder; on a cluster that would be the driver's alone, so it is an error.
    Checkpoints go with their DataFrames where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/tessera-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, written to the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs, with dots or not, can clash with a step's own columns."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def fields_of(row: str, names: list[str]) -> list[Column]:
    """The columns of a whole_row() again, by their old names."""
    return [F.col(row).getField(c).alias(c) for c in names]


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder under shared_dir() that is not needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words_of(text: Column) -> Column:
    """Words of a text: maximal runs of characters other than WS; no words for null or blank texts."""
    trimmed = F.btrim(text, F.lit(WS_CHARS))
    return F.when(trimmed.isNull() | (trimmed == ""), F.array().cast("array<string>")).otherwise(F.split(trimmed, WS, -1))
