"""Rendezvous (highest random weight) sharding of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

#: Slots are numbered in this many independent parts of a shard, so no task sorts a whole shard.
SLOT_PARTS = 1024


def _bits(*parts: Column) -> Column:
    """The first 52 bits of a digest of the parts, as a whole double."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double")


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard of a key: the one whose exponential draw at rate weight, keyed by (key, shard), is least.

    A draw is the first 52 bits of an MD5 digest, so that any other engine can find the same shard.

    A shard added at the end only competes with the old winner, so records move into it or stay.
    Shards of weight 0 take nothing. Expected shares are proportional to the weights.
    """
    draws = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            draws.append(F.struct((-F.log((_bits(key, F.lit(shard), F.lit(seed)) + 0.5) / float(1 << 52)) / float(weight)).alias("draw"), F.lit(shard).alias("shard")))
    if not draws:
        raise ValueError("at least one shard needs a positive weight")
    return F.array_min(F.array(*draws))["shard"]


def shard_records(
    records: DataFrame,
    weights: Sequence[float] = (1.0,) * 8,
    grown_weight: float = 1.0,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 0,
) -> DataFrame:
    """Deals records to len(weights) shards by their key and numbers each shard's records from 0.

    Returns key, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot, grown_shard (the shard
    when one more of grown_weight is appended). Null keys hash as one key of their own; a null text has no bytes.
    Repeated rows keep their own slots. Other columns are not read, so their names cannot clash. Within a shard, slots
    follow a digest of (key, text_crc32, size), then these three. Jobs run while this is called.
    """
    body = F.coalesce(F.encode(F.col(f"`{text}`"), "UTF-8"), F.lit(b""))
    name = F.coalesce(F.col("k").cast("string"), F.lit("\x00null"))
    sized = records.select(F.col(f"`{key}`").alias("k"), (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).cast("long").alias("crc"))
    # rows alike in all three are counted first and numbered together, so that no repeated row is a hot group
    alike = cut(sized.groupBy("k", "size", "crc").agg(F.count("*").alias("n")))
    part = F.pmod(_bits(name, F.col("crc"), F.col("size")).cast("long"), F.lit(SLOT_PARTS)).alias("part")
    dealt = alike.select("k", "size", "crc", "n", rendezvous(name, weights, seed).alias("shard"), rendezvous(name, [*weights, grown_weight], seed).alias("grown_shard"), part)
    counts = dealt.groupBy("shard", "part").agg(F.sum("n").alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # at most len(weights) * SLOT_PARTS rows, whatever the input
    starts = F.broadcast(counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    inside = W.partitionBy("shard", "part").orderBy("k", "crc", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["shard", "part"])
    return placed.select(
        F.col("k").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(F.col("start") + F.col("first"), F.col("start") + F.col("first") + F.col("n") - 1)).alias("slot"),
        "grown_shard",
    )


def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(table(spark, sf_dir, "documents"))
