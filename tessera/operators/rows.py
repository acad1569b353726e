"""Rows by rank and key: latest, canonical, first and top rows, semi and anti joins, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import classes as C
from tessera.operators.lineage import cut


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of every key; Spark drops later rows before the shuffle (WindowGroupLimit)."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def first_child(parents: DataFrame, children: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """parents with the value of their child that comes first in order; an aggregate instead of a lookup per row."""
    return parents.join(children.groupBy(key).agg(F.min_by(value, order).alias(value)), key, "left")


def ordered_children(parents: DataFrame, children: DataFrame, key: str, value: str, order: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(order, value)))
    return parents.join(children.groupBy(key).agg(F.transform(rows, lambda x: x[value]).alias(f"{value}s")), key, "left")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows; order must end in a unique column."""
    return df.orderBy(*order).offset(offset).limit(limit)


def match_any_key(left: DataFrame, right: DataFrame, left_id: str, keys: list[tuple[str, str]]) -> DataFrame:
    """Pairs that agree in at least one key: a union of equi joins, each pair once, never a nested loop."""
    out = None
    for a, b in keys:
        found = left.join(right, left[a] == right[b])
        out = found if out is None else out.union(found)
    return out.distinct()


def having_any(df: DataFrame, others: list[tuple[DataFrame, str]], key: str) -> DataFrame:
    """Rows whose key is in at least one of several sets."""
    wanted = None
    for other, column in others:
        keys = other.select(F.col(column).alias(key)).where(F.col(key).isNotNull())
        wanted = keys if wanted is None else wanted.union(keys)
    return df.join(wanted.distinct(), key, "left_semi")


def class_overlap_counts(a: DataFrame, b: DataFrame, a_id: str, b_id: str, classes: str = "classes") -> DataFrame:
    """(a_id, n, first) for every id of a that shares a class with one of b: how many ids of b do, and the smallest.

    Ids with equal sets of classes are counted first, so that sets meet instead of ids and no pair of ids is made; sets
    meet by an equi join on classes. 99 is written out as 1..45, and an id of several rows has the classes of all.
    """
    sets = lambda df, c: df.groupBy(c).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_compact(C.expand(F.col(classes))))))).alias("set"))
    mine = sets(a, a_id)
    counted = sets(b, b_id).groupBy("set").agg(F.count(b_id).alias("n"), F.min(b_id).alias("first"))
    spread = lambda df, name: df.select(F.col("set").alias(name), *[c for c in df.columns if c != "set"], F.explode("set").alias("class"))
    met = spread(mine.select("set").distinct(), "sa").join(spread(counted, "sb"), "class").dropDuplicates(["sa", "sb"])
    return mine.join(met.groupBy(F.col("sa").alias("set")).agg(F.sum("n").alias("n"), F.min("first").alias("first")), "set").select(a_id, "n", "first")


def first_others(df: DataFrame, by: list[str], own: list[str], order: list[Column], k: int) -> DataFrame:
    """Rows of which, within every `by`, those first k are never lost that differ from any given values in all of `own`.

    For one column, or two: a row among the first k that are left when a value of each column is excluded has fewer than k
    kept rows before it, and of the excluded values at most as many as a value may keep. Null never equals a value.
    """
    m = len(own)
    if m > 1:
        df = first_per_key(df, [*by, *own], order, k)  # else a value excluded in one column could fill up the other's
    for c in own:
        df = first_per_key(df, [*by, c], order, m * k)
    return first_per_key(df, by, order, k + m * m * k)


#: Row numbers within a partition in what monotonically_increasing_id() gives.
_ROW_BITS = 33


def numbered(df: DataFrame, order: list[Column], start: Column | int = 1, name: str = "n") -> DataFrame:
    """df with `name`, dense numbers from `start` in the order given, without a window over all rows.

    Rows are dealt by ranges of the order and sorted there; a partition's rows count on from those of the partitions
    before, of which there is one row each. Jobs run while this is called.
    """
    held = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("__id", F.monotonically_increasing_id())
    held = held.withColumn("__run", F.shiftright("__id", _ROW_BITS))
    runs = held.groupBy(F.col("__run").alias("__of")).agg(F.count("*").alias("__n"), F.min("__id").alias("__low"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(runs.select("__of", (before - F.col("__low")).alias("__start")))  # a row for each partition
    base = start if isinstance(start, Column) else F.lit(start)
    placed = held.join(starts, F.col("__run") == F.col("__of"))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__id") + F.col("__start") + base).alias(name))
