"""Counts and lists for dashboards, leads and alerts: conditional aggregates over filtered joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_where(df: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    """One pass for any number of conditional counts."""
    aggs = [F.count_if(c).alias(n) for n, c in conditions.items()]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def lead_stats(leads: DataFrame, days_left: Column) -> DataFrame:
    """Disjoint urgency classes of open leads."""
    return counts_where(leads, [], {"critical": days_left.between(0, 7), "urgent": days_left.between(8, 14), "soon": days_left.between(15, 30), "later": days_left > 30, "expired": days_left < 0})


def lead_statistics_view(leads: DataFrame, days_left: Column) -> DataFrame:
    """Cumulative urgency classes: urgent ones include critical ones."""
    return counts_where(leads, [], {"critical": days_left.between(0, 7), "urgent": days_left.between(0, 14), "soon": days_left.between(0, 30)})


def totals(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of independent counts; each table gives one row, so the cross join is of single rows."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def source_overlap(records: DataFrame, key: str, source: str) -> DataFrame:
    """Number of keys by the combination of sources that hold them."""
    sets = records.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(source)), "+").alias("sources"), F.count("*").alias("n"))
    return sets.groupBy("sources").agg(F.count("*").alias("n_keys"), F.max("n").alias("most_rows"))


#: Days to the deadline at most, by urgency; as filters they are cumulative.
URGENT = {"critical": 7, "urgent": 14, "soon": 30}
#: Months after its expiry for which a mark still stands against others.
GRACE_MONTHS = 6


def conflict_leads(
    conflicts: DataFrame, marks: DataFrame, organizations: DataFrame, watched: DataFrame, as_of: Column, least: float = 0.5, urgency: str | None = None, nice_class: int | None = None, k: int = 50
) -> DataFrame:
    """Open conflicts that an organisation may be told of: the k nearest to their deadline, then of the highest score.

    conflicts: id, new_mark_id, existing_mark_id, existing_holder_id, existing_app_no, score, overlapping (classes),
    deadline; marks: id, name, expiry; organizations: id; watched: application_no, is_active. A lead has a score of at
    least `least`, shared classes and a deadline to come; the existing mark's expiry, if known, is no longer past than
    GRACE_MONTHS; its holder is no organisation of the service and it is on none of the active watches.
    """
    left = F.datediff("deadline", as_of)
    open_ones = conflicts.where((left >= 0) & (F.col("score") >= least) & (F.coalesce(F.size("overlapping"), F.lit(0)) > 0))
    if urgency:
        open_ones = open_ones.where(left <= URGENT[urgency])
    if nice_class is not None:
        open_ones = open_ones.where(F.array_contains("overlapping", nice_class))
    free = open_ones.join(organizations.select(F.col("id").alias("existing_holder_id")), "existing_holder_id", "left_anti")
    free = free.join(watched.where("is_active").select(F.col("application_no").alias("existing_app_no")), "existing_app_no", "left_anti")
    side = lambda n: marks.select(F.col("id").alias(f"{n}_mark_id"), F.col("name").alias(f"{n}_mark_name"), F.col("expiry").alias(f"{n}_expiry"))
    named = free.join(side("new"), "new_mark_id", "left").join(side("existing"), "existing_mark_id", "left")
    live = named.where(F.col("existing_expiry").isNull() | (F.col("existing_expiry") >= F.add_months(as_of, -GRACE_MONTHS)))
    level = F.coalesce(*[F.when(left <= days, name) for name, days in URGENT.items()], F.lit("normal"))
    told = live.select("id", "new_mark_name", "existing_mark_name", "score", F.array_sort("overlapping").alias("overlapping"), left.alias("days_left"), level.alias("urgency"))
    return told.orderBy("days_left", F.desc("score"), "id").limit(k)
