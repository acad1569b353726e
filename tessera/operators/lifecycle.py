"""Status of registry rights, folded from their events in order.

A state machine is data: a table of transitions (event, state before, state after). The fold is one built-in
aggregate over a key's sorted events, so it stays in the JVM; a key's events are its unit of work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.dates import parse_date

# fixed values: lifecycle of patents ---------------------------------------------------------------------------
PATENT_SEED = {"PUBLISHED_APP": "PENDING", "PUBLISHED_UM_APP": "PENDING", "GRANTED_PATENT": "ACTIVE", "GRANTED_UM": "ACTIVE"}
PATENT_RANK = {
    "APPLICATION_REJECTED": -3, "APPLICATION_WITHDRAWN": -3, "APPLICATION_ABANDONED": -3, "GRANT_PROTECTION_EXPIRED": -3, "GRANT_INVALIDATED_LEGACY_551": -3,
    "APPLICATION_LAPSED_OR_REJECTED": -2, "APPLICATION_FEE_LAPSE": -2, "GRANT_FEE_LAPSE": -2,
    "APPLICATION_PUBLISHED": 1,
    "APPLICATION_FEE_LAPSE_CANCELLED": 2, "APPLICATION_ABANDONED_CANCELLED": 2, "APPLICATION_FEE_REVALIDATION": 2, "PROCEDURAL_REVALIDATION": 2,
    "GRANT_FEE_LAPSE_CANCELLED": 2, "GRANT_FEE_REVALIDATION": 2,
    "GRANT_ANNOUNCED": 3, "GRANT_ANNOUNCED_LEGACY_551": 3, "GRANT_FINALIZED": 3,
}
_LIVE = "UNKNOWN PENDING ACTIVE LAPSED_APPLICATION LAPSED_GRANT".split()
PATENT_MOVES = {
    **{(e, s): to for s in _LIVE for e, to in {"APPLICATION_REJECTED": "REJECTED", "APPLICATION_WITHDRAWN": "WITHDRAWN", "APPLICATION_ABANDONED": "WITHDRAWN", "GRANT_PROTECTION_EXPIRED": "EXPIRED", "GRANT_INVALIDATED_LEGACY_551": "INVALIDATED"}.items()},
    **{(e, s): "ACTIVE" for s in [*_LIVE, "WITHDRAWN"] for e in ("GRANT_ANNOUNCED", "GRANT_ANNOUNCED_LEGACY_551", "GRANT_FINALIZED")},
    **{(e, s): "LAPSED_APPLICATION" for s in ("UNKNOWN", "PENDING") for e in ("APPLICATION_LAPSED_OR_REJECTED", "APPLICATION_FEE_LAPSE")},
    **{("GRANT_FEE_LAPSE", s): "LAPSED_GRANT" for s in ("UNKNOWN", "PENDING", "ACTIVE", "LAPSED_APPLICATION")},
    **{(e, s): "ACTIVE" for s in ("UNKNOWN", "PENDING", "LAPSED_APPLICATION", "LAPSED_GRANT") for e in ("GRANT_FEE_LAPSE_CANCELLED", "GRANT_FEE_REVALIDATION")},
    **{(e, "LAPSED_APPLICATION"): "PENDING" for e in ("APPLICATION_FEE_LAPSE_CANCELLED", "APPLICATION_FEE_REVALIDATION", "PROCEDURAL_REVALIDATION")},
    ("APPLICATION_PUBLISHED", "UNKNOWN"): "PENDING",
    ("APPLICATION_ABANDONED_CANCELLED", "WITHDRAWN"): "PENDING",
    ("PROCEDURAL_REVALIDATION", "WITHDRAWN"): "PENDING",
    ("PROCEDURAL_REVALIDATION", "LAPSED_GRANT"): "ACTIVE",
}

# fixed values: lifecycle of designs ---------------------------------------------------------------------------
DESIGN_SEED = {"tr_native": "Yayında", "deferred_lifted": "Yayında", "republished": "Yayında", "hague": "Yayında", "deferred": "Yayım Ertelendi"}
DESIGN_RANK = {
    "full_cancellation_board": -3, "full_cancellation_applicant": -3, "partial_cancellation_board": -2, "partial_cancellation_owner": -2,
    "seizure": -1, "provisional_seizure": -1, "partial_provisional_injunction": -1, "provisional_injunction_lifted": 1,
    "transfer": 2, "renewal": 3, "partial_renewal": 3,
}
DESIGN_TERMINAL = ("Hükümsüz", "İptal Edildi", "Süresi Doldu")
_DESIGN_TO = {
    "full_cancellation_board": "Hükümsüz", "partial_cancellation_board": "Hükümsüz", "full_cancellation_applicant": "İptal Edildi",
    "partial_cancellation_owner": "İptal Edildi", "renewal": "Yenilendi", "partial_renewal": "Yenilendi", "transfer": "Devredildi",
}
DESIGN_MOVES = {(e, s): to for e, to in _DESIGN_TO.items() for s in ("Bilinmiyor", "Yayında", "Yayım Ertelendi", "Yenilendi", "Devredildi")}


def _lookup(pairs: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def _fold(events: Column, seed: Column, moves: dict[tuple[str, str], str]) -> Column:
    """struct<status, last_event_type, last_event_date>; an event without a transition from the state passes."""
    table = {f"{e}|{s}": to for (e, s), to in moves.items()}
    start = F.struct(seed.alias("status"), F.lit(None).cast("string").alias("last_event_type"), F.lit(None).cast("date").alias("last_event_date"))

    def step(s: Column, e: Column) -> Column:
        to = _lookup(table, F.concat(e["type"], F.lit("|"), s["status"]))
        moved = F.struct(to.alias("status"), e["type"].alias("last_event_type"), e["day"].alias("last_event_date"))
        return F.when(to.isNotNull(), moved).otherwise(s)

    return F.aggregate(events, start, step)


def _ordered(day: Column, rank: Column, kind: Column, extra: list[Column] = ()) -> Column:
    return F.sort_array(F.collect_list(F.struct(day.alias("day"), rank.alias("rank"), kind.alias("type"), *extra)))


def patent_status(events: DataFrame, patents: DataFrame) -> DataFrame:
    """(application_no, status, last_event_type, last_event_date) of every patent of (application_no, record_type).

    events: application_no, event_type, event_date, bulletin_date. Order: date of the bulletin, else of the event,
    unknown first; then what harms before what helps; then type. Events of other types are ignored.
    """
    day = F.coalesce("bulletin_date", "event_date")
    kept = events.where(F.col("event_type").isin(list(PATENT_RANK)))
    lists = kept.groupBy("application_no").agg(_ordered(day, _lookup(PATENT_RANK, F.col("event_type")), F.col("event_type")).alias("events"))
    seed = F.coalesce(_lookup(PATENT_SEED, F.col("record_type")), F.lit("UNKNOWN"))
    none = F.array().cast("array<struct<day:date,rank:int,type:string>>")
    state = _fold(F.coalesce("events", none), seed, PATENT_MOVES)
    return patents.join(lists, "application_no", "left").select("application_no", state.alias("s")).select("application_no", "s.*")


def design_status(events: DataFrame, designs: DataFrame, as_of: Column) -> DataFrame:
    """As patent_status, for designs (application_no, design_index, section, application_date).

    An event that lists design_indices concerns the listed designs only, none where the design's index is unknown.
    A design that ends in no terminal state expires 25 years (9131 days) after its application.
    """
    day = F.coalesce("bulletin_date", "event_date")
    kept = events.where(F.col("event_type").isin(list(_DESIGN_TO)))
    lists = kept.groupBy("application_no").agg(_ordered(day, _lookup(DESIGN_RANK, F.col("event_type")), F.col("event_type"), [F.col("design_indices").alias("only")]).alias("events"))
    mine = F.filter(F.coalesce("events", F.array().cast(lists.schema["events"].dataType)), lambda e: F.coalesce(F.size(e["only"]) <= 0, F.lit(True)) | F.coalesce(F.array_contains(e["only"], F.col("design_index")), F.lit(False)))
    state = _fold(mine, F.coalesce(_lookup(DESIGN_SEED, F.col("section")), F.lit("Bilinmiyor")), DESIGN_MOVES)
    ends = F.date_add("application_date", 9131)
    over = ~F.col("s.status").isin(*DESIGN_TERMINAL) & F.coalesce(ends < as_of, F.lit(False))
    return designs.join(lists, "application_no", "left").withColumn("s", state).select(
        "application_no",
        "design_index",
        F.when(over, "Süresi Doldu").otherwise(F.col("s.status")).alias("status"),
        F.when(over, "term_expired").otherwise(F.col("s.last_event_type")).alias("last_event_type"),
        F.when(over, ends).otherwise(F.col("s.last_event_date")).alias("last_event_date"),
    )


# fixed values: events of trademarks ---------------------------------------------------------------------------
RESTRICTIONS = ("seizure", "precautionary_seizure", "injunction", "precautionary_injunction")
LIFTS = ("seizure_lift", "injunction_lift", "restriction_lift")
TRANSFERS = ("transfer", "merger", "partial_transfer")
MARK_STATUS = {**dict.fromkeys(TRANSFERS, "Devredildi"), "cancellation": "İptal Edildi", "withdrawal": "Geri Çekildi", "renewal": "Yenilendi"}
FLAGS = {"license": "has_license", "bankruptcy": "has_bankruptcy", "correction": "has_correction", "madrid_registration": "madrid_protected", "madrid_renewal": "madrid_protected"}


def trademark_fold(events: DataFrame) -> DataFrame:
    """State of a trademark by application_no, from events in the order of bulletin_date (unknown first), created_at, id.

    events: application_no, event_type, event_subtype, new_value, details (a map, may be absent), bulletin_date,
    created_at, id. Last-wins columns are max_by over the order; the count of active restrictions is floored at 0 at
    every step, which is the final running sum less the least running sum below 0. All of it is one window and one
    aggregation. A renewal of 29 February expires on 28 February where ten years on has no such day.
    """
    order = W.partitionBy("application_no").orderBy(F.col("bulletin_date").asc_nulls_first(), "created_at", "id")
    kind = F.col("event_type")
    delta = F.when(kind.isin(*RESTRICTIONS), 1).when(kind.isin(*LIFTS), -1).otherwise(0)
    seen = events.select("*", F.row_number().over(order).alias("n"), F.sum(delta).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("running"))
    status = _lookup(MARK_STATUS, kind)
    holder = F.trim(F.substring_index("new_value", "(", 1))
    named = kind.isin(*TRANSFERS) & (holder != "")
    told = F.coalesce(F.nullif(F.col("details")["renewal_date"], F.lit("")), F.col("new_value")) if "details" in events.columns else F.col("new_value")
    renewed = parse_date(told, day_first=False)
    last = lambda value, when: F.max_by(value, F.when(when, F.col("n")))
    court = F.contains(F.lower("event_subtype"), F.lit("court"))
    active = (F.max_by("running", "n") - F.least(F.lit(0), F.min("running"))).cast("int")
    flags = F.array_sort(F.array_compact(F.array_union(F.collect_set(_lookup(FLAGS, kind)), F.array(F.when(F.bool_or(court), F.lit("has_court_order"))))))
    return seen.groupBy("application_no").agg(
        last(status, status.isNotNull()).alias("effective_status"),
        active.alias("active_restriction_count"),
        (active > 0).alias("has_restrictions"),
        last(holder, named).alias("current_holder_name"),
        last(F.col("bulletin_date"), named).alias("holder_changed_at"),
        last(F.add_months(renewed, 120), (kind == "renewal") & renewed.isNotNull()).alias("renewal_expiry"),
        F.max_by("event_type", "n").alias("last_event_type"),
        F.max_by("bulletin_date", "n").alias("last_event_date"),
        F.map_from_arrays(flags, F.transform(flags, lambda _: F.lit(True))).alias("event_flags"),
        F.coalesce(F.bool_or(court), F.lit(False)).alias("has_court_order"),
        F.count("*").alias("total_event_count"),
    )


def final_status(current: Column, effective: Column, source: Column, bulletin_date: Column, gazette_date: Column, updated: Column, event_date: Column) -> Column:
    """The status of the newer source: that of events where their date is not before the document's."""
    ingest = F.coalesce(F.when(source == "BLT", bulletin_date).when(source == "GZ", gazette_date).otherwise(updated), updated)
    return (
        F.when(effective.isNull(), current).when(current.isNull(), effective).when(event_date >= ingest, effective).when(event_date < ingest, current).otherwise(F.coalesce(effective, current))
    )


def orphan_reset(states: DataFrame, events: DataFrame) -> DataFrame:
    """Keys that hold a state but no event any more, with the state of a key without events."""
    return states.join(events.select("application_no").distinct(), "application_no", "left_anti").select(
        "application_no", F.lit(None).cast("string").alias("effective_status"), F.lit(0).alias("active_restriction_count"), F.lit(0).cast("long").alias("total_event_count")
    )
