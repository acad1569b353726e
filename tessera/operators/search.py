"""Searches over the registries: arms of their own kind, the greatest signal of each, a weighted sum, and the records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scores as S
from tessera.functions import text as X
from tessera.operators.retrieval import merge_signals, nearest
from tessera.operators.rows import having_any

#: Candidates that an arm hands on, the least trigram similarity, and sections that hold notices only.
POOL, IMAGE_POOL, LEAST = 200, 100, 0.2
ADMIN_SECTIONS = ("corrections", "gazette_only_announcements")


def application_id(query: str) -> str | None:
    """The application number that a query is, as in "2017/15048" or "2017/15048 B", or None."""
    m = re.fullmatch(r"\s*(\d{4})\s*/\s*(\d{1,6})(?:\s+[A-Za-z]\d?)?\s*", query)
    return f"{m[1]}/{m[2]}" if m else None


def text_arm(rows: DataFrame, query: str, key: str, name: str, k: int = POOL) -> DataFrame:
    """(key, score) of names that contain the query or resemble it in trigrams, both normalised."""
    n, q = X.normalize(F.col(name)), X.normalize(F.lit(query))
    similar = X.trigram_similarity(n, q)
    hit = rows.where(F.contains(n, q) | (similar > LEAST))
    return hit.select(F.col(key), F.round(similar, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def views_arm(views: DataFrame, vector: list[float], key: str, column: str, k: int = IMAGE_POOL) -> DataFrame:
    """(key, score) by the most similar of a design's views."""
    v = F.array(*[F.lit(float(x)) for x in vector])
    best = views.where(F.col(column).isNotNull()).groupBy(key).agg(F.max(S.cosine(F.col(column), v)).alias("s"))
    return best.select(key, F.round("s", 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def ranked(arms: dict[str, DataFrame], weights: dict[str, float], records: DataFrame, key: str, k: int = 20, allowed: DataFrame | None = None) -> DataFrame:
    """The k best of all arms, with their signals, total and records.

    allowed (key) is applied to what the arms found and not before, as in the registry's own search.
    """
    merged = merge_signals(arms, key)
    if allowed is not None:
        merged = merged.join(allowed, key, "left_semi")
    for missing in set(weights) - set(arms):
        merged = merged.withColumn(missing, F.lit(None).cast("double"))
    best = merged.withColumn("total", F.round(S.weighted(weights), 8)).orderBy(F.desc("total"), key).limit(k)
    return records.join(F.broadcast(best), key)  # k rows


def search_patents(patents: DataFrame, query: str, vector: list[float] | None = None, holders: DataFrame | None = None, holder: str | None = None, k: int = 20) -> DataFrame:
    """Patents (id, application_no, title, embedding) for a query: by number alone where it is one, else by text and vector.

    holders (id, name) and holder keep the found patents that have a holder of such a name.
    """
    number = application_id(query)
    if number:
        arms = {"lexical": patents.where(F.col("application_no") == number).select("id", F.lit(1.0).alias("score"))}
    else:
        arms = {"lexical": text_arm(patents, query, "id", "title")}
        if vector:
            arms["semantic"] = nearest(patents, vector, "id", "embedding", POOL)
    allowed = holders.where(F.contains(F.lower("name"), F.lit(holder.strip().lower()))).select("id").distinct() if holder else None
    return ranked(arms, S.HYBRID_TEXT, patents, "id", k, allowed)


def gi_filter(section: Column, gi_type: Column, boundary: Column, day: Column, *, sections: list[str] | None = None, kind: str | None = None, region: str | None = None, since: str | None = None, until: str | None = None, admin: bool = False) -> Column:
    """Filters of geographical indications; sections of notices are left out unless asked for."""
    test = section.isin(sections) if sections else F.lit(True) if admin else ~section.isin(*ADMIN_SECTIONS)
    if kind:
        test &= F.lower(gi_type) == kind.lower()
    if region:
        low = F.lower(boundary)
        test &= F.contains(low, F.lit(region.lower())) | (X.trigram_similarity(low, F.lit(region.lower())) > LEAST)
    if since:
        test &= day >= since
    if until:
        test &= day <= until
    return test


def search_names(rows: DataFrame, query: str, least: float = 0.2, k: int = 50) -> DataFrame:
    """Names with every word of the query longer than two letters, or similar by more than `least`; exact ones first."""
    n, q = X.normalize(F.col("name")), X.normalize(F.lit(query))
    words = [w for w in re.split(r"\W+", query.lower()) if len(w) > 2]
    every = F.lit(bool(words))
    for w in words:
        every &= F.contains(n, X.normalize(F.lit(w)))
    similar = X.trigram_similarity(n, q)
    found = rows.where(every | (similar > least)).select("id", "name", (n == q).alias("exact_match"), F.round(similar, 6).alias("total"))
    return found.orderBy(F.desc("exact_match"), F.desc("total"), "id").limit(k)


def watched_references(watch: DataFrame, records: DataFrame) -> DataFrame:
    """(watch_id, id): records that name a watched one by any of three numbers, each pair once."""
    out = None
    for column in ("existing_registration_no", "registration_no", "reference_no"):
        found = watch.join(records.select("id", F.col(column).alias("watched_no")), "watched_no").select("watch_id", "id")
        out = found if out is None else out.union(found)
    return out.distinct()


def lead_feed(events: DataFrame, marks: DataFrame, kinds: list[str], as_of: Column, months: int) -> DataFrame:
    """Events of some kinds within the last months, with their marks and holders and the days since, the newest first."""
    recent = events.where(F.col("event_type").isin(kinds) & (F.col("event_date") >= F.add_months(as_of, -months)))
    rows = recent.join(marks, "id").withColumn("days_since", F.datediff(as_of, "event_date").cast("long"))
    return rows.orderBy(F.desc_nulls_last("event_date"), F.desc("event_id"))


def patent_leads(events: DataFrame, holders: DataFrame, watch: DataFrame, kinds: list[str]) -> DataFrame:
    """Events of some kinds on patents one of whose holders is watched by id, by client number or by name."""
    h = holders.select("patent_id", "holder_id", "client_id", F.lower("name").alias("low"))
    watched = [
        h.join(watch.select(F.col("holder_id")).where("holder_id is not null").distinct(), "holder_id", "left_semi"),
        h.join(watch.select("client_id").where("client_id is not null").distinct(), "client_id", "left_semi"),
        h.join(watch.select(F.lower("holder_name").alias("low")).where("low is not null").distinct(), "low", "left_semi"),
    ]
    return having_any(events.where(F.col("event_type").isin(kinds)), [(w.select("patent_id"), "patent_id") for w in watched], "patent_id")


def numbered_page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows, each with the number of rows that all pages have together."""
    total = df.agg(F.count("*").alias("total"))  # one row
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def phrase_types(texts: DataFrame, phrases: DataFrame, text: str) -> DataFrame:
    """texts with event_type: of the phrase (phrase, event_type) that the text is, else of the longest that begins it or that it begins.

    phrases is a small table of fixed values. Distinct texts meet it once; shared first letters are the join's key.
    """
    keys = texts.select(F.col(text).alias("t")).distinct().select("t", X.phrase_key(F.col("t")).alias("k")).where("k <> ''").withColumn("c", F.left("k", F.lit(1)))
    table = phrases.select(X.phrase_key(F.col("phrase")).alias("p"), "event_type").withColumn("c", F.left("p", F.lit(1)))
    met = keys.join(table, "c").where(F.col("k").startswith(F.col("p")) | F.col("p").startswith(F.col("k")))
    best = met.groupBy("t").agg(F.max_by("event_type", F.struct((F.col("k") == F.col("p")).alias("same"), F.length("p").alias("n"), "event_type")).alias("event_type"))
    return texts.join(best, F.col(text) == F.col("t"), "left").drop("t").withColumn("event_type", F.coalesce("event_type", F.lit("UNKNOWN")))

