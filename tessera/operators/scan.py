"""Watchlist and conflict scans: new records against watched ones, by joins on blocking keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import classes as C
from tessera.functions import scores as S
from tessera.functions import text as X
from tessera.operators import lexicon, rows, scoring
from tessera.operators.lineage import cut
from tessera.operators.retrieval import similar_names


def _first_marks(watch: DataFrame, marks: DataFrame, near: DataFrame, score: str, own: list[str], k: int) -> DataFrame:
    """(watch_id, cw, cm, mark_id and what near holds of the names) of the k marks of the highest score for every watched item.

    near: na, nb, score and more. A pair needs a shared class and no value of `own` in common. Rows alike in name and
    classes meet as one: of each such group of marks, and of what a group of watched items finds, rows.first_others()
    keeps as many as any item may need, so that what is made grows with the rows, not with the pairs of copies.
    """
    others = [c for c in near.columns if c not in ("na", "nb")]
    value = lambda c: F.nullif(F.trim(c), F.lit("")) if c == "holder" else F.col(c)
    side = lambda df, key, name, cls, full: df.select(key, F.col("name").alias(name), F.array_sort(F.array_distinct("classes")).alias(cls), C.expand(F.col("classes")).alias(full), *[value(c).alias(f"{c}_of") for c in own])
    mine = [f"{c}_of" for c in own]
    w, m = side(watch, "watch_id", "na", "cw", "fw"), side(marks, "mark_id", "nb", "cm", "fm")
    firsts = rows.first_others(m, ["nb", "cm"], mine, [F.col("mark_id")], k)
    groups = firsts.groupBy("nb", "cm").agg(F.first("fm").alias("fm"), F.collect_list(F.struct("mark_id", *mine)).alias("ms"))  # at most k or a few times k marks
    met = w.select("na", "cw", "fw").distinct().join(near, "na").alias("n").join(groups.alias("g"), (F.col("n.nb") == F.col("g.nb")) & F.arrays_overlap("fw", "fm"))
    each = met.select("na", "cw", "cm", *others, F.explode("ms").alias("x")).select("na", "cw", "cm", *others, "x.*")
    best = rows.first_others(each, ["na", "cw"], mine, [F.desc(score), F.col("mark_id")], k)
    lists = best.groupBy("na", "cw").agg(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("less"), "mark_id", "cm", *others, *mine))).alias("found"))
    same = lambda x: [F.coalesce(x[c] == F.col(c), F.lit(False)) for c in mine]
    free = F.slice(F.filter("found", lambda x: ~reduce(lambda p, q: p | q, same(x))), 1, k)
    told = w.join(lists, ["na", "cw"]).select("watch_id", "cw", F.explode(free).alias("x")).select("watch_id", "cw", "x.mark_id", "x.cm", *[f"x.{c}" for c in others])
    return rows.first_per_key(told, ["watch_id"], [F.desc(score), F.col("mark_id")], k)  # an item may stand in several rows


def _may_share() -> Column:
    """Whether names a and b may share a class by their bits; no pair that does is missed."""
    return F.col("a_bits").bitwiseAND(F.col("b_bits")) != 0


def _names_with_classes(df: DataFrame) -> DataFrame:
    """(name, bits) of distinct names; bits holds the classes of all rows of the name, each as one of 64 bits."""
    bit = lambda c: F.coalesce(F.call_function("shiftleft", F.lit(1).cast("bigint"), c), F.lit(0).cast("bigint"))
    of_row = F.aggregate(C.expand(F.col("classes")), F.lit(0).cast("bigint"), lambda s, c: s.bitwiseOR(bit(c)))
    return df.where("name is not null").groupBy("name").agg(F.bit_or(F.coalesce(of_row, F.lit(0).cast("bigint"))).alias("bits"))


def conflicts(watch: DataFrame, marks: DataFrame, least: float = 0.5, k: int = 10) -> DataFrame:
    """The k most similar marks for every watched item: (watch_id, mark_id, similarity, overlap).

    watch: watch_id, name, classes, holder; marks: mark_id, name, classes, holder. A pair needs a shared class, a
    trigram similarity of at least `least` and different holders. Distinct names meet on trigrams first, which is the
    more selective key.
    """
    near = similar_names(_names_with_classes(watch), _names_with_classes(marks), "name", least, ("bits",), _may_share())
    best = _first_marks(watch, marks, near, "similarity", ["holder"], k)
    return best.select("watch_id", "mark_id", "similarity", C.overlap(F.col("cw"), F.col("cm")).alias("overlap"))


def name_candidates(watch: DataFrame, marks: DataFrame, stats: DataFrame, score: float, sounds: bool, least: float = 0.3) -> DataFrame:
    """(na, nb): every pair of distinct names of both sides that the registry's retrieval would bring together and may score `score`.

    Names equal but for blanks, names that share an anchor (a word or part of one that is not generic), names of which
    one has an anchor that begins, three letters longer, with an anchor of the other, and names whose trigram similarity
    is at least `least`; rows of both must share a class. Each rule is an equi join on keys of its own, so no pair of names
    that shares none is ever made, and what is known of both names rules out most pairs where they meet: those with too
    low a score by scoring.may_reach(), and those without a shared class.
    """
    one, two = _names_with_classes(watch), _names_with_classes(marks)
    words = cut(lexicon.names(one.select("name").union(two.select("name")).distinct(), "name", stats, scoring.LEVEL_WEIGHTS)).select("name", "norm", "words")
    one, two = cut(words.join(one, "name")), cut(words.join(two, "name"))
    bounded = score > scoring.UNMET
    fits = scoring.may_reach(F.col("a_norm"), F.col("b_norm"), F.col("a_words"), F.col("b_words"), score, sounds) if bounded else F.lit(True)
    able = scoring.may_meet(F.col("words")) if bounded else F.lit(True)
    anchors = F.transform(F.filter("words", lambda w: ~lexicon.generic(w["role"])), lambda w: w["t"])
    begun = lambda t: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(t) - 4)), lambda i: F.substr(t, F.lit(1), F.when(i == 0, F.length(t)).otherwise(i)))
    compact = F.replace("norm", F.lit(" "), F.lit(""))
    keyed = lambda df, p, keys: df.select(F.col("name").alias(f"n{p}"), *[F.col(c).alias(f"{p}_{c}") for c in ("bits", "norm", "words")], F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("="), compact)), keys))).alias("key")).where("key <> '='")
    none = F.array().cast("array<string>")
    met = keyed(one, "a", F.when(able, anchors).otherwise(none)).join(keyed(two, "b", F.flatten(F.transform(anchors, begun))), "key").where(_may_share() & fits)
    similar = similar_names(one.where(able), two, "name", least, ("bits", "norm", "words"), _may_share(), fits)
    return cut(met.select("na", "nb").union(similar.select("na", "nb")).distinct())


def name_conflicts(watch: DataFrame, marks: DataFrame, stats: DataFrame, least: float = 0.5, k: int = 20, sounds: bool = True) -> DataFrame:
    """The k marks of the highest score for every watched item: watch_id, mark_id, score, path, risk_level, conflict_type, overlap.

    watch: watch_id, name, classes, holder, application_no; marks: mark_id and the same. A pair needs a shared class,
    different holders and applications, and a score of at least `least`. overlap is what both share or, where either
    holds class 99, all that they name. Distinct pairs of names are scored once, by scoring.score_pairs().
    """
    used = ["name", "classes", "holder", "application_no"]
    watch, marks, stats = cut(watch.select("watch_id", *used)), cut(marks.select("mark_id", *used)), cut(stats)  # each is read by many steps
    pairs = name_candidates(watch, marks, stats, least, sounds)
    scored = cut(scoring.score_pairs(pairs, "na", "nb", stats, sounds, least=least).select("na", "nb", "score", "path"))  # else a filter would have each score worked out twice
    near = scored.where(F.col("score") >= least)
    best = _first_marks(watch, marks, near, "score", ["holder", "application_no"], k)
    every = F.array_contains("cw", C.ALL) | F.array_contains("cm", C.ALL)
    overlap = F.array_sort(F.when(every, F.array_union("cw", "cm")).otherwise(F.array_intersect("cw", "cm")))
    # meanings of names no longer count, so a conflict rests on the text
    return best.select("watch_id", "mark_id", "score", "path", S.risk_level(F.col("score")).alias("risk_level"), F.lit("TEXT").alias("conflict_type"), overlap.alias("overlap"))


def reasons(score: Column, overlap: Column, registered: Column) -> Column:
    """What a conflict rests on, in words."""
    shared = F.when(F.size(overlap) > 0, F.concat(F.lit("classes "), F.array_join(overlap, ",")))
    return F.concat_ws("; ", F.when(score >= 0.8, "similar text"), shared, F.when(registered, "registered"))


def event_alerts(events: DataFrame, watch: DataFrame, alerted: DataFrame) -> DataFrame:
    """Events on watched applications for which no alert stands yet (application_no, event_type, event_date, watch_id)."""
    hits = events.join(watch.select("application_no", "watch_id"), "application_no")
    return hits.join(alerted.select("watch_id", "event_type", "event_date"), ["watch_id", "event_type", "event_date"], "left_anti")


def holder_watch(watch: DataFrame, records: DataFrame) -> DataFrame:
    """Records whose holder is a watched name, without regard to case."""
    return watch.select("watch_id", F.lower(F.trim("holder")).alias("h")).join(records.withColumn("h", F.lower(F.trim("holder"))), "h").drop("h")


#: What a record of a section says of the right it refers to.
LIFECYCLE = {"article_42_change_requests": "lifecycle_change_request", "article_42_finalized": "lifecycle_finalized", "corrections": "lifecycle_correction"}


def lifecycle_watch(watch: DataFrame, records: DataFrame) -> DataFrame:
    """(watch_id, record_id, match_type) of records that refer to a watched registration by any of three numbers.

    watch: watch_id, registration_no; records: record_id, section, registration_no, existing_registration_no and
    correction_of (a text). One equi join over the distinct numbers of a record, so neither an OR nor a row twice.
    """
    kinds = F.create_map(*[F.lit(x) for kv in LIFECYCLE.items() for x in kv])
    numbers = F.array_distinct(F.array_compact(F.array(*[F.col(c).cast("string") for c in ("registration_no", "existing_registration_no", "correction_of")])))
    told = records.select("record_id", F.coalesce(kinds[F.col("section")], F.lit("lifecycle_change_request")).alias("match_type"), F.explode(numbers).alias("no"))
    return watch.select("watch_id", F.col("registration_no").cast("string").alias("no")).join(told, "no").select("watch_id", "record_id", "match_type")


def state_changes(before: DataFrame, after: DataFrame, key: str, watched: list[str]) -> DataFrame:
    """(key, change, field, old, new) between two snapshots: rows that came, rows that went, and values that differ.

    One full join on the key; values are compared as texts, nulls included.
    """
    side = lambda df, n: df.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in watched]).alias(n))
    both = side(before, "a").join(side(after, "b"), key, "full")
    change = lambda kind, field, old, new: F.struct(F.lit(kind).alias("change"), F.lit(field).cast("string").alias("field"), old.cast("string").alias("old"), new.cast("string").alias("new"))
    none = F.lit(None)
    differ = [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), change("changed", c, F.col(f"a.{c}"), F.col(f"b.{c}"))) for c in watched]
    found = F.when(F.col("a").isNull(), F.array(change("came", None, none, none))).when(F.col("b").isNull(), F.array(change("went", None, none, none))).otherwise(F.array_compact(F.array(*differ)))
    return both.select(key, F.explode(found).alias("x")).select(key, "x.change", "x.field", "x.old", "x.new")


def portfolio(records: DataFrame, names: str, wanted: str) -> DataFrame:
    """Records in whose list of names the wanted one is, compared without punctuation and case."""
    return records.where(F.array_contains(F.transform(names, X.holder_key), X.holder_key(F.lit(wanted))))
