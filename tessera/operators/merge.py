"""Merging of records from several sources: upserts, priorities, scope replacement, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.functions import status as ST
from tessera.operators import rows

RANK = {"BLT": 1, "GZ": 2, "APP": 3}


def _sides(target: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    rest = [c for c in target.columns if c not in keys]
    t = target.select(*keys, F.struct(*rest).alias("t"))
    i = incoming.select(*keys, F.struct(*[c for c in rest if c in incoming.columns]).alias("i"))
    return t.join(i, keys, "full"), rest


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming values win where they are not null; new keys are added."""
    both, rest = _sides(target, incoming, keys)
    return both.select(*keys, *[F.coalesce(f"i.{c}", f"t.{c}").alias(c) if c in incoming.columns else F.col(f"t.{c}").alias(c) for c in rest])


def overwrite(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace rows of the same key as a whole."""
    return target.join(incoming, keys, "left_anti").unionByName(incoming)


def insert_absent(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(incoming.dropDuplicates(keys).join(target, keys, "left_anti"))


def replace_scopes(target: DataFrame, incoming: DataFrame, scope: list[str]) -> DataFrame:
    """All rows of every scope that incoming delivers are replaced by what it delivers."""
    return target.join(incoming.select(*scope).distinct(), scope, "left_anti").unionByName(incoming)


def prune_scopes(target: DataFrame, present: DataFrame, scope: list[str]) -> DataFrame:
    return target.join(present.select(*scope).distinct(), scope, "left_semi")


def _classes(old: Column, new: Column, source: Column, plain: Column) -> Column:
    """Lists of exactly six (a page's limit) never replace a longer one; applications fill an empty list or lengthen one.

    plain is what the priority of the sources alone would keep.
    """
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    app = F.when(size(old) == 0, F.coalesce(new, old)).when((size(new) > 6) & (size(new) > size(old)), new).otherwise(old)
    return F.when(source == "APP", app).when((size(new) == 6) & (size(old) > 6), old).otherwise(plain)


#: Fields that one source owns: others leave them as they are.
OWNED = {"bulletin_no": "BLT", "bulletin_date": "BLT", "appeal_deadline": "BLT", "registration_no": "GZ", "registration_date": "GZ", "gazette_no": "GZ", "gazette_date": "GZ"}


def priority_merge(target: DataFrame, incoming: DataFrame, key: str = "application_no") -> DataFrame:
    """Merges deliveries (key, source, status, classes and any other columns) into target: BLT < GZ < APP.

    A source of at least the target's rank replaces values, one of a lower rank fills gaps; null never replaces a value.
    OWNED fields change by their owner's delivery alone. A lower rank changes the status only of what an application
    delivered as applied for; the source is that of the status. A boolean clear_name in incoming empties the name. New
    keys take their delivery as it is.
    """
    both, rest = _sides(target, incoming.drop("clear_name"), [key])
    if "clear_name" in incoming.columns:
        both = both.join(incoming.select(key, F.col("clear_name").alias("clear")), key, "left")
    rank = lambda c: F.coalesce(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[c], F.lit(0))
    source = F.col("i.source")
    first = rank(source) >= rank(F.col("t.source"))

    next_status = F.when(first | ((F.col("t.source") == "APP") & (F.col("t.status") == ST.APPLIED)), F.col("i.status")).otherwise(F.col("t.status"))
    status = F.coalesce(next_status, "t.status", "i.status")

    def merged(c: str) -> Column:
        old, new = F.col(f"t.{c}"), F.col(f"i.{c}") if c in incoming.columns else F.lit(None)
        plain = F.when(first, F.coalesce(new, old)).otherwise(F.coalesce(old, new))
        if c == "status":
            value = status
        elif c == "source":
            value = F.when(status == F.col("t.status"), old).otherwise(new)
        elif c in OWNED:
            value = F.when(source == OWNED[c], F.coalesce(new, old)).otherwise(old)
        elif c == "classes":
            value = _classes(old, new, source, plain)
        elif c == "name" and "clear_name" in incoming.columns:
            value = F.when(~F.coalesce("clear", F.lit(False)), plain)
        else:
            value = plain
        return F.when(F.col("i").isNull(), old).when(F.col("t").isNull(), new).otherwise(value).alias(c)

    return both.select(key, *[merged(c) for c in rest])


def replace_children(children: DataFrame, incoming: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children of every delivered parent are those delivered, which may be none; children of others stay."""
    return children.join(parents.select(key).distinct(), key, "left_anti").unionByName(incoming)


def sidecar(records: DataFrame, scraped: DataFrame, key: str, plain: list[str], clears: dict[str, list[str]]) -> DataFrame:
    """Records with the meaningful values of a sidecar (not null, blank, "-" or "null"), and whether they changed.

    A changed value empties the columns that were worked out from it (clears: column to those). Of repeated keys in
    the sidecar the greatest row counts; keys that no record has are left out.
    """
    fields = [*plain, *clears]
    rest = [c for c in scraped.columns if c != key]
    once = scraped.groupBy(key).agg(F.max(F.struct(*rest)).alias("s"))
    met = records.join(once, key, "left")
    meant = {c: F.when(~F.lower(F.trim(F.col(f"s.{c}"))).isin("", "-", "null"), F.col(f"s.{c}")) for c in fields}
    differs = {c: F.coalesce(~meant[c].eqNullSafe(F.col(c)) & meant[c].isNotNull(), F.lit(False)) for c in fields}
    emptied = {d: differs[c] for c, ds in clears.items() for d in ds}

    def column(c: str) -> Column:
        if c in fields:
            return F.coalesce(meant[c], F.col(c)).alias(c)
        return F.when(~emptied[c], F.col(c)).alias(c) if c in emptied else F.col(c)

    changed = F.lit(False)
    for d in differs.values():
        changed = changed | d
    return met.select(*[column(c) for c in records.columns], changed.alias("changed"))


def reconcile(first: DataFrame, second: DataFrame, key: str, second_only: list[str]) -> DataFrame:
    """Full outer merge of two deliveries of the same records: `first` wins scalars, `second` alone gives second_only."""
    scalars = [c for c in first.columns if c != key]
    a = first.select(key, F.struct(*scalars).alias("a"))
    b = second.select(key, F.struct(*[c for c in second.columns if c != key]).alias("b"))
    origin = F.when(F.col("a").isNull(), "PDF").when(F.col("b").isNull(), "CD").otherwise("BOTH")
    return a.join(b, key, "full").select(
        key,
        *[(F.coalesce(f"a.{c}", f"b.{c}") if c in second.columns else F.col(f"a.{c}")).alias(c) for c in scalars],
        *[F.col(f"b.{c}").alias(c) for c in second_only],
        origin.alias("source_format"),
    )


def _filled(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def repair_status(current: Column, app_evidence: Column, gazette_no: Column, registration_no: Column, bulletin_no: Column) -> Column:
    """Explicit evidence beyond an application; else registration where gazetted; else publication where in a bulletin."""
    told = _filled(app_evidence) & (app_evidence != ST.APPLIED)
    return F.when(told, app_evidence).when(_filled(gazette_no) | _filled(registration_no), ST.REGISTERED).when(_filled(bulletin_no), ST.PUBLISHED).otherwise(current)


def repair_candidates(records: DataFrame) -> DataFrame:
    """Records that still count as applied for although a bulletin, a gazette or a registration is known."""
    known = _filled(F.col("bulletin_no")) | _filled(F.col("gazette_no")) | _filled(F.col("registration_no")) | F.col("registration_date").isNotNull()
    return records.where((F.col("status") == ST.APPLIED) & known)


def repair_classes(records: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Records of exactly six classes with the best longer list: a gazette's before a bulletin's, then the longest, then the last."""
    best = evidence.where(F.size("classes") > 6).groupBy(key).agg(
        F.max_by("classes", F.struct((F.col("source") == "GZ").alias("gazette"), F.size("classes").alias("n"), "folder")).alias("found")
    )
    found = records.where(F.size("classes") == 6).join(best, key)
    return found.select(*[F.col("found").alias("classes") if c == "classes" else F.col(c) for c in records.columns])


def reconcile_designs(first: DataFrame, second: DataFrame, key: str, second_only: list[str]) -> DataFrame:
    """As reconcile(), with a column views (array of struct no, path): united by number, those of `first` before those of `second`."""
    a = first.select(key, F.struct(*[c for c in first.columns if c != key]).alias("a"))
    b = second.select(key, F.struct(*[c for c in second.columns if c != key]).alias("b"))
    none = F.array().cast(first.schema["views"].dataType)
    mine, theirs = F.coalesce("a.views", none), F.coalesce("b.views", none)
    numbers = F.transform(mine, lambda v: v["no"])
    united = F.array_sort(F.concat(mine, F.filter(theirs, lambda v: ~F.array_contains(numbers, v["no"]))))
    scalars = [c for c in first.columns if c not in (key, "views")]
    origin = F.when(F.col("a").isNull(), "PDF").when(F.col("b").isNull(), "CD").otherwise("BOTH")
    return a.join(b, key, "full").select(
        key, *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in scalars], united.alias("views"), *[F.col(f"b.{c}").alias(c) for c in second_only], origin.alias("source_format")
    )


def merge_into_gazette(gazette: DataFrame, disc: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """Records in the gazette's shape: non-empty values of the disc win, but for `kept`; what the disc alone has is appended."""
    rest = [c for c in gazette.columns if c != key]
    g = gazette.select(key, F.struct(*rest).alias("g"))
    d = disc.select(key, F.struct(*[c for c in rest if c in disc.columns]).alias("d"))
    filled = lambda c: F.nullif(F.trim(F.col(f"d.{c}")), F.lit("")) if disc.schema[c].dataType.typeName() == "string" else F.col(f"d.{c}")
    value = lambda c: F.col(f"g.{c}") if c not in disc.columns else F.coalesce(f"g.{c}", filled(c)) if c in kept else F.coalesce(filled(c), f"g.{c}")
    return g.join(d, key, "full").select(key, *[value(c).alias(c) for c in rest], F.col("g").isNull().alias("appended"))


def same_bulletin(a: Column, b: Column) -> Column:
    """The number of the bulletin that two deliveries of a record are of; two that differ fail the job.

    Records of different bulletins would be united without a sign, so the check is a part of the plan.
    """
    x, y = D.bulletin_number(a), D.bulletin_number(b)
    clash = F.raise_error(F.concat(F.lit("bulletin numbers differ: "), a, F.lit(" and "), b)).cast("string")
    return F.when(x.isNotNull() & y.isNotNull() & (x != y), clash).otherwise(F.coalesce(x, y))


def continue_gazette(gazette: DataFrame, disc: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """As merge_into_gazette(), with record_index, attorney (struct of name, firm) and bulletin_no.

    What the disc alone has is numbered on, by key, from the greatest record_index of the gazette. An attorney's name
    is the disc's where it has one, the firm always the gazette's. Bulletins must agree, as same_bulletin() demands.
    """
    rest = [c for c in gazette.columns if c not in ("record_index", "attorney", "bulletin_no")]
    merged = merge_into_gazette(gazette.select(rest), disc.select([c for c in rest if c in disc.columns]), key, kept)
    told = lambda c: F.nullif(F.trim(c), F.lit(""))
    g = gazette.select(key, "record_index", F.col("attorney").alias("ga"), F.col("bulletin_no").alias("gb"))
    d = disc.select(key, F.col("attorney").alias("da"), F.col("bulletin_no").alias("db"))
    attorney = F.struct(F.coalesce(told(F.col("da.name")), F.col("ga.name")).alias("name"), F.col("ga.firm").alias("firm"))
    both = merged.join(g, key, "left").join(d, key, "left").withColumns({"attorney": attorney, "bulletin_no": same_bulletin(F.col("gb"), F.col("db"))}).drop("ga", "da", "gb", "db")
    last = F.broadcast(gazette.agg(F.coalesce(F.max("record_index"), F.lit(0)).alias("__last")))  # one row
    fresh = both.where("appended").crossJoin(last)
    numbered = rows.numbered(fresh, [F.col(key).asc()], 1, "__n").withColumn("record_index", F.col("__last") + F.col("__n")).drop("__last", "__n")
    return both.where("not appended").unionByName(numbered)
