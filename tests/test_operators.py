import datetime as dt
import itertools
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import corpus, feeds, lifecycle, merge, nearest, retrieval, rows, scan, search

DAY = dt.date(2024, 1, 1)


def patent(spark, events, record_type="PUBLISHED_APP"):
    data = [("p", t, None, DAY + dt.timedelta(d) if d is not None else None) for t, d in events]
    e = spark.createDataFrame(data, "application_no string, event_type string, event_date date, bulletin_date date")
    return lifecycle.patent_status(e, spark.createDataFrame([("p", record_type)], "application_no string, record_type string")).first()


def test_patent_machine(spark):
    assert patent(spark, [], "OTHER").status == "UNKNOWN"
    assert patent(spark, [("GRANT_ANNOUNCED", 3)]).status == "ACTIVE"
    assert patent(spark, [("APPLICATION_REJECTED", 1), ("GRANT_ANNOUNCED", 2)]).status == "REJECTED"
    assert patent(spark, [("GRANT_FEE_REVALIDATION", 5), ("GRANT_FEE_LAPSE", 5), ("GRANT_ANNOUNCED", 1)]).status == "ACTIVE"
    r = patent(spark, [("APPLICATION_WITHDRAWN", 1), ("PROCEDURAL_REVALIDATION", 4), ("SOMETHING", 9)])
    assert (r.status, r.last_event_type, r.last_event_date) == ("PENDING", "PROCEDURAL_REVALIDATION", DAY + dt.timedelta(4))
    assert patent(spark, [("APPLICATION_FEE_LAPSE", None)]).last_event_date is None


def test_design_machine(spark):
    e = spark.createDataFrame(
        [("d", "partial_cancellation_owner", None, DAY, [2]), ("d", "renewal", None, DAY, None)], "application_no string, event_type string, event_date date, bulletin_date date, design_indices array<int>"
    )
    d = spark.createDataFrame([("d", 1, "hague", dt.date(2020, 1, 1)), ("d", 2, "hague", dt.date(2020, 1, 1)), ("x", None, "deferred", dt.date(1990, 1, 1))], "application_no string, design_index int, section string, application_date date")
    got = {(r.application_no, r.design_index): r.status for r in lifecycle.design_status(e, d, F.lit("2024-06-01").cast("date")).collect()}
    assert got == {("d", 1): "Yenilendi", ("d", 2): "İptal Edildi", ("x", None): "Süresi Doldu"}


def test_trademark_fold_equals_stepwise(spark):
    rng = random.Random(4)
    kinds = ["seizure", "injunction", "restriction_lift", "seizure_lift", "transfer", "renewal", "cancellation", "other"]
    data = [(f"a{rng.randrange(5)}", rng.choice(kinds), rng.choice([None, "court order"]), f"Holder {i} (7)" if i % 3 else "(7)", DAY + dt.timedelta(rng.randrange(9)) if i % 11 else None, i) for i in range(200)]
    e = spark.createDataFrame(data, "application_no string, event_type string, event_subtype string, new_value string, bulletin_date date, id int").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    got = {r.application_no: r for r in lifecycle.trademark_fold(e).collect()}
    to = {"transfer": "Devredildi", "renewal": "Yenilendi", "cancellation": "İptal Edildi"}
    for key in got:
        active, status, holder = 0, None, None
        for _, kind, _, value, _, _ in sorted((x for x in data if x[0] == key), key=lambda x: (x[4] is not None, x[4] or DAY, x[5])):
            active = max(0, active + {"seizure": 1, "injunction": 1, "restriction_lift": -1, "seizure_lift": -1}.get(kind, 0))
            status = to.get(kind, status)
            if kind == "transfer" and value.split("(")[0].strip():
                holder = value.split("(")[0].strip()
        assert (got[key].active_restriction_count, got[key].effective_status, got[key].current_holder_name) == (active, status, holder)


def test_merges(spark):
    schema = "application_no string, source string, status string, name string, bulletin_no string, registration_no string, classes array<int>"
    old = spark.createDataFrame([("1", "APP", "Tescil Edildi", None, None, "R1", list(range(1, 9))), ("2", "BLT", "Yayında", "old", "B1", None, [1])], schema)
    new = spark.createDataFrame([("1", "BLT", "Yayında", "n", "B9", "R9", [1, 2, 3, 4, 5, 6]), ("2", "GZ", "Tescil Edildi", None, "B2", "R2", [1, 2]), ("3", "BLT", "Yayında", "x", None, None, None)], schema)
    got = {r.application_no: r for r in merge.priority_merge(old, new).collect()}
    assert (got["1"].source, got["1"].status, got["1"].name, got["1"].bulletin_no, got["1"].registration_no, len(got["1"].classes)) == ("APP", "Tescil Edildi", "n", "B9", "R1", 8)
    assert (got["2"].source, got["2"].status, got["2"].name, got["2"].bulletin_no, got["2"].registration_no) == ("GZ", "Tescil Edildi", "old", "B1", "R2")
    assert got["3"].status == "Yayında"
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(merge.overwrite(t, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert merge.prune_scopes(t, spark.createDataFrame([(1,)], "k int"), ["k"]).collect() == [(1, "a")]
    lit = lambda s: F.lit(s).cast("string")
    decided = spark.range(1).select(merge.repair_status(lit("Başvuruldu"), lit(None), lit(None), lit(" "), lit("2024/1")), merge.repair_status(lit("x"), lit("Reddedildi"), lit("1"), lit(None), lit(None)))
    assert tuple(decided.first()) == ("Yayında", "Reddedildi")


def test_fuzzy_join_is_exact(spark):
    rng = random.Random(1)
    names = [" ".join(rng.choice(["kuzey", "kuzay", "star", "stars", "delta", "deltha", "mavi"]) for _ in range(rng.randint(1, 3))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")

    def grams(n):
        return {("  " + w + " ")[i : i + 3] for w in n.split() for i in range(len(w) + 1)}

    for least in (0.3, 0.5, 0.8):
        got = {(r.a, r.b) for r in retrieval.fuzzy_join(df.withColumnRenamed("id", "a"), df.withColumnRenamed("id", "b"), "a", "b", "name", least).collect()}
        assert got == {(i, j) for i, x in enumerate(names) for j, y in enumerate(names) if round(len(grams(x) & grams(y)) / len(grams(x) | grams(y)), 6) >= least}


def test_stages_share_the_pool(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(["Star", "S-tar", "star light", "stars", "moon", "star"])], "id int, name string")
    got = {r.id: (r.stage, r.stages) for r in retrieval.staged(df, "star").collect()}
    assert got[0][0] == got[5][0] == "exact" and got[1][0] == "compact" and 4 not in got
    assert [r.id for r in retrieval.staged(df, "star", limit=2).collect()] == [0, 5]


def test_scan_and_rows(spark):
    schema = "name string, classes array<int>, holder string"
    w = spark.createDataFrame([(1, "blue star", [9], "H1"), (2, "blue star", [1], "H2")], "watch_id int, " + schema)
    m = spark.createDataFrame([(10, "blue stars", [99], "H3"), (11, "blue star", [9], " H1"), (12, "red", [9], "H4")], "mark_id int, " + schema)
    assert {(r.watch_id, r.mark_id) for r in scan.conflicts(w, m).collect()} == {(1, 10), (2, 10)}
    a = spark.createDataFrame([(1, 5), (2, 6)], "x int, y int")
    b = spark.createDataFrame([(1,), (5,)], "z int")
    assert rows.match_any_key(a, b, "x", [("x", "z"), ("y", "z")]).count() == 2
    assert rows.first_child(a, spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "x int, seq int, v string"), "x", "v", "seq").where("x = 1").first().v == "a"
    assert feeds.totals({"a": a, "b": b}).first().asDict() == {"a": 2, "b": 2}


def test_dispersion(spark):
    docs = spark.createDataFrame([(1, "kuzey su", "h1"), (2, "su", "h2"), (3, "kuzey kuzey su", "h1"), (4, " ", "h3")], "id int, name string, holder string")
    got = {r.word: r for r in corpus.dispersion(docs, "name", "holder", 2).collect()}
    assert (got["su"].doc_freq, got["su"].first_count, got["su"].last_count, got["su"].single_count, got["su"].unique_group_count) == (3, 1, 3, 1, 2)
    assert (got["kuzey"].doc_freq, got["kuzey"].first_count) == (2, 2)
    assert {r.word: r.unique_partner_count for r in corpus.partner_counts(docs, "name").collect()} == {"kuzey": 1, "su": 1}


def test_search_helpers(spark):
    assert search.application_id(" 2017/15048 B1 ") == "2017/15048" and search.application_id("2017/15048x") is None and search.application_id("name") is None
    phrases = spark.createDataFrame([("Red kararı", "R"), ("Red kararı iptali", "C")], "phrase string, event_type string")
    said = spark.createDataFrame([("RED  kararı",), ("Red kararı iptali hk.",), ("red",), ("",), (None,), ("x",)], "said string")
    assert {r.said: r.event_type for r in search.phrase_types(said, phrases, "said").collect()} == {"RED  kararı": "R", "Red kararı iptali hk.": "C", "red": "C", "": "UNKNOWN", None: "UNKNOWN", "x": "UNKNOWN"}


def test_repairs(spark):
    r = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6]), (2, [1]), (3, [1, 2, 3, 4, 5, 6])], "k int, classes array<int>")
    long = list(range(1, 9))
    e = spark.createDataFrame([(1, "BLT", list(range(1, 12)), "z"), (1, "GZ", long, "a"), (1, "GZ", long[::-1], "b"), (2, "GZ", long, "a"), (3, "GZ", long[:6], "a")], "k int, source string, classes array<int>, folder string")
    assert [tuple(x) for x in merge.repair_classes(r, e, "k").collect()] == [(1, long[::-1])]
    old = spark.createDataFrame([("1", "APP", "Başvuruldu", "n", [1])], "application_no string, source string, status string, name string, classes array<int>")
    new = spark.createDataFrame([("1", "BLT", "Yayında", None, [2], True)], old.schema.simpleString()[7:-1].replace(":", " ").replace("array<int>", "array<int>") + ", clear_name boolean")
    assert tuple(merge.priority_merge(old, new).first()) == ("1", "BLT", "Yayında", None, [1])


def test_prescreen_caps_and_pool(spark):
    rows = spark.createDataFrame([(i, "red widget" if i < 40 else f"red {i}") for i in range(200)], "id int, name string")
    got = retrieval.prescreen(rows, "Red Widget", ["widget", "red"]).collect()
    by_stage = {s: sum(s in r.stages for r in got) for s in retrieval.STAGES}
    assert by_stage["exact"] == 25 and by_stage["short-token"] == 120 and by_stage["any-token"] == 40 and by_stage["phonetic"] == 0
    assert max(r.stage_no for r in retrieval.prescreen(rows, "Red Widget", ["widget", "red"], limit=30).collect()) <= 1


def test_nearest_of_many_is_exact(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 8)) * 4
    vectors = np.concatenate([middles[i % 12] + rng.normal(size=8) * 0.3 for i in range(3000)]).reshape(-1, 8)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(4000 + i, vectors[5].tolist()) for i in range(30)] + [(5000, [0.0] * 8), (5001, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(6)
    asked = df.where("id % 50 = 0 or id = 5001").withColumnRenamed("id", "query_id")
    got = {}
    for r in nearest.nearest_many(df, asked, "id", "v", 5).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.id))
    ids, x = np.array([i for i, v in rows if v]), np.array([v for _, v in rows if v])
    size = np.linalg.norm(x, axis=1)
    for i, v in rows:
        if v and i % 50 == 0:
            q = np.array(v)
            s = np.divide(x @ q, size * np.linalg.norm(q), out=np.zeros(len(x)), where=(size > 0) & (np.linalg.norm(q) > 0))
            best = sorted((-round(float(a), 6), int(j)) for a, j in zip(s, ids) if j != i)[:5]
            assert sorted(got[i]) == [(pytest.approx(a), j) for a, j in best], i
    assert len(got) == sum(1 for i, v in rows if v and i % 50 == 0)
    assert nearest.nearest_many(df.where("id = 5001"), asked, "id", "v", 5).collect() == []


def test_bounds_spare_most_blocks(spark):
    """Of clustered rows only a small share is scored."""
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(40, 16))
    df = spark.createDataFrame([(i, (middles[i % 40] + rng.normal(size=16) * 0.05).tolist()) for i in range(4000)], "id long, v array<double>").repartition(2)
    sizes = []
    met = nearest._met

    def counted(pairs, blocks, queries, slots):
        sizes.append(pairs.join(blocks.select("block", F.size("keys").alias("n")), "block").agg(F.sum("n")).first()[0] or 0)
        return met(pairs, blocks, queries, slots)

    nearest._met = counted
    try:
        asked = df.where("id % 100 = 0").withColumnRenamed("id", "query_id")
        assert nearest.nearest_many(df, asked, "id", "v", 10).count() == 400
    finally:
        nearest._met = met
    assert sum(sizes) < 0.2 * 40 * 4000, sizes


def test_rows_are_numbered_without_gaps(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("n")).repartition(7)
    got = rows.numbered(df, [F.col("k").desc()], 10, "no").collect()
    assert {r.k: r.no for r in got} == {k: 10 + 4999 - k for k in range(5000)} and got[0].n == "x"
    assert rows.numbered(df.limit(0), [F.col("k").asc()]).collect() == []


def test_bulletins_that_differ_fail(spark):
    side = lambda no: spark.createDataFrame([(1, "t", ("a", "f"), no, 4)], "k int, title string, attorney struct<name: string, firm: string>, bulletin_no string, record_index int")
    merged = merge.continue_gazette(side("2025-08"), side("2025/8").drop("record_index"), "k", []).first()
    assert (merged.bulletin_no, merged.record_index) == ("2025/8", 4)
    with pytest.raises(Exception, match="bulletin numbers differ"):
        merge.continue_gazette(side("2025-08"), side("2025/9").drop("record_index"), "k", []).collect()


def test_class_overlaps_are_counted_without_pairs(spark):
    rng = random.Random(3)
    sets = [[1], [2, 3], [99], [3, 3, 4], [], None, [5, None], [99, 7], [46]]
    a = [(i, rng.choice(sets)) for i in range(60)] + [(1, [3]), (None, [1])]
    b = [(i, rng.choice(sets)) for i in range(60)] + [(2, [5]), (2, [4]), (None, [1])]
    full = lambda c: set(range(1, 46)) if 99 in (c or []) else {x for x in c or [] if x is not None}
    wanted = {}
    for i, c in a:
        wanted.setdefault(i, set()).update(j for j, d in b if full(c) & full(d))
    schema = "id int, classes array<int>"
    got = rows.class_overlap_counts(spark.createDataFrame(a, schema).withColumnRenamed("id", "x"), spark.createDataFrame(b, schema).withColumnRenamed("id", "y"), "x", "y").collect()
    assert {r.x: (r.n, r.first) for r in got} == {i: (len(js - {None}), min(js - {None})) for i, js in wanted.items() if js}
    # a class that all bear: forty thousand ids a side, which as pairs would be 1.6 thousand million
    many = spark.range(40_000).select("id", F.array(F.lit(7)).alias("classes"))
    found = rows.class_overlap_counts(many.withColumnRenamed("id", "x"), many.withColumnRenamed("id", "y"), "x", "y")
    assert found.agg(F.count("*"), F.min("n"), F.max("n"), F.max("first")).first() == (40_000, 40_000, 40_000, 0)


@pytest.mark.parametrize("own", [["h"], ["h", "p"]])
def test_first_others_lose_no_row_that_is_needed(spark, own):
    rng = random.Random(len(own))
    data = [(i, rng.choice("gg2"), rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["p", "p", "q", "r", None])) for i in range(400)]
    df = spark.createDataFrame(data, "id int, g string, h string, p string")
    kept = {r.id for r in rows.first_others(df, ["g"], own, [F.col("id")], 4).collect()}
    assert len(kept) < 200
    for g, h, p in itertools.product("g2", "abcx", "pqrx"):
        left = [i for i, x, y, z in data if x == g and y != h and ("p" not in own or z != p)]
        assert kept >= set(left[:4])


def test_conflicts_among_copies(spark):
    rng = random.Random(8)
    names, holders, sets = ["blue gear", "blue gears", "red gear", "odd", None], ["A", " A", "B", "C", "", None], [[1], [2, 3], [99], [3, 1]]
    draw = lambda n: [(i, rng.choice(names), rng.choice(sets), rng.choice(holders)) for i in range(n)]
    w, m = draw(50), draw(300)
    schema = "id int, name string, classes array<int>, holder string"
    got = scan.conflicts(spark.createDataFrame(w, schema).withColumnRenamed("id", "watch_id"), spark.createDataFrame(m, schema).withColumnRenamed("id", "mark_id"), 0.5, 6).collect()
    grams = lambda t: {f"  {x} "[i : i + 3] for x in t.split() for i in range(len(x) + 1)}
    full = lambda c: set(range(1, 46)) if 99 in c else set(c)
    for i, name, classes, holder in w:
        met = [
            (-round(len(grams(name) & grams(n)) / len(grams(name) | grams(n)), 6), j, sorted(full(classes) & full(c))) for j, n, c, h in m
            if name and n and full(classes) & full(c) and not ((holder or "").strip() and (holder or "").strip() == (h or "").strip())
        ]
        wanted = sorted(x for x in met if x[0] <= -0.5)[:6]
        assert sorted((-r.similarity, r.mark_id, r.overlap) for r in got if r.watch_id == i) == wanted, (i, name, holder)


def test_a_full_pool_shuts_stages_that_own_no_row(spark):
    df = spark.createDataFrame([(i, "the and") for i in range(3)], "id int, name string")
    got = retrieval.prescreen(df, "The and", ["the", "and"], limit=3).collect()
    assert [(r.id, r.stage, r.stages) for r in got] == [(i, "exact", ["exact"]) for i in range(3)]


def test_statistics_read_their_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(t):
        read.add(1)
        return t

    docs = spark.createDataFrame([(f"Blue İris {i % 7}x", f"h{i}", [i % 5]) for i in range(40)], "t string, holder string, classes array<int>")
    docs = docs.select(F.udf(seen, "string").asNondeterministic()("t").alias("t"), "holder", "classes")
    for statistics in (lambda: corpus.word_statistics(docs, "t"), lambda: corpus.lexical_statistics(docs, "t", "holder", "classes", least=2)):
        before = read.value
        assert {r.word: r.doc_freq for r in statistics().collect()} == {"blue": 40, "iris": 40} | {f"{k}x": 6 if k < 5 else 5 for k in range(7)}
        assert read.value - before == 40


def test_folding_keeps_the_turkish_rule(spark):
    every = spark.range(1, 0x3000).select(F.concat(F.lit("I"), F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE"), F.lit("İ")).alias("t"))
    told = F.trim(F.regexp_replace(F.translate(text.turkish_lower(F.col("t")), text.MARKED, text.BARE), "[^a-z0-9]+", " "))
    assert every.where(text.normalize(F.col("t")) != told).count() == 0
