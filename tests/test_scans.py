"""Scans of names: pairs that can't count are ruled out where they meet, and no pair that counts is lost."""

import itertools
import random

import pytest

from pyspark.sql import functions as F
from test_scoring import KNOWN, NAMES, STATS

from tessera.operators import lexicon, retrieval, scan, scoring


def test_similar_names_are_measured_where_they_meet(spark):
    """Pairs of names that share trigrams are not written before they are measured, nor once for each shared trigram."""
    df = spark.createDataFrame([(f"blue gear {i}",) for i in range(30)], "name string")
    near = retrieval.similar_names(df, df, "name", 0.3)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan[: plan.index("Join")]
    assert near.count() == 900


@pytest.mark.parametrize("least", [0.2, 0.3, 0.5, 1.0])
def test_similar_names_equal_all_pairs(spark, least):
    rng = random.Random(11)
    words = ["blue", "blues", "gear", "gearbox", "Şişe", "öl", "x", "😀😁", "kuzey", "kuzeyli"]
    draw = lambda n: sorted({" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(n)})
    a, b = draw(60), draw(80)
    names = lambda ns: spark.createDataFrame([(n,) for n in [*ns, None]], "name string")
    got = {(r.na, r.nb): r.similarity for r in retrieval.similar_names(names(a), names(b), "name", least).collect()}
    every = names(a).withColumnRenamed("name", "na").crossJoin(names(b).withColumnRenamed("name", "nb")).where("na is not null and nb is not null")
    wanted = {(r.na, r.nb): r.s for r in every.withColumn("s", F.round(retrieval.X.trigram_similarity(F.col("na"), F.col("nb")), 6)).where(F.col("s") >= least).collect()}
    assert got == wanted and wanted


@pytest.mark.parametrize("sounds", [False, True])
def test_no_score_is_lost_to_the_bound(spark, sounds):
    rng = random.Random(12)
    words = ["nike", "nikee", "blue", "house", "horse", "pearl", "group", "ocean", "yapim", "ab", "a", "kuzeymarket", "bluehouse", "elmalar", "redd", "red", "perla", "store", "filip", "philip"]
    mixed = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(80)]
    pairs = {*itertools.product([n for n in NAMES if n], repeat=2), *[(rng.choice(mixed), rng.choice(mixed)) for _ in range(1500)]}
    stats = spark.createDataFrame(KNOWN, STATS)
    df = spark.createDataFrame(sorted(pairs), "a string, b string")
    named = lexicon.names(df.select(F.col("a").alias("n")).union(df.select("b")), "n", stats, scoring.LEVEL_WEIGHTS)
    side = lambda n, p: named.select(F.col("name").alias(n), F.col("norm").alias(f"{p}n"), F.col("words").alias(p))
    held = scoring.score_pairs(df, "a", "b", stats, sounds).join(side("a", "q"), "a").join(side("b", "t"), "b").cache()
    for least in (0.46, 0.5, 0.57, 0.8):
        told = held.withColumn("may", scoring.may_reach(F.col("qn"), F.col("tn"), F.col("q"), F.col("t"), least, sounds))
        assert told.where((F.col("score") >= least) & ~F.col("may")).select("a", "b", "score").collect() == []
        assert told.where("not may").count() > 500


@pytest.mark.parametrize("least", [0.3, 0.5])
def test_conflicts_equal_all_pairs(spark, least):
    """Against scores of all pairs under the rules of candidates, of a list of few names in many rows; 0.3 is below what the bound may use."""
    rng = random.Random(13)
    names = [n for n in NAMES if n] + [None]
    row = lambda i: (i, rng.choice(names), rng.choice([[1], [2, 3], [99], [3, 1], [], None, [7, None]]), rng.choice(["A", " A", "B", "C", "", None]), f"n{rng.randint(0, 40)}")
    w, m = [row(i) for i in range(40)], [row(i) for i in range(160)]
    schema = "id int, name string, classes array<int>, holder string, application_no string"
    stats = spark.createDataFrame(KNOWN, STATS)
    watch, marks = spark.createDataFrame(w, schema), spark.createDataFrame(m, schema)
    got = scan.name_conflicts(watch.withColumnRenamed("id", "watch_id"), marks.withColumnRenamed("id", "mark_id"), stats, least, 5, sounds=False).collect()

    pairs = spark.createDataFrame([(a, b) for a in names if a for b in names if b], "na string, nb string")
    score = {(r.na, r.nb): r.score for r in scoring.score_pairs(pairs, "na", "nb", stats, sounds=False).collect()}
    near = {(r.na, r.nb) for r in pairs.where(retrieval.X.trigram_similarity(F.col("na"), F.col("nb")) >= 0.3).collect()}
    known = {r.name: (r.norm.replace(" ", ""), [x.t for x in r.words if x.role != "generic"]) for r in lexicon.names(pairs, "na", stats, scoring.LEVEL_WEIGHTS).collect()}

    def met(a, b):
        (x, xs), (y, ys) = known[a], known[b]
        return (a, b) in near or (x == y != "") or any(v == u or (v.startswith(u) and len(v) - len(u) >= 3) for u in xs for v in ys)

    full = lambda c: set(range(1, 46)) if c and 99 in c else {x for x in c or [] if x is not None}
    same = lambda x, y: bool((x or "").strip()) and (x or "").strip() == (y or "").strip()
    for i, name, classes, holder, no in w:
        found = sorted((-score[name, n], j) for j, n, c, h, o in m if name and n and met(name, n) and score[name, n] >= least and full(classes) & full(c) and not same(holder, h) and no != o)
        assert sorted((-r.score, r.mark_id) for r in got if r.watch_id == i) == found[:5], (i, name)
    assert len(got) > 30


def test_pairs_of_low_caps_are_left_out_and_no_others(spark):
    stats = spark.createDataFrame(KNOWN, STATS)
    df = spark.createDataFrame([(a, b) for a in NAMES for b in NAMES[::5]], "a string, b string")
    every = {(r.a, r.b): r.score for r in scoring.score_pairs(df, "a", "b", stats, sounds=False).collect()}
    some = {(r.a, r.b): r.score for r in scoring.score_pairs(df, "a", "b", stats, sounds=False, least=0.5).collect()}
    assert len(some) < len(every) / 2 and some.items() <= every.items()
    assert {p for p, s in every.items() if s >= 0.5} <= set(some)
