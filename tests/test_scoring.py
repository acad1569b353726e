"""Scores of name pairs against the same rules stated in SQL, and what the registry's own examples demand."""

import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import corpus, lexicon, scoring
from tessera.plans import catalog, pair_sql, searches  # noqa: F401  searches adds to the catalog

STATS = "word string, word_class string, idf double, doc_freq bigint, first double, last double, single double, signals int, score double, descriptor_like boolean"
#: word, class and, for a few, the profile: a weak anchor, a common anchor, a descriptor, a word known by its stem only.
KNOWN = [
    ("group", "generic", 2.0, 900, 0.1, 0.6, 0.01, 3, 0.9, False), ("house", "semi_generic", 5.0, 90, 0.5, 0.1, 0.2, 0, 0.1, False), ("and", "generic", 2.0, 900, 0.0, 0.0, 0.0, 0, 0.0, False),
    ("pearl", "distinctive", 8.0, 60, 0.1, 0.5, 0.02, 3, 0.5, False), ("ocean", "generic", 7.0, 40, 0.5, 0.1, 0.2, 0, 0.1, False), ("yapim", "semi_generic", 5.0, 300, 0.1, 0.6, 0.01, 4, 0.9, True),
    ("elma", "generic", 3.0, 300, 0.3, 0.3, 0.3, 0, 0.1, False),
]
NAMES = [
    "Nike", "nike", "Ni ke", "Nikee", "Nike Group", "Group", "House", "Blue House", "Blue Horse", "Blue Horse Group", "blue and red", "Redd Bluee", "Reda Blue", "Pearl Nikes", "Pearle House", "", "!", "x", None,
    "Kuzey Yıldızı", "KUZEY YILDIZ", "house and group", "Nikemarket", "Nike market", "Bluehouse Pearl", "Blue Pearl", "Green Pearl", "Pearl", "AB", "AB Pearl", "AB Green", "A B", "Ocean", "Ocean Blue", "Oceanic", "Nikeyapim", "Nike yapim",
    "Elmalari", "elmalar nike", "Kuzeymarketgroup", "Kuzey market group", "Dogan Patent", "Dogan Marka Patent", "Bluestore", "Redstore", "Abstore", "Nike Pro Run", "Run Nike", "Nikeblue", "Blue Nike Group Ocean", "House Nike",
]


def by_sql(pairs):
    con = duckdb.connect()
    con.execute("CREATE TABLE pr (id INTEGER, a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO pr VALUES (?, ?, ?)", pairs)
    con.execute("CREATE TABLE st (word VARCHAR, cls VARCHAR, idf DOUBLE, doc_freq BIGINT, first DOUBLE, last DOUBLE, single DOUBLE, signals INTEGER, score DOUBLE, descr BOOLEAN)")
    con.executemany("INSERT INTO st VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?, ?)", KNOWN)
    return {r[0]: r[1:] for r in con.execute(f"WITH RECURSIVE {pair_sql.SCORED} SELECT id, score, path, caps FROM scored").fetchall()}


def test_scores_equal_sql(spark):
    rng = random.Random(5)
    words = ["nike", "nikee", "blue", "house", "horse", "pearl", "group", "ocean", "yapim", "ab", "a", "kuzeymarket", "bluehouse", "elmalar", "redd", "red", "perla", "store"]
    mixed = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    pairs = [*itertools.product(NAMES, NAMES), *[(rng.choice(mixed), rng.choice(mixed)) for _ in range(600)]]
    pairs = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    wanted = by_sql(pairs)
    df = spark.createDataFrame(pairs, "id int, a string, b string")
    got = scoring.score_pairs(df, "a", "b", spark.createDataFrame(KNOWN, STATS), sounds=False).collect()
    assert len(got) == len(pairs) == len(wanted)
    wrong = [(r.a, r.b, (r.score, r.path, r.caps), wanted[r.id]) for r in got if abs(r.score - wanted[r.id][0]) > 1.01e-4 or list(r.caps) != wanted[r.id][2]]
    assert not wrong, (len(wrong), wrong[:5])
    reached = {c for r in got for c in r.caps}
    assert reached >= set(scoring.CAPS) - {"some_common"} | {"single_short_anchor", "single_anchor", "distinctive_extra", "semi_extra", "changed_on_both_sides", "changed_rest", "partial_core", "weak_shared_anchor", "acronym", "inexact_anchor"}, reached


def scores(spark, *pairs, stats=KNOWN, **more):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a string, b string")
    return [r for r in scoring.score_pairs(df, "a", "b", spark.createDataFrame(stats, STATS), **more).orderBy("id").collect()]


def test_null_names_and_empty_tables(spark):
    stats = spark.createDataFrame([], "word string, word_class string")
    pairs = spark.createDataFrame([(None, "Nike"), ("Nike", None), (None, None)], "a string, b string")
    assert [r.score for r in scoring.score_pairs(pairs, "a", "b", stats).collect()] == [0.0, 0.0, 0.0]
    assert scoring.score_pairs(pairs.where("a = 'none'"), "a", "b", stats).count() == 0


def test_brand_risk_query(spark, sf):
    rows = catalog.QUERIES["q4_brand_risk"](spark, sf).collect()
    assert 0 < len(rows) <= 100 and rows == sorted(rows, key=lambda r: (-r.score, r.id))
    assert {r.needs_live for r in rows} == {rows[0].score < scoring.LIVE}


def test_what_examples_demand(spark):
    same, suffix, plain, moved, unlike, copied, missing, sounds = scores(
        spark, ("Doğan Patent", "DOGAN PATENT"), ("Nikemarket", "Nike market Run"), ("Group", "Blue Group"), ("Nike Group", "Blue Group"), ("Bluestore", "Redstore"), ("Nike", "Nike Group"), ("Ander House", "Green House"), ("Philip", "Filip")
    )
    assert (same.score, same.path) == (1.0, "exact")
    assert suffix.score >= 0.70 and suffix.path in ("containment", "core", "alignment")
    assert plain.score <= 0.18 and plain.caps[0] == "generic_only"
    assert moved.score <= 0.18 and "missing_anchor" in moved.caps
    # a shared generic ending says nothing: what is left differs
    assert unlike.score < 0.50
    assert copied.score >= 0.88
    assert missing.score <= 0.62
    assert sounds.score > scores(spark, ("Philip", "Filip"), sounds=False)[0].score


def test_overridden_words_count_as_generic_and_as_matter(spark):
    over = spark.createDataFrame([("zebra",), ("house",)], "word string")
    held = lexicon.roles(spark.createDataFrame([("zebra",), ("house",), ("houseleri",), ("nike",)], "word string"), spark.createDataFrame(KNOWN, STATS), over)
    assert {r.word: (r.role, r["class"]) for r in held.collect()} == {"zebra": ("generic", "distinctive"), "house": ("overridden", "semi_generic"), "houseleri": ("semi_generic", "semi_generic"), "nike": ("distinctive", "distinctive")}
    first, second = (scores(spark, ("Nike", "Nike House"), overrides=o)[0] for o in (over, over.where("word = 'zebra'")))
    assert first.caps == ["single_short_anchor"] and second.caps == ["semi_extra"]


def test_words_fall_into_parts(spark):
    words = spark.createDataFrame([(w,) for w in ("kuzeymarketgroup", "nikemarket", "market", "abmarket", "nikeyapim", "groupmarket", "x")], "word string")
    got = {r.word: [p.t for p in r.parts] for r in lexicon.segmented(words, spark.createDataFrame(KNOWN, STATS)).collect()}
    assert got == {"kuzeymarketgroup": ["kuzey", "market", "group"], "nikemarket": ["nike", "market"], "market": ["market"], "abmarket": ["abmarket"], "nikeyapim": ["nike", "yapim"], "groupmarket": ["groupmarket"], "x": ["x"]}


def test_no_match_is_lost_to_the_bound(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abceiklmnr") for _ in range(rng.randint(3, 9))) for _ in range(90)]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words if a < b], "x string, y string")
    near = pairs.withColumn("r", lexicon.P.difference_ratio("x", "y")).where(f"r >= {lexicon.LEAST_RATIO}")
    assert near.count() > 50 and near.where(~lexicon.may_match(F.col("x"), F.col("y"))).count() == 0


def test_statistics_with_profile(spark, sf):
    docs = spark.createDataFrame([(f"brand{i} yapim", f"h{i}", [i % 45 + 1]) for i in range(60)], "name string, holder string, classes array<int>")
    got = {r.word: r for r in corpus.lexical_statistics(docs, "name", "holder", "classes", least=10).collect()}
    assert got["yapim"].last == 1.0 and got["yapim"].signals >= 3 and got["brand7"].last is None and got["brand7"].word_class == "generic"


def test_translations_count_where_more_alike(spark):
    stats = spark.createDataFrame(KNOWN, STATS)
    told = [
        ("Blue Horse", "Mavi At", "blue horse"),  # a translation
        ("Blue Horse", "Blue Horse", "Blue Horse"),  # the name itself: nothing gained
        ("Bluehorse", "Bluehorses inn", "bluehorse"),  # a rest of the name: at most 0.70 or the name's own score
        ("Ox", "Oxa", "ox"),  # short, and near the name
        ("Blue Horse", "Mavi At", None),
        ("Blue Horse", "Mavi At", "  "),
        (None, "Mavi At", "mavi at"),
        ("Blue Horse", None, "blue horse"),
    ]
    pairs = spark.createDataFrame([(i, *t) for i, t in enumerate(told)], "id int, a string, b string, tr string")
    rows = {r.id: r for r in scoring.score_translated(pairs, "a", "b", "tr", stats, stats).collect()}
    own = {r.id: r.score for r in scoring.score_pairs(pairs, "a", "b", stats).collect()}
    assert len(rows) == len(told)
    assert (rows[0].score, rows[0].source, rows[0].path) == (1.0, "translated", "exact")
    assert (rows[1].score, rows[1].source) == (1.0, "original")
    assert rows[2].score == max(own[2], 0.70) or rows[2].source == "original"
    assert rows[3].score == max(own[3], 0.45) < 1
    assert all(rows[i].source == "original" and rows[i].score == own[i] for i in (4, 5, 6))
    assert (rows[7].score, rows[7].source) == (1.0, "translated")


def test_logos_and_names(spark):
    given = [
        # text, clip, dino, ocr, has_ocr, plain_a, plain_b, caps -> visual, total
        ((0.9, 0.9, 0.9, 0.0, False, False, False, []), 0.9, 0.98),  # two signals that agree
        ((0.2, 0.9, 0.9, 0.0, False, True, True, []), 0.35 + 0.1 * 0.2 / 0.78, 0.3756),  # written names that differ
        ((0.55, 0.5, 0.5, 0.0, False, False, False, ["no_distinctive"]), 0.5, 0.20 + 0.25 * 0.5 / 0.8),  # the logo alone, capped
        ((0.55, 0.95, 0.95, 0.0, False, False, False, ["no_distinctive"]), 0.95, 0.95),  # the logo alone, confirmed
        ((0.58, 0.6, 0.6, 0.0, False, False, False, ["short_inexact"]), 0.6, 0.58),  # short and inexact
        ((0.5, None, None, None, None, None, None, []), 0.0, 0.5),  # no logo
    ]
    rows = [(i, "alpha", "omega", *g[:1], "x", g[7], *g[1:7]) for i, (g, _, _) in enumerate(given)]
    df = spark.createDataFrame(rows, "id int, a string, b string, score double, path string, caps array<string>, clip double, dino double, ocr double, has_ocr boolean, plain_a boolean, plain_b boolean")
    got = {r.id: r for r in scoring.hybrid_risk(df, "a", "b").collect()}
    for i, (_, visual, total) in enumerate(given):
        assert (got[i].visual, got[i].total) == (pytest.approx(visual, abs=1e-4), pytest.approx(total, abs=1e-4)), i
    assert got[0].risk_level == "critical"
