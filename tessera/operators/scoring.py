"""Lexical score of name pairs: words aligned by weight, containment, spelling, sound and copied cores, under caps.

A word's role in the corpus decides its weight; words that differ are compared once per distinct pair of words and
joined in. The alignment of two names is one built-in aggregate over the words of the first, and everything after it
is columns, so a pair of names is a row that never leaves the JVM but for its ratios and sounds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import phonetic as P
from tessera.functions import scores as S
from tessera.functions import text as X
from tessera.functions import visual as V
from tessera.operators import lexicon, retrieval
from tessera.operators.lineage import cut

# fixed values: scores of equal names, and caps by name
EXACT, COMPACT, NO_WORDS = 1.0, 0.96, 0.45
CAPS = {
    "generic_only": 0.18, "missing_anchor": 0.18, "contained_without_anchor": 0.18, "semi_only": 0.45, "no_distinctive": 0.55, "some_distinctive": 0.69,
    "no_common": 0.18, "some_common": 0.69, "short_inexact": 0.58, "short_anchor": 0.45, "no_first_anchor": 0.62, "no_anchor": 0.45,
}
#: Floor and ceiling of caps that rest on evidence.
ADDED = {
    "single_short_anchor": (0.80, 0.84), "single_anchor": (0.66, 0.78), "distinctive_extra": (0.80, 0.84), "single_weak_extra": (0.66, 0.78), "semi_extra": (0.80, 0.88),
    "changed_on_both_sides": (0.44, 0.58), "asymmetric": (0.58, 0.68), "changed_rest": (0.65, 0.78), "partial_core": (0.50, 0.78),
}
WEAK_ANCHOR = {True: (0.50, 0.65), False: (0.42, 0.58)}  # by whether the match is exact
ACRONYM, INEXACT = (0.68, 0.82), {("phonetic", True): (0.42, 0.58), ("phonetic", False): (0.54, 0.68), ("fuzzy", True): (0.46, 0.62), ("fuzzy", False): (0.56, 0.68)}  # by kind and fragment
#: Caps of a text score that gives way to the logo's, and of one that the logo lifts only so far.
WEAK = ["generic_only", "missing_anchor", "contained_without_anchor", "no_common", "no_distinctive", "no_first_anchor", "short_anchor", "no_anchor"]
LIMITED = ["changed_on_both_sides", "asymmetric", "single_weak_extra", "inexact_anchor", "weak_shared_anchor", "short_inexact", "acronym"]

#: Every cap that a score may bear.
NAMED_CAPS = [*CAPS, *ADDED, "weak_shared_anchor", "acronym", "inexact_anchor"]
#: A pool whose best score is below asks for fresh candidates.
LIVE = 0.75

_MATCH = "array<struct<x: string, y: string, kind: string, sim: double, fuzzy: double, xw: double, yw: double, xr: string, yr: string>>"


def anchor(role: Column) -> Column:
    return ~lexicon.generic(role)


def _short(w: Column) -> Column:
    return anchor(w["role"]) & (F.length(w["t"]) <= 2)


def align(q: Column, t: Column, sims: Column) -> Column:
    """Greedy alignment: each word of q in turn takes itself among the free words of t, else the most alike by sims.

    sims: (x, y, fuzzy, sim, kind) of the words that match at all; ties go to the greater (sim, weightier y). Returns
    struct<left, hits, shy>: free words of t, matches, and whether an anchor of one or two letters met another word.
    """
    start = F.struct(t.alias("left"), F.array().cast(_MATCH).alias("hits"), F.lit(False).alias("shy"))

    def step(s: Column, x: Column) -> Column:
        same = F.exists(s["left"], lambda y: y["t"] == x["t"])
        # the match in sims of each free word, if there is one
        found = F.transform(s["left"], lambda y: F.struct(F.get(F.filter(sims, lambda m: (m["x"] == x["t"]) & (m["y"] == y["t"])), F.lit(0)).alias("m"), y.alias("y")))
        best = F.array_max(F.transform(F.filter(found, lambda f: f["m"].isNotNull()), lambda f: F.struct(f["m"]["sim"].alias("sim"), f["y"].alias("y"), f["m"].alias("m"))))
        mine = F.array_max(F.transform(F.filter(s["left"], lambda y: y["t"] == x["t"]), lambda y: F.struct(F.lit(1.0).alias("sim"), y.alias("y"), F.struct(x["t"].alias("x"), y["t"].alias("y"), F.lit(1.0).alias("fuzzy"), F.lit(1.0).alias("sim"), F.lit("exact").alias("kind")).alias("m"))))
        hit = lambda b: F.struct(
            x["t"].alias("x"), b["y"]["t"].alias("y"), b["m"]["kind"].alias("kind"), b["m"]["sim"].alias("sim"), b["m"]["fuzzy"].alias("fuzzy"),
            (-x["less"]).alias("xw"), (-b["y"]["less"]).alias("yw"), x["role"].alias("xr"), b["y"]["role"].alias("yr"),
        )
        shy = s["shy"] | (~same & F.exists(s["left"], lambda y: _short(x) | _short(y)))
        took = lambda b: F.struct(F.filter(s["left"], lambda y: y["t"] != b["y"]["t"]).alias("left"), F.array_append(s["hits"], hit(b)).alias("hits"), shy.alias("shy"))
        none = F.struct(s["left"].alias("left"), s["hits"].alias("hits"), shy.alias("shy"))
        # the best is bound once, as the one element of an array
        return F.get(F.transform(F.array(F.when(same, mine).otherwise(best)), lambda b: F.when(b.isNotNull(), took(b)).otherwise(none)), F.lit(0))

    return F.aggregate(q, start, step)


def containment(qn: Column, tn: Column, q: Column, t: Column) -> Column:
    """Score of one normalised name within the other, by coverage and by words that are in the longer one only."""
    squeeze = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    qc, tc = squeeze(qn), squeeze(tn)
    holds = lambda big, small, big_c, small_c: F.contains(big, small) | ((F.length(small_c) >= 4) & F.contains(big_c, small_c))
    only = lambda a, b: F.size(F.array_except(F.transform(a, lambda x: x["t"]), F.transform(b, lambda x: x["t"])))
    grade = lambda part, whole, extra, floor, most: F.greatest(F.lit(floor), 0.84 + 0.12 * F.length(part) / F.length(whole) - F.least(F.lit(most), extra))
    return (
        F.when((qc == "") | (tc == ""), 0.0)
        .when(holds(tn, qn, tc, qc), grade(qc, tc, only(t, q) * 0.035, 0.65, 0.18))
        .when(holds(qn, tn, qc, tc), grade(tc, qc, only(q, t) * 0.02, 0.60, 0.10))
        .otherwise(0.0)
    )


def begins(a: Column, w: Column) -> Column:
    """Whether an anchor is another one or, three letters shorter, its beginning."""
    return (a["t"] == w["t"]) | (F.startswith(w["t"], a["t"]) & (F.length(w["t"]) - F.length(a["t"]) >= 3))


#: No score is greater where no anchor is met, where the first name has none or semi-generic ones alone, or either has no words.
UNMET = max(NO_WORDS, *[CAPS[c] for c in ("generic_only", "missing_anchor", "contained_without_anchor", "semi_only", "no_common", "no_anchor")])


def may_meet(words: Column) -> Column:
    """Whether a name of these words may score more than UNMET against any but its equals."""
    has = lambda *roles: F.exists(words, lambda w: w["role"].isin(*roles))
    return has("distinctive", "common_anchor") | (has("weak_anchor") & ~has("semi_generic"))


def may_reach(qn: Column, tn: Column, q: Column, t: Column, least: float, sounds: bool) -> Column:
    """Whether two names may score `least`, by their norms and words alone, without a ratio; no pair that does is missed.

    It rests on `least` being above UNMET: names equal but for blanks reach it. Else an anchor of the first, of those that the caps ask
    for, must stand in the second, be like one of its anchors by length and letters, or begin one where a name is within
    the other. Where but one anchor is shared, none is like another and both names have more, the cap of change on both
    sides is known but for their generic words, which count as matched.
    """
    squeeze = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    ratio = lexicon.LEAST_RATIO if sounds else lexicon.NEARLY
    qc, tc = squeeze(qn), squeeze(tn)
    within = F.contains(tc, qc) | F.contains(qc, tc)
    alike = lambda x, y: ~_short(x) & ~_short(y) & lexicon.may_match(x["t"], y["t"], ratio)
    like = lambda x, y: anchor(y["role"]) & ((x["t"] == y["t"]) | (within & begins(x, y)) | alike(x, y))
    telling = F.exists(q, lambda w: w["role"] == "distinctive")
    common = F.exists(q, lambda w: w["role"] == "common_anchor")
    # a name without distinctive words needs one of its common anchors, if it has any
    needed = lambda x: anchor(x["role"]) & (telling | ~common | (x["role"] == "common_anchor"))
    meets = may_meet(q) & F.exists(q, lambda x: needed(x) & F.exists(t, lambda y: like(x, y)))

    heavy = lambda ws: F.filter(ws, lambda w: anchor(w["role"]))
    total = lambda ws: _sum(ws, lambda w: -w["less"])
    own, other = heavy(q), heavy(t)
    shared = F.filter(own, lambda x: F.exists(other, lambda y: x["t"] == y["t"]))
    one = F.get(shared, F.lit(0))
    alone = (F.size(own) > 1) & (F.size(other) > 1) & (F.size(shared) == 1) & (one["role"] != "weak_anchor")
    near = F.exists(own, lambda x: F.exists(other, lambda y: (x["t"] != y["t"]) & alike(x, y)))
    weight, brand = -one["less"], lambda ws: _count(ws, lambda w: w["role"].isin("common_anchor", "distinctive") & (w["t"] != one["t"]))
    cover = weight / F.greatest(total(own), total(other))
    part = lambda ws, anchors: 1 - (total(anchors) - weight) / total(ws)  # noqa: E731  generic words count as matched
    added = F.least(F.lit(0.24), (F.size(own) + F.size(other) - 3) * 0.04) + F.least(F.lit(0.12), (brand(own) + brand(other)) * 0.02)
    most = S.bounded(*ADDED["changed_on_both_sides"], cover * 0.45 + F.least(part(q, own), part(t, other)) * 0.35 + 0.20 - added)
    return (qc == tc) | (meets & ~F.coalesce(alone & (most < least - 1e-4) & ~near, F.lit(False)))


def _matched(pairs: DataFrame, words: DataFrame, stats: DataFrame, sounds: bool) -> DataFrame:
    """Distinct pairs (a, b) with both names' words and their alignment m."""
    side = lambda n, p: words.select(F.col("name").alias(n), *[F.col(c).alias(f"{p}{c}") for c in ("norm", "words", "ordered", "split", "raw")])
    held = cut(pairs.join(side("a", "q_"), "a").join(side("b", "t_"), "b"))
    two = held.select("a", "b", F.explode("q_words").alias("x"), F.col("t_words")).select("a", "b", "x", F.explode("t_words").alias("y"))
    x, y = F.col("x"), F.col("y")
    fit = (x["t"] != y["t"]) & (lexicon.generic(x["role"]) == lexicon.generic(y["role"])) & ~_short(x) & ~_short(y) & lexicon.may_match(x["t"], y["t"])
    two = two.where(fit).select("a", "b", F.col("x.t").alias("x"), F.col("y.t").alias("y"))
    near = lexicon.alike(cut(two.select("x", "y").distinct()), stats, sounds)
    sims = two.join(near, ["x", "y"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("x", "y", "fuzzy", "sim", "kind"))).alias("sims"))
    none = F.array().cast("array<struct<x: string, y: string, fuzzy: double, sim: double, kind: string>>")
    return held.join(sims, ["a", "b"], "left").withColumn("m", align(F.col("q_words"), F.col("t_words"), F.coalesce("sims", none))).drop("sims")


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + value(x))


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0.0)), F.lit(0.0))


def evidence(held: DataFrame) -> DataFrame:
    """Rows of _matched() with what the caps rest on.

    recall, precision: weighed share of the words of either name that are matched; q_cov, t_cov: of its anchors. q_extra,
    t_extra: words that are not. n_anchors: matches with an anchor on either side, met the first; quality their mean.
    """
    hits, q, t = F.col("m.hits"), F.col("q_words"), F.col("t_words")
    heavy = lambda ws: F.filter(ws, lambda w: anchor(w["role"]))
    total = lambda ws: _sum(ws, lambda w: -w["less"])
    anchored = F.filter(hits, lambda h: anchor(h["xr"]) | anchor(h["yr"]))
    rest = lambda ws, f: F.filter(ws, lambda w: ~F.exists(hits, lambda h: h[f] == w["t"]))
    exact = F.filter(hits, lambda h: h["kind"] == "exact")
    first = held.withColumns({
        "hits": hits, "q_anchors": heavy(q), "t_anchors": heavy(t), "q_extra": rest(q, "x"), "t_extra": rest(t, "y"), "exact": exact, "anchored": anchored,
        "recall": _share(_sum(hits, lambda h: h["xw"] * h["sim"]), total(q)), "precision": _share(_sum(hits, lambda h: h["yw"] * h["sim"]), total(t)),
        "good": _share(_sum(hits, lambda h: h["xw"] * h["sim"]), _sum(hits, lambda h: h["xw"])),
    })
    # generic as an anchor, overridden words count as matter that is added
    matter = lambda ws: _count(ws, lambda w: w["role"] != "generic")
    strict = lambda ws: _count(ws, lambda w: anchor(w["role"]))
    both = lambda test: _count(F.col("q_extra"), test) + _count(F.col("t_extra"), test)
    head = F.get(F.filter("t_ordered", lambda o: F.exists(t, lambda w: w["t"] == o)), F.lit(0))
    full_q, full_t = (F.size("q_words") > 0) & (F.size("exact") == F.size("q_words")), (F.size("t_words") > 0) & (F.size("exact") == F.size("t_words"))
    second = first.withColumns({
        "q_cov": _share(_sum(F.filter("hits", lambda h: anchor(h["xr"])), lambda h: h["xw"] * h["sim"]), total(F.col("q_anchors"))),
        "t_cov": _share(_sum(F.filter("hits", lambda h: anchor(h["yr"])), lambda h: h["yw"] * h["sim"]), total(F.col("t_anchors"))),
        "n_anchors": F.size("anchored"), "met": F.get("anchored", F.lit(0)),
        "quality": _share(_sum(F.col("anchored"), lambda h: h["sim"]), F.size("anchored").cast("double")),
        "q_matter": matter(F.col("q_extra")), "t_matter": matter(F.col("t_extra")), "q_strict": strict(F.col("q_extra")), "t_strict": strict(F.col("t_extra")),
        "extras": F.size("q_extra") + F.size("t_extra"), "brandlike": both(lambda w: w["role"].isin("common_anchor", "distinctive", "overridden")),
        "weak_extras": both(lambda w: w["role"] == "weak_anchor"), "semi_extras": both(lambda w: w["role"] == "semi_generic"),
        "generic_extras": both(lambda w: lexicon.generic(w["role"])),
        "leads": F.coalesce(F.exists("t_extra", lambda w: (w["t"] == head) & (w["role"] != "generic")), F.lit(False)),
        "full_q": full_q, "full_t": full_t,
        "exact_anchors": F.filter("exact", lambda h: anchor(h["xr"])),
    })
    return second.withColumns({
        "one_each": (_count(F.col("hits"), lambda h: anchor(h["xr"])) == 1) & (_count(F.col("hits"), lambda h: anchor(h["yr"])) == 1),
        "copied": F.when(F.col("full_q"), F.size("q_words")).when(F.col("full_t"), F.size("t_words")).otherwise(0),
    })


def _calibrated(name: str, balanced: bool = False, brandlike: str = "brandlike") -> Column:
    """A cap between its floor and ceiling by how much of both names is matched, less what is added."""
    c = F.col
    both = (lambda a, b: F.least(a, b)) if balanced else (lambda a, b: a * 0.65 + b * 0.35)
    added = F.least(F.lit(0.24), F.greatest(F.lit(0), c("q_matter") + c("t_matter") - 1) * 0.04) + F.least(F.lit(0.12), c(brandlike) * 0.02)
    return S.bounded(*ADDED[name], both(c("q_cov"), c("t_cov")) * 0.45 + both(c("recall"), c("precision")) * 0.35 + c("quality") * 0.20 - added)


def added_matter(held: DataFrame) -> DataFrame:
    """Rows of evidence() with core, the score of a copied core beside added matter, and core_cap, the cap's name if it is one.

    The first that applies: a name copied whole with words added, one shared anchor where both sides change, one shared
    anchor and matter added to one side, the query's anchors kept, or some of them. An exact anchor must be shared.
    """
    c = F.col
    many = (F.size("q_anchors") >= 2) | (F.size("t_anchors") >= 2)
    changed = c("one_each") & many & (c("q_strict") > 0) & (c("t_strict") > 0)
    generic_left = _count(c("q_extra"), lambda w: lexicon.generic(w["role"])) - (c("q_matter") - c("q_strict"))
    lopsided = (
        c("one_each") & (F.size("q_anchors") == 1) & ~changed & (generic_left + (c("q_matter") - c("q_strict")) > 0) & (c("q_strict") == 0) & (c("t_matter") > 0)
        & ((c("t_matter") >= 2) | c("leads") | (F.size("t_extra") >= 2))
    )
    short = c("full_q") & (F.size("q_words") == 1) & (F.size("exact_anchors") == 1) & (F.length(F.get("exact_anchors", F.lit(0))["x"]) <= 4)
    copied = (c("full_q") | c("full_t")) & (c("extras") > 0)
    one = c("copied") <= 1
    case = lambda name, value: F.struct(value.alias("score"), F.lit(name).alias("cap"))
    calibrated = lambda name, **k: case(name, _calibrated(name, **k))
    found = (
        F.when(copied & (c("brandlike") > 0) & one & short, calibrated("single_short_anchor"))
        .when(copied & (c("brandlike") > 0) & one, calibrated("single_anchor"))
        .when(copied & (c("brandlike") > 0), calibrated("distinctive_extra"))
        .when(copied & (c("weak_extras") > 0) & one, calibrated("single_weak_extra", brandlike="weak_extras"))
        .when(copied & (c("semi_extras") > 0), case("semi_extra", F.greatest(F.lit(0.80), 0.88 - F.least(F.lit(0.06), c("semi_extras") * 0.03))))
        .when(copied, case(None, F.greatest(F.lit(0.88), 0.96 - F.least(F.lit(0.08), c("generic_extras") * 0.02))))
        .when(changed, calibrated("changed_on_both_sides", balanced=True))
        .when(lopsided, calibrated("asymmetric", balanced=True))
        .when((c("extras") > 0) & (c("q_cov") >= 0.98), calibrated("changed_rest"))
        .when(c("extras") > 0, calibrated("partial_core"))
    )
    core = F.when((F.size("q_anchors") > 0) & (c("q_cov") > 0) & (F.size("exact_anchors") > 0), found)
    return held.withColumn("core", core).withColumns({"core": F.round(F.coalesce("core.score", F.lit(0.0)), 4), "core_cap": F.col("core.cap")})


def guards(held: DataFrame) -> DataFrame:
    """Rows of added_matter() with weak_shared, acronym and inexact (caps by evidence, null where they don't apply), short_inexact and headless."""
    c = F.col
    m, cov = c("met"), lambda n: F.round(c(n), 4)
    one = c("n_anchors") == 1
    exact = m["kind"] == "exact"
    # one shared anchor that hardly tells names apart
    stronger = F.exists("q_anchors", lambda w: w["role"] != "weak_anchor")
    weak = one & ((m["xr"] == "weak_anchor") | (m["yr"] == "weak_anchor")) & ((F.size("q_extra") > 0) | ~stronger)
    proof = (
        m["sim"] * 0.45 + F.least(cov("q_cov"), cov("t_cov")) * 0.25 + F.least(cov("recall"), cov("precision")) * 0.20 + F.when(exact, 0.10).otherwise(0.0)
        - F.least(F.lit(0.12), (c("q_matter") + c("t_matter")) * 0.04)
    )
    weak_cap = F.when(weak & exact, S.bounded(*WEAK_ANCHOR[True], proof)).when(weak, S.bounded(*WEAK_ANCHOR[False], proof))
    # one short word on one side, exactly met, of several on the other
    brief = F.filter("exact", lambda h: anchor(h["xr"]) & anchor(h["yr"]) & (F.length(h["x"]) <= 2))
    alone = lambda small, big, part, extra, matter: (F.size(small) == 1) & (F.size(big) >= 2) & (cov(part) < 0.98) & ((F.size(extra) > 0) | (c(matter) > 0))
    q_long = alone("t_words", "q_words", "recall", "q_extra", "q_matter")
    t_long = alone("q_words", "t_words", "precision", "t_extra", "t_matter")
    missing = F.when(q_long, F.greatest("q_matter", F.size("q_extra"))).otherwise(F.greatest("t_matter", F.size("t_extra")))
    copied = F.least(cov("recall"), cov("precision")) * 0.45 + cov("q_cov") * 0.20 + cov("t_cov") * 0.15 + 0.20 - F.least(F.lit(0.18), missing * 0.06)
    acronym = F.when((F.size(brief) == 1) & (q_long | t_long), S.bounded(*ACRONYM, copied))
    # one anchor that is met by spelling or sound alone
    inexact = one & m["kind"].isin("fuzzy", "phonetic")
    long, brief_length = F.greatest(F.length(m["x"]), F.length(m["y"])), F.least(F.length(m["x"]), F.length(m["y"]))
    edits = F.levenshtein(m["x"], m["y"])
    length_ratio, raw = brief_length / long, F.round(m["fuzzy"], 4)
    near_miss = (length_ratio >= 0.80) & (m["fuzzy"] >= 0.78) & (edits <= F.greatest(F.lit(1), F.ceil(long * 0.20)))
    fragment = length_ratio < 0.78
    # coverage by this match alone, which is the only one with an anchor
    kept = raw * 0.35 + F.round(length_ratio, 4) * 0.25 + F.round(1 - edits / long, 4) * 0.25 + F.least(c("q_cov"), c("t_cov")) * 0.15
    grades = [F.when((m["kind"] == kind) & (fragment == F.lit(part)), S.bounded(*bounds, kept)) for (kind, part), bounds in INEXACT.items()]
    quality = F.when((F.size("q_anchors") > 0) & inexact & ~near_miss, F.coalesce(*grades))
    first = F.get(F.filter("q_ordered", lambda o: F.exists("q_anchors", lambda w: w["t"] == o)), F.lit(0))
    return held.withColumns({
        "weak_shared": weak_cap, "acronym": acronym, "inexact": quality,
        "short_inexact": F.coalesce(inexact & (brief_length <= 4) & (c("extras") > 0), F.lit(False)),
        "headless": (F.size("q_anchors") >= 2) & F.exists("hits", lambda h: anchor(h["xr"])) & ~F.exists("hits", lambda h: h["x"] == first),
    })


#: What the score is made of, of all that guards() and the steps before it give.
_USED = [
    "a", "b", "q_norm", "t_norm", "q_words", "t_words", "q_raw", "t_raw", "q_split", "hits", "q_anchors", "t_anchors", "exact_anchors", "recall", "precision", "good",
    "core", "core_cap", "weak_shared", "acronym", "inexact", "short_inexact", "headless",
]


def _scored(pairs: DataFrame, stats: DataFrame, sounds: bool, overrides: DataFrame | None, least: float) -> DataFrame:
    """Distinct pairs (a, b) with r: struct of score, path and caps; without pairs whose caps are below `least`."""
    words = cut(lexicon.names(pairs.select(F.col("a").alias("n")).union(pairs.select("b")), "n", stats, LEVEL_WEIGHTS, overrides))
    held = cut(guards(added_matter(evidence(_matched(pairs, words, stats, sounds)))).select(*_USED, F.col("m.shy").alias("shy")))
    c = F.col
    squeeze = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    qn, tn, hits = c("q_norm"), c("t_norm"), c("hits")
    told = F.array_distinct(F.concat("q_raw", "t_raw"))
    held = held.withColumns({"qc": squeeze(qn), "tc": squeeze(tn)})
    part = containment(qn, tn, c("q_words"), c("t_words"))
    glued = c("q_split") & (F.size("exact_anchors") > 0) & (F.length("qc") >= 4) & F.contains(c("tc"), c("qc"))
    compound = F.when(glued, F.least(F.lit(0.96), 0.88 + 0.08 * F.length("qc") / F.length("tc"))).otherwise(0.0)
    held = held.withColumns({"inside": F.greatest(part, compound), "matched": _count(hits, lambda h: anchor(h["xr"]))})
    within = lambda ws: (c("inside") > 0) & F.exists(ws, lambda a: F.exists("t_anchors", lambda w: begins(a, w)))
    held = held.withColumns({"kept": within(c("q_anchors")), "kept_common": within(F.filter("q_anchors", lambda a: a["role"] == "common_anchor"))})
    held = held.withColumn("lexical", (c("matched") > 0) | c("kept"))
    have = lambda role: _count(c("q_words"), lambda w: w["role"] == role)
    got = lambda role: _count(hits, lambda h: h["xr"] == role)
    plain = F.exists(hits, lambda h: lexicon.generic(h["xr"]))
    cap = lambda name, value=None: F.struct(F.lit(name).alias("name"), (F.lit(CAPS[name]) if value is None else value).alias("value"))
    absent = (
        F.when(F.size("q_anchors") == 0, cap("generic_only"))
        .when((c("matched") == 0) & plain, cap("missing_anchor"))
        .when((c("matched") == 0) & (c("inside") > 0) & ~c("kept"), cap("contained_without_anchor"))
        .when((have("distinctive") == 0) & (have("common_anchor") == 0) & (have("semi_generic") > 0), cap("semi_only"))
        .when((have("distinctive") > 0) & (got("distinctive") == 0), cap("no_distinctive"))
        .when(got("distinctive") < have("distinctive"), cap("some_distinctive"))
        .when((have("common_anchor") > 0) & (got("common_anchor") == 0) & ~c("kept_common"), cap("no_common"))
        .when((got("common_anchor") < have("common_anchor")) & ~c("kept_common"), cap("some_common"))
    )
    caps = F.array_compact(F.array(
        absent,
        F.when(c("core_cap").isNotNull() & c("weak_shared").isNull(), F.struct(c("core_cap").alias("name"), F.when(c("core_cap") == "semi_extra", ADDED["semi_extra"][1]).otherwise(c("core")).alias("value"))),
        F.when(c("weak_shared").isNotNull(), cap("weak_shared_anchor", c("weak_shared"))),
        F.when(c("acronym").isNotNull(), cap("acronym", c("acronym"))),
        F.when(c("short_inexact"), cap("short_inexact")),
        F.when(c("inexact").isNotNull(), cap("inexact_anchor", c("inexact"))),
        F.when(c("shy") & (F.size("q_anchors") > 0) & (c("matched") == 0), cap("short_anchor")),
        F.when(c("headless"), cap("no_first_anchor")),
        F.when(~c("lexical"), cap("no_anchor")),
    ))
    held = held.withColumn("caps", caps)
    lowest = F.coalesce(F.array_min(F.transform("caps", lambda x: x["value"])), F.lit(1.0))
    empty = (F.size("q_words") == 0) | (F.size("t_words") == 0)
    if least > 0:  # no more is worked out where the caps are too low; names equal but for blanks have a score of their own
        held = held.where(empty | (c("qc") == c("tc")) | (lowest >= least - 1e-4))
    held = held.withColumns({
        "tri": X.trigram_similarity(c("a"), c("b")), "level": _multilevel("q_norm", "t_norm", F.transform(told, lambda x: x["t"]), F.transform(told, lambda x: x["w"])),
        "sound": P.sound_similarity(qn, tn) if sounds else F.lit(0.0),
    }).withColumn("letters", F.greatest("tri", "level"))
    recall, precision = c("recall"), c("precision")
    aligned = _share(2 * recall * precision, recall + precision) * (0.8 + 0.2 * c("good"))
    spelled = F.when(c("lexical"), F.least(F.lit(0.75), c("letters") * 0.80 + recall * 0.20)).otherwise(F.least(F.lit(0.45), c("letters") * 0.55))
    heard = F.when(c("sound") >= 0.82, F.when(c("lexical") | (c("letters") >= 0.55), F.least(F.lit(0.72), 0.42 + c("sound") * 0.30)).otherwise(F.least(F.lit(0.45), c("sound") * 0.40))).otherwise(0.0)
    limit = F.when(c("short_inexact"), CAPS["short_inexact"]).otherwise(1.0)
    # of equal components the first named
    parts = [(aligned, "alignment"), (c("inside"), "containment"), (spelled, "spelling"), (heard, "sound"), (c("core"), "core")]
    best = F.array_max(F.array(*[F.struct(F.least(v, limit).alias("score"), F.lit(-i).alias("no"), F.lit(p).alias("path")) for i, (v, p) in enumerate(parts)]))
    held = held.withColumn("best", best)
    nothing = F.array().cast("array<string>")
    fixed = lambda v, p, n=nothing: F.struct(F.round(v, 4).alias("score"), F.lit(p).alias("path"), n.alias("caps"))
    return held.select("a", "b", (
        F.when(empty & (c("qc") == c("tc")) & (F.length("qc") >= 2), fixed(F.lit(COMPACT), "compact"))
        .when(empty, fixed(F.least(F.lit(NO_WORDS), c("tri") * 0.50), "no words", F.array(F.lit("no_anchor"))))
        .when(qn == tn, fixed(F.lit(EXACT), "exact"))
        .when((F.length("qc") >= 4) & (c("qc") == c("tc")), fixed(F.lit(COMPACT), "compact"))
        .otherwise(F.struct(F.round(F.least(c("best.score"), lowest), 4).alias("score"), c("best.path").alias("path"), F.transform("caps", lambda x: x["name"]).alias("caps")))
    ).alias("r"))


def score_pairs(pairs: DataFrame, a: str, b: str, stats: DataFrame, sounds: bool = True, overrides: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """pairs with score (0 to 1), path and caps (names of those that apply), of the name in column a against that in b.

    Null names are empty. Equal normalised names score 1; equal compact ones of four letters 0.96; without words at
    most 0.45. Otherwise the greatest of alignment, containment, spelling, sound and copied core counts, under the caps
    of absent anchors, added matter, weak or inexact anchors. stats: word, word_class and, where known, idf and the
    profile of corpus.lexical_statistics(); overrides (word): words that count as generic. Without `sounds` neither
    words nor names match by sound. Distinct pairs of names are scored once and joined back. Pairs whose caps alone are
    below `least` are left out; others of a lower score are not.
    """
    named = pairs.withColumns({"__a": F.coalesce(F.col(f"`{a}`"), F.lit("")), "__b": F.coalesce(F.col(f"`{b}`"), F.lit(""))})
    found = _scored(cut(named.select(F.col("__a").alias("a"), F.col("__b").alias("b")).distinct()), cut(stats), sounds, overrides, least)
    scored = named.join(found.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("r").alias("__r")), ["__a", "__b"])
    return scored.select(*[F.col(f"`{c}`") for c in pairs.columns], F.col("__r.score").alias("score"), F.col("__r.path").alias("path"), F.col("__r.caps").alias("caps"))


def collapsed(own: Column, other: Column, name: Column, translated: Column, path: Column) -> Column:
    """The score of a translated name, capped where the translation is but the name itself, or a rest of it.

    own, other: scores of the name and of its translation; path: how the latter came about.
    """
    n, t = X.compact(name), X.compact(translated)
    words = F.split(X.normalize(translated), " ", -1)
    near = P.difference_ratio(n, t) >= 0.72
    exactish = path.isin("exact", "compact") | (other >= 0.90)
    short = (F.size(words) == 1) & (F.length(t) <= 3) & (F.length(n) > F.length(t)) & (path == "exact") & (F.contains(n, t) | ((F.length(n) <= 4) & near))
    rest = (F.length(t) >= 4) & ((F.contains(n, t) & (F.length(n) - F.length(t) >= 3)) | ((F.length(n) >= 4) & near))
    return (
        F.when((n == "") | (t == ""), other)
        .when(n == t, F.least(own, other))
        .when(exactish & short, F.least(other, F.greatest(own, F.lit(0.45))))
        .when(exactish & rest, F.least(other, F.greatest(own, F.lit(0.70))))
        .otherwise(other)
    )


def score_translated(pairs: DataFrame, a: str, b: str, translated: str, stats: DataFrame, translated_stats: DataFrame, sounds: bool = True) -> DataFrame:
    """pairs with score, path, caps and source: of b or, where that is strictly more alike, of its translation.

    A null or blank translation does not count. Each of the two scores uses the statistics of its own corpus of words.
    """
    kept = [F.col(f"`{c}`") for c in pairs.columns]
    own = score_pairs(pairs, a, b, stats, sounds).select(*kept, F.struct("score", "path", "caps", F.lit("original").alias("source")).alias("__own"))
    both = score_pairs(own, a, translated, translated_stats, sounds)
    there = F.trim(F.coalesce(F.col(f"`{translated}`"), F.lit(""))) != ""
    value = F.when(there, collapsed(F.col("__own.score"), F.col("score"), F.col(f"`{b}`"), F.col(f"`{translated}`"), F.col("path"))).otherwise(0.0)
    other = F.struct(F.round(value, 6).alias("score"), "path", "caps", F.lit("translated").alias("source"))
    chosen = both.withColumn("__r", F.when(value > F.col("__own.score"), other).otherwise(F.col("__own")))
    return chosen.select(*kept, "__r.score", "__r.path", "__r.caps", "__r.source")


def hybrid_risk(scored: DataFrame, a: str, b: str, clip: str = "clip", dino: str = "dino", ocr: str = "ocr", has_ocr: str = "has_ocr", plain_a: str = "plain_a", plain_b: str = "plain_b") -> DataFrame:
    """Rows of score_pairs() or score_translated() with visual (guarded similarity of the logos), total and risk_level.

    clip, dino and ocr are the logos' similarities by two models and by the text read from them, has_ocr whether both
    bear text; plain_a and plain_b tell a logo that is but a written name. Nulls are 0 or false.
    """
    c, d, o = F.col(clip), F.col(dino), F.col(ocr)
    raw = V.unit(S.visual_score(c, d, o, F.coalesce(F.col(has_ocr), F.lit(False))))
    agreement = F.greatest(F.col("score"), X.trigram_similarity(F.col(a), F.col(b)), V.unit(o))
    guarded = scored.withColumn("__raw", raw).withColumn("visual", F.round(V.plain_wordmark(F.col("__raw"), agreement, F.col(plain_a), F.col(plain_b)), 6))
    marked = lambda *names: F.arrays_overlap("caps", F.array(*[F.lit(n) for n in names]))
    short = marked("short_inexact")
    total = V.with_text(F.col("score"), F.col("visual"), c, d, o, marked(*WEAK), marked(*LIMITED), short, F.col("visual") < F.round("__raw", 6))
    return guarded.withColumn("total", total).withColumn("risk_level", S.risk_level(F.col("total"))).drop("__raw")


def brand_risk(rows: DataFrame, query: str, anchors: list[str], stats: DataFrame, key: str = "id", name: str = "name", k: int = 100, sounds: bool = True, **stages) -> DataFrame:
    """The k candidates of the highest score for a name: key, name, stage_no, score, path, risk_level and needs_live.

    Candidates come from retrieval.prescreen(), which takes `stages` besides; needs_live tells that the best of all of
    them scores below LIVE.
    """
    found = retrieval.prescreen(rows, query, anchors, key, name, **stages).select(key, "stage_no")
    pairs = rows.select(key, name).join(F.broadcast(found), key).withColumn("query", F.lit(query))  # found has at most 500 rows
    scored = cut(score_pairs(pairs, "query", name, stats, sounds))
    best = F.broadcast(scored.agg((F.max("score") < LIVE).alias("needs_live")))  # one row
    ranked = scored.select(key, name, "stage_no", "score", "path", S.risk_level(F.col("score")).alias("risk_level")).crossJoin(best)
    return ranked.orderBy(F.desc("score"), key).limit(k)


#: Weight of a word by its class in the multilevel similarity, and the least ratio of words that match.
LEVEL_WEIGHTS, LIKE = {"distinctive": 1.0, "semi_generic": 0.5, "generic": 0.1}, 0.75


def _levels(q: str, t: str, weights: dict[str, float]) -> float:
    """Of two normalised names: letters (0.25), weighed words (0.65) and build (0.10); at most 0.99 unless equal.

    Words that differ are matched greedily in alphabetical order, each with the most alike of those left.
    """
    if not q or not t:
        return 0.0
    if q == t:
        return 1.0
    own, other = set(q.split()), set(t.split())
    weight = lambda w: weights.get(w, 1.0)
    matched, lost, left = sum(map(weight, own & other)), 0.0, sorted(other - own)
    for w in sorted(own - other):
        best = max(((P.ratio(w, x), -i) for i, x in enumerate(left)), default=(0.0, 0))
        if best[0] >= LIKE:
            matched += weight(w) * best[0]
            left.pop(-best[1])
        else:
            lost += weight(w)
    whole = matched + 0.3 * lost + 0.2 * sum(map(weight, left))
    share = lambda a, b: min(a, b) / max(a, b)
    build = 0.25 * share(len(q), len(t)) + 0.25 * share(len(own), len(other)) + 0.50 * (q in t or t in q)
    return min(0.99, 0.25 * P.ratio(q, t) + 0.65 * (matched / whole if whole else 0.0) + 0.10 * build)


@F.pandas_udf(T.DoubleType())
def _multilevel(q: pd.Series, t: pd.Series, words: pd.Series, weights: pd.Series) -> pd.Series:
    return pd.Series([round(_levels(a, b, dict(zip(w, x, strict=True))), 6) for a, b, w, x in zip(q, t, words, weights, strict=True)], dtype="float64")


def multilevel(pairs: DataFrame, a: str, b: str, stats: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with their multilevel similarity; the weights of a pair's words come by a join on words."""
    classes = F.create_map(*[F.lit(x) for kv in LEVEL_WEIGHTS.items() for x in kv])
    named = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct().select("a", "b", X.normalize(F.col("a")).alias("q"), X.normalize(F.col("b")).alias("t"))
    words = named.select("a", "b", "q", "t", F.explode_outer(F.array_distinct(F.concat(F.split("q", " ", -1), F.split("t", " ", -1)))).alias("word"))
    known = words.join(stats.select("word", classes[F.col("word_class")].alias("w")), "word", "left")
    listed = known.groupBy("a", "b", "q", "t").agg(F.collect_list(F.struct("word", F.coalesce("w", F.lit(1.0)).alias("w"))).alias("x"))
    return listed.select(F.col("a").alias(a), F.col("b").alias(b), _multilevel("q", "t", "x.word", "x.w").alias("similarity"))
