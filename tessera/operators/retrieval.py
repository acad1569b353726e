"""Candidate retrieval in stages, and hybrid searches that merge signals.

A search returns the rows of one query name or vector, so every top-k is a per-partition top-k followed by one merge
of k rows; the corpus itself is filtered and scored in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scores as S
from tessera.functions import text as X

#: Most rows that a stage hands on, in the order of the stages.
CAPS = {"exact": 25, "compact": 80, "containment": 60, "token": 100, "trigram": 120}


def _top(df: DataFrame, key: str, score: Column, k: int) -> DataFrame:
    return df.select(F.col(key), F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def _capped(found: DataFrame, key: str, caps: dict[str, int], order: list[Column] | None = None) -> DataFrame:
    """Of every stage its first rows, by score and key if no order is given, as many as its cap."""
    rank = F.row_number().over(W.partitionBy("stage_no").orderBy(*(order or [F.desc("score")]), key))
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col("stage")]
    return found.withColumn("r", rank).where((F.col("r") <= max(caps.values())) & (F.col("r") <= cap)).drop("r")


#: Stages of the registry's own search, their caps and scores, in their order.
STAGES = {
    "exact": (25, 1.0), "compact": (80, 0.88), "containment": (60, 0.86), "short-all-token": (80, 0.82), "short-token": (120, 0.78), "all-token": (100, 0.85),
    "any-token": (80, 0.80), "fuzzy": (120, None), "visual": (50, None), "OCR": (20, 0.75), "phonetic": (100, 0.70),
}


def _with_similarity(df: DataFrame, text: str, query: Column) -> DataFrame:
    """df with `similar`, the trigram similarity of a column to the query, whose trigrams are made once and not per row."""
    own = F.broadcast(df.sparkSession.range(1).select(X.trigrams(query).alias("__q")))  # one row
    return df.crossJoin(own).withColumn("similar", X.set_similarity(X.trigrams(F.col(text)), F.col("__q"))).drop("__q")


def prescreen(rows: DataFrame, query: str, anchors: list[str], key: str = "id", name: str = "name", image: list[float] | None = None, vector: str | None = None, ocr: str | None = None, sounds: DataFrame | None = None, limit: int = 500) -> DataFrame:
    """Candidates (key, stage_no, stage, score, stages) for a name by the registry's eleven stages; the first owns a row.

    anchors are the query's telling words, at most eight, best first; those of two or three letters are sought as
    whole words, longer ones anywhere in the name. image and vector are a logo's embedding and the column to compare
    it with; ocr is the column of texts read from logos. sounds (norm, code) gives sound codes of normalised names
    and of the query; without it the last stage is left out. One scan serves all stages; within a stage shorter
    names come first, in fuzzy and visual stages the most similar ones. Stages that would begin with `limit` rows in
    the pool add nothing.
    """
    q = F.lit(query)
    fields = [F.col(key), F.col(name).alias("n"), X.normalize(F.col(name)).alias("norm"), F.length(F.coalesce(name, F.lit(""))).alias("size")]
    held = rows.select(*fields, *([F.col(vector).alias("v")] if vector else []), *([F.col(ocr).alias("o")] if ocr else []))
    qn, qc = X.normalize(q), X.compact(q)
    compact = F.replace("norm", F.lit(" "), F.lit(""))
    short, broad = [a for a in anchors[:8] if 2 <= len(a) <= 3], [a for a in anchors[:8] if len(a) > 3]
    padded = F.concat(F.lit(" "), F.col("norm"), F.lit(" "))
    word = [F.contains(padded, F.lit(f" {a} ")) for a in short]
    part = [F.contains("norm", F.lit(a)) | F.contains(compact, F.lit(a)) for a in broad]
    every, some = lambda tests: reduce(lambda x, y: x & y, tests), lambda tests: reduce(lambda x, y: x | y, tests)
    held, similar = _with_similarity(held, "norm", qn), F.col("similar")
    tests: dict[str, tuple[Column, Column]] = {
        "exact": (F.col("norm") == qn, F.lit(0)),
        "compact": ((qc != "") & F.contains(compact, qc), F.when(compact == qc, 0).otherwise(1)),
        "containment": ((F.length(qn) >= 4) & F.contains(qn, F.lit(" ")) & F.contains("norm", qn), F.lit(0)),
        "fuzzy": ((F.lower(F.coalesce("n", F.lit(""))) != F.lower(q)) & (similar >= 0.3), F.lit(0)),
    }
    if len(short) > 1:
        tests["short-all-token"] = (every(word), F.lit(0))
    if short:
        tests["short-token"] = (some(word), F.lit(0))
    if len(broad) > 1:
        tests["all-token"] = (every(part), F.lit(0))
    if broad:
        tests["any-token"] = (some(part), F.lit(0))
    measured = {"fuzzy": similar}
    if image and vector:
        measured["visual"] = S.cosine(F.col("v"), F.array(*[F.lit(float(x)) for x in image]))
        tests["visual"] = (F.col("v").isNotNull(), F.lit(0))
    if ocr:
        tests["OCR"] = ((F.length(qn) >= 2) & (F.coalesce("o", F.lit("")) != "") & F.contains(X.normalize(F.col("o")), qn), F.lit(0))
    if sounds is not None:
        mine = F.broadcast(sounds.where(F.col("norm") == qn).select(F.col("code").alias("qcode")).limit(1))  # one row
        held = held.join(sounds.select("norm", "code"), "norm", "left").crossJoin(mine)
        near = F.length("norm").between(F.greatest(F.lit(2), F.length(qn) - 2), F.length(qn) + 4)
        tests["phonetic"] = ((F.length(qn) >= 2) & near & (F.col("code") != "") & (F.col("code") == F.col("qcode")), F.levenshtein("norm", qn))
    spec = [(i, s, *tests[s]) for i, s in enumerate(STAGES) if s in tests]
    score = lambda s: F.round(measured[s], 6) if s in measured else F.lit(STAGES[s][1])
    first = lambda s, o: -score(s) if s in measured else o.cast("double")
    met = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(i).alias("no"), F.lit(s).alias("stage"), score(s).cast("double").alias("score"), first(s, o).alias("o"))) for i, s, t, o in spec]))
    flat = held.select(F.col(key), "size", F.explode(met).alias("m")).select(key, "size", F.col("m.no").alias("stage_no"), "m.stage", "m.score", "m.o")
    by_size = F.when(F.col("stage").isin(*measured), 0).otherwise(F.col("size"))
    found = _capped(flat, key, {s: STAGES[s][0] for _, s, *_ in spec}, [F.col("o"), by_size]).drop("size", "o")
    return _first_stage_owns(found, key, limit)


def staged(rows: DataFrame, query: str, key: str = "id", name: str = "name", limit: int = 500, caps: dict[str, int] | None = None) -> DataFrame:
    """Candidates (key, stage_no, stage, score, stages) for a name: the first stage to find a row owns it.

    Stages, each with its own cap: equal normalised names, equal compact names, one compact name within the other,
    a shared word, trigram similarity of at least 0.3 with a different name. `limit` is shared: stages that would
    begin with the pool full add neither rows nor provenance.
    """
    caps = caps or CAPS
    q = F.lit(query)
    # ids and names are a narrow table in few files, so they are dealt to all tasks before names are compared
    spread = rows.select(F.col(key), F.col(name).alias("n")).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = _with_similarity(spread.withColumn("norm", X.normalize(F.col("n"))), "n", q)
    qn, qc, similar = X.normalize(q), X.compact(q), F.col("similar")
    compact = F.replace("norm", F.lit(" "), F.lit(""))
    size = lambda c: F.length(c).cast("double")
    within = F.contains(compact, qc) | F.contains(qc, compact)
    ratio = F.least(size(compact), size(qc)) / F.greatest(size(compact), size(qc))
    words = X.token_set(q)
    shared = F.size(F.array_intersect(F.array_distinct(F.split("norm", " ", -1)), words))
    tests = [
        ("exact", F.col("norm") == qn, F.lit(1.0)),
        ("compact", compact == qc, F.lit(0.98)),
        ("containment", (compact != "") & within, ratio),
        ("token", shared > 0, shared / F.greatest(F.size(words), F.lit(1))),
        ("trigram", (similar >= 0.3) & (F.lower("n") != F.lower(q)), similar),
    ]
    # one scan: a row gives the stages that it meets, and each stage keeps its first rows before the shuffle
    stages = [(i, s, test, score) for i, (s, test, score) in enumerate(tests)]
    met = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(i).alias("no"), F.lit(s).alias("stage"), F.round(score.cast("double"), 6).alias("score"))) for i, s, test, score in stages]))
    found = _capped(held.select(F.col(key), F.explode(met).alias("m")).select(key, "m.score", F.col("m.no").alias("stage_no"), "m.stage"), key, caps)
    return _first_stage_owns(found, key, limit)


def _first_stage_owns(found: DataFrame, key: str, limit: int) -> DataFrame:
    """One row per key of the stages' rows, at most the sum of their caps: its first stage, and all that found it.

    pool counts the rows that earlier stages own, for stages that own none, too. Its window holds no more than those
    capped rows, and the stages are found in one pass over the table.
    """
    owns = found.withColumn("owns", F.row_number().over(W.partitionBy(key).orderBy("stage_no")) == 1)
    earlier = W.orderBy("stage_no").rangeBetween(W.unboundedPreceding, -1)
    open_stages = owns.withColumn("pool", F.coalesce(F.sum(F.col("owns").cast("int")).over(earlier), F.lit(0))).where(F.col("pool") < limit)
    best = open_stages.groupBy(key).agg(
        F.min("stage_no").alias("stage_no"),
        F.min_by("stage", "stage_no").alias("stage"),
        F.min_by("score", "stage_no").alias("score"),
        F.transform(F.sort_array(F.collect_list(F.struct("stage_no", "stage"))), lambda x: x["stage"]).alias("stages"),
    )
    return best.orderBy("stage_no", F.desc("score"), key).limit(limit)


def fuzzy_names(rows: DataFrame, query: str, key: str, name: str, k: int = 20, least: float = 0.2) -> DataFrame:
    """Names that contain the query or are similar to it in trigrams by more than `least`."""
    similar = X.trigram_similarity(F.col(name), F.lit(query))
    hit = F.contains(X.normalize(F.col(name)), X.normalize(F.lit(query))) | (similar > least)
    return rows.where(hit).select(F.col(key), F.col(name), F.round(similar, 6).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def nearest(rows: DataFrame, query: list[float], key: str, vector: str, k: int = 10) -> DataFrame:
    """Exact cosine top-k for one vector."""
    v = F.array(*[F.lit(float(x)) for x in query])
    return _top(rows.where(F.col(vector).isNotNull()), key, S.cosine(F.col(vector), v), k)


def merge_signals(signals: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per key with the greatest value of every signal found for it; null where a signal did not find it."""
    names = list(signals)
    tall = reduce(
        DataFrame.unionByName,
        [df.select(key, *[(F.col("score") if n == own else F.lit(None)).cast("double").alias(n) for n in names]) for own, df in signals.items()],
    )
    return tall.groupBy(key).agg(*[F.max(n).alias(n) for n in names])


def hybrid(signals: dict[str, DataFrame], weights: dict[str, float], key: str, k: int = 20) -> DataFrame:
    merged = merge_signals(signals, key)
    return merged.withColumn("total", F.round(S.weighted(weights), 6)).orderBy(F.desc("total"), key).limit(k)


def unified(registries: dict[str, DataFrame], k: int = 50) -> DataFrame:
    """Results (id, similarity) of several registries as one list, with the number of results of each registry."""
    tagged = reduce(DataFrame.unionByName, [df.select(F.lit(r).alias("registry"), "id", "similarity") for r, df in registries.items()])
    counted = tagged.withColumn("registry_results", F.count("*").over(W.partitionBy("registry")))
    return counted.orderBy(F.desc("similarity"), "registry", "id").limit(k)


def _gram_code(g: Column) -> Column:
    """A trigram as one number of its three code points, which tells it from any other."""
    point = lambda i: F.ascii(F.substr(g, F.lit(i), F.lit(1))).cast("bigint")
    return point(1) * (1 << 42) + point(2) * (1 << 21) + point(3)


def similar_names(a: DataFrame, b: DataFrame, name: str, least: float, held: tuple[str, ...] = (), before: Column | None = None, fits: Column | None = None) -> DataFrame:
    """(na, nb, similarity) of distinct names with a trigram similarity of at least `least` > 0.

    Exact without a nested loop: two such names share one of the size - ceil(least * size) + 1 rarest trigrams of
    either (prefix filter), rarity being counted over both sides. They meet at each shared one, but a pair is made at the
    first alone, if what follows there may suffice, and is measured on the spot: no pair is written that is not similar.
    A common trigram is in few prefixes, and what is left of its skew the adaptive join splits.

    held: columns that both sides have besides, of any row of a name. Pairs whose a_<column> and b_<column> don't meet
    `before` are not measured, and similar ones that don't meet `fits` are left out.
    """
    more = [F.first(c, ignorenulls=True).alias(c) for c in held]

    def grams(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(name).alias("n"), *held).where("n is not null")
        rows = rows.groupBy("n").agg(*more) if held else rows.distinct()
        return rows.withColumn("g", F.transform(X.trigrams(F.col("n")), _gram_code)).where(F.size("g") > 0)

    ga, gb = grams(a), grams(b)
    rarity = ga.select("n", "g").union(gb.select("n", "g")).distinct().select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("f"))

    def prefix(g: DataFrame, p: str) -> DataFrame:
        ranked = g.select("n", *held, F.explode("g").alias("gram")).join(rarity, "gram").groupBy("n").agg(F.sort_array(F.collect_list(F.struct("f", "gram"))).alias("fg"), *more)
        kept = ranked.select(F.col("n").alias(f"n{p}"), *[F.col(c).alias(f"{p}_{c}") for c in held], F.transform("fg", lambda x: x["gram"]).alias(f"g{p}")).withColumn(f"s{p}", F.size(f"g{p}"))
        keep = F.col(f"s{p}") - F.ceil(F.col(f"s{p}") * F.lit(least) - 1e-9) + 1
        return kept.select("*", F.posexplode(F.slice(f"g{p}", F.lit(1), keep.cast("int"))).alias(f"i{p}", "gram"))

    x, y = prefix(ga, "a"), prefix(gb, "b")
    # where a pair meets first, the trigrams from there on are all that it may share
    enough = F.least(F.col("sa") - F.col("ia"), F.col("sb") - F.col("ib")) >= (F.col("sa") + F.col("sb")) * (least / (1 + least)) - 1e-5
    met = x.join(y, "gram").where(enough if before is None else enough & before)
    met = met.select("*", F.explode(F.array(F.array_intersect("ga", "gb"))).alias("shared"))  # worked out once, in the order of ga
    n = F.size("shared")
    similarity = F.round(n / (F.col("sa") + F.col("sb") - n), 6)
    first = (similarity >= least) & (F.get("shared", F.lit(0)) == F.col("gram"))
    return met.where(first if fits is None else F.when(first, fits)).select("na", "nb", similarity.alias("similarity"))


def fuzzy_join(a: DataFrame, b: DataFrame, a_key: str, b_key: str, name: str, least: float) -> DataFrame:
    """Pairs of rows whose names have a trigram similarity of at least `least`: similar_names(), spread to the rows."""
    left = a.select(F.col(a_key), F.col(name).alias("na"))
    right = b.select(F.col(b_key), F.col(name).alias("nb"))
    return left.join(similar_names(a, b, name, least), "na").join(right, "nb").select(a_key, b_key, "similarity")
