"""Corpus statistics of words: inverse document frequencies, classes, and the dispersion profile of frequent words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.lineage import cut

GENERIC, SEMI = 0.005, 0.001


#: Stands for the text itself among its words, so that one pass counts both; no word holds it.
_TEXT = "\x00"


def word_statistics(docs: DataFrame, text: str) -> DataFrame:
    """word, doc_freq, idf, word_class and is_generic. N counts rows with a text that is not blank.

    One pass: every row gives its distinct words and a mark of its own, counted in two stages before and after one
    shuffle. N is the mark's count, read from the same exchange: the mark is told by an aggregate, since a filter on
    the word itself would be moved before the exchange of one side, and both would be computed.
    """
    live = docs.where(F.trim(F.col(text)) != "")
    counts = live.select(F.explode(F.array_append(F.array_distinct(X.tokens(F.col(text))), F.lit(_TEXT))).alias("word")).groupBy("word").agg(F.count("*").alias("doc_freq"), F.min(F.col("word") == _TEXT).alias("whole"))
    n = F.broadcast(counts.agg(F.max(F.when(F.col("whole"), F.col("doc_freq"))).alias("n_docs")))  # one row
    share = F.col("doc_freq") / F.col("n_docs")
    word_class = F.when(share > GENERIC, "generic").when(share > SEMI, "semi_generic").otherwise("distinctive")
    return counts.where(~F.col("whole")).crossJoin(n).select(
        "word", "doc_freq", F.round(F.log(F.col("n_docs") / F.col("doc_freq")), 4).alias("idf"), word_class.alias("word_class"), (share > GENERIC).alias("is_generic")
    )


def _word_rows(docs: DataFrame, text: str, *more: str) -> DataFrame:
    """One row per row and distinct word of its text: word, first, last, single (how the word stands) and more columns."""
    words = X.tokens(F.col(text))
    ends = docs.where(F.trim(F.col(text)) != "").select(words.alias("ws"), *more)
    ends = ends.select(F.array_distinct("ws").alias("set"), F.get("ws", F.lit(0)).alias("head"), F.get("ws", F.size("ws") - 1).alias("tail"), F.size("ws").alias("n"), *more)
    each = ends.select(F.explode("set").alias("word"), "head", "tail", "n", *more)
    return each.select("word", (F.col("word") == F.col("head")).alias("first"), (F.col("word") == F.col("tail")).alias("last"), (F.col("n") == 1).alias("single"), *more)


def dispersion(docs: DataFrame, text: str, group: str, least: int) -> DataFrame:
    """Profile of words in at least `least` texts: how often they come first, last or alone, and exact counts of groups."""
    return _word_rows(docs, text, group).groupBy("word").agg(
        F.count("*").alias("doc_freq"),
        F.count_if("first").alias("first_count"),
        F.count_if("last").alias("last_count"),
        F.count_if("single").alias("single_count"),
        F.count_distinct(group).alias("unique_group_count"),
    ).where(F.col("doc_freq") >= least)


#: Least lengths of the root and the suffix of a compound; gates of what counts as a descriptor.
ROOT, SUFFIX = 4, 3
MIN_SHARE, MIN_TEXTS, SCORE, FIRST_RATE, SINGLE_RATE, STRONG_SUFFIX, SOME_SUFFIX = 0.00035, 250, 0.72, 0.25, 0.05, 0.45, 0.15


def compound_hits(docs: DataFrame, text: str, words: DataFrame) -> DataFrame:
    """(word, compact_suffix_hits): rows times distinct tokens that end in the word behind a root of at least ROOT letters.

    Tokens are cut at every place that leaves a root and a suffix long enough, and the suffixes met by an equi join.
    """
    tokens = docs.where(F.trim(F.col(text)) != "").select(F.explode(F.array_distinct(X.tokens(F.col(text)))).alias("t")).where(F.length("t") >= ROOT + SUFFIX)
    counted = tokens.groupBy("t").agg(F.count("*").alias("n"))
    cuts = counted.select("n", F.explode(F.transform(F.sequence(F.lit(ROOT + 1), F.length("t") - SUFFIX + 1), lambda i: F.substr(F.col("t"), i))).alias("word"))
    return cuts.join(words.select("word"), "word").groupBy("word").agg(F.sum("n").alias("compact_suffix_hits"))


def descriptors(docs: DataFrame, text: str, holder: str, classes: str, least: int | None = None) -> DataFrame:
    """Words in enough texts, their profile, its score, and whether it makes them descriptors.

    Partners are the other words of the same rows, holders and classes those of the rows. `least` is the number of
    texts a word needs; by default the greater of MIN_TEXTS and MIN_SHARE of all.
    """
    live = docs.where(F.trim(F.col(text)) != "")
    seen = _word_rows(docs, text, holder)
    n = F.broadcast(live.agg(F.greatest(F.lit(MIN_TEXTS), F.floor(F.count("*") * MIN_SHARE)).alias("least"))) if least is None else docs.sparkSession.range(1).select(F.lit(least).alias("least"))
    base = seen.groupBy("word").agg(
        F.count("*").alias("doc_freq"), F.count_if("first").alias("f"), F.count_if("last").alias("l"), F.count_if("single").alias("s"), F.count_distinct(holder).alias("holders")
    ).crossJoin(F.broadcast(n)).where(F.col("doc_freq") >= F.col("least"))  # one row
    frequent = base.select("word")
    of_class = live.select(F.explode(F.array_distinct(X.tokens(F.col(text)))).alias("word"), classes).join(frequent, "word")
    n_classes = of_class.select("word", F.explode(classes).alias("c")).groupBy("word").agg(F.count_distinct("c").alias("n_classes"))
    partners = partner_counts(docs, text, frequent)
    hits = compound_hits(docs, text, frequent)
    zero = lambda c: F.coalesce(c, F.lit(0))
    p = base.join(n_classes, "word", "left").join(partners, "word", "left").join(hits, "word", "left").select(
        "word", "doc_freq", (F.col("f") / F.col("doc_freq")).alias("first"), (F.col("l") / F.col("doc_freq")).alias("last"), (F.col("s") / F.col("doc_freq")).alias("single"),
        zero(F.col("unique_partner_count")).alias("partners"), "holders", zero(F.col("n_classes")).alias("n_classes"), zero(F.col("compact_suffix_hits")).alias("hits"),
    )
    d = F.col("doc_freq")
    part = lambda x, w: F.least(F.lit(1.0), x) * w
    score = (
        part(F.col("last") / STRONG_SUFFIX, 0.30)
        + (1 - F.least(F.lit(1.0), F.col("first") / FIRST_RATE)) * 0.16
        + (1 - F.least(F.lit(1.0), F.col("single") / SINGLE_RATE)) * 0.10
        + part(F.col("partners") / F.greatest(d * 0.50, F.lit(1)), 0.14)
        + part(F.col("holders") / F.greatest(d * 0.35, F.lit(1)), 0.12)
        + part(F.col("n_classes") / F.lit(8.0), 0.13)
        + part(F.col("hits") / F.greatest(d * 0.04, F.lit(10)), 0.15)
    )
    score = F.round(F.least(F.lit(1.0), score), 4)
    enough = lambda c, least, share: F.col(c) >= F.greatest(F.lit(least), F.floor(d * share))
    spread = enough("partners", 80, 0.45) & enough("holders", 50, 0.30) & (F.col("n_classes") >= 8)
    suffix = (F.col("last") >= STRONG_SUFFIX) | ((F.col("last") >= SOME_SUFFIX) & spread) | enough("hits", 15, 0.02)
    flags = [F.col("last") >= STRONG_SUFFIX, F.col("first") <= FIRST_RATE, F.col("single") <= SINGLE_RATE, (F.col("last") >= SOME_SUFFIX) & spread, enough("hits", 15, 0.02)]
    p = p.withColumn("signals", sum((f.cast("int") for f in flags[1:]), flags[0].cast("int")))
    return p.withColumn("score", score).withColumn("descriptor_like", (F.col("score") >= SCORE) & (F.col("first") <= FIRST_RATE) & (F.col("single") <= SINGLE_RATE) & suffix)


def partner_counts(docs: DataFrame, text: str, words: DataFrame | None = None) -> DataFrame:
    """Per word, or per one of `words`, the number of distinct other words it shares a text with.

    A word that nobody asks for is dropped before its partners are made; pairs are told apart before they are counted.
    """
    texts = docs.select(X.token_set(F.col(text)).alias("ws"))
    first = texts.select(F.explode("ws").alias("word"), "ws")
    if words is not None:
        first = first.join(words.select("word"), "word", "left_semi")
    pairs = first.select("word", F.explode("ws").alias("partner")).where("word <> partner").distinct()
    return pairs.groupBy("word").agg(F.count("*").alias("unique_partner_count"))


def lexical_statistics(docs: DataFrame, text: str, holder: str, classes: str, least: int | None = None) -> DataFrame:
    """word_statistics() with the profile of descriptors() where a word is frequent enough: what lexicon.roles() asks for.

    The profile's parts each read the three columns, so these are written once: they may come of a far wider table.
    """
    docs = cut(docs.select(*dict.fromkeys((text, holder, classes))))
    profile = descriptors(docs, text, holder, classes, least).select("word", "first", "last", "single", "signals", "score", "descriptor_like")
    return word_statistics(docs, text).join(profile, "word", "left")
