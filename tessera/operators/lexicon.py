"""Words of names: their entry in the corpus statistics, their role in a name, parts of glued words, and how alike two are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import phonetic as P
from tessera.functions import text as X
from tessera.operators.lineage import cut

# fixed values: endings that are tried, in this order, where a word has no entry of its own; words that name no brand
ENDINGS = ("leri", "lari", "ler", "lar", "si", "i", "in", "nin", "ye", "ya", "e", "a")
GENERIC_WORDS = (
    "patent", "marka", "grup", "group", "holding", "sanayi", "san", "ticaret", "tic", "limited", "ltd", "sti", "pty", "inc", "corp",
    "company", "co", "office", "ve", "dis", "ic", "ithalat", "ihracat", "uretim", "dagitim", "yonetim", "hizmet", "hizmetleri",
    "endustri", "endustriyel", "teknoloji", "tech", "digital", "global", "inter", "international", "trademark", "market", "store",
)
#: Weight of a word by its role; of all but generic ones (and `overridden`, generic by a list alone) a name has anchors.
WEIGHTS = {"distinctive": 1.0, "common_anchor": 0.65, "semi_generic": 0.45, "weak_anchor": 0.45, "generic": 0.10, "overridden": 0.10}
STEM, ROOT, SUFFIX, DEFAULT_IDF, COMMON_IDF = 3, 4, 3, 9.0, 6.5
WEAK = {"doc_freq": 50, "last": 0.30, "first": 0.30, "single": 0.08, "signals": 2}
DESCRIPTOR_SCORE = 0.72
#: Columns that statistics may have besides word and word_class.
OPTIONAL = {"doc_freq": "bigint", "idf": "double", "first": "double", "last": "double", "single": "double", "signals": "int", "score": "double", "descriptor_like": "boolean"}


def generic(role: Column) -> Column:
    return role.isin("generic", "overridden")


def weight(role: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[role]


def entries(words: DataFrame, stats: DataFrame) -> DataFrame:
    """(word, entry) of distinct words: the statistics of the word itself or, if it has none, of the first stem that has.

    Stems are what the ENDINGS, in their order, leave of at least STEM letters. Words without any have a null entry.
    """
    held = stats.select(F.col("word").alias("stem"), F.struct("word_class", *[(F.col(c) if c in stats.columns else F.lit(None)).cast(t).alias(c) for c, t in OPTIONAL.items()]).alias("entry"))
    w = F.col("word")
    stem = lambda i, e: F.when(F.endswith(w, F.lit(e)) & (F.length(w) - len(e) >= STEM), F.struct(F.lit(i).alias("rank"), F.substr(w, F.lit(1), F.length(w) - len(e)).alias("stem")))
    tried = F.array_compact(F.array(F.struct(F.lit(0).alias("rank"), w.alias("stem")), *[stem(i, e) for i, e in enumerate(ENDINGS, 1)]))
    found = words.select("word", F.explode(tried).alias("t")).select("word", "t.rank", "t.stem").join(held, "stem", "left")
    return found.groupBy("word").agg(F.min_by("entry", F.when(F.col("entry").isNotNull(), F.col("rank"))).alias("entry"))


def word_class(entry: Column) -> Column:
    return F.when(F.coalesce(entry["descriptor_like"], F.lit(False)), "generic").otherwise(F.coalesce(entry["word_class"], F.lit("distinctive")))


def roles(words: DataFrame, stats: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(word, role, class) of distinct words.

    Generic are GENERIC_WORDS, those of `overrides` (word) and descriptors. Distinctive and semi-generic words that come
    last in many names and hardly ever first or alone are weak anchors; generic ones of a high idf common anchors. An
    overridden word that the corpus holds for distinctive counts as generic, but as matter where it is added.
    """
    held = entries(words, stats)
    if overrides is None:
        held = held.withColumn("over", F.lit(False))
    else:
        held = held.join(overrides.select("word", F.lit(True).alias("over")).distinct(), "word", "left").withColumn("over", F.coalesce("over", F.lit(False)))
    e, own = F.col("entry"), word_class(F.col("entry"))
    described = F.coalesce(e["descriptor_like"], F.lit(False))
    branded = own.isin("distinctive", "semi_generic")
    weak = branded & (e["doc_freq"] >= WEAK["doc_freq"]) & (e["last"] >= WEAK["last"]) & (e["first"] <= WEAK["first"]) & (e["single"] <= WEAK["single"]) & (e["signals"] >= WEAK["signals"])
    kept = F.col("over") & ~described & branded & e.isNotNull() & (F.coalesce(e["score"], F.lit(0.0)) < DESCRIPTOR_SCORE)
    role = (
        F.when(kept, "overridden")
        .when(F.col("word").isin(*GENERIC_WORDS) | F.col("over") | described, "generic")
        .when(weak, "weak_anchor")
        .when((own == "generic") & (F.coalesce(e["idf"], F.lit(DEFAULT_IDF)) >= COMMON_IDF), "common_anchor")
        .otherwise(own)
    )
    return held.select("word", role.alias("role"), own.alias("class"))


def suffixes(stats: DataFrame) -> DataFrame:
    """(suffix) that part a compound: GENERIC_WORDS and descriptors of at least SUFFIX letters."""
    spark = stats.sparkSession
    listed = spark.createDataFrame([(w,) for w in GENERIC_WORDS if len(w) >= SUFFIX], "suffix string")
    if "descriptor_like" not in stats.columns:
        return listed
    return listed.union(stats.where(F.col("descriptor_like") & (F.length("word") >= SUFFIX)).select("word")).distinct()


def _cuts(words: DataFrame, listed: DataFrame, root: int) -> DataFrame:
    """(word, root, suffix) for every listed suffix that a word ends in behind at least `root` letters, by an equi join."""
    at = F.sequence(F.lit(root + 1), F.length("word") - SUFFIX + 1)
    places = words.where(F.length("word") >= root + SUFFIX).select("word", F.explode(at).alias("at"))
    return places.select("word", F.substr("word", F.lit(1), F.col("at") - 1).alias("root"), F.substr("word", F.col("at")).alias("suffix")).join(listed, "suffix").select("word", "root", "suffix")


def segmented(words: DataFrame, stats: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(word, role, class, parts, split) of distinct words: parts as structs of (t, role), one where nothing is split.

    A word that is not generic is split at the longest listed suffix that leaves an anchor of at least ROOT letters as
    root, and that root once more. Cuts of all words meet the suffixes and their roles by joins, each string looked up once.
    """
    listed = suffixes(stats)
    one = cut(_cuts(words, listed, ROOT))
    two = _cuts(one.select(F.col("root").alias("word")).distinct(), listed, ROOT)
    strings = words.select("word").union(one.select("root")).union(one.select("suffix")).union(two.select("root")).union(two.select("suffix")).distinct()
    known = cut(roles(strings, stats, overrides))
    role = known.select("word", "role")

    def best(cuts: DataFrame) -> DataFrame:
        """The longest suffix behind an anchor."""
        anchored = cuts.join(role.where(~generic(F.col("role"))).withColumnsRenamed({"word": "root", "role": "root_role"}), "root")
        return anchored.groupBy("word").agg(F.max_by(F.struct("root", "suffix"), F.length("suffix")).alias("cut"))

    first = best(one)
    second = best(two).select(F.col("word").alias("root"), F.col("cut").alias("again"))
    held = known.join(words, "word").join(first, "word", "left").withColumn("cut", F.when(~generic(F.col("role")), F.col("cut"))).withColumn("root", F.col("cut.root")).join(second, "root", "left")
    parts = (
        F.when(F.col("again").isNotNull(), F.array("again.root", "again.suffix", "cut.suffix"))
        .when(F.col("cut").isNotNull(), F.array("cut.root", "cut.suffix"))
        .otherwise(F.array("word"))
    )
    flat = held.select("word", "role", "class", F.posexplode(parts).alias("at", "t"), F.size(parts).alias("n"))
    of = role.withColumnsRenamed({"word": "t", "role": "part_role"})
    listed_parts = F.transform(F.sort_array(F.collect_list(F.struct("at", "t", F.col("part_role").alias("role")))), lambda p: F.struct(p["t"].alias("t"), p["role"].alias("role")))
    return flat.join(of, "t").groupBy("word", "role", "class", (F.col("n") > 1).alias("split")).agg(listed_parts.alias("parts")).select("word", "role", "class", "parts", "split")


def names(df: DataFrame, name: str, stats: DataFrame, levels: dict[str, float], overrides: DataFrame | None = None) -> DataFrame:
    """(name, norm, words, ordered, split, raw) of every distinct name.

    words: distinct parts of its words of two letters or more, as structs of (less, t, role), the weightiest first (less
    is the negative weight). ordered: parts of all its words in their order. split: whether a word fell into parts.
    raw: its words as structs of (t, w), w by class and `levels`. Null and blank names have none.
    """
    given = df.select(F.col(name).alias("name")).distinct().withColumn("norm", X.normalize(F.col("name")))
    placed = given.select("name", F.posexplode(F.split("norm", " ", -1)).alias("at", "word")).where("word <> ''")
    seg = cut(segmented(cut(placed.select("word").distinct()), stats, overrides))
    classes = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    told = placed.join(seg, "word").groupBy("name").agg(
        F.sort_array(F.collect_list(F.struct("at", "word", "parts", "split", classes[F.col("class")].alias("w")))).alias("ws")
    )  # a row a name
    long = F.filter("ws", lambda x: F.length(x["word"]) > 1)
    weighed = F.transform(F.array_distinct(F.flatten(F.transform(long, lambda x: x["parts"]))), lambda p: F.struct((-weight(p["role"])).alias("less"), p["t"].alias("t"), p["role"].alias("role")))
    shaped = told.select(
        "name",
        F.sort_array(weighed).alias("words"),
        F.array_distinct(F.flatten(F.transform("ws", lambda x: F.transform(x["parts"], lambda p: p["t"])))).alias("ordered"),
        F.exists(long, lambda x: x["split"]).alias("split"),
        F.array_distinct(F.transform("ws", lambda x: F.struct(x["word"].alias("t"), x["w"].alias("w")))).alias("raw"),
    )
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return given.join(shaped, "name", "left").select(
        "name", "norm", none("words", "array<struct<less: double, t: string, role: string>>"), none("ordered", "array<string>"),
        F.coalesce("split", F.lit(False)).alias("split"), none("raw", "array<struct<t: string, w: double>>"),
    )


# ---- how alike two words are ---------------------------------------------------------------------------------------

#: Least ratios of words alike in spelling, and in spelling and sound; below LIKE no match counts.
LIKE, SPELLED, NEARLY, EMBEDDED = 0.70, 0.84, 0.74, 0.69
BY_SOUND = ((0.90, 0.55, 0.82, 0.78), (0.84, 0.60, 0.78, 0.72))  # sound, spelling, factor, most
LEAST_RATIO = min(ratio for _, ratio, *_ in BY_SOUND)


def may_match(x: Column, y: Column, least: float = LEAST_RATIO) -> Column:
    """Whether two words may have a ratio of `least`: by their lengths, and by the letters that they share.

    Lossless: twice the shared letters over all letters is no less than the ratio, and taking a shared ending away
    from both, as fuzzy ratios do, only lowers this bound.
    """
    count = lambda w, c: F.length(w) - F.length(F.replace(w, c, F.lit("")))
    total = F.length(x) + F.length(y)
    shared = F.aggregate(F.array_distinct(F.split(x, "", -1)), F.lit(0), lambda s, c: s + F.when(c == "", 0).otherwise(F.least(count(x, c), count(y, c))))
    return (2 * F.least(F.length(x), F.length(y)) >= least * total) & (2 * shared >= least * total)


def fuzzy(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """(x, y, fuzzy) of distinct pairs of words: the difference ratio of what is left without a generic ending that they share.

    The ending is the longest listed suffix of both: short roots then count 0, roots less alike than 0.72 at most 0.45.
    Else it is all that both end in, if that is a generic word of four letters or more and leaves two letters of each.
    """
    listed = suffixes(stats)
    words = pairs.select(F.col("x").alias("word")).union(pairs.select("y")).distinct()
    ends = _cuts(cut(words), listed, 0).groupBy("word").agg(F.collect_set("suffix").alias("ends"))
    none = F.array().cast("array<string>")
    held = pairs.select("x", "y")
    for side in ("x", "y"):
        held = held.join(ends.select(F.col("word").alias(side), F.col("ends").alias(f"{side}_ends")), side, "left").withColumn(f"{side}_ends", F.coalesce(f"{side}_ends", none))
    both = F.array_sort(F.array_intersect("x_ends", "y_ends"), lambda a, b: F.length(b) - F.length(a))
    x, y = F.col("x"), F.col("y")
    alike = F.size(F.filter(F.sequence(F.lit(1), F.least(F.length(x), F.length(y))), lambda n: F.right(x, n) == F.right(y, n)))
    held = cut(held.select("x", "y", F.get(both, F.lit(0)).alias("shared"), F.right(x, alike).alias("tail")))
    tails = held.where((F.length("tail") >= 4) & F.col("shared").isNull()).select(F.col("tail").alias("word")).distinct()
    plain = entries(tails, stats).where(word_class(F.col("entry")) == "generic").select(F.col("word").alias("tail"), F.lit(True).alias("plain"))
    held = held.join(plain, "tail", "left")
    less = lambda w, end: F.substr(w, F.lit(1), F.length(w) - F.length(end))
    drop = (F.length("x") - F.length("tail") >= 2) & (F.length("y") - F.length("tail") >= 2) & F.coalesce("plain", F.lit(False))
    root = lambda w: F.when(F.col("shared").isNotNull(), less(w, F.col("shared"))).when(drop, less(w, F.col("tail"))).otherwise(w)
    held = held.select("x", "y", "shared", root(x).alias("p"), root(y).alias("q"))
    held = held.withColumn("r", P.difference_ratio("p", "q"))
    short = (F.length("p") < ROOT) | (F.length("q") < ROOT)
    value = F.when(F.col("shared").isNull(), F.col("r")).when(short, 0.0).when(F.col("r") < 0.72, F.least(F.lit(0.45), F.col("r") * 0.60)).otherwise(F.col("r"))
    return held.select("x", "y", value.alias("fuzzy"))


def alike(pairs: DataFrame, stats: DataFrame, sounds: bool = True) -> DataFrame:
    """(x, y, fuzzy, sim, kind) of distinct pairs of different words that match, kind being fuzzy or phonetic.

    Every pair is worked out once, however many pairs of names hold it. A word within the other, two letters longer,
    matches by sound alone. Without `sounds` spelling alone counts.
    """
    f, x, y = F.col("fuzzy"), F.col("x"), F.col("y")
    low = F.least(F.length(x), F.length(y))
    inside = (low >= ROOT) & (F.abs(F.length(x) - F.length(y)) >= 2) & (F.startswith(x, y) | F.startswith(y, x) | F.endswith(x, y) | F.endswith(y, x))
    met = cut(fuzzy(pairs, stats)).withColumn("used", F.when(inside, F.least(f, F.lit(EMBEDDED))).otherwise(f)).withColumn("raw", f)
    u = F.col("used")
    spelled = F.when(u >= SPELLED, u).when((u >= NEARLY) & (low >= 4), u * 0.95)
    met = met.withColumn("sim", spelled)
    out = met.where(F.col("sim").isNotNull()).select("x", "y", "fuzzy", "sim", F.lit("fuzzy").alias("kind"))
    if sounds:
        near = met.where(F.col("sim").isNull() & (u >= LEAST_RATIO)).withColumn("sound", P.sound_similarity(x, y))
        heard = F.coalesce(*[F.when((F.col("sound") >= s) & (u >= r), F.least(F.lit(most), F.col("sound") * factor)) for s, r, factor, most in BY_SOUND])
        out = out.union(near.select("x", "y", "fuzzy", heard.alias("sim"), F.lit("phonetic")))
    return out.where(F.col("sim") >= LIKE).select("x", "y", "fuzzy", F.round("sim", 4).alias("sim"), "kind")
