"""Queries of searches, feeds, ingest rules and repairs, with their equals in SQL.

Names are the first three words of documents, with Turkish letters put in, so that they are many and of many lengths;
the other stand-ins are those of the catalog. The SQL states the registry's rules and not this library's code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.functions import phonetic as P
from tessera.functions import scores as S
from tessera.functions import status as ST
from tessera.functions import text as X
from tessera.functions import visual as V
from tessera.operators import corpus, feeds, lexicon, merge, nearest, retrieval, rows, scan, scoring, search
from tessera.operators.lineage import cut
from tessera.plans.catalog import AS_OF, GRAMS, TM, jaccard_sql, query, read, trademarks
from tessera.plans.pair_sql import BLOCKS, SCORED, STATISTICS, TRIGRAMS, lookup_sql
from tessera.plans.registry import RISK, as_of

MK = r"""mk AS (SELECT doc_id AS id, translate(array_to_string(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '')[1:3], ' '), 'sogSOG', 'şöğŞÖĞ') AS name, source AS holder, lang,
 [CAST(doc_id % 45 + 1 AS INTEGER), CAST(doc_id * 7 % 45 + 1 AS INTEGER)] AS classes, DATE '2020-01-01' + CAST(doc_id % 1500 AS INTEGER) AS day,
 ['published', 'registered', 'corrections', 'changes'][CAST(doc_id % 4 AS INTEGER) + 1] AS section, (2000 + doc_id % 20) || '/' || doc_id AS application_no FROM documents)"""
NORM_TR = f"trim(regexp_replace(translate(lower(translate({{0}}, 'Iİ', 'ıi')), '{X.MARKED}', '{X.BARE}'), '[^a-z0-9]+', ' ', 'g'))"
VEC = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings WHERE embedding IS NOT NULL), v AS (SELECT a AS q FROM e WHERE id = 7)"


def marks(spark, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+", 5), lambda w: w != "")  # the rest of a text, which is no name, stays whole
    return read(spark, sf_dir, "documents").select(
        k.alias("id"), F.translate(F.array_join(F.slice(words, 1, 3), " "), "sogSOG", "şöğŞÖĞ").alias("name"), F.col("source").alias("holder"), "lang",
        F.array((k % 45 + 1).cast("int"), (k * 7 % 45 + 1).cast("int")).alias("classes"), F.date_add(F.lit("2020-01-01").cast("date"), (k % 1500).cast("int")).alias("day"),
        F.get(F.array(*[F.lit(s) for s in ("published", "registered", "corrections", "changes")]), (k % 4).cast("int")).alias("section"),
        F.concat((2000 + k % 20).cast("string"), F.lit("/"), k.cast("string")).alias("application_no"),
    )


def vectors(spark, sf_dir: str) -> tuple[DataFrame, list[float]]:
    e = read(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("a"))
    return e, e.where("id = 7").select("a").first()[0]  # one vector


def picked(number, *values):
    return F.get(F.array(*[F.lit(v) for v in values]), number.cast("int"))


# ---- names ---------------------------------------------------------------------------------------------------------


@query("x2_turkish_names", f"WITH {MK} SELECT id, {NORM_TR.format('name')} AS norm FROM mk")
def x2b(spark, sf):
    return marks(spark, sf).select("id", X.normalize(F.col("name")).alias("norm"))


@query("x4_repaired_names", f"WITH {MK} SELECT id, name FROM mk WHERE NOT regexp_matches(name, '[ÃÄÅÂ]')")
def x4(spark, sf):
    m = marks(spark, sf).where(~F.col("name").rlike("[ÃÄÅÂ]"))
    return m.select("id", X.repair_mojibake(F.decode(F.encode("name", "UTF-8"), "ISO-8859-1")).alias("name"))


@query("x8_sound_codes")
def x8(spark, sf):
    names = marks(spark, sf).select(X.normalize(F.col("name")).alias("norm")).distinct()
    return names.select("norm", P.sound_codes("norm").alias("c")).select("norm", "c.primary", "c.secondary")


@query("x9_sound_similarity")
def x9(spark, sf):
    names = marks(spark, sf).select("name").distinct()
    return names.select("name", P.sound_similarity(F.col("name"), F.lit("Şerle ander")).alias("similarity"), P.difference_ratio(X.normalize(F.col("name")), F.lit("serle ander")).alias("ratio"), P.ocr_similarity(F.col("name"), F.lit("and er")).alias("ocr"))


@query("q1_prescreen", f"""WITH {MK}, {VEC}, s AS (SELECT mk.id, name, length(name) AS size, {NORM_TR.format('name')} AS n, a, q, CASE WHEN mk.id % 3 = 0 THEN name || ' logo' END AS ocr FROM mk LEFT JOIN e ON e.id = mk.id CROSS JOIN v),
 t AS (SELECT *, replace(n, ' ', '') AS c, {GRAMS.format('n')} AS g, {GRAMS.format("'the and'")} AS p FROM s), u AS (SELECT *, {jaccard_sql('g', 'p')} AS sim, list_cosine_similarity(a, q) AS cos FROM t),
 x AS (SELECT * FROM (SELECT id, 1.0::DOUBLE AS score, 0 AS stage_no FROM u WHERE n = 'the and' ORDER BY size, id LIMIT 25)
 UNION ALL SELECT * FROM (SELECT id, 0.88, 1 FROM u WHERE contains(c, 'theand') ORDER BY CASE WHEN c = 'theand' THEN 0 ELSE 1 END, size, id LIMIT 80)
 UNION ALL SELECT * FROM (SELECT id, 0.86, 2 FROM u WHERE contains(n, 'the and') ORDER BY size, id LIMIT 60)
 UNION ALL SELECT * FROM (SELECT id, 0.82, 3 FROM u WHERE contains(' ' || n || ' ', ' the ') AND contains(' ' || n || ' ', ' and ') ORDER BY size, id LIMIT 80)
 UNION ALL SELECT * FROM (SELECT id, 0.78, 4 FROM u WHERE contains(' ' || n || ' ', ' the ') OR contains(' ' || n || ' ', ' and ') ORDER BY size, id LIMIT 120)
 UNION ALL SELECT * FROM (SELECT id, 0.85, 5 FROM u WHERE (contains(n, 'tion') OR contains(c, 'tion')) AND (contains(n, 'then') OR contains(c, 'then')) ORDER BY size, id LIMIT 100)
 UNION ALL SELECT * FROM (SELECT id, 0.80, 6 FROM u WHERE contains(n, 'tion') OR contains(c, 'tion') OR contains(n, 'then') OR contains(c, 'then') ORDER BY size, id LIMIT 80)
 UNION ALL SELECT * FROM (SELECT id, round(sim, 6) AS s, 7 FROM u WHERE lower(name) <> 'the and' AND sim >= 0.3 ORDER BY s DESC, id LIMIT 120)
 UNION ALL SELECT * FROM (SELECT id, round(cos, 6) AS s, 8 FROM u WHERE a IS NOT NULL ORDER BY s DESC, id LIMIT 50)
 UNION ALL SELECT * FROM (SELECT id, 0.75, 9 FROM u WHERE coalesce(ocr, '') <> '' AND contains({NORM_TR.format('ocr')}, 'the and') ORDER BY size, id LIMIT 20)),
 o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stage_no) AS r FROM x), b AS (SELECT stage_no, coalesce(sum(count(*) FILTER (r = 1)) OVER (ORDER BY stage_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pool FROM o GROUP BY stage_no),
 k AS (SELECT id, min(stage_no) AS stage_no, min_by(score, stage_no) AS score, array_to_string(list(CAST(stage_no AS VARCHAR) ORDER BY stage_no), ',') AS stages FROM o JOIN b USING (stage_no) WHERE pool < 500 GROUP BY id)
 SELECT * FROM k ORDER BY stage_no, score DESC, id LIMIT 500""")
def q1(spark, sf):
    e, v = vectors(spark, sf)
    m = marks(spark, sf).join(e, "id", "left").withColumn("ocr", F.when(F.col("id") % 3 == 0, F.concat("name", F.lit(" logo"))))
    found = retrieval.prescreen(m, "The and", ["the", "tion", "and", "then"], image=v, vector="a", ocr="ocr")
    number = F.create_map(*[F.lit(x) for i, s in enumerate(retrieval.STAGES) for x in (s, str(i))])
    return found.select("id", "stage_no", "score", F.array_join(F.transform("stages", lambda s: number[s]), ",").alias("stages"))


_TEXT_STAGES = "x AS (SELECT * FROM (SELECT id, 1.0::DOUBLE AS score, 0 AS stage_no FROM u WHERE n = 'the and' ORDER BY size, id LIMIT 25) " + " ".join(
    f"UNION ALL SELECT * FROM (SELECT id, {score}, {no} FROM u WHERE {test} ORDER BY {order}, id LIMIT {cap})" for no, score, cap, order, test in (
        (1, 0.88, 80, "CASE WHEN c = 'theand' THEN 0 ELSE 1 END, size", "contains(c, 'theand')"), (2, 0.86, 60, "size", "contains(n, 'the and')"),
        (3, 0.82, 80, "size", "contains(' ' || n || ' ', ' the ') AND contains(' ' || n || ' ', ' and ')"), (4, 0.78, 120, "size", "contains(' ' || n || ' ', ' the ') OR contains(' ' || n || ' ', ' and ')"),
        (7, "round(sim, 6) AS s", 120, "s DESC", "lower(name) <> 'the and' AND sim >= 0.3"),
    )
) + ")"


@query("q4_brand_risk", f"""WITH RECURSIVE {MK}, t AS (SELECT *, replace(n, ' ', '') AS c, {GRAMS.format('n')} AS g, {GRAMS.format("'the and'")} AS p FROM (SELECT id, name, length(name) AS size, {NORM_TR.format('name')} AS n FROM mk)), u AS (SELECT *, {jaccard_sql('g', 'p')} AS sim FROM t), {_TEXT_STAGES},
 fo AS (SELECT id, min(stage_no) AS stage_no FROM x GROUP BY id), pr AS (SELECT id, 'The and' AS a, name AS b FROM fo JOIN mk USING (id)), {STATISTICS}, {SCORED}
 SELECT id, name, stage_no, score, path, {RISK} AS risk_level, (SELECT max(score) FROM scored) < 0.75 AS needs_live FROM scored JOIN fo USING (id) JOIN mk USING (id) ORDER BY score DESC, id LIMIT 100""")
def q4(spark, sf):
    """Candidates for a name by the registry's stages, scored by the word classes of the corpus: the 100 of the highest risk."""
    return scoring.brand_risk(marks(spark, sf), "The and", ["the", "and"], corpus.word_statistics(read(spark, sf, "documents"), "text"), sounds=False)


@query("q1_prescreen_by_sound")
def q1b(spark, sf):
    """All eleven stages; the phonetic one has no form in SQL."""
    m = marks(spark, sf)
    norms = m.select(X.normalize(F.col("name")).alias("norm")).union(spark.range(1).select(F.lit("the and").alias("norm"))).distinct()
    sounds = norms.select("norm", P.sound_codes("norm")["primary"].alias("code"))
    found = retrieval.prescreen(m, "The and", ["the", "tion", "and", "then"], sounds=sounds)
    return found.select("id", "stage_no", "stage", "score", F.array_join("stages", ",").alias("stages"))


NAME_GRAMS = f"g AS (SELECT id, {NORM_TR.format('name')} AS n, {GRAMS.format(NORM_TR.format('name'))} AS g, {GRAMS.format(repr('ander the'))} AS p, {GRAMS.format(repr('and'))} AS r FROM mk)"


@query("q5_name_search", f"""WITH {MK}, {NAME_GRAMS}, s AS (SELECT id, n, {jaccard_sql('g', 'p')} AS s FROM g)
 SELECT id, name, n = 'ander the' AS exact_match, round(s, 6) AS total FROM s JOIN mk USING (id) WHERE (contains(n, 'ander') AND contains(n, 'the')) OR s > 0.2 ORDER BY exact_match DESC, total DESC, id LIMIT 50""")
def q5(spark, sf):
    return search.search_names(marks(spark, sf), "Ander the")


@query("q6_image_search", f"""WITH {VEC}, c AS (SELECT id, round(list_cosine_similarity(a, q), 6) AS clip FROM e, v ORDER BY clip DESC, id LIMIT 100), d AS (SELECT id, round(list_cosine_similarity(list_reverse(a), q), 6) AS dino FROM e, v ORDER BY dino DESC, id LIMIT 100)
 SELECT id, clip, dino, round(greatest(coalesce(clip, -1), coalesce(dino, -1)), 6) AS best FROM c FULL JOIN d USING (id)""")
def q6(spark, sf):
    e, v = vectors(spark, sf)
    arms = {"clip": retrieval.nearest(e, v, "id", "a", 100), "dino": retrieval.nearest(e.select("id", F.reverse("a").alias("a")), v, "id", "a", 100)}
    return retrieval.merge_signals(arms, "id").withColumn("best", F.round(F.greatest("clip", "dino"), 6))


@query("j13_nearest_many", f"""WITH {VEC}, s AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(b.a, a.a), 6) AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id)
 SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 5""")
def j13(spark, sf):
    e, _ = vectors(spark, sf)
    return nearest.nearest_many(e, e.where("id % 100 = 0").withColumnRenamed("id", "query_id"), "id", "a", 5)


@query("q8_design_search", f"""WITH {MK}, {VEC}, {NAME_GRAMS}, t AS (SELECT id, round({jaccard_sql('g', 'p')}, 6) AS text FROM g WHERE contains(n, 'ander the') OR {jaccard_sql('g', 'p')} > 0.2 ORDER BY text DESC, id LIMIT 200),
 d AS (SELECT id, round(list_cosine_similarity(a, q), 6) AS dinov2 FROM e, v ORDER BY dinov2 DESC, id LIMIT 200), c AS (SELECT id, round(list_cosine_similarity(list_reverse(a), q), 6) AS clip FROM e, v ORDER BY clip DESC, id LIMIT 100),
 h AS (SELECT id // 2 AS id, round(max(list_cosine_similarity(a[1:8], q[1:8])), 6) AS color FROM e, v GROUP BY 1 ORDER BY color DESC, id LIMIT 100),
 m AS (SELECT id, text, dinov2, clip, color FROM t FULL JOIN d USING (id) FULL JOIN c USING (id) FULL JOIN h USING (id)), s AS (SELECT *, round(coalesce(dinov2, 0) * 0.55 + coalesce(clip, 0) * 0.30 + coalesce(color, 0) * 0.10 + coalesce(text, 0) * 0.05, 8) AS total FROM m ORDER BY total DESC, id LIMIT 20)
 SELECT id, name, total FROM s JOIN mk USING (id)""")
def q8(spark, sf):
    e, v = vectors(spark, sf)
    m = marks(spark, sf).select("id", "name")
    views = e.select(F.floor(F.col("id") / 2).alias("id"), F.slice("a", 1, 8).alias("hsv"))
    arms = {
        "text": search.text_arm(m, "Ander the", "id", "name"),
        "dinov2": retrieval.nearest(e, v, "id", "a", search.POOL),
        "clip": retrieval.nearest(e.select("id", F.reverse("a").alias("a")), v, "id", "a", search.IMAGE_POOL),
        "color": search.views_arm(views, v[:8], "id", "hsv"),
    }
    return search.ranked(arms, S.DESIGN_IMAGE, m, "id").select("id", "name", "total")


@query("q9_patent_by_number", f"WITH {MK} SELECT id, application_no, 0.4::DOUBLE AS total FROM mk WHERE application_no = '2007/7'")
def q9b(spark, sf):
    m = marks(spark, sf).withColumnRenamed("name", "title")
    return search.search_patents(m, " 2007/7 B ").select("id", "application_no", "total")


@query("q9_patent_by_holder", f"""WITH {MK}, {VEC}, {NAME_GRAMS}, t AS (SELECT id, round({jaccard_sql('g', 'p')}, 6) AS lexical FROM g WHERE contains(n, 'ander the') OR {jaccard_sql('g', 'p')} > 0.2 ORDER BY lexical DESC, id LIMIT 200),
 d AS (SELECT id, round(list_cosine_similarity(a, q), 6) AS semantic FROM e JOIN mk USING (id), v ORDER BY semantic DESC, id LIMIT 200), m AS (SELECT id, round(coalesce(lexical, 0) * 0.4 + coalesce(semantic, 0) * 0.6, 8) AS total FROM t FULL JOIN d USING (id)),
 f AS (SELECT m.* FROM m JOIN mk USING (id) WHERE contains(lower(holder), 'src1') ORDER BY total DESC, id LIMIT 20) SELECT id, holder, total FROM f JOIN mk USING (id)""")
def q9c(spark, sf):
    e, v = vectors(spark, sf)
    m = marks(spark, sf).withColumnRenamed("name", "title").join(e.withColumnRenamed("a", "embedding"), "id", "left")
    return search.search_patents(m, "Ander the", v, m.select("id", F.col("holder").alias("name")), "SRC1").select("id", "holder", "total")


@query("q10_gi_search", f"""WITH {MK}, {VEC}, {NAME_GRAMS}, o AS (SELECT id FROM g JOIN mk USING (id) WHERE section NOT IN ('corrections', 'gazette_only_announcements') AND lower(lang) = 'en' AND (contains(n, 'and') OR {jaccard_sql('g', 'r')} > 0.2) AND day >= DATE '2020-02-01'),
 t AS (SELECT id, round({jaccard_sql('g', 'p')}, 6) AS lexical FROM g JOIN o USING (id) WHERE contains(n, 'ander the') OR {jaccard_sql('g', 'p')} > 0.2 ORDER BY lexical DESC, id LIMIT 200), d AS (SELECT id, round(list_cosine_similarity(a, q), 6) AS semantic FROM e JOIN o USING (id), v ORDER BY semantic DESC, id LIMIT 200),
 i AS (SELECT id, round(list_cosine_similarity(list_reverse(a), q), 6) AS image FROM e JOIN o USING (id), v ORDER BY image DESC, id LIMIT 200), m AS (SELECT id, round(coalesce(lexical, 0) * 0.25 + coalesce(semantic, 0) * 0.35 + coalesce(image, 0) * 0.40, 8) AS total FROM t FULL JOIN d USING (id) FULL JOIN i USING (id) ORDER BY total DESC, id LIMIT 20)
 SELECT id, name, total FROM m JOIN mk USING (id)""")
def q10(spark, sf):
    e, v = vectors(spark, sf)
    m = marks(spark, sf)
    open_ = m.where(search.gi_filter(F.col("section"), F.col("lang"), X.normalize(F.col("name")), F.col("day"), kind="EN", region="And", since="2020-02-01")).select("id", "name")
    mine = e.join(open_.select("id"), "id", "left_semi")
    arms = {
        "lexical": search.text_arm(open_, "Ander the", "id", "name"),
        "semantic": retrieval.nearest(mine, v, "id", "a", search.POOL),
        "image": retrieval.nearest(mine.select("id", F.reverse("a").alias("a")), v, "id", "a", search.POOL),
    }
    return search.ranked(arms, S.HYBRID_ALL, open_, "id").select("id", "name", "total")


@query("f5_gi_filters", f"WITH {MK} SELECT id FROM mk WHERE section IN ('published', 'changes') AND lower(lang) = 'fr' AND day <= DATE '2022-12-31'")
def f5(spark, sf):
    c = F.col
    return marks(spark, sf).where(search.gi_filter(c("section"), c("lang"), c("name"), c("day"), sections=["published", "changes"], kind="Fr", until="2022-12-31")).select("id")


# ---- corpus --------------------------------------------------------------------------------------------------------

TOKENS = f"list_filter(string_split({NORM_TR.format('name')}, ' '), lambda w: length(w) > 1)"


@query("a15_compound_suffixes", f"""WITH {MK}, t AS (SELECT id, unnest(list_distinct({TOKENS})) AS t FROM mk), w AS (SELECT t AS word FROM t GROUP BY t HAVING count(*) >= 5), s AS (SELECT substr(t, i) AS word FROM t, unnest(range(5, length(t) - 1)) AS r(i) WHERE length(t) >= 7)
 SELECT word, count(*) AS compact_suffix_hits FROM s JOIN w USING (word) GROUP BY word""")
def a15(spark, sf):
    m = marks(spark, sf)
    words = corpus.word_statistics(m, "name").where("doc_freq >= 5")
    return corpus.compound_hits(m, "name", words)


@query("q22_descriptors", f"""WITH {MK}, t AS (SELECT id, holder, classes, {TOKENS} AS ws FROM mk WHERE trim(name) <> ''), d AS (SELECT id, holder, classes, unnest(list_distinct(ws)) AS word, ws[1] AS head, ws[-1] AS tail, len(ws) AS n FROM t),
 b AS (SELECT word, count(*) AS doc_freq, count(*) FILTER (word = head) AS f, count(*) FILTER (word = tail) AS l, count(*) FILTER (n = 1) AS s, count(DISTINCT holder) AS holders FROM d GROUP BY word HAVING count(*) >= 8),
 p AS (SELECT a.word, count(DISTINCT b.word) AS partners FROM d a JOIN d b ON a.id = b.id AND a.word <> b.word GROUP BY a.word), c AS (SELECT word, count(DISTINCT c) AS n_classes FROM (SELECT word, unnest(classes) AS c FROM d) GROUP BY word),
 h AS (SELECT substr(word, i) AS word, count(*) AS hits FROM d, unnest(range(5, length(word) - 1)) AS r(i) WHERE length(word) >= 7 GROUP BY 1),
 r AS (SELECT word, doc_freq, f::DOUBLE / doc_freq AS first, l::DOUBLE / doc_freq AS last, s::DOUBLE / doc_freq AS single, coalesce(partners, 0) AS partners, holders, coalesce(n_classes, 0) AS n_classes, coalesce(hits, 0)::BIGINT AS hits FROM b LEFT JOIN p USING (word) LEFT JOIN c USING (word) LEFT JOIN h USING (word)),
 z AS (SELECT *, least(1.0, last / 0.45) * 0.30 + (1 - least(1.0, first / 0.25)) * 0.16 + (1 - least(1.0, single / 0.05)) * 0.10 + least(1.0, partners / greatest(doc_freq * 0.50::DOUBLE, 1)) * 0.14 + least(1.0, holders / greatest(doc_freq * 0.35::DOUBLE, 1)) * 0.12 + least(1.0, n_classes / 8.0::DOUBLE) * 0.13 + least(1.0, hits / greatest(doc_freq * 0.04::DOUBLE, 10)) * 0.15 AS raw FROM r)
 SELECT word, doc_freq, partners, holders, n_classes, hits, round(least(1.0, raw), 4)::DOUBLE AS score FROM z""")
def q22b(spark, sf):
    d = corpus.descriptors(marks(spark, sf), "name", "holder", "classes", least=8)
    return d.select("word", "doc_freq", "partners", "holders", "n_classes", "hits", "score")


# ---- ingest rules ----------------------------------------------------------------------------------------------------

FOLDERS = ["BLT_2024_05", "GZ-481_2023-02-07", "bulten_77", "APP_2024", "GAZETE_2022_13_01", "scraped_x"]


@query("x21_bulletin_folders", f"""WITH f AS (SELECT p_partkey, {FOLDERS}[p_size % 6 + 1] AS folder FROM part)
 SELECT p_partkey, CASE folder WHEN 'BLT_2024_05' THEN '2024/05' WHEN 'GZ-481_2023-02-07' THEN '481' WHEN 'bulten_77' THEN '77' WHEN 'GAZETE_2022_13_01' THEN '2022' END AS no,
 CASE folder WHEN 'BLT_2024_05' THEN DATE '2024-05-01' WHEN 'GZ-481_2023-02-07' THEN DATE '2023-02-07' END AS day FROM f""")
def x21(spark, sf):
    return read(spark, sf, "part").select("p_partkey", D.bulletin_of(picked(F.col("p_size") % 6, *FOLDERS)).alias("b")).select("p_partkey", "b.no", "b.day")


TOLD = ["Marka başvurusu geçersiz", "Tescil edildi", "İTİRAZ var", "renewed", "", "başvuru incelemede"]


@query("x22_delivered_status", f"""WITH f AS (SELECT p_partkey, {FOLDERS}[p_size % 6 + 1] AS folder, {TOLD}[p_partkey % 6 + 1] AS told, CASE WHEN p_partkey % 7 = 0 THEN '2001 5' WHEN p_partkey % 7 = 1 THEN ' YOK ' END AS reg FROM part),
 s AS (SELECT p_partkey, CASE WHEN told LIKE '%geçersiz%' THEN 'Reddedildi' WHEN told = 'Tescil edildi' THEN 'Tescil Edildi' WHEN told = 'İTİRAZ var' THEN 'İtiraz Edildi' WHEN told = 'renewed' THEN 'Yenilendi' WHEN reg = '2001 5' THEN 'Tescil Edildi'
  WHEN folder LIKE 'GZ%' OR folder LIKE '%GAZETE%' THEN 'Tescil Edildi' WHEN folder IN ('BLT_2024_05', 'bulten_77') THEN CASE WHEN folder = 'BLT_2024_05' OR contains(upper(folder), 'BULTEN') THEN 'Yayında' ELSE 'Başvuruldu' END ELSE 'Başvuruldu' END AS status, folder FROM f)
 SELECT p_partkey, CASE WHEN folder = 'GZ-481_2023-02-07' AND status = 'Tescil Edildi' THEN 'Tescil Edildi' ELSE status END AS status,
 CASE status WHEN 'Yenilendi' THEN 4 WHEN 'Tescil Edildi' THEN 3 WHEN 'Reddedildi' THEN 2 WHEN 'İtiraz Edildi' THEN 2 WHEN 'Yayında' THEN 1 ELSE 0 END AS rank,
 CASE WHEN folder IN ('APP_2024', 'scraped_x') THEN 'APP' WHEN folder LIKE 'GAZETE%' THEN 'GZ' ELSE 'BLT' END AS source FROM s""".replace("folder LIKE 'GZ%' OR", "folder LIKE 'GZ\\_%' ESCAPE '\\' OR"))
def x22(spark, sf):
    k, folder = F.col("p_partkey"), picked(F.col("p_size") % 6, *FOLDERS)
    status = ST.from_delivery(folder, picked(k % 6, *TOLD), F.when(k % 7 == 0, "2001 5").when(k % 7 == 1, " YOK "))
    p = read(spark, sf, "part").select("p_partkey", status.alias("status"), ST.source_of(folder).alias("source"))
    return p.select("p_partkey", "status", ST.rank(F.col("status")).alias("rank"), "source")


@query("x36_design_indices", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS design_index FROM events""")
def x36(spark, sf):
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("design_index"))


@query("x38_translation_bands", "SELECT p_partkey, CASE WHEN s >= 1.0 THEN 'translation_exact' WHEN s >= 0.85 THEN 'translation_high' WHEN s >= 0.6 THEN 'translation_partial' ELSE 'none' END AS band FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS s FROM part)")
def x38(spark, sf):
    return read(spark, sf, "part").select("p_partkey", S.translation_band(F.col("p_size") / F.lit(50.0)).alias("band"))


PHRASES = [("Başvuru yayını", "PUBLISHED"), ("Başvuru yayını düzeltme", "CORRECTED"), ("Red kararı", "REJECTED")]
SAID = ["BAŞVURU  yayını", "Başvuru yayını (6769 SMK)", "red", "Başvuru yayını düzeltme ilanı", "other", ""]


@query("x41_event_phrases", f"SELECT p_partkey, ['UNKNOWN', 'PUBLISHED', 'REJECTED', 'CORRECTED', 'UNKNOWN', 'UNKNOWN'][CASE WHEN p_size % 6 = 0 THEN 2 WHEN p_size % 6 = 1 THEN 2 WHEN p_size % 6 = 2 THEN 3 WHEN p_size % 6 = 3 THEN 4 ELSE 1 END] AS event_type FROM part")
def x41(spark, sf):
    said = read(spark, sf, "part").select("p_partkey", picked(F.col("p_size") % 6, *SAID).alias("said"))
    return search.phrase_types(said, spark.createDataFrame(PHRASES, "phrase string, event_type string"), "said").select("p_partkey", "event_type")


@query("x23_clean_names", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN p_name WHEN 2 THEN p_name || ' ab' WHEN 3 THEN NULL ELSE p_name END AS name, p_size % 5 IN (1, 4) AS has_number FROM part")
def x23(spark, sf):
    n = F.col("p_size") % 5
    raw = F.when(n == 0, "şekil").when(n == 1, F.concat("p_name", F.lit(" + ŞEKİL"))).when(n == 2, F.concat("p_name", F.lit("  sekıl  ab"))).when(n == 4, F.col("p_name"))
    number = F.when(n == 0, "-").when(n == 1, "2001 7").when(n == 2, " N/A ").when(n == 4, "7")
    return read(spark, sf, "part").select("p_partkey", X.clean_name(raw).alias("name"), ST.has_number(number).alias("has_number"))


@query("x27_event_severity", """SELECT event_id, CASE event_type WHEN 'click' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'view' THEN 'low' WHEN 'signup' THEN 'medium' END AS severity FROM events""")
def x27(spark, sf):
    kinds = F.create_map(*[F.lit(x) for kv in {"click": "SEIZURE", "purchase": "merger", "view": "injunction_lift", "signup": "unheard_of", "error": ""}.items() for x in kv])
    return read(spark, sf, "events").select("event_id", S.event_severity(kinds[F.col("event_type")]).alias("severity"))


@query("x30_visual_scores", """WITH s AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size / 50.0::DOUBLE END AS c, CASE WHEN p_size % 3 = 0 THEN NULL ELSE (p_size % 7) / 7.0::DOUBLE END AS d, (p_size % 5) / 5.0::DOUBLE AS o, p_size % 2 = 0 AS read FROM part),
 w AS (SELECT *, CASE WHEN c <> 0 THEN 0.45 ELSE 0 END::DOUBLE AS wc, CASE WHEN coalesce(d, 0) <> 0 THEN 0.35 ELSE 0 END::DOUBLE AS wd, CASE WHEN read THEN 0.15 ELSE 0 END::DOUBLE AS wo FROM s)
 SELECT p_partkey, CASE WHEN wc + wd + wo = 0 THEN 0 ELSE round((c * wc + coalesce(d, 0) * wd + o * wo) / (wc + wd + wo), 6) END::DOUBLE AS visual FROM w""")
def x30(spark, sf):
    s = F.col("p_size")
    clip, dino = F.when(s % 4 == 0, F.lit(0.0)).otherwise(s / F.lit(50.0)), F.when(s % 3 != 0, s % 7 / F.lit(7.0))
    return read(spark, sf, "part").select("p_partkey", F.round(S.visual_score(clip, dino, s % 5 / F.lit(5.0), s % 2 == 0), 6).alias("visual"))


@query("w2_canonical_holders", "SELECT p_partkey, first_value(p_partkey) OVER (PARTITION BY lower(p_name) ORDER BY CASE WHEN p_size % 9 > 0 THEN p_size END NULLS LAST, p_partkey) AS canonical FROM part")
def w2(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", X.holder_key(F.col("p_name")).alias("k"), F.when(F.col("p_size") % 9 > 0, F.col("p_size")).alias("created"))
    first = rows.first_per_key(p, ["k"], [F.asc_nulls_last("created"), F.col("p_partkey")]).select("k", F.col("p_partkey").alias("canonical"))
    return p.join(first, "k").select("p_partkey", "canonical")


#: Logo signals of a mark: odd divisors keep totals off the borders of rounding.
SIGNALS = "sg AS (SELECT id, name, (id % 97) / 97.0::DOUBLE AS c, (id % 89) / 89.0::DOUBLE AS d, (id % 83) / 83.0::DOUBLE AS o, id % 3 > 0 AS has, id % 5 = 0 AS pa, id % 4 = 0 AS pb FROM mk)"


def signals(m: DataFrame) -> DataFrame:
    k = F.col("id")
    return m.select(
        "id", "name", (k % 97 / F.lit(97.0)).alias("clip"), (k % 89 / F.lit(89.0)).alias("dino"), (k % 83 / F.lit(83.0)).alias("ocr"),
        (k % 3 > 0).alias("has_ocr"), (k % 5 == 0).alias("plain_a"), (k % 4 == 0).alias("plain_b"),
    )


@query("q3_hybrid_risk", f"""WITH RECURSIVE {MK}, {SIGNALS}, pr AS (SELECT id, 'Ander the thing' AS a, name AS b FROM mk), {STATISTICS}, {SCORED},
 tx AS (SELECT scored.*, name, c, d, o, pa, pb, has, greatest(score, tri, o) AS e FROM scored JOIN sg USING (id)),
 rw AS (SELECT *, coalesce((0.45::DOUBLE * c + 0.35::DOUBLE * d + CASE WHEN has THEN 0.15::DOUBLE * o ELSE 0 END) / nullif(CASE WHEN c <> 0 THEN 0.45 ELSE 0 END::DOUBLE + CASE WHEN d <> 0 THEN 0.35 ELSE 0 END::DOUBLE + CASE WHEN has THEN 0.15 ELSE 0 END::DOUBLE, 0), 0) AS raw FROM tx),
 gu AS (SELECT *, round(CASE WHEN (pa OR pb) AND e < 0.78 AND raw > lim THEN round(lim, 4) ELSE raw END, 6) AS v, o >= 0.78 AS so, o >= 0.78 OR (c >= 0.9 AND d >= 0.9) AS sure
  FROM (SELECT *, CASE WHEN pa AND pb THEN 0.35::DOUBLE + 0.10::DOUBLE * least(1, e / 0.78::DOUBLE) ELSE 0.45::DOUBLE + 0.10::DOUBLE * least(1, e / 0.78::DOUBLE) END AS lim FROM rw)),
 fl AS (SELECT *, weak AND v > 0 AS w, limited AND v > 0 AND (v < 0.8 OR NOT sure) AS l, short AND v > 0 AND NOT sure AS s FROM gu),
 bs AS (SELECT *, CASE WHEN w THEN 0 ELSE score END AS t FROM fl),
 tt AS (SELECT *, round(least(1, greatest(t, v) + CASE WHEN l OR s OR v < round(raw, 6) THEN 0 WHEN least(t, v) >= 0.40 THEN least(0.08::DOUBLE, least(t, v) * 0.10::DOUBLE) ELSE least(0.03::DOUBLE, least(t, v) * 0.05::DOUBLE) END), 4) AS t0 FROM bs),
 wk AS (SELECT *, CASE WHEN NOT w THEN t0 WHEN v < 0.8 THEN least(t0, round(0.20::DOUBLE + 0.25::DOUBLE * v / 0.8::DOUBLE, 4)) WHEN v < 0.9 AND NOT so THEN least(t0, round(0.55::DOUBLE + 0.14::DOUBLE * (v - 0.8::DOUBLE) / 0.1::DOUBLE, 4))
  WHEN v >= 0.9 AND NOT sure THEN least(t0, round(0.66::DOUBLE + 0.03::DOUBLE * (v - 0.9::DOUBLE) / 0.1::DOUBLE, 4)) ELSE t0 END AS t1 FROM tt),
 lm AS (SELECT *, CASE WHEN NOT l THEN t1 WHEN v < 0.8 THEN least(t1, round(0.58::DOUBLE + 0.08::DOUBLE * v / 0.8::DOUBLE, 4)) ELSE least(t1, round(0.62::DOUBLE + 0.07::DOUBLE * (v - 0.8::DOUBLE) / 0.2::DOUBLE, 4)) END AS t2 FROM wk),
 fi AS (SELECT *, CASE WHEN s THEN least(t2, 0.58::DOUBLE) ELSE t2 END AS total FROM lm)
 SELECT id, score AS text, v AS visual, total, {RISK.replace('score', 'total')} AS risk_level FROM fi""")
def q3(spark, sf):
    """Every mark against one: the names' score and the logos', under the guards that tie one to the other. SQL has no sounds."""
    pairs = signals(marks(spark, sf)).withColumn("query", F.lit("Ander the thing"))
    scored = scoring.score_pairs(pairs, "query", "name", corpus.word_statistics(read(spark, sf, "documents"), "text"), sounds=False)
    return scoring.hybrid_risk(scored, "query", "name").select("id", F.col("score").alias("text"), "visual", "total", "risk_level")


@query("q3_hybrid_risk_by_sound")
def q3_sound(spark, sf):
    """As q3_hybrid_risk, words and names matching by sound, too; sound codes have no form in SQL."""
    pairs = signals(marks(spark, sf)).withColumn("query", F.lit("Ander the thing"))
    scored = scoring.score_pairs(pairs, "query", "name", corpus.word_statistics(read(spark, sf, "documents"), "text"))
    return scoring.hybrid_risk(scored, "query", "name").select("id", F.col("score").alias("text"), "path", "visual", "total", "risk_level")


@query("x14_multilevel_similarity", f"""WITH RECURSIVE {MK}, pr AS (SELECT row_number() OVER () AS id, 'Ander the thing' AS a, name AS b FROM (SELECT DISTINCT name FROM mk WHERE name <> '')), {STATISTICS}, {SCORED} SELECT a AS query, b AS name, level AS similarity FROM lv""")
def x14(spark, sf):
    """Every distinct name against one, its words weighed by their class in the corpus."""
    names = marks(spark, sf).select("name").where("name <> ''").distinct().withColumn("query", F.lit("Ander the thing"))
    return scoring.multilevel(names, "query", "name", corpus.word_statistics(read(spark, sf, "documents"), "text"))


@query("x10_difference_ratios", f"""WITH RECURSIVE {MK}, n AS (SELECT DISTINCT name, {NORM_TR.format('name')} AS x FROM mk), sp AS MATERIALIZED (SELECT x, 'serle ander' AS y FROM n UNION SELECT x, 'and er' FROM n UNION SELECT replace(x, ' ', ''), 'ander' FROM n), {BLOCKS},
 o AS (SELECT name, n.x, a.r AS ratio, greatest(b.r, c.r) AS best, length(replace(n.x, ' ', '')) AS l FROM n JOIN ra a ON a.x = n.x AND a.y = 'serle ander' JOIN ra b ON b.x = n.x AND b.y = 'and er' JOIN ra c ON c.x = replace(n.x, ' ', '') AND c.y = 'ander')
 SELECT name, round(ratio, 6) AS ratio, CASE WHEN l = 0 THEN 0 WHEN replace(x, ' ', '') = 'ander' THEN 1 ELSE round(least(best, 0.68::DOUBLE, CASE WHEN least(l, 5)::DOUBLE / greatest(l, 5) < 0.60 THEN 0.62 ELSE 1 END::DOUBLE), 4) END::DOUBLE AS ocr FROM o""")
def x10(spark, sf):
    """Matching blocks of every name with one, and its likeness to a text read from a logo."""
    names = marks(spark, sf).select("name").distinct()
    ratio = F.round(P.difference_ratio(X.normalize(F.col("name")), F.lit("serle ander")), 6)
    return names.select("name", ratio.alias("ratio"), P.ocr_similarity(F.col("name"), F.lit("and er")).alias("ocr"))


#: Statistics of the marks' own words, their profile included, as words of eight marks or more have it.
PROFILE = f"""tk AS (SELECT id, holder, classes, {TOKENS} AS ws FROM mk WHERE trim(name) <> ''), dd AS (SELECT id, holder, classes, unnest(list_distinct(ws)) AS word, ws[1] AS head, ws[-1] AS tail, len(ws) AS n FROM tk),
 bs AS (SELECT word, count(*) AS df, count(*) FILTER (word = head) AS f, count(*) FILTER (word = tail) AS l, count(*) FILTER (n = 1) AS s, count(DISTINCT holder) AS holders FROM dd GROUP BY word),
 pn AS (SELECT a.word, count(DISTINCT b.word) AS partners FROM dd a JOIN dd b ON a.id = b.id AND a.word <> b.word GROUP BY a.word), cn AS (SELECT word, count(DISTINCT c) AS n_classes FROM (SELECT word, unnest(classes) AS c FROM dd) GROUP BY word),
 hn AS (SELECT substr(word, i) AS word, count(*) AS hits FROM dd, unnest(range(5, length(word) - 1)) AS r(i) WHERE length(word) >= 7 GROUP BY 1),
 rt0 AS (SELECT word, df, f::DOUBLE / df AS first, l::DOUBLE / df AS last, s::DOUBLE / df AS single, coalesce(partners, 0) AS partners, holders, coalesce(n_classes, 0) AS n_classes, coalesce(hits, 0)::BIGINT AS hits FROM bs LEFT JOIN pn USING (word) LEFT JOIN cn USING (word) LEFT JOIN hn USING (word) WHERE df >= 8),
 zs AS (SELECT *, round(least(1.0, least(1.0, last / 0.45) * 0.30 + (1 - least(1.0, first / 0.25)) * 0.16 + (1 - least(1.0, single / 0.05)) * 0.10 + least(1.0, partners / greatest(df * 0.50::DOUBLE, 1)) * 0.14 + least(1.0, holders / greatest(df * 0.35::DOUBLE, 1)) * 0.12 + least(1.0, n_classes / 8.0::DOUBLE) * 0.13
   + least(1.0, hits / greatest(df * 0.04::DOUBLE, 10)) * 0.15), 4)::DOUBLE AS score, last >= 0.45 AS s1, first <= 0.25 AS s2, single <= 0.05 AS s3, last >= 0.15 AND partners >= greatest(80, floor(df * 0.45)) AND holders >= greatest(50, floor(df * 0.30)) AND n_classes >= 8 AS s4, hits >= greatest(15, floor(df * 0.02)) AS s5 FROM rt0),
 st AS MATERIALIZED (SELECT word, CASE WHEN bs.df::DOUBLE / n > 0.005 THEN 'generic' WHEN bs.df::DOUBLE / n > 0.001 THEN 'semi_generic' ELSE 'distinctive' END AS cls, round(ln(n::DOUBLE / bs.df), 4) AS idf, bs.df AS doc_freq, first, last, single, s1::INT + s2::INT + s3::INT + s4::INT + s5::INT AS signals, score,
   score >= 0.72 AND s2 AND s3 AND (s1 OR s4 OR s5) AS descr FROM bs LEFT JOIN zs USING (word), (SELECT count(*) AS n FROM tk))"""


@query("q3_caps", f"""WITH RECURSIVE {MK}, pr AS (SELECT id, 'Ander tion, the thingen' AS a, name AS b FROM mk), {PROFILE}, {SCORED}
 SELECT id, score, path, {", ".join(f"list_contains(caps, '{c}') AS {c}" for c in scoring.NAMED_CAPS)} FROM scored""")
def q3_caps(spark, sf):
    """Every mark against one by the profile of the marks' own words: the score, and a column for each cap."""
    m = marks(spark, sf)
    stats = corpus.lexical_statistics(m, "name", "holder", "classes", least=8)
    scored = scoring.score_pairs(m.withColumn("query", F.lit("Ander tion, the thingen")), "query", "name", stats, sounds=False)
    return scored.select("id", "score", "path", *[F.array_contains("caps", c).alias(c) for c in scoring.NAMED_CAPS])


@query("x12_word_roles", f"""WITH RECURSIVE {MK}, pr AS (SELECT id, name AS a, name AS b FROM mk), {PROFILE}, {SCORED} SELECT rl.word, role, rl.cls AS word_class, array_to_string(parts, '+') AS parts FROM sgm JOIN rl USING (word)""")
def x12(spark, sf):
    """Every word of the marks: its role, its class (of its stem, if it has none of its own), and the parts of glued words."""
    m = marks(spark, sf)
    stats = cut(corpus.lexical_statistics(m, "name", "holder", "classes", least=8))  # read by each lookup
    words = m.select(F.explode(F.split(X.normalize(F.col("name")), " ", -1)).alias("word")).where("word <> ''").distinct()
    return lexicon.segmented(words, stats).select("word", "role", F.col("class").alias("word_class"), F.array_join(F.transform("parts", lambda p: p["t"]), "+").alias("parts"))


@query("x11_stemmed_classes", f"""WITH {MK}, {STATISTICS}, ws AS (SELECT DISTINCT unnest(string_split({NORM_TR.format('name')}, ' ')) || e AS word FROM mk, unnest(['', 'leri', 'in', 'si', 'ya']) AS u(e) WHERE trim(name) <> ''), {lookup_sql('rl', 'ws')} SELECT word, cls AS word_class, role FROM rl""")
def x11(spark, sf):
    """Words of the marks under five endings: the class of the first stem that the corpus knows."""
    words = marks(spark, sf).where(F.trim("name") != "").select(F.explode(F.split(X.normalize(F.col("name")), " ", -1)).alias("w")).select(F.explode(F.array(*[F.concat("w", F.lit(e)) for e in ("", "leri", "in", "si", "ya")])).alias("word")).distinct()
    return lexicon.roles(words, corpus.word_statistics(read(spark, sf, "documents"), "text")).select("word", F.col("class").alias("word_class"), "role")


@query("q3_image_only", f"""WITH {MK}, {SIGNALS}, n AS (SELECT *, greatest(c, d) AS hi, CASE WHEN c > 0 AND d > 0 THEN least(c, d) ELSE greatest(c, d) END AS lo, CASE WHEN c > 0 AND d > 0 THEN (c + d) / 2 ELSE c + d END AS mean, greatest(c, d, o) AS v FROM sg)
 SELECT id, round(CASE WHEN hi = 0 OR has AND pa THEN v WHEN c > 0 AND d > 0 AND lo >= 0.88 AND mean >= 0.88 THEN v
  WHEN c > 0 AND d > 0 AND NOT pb AND ((hi >= 0.84 AND lo >= 0.72 AND mean >= 0.78) OR (hi >= 0.81 AND lo >= 0.74 AND mean >= 0.765 AND hi - lo <= 0.10)) THEN least(v, 0.84::DOUBLE)
  ELSE least(v, 0.50::DOUBLE + 0.18::DOUBLE * (0.5::DOUBLE * least(1, mean / 0.88::DOUBLE) + 0.4::DOUBLE * least(1, lo / 0.88::DOUBLE) + 0.1::DOUBLE * least(1, o / 0.78::DOUBLE))) END, 4) AS visual FROM n""")
def q3b(spark, sf):
    c, d, o = F.col("clip"), F.col("dino"), F.col("ocr")
    guarded = V.image_only(F.greatest(c, d, o), c, d, o, F.col("has_ocr") & F.col("plain_a"), ~F.col("plain_b"))
    return signals(marks(spark, sf)).select("id", F.round(guarded, 4).alias("visual"))


_CLASSES = "[CASE WHEN id % 31 = 0 THEN 99 ELSE classes[1] END, classes[2]]"
_FULL = "CASE WHEN list_contains({0}, 99) THEN range(1, 46) ELSE {0} END"
_SHARED = "CASE WHEN list_contains(wc, 99) OR list_contains(mc, 99) THEN list_distinct(wc || mc) ELSE list_intersect(list_distinct(wc), mc) END"


#: New marks of a month, and marks that stand.
LIVE = """nw AS (SELECT * FROM wm WHERE section = 'published' AND day BETWEEN DATE '2020-01-01' AND DATE '2020-01-31'), lv0 AS (SELECT * FROM wm WHERE section IN ('registered', 'changes') AND day + INTERVAL 120 MONTH >= DATE '2030-06-01' - 183)"""


def with_all(m: DataFrame) -> DataFrame:
    """Marks of which some bear class 99."""
    return m.withColumn("classes", F.array(F.when(F.col("id") % 31 == 0, 99).otherwise(F.get("classes", F.lit(0))), F.get("classes", F.lit(1))))


@query("q12_watch_scan", f"""WITH RECURSIVE {MK}, wm AS (SELECT *, {_CLASSES} AS c FROM mk), {PROFILE},
 g AS MATERIALIZED (SELECT name, replace({NORM_TR.format('name')}, ' ', '') AS cn, {TRIGRAMS.format('name')} AS g FROM (SELECT DISTINCT name FROM mk)),
 wn AS (SELECT DISTINCT name FROM mk WHERE holder = 'src3'), sw AS (SELECT DISTINCT unnest(string_split({NORM_TR.format('name')}, ' ')) AS word FROM mk WHERE trim(name) <> ''),
 pr AS (SELECT row_number() OVER () AS id, a.name AS a, b.name AS b FROM wn a, (SELECT DISTINCT name FROM mk WHERE section = 'published') b), {SCORED},
 ck AS (SELECT pr.a, pr.b, score, path FROM scored JOIN pr USING (id) JOIN hd ON hd.a = pr.a AND hd.b = pr.b JOIN g x ON x.name = pr.a JOIN g y ON y.name = pr.b
  WHERE score >= 0.5 AND ((x.cn = y.cn AND x.cn <> '') OR len(list_filter(hd.q, lambda u: u.role <> 'generic' AND len(list_filter(hd.t, lambda v: v.role <> 'generic' AND (v.t = u.t OR (starts_with(v.t, u.t) AND length(v.t) - length(u.t) >= 3)))) > 0)) > 0
   OR coalesce(len(list_intersect(x.g, y.g))::DOUBLE / nullif(len(list_distinct(x.g || y.g)), 0), 0) >= 0.3)),
 pp AS (SELECT w.id AS watch_id, m.id AS mark_id, score, path, w.c AS wc, m.c AS mc FROM wm w JOIN ck ON ck.a = w.name JOIN wm m ON m.name = ck.b AND m.section = 'published' AND w.holder = 'src3' AND w.holder <> m.holder AND w.application_no <> m.application_no AND list_has_any({_FULL.format('w.c')}, {_FULL.format('m.c')}))
 SELECT watch_id, mark_id, score, path, {RISK} AS risk_level, 'TEXT' AS conflict_type, array_to_string(list_sort({_SHARED}), ',') AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY watch_id ORDER BY score DESC, mark_id) AS r FROM pp) WHERE r <= 10""")
def q12_scan(spark, sf):
    """One organisation's marks against those just published, by the pair scorer."""
    m = with_all(marks(spark, sf))
    stats = corpus.lexical_statistics(m, "name", "holder", "classes", least=8)
    watch = m.where("holder = 'src3'").withColumnRenamed("id", "watch_id")
    found = scan.name_conflicts(watch, m.where("section = 'published'").withColumnRenamed("id", "mark_id"), stats, k=10, sounds=False)
    return found.withColumn("overlap", F.array_join("overlap", ","))


@query("q13_conflict_scan", f"""WITH RECURSIVE {MK}, wm AS (SELECT *, {_CLASSES} AS c FROM mk), {STATISTICS}, {LIVE},
 g AS MATERIALIZED (SELECT name, replace({NORM_TR.format('name')}, ' ', '') AS cn, {TRIGRAMS.format('name')} AS g FROM (SELECT DISTINCT name FROM mk)),
 pr AS (SELECT row_number() OVER () AS id, a.name AS a, b.name AS b FROM (SELECT DISTINCT name FROM nw) a, (SELECT DISTINCT name FROM lv0) b), {SCORED},
 ck AS (SELECT pr.a, pr.b, score, path FROM scored JOIN pr USING (id) JOIN hd ON hd.a = pr.a AND hd.b = pr.b JOIN g x ON x.name = pr.a JOIN g y ON y.name = pr.b
  WHERE score >= 0.5 AND ((x.cn = y.cn AND x.cn <> '') OR len(list_filter(hd.q, lambda u: u.role <> 'generic' AND len(list_filter(hd.t, lambda v: v.role <> 'generic' AND (v.t = u.t OR (starts_with(v.t, u.t) AND length(v.t) - length(u.t) >= 3)))) > 0)) > 0
   OR coalesce(len(list_intersect(x.g, y.g))::DOUBLE / nullif(len(list_distinct(x.g || y.g)), 0), 0) >= 0.3)),
 pp AS (SELECT w.id AS watch_id, m.id AS mark_id, score, w.c AS wc, m.c AS mc, m.section FROM nw w JOIN ck ON ck.a = w.name JOIN lv0 m ON m.name = ck.b AND w.holder <> m.holder AND w.application_no <> m.application_no AND list_has_any({_FULL.format('w.c')}, {_FULL.format('m.c')}))
 SELECT watch_id, mark_id, score, {RISK} AS risk_level, concat_ws('; ', CASE WHEN score >= 0.8 THEN 'similar text' END, 'classes ' || array_to_string(list_sort({_SHARED}), ','), CASE WHEN section = 'registered' THEN 'registered' END) AS reasons
 FROM (SELECT *, row_number() OVER (PARTITION BY watch_id ORDER BY score DESC, mark_id) AS r FROM pp) WHERE r <= 20""")
def q13_scan(spark, sf):
    """Marks whose publication falls in one month against all that stand, not expired by more than the grace of six months."""
    m = with_all(marks(spark, sf))
    new = m.where((F.col("section") == "published") & F.col("day").between(F.lit("2020-01-01"), F.lit("2020-01-31"))).withColumnRenamed("id", "watch_id")
    standing = m.where(F.col("section").isin("registered", "changes") & (F.add_months("day", 120) >= F.date_sub(F.lit("2030-06-01").cast("date"), 183)))
    found = scan.name_conflicts(new, standing.withColumnRenamed("id", "mark_id"), corpus.word_statistics(read(spark, sf, "documents"), "text"), sounds=False)
    registered = standing.select(F.col("id").alias("mark_id"), (F.col("section") == "registered").alias("registered"))
    told = found.join(registered, "mark_id")
    return told.select("watch_id", "mark_id", "score", "risk_level", scan.reasons(F.col("score"), F.col("overlap"), F.col("registered")).alias("reasons"))


# ---- feeds -----------------------------------------------------------------------------------------------------------

EV = "ev AS (SELECT event_id, user_id AS id, CASE event_type WHEN 'click' THEN 'cancellation' WHEN 'purchase' THEN 'transfer' WHEN 'error' THEN 'bankruptcy' WHEN 'view' THEN 'merger' ELSE 'renewal' END AS event_type, CAST(ts AS DATE) AS event_date FROM events)"


def mark_events(spark, sf):
    kinds = F.create_map(*[F.lit(x) for kv in {"click": "cancellation", "purchase": "transfer", "error": "bankruptcy", "view": "merger", "signup": "renewal"}.items() for x in kv])
    return read(spark, sf, "events").select("event_id", F.col("user_id").alias("id"), kinds[F.col("event_type")].alias("event_type"), F.col("ts").cast("date").alias("event_date"))


def _feed(name: str, kinds: list[str], months: int, day: str = AS_OF):
    listed = ", ".join(f"'{k}'" for k in kinds)

    @query(name, f"""WITH {TM}, {EV} SELECT event_id, id, name, holder, event_type, event_date, date_diff('day', event_date, DATE '{day}') AS days_since FROM ev JOIN tm USING (id) WHERE event_type IN ({listed}) AND event_date >= CAST(DATE '{day}' - INTERVAL {months} MONTH AS DATE)""")
    def feed(spark, sf):
        found = search.lead_feed(mark_events(spark, sf), trademarks(spark, sf).select("id", "name", "holder"), kinds, F.lit(day).cast("date"), months)
        return found.select("event_id", "id", "name", "holder", "event_type", "event_date", "days_since")

    return feed


_feed("q16_cancellation_feed", ["cancellation"], 12)
_feed("q16_transfer_feed", ["transfer", "merger", "partial_transfer"], 12, "2025-01-15")
_feed("q16_bankruptcy_feed", ["bankruptcy"], 24)


@query("q16_renewal_feed", f"""WITH {TM}, x AS (SELECT id, status, CASE WHEN month(applied) = 2 AND day(applied) = 29 THEN applied + 3652 ELSE CAST(applied + INTERVAL 120 MONTH AS DATE) END AS expires FROM tm WHERE status IN ('Tescil Edildi', 'Yenilendi'))
 SELECT id, expires, CASE WHEN n < 0 THEN 'grace' WHEN n <= 90 THEN 'critical' WHEN n <= 180 THEN 'urgent' WHEN n <= 365 THEN 'upcoming' ELSE 'later' END AS urgency FROM (SELECT *, date_diff('day', DATE '{AS_OF}', expires) AS n FROM x) WHERE expires BETWEEN CAST(DATE '{AS_OF}' - INTERVAL 6 MONTH AS DATE) AND CAST(DATE '{AS_OF}' + INTERVAL 12 MONTH AS DATE)""")
def q16b(spark, sf):
    t = trademarks(spark, sf).where(F.col("status").isin(ST.REGISTERED, ST.RENEWED)).select("id", D.expiry(F.col("applied"), 0).alias("expires"))
    t = t.where(F.col("expires").between(F.add_months(as_of(), -6), F.add_months(as_of(), 12)))
    return t.withColumn("urgency", D.renewal_urgency(F.datediff("expires", as_of())))


@query("j3_events_with_holders", f"WITH {TM}, {EV} SELECT event_id, id, s_name FROM ev JOIN tm USING (id) LEFT JOIN supplier ON s_suppkey = id % 100")
def j3(spark, sf):
    s = read(spark, sf, "supplier").select((F.col("s_suppkey")).alias("h"), "s_name")
    e = mark_events(spark, sf).join(trademarks(spark, sf).select("id"), "id").withColumn("h", F.col("id") % 100)
    return e.join(s, "h", "left").select("event_id", "id", "s_name")


WATCH = "w AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 40 END AS holder_id, CASE WHEN c_custkey % 3 = 1 THEN 'T' || (c_custkey % 55) END AS client_id, CASE WHEN c_custkey % 3 = 2 THEN upper('Supplier ' || (c_custkey % 30)) END AS holder_name FROM customer WHERE c_nationkey = 3)"
PH = "ph AS (SELECT DISTINCT l_partkey AS patent_id, l_suppkey AS holder_id, 'T' || l_suppkey AS client_id, 'Supplier ' || l_suppkey AS name FROM lineitem)"


def patent_watch(spark, sf):
    k = F.col("c_custkey")
    watch = read(spark, sf, "customer").where("c_nationkey = 3").select(
        F.when(k % 3 == 0, k % 40).alias("holder_id"), F.when(k % 3 == 1, F.concat(F.lit("T"), (k % 55).cast("string"))).alias("client_id"), F.when(k % 3 == 2, F.upper(F.concat(F.lit("Supplier "), (k % 30).cast("string")))).alias("holder_name")
    )
    s = F.col("l_suppkey")
    holders = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("patent_id"), s.alias("holder_id"), F.concat(F.lit("T"), s.cast("string")).alias("client_id"), F.concat(F.lit("Supplier "), s.cast("string")).alias("name")).distinct()
    return watch, holders


@query("q17_patent_leads", f"""WITH {EV}, {WATCH}, {PH} SELECT event_id, id AS patent_id FROM ev WHERE event_type IN ('cancellation', 'bankruptcy') AND EXISTS (SELECT 1 FROM ph, w WHERE ph.patent_id = ev.id AND (w.holder_id = ph.holder_id OR w.client_id = ph.client_id OR lower(w.holder_name) = lower(ph.name)))""")
def q17(spark, sf):
    watch, holders = patent_watch(spark, sf)
    events = mark_events(spark, sf).withColumnRenamed("id", "patent_id")
    return search.patent_leads(events, holders, watch, ["cancellation", "bankruptcy"]).select("event_id", "patent_id")


@query("q17_lead_summary", f"WITH {EV} SELECT count(*) FILTER (event_type IN ('cancellation', 'bankruptcy')) AS lapsed, count(*) FILTER (event_type IN ('transfer', 'merger')) AS moved, count(*) FILTER (event_type = 'renewal') AS renewed FROM ev")
def q17b(spark, sf):
    k = F.col("event_type")
    return feeds.counts_where(mark_events(spark, sf), [], {"lapsed": k.isin("cancellation", "bankruptcy"), "moved": k.isin("transfer", "merger"), "renewed": k == "renewal"})


def _portfolio(name: str, column: str, wanted: str):
    @query(name, f"WITH {MK} SELECT id, application_no, day FROM mk WHERE regexp_replace(regexp_replace(lower({column}), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g') = '{wanted.lower()}' ORDER BY day DESC, id LIMIT 30")
    def portfolio(spark, sf):
        mine = marks(spark, sf).where(X.holder_key(F.col(column)) == X.holder_key(F.lit(wanted)))
        return rows.page(mine.select("id", "application_no", "day"), [F.desc("day"), F.col("id")], 30)

    return portfolio


_portfolio("q18_holder_records", "holder", "Src1")
_portfolio("q18_attorney_records", "section", "Published")
_portfolio("q18_agent_records", "lang", "DE")


@query("q18_inventor_records", "SELECT DISTINCT p_partkey AS id, p_name FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE lower(s_name) = (SELECT lower(min(s_name)) FROM supplier)")
def q18b(spark, sf):
    s = read(spark, sf, "supplier")
    first = s.agg(F.lower(F.min("s_name")).alias("wanted"))  # one row
    mine = s.crossJoin(F.broadcast(first)).where(F.lower("s_name") == F.col("wanted")).select(F.col("s_suppkey").alias("l_suppkey"))
    lines = read(spark, sf, "lineitem").select("l_partkey", "l_suppkey").join(mine, "l_suppkey", "left_semi")
    return read(spark, sf, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select(F.col("p_partkey").alias("id"), "p_name")


@query("q18_designer_records", f"WITH {MK} SELECT id FROM mk WHERE list_contains(list_transform([name, holder], lambda x: regexp_replace(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g')), 'src2')")
def q18c(spark, sf):
    names = F.transform(F.array("name", "holder"), X.holder_key)
    return marks(spark, sf).where(F.array_contains(names, X.holder_key(F.lit("SRC2.")))).select("id")


@query("q14_reference_watch", f"WITH {MK} SELECT DISTINCT c_custkey AS watch_id, id FROM customer JOIN mk ON c_custkey IN (id // 2, id // 3, id + 5)")
def q14b(spark, sf):
    k = F.col("id")
    r = marks(spark, sf).select("id", F.floor(k / 2).alias("existing_registration_no"), F.floor(k / 3).alias("registration_no"), (k + 5).alias("reference_no"))
    watch = read(spark, sf, "customer").select(F.col("c_custkey").alias("watch_id"), F.col("c_custkey").alias("watched_no"))
    return search.watched_references(watch, r)


@query("q14_region_watch", f"""WITH {MK}, {NAME_GRAMS} SELECT id FROM g WHERE contains(n, 'and') OR {jaccard_sql('g', 'r')} > 0.2""")
def q14c(spark, sf):
    n = X.normalize(F.col("name"))
    return marks(spark, sf).where(search.gi_filter(F.col("section"), F.col("lang"), n, F.col("day"), region="and", admin=True)).select("id")


@query("f10_visible_alerts", f"WITH {TM} SELECT id FROM tm WHERE id % 3 <> 0 OR (deadline >= DATE '{AS_OF}' AND status = 'Yayında')")
def f10(spark, sf):
    kind = F.when(F.col("id") % 3 == 0, "similarity").otherwise("event")
    return trademarks(spark, sf).where(D.alert_visible(kind, F.col("deadline"), F.col("status"), F.lit(None).cast("string"), as_of())).select("id")


@query("f13_goods", "SELECT p_partkey FROM part WHERE p_size % 4 NOT IN (0, 1, 2)")
def f13(spark, sf):
    return read(spark, sf, "part").where(X.goods_present(picked(F.col("p_size") % 4, "[]", "null", None, '["x"]'))).select("p_partkey")


# ---- hydrate, pages, counts ----------------------------------------------------------------------------------------------


@query("j20_hydrate", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50)")
def j20(spark, sf):
    line = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    keys = line.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(50).select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(F.broadcast(keys), "o_orderkey", "left_semi")


@query("a12_page_with_total", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def a12(spark, sf):
    done = read(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return search.numbered_page(done, [F.desc("o_totalprice"), F.col("o_orderkey")], 20, 40)


@query("a20_watch_report", f"WITH {TM}, {EV} SELECT holder, count(*) AS n_alerts, count(*) FILTER (event_type = 'cancellation') AS n_severe, count(DISTINCT id) AS n_marks, max(event_date) AS last_date FROM ev JOIN tm USING (id) GROUP BY holder")
def a20(spark, sf):
    e = mark_events(spark, sf).join(trademarks(spark, sf).select("id", "holder"), "id")
    return e.groupBy("holder").agg(F.count("*").alias("n_alerts"), F.count_if(F.col("event_type") == "cancellation").alias("n_severe"), F.count_distinct("id").alias("n_marks"), F.max("event_date").alias("last_date"))


RECON = "a AS (SELECT p_partkey AS k, p_brand AS t FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS k, p_brand AS t FROM part WHERE p_partkey % 2 = 0), m AS (SELECT k, coalesce(a.t, b.t) AS t, CASE WHEN a.t IS NULL THEN 'PDF' WHEN b.t IS NULL THEN 'CD' ELSE 'BOTH' END AS f FROM a FULL JOIN b USING (k))"


@query("a22_reconcile_stats", f"WITH {RECON} SELECT t AS record_type, count(*) FILTER (f = 'BOTH') AS n_both, count(*) FILTER (f = 'CD') AS n_cd, count(*) FILTER (f = 'PDF') AS n_pdf FROM m GROUP BY t")
def a22(spark, sf):
    k, p = F.col("p_partkey"), read(spark, sf, "part")
    a, b = p.where(k % 3 != 0).select(k.alias("k"), F.col("p_brand").alias("t")), p.where(k % 2 == 0).select(k.alias("k"), F.col("p_brand").alias("t"))
    f = F.col("source_format")
    return feeds.counts_where(merge.reconcile(a, b, "k", []).withColumnRenamed("t", "record_type"), ["record_type"], {"n_both": f == "BOTH", "n_cd": f == "CD", "n_pdf": f == "PDF"})


@query("a26_admin_overview", "SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS active_users, (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-24') AS events_week, (SELECT count(DISTINCT user_id) FROM events) AS seen_users")
def a26(spark, sf):
    c = feeds.counts_where(read(spark, sf, "customer"), [], {"users": F.lit(True), "active_users": F.col("c_acctbal") > 0})
    e = read(spark, sf, "events").agg(F.count_if(F.col("ts") >= F.lit("2024-01-24").cast("timestamp")).alias("events_week"), F.count_distinct("user_id").alias("seen_users"))
    return c.crossJoin(F.broadcast(e))  # one row each


@query("a29_watched_in_all", "SELECT (SELECT count(*) FROM customer WHERE c_nationkey = 3) + (SELECT count(*) FROM supplier WHERE s_nationkey = 3) + (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') + (SELECT count(*) FROM part WHERE p_size = 7) AS total")
def a29(spark, sf):
    t = [("customer", "c_nationkey = 3"), ("supplier", "s_nationkey = 3"), ("orders", "o_orderstatus = 'P'"), ("part", "p_size = 7")]
    counts = [read(spark, sf, n).where(w).agg(F.count("*").alias("n")) for n, w in t]
    all_ = counts[0].union(counts[1]).union(counts[2]).union(counts[3])
    return all_.agg(F.sum("n").alias("total"))


# ---- sinks and repairs -----------------------------------------------------------------------------------------------------


@query("sk7_child_replace", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 1, 99.0 FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0")
def sk7(spark, sf):
    o = read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    fresh = o.where("l_orderkey % 2 = 0").select("l_orderkey", F.lit(1).alias("l_linenumber"), F.lit(99.0).alias("l_quantity"))
    return merge.replace_children(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), fresh, o, "l_orderkey")


@query("sk13_sidecar", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN upper(p_name) ELSE p_name END AS name, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN 'new.jpg' ELSE 'old.jpg' END AS image, CASE WHEN p_size % 4 = 0 AND upper(p_name) <> p_name THEN NULL ELSE 'tr' END AS name_tr, (p_size % 4 = 0 AND upper(p_name) <> p_name) OR (p_size % 3 = 0 AND p_size % 2 = 0) AS changed FROM part")
def sk13(spark, sf):
    p, size = read(spark, sf, "part"), F.col("p_size")
    records = p.select("p_partkey", F.col("p_name").alias("name"), F.lit("old.jpg").alias("image"), F.lit("tr").alias("name_tr"))
    scraped = p.where(size % 2 == 0).select("p_partkey", F.when(size % 4 == 0, F.upper("p_name")).otherwise(" - ").alias("name"), F.when(size % 3 == 0, "new.jpg").otherwise("null").alias("image"))
    return merge.sidecar(records, scraped, "p_partkey", ["image"], {"name": ["name_tr"]})


@query("q24_repair_candidates", f"WITH {TM} SELECT id, CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN 'Tescil Edildi' ELSE 'Yayında' END AS target FROM tm WHERE status = 'Başvuruldu' AND (id % 5 = 0 OR id % 7 = 0 OR id % 4 = 0)")
def q24(spark, sf):
    k, none = F.col("id"), F.lit(None).cast("string")
    t = trademarks(spark, sf).select(
        "id", "status", F.when(k % 5 == 0, "7").alias("gazette_no"), F.when(k % 7 == 0, "2001 1").otherwise(" ").alias("registration_no"), F.when(k % 4 == 0, "2024/1").alias("bulletin_no"), F.lit(None).cast("date").alias("registration_date")
    )
    target = merge.repair_status(F.col("status"), none, F.col("gazette_no"), F.col("registration_no"), F.col("bulletin_no"))
    return merge.repair_candidates(t).select("id", target.alias("target"))


@query("sk12_repair_chain", f"WITH {TM}, c AS (SELECT id FROM tm WHERE status = 'Başvuruldu' AND id % 4 = 0) SELECT (SELECT count(*) FROM c) AS candidates, (SELECT count(*) FROM tm WHERE id NOT IN (SELECT id FROM c) AND status = 'Başvuruldu') AS left_applied, (SELECT count(*) FROM tm WHERE status = 'Yayında') + (SELECT count(*) FROM c) AS published")
def sk12(spark, sf):
    """Candidates, their audit rows and the updated records, as counts of what a run would write."""
    none = F.lit(None).cast("string")
    t = trademarks(spark, sf).select("id", "status", none.alias("gazette_no"), none.alias("registration_no"), F.when(F.col("id") % 4 == 0, "2024/1").alias("bulletin_no"), F.lit(None).cast("date").alias("registration_date"))
    audit = merge.repair_candidates(t).select("id", F.lit(ST.PUBLISHED).alias("status"))
    updated = merge.upsert(t.select("id", "status"), audit, ["id"])
    after = feeds.counts_where(updated, [], {"left_applied": F.col("status") == ST.APPLIED, "published": F.col("status") == ST.PUBLISHED})
    return audit.agg(F.count("*").alias("candidates")).crossJoin(F.broadcast(after))  # one row each


@query("q27_class_repair", "WITH r AS (SELECT p_partkey FROM part WHERE p_size % 2 = 0) SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 7 ELSE 9 END AS n_classes FROM part WHERE p_partkey IN (SELECT p_partkey FROM r) AND p_size % 3 <> 0")
def q27(spark, sf):
    p, s = read(spark, sf, "part"), F.col("p_size")
    upto = lambda n: F.sequence(F.lit(1), F.lit(n))
    records = p.select("p_partkey", F.when(s % 2 == 0, upto(6)).otherwise(upto(3)).alias("classes"))
    found = p.where(s % 3 != 0)
    one = found.select("p_partkey", F.lit("BLT").alias("source"), upto(9).alias("classes"), F.lit("b").alias("folder"))
    two = found.select("p_partkey", F.lit("GZ").alias("source"), F.when(s % 4 == 0, upto(7)).otherwise(upto(5)).alias("classes"), F.lit("a").alias("folder"))
    return merge.repair_classes(records, one.union(two), "p_partkey").select("p_partkey", F.size("classes").alias("n_classes"))


@query("q26_design_reconcile", """SELECT p_partkey AS k, CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE p_brand END AS title, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 0 THEN '1:cd,2:pdf' WHEN p_partkey % 3 <> 0 THEN '1:cd' ELSE '1:pdf,2:pdf' END AS views, CASE WHEN p_partkey % 2 = 0 THEN 'hague' END AS section,
 CASE WHEN p_partkey % 3 = 0 THEN 'PDF' WHEN p_partkey % 2 = 0 THEN 'BOTH' ELSE 'CD' END AS source_format FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0""")
def q26(spark, sf):
    p, k = read(spark, sf, "part"), F.col("p_partkey")
    view = lambda n, path: F.struct(F.lit(n).alias("no"), F.lit(path).alias("path"))
    cd = p.where(k % 3 != 0).select(k.alias("k"), F.col("p_name").alias("title"), F.array(view(1, "cd")).alias("views"))
    pdf = p.where(k % 2 == 0).select(k.alias("k"), F.col("p_brand").alias("title"), F.array(view(1, "pdf"), view(2, "pdf")).alias("views"), F.lit("hague").alias("section"))
    out = merge.reconcile_designs(cd, pdf, "k", ["section"])
    return out.withColumn("views", F.array_join(F.transform("views", lambda v: F.concat_ws(":", v["no"].cast("string"), v["path"])), ","))


@query("q28_gazette_merge", """SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 AND p_size % 5 <> 0 THEN p_brand WHEN p_partkey % 3 <> 0 THEN p_name END AS title, CASE WHEN p_partkey % 3 <> 0 THEN 'pdf' ELSE 'cd' END AS section, p_partkey % 3 = 0 AS appended FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0""")
def q28(spark, sf):
    p, k = read(spark, sf, "part"), F.col("p_partkey")
    gazette = p.where(k % 3 != 0).select(k.alias("k"), F.col("p_name").alias("title"), F.lit("pdf").alias("section"))
    disc = p.where(k % 2 == 0).select(k.alias("k"), F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_brand")).alias("title"), F.lit("cd").alias("section"))
    return merge.merge_into_gazette(gazette, disc, "k", ["section"])


@query("q28_record_numbers", """WITH g AS (SELECT p_partkey AS k, p_name AS title, 'pdf' AS section, 2 * p_partkey AS record_index, 'G ' || p_brand AS gname, p_type AS firm, '2024-0' || (p_size % 9 + 1) AS gb FROM part WHERE p_partkey % 3 <> 0),
 d AS (SELECT p_partkey AS k, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS title, 'cd' AS section, CASE WHEN p_size % 7 <> 0 THEN 'D ' || p_brand END AS dname, '2024/' || (p_size % 9 + 1) AS db FROM part WHERE p_partkey % 2 = 0),
 m AS (SELECT k, coalesce(d.title, g.title) AS title, coalesce(g.section, d.section) AS section, record_index, coalesce(dname, gname) AS name, firm, CASE WHEN gb IS NULL THEN db ELSE replace(gb, '-0', '/') END AS bulletin_no FROM g FULL JOIN d USING (k))
 SELECT k, title, section, coalesce(record_index, (SELECT max(record_index) FROM g) + row_number() OVER (PARTITION BY record_index IS NULL ORDER BY k)) AS record_index, name, firm, bulletin_no FROM m""")
def q28_numbers(spark, sf):
    """Records of a disc put into the gazette's, numbered on; attorneys of both; bulletins that must agree."""
    p, k = read(spark, sf, "part"), F.col("p_partkey")
    month = (F.col("p_size") % 9 + 1).cast("string")
    gazette = p.where(k % 3 != 0).select(k.alias("k"), F.col("p_name").alias("title"), F.lit("pdf").alias("section"), (2 * k).alias("record_index"), F.struct(F.concat(F.lit("G "), "p_brand").alias("name"), F.col("p_type").alias("firm")).alias("attorney"), F.concat(F.lit("2024-0"), month).alias("bulletin_no"))
    disc = p.where(k % 2 == 0).select(k.alias("k"), F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_brand")).alias("title"), F.lit("cd").alias("section"), F.struct(F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.concat(F.lit("D "), "p_brand")).alias("name")).alias("attorney"), F.concat(F.lit("2024/"), month).alias("bulletin_no"))
    done = merge.continue_gazette(gazette, disc, "k", ["section"])
    return done.select("k", "title", "section", "record_index", "attorney.name", "attorney.firm", "bulletin_no")


@query("q14_lifecycle_watch", f"""WITH {MK}, r AS (SELECT id AS record_id, section, id // 3 AS existing, id // 5 AS registration, CAST(id // 7 AS VARCHAR) AS correction FROM mk)
 SELECT s_suppkey AS watch_id, record_id, CASE section WHEN 'corrections' THEN 'lifecycle_correction' WHEN 'registered' THEN 'lifecycle_finalized' ELSE 'lifecycle_change_request' END AS match_type
 FROM supplier JOIN r ON r.existing = s_suppkey OR r.registration = s_suppkey OR r.correction = CAST(s_suppkey AS VARCHAR)""")
def q14_lifecycle(spark, sf):
    m = marks(spark, sf)
    sections = F.create_map(*[F.lit(x) for kv in {"corrections": "corrections", "registered": "article_42_finalized", "changes": "article_42_change_requests"}.items() for x in kv])
    div = lambda n: F.expr(f"id div {n}")
    records = m.select(F.col("id").alias("record_id"), sections[F.col("section")].alias("section"), div(5).alias("registration_no"), div(3).alias("existing_registration_no"), div(7).cast("string").alias("correction_of"))
    watch = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("watch_id"), F.col("s_suppkey").alias("registration_no"))
    return scan.lifecycle_watch(watch, records)


@query("q14_state_changes", """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_custkey AS owner FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 8 <> 0 THEN o_custkey END AS owner FROM orders WHERE o_orderkey % 13 <> 0)
 SELECT k, 'came' AS change, NULL AS field, NULL AS old, NULL AS new FROM b WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT k, 'went', NULL, NULL, NULL FROM a WHERE k NOT IN (SELECT k FROM b)
 UNION ALL SELECT k, 'changed', 'status', a.status, b.status FROM a JOIN b USING (k) WHERE a.status IS DISTINCT FROM b.status UNION ALL SELECT k, 'changed', 'owner', a.owner::VARCHAR, b.owner::VARCHAR FROM a JOIN b USING (k) WHERE a.owner IS DISTINCT FROM b.owner""")
def q14_changes(spark, sf):
    """Two snapshots of states: what came, went or changed."""
    o, k = read(spark, sf, "orders"), F.col("o_orderkey")
    before = o.where(k % 11 != 0).select(k.alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"))
    after = o.where(k % 13 != 0).select(k.alias("k"), F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.when(k % 8 != 0, F.col("o_custkey")).alias("owner"))
    return scan.state_changes(before, after, "k", ["status", "owner"])


@query("q16_conflict_leads", f"""WITH {TM}, c AS (SELECT o_orderkey AS id, o_custkey % 500 AS nid, o_orderkey % 1900 AS eid, o_orderkey % 100 AS hid, '2001/' || o_orderkey % 1900 AS app, (o_orderkey * 7 % 101) / 100.0::DOUBLE AS score,
  CASE WHEN o_orderkey % 12 = 0 THEN NULL WHEN o_orderkey % 6 = 0 THEN [] ELSE [CAST(o_orderkey % 45 + 1 AS INTEGER), CAST(o_custkey % 45 + 1 AS INTEGER)] END AS cls, date_diff('day', DATE '{AS_OF}', DATE '{AS_OF}' + CAST(o_orderkey % 120 - 40 AS INTEGER)) AS n FROM orders)
 SELECT c.id, a.name AS new_mark_name, b.name AS existing_mark_name, score, array_to_string(list_sort(cls), ',') AS overlapping, n AS days_left, CASE WHEN n <= 7 THEN 'critical' WHEN n <= 14 THEN 'urgent' WHEN n <= 30 THEN 'soon' ELSE 'normal' END AS urgency
 FROM c LEFT JOIN tm a ON a.id = nid LEFT JOIN tm b ON b.id = eid WHERE n >= 0 AND n <= 30 AND score >= 0.6 AND len(cls) > 0 AND (b.applied IS NULL OR b.applied + INTERVAL 120 MONTH >= DATE '{AS_OF}' - INTERVAL 6 MONTH)
 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = hid AND s_suppkey % 3 = 0) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 2 = 0 AND '2001/' || c_custkey * 3 = app) ORDER BY n, score DESC, c.id LIMIT 50""")
def q16_leads(spark, sf):
    """Conflicts made of orders, between marks made of parts, for organisations made of suppliers."""
    o, k = read(spark, sf, "orders"), F.col("o_orderkey")
    classes = F.when(k % 12 == 0, None).when(k % 6 == 0, F.array().cast("array<int>")).otherwise(F.array((k % 45 + 1).cast("int"), (F.col("o_custkey") % 45 + 1).cast("int")))
    conflicts = o.select(
        k.alias("id"), (F.col("o_custkey") % 500).alias("new_mark_id"), (k % 1900).alias("existing_mark_id"), (k % 100).alias("existing_holder_id"), F.concat(F.lit("2001/"), (k % 1900).cast("string")).alias("existing_app_no"),
        (k * 7 % 101 / F.lit(100.0)).alias("score"), classes.alias("overlapping"), F.date_add(as_of(), (k % 120 - 40).cast("int")).alias("deadline"),
    )
    tm = trademarks(spark, sf).select("id", "name", F.add_months("applied", 120).alias("expiry"))
    organizations = read(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id"))
    watched = read(spark, sf, "customer").select(F.concat(F.lit("2001/"), (F.col("c_custkey") * 3).cast("string")).alias("application_no"), (F.col("c_custkey") % 2 == 0).alias("is_active"))
    found = feeds.conflict_leads(conflicts, tm, organizations, watched, as_of(), 0.6, "soon")
    return found.withColumns({"overlapping": F.array_join("overlapping", ","), "days_left": F.col("days_left").cast("long")})
