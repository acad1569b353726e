"""More named queries with their equals in SQL: filters, joins, aggregates, states, sinks and composites of the registries.

They add to the catalog's QUERIES and SQL; the stand-ins for registry data are those of the catalog.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import classes as C
from tessera.functions import dates as D
from tessera.functions import scores as S
from tessera.functions import status as ST
from tessera.functions import text as X
from tessera.operators import corpus, feeds, lifecycle, merge, retrieval, rows, scan, scoring
from tessera.plans.catalog import AS_OF, GRAMS, NORM, STAGED, TM, jaccard_sql, query, read, trademarks


def as_of():
    """The day of reference as a literal."""
    return F.lit(AS_OF).cast("date")


EXPANDED = "CASE WHEN list_contains(classes, 99) THEN range(1, 46) ELSE list_distinct(classes) END"
WORDS = """list_filter(string_split_regex(trim(regexp_replace(translate(lower(translate(text, 'Iİ', 'ıi')), 'ğıöüşçàáâãäåèéêëìíîïñòóôõùúûýÿ', 'giouscaaaaaaeeeeiiiinoooouuuyy'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 1)"""

# ---- filters -----------------------------------------------------------------------------------------------------


@query("f3_locarno_classes", """WITH d AS (SELECT p_partkey, [printf('%02d-%02d', p_size % 32 + 1, p_size * 7 % 10), printf('%02d-%02d', p_size * 3 % 32 + 1, p_size % 10)] AS codes FROM part)
 SELECT p_partkey FROM d WHERE list_has_any(codes, ['06', '12-03']) OR list_has_any(list_transform(codes, lambda c: split_part(c, '-', 1)), ['06', '12-03'])""")
def f3(spark, sf):
    s = F.col("p_size")
    code = lambda a, b: F.format_string("%02d-%02d", a, b)
    d = read(spark, sf, "part").select("p_partkey", F.array(code(s % 32 + 1, s * 7 % 10), code(s * 3 % 32 + 1, s % 10)).alias("codes"))
    return d.where(C.locarno_matches(F.col("codes"), ["06", "12-03"])).select("p_partkey")


@query("f4_class_and_dates", f"WITH {TM} SELECT id FROM tm WHERE list_has_any(classes, [3, 5, 30]) AND applied BETWEEN DATE '2012-01-01' AND DATE '2020-12-31'")
def f4(spark, sf):
    wanted = F.array(*[F.lit(c) for c in (3, 5, 30)])
    return trademarks(spark, sf).where(F.arrays_overlap("classes", wanted) & F.col("applied").between("2012-01-01", "2020-12-31")).select("id")


@query("f6_live_status", f"WITH {TM} SELECT id, status FROM tm WHERE status NOT IN ('Reddedildi', 'İtiraz Edildi')")
def f6(spark, sf):
    return trademarks(spark, sf).where(~F.col("status").isin("Reddedildi", "İtiraz Edildi")).select("id", "status")


@query("f7_escaped_like", "SELECT p_partkey FROM part WHERE contains(p_brand || '_50%', '_50%') AND contains(p_brand, '#1')")
def f7(spark, sf):
    marked = F.concat("p_brand", F.lit("_50%"))
    return read(spark, sf, "part").where(marked.like(f"%{X.like_escaped('_50%')}%") & F.contains("p_brand", F.lit("#1"))).select("p_partkey")


@query("f8_token_boundary", f"SELECT p_partkey FROM part WHERE contains(' ' || {NORM.format('p_name')} || ' ', ' red ')")
def f8(spark, sf):
    return read(spark, sf, "part").where(X.has_token(F.col("p_name"), "red")).select("p_partkey")


@query("f9_open_deadlines", f"WITH {TM} SELECT id FROM tm WHERE deadline >= DATE '{AS_OF}' AND status = 'Yayında'")
def f9(spark, sf):
    return trademarks(spark, sf).where(D.deadline_open(F.col("deadline"), F.lit(None).cast("string"), F.col("status"), as_of())).select("id")


@query("f12_placeholder_names", """WITH n AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN 'şekil !' WHEN p_size < 20 THEN 'şekil ' || p_name ELSE p_name END AS name FROM part)
 SELECT p_partkey FROM n WHERE regexp_replace(regexp_replace(lower(name), 'şekil|sekil', '', 'g'), '[^\\p{L}\\p{N}]', '', 'g') <> ''""")
def f12(spark, sf):
    size = F.col("p_size")
    name = F.when(size < 10, "şekil !").when(size < 20, F.concat(F.lit("şekil "), "p_name")).otherwise(F.col("p_name"))
    return read(spark, sf, "part").where(~X.is_placeholder(name)).select("p_partkey")


@query("f15_renewal_windows", f"""WITH {TM}, e AS (SELECT date_diff('day', DATE '{AS_OF}', CASE WHEN month(applied) = 2 AND day(applied) = 29 THEN applied + 3652 ELSE CAST(applied + INTERVAL 120 MONTH AS DATE) END) AS n FROM tm)
 SELECT CASE WHEN n < 0 THEN 'grace' WHEN n <= 90 THEN 'critical' WHEN n <= 180 THEN 'urgent' WHEN n <= 365 THEN 'upcoming' ELSE 'later' END AS urgency, count(*) AS n FROM e WHERE n BETWEEN -183 AND 365 GROUP BY 1""")
def f15(spark, sf):
    left = F.datediff(D.expiry(F.col("applied"), 0), as_of())
    t = trademarks(spark, sf).select(left.alias("left")).where(F.col("left").between(-183, 365))
    return t.groupBy(D.renewal_urgency(F.col("left")).alias("urgency")).agg(F.count("*").alias("n"))


@query("f18_lead_urgency", f"""WITH {TM}, d AS (SELECT date_diff('day', DATE '{AS_OF}', deadline) AS n FROM tm WHERE status = 'Yayında' AND deadline >= DATE '{AS_OF}')
 SELECT CASE WHEN n <= 7 THEN 'critical' WHEN n <= 14 THEN 'urgent' WHEN n <= 30 THEN 'soon' ELSE 'normal' END AS urgency, count(*) AS n FROM d GROUP BY 1""")
def f18(spark, sf):
    left = F.datediff("deadline", as_of())
    return trademarks(spark, sf).where((F.col("status") == "Yayında") & (left >= 0)).groupBy(D.urgency(left).alias("urgency")).agg(F.count("*").alias("n"))


# ---- joins -------------------------------------------------------------------------------------------------------


@query("j1_supplier_nation", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def j1(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return read(spark, sf, "supplier").select("s_suppkey", "s_nationkey").join(n, "s_nationkey", "left").select("s_suppkey", "n_name")


@query("j8_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000 AND o_custkey IS NOT NULL)")
def j8(spark, sf):
    large = read(spark, sf, "orders").where("o_totalprice > 300000 and o_custkey is not null").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf, "customer").select("c_custkey").join(large, "c_custkey", "left_anti")


@query("j15_share_of_total", "SELECT o_orderstatus, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY o_orderstatus")
def j15(spark, sf):
    per = read(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))  # one row
    return per.crossJoin(F.broadcast(total)).select("o_orderstatus", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("j17_canonical_names", "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY lower(p_name)) AS canonical FROM part")
def j17(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", X.holder_key(F.col("p_name")).alias("k"))
    return p.join(p.groupBy("k").agg(F.min("p_partkey").alias("canonical")), "k").select("p_partkey", "canonical")


@query("j18_link_orphans", """SELECT event_id, coalesce('supplier ' || s_suppkey, 'customer ' || c_custkey) AS linked FROM events LEFT JOIN supplier ON s_suppkey = user_id LEFT JOIN customer ON c_custkey = user_id""")
def j18(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey")
    s = read(spark, sf, "supplier").select("s_suppkey")
    e = read(spark, sf, "events").select("event_id", "user_id")
    linked = F.coalesce(F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")))
    return e.join(s, F.col("s_suppkey") == F.col("user_id"), "left").join(c, F.col("c_custkey") == F.col("user_id"), "left").select("event_id", linked.alias("linked"))


@query("j22_filter_after_top", "SELECT p_partkey FROM (SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 200) WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def j22(spark, sf):
    top = rows.page(read(spark, sf, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")], 200)
    return top.join(read(spark, sf, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey")


@query("j23_name_in_list", "SELECT p_partkey FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'gadget')")
def j23(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.split("p_name", " ", -1).alias("names"))
    return scan.portfolio(p, "names", "Gadget").select("p_partkey")


@query("j24_null_tolerant", "SELECT a.event_id FROM events a WHERE coalesce(CASE WHEN a.event_type = 'view' THEN NULL ELSE a.event_type END, '') = coalesce(CASE WHEN a.value > 50 THEN 'click' END, '')")
def j24(spark, sf):
    a, b = F.when(F.col("event_type") != "view", F.col("event_type")), F.when(F.col("value") > 50, F.lit("click"))
    return read(spark, sf, "events").where(F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))).select("event_id")


@query("j25_portfolio_semi", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 3)")
def j25(spark, sf):
    mine = read(spark, sf, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("l_suppkey"))
    lines = read(spark, sf, "lineitem").select("l_partkey", "l_suppkey").join(mine, "l_suppkey", "left_semi")
    return read(spark, sf, "part").select("p_partkey", "p_name").join(lines.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")


@query("j26_unfinished", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND (o.o_orderstatus <> 'P' OR c.c_acctbal > 5000))")
def j26(spark, sf):
    c, o = read(spark, sf, "customer").select("c_custkey", "c_acctbal"), read(spark, sf, "orders").select("o_custkey", "o_orderstatus")
    return c.join(o, (F.col("o_custkey") == F.col("c_custkey")) & ((F.col("o_orderstatus") != "P") | (F.col("c_acctbal") > 5000)), "left_anti").select("c_custkey")


# ---- aggregates ----------------------------------------------------------------------------------------------------


@query("a7_best_per_group", """WITH v AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 7)
 SELECT label, round(max(list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), q)), 5) AS similarity FROM embeddings, v WHERE embedding IS NOT NULL GROUP BY label""")
def a7(spark, sf):
    e = read(spark, sf, "embeddings")
    wanted = e.where("vec_id = 7").select("embedding").first()[0]  # one vector
    v = F.array(*[F.lit(float(x)) for x in wanted])
    return e.where("embedding is not null").groupBy("label").agg(F.round(F.max(S.cosine(F.col("embedding"), v)), 5).alias("similarity"))


@query("a9_digest_ids", "SELECT user_id, CAST(ts AS DATE) AS day, array_to_string(list(CAST(event_id AS VARCHAR) ORDER BY event_id), ',') AS ids FROM events GROUP BY ALL")
def a9(spark, sf):
    ids = F.array_sort(F.collect_list("event_id"))
    return read(spark, sf, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids"))


@query("a11_autocomplete", "SELECT p_brand, count(*) AS n FROM part WHERE lower(p_brand) LIKE 'brand#1%' GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
def a11(spark, sf):
    hit = F.lower("p_brand").like(f"{X.like_escaped('brand#1')}%")
    return read(spark, sf, "part").where(hit).groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand").limit(10)


@query("a14_word_dispersion", f"""WITH t AS (SELECT doc_id, source, {WORDS} AS ws FROM documents WHERE trim(text) <> ''), u AS (SELECT doc_id, source, len(ws) AS n, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM t),
 f AS (SELECT doc_id, source, word, max((pos = 1)::INTEGER) AS f, max((pos = n)::INTEGER) AS l, max((n = 1)::INTEGER) AS s FROM u GROUP BY ALL)
 SELECT word, count(*) AS doc_freq, sum(f)::BIGINT AS first_count, sum(l)::BIGINT AS last_count, sum(s)::BIGINT AS single_count, count(DISTINCT source) AS unique_group_count FROM f GROUP BY word HAVING count(*) >= 10""")
def a14(spark, sf):
    return corpus.dispersion(read(spark, sf, "documents"), "text", "source", 10)


@query("a14_word_partners", """WITH t AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part)
 SELECT a.w AS word, count(DISTINCT b.w) AS unique_partner_count FROM t a JOIN t b ON a.p_partkey = b.p_partkey AND a.w <> b.w WHERE length(a.w) > 1 AND length(b.w) > 1 GROUP BY a.w""")
def a14b(spark, sf):
    return corpus.partner_counts(read(spark, sf, "part"), "p_name")


@query("a18_category_counts", "SELECT count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'error' AND value > 50) AS severe, count(*) FILTER (WHERE event_type IN ('signup', 'purchase')) AS conversions FROM events")
def a18(spark, sf):
    kind = F.col("event_type")
    return feeds.counts_where(read(spark, sf, "events"), [], {"clicks": kind == "click", "severe": (kind == "error") & (F.col("value") > 50), "conversions": kind.isin("signup", "purchase")})


@query("a21_risk_levels", """SELECT CASE WHEN s >= 0.9 THEN 'critical' WHEN s >= 0.8 THEN 'very_high' WHEN s >= 0.7 THEN 'high' WHEN s >= 0.5 THEN 'medium' ELSE 'low' END AS risk_level, count(*) AS n FROM (SELECT p_size / 50.0::DOUBLE AS s FROM part) GROUP BY 1""")
def a21(spark, sf):
    return read(spark, sf, "part").groupBy(S.risk_level(F.col("p_size") / F.lit(50.0)).alias("risk_level")).agg(F.count("*").alias("n"))


@query("a24_fan_out_totals", """SELECT c_mktsegment, count(DISTINCT c_custkey) AS n_customers, count(o_orderkey) AS n_orders, count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN c_custkey END) AS n_active
 FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def a24(spark, sf):
    # counted per customer first: the join carries one row each and the totals need no distinct count
    o = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("open"))
    c = read(spark, sf, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey", "left")
    return c.groupBy("c_mktsegment").agg(
        F.count("*").alias("n_customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_orders"), F.coalesce(F.sum("open"), F.lit(0)).alias("n_open"), F.count_if(F.col("open") > 0).alias("n_active")
    )


@query("a28_status_transitions", """SELECT before, after, count(*) AS n FROM (SELECT lag(o_orderstatus) OVER w AS before, o_orderstatus AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE before <> after GROUP BY ALL""")
def a28(spark, sf):
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    moved = read(spark, sf, "orders").select(F.lag("o_orderstatus").over(order).alias("before"), F.col("o_orderstatus").alias("after"))
    return moved.where("before <> after").groupBy("before", "after").agg(F.count("*").alias("n"))


@query("a32_skip_counters", f"""WITH {TM} SELECT count(*) FILTER (WHERE applied IS NULL) AS no_date, count(*) FILTER (WHERE applied >= DATE '{AS_OF}' - INTERVAL 24 MONTH) AS recent, count(*) FILTER (WHERE applied < DATE '{AS_OF}' - INTERVAL 120 MONTH) AS older FROM tm""")
def a32(spark, sf):
    a = F.col("applied")
    return feeds.counts_where(trademarks(spark, sf), [], {"no_date": a.isNull(), "recent": a >= F.add_months(as_of(), -24), "older": a < F.add_months(as_of(), -120)})


# ---- order and state -----------------------------------------------------------------------------------------------


@query("w6_last_write", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey")
def w6(spark, sf):
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


@query("w8_best_class_evidence", f"WITH {TM} SELECT brand, id FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY CASE WHEN status = 'Tescil Edildi' THEN 0 ELSE 1 END, len(classes) DESC, id DESC) AS r FROM tm) WHERE r = 1")
def w8(spark, sf):
    t = trademarks(spark, sf).select("brand", "id", "status", F.size("classes").alias("n"))
    return rows.first_per_key(t, ["brand"], [F.when(F.col("status") == "Tescil Edildi", 0).otherwise(1), F.desc("n"), F.desc("id")]).select("brand", "id")


DESIGN_TYPES = {"signup": "renewal", "purchase": "transfer", "error": "seizure", "view": "partial_renewal", "click": "partial_provisional_injunction"}


@query("l3_design_status", f"""WITH e AS (SELECT event_id % 2000 AS application_no, CASE WHEN event_type = 'signup' THEN 'renewal' WHEN event_type = 'purchase' THEN 'transfer' WHEN event_type = 'view' THEN 'partial_renewal' WHEN value > 95 THEN 'full_cancellation_applicant' END AS k, CAST(ts AS DATE) AS d,
  CASE event_type WHEN 'error' THEN -3 WHEN 'click' THEN -3 WHEN 'purchase' THEN 2 ELSE 3 END AS r FROM events),
 l AS (SELECT application_no, list(k ORDER BY d, r, k) FILTER (k IS NOT NULL) AS ks FROM e GROUP BY application_no), s AS (SELECT application_no, coalesce(list_reduce(list_prepend('Yayında', ks), lambda s, k: CASE WHEN s = 'İptal Edildi' THEN s WHEN k IN ('renewal', 'partial_renewal') THEN 'Yenilendi' WHEN k = 'transfer' THEN 'Devredildi' ELSE 'İptal Edildi' END), 'Yayında') AS status FROM l)
 SELECT application_no, CASE WHEN status <> 'İptal Edildi' AND DATE '1990-01-01' + CAST(application_no * 97 % 9000 AS INTEGER) + 9131 < DATE '{AS_OF}' THEN 'Süresi Doldu' ELSE status END AS status FROM s""")
def l3(spark, sf):
    kind = F.col("event_type")
    design = F.when(kind.isin("error", "click") & (F.col("value") > 95), "full_cancellation_applicant").otherwise(lifecycle._lookup(DESIGN_TYPES, kind))
    e = read(spark, sf, "events").select(
        (F.col("event_id") % 2000).alias("application_no"), design.alias("event_type"), F.lit(None).cast("date").alias("event_date"), F.col("ts").cast("date").alias("bulletin_date"), F.lit(None).cast("array<int>").alias("design_indices")
    )
    k = F.col("application_no")
    designs = e.select("application_no").distinct().select(
        k, F.lit(1).alias("design_index"), F.lit("hague").alias("section"), F.date_add(F.lit("1990-01-01").cast("date"), (k * 97 % 9000).cast("int")).alias("application_date")
    )
    return lifecycle.design_status(e, designs, as_of()).select("application_no", "status")


@query("l4_orphan_reset", """SELECT c_custkey AS application_no, NULL::VARCHAR AS effective_status, 0 AS active_restriction_count, 0::BIGINT AS total_event_count FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def l4(spark, sf):
    return lifecycle.orphan_reset(read(spark, sf, "customer").select(F.col("c_custkey").alias("application_no")), read(spark, sf, "events").select(F.col("user_id").alias("application_no")))


@query("s8_timeline", """SELECT *, row_number() OVER (PARTITION BY key ORDER BY day, kind) AS seq FROM (SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS day, 'order' AS kind FROM orders UNION ALL SELECT user_id, CAST(ts AS DATE), event_type FROM events)""")
def s8(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").cast("date").alias("day"), F.lit("order").alias("kind"))
    e = read(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("date").alias("day"), F.col("event_type").alias("kind"))
    return o.unionByName(e).withColumn("seq", F.row_number().over(W.partitionBy("key").orderBy("day", "kind")).cast("long"))


@query("u1_row_counts", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'supplier', count(*) FROM supplier")
def u1(spark, sf):
    return reduce(DataFrame.unionByName, [read(spark, sf, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("customer", "orders", "supplier")])


@query("u3_class_sets", f"""WITH {TM} SELECT id, len(list_distinct(list_concat(classes, [3, 9]))) AS n_either, len(list_filter(list_distinct(classes), lambda c: c NOT IN (3, 9))) AS n_only FROM tm""")
def u3(spark, sf):
    other = F.array(F.lit(3), F.lit(9))
    return trademarks(spark, sf).select("id", F.size(F.array_union("classes", other)).cast("long").alias("n_either"), F.size(F.array_except("classes", other)).cast("long").alias("n_only"))


# ---- scalar functions ------------------------------------------------------------------------------------------------


@query("x1_turkish_lower", "SELECT p_partkey, lower(translate('ISPARTA İZMİR ' || p_brand, 'Iİ', 'ıi')) AS low FROM part")
def x1(spark, sf):
    return read(spark, sf, "part").select("p_partkey", X.turkish_lower(F.concat(F.lit("ISPARTA İZMİR "), "p_brand")).alias("low"))


@query("x20_parse_dates", """WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'P' THEN strftime(o_orderdate, '%d.%m.%Y') END AS t FROM orders)
 SELECT o_orderkey, CAST(coalesce(try_strptime(t, '%d/%m/%Y'), try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%d.%m.%Y')) AS DATE) AS day FROM s""")
def x20(spark, sf):
    o, day = F.col("o_orderstatus"), F.col("o_orderdate")
    t = F.when(o == "F", F.date_format(day, "dd/MM/yyyy")).when(o == "O", F.date_format(day, "yyyy-MM-dd")).when(o == "P", F.date_format(day, "dd.MM.yyyy"))
    return read(spark, sf, "orders").select("o_orderkey", D.parse_date(t).alias("day"))


@query("x24_client_ids", "SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS client_id, s_name AS holder FROM supplier")
def x24(spark, sf):
    full = F.concat("s_name", F.lit(" ("), F.col("s_suppkey").cast("string"), F.lit(")"))
    return read(spark, sf, "supplier").select("s_suppkey", X.client_id(full).alias("client_id"), X.without_client_id(full).alias("holder"))


@query("x28_status_weights", f"""WITH {TM}, s AS (SELECT CASE id % 9 WHEN 0 THEN 'Expired' WHEN 1 THEN 'Kısmi Red' WHEN 2 THEN 'Cancelled' WHEN 3 THEN 'else' ELSE status END AS status FROM tm)
 SELECT status, CASE WHEN status IN ('Tescil Edildi', 'Yayında', 'Yenilendi') THEN 1.0 WHEN status = 'İtiraz Edildi' THEN 0.9 WHEN status = 'Başvuruldu' THEN 0.85 WHEN status = 'Reddedildi' THEN 0.8 WHEN status = 'Cancelled' THEN 0.75 WHEN status = 'Kısmi Red' THEN 0.6 WHEN status = 'Expired' THEN 0.3 ELSE 0.5 END::DOUBLE AS weight,
 CASE WHEN status IN ('Tescil Edildi', 'Yayında', 'Yenilendi', 'İtiraz Edildi', 'Başvuruldu') THEN 'RISK' WHEN status IN ('Reddedildi', 'Cancelled', 'Kısmi Red') THEN 'WARNING' WHEN status = 'Expired' THEN 'OPPORTUNITY' ELSE 'UNKNOWN' END AS level, count(*) AS n FROM s GROUP BY ALL""")
def x28(spark, sf):
    k = F.col("id") % 9
    status = F.when(k == 0, "Expired").when(k == 1, ST.PARTIAL).when(k == 2, "Cancelled").when(k == 3, "else").otherwise(F.col("status"))
    return trademarks(spark, sf).select(status.alias("status")).groupBy("status", ST.weight(F.col("status")).alias("weight"), ST.level(F.col("status")).alias("level")).agg(F.count("*").alias("n"))


@query("x31_design_scores", "SELECT p_partkey, round(p_size / 50.0::DOUBLE * 0.55 + (p_partkey % 10) / 10.0::DOUBLE * 0.30 + (p_partkey % 3) / 3.0::DOUBLE * 0.05, 6) AS total FROM part")
def x31(spark, sf):
    k = F.col("p_partkey")
    p = read(spark, sf, "part").select(
        k, (F.col("p_size") / F.lit(50.0)).alias("dinov2"), (k % 10 / F.lit(10.0)).alias("clip"), F.lit(None).cast("double").alias("color"), (k % 3 / F.lit(3.0)).alias("text")
    )
    return p.select("p_partkey", F.round(S.weighted(S.DESIGN_IMAGE), 6).alias("total"))


@query("x34_class_lists", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([p_size, p_size * 3 % 60], lambda n: n BETWEEN 1 AND 45))), ',') AS classes FROM part")
def x34(spark, sf):
    s = F.col("p_size")
    written = F.concat(s.cast("string"), F.lit(", "), (s * 3 % 60).cast("string"), F.lit(";99/"))
    return read(spark, sf, "part").select("p_partkey", F.array_join(F.transform(X.class_list(written), lambda c: c.cast("string")), ",").alias("classes"))


@query("x39_monthly", f"SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n, max(date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}')) AS oldest_days, min(year(o_orderdate)) AS year FROM orders GROUP BY 1")
def x39(spark, sf):
    day = F.col("o_orderdate")
    return read(spark, sf, "orders").groupBy(F.trunc(day, "month").alias("month")).agg(
        F.count("*").alias("n"), F.max(F.datediff(as_of(), day)).cast("long").alias("oldest_days"), F.min(F.year(day)).cast("long").alias("year")
    )


@query("x40_bulletin_numbers", "SELECT o_orderkey, year(o_orderdate) || '/' || month(o_orderdate) AS bulletin_no FROM orders")
def x40(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", D.bulletin_number(F.date_format("o_orderdate", "yyyy-MM")).alias("bulletin_no"))


@query("x42_short_fingerprint", "SELECT event_id, left(sha256(concat_ws('|', CAST(user_id % 7 AS VARCHAR), CAST(user_id AS VARCHAR), event_type, left(props, 200))), 16) AS fingerprint FROM events")
def x42(spark, sf):
    u = F.col("user_id")
    return read(spark, sf, "events").select("event_id", X.event_fingerprint(u % 7, u, F.col("event_type"), F.col("props")).alias("fingerprint"))


@query("x43_kind_codes", """SELECT p_partkey, CASE code WHEN 'B' THEN 'GRANTED_PATENT' WHEN 'A1' THEN 'PUBLISHED_APP' WHEN 'T5' THEN 'PUBLISHED_UM_APP' ELSE 'UNKNOWN' END AS record_type FROM (SELECT p_partkey, ['B', 'A1', 'U3', 'T5'][p_size % 4 + 1] AS code FROM part)""")
def x43(spark, sf):
    code = F.get(F.array(*[F.lit(c) for c in ("B", "A1", "U3", "T5")]), F.col("p_size") % 4)
    return read(spark, sf, "part").select("p_partkey", X.kind_record_type(code).alias("record_type"))


# ---- merges and repairs ------------------------------------------------------------------------------------------------


@query("sk2_priority_merge", f"""WITH {TM}, t AS (SELECT id, ['BLT','GZ','APP'][CAST(id % 3 AS INTEGER) + 1] AS source, status, name, CASE WHEN id % 2 = 0 THEN 'b' || id END AS b, NULL::VARCHAR AS r, CASE id % 5 WHEN 0 THEN [1, 2, 3, 4, 5, 6, 7] WHEN 1 THEN NULL ELSE classes END AS classes FROM tm WHERE len(name) < 11),
 i AS (SELECT id, ['APP','BLT','GZ'][CAST(id // 3 % 3 AS INTEGER) + 1] AS source, 'Yenilendi' AS status, CASE WHEN id % 7 <> 0 THEN brand END AS name, 'n' || id AS b, 'r' || id AS r, CASE id % 4 WHEN 0 THEN [1, 2, 3, 4, 5, 6] WHEN 1 THEN NULL WHEN 2 THEN [1, 2, 3, 4, 5, 6, 7, 8] ELSE [1, 2, 3] END AS classes, id % 13 = 0 AS clear_name FROM tm WHERE len(name) > 8),
 j AS (SELECT coalesce(t.id, i.id) AS application_no, t.id IS NULL AS fresh, i.id IS NULL AS untouched, t.source AS ts, i.source AS src, t.status AS tst, i.status AS ist, t.name AS tn, i.name AS inn, t.b AS tb, i.b AS ib, t.r AS tr, i.r AS ir, t.classes AS tc, i.classes AS ic, clear_name,
  coalesce(len(t.classes), 0) AS nt, coalesce(len(i.classes), 0) AS ni FROM t FULL JOIN i ON t.id = i.id),
 k AS (SELECT *, CASE src WHEN 'APP' THEN false WHEN 'GZ' THEN coalesce(ts, '') = 'APP' ELSE coalesce(ts, '') IN ('APP', 'GZ') END AS held FROM j),
 n AS (SELECT *, CASE WHEN untouched THEN tst WHEN fresh OR NOT held OR (ts = 'APP' AND tst = 'Başvuruldu') THEN ist ELSE tst END AS next FROM k)
 SELECT application_no, CASE WHEN untouched OR next = tst THEN ts ELSE src END AS source, next AS status, CASE WHEN untouched THEN tn WHEN fresh THEN inn WHEN clear_name THEN NULL WHEN held THEN coalesce(tn, inn) ELSE coalesce(inn, tn) END AS name,
 CASE WHEN fresh THEN ib WHEN src = 'BLT' THEN coalesce(ib, tb) ELSE tb END AS bulletin_no, CASE WHEN fresh THEN ir WHEN src = 'GZ' THEN coalesce(ir, tr) ELSE tr END AS registration_no,
 array_to_string(CASE WHEN untouched THEN tc WHEN fresh THEN ic WHEN src = 'APP' THEN CASE WHEN nt = 0 THEN coalesce(ic, tc) WHEN ni > 6 AND ni > nt THEN ic ELSE tc END WHEN ni = 6 AND nt > 6 THEN tc WHEN held THEN coalesce(tc, ic) ELSE coalesce(ic, tc) END, ',') AS classes FROM n""")
def sk2(spark, sf):
    tm = trademarks(spark, sf)
    k = F.col("id")
    of = lambda at, *s: F.get(F.array(*[F.lit(x) for x in s]), at.cast("int")).alias("source")
    tag = lambda p: F.concat(F.lit(p), k.cast("string"))
    upto = lambda n: F.sequence(F.lit(1), F.lit(n))
    size = F.length("name")
    t = tm.where(size < 11).select(
        k.alias("application_no"), of(k % 3, "BLT", "GZ", "APP"), "status", "name", F.when(k % 2 == 0, tag("b")).alias("bulletin_no"), F.lit(None).cast("string").alias("registration_no"),
        F.when(k % 5 == 0, upto(7)).when(k % 5 != 1, F.col("classes")).alias("classes"),
    )
    i = tm.where(size > 8).select(
        k.alias("application_no"), of(F.floor(k / 3) % 3, "APP", "BLT", "GZ"), F.lit(ST.RENEWED).alias("status"), F.when(k % 7 != 0, F.col("brand")).alias("name"), tag("n").alias("bulletin_no"), tag("r").alias("registration_no"),
        F.when(k % 4 == 0, upto(6)).when(k % 4 == 2, upto(8)).when(k % 4 == 3, upto(3)).alias("classes"), (k % 13 == 0).alias("clear_name"),
    )
    return merge.priority_merge(t, i).withColumn("classes", F.array_join(F.transform("classes", lambda c: c.cast("string")), ","))


@query("sk3_overwrite", "SELECT p_partkey, p_name AS v FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_size >= 20")
def sk3(spark, sf):
    p = read(spark, sf, "part")
    return merge.overwrite(p.select("p_partkey", F.col("p_name").alias("v")), p.where("p_size >= 20").select("p_partkey", F.col("p_brand").alias("v")), ["p_partkey"])


@query("sk6_prune_scopes", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 7)")
def sk6(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    return merge.prune_scopes(p, p.where("p_size = 7"), ["p_brand"]).select("p_partkey", "p_brand")


@query("q25_status_repair", f"""WITH {TM} SELECT id, CASE WHEN id % 4 = 0 THEN 'Devredildi' WHEN id % 4 <> 1 AND id % 3 = 0 THEN 'Tescil Edildi' WHEN id % 5 = 0 THEN 'Yayında' ELSE status END AS status FROM tm""")
def q25(spark, sf):
    k, none = F.col("id"), F.lit(None).cast("string")
    evidence = F.when(k % 4 == 0, "Devredildi").when(k % 4 == 1, "Başvuruldu")
    gazette = F.when((k % 4 != 1) & (k % 3 == 0), "g")
    return trademarks(spark, sf).select("id", merge.repair_status(F.col("status"), evidence, gazette, none, F.when(k % 5 == 0, "b").otherwise(" ")).alias("status"))


# ---- lookbacks, searches, scans, portfolios ----------------------------------------------------------------------------


@query("st7_reminders", f"WITH {TM} SELECT id, date_diff('day', DATE '{AS_OF}', deadline) AS days_left FROM tm WHERE date_diff('day', DATE '{AS_OF}', deadline) IN (30, 14, 7, 3, 1)")
def st7(spark, sf):
    return trademarks(spark, sf).select("id", F.datediff("deadline", as_of()).cast("long").alias("days_left")).where(F.col("days_left").isin(30, 14, 7, 3, 1))


@query("st10_daily_quota", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS used, count(*) >= 5 AS over FROM events GROUP BY ALL")
def st10(spark, sf):
    used = read(spark, sf, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("used"))
    return used.withColumn("over", F.col("used") >= 5)


@query("q2_image_candidates", """WITH v AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 7), e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings WHERE embedding IS NOT NULL)
 SELECT vec_id, round(greatest(list_cosine_similarity(a, q), list_cosine_similarity(list_reverse(a), q)), 6) AS score FROM e, v ORDER BY score DESC, vec_id LIMIT 50""")
def q2(spark, sf):
    e = read(spark, sf, "embeddings").where("embedding is not null")
    wanted = e.where("vec_id = 7").select("embedding").first()[0]  # one vector
    v = F.array(*[F.lit(float(x)) for x in wanted])
    score = F.greatest(S.cosine(F.col("embedding"), v), S.cosine(F.reverse("embedding"), v))
    return e.select("vec_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(50)


@query("q13_universal_conflicts", f"""WITH {TM}, g AS (SELECT *, {GRAMS.format('name')} AS g, {EXPANDED} AS c FROM tm), w AS (SELECT * FROM g WHERE status = 'Başvuruldu'), m AS (SELECT * FROM g WHERE status IN ('Tescil Edildi', 'Yayında', 'Yenilendi') AND applied + 3652 >= DATE '{AS_OF}' - 183),
 n AS (SELECT DISTINCT name, g FROM g), s AS (SELECT a.name AS x, b.name AS y, round({jaccard_sql('a.g', 'b.g')}, 6) AS similarity FROM n a, n b),
 p AS (SELECT w.id AS watch_id, m.id AS mark_id, similarity FROM w JOIN s ON s.x = w.name AND similarity >= 0.5 JOIN m ON m.name = s.y WHERE w.holder <> m.holder AND list_has_any(w.c, m.c))
 SELECT watch_id, mark_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY watch_id ORDER BY similarity DESC, mark_id) AS r FROM p) WHERE r <= 20""")
def q13(spark, sf):
    t = trademarks(spark, sf)
    live = t.where(F.col("status").isin("Tescil Edildi", "Yayında", "Yenilendi") & (F.date_add("applied", 3652) >= F.date_sub(as_of(), 183)))
    found = scan.conflicts(t.where("status = 'Başvuruldu'").withColumnRenamed("id", "watch_id"), live.withColumnRenamed("id", "mark_id"), 0.5, 20)
    return found.select("watch_id", "mark_id", "similarity")


@query("q14_holder_watch", "SELECT c_custkey AS watch_id, s_suppkey FROM customer JOIN supplier ON lower(trim(replace(c_name, 'Customer', 'X'))) = lower(trim(replace(s_name, 'Supplier', 'x')))")
def q14(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("watch_id"), F.replace("c_name", F.lit("Customer"), F.lit("X")).alias("holder"))
    s = read(spark, sf, "supplier").select("s_suppkey", F.replace("s_name", F.lit("Supplier"), F.lit("x")).alias("holder"))
    return scan.holder_watch(c, s).select("watch_id", "s_suppkey")


@query("q16_lead_feed", f"""WITH {TM}, d AS (SELECT id, name, holder, date_diff('day', DATE '{AS_OF}', deadline) AS days_left FROM tm WHERE status = 'Yayında' AND deadline >= DATE '{AS_OF}')
 SELECT id, name, holder, days_left, CASE WHEN days_left <= 7 THEN 'critical' WHEN days_left <= 14 THEN 'urgent' WHEN days_left <= 30 THEN 'soon' ELSE 'normal' END AS urgency FROM d ORDER BY days_left, id LIMIT 50""")
def q16(spark, sf):
    left = F.datediff("deadline", as_of()).cast("long")
    t = trademarks(spark, sf).where((F.col("status") == "Yayında") & (left >= 0)).select("id", "name", "holder", left.alias("days_left"))
    return rows.page(t.withColumn("urgency", D.urgency(F.col("days_left"))), [F.col("days_left"), F.col("id")], 50)


@query("q18_holder_portfolio", f"""WITH {TM} SELECT holder, count(*) AS n, count(*) FILTER (WHERE status = 'Tescil Edildi') AS n_registered, count(*) FILTER (WHERE status = 'Yayında') AS n_published, min(applied) AS first_applied, max(applied) AS last_applied FROM tm GROUP BY holder""")
def q18(spark, sf):
    s = F.col("status")
    return trademarks(spark, sf).groupBy("holder").agg(
        F.count("*").alias("n"), F.count_if(s == "Tescil Edildi").alias("n_registered"), F.count_if(s == "Yayında").alias("n_published"), F.min("applied").alias("first_applied"), F.max("applied").alias("last_applied")
    )


@query("q20_lead_view", f"""WITH {TM}, d AS (SELECT date_diff('day', DATE '{AS_OF}', deadline) AS n FROM tm WHERE status = 'Yayında')
 SELECT count(*) FILTER (WHERE n BETWEEN 0 AND 7) AS critical, count(*) FILTER (WHERE n BETWEEN 0 AND 14) AS urgent, count(*) FILTER (WHERE n BETWEEN 0 AND 30) AS soon FROM d""")
def q20(spark, sf):
    return feeds.lead_statistics_view(trademarks(spark, sf).where("status = 'Yayında'"), F.datediff("deadline", as_of()))


RISK = "CASE WHEN score >= 0.90 THEN 'critical' WHEN score >= 0.80 THEN 'very_high' WHEN score >= 0.70 THEN 'high' WHEN score >= 0.50 THEN 'medium' ELSE 'low' END"
