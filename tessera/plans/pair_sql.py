"""SQL of the pair scorer, stated from the registry's rules: roles, glued words, difference ratios, alignment and caps.

SCORED needs pr(id, a, b) and st(word, cls, idf, doc_freq, first, last, single, signals, score, descr); it gives
scored(id, score, path, caps, tri, weak, limited, short). Words match by spelling alone, as SQL has no sound codes.
"""

from __future__ import annotations

from tessera.functions import text as X
from tessera.operators import lexicon, scoring

NORM = f"trim(regexp_replace(translate(lower(translate({{0}}, 'Iİ', 'ıi')), '{X.MARKED}', '{X.BARE}'), '[^a-z0-9]+', ' ', 'g'))"
TRIGRAMS = r"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"

#: Word statistics of documents, without the profile of descriptors.
STATISTICS = f"""dw AS (SELECT unnest(list_distinct(list_filter(string_split({NORM.format("text")}, ' '), lambda x: length(x) > 1))) AS word FROM documents WHERE trim(text) <> ''), nd AS (SELECT count(*) AS n FROM documents WHERE trim(text) <> ''),
 st AS MATERIALIZED (SELECT word, CASE WHEN count(*)::DOUBLE / any_value(n) > 0.005 THEN 'generic' WHEN count(*)::DOUBLE / any_value(n) > 0.001 THEN 'semi_generic' ELSE 'distinctive' END AS cls, round(ln(any_value(n)::DOUBLE / count(*)), 4) AS idf, count(*) AS doc_freq,
  NULL::DOUBLE AS first, NULL::DOUBLE AS last, NULL::DOUBLE AS single, NULL::INTEGER AS signals, NULL::DOUBLE AS score, NULL::BOOLEAN AS descr FROM dw, nd GROUP BY word)"""

_STEMS = "[" + ", ".join(["struct_pack(k := 0, s := word)", *(f"CASE WHEN ends_with(word, '{e}') AND length(word) >= {len(e) + 3} THEN struct_pack(k := {i}, s := left(word, length(word) - {len(e)})) END" for i, e in enumerate(lexicon.ENDINGS, 1))]) + "]"
_LISTED = "(" + ", ".join(f"'{w}'" for w in lexicon.GENERIC_WORDS) + ")"


def lookup_sql(name: str, words: str) -> str:
    """CTE name(word, role, cls) of the distinct words of a CTE."""
    return f"""{name} AS MATERIALIZED (SELECT word, CASE WHEN word IN {_LISTED} OR d THEN 'generic' WHEN c <> 'generic' AND e.doc_freq >= 50 AND e.last >= 0.30 AND e.first <= 0.30 AND e.single <= 0.08 AND e.signals >= 2 THEN 'weak_anchor'
   WHEN c = 'generic' AND coalesce(e.idf, 9.0) >= 6.5 THEN 'common_anchor' ELSE c END AS role, c AS cls
  FROM (SELECT word, e, coalesce(e.descr, false) AS d, CASE WHEN coalesce(e.descr, false) THEN 'generic' ELSE coalesce(e.cls, 'distinctive') END AS c
   FROM (SELECT w.word, arg_min(st, w.t.k) FILTER (st.word IS NOT NULL) AS e FROM (SELECT word, unnest(list_filter({_STEMS}, lambda x: x IS NOT NULL)) AS t FROM {words}) w LEFT JOIN st ON st.word = w.t.s GROUP BY 1)))"""


_GEN = "({0} = 'generic')"
_CUT = "SELECT word, left(word, i - 1) AS root, substr(word, i) AS suffix FROM {0}, range(5, length(word) - 1) AS r(i) WHERE substr(word, i) IN (SELECT suffix FROM sfx)"
#: Longest common block of a and b: its length l, the earliest in a (m is -i), then the earliest in b.
_BLOCK = "list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(list_filter(range(1, length(a) - i + 2), lambda n: contains(b, substr(a, i, n))), lambda n: struct_pack(l := n, m := -i)))))"
#: Ratios ra(x, y, r) of the pairs in sp(x, y): twice the letters in matching blocks over all letters.
BLOCKS = f"""bl AS (SELECT x, y, x AS a, y AS b FROM sp UNION ALL SELECT x, y, n.a, n.b FROM (SELECT x, y, unnest([struct_pack(a := left(a, -f.m - 1), b := left(b, strpos(b, substr(a, -f.m, f.l)) - 1)), struct_pack(a := substr(a, -f.m + f.l), b := substr(b, strpos(b, substr(a, -f.m, f.l)) + f.l))]) AS n
   FROM (SELECT *, {_BLOCK} AS f FROM bl WHERE a <> '' AND b <> '') WHERE f IS NOT NULL) WHERE n.a <> '' AND n.b <> ''),
 ra AS MATERIALIZED (SELECT x, y, CASE WHEN length(x) + length(y) = 0 THEN 1 ELSE 2 * coalesce(sum(({_BLOCK}).l), 0)::DOUBLE / (length(x) + length(y)) END AS r FROM bl GROUP BY x, y)"""
_HAS = "len(list_filter({0}, lambda z: z.{1} = {2})) > 0"


def _b(name: str, evidence: str) -> str:
    low, high = scoring.ADDED[name]
    return f"({low}::DOUBLE + {round(high - low, 2)}::DOUBLE * greatest(0, least(1, {evidence})))"


def _proof(balanced: bool = False, brand: str = "brandlike") -> str:
    both = "least({0}, {1})" if balanced else "({0} * 0.65::DOUBLE + {1} * 0.35::DOUBLE)"
    return f"{both.format('q_cov', 't_cov')} * 0.45::DOUBLE + {both.format('recall', 'prec')} * 0.35::DOUBLE + quality * 0.20::DOUBLE - least(0.24::DOUBLE, greatest(0, nq + nt - 1) * 0.04::DOUBLE) - least(0.12::DOUBLE, {brand} * 0.02::DOUBLE)"


def _between(low: float, high: float, evidence: str) -> str:
    return f"({low}::DOUBLE + {round(high - low, 2)}::DOUBLE * greatest(0, least(1, {evidence})))"


_TOTAL = "coalesce(list_sum(list_transform({0}, lambda w: -w.less)), 0)"
_OF = "coalesce({0} / nullif({1}, 0), 0)"
_SUM = "coalesce(list_sum(list_transform({0}, lambda h: h.{1} * h.sim)), 0)"
_N = "len(list_filter({0}, lambda w: {1}))"
_LEVEL = "CASE {0} WHEN 'generic' THEN 0.1 WHEN 'semi_generic' THEN 0.5 ELSE 1 END::DOUBLE"

SCORED = f"""nm AS MATERIALIZED (SELECT name, {NORM.format("name")} AS norm FROM (SELECT coalesce(a, '') AS name FROM pr UNION SELECT coalesce(b, '') FROM pr)),
 wp AS MATERIALIZED (SELECT name, i AS nth, string_split(norm, ' ')[i] AS word FROM nm, unnest(range(1, len(string_split(norm, ' ')) + 1)) AS r(i) WHERE norm <> ''),
 sfx AS MATERIALIZED (SELECT unnest([{", ".join(f"'{w}'" for w in lexicon.GENERIC_WORDS if len(w) >= 3)}]) AS suffix UNION SELECT word FROM st WHERE descr AND length(word) >= 3),
 wd AS MATERIALIZED (SELECT DISTINCT word FROM wp), c1 AS MATERIALIZED ({_CUT.format("wd")}), rd AS (SELECT DISTINCT root AS word FROM c1), c2 AS MATERIALIZED ({_CUT.format("rd")}),
 ss AS (SELECT word FROM wd UNION SELECT root FROM c1 UNION SELECT suffix FROM c1 UNION SELECT root FROM c2 UNION SELECT suffix FROM c2), {lookup_sql("rl", "ss")},
 b1 AS (SELECT c.word, arg_max(struct_pack(root, suffix), length(suffix)) AS c FROM c1 c JOIN rl w ON w.word = c.word JOIN rl o ON o.word = c.root WHERE NOT {_GEN.format("w.role")} AND NOT {_GEN.format("o.role")} GROUP BY c.word),
 b2 AS (SELECT c.word, arg_max(struct_pack(root, suffix), length(suffix)) AS c FROM c2 c JOIN rl o ON o.word = c.root WHERE NOT {_GEN.format("o.role")} GROUP BY c.word),
 sgm AS MATERIALIZED (SELECT wd.word, cls, CASE WHEN b2.c IS NOT NULL THEN [b2.c.root, b2.c.suffix, b1.c.suffix] WHEN b1.c IS NOT NULL THEN [b1.c.root, b1.c.suffix] ELSE [wd.word] END AS parts, b1.c IS NOT NULL AS split
  FROM wd JOIN rl USING (word) LEFT JOIN b1 USING (word) LEFT JOIN b2 ON b2.word = b1.c.root),
 pa AS (SELECT name, nth, sgm.word, parts, split FROM wp JOIN sgm USING (word)),
 lw AS (SELECT name, list(struct_pack(less := -w, t := t, role := role) ORDER BY -w, t) AS words FROM (SELECT DISTINCT name, t FROM (SELECT name, unnest(parts) AS t FROM pa WHERE length(word) > 1))
  JOIN (SELECT word, role, CASE role WHEN 'distinctive' THEN 1 WHEN 'common_anchor' THEN 0.65 WHEN 'generic' THEN 0.10 ELSE 0.45 END::DOUBLE AS w FROM rl) ON word = t GROUP BY name),
 od AS (SELECT name, flatten(list(parts ORDER BY nth)) AS ordered, bool_or(split AND length(word) > 1) AS split FROM pa GROUP BY name),
 rwd AS (SELECT name, list(struct_pack(t := word, w := {_LEVEL.format("cls")}) ORDER BY word) AS raw FROM (SELECT DISTINCT name, word FROM wp) JOIN sgm USING (word) GROUP BY name),
 fn AS MATERIALIZED (SELECT nm.name, norm, replace(norm, ' ', '') AS c, coalesce(words, []) AS words, coalesce(ordered, []) AS ordered, coalesce(split, false) AS split, coalesce(raw, []) AS raw FROM nm LEFT JOIN lw USING (name) LEFT JOIN od USING (name) LEFT JOIN rwd USING (name)),
 hd AS MATERIALIZED (SELECT DISTINCT x.name AS a, y.name AS b, x.norm AS qn, y.norm AS tn, x.c AS qc, y.c AS tc, x.words AS q, y.words AS t, x.ordered AS qo, y.ordered AS tor, x.split AS qs, x.raw AS qr, y.raw AS tr FROM pr JOIN fn x ON x.name = coalesce(pr.a, '') JOIN fn y ON y.name = coalesce(pr.b, '')),
 cd AS MATERIALIZED (SELECT DISTINCT x.t AS x, y.t AS y FROM (SELECT unnest(q) AS x, t FROM hd), unnest(t) AS u(y) WHERE x.t <> y.t AND {_GEN.format("x.role")} = {_GEN.format("y.role")} AND ({_GEN.format("x.role")} OR (length(x.t) > 2 AND length(y.t) > 2))),
 tl AS MATERIALIZED (SELECT x, y, (SELECT arg_max(suffix, length(suffix)) FROM sfx WHERE ends_with(x, suffix) AND ends_with(y, suffix)) AS shared, right(x, list_max(list_filter(range(0, least(length(x), length(y)) + 1), lambda n: right(x, n::BIGINT) = right(y, n::BIGINT)))::BIGINT) AS tail FROM cd),
 tw AS (SELECT DISTINCT tail AS word FROM tl WHERE length(tail) >= 4), {lookup_sql("rt", "tw")},
 rr AS MATERIALIZED (SELECT x, y, shared, CASE WHEN shared IS NOT NULL THEN left(x, length(x) - length(shared)) WHEN cut THEN left(x, length(x) - length(tail)) ELSE x END AS p, CASE WHEN shared IS NOT NULL THEN left(y, length(y) - length(shared)) WHEN cut THEN left(y, length(y) - length(tail)) ELSE y END AS z
  FROM (SELECT tl.*, coalesce(rt.cls = 'generic', false) AND length(x) - length(tail) >= 2 AND length(y) - length(tail) >= 2 AS cut FROM tl LEFT JOIN rt ON rt.word = tail AND length(tail) >= 4)),
 wr AS (SELECT DISTINCT x.t AS x, y.t AS y FROM (SELECT unnest(qr) AS x, tr FROM hd), unnest(tr) AS u(y) WHERE x.t <> y.t),
 sp AS MATERIALIZED (SELECT p AS x, z AS y FROM rr UNION SELECT x, y FROM wr UNION SELECT qn, tn FROM hd),
 {BLOCKS},
 fz AS MATERIALIZED (SELECT rr.x, rr.y, CASE WHEN shared IS NULL THEN r WHEN length(p) < 4 OR length(z) < 4 THEN 0 WHEN r < 0.72 THEN least(0.45::DOUBLE, r * 0.60::DOUBLE) ELSE r END::DOUBLE AS f FROM rr JOIN ra ON ra.x = p AND ra.y = z),
 si AS MATERIALIZED (SELECT x, y, f, round(CASE WHEN u >= 0.84 THEN u WHEN u >= 0.74 AND least(length(x), length(y)) >= 4 THEN u * 0.95::DOUBLE END, 4) AS sim FROM (SELECT *, CASE WHEN least(length(x), length(y)) >= 4 AND abs(length(x) - length(y)) >= 2
   AND (starts_with(x, y) OR starts_with(y, x) OR ends_with(x, y) OR ends_with(y, x)) THEN least(f, 0.69::DOUBLE) ELSE f END AS u FROM fz) WHERE u >= 0.74),
 al AS (SELECT a, b, 1 AS i, q, t AS free, false AS shy, CAST([] AS STRUCT(x VARCHAR, y VARCHAR, kind VARCHAR, sim DOUBLE, f DOUBLE, xw DOUBLE, yw DOUBLE, xr VARCHAR, yr VARCHAR)[]) AS hits,
   (SELECT list(struct_pack(x := s.x, y := s.y, f := s.f, sim := s.sim)) FROM si s WHERE s.sim >= 0.70 AND {_HAS.format("hd.q", "t", "s.x")} AND {_HAS.format("hd.t", "t", "s.y")}) AS sims FROM hd
  UNION ALL SELECT a, b, i + 1, q, CASE WHEN h IS NULL THEN free ELSE list_filter(free, lambda z: z.t <> h.y.t) END, shy OR (NOT same AND len(list_filter(free, lambda z: (length(z.t) <= 2 AND z.role <> 'generic') OR (length(q[i].t) <= 2 AND q[i].role <> 'generic'))) > 0),
   CASE WHEN h IS NULL THEN hits ELSE list_append(hits, struct_pack(x := q[i].t, y := h.y.t, kind := CASE WHEN same THEN 'exact' ELSE 'fuzzy' END, sim := h.sim, f := h.f, xw := -q[i].less, yw := -h.y.less, xr := q[i].role, yr := h.y.role)) END, sims
   FROM (SELECT *, CASE WHEN same THEN struct_pack(sim := 1::DOUBLE, y := list_filter(free, lambda z: z.t = q[i].t)[1], f := 1::DOUBLE) ELSE list_max(list_transform(list_filter(free, lambda z: len(list_filter(sims, lambda m: m.x = q[i].t AND m.y = z.t)) > 0),
     lambda z: struct_pack(sim := list_filter(sims, lambda m: m.x = q[i].t AND m.y = z.t)[1].sim, y := z, f := list_filter(sims, lambda m: m.x = q[i].t AND m.y = z.t)[1].f))) END AS h FROM (SELECT *, {_HAS.format("free", "t", "q[i].t")} AS same FROM al WHERE i <= len(q)))),
 ml AS (SELECT a, b, 1 AS i, own, lft, 0::DOUBLE AS got, 0::DOUBLE AS lost, rs FROM (SELECT a, b, list_filter(qr, lambda z: NOT list_contains(list_transform(tr, lambda o: o.t), z.t)) AS own, list_filter(tr, lambda z: NOT list_contains(list_transform(qr, lambda o: o.t), z.t)) AS lft,
    (SELECT list(struct_pack(x := ra.x, y := ra.y, r := ra.r)) FROM ra WHERE {_HAS.format("hd.qr", "t", "ra.x")} AND {_HAS.format("hd.tr", "t", "ra.y")}) AS rs FROM hd)
  UNION ALL SELECT a, b, i + 1, own, CASE WHEN h.r >= 0.75 THEN list_filter(lft, lambda z: z.t <> lft[-h.k].t) ELSE lft END, got + CASE WHEN h.r >= 0.75 THEN own[i].w * h.r ELSE 0 END, lost + CASE WHEN h.r >= 0.75 THEN 0 ELSE own[i].w END, rs
   FROM (SELECT *, list_max(list_transform(range(1, len(lft) + 1), lambda k: struct_pack(r := list_filter(rs, lambda m: m.x = own[i].t AND m.y = lft[k].t)[1].r, k := -k))) AS h FROM ml WHERE i <= len(own))),
 lv AS (SELECT a, b, CASE WHEN qn = '' OR tn = '' THEN 0 WHEN qn = tn THEN 1 ELSE round(least(0.99::DOUBLE, 0.25::DOUBLE * r + 0.65::DOUBLE * coalesce(m / nullif(m + 0.3::DOUBLE * lost + 0.2::DOUBLE * rest, 0), 0) + 0.10::DOUBLE * (0.25::DOUBLE * least(length(qn), length(tn)) / greatest(length(qn), length(tn))
   + 0.25::DOUBLE * least(len(qr), len(tr)) / greatest(len(qr), len(tr)) + CASE WHEN contains(qn, tn) OR contains(tn, qn) THEN 0.50 ELSE 0 END::DOUBLE)), 6) END::DOUBLE AS level
  FROM (SELECT hd.*, ra.r, lost, got + coalesce(list_sum(list_transform(list_filter(qr, lambda z: list_contains(list_transform(tr, lambda o: o.t), z.t)), lambda z: z.w)), 0) AS m, coalesce(list_sum(list_transform(lft, lambda z: z.w)), 0) AS rest
   FROM hd JOIN ml ON ml.a = hd.a AND ml.b = hd.b AND ml.i = len(ml.own) + 1 JOIN ra ON ra.x = qn AND ra.y = tn)),
 e1 AS (SELECT hd.*, hits, shy, level, list_filter(hits, lambda h: h.xr <> 'generic' OR h.yr <> 'generic') AS anch, list_filter(hits, lambda h: h.kind = 'exact') AS ex, list_filter(hits, lambda h: h.kind = 'exact' AND h.xr <> 'generic') AS exa, list_filter(q, lambda w: w.role <> 'generic') AS qa, list_filter(t, lambda w: w.role <> 'generic') AS ta,
   list_filter(q, lambda w: NOT {_HAS.format("hits", "x", "w.t")}) AS qx, list_filter(t, lambda w: NOT {_HAS.format("hits", "y", "w.t")}) AS tx, {TRIGRAMS.format("hd.a")} AS ga, {TRIGRAMS.format("hd.b")} AS gb
  FROM hd JOIN (SELECT a, b, shy, hits FROM al WHERE i = len(q) + 1) al ON al.a = hd.a AND al.b = hd.b JOIN lv ON lv.a = hd.a AND lv.b = hd.b),
 e2 AS (SELECT *, {_OF.format(_SUM.format("hits", "xw"), _TOTAL.format("q"))} AS recall, {_OF.format(_SUM.format("hits", "yw"), _TOTAL.format("t"))} AS prec, {_OF.format(_SUM.format("hits", "xw"), "coalesce(list_sum(list_transform(hits, lambda h: h.xw)), 0)")} AS good,
   {_OF.format(_SUM.format("list_filter(hits, lambda z: z.xr <> 'generic')", "xw"), _TOTAL.format("qa"))} AS q_cov, {_OF.format(_SUM.format("list_filter(hits, lambda z: z.yr <> 'generic')", "yw"), _TOTAL.format("ta"))} AS t_cov, coalesce(list_avg(list_transform(anch, lambda h: h.sim)), 0) AS quality,
   {_N.format("qx", "w.role <> 'generic'")} AS nq, {_N.format("tx", "w.role <> 'generic'")} AS nt, len(qx) + len(tx) AS extras, {_N.format("qx || tx", "w.role IN ('common_anchor', 'distinctive')")} AS brandlike, {_N.format("qx || tx", "w.role = 'weak_anchor'")} AS weaks, {_N.format("qx || tx", "w.role = 'semi_generic'")} AS semis,
   {_N.format("qx || tx", "w.role = 'generic'")} AS gens, len(q) > 0 AND len(ex) = len(q) AS fq, len(t) > 0 AND len(ex) = len(t) AS ft, anch[1] AS m, coalesce(len(list_intersect(ga, gb))::DOUBLE / nullif(len(list_distinct(ga || gb)), 0), 0) AS tri,
   {_N.format("hits", "w.xr <> 'generic'")} AS matched, list_filter(tor, lambda o: {_HAS.format("t", "t", "o")})[1] AS head FROM e1),
 e3 AS (SELECT *, {_N.format("hits", "w.xr <> 'generic'")} = 1 AND {_N.format("hits", "w.yr <> 'generic'")} = 1 AS one, CASE WHEN fq THEN len(q) WHEN ft THEN len(t) ELSE 0 END AS cop, coalesce({_HAS.format("list_filter(tx, lambda v: v.role <> 'generic')", "t", "head")}, false) AS leads FROM e2),
 e4 AS (SELECT *, one AND (len(qa) >= 2 OR len(ta) >= 2) AND nq > 0 AND nt > 0 AS chg, fq AND len(q) = 1 AND len(exa) = 1 AND length(exa[1].x) <= 4 AS brief FROM e3),
 e5 AS (SELECT *, one AND len(qa) = 1 AND NOT chg AND nq = 0 AND len(qx) > 0 AND nt > 0 AND (nt >= 2 OR leads OR len(tx) >= 2) AS lop FROM e4),
 e6 AS (SELECT *, CASE WHEN len(qa) = 0 OR q_cov <= 0 OR len(exa) = 0 OR extras = 0 THEN NULL WHEN fq OR ft THEN CASE WHEN brandlike > 0 AND cop <= 1 AND brief THEN 'single_short_anchor' WHEN brandlike > 0 AND cop <= 1 THEN 'single_anchor' WHEN brandlike > 0 THEN 'distinctive_extra'
   WHEN weaks > 0 AND cop <= 1 THEN 'single_weak_extra' WHEN semis > 0 THEN 'semi_extra' ELSE 'plain' END WHEN chg THEN 'changed_on_both_sides' WHEN lop THEN 'asymmetric' WHEN q_cov >= 0.98 THEN 'changed_rest' ELSE 'partial_core' END AS cc FROM e5),
 e7 AS (SELECT *, round(CASE cc {" ".join(f"WHEN '{n}' THEN {_b(n, _proof())}" for n in ("single_short_anchor", "single_anchor", "distinctive_extra", "changed_rest", "partial_core"))} WHEN 'single_weak_extra' THEN {_b("single_weak_extra", _proof(brand="weaks"))}
   {" ".join(f"WHEN '{n}' THEN {_b(n, _proof(True))}" for n in ("changed_on_both_sides", "asymmetric"))} WHEN 'semi_extra' THEN greatest(0.80::DOUBLE, 0.88::DOUBLE - least(0.06::DOUBLE, semis * 0.03::DOUBLE)) WHEN 'plain' THEN greatest(0.88::DOUBLE, 0.96::DOUBLE - least(0.08::DOUBLE, gens * 0.02::DOUBLE)) ELSE 0 END, 4) AS core,
   len(anch) = 1 AND (m.xr = 'weak_anchor' OR m.yr = 'weak_anchor') AND (len(qx) > 0 OR {_N.format("qa", "w.role <> 'weak_anchor'")} = 0) AS ws, len(t) = 1 AND len(q) >= 2 AND round(recall, 4) < 0.98 AND len(qx) > 0 AS ql, len(q) = 1 AND len(t) >= 2 AND round(prec, 4) < 0.98 AND len(tx) > 0 AS tlg,
   len(anch) = 1 AND m.kind = 'fuzzy' AS inx, least(length(m.x), length(m.y)) AS ls, greatest(length(m.x), length(m.y)) AS ll, levenshtein(m.x, m.y) AS ed FROM e6),
 e8 AS (SELECT *, m.sim * 0.45::DOUBLE + least(round(q_cov, 4), round(t_cov, 4)) * 0.25::DOUBLE + least(round(recall, 4), round(prec, 4)) * 0.20::DOUBLE + CASE WHEN m.kind = 'exact' THEN 0.10 ELSE 0 END::DOUBLE - least(0.12::DOUBLE, (nq + nt) * 0.04::DOUBLE) AS pw,
   least(round(recall, 4), round(prec, 4)) * 0.45::DOUBLE + round(q_cov, 4) * 0.20::DOUBLE + round(t_cov, 4) * 0.15::DOUBLE + 0.20::DOUBLE - least(0.18::DOUBLE, CASE WHEN ql THEN len(qx) ELSE len(tx) END * 0.06::DOUBLE) AS pc,
   round(m.f, 4) * 0.35::DOUBLE + round(ls::DOUBLE / ll, 4) * 0.25::DOUBLE + round(1 - ed::DOUBLE / ll, 4) * 0.25::DOUBLE + least(q_cov, t_cov) * 0.15::DOUBLE AS pq FROM e7),
 e9 AS (SELECT *, CASE WHEN ws AND m.kind = 'exact' THEN {_between(0.50, 0.65, "pw")} WHEN ws THEN {_between(0.42, 0.58, "pw")} END AS c_weak, CASE WHEN (ql OR tlg) AND {_N.format("exa", "w.yr <> 'generic' AND length(w.x) <= 2")} = 1 THEN {_between(0.68, 0.82, "pc")} END AS c_acr,
   CASE WHEN inx AND len(qa) > 0 AND NOT (ls::DOUBLE / ll >= 0.80 AND m.f >= 0.78 AND ed <= greatest(1, ceil(ll * 0.20))) THEN CASE WHEN ls::DOUBLE / ll < 0.78 THEN {_between(0.46, 0.62, "pq")} ELSE {_between(0.56, 0.68, "pq")} END END AS c_inx, coalesce(inx AND ls <= 4 AND extras > 0, false) AS c_short,
   len(qa) >= 2 AND matched > 0 AND NOT {_HAS.format("hits", "x", f"list_filter(qo, lambda o: {_HAS.format('qa', 't', 'o')})[1]")} AS c_head,
   greatest(CASE WHEN qc = '' OR tc = '' THEN 0 WHEN contains(tn, qn) OR (length(qc) >= 4 AND contains(tc, qc)) THEN greatest(0.65::DOUBLE, 0.84::DOUBLE + 0.12::DOUBLE * length(qc) / length(tc) - least(0.18::DOUBLE, {_N.format("t", "NOT list_contains(list_transform(q, lambda z: z.t), w.t)")} * 0.035::DOUBLE))
    WHEN contains(qn, tn) OR (length(tc) >= 4 AND contains(qc, tc)) THEN greatest(0.60::DOUBLE, 0.84::DOUBLE + 0.12::DOUBLE * length(tc) / length(qc) - least(0.10::DOUBLE, {_N.format("q", "NOT list_contains(list_transform(t, lambda z: z.t), w.t)")} * 0.02::DOUBLE)) ELSE 0 END::DOUBLE,
    CASE WHEN qs AND len(exa) > 0 AND length(qc) >= 4 AND contains(tc, qc) THEN least(0.96::DOUBLE, 0.88::DOUBLE + 0.08::DOUBLE * length(qc) / length(tc)) ELSE 0 END) AS inside FROM e8),
 f1 AS (SELECT *, inside > 0 AND len(list_filter(qa, lambda x: len(list_filter(ta, lambda y: y.t = x.t OR (starts_with(y.t, x.t) AND length(y.t) - length(x.t) >= 3))) > 0)) > 0 AS kept,
   inside > 0 AND len(list_filter(qa, lambda x: x.role = 'common_anchor' AND len(list_filter(ta, lambda y: y.t = x.t OR (starts_with(y.t, x.t) AND length(y.t) - length(x.t) >= 3))) > 0)) > 0 AS keptc,
   {_N.format("q", "w.role = 'distinctive'")} AS hd_, {_N.format("hits", "w.xr = 'distinctive'")} AS gd, {_N.format("q", "w.role = 'common_anchor'")} AS hc, {_N.format("hits", "w.xr = 'common_anchor'")} AS gc, {_N.format("q", "w.role = 'semi_generic'")} AS hs, greatest(tri, level) AS letters FROM e9),
 f2 AS (SELECT *, matched > 0 OR kept AS lexical, CASE WHEN len(qa) = 0 THEN 'generic_only' WHEN matched = 0 AND len(hits) > 0 THEN 'missing_anchor' WHEN matched = 0 AND inside > 0 AND NOT kept THEN 'contained_without_anchor' WHEN hd_ = 0 AND hc = 0 AND hs > 0 THEN 'semi_only' WHEN hd_ > 0 AND gd = 0 THEN 'no_distinctive'
   WHEN gd < hd_ THEN 'some_distinctive' WHEN hc > 0 AND gc = 0 AND NOT keptc THEN 'no_common' WHEN gc < hc AND NOT keptc THEN 'some_common' END AS ab FROM f1),
 f3 AS (SELECT *, coalesce(2 * recall * prec / nullif(recall + prec, 0), 0) * (0.8::DOUBLE + 0.2::DOUBLE * good) AS aligned, CASE WHEN lexical THEN least(0.75::DOUBLE, letters * 0.80::DOUBLE + recall * 0.20::DOUBLE) ELSE least(0.45::DOUBLE, letters * 0.55::DOUBLE) END AS spelled, CASE WHEN c_short THEN 0.58 ELSE 1 END::DOUBLE AS lim,
   list_filter([struct_pack(n := ab, v := CASE ab {" ".join(f"WHEN '{n}' THEN {scoring.CAPS[n]}" for n in ("generic_only", "missing_anchor", "contained_without_anchor", "semi_only", "no_distinctive", "some_distinctive", "no_common", "some_common"))} END::DOUBLE),
    struct_pack(n := CASE WHEN cc <> 'plain' AND c_weak IS NULL THEN cc END, v := CASE WHEN cc = 'semi_extra' THEN 0.88::DOUBLE ELSE core END), struct_pack(n := CASE WHEN c_weak IS NOT NULL THEN 'weak_shared_anchor' END, v := c_weak), struct_pack(n := CASE WHEN c_acr IS NOT NULL THEN 'acronym' END, v := c_acr),
    struct_pack(n := CASE WHEN c_short THEN 'short_inexact' END, v := 0.58::DOUBLE), struct_pack(n := CASE WHEN c_inx IS NOT NULL THEN 'inexact_anchor' END, v := c_inx), struct_pack(n := CASE WHEN shy AND len(qa) > 0 AND matched = 0 THEN 'short_anchor' END, v := 0.45::DOUBLE),
    struct_pack(n := CASE WHEN c_head THEN 'no_first_anchor' END, v := 0.62::DOUBLE), struct_pack(n := CASE WHEN NOT lexical THEN 'no_anchor' END, v := 0.45::DOUBLE)], lambda z: z.n IS NOT NULL) AS cp FROM f2),
 f4 AS (SELECT *, len(q) = 0 OR len(t) = 0 AS mt FROM f3),
 f5 AS (SELECT a, b, tri, CASE WHEN mt AND qc = tc AND length(qc) >= 2 THEN 'compact' WHEN mt THEN 'no words' WHEN qn = tn THEN 'exact' WHEN length(qc) >= 4 AND qc = tc THEN 'compact' END AS fixed, round(least(greatest(least(aligned, lim), least(inside, lim), least(spelled, lim), least(core, lim)), coalesce(list_min(list_transform(cp, lambda z: z.v)), 1)), 4) AS free_score,
   CASE WHEN least(aligned, lim) >= greatest(least(inside, lim), least(spelled, lim), least(core, lim)) THEN 'alignment' WHEN least(inside, lim) >= greatest(least(spelled, lim), least(core, lim)) THEN 'containment' WHEN least(spelled, lim) > 0 AND least(spelled, lim) >= least(core, lim) THEN 'spelling' ELSE 'core' END AS free_path, list_transform(cp, lambda z: z.n) AS free_caps FROM f4),
 scored AS (SELECT pr.id, CASE fixed WHEN 'exact' THEN 1 WHEN 'compact' THEN 0.96 WHEN 'no words' THEN round(least(0.45::DOUBLE, tri * 0.50::DOUBLE), 4) ELSE free_score END::DOUBLE AS score, coalesce(fixed, free_path) AS path, tri, caps,
   list_has_any(caps, [{", ".join(f"'{n}'" for n in scoring.WEAK)}]) AS weak, list_has_any(caps, [{", ".join(f"'{n}'" for n in scoring.LIMITED)}]) AS limited, list_contains(caps, 'short_inexact') AS short
  FROM (SELECT *, CASE WHEN fixed = 'no words' THEN ['no_anchor'] WHEN fixed IS NOT NULL THEN [] ELSE free_caps END AS caps FROM f5) x JOIN pr ON coalesce(pr.a, '') = x.a AND coalesce(pr.b, '') = x.b)"""
