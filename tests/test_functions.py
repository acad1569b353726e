import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import classes as C
from tessera.functions import dates as D
from tessera.functions import phonetic as P
from tessera.functions import scores as S
from tessera.functions import status as ST
from tessera.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "text, wanted",
    [("İSTANBUL Çiçek", "istanbul cicek"), ("  Dağ-Evi & Köşk!! ", "dag evi kosk"), ("Café", "cafe"), ("", ""), (None, ""), ("IŞIK", "isik")],
)
def test_normalize(spark, text, wanted):
    assert one(spark, X.normalize(F.lit(text).cast("string"))) == wanted


def test_trigrams(spark):
    assert round(one(spark, X.trigram_similarity(F.lit("nike"), F.lit("naik"))), 6) == round(1 / 9, 6)
    assert one(spark, X.trigram_similarity(F.lit(""), F.lit(""))) == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("abcI ıİş-", max_size=12), st.text("abcI ıİş-", max_size=12)), min_size=1, max_size=30))
def test_similarity_properties(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    ab, ba = X.trigram_similarity(F.col("a"), F.col("b")), X.trigram_similarity(F.col("b"), F.col("a"))
    again = X.normalize(X.normalize(F.col("a"))) == X.normalize(F.col("a"))
    assert all(r[0] == r[1] and 0 <= r[0] <= 1 and r[2] for r in df.select(ab, ba, again).collect())


def test_names(spark):
    assert one(spark, X.clean_name(F.lit("ŞEKİL Kuzey  Rüzgar"))) == "Kuzey Rüzgar"
    assert one(spark, X.is_placeholder(F.lit("(şekil)"))) is True
    assert one(spark, X.client_id(F.lit("ACME A.Ş. (12345)"))) == "12345"
    assert one(spark, X.class_list(F.lit("9, 35;x/99 9 45"))) == [9, 35, 45]
    assert one(spark, X.kind_record_type(F.lit("b"))) == "GRANTED_PATENT"
    assert one(spark, X.kind_record_type(F.lit("U3"))) == "UNKNOWN"


@pytest.mark.parametrize("day, wanted", [("2025-01-15", "2025-03-15"), ("2025-12-31", "2026-02-28"), ("2025-01-31", "2025-03-31")])
def test_appeal_deadline(spark, day, wanted):
    assert str(one(spark, D.appeal_deadline(F.lit(day).cast("date")))) == wanted


def test_dates(spark):
    assert one(spark, D.parse_date(F.lit("03/04/2020"))) == dt.date(2020, 4, 3)
    assert one(spark, D.parse_date(F.lit("not a date"))) is None
    assert one(spark, D.expiry(F.lit("2012-02-29").cast("date"))) == dt.date(2012, 2, 29) + dt.timedelta(3652 + 183)
    assert one(spark, D.bulletin_number(F.lit("2025-08"))) == "2025/8"
    as_of = F.lit("2024-06-15").cast("date")
    for status, day, wanted in [("Yayında", "2024-06-20", "active_critical"), ("Yayında", "2024-06-14", "expired"), ("Tescil Edildi", None, "registered"), ("Registered", None, "registered"), ("Süresi Doldu", None, "expired"), ("Başvuruldu", None, "unknown")]:
        assert one(spark, D.deadline_status(F.lit(status), as_of, F.lit(day).cast("date"), as_of)) == wanted


def test_deadline_needs_a_bulletin(spark):
    none, day = F.lit(None).cast("date"), F.lit("2024-06-20").cast("date")
    assert one(spark, D.deadline_status(F.lit("Başvuruldu"), none, day, day)) == "pre_publication"


def test_fingerprints_keep_borders(spark):
    f = lambda *p: one(spark, X.fingerprint(*[F.lit(x).cast("string") for x in p]))
    assert len({f("a|b", "c"), f("a", "b|c"), f("a", None), f("a", ""), f("a", "\\N")}) == 5 and f(" a ", "c") == f("a", "c")


@pytest.mark.parametrize("text", ["Yayında şişe ğ", "Çağrı İş", "plain", "Ümit — “x” €", None, "Ä alone"])
def test_repair_of_misread_text(spark, text):
    for code in ("latin1", "cp1252"):
        misread = text
        for _ in range(2):
            try:
                misread = misread and misread.encode().decode(code)
            except UnicodeDecodeError:
                break
        assert one(spark, X.repair_mojibake(F.lit(misread).cast("string"))) == text


def test_statuses(spark):
    s = lambda x: F.lit(x).cast("string")
    for text, wanted in [("Başvuru GEÇERSİZ", ST.REFUSED), ("marka tescil edildi", ST.REGISTERED), ("İTİRAZ aşamasında", ST.OPPOSED), ("x", None), (None, None), ("Yenilendi", ST.RENEWED)]:
        assert one(spark, ST.told(s(text))) == wanted, text
    assert one(spark, ST.from_delivery(s("GZ_481"), s(None), s("-"))) == ST.REGISTERED and one(spark, ST.from_delivery(s("APP_1"), s(""), s("yok"))) == ST.APPLIED
    assert one(spark, ST.rank(s("Registered"))) == 3 and one(spark, ST.weight(s("nothing"))) == 0.5
    assert [one(spark, D.bulletin_of(s(f)))["no"] for f in ("BLT_2024_05", "GZ-481_2023-02-07", "x")] == ["2024/05", "481", None]
    assert str(one(spark, D.bulletin_of(s("GZ-481_2023-02-07")))["day"]) == "2023-02-07" and str(one(spark, D.bulletin_of(s("BLT_2024_05")))["day"]) == "2024-05-01"


def test_classes(spark):
    a = lambda *c: F.array(*[F.lit(x) for x in c])
    assert one(spark, C.overlap_score(a(1, 2, 3, 4), a(3, 4))) == 1.0
    assert one(spark, C.overlap_score(a(99), a(7))) == 1.0
    assert one(spark, C.overlap(a(99), a(7, 3))) == [3, 7]
    assert one(spark, C.matches(a(5), a(99))) is False
    assert one(spark, C.locarno_matches(F.array(F.lit("06-01")), ["06"])) is True


def test_scores(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, S.cosine(v(1, 0), v(0, 0))) == 0.0
    assert abs(one(spark, S.cosine(v(1, 1), v(2, 2))) - 1) < 1e-12
    assert abs(one(spark, S.text_visual(F.lit(0.5), F.lit(0.9))) - 0.95) < 1e-12
    assert abs(one(spark, S.visual_score(F.lit(0.8), F.lit(0.0), F.lit(0.0), F.lit(False))) - 0.8) < 1e-12
    assert one(spark, S.bounded(0.4, 0.6, F.lit(5.0))) == 0.6


@pytest.mark.parametrize("name, codes", [
    ("Smith", ("SM0", "XMT")), ("Schmidt", ("XMT", "SMT")), ("Thomas", ("TMS", "TMS")), ("Knight", ("NT", "NT")), ("Nike", ("NK", "NK")), ("Naik", ("NK", "NK")),
    ("Philips", ("FLPS", "FLPS")), ("Xerox", ("SRKS", "SRKS")), ("Wright", ("RT", "RT")), ("Cheese", ("XS", "XS")), ("Bacher", ("PKR", "PKR")), ("Ghost", ("KST", "KST")), ("Laugh", ("LF", "LF")), ("Sugar", ("XKR", "SKR")), ("Jose", ("HS", "HS")), ("", ("", "")),
])
def test_double_metaphone(name, codes):
    assert P.double_metaphone(name) == codes


def test_sound_similarity(spark):
    s = lambda a, b: one(spark, P.sound_similarity(F.lit(a), F.lit(b)))
    assert s("NIKE", "nike") == 1.0 and s("", "x") == 0.0 and s("Nike", "Naik") > 0.7 > s("Nike", "Samsung") and s("Doğan", "Togan") > 0.8
    assert P.first_syllable("samsung") == "sam" and P.first_syllable("google") == "goog" and P.first_syllable("apple") == "ap"
    assert one(spark, P.ocr_similarity(F.lit("AB C"), F.lit("abc"))) == 1.0 and one(spark, P.ocr_similarity(F.lit("abcd"), F.lit("abce"))) == 0.68
    assert one(spark, P.difference_ratio(F.lit("abcd"), F.lit("bcde"))) == 0.75
