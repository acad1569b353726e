"""Statuses of registry rights: canonical labels, their aliases, their ranks, and what they mean for a new application."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values ---------------------------------------------------------------------------------------------------
APPLIED, PUBLISHED, REGISTERED, OPPOSED, RENEWED = "Başvuruldu", "Yayında", "Tescil Edildi", "İtiraz Edildi", "Yenilendi"
REFUSED, WITHDRAWN, CANCELLED, EXPIRED, PARTIAL = "Reddedildi", "Geri Çekildi", "İptal Edildi", "Süresi Doldu", "Kısmi Red"
TRANSFERRED, UNKNOWN = "Devredildi", "Bilinmiyor"
ALIASES = {
    "Registered": REGISTERED, "Published": PUBLISHED, "Renewed": RENEWED, "Opposed": OPPOSED, "Applied": APPLIED, "Refused": REFUSED,
    "Cancelled": CANCELLED, "Partial Refusal": PARTIAL, "Expired": EXPIRED, "Withdrawn": WITHDRAWN, "Transferred": TRANSFERRED, "Unknown": UNKNOWN,
}
#: Level and weight of an existing right by its status.
CATEGORY = {
    REGISTERED: ("RISK", 1.0), PUBLISHED: ("RISK", 1.0), RENEWED: ("RISK", 1.0), OPPOSED: ("RISK", 0.9), APPLIED: ("RISK", 0.85),
    REFUSED: ("WARNING", 0.8), CANCELLED: ("WARNING", 0.75), PARTIAL: ("WARNING", 0.6),
    EXPIRED: ("OPPORTUNITY", 0.3), WITHDRAWN: ("OPPORTUNITY", 0.3), UNKNOWN: ("UNKNOWN", 0.5),
}
RANK = {RENEWED: 4, REGISTERED: 3, TRANSFERRED: 3, EXPIRED: 2, OPPOSED: 2, REFUSED: 2, WITHDRAWN: 2, CANCELLED: 2, PUBLISHED: 1, PARTIAL: 1, APPLIED: 0}
#: Words that tell a status, in the order in which they are tried.
KEYWORDS = [
    (REFUSED, "geçersiz gecersiz reddedildi red_edildi ret_kararı red_kararı refused rejected".split()),
    (WITHDRAWN, "feragat geri_çekildi geri_cekildi geri_alındı geri_alindi vazgeçildi vazgecildi withdrawn".split()),
    (CANCELLED, "iptal_edildi mahkeme_kararı mahkeme_karari cancelled canceled".split()),
    (REGISTERED, "tescil_edildi tescilli kabul_edildi registered".split()),
    (OPPOSED, "itiraz opposed".split()),
    (EXPIRED, "sona_erdi süresi_doldu suresi_doldu hükümsüz hukumsuz expired yürürlükten yururlukten".split()),
    (PUBLISHED, "yayınlandı yayinlandi ilan_edildi published".split()),
    (RENEWED, "renewed yenilendi".split()),
]


def _map(pairs: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def canonical(c: Column) -> Column:
    """English names as the registry's own; others stay."""
    return F.coalesce(_map(ALIASES, c), c)


def level(c: Column) -> Column:
    """RISK, WARNING, OPPORTUNITY or UNKNOWN."""
    return F.coalesce(_map({k: v[0] for k, v in CATEGORY.items()}, canonical(c)), F.lit(CATEGORY[UNKNOWN][0]))


def weight(c: Column) -> Column:
    """How much an existing right of this status counts; that of an unknown status where it is not listed."""
    return F.coalesce(_map({k: v[1] for k, v in CATEGORY.items()}, canonical(c)), F.lit(CATEGORY[UNKNOWN][1]))


def rank(c: Column) -> Column:
    return F.coalesce(_map(RANK, canonical(c)), F.lit(-1))


def told(text: Column) -> Column:
    """The status that a text tells in so many words, or null."""
    low = F.trim(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("̇"), F.lit("")))
    out = F.when(low == "", F.lit(None).cast("string"))
    for status, words in KEYWORDS:
        out = out.when(low.rlike("|".join(w.replace("_", " ") for w in words)), F.lit(status))
    return out


def from_delivery(folder: Column, text: Column, registration_no: Column) -> Column:
    """What a text tells; else registered by a number or a gazette, published by a bulletin, applied for otherwise."""
    up = F.upper(folder)
    return (
        F.when(told(text).isNotNull(), told(text))
        .when(has_number(registration_no), REGISTERED)
        .when(up.startswith("GZ_") | F.contains(up, F.lit("GAZETE")), REGISTERED)
        .when(up.startswith("BLT_") | F.contains(up, F.lit("BULTEN")), PUBLISHED)
        .otherwise(APPLIED)
    )


def has_number(c: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return ~t.isin("", "null", "none", "-", "yok", "n/a", "na")


def source_of(folder: Column) -> Column:
    """APP, GZ or BLT by a delivery's folder."""
    up = F.upper(F.coalesce(folder, F.lit("")))
    return F.when(up.startswith("APP_") | up.startswith("LIVE_") | F.contains(up, F.lit("SCRAPED")), "APP").when(up.startswith("GZ_") | F.contains(up, F.lit("GAZETE")), "GZ").otherwise("BLT")
