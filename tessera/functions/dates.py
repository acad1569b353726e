"""Date functions. The day of reference is always an argument, never the clock's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import status as ST


def parse_date(c: Column, day_first: bool = True) -> Column:
    """A date in one of three layouts, tried in the order of the caller's kind of source; null if none fits."""
    layouts = ["dd/MM/yyyy", "yyyy-MM-dd", "dd.MM.yyyy"] if day_first else ["yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy"]
    return F.coalesce(*[F.try_to_date(F.trim(c), f) for f in layouts])


def appeal_deadline(published: Column) -> Column:
    """Two calendar months later, at the month's end where it is shorter."""
    return F.add_months(published, 2)


def deadline_status(status: Column, published: Column, deadline: Column, as_of: Column) -> Column:
    """Stage of the opposition period of an application; published is the date of its bulletin."""
    left = F.datediff(deadline, as_of)
    final = ST.canonical(status)
    return (
        F.when(final.isin(ST.REFUSED, ST.WITHDRAWN), "resolved")
        .when(final == ST.OPPOSED, "opposed")
        .when(final.isin(ST.REGISTERED, ST.RENEWED), "registered")
        .when(final == ST.EXPIRED, "expired")
        .when(published.isNull(), "pre_publication")
        .when(deadline.isNull(), "unknown")
        .when(left < 0, "expired")
        .when(left <= 7, "active_critical")
        .when(left <= 30, "active_urgent")
        .otherwise("active")
    )


def deadline_open(deadline: Column, final_status: Column, current_status: Column, as_of: Column) -> Column:
    return F.coalesce(deadline.isNotNull() & (deadline >= as_of) & (F.coalesce(final_status, current_status) == "Yayında"), F.lit(False))


def expiry(applied: Column, grace_days: int = 183) -> Column:
    """Ten years and the days of grace; from 29 February, 3652 days stand for ten years."""
    leap = (F.month(applied) == 2) & (F.dayofmonth(applied) == 29)
    return F.date_add(F.when(leap, F.date_add(applied, 3652)).otherwise(F.add_months(applied, 120)), grace_days)


def recent(applied: Column, as_of: Column, years: int = 11) -> Column:
    """Applied for within the last years, or at an unknown date."""
    return applied.isNull() | (applied >= F.add_months(as_of, -12 * years))


def urgency(days_left: Column) -> Column:
    return F.when(days_left <= 7, "critical").when(days_left <= 14, "urgent").when(days_left <= 30, "soon").otherwise("normal")


def renewal_urgency(days_left: Column) -> Column:
    return F.when(days_left < 0, "grace").when(days_left <= 90, "critical").when(days_left <= 180, "urgent").when(days_left <= 365, "upcoming").otherwise("later")


def bulletin_number(c: Column) -> Column:
    """"2025-08" and "2025/8" alike as "2025/8"."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{4}[-/]0*\d+$"), F.concat(F.regexp_extract(t, r"^(\d{4})", 1), F.lit("/"), F.regexp_extract(t, r"[-/]0*(\d+)$", 1))).otherwise(t)


def bulletin_of(folder: Column) -> Column:
    """struct<no, day> that a delivery's folder tells: BLT_2024_05 is number 2024/05 of May 2024, GZ-481_2023-02-07 number 481."""
    head = r"(?i)(?:BLT|BULTEN|GZ|GAZETE)[_-]?"
    period = F.nullif(F.regexp_extract(folder, "^" + head + r"(\d{4})[_-]\d{2}$", 1), F.lit(""))
    number = F.nullif(F.regexp_extract(folder, head + r"(\d+)", 1), F.lit(""))
    written = F.replace(F.regexp_extract(folder, r"\d{4}[_-]\d{2}[_-]\d{2}|\d{4}[_-]\d{2}", 0), F.lit("_"), F.lit("-"))
    day = F.try_to_date(F.when(F.length(written) == 7, F.concat(written, F.lit("-01"))).otherwise(written), "yyyy-MM-dd")
    return F.struct(F.coalesce(F.concat(period, F.lit("/"), F.right(folder, F.lit(2))), number).alias("no"), day.alias("day"))


def alert_visible(kind: Column, deadline: Column, final_status: Column, current_status: Column, as_of: Column) -> Column:
    """Alerts on similar marks are shown while their deadline is open, all others always."""
    return (F.coalesce(kind, F.lit("")) != "similarity") | deadline_open(deadline, final_status, current_status, as_of)
