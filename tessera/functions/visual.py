"""Caps on the similarity of two logos, and how it joins the score of the names. All are Columns over plain columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scores import bounded

# fixed values: agreement that lifts a cap, and floors, ceilings and thresholds of the caps
STRONG_TEXT, STRONG_OCR, STRONG_PART = 0.78, 0.78, 0.90
BOTH_PLAIN, ONE_PLAIN = (0.35, 0.45), (0.45, 0.55)
SAME_LOGO, IMAGE_ONLY, LAYOUT_CAP = 0.88, (0.50, 0.68), 0.84
LAYOUTS = {"strict": (0.84, 0.72, 0.78, 1.0), "balanced": (0.81, 0.74, 0.765, 0.10)}
LOW, MIDDLE, TOP = 0.80, 0.90, 0.69
SHORT_ANCHOR = 0.58


def unit(c: Column) -> Column:
    """c between 0 and 1; 0 for null."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.cast("double"), F.lit(0.0))))


def _at_most(score: Column, limit: Column | float) -> Column:
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    return F.when(score > limit, F.round(limit, 4)).otherwise(score)


def plain_wordmark(visual: Column, agreement: Column, plain_a: Column, plain_b: Column) -> Column:
    """A logo that is only a written name counts little where neither names nor texts read from the logos agree."""
    v, e = unit(visual), unit(agreement)
    plain_a, plain_b = F.coalesce(plain_a, F.lit(False)), F.coalesce(plain_b, F.lit(False))
    limit = F.when(plain_a & plain_b, bounded(*BOTH_PLAIN, e / STRONG_TEXT)).otherwise(bounded(*ONE_PLAIN, e / STRONG_TEXT))
    return F.when((plain_a | plain_b) & (e < STRONG_TEXT), _at_most(v, limit)).otherwise(v)


def image_only(visual: Column, clip: Column, dino: Column, ocr: Column, read_alike: Column, graphic: Column) -> Column:
    """Cap of a match without a name to compare.

    The same logo, or one whose read text drives the match (read_alike), keeps its score; the same logo in another
    layout, both being graphics, has at most 0.84; others a cap by how strong and how even the two models are.
    """
    v, c, d, o = unit(visual), unit(clip), unit(dino), unit(ocr)
    both = (c > 0) & (d > 0)
    mean = F.when(both, (c + d) / 2).otherwise(c + d)
    high = F.greatest(c, d)
    low = F.when(both, F.least(c, d)).otherwise(high)
    same = both & (low >= SAME_LOGO) & (mean >= SAME_LOGO)
    variant = F.lit(False)
    for strong, weak, middle, spread in LAYOUTS.values():
        variant |= (high >= strong) & (low >= weak) & (mean >= middle) & (high - low <= spread)
    evidence = 0.50 * F.least(mean / SAME_LOGO, F.lit(1.0)) + 0.40 * F.least(low / SAME_LOGO, F.lit(1.0)) + 0.10 * F.least(o / STRONG_OCR, F.lit(1.0))
    return (
        F.when((v <= 0) | F.coalesce(read_alike, F.lit(False)) | same | (high <= 0), v)
        .when(both & F.coalesce(graphic, F.lit(False)) & variant, F.least(v, F.lit(LAYOUT_CAP)))
        .otherwise(_at_most(v, bounded(*IMAGE_ONLY, evidence)))
    )


def with_text(text: Column, visual: Column, clip: Column, dino: Column, ocr: Column, weak: Column, limited: Column, short: Column, plain_capped: Column) -> Column:
    """Total of a text score and a guarded visual score.

    weak, limited, short: the text score bears a cap of an absent anchor, of a limited one, of a short inexact one
    beside other words. A weak text gives way to the logo, whose score is then capped unless its text or both models
    confirm it. The rise of two signals that agree is left out where a guard is active.
    """
    t, v = unit(text), unit(visual)
    strong_ocr = unit(ocr) >= STRONG_OCR
    confirmed = strong_ocr | ((unit(clip) >= STRONG_PART) & (unit(dino) >= STRONG_PART))
    weak, limited, short = weak & (v > 0), limited & (v > 0) & ((v < LOW) | ~confirmed), short & (v > 0) & ~confirmed
    own = F.when(weak, 0.0).otherwise(t)
    low, high = F.least(own, v), F.greatest(own, v)
    boost = F.when(low >= 0.40, F.least(F.lit(0.08), low * 0.10)).otherwise(F.least(F.lit(0.03), low * 0.05))
    boost = F.when(limited | short | plain_capped, 0.0).otherwise(boost)
    total = F.round(F.least(F.lit(1.0), high + boost), 4)
    lowest = (
        F.when(weak & (v < LOW), bounded(0.20, 0.45, v / LOW))
        .when(weak & (v < MIDDLE) & ~strong_ocr, bounded(0.55, TOP, (v - LOW) / 0.10))
        .when(weak & (v >= MIDDLE) & ~confirmed, bounded(0.66, TOP, (v - MIDDLE) / 0.10))
    )
    limit = F.when(v < LOW, bounded(0.58, 0.66, v / LOW)).otherwise(bounded(0.62, TOP, (v - LOW) / 0.20))
    # least() passes over the nulls of caps that do not apply
    return F.least(total, F.round(lowest, 4), F.when(limited, F.round(limit, 4)), F.when(short, F.lit(SHORT_ANCHOR)))
