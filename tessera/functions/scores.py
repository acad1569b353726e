"""Vector similarity and the combination of signals into scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a vector without length, null for a null vector."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def weighted(signals: dict[str, float]) -> Column:
    """Weighted sum of named columns, missing ones as 0."""
    return reduce(lambda x, y: x + y, [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in signals.items()])


#: Weights of the registries' hybrid searches, by query kind.
DESIGN_IMAGE = {"dinov2": 0.55, "clip": 0.30, "color": 0.10, "text": 0.05}
DESIGN_TEXT = {"text": 0.70, "dinov2": 0.20, "clip": 0.10}
HYBRID_TEXT = {"lexical": 0.40, "semantic": 0.60}
HYBRID_ALL = {"lexical": 0.25, "semantic": 0.35, "image": 0.40}


def visual_score(clip: Column, dino: Column, ocr: Column, has_ocr: Column) -> Column:
    """Weights .45, .35, .15 of the active components, normalised over them; 0 if none is active."""
    parts = [(clip, F.coalesce(clip, F.lit(0.0)) != 0, 0.45), (dino, F.coalesce(dino, F.lit(0.0)) != 0, 0.35), (ocr, has_ocr, 0.15)]
    total = reduce(lambda x, y: x + y, [F.when(on, F.coalesce(v, F.lit(0.0)) * w).otherwise(0.0) for v, on, w in parts])
    weight = reduce(lambda x, y: x + y, [F.when(on, F.lit(w)).otherwise(0.0) for _, on, w in parts])
    return F.when(weight == 0, F.lit(0.0)).otherwise(total / weight)


def text_visual(text: Column, visual: Column) -> Column:
    """The greater signal, raised a little where the other supports it."""
    low, high = F.least(text, visual), F.greatest(text, visual)
    boost = F.when(low >= 0.40, F.least(F.lit(0.08), low * 0.10)).otherwise(F.least(F.lit(0.03), low * 0.05))
    return F.least(F.lit(1.0), high + boost)


def score_severity(score: Column) -> Column:
    return F.when(score >= 0.85, "critical").when(score >= 0.70, "high").when(score >= 0.55, "medium").otherwise("low")


#: Severity of a registry event; that of others is medium.
EVENT_SEVERITY = {
    "critical": "cancellation seizure precautionary_seizure bankruptcy".split(),
    "high": "injunction precautionary_injunction transfer merger partial_transfer withdrawal".split(),
    "medium": "renewal license".split(),
    "low": "seizure_lift injunction_lift restriction_lift correction address_change name_change".split(),
}


def event_severity(kind: Column) -> Column:
    """Null for an absent or empty event type."""
    out = F.when(F.coalesce(kind, F.lit("")) == "", F.lit(None).cast("string"))
    for severity, kinds in EVENT_SEVERITY.items():
        out = out.when(F.lower(kind).isin(kinds), severity)
    return out.otherwise("medium")


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.90, "critical").when(score >= 0.80, "very_high").when(score >= 0.70, "high").when(score >= 0.50, "medium").otherwise("low")


def bounded(floor: float, ceiling: float, evidence: Column) -> Column:
    """A cap between floor and ceiling by evidence clamped to 0..1."""
    return floor + (ceiling - floor) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), evidence))


def translation_band(score: Column) -> Column:
    return F.when(score >= 1.0, "translation_exact").when(score >= 0.85, "translation_high").when(score >= 0.6, "translation_partial").otherwise("none")
