"""Distances and scores between vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distances are rounded to this many places before ranking. Stored vectors are
# single precision, so nothing real is lost, and two equal distances summed in
# another order still tie and fall back to the id.
DISTANCE_PLACES = 9

# Score limits of the relevance bands.
HIGH_SCORE = 0.40
MODERATE_SCORE = 0.20


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision."""
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")))
    total = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g)
    return F.round(total, DISTANCE_PLACES)


def score_of(distance: Column) -> Column:
    """Similarity in (0, 1]: 1 for distance 0, falling with distance."""
    return F.lit(1.0) / (F.lit(1.0) + distance)


def relevance_band(score: Column) -> Column:
    """`high`, `moderate` or `weak`; the limits themselves count as moderate."""
    return (
        F.when(score > HIGH_SCORE, "high").when(score >= MODERATE_SCORE, "moderate").otherwise("weak")
    )
