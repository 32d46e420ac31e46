"""Confidence in a text by its age."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Freshness:
    """Ages in hours. ``max_age_hours`` is carried for callers; no score reads it."""

    max_age_hours: float = 24.0
    critical_age_hours: float = 4.0
    min_score: float = 0.1
    decay_rate: float = 0.15

    def confidence(self, age: Column) -> Column:
        decayed = F.exp(F.lit(-self.decay_rate) * (age - F.lit(self.critical_age_hours)))
        return F.when(age <= self.critical_age_hours, F.lit(1.0)).when(
            age.isNotNull(), F.greatest(decayed, F.lit(self.min_score))
        )

    def is_fresh(self, age: Column) -> Column:
        return age <= self.critical_age_hours

    def boost(self, age: Column) -> Column:
        return boost(self.confidence(age))


def age_hours(updated_at: Column, as_of: Column) -> Column:
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(updated_at.cast("timestamp"))
    return micros / F.lit(3.6e9)


def category(age: Column) -> Column:
    return (
        F.when(age <= 1, "real-time")
        .when(age <= 4, "very_fresh")
        .when(age <= 12, "fresh")
        .when(age <= 24, "recent")
        .when(age.isNotNull(), "outdated")
    )


def boost(confidence: Column) -> Column:
    return confidence * confidence


def freshness_columns(updated_at: Column, as_of: Column, model: Freshness = Freshness()) -> dict[str, Column]:
    """The freshness record of a row, for ``withColumns``."""
    age = age_hours(updated_at, as_of)
    return {
        "age_hours": age,
        "confidence_score": model.confidence(age),
        "is_fresh": model.is_fresh(age),
        "freshness_category": category(age),
        "boost_factor": model.boost(age),
    }
