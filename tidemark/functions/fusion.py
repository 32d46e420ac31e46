"""Three scores into one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-10
DYNAMIC_VARIANCE = 0.1
DYNAMIC_LOW = (0.33, 0.34, 0.33)
DYNAMIC_HIGH = (0.25, 0.5, 0.25)


def in_unit_range(score: Column, mode: str = "null") -> Column:
    """Scores outside [0, 1]: ``null`` drops them, ``clamp`` cuts them, ``error`` stops the job."""
    ok = score.between(0, 1)
    if mode == "null":
        return F.when(ok, score)
    if mode == "clamp":
        return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    if mode == "error":
        return F.when(score.isNull() | ok, score).otherwise(
            F.raise_error(F.concat(F.lit("score must be between 0 and 1: "), score.cast("string"))).cast("double")
        )
    raise ValueError(f"unknown range mode: {mode}")


def variance(*scores: Column) -> Column:
    """Population variance across columns of one row."""
    n = F.lit(float(len(scores)))
    mean = sum(scores[1:], scores[0]) / n
    squares = [(s - mean) * (s - mean) for s in scores]
    return sum(squares[1:], squares[0]) / n


@dataclass(frozen=True)
class Fusion:
    similarity: float = 0.15
    cross_encoder: float = 0.35
    time_decay: float = 0.5
    dynamic: bool = False

    def weights(self, s: Column, c: Column, t: Column) -> tuple[Column, Column, Column]:
        if not self.dynamic:
            return F.lit(self.similarity), F.lit(self.cross_encoder), F.lit(self.time_decay)
        low = variance(s, c, t) < DYNAMIC_VARIANCE
        return tuple(F.when(low, F.lit(a)).otherwise(F.lit(b)) for a, b in zip(DYNAMIC_LOW, DYNAMIC_HIGH))

    def weighted_average(self, s: Column, c: Column, t: Column) -> Column:
        a, b, d = self.weights(s, c, t)
        return a * s + b * c + d * t

    def harmonic_mean(self, s: Column, c: Column, t: Column) -> Column:
        a, b, d = self.weights(s, c, t)
        return (a + b + d) / (a / (s + EPSILON) + b / (c + EPSILON) + d / (t + EPSILON))

    def geometric_mean(self, s: Column, c: Column, t: Column) -> Column:
        a, b, d = self.weights(s, c, t)
        return F.pow(s, a) * F.pow(c, b) * F.pow(t, d)
