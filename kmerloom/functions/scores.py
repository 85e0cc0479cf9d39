"""Column functions on arrays of class probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def argmax(p: Column) -> Column:
    """Class of the highest probability, the lowest class where equal."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def score_delta_mean(p: Column, size: int | None = None) -> Column:
    """Distance to the mean. size: number of classes, where those of probability 0 are left out of p."""
    return F.array_max(p) - _sum(p) / (F.size(p) if size is None else F.lit(size))


def score_min_max(p: Column, size: int | None = None) -> Column:
    """Distance to the next lower probability; null where all are equal."""
    lower = F.array_max(F.filter(p, lambda x: x != F.array_max(p)))
    if size is not None:
        lower = F.coalesce(lower, F.when((F.size(p) < size) & (F.array_max(p) > 0), 0.0))
    return F.array_max(p) - lower


def accepts(func: str, p: Column, t: Column, size: int | None = None) -> Column:
    """Whether an acceptance function takes a window at threshold t."""
    if func == "delta_mean":
        return score_delta_mean(p, size) > t
    if func == "min_max":
        return score_min_max(p, size) > t
    if func == "delta_sum":
        return F.array_max(p) > (_sum(p) - F.array_max(p)) + t
    return F.lit(True)


def clamp_threshold(t: float | None) -> float:
    """Acceptance threshold within 0.01 and 1."""
    if t is None:
        raise ValueError("a threshold is needed")
    return min(1.0, max(0.01, float(t)))


def clamped(t: Column) -> Column:
    """clamp_threshold() of a column."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.01), t))


def ladder(t: float, step: float = 0.05) -> list[float]:
    """Thresholds tried in turn, by repeated subtraction, while positive."""
    out, t = [], min(t, 1.0)
    while t > 0:
        out.append(t)
        t -= step
    return out
