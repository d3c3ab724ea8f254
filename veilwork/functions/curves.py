"""Draws from stored statistics: a 17-knot quantile curve or a table of weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions.numeric import PROB_NAMES, PROBS

LEVELS = (0.0, *PROBS, 1.0)


def curve_of(row) -> list[float]:
    """The knots of one profile row (min, 15 percentiles, max), made non-decreasing."""
    lo, hi = sorted((float(row["min"]), float(row["max"])))
    knots = [lo]
    for name in PROB_NAMES:
        knots.append(max(knots[-1], float(row[name])))
    return [*knots, max(knots[-1], hi)]


def curve_column() -> Column:
    """The same knots as an array column over profile columns."""
    return F.array(F.col("min"), *[F.col(n) for n in PROB_NAMES], F.col("max"))


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def segment(u: Column) -> Column:
    """Index of the curve segment that holds ``u``."""
    out = F.lit(len(LEVELS) - 2)
    for i in reversed(range(len(LEVELS) - 2)):
        out = F.when(u < LEVELS[i + 1], i).otherwise(out)
    return out


def curve_value(knots: Column, u: Column) -> Column:
    """Linear interpolation of the inverse distribution function.

    ``u`` is read many times, so callers pass a column made in an earlier projection, not an expression.
    """
    at = segment(u)
    levels = literal(LEVELS)
    lo, hi = F.get(knots, at), F.get(knots, at + 1)
    a, b = F.get(levels, at), F.get(levels, at + 1)
    return lo + (hi - lo) * (u - a) / (b - a)


def curve_draw(knots: Column, u: Column, jitter: Column) -> Column:
    """Interpolation plus a jitter of at most 5 % of the segment's width, kept inside the curve's ends."""
    at = segment(u)
    width = F.get(knots, at + 1) - F.get(knots, at)
    raw = curve_value(knots, u) + (jitter - 0.5) * width * 0.1
    return F.greatest(F.get(knots, F.lit(0)), F.least(F.get(knots, F.lit(len(LEVELS) - 1)), raw))


def weighted_pick(values: Column, ends: Column, u: Column) -> Column:
    """The value whose cumulative weight range holds ``u``; ``ends`` are the running sums of normalised weights."""
    at = F.size(F.filter(ends, lambda e: e <= u))
    # the second use of ``u`` keeps the optimiser from moving its formula into the per-element comparison
    return F.when(u.isNotNull(), F.get(values, F.least(at, F.size(values) - 1)))


def running(weights: Sequence[float]) -> list[float]:
    total, out, acc = float(sum(weights)) or 1.0, [], 0.0
    for w in weights:
        acc += float(w)
        out.append(acc / total)
    return out
