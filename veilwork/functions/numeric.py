"""Numeric column expressions Spark has no built-in for."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 15 inner percentile levels of a column profile (fixed values).
PROBS = (0.01, 0.02, 0.05, 0.10, 0.20, 0.25, 0.35, 0.50, 0.65, 0.75, 0.80, 0.90, 0.95, 0.98, 0.99)
# Published coefficients of the normal tail (fixed values), highest power first.
CDF_TAIL = [1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530]
PROB_NAMES = tuple(f"q{round(p * 100):02d}" for p in PROBS)


def is_numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_integer_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def rounded(value: Column, digits: int) -> Column:
    """Round and drop negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def clamp(value: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), value))


def polynomial(x: Column, coefficients: list[float]) -> Column:
    """Horner evaluation, highest power first."""
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_cdf(x: Column) -> Column:
    """Standard normal CDF by the Abramowitz-Stegun 26.2.17 series (absolute error below 7.5e-8)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * F.abs(x))
    tail = polynomial(t, CDF_TAIL) * t
    density = F.exp(-x * x / 2.0) / F.lit(math.sqrt(2.0 * math.pi))
    upper = density * tail
    return F.when(x >= 0, F.lit(1.0) - upper).otherwise(upper)


def normal_cdf_values() -> Callable[[np.ndarray], np.ndarray]:
    """A function with the same series over an array; it needs no import inside a task."""

    def cdf(x: np.ndarray) -> np.ndarray:
        t = 1.0 / (1.0 + 0.2316419 * np.abs(x))
        upper = np.exp(-x * x / 2.0) / math.sqrt(2.0 * math.pi) * (np.polyval(CDF_TAIL, t) * t)
        return np.where(x >= 0, 1.0 - upper, upper)

    return cdf


def probit(p: Column) -> Column:
    """Inverse standard normal CDF by Acklam's rational approximation (relative error below 1.2e-9)."""
    # Published coefficients (fixed values), highest power first.
    a = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
    b = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
    c = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
    d = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]
    cut = 0.02425
    q = p - F.lit(0.5)
    centre = polynomial(q * q, a) * q / polynomial(q * q, b)
    low = F.sqrt(F.lit(-2.0) * F.log(p))
    high = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    return (
        F.when(p < cut, polynomial(low, c) / polynomial(low, d))
        .when(p > 1.0 - cut, -polynomial(high, c) / polynomial(high, d))
        .otherwise(centre)
    )


def plain_text(column: Column, dtype: T.DataType) -> Column:
    """Text form of a cell; doubles are written without an exponent, structures as JSON."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = column.cast("string")
        wide = F.regexp_replace(column.cast("decimal(38,8)").cast("string"), r"(\.\d*?[1-9])0+$|\.0+$", "$1")
        fixed = F.when(F.instr(wide, ".") > 0, wide).otherwise(F.concat(wide, F.lit(".0")))
        return F.when(F.instr(text, "E") > 0, F.coalesce(fixed, text)).otherwise(text)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def entropy_bits(text: Column) -> Column:
    """Shannon entropy in bits per character of a text cell, all in the JVM.

    Each distinct character is counted with one native ``replace``, so the cost is length x alphabet.
    """
    n = F.length(text).cast("double")
    letters = F.array_distinct(F.split(text, ""))
    shares = F.transform(letters, lambda ch: (n - F.length(F.replace(text, ch, F.lit("")))) / n)
    return -F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))
