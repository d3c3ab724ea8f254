"""Reproducible uniform and normal draws that depend only on (seed, stream, row id).

``rand(seed)`` changes with the partitioning and cannot be recomputed after an executor is lost. These draws are
plain integer arithmetic on the row id: two affine terms whose multipliers differ per stream, followed by two
shift-xor and multiply rounds, all modulo the prime 2^31 - 1 so that no product leaves 63 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647


def _constants(seed: int, stream: str) -> list[int]:
    digest = hashlib.md5(f"{seed}/{stream}".encode()).hexdigest()
    pieces = [int(digest[i : i + 6], 16) for i in range(0, 30, 6)]
    return [1_000_003 + (p * 2654435761) % (PRIME - 2_000_003) for p in pieces]


def uniform(row_id: Column, seed: int, stream: str) -> Column:
    """A double strictly between 0 and 1 for each non-negative row id."""
    a, b, c, m1, m2 = _constants(seed, stream)
    prime = F.lit(PRIME).cast("long")
    low = row_id.cast("long") % prime
    high = F.floor(row_id.cast("long") / prime) % prime
    x = ((low * F.lit(a).cast("long")) % prime + (high * F.lit(b).cast("long")) % prime + F.lit(c).cast("long")) % prime
    x = (x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(m1).cast("long")) % prime
    x = (x.bitwiseXOR(F.shiftright(x, 13)) * F.lit(m2).cast("long")) % prime
    return (x.cast("double") + F.lit(0.5)) / F.lit(float(PRIME))


def uniform_sql(row_id: str, seed: int, stream: str) -> str:
    """The same draw as a standard SQL expression, for the equality checks."""
    a, b, c, m1, m2 = _constants(seed, stream)
    x = (
        f"((((({row_id})::BIGINT % {PRIME}) * {a}::BIGINT) % {PRIME} + "
        f"(((({row_id})::BIGINT // {PRIME}) % {PRIME}) * {b}::BIGINT) % {PRIME} + {c}::BIGINT) % {PRIME})"
    )
    x = f"((xor({x}, ({x}) >> 15) * {m1}::BIGINT) % {PRIME})"
    x = f"((xor({x}, ({x}) >> 13) * {m2}::BIGINT) % {PRIME})"
    return f"(({x})::DOUBLE + 0.5) / {float(PRIME)}::DOUBLE"


def normal(row_id: Column, seed: int, stream: str) -> Column:
    """A standard normal draw by the Box-Muller transform of two uniform streams."""
    u1 = uniform(row_id, seed, stream + "/radius")
    u2 = uniform(row_id, seed, stream + "/angle")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def normal_values(seed: int, stream: str) -> Callable[[np.ndarray], np.ndarray]:
    """A function that gives the same normal draws for an array of row ids; it needs no import inside a task."""

    def uniforms(ids: np.ndarray, constants: list[int]) -> np.ndarray:
        a, b, c, m1, m2 = constants
        x = ((ids % PRIME * a) % PRIME + (ids // PRIME % PRIME * b) % PRIME + c) % PRIME
        x = ((x ^ (x >> 15)) * m1) % PRIME
        x = ((x ^ (x >> 13)) * m2) % PRIME
        return (x + 0.5) / float(PRIME)

    radius, angle = _constants(seed, stream + "/radius"), _constants(seed, stream + "/angle")

    def draw(ids: np.ndarray) -> np.ndarray:
        return np.sqrt(-2.0 * np.log(uniforms(ids, radius))) * np.cos(2.0 * math.pi * uniforms(ids, angle))

    return draw


def uuid_text(row_id: Column, seed: int, stream: str) -> Column:
    """A version-4 shaped identifier from the md5 of (seed, stream, row id)."""
    h = F.md5(F.concat_ws("/", F.lit(str(seed)), F.lit(stream), row_id.cast("string")))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("4"), F.substring(h, 14, 3)),
        F.concat(F.lit("a"), F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )
