"""Fuzzy-set scalar functions on columns.

Grades are INT levels ``0..scale`` (tenths by default), so Lukasiewicz
arithmetic is exact.  Goguen ratios are floored or rounded on the same grid in
integer arithmetic, or kept as DOUBLE where the caller asks for no rounding.
"""

from __future__ import annotations

from enum import Enum
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerances of the fuzzy calculus on DOUBLE grades.
GOGUEN_EPS = 1e-6
EQUAL_EPS = 1e-6
SUPPORT_EPS = 1e-9

# Number of equal steps in the three standard level scales.
LEVEL_SCALES = {"L1": 10, "L2": 100, "L3": 1000}


class Implication(Enum):
    LUKASIEWICZ = "lukasiewicz"
    GOGUEN = "goguen"


class Rounding(Enum):
    """How a derivation falls back onto the level grid."""

    FLOOR = "floor"
    NEAREST = "nearest"
    NONE = "none"


def level_grid(scale: int) -> Column:
    """ARRAY<INT> 0..scale, the level scale in integer steps."""
    return F.sequence(F.lit(0), F.lit(scale))


def implies_real(a: Column, b: Column, kind: Implication) -> Column:
    """a -> b on DOUBLE grades in [0, 1]."""
    if kind is Implication.LUKASIEWICZ:
        return F.least(F.lit(1.0), F.lit(1.0) - a + b)
    return F.when((a <= b + GOGUEN_EPS) | (a < GOGUEN_EPS), F.lit(1.0)).otherwise(b / a)


def implies_level(a: Column, b: Column, kind: Implication, scale: int,
                  rounding: Rounding = Rounding.FLOOR) -> Column:
    """a -> b on INT levels; Goguen ratios are put on the grid exactly."""
    if kind is Implication.LUKASIEWICZ:
        return F.least(F.lit(scale), F.lit(scale) - a + b).cast("int")
    num, den = b.cast("bigint") * scale, a.cast("bigint")
    if rounding is Rounding.NEAREST:  # a tie goes to the lower level
        num, den = num * 2 + a - 1, den * 2
    ratio = (num - num % den) / den  # exact: the numerator is now a multiple of den
    return F.when(a <= b, F.lit(scale)).otherwise(ratio).cast("int")


def quantize(value: Column, scale: int) -> Column:
    """Nearest level of a DOUBLE grade; a tie goes to the lower level."""
    level = F.ceil(value * scale - 0.5)
    return F.least(F.lit(scale), F.greatest(F.lit(0), level)).cast("int")


def pack_tenths(value: Column) -> Column:
    """Tenths of a DOUBLE grade, half away from zero, clamped to 0..10."""
    return F.least(F.lit(10), F.greatest(F.lit(0), F.floor(value * 10 + 0.5))).cast("int")


def intersection(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def union(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def equal(a: Column, b: Column, eps: float = 0.0) -> Column:
    if eps == 0.0:
        return a == b
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= eps), lambda ok: ok)


def subset(a: Column, b: Column) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: x <= y), lambda ok: ok)


def strict_subset(a: Column, b: Column) -> Column:
    return subset(a, b) & (a != b)


def set_size(grades: Column) -> Column:
    """Sum of the grades."""
    return F.aggregate(grades, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def support_card(grades: Column) -> Column:
    """Number of attributes with a positive grade."""
    return F.size(F.filter(grades, lambda x: x > SUPPORT_EPS))


def direct_sum(grades: Column, attr: int, level: int, m: int) -> Column:
    """Prefix of ``grades`` below ``attr``, ``level`` at ``attr``, zeros after.

    NULL where the set already reaches ``level`` at ``attr``.
    """
    head = F.slice(grades, 1, attr)
    tail = F.array_repeat(F.lit(0), m - attr - 1)
    return F.when(F.element_at(grades, attr + 1) < level, F.concat(head, F.array(F.lit(level)), tail))


def lectic_before(b: Column, c: Column, attr: int) -> Column:
    """b precedes c at ``attr``: equal before it, smaller there."""
    return (F.slice(b, 1, attr) == F.slice(c, 1, attr)) & (F.element_at(b, attr + 1) < F.element_at(c, attr + 1))


def levels(grades: Column, m: int) -> list[Column]:
    """The single grades of a wide row."""
    return [grades[j] for j in range(m)]


def fold_min(cols: list[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.least(*cols)


def fold_sum(cols: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, cols)
