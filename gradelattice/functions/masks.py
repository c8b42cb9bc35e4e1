"""Attribute sets as bit masks held in BIGINT columns.

A set over ``m`` attributes takes ``ceil(m / 62)`` BIGINT columns (62 bits each,
so every word stays non-negative): ``mask`` when one word is enough, else
``mask0, mask1, ...``.  All tests below are plain bit arithmetic and stay inside
whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 62


def n_words(m: int) -> int:
    return max(1, -(-m // WORD_BITS))


def mask_cols(m: int, stem: str = "mask") -> list[str]:
    w = n_words(m)
    return [stem] if w == 1 else [f"{stem}{i}" for i in range(w)]


def full_words(m: int) -> np.ndarray:
    """All ``m`` attributes, one int64 per word."""
    return np.array([(1 << min(WORD_BITS, m - w * WORD_BITS)) - 1 for w in range(n_words(m))], np.int64)


def bit_words(m: int) -> np.ndarray:
    """Row ``j`` is the singleton set ``{j}``."""
    out = np.zeros((m, n_words(m)), np.int64)
    for j in range(m):
        out[j, j // WORD_BITS] = 1 << (j % WORD_BITS)
    return out


def mask_of(flags: list[Column], stem: str = "mask") -> list[Column]:
    """Mask columns of the attributes whose boolean flag holds."""
    words = []
    for w, name in enumerate(mask_cols(len(flags), stem)):
        part = flags[w * WORD_BITS:(w + 1) * WORD_BITS]
        terms = [F.when(f, F.lit(1 << b).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for b, f in enumerate(part)]
        words.append(reduce(lambda x, y: x.bitwiseOR(y), terms).alias(name))
    return words


UNROLL_ATTRS = 24  # beyond this, generated code outgrows what the JVM compiles well


def mask_where(grades: Column, m: int, test, stem: str = "mask") -> list[Column]:
    """Mask columns of the attributes whose grade passes ``test``."""
    if m <= UNROLL_ATTRS:
        return mask_of([test(grades[j]) for j in range(m)], stem)
    zero, words = F.lit(0).cast("bigint"), []
    for w, name in enumerate(mask_cols(m, stem)):
        size = min(WORD_BITS, m - w * WORD_BITS)
        bits = F.array(*[F.lit(1 << b).cast("bigint") for b in range(size)])
        held = F.zip_with(F.slice(grades, w * WORD_BITS + 1, size), bits, lambda g, b: F.when(test(g), b).otherwise(zero))
        words.append(F.aggregate(held, zero, lambda x, y: x.bitwiseOR(y)).alias(name))
    return words


def members(cols: list[Column], m: int) -> Column:
    """Ascending ARRAY<INT> of the attributes in a mask."""
    picks = []
    for j in range(m):
        bit = F.lit(1 << (j % WORD_BITS)).cast("bigint")
        picks.append(F.when(cols[j // WORD_BITS].bitwiseAND(bit) != 0, F.lit(j)))
    return F.array_compact(F.array(*picks))


def card(cols: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(c) for c in cols]).cast("int")


def attr_words(attr: Column, m: int) -> list[Column]:
    """Mask columns of the singleton ``{attr}`` for an attribute held in a column."""
    return [F.element_at(F.array(*[F.lit(int(x)).cast("bigint") for x in word]), attr + 1) for word in bit_words(m).T]


def contains_attr(cols: list[Column], attr: Column, m: int) -> Column:
    return reduce(lambda x, y: x | y, [c.bitwiseAND(b) != 0 for c, b in zip(cols, attr_words(attr, m))])


def with_attr(cols: list[Column], attr: Column, m: int) -> list[Column]:
    return [c.bitwiseOR(b) for c, b in zip(cols, attr_words(attr, m))]


def subset(a: list[Column], b: list[Column]) -> Column:
    """a is contained in b (equality allowed)."""
    return reduce(lambda x, y: x & y, [x.bitwiseAND(F.bitwise_not(y)) == 0 for x, y in zip(a, b)])


def strict_subset(a: list[Column], b: list[Column]) -> Column:
    differs = reduce(lambda x, y: x | y, [x != y for x, y in zip(a, b)])
    return subset(a, b) & differs
