"""Definitions spelled out on small inputs, with no Spark and no shared code."""

import itertools

import numpy as np


def modal_closure(rows, members):
    rows = np.asarray(rows)
    ext = [max([0, *[r[a] for a in members]]) for r in rows]
    return frozenset(a for a in range(rows.shape[1]) if all(r[a] <= e for r, e in zip(rows, ext)))


def modal_concepts(rows):
    m = len(rows[0])
    subsets = (frozenset(c) for k in range(m + 1) for c in itertools.combinations(range(m), k))
    return {b for b in subsets if modal_closure(rows, b) == b}


def implies(a, b, kind, scale=10, nearest=False):
    if a <= b:
        return scale
    if kind == "lukasiewicz":
        return scale - a + b
    return (2 * scale * b + a - 1) // (2 * a) if nearest else scale * b // a


def fuzzy_closure(rows, y, kind, scale=10, nearest=False):
    down = [min(implies(a, b, kind, scale, nearest) for a, b in zip(y, r)) for r in rows]
    return tuple(min(implies(d, r[j], kind, scale, nearest) for d, r in zip(down, rows)) for j in range(len(rows[0])))


def fuzzy_concepts(rows, kind, scale=10, nearest=False):
    grid = itertools.product(range(scale + 1), repeat=len(rows[0]))
    return {y for y in grid if fuzzy_closure(rows, y, kind, scale, nearest) == y}


def covers(family, below):
    pairs = [(a, b) for a in family for b in family if below(a, b)]
    return {(a, b) for a, b in pairs if not any(below(a, c) and below(c, b) for c in family)}


def width(family, below):
    """n minus a maximum matching, by simple augmentation."""
    family = list(family)
    above = {a: [b for b in family if below(a, b)] for a in family}
    mate = {}
    def extend(a, seen):
        for b in above[a]:
            if b not in seen:
                seen.add(b)
                if b not in mate or extend(mate[b], seen):
                    mate[b] = a
                    return True
        return False
    return len(family) - sum(extend(a, set()) for a in family)


def height(family, below):
    depth = {}
    for a in sorted(family, key=lambda s: len(s)):
        depth[a] = 1 + max([depth[b] for b in depth if below(b, a)], default=0)
    return max(depth.values(), default=0)


def mask(members):
    return sum(1 << a for a in members)


def members(value):
    return frozenset(j for j in range(62) if value >> j & 1)
