"""Codes found with pivots against plain search of all entries."""

import hashlib
import math
import random

import numpy as np
import pytest

from gradelattice.llm import vector_codes

SCHEMA = "vec_id bigint, label int, embedding array<float>"


def brute(rows, parts, entries, rounds, scale=256):
    """(codes by position of kept row, codebooks) with Python integers only."""
    kept = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    cells = [[math.floor(scale * x) for x in r[2]] for r in kept]
    width = len(cells[0]) // parts
    cut = [[tuple(c[p * width:(p + 1) * width]) for p in range(parts)] for c in cells]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [tuple(sum(x) // len(groups[k]) for x in zip(*groups[k])) if k in groups else e for k, e in enumerate(books[p])]
    out = []
    for r, c in zip(kept, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((r[0], r[1], "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


def check(spark, rows, **sizes):
    codes = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), **sizes)
    done = vector_codes.with_label_error(codes).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()
    want, books = brute(rows, sizes["parts"], sizes["entries"], sizes.get("rounds", 2))
    totals = {}
    for _, label, _, error in want:
        totals[label] = totals.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert sorted(map(str, map(tuple, done))) == sorted(str((i, l, c, e, totals[l], digest)) for i, l, c, e in want)


@pytest.mark.parametrize("scale", [0.01, 1.0, 300.0, 90000.0])
def test_codes_are_those_of_searching_every_entry(spark, scale):
    rnd = random.Random(4)
    rows = [(k, rnd.choice([None, 0, 1, 2]), [float(np.float32(rnd.gauss(0, scale))) for _ in range(8)]) for k in range(400)]
    check(spark, rows, parts=4, entries=16)


def test_ties_repeats_nulls_and_unusable_vectors(spark):
    rnd = random.Random(9)
    rows = [(k // 2 * 3, k % 3 or None, [float(rnd.choice([-0.5, 0.0, 0.25])) for _ in range(6)]) for k in range(150)]
    rows += [rows[5], rows[5], (None, 1, [0.0] * 6)]
    rows += [(1, 1, None), (-4, 1, [float("nan")] + [0.0] * 5), (-3, 1, [None] + [0.0] * 5), (-2, None, [float("inf")] * 6), (-1, 0, [-float("inf")] * 6)]
    rnd.shuffle(rows)
    check(spark, rows, parts=3, entries=20, rounds=3)
    check(spark, rows[:5] + [(9, None, [1.0] * 6)], parts=2, entries=64)


def test_other_lengths_empty_tables_and_clashing_columns(spark):
    rows = [(5, 1, [1.0, 2.0]), (4, 1, [0.5, 0.25]), (3, 2, [0.5] * 4), (6, 2, [0.1])]
    codes = vector_codes.compress(spark.createDataFrame(rows, SCHEMA), parts=2, entries=3)
    assert [r.vec_id for r in codes.vectors.collect()] == [3]
    assert codes.codebooks.shape == (2, 1, 2)
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame(rows[:1], SCHEMA), parts=4)
    for empty in (spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 1, None)], SCHEMA)):
        none = vector_codes.compress(empty)
        assert vector_codes.with_label_error(none).count() == 0 and none.sha256 == hashlib.sha256(b"").hexdigest()
    clash = spark.createDataFrame([(1, "x", 2.0, [1.0, 2.0], "kept")], "vec_id bigint, code string, error double, embedding array<double>, label string")
    coded = vector_codes.with_label_error(vector_codes.compress(clash, parts=1)).collect()
    assert coded[0].asDict() | {"codebooks_sha256": ""} == {"vec_id": 1, "label": "kept", "code": "00", "error": 0, "label_error": 0, "codebooks_sha256": ""}
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, 1, [3e30, 1.0])], SCHEMA), parts=1)


def test_bounds_leave_out_most_exact_distances():
    rng = np.random.default_rng(1)
    parts = rng.normal(0, 40, (4000, 1, 4)).astype(np.int64)
    books = parts[:64].transpose(1, 0, 2)
    fixed = vector_codes.choose_pivots(books)
    far = vector_codes.pivot_distances(parts, fixed)
    d = books[0][:, None, :] - fixed[0][None]
    entry, least, evaluated = vector_codes.nearest(parts[:, 0], far[:, 0], books[0], np.sqrt((d * d).sum(axis=2)).astype(np.float32))
    every = ((parts[:, 0][:, None, :] - books[0][None]) ** 2).sum(axis=2)
    assert (entry == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()
    assert evaluated < 0.35 * every.size
