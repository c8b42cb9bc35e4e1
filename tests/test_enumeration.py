import numpy as np
import pytest
from pyspark.sql import functions as F

from gradelattice.functions import masks
from gradelattice.functions.fuzzy import Implication, Rounding
from gradelattice.operators import enumerate as en
from gradelattice.operators import context as cx
from gradelattice.operators.closure import FuzzyClosure, ModalClosure
from gradelattice.sources import tables
from tests import brute

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def sets(frame):
    return [brute.members(r.mask) for r in frame.select("mask").collect()]


def random_rows(seed, n, m, low=0, high=10):
    return np.random.default_rng(seed).integers(low, high + 1, (n, m))


@pytest.mark.parametrize("seed,n,m,high", [(1, 5, 6, 10), (2, 8, 7, 3), (3, 4, 5, 1), (4, 1, 4, 10)])
def test_every_closed_set_once(make, seed, n, m, high):
    rows = random_rows(seed, n, m, 0, high)
    expected = brute.modal_concepts(rows)
    ctx = make(rows)
    found = sets(en.concepts(ctx))
    assert len(found) == len(set(found)) and set(found) == expected
    assert set(sets(en.powerset_concepts(ctx))) == expected


def test_fragments_and_rounds_agree_with_resident(make):
    ctx = make(random_rows(5, 7, 6))
    plain = set(sets(en.concepts(ctx)))
    assert set(sets(en.concepts(ctx, first_budget=50, round_budget=200))) == plain
    apart = ModalClosure(ctx, resident_bytes=0, block_rows=5)
    found = sets(en.concepts(ctx, apart))
    assert len(found) == len(set(found)) and set(found) == plain


def test_cluster_prune_keeps_closures(make, monkeypatch):
    from gradelattice.operators import closure
    ctx = make(random_rows(6, 12, 6))
    plain = set(sets(en.concepts(ctx)))
    monkeypatch.setattr(closure, "PRUNE_PIVOTS", 4)
    assert set(sets(en.concepts(ctx))) == plain


def test_empty_column_belongs_to_the_least_concept(make):
    ctx = make([[0, 3, 5], [0, 2, 1]])
    found = set(sets(en.concepts(ctx)))
    assert frozenset() not in found and frozenset({0}) in found
    assert set(sets(en.with_bottom(en.concepts(ctx), 3))) == found | {frozenset()}


def test_more_than_one_mask_word(make):
    rng = np.random.default_rng(7)
    rows = (rng.random((6, 70)) < 0.4).astype(int)
    ctx = make(rows, scale=1)
    cols = masks.mask_cols(70)
    assert cols == ["mask0", "mask1"]
    found = {frozenset(r.attrs) for r in en.concepts(ctx).select(
        masks.members([F.col(c) for c in cols], 70).alias("attrs")).collect()}
    extents = {frozenset(np.nonzero(rows[:, list(b)].any(axis=1))[0]) if b else frozenset() for b in found}
    assert len(extents) == len(found)
    assert all(brute.modal_closure(rows, b) == b for b in found)
    columns = [frozenset(np.nonzero(rows[:, j])[0]) for j in range(70)]
    unions = {frozenset()}
    for c in columns:
        unions |= {u | c for u in unions}
    assert extents == unions
    apart = en.concepts(ctx, ModalClosure(ctx, resident_bytes=0, block_rows=64))
    assert apart.exceptAll(en.concepts(ctx)).isEmpty() and apart.count() == len(found)


@pytest.mark.parametrize("sf,name,cut,expected", [
    (SMALL, "region_bucket", None, 324), (SF, "region_bucket", None, 162), (SMALL, "brand_size", 7, 432),
    (SF, "brand_size", 7, 176), (SMALL, "seg_month", None, 1829), (SF, "seg_month", None, 356)])
def test_known_counts(spark, sf, name, cut, expected):
    ctx = getattr(tables, name)(spark, sf)
    assert en.concepts(cx.alpha_cut(ctx, cut) if cut else ctx).count() == expected


@pytest.mark.parametrize("rows,luk,goguen,nearest", [
    ([[8, 2], [5, 3]], 26, 18, 18), ([[8, 2, 9], [5, 3, 2], [6, 7, 2]], 91, 64, 65),
    ([[3, 7, 5], [9, 4, 6], [2, 8, 1], [6, 6, 6]], 158, 148, 161), ([[10, 0], [0, 10]], 121, 4, 4)])
def test_fuzzy_intents(make, rows, luk, goguen, nearest):
    ctx = make(rows)
    for kind, count in ((Implication.LUKASIEWICZ, luk), (Implication.GOGUEN, goguen)):
        found = [tuple(r.grades) for r in en.fuzzy_concepts(ctx, kind).collect()]
        assert len(found) == count == len(set(found))
        assert set(found) == brute.fuzzy_concepts(rows, kind.value)
    fixed = {tuple(r.grades) for r in en.fuzzy_fixpoints(ctx, Implication.GOGUEN, Rounding.NEAREST).collect()}
    assert len(fixed) == nearest and fixed == brute.fuzzy_concepts(rows, "goguen", nearest=True)


def test_fuzzy_fragments_and_rounds(make):
    rows = [[3, 7, 5], [9, 4, 6], [2, 8, 1], [6, 6, 6]]
    ctx = make(rows)
    plain = {tuple(r.grades) for r in en.fuzzy_concepts(ctx).collect()}
    apart = FuzzyClosure(ctx, resident_bytes=0, block_rows=3)
    for frame in (en.fuzzy_concepts(ctx, closure=apart), en.fuzzy_concepts(ctx, first_budget=100, round_budget=500)):
        found = [tuple(r.grades) for r in frame.collect()]
        assert len(found) == len(plain) and set(found) == plain


def test_finer_scales(make):
    rows = [[73, 21], [50, 38], [66, 94]]
    found = {tuple(r.grades) for r in en.fuzzy_concepts(make(rows, scale=100)).collect()}
    assert found == brute.fuzzy_concepts(rows, "lukasiewicz", 100)


def test_goguen_enumeration_refuses_nearest(make):
    ctx = make([[8, 2], [5, 3]])
    with pytest.raises(ValueError):
        en.fuzzy_concepts(ctx, closure=FuzzyClosure(ctx, Implication.GOGUEN, Rounding.NEAREST))


def test_next_closure_order(make):
    ranked = en.next_closure_order(en.fuzzy_concepts(make([[8, 2], [5, 3]]))).orderBy("position").collect()
    assert [tuple(r.grades) for r in ranked] == sorted(tuple(r.grades) for r in ranked)
    assert [r.position for r in ranked] == list(range(26))


def test_quota(make):
    ctx = make([[3, 7, 5], [9, 4, 6], [2, 8, 1], [6, 6, 6]])
    every = sorted(tuple(r.grades) for r in en.fuzzy_concepts(ctx).collect())
    for quota in (1, 40, 500):
        part = sorted(tuple(r.grades) for r in en.bounded_concepts(ctx, quota).collect())
        assert part == every[:quota]


@pytest.mark.parametrize("resident", [True, False])
def test_lectic_prefix_in_rounds(make, resident):
    ctx = make([[3, 7, 5], [9, 4, 6], [2, 8, 1], [6, 6, 6]])
    closure = FuzzyClosure(ctx) if resident else FuzzyClosure(ctx, resident_bytes=0, block_rows=3)
    every = sorted(tuple(r.grades) for r in en.fuzzy_concepts(ctx).collect())
    for quota in (0, 7, 60) if resident else (0, 7):
        found, counts = en.lectic_prefix(ctx, quota, closure, first_budget=500, round_budget=2000)
        assert sorted(tuple(r.grades) for r in found.collect()) == every[:quota]
        assert counts["rounds"] > 1 or not quota


def test_lectic_prefix_leaves_the_rest_alone(make):
    rng = np.random.default_rng(5)
    ctx = make(rng.integers(0, 11, (40, 5)))
    closure = FuzzyClosure(ctx)
    every, all_counts = en.fuzzy_enumeration(ctx, closure=closure)
    grades = sorted(tuple(r.grades) for r in every.collect())
    assert len(grades) > 4000
    for budget in (en.FIRST_BUDGET, 20_000):
        found, counts = en.lectic_prefix(ctx, 50, closure, first_budget=budget, round_budget=budget)
        assert sorted(tuple(r.grades) for r in found.collect()) == grades[:50]
        assert 20 * counts["closures"] < all_counts["closures"]


def test_inherited_failures_save_closures(make):
    rng = np.random.default_rng(8)
    for rows in (rng.integers(0, 11, (12, 4)), rng.integers(0, 4, (6, 5))):
        ctx = make(rows)
        found, counts = en.fuzzy_enumeration(ctx)
        apart, plain = en.fuzzy_enumeration(ctx, closure=FuzzyClosure(ctx, resident_bytes=0, block_rows=50))
        grades = sorted(tuple(r.grades) for r in found.collect())
        assert len(set(grades)) == len(grades) and grades == sorted(tuple(r.grades) for r in apart.collect())
        assert counts["skipped"] > 0 and counts["closures"] - counts["rejected"] == len(grades)
        small = en.fuzzy_enumeration(ctx, first_budget=300, round_budget=3000)
        assert sorted(tuple(r.grades) for r in small[0].collect()) == grades
        assert small[1]["closures"] + small[1]["skipped"] == counts["closures"] + counts["skipped"]
        assert en.fuzzy_counters(found, counts).first().concepts == len(grades)


def test_forced_bounds(make):
    rows = [[3, 7, 5], [9, 4, 6], [2, 8, 1], [6, 6, 6]]
    bounds = {r.bound: tuple(r.grades) for r in en.forced_bounds(make(rows)).collect()}
    assert bounds["min_intent"] == brute.fuzzy_closure(rows, (0, 0, 0), "lukasiewicz")
    assert bounds["max_intent"] == brute.fuzzy_closure(rows, (10, 10, 10), "lukasiewicz")
