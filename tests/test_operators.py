import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradelattice.functions import fuzzy, masks
from gradelattice.functions.fuzzy import Implication, Rounding
from gradelattice.operators import context as cx
from gradelattice.operators import derivation
from gradelattice.operators import closure as closure_module
from gradelattice.operators.closure import FuzzyClosure, ModalClosure
from gradelattice.session import stage
from tests import brute

ROWS = np.random.default_rng(11).integers(0, 11, (9, 5))


def test_closure_laws(spark, make):
    closure = ModalClosure(make(ROWS))
    every = spark.range(32).select(F.col("id").alias("mask"))
    cl = {r.mask: r.closure for r in closure.close(every).collect()}
    for b, c in cl.items():
        assert b & ~c == 0 and cl[c] == c
        assert brute.members(c) == brute.modal_closure(ROWS, brute.members(b))
        for d, e in cl.items():
            assert b & ~d or c & ~e == 0


def test_extent_intent_closure_agree(spark, make):
    ctx = make(ROWS)
    sets = spark.range(32).select(F.col("id").alias("set_id"), F.col("id").alias("mask"))
    for bound in (derivation.BROADCAST_MEMBERS, 0):
        extents = derivation.modal_extents(sets, ctx, bound)
        for r in extents.collect():
            assert r.ext == max([0, *[ROWS[r.obj][a] for a in brute.members(r.set_id)]])
        intents = {r.set_id: r.mask for r in derivation.modal_intents(extents, ctx).collect()}
        closed = {r.set_id: r.closure for r in ModalClosure(ctx).close(sets).collect()}
        assert intents == closed


@pytest.mark.parametrize("kind", list(Implication))
@pytest.mark.parametrize("rounding", [Rounding.FLOOR, Rounding.NEAREST])
def test_derivations(spark, make, kind, rounding):
    ctx = make(ROWS)
    sets = [(i, np.random.default_rng(i).integers(0, 11, 5).tolist()) for i in range(12)]
    frame = spark.createDataFrame(sets, "set_id int, grades array<int>")
    down = derivation.derive_down(frame, ctx, kind, rounding)
    near = rounding is Rounding.NEAREST
    for r in down.collect():
        assert r.ext == min(brute.implies(a, b, kind.value, nearest=near) for a, b in zip(dict(sets)[r.set_id], ROWS[r.obj]))
    closed = {r.set_id: tuple(r.closure) for r in FuzzyClosure(ctx, kind, rounding).close(frame).collect()}
    for r in derivation.derive_up(down, ctx, kind, rounding).collect():
        assert tuple(r.grades) == closed[r.set_id] == brute.fuzzy_closure(ROWS, dict(sets)[r.set_id], kind.value, nearest=near)
    apart = FuzzyClosure(ctx, kind, rounding, resident_bytes=0, block_rows=4, stream_sets=0).close(frame)
    streamed = FuzzyClosure(ctx, kind, rounding, resident_bytes=0).close(frame)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, apart.collect()))
    assert {r.set_id: tuple(r.closure) for r in apart.collect()} == closed


def test_closure_of_no_objects(spark, make):
    ctx = make(ROWS)
    none = cx.Context(ctx.frame.where("false"), 5)
    one = spark.createDataFrame([(5,)], "mask bigint")
    assert ModalClosure(none).close(one).first().closure == 31
    assert ModalClosure(none, resident_bytes=0).close(one).first().closure == 31


def test_implications(spark):
    pairs = spark.range(11).select(F.col("id").cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("b"))
    a, b = F.col("a"), F.col("b")
    out = pairs.select(
        "a", "b", fuzzy.implies_level(a, b, Implication.LUKASIEWICZ, 10).alias("luk"),
        fuzzy.implies_level(a, b, Implication.GOGUEN, 10).alias("floor"),
        fuzzy.implies_level(a, b, Implication.GOGUEN, 10, Rounding.NEAREST).alias("near"),
        fuzzy.implies_real(a / F.lit(10.0), b / F.lit(10.0), Implication.GOGUEN).alias("real"))
    for r in out.collect():
        assert r.luk == brute.implies(r.a, r.b, "lukasiewicz")
        assert r.floor == brute.implies(r.a, r.b, "goguen")
        assert r.near == brute.implies(r.a, r.b, "goguen", nearest=True)
        assert r.real == pytest.approx(1.0 if r.a <= r.b else r.b / r.a)


def test_rounding_ties(spark):
    values = spark.createDataFrame([(0.05,), (0.15,), (0.16,), (1.0,), (0.0,), (1.2,), (-0.3,)], "v double")
    out = [tuple(r) for r in values.select(fuzzy.quantize(F.col("v"), 10), fuzzy.pack_tenths(F.col("v"))).collect()]
    assert out == [(0, 1), (1, 2), (2, 2), (10, 10), (0, 0), (10, 10), (0, 0)]


def test_set_functions(spark):
    row = spark.createDataFrame([([3, 0, 5], [4, 0, 5])], "a array<int>, b array<int>")
    a, b = F.col("a"), F.col("b")
    got = row.select(fuzzy.intersection(a, b), fuzzy.union(a, b), fuzzy.subset(a, b), fuzzy.strict_subset(a, b),
                     fuzzy.strict_subset(a, a), fuzzy.set_size(a), fuzzy.support_card(a), fuzzy.equal(a, b, 1.0),
                     fuzzy.direct_sum(a, 1, 4, 3), fuzzy.direct_sum(a, 0, 3, 3), fuzzy.lectic_before(a, b, 0)).first()
    assert tuple(got) == ([3, 0, 5], [4, 0, 5], True, True, False, 8, 2, True, [3, 4, 0], None, True)


def test_masks(spark):
    m = 70
    flags = [F.array_contains("ids", j) for j in range(m)]
    frame = spark.createDataFrame([([0, 61, 62, 69],), ([],), ([5],)], "ids array<int>").select("ids", *masks.mask_of(flags))
    cols = [F.col(c) for c in masks.mask_cols(m)]
    for r in frame.select("ids", masks.members(cols, m).alias("back"), masks.card(cols).alias("card"),
                          masks.contains_attr(cols, F.lit(62), m).alias("has"),
                          masks.members(masks.with_attr(cols, F.lit(63), m), m).alias("more")).collect():
        assert r.back == r.ids and r.card == len(r.ids) and r.has == (62 in r.ids)
        assert r.more == sorted([*r.ids, 63])


def test_scaling(spark, make):
    ctx = make([[3, 0], [3, 7], [9, 7]])
    assert [tuple(r) for r in cx.scaling_map(ctx).orderBy("crisp_attr").collect()] == [(0, 0, 3), (1, 0, 9), (2, 1, 7)]
    nominal = {r.obj: r.grades for r in cx.nominal_scaling(ctx).frame.collect()}
    assert nominal == {0: [1, 0, 0], 1: [1, 0, 1], 2: [0, 1, 1]}
    ordinal = {r.obj: r.grades for r in cx.ordinal_scaling(ctx).frame.collect()}
    assert ordinal == {0: [1, 0, 0], 1: [1, 0, 1], 2: [1, 1, 1]}
    cells = {(r.obj, r.crisp_attr) for r in cx.scaled_cells(ctx).collect()}
    assert cells == {(o, j) for o, g in nominal.items() for j, q in enumerate(g) if q}
    stats = cx.context_stats(ctx).first()
    assert (stats.n_objects, stats.scaled_attrs, stats.n_ones, stats.density, stats.expansion) == (3, 3, 0, 0.833333, 1.5)
    assert cx.explain_scaling(ctx, 1).where("held").count() == 2
    cut = {r.obj: r.grades for r in cx.alpha_cut(ctx, 7).frame.collect()}
    assert cut == {0: [0, 0], 1: [0, 1], 2: [1, 1]}


def test_from_long_fills_gaps(spark):
    cells = spark.createDataFrame([(0, 1, 4), (1, 0, 2)], "obj int, attr int, q int")
    assert {r.obj: r.grades for r in cx.from_long(cells, 3).frame.collect()} == {0: [0, 4, 0], 1: [2, 0, 0]}


def test_unlisted_values_fail_and_constant_vectors_do_not(spark):
    from pyspark.sql import functions as F

    from gradelattice.operators.context import grade_counts, grade_vectors
    from gradelattice.sources.tables import rank_of
    facts = spark.createDataFrame([("a", "de", 0), ("b", "it", 7), ("c", None, None)], "o string, lang string, n int")
    with pytest.raises(Exception, match="it"):
        grade_counts(facts, F.col("o"), rank_of("lang", ("de", "en")), 2).frame.collect()
    with pytest.raises(Exception, match="attribute 7"):
        grade_counts(facts, F.col("o"), F.col("n"), 2).frame.collect()
    known = facts.where("o <> 'b'")
    got = {r.obj: r.grades for r in grade_counts(known, F.col("o"), rank_of("lang", ("de", "en")), 2).frame.collect()}
    assert got == {"a": [10, 0], "c": [0, 0]}
    vectors = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.0, 1.0])], "i int, v array<double>")
    assert {r.obj: r.grades for r in grade_vectors(vectors, F.col("i"), F.col("v"), 2).frame.collect()} == {1: [0, 0], 2: [0, 10]}
    with pytest.raises(Exception, match="2 components"):
        grade_vectors(vectors, F.col("i"), F.col("v"), 3).frame.collect()


def test_object_rows_stay_where_they_are(spark, make):
    """Partial closures come out of the scan of the rows: they pass no exchange before."""
    rng = np.random.default_rng(2)
    ctx = make(rng.integers(0, 11, (60, 6)))
    sets = spark.createDataFrame([(k,) for k in range(64)], "mask bigint")
    plain = {r.mask: r.closure for r in ModalClosure(ctx).close(sets).collect()}
    for closure in (ModalClosure(ctx, resident_bytes=0), ModalClosure(ctx, resident_bytes=0, stream_sets=0, block_rows=9)):
        assert {r.mask: r.closure for r in closure.close(sets).collect()} == plain
    staged = ModalClosure(ctx, resident_bytes=0)._prepared[1].repartition(5)
    path = closure_module._stage_distinct(sets, "sets")[1]
    rows = stage(staged, "rows")
    partial = closure_module.fold_rows(rows, path, lambda b: np.asarray(b.column(0)), np.zeros_like, lambda *a: None,
                                       lambda held, x: pa.RecordBatch.from_arrays([pa.array(held)], names=["mask"]), "mask bigint")
    assert "Exchange" not in partial._jdf.queryExecution().executedPlan().toString()
    assert partial.count() == 64 * rows.rdd.getNumPartitions()
