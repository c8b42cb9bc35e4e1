import numpy as np
import pytest
from pyspark.sql import functions as F

from gradelattice.functions import masks
from gradelattice.operators import containment, metrics, sampling
from gradelattice.operators import enumerate as en
from gradelattice.operators.closure import ModalClosure
from gradelattice.operators.real import RealContext, real_closure, real_extents
from gradelattice.sources import text, writers
from tests import brute


def real(spark, rows):
    frame = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(rows)], "obj bigint, values array<double>")
    return RealContext(frame, len(rows[0]))


@pytest.mark.parametrize("seed", [1, 2])
def test_order_coding_keeps_concepts_closures_and_extents(spark, seed):
    rng = np.random.default_rng(seed)
    rows = rng.choice([-0.3, 0.0, 1e-12, 0.1, 0.1 + 1e-16, 1 / 3, 0.7, rng.random()], (5, 6))
    ctx = real(spark, rows)
    floored = np.maximum(rows, 0)
    expected = brute.modal_concepts(floored)
    concepts = en.concepts(ctx.coded())
    assert {brute.members(r.mask) for r in concepts.collect()} == expected
    got = {(brute.members(r.mask), r.obj): r.ext for r in real_extents(concepts, ctx).collect()}
    assert got == {(b, o): float(max([floored[o][j] for j in b], default=0.0)) for b in expected for o in range(5)}
    sets = spark.createDataFrame([(m,) for m in range(64)], "mask bigint")
    for r in real_closure(ctx, resident_bytes=0, block_rows=7).close(sets).collect():
        assert brute.members(r.closure) == brute.modal_closure(floored, brute.members(r.mask))


def test_cut_scaling_and_text_of_real_grades(spark, tmp_path):
    rows = [[0.0625, 0.1, 1e-10], [0.5, 0.1, 0.3333333333333333], [0.0624999, 0.0, 1.0]]
    ctx = real(spark, rows)
    assert [r.grades for r in ctx.alpha_cut(0.0625).frame.orderBy("obj").collect()] == [[1, 1, 0], [1, 1, 1], [0, 0, 1]]
    mapping = [(r.crisp_attr, r.fuzzy_attr, r.value) for r in ctx.scaling_map().orderBy("crisp_attr").collect()]
    distinct = [(j, v) for j in range(3) for v in sorted({r[j] for r in rows}) if v > 1e-9]
    assert mapping == [(k, j, v) for k, (j, v) in enumerate(distinct)]
    cells = {(r.obj, r.crisp_attr) for r in ctx.scaled_cells().collect()}
    assert cells == {(o, k) for k, (j, v) in enumerate(distinct) for o in range(3) if rows[o][j] == v}
    writers.write_lines(writers.real_lines(ctx), str(tmp_path / "real"))
    read, n, m = text.scan_cells(spark, str(tmp_path / "real"))
    assert (n, m) == (3, 3)
    assert [r["values"] for r in RealContext.of_cells(read, m).frame.orderBy("obj").collect()] == rows


@pytest.mark.parametrize("bad", [[0.1], [0.1, None], [float("nan"), 0.2], None])
def test_vectors_that_do_not_fit_fail(spark, bad):
    frame = spark.createDataFrame([(1, [0.1, 0.2]), (2, bad)], "id int, v array<double>")
    with pytest.raises(Exception, match="has not 2 numbers"):
        RealContext.of_vectors(frame, F.col("id"), F.col("v"), 2).frame.collect()


def test_wide_lattice_end_to_end(spark, make):
    """150 attributes: three mask words through concepts, covers, levels, width and sampling."""
    rng = np.random.default_rng(3)
    rows = (rng.random((5, 150)) < 0.35).astype(int)
    closure = ModalClosure(make(rows, scale=1))
    concepts = en.concepts(closure.ctx, closure)
    cols, sups = masks.mask_cols(150), masks.mask_cols(150, "sup_mask")
    assert len(cols) == 3

    def sets(frame, names):
        return [frozenset(r.a) for r in frame.select(masks.members([F.col(c) for c in names], 150).alias("a")).collect()]

    found = sets(concepts, cols)
    assert all(brute.modal_closure(rows, b) == b for b in found) and len(found) == len(set(found)) > 20
    covers = containment.modal_covers(concepts, closure)
    edges = set(zip(sets(covers.orderBy(*cols, *sups), cols), sets(covers.orderBy(*cols, *sups), sups)))
    expected = brute.covers(set(found), lambda a, b: a < b)
    assert edges == expected
    assert set(zip(*(sets(containment.cover_edges(concepts, cols).orderBy(*cols, *sups), names) for names in (cols, sups)))) == expected
    graph = concepts.select(F.struct(*[F.col(c).alias(f"w{i}") for i, c in enumerate(cols)]).alias("id")), metrics.edge_frame(covers, cols, sups)
    levels = metrics.levels(*graph)
    assert metrics.height(levels).first().height == brute.height(set(found), lambda a, b: a < b)
    assert metrics.width_exact(*graph, levels).first().width_exact == brute.width(set(found), lambda a, b: a < b)
    chosen = sets(sampling.quota_sample(concepts, 150, 15), cols)
    assert len(chosen) == len(set(chosen)) and set(chosen) <= set(found)
