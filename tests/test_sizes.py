"""Queries over tables whose sizes change the form of what they build."""

import numpy as np

from gradelattice.functions.fuzzy import Implication
from gradelattice.operators import closure as closure_module
from gradelattice.operators.closure import FuzzyClosure
from gradelattice.operators.dominance import DominanceIndex
from gradelattice.plans.queries import REGISTRY, joined
from tests import brute


def test_wide_lattice_of_one_mask_word(spark, tmp_path):
    """Few scaled attributes: the vertices' keys are single words, as the ends of the edges are."""
    held = {"LARGE": (1, 2), "SMALL": (2, 3), "PROMO": (3,)}
    parts = [(k, kind, size) for k, (kind, sizes) in enumerate(held.items()) for size in sizes]
    spark.createDataFrame(parts, "p_partkey bigint, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = REGISTRY["lattice_metrics_wide"](spark, str(tmp_path)).first()
    # extents {}, {PROMO, SMALL}, {LARGE}, {LARGE, SMALL} and all
    assert (got.n_vertices, got.n_edges, got.height) == (5, 5, 4)


def test_repeated_candidates_are_closed_once(spark, make, monkeypatch):
    """The work follows the distinct candidates, however many ask for them; all of them get their answer."""
    rows = np.random.default_rng(4).integers(0, 11, (30, 4))
    asked = [(k, [10 * (k % 3 == j) for j in range(4)]) for k in range(400)]
    sets = spark.createDataFrame(asked, "set_id int, grades array<int>").repartition(5)
    given, plain = [], closure_module.map_batches

    def counted(frame, fn, schema):
        given.append(frame.count())
        return plain(frame, fn, schema)

    monkeypatch.setattr(closure_module, "map_batches", counted)
    got = FuzzyClosure(make(rows), Implication.GOGUEN).close(sets).collect()
    assert sorted(r.set_id for r in got) == list(range(400)) and given == [3]
    assert all(tuple(r.closure) == brute.fuzzy_closure(rows.tolist(), r.grades, "goguen") for r in got)


def test_repeated_vectors_are_looked_up_once(spark, monkeypatch):
    """Equal vectors share their answers, also where those are spread over more tasks than there are vectors."""
    vectors = [[a, b, c] for a in range(5) for b in range(5) for c in range(5)]
    index = DominanceIndex(spark, 3, 4)
    index.append(spark.createDataFrame([(v,) for v in vectors], "grades array<int>"), len(vectors), segment=40)
    asked = [(k if k % 11 else None, [[0, 0, 0], [1, 2, 3], [4, 4, 4]][k % 3]) for k in range(300)]
    questions = spark.createDataFrame(asked, "q int, grades array<int>").repartition(3)
    given, plain = [], DominanceIndex._asked

    def counted(self, frame, *rest):
        given.append(frame.count())
        return plain(self, frame, *rest)

    monkeypatch.setattr(DominanceIndex, "_asked", counted)
    expected = sorted((str(q), ",".join(map(str, v))) for q, a in asked for v in vectors if v != a and all(x >= y for x, y in zip(v, a)))
    for task_rows in (1 << 23, 1000):
        found = index.lookup(questions, 300, 125, of=joined, task_rows=task_rows)
        assert found.columns == ["q", "grades", "found"]
        assert sorted((str(r.q), r.found) for r in found.collect()) == expected
    assert given == [3, 3]
