import numpy as np
import pytest
from pyspark.sql import functions as F

from gradelattice.functions.fuzzy import Implication
from gradelattice.operators import containment, dominance, metrics
from gradelattice.operators import enumerate as en
from gradelattice.operators.closure import FuzzyClosure, ModalClosure
from gradelattice.streaming import incremental
from gradelattice.streaming.incremental import IncrementalCovers, IncrementalLattice, batch_covers
from tests import brute


def below(a, b):
    return a < b


def family(spark, sets):
    return spark.createDataFrame([(brute.mask(s),) for s in sets], "mask bigint")


def edge_set(frame):
    got = [(brute.members(r.mask), brute.members(r.sup_mask)) for r in frame.collect()]
    assert len(got) == len(set(got))
    return set(got)


def random_family(seed, n, m):
    rng = np.random.default_rng(seed)
    return {frozenset(np.nonzero(rng.random(m) < rng.random())[0].tolist()) for _ in range(n)}


@pytest.mark.parametrize("limits", [{}, {"block_rows": 1}, {"block_rows": 8}])
def test_covers_of_any_family(spark, limits):
    sets = random_family(3, 40, 7)
    found = edge_set(containment.cover_edges(family(spark, sets), ["mask"], **limits))
    assert found == brute.covers(sets, below)


def test_star_family_is_split(spark):
    """One set below everything: a third of all edges hang on it."""
    sets = {frozenset()} | {frozenset({j, k}) for j in range(9) for k in range(j + 1, 9)} | {frozenset(range(9))}
    found = edge_set(containment.cover_edges(family(spark, sets), ["mask"], block_rows=5))
    assert found == brute.covers(sets, below)


def test_closure_covers_match_pairwise(spark, make):
    rows = np.random.default_rng(5).integers(0, 11, (6, 6))
    closure = ModalClosure(make(rows))
    concepts = en.concepts(closure.ctx, closure)
    expected = brute.covers(brute.modal_concepts(rows), below)
    assert edge_set(containment.modal_covers(concepts, closure)) == expected
    apart = ModalClosure(closure.ctx, resident_bytes=0, block_rows=16)
    assert edge_set(containment.modal_covers(concepts, apart)) == expected


@pytest.mark.parametrize("kind", list(Implication))
def test_fuzzy_covers(spark, make, kind):
    rows = [[8, 2, 9], [5, 3, 2], [6, 7, 2]]
    closure = FuzzyClosure(make(rows), kind)
    intents = en.fuzzy_concepts(closure.ctx, kind, closure)
    def under(a, b):
        return a != b and all(x <= y for x, y in zip(a, b))
    expected = brute.covers(brute.fuzzy_concepts(rows, kind.value), under)
    apart = FuzzyClosure(closure.ctx, kind, resident_bytes=0, block_rows=16)
    for c in (closure, apart):
        assert {(tuple(r.grades), tuple(r.sup_grades)) for r in containment.fuzzy_covers(intents, c).collect()} == expected
    steps = intents.select(*containment.thermometer(F.col("grades"), 3, 10))
    assert containment.cover_edges(steps, ["mask"]).count() == len(expected)


def test_pairs_and_counts(spark):
    sets = random_family(9, 25, 6)
    frame = family(spark, sets)
    expected = {(a, b) for a in sets for b in sets if a < b}
    for rows in (1 << 20, 7):
        assert edge_set(containment.subset_pairs(frame, frame, ["mask"], block_rows=rows)) == expected
        counted = containment.subset_counts(frame, frame, ["mask"], "n", block_rows=rows)
        assert {brute.members(r.mask): r.n for r in counted.collect()} == {b: sum(a <= b for a in sets) for b in sets}


def graph(spark, sets):
    vertices = family(spark, sets).withColumnRenamed("mask", "id")
    rows = [(brute.mask(a), brute.mask(b)) for a, b in brute.covers(sets, below)]
    return vertices, spark.createDataFrame(rows, "child bigint, parent bigint")


@pytest.mark.parametrize("seed", [1, 2])
def test_metrics(spark, seed):
    sets = random_family(seed, 30, 6)
    vertices, edges = graph(spark, sets)
    lv = metrics.levels(vertices, edges)
    assert metrics.height(lv).first().height == brute.height(sets, below)
    assert lv.count() == len(sets)
    exact = metrics.width_exact(vertices, edges, lv).first().width_exact
    assert exact == brute.width(sets, below)
    assert metrics.width_levels(lv).first().width_levels <= exact
    row = metrics.lattice_metrics(vertices, edges, lv).first()
    assert (row.n_vertices, row.n_edges) == (len(sets), len(brute.covers(sets, below)))


def test_topological_order(spark):
    sets = random_family(11, 40, 6)
    vertices, edges = graph(spark, sets)
    found, read = metrics.topological_levels(vertices, edges, F.bit_count)
    assert {r.id: r.level for r in found.collect()} == {r.id: r.level for r in metrics.levels(vertices, edges).collect()}
    assert read == edges.count()
    at = {r.id: r.position for r in metrics.topological_order(vertices, edges, F.bit_count).collect()}
    assert sorted(at.values()) == list(range(len(sets))) and all(at[r.child] < at[r.parent] for r in edges.collect())
    assert metrics.topological_order(vertices.limit(0), edges.limit(0), F.bit_count).count() == 0
    assert metrics.topological_levels(vertices, edges.limit(0), F.bit_count)[0].where("level = 0").count() == len(sets)
    with pytest.raises(Exception, match="does not go up"):
        metrics.topological_levels(vertices, edges.select(F.col("parent").alias("child"), F.col("child").alias("parent")), F.bit_count)


def test_width_needs_augmenting_paths(spark):
    """Level sizes say 2, the widest antichain has 3 members."""
    sets = [frozenset(s) for s in ({0}, {0, 1}, {0, 1, 2}, {5}, {6, 7}, {6, 7, 8}, {5, 6, 7, 8})]
    vertices, edges = graph(spark, sets)
    assert metrics.width_exact(vertices, edges).first().width_exact == brute.width(sets, below)


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "id bigint")
    edges = spark.createDataFrame([], "child bigint, parent bigint")
    lv = metrics.levels(none, edges)
    assert metrics.height(lv).first().height == 0
    assert metrics.width_exact(none, edges, lv).first().width_exact == 0


def test_degree_median_is_the_upper_one(spark):
    sets = [frozenset(s) for s in ((), {0}, {1}, {0, 1})]
    stats = {r.side: r for r in metrics.degree_stats(*graph(spark, sets)).collect()}
    assert (stats["out"].avg_degree, stats["out"].median_degree, stats["out"].max_degree) == (1.0, 1, 2)
    pair = {r.side: r for r in metrics.degree_stats(*graph(spark, [frozenset(), frozenset({0})])).collect()}
    assert pair["out"].median_degree == 1


def test_join_closure(spark, make):
    rows = np.random.default_rng(8).integers(0, 11, (5, 6))
    closure = ModalClosure(make(rows))
    gens = {brute.modal_closure(rows, {j}) for j in range(0, 6, 2)}
    expected = set(gens)
    while True:
        more = {brute.modal_closure(rows, a | b) for a in expected for b in expected} - expected
        if not more:
            break
        expected |= more
    found = [brute.members(r.mask) for r in containment.join_closure(family(spark, gens), closure, 2).collect()]
    assert len(found) == len(set(found)) and set(found) == expected


@pytest.mark.parametrize("every", [16, 2])
def test_incremental_equals_batch(spark, monkeypatch, tmp_path, every):
    monkeypatch.setattr(incremental, "COMPACT_EVERY", every)
    sets = sorted(random_family(12, 40, 7), key=lambda s: hash(frozenset(s)) % 7)
    lattice = IncrementalLattice(spark, 7, str(tmp_path / "state"))
    for epoch in range(4):
        lattice.apply(family(spark, sets[epoch::4]), epoch)
    assert edge_set(lattice.edges) == brute.covers(set(sets), below)
    lattice.apply(family(spark, sets[3::4]), 3)  # a replayed batch changes nothing
    assert edge_set(lattice.edges) == brute.covers(set(sets), below)
    lattice.apply(family(spark, sets[:5]), 4)    # nor do sets seen before
    assert edge_set(lattice.edges) == edge_set(batch_covers(family(spark, sets), 7))
    again = IncrementalLattice(spark, 7, str(tmp_path / "state"))  # as after a restart
    assert again.version == 4 and edge_set(again.edges) == edge_set(lattice.edges)
    assert again.vertices.count() == len(set(sets))


def test_streamed(spark, tmp_path):
    sets = list(random_family(13, 30, 6))
    for i in range(3):
        family(spark, sets[i::3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    lattice = IncrementalLattice(spark, 6, str(tmp_path / "state"))
    stream = spark.readStream.schema("mask bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    lattice.start(stream, str(tmp_path / "progress")).awaitTermination()
    assert lattice.version >= 2
    assert edge_set(lattice.edges) == brute.covers(set(sets), below)


def test_fuzzy_join_closure(spark, make):
    rows = [[8, 2, 9], [5, 3, 2], [6, 7, 2], [1, 4, 4]]
    closure = FuzzyClosure(make(rows), Implication.LUKASIEWICZ)
    gens = {brute.fuzzy_closure(rows, tuple(r), "lukasiewicz") for r in rows[:3]}
    expected = set(gens)
    while True:
        more = {brute.fuzzy_closure(rows, tuple(map(max, a, b)), "lukasiewicz") for a in expected for b in expected} - expected
        if not more:
            break
        expected |= more
    frame = spark.createDataFrame([(list(map(int, g)),) for g in gens], "grades array<int>")
    found = [tuple(r.grades) for r in containment.fuzzy_join_closure(frame, closure, block_rows=2).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    pairs = spark.createDataFrame([(list(map(int, a)), list(map(int, b))) for a in gens for b in gens], "a array<int>, b array<int>")
    for r in containment.fuzzy_join(pairs, "a", "b", closure).collect():
        assert tuple(r.joined) == brute.fuzzy_closure(rows, tuple(map(max, r.a, r.b)), "lukasiewicz")


def dominated(a, b):
    return a != b and all(x <= y for x, y in zip(a, b))


@pytest.mark.parametrize("every", [16, 2])
def test_incremental_fuzzy_equals_batch(spark, monkeypatch, tmp_path, every):
    monkeypatch.setattr(incremental, "COMPACT_EVERY", every)
    rng = np.random.default_rng(4)
    vectors = list({tuple(map(int, v)) for v in rng.integers(0, 5, (70, 3))})
    lattice = IncrementalCovers(spark, 3, 4, str(tmp_path / "state"))
    def batch(part):
        return spark.createDataFrame([(list(v),) for v in part], "grades array<int>")
    for epoch in range(3):
        lattice.apply(batch(vectors[epoch::3] + vectors[:2]), epoch)
    lattice.apply(batch(vectors[2::3]), 2)  # replayed
    lattice.apply(batch([]), 3)
    for state in (lattice, IncrementalCovers(spark, 3, 4, str(tmp_path / "state"))):
        found = [(tuple(r.grades), tuple(r.sup_grades)) for r in state.covers.collect()]
        assert len(found) == len(set(found)) and set(found) == brute.covers(vectors, dominated)
        assert sorted(tuple(r.grades) for r in state.grades.collect()) == sorted(vectors)


def test_dominance_index(spark):
    rng = np.random.default_rng(6)
    vectors = list({tuple(map(int, v)) for v in rng.integers(0, 7, (90, 4))})
    asked = vectors[:20] + [tuple(map(int, v)) for v in rng.integers(0, 7, (30, 4))] + [(0,) * 4, (6,) * 4]
    def frame(rows, schema="grades array<int>"):
        return spark.createDataFrame([(list(v),) for v in rows], schema)
    index = dominance.DominanceIndex(spark, 4, 6)
    index.append(frame(vectors[:50]), 50, segment=16)
    index.append(frame(vectors[50:]), len(vectors) - 50)
    index.append(frame([]), 0)
    questions = spark.createDataFrame([(k, list(v)) for k, v in enumerate(asked)], "q int, grades array<int>")
    for upward in (True, False):
        for strict in (True, False):
            got = sorted((r.q, tuple(r.found)) for r in index.lookup(questions, 52, 90, upward=upward, strict=strict).collect())
            def held(v, a):
                low, high = (a, v) if upward else (v, a)
                return all(x <= y for x, y in zip(low, high)) and (not strict or v != a)
            assert got == sorted((k, v) for k, a in enumerate(asked) for v in vectors if held(v, a))
    absent = sorted(r.q for r in index.missing(questions, 52, 1 << 30).collect())
    assert absent == [k for k, a in enumerate(asked) if a not in vectors]
