import numpy as np
import pytest

from gradelattice.llm import embedding_dedup as ed
from tests.llm.test_graph import brute as united


def brute(rows, cosine):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v):
            return None
        v = np.array(v, np.float64)
        return v / np.sqrt((v * v).sum()) if v.any() else None
    units = [(i, unit(v)) for i, v in rows]
    links = [(a, b) for k, (a, x) in enumerate(units) for b, y in units[:k]
             if a is not None and b is not None and x is not None and y is not None and len(x) == len(y) and x @ y >= cosine]
    group, degree = united(links), {}
    for a, b in links:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    return sorted((i, degree.get(i, 0), group.get(i, i), group.get(i, i) == i) for i, _ in rows if i is not None)


def vectors(seed, clusters, size, dimension=16):
    rng, rows = np.random.default_rng(seed), []
    for k in range(clusters):
        base = rng.standard_normal(dimension)
        for _ in range(size if k else 12 * size):
            rows.append((base + 0.08 * rng.standard_normal(dimension)).astype(np.float32).tolist())
    rows += [rng.standard_normal(dimension).astype(np.float32).tolist() for _ in range(60)]
    rows += [rows[3]] * 5
    return [(int(i), v) for i, v in zip(rng.permutation(len(rows)) * 2, rows)]


@pytest.mark.parametrize("window,block", [(256, 512), (16, 8)])
def test_links_agree_with_brute_force(spark, monkeypatch, window, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    odd = [(1, None), (3, []), (5, [0.0] * 16), (7, [float("nan")] * 16), (9, [None] + [1.0] * 15), (11, [float("inf")] * 16),
           (13, [1.0, 2.0]), (15, [2.0, 4.0]), (17, [1.0]), (None, [1.0, 2.0]), (19, [1e-30] * 16), (21, [1.0] * 16)]
    rows = vectors(4, 6, 5) + odd
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, component_id string, high int")
    got = ed.near_vectors(table, window=window).collect()
    assert len(got) == len(rows) and [tuple(r) for r in got if r.vec_id is None] == [(None, 0, None, False)]
    assert sorted(tuple(r) for r in got if r.vec_id is not None) == brute(rows, 0.9)


def test_empty_and_repeated_rows(spark):
    table = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert ed.near_vectors(table).count() == 0
    table = spark.createDataFrame([(4, [1.0, 0.0]), (4, [1.0, 0.0]), (2, [0.0, 1.0])], table.schema)
    assert sorted(tuple(r) for r in ed.near_vectors(table).collect()) == [(2, 0, 2, True), (4, 1, 4, True), (4, 1, 4, True)]


def test_more_vectors_take_more_passes():
    assert ed.passes_for(100) == 1 and 1 < ed.passes_for(10_000) < ed.passes_for(10**9)


def test_window_does_not_depend_on_partitions(spark):
    rows = vectors(8, 5, 9)
    nodes = spark.createDataFrame([(i, np.array(v, np.float64).tobytes()) for i, v in dict(rows).items()], "rep bigint, vector binary")
    from gradelattice.llm.graph import components
    got = [sorted(map(tuple, components(ed._links(ed._sorted_passes(nodes, 3, n), 0.9, 12)).collect())) for n in (1, 5)]
    assert got[0] == got[1]


def test_pairs_in_a_dense_cone_are_found(spark):
    """A third of the vectors have a mutual cosine of 0.8; pairs of cosine 0.901 are planted among them."""
    rng, dimension, cone, planted = np.random.default_rng(12), 64, 1000, 200
    axis = np.eye(dimension)[0]

    def across(n):
        x = rng.standard_normal((n, dimension)) * (np.arange(dimension) > 0)
        return x / np.linalg.norm(x, axis=1, keepdims=True)
    e = across(cone)
    g = across(planted)
    g -= (g * e[:planted]).sum(axis=1, keepdims=True) * e[:planted]
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    share = (0.901 - 0.8) / 0.2
    inside = [np.sqrt(0.8) * axis + np.sqrt(0.2) * x for x in (e, share * e[:planted] + np.sqrt(1 - share**2) * g)]
    rows = np.concatenate([inside[1], inside[0], rng.standard_normal((2 * (cone + planted), dimension))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")
    component = {r.vec_id: r.component_id for r in ed.near_vectors(table, window=16).collect()}
    assert sum(component[k] == component[planted + k] for k in range(planted)) >= 0.96 * planted
