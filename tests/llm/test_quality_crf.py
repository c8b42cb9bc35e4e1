from itertools import product

import numpy as np
import pytest

from gradelattice.llm import quality_crf as q


def brute_chain(unary, move):
    total, marginal, pairs = 0.0, np.zeros(len(unary)), np.zeros((2, 2))
    for y in product((0, 1), repeat=len(unary)):
        w = np.exp(sum(u for u, s in zip(unary, y) if s) + sum(move[a, b] for a, b in zip(y, y[1:])))
        total += w
        marginal += w * np.array(y)
        for a, b in zip(y, y[1:]):
            pairs[a, b] += w
    return marginal / total, pairs / total, np.log(total)


def test_forward_backward_agrees_with_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([3, 0, 1, 7, 2])
    unary, move = 3 * rng.standard_normal(counts.sum()), rng.standard_normal((2, 2))
    p, pairs, log_z = q.forward_backward(unary, move, counts)
    parts = [brute_chain(u, move) for u in np.split(unary, np.cumsum(counts)[:-1]) if len(u)]
    assert np.allclose(p, np.concatenate([x[0] for x in parts]))
    assert np.allclose(pairs, sum(x[1] for x in parts)) and log_z == pytest.approx(sum(x[2] for x in parts))


def test_long_and_extreme_chains_stay_finite():
    p, _, log_z = q.forward_backward(np.tile([800.0, -800.0], 2000), np.array([[2.0, -2], [-2, 2]]), np.array([4000]))
    assert np.isfinite(p).all() and np.isfinite(log_z)


def test_features_do_not_depend_on_neighbouring_documents():
    documents = [["One line.", "TWO!!! ###"], [], ["a | b | c"], ["x x x"]]
    together, sizes, counts = q.features(documents)
    assert counts.tolist() == [2, 0, 1, 1] and together.shape == (4, q.FEATURES)
    assert np.allclose(together, np.concatenate([q.features([d])[0] for d in documents if d]))


def corpus(n=240):
    rng = np.random.default_rng(3)
    words = ["stone", "river", "walks", "under", "bright", "city", "of", "the", "and"]
    sentence = lambda: " ".join(rng.choice(words, 9)).capitalize() + "."
    junk = lambda: " ".join(w + "###" for w in rng.choice(words, 9))
    rows = []
    for k in range(n):
        good = k % 3 > 0
        lines = [sentence() for _ in range(rng.integers(1, 6))] if good else [sentence()] * int(rng.integers(0, 2)) + [junk() for _ in range(rng.integers(2, 6))]
        rows.append((k, "\n".join(lines), int(good)))
    return rows


def test_fit_and_score(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t, _ in rows], "doc_id bigint, text string, quality string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (7, 1), (7, 1)], "doc_id bigint, quality int")
    from pyspark.sql import functions as F
    model = q.fit(docs, labels, F.col("doc_id") % 4 != 0)
    got = {r.doc_id: r.score for r in q.score(docs, model).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i % 4 == 0]
    assert np.mean(held) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n\n"), (None, "Stone walks under the city."), (4, "x### " * 30000), (4, "x### " * 30000)], "doc_id bigint, text string")
    found = q.score(odd, model).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in found if r.doc_id in (1, 2, 3)} == {round(model.prior, 6)}
    assert q.score(odd.limit(0), model).count() == 0


def test_degenerate_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "doc_id bigint, text string")
    ones = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id bigint, quality int")
    assert all(r.score > 0.5 for r in q.score(docs, q.fit(docs, ones)).collect())
    with pytest.raises(ValueError):
        q.fit(docs, ones.limit(0))


def test_held_out_accuracy(spark):
    from gradelattice.llm.queries import op2_quality_crf
    sf = "/root/testdata/sf0.01"
    found = op2_quality_crf(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert (found.predicted == found.quality).mean() > 0.95
