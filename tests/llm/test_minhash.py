import random

import numpy as np
import pytest

from gradelattice.llm import minhash as mh
from tests.llm.test_graph import brute as united


def brute(rows, words, percent):
    sets = [(i, {tuple(w[k:k + min(words, len(w))]) for k in range(len(w) - min(words, len(w)) + 1)} if w else set())
            for i, t in rows for w in [(t or "").encode().lower().split()]]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k]
             if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y)]
    group = united(links)
    return sorted(((i if i is not None else -1, len(s), group.get(i, i) if i is not None else None, i is not None and group.get(i, i) == i)
                   for i, s in sets), key=repr)


def corpus(seed=3):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{k}" for k in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 60, 200]))] for _ in range(25)]
    for base in bases:
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 3, len(base) // 25])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    odd = [None, "", " \n ", "one", "ONE", "one two", "One\tTwo", "É é", " ", "long " * 4000, "long " * 4001]
    return [(k * 3 + 1, t) for k, t in enumerate(rows + odd)] + [(None, "one"), (1, "one two"), (2, "one two")]


@pytest.mark.parametrize("words,block,limit", [(2, 256, 2_000_000), (2, 2, 0), (5, 256, 2_000_000)])
def test_groups_agree_with_brute_force(spark, monkeypatch, words, block, limit):
    monkeypatch.setattr(mh, "BLOCK", block)
    monkeypatch.setattr(mh, "BROADCAST_IDS", limit)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, component_id string, n bigint")
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id, r.kept)
                  for r in mh.near_duplicates(docs, words=words).collect()), key=repr)
    assert got == brute(rows, words, 80)
    kept = mh.keep_one_of_each(docs, words=words)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _, k in brute(rows, words, 80) if k} | {None}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert mh.near_duplicates(docs).count() == 0 and mh.keep_one_of_each(docs).count() == 0


def test_signature_estimates_similarity():
    a, b = np.arange(0, 900, dtype=np.uint64), np.arange(100, 1000, dtype=np.uint64)
    x, y = (mh.signature(mh._scatter(s + np.uint64(77)), 160) for s in (a, b))
    assert abs((x == y).mean() - 0.8) < 0.12
