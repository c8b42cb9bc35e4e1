import hashlib
import math

import numpy as np
import pytest

from gradelattice.operators import enumerate as enumerate_
from gradelattice.operators import sampling
from tests import brute


def brute_quota(counts, maxn):
    quota = {c: 0 for c in counts}
    if maxn == 0:
        return quota
    used = 0
    if counts.get(0):
        quota[0] = used = 1
    budget = maxn - used
    if budget == 0:
        return quota
    total = sum(math.sqrt(n) for c, n in counts.items() if c > 0)
    for c, n in counts.items():
        if c > 0:
            quota[c] = min(n, max(1, math.floor(math.sqrt(n) / total * budget)))
    while sum(quota.values()) > maxn:
        best = max((c for c in quota if c > 0 and quota[c] > 1), key=lambda c: (quota[c], -c), default=None)
        if best is None:
            break
        quota[best] -= 1
    return quota


def brute_sample(sets, maxn, seed, levels):
    def order(s):
        return hashlib.md5(f"{seed}:{len(s)}:{brute.mask(s)}".encode()).hexdigest()
    counts = {}
    for s in sets:
        counts[len(s)] = counts.get(len(s), 0) + 1
    quota = brute_quota(counts, maxn)
    chosen, last, total = {}, -1, 0
    for card in sorted(c for c, q in quota.items() if q > 0):
        rest, taken = sorted((s for s in sets if len(s) == card), key=order), []
        if card > 0 and last >= 0:
            for k in range(levels, 4):
                pool = [p for c in range(last, last - k, -1) for p in chosen.get(c, [])]
                score = {s: sum(p <= s for p in pool) for s in rest}
                linked = sorted((s for s in rest if score[s]), key=lambda s: (-score[s], order(s)))
                taken += linked[:quota[card] - len(taken)]
                rest = [s for s in rest if s not in taken]
        taken += rest[:quota[card] - len(taken)]
        chosen[card], last = taken, card
        total += len(taken)
        if total >= maxn:
            break
    return {s for part in chosen.values() for s in part}


def random_sets(seed, n, m):
    rng = np.random.default_rng(seed)
    return {frozenset(np.nonzero(rng.random(m) < rng.random())[0].tolist()) for _ in range(n)}


@pytest.mark.parametrize("maxn", [0, 1, 3, 12, 30, 1000])
def test_quotas(spark, maxn):
    counts = {0: 1, 1: 7, 2: 30, 3: 55, 5: 2}
    histogram = spark.createDataFrame(list(counts.items()), "card int, n bigint")
    assert sampling.sqrt_quota(histogram, maxn) == brute_quota(counts, maxn)


def test_trim_matches_one_by_one():
    for quotas in ({1: 9, 2: 9, 3: 4}, {0: 1, 1: 1, 2: 1}, {1: 20, 2: 3}):
        for maxn in range(1, 25):
            plain = dict(quotas)
            while sum(plain.values()) > maxn:
                best = max((c for c in plain if c > 0 and plain[c] > 1), key=lambda c: (plain[c], -c), default=None)
                if best is None:
                    break
                plain[best] -= 1
            assert sampling.trim_quotas(quotas, maxn) == plain


@pytest.mark.parametrize("maxn,levels", [(25, 1), (40, 2), (60, 3), (10_000, 1)])
def test_sample(spark, monkeypatch, maxn, levels):
    sets = random_sets(4, 120, 8)
    frame = spark.createDataFrame([(brute.mask(s),) for s in sets], "mask bigint")
    expected = brute_sample(sets, maxn, 42, levels)
    got = [brute.members(r.mask) for r in sampling.quota_sample(frame, 8, maxn, 42, levels).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_rows_of_one_set_stay_apart(spark):
    rows = [(n, f"line {n}", brute.mask(s)) for n, s in enumerate(s for s in random_sets(6, 40, 5) for _ in range(3))]
    frame = spark.createDataFrame(rows, "line bigint, value string, mask bigint").repartition(3)
    got = sampling.quota_sample(frame, 5, 50, key="line").collect()
    quotas = sampling.sqrt_quota(sampling.card_histogram(frame, 5), 50)
    assert len({r.line for r in got}) == len(got) == sum(quotas.values())
    assert all((r.line, r.value, r.mask) in set(rows) for r in got)
    assert {c: sum(r.card == c for r in got) for c in quotas} == quotas
    assert len({r.mask for r in got}) < len(got)
    assert sampling.quota_sample(frame.limit(0), 5, 50, key="line").count() == 0


def test_sample_by_rank(spark, monkeypatch):
    sets = random_sets(5, 80, 7)
    frame = spark.createDataFrame([(brute.mask(s),) for s in sets], "mask bigint").repartition(4)
    monkeypatch.setattr(enumerate_, "TOP_ROWS", 2)
    got = {brute.members(r.mask) for r in sampling.quota_sample(frame, 7, 30).collect()}
    assert got == brute_sample(sets, 30, 42, 1)


def test_parent_cap_counts_only_the_first(spark):
    pool = spark.createDataFrame([(1, 1, 0, 0, "a"), (2, 1, 0, 0, "b")], "mask bigint, card int, tier int, links bigint, ord string")
    candidates = spark.createDataFrame([(3,), (2,)], "mask bigint")
    got = {r.mask: r.n for r in sampling.link_scores(candidates, pool, 2, "n", max_parents=1).collect()}
    assert got == {3: 1, 2: 0}
