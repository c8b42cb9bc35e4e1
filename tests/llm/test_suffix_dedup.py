import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradelattice.llm import suffix_dedup as sd


def brute(rows, length):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        if i is not None:
            for k in range(len(data) - length + 1):
                g = data[k:k + length]
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = set()
        for k in range(len(data) - length + 1):
            if i is not None and first[data[k:k + length]] < i:
                gone |= set(range(k, k + length))
        kept = bytes(c for k, c in enumerate(data) if k not in gone)
        out.append((i if i is not None else -1, len(data), len(gone), sum(k - 1 not in gone for k in gone), kept))
    return sorted(out)


def result(removed):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), bytes(r.kept))
                  for r in removed.collect())


def corpus(seed):
    rng, rows = random.Random(seed), []
    parts = ["".join(rng.choice("abcdeé \n") for _ in range(rng.choice([20, 49, 50, 51, 80, 300]))) for _ in range(30)]
    for k in range(60):
        rows.append("".join(rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(90)))
                            for _ in range(rng.randrange(6))))
    rows += [rows[5], rows[5], "x" * 400, "x" * 49, "y" + "x" * 70, None, "", "ab" * 200, "ab" * 30, rows[7][:-1] + "!"]
    ids = rng.sample(range(1000), len(rows))
    return [*zip(ids, rows), (None, rows[5]), (None, None), (ids[3], rows[5]), (ids[3], rows[3])]


@pytest.mark.parametrize("length,chunk,size,anchors", [(50, 20_000, 16 << 20, 1 << 20), (50, 3, 500, 8), (24, 50, 2000, 64)])
def test_removal_agrees_with_brute_force(spark, monkeypatch, length, chunk, size, anchors):
    for name, value in (("CHUNK_PHRASES", chunk), ("SLICE_BYTES", size), ("BUCKET_ANCHORS", anchors)):
        monkeypatch.setattr(sd, name, value)
    rows = corpus(length + chunk)
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id bigint, text string, kept string, n_bytes int")
    assert result(sd.remove_repeats(docs, length=length)) == brute(rows, length)


def test_very_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sd, "_PIECE", 1000)
    rng = random.Random(9)
    a = "".join(rng.choice("abcdefghij ") for _ in range(20_000))
    rows = [(1, a), (2, "zz" + a[300:9_000] + "q" + a[9_000:9_060]), (3, a[:49] + "z" + a[100:149])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(sd.remove_repeats(docs)) == brute(rows, 50)


def test_empty_table(spark):
    assert sd.digest(sd.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0
    with pytest.raises(ValueError):
        sd.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string"), length=90)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=400), st.integers(0, 60), st.integers(0, 60))
def test_equal_strings_have_equal_triggers(data, before, after):
    """Every string lies in exactly one phrase, whose trigger depends on the string alone."""
    def triggers(text):
        trigger, first, last, _ = sd.phrases(text)
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)]) if len(first) else np.empty(0, int)
        assert starts.tolist() == list(range(max(0, len(text) - 49)))
        return dict(zip(starts.tolist(), np.repeat(trigger, last - first + 1).tolist()))
    plain, moved = triggers(data), triggers(bytes([1]) * before + data + bytes([2]) * after)
    assert all(moved[k + before] == t for k, t in plain.items())


def test_phrases_of_a_common_trigger_are_spread(spark, monkeypatch):
    """One short line in all documents: no call judges more phrases of a trigger than a chunk has."""
    monkeypatch.setattr(sd, "CHUNK_PHRASES", 20)
    rng = random.Random(3)
    line = "all rights reserved by the publisher"
    texts = ["".join(rng.choice("abcdef ") for _ in range(60)) + line + "".join(rng.choice("abcdef ") for _ in range(60)) for _ in range(150)]
    texts += [t[20:130] for t in texts[::7]] + texts[:5]
    rows = list(zip(rng.sample(range(1000), len(texts)), texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spread, whole = [], sd._spread_verdicts
    monkeypatch.setattr(sd, "_spread_verdicts", lambda hot, length: spread.append(hot.count()) or whole(hot, length))
    assert result(sd.remove_repeats(docs)) == brute(rows, 50) and spread and spread[0] > 20
