import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradelattice.llm import decontaminate as dc


def brute(text, items, window):
    words, marks, names = dc.words_of(text), set(), set()
    for name, item in items:
        w = dc.words_of(item)
        size = min(window, len(w))
        grams = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if w else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k:k + size]) in grams:
                marks |= set(range(k, k + size))
                names.add(name)
    return len(words), len(marks), sorted(names)


TEXTS = st.lists(st.sampled_from(["a", "b", "C", "é", "d1"]), max_size=12).map(lambda w: " ".join(w).encode())


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, max_size=6), st.lists(TEXTS, min_size=1, max_size=4), st.integers(1, 4))
def test_automaton_agrees_with_brute_force(texts, items, window):
    named = [(str(k), t) for k, t in enumerate(items)]
    automaton = dc.SuffixAutomaton([(n, dc.words_of(t)) for n, t in named], window)
    for text in texts:
        import numpy as np
        coded = np.array([automaton.vocabulary.get(w, -1) for w in dc.words_of(text)] + [-1], np.int32)
        marks, names = set(), set()
        for a, b in automaton.runs(coded):
            for end, size, found in automaton.scan(coded[a:b].tolist()):
                marks |= set(range(a + end - size, a + end))
                names |= found
        assert (len(coded) - 1, len(marks), sorted(names)) == brute(text, named, window)


@pytest.fixture
def tables(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(1, "x x x x " + passage.upper() + ", y", "k"), (2, None, None), (3, "", "k"), (4, "Two three", "k"), (5, passage, "k"),
            (5, passage, "k"), (None, "short item!", "k"), (7, "filler " * 5000 + passage + " tail", "k"), (8, "clean text", "k")]
    items = [(10, passage, "a"), (9, "short-ITEM", "b"), (11, None, "c"), (12, "...", "d"), (None, "six seven", "e"), (10, passage, "a")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string, doc_id string")


@pytest.mark.parametrize("block", [1, 200_000])
def test_find_and_remove(spark, tables, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_WORDS", block)
    docs, items = tables
    named = [(("null" if r.item_id is None else str(r.item_id)), r.text.encode()) for r in items.collect() if r.text]
    want = sorted((r.doc_id or -1, *brute(r.text.encode() if r.text else None, named, 10)) for r in docs.collect())
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in dc.find_copies(docs, items).collect())
    assert got == want
    kept = {r.doc_id: r for r in dc.remove_copies(docs, items).collect()}
    assert set(kept) == {1, 2, 3, 4, 7, 8} and kept[2].text is None and kept[8].text == "clean text"
    assert kept[1].text == "x x x x , y" and kept[7].text == "filler " * 5000 + " tail" and kept[1].item_id == "k"


def test_empty_tables(spark, tables):
    docs, items = tables
    assert dc.find_copies(docs.limit(0), items).count() == 0
    rows = dc.find_copies(docs, items.limit(0)).collect()
    assert len(rows) == 9 and not any(r.n_hit for r in rows)
