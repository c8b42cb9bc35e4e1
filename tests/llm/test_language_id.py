import math
from collections import Counter

import numpy as np
import pytest

from gradelattice.llm import language_id as li


def brute_probability(texts, order, alphabet, context, char):
    """Interpolated Kneser-Ney of one language, from the definition, by recursion over the order."""
    top = Counter(t[k:k + order] for t in texts for k in range(len(t) - order + 1))
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(k, context):
        if k == 0:
            return 1 / alphabet
        counts = levels[k]
        once, twice = (sum(1 for c in counts.values() if c == n) for n in (1, 2))
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        context = context[len(context) - k + 1:]
        follow = {g[-1]: c for g, c in counts.items() if g[:-1] == context}
        total = sum(follow.values())
        lower = p(k - 1, context)
        if not total:
            return lower
        return max(follow.get(char, 0) - d, 0) / total + d * len(follow) / total * lower
    return p(order, context)


def test_model_agrees_with_the_definition():
    texts = {"x": ["abracadabra", "abba"], "y": ["banana band", "cabana"]}
    order = 3
    grams = {n: Counter(t[k:k + order] for t in v for k in range(len(t) - order + 1)) for n, v in texts.items()}
    rows = sorted(set().union(*grams.values()))
    codes = np.array([[ord(c) for c in g] for g in rows], np.uint32)
    counts = np.array([[grams[n][g] for n in texts] for g in rows])
    model = li.KneserNey(codes, counts, list(texts), least=1)
    alphabet = len({g[-1] for g in rows}) + 1
    text = "abracabana bandz qq aab"
    found = model.log_probabilities(np.array([ord(c) for c in text], np.uint32), order)
    for k in range(order, len(text)):
        for j, name in enumerate(texts):
            want = brute_probability(texts[name], order, alphabet, text[k - order + 1:k], text[k])
            assert found[k - order, j] == pytest.approx(math.log2(want), abs=1e-4)


def test_letters():
    show = lambda t: "".join(map(chr, li.letters(t)))
    assert show("  Ab,, C-d 12\n") == "ab c d" and show(None) == show("12 !?") == "" and show("É\U00020000") == "é\U00020000" and show("😀 1") == ""


def test_entropies_do_not_depend_on_neighbours_or_steps(monkeypatch):
    grams = np.array([[97, 98], [98, 97], [32, 97]], np.uint32)
    model = li.KneserNey(grams, np.array([[5, 1], [4, 0], [1, 3]]), ["p", "q"], least=1)
    documents = [li.letters(t) for t in ("ab ba", "", "a", "b" * 300)]
    sizes, bits = model.entropies(documents)
    monkeypatch.setattr(li, "STEP", 7)
    assert np.allclose(model.entropies(documents)[1], bits)
    for k, d in enumerate(documents):
        assert np.allclose(model.entropies([d])[1][0], bits[k])


def test_fit_and_identify(spark):
    words = {"l1": "the cat sat on that mat with this hat", "l2": "der hund und die katze sind nicht hier", "l3": "el gato está en la casa del señor"}
    rows = [(k, " ".join(np.random.default_rng(k).permutation(t.split() * 3)), n, "z") for n, t in words.items() for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string")
    identifier = li.fit(docs)
    odd = [(1, None, None, ""), (2, "", None, ""), (3, "123 !", None, ""), (4, "the mat that sat with the cat", "l3", ""),
           (None, "die katze und der hund", None, ""), (5, "el gato del señor " * 5000, None, ""), (6, "xqzw kjvx wqqz zxkq " * 40, None, ""),
           (4, "the mat that sat with the cat", "l3", "")]
    found = li.identify(spark.createDataFrame(odd, docs.schema), identifier).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == 8 and [by[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and by[1].lang_score == 0 and not by[1].lang_accepted
    assert by[4].lang_pred == "l1" and by[None].lang_pred == "l2" and by[5].lang_pred == "l3" and by[5].lang_accepted
    assert not by[6].lang_accepted and by[6].lang_score < 0.5 and all(0 <= r.lang_score <= 1 for r in found)
    assert li.identify(docs.limit(0), identifier).count() == 0
    with pytest.raises(ValueError):
        li.fit(docs.limit(0))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from gradelattice.llm.queries import op1_language_id
    found = op1_language_id(spark, "/root/testdata/sf0.001").where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.95
