import re

import public_tokenizers
import pytest

import corpus_pipeline as cp
from gradelattice.llm import decontaminate as dc
from gradelattice.llm import language_id
from gradelattice.llm.pieces import Pieces
from gradelattice.session import stage
from tests.llm.test_minhash import brute as near_brute

SF = "/root/testdata/sf0.001"
FOUND = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+\w|\+\d \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b[0-9a-fA-F]{40}\b|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])")


@pytest.fixture(scope="module")
def steps(spark):
    """What goes into the first stage, and what comes out of each."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, function in cp.STAGES:
        out.append(stage(function(spark, out[-1], SF), name))
    return out


def rows(frame):
    return sorted(map(tuple, frame.select("doc_id", "text").collect()))


def test_columns(steps):
    assert [f.columns for f in steps[1:-1]] == [steps[0].columns] * 4
    assert all(r.n_chars == len(r.text) for f in steps[:-1] for r in f.collect())


def test_language_stage(spark, steps):
    identifier = language_id.fit(steps[0])
    texts = rows(steps[0])
    accepted = identifier.predict([t for _, t in texts])[2]
    assert rows(steps[1]) == [r for r, ok in zip(texts, accepted) if ok] and sum(accepted) > 0.97 * len(texts)


def test_near_copies_stage(steps):
    kept = {i for i, _, _, ok in near_brute(rows(steps[1]), 5, 80) if ok}
    assert rows(steps[2]) == [r for r in rows(steps[1]) if r[0] in kept]


def test_decontamination_stage(spark, steps):
    items = [dc.words_of(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[k:k + min(10, len(w))]) for w in items for k in range(len(w) - min(10, len(w)) + 1)}
    want = []
    for i, text in rows(steps[2]):
        words = dc.words_of(text.encode())
        hit = {p for n in {len(g) for g in grams} for k in range(len(words) - n + 1) if tuple(words[k:k + n]) in grams for p in range(k, k + n)}
        if len(hit) <= 0.8 * len(words):
            spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
            gone = sorted((spans[p][0], spans[p + 1][0] if p + 1 in hit else spans[p][1]) for p in hit)
            want.append((i, "".join(c for k, c in enumerate(text) if not any(a <= k < b for a, b in gone))))
    assert rows(steps[3]) == want and rows(steps[3]) != rows(steps[2])


def test_personal_data_stage(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert [i for i, _ in before] == [i for i, _ in after] and before != after
    for (_, a), (_, b) in zip(before, after):
        assert len(FOUND.findall(a)) == len(FOUND.findall(b)) and not set(FOUND.findall(a)) & set(FOUND.findall(b))
        assert FOUND.sub("", a) == FOUND.sub("", b)


def test_pieces_stage_and_run(spark, steps):
    model, texts = Pieces.load(public_tokenizers.path("piece_bpe_32k.model")), dict(rows(steps[4]))
    out = {r.doc_id: r for r in steps[5].collect()}
    assert set(out) == set(texts)
    for i, r in out.items():
        assert r.round_trip and r.n_pieces == len(r.ids) and model.decode(r.ids) == texts[i]
    assert {r.doc_id: r.ids for r in cp.run(spark, SF).collect()} == {i: r.ids for i, r in out.items()}


def test_odd_rows_pass_all_stages(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (2, " \n", None, "s", 2), (3, "the river and the stone " * 9000, None, "s", 1),
           (4, "the river and the stone", "en", "s", 1), (4, "the river and the stone", "en", "s", 1), (5, "12 !", "xx", "s", 4)]
    for given in (odd, []):
        docs = spark.createDataFrame(given, schema)
        for name, function in cp.STAGES:
            docs = stage(function(spark, docs, SF), name)
        assert {r.doc_id for r in docs.collect()} <= {None, 1, 2, 3, 4, 5}
