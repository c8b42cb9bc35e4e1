"""Encoding and decoding by speculated byte pairs against the tokenizers library."""

import hashlib
import json
import random
import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradelattice.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
SIGNS = ["a", "b", "'s", "'ll", "A", "É", "é", "Σ", "ς", " ", "  ", "\t", "\n", "\x00", "\x1c", "\x1f", "\x85", "　", "1", "٣", "½", "字",
         "<|endoftext|>", "<|startoftext|>", "<|", "|>", "</w>", "w", "'", "!", "?", "́", "ß", "İ", "ǅ", "🎉", "\x7f", "ﬁ", "the",
         "ing", "aaaa", "__", "﻿", "​", "e", "th"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    return bpe.MergeModel(PATH)


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_texts_are_encoded_and_decoded_as_by_the_library(model, library):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    for text, got in zip(texts, model.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert got == packed(want), text
        assert model.decode(want) == library.decode(want, skip_special_tokens=False)


def test_every_pair_verdict_is_that_of_merging_the_pair(model):
    rnd = random.Random(3)
    tokens = [t for t, k in model.inner.items()]
    ends = list(model.final)
    pairs = [(rnd.choice(tokens), rnd.choice(tokens if n % 2 else ends)) for n in range(6000)]
    pairs += [("a" * n, "a" * k) for n in range(1, 5) for k in range(1, 5) if "a" * n in model.inner and "a" * k in model.inner]
    import numpy as np
    kinds = [n % 2 == 1 or n >= 6000 for n in range(len(pairs))]
    x = np.array([model.inner[a] for a, _ in pairs])
    y = np.array([(model.inner if inside else model.final)[b] for (_, b), inside in zip(pairs, kinds)])
    for (a, b), inside, clash, p, q in zip(pairs, kinds, model.clashes(x, y), x.tolist(), y.tolist()):
        assert clash == (model._merged(model._signs(a + b, not inside)) != [p, q]), (a, b)


def test_words_that_fail_are_merged_and_long_ones_too(model, library):
    rnd = random.Random(5)
    words = list({"".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 25))) for _ in range(3000)})
    proposals = [model._greedy(w) for w in words]
    found = model.words(words)
    assert 0 < sum(a == b for a, b in zip(proposals, found)) < len(words)  # both ways are taken
    for word, ids in zip(words, found):
        assert ids == library.encode(word, add_special_tokens=False).ids
    for text in ("a" * 30000, "ab" * 20000, "字" * 8000, "".join(rnd.choice("abcdefgh") for _ in range(60000))):
        assert model.encode([text])[0] == packed(library.encode(text, add_special_tokens=False).ids)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    model, rnd = bpe.MergeModel(PATH), random.Random(2)
    for _ in range(30):
        texts = [" ".join("".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 90))) for _ in range(8))]
        assert model.encode(texts)[0] == packed(library.encode(texts[0], add_special_tokens=False).ids)


def test_other_rules_go_through_the_library_parts(tmp_path):
    spec = json.load(open(PATH))
    spec["normalizer"] = None
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(spec))
    model, library = bpe.MergeModel(str(path)), Tokenizer.from_file(str(path))
    assert model.pattern is None
    for text in ("Hello  World\n'sa", "", "é<|endoftext|>x"):
        assert model.encode([text])[0] == packed(library.encode(text, add_special_tokens=False).ids)


def test_columns_nulls_clashes_repeats_and_empty_tables(spark, library):
    rows = [(1, "Some text, 12 words", "x", 5), (2, None, None, None), (3, "", "y", 6), (1, "Some text, 12 words", "x", 5), (None, "a\tb", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int")
    done = bpe.encode(docs, PATH, decoded="decoded").collect()
    assert len(done) == 5 and done[0].__fields__ == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    for row in done:
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        assert (row.ids, row.n_tokens, row.decoded) == (ids, len(ids), library.decode(ids, skip_special_tokens=False))
    again = bpe.decode(bpe.encode(docs, PATH), PATH).select("doc_id", "decoded").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in spark.createDataFrame(
        [(r.doc_id, r.decoded) for r in done], "doc_id bigint, decoded string").collect())
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    null_ids = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(null_ids, PATH).collect()] == [None, ""]


def test_query_matches_the_library_on_the_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = library.encode(text, add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert got[doc_id] == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(said.encode()).hexdigest())
