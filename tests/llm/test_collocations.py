"""Mined phrases against counting every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from gradelattice.llm import collocations

SCHEMA = "doc_id bigint, text string, lang string"


def brute(rows, support=30, top=2000, contained=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for a in range(len(words) - k + 1):
                    counts[lang, tuple(words[a:a + k])] += 1
    found = {(lang, p): a for (lang, p), a in counts.items() if len(p) > 1 and a >= support}
    out = {}
    for (lang, p), a in found.items():
        if any(100 * b >= contained * a and len(q) > len(p) and any(q[k:k + len(p)] == p for k in range(len(q))) for (m, q), b in found.items() if m == lang):
            continue
        score, cut = min((2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:cut]], counts[lang, p[cut:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, totals[lang], -s) for lang, group in out.items()
                  for rank, (s, a, p, l, r) in enumerate(sorted(group)[:top], 1))


def mine(spark, rows, **limits):
    docs = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, collocations.collocations(docs, **limits).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def corpus(seed, docs=120):
    rnd = random.Random(seed)
    words = ["new", "York", "the", "of", "and", "É", "字", "x" * 30, "1", "-", "o'clock"]
    gaps = [" "] * 12 + ["  ", "\t", ". ", ", ", "\n", "\r\n", "\x0b", "!", " : ", "\x85", "\xa0"]
    fixed = ["State of the art. ", "new York city hall ", "as well as as well as"]
    rows = []
    for k in range(docs):
        text = "".join(rnd.choice(fixed) if rnd.random() < 0.2 else rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randint(0, 40)))
        rows.append((rnd.choice([k, 7, None]), text, rnd.choice(["en", "en", "en", "fr", None, "und"])))
    return rows + [(1, None, "en"), (2, "", "en"), (3, "word", None), (4, "...", "de")]


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_phrases_are_those_of_counting_everything(spark, shards):
    rows = corpus(shards)
    assert mine(spark, rows, shards=shards) == brute(rows)
    assert mine(spark, rows, shards=shards, support=7, top=9) == brute(rows, support=7, top=9)


def test_one_document_may_hold_everything(spark):
    rows = [(1, "a rose is " * 400 + "end", "en")] + [(k, "other", "en") for k in range(5)]
    assert mine(spark, rows) == brute(rows)


def test_empty_tables_extra_columns_and_other_names(spark):
    assert mine(spark, spark.createDataFrame([], SCHEMA).collect()) == []
    docs = spark.createDataFrame([(k, "the same words", "en", 1, 2) for k in range(40)], "key bigint, body string, phrase string, n int, lang int")
    got = collocations.collocations(docs, id="key", text="body", lang="phrase").collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got] == [("the same words", 40, 40, 40, 120, 1000000)]


@pytest.mark.parametrize("limit", [3, 17, 200])
def test_cutting_texts_loses_no_phrase_and_counts_none_twice(limit):
    rows = [r for r in corpus(5, 40)]
    texts = [(t or "").encode() for _, t, _ in rows]
    salts = np.zeros(len(texts), np.uint64)

    def seen(size):
        counter, langs, codes = collocations.Counter(4), ["en"] * len(texts), np.zeros(len(texts), int)
        for block in collocations.blocks(texts, salts, size):
            counter.add(block, langs, codes, [])
        return {(b.column(1)[k].as_py(), b.column(2)[k].as_py()): b.column(3)[k].as_py() for b in counter.summed() for k in range(b.num_rows)}

    assert seen(limit) == seen(1 << 20)


def test_words_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(collocations, "_mixed", lambda h: h & np.uint64(3))
    rows = [(1, "a b c d e f a b", "en")]
    counter = collocations.Counter(4)
    for block in collocations.blocks([rows[0][1].encode()], np.zeros(1, np.uint64)):
        counter.add(block, ["en"], np.zeros(1, int), [])
    got = {b.column(2)[k].as_py(): b.column(3)[k].as_py() for b in counter.summed() for k in range(b.num_rows)}
    assert got["a b"] == 2 and got["a"] == 2 and got["c"] == 1 and got[""] == 8


def test_many_flushes_and_a_crowded_filter_change_nothing(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(collocations, "FILTER_BITS", 5)
    monkeypatch.setattr(collocations, "SEGMENT_BITS", 4)
    assert mine(spark, rows, support=10) == brute(rows, support=10)


def test_counter_hands_on_when_full(monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 50)
    texts = [t.encode() for _, t, _ in corpus(2) if t]
    codes, langs = np.zeros(len(texts), int), ["en"] * len(texts)

    def total(limit, flush):
        counter, out = collocations.Counter(4), Counter()
        def take():
            for b in counter.summed():
                for r in b.to_pylist():
                    out[r["size"], r["phrase"]] += r["n"]
        for block in collocations.blocks(texts, np.zeros(len(texts), np.uint64), limit):
            counter.add(block, langs, codes, [])
            if flush and counter.full():
                take()
        take()
        return out

    assert total(100, True) == total(1 << 20, False)
