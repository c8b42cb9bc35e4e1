import random

import public_tokenizers
import pytest

from gradelattice.llm.pieces import BYTE, MARK, NORMAL, DoubleArray, Pieces, decode, encode

ODD = ["", " ", "  a", "a b", " a  b ", "\n\n x\ny\t", MARK, f"a{MARK}{MARK} b", "é😀\u0000", "<0x0A><s>", "　x y", "x" * 5000, "ab " * 5000]


@pytest.fixture(scope="module")
def model():
    return Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))


def toy():
    words = {"a": -1.0, "b": -1.5, "ab": -2.0, "ba": -2.2, "aba": -3.1, MARK: -1.0, MARK + "a": -2.5, MARK + "ab": -2.9, "é": -3.0, "c": -4.0}
    return Pieces([("<unk>", 0, 2)] + [(f"<0x{b:02X}>", 0, BYTE) for b in range(256)] + [(p, s, NORMAL) for p, s in words.items()]), words


def test_viterbi_finds_the_best_score():
    model, words = toy()

    def best(text):
        """By trying every segmentation."""
        if not text:
            return 0.0
        found = [s + best(text[len(p):]) for p, s in words.items() if text.startswith(p)]
        return max([*found, model.unknown + best(text[1:])])
    rng = random.Random(1)
    for _ in range(150):
        word = MARK * rng.randrange(2) + "".join(rng.choice("aabbcéz") for _ in range(rng.randrange(9)))
        ids = model.best(word)
        text = b"".join(model.plain[k] for k in ids).decode().replace(" ", MARK)
        fallen = [c for c in word if c not in words]
        assert text == word
        assert sum(model.score[k] for k in ids) + model.unknown * len(fallen) == pytest.approx(best(word))


def test_words_are_cut_as_whole_texts_are():
    model, _ = toy()
    for text in ("ab a ba\naba", "a  b", "\n\na é"):
        whole = model.best(MARK + text.replace(" ", MARK))
        assert model.encode(text).tolist() == whole


def test_double_array_holds_exactly_its_keys():
    rng = random.Random(2)
    keys = {bytes(rng.choice(b"ab\xff\x00") for _ in range(rng.randrange(1, 7))): k for k in range(300)}
    trie = DoubleArray(keys)

    def get(key):
        state = 0
        for c in key:
            child = trie.base[state] + c + 1
            if trie.check[child] != state:
                return -1
            state = child
        return trie.value[state]
    assert all(get(k) == v for k, v in keys.items())
    for _ in range(500):
        key = bytes(rng.choice(b"ab\xff\x00c") for _ in range(rng.randrange(1, 8)))
        assert get(key) == keys.get(key, -1)


def test_round_trip(model):
    assert [model.decode(model.encode(t).tolist()) for t in ODD] == ODD
    assert len(model.encode("The cat sat on the mat.")) < 12


def test_tables(spark, model):
    rows = [(k, t, 7) for k, t in enumerate(ODD)] + [(None, None, 7), (1, "a b", 7), (1, "a b", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = decode(encode(docs, model, check_into="same"), model).collect()
    assert all(r.same for r in got)
    assert len(got) == len(rows) and all(r.text == r.decoded for r in got)
    assert all(r.n_pieces == len(r.ids or []) and 0 <= r.n_bytes <= r.n_pieces for r in got)
    assert [r.ids for r in got if r.text is None] == [None]
    assert decode(encode(docs.limit(0), model), model).count() == 0


def test_words_searched_together_are_cut_as_alone(model):
    rng = random.Random(3)
    signs = ["a", "e", "t", "h", "in", "é", "字", MARK, "🎉", "\x00", "s", "ing", "ñ", "<0x41>", "1"]
    for each in (model, toy()[0]):
        words = sorted({"".join(rng.choice(signs) for _ in range(rng.randint(1, 12))) for _ in range(1500)}, key=lambda w: len(w.encode()))
        assert each.best_of_many([w.encode() for w in words]) == [each._packed(each.best(w)) for w in words]


def test_unspaced_lines_and_forgetting(model, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghij字") for _ in range(400)) + "\n" + " ".join("".join(rng.choice("abc") for _ in range(9)) for _ in range(30))
             for _ in range(40)]
    want = [model.encode(t).tolist() for t in texts]
    monkeypatch.setattr("gradelattice.llm.pieces.CACHE_BYTES", 4000)
    model.forget()
    assert [model.encode(t).tolist() for t in texts] == want
    assert model.held < 4000 + 40 * (180 + 9 + 40)  # a text's words at most beyond the bound
    assert max(map(len, model.known)) <= 64
