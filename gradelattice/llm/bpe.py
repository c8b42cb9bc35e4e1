"""Byte-pair encoding by speculation, and decoding.

A greedy longest match proposes the tokens of a word.  A proposal is the merge result exactly if no merge could ever join
two neighbouring tokens while they were built up, and that depends on each adjacent pair alone; the pairs of all new words
are tested together in NumPy.  Only words with a pair that fails are merged step by step.

Why pairs suffice: merges of a trained vocabulary need parts that earlier merges made, so they run in order of rank.  Take
the first merge across a border of the proposal.  Up to it both neighbours went through the very states that they pass
on their own, so the same merge would cross the border if the two stood alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import sys
from array import array
from codecs import charmap_decode
from collections.abc import Iterable, Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gradelattice.llm.batches import slices, texts
from gradelattice.session import ship_package

TEXT_BYTES = 2 << 20  # text a worker splits at once
CACHE_BYTES = 96 << 20  # what a worker remembers, by the sizes below; beyond, it starts anew
ENTRY_BYTES = 220  # of an entry besides its text and ids
LONGEST_KEPT = 64  # longer chunks are not remembered
ABSENT = np.int64(1) << 60
SHORT = 40  # signs of a word up to which many are merged together
TOGETHER = 4096
LATIN = "\u0250"

_models: dict = {}


class MergeModel:
    """Tokens and merges of a tokenizer file, with what the pair test needs of them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix")):
            raise ValueError("only plain byte-pair models are supported")
        if not model["merges"]:
            raise ValueError("a model without merges")
        self.library = Tokenizer.from_file(path)
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._special(spec.get("added_tokens") or [])
        self._spines(merges)
        self._matcher()
        self._splitter(spec)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _special(self, added: list[dict]) -> None:
        if any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("added tokens must be plain")
        self.special = {a["content"]: a["id"] for a in added}
        names = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(names) + ")") if names else None
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.token = [""] * size
        for text, k in [*self.vocab.items(), *self.special.items()]:
            self.token[k] = text

    def _spines(self, merges: list[tuple[str, str]]) -> None:
        """For every token: the rank of the merge that made it (-1 for a single sign) and its two parts."""
        size, vocab = len(self.token), self.vocab
        self.birth = np.full(size, -1, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rule: dict[int, tuple[int, int]] = {}
        keys = np.empty(len(merges), np.int64)
        for rank, (a, b) in enumerate(merges):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            if self.birth[made] >= 0 or max(self.birth[x], self.birth[y]) >= rank:
                raise ValueError("merges must make each token once, of earlier ones")
            self.birth[made], self.left[made], self.right[made] = rank, x, y
            keys[rank] = self._key(x, y)
            self.rule[int(keys[rank])] = (rank, made)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([self.rule[int(k)][1] for k in self.keys], np.int64)

    @staticmethod
    def _key(x, y):
        return (x << 32) | y

    def _matcher(self) -> None:
        """Tokens by text, inside a word and at its end, and the lengths of those that begin with the same three signs.

        Only tokens that merging makes of their own text take part: others never stand in a proposal that holds.
        """
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for text, k in self.vocab.items():
            if self.suffix and text.endswith(self.suffix) and len(text) > len(self.suffix):
                self.final[text[:-len(self.suffix)]] = k
            else:
                self.inner[text] = k
        lengths: dict[str, set[int]] = {}
        for text in self.inner:
            if len(text) > 2:
                lengths.setdefault(text[:3], set()).add(len(text))
        self.lengths = {start: tuple(sorted(sizes, reverse=True)) for start, sizes in lengths.items()}
        self.final_reach = max(map(len, self.final), default=0)
        if not self.suffix:
            self.final, self.final_reach = self.inner, max(map(len, self.inner), default=0)
        for kind in (self.inner, self.final):
            for text in [t for t, k in kind.items() if self.birth[k] >= 0 and self._merged(self._signs(t, kind is self.final)) != [k]]:
                del kind[text]

    def _splitter(self, spec: dict) -> None:
        """The word pattern for Latin letters, where the file's rules are of the kind that white space always separates.

        Signs before ``LATIN`` are composed as they stand, so only lower case is left of the normal form.
        """
        self.pattern = None
        normal, before = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = [s.get("type") for s in normal.get("normalizers", [])]
        parts = before.get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [p.get("type") for p in parts] != ["Split", "ByteLevel"]:
            return
        split, byte = parts
        regex = split["pattern"].get("Regex", "")
        if not (split["behavior"] == "Removed" and split["invert"] and not byte["add_prefix_space"] and not byte["use_regex"]):
            return
        letters, numbers = ({c for k in range(ord(LATIN)) for c in chr(k).lower() if category(c)[0] == kind} for kind in "LN")
        latin = regex
        for name, signs in (("L", letters), ("N", numbers)):
            listed = "".join(sorted(signs))
            latin = latin.replace(f"[\\p{{{name}}}]", f"[{listed}]").replace(f"\\p{{{name}}}", listed)
        latin = latin.replace("\\s", "\\s\x85\xa0")
        if "\\p" not in latin and "[^\\s" in latin:
            self.pattern = re.compile(latin, re.ASCII)
            free = iter(range(256, 512))
            visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
            self.byte_signs = "".join(chr(k if k in visible else next(free)) for k in range(256))

    # ------------------------------------------------------------ words

    def _pieces(self, chunk: str) -> list[str]:
        """The words of a chunk, in the signs that stand for bytes."""
        if self.pattern is not None and ((seen := chunk.isascii()) or max(chunk) < LATIN):
            words = self.pattern.findall(chunk.lower())
            if seen and chunk.isprintable():
                return words
            return [charmap_decode(w.encode(), "strict", self.byte_signs)[0] for w in words]
        plain = self.library.normalizer.normalize_str(chunk) if self.library.normalizer else chunk
        if not self.library.pre_tokenizer:
            return [plain] if plain else []
        return [word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def _signs(self, word: str, whole: bool = True) -> list[int]:
        """Ids of the single signs of a word; signs outside the vocabulary are left out, as the library does without an unknown token."""
        vocab = self.vocab
        last = word[-1] + self.suffix if whole else word[-1]
        return [vocab[c] for c in [*word[:-1], last] if c in vocab]

    def _greedy(self, word: str) -> list[int] | None:
        """Longest tokens from left to right; None where none fits."""
        out, at, end = [], 0, len(word)
        inner, final, lengths, longest = self.inner, self.final, self.lengths, self.final_reach
        while True:
            left = end - at
            if left <= longest:
                k = final.get(word[at:])
                if k is not None:
                    out.append(k)
                    return out
            for size in lengths.get(word[at:at + 3], ()):
                if size < left and (k := inner.get(word[at:at + size])) is not None:
                    break
            else:
                for size in (2, 1):
                    if size < left and (k := inner.get(word[at:at + size])) is not None:
                        break
                else:
                    return None
            out.append(k)
            at += size

    def _merged(self, ids: list[int]) -> list[int]:
        """Merges step by step: the lowest rank first, the leftmost of equals."""
        size, rule = len(ids), self.rule
        after, before = [*range(1, size), -1], list(range(-1, size - 1))
        heap = []
        for k in range(size - 1):
            found = rule.get((ids[k] << 32) | ids[k + 1])
            if found:
                heap.append((found[0], k, found[1], ids[k], ids[k + 1]))
        heapq.heapify(heap)
        while heap:
            _, k, made, x, y = heapq.heappop(heap)
            n = after[k]
            if n < 0 or ids[k] != x or ids[n] != y:
                continue
            ids[k], ids[n] = made, -1
            follow = after[k] = after[n]
            if follow >= 0:
                before[follow] = k
                found = rule.get((made << 32) | ids[follow])
                if found:
                    heapq.heappush(heap, (found[0], k, found[1], made, ids[follow]))
            prior = before[k]
            if prior >= 0:
                found = rule.get((ids[prior] << 32) | made)
                if found:
                    heapq.heappush(heap, (found[0], prior, found[1], ids[prior], made))
        return [k for k in ids if k >= 0]

    def _looked_up(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs, ``ABSENT`` where no merge joins them, and what merging makes."""
        key = self._key(x, y)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        there = self.keys[at] == key
        return np.where(there, self.ranks[at], ABSENT), self.made[at]

    def _merged_together(self, words: list[list[int]]) -> list[list[int]]:
        """``_merged`` of many short words: a round makes one merge in each."""
        width = max(map(len, words))
        signs = np.full((len(words), width + 1), -1, np.int64)
        for row, word in zip(signs, words):
            row[:len(word)] = word
        rank = self._looked_up(signs[:, :-1], signs[:, 1:])[0]
        live, column = np.arange(len(words)), np.arange(width + 1)
        done, now = signs.copy(), signs
        while len(live):
            at = rank.argmin(axis=1)
            row = np.arange(len(live))
            open_ = rank[row, at] < ABSENT
            done[live[~open_]] = now[~open_]
            live, now, rank, at = live[open_], now[open_], rank[open_], at[open_]
            row = np.arange(len(live))
            made = self._looked_up(now[row, at], now[row, at + 1])[1]
            behind = column[None, :] > at[:, None]
            now[:, :-1] = np.where(behind[:, :-1], now[:, 1:], now[:, :-1])
            rank[:, :-1] = np.where(behind[:, :-2], rank[:, 1:], rank[:, :-1])
            now[:, -1], rank[:, -1] = -1, ABSENT
            now[row, at] = made
            rank[row, at] = self._looked_up(made, now[row, at + 1])[0]
            inner = np.flatnonzero(at)
            rank[inner, at[inner] - 1] = self._looked_up(now[inner, at[inner] - 1], made[inner])[0]
        sizes = (done >= 0).sum(axis=1).tolist()
        return [row[:n] for row, n in zip(done.tolist(), sizes)]

    def clashes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For adjacent tokens: would some merge have joined a right end of ``x`` with a left end of ``y``?

        The ends that exist at one time form a staircase: from the finished tokens back, the younger end is undone first.
        A merge joins two ends if its rank comes before either is taken into its own token; of equals, the left goes first.
        """
        hit = np.zeros(len(x), bool)
        live = np.arange(len(x))
        x, y = x.astype(np.int64), y.astype(np.int64)
        taken_x, taken_y = np.full(len(x), ABSENT), np.full(len(x), ABSENT)
        while len(live):
            rank = self._looked_up(x, y)[0]
            crossing = (rank < taken_x) & (rank <= taken_y) & (rank < ABSENT)
            hit[live[crossing]] = True
            back_x = self.birth[x] > self.birth[y]
            # Of ends made by one merge, the left one was made first, so the right one is undone first.
            born = np.where(back_x, self.birth[x], self.birth[y])
            go = ~crossing & (born >= 0)
            live, x, y, taken_x, taken_y, back_x, born = (v[go] for v in (live, x, y, taken_x, taken_y, back_x, born))
            taken_x, taken_y = np.where(back_x, born, taken_x), np.where(back_x, taken_y, born)
            x, y = np.where(back_x, self.right[x], x), np.where(back_x, y, self.left[y])
        return hit

    def words(self, words: list[str]) -> list[list[int]]:
        """Token ids of distinct words."""
        found = [self._greedy(w) for w in words]
        sizes = np.array([len(f) if f else 0 for f in found], np.int64)
        flat = np.fromiter((k for f in found if f for k in f), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        wrong = sizes == 0
        wrong[owner[inside][self.clashes(flat[inside], flat[inside + 1])]] = True
        failed = [(k, self._signs(words[k])) for k in np.flatnonzero(wrong).tolist()]
        short = sorted(((k, ids) for k, ids in failed if 0 < len(ids) <= SHORT), key=lambda f: len(f[1]))
        for a in range(0, len(short), TOGETHER):
            part = short[a:a + TOGETHER]
            for (k, _), ids in zip(part, self._merged_together([ids for _, ids in part])):
                found[k] = ids
        for k, ids in failed:
            if not 0 < len(ids) <= SHORT:
                found[k] = self._merged(ids)
        return found

    # ------------------------------------------------------------ texts

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        pieces = {c: self._pieces(c) for c in chunks}
        distinct = list({w for words in pieces.values() for w in words if w})
        ids = {w: _packed(k) for w, k in zip(distinct, self.words(distinct))}
        ids[""] = b""
        return {c: ids[words[0]] if len(words) == 1 else b"".join([ids[w] for w in words]) for c, words in pieces.items()}

    def _chunks(self, text: str) -> list[str]:
        if self.pattern is None:
            return [text]
        for blank in "\t\n\r\x0b\x0c":
            text = text.replace(blank, " ")
        return text.split(" ")

    def encode(self, whole: list[str | None]) -> list[bytes]:
        """Ids of texts, packed as little-endian 32-bit integers."""
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        parts = [self.cut.split(t) if self.cut and "<" in t else [t] for t in (t or "" for t in whole)]
        chunks = [[p if k % 2 else self._chunks(p) for k, p in enumerate(each)] for each in parts]
        wanted = {c for each in chunks for p in each[::2] for c in p}
        new = self._learn(wanted.difference(self.known))
        kept = {c: ids for c, ids in new.items() if len(c) <= LONGEST_KEPT}
        self.known.update(kept)
        self.held += sum(len(c) + len(ids) for c, ids in kept.items()) + ENTRY_BYTES * len(kept)
        get = {c: ids for c, ids in new.items() if len(c) > LONGEST_KEPT}
        look = self.known.__getitem__ if not get else lambda c: get[c] if c in get else self.known[c]
        return [b"".join(_packed([self.special[p]]) if k % 2 else b"".join(map(look, p)) for k, p in enumerate(each))
                for each in chunks]

    def decode(self, ids: list[int]) -> str:
        """Text of ids, special tokens included."""
        tokens = map(self.token.__getitem__, ids)
        return self.library.decoder.decode(list(tokens)) if self.library.decoder else " ".join(tokens)


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder != "little":
        packed.byteswap()
    return packed.tobytes()


def model_of(path: str) -> MergeModel:
    """The model of a file, once per worker."""
    if path not in _models:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _models[path] = MergeModel(path)
    return _models[path]


def encode(docs: DataFrame, tokenizer: str, *, text: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the token ids of ``text`` in ``into`` and their number in ``n_tokens``.

    ``tokenizer`` is the path of a tokenizer file on every machine.  Whole texts are encoded, without special tokens added;
    those written in a text count as such.  A null or empty text has no ids; repeated rows are encoded alike.  With
    ``decoded``, that column holds what the ids decode to, in the same pass.  Columns named as the results are replaced.
    Texts are split in slices of ``TEXT_BYTES``, longer only for a single longer text.
    """
    ship_package(docs.sparkSession)
    added = [(into, T.ArrayType(T.IntegerType())), ("n_tokens", T.LongType())] + ([(decoded, T.StringType())] if decoded else [])
    source = docs.drop(*{name for name, _ in added} - {text})
    fields = [f for f in source.schema.fields if f.name not in dict(added)]
    schema = T.StructType([*fields, *[T.StructField(*a) for a in added]])
    kept = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(tokenizer)
        for batch in slices(batches, text, TEXT_BYTES):
            packed = model.encode(texts(batch, text))
            ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])])
            flat = np.frombuffer(b"".join(packed), "<i4")
            columns = [batch.column(c) for c in kept]
            columns += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), pa.array(np.diff(ends), pa.int64())]
            if decoded:
                all_ids = flat.tolist()
                columns.append(pa.array([model.decode(all_ids[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str, *, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of ``ids`` in ``into``, special tokens included; null ids decode to null, none to an empty text."""
    ship_package(encoded.sparkSession)
    source = encoded.drop(into)
    schema = T.StructType([*source.schema.fields, T.StructField(into, T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(tokenizer)
        for whole in batches:
            for a in range(0, whole.num_rows, 200):
                batch = whole.slice(a, 200)
                found = [None if k is None else model.decode(k) for k in batch.column(ids).to_pylist()]
                yield batch.append_column(into, pa.array(found, pa.string()))

    return source.mapInArrow(run, schema)


def digest(encoded: DataFrame, *, id: str = "doc_id", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Per row: id, number of ids, SHA-256 of the ids (little-endian unsigned 32-bit) and of the decoded text in UTF-8."""
    schema = T.StructType([encoded.schema[id], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, words = batch.column(1), batch.column(2).cast(pa.binary())
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
            sums = [hashlib.sha256(flat[a:b]).hexdigest() for a, b in zip(ends.tolist(), ends[1:].tolist())]
            said = [hashlib.sha256(memoryview(w.as_buffer()) if w.is_valid else b"").hexdigest() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(sums), pa.array(said)], names=schema.names)

    return encoded.select(id, ids, decoded).mapInArrow(run, schema)
