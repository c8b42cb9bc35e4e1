"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Blanks become the marker U+2581, put before the text as well.  Characters in no piece, and markers that stand in the text
itself, fall back to byte pieces, so decoding restores every text exactly.  Pieces carry a marker at their start only, and
none holds a line end; a best path therefore never crosses either, and the pieces of a word between them are remembered.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gradelattice.llm.batches import release, slices, texts
from gradelattice.session import ship_package

MARK = "▁"
BARRED = -1e8  # pieces scored at or below are never chosen, but for single characters
UNKNOWN_PENALTY = 10.0  # a character in bytes scores this much below the worst piece
CACHE_BYTES = 40 << 20  # what a task remembers of words, by the sizes below; beyond, it starts anew
ENTRY_BYTES = 180  # of an entry besides its text and ids
LONGEST_KEPT = 64  # longer words are not remembered, nor searched together with others
TOGETHER = 4096
TEXT_BYTES = 2 << 20
BPE, NORMAL, BYTE = 2, 1, 6  # fixed values of the model file


class DoubleArray:
    """Trie over bytes in two arrays: the child of state s at byte c is ``base[s] + c + 1`` if its ``check`` is s."""

    def __init__(self, entries: dict[bytes, int]):
        keys = sorted(entries)
        size = 4 * sum(map(len, keys)) // 3 + 1024
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        self.free = 1
        todo = [(0, 0, len(keys), 0)]
        while todo:
            state, a, b, depth = todo.pop()
            if a < b and len(keys[a]) == depth:
                self.value[state] = entries[keys[a]]
                a += 1
            if a == b:
                continue
            groups, k = [], a
            while k < b:
                c, first = keys[k][depth], k
                while k < b and keys[k][depth] == c:
                    k += 1
                groups.append((c, first, k))
            base = self._place([g[0] for g in groups])
            self.base[state] = base
            for c, first, last in groups:
                child = base + c + 1
                self.check[child] = state
                todo.append((child, first, last, depth + 1))
        last = max(k for k, c in enumerate(self.check) if c >= 0) + 258
        self.base, self.check, self.value = (x[:last] + [-1 if n else 0] * max(0, last - len(x)) for n, x in enumerate((self.base, self.check, self.value)))

    def _place(self, codes: list[int]) -> int:
        check = self.check
        while check[self.free] >= 0:
            self.free += 1
        at, least, taken = self.free, codes[0] + 1, 0
        while True:
            base = at - least
            if base >= 0:
                top = base + codes[-1] + 1
                if top + 258 >= len(check):
                    grow = len(check) // 2 + 1024
                    self.base += [0] * grow
                    check += [-1] * grow
                    self.value += [-1] * grow
                if all(check[base + c + 1] < 0 for c in codes):
                    if taken > 0.9 * (at - self.free + 1):
                        self.free = at  # nearly full up to here: later searches start behind
                    return base
            at += 1
            while check[at] >= 0:
                at, taken = at + 1, taken + 1


class Pieces:
    """Pieces of a model file with log scores.

    The scores of a unigram model are used as they are.  A byte-pair model only ranks its pieces; their log-probabilities
    follow from the rank by Zipf's law.
    """

    def __init__(self, pieces: list[tuple[str, float, int]], ranks: bool = False):
        normal = {p: (k, s) for k, (p, s, kind) in enumerate(pieces) if kind == NORMAL and s > BARRED}
        single = {p: k for k, (p, s, kind) in enumerate(pieces) if kind == NORMAL and s <= BARRED and len(p) == 1}
        if ranks:
            order = sorted(normal, key=lambda p: (-normal[p][1], normal[p][0]))
            scale = log(sum(1 / r for r in range(1, len(order) + 1)) or 1)
            normal = {p: (normal[p][0], -log(r) - scale) for r, p in enumerate(order, 1)}
        worst = min((s for _, s in normal.values()), default=0.0)
        normal |= {p: (k, worst) for p, k in single.items()}  # barred characters still stand before bytes
        if any(MARK in p[1:] or "\n" in p or not p for p in normal):
            raise ValueError("pieces with a marker or a line end inside are not supported")
        self.score = [0.0] * len(pieces)
        for k, s in normal.values():
            self.score[k] = s
        self.unknown = worst - UNKNOWN_PENALTY
        self.trie = DoubleArray({p.encode(): k for p, (k, _) in normal.items()})
        self.bytes = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces to fall back to")
        self.plain = [p.replace(MARK, " ").encode() for p, _, _ in pieces]
        for value, k in self.bytes.items():
            self.plain[k] = bytes([value])
        self.is_byte = np.zeros(len(pieces), bool)
        self.is_byte[list(self.bytes.values())] = True
        self.mark_bytes = self._packed([self.bytes[b] for b in MARK.encode()])
        self.tables = tuple(np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value))
        self.scores = np.array(self.score)
        self.byte_ids = np.array([self.bytes[b] for b in range(256)], np.uint32)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {"": b""}
        self.held = 0

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        return cls([(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type == BPE)

    def __getstate__(self):
        return self.__dict__ | {"known": {"": b""}, "held": 0}

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def best(self, word: str) -> list[int]:
        """Ids of the best path over one word; among equals, the one whose last piece is longest."""
        data, base, check, value, score = word.encode(), self.trie.base, self.trie.check, self.trie.value, self.score
        size = len(data)
        top, back, piece = [-1e300] * (size + 1), [0] * (size + 1), [-1] * (size + 1)
        top[0] = 0.0
        for a in range(size):
            here = top[a]
            if here <= -1e300:
                continue
            lead = data[a]
            if lead & 0xC0 == 0x80:
                continue  # inside a character
            state = 0
            for k in range(a, size):
                child = base[state] + data[k] + 1
                if check[child] != state:
                    break
                state = child
                found = value[state]
                if found >= 0:
                    total = here + score[found]
                    if total > top[k + 1]:
                        top[k + 1], back[k + 1], piece[k + 1] = total, a, found
            end = a + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            if here + self.unknown > top[end]:
                top[end], back[end], piece[end] = here + self.unknown, a, -1
        out, at = [], size
        while at:
            a = back[at]
            out.append([piece[at]] if piece[at] >= 0 else [self.bytes[b] for b in data[a:at]])
            at = a
        return [k for ids in reversed(out) for k in ids]

    def best_of_many(self, words: list[bytes]) -> list[bytes]:
        """``best`` of words of similar length, packed: all of them take each step of the search at once."""
        base, check, value = self.tables
        size = np.array([len(w) for w in words])
        width, count = int(size.max()), len(words)
        data = np.zeros((count, width), np.int32)
        data[np.arange(width)[None, :] < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        top = np.full((count, width + 4), -1e300)
        back, piece = np.zeros((count, width + 4), np.int32), np.full((count, width + 4), -1, np.int32)
        top[:, 0] = 0.0
        for a in range(width):
            rows = np.flatnonzero((top[:, a] > -1e300) & (a < size) & (data[:, a] & 0xC0 != 0x80))
            at, state = rows, np.zeros(len(rows), np.int32)
            for k in range(a, width):
                child = base[state] + data[at, k] + 1
                on = (check[child] == state) & (k < size[at])
                at, state = at[on], child[on]
                if not len(at):
                    break
                found = value[state]
                ends = np.flatnonzero(found >= 0)
                total = top[at[ends], a] + self.scores[found[ends]]
                ends, total = (x[total > top[at[ends], k + 1]] for x in (ends, total))
                top[at[ends], k + 1], back[at[ends], k + 1], piece[at[ends], k + 1] = total, a, found[ends]
            lead = data[rows, a]
            end = a + 1 + (lead >= 0x80).astype(int) + (lead >= 0xE0) + (lead >= 0xF0)
            total = top[rows, a] + self.unknown
            better = total > top[rows, end]
            rows, end = rows[better], end[better]
            top[rows, end], back[rows, end], piece[rows, end] = total[better], a, -1
        row, at, steps = np.arange(count), size, []
        while len(row):
            before = back[row, at]
            steps.append(np.stack([row, before, at, piece[row, at]]))
            row, at = row[before > 0], before[before > 0]
        row, start, end, found = (x := np.concatenate(steps, axis=1))[:, np.lexsort((x[2], x[0]))]
        n = np.where(found >= 0, 1, end - start)
        first = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(first, n)
        spread = np.repeat(np.arange(len(n)), n)
        ids = np.where(found[spread] >= 0, found[spread], self.byte_ids[data[row[spread], np.minimum(start[spread] + inner, width - 1)]]).astype("<u4").tobytes()
        bounds = np.searchsorted(row[spread], np.arange(count + 1)) * 4
        return [ids[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Remember words; returns the ids of those too long for that."""
        coded = sorted(((w.encode(), w) for w in words.difference(self.known)), key=lambda c: len(c[0]))
        if self.held > CACHE_BYTES:
            self.forget()
            coded = sorted(((w.encode(), w) for w in words if w), key=lambda c: len(c[0]))
        short = [c for c in coded if len(c[0]) <= LONGEST_KEPT]
        for a in range(0, len(short), TOGETHER):
            part = short[a:a + TOGETHER]
            ids = self.best_of_many([c for c, _ in part])
            self.known.update(zip((w for _, w in part), ids))
            self.held += sum(len(c) for c, _ in part) + sum(map(len, ids)) + ENTRY_BYTES * len(part)
        return {w: self._packed(self.best(w)) for _, w in coded[len(short):]}

    @staticmethod
    def _split(text: str) -> list[list[str]]:
        """The words of a text, in parts between the markers that stand in it."""
        parts = []
        for k, part in enumerate(text.split(MARK)):
            spaced = part.replace(" ", " " + MARK).replace("\n", " \n ")
            parts.append((spaced if k else MARK + spaced).split(" "))
        return parts

    def encode_all(self, whole: list[str | None]) -> list[np.ndarray]:
        """Piece ids of texts; the words that are new are searched together."""
        split = [self._split(t) if t else [] for t in whole]
        long = self.learn({w for parts in split for words in parts for w in words})
        look = self.known.__getitem__ if not long else lambda w: long[w] if w in long else self.known[w]
        return [np.frombuffer(self.mark_bytes.join([b"".join(map(look, words)) for words in parts]), np.uint32) for parts in split]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.plain.__getitem__, ids))
        return (data[1:] if data.startswith(b" ") else data).decode("utf-8", "replace")


def encode(docs: DataFrame, pieces: Pieces, *, text: str = "text", into: str = "ids", check_into: str | None = None) -> DataFrame:
    """``docs`` with the piece ids of ``text`` in ``into`` and, in ``n_pieces`` and ``n_bytes``, how many ids and byte pieces.

    Whole texts are encoded, however long, and repeated rows alike.  A null text has null ids and counts of 0, an empty one no ids.  With ``check_into``, ids are
    decoded where they are made, and that column tells whether they give the text back (null ids give a null text).
    Columns named as the results are replaced.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # as large as the vocabulary
    added = [(into, T.ArrayType(T.IntegerType())), ("n_pieces", T.LongType()), ("n_bytes", T.LongType())]
    added += [(check_into, T.BooleanType())] if check_into else []
    docs = docs.drop(*{name for name, _ in added} - {text})
    schema = T.StructType([*docs.schema.fields, *[T.StructField(*a) for a in added]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text, TEXT_BYTES):
            whole = texts(batch, text)
            found = model.encode_all(whole)
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])])
            flat = np.concatenate(found)
            fallback = np.concatenate([[0], np.cumsum(model.is_byte[flat])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int32)), mask=pa.array([t is None for t in whole], pa.bool_()))
            out = (batch.append_column(into, lists).append_column("n_pieces", pa.array(np.diff(ends), pa.int64()))
                   .append_column("n_bytes", pa.array(fallback[ends[1:]] - fallback[ends[:-1]], pa.int64())))
            if check_into:
                same = [t is None or model.decode(f.tolist()) == t for t, f in zip(whole, found)]
                out = out.append_column(check_into, pa.array(same, pa.bool_()))
            yield out
        model.forget()
        release()

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, pieces: Pieces, *, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of ``ids`` in ``into``; null ids decode to null.  Bytes that are no UTF-8 become U+FFFD."""
    ship_package(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)  # as large as the vocabulary
    encoded = encoded.drop(into)
    schema = T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 200):
                batch = whole.slice(a, 200)
                column = batch.column(ids)
                ends = column.offsets.to_numpy()
                flat, ends = column.values.slice(ends[0], ends[-1] - ends[0]).to_numpy().tolist(), (ends - ends[0]).tolist()
                found = [model.decode(flat[x:y]) if ok else None for x, y, ok in zip(ends, ends[1:], column.is_valid().to_pylist())]
                yield batch.append_column(into, pa.array(found, pa.string()))

    return encoded.mapInArrow(run, schema)
