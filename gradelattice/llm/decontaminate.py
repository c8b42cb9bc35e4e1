"""Benchmark decontamination: a generalised suffix automaton of the test items, past which documents stream.

Items become blocks of bounded size in the shared folder; a task builds the automaton of one block at a time, so neither
the driver nor a broadcast ever holds the items.  In a task, documents are first reduced to runs of item-word pairs (no
window can lie outside such a run), and only those runs walk the automaton, which keeps the longest match that ends at
each word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelattice.llm.batches import locate, raw, slices
from gradelattice.session import ship_package, stage_path

WINDOW = 10  # consecutive item words that count as a copy
BLOCK_WORDS = 200_000  # item words in one automaton
TEXT_BYTES = 4 << 20
MAX_COVERAGE = 0.8  # documents with more of their words inside copies are dropped as a whole

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased, runs of digits, letters and anything beyond ASCII."""
    return text.translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """All word sequences of the items, with the windows and whole short items that end in each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.next, self.link, self.length = [{}], [-1], [0]
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.shortest = min((min(window, len(w)) for _, w in coded), default=window)
        self.ends: dict[int, dict[int, set[str]]] = {}
        for name, words in coded:
            size, state = min(window, len(words)), 0
            for k, w in enumerate(words):
                state = self.next[state][w]
                if k + 1 >= size:
                    self.ends.setdefault(self._at(state, size), {}).setdefault(size, set()).add(name)
        pairs = {a * len(self.vocabulary) + b for _, words in coded for a, b in zip(words, words[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.all_ends: dict[int, list[tuple[int, frozenset]]] = {}

    def _new(self, length: int, link: int, follow: dict) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = self._split(p, w) if p >= 0 else 0
        return new

    def _split(self, p: int, w: int) -> int:
        """The state of exactly the string of ``p`` followed by ``w``, cloned out of a longer one if need be."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _at(self, state: int, size: int) -> int:
        """The state, on the suffix path of ``state``, that holds the suffix of ``size`` words."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _ends(self, state: int) -> list[tuple[int, frozenset]]:
        if state not in self.all_ends:
            found, at = [], state
            while at > 0:
                found += [(size, frozenset(names)) for size, names in self.ends.get(at, {}).items()]
                at = self.link[at]
            self.all_ends[state] = found
        return self.all_ends[state]

    def runs(self, coded: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches ``[a, b)`` of item words long enough for a window whose neighbours all occur as pairs in items."""
        if self.shortest == 1:
            good = coded >= 0
        else:
            key = coded[:-1].astype(np.int64) * len(self.vocabulary) + coded[1:]
            near = np.flatnonzero((coded[:-1] >= 0) & (coded[1:] >= 0))
            at = np.searchsorted(self.pairs, key[near]).clip(max=max(0, len(self.pairs) - 1))
            good = np.zeros(len(key), bool)
            if len(self.pairs):
                good[near] = self.pairs[at] == key[near]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], good.view(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= max(1, self.shortest - 1):
                yield a, b + (self.shortest > 1)

    def scan(self, words: list[int]) -> Iterator[tuple[int, int, frozenset]]:
        """``(end, size, items)`` of every window that occurs; the walk holds the longest match at each word."""
        state = matched = 0
        for k, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state, matched = self.next[state][w], matched + 1
                for size, names in self._ends(state):
                    if size <= matched:
                        yield k + 1, size, names


@lru_cache(maxsize=1)
def _automaton(folder: str, block: int, window: int) -> SuffixAutomaton:
    filesystem, path = locate(folder)
    table = ds.dataset(f"{path}/block={block}", filesystem=filesystem, format="parquet").to_table(["name", "words"])
    return SuffixAutomaton([(n, w.split(b" ")) for n, w in zip(table["name"].to_pylist(), table["words"].to_pylist())], window)


def _blocks(items: DataFrame, id: str, text: str) -> tuple[str, list[int]]:
    """Write the items' words in blocks of about ``BLOCK_WORDS``; returns the folder and the blocks there."""
    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = [b" ".join(words_of(t)) for t in raw(batch, "text")]
            yield pa.RecordBatch.from_pydict({"name": batch.column("name"), "words": pa.array(words, pa.binary())})

    named = items.select(F.coalesce(F.col(id).cast("string"), F.lit("null")).alias("name"), F.col(text).cast("string").alias("text"))
    folded = named.mapInArrow(fold, "name string, words binary").where(F.length("words") > 0)
    total = folded.agg(F.sum(F.size(F.split(F.decode("words", "UTF-8"), " ")))).first()[0] or 0
    count, folder = -(-total // BLOCK_WORDS), stage_path(items.sparkSession, "items")
    if not count:
        return folder, []
    block = F.pmod(F.xxhash64("name", "words"), F.lit(count)).cast("int")
    folded.withColumn("block", block).repartition("block").write.partitionBy("block").parquet(folder)
    return folder, [r.block for r in items.sparkSession.read.parquet(folder).select("block").distinct().collect()]


def _hits(texts: list[bytes | None], folder: str, blocks: list[int], window: int) -> Iterator[tuple[int, np.ndarray | None, set]]:
    """Per text: number of words, marks of the words inside a window (None if none is), names of the items found."""
    split = [words_of(t) for t in texts]
    ends = np.cumsum([len(w) + 1 for w in split]) if split else np.zeros(0, int)  # a stop between texts
    marks, names = {}, [set() for _ in split]
    for block in blocks:
        automaton = _automaton(folder, block, window)
        coded = np.full(int(ends[-1]) if len(ends) else 0, -1, np.int32)
        for end, words in zip(ends.tolist(), split):
            coded[end - 1 - len(words):end - 1] = np.fromiter(map(automaton.vocabulary.get, words, repeat(-1)), np.int32, len(words))
        for a, b in automaton.runs(coded):
            k = int(np.searchsorted(ends, a, side="right"))
            first = int(ends[k]) - 1 - len(split[k])
            for end, size, found in automaton.scan(coded[a:b].tolist()):
                if k not in marks:
                    marks[k] = np.zeros(len(split[k]), bool)
                marks[k][a - first + end - size:a - first + end] = True
                names[k] |= found
    for k, words in enumerate(split):
        yield len(words), marks.get(k), names[k]


def find_copies(docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Words of each document inside an occurrence of a ``window``-word sequence of an item (a shorter item: all of it).

    Returns ``doc_id, n_words, n_hit, items`` (names of the items found, sorted as strings), one row for each row of
    ``docs``.  Null and empty texts have no words; a null document id stays null; an item without words never occurs, one
    without id goes by the name ``null``; repeated items count once per id.  Texts are read whole; other columns are
    ignored.
    """
    ship_package(docs.sparkSession)
    folder, blocks = _blocks(items, item_id, item_text)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            found = list(_hits(raw(batch, "text"), folder, blocks, window))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": pa.array([n for n, _, _ in found], pa.int64()),
                "n_hit": pa.array([0 if m is None else int(m.sum()) for _, m, _ in found], pa.int64()),
                "items": pa.array([sorted(s) for _, _, s in found], pa.list_(pa.string()))})

    read = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(scan, f"doc_id {kind}, n_words bigint, n_hit bigint, items array<string>")


def contamination_digest(found: DataFrame) -> DataFrame:
    """The counts of ``find_copies``, with a digest of the items found."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_copies(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` with copied spans cut out of ``text``; a document that is copied beyond ``max_coverage`` is left out.

    A span runs from the first to the last word of adjoining copies.  Documents without a copy keep their text byte for
    byte, null texts stay null; all columns are kept.
    """
    ship_package(docs.sparkSession)
    folder, blocks = _blocks(items, item_id, item_text)

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, TEXT_BYTES):
            whole = raw(batch, text)
            keep, out = [], []
            for t, (n, marks, _) in zip(whole, _hits(whole, folder, blocks, window)):
                keep.append(marks is None or marks.sum() <= max_coverage * n)
                out.append(t if marks is None else cut(t, marks))
            at = batch.schema.get_field_index(text)
            column = pa.array(out, pa.binary()).cast(batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), column).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def cut(text: bytes, marks: np.ndarray) -> bytes:
    """``text`` without the stretches from the first to the last of neighbouring marked words."""
    spans = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]]))).tolist()
    kept, at = [], 0
    for a, b in zip(edge[::2], edge[1::2]):
        kept.append(text[at:spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*kept, text[at:]])
