"""Language identification by interpolated Kneser-Ney character models.

Spark counts the n-grams of a bounded sample of labelled texts; the models of all languages share sorted arrays of n-gram
hashes, each with one column of interpolated log-probabilities per language, so that one look-up serves all of them.  A
text goes to the language of the lowest cross-entropy per character.  It is rejected if that lies further above what held
back labelled texts of the language show than their spread, widened for short texts, explains.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradelattice.llm.batches import release, slices, texts
from gradelattice.session import ship_package, stage

ORDER = 5
SAMPLE_DOCS = 1_500  # expected number of labelled texts of a language that its model learns from, at most
HELD_BACK = 4  # one sampled text in so many calibrates the rejection instead of the model
LEAST_COUNT = 2  # n-grams of the full order seen less often than this in all languages are left to the lower orders
REJECT_SD = 6.0  # spreads above the usual cross-entropy at which a text is rejected
SPREAD_FLOOR = 0.15  # bits; least spread of whole texts
CHARACTER_VARIANCE = 9.0  # bits squared; variance of one character's log-probability
STEP = 1 << 18  # characters scored at once

UNDETERMINED = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text; everything between letters is one space, at the ends none; empty without letters."""
    if not text:
        return np.empty(0, np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = _LETTER[codes]
    at = np.flatnonzero(is_letter)
    if not len(at):
        return np.empty(0, np.uint32)
    codes, is_letter = codes[at[0]:at[-1] + 1], is_letter[at[0]:at[-1] + 1]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first sign after a letter stands for the gap
    return np.where(is_letter, codes, np.uint32(32))[keep]


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1..order, the hash of the k characters that end at each place (earlier places count as absent)."""
    out, last = [], np.zeros(len(codes), np.uint64)
    wide = codes.astype(np.uint64) + np.uint64(1)
    for k in range(order):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[k > 0:] = last[:-1] if k and len(last) else last
        last = shifted * _BASE + wide if k else wide
        mixed = (last ^ (last >> np.uint64(29))) * _MIX
        out.append(mixed ^ (mixed >> np.uint64(32)))
    return out


@dataclass
class SortedHashes:
    """A sorted array of hashes with a row of values each; an index over the leading bits finds the place to look."""

    keys: np.ndarray
    values: np.ndarray
    shift: np.uint64 = field(init=False)
    first: np.ndarray = field(init=False)

    def __post_init__(self):
        order = np.argsort(self.keys)
        self.keys, self.values = np.append(self.keys[order], np.uint64(2**64 - 1)), self.values[order].astype(np.float32)
        bits = max(4, int(len(order)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row of each hash, or -1."""
        at = self.first[(wanted >> self.shift).astype(np.int64)]
        there = self.keys[at]
        behind = np.flatnonzero(there < wanted)
        while len(behind):
            at[behind] += 1
            there[behind] = self.keys[at[behind]]
            behind = behind[there[behind] < wanted[behind]]
        return np.where((there == wanted) & (at < len(self.keys) - 1), at, -1)


class KneserNey:
    """Interpolated models of several languages over the n-grams of all of them."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, languages: list[str], least: int = LEAST_COUNT):
        """``grams``: code points, one row of ORDER each; ``counts``: occurrences, one column per language."""
        self.languages, self.order = languages, grams.shape[1]
        alphabet = len(np.unique(grams[:, -1])) + 1
        self.probability, self.backoff = [], []
        tables = [(grams, counts.astype(np.float64))]
        for _ in range(self.order - 1):  # lower orders count the different characters that precede an n-gram
            longer, seen = tables[0]
            suffix, row = np.unique(longer[:, 1:], axis=0, return_inverse=True)
            preceding = np.zeros((len(suffix), counts.shape[1]))
            np.add.at(preceding, row.reshape(-1), seen > 0)
            tables.insert(0, (suffix, preceding))
        for k, (rows, seen) in enumerate(tables, 1):
            once, twice = (seen == 1).sum(axis=0), (seen == 2).sum(axis=0)
            discount = np.where(once > 0, once / np.maximum(once + 2.0 * twice, 1), 0.5).clip(0.1, 0.95)
            context, row = np.unique(rows[:, :-1], axis=0, return_inverse=True) if k > 1 else (rows[:1, :0], np.zeros(len(rows), int))
            row = row.reshape(-1)
            total, kinds = np.zeros((len(context), seen.shape[1])), np.zeros((len(context), seen.shape[1]))
            np.add.at(total, row, seen)
            np.add.at(kinds, row, seen > 0)
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            if k == 1:
                lower = np.full(seen.shape, 1.0 / alphabet)
                self.unseen = np.log2(weight[0] / alphabet).astype(np.float32)
            else:
                table = self.probability[-1]
                lower = np.exp2(table.values[table.find(self._hash(rows[:, 1:]))].astype(np.float64))
                self.backoff.append(SortedHashes(self._hash(context), np.log2(weight)))
            p = np.maximum(seen - discount, 0) / np.maximum(total, 1)[row] + weight[row] * lower
            keep = seen.sum(axis=1) >= least if k == self.order else slice(None)
            self.probability.append(SortedHashes(self._hash(rows[keep]), np.log2(p[keep])))

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        value = np.zeros(len(rows), np.uint64)
        for k in range(rows.shape[1]):
            value = value * _BASE + (rows[:, k].astype(np.uint64) + np.uint64(1)) if k else rows[:, 0].astype(np.uint64) + np.uint64(1)
        mixed = (value ^ (value >> np.uint64(29))) * _MIX
        return mixed ^ (mixed >> np.uint64(32))

    def log_probabilities(self, codes: np.ndarray, start: int) -> np.ndarray:
        """Per place from ``start`` on and per language, log2 of the probability of the character after those before it."""
        hashes = [h[start:] for h in _hashes(codes, self.order)]
        before = [h[start - 1:-1] for h in _hashes(codes, self.order - 1)] if start else None
        out = np.zeros((len(codes) - start, len(self.languages)), np.float32)
        open_ = np.arange(len(out))
        for k in range(self.order, 0, -1):
            table = self.probability[k - 1]
            row = table.find(hashes[k - 1][open_])
            found = row >= 0
            out[open_[found]] += table.values[row[found]]
            open_ = open_[~found]
            if not len(open_):
                break
            if k == 1:
                out[open_] += self.unseen
            else:
                row = self.backoff[k - 2].find(before[k - 2][open_])
                out[open_[row >= 0]] += self.backoff[k - 2].values[row[row >= 0]]
        return out

    def entropies(self, documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of each text, and bits per character in each language."""
        pad = self.order  # spaces before each text; the first has no context of its own
        sizes = np.array([len(d) for d in documents])
        gap = np.full(pad, 32, np.uint32)
        codes = np.concatenate([x for d in documents for x in (gap, d)]) if documents else gap[:0]
        owner = np.repeat(np.arange(len(documents)), sizes + pad)
        scored = np.ones(len(codes), bool)
        starts = np.cumsum(sizes + pad) - sizes - pad
        for k in range(pad):
            scored[starts + k] = False
        total = np.zeros((len(documents), len(self.languages)))
        for a in range(0, len(codes), STEP):
            b, lead = min(len(codes), a + STEP), min(a, pad)
            lead = lead if lead else 1
            part = codes[a - lead:b] if a else np.concatenate([[np.uint32(32)], codes[:b]])
            found = self.log_probabilities(part, lead)
            at = np.flatnonzero(scored[a:b])
            for j in range(found.shape[1]):
                total[:, j] += np.bincount(owner[a:b][at], found[at, j], len(documents))
        return sizes, -total / np.maximum(sizes, 1)[:, None]


@dataclass
class Identifier:
    """Models, and per language the usual bits per character of its texts and their spread."""

    model: KneserNey
    usual: np.ndarray
    spread: np.ndarray

    def predict(self, documents: list[str | None]) -> tuple[list[str], list[float], list[bool], list[float]]:
        """Language, score, whether it is accepted, and bits per character."""
        sizes, bits = self.model.entropies([letters(t) for t in documents])
        best = bits.argmin(axis=1)
        rows = np.arange(len(bits))
        lowest = bits[rows, best]
        spread = np.sqrt(self.spread[best] ** 2 + CHARACTER_VARIANCE / np.maximum(sizes, 1))
        excess = (lowest - self.usual[best]) / spread
        # Odds against the other languages over a stretch of 20 characters, and against being none of them.
        among = 1 / np.exp2(-20 * (bits - lowest[:, None])).sum(axis=1)
        score = np.where(sizes > 0, among / (1 + np.exp(excess - REJECT_SD)), 0.0)
        names = np.array([*self.model.languages, UNDETERMINED])[np.where(sizes > 0, best, len(self.model.languages))]
        return names.tolist(), score.round(6).tolist(), ((sizes > 0) & (excess <= REJECT_SD)).tolist(), lowest.tolist()


def fit(docs: DataFrame, learn: Column | None = None, *, text: str = "text", lang: str = "lang", id: str = "doc_id",
        order: int = ORDER, sample_docs: int = SAMPLE_DOCS) -> Identifier:
    """Learn from rows with text and language (and ``learn``), at most about ``sample_docs`` of each language.

    The sample is drawn by a hash of the id, so it does not depend on partitioning.  Raises ValueError if no row has both.
    """
    ship_package(docs.sparkSession)
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (learn if learn is not None else F.lit(True)))
    draw = F.pmod(F.xxhash64(F.col(id).cast("string"), F.lit(17)), F.lit(1 << 40))
    share = {r[0]: min(1.0, sample_docs / r[1]) for r in usable.groupBy(lang).count().collect()}
    if not share:
        raise ValueError("no labelled text to learn languages from")
    limits = F.create_map(*[F.lit(x) for name, s in share.items() for x in (name, int(s * (1 << 40)))])
    sample = stage(usable.select(F.col(lang).alias("lang"), F.col(text).alias("text"), draw.alias("draw"))
                   .where(F.col("draw") < limits[F.col("lang")])
                   .select("lang", "text", (F.pmod("draw", F.lit(HELD_BACK)) == 0).alias("held")), "language-sample").repartition(16)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            for name in set(texts(batch, "lang")):
                of = [letters(t) for t, n in zip(texts(batch, "text"), texts(batch, "lang")) if n == name]
                codes = np.concatenate([x for d in of for x in (np.full(order - 1, 32, np.uint32), d)])
                rows = np.lib.stride_tricks.sliding_window_view(codes, order) if len(codes) >= order else np.empty((0, order), np.uint32)
                rows = rows[rows[:, -1] != 32] if not len(rows) else rows
                _, first, n = np.unique(KneserNey._hash(rows), return_index=True, return_counts=True)
                grams = [rows[k].tobytes().decode("utf-32-le", "replace") for k in first.tolist()]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(grams), pa.string()), "gram": pa.array(grams, pa.string()), "n": pa.array(n, pa.int64())})

    def tabulate(part: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = part.mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
        grams, row = np.unique(np.array(got["gram"].to_pylist(), dtype=f"<U{order}"), return_inverse=True)
        counts = np.zeros((len(grams), len(names)))
        counts[row.reshape(-1), [names.index(x) for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
        return np.frombuffer(grams.tobytes(), np.uint32).reshape(len(grams), order), counts

    names = sorted(share)
    # Without a held-back part (a handful of texts), calibrate on what was learned from.
    held = {r[0] for r in sample.where("held").select("lang").distinct().collect()}
    learned = sample.where(~F.col("held") | ~F.col("lang").isin(sorted(held)))
    grams, counts = tabulate(learned)
    if not len(grams):
        grams, counts = tabulate(sample)
    if not len(grams):  # labelled texts without a letter: all languages are alike
        grams, counts = np.full((1, order), 32, np.uint32), np.ones((1, len(names)))
    model = KneserNey(grams, counts, names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sizes, bits = shared.value.entropies([letters(t) for t in texts(batch, "text")])
            own = bits[np.arange(len(bits)), [names.index(x) for x in texts(batch, "lang")]]
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "size": pa.array(sizes), "bits": pa.array(own)})

    seen = sample.where(F.col("held") | ~F.col("lang").isin(sorted(held))).mapInArrow(measure, "lang string, size bigint, bits double").toPandas()
    seen = seen[seen["size"] > 0]
    usual, spread = np.full(len(names), np.nan), np.full(len(names), SPREAD_FLOOR)
    for k, name in enumerate(names):
        own = seen[seen["lang"] == name]
        if len(own):
            usual[k] = np.average(own["bits"], weights=own["size"])
            long = own[own["size"] >= 200]["bits"]
            spread[k] = max(SPREAD_FLOOR, float(np.sqrt(np.mean((long - usual[k]) ** 2))) if len(long) else 0.0)
    usual = np.where(np.isnan(usual), np.nanmean(usual) if len(seen) else np.log2(32), usual)
    del grams, counts, seen
    release()  # the driver lives on, too
    return Identifier(model, usual, spread)


def identify(docs: DataFrame, identifier: Identifier, *, text: str = "text", prefix: str = "lang_") -> DataFrame:
    """``docs`` with columns ``<prefix>pred, <prefix>score, <prefix>accepted, <prefix>bits`` (replacing columns of those names).

    Whole texts count.  A null text or one without a letter is ``und`` with score 0 and not accepted.  Ties go to the
    language first in alphabetical order.  Repeated rows are told alike.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(identifier)  # bounded by the sample it was fitted on
    names = [prefix + x for x in ("pred", "score", "accepted", "bits")]
    docs = docs.drop(*names)
    kinds = [pa.string(), pa.float64(), pa.bool_(), pa.float64()]

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 20):
            found = shared.value.predict(texts(batch, text))
            for name, kind, values in zip(names, kinds, found):
                batch = batch.append_column(name, pa.array(values, kind))
            yield batch

    schema = T.StructType(list(docs.schema.fields))
    for name, kind in zip(names, ("string", "double", "boolean", "double")):
        schema = schema.add(name, kind)
    return docs.mapInArrow(predict, schema)
