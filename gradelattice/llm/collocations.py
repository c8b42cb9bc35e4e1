"""Phrases that occur more often than their parts explain, mined by partitioning (SON).

The documents fall into a few shards by a hash of their id, and every shard is mined completely at the support divided by
the number of shards, rounded up: a phrase that reaches the support in all reaches the lowered one in some shard.  Shards
are mined level by level, pairs first; a phrase of k words is counted in a shard only where both phrases of k - 1 words in
it are already candidates.  Mining works on 64-bit hashes, which can only add candidates.  Their union, a bit set of
bounded size for each length, then goes past all documents once more, where words and phrases are told apart by their
bytes and counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradelattice.llm.batches import locate, raw, slices
from gradelattice.session import ship_package, stage, stage_observed, stage_path

SUPPORT = 30
LONGEST = 4  # words of a phrase
SHARDS = 5  # at most 8: a shard takes the last three bits of a key
TOP = 2000
CONTAINED = 80  # percent of its occurrences inside one longer candidate, from which a candidate is dropped
BLOCK_BYTES = 1 << 20  # text hashed at once, longer only for a single longer word
TEXT_BYTES = 4 << 20
HELD = 3 << 20  # phrase occurrences a task gathers before it sums them
WORDS_HELD = 500_000  # distinct words a task names before it hands its counts on; fewer than 2 ** ID_BITS with one more block
ID_BITS = 20
EMIT_ROWS = 50_000
FILTER_BITS = 29  # at most so many as a power of two (64 MB); with more candidates more false ones pass, and are counted
SEGMENT_BITS = 20
SALTS = 64
UNKNOWN = "und"

BLANK, LINE = 32, 10
_FOLD = bytearray(range(256))
_FOLD[ord("A"):ord("Z") + 1] = b"abcdefghijklmnopqrstuvwxyz"
_FOLD[9] = BLANK
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _FOLD[_c] = LINE
FOLD = bytes(_FOLD)

BASE = np.uint64(0x9E3779B97F4A7C15)
_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []
_filters: dict[str, Filter] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def _power_tables(size: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        size = max(size, BLOCK_BYTES)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)])) for b in (BASE, inverse)]
    return _powers


class Block:
    """The words of some text: hashes, positions, pieces and rows; the first ``skip`` words were counted before."""

    def __init__(self, data: bytes, row_starts: np.ndarray, at: int, skip: int, salts: np.ndarray):
        self.data, self.skip = data, skip
        buf = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(buf) + 2, bool)
        inside[1:-1] = (buf != BLANK) & (buf != LINE)
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        power, inverse = _power_tables(len(buf))
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_VALUES[buf] * power[:len(buf)], out=sums[1:])
        self.row = np.searchsorted(row_starts, self.starts + at, side="right") - 1
        self.piece = np.searchsorted(np.flatnonzero(buf == LINE), self.starts)
        self.hash = _mixed(_mixed((sums[self.ends] - sums[self.starts]) * inverse[self.starts]) ^ salts[self.row])

    def grams(self, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1 to ``size``: hashes by first word, and whether a phrase of that length starts there."""
        n, out = len(self.hash), [(self.hash, np.ones(len(self.hash), bool))]
        for k in range(2, size + 1):
            m = max(0, n - k + 1)
            h = _mixed(out[-1][0][:m] * BASE + self.hash[k - 1:])
            out.append((h, self.piece[:m] == self.piece[k - 1:]))
        return out

    def fresh(self, size: int, count: int) -> np.ndarray:
        """Whether a phrase ends behind the words that were counted before."""
        return np.arange(count) + size - 1 >= self.skip


def blocks(texts: list[bytes | None], salts: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Texts with a line end between them in blocks, cut behind a piece if possible, else between words of one piece.

    In the latter case the last words come again, as context of the phrases that go on behind the cut.
    """
    folded = []
    for text in texts:
        text = (text or b"").translate(FOLD)
        while b"  " in text:
            text = text.replace(b"  ", b" ")
        folded.append(text + b"\n")
    row_starts = np.concatenate([[0], np.cumsum([len(t) for t in folded])[:-1]])
    data = b"".join(folded)
    at, done, skip, size = 0, 0, 0, len(data)
    while done < size:
        end = min(size, done + limit)
        if end < size:
            cut = data.rfind(b"\n", done, end) + 1 or data.rfind(b" ", done, end) + 1
            end = cut or min((k + 1 for k in (data.find(b"\n", end), data.find(b" ", end)) if k >= 0), default=size)
        block = Block(data[at:end], row_starts, at, skip, salts)
        yield block
        again = 0 if data[end - 1] == LINE else min(LONGEST - 1, int(np.count_nonzero(block.piece == block.piece[-1])) if len(block.piece) else 0)
        at, done, skip = at + int(block.starts[-again]) if again else end, end, again


class Filter:
    """A bit set over the leading bits of hashes."""

    def __init__(self, path: str, bits: int):
        filesystem, name = locate(path)
        self.shift = np.uint64(64 - bits)
        self.bits = np.zeros(1 << max(0, bits - 3), np.uint8)
        for batch in ds.dataset(name, filesystem=filesystem, format="parquet").to_batches(batch_size=64):
            for segment, packed in zip(batch.column("segment").to_pylist(), batch.column("bits").to_pylist()):
                self.bits[segment * len(packed):(segment + 1) * len(packed)] = np.frombuffer(packed, np.uint8)

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = (h >> self.shift).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _filter(spec: tuple[str, int]) -> Filter:
    if spec[0] not in _filters:
        while len(_filters) >= LONGEST:
            _filters.pop(next(iter(_filters)))
        _filters[spec[0]] = Filter(*spec)
    return _filters[spec[0]]


def _salt(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang)


def _salts(langs: list[str]) -> np.ndarray:
    known = {lang: _salt(lang) for lang in set(langs)}
    return np.array([known[lang] for lang in langs], np.uint64)


def _pruned(block: Block, size: int, filters: list[Filter]) -> list[np.ndarray]:
    """For each length from 2 to ``size``: where a phrase starts whose parts of one word less, and itself where there is a filter, are candidates."""
    grams, out, parts = block.grams(size), [], None
    for k in range(2, size + 1):
        h, whole = grams[k - 1]
        if parts is not None:
            whole = whole & parts[:len(h)] & parts[1:len(h) + 1]
        if k - 2 < len(filters):
            some = np.flatnonzero(whole)
            whole = np.zeros(len(h), bool)
            whole[some] = filters[k - 2].holds(h[some])
        out.append(whole)
        parts = whole
    return out


def _mined(docs: DataFrame, size: int, filters: list[tuple[str, int]], support: int) -> tuple[str, int]:
    """Bit set of the phrases of ``size`` words that reach ``support`` within a shard."""
    specs = list(filters)

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests, held, n = [_filter(s) for s in specs], [], 0

        def summed():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            keys, counts = keys.view(np.int64), counts.astype(np.int32)
            for a in range(0, len(keys), EMIT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:a + EMIT_ROWS]), pa.array(counts[a:a + EMIT_ROWS])], names=["key", "n"])

        for batch in slices(batches, "text", TEXT_BYTES):
            shard = batch.column("shard").to_numpy(zero_copy_only=False).astype(np.uint64)
            for block in blocks(raw(batch, "text"), _salts(batch.column("lang").to_pylist())):
                h = block.grams(size)[size - 1][0]
                at = np.flatnonzero(_pruned(block, size, tests)[-1] & block.fresh(size, len(h)))
                held.append(h[at] & ~np.uint64(7) | shard[block.row[at]])
                n += len(at)
            if n > HELD:
                yield from summed()
                held, n = [], 0
        if n:
            yield from summed()
        _filters.clear()
        pa.default_memory_pool().release_unused()

    local = docs.mapInArrow(grams, "key bigint, n int").repartition("key").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
    frequent, seen = stage_observed(local.select("key"), f"mined-{size}", n=F.count(F.lit(1)))
    bits = min(FILTER_BITS, max(SEGMENT_BITS, ceil(np.log2(16 * max(1, seen["n"] or 0)))))
    return _bit_set(frequent, bits), bits


def _bit_set(keys: DataFrame, bits: int) -> str:
    """Path of a table (segment, bits): a row for every run of the bit set that has a bit set."""
    inside = min(bits, SEGMENT_BITS)
    spots = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("bit")).select(
        F.shiftrightunsigned("bit", inside).cast("int").alias("segment"), F.col("bit").bitwiseAND(F.lit((1 << inside) - 1)).cast("int").alias("bit"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bitmap = None, None  # rows come by segment

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bitmap, bitorder="little").tobytes()])], names=["segment", "bits"])

        for batch in batches:
            segment, bit = (batch.column(c).to_numpy() for c in ("segment", "bit"))
            for s in np.unique(segment).tolist():
                if s != now:
                    if now is not None:
                        yield done()
                    now, bitmap = s, np.zeros(1 << inside, bool)
                bitmap[bit[segment == s]] = True
        if now is not None:
            yield done()

    packed = spots.repartition("segment").sortWithinPartitions("segment").mapInArrow(pack, "segment int, bits binary")
    path = stage_path(keys.sparkSession, "candidates")
    packed.write.parquet(path)
    return path


class Counter:
    """Exact counts of words and candidate phrases in a task."""

    def __init__(self, size: int):
        self.size, self.names = size, {}
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, dict[bytes, int]] = {}
        self.words: list[bytes] = []
        self.langs: list[str] = []
        self.counts = np.zeros(1 << 16, np.int64)
        self.held: dict[int, list[np.ndarray]] = {k: [] for k in range(2, self.size + 1)}
        self.n = 0

    def named(self, block: Block, langs: list[str], codes: np.ndarray) -> np.ndarray:
        """The task's number of each word, one for each language and text; equal hashes are checked byte by byte."""
        _, first, which = np.unique(block.hash, return_index=True, return_inverse=True)
        like = first[which]
        length = block.ends - block.starts
        same = (length == length[like]).all() and (codes[block.row] == codes[block.row[like]]).all()
        if same:
            buf, offset = np.frombuffer(block.data, np.uint8), np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            same = np.array_equal(buf[np.repeat(block.starts, length) + offset], buf[np.repeat(block.starts[like], length) + offset])
        if not same:  # two words with one hash
            first, which = np.arange(len(block.hash)), np.arange(len(block.hash))
        found = []
        data, starts, ends, row = block.data, block.starts[first].tolist(), block.ends[first].tolist(), block.row[first].tolist()
        for a, b, r in zip(starts, ends, row):
            known = self.ids.setdefault(langs[r], {})
            word = data[a:b]
            k = known.get(word)
            if k is None:
                k = known[word] = len(self.words)
                self.words.append(word)
                self.langs.append(langs[r])
            found.append(k)
        return np.array(found, np.int64)[which]

    def add(self, block: Block, langs: list[str], codes: np.ndarray, filters: list[Filter]) -> None:
        """``langs`` and ``codes``: name and number of each row's language."""
        if not len(block.hash):
            return
        ids = self.named(block, langs, codes)
        if len(self.words) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(len(self.words), np.int64)])
        self.counts += np.bincount(ids[block.skip:], minlength=len(self.counts))
        for k, starts in enumerate(_pruned(block, self.size, filters), 2):
            at = np.flatnonzero(starts & block.fresh(k, len(starts)))
            keys = [ids[at]]
            for j in range(1, k):
                if j % 3:
                    keys[-1] = keys[-1] << ID_BITS | ids[at + j]
                else:
                    keys.append(ids[at + j])
            self.held[k].append(np.stack(keys))
            self.n += len(at)

    def full(self) -> bool:
        return self.n > HELD or len(self.words) > WORDS_HELD

    def summed(self) -> Iterator[pa.RecordBatch]:
        words, langs = pa.array(self.words, pa.binary()).cast(pa.string()), pa.array(self.langs, pa.string()).dictionary_encode()
        counts = self.counts[:len(self.words)]
        totals: dict[str, int] = {}
        which = langs.indices.to_numpy()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            totals[lang] = int(counts[which == k].sum())
        if totals:
            yield self._rows(0, pa.array(list(totals)), pa.array([""] * len(totals)), np.array(list(totals.values())))
        at = np.flatnonzero(counts)
        yield from self._split(1, langs, at, [words.take(pa.array(at))], counts[at])
        for k, parts in self.held.items():
            keys = np.concatenate(parts, axis=1) if parts else np.empty((1, 0), np.int64)
            if not keys.shape[1]:
                continue
            keys = keys[:, np.lexsort(keys[::-1])]
            new = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            n, keys = np.diff(np.append(new, keys.shape[1])), keys[:, new]
            ids = []
            for j in range(k):
                within = min(3, k - j // 3 * 3)
                ids.append(keys[j // 3] >> (ID_BITS * (within - 1 - j % 3)) & ((1 << ID_BITS) - 1))
            for a in range(0, len(n), EMIT_ROWS):
                part = [words.take(pa.array(i[a:a + EMIT_ROWS])) for i in ids]
                yield from self._split(k, langs, ids[0][a:a + EMIT_ROWS], part, n[a:a + EMIT_ROWS])
        self.clear()

    def _split(self, k: int, langs: pa.Array, at: np.ndarray, parts: list[pa.Array], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        phrase = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, " ")
        lang = langs.take(pa.array(at)).dictionary_decode()
        for a in range(0, len(n), EMIT_ROWS):
            yield self._rows(k, lang.slice(a, EMIT_ROWS), phrase.slice(a, EMIT_ROWS), n[a:a + EMIT_ROWS])

    @staticmethod
    def _rows(k: int, lang: pa.Array, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(n), k, np.int32)), phrase, pa.array(n.astype(np.int64))], names=["lang", "size", "phrase", "n"])


def count_phrases(docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", support: int = SUPPORT,
                  longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """``lang, size, phrase, n``: exact counts of all phrases of 2 to ``longest`` words, and all words, that occur ``support`` times or more
    in documents of a language, and in the rows of size 0 how many words each language has.

    Texts are lower-cased in A-Z, cut at ``. , ; : ! ?`` and line ends into pieces and at blanks and tabs into words; phrases
    lie within a piece, and overlapping occurrences count.  A null text is empty, a null language ``und``; repeated rows and
    ids count as often as they come; an empty table gives no rows.  Other columns are ignored.
    """
    if not 1 <= shards <= 8 or not 2 <= longest <= LONGEST:
        raise ValueError("1 to 8 shards, phrases of 2 to 4 words")
    ship_package(docs.sparkSession)
    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text"),
                       F.pmod(F.xxhash64(F.col(id)), F.lit(shards)).cast("int").alias("shard"))
    filters: list[tuple[str, int]] = []
    for size in range(2, longest + 1):
        filters.append(_mined(read, size, filters, -(-support // shards)))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests, counter = [_filter(s) for s in filters], Counter(longest)
        for batch in slices(batches, "text", TEXT_BYTES):
            langs = batch.column("lang").to_pylist()
            codes = pa.array(langs, pa.string()).dictionary_encode().indices.to_numpy()
            for block in blocks(raw(batch, "text"), _salts(langs)):
                counter.add(block, langs, codes, tests)
                if counter.full():
                    yield from counter.summed()
        yield from counter.summed()
        _filters.clear()
        pa.default_memory_pool().release_unused()

    counted = read.select("lang", "text").mapInArrow(count, "lang string, size int, phrase string, n bigint")
    counted = counted.repartition("lang", "size", "phrase").groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return stage(counted.where((F.col("n") >= support) | (F.col("size") == 0)), "phrase-counts")


def collocations(docs: DataFrame, *, top: int = TOP, contained: int = CONTAINED, **limits) -> DataFrame:
    """The ``top`` phrases of each language, ``lang, rank, phrase, a, l, r, n, score``; ``limits`` as for ``count_phrases``.

    ``a`` counts the phrase.  Cutting it into two parts, counted by ``l`` and ``r``, gives floor(2000000 a / (l + r)); the cut
    of the lowest score counts, the leftmost of equals.  A phrase with ``contained`` percent of its occurrences inside some
    longer candidate is left out.  Ranks go by score, then ``a``, both descending, then the phrase by its bytes.
    """
    counts = count_phrases(docs, **limits)
    found = counts.where("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"))
    words = found.withColumn("w", F.split("phrase", " ", -1))
    said = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    cuts = words.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", said(F.lit(1), F.col("cut")).alias("left"), said(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("right"))
    parts = counts.where("size >= 1")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    whole = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"cast((cast(2000000 as decimal(7,0)) * {whole('a')}) div ({whole('l')} + {whole('r')}) as bigint)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda s: F.transform(
        F.sequence(F.lit(1), F.col("size") - s + 1), lambda at: F.array_join(F.slice("w", at, s), " "))))
    longer = words.where("size >= 3").select("lang", "a", F.explode(inside).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    swallowed = longer.join(found.select("lang", "phrase", "a"), ["lang", "phrase"]).where(
        F.expr(f"100 * {whole('longer')} >= {int(contained)} * {whole('a')}")).select("lang", "phrase")
    kept = best.join(swallowed, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))  # a language may hold most phrases
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
