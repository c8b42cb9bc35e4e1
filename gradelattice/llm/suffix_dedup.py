"""Removal of repeated byte strings by distributed prefix-free parsing.

A rolling hash over ``TRIGGER`` bytes picks, in every string of ``length`` bytes, the place of its least value.  Equal
strings have their place alike, so consecutive strings of one place form a phrase, and a phrase can only share strings
with phrases of the same trigger.  The parse of a document is its sequence of phrases; the dictionary is made of the
phrases whose trigger stands in more than one document.  Dictionary phrases of a trigger meet in one place, where their
strings of ``length`` bytes are compared by hash, without a suffix array; equal hashes tell in which document a string
comes first.
Carried back along the parse, that gives the bytes of each document that an earlier one has.

Texts are laid down once, in slices on the shared folder that any task can open; from then on only hashes, phrases of
shared triggers and their verdicts move.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelattice.llm.batches import locate, raw, slices
from gradelattice.session import ship_package, stage, stage_observed, stage_path

LENGTH = 50
TRIGGER = 16
SLICE_BYTES = 32 << 20  # text of a slice, which a task holds
BUCKET_ANCHORS = 1 << 20  # triggers compared in one group, about
CHUNK_PHRASES = 8_000  # dictionary phrases judged at once; triggers with more are spread

VERDICT = np.dtype([("phrase", "<u8"), ("first", "<i8"), ("early", "<i8")])
_PLACES = np.uint64((1 << 20) - 1)
_PIECE = 1 << 17  # start positions of a text looked at together
_BYTES = np.random.default_rng(50).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 2**64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n``."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 17, n + n // 4)
        for name, base in (("up", _P), ("down", _P_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of all substrings of a buffer, from one running sum."""

    def __init__(self, data: bytes):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, size: int) -> np.ndarray:
        """Of the ``size`` bytes from every place on."""
        x = self.sums[size:] - self.sums[:-size]
        x *= self.down[:len(x)]
        x ^= x >> np.uint64(32)
        x *= _MIX
        x ^= x >> np.uint64(29)
        return x


def phrases(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of a text: hash of the trigger, first and last start of its strings, and hash of all its bytes."""
    parts = []
    width = length - TRIGGER + 1
    for at in range(0, max(0, len(data) - length + 1), _PIECE):
        piece = data[at:at + _PIECE + length - 1]
        hashes = Hashes(piece)
        own = hashes.windows(TRIGGER)
        least, reach = own & ~_PLACES, 1
        least |= np.arange(len(own), dtype=np.uint64)
        while 2 * reach <= width:
            least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
        if reach < width:
            least = np.minimum(least[:len(least) - (width - reach)], least[width - reach:])
        chosen = (least & _PLACES).astype(np.int64)
        first = np.flatnonzero(np.diff(chosen, prepend=-1))
        last = np.append(first[1:], len(chosen)) - 1
        whole = _mixed(hashes.of(first, last + length) + own[chosen[first]] + (last - first).astype(np.uint64))
        parts.append((own[chosen[first]], first + at, last + at, whole))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _lay_down(docs: DataFrame, folder: str) -> DataFrame:
    """Write the texts in slices; staged ``slice, doc_id, n_bytes, high, low`` (hash of the text) for each row."""
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = locate(folder)
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])
        writer = name = None
        held = 0
        for batch in slices(batches, "text", 4 << 20):
            whole = [t or b"" for t in raw(batch, "text")]
            if writer is None:
                filesystem.create_dir(base, recursive=True)
                name, held = f"{uuid.uuid4().hex}.parquet", 0
                writer = pq.ParquetWriter(f"{base}/{name}", schema, compression="zstd", use_dictionary=False, filesystem=filesystem)
            writer.write_batch(pa.record_batch([batch.column("doc_id"), pa.array(whole, pa.binary())], schema=schema))
            digests = [xxhash.xxh3_128_intdigest(t) for t in whole]
            sizes = [len(t) for t in whole]
            yield pa.RecordBatch.from_pydict({
                "slice": [name] * len(whole), "doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()),
                "high": pa.array([(d >> 64) - (1 << 63) for d in digests], pa.int64()),
                "low": pa.array([(d & (1 << 64) - 1) - (1 << 63) for d in digests], pa.int64())})
            held += sum(sizes)
            if held >= SLICE_BYTES:
                writer.close()
                writer = None
        if writer is not None:
            writer.close()

    return stage(docs.mapInArrow(write, "slice string, doc_id bigint, n_bytes bigint, high bigint, low bigint"), "laid-down")


def _opened(folder: str, name: str) -> Iterator[tuple[int | None, bytes]]:
    """Ids and texts of a slice, a few megabytes in memory at a time."""
    filesystem, base = locate(folder)
    with filesystem.open_input_file(f"{base}/{name}") as source:
        file = pq.ParquetFile(source)
        for k in range(file.num_row_groups):
            group = file.read_row_group(k, use_threads=False)
            yield from zip(group.column("doc_id").to_pylist(), group.column("text").to_pylist())
    pa.default_memory_pool().release_unused()


def _live(folder: str, row: dict, length: int) -> Iterator[tuple[int, bytes]]:
    """Documents of a slice that are long enough and no copies."""
    copies = set(row["copies"] or ())
    for i, text in _opened(folder, row["slice"]):
        if i is not None and i not in copies and len(text) >= length:
            yield i, text


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _unsigned(binary: list[bytes] | None) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(binary or ()), np.uint64))


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.searchsorted(table, values)
    return (table[np.minimum(at, len(table) - 1)] == values) if len(table) else np.zeros(len(values), bool)


def _shared_triggers(named: DataFrame, folder: str, anchors: int, length: int) -> DataFrame:
    """``number, hashes``: triggers of the slice that stand in at least two documents of the table."""
    bits = max(4, (anchors // BUCKET_ANCHORS).bit_length())

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            each = [np.unique(phrases(text, length)[0]) for _, text in _live(folder, row, length)]
            if not each:
                continue
            # One entry for each trigger of the slice, however many of its documents have it.
            found, times = np.unique(np.concatenate(each), return_counts=True)
            cuts = np.searchsorted(found, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            parts, many = np.split(found, cuts), np.split(times > 1, cuts)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(range(1 << bits), pa.int32()), "number": pa.array([row["number"]] * (1 << bits), pa.int64()),
                                              "hashes": [x.tobytes() for x in parts], "many": [np.packbits(x).tobytes() for x in many]})

    def meet(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(o)).astype(bool) for x, o in zip(table["many"].to_pylist(), own)]
        found, at, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        shared = times > 1
        shared[at[np.concatenate(many)]] = True
        ends = np.cumsum([len(o) for o in own])
        kept = [o[shared[a]].tobytes() for o, a in zip(own, np.split(at, ends[:-1]))]
        return pa.table({"number": table["number"], "hashes": pa.array(kept, pa.binary())})

    return (named.mapInArrow(read, "bucket int, number bigint, hashes binary, many binary")
            .groupBy("bucket").applyInArrow(meet, "number bigint, hashes binary").where(F.length("hashes") > 0))


def _dictionary(named: DataFrame, folder: str, length: int) -> DataFrame:
    """``trigger, number, phrase, first, last``: the different phrases of a slice's shared triggers, with the first and the
    last document there that has each."""
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            shared, found, documents = _unsigned(row["hashes"]), [], []
            for i, text in _live(folder, row, length):
                trigger, first, last, whole = phrases(text, length)
                at = np.flatnonzero(_among(trigger, shared))
                found.append((trigger[at], first[at], last[at], whole[at], np.full(len(at), len(documents))))
                documents.append((i, text))
            if not found:
                continue
            trigger, first, last, whole, owner = (np.concatenate(x) for x in zip(*found))
            ids = np.array([i for i, _ in documents])
            _, one, of = np.unique(whole, return_index=True, return_inverse=True)
            earliest, latest = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
            np.minimum.at(earliest, of, ids[owner])
            np.maximum.at(latest, of, ids[owner])
            for k in range(0, len(one), CHUNK_PHRASES):
                at = one[k:k + CHUNK_PHRASES]
                texts = [documents[d][1][a:b + length] for d, a, b in zip(owner[at].tolist(), first[at].tolist(), last[at].tolist())]
                yield pa.RecordBatch.from_pydict({"trigger": pa.array(trigger[at].view(np.int64)), "number": pa.array([row["number"]] * len(at), pa.int64()),
                                                  "phrase": pa.array(texts, pa.binary()), "first": pa.array(earliest[k:k + CHUNK_PHRASES]),
                                                  "last": pa.array(latest[k:k + CHUNK_PHRASES])})

    return named.mapInArrow(read, "trigger bigint, number bigint, phrase binary, first bigint, last bigint")


def _verdicts(dictionary: DataFrame, length: int) -> DataFrame:
    """``number, verdicts``: packed for each slice, the hash and the first document of phrases, and a bit for each of their
    strings that stands in a document before that one; without the phrases of a slice that lose nothing.  Phrases of triggers that have too many for one task come back as
    ``trigger, number, phrase, first, last``, without a verdict."""
    def order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        hot = None
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < CHUNK_PHRASES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            trigger = table["trigger"].to_numpy()
            last = int(trigger[-1])
            cut = int(np.searchsorted(trigger, last))  # the last trigger may go on in the next batch
            yield from settled(table.slice(0, cut), hot)
            if last == hot or table.num_rows - cut > CHUNK_PHRASES:
                yield from settled(table.slice(cut), last)
                held, hot = [], last
            else:
                held = table.slice(cut).to_batches()
        if held:
            yield from settled(pa.Table.from_batches(held).combine_chunks(), hot)

    def settled(table: pa.Table, hot: int | None) -> Iterator[pa.RecordBatch]:
        """Verdicts, but the phrases themselves of ``hot`` and other triggers with more of them than are judged at once."""
        if not table.num_rows:
            return
        trigger = table["trigger"].to_numpy()
        _, of, n = np.unique(trigger, return_inverse=True, return_counts=True)
        many = n[of] > CHUNK_PHRASES
        if hot is not None:
            many |= trigger == hot
        if many.any():
            for part in table.filter(pa.array(many)).to_batches():
                nothing = pa.nulls(part.num_rows, pa.binary())
                yield pa.RecordBatch.from_pydict({"number": part["number"], "verdicts": nothing} | {c: part[c] for c in ("trigger", "phrase", "first", "last")})
            table = table.filter(pa.array(~many)).combine_chunks()
        if table.num_rows:
            done = judge(table)
            rest = {c: pa.nulls(done.num_rows, t) for c, t in (("trigger", pa.int64()), ("phrase", pa.binary()), ("first", pa.int64()), ("last", pa.int64()))}
            yield pa.RecordBatch.from_pydict({c: done[c] for c in ("number", "verdicts")} | rest)

    def judge(table: pa.Table) -> pa.RecordBatch:
        texts = table["phrase"].to_pylist()
        trigger, first = table["trigger"].to_numpy().view(np.uint64), table["first"].to_numpy()
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        hashes = Hashes(b"".join(texts))
        whole = _mixed(hashes.of(ends - sizes, ends) + trigger + (sizes - length).astype(np.uint64))
        _, one, of = np.unique(whole, return_index=True, return_inverse=True)
        earliest = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(earliest, of, first)
        # All strings of different phrases, by their hashes.
        counts = sizes[one] - length + 1
        owner = np.repeat(np.arange(len(one)), counts)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = (ends - sizes)[one][owner] + inside
        _, string = np.unique(_mixed(hashes.of(start, start + length) + trigger[one][owner]), return_inverse=True)
        least = np.full(int(string.max()) + 1 if len(string) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, string, earliest[owner])
        early = np.zeros(len(one), np.int64)
        np.bitwise_or.at(early, owner, (least[string] < earliest[owner]).astype(np.int64) << inside)
        keep = np.flatnonzero((early[of] != 0) | (table["last"].to_numpy() > earliest[of]))
        number = table["number"].to_numpy()[keep]
        keep, number = keep[(order := np.argsort(number, kind="stable"))], number[order]
        out = np.empty(len(keep), VERDICT)
        out["phrase"], out["first"], out["early"] = whole[keep], earliest[of[keep]], early[of[keep]]
        cuts = np.flatnonzero(np.diff(number)) + 1
        return pa.RecordBatch.from_pydict({"number": pa.array(number[np.append(0, cuts)] if len(number) else number, pa.int64()),
                                           "verdicts": pa.array([x.tobytes() for x in np.split(out, cuts)] if len(number) else [], pa.binary())})

    return (dictionary.repartition("trigger").sortWithinPartitions("trigger")
            .mapInArrow(order, "number bigint, verdicts binary, trigger bigint, phrase binary, first bigint, last bigint"))


def _spread_verdicts(hot: DataFrame, length: int) -> DataFrame:
    """``number, verdicts`` of the phrases that ``_verdicts`` left open, whose triggers have more than one task should hold:
    joined string by string."""
    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK_PHRASES):
                part = batch.slice(a, CHUNK_PHRASES)
                texts = part["phrase"].to_pylist()
                trigger = part["trigger"].to_numpy().view(np.uint64)
                sizes = np.array([len(t) for t in texts])
                ends = np.cumsum(sizes)
                hashes = Hashes(b"".join(texts))
                whole = _mixed(hashes.of(ends - sizes, ends) + trigger + (sizes - length).astype(np.uint64))
                counts = sizes - length + 1
                stops = np.cumsum(counts)
                start = np.repeat(ends - sizes, counts) + np.arange(counts.sum()) - np.repeat(stops - counts, counts)
                strings = _mixed(hashes.of(start, start + length) + np.repeat(trigger, counts)).view(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "trigger": part["trigger"], "number": part["number"], "whole": pa.array(whole.view(np.int64)), "first": part["first"], "last": part["last"],
                    "strings": pa.ListArray.from_arrays(pa.array(np.append(0, stops), pa.int32()), pa.array(strings))})

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch["number"].to_numpy()
            out = np.empty(len(number), VERDICT)
            out["phrase"], out["first"], out["early"] = batch["whole"].to_numpy().view(np.uint64), batch["earliest"].to_numpy(), batch["early"].to_numpy()
            names = np.unique(number)
            yield pa.RecordBatch.from_pydict({"number": pa.array(names), "verdicts": pa.array([out[number == n].tobytes() for n in names], pa.binary())})

    rows = stage(hot.select("trigger", "number", "phrase", "first", "last").repartition("phrase")
                 .mapInArrow(hashed, "trigger bigint, number bigint, whole bigint, first bigint, last bigint, strings array<bigint>"), "hot-phrases")
    each = rows.groupBy("trigger", "whole").agg(F.min("first").alias("earliest"), F.first("strings").alias("strings"))
    strings = stage(each.select("trigger", "whole", "earliest", F.posexplode("strings").alias("inside", "string")), "hot-strings")
    least = strings.groupBy("trigger", "string").agg(F.min("earliest").alias("least"))
    early = (strings.join(least, ["trigger", "string"]).groupBy("trigger", "whole")
             .agg(F.min("earliest").alias("earliest"), F.expr("bit_or(if(least < earliest, shiftleft(1L, inside), 0L))").alias("early")))
    told = rows.drop("strings").join(early, ["trigger", "whole"]).where("early <> 0 or last > earliest")
    return told.select("number", "whole", "earliest", "early").mapInArrow(pack, "number bigint, verdicts binary")


def _spans(text: bytes, starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + length).tolist()))


def _cut(documents: list[tuple[int | None, bytes]], phrase: np.ndarray, first: np.ndarray, early: np.ndarray, copies: set,
         length: int) -> pa.RecordBatch:
    spans, kept = [], []
    for i, t in documents:
        if i in copies and len(t) >= length:
            spans.append([(0, len(t))])
        elif i is None or len(t) < length or not len(phrase):
            spans.append([])
        else:
            _, begin, end, whole = phrases(t, length)
            at = np.searchsorted(phrase, whole).clip(max=len(phrase) - 1)
            found = np.flatnonzero(phrase[at] == whole)
            begin, counts, at = begin[found], (end - begin + 1)[found], at[found]
            inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            gone = np.repeat(first[at] < i, counts) | (np.repeat(early[at], counts) >> inside & 1).astype(bool)
            spans.append(_spans(t, (np.repeat(begin, counts) + inside)[gone], length))
        edges = [0, *(x for s in spans[-1] for x in s), len(t)]
        kept.append(b"".join(t[x:y] for x, y in zip(edges[::2], edges[1::2])))
    flat = np.array([x for s in spans for x in s], np.int64).reshape(-1, 2)
    ends = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
    parts = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([i for i, _ in documents], pa.int64()), "n_bytes": pa.array([len(t) for _, t in documents], pa.int64()),
        "spans": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts), "kept": pa.array(kept, pa.binary())})


def remove_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Bytes of each text that belong to a string of ``length`` bytes which also starts in a document of a smaller id.

    Texts are UTF-8 bytes, matches end at the text's, and all are judged on the input.  Returns ``doc_id, n_bytes, spans,
    kept`` for each row: maximal removed runs as ``array<struct<start, end>>`` and the bytes that remain.  A null text is
    empty; a row without id neither loses anything nor counts for others; rows of one id are not earlier than each other.
    Whole texts are judged, however long.  Other columns are ignored.  ``length`` is 24 to 79.
    """
    if not TRIGGER + 8 <= length <= TRIGGER + 63:
        raise ValueError("strings of 24 to 79 bytes can be compared")
    spark = docs.sparkSession
    ship_package(spark)
    folder = stage_path(spark, "slices")
    laid = _lay_down(docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")), folder)
    names, seen = stage_observed(laid.groupBy("slice").agg(F.sum("n_bytes").alias("size")), "slice-names", n=F.count(F.lit(1)), size=F.sum("size"))
    # Whole copies of an earlier text are settled by their hash.
    twins = (laid.where(f"doc_id is not null and n_bytes >= {length}").groupBy("high", "low")
             .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("most")).where("most > first").select("high", "low", "first"))
    copies = (laid.where("doc_id is not null").join(twins, ["high", "low"]).where("doc_id > first")
              .groupBy("slice").agg(F.collect_set("doc_id").alias("copies")))
    spread = max(1, int(seen["n"]))
    named = stage(names.select("slice").join(copies, "slice", "left").withColumn("number", F.monotonically_increasing_id()), "slices-copies")

    def dealt(table: DataFrame) -> DataFrame:
        return table.repartition(spread)  # one slice to a task

    shared = stage(_shared_triggers(dealt(named), folder, int(seen["size"] or 0) // 16, length), "shared-triggers")
    with_shared = named.join(shared.groupBy("number").agg(F.collect_list("hashes").alias("hashes")), "number")
    verdicts, open_ = stage_observed(_verdicts(_dictionary(dealt(with_shared), folder, length), length), "verdicts", n=F.count("phrase"))
    hot = verdicts.where("phrase is not null")
    verdicts = verdicts.where("phrase is null").select("number", "verdicts")
    if open_["n"]:
        verdicts = verdicts.union(_spread_verdicts(hot, length))
    packed = verdicts.groupBy("number").agg(F.collect_list("verdicts").alias("verdicts"))

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            verdicts = np.frombuffer(b"".join(row["verdicts"] or ()), VERDICT)
            phrase, at = np.unique(verdicts["phrase"], return_index=True)
            first, early, copies = verdicts["first"][at], verdicts["early"][at], set(row["copies"] or ())
            documents = _opened(folder, row["slice"])
            while part := list(islice(documents, 256)):
                yield _cut(part, phrase, first, early, copies, length)

    final = dealt(named.join(packed, "number", "left"))
    return final.select("slice", "copies", "verdicts").mapInArrow(finish, "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    """Counts and the hash of what remains, of ``remove_repeats``."""
    lengths = F.transform("spans", lambda s: s["end"] - s["start"])
    return removed.select("doc_id", "n_bytes", F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_removed"),
                          F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
