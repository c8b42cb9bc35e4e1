"""Token ids of a corpus as Arrow files of equal-length sequences.

Documents are range-partitioned by id; each task encodes its documents in order and writes one shard: an Arrow IPC file
whose record batches hold ``ids: fixed_size_list<uint16|uint32>[L]`` and ``mask: fixed_size_list<bool>[L]`` (true =
token, false = padding behind the last document of the shard; a bit each), and beside it an index file ``doc_id, start, n_tokens``.  A sequence
is addressed by (shard, row) and read through a memory map without copying.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradelattice.llm.batches import locate, slices, texts
from gradelattice.session import ship_package, stage, stage_path

SEQUENCE = 2048  # ids in a sequence
BATCH_ROWS = 256  # sequences in a record batch
WORDS_KEPT = 1_800_000  # encoded words a worker remembers (some 400 MB); beyond, it starts anew
WORDS_AT_ONCE = 2_000  # new words in one call of the tokenizer
TEXT_BYTES = 2 << 20  # text a worker splits into words at once

_encoders: dict = {}


class Encoder:
    """Encodes texts; remembers the ids, as little-endian bytes, of the white-space separated words seen.

    ``by_words`` is for tokenizers that lower-case, drop white space and split letters from other signs (such as
    ``word_bpe_49k.json``): there, the ids of a text are those of its lower-case words one after another.  Texts in which
    that could differ, by special tokens or context-dependent case, are encoded whole, as are all texts otherwise.
    """

    def __init__(self, path: str, by_words: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_file(path), by_words
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.kind = id_type(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.known: dict[str, bytes] = {"": b""}

    def _packed(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, missing: set[str]) -> None:
        known = self.known
        ends = {w: w[:-1] for w in missing if w[-1] in ".," and w[:-1].isalpha()}
        plain = [w for w in {*missing.difference(ends), *ends.values(), ".", ","}.difference(known)]
        letters = [w for w in plain if w.isalpha()]
        for a in range(0, len(letters), WORDS_AT_ONCE):
            group = letters[a:a + WORDS_AT_ONCE]
            got = self.tokenizer.encode(" ".join(group), add_special_tokens=False)
            starts = np.flatnonzero(np.diff(np.array(got.word_ids), prepend=-1))
            if len(starts) == len(group):
                ids = np.array(got.ids, self.kind)
                known.update(zip(group, map(bytes, np.split(ids, starts[1:]))))
        known.update((w, self._packed(w)) for w in plain if w not in known)
        known.update((w, known[base] + known[w[-1]]) for w, base in ends.items())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_words:
            return [self._packed(t) if t else b"" for t in texts]
        if len(self.known) > WORDS_KEPT:
            self.known = {"": b""}
        out, open_, missing, get = [b""] * len(texts), {}, set(), self.known.__getitem__
        for k, text in enumerate(texts):
            if not text:
                continue
            if "<|" in text or "\u03a3" in text:
                out[k] = self._packed(text)
                continue
            words = text.lower().replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            try:
                out[k] = b"".join(map(get, words))
            except KeyError:
                open_[k] = words
                missing.update(words)
        if open_:
            self._learn(missing.difference(self.known))
            for k, words in open_.items():
                out[k] = b"".join(map(get, words))
        return out


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def encoder(path: str, by_words: bool) -> Encoder:
    if (path, by_words) not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path, by_words] = Encoder(path, by_words)
    return _encoders[path, by_words]


class ShardWriter:
    """Collects ids and writes full sequences; ``close`` pads the last one."""

    def __init__(self, sink: pa.NativeFile, kind: np.dtype, length: int):
        self.kind, self.length, self.rest, self.held = kind, length, [], 0
        value = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: bytes) -> None:
        self.rest.append(ids)
        self.held += len(ids) // self.kind.itemsize
        if self.held >= self.length * BATCH_ROWS:
            self._write(self.held // (self.length * BATCH_ROWS) * BATCH_ROWS, False)

    def _write(self, rows: int, pad: bool) -> None:
        ids, size = np.frombuffer(b"".join(self.rest), self.kind), rows * self.length
        tail = ids[size:]
        self.rest, self.held = [tail.tobytes()], len(tail)
        mask = np.ones(size, bool)
        if pad:
            mask[len(ids):] = False
            ids = np.concatenate([ids, np.zeros(max(0, size - len(ids)), self.kind)])
        for a in range(0, size, BATCH_ROWS * self.length):
            b = min(size, a + BATCH_ROWS * self.length)
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x[a:b]), self.length) for x in (ids[:size], mask)]
            self.file.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._write(-(-self.held // self.length), True)
        self.file.close()


class Shard:
    """Random access to one written shard."""

    def __init__(self, path: str):
        filesystem, name = locate(path)
        local = filesystem.type_name == "local"
        source = pa.memory_map(name) if local else filesystem.open_input_file(name)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.batch = -1, None

    def _batch(self, k: int) -> pa.RecordBatch:
        if k != self.at:
            self.at, self.batch = k, self.file.get_batch(k)
        return self.batch

    def sequence(self, row: int) -> tuple[pa.Array, pa.Array]:
        """Ids and mask of one sequence, as views of the file's buffers."""
        batch, at = self._batch(row // BATCH_ROWS), row % BATCH_ROWS * self.length
        return tuple(batch.column(c).values.slice(at, self.length) for c in ("ids", "mask"))

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from position ``start`` of the shard."""
        span, parts, end = BATCH_ROWS * self.length, [], start + count
        while start < end:
            k, a = divmod(start, span)
            b = min(span, a + end - start)
            parts.append(self._batch(k).column("ids").values.to_numpy()[a:b])
            start += b - a
        if len(parts) == 1:
            return parts[0]
        return np.concatenate(parts) if parts else np.empty(0, np.uint16)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, *, id: str = "doc_id",
                      text: str = "text", end_id: int | None = None, length: int = SEQUENCE,
                      by_words: bool = False) -> DataFrame:
    """Write ``docs`` as token shards in ascending ``id`` order and return the manifest, one row per shard.

    ``end_id`` is appended to every document.  A null or empty text has no ids but that one; a null id sorts first; rows
    that share an id are all written, in no fixed order among themselves; an empty table gives an empty manifest.  Other
    columns are ignored.  Each attempt of a task writes under a name of its own, and the manifest names the files of the
    attempts that Spark committed, so a lost executor leaves at most unused files.
    """
    spark = docs.sparkSession
    ship_package(spark)
    folder = folder or stage_path(spark, "tokens")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, writer, index, total = encoder(tokenizer, by_words), None, None, 0
        end = b"" if end_id is None else np.array([end_id], pieces.kind).tobytes()
        filesystem, base = locate(folder)
        part, n_docs, first = TaskContext.get().partitionId(), 0, None
        names = [f"{base}/{part:06d}-{uuid.uuid4().hex[:12]}.{kind}.arrow" for kind in ("ids", "docs")]
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        for batch in slices(batches, "text", TEXT_BYTES):
            if writer is None:
                filesystem.create_dir(base, recursive=True)
                sinks = [filesystem.open_output_stream(n) for n in names]
                writer, index = ShardWriter(sinks[0], pieces.kind, length), pa.ipc.new_file(sinks[1], schema)
            sizes = []
            for ids in pieces.encode(texts(batch, "text")):
                writer.add(ids + end)
                sizes.append(len(ids + end) // pieces.kind.itemsize)
            ends = total + np.cumsum(sizes, dtype=np.int64)
            index.write_batch(pa.record_batch([batch.column("doc_id"), pa.array(ends - sizes), pa.array(sizes, pa.int64())], schema=schema))
            first = batch.column("doc_id")[0].as_py() if not n_docs else first
            total, n_docs = int(ends[-1]), n_docs + batch.num_rows
        if writer is not None:
            writer.close()
            index.close()
            for s in sinks:
                s.close()
            scheme = "" if filesystem.type_name == "local" else folder.split(":", 1)[0] + "://"
            yield pa.RecordBatch.from_pydict({"shard": [part], "ids_path": [scheme + names[0]], "docs_path": [scheme + names[1]],
                                              "n_docs": [n_docs], "n_tokens": [total], "first_id": pa.array([first], pa.int64())})

    ordered = (docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id"))
    shards = ordered.mapInArrow(write, "shard bigint, ids_path string, docs_path string, n_docs bigint, n_tokens bigint, first_id bigint")
    # One row per shard: the running count behind it is a matter of a few kilobytes.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return stage(shards, "manifest").withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: ``doc_id, start, n_tokens, ids_crc32`` (of its ids as unsigned 32-bit, little-endian)."""
    ship_package(manifest.sparkSession)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["ids_path"])
                filesystem, name = locate(row["docs_path"])
                with filesystem.open_input_file(name) as source:
                    for docs in pa.ipc.open_file(source).read_all().to_batches():
                        start, size = (docs.column(c).to_numpy() for c in ("start", "n_tokens"))
                        sums = [zlib.crc32(shard.ids(a, n).astype("<u4").tobytes()) for a, n in zip(start.tolist(), size.tolist())]
                        yield pa.RecordBatch.from_pydict({"doc_id": docs.column("doc_id"), "start": pa.array(start + row["start"]),
                                                          "n_tokens": pa.array(size), "ids_crc32": pa.array(sums, pa.int64())})

    shards = max(1, manifest.count())
    return (manifest.select("ids_path", "docs_path", "start").repartition(shards)
            .mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))
