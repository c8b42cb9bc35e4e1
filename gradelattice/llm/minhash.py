"""Near-duplicate documents by circulant MinHash, banding, and exact Jaccard similarity.

Two permutations make all coordinates: the first scatters a shingle over a circle of ``2**UNIVERSE_BITS`` places, the
second, shifted by k places along the circle, gives coordinate k.  The coordinates of a shingle are therefore
neighbours in one table, and a signature is a column-wise minimum of table rows.

Equal sets are one node from the start.  Buckets are dealt at random into small cells with a leader each, and every
document is compared with its likeliest leaders; so are, in further rounds with other cells, documents of buckets that
still hold several components.  What the rounds leave is compared in full: all pairs of a bucket whose documents are in
different components, large buckets in blocks.  So no pair that shares a bucket is left out unless it is already joined,
and a group of n near copies costs about n comparisons.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelattice.llm.batches import binary_lists, raw, slices, small_batches
from gradelattice.llm.graph import components
from gradelattice.session import ship_package, stage, stage_observed

WORDS = 5  # words of a shingle
PERCENT = 80  # least similarity of a link
BANDS, ROWS = 32, 5  # a pair of similarity 0.8 shares no band with a probability of 3e-6
UNIVERSE_BITS = 22
SKETCH_SLACK = 6.0  # standard deviations below the expected number of equal coordinates at which a pair is left unverified
ROUNDS, CELL, LIKELIEST = 2, 8, 3  # rounds of leaders, documents in a cell, leaders a document is compared with in a round
BLOCK, BLOCK_SHINGLES = 1024, 1 << 22  # documents of a bucket, and shingles of theirs, compared with as many others in one group, about
COLUMNS = 4096  # shingles in a membership matrix
PAIR_ROWS = 500  # pairs with their full sets in an Arrow batch
BROADCAST_IDS = 2_000_000  # ids (some 40 MB) sent to all executors at most; beyond, texts are shuffled by id instead

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STEP
    x = (x ^ (x >> np.uint64(32))) * _STEP
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: A-Z lower-cased, words split at ASCII white space."""
    split = text.lower().split() if text else []
    if not split:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
    size = min(words, len(codes))
    out = np.full(len(codes) - size + 1, size, np.uint64)
    for k in range(size):
        out = _scatter(out * _MIX + codes[k:len(codes) - size + 1 + k])
    return np.unique(out)


@lru_cache(maxsize=1)
def _circle(width: int) -> np.ndarray:
    """Row i: the second permutation at places i, i + 1, ... of the circle, ``width`` of them (a view)."""
    size = 1 << UNIVERSE_BITS
    second = np.random.default_rng(20240229).permutation(size).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:width - 1]]), width)


def signature(items: np.ndarray, width: int) -> np.ndarray:
    """Circulant MinHash coordinates of a set that is not empty."""
    circle = _circle(width)
    places = (_scatter(items) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
    out = np.full(width, np.iinfo(np.int32).max, np.int32)
    for a in range(0, len(places), 2048):
        np.minimum(out, circle[places[a:a + 2048]].min(axis=0), out=out)
    return out


def _band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _MIX, parts.shape[:2])
    for k in range(rows):
        out = _scatter(out + parts[:, :, k])
    return out.view(np.int64)


def _least_equal(width: int, percent: int) -> int:
    """Equal sketch bytes below which a pair of ``percent`` similarity is all but impossible."""
    p = percent / 100
    return int(width * p - SKETCH_SLACK * (width * p * (1 - p)) ** 0.5)


def _signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """Per document: size and hash of its set, and for sets that are not empty a byte of each coordinate and band keys."""
    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, high, low, found = [], [], [], []
            for text in raw(batch, "text"):
                items = shingles(text, words)
                digest = xxhash.xxh3_128_intdigest(items.tobytes())
                sizes.append(len(items))
                high.append((digest >> 64) - (1 << 63))
                low.append((digest & (1 << 64) - 1) - (1 << 63))
                if len(items):
                    found.append(signature(items, bands * rows))
            full = np.array(sizes) > 0
            matrix = np.array(found, np.int32).reshape(-1, bands * rows)
            keys, ends = _band_keys(matrix, bands, rows), np.concatenate([[0], np.cumsum(full)])
            bytes_ = iter((matrix & 255).astype(np.uint8))
            sketches = [next(bytes_).tobytes() if f else None for f in full.tolist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n": pa.array(sizes, pa.int64()), "high": pa.array(high, pa.int64()),
                "low": pa.array(low, pa.int64()), "sketch": pa.array(sketches, pa.binary()),
                "keys": binary_lists(keys.reshape(-1), ends * bands)})

    return docs.mapInArrow(sign, "doc_id bigint, n bigint, high bigint, low bigint, sketch binary, keys array<bigint>")


def _alike(pairs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose sizes and sketches allow the similarity, with the number of equal sketch bytes."""
    least = _least_equal(width, percent)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, width) for c in ("sa", "sb"))
            same = (left == right).sum(axis=1)
            keep = pa.array(same >= least)
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "same": pa.array(same, pa.int64())}).filter(keep)

    sized = (pairs.join(nodes.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
             .join(nodes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
             .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    return sized.select("a", "b", "sa", "sb").mapInArrow(count, "a bigint, b bigint, same bigint")


def with_ids(docs: DataFrame, ids: DataFrame, count: int, how: str, id: str = "doc_id") -> DataFrame:
    """Semi or anti join with a table of ``count`` distinct ids: broadcast while that is small, else by shuffle."""
    right = ids.select(F.col(ids.columns[0]).alias(id))
    return docs.join(F.broadcast(right) if count <= BROADCAST_IDS else right, id, how)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """Shingle sets of the documents in ``wanted``, staged: ``doc_id, items`` (sorted hashes as bytes)."""
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [shingles(t, words).tobytes() for t in raw(batch, "text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "items": pa.array(found, pa.binary())})

    ids, seen = stage_observed(wanted.distinct(), "wanted", n=F.count(F.lit(1)))
    return stage(with_ids(docs, ids, seen["n"], "left_semi").mapInArrow(read, "doc_id bigint, items binary"), "sets")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.sort(np.concatenate([x, y]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity, as a staged table ``a, b``."""
    pairs = stage(pairs.select("a", "b"), "candidates")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for batch in slices([part], "ia"):
                keep = []
                for x, y in zip(*(batch.column(c).to_pylist() for c in ("ia", "ib"))):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    common = _common(x, y)
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    held = _sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), words)
    joined = (pairs.join(held.select(F.col("doc_id").alias("a"), F.col("items").alias("ia")), "a")
              .join(held.select(F.col("doc_id").alias("b"), F.col("items").alias("ib")), "b"))
    with small_batches(docs.sparkSession, PAIR_ROWS):
        return stage(joined.select("a", "b", "ia", "ib").mapInArrow(compare, "a bigint, b bigint"), "links")


def _open(multi: DataFrame, owner: DataFrame) -> DataFrame:
    """Buckets that hold several components: ``key, rep, component, members, shingles``."""
    placed = stage(multi.join(owner, multi.rep == owner.node, "left")
                   .select("key", "rep", F.coalesce("component", "rep").alias("component"), "members", "shingles"), "placed")
    split = placed.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("key")
    return stage(placed.join(split, "key"), "open-buckets")


def _leaders(buckets: DataFrame, salt: int) -> DataFrame:
    """Pairs of a document and the smallest one of its cell, if they are in different components."""
    cell = F.pmod(F.xxhash64("rep", F.lit(salt)), F.ceil(F.col("members") / CELL))
    dealt = buckets.select("key", cell.alias("cell"), "rep", "component")
    least = dealt.groupBy("key", "cell").agg(F.min(F.struct(F.col("rep").alias("a"), F.col("component").alias("of"))).alias("least"))
    return (dealt.join(least, ["key", "cell"]).where("rep <> least.a and component <> least.of")
            .select(F.col("least.a").alias("a"), F.col("rep").alias("b")).distinct())


def _likeliest(alike: DataFrame) -> DataFrame:
    """For each ``b``, the ``a`` of the most equal sketch bytes; there are at most as many to choose from as bands."""
    best = alike.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("same", "a")), asc=False), 1, LIKELIEST).alias("best"))
    return best.select("b", F.explode("best.a").alias("a")).select("a", "b")


def _across(open_: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, width: int, percent: int) -> DataFrame:
    """Links between the components of each bucket, as a staged table ``a, b`` of components.

    A bucket is one group, or pairs of blocks that are one group each, so a group is bounded; its pairs are compared where
    they are and never become rows.
    """
    least = _least_equal(width, percent)
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = open_.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    held = _sets(docs, open_.select(F.col("rep").alias("doc_id")), words)
    rows = (dealt.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "rep", "component")
            .join(nodes.select(F.col("doc_id").alias("rep"), "n", "sketch"), "rep").join(held.withColumnRenamed("doc_id", "rep"), "rep"))

    def compare(table: pa.Table) -> pa.Table:
        of, n = table.column("component").to_numpy(), table.column("n").to_numpy()
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, width)
        items = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        left, right = [], []
        for k in range(1, len(of)):
            fit = np.flatnonzero((of[:k] != of[k]) & (100 * np.minimum(n[:k], n[k]) >= percent * np.maximum(n[:k], n[k])))
            fit = fit[(sketch[fit] == sketch[k]).sum(axis=1) >= least]
            left.append(np.full(len(fit), k))
            right.append(fit)
        left, right = (np.concatenate(x) if x else np.empty(0, int) for x in (left, right))
        common = _common_of_pairs(items, left, right)
        near = 100 * common >= percent * (n[left] + n[right] - common)
        found = np.unique(np.stack([of[left[near]], of[right[near]]], axis=1), axis=0)
        return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    return stage(rows.groupBy("key", "p", "q").applyInArrow(compare, "a bigint, b bigint").distinct(), "links")


def _common_of_pairs(items: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of many pairs of few sets: by products of membership matrices where that is less work."""
    if len(left) < 8 * len(items):
        return np.array([_common(items[a], items[b]) for a, b in zip(left.tolist(), right.tolist())], np.int64)
    used = np.unique(np.concatenate([left, right]))
    place = np.zeros(len(items), int)
    place[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(used)), [len(items[k]) for k in used])
    _, column, times = np.unique(np.concatenate([items[k] for k in used]), return_inverse=True, return_counts=True)
    shared = times[column] > 1  # others are in no intersection
    _, column = np.unique(column[shared], return_inverse=True)
    owner, order = owner[shared], np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(used), len(used)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        x, y = np.searchsorted(column, [a, a + COLUMNS])
        part = np.zeros((len(used), COLUMNS), np.float32)
        part[owner[x:y], column[x:y] - a] = 1
        total += part @ part.T
    return total[place[left], place[right]].astype(np.int64)


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Groups of documents linked by ``100 * intersection >= percent * union`` of their sets of ``words``-word shingles.

    Returns ``doc_id, n_shingles, component_id, kept`` for each row of ``docs``: the smallest id reachable over links, and
    whether that is the document itself.  A text of fewer words is one shingle; null, empty and blank texts have none and
    link with nothing; rows with equal text are linked; a null id has no component and is not kept.  Rows that share an
    id are one document with several texts.  Other columns are ignored.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    width = bands * rows
    signed = stage(_signed(docs, words, bands, rows), "signed")
    same = (signed.where("n > 0 and doc_id is not null").groupBy("high", "low")
            .agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")))
    # Only sets that occur more than once need their representative looked up.
    twins = stage(same.where("most > rep").select("high", "low", "rep"), "equal-sets")
    mapped = stage(signed.where("n > 0 and doc_id is not null").select("doc_id", "high", "low").join(twins, ["high", "low"])
                   .where("doc_id > rep").select("doc_id", "rep").distinct(), "copies")
    nodes = stage(signed.where("n > 0 and doc_id is not null").join(mapped, "doc_id", "left_anti")
                  .select("doc_id", "n", "sketch", "keys"), "nodes")

    rows_of = nodes.select(F.col("doc_id").alias("rep"), "n", F.explode("keys").alias("key"))
    shared = rows_of.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).where("members > 1")
    multi = stage(rows_of.drop("n").join(shared, "key"), "buckets")
    open_, links = multi.withColumn("component", F.col("rep")), None
    for salt in range(ROUNDS):
        found = _verified(_likeliest(_alike(_leaders(open_, salt), nodes, width, percent)), docs, words, percent)
        links = found if links is None else links.union(found)
        open_ = _open(multi, components(links, rounds=2))
    links = links.union(_across(open_, docs, nodes, words, width, percent))
    # Copies join their representative here, so that one id with several texts connects them all.
    joined = components(links.union(mapped.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    return (signed.select("doc_id", F.col("n").alias("n_shingles")).join(joined, F.col("doc_id") == F.col("node"), "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
                    F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(False)).alias("kept")))


def keep_one_of_each(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that are not the smallest of their group; a row without id stays."""
    found = near_duplicates(docs, id=id, text=text, **options)
    gone, seen = stage_observed(found.where("doc_id is not null and not kept").select("doc_id").distinct(), "near-copies", n=F.count(F.lit(1)))
    return with_ids(docs, gone, seen["n"], "left_anti", id).select(docs.columns)
