"""Compression of integer vectors to short codes: per part a codebook, searched with fixed pivots (LAESA).

Every component becomes ``floor(scale * x)`` and every vector is cut into equal parts.  Each part position has a few fixed
pivots; the distances of all parts to them are computed once and staged with the vectors.  A round computes only the
distances from its codebook entries to the pivots: by the triangle inequality the difference of the two distances to a
pivot never exceeds the true distance, so the largest difference is a lower bound.  The entry of the lowest bound is
evaluated first, exactly and in integers, and only entries whose bound does not exceed that distance follow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradelattice.session import ship_package, stage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
PIVOTS = 4
CHUNK = 2048  # vectors compared at once
SLACK = 4e-7  # of single-precision distances: their rounding, relative to their size
WIDEST = 1 << 27  # components from this size on would not leave exact 64-bit distances


@dataclass
class Codes:
    """``vectors``: the kept rows with ``code`` and ``error``; ``codebooks``: (part, entry, position), the final integers."""

    vectors: DataFrame
    codebooks: np.ndarray

    @property
    def sha256(self) -> str:
        """Of all entries' decimal integers by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def usable(embedding: str) -> Column:
    """Neither null nor with a null or non-finite component."""
    fit = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(embedding).isNotNull() & F.coalesce(fit, F.lit(False))


def integers(rows: np.ndarray, scale: int = SCALE) -> np.ndarray:
    cells = np.floor(scale * rows.astype(np.float64))
    if cells.size and np.abs(cells).max() >= WIDEST:
        raise ValueError(f"components of {WIDEST // scale} or more are too large for exact distances")
    return cells.astype(np.int64)


def choose_pivots(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """(part, pivot, position): entries far apart from each other, the first one first."""
    chosen = []
    for part in entries:
        at, nearest = [0], None
        while len(at) < count:
            d = ((part - part[at[-1]]) ** 2).sum(axis=1)
            nearest = d if nearest is None else np.minimum(nearest, d)
            at.append(int(nearest.argmax()))
        chosen.append(part[at])
    return np.array(chosen)


def pivot_distances(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(row, part, pivot) distances, in single precision; ``parts`` is (row, part, position)."""
    d = parts[:, :, None, :] - pivots[None]
    return np.sqrt((d * d).sum(axis=3)).astype(np.float32)


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, entry_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of one part position: nearest entry, the lower index of equals, its squared distance; and how many were evaluated."""
    bound = np.abs(to_pivots[:, :1] - entry_pivots[None, :, 0])
    for p in range(1, entry_pivots.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, p:p + 1] - entry_pivots[None, :, p]), out=bound)
    d = parts - entries[bound.argmin(axis=1)]
    first = np.sqrt((d * d).sum(axis=1))
    slack = SLACK * (to_pivots.max(axis=1) + entry_pivots.max()) + 1e-12
    row, entry = np.nonzero(bound <= (first + slack).astype(np.float32)[:, None] * np.float32(1 + 1e-6))
    d = parts[row] - entries[entry]
    exact = (d * d).sum(axis=1)
    starts = np.flatnonzero(np.diff(row, prepend=-1))  # every row keeps its first entry at least
    least = np.minimum.reduceat(exact, starts)
    hits = np.flatnonzero(exact == least[row])
    hits = hits[np.flatnonzero(np.diff(row[hits], prepend=-1))]
    return entry[hits], least, len(row) + len(parts)


def assign(parts: np.ndarray, to_pivots: np.ndarray, codebooks: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, part) entries and squared distances."""
    count = parts.shape[1]
    code, error = np.empty((len(parts), count), np.int64), np.empty((len(parts), count), np.int64)
    for p in range(count):
        d = codebooks[p][:, None, :] - pivots[p][None]
        entry_pivots = np.sqrt((d * d).sum(axis=2)).astype(np.float32)
        code[:, p], error[:, p], _ = nearest(parts[:, p], to_pivots[:, p], codebooks[p], entry_pivots)
    return code, error


def _unpack(batch: pa.RecordBatch, shape: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    cells, distances = batch.column("_cells").to_pylist(), batch.column("_pivots").to_pylist()
    for a in range(0, len(cells), CHUNK):
        some = cells[a:a + CHUNK]
        wide = np.frombuffer(b"".join(some), np.int32)
        yield (wide.astype(np.int64).reshape(len(some), *shape),
               np.frombuffer(b"".join(distances[a:a + CHUNK]), np.float32).reshape(len(some), shape[0], -1))


def compress(vectors: DataFrame, *, id: str = "vec_id", embedding: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS, pivots: int = PIVOTS, scale: int = SCALE) -> Codes:
    """Codebooks and codes of ``vectors``.

    A null vector and one with a null or non-finite component is dropped, as is one of another length than the first kept
    row has; a length that ``parts`` does not divide is an error.  Codebooks start as the parts of the ``entries`` rows of
    the smallest ids (nulls first; of rows that share an id, the smaller vector first), fewer if there are fewer; each
    round assigns all parts and replaces every used entry by the floor of its parts' mean.  ``code`` has two hex digits for
    each part, ``error`` the sum of squared distances.  Repeated rows are all coded.  An empty table gives no rows.
    Columns named ``code`` or ``error`` are replaced, all others but the vector are kept.

    Besides rows, tasks send only sums by part and entry.  To the driver come the first ``entries`` rows and these sums.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name 256 entries at most")
    spark = vectors.sparkSession
    ship_package(spark)
    source = vectors.where(usable(embedding)).drop(*{"code", "error", "_cells", "_pivots"} - {embedding, id})
    order = [F.col(id).asc_nulls_first(), F.col(embedding)]
    first = [r[0] for r in source.orderBy(*order).limit(entries).select(embedding).collect()]
    kept = [f for f in source.schema.fields if f.name != embedding]
    names = [f.name for f in kept]
    coded = T.StructType([*kept, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not first:
        return Codes(spark.createDataFrame([], coded), np.zeros((parts, 0, 0), np.int64))
    length = len(first[0])
    if length % parts:
        raise ValueError(f"vectors of {length} components have no {parts} equal parts")
    first = [v for v in first if len(v) == length]
    source = source.where(F.size(embedding) == length)
    if len(first) < entries:  # rows of another length stood among them
        first = [r[0] for r in source.orderBy(*order).limit(entries).select(embedding).collect()]
    shape = (parts, length // parts)
    books = integers(np.array(first, np.float64), scale).reshape(-1, *shape).transpose(1, 0, 2)
    fixed = choose_pivots(books, pivots)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(a, CHUNK)
                rows = batch.column(embedding).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, length)
                cells = integers(rows, scale)
                far = pivot_distances(cells.reshape(-1, *shape), fixed)
                columns = [batch.column(c) for c in names]
                columns += [pa.array([c.tobytes() for c in cells.astype(np.int32)], pa.binary()), pa.array([f.tobytes() for f in far], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "_cells", "_pivots"])

    measured = T.StructType([*kept, T.StructField("_cells", T.BinaryType()), T.StructField("_pivots", T.BinaryType())])
    table = stage(source.select(*names, embedding).mapInArrow(measure, measured), "pivot-distances")
    for _ in range(rounds):
        books = _means(table.select("_cells", "_pivots"), books, fixed, shape)
    final = books

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for cells, far in _unpack(batch, shape):
                found, error = assign(cells, far, final, fixed)
                some = batch.slice(at, len(cells))
                at += len(cells)
                columns = [*[some.column(c) for c in names], pa.array([c.tobytes().hex() for c in found.astype(np.uint8)], pa.string()), pa.array(error.sum(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, names=coded.names)

    return Codes(stage(table.mapInArrow(code, coded), "codes"), books)


def _means(table: DataFrame, books: np.ndarray, fixed: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Codebooks after one round."""
    parts, width = shape
    count = books.shape[1]
    cols = [f"s{k}" for k in range(width)]

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, count, width), np.int64), np.zeros((parts, count), np.int64)
        for batch in batches:
            for cells, far in _unpack(batch, shape):
                found, _ = assign(cells, far, books, fixed)
                for p in range(parts):
                    np.add.at(total[p], found[:, p], cells[:, p])
                    n[p] += np.bincount(found[:, p], minlength=count)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]),
                                          *[pa.array(total[p, e, k]) for k in range(width)]], names=["part", "entry", "n", *cols])

    schema = ", ".join(["part int", "entry int", "n bigint", *[f"{c} bigint" for c in cols]])
    summed = table.mapInArrow(sums, schema).groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in cols])
    out = books.copy()
    for row in summed.collect():  # a row for each used entry of the codebooks
        out[row["part"], row["entry"]] = [int(row[c]) // row["n"] for c in cols]
    return out


def with_label_error(codes: Codes, *, label: str = "label") -> DataFrame:
    """The coded rows with ``label_error``, the error summed over rows of an equal label (nulls together), and ``codebooks_sha256``."""
    coded = codes.vectors.drop("label_error", "codebooks_sha256")
    total = coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(total, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")
    return joined.withColumn("codebooks_sha256", F.lit(codes.sha256))
