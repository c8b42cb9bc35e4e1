"""Vertical bitmap index over level vectors, for dominance look-ups.

The index is a table of segments of at most ``SEGMENT`` vectors.  A segment holds, for each attribute and level, the packed
list of its vectors that reach the level.  The vectors above a given one are the AND of one list per attribute; those below
are the AND of the complements one level higher.  Segments are appended and never rewritten.  A task holds some of the
vectors asked for and streams the segments past them, skipping those whose largest (or smallest) grades rule them out; no
two tables are joined and no pair of vectors is compared to find who lies above whom.  Equal vectors are asked once, and
their answers then joined to all that ask.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelattice.functions import kernels
from gradelattice.operators.closure import SMALL_SETS, ddl
from gradelattice.session import ship_package, stage_observed, stage_path, staged_batches

SEGMENT = 1 << 16
ASKED = 1 << 12         # vectors that a task holds while segments pass
LEAST_WORK = 1 << 26    # pairs of vectors that are worth a task
ANSWER_WORK = 1 << 24   # the same, where many of the pairs are answers
TASK_ROWS = 1 << 23     # rows of a look-up that one task hands out


class Segment:
    """One row of the index, unpacked."""

    def __init__(self, row: dict, m: int, scale: int):
        self.n, self.epoch = row["n"], row["epoch"]
        self.cells = np.frombuffer(row["cells"], np.int16).reshape(self.n, m)
        width = -(-self.n // 8)
        lists = np.frombuffer(b"".join(row["lists"]), np.uint8).reshape(m, scale, width)
        everyone = np.packbits(np.ones(self.n, bool))
        self.reach = np.concatenate([np.broadcast_to(everyone, (m, 1, width)), lists, np.zeros((m, 1, width), np.uint8)], axis=1)
        self.most, self.least, self.everyone = self.cells.max(axis=0), self.cells.min(axis=0), everyone

    def above(self, vectors: np.ndarray) -> np.ndarray:
        """Packed bits, a row for each vector: who is at least as large everywhere."""
        out = self.reach[0, vectors[:, 0]].copy()
        for j in range(1, vectors.shape[1]):
            out &= self.reach[j, vectors[:, j]]
        return out

    def below(self, vectors: np.ndarray) -> np.ndarray:
        out = np.broadcast_to(self.everyone, (len(vectors), len(self.everyone))).copy()
        for j in range(vectors.shape[1]):
            out &= ~self.reach[j, vectors[:, j] + 1]
        return out

    def hits(self, vectors: np.ndarray, upward: bool, strict: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of ``vectors``, position here) of all that lie above (or below), by ascending row."""
        fit = (vectors <= self.most).all(axis=1) if upward else (vectors >= self.least).all(axis=1)
        rows = np.flatnonzero(fit)
        for part in kernels.chunks(len(rows), 8 * len(self.everyone)):
            asked = vectors[rows[part]]
            bits = self.above(asked) if upward else self.below(asked)
            row, at = np.nonzero(np.unpackbits(bits, axis=1, count=self.n))
            if strict:
                other = (self.cells[at] != asked[row]).any(axis=1)
                row, at = row[other], at[other]
            if len(row):
                yield rows[part][row], at


def pack_segments(batches: Iterable[pa.RecordBatch], m: int, scale: int, epoch: int, rows: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """Rows of the index for the vectors of a task, in the order they come."""
    def packed(cells: np.ndarray) -> pa.RecordBatch:
        lists = [np.packbits(cells[:, j] >= level).tobytes() for j in range(m) for level in range(1, scale + 1)]
        return pa.RecordBatch.from_arrays([pa.array([epoch], pa.int32()), pa.array([len(cells)], pa.int32()),
                                           pa.array([cells.tobytes()], pa.binary()), pa.array([lists], pa.list_(pa.binary()))],
                                          names=["epoch", "n", "cells", "lists"])
    held, n = [], 0
    for batch in batches:
        cells = kernels.grades_of(batch, "grades", m)
        while len(cells):
            held.append(cells[:rows - n])
            n, cells = n + len(held[-1]), cells[len(held[-1]):]
            if n == rows:
                yield packed(np.concatenate(held))
                held, n = [], 0
    if n:
        yield packed(np.concatenate(held))


def minimal(vectors: np.ndarray) -> np.ndarray:
    """Positions of the minimal ones of distinct vectors, by ascending sum: equal sums never dominate each other."""
    sums = vectors.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    kept = order[:0]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), np.diff(sums[order]) != 0]))
    for a, b in zip(starts, np.append(starts[1:], len(order))):
        group = order[a:b]
        if len(kept):
            free = np.ones(len(group), bool)
            for part in kernels.chunks(len(kept), len(group) * vectors.shape[1]):
                free &= ~(vectors[kept[part]][None] <= vectors[group][:, None]).all(axis=2).any(axis=1)
            group = group[free]
        kept = np.concatenate([kept, group])
    return kept


class DominanceIndex:
    """Segments of vectors of ``m`` levels 0..``scale`` in tables that are only added to."""

    def __init__(self, spark: SparkSession, m: int, scale: int, paths: list[str] | None = None):
        self.spark, self.m, self.scale, self.paths = spark, m, scale, list(paths or [])

    def append(self, rows: DataFrame, count: int, path: str | None = None, epoch: int = 0, segment: int = SEGMENT) -> str:
        """Add the ``grades`` of ``rows`` (staged, ``count`` of them) as a table of segments of similar size sums."""
        path, m, scale = path or stage_path(self.spark, "dominance"), self.m, self.scale
        ship_package(self.spark)
        parts = max(1, -(-count // segment))
        total = F.aggregate("grades", F.lit(0), lambda x, y: x + y)
        order = [total, F.col("grades")]
        spread = rows.select("grades").repartitionByRange(parts, *order) if parts > 1 else rows.select("grades").coalesce(1)
        (spread.sortWithinPartitions(*order).mapInArrow(lambda b: pack_segments(b, m, scale, epoch, segment), "epoch int, n int, cells binary, lists array<binary>")
         .write.mode("overwrite").parquet(path))
        self.paths.append(path)
        return path

    def _asked(self, vectors: DataFrame, fn, schema: str, count: int, size: int, least: int = LEAST_WORK) -> DataFrame:
        """``fn(batch, grades, segments)`` for the vectors of each task; ``segments()`` streams the index anew."""
        paths, m, scale = self.paths, self.m, self.scale
        ship_package(self.spark)
        def segments() -> Iterator[Segment]:
            for batch in staged_batches(paths, 4):
                for row in batch.to_pylist():
                    yield Segment(row, m, scale)
        def run(batches):
            for whole in batches:
                for a in range(0, whole.num_rows, ASKED):
                    batch = whole.slice(a, ASKED)
                    yield from fn(batch, kernels.grades_of(batch, "grades", m), segments)
        tasks = max(1, min(-(-count // 64), count * max(1, size) // least))
        return (vectors.repartition(tasks) if tasks > 1 else vectors.coalesce(1)).mapInArrow(run, schema)

    def lookup(self, vectors: DataFrame, count: int, size: int, *, upward: bool = True, strict: bool = True, out: str = "found",
               of: Callable[[Column], Column] | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
        """A row for each vector asked for and each indexed one above it (or below), whose grades, or ``of`` them, are ``out``.

        ``of`` is evaluated once for the answers to all equal vectors.  The rows that each task hands out are bounded by
        ``task_rows``: the answers are counted first, and those to the most frequent vectors spread.  ``count`` and ``size``,
        the numbers of vectors asked for and indexed, only decide how many tasks look.
        """
        keep = [c for c in vectors.columns if c != out]
        once = vectors.groupBy("grades").agg(F.count(F.lit(1)).alias("_times")).withColumn("_asked", F.monotonically_increasing_id())
        once, seen = stage_observed(once, "asked-once", n=F.count(F.lit(1)))
        def fn(batch, asked, segments):
            for segment in segments():
                for row, at in segment.hits(asked, upward, strict):
                    some = batch.take(pa.array(row))
                    yield kernels.batch_of({c: some.column(c) for c in ("_asked", "_times")} | {out: kernels.grades_array(segment.cells[at])})
        found = self._asked(once, fn, f"_asked bigint, _times bigint, {out} array<int>", min(count, seen["n"]), size, ANSWER_WORK)
        answers, given = stage_observed(found.withColumn(out, of(F.col(out))) if of else found, "answers", rows=F.sum("_times"))
        asking = vectors.select(*keep).join(F.broadcast(once) if seen["n"] <= SMALL_SETS else once, "grades").select(*keep, "_asked")
        on, tasks = ["_asked"], -(-(given["rows"] or 0) // task_rows)
        if tasks > 1:
            most = answers.groupBy("_asked").agg(F.sum("_times").alias("rows")).agg(F.max("rows")).first()[0]
            shares = -(-most // task_rows)
            if shares > 1:
                on = ["_asked", "_share"]
                answers = answers.withColumn("_share", F.pmod(F.xxhash64(out), F.lit(shares)).cast("int"))
                asking = asking.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
            answers, asking = answers.repartition(tasks, *on), asking.repartition(tasks, *on)
        return answers.drop("_times").join(asking, on).select(*keep, out)

    def missing(self, vectors: DataFrame, count: int, size: int) -> DataFrame:
        """The vectors asked for that the index does not hold."""
        keep = list(vectors.columns)
        def fn(batch, asked, segments):
            absent = np.ones(len(asked), bool)
            for segment in segments():
                for row, at in segment.hits(asked, True, strict=False):
                    same = (segment.cells[at] == asked[row]).all(axis=1)
                    absent[row[same]] = False
            yield batch.filter(pa.array(absent))
        return self._asked(vectors, fn, ddl(vectors, keep), count, size)

    def neighbours(self, vectors: DataFrame, count: int, size: int, epoch: int) -> DataFrame:
        """(kind, grades, sup_grades) for the vectors added at ``epoch``: cover edges at them, and pairs they come between.

        Kind 0 are the edges to the minimal vectors above one asked for and from the maximal ones below; an edge between two
        new vectors comes once.  Kind 1 are the pairs of older vectors, one below and one above, that are no edge any more.
        """
        m = self.m
        def fn(batch, asked, segments):
            nothing = np.empty((0, m), np.int16)
            # by direction: the nearest of all, the nearest of the older ones
            near = {(upward, older): [nothing] * len(asked) for upward in (True, False) for older in (True, False)}
            def keep(upward: bool, older: bool, k: int, found: np.ndarray) -> None:
                both = np.concatenate([near[upward, older][k], found])
                near[upward, older][k] = both[minimal(both if upward else -both)]
            for segment in segments():
                for upward in (True, False):
                    for row, at in segment.hits(asked, upward):
                        starts = np.flatnonzero(np.diff(row, prepend=-1))
                        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(row)]):
                            keep(upward, False, row[a], segment.cells[at[a:b]])
                            if segment.epoch != epoch:
                                keep(upward, True, row[a], segment.cells[at[a:b]])
            edges, between = [], []
            for k, vector in enumerate(asked):
                up, down, old_up, old_down = near[True, False][k], near[False, False][k], near[True, True][k], near[False, True][k]
                if len(old_up) and len(old_down):
                    between.append(np.concatenate([np.repeat(old_down, len(old_up), axis=0), np.tile(old_up, (len(old_down), 1))], axis=1))
                if len(down):  # an edge from a new vector comes with that one
                    down = down[(down[:, None] == old_down[None]).all(axis=2).any(axis=1)]
                edges.append(np.concatenate([np.broadcast_to(vector, (len(up), m)), up], axis=1))
                edges.append(np.concatenate([down, np.broadcast_to(vector, (len(down), m))], axis=1))
            for kind, parts in ((0, edges), (1, between)):
                pairs = np.concatenate(parts) if parts else np.empty((0, 2 * m), np.int16)
                yield kernels.batch_of({"kind": np.full(len(pairs), kind, np.int32), "grades": kernels.grades_array(pairs[:, :m]),
                                        "sup_grades": kernels.grades_array(pairs[:, m:])})
        return self._asked(vectors.select("grades"), fn, "kind int, grades array<int>, sup_grades array<int>", count, size)
