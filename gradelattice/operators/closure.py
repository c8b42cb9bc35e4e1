"""Closure operators over a context, for the modal and the residuated calculus.

What a closure needs of the objects is first shrunk on the cluster: distinct
up-set masks (modal) or distinct grade rows (residuated), both pre-aggregated
map-side.  Two exact ways to apply it follow:

* resident: the shrunk rows pass a size check, are broadcast, and candidate sets
  are closed where they are (residuated: each distinct one once);
* streamed: there are more rows, but a bounded number of candidates: they are
  staged, every task of the rows reads them and folds its rows into one partial
  closure per candidate, and only those move;
* fragmented: rows and candidates are hashed into blocks of bounded size, each
  pair of blocks is one task giving one partial closure per candidate.

Partial closures are combined (AND or MIN) per candidate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gradelattice.functions import kernels, masks
from gradelattice.functions.fuzzy import Implication, Rounding
from gradelattice.operators.context import Context
from gradelattice.session import Observation, ship_package, stage, stage_path, staged_batches

RESIDENT_BYTES = 64 << 20   # largest broadcast of shrunk rows
BLOCK_ROWS = 1 << 15        # rows of either side in one fragment
STREAM_SETS = 1 << 18       # candidates that a task of the rows holds with their partial closures
PRUNE_PIVOTS = 2048         # smallest masks used to drop implied ones
LEAST_WORK = 1 << 22        # pairs of a candidate and a row that are worth a task
SMALL_SETS = 1 << 16        # closed candidates that are broadcast to those that asked


def stage_bounded(frame: DataFrame, label: str, max_rows: int) -> tuple[DataFrame, pa.Table | None]:
    """(``frame`` staged, None), or (``frame``, its rows) when there are at most ``max_rows``.

    The rows are cached where they are and counted first, so a frame that is too
    large is never funnelled through one task or the driver to find that out.
    """
    cached = frame.persist()
    try:
        if cached.count() <= max_rows:
            return frame, cached.toArrow()
        return stage(cached, label), None
    finally:
        cached.unpersist()


def map_batches(frame: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one record batch giving record batches."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
    ship_package(frame.sparkSession)
    return frame.mapInArrow(run, schema)


def fragment_join(left: DataFrame, right: DataFrame, fn, schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Run ``fn(left block, right block)`` for every pair of hashed blocks.

    Rows on both sides must be distinct; hashing whole rows then keeps every
    block near ``block_rows``, so no task grows with the data or with a hot key.
    """
    p = max(1, math.ceil(left.count() / block_rows))
    q = max(1, math.ceil(right.count() / block_rows))
    def side(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        block = F.pmod(F.xxhash64(*df.columns), F.lit(n_own)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        return df.withColumn(own, block).withColumn(other, copies)
    l = side(left, "frag_l", p, "frag_r", q).groupBy("frag_l", "frag_r")
    r = side(right, "frag_r", q, "frag_l", p).groupBy("frag_l", "frag_r")
    ship_package(left.sparkSession)
    nothing = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        return fn(a, b) if a.num_rows and b.num_rows else nothing
    return l.cogroup(r).applyInArrow(cell, schema)


def _stage_distinct(sets: DataFrame, label: str) -> tuple[DataFrame, str, int]:
    """The distinct rows of ``sets`` staged, where they are, and how many."""
    path, seen, distinct = stage_path(sets.sparkSession, label), Observation(), sets.distinct()
    distinct.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return sets.sparkSession.read.schema(distinct.schema).parquet(path), path, seen.get["n"] or 0


def fold_rows(rows: DataFrame, path: str, load, start, fold, emit, schema: str) -> DataFrame:
    """Per task of ``rows``: ``start(candidates)``, ``fold`` for every batch of rows, then ``emit`` the partial closures.

    The candidates are read from their table; the rows stay where they are.
    """
    def run(batches):
        held = [load(b) for b in staged_batches([path], 1 << 14) if b.num_rows]
        if not held:
            return
        sets = np.concatenate(held)
        partial = start(sets)
        for batch in batches:
            if batch.num_rows:
                fold(partial, sets, batch)
        yield emit(sets, partial)
    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def ddl(frame: DataFrame, cols: list[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    return ", ".join(f"`{c}` {types[c]}" for c in cols)


# ---------------------------------------------------------------- modal


def modal_rows(ctx: Context) -> DataFrame:
    """Distinct (need mask -> attrs mask): attribute a of ``attrs`` is in cl(B) only if B meets ``need``.

    One candidate row per distinct positive level of an object: ``need`` holds the
    attributes graded at least that level, ``attrs`` those graded exactly so.
    """
    m = ctx.m
    need, attr = masks.mask_cols(m, "need"), masks.mask_cols(m, "attrs")
    positive = F.array_distinct(F.filter("grades", lambda g: g > 0))
    per_level = ctx.frame.select("grades", F.explode(positive).alias("level"))
    grades, level = F.col("grades"), F.col("level")
    rows = per_level.select(*masks.mask_where(grades, m, lambda g: g >= level, "need"),
                            *masks.mask_where(grades, m, lambda g: g == level, "attrs"))
    return rows.groupBy(*need).agg(*[F.bit_or(a).alias(a) for a in attr])


def _prune(table: tuple[np.ndarray, np.ndarray], pivots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Attributes each row still has to guard: not those guarded by a strictly smaller need mask."""
    need, attrs = table
    guarded = np.zeros_like(attrs)
    p_need, p_attrs = pivots
    for part in kernels.chunks(len(need), len(p_need)):
        inside = np.ones((part.stop - part.start, len(p_need)), bool)
        same = inside.copy()
        for w in range(need.shape[1]):
            inside &= (p_need[None, :, w] & ~need[part, None, w]) == 0
            same &= p_need[None, :, w] == need[part, None, w]
        inside &= ~same
        for w in range(need.shape[1]):
            guarded[part, w] = np.bitwise_or.reduce(np.where(inside, p_attrs[None, :, w], 0), axis=1)
    return attrs & ~guarded


@dataclass
class ModalClosure:
    """cl(B) = attributes whose grade never exceeds the largest grade over B, for any object."""

    ctx: Context
    resident_bytes: int = RESIDENT_BYTES
    block_rows: int = BLOCK_ROWS
    stream_sets: int = STREAM_SETS

    @property
    def _spark(self):
        return self.ctx.frame.sparkSession

    @property
    def m(self) -> int:
        return self.ctx.m

    @property
    def cols(self) -> list[str]:
        return masks.mask_cols(self.m)

    @cached_property
    def _need_cols(self) -> tuple[list[str], list[str]]:
        return masks.mask_cols(self.m, "need"), masks.mask_cols(self.m, "attrs")

    @cached_property
    def _prepared(self):
        need, attr = self._need_cols
        max_rows = self.resident_bytes // (16 * len(need))
        rows, table = stage_bounded(modal_rows(self.ctx), "modal-rows", min(PRUNE_PIVOTS, max_rows))
        if table is not None:
            pair = (kernels.words_of(table, need), kernels.words_of(table, attr))
            left = _prune(pair, pair)
        else:
            rows, table = stage_bounded(self._prune_on_cluster(rows), "modal-pruned", max_rows)
            if table is None:
                return None, rows
            pair, left = (kernels.words_of(table, need),), kernels.words_of(table, attr)
        keep = left.any(axis=1)
        packed = (np.ascontiguousarray(pair[0][keep]), np.ascontiguousarray(left[keep]))
        return self._spark.sparkContext.broadcast(packed), None

    def _prune_on_cluster(self, rows: DataFrame) -> DataFrame:
        """Drop implied rows against the smallest need masks (a bounded top-k); exact for any pivots."""
        need, attr = self._need_cols
        size = masks.card([F.col(c) for c in need])
        top = rows.orderBy(size, *need).limit(PRUNE_PIVOTS).toArrow()
        pivots = self._spark.sparkContext.broadcast((kernels.words_of(top, need), kernels.words_of(top, attr)))
        def fn(batch):
            pair = (kernels.words_of(batch, need), kernels.words_of(batch, attr))
            left = _prune(pair, pivots.value)
            keep = left.any(axis=1)
            yield kernels.batch_of(kernels.word_dict(pair[0][keep], need) | kernels.word_dict(left[keep], attr))
        return map_batches(rows, fn, ddl(rows, need + attr))

    @property
    def broadcast(self):
        """Broadcast (need, attrs) word matrices, or None when they are too large."""
        return self._prepared[0]

    def close(self, sets: DataFrame, out: str = "closure") -> DataFrame:
        """Append the closure of each mask as ``out`` columns."""
        outs = masks.mask_cols(self.m, out)
        keep = [c for c in sets.columns]
        schema = ddl(sets, keep) + ", " + ", ".join(f"{c} bigint" for c in outs)
        cols, full = self.cols, masks.full_words(self.m)
        if self.broadcast is not None:
            bc = self.broadcast
            def fn(batch):
                closed = full & ~kernels.modal_open(kernels.words_of(batch, cols), *bc.value)
                yield kernels.batch_of({c: batch.column(i) for i, c in enumerate(keep)} | kernels.word_dict(closed, outs))
            return map_batches(sets, fn, schema)
        need, attr = self._need_cols
        def fn(left, right):
            opened = kernels.modal_open(kernels.words_of(left, cols), kernels.words_of(right, need),
                                        kernels.words_of(right, attr))
            for c, col in kernels.word_dict(opened, outs).items():
                left = left.append_column(c, pa.array(col))
            return left.select(keep + outs)
        distinct, path, n = _stage_distinct(sets.select(*cols), "candidate-sets")
        part_schema = ddl(sets, cols) + ", " + ", ".join(f"{c} bigint" for c in outs)
        keep_outer, keep = keep, cols
        if n <= self.stream_sets:
            def fold(opened, held, batch):
                opened |= kernels.modal_open(held, kernels.words_of(batch, need), kernels.words_of(batch, attr))
            def emit(held, opened):
                some = opened.any(axis=1)
                return kernels.batch_of(kernels.word_dict(held[some], cols) | kernels.word_dict(opened[some], outs))
            parts = fold_rows(self._prepared[1], path, lambda b: kernels.words_of(b, cols), np.zeros_like, fold, emit, part_schema)
        else:
            parts = fragment_join(distinct, self._prepared[1], fn, part_schema, self.block_rows)
        opened = parts.groupBy(*cols).agg(*[F.bit_or(c).alias(c) for c in outs])
        closed = opened.select(*cols, *[F.lit(int(f)).bitwiseAND(F.bitwise_not(F.col(c))).alias(c)
                                        for f, c in zip(full, outs)])
        # no rows at all: nothing keeps any attribute out
        joined = sets.join(closed, cols, "left")
        return joined.select(*keep_outer, *[F.coalesce(F.col(c), F.lit(int(f))).alias(c) for f, c in zip(full, outs)])


# ---------------------------------------------------------------- residuated


@dataclass
class FuzzyClosure:
    """cl(Y) = up(down(Y)) on integer levels, with derivations kept on the grid."""

    ctx: Context
    kind: Implication = Implication.LUKASIEWICZ
    rounding: Rounding = Rounding.FLOOR
    resident_bytes: int = RESIDENT_BYTES
    block_rows: int = BLOCK_ROWS
    stream_sets: int = STREAM_SETS

    def __post_init__(self):
        if self.rounding is Rounding.NONE:
            raise ValueError("closures on the level grid need rounding 'floor' or 'nearest'")

    @property
    def m(self) -> int:
        return self.ctx.m

    @property
    def scale(self) -> int:
        return self.ctx.scale

    @cached_property
    def table(self) -> np.ndarray:
        return kernels.implication_table(self.kind.value, self.scale, self.rounding.value)

    @cached_property
    def _prepared(self):
        distinct = self.ctx.frame.select("grades").distinct()
        rows, table = stage_bounded(distinct, "grade-rows", self.resident_bytes // (2 * self.m))
        if table is None:
            return None, rows
        levels = kernels.grades_of(table, "grades", self.m)
        return self.ctx.frame.sparkSession.sparkContext.broadcast((levels, self.table)), None

    @property
    def broadcast(self):
        return self._prepared[0]

    def close(self, sets: DataFrame, out: str = "closure", distinct: bool = False) -> DataFrame:
        """Append the closure of each ``grades`` array as ARRAY<INT> ``out``.

        Each distinct array is closed once, unless the caller knows that they are ``distinct`` already.
        """
        keep, m = list(sets.columns), self.m
        if self.broadcast is not None and not distinct:
            once, _, n = _stage_distinct(sets.select("grades"), "candidate-intents")
            tasks = max(1, min(n, n * len(self.broadcast.value[0]) // LEAST_WORK))
            closed = stage(self.close(once.repartition(tasks), out, distinct=True), "closed-intents")
            return sets.join(F.broadcast(closed) if n <= SMALL_SETS else closed, "grades", "left").select(*keep, out)
        if self.broadcast is not None:
            bc = self.broadcast
            def fn(batch):
                closed = kernels.fuzzy_close(kernels.grades_of(batch, "grades", m), *bc.value)
                yield kernels.batch_of({c: batch.column(i) for i, c in enumerate(keep)} | {out: kernels.grades_array(closed)})
            return map_batches(sets, fn, ddl(sets, keep) + f", {out} array<int>")
        table = self.table
        def fn(left, right):
            closed = kernels.fuzzy_close(kernels.grades_of(left, "grades", m), kernels.grades_of(right, "grades", m), table)
            return left.select(["grades"]).append_column(out, kernels.grades_array(closed))
        once, path, n = _stage_distinct(sets.select("grades"), "candidate-intents")
        schema = f"grades array<int>, {out} array<int>"
        if n <= self.stream_sets:
            scale = self.scale
            def fold(closed, held, batch):
                np.minimum(closed, kernels.fuzzy_close(held, kernels.grades_of(batch, "grades", m), table), out=closed)
            def emit(held, closed):
                return kernels.batch_of({"grades": kernels.grades_array(held), out: kernels.grades_array(closed)})
            parts = fold_rows(self._prepared[1], path, lambda b: kernels.grades_of(b, "grades", m), lambda held: np.full_like(held, scale), fold, emit, schema)
        else:
            parts = fragment_join(once, self._prepared[1], fn, schema, self.block_rows)
        mins = parts.groupBy("grades").agg(*[F.min(F.col(out)[j]).alias(f"c{j}") for j in range(m)])
        closed = mins.select("grades", F.array(*[f"c{j}" for j in range(m)]).alias(out))
        top = F.array_repeat(F.lit(self.scale), m)
        return sets.join(closed, "grades", "left").select(*keep, F.coalesce(out, top).alias(out))
