"""Containment joins and the cover (Hasse) relation.

Fuzzy dominance is containment too: a level vector becomes the set of
(attribute, level) steps it reaches, so one bit-mask operator serves both kinds.

For a complete closure system the upper covers of a set come from closing its
one-step enlargements; no two members are ever compared.  Any other family is
staged, in order of size once it is large; a task holds a block of sets and
streams the other side past it from the staged table, without what its sizes
rule out.  Neither the driver nor a broadcast nor a shuffle sees pairs, and what
a set needs of the family comes together in the task that holds it.
"""

from __future__ import annotations

import numpy as np
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelattice.functions import fuzzy, kernels, masks
from gradelattice.operators.closure import FuzzyClosure, ModalClosure, ddl, map_batches
from gradelattice.session import Observation, ship_package, stage, stage_path, staged_batches

BLOCK_ROWS = 1 << 12    # sets that a task holds while the other side passes
STREAM_ROWS = 1 << 14   # sets of the other side compared at once
LEAST_WORK = 1 << 26    # pairs of sets that are worth a task
SORTED_ROWS = 1 << 18   # families from this size on are staged in order of size


def thermometer(grades: Column, m: int, scale: int, stem: str = "mask") -> list[Column]:
    """Masks over ``m * scale`` steps whose containment is pointwise <= of the grades."""
    return masks.mask_of([grades[j] >= level for j in range(m) for level in range(1, scale + 1)], stem)


def from_thermometer(cols: list[str], m: int, scale: int) -> Column:
    """The grades that ``thermometer`` made masks of."""
    words = [F.col(c) for c in cols]
    held = lambda j, level: masks.contains_attr(words, F.lit(j * scale + level), m * scale).cast("int")
    return F.array(*[sum((held(j, level) for level in range(1, scale)), held(j, 0)) for j in range(m)])


def _staged(family: DataFrame, cols: list[str], label: str) -> tuple[str, int]:
    """Path of a table of the sets with their sizes (``_card``), and how many there are."""
    spark = family.sparkSession
    sized, path, seen = family.select(*cols, masks.card([F.col(c) for c in cols]).alias("_card")), stage_path(spark, label), Observation()
    sized.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    n = seen.get["n"] or 0
    if n >= SORTED_ROWS:
        unsorted, path = spark.read.schema(sized.schema).parquet(path), stage_path(spark, label)
        unsorted.repartitionByRange(-(-n // SORTED_ROWS), "_card", *cols).sortWithinPartitions("_card", *cols).write.parquet(path)
    return path, n


def _against(held: DataFrame, other: DataFrame, cols: list[str], fn, schema: str, block_rows: int, upward: bool | None = True) -> DataFrame:
    """``fn(block, stream)`` for blocks of ``held``; ``stream()`` passes the words of ``other`` anew.

    With ``upward``, only sets of ``other`` at least as large as the smallest of the block come; if it is False, at most as
    large as the largest; all of them if it is None.
    """
    spark = held.sparkSession
    path, n_other = _staged(other, cols, "family")
    held_path, n_held = (path, n_other) if held is other else _staged(held, cols, "sets")
    def run(batches):
        for batch in batches:
            words = kernels.words_of(batch, cols)
            for a in range(0, len(words), block_rows):
                block = words[a:a + block_rows]
                sizes = kernels.popcount(block)
                near = None if upward is None else ds.field("_card") >= int(sizes.min()) if upward else ds.field("_card") <= int(sizes.max())
                def stream():
                    for part in staged_batches([path], STREAM_ROWS, near):
                        if part.num_rows:
                            yield kernels.words_of(part, cols)
                yield from fn(block, stream)
    tasks = max(1, min(-(-n_held // 64), n_held * n_other // LEAST_WORK))
    rows = spark.read.schema(", ".join(f"{c} bigint" for c in cols)).parquet(held_path)
    ship_package(spark)
    return (rows.repartition(tasks) if tasks > 1 else rows.coalesce(1)).mapInArrow(run, schema)


def _contained(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix: is row i of ``a`` contained in row k of ``b``?"""
    inside = (a[:, None, 0] & ~b[None, :, 0]) == 0
    for w in range(1, a.shape[1]):
        inside &= (a[:, None, w] & ~b[None, :, w]) == 0
    return inside


def subset_pairs(left: DataFrame, right: DataFrame, cols: list[str], strict: bool = True,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All (a, b) with a in ``left`` contained in b in ``right``; columns ``cols`` and ``sup_*``."""
    sups = [f"sup_{c}" for c in cols]
    def fn(a, stream):
        for b in stream():
            for part in kernels.chunks(len(a), max(1, len(b))):
                inside = _contained(a[part], b)
                if strict:
                    inside &= ~_contained(b, a[part]).T
                i, k = np.nonzero(inside)
                yield kernels.batch_of(kernels.word_dict(a[part][i], cols) | kernels.word_dict(b[k], sups))
    return _against(left, right, cols, fn, ", ".join(f"{c} bigint" for c in [*cols, *sups]), block_rows)


def subset_counts(left: DataFrame, right: DataFrame, cols: list[str], label: str,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Append to ``right`` the number of ``left`` sets contained in each; no pairs are built, and counts are whole where they are made."""
    def fn(b, stream):
        n = np.zeros(len(b), np.int64)
        for a in stream():
            for part in kernels.chunks(len(b), max(1, len(a))):
                n[part] += _contained(a, b[part]).sum(axis=0)
        yield kernels.batch_of(kernels.word_dict(b, cols) | {label: n})
    held = right if list(right.columns) == cols and right is left else right.select(*cols).distinct()
    counted = _against(held, left, cols, fn, ", ".join(f"{c} bigint" for c in [*cols, label]), block_rows, upward=False)
    if held is right:
        return counted.select(*cols, label)
    return right.join(counted, cols, "left").select(*right.columns, F.coalesce(label, F.lit(0).cast("bigint")).alias(label))


def _holds_any(inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """For each row of ``outer``: does it contain some row of ``inner``?"""
    hit = np.zeros(len(outer), bool)
    if len(inner) and len(outer):
        for part in kernels.chunks(len(inner), len(outer)):
            left = np.nonzero(~hit)[0]
            hit[left] = _contained(inner[part], outer[left]).any(axis=0)
    return hit


def _minimal(sups: np.ndarray) -> np.ndarray:
    """Minimal rows of ``sups``, one size at a time.

    Sets of one size never contain each other, so the smallest ones left are all
    minimal and only larger ones have to be tested against them.
    """
    sizes, out = kernels.popcount(sups), []
    while len(sups):
        smallest = sizes == sizes.min()
        out.append(sups[smallest])
        sups, sizes = sups[~smallest], sizes[~smallest]
        keep = ~_holds_any(out[-1], sups)
        sups, sizes = sups[keep], sizes[keep]
    return np.concatenate(out) if out else sups


def minimal_supersets(sets: DataFrame, family: DataFrame, cols: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(cols.., sup_cols..): for each set, the minimal members of ``family`` strictly above it.

    While the family passes, a set keeps the minimal supersets met so far, which in the end are its covers: no list is
    longer than those of one size.
    """
    sups = [f"sup_{c}" for c in cols]
    def fn(a, stream):
        kept: list[np.ndarray] = [a[:0]] * len(a)
        for b in stream():
            for part in kernels.chunks(len(a), max(1, len(b))):
                inside = _contained(a[part], b) & ~_contained(b, a[part]).T
                for i in np.nonzero(inside.any(axis=1))[0]:
                    old, new = kept[part.start + i], b[inside[i]]
                    if len(old):
                        new = new[~_holds_any(old, new)]
                        if not len(new):
                            continue
                    kept[part.start + i] = _minimal(np.concatenate([old, new]))
        n = [len(k) for k in kept]
        yield kernels.batch_of(kernels.word_dict(np.repeat(a, n, axis=0), cols) | kernels.word_dict(np.concatenate(kept), sups))
    found = _against(sets, family, cols, fn, ", ".join(f"{c} bigint" for c in [*cols, *sups]), block_rows)
    return stage(found, "covers")


def cover_edges(family: DataFrame, cols: list[str], **limits) -> DataFrame:
    """Cover relation of any family of distinct masks: (cols.., sup_cols..), child below parent."""
    return minimal_supersets(family, family, cols, **limits)


# ---------------------------------------------------------------- complete closure systems


def modal_covers(concepts: DataFrame, closure: ModalClosure) -> DataFrame:
    """Cover relation of all modal concepts, from the closures of their one-attribute enlargements.

    ``cl(B + a)`` covers B exactly when every attribute it adds leads to that same closure.
    """
    cols, m = closure.cols, closure.m
    sups = [f"sup_{c}" for c in cols]
    if closure.broadcast is None:
        return _modal_covers_fragmented(concepts, closure, sups)
    bc, full, bits = closure.broadcast, masks.full_words(m), masks.bit_words(m)
    def fn(batch):
        sets = kernels.words_of(batch, cols)
        for part in kernels.chunks(len(sets), m * m):
            base = sets[part]
            row, attr = np.nonzero(((base[:, None, :] & bits[None, :, :]) == 0).all(axis=2))
            grown = base[row]
            closed = full & ~kernels.modal_open(grown | bits[attr], *bc.value)
            yield _covers_batch(row, grown, closed, kernels.popcount(closed & ~grown), cols, sups)
    return map_batches(concepts.select(*cols), fn, ", ".join(f"{c} bigint" for c in [*cols, *sups]))


def _covers_batch(row, base, closed, added, cols, sups):
    """One row per distinct closure of a base that is reached by as many steps as it adds."""
    key = np.concatenate([row[:, None], closed], axis=1)
    order = np.lexsort(key.T[::-1])
    key, base, closed, added = key[order], base[order], closed[order], added[order]
    start = np.ones(len(key), bool)
    start[1:] = (key[1:] != key[:-1]).any(axis=1)
    at = np.nonzero(start)[0]
    reached = np.diff(np.append(at, len(key)))
    keep = at[reached == added[at]]
    return kernels.batch_of(kernels.word_dict(base[keep], cols) | kernels.word_dict(closed[keep], sups))


def _modal_covers_fragmented(concepts: DataFrame, closure: ModalClosure, sups: list[str]) -> DataFrame:
    cols, m = closure.cols, closure.m
    base = [f"base_{c}" for c in cols]
    steps = concepts.select(*[F.col(c).alias(b) for c, b in zip(cols, base)],
                            F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    steps = steps.where(~masks.contains_attr([F.col(b) for b in base], F.col("j"), m))
    grown = masks.with_attr([F.col(b) for b in base], F.col("j"), m)
    closed = closure.close(stage(steps.select(*base, "j", *[g.alias(c) for g, c in zip(grown, cols)]), "enlarged"))
    outs = masks.mask_cols(m, "closure")
    reached = closed.groupBy(*base, *outs).agg(F.count(F.lit(1)).alias("n"))
    added = masks.card([F.col(o).bitwiseAND(F.bitwise_not(F.col(b))) for o, b in zip(outs, base)])
    return reached.where(F.col("n") == added).select(
        *[F.col(b).alias(c) for b, c in zip(base, cols)], *[F.col(o).alias(s) for o, s in zip(outs, sups)])


def fuzzy_covers(intents: DataFrame, closure: FuzzyClosure) -> DataFrame:
    """Cover relation of all closed intents (``grades``, ``sup_grades``).

    Every larger intent contains some one-level raise of B, so the upper covers
    are the minimal closures of those raises; such a closure is minimal exactly
    when every attribute it lifts leads to it.
    """
    m, scale = closure.m, closure.scale
    schema = "grades array<int>, sup_grades array<int>"
    if closure.broadcast is None:
        return _fuzzy_covers_fragmented(intents, closure)
    bc = closure.broadcast
    def fn(batch):
        sets = kernels.grades_of(batch, "grades", m)
        for part in kernels.chunks(len(sets), m * m):
            base = sets[part]
            row, attr = np.nonzero(base < scale)
            grown = base[row]
            raised = grown.copy()
            raised[np.arange(len(row)), attr] += 1
            closed = kernels.fuzzy_close(raised, *bc.value)
            added = (closed > grown).sum(axis=1)
            key = np.concatenate([row[:, None], closed], axis=1)
            _, at, reached = np.unique(key, axis=0, return_index=True, return_counts=True)
            keep = at[reached == added[at]]
            yield kernels.batch_of({"grades": kernels.grades_array(grown[keep]),
                                    "sup_grades": kernels.grades_array(closed[keep])})
    return map_batches(intents.select("grades"), fn, schema)


def _fuzzy_covers_fragmented(intents: DataFrame, closure: FuzzyClosure) -> DataFrame:
    steps = intents.select(F.col("grades").alias("base"), F.posexplode("grades").alias("j", "old"))
    raised = F.transform("base", lambda g, i: F.when(i == F.col("j"), g + 1).otherwise(g))
    steps = steps.where(F.col("old") < closure.scale).select("base", "j", raised.alias("grades"))
    closed = closure.close(stage(steps, "raised"))
    reached = closed.groupBy("base", "closure").agg(F.count(F.lit(1)).alias("n"))
    lifted = F.size(F.filter(F.zip_with("base", "closure", lambda x, y: y > x), lambda up: up))
    return reached.where(F.col("n") == lifted).select(F.col("base").alias("grades"), F.col("closure").alias("sup_grades"))


def _joined(start: DataFrame, cols: list[str], close, block_rows: int) -> DataFrame:
    """Smallest family of masks holding ``start`` and closed under ``close(A | B)``.

    Joining one generator at a time reaches every join, so each round combines
    only the new members with the generators; rounds end when nothing is new.
    """
    seen = stage(start.select(*cols).distinct(), "joins")
    base, delta = seen, seen
    def fn(a, stream):
        for b in stream():
            for part in kernels.chunks(len(a), max(1, len(b)) * a.shape[1]):
                both = (a[part, None, :] | b[None, :, :]).reshape(-1, a.shape[1])
                yield kernels.batch_of(kernels.word_dict(np.unique(both, axis=0), cols))
    while not delta.isEmpty():
        unions = _against(delta, base, cols, fn, ", ".join(f"{c} bigint" for c in cols), block_rows, upward=None)
        closed = close(unions.distinct()).distinct()
        delta = stage(closed.join(seen, cols, "left_anti"), "joins-new")
        seen = seen.unionByName(delta)
    return seen


def join_closure(generators: DataFrame, closure: ModalClosure, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Smallest family holding the generators and closed under joins ``cl(A | B)``."""
    cols, outs = closure.cols, masks.mask_cols(closure.m, "closure")
    def close(sets):
        return closure.close(sets).select(*[F.col(o).alias(c) for o, c in zip(outs, cols)])
    return _joined(generators, cols, close, block_rows)


def fuzzy_join_closure(generators: DataFrame, closure: FuzzyClosure, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``grades`` of the smallest family holding the generators and closed under joins ``cl(max(A, B))``.

    As masks of reached steps, the maximum of two vectors is a union.
    """
    m, scale = closure.m, closure.scale
    cols = masks.mask_cols(m * scale)
    def close(sets):
        vectors = sets.select(from_thermometer(cols, m, scale).alias("grades"))
        return closure.close(vectors, distinct=True).select(*thermometer(F.col("closure"), m, scale))
    family = _joined(generators.select(*thermometer(F.col("grades"), m, scale)), cols, close, block_rows)
    return family.select(from_thermometer(cols, m, scale).alias("grades"))


def fuzzy_join(pairs: DataFrame, a: str, b: str, closure: FuzzyClosure, out: str = "joined") -> DataFrame:
    """Append the join ``cl(max(a, b))`` of two intents."""
    both = pairs.select(*pairs.columns, fuzzy.union(F.col(a), F.col(b)).alias("grades"))
    return closure.close(both, out).drop("grades")


__all__ = ["cover_edges", "fuzzy_covers", "fuzzy_join", "fuzzy_join_closure", "join_closure", "minimal_supersets", "modal_covers",
           "subset_counts", "subset_pairs", "thermometer"]
