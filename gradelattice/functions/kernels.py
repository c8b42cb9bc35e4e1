"""Array kernels run inside tasks on Arrow batches.

Sets are int64 word matrices (rows x words), fuzzy sets int16 level matrices
(rows x attributes).  Both closures are decomposable over objects: closing
against part of the objects gives a superset of the true closure, and the exact
closure is the intersection (AND, respectively minimum) over all the parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CELLS = 1 << 21  # largest intermediate matrix, in cells


def words_of(batch, cols: list[str]) -> np.ndarray:
    return np.stack([np.asarray(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False), np.int64)
                     for c in cols], axis=1)


def grades_of(batch, col: str, m: int) -> np.ndarray:
    arr = batch.column(batch.schema.get_field_index(col))
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return np.asarray(arr.flatten().to_numpy(zero_copy_only=False), np.int16).reshape(-1, m)


def grades_array(levels: np.ndarray) -> pa.Array:
    k, m = levels.shape
    offsets = np.arange(0, (k + 1) * m, m, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(levels.reshape(-1).astype(np.int32)))


def batch_of(cols: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(cols))


def word_dict(words: np.ndarray, cols: list[str]) -> dict[str, np.ndarray]:
    return {c: np.ascontiguousarray(words[:, w]) for w, c in enumerate(cols)}


def chunks(n: int, width: int):
    step = max(1, CELLS // max(1, width))
    for lo in range(0, n, step):
        yield slice(lo, min(n, lo + step))


def popcount(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=1).astype(np.int32)


def modal_open(sets: np.ndarray, need: np.ndarray, attrs: np.ndarray) -> np.ndarray:
    """Attributes kept out of each closure: those of a row whose ``need`` mask the set misses."""
    out = np.zeros_like(sets)
    if len(need) == 0:
        return out
    for part in chunks(len(sets), len(need)):
        miss = (sets[part, None, 0] & need[None, :, 0]) == 0
        for w in range(1, sets.shape[1]):
            miss &= (sets[part, None, w] & need[None, :, w]) == 0
        for w in range(sets.shape[1]):
            out[part, w] = np.bitwise_or.reduce(np.where(miss, attrs[None, :, w], 0), axis=1)
    return out


def implication_table(kind: str, scale: int, rounding: str) -> np.ndarray:
    """table[a, b] = a -> b on levels 0..scale, by rule."""
    a = np.arange(scale + 1)[:, None]
    b = np.arange(scale + 1)[None, :]
    if kind == "lukasiewicz":
        return np.minimum(scale, scale - a + b).astype(np.int16)
    den = np.maximum(a, 1)
    ratio = (2 * scale * b + den - 1) // (2 * den) if rounding == "nearest" else (scale * b) // den
    return np.where(a <= b, scale, ratio).astype(np.int16)


def fuzzy_down(intents: np.ndarray, rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Extents (sets x objects): min over attributes of intent -> grade."""
    out = np.full((len(intents), len(rows)), table.shape[0] - 1, np.int16)
    for j in range(rows.shape[1]):
        np.minimum(out, table[intents[:, j, None], rows[None, :, j]], out=out)
    return out


def fuzzy_up(extents: np.ndarray, rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Intents (sets x attributes): min over objects of extent -> grade."""
    out = np.full((len(extents), rows.shape[1]), table.shape[0] - 1, np.int16)
    if len(rows):
        for j in range(rows.shape[1]):
            out[:, j] = table[extents, rows[None, :, j]].min(axis=1)
    return out


def fuzzy_close(intents: np.ndarray, rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.empty_like(intents)
    for part in chunks(len(intents), len(rows)):
        out[part] = fuzzy_up(fuzzy_down(intents[part], rows, table), rows, table)
    return out
