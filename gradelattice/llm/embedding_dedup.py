"""Near-duplicate vectors by sorted projection passes.

A pass hashes every vector to the signs of its projections on random directions, sorts all vectors by the concatenated
signs and compares each with a bounded window of neighbours in that order; verified links of all passes are united to
components.  The windows do not depend on how the order is cut into partitions: the two ends of neighbouring partitions
are compared as well.  A run of vectors that agree in all leading signs the passes count on, and that a window does not
span, is then compared in full, in pairs of bounded blocks, unless it lies in one component already.  So any pair that
agrees in those signs in some pass meets, however dense its region is; how many signs that should be is measured on the
vectors, as that decides only what the comparisons cost.  How often a vector is linked is then counted within the components, exactly, in pairs of bounded
blocks; no link is ever a row of its own, only what ties a component together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import ceil, log, log1p, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelattice.llm.graph import components
from gradelattice.session import ship_package, stage, stage_observed

COSINE = 0.9
WINDOW = 256  # neighbours on either side that a vector is compared with in a pass
MISSED = 0.02  # share of pairs of exactly the least cosine that all passes together may leave apart
BITS = 62  # signs in a sort key
TRIALS = 3  # passes in which the sizes of runs are measured
MOVED = 2000  # comparisons that cost about as much as one more vector in a sort
BLOCK = 512  # vectors of a component or run compared with as many others in one group
CHUNK = 256


def passes_for(count: int, cosine: float = COSINE, window: int = WINDOW, missed: float = MISSED, bits: int | None = None) -> int:
    """Passes so that a pair of the least cosine agrees in all of ``bits`` leading signs of some pass, whatever the other
    vectors are; about log2(count / window) signs unless given."""
    bits = _least_bits(count, window) if bits is None else bits
    if not bits:
        return 1
    equal = (1 - np.arccos(cosine) / np.pi) ** bits
    return max(1, ceil(log(missed) / log1p(-equal)))


def _least_bits(count: int, window: int) -> int:
    return min(BITS, ceil(log2(count / window))) if count > window else 0


def _bits_for(nodes: DataFrame, count: int, cosine: float, window: int, missed: float) -> int:
    """Leading signs that cost the least comparisons: more of them take more passes, fewer leave larger runs."""
    least = _least_bits(count, window)
    if not least:
        return 0
    keys = _keyed(nodes, TRIALS).select("pass", "key", F.explode(F.lit(list(range(least, min(BITS, least + 16) + 1)))).alias("bits"))
    runs = keys.groupBy("pass", "bits", F.expr(f"shiftright(key, {BITS} - bits)").alias("run")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = dict(runs.groupBy("bits").agg(F.sum(F.when(F.col("n") > window + 1, F.col("n") * F.col("n") / 2).otherwise(0)) / TRIALS).collect())
    return min(pairs, key=lambda bits: passes_for(count, cosine, window, missed, bits) * (pairs[bits] + count * (window + MOVED)))


@lru_cache(maxsize=8)
def _directions(dimension: int, passes: int) -> np.ndarray:
    return np.random.default_rng(dimension).standard_normal((dimension, passes * BITS))


def _units(packed: list[bytes]) -> np.ndarray:
    """Rows of double-precision vectors of one dimension, at length one."""
    rows = np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _by_dimension(packed: list[bytes]) -> Iterator[np.ndarray]:
    sizes = np.array([len(p) for p in packed])
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def _packed(vectors: DataFrame, id: str, embedding: str) -> DataFrame:
    """``vec_id, high, low, vector``: doubles as bytes with their hash; a null vector where it can't be compared."""
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, high, low = [], [], []
            for v in batch.column("embedding"):
                row = np.array(v.values.to_numpy(zero_copy_only=False), np.float64) if v.is_valid and len(v) else np.zeros(1)
                with np.errstate(over="ignore"):
                    fit = np.isfinite(row).all() and row.any() and 0 < (row * row).sum() < np.inf
                data = (row + 0.0).tobytes() if fit else None  # plus zero: minus zero is zero
                digest = xxhash.xxh3_128_intdigest(data or b"")
                out.append(data)
                high.append((digest >> 64) - (1 << 63))
                low.append((digest & (1 << 64) - 1) - (1 << 63))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "high": pa.array(high, pa.int64()),
                                              "low": pa.array(low, pa.int64()), "vector": pa.array(out, pa.binary())})

    read = vectors.select(F.col(id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    return read.mapInArrow(pack, "vec_id bigint, high bigint, low bigint, vector binary")


def _keyed(nodes: DataFrame, passes: int) -> DataFrame:
    """``pass, key, rep, vector``: the signs of each vector in each pass."""
    def key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                packed = part.column("vector").to_pylist()
                keys = np.zeros((len(packed), passes), np.int64)
                for at in _by_dimension(packed):
                    rows = _units([packed[k] for k in at])
                    signs = (rows @ _directions(rows.shape[1], passes) > 0).reshape(len(at), passes, BITS)
                    for bit in range(BITS):
                        keys[at] = keys[at] * 2 + signs[:, :, bit]
                for p in range(passes):
                    yield pa.RecordBatch.from_pydict({"pass": pa.array([p] * len(packed), pa.int32()), "key": pa.array(keys[:, p]),
                                                      "rep": part.column("rep"), "vector": part.column("vector")})

    return nodes.select("rep", "vector").mapInArrow(key, "pass int, key bigint, rep bigint, vector binary")


def _sorted_passes(nodes: DataFrame, passes: int, partitions: int) -> DataFrame:
    order = ["pass", "key", "rep"]
    return _keyed(nodes, passes).repartitionByRange(partitions, *order).sortWithinPartitions(*order)


class _Window:
    """Compares rows in sort order with those up to WINDOW before them; yields what ties their components together."""

    def __init__(self, cosine: float, window: int):
        self.cosine, self.window = cosine, window
        self.vectors: list[bytes] = []
        self.ids, self.passes, self.label, self.next_label = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64), 0

    def add(self, ids: np.ndarray, passes: np.ndarray, vectors: list[bytes]) -> list[tuple[int, int]]:
        held, out = len(self.ids), []
        self.vectors = self.vectors + vectors
        self.ids, self.passes = np.concatenate([self.ids, ids]), np.concatenate([self.passes, passes])
        self.label = np.concatenate([self.label, np.arange(self.next_label, self.next_label + len(ids))])
        self.next_label += len(ids)
        total = len(self.ids)
        near = np.zeros((len(ids), total), bool)
        for at in _by_dimension(self.vectors):
            rows = _units([self.vectors[k] for k in at])
            new = at >= held
            near[np.ix_(at[new] - held, at)] = rows[new] @ rows.T >= self.cosine
        place = np.arange(total)
        near &= (place[None, :] < place[held:, None]) & (place[None, :] >= place[held:, None] - self.window) & (self.passes[None, :] == passes[:, None])
        for k in np.flatnonzero(near.any(axis=1)).tolist():
            others = np.flatnonzero(near[k])
            labels, first = np.unique(self.label[others], return_index=True)
            out += [(int(ids[k]), int(self.ids[others[f]])) for f, name in zip(first, labels) if name != self.label[held + k]]
            self.label[np.isin(self.label, labels)] = self.label[held + k]
        keep = max(0, total - self.window)
        self.vectors, self.ids, self.passes, self.label = self.vectors[keep:], self.ids[keep:], self.passes[keep:], self.label[keep:]
        return out


def _links(ordered: DataFrame, cosine: float, window: int) -> DataFrame:
    """Staged ``a, b`` of all windows."""
    columns = "part int, place bigint, pass int, rep bigint, vector binary, a bigint, b bigint"

    def row_batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"part": pa.int32(), "place": pa.int64(), "pass": pa.int32(), "rep": pa.int64(), "vector": pa.binary(), "a": pa.int64(), "b": pa.int64()}
        return pa.RecordBatch.from_pydict({c: pa.array([r.get(c) for r in rows], t) for c, t in kinds.items()})

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, state, tail = TaskContext.get().partitionId(), 0, _Window(cosine, window), []
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                rows = batch.slice(a, CHUNK)
                ids, passes, vectors = rows.column("rep").to_numpy(), rows.column("pass").to_numpy(), rows.column("vector").to_pylist()
                links = state.add(ids, passes, vectors)
                here = [{"part": part, "place": place + k, "pass": p, "rep": i, "vector": v} for k, (i, p, v) in enumerate(zip(ids.tolist(), passes.tolist(), vectors))]
                # The first rows of a partition go to the end of the one before.
                head = [r | {"part": part - 1, "place": (1 << 40) + r["place"]} for r in here if r["place"] < window]
                place, tail = place + len(here), (tail + here)[-window:]
                if links or head:
                    yield row_batch([{"a": x, "b": y} for x, y in links] + head)
        if tail:
            yield row_batch(tail)

    found = stage(ordered.mapInArrow(walk, columns), "windows")

    def seam(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        first = sum(p < 1 << 40 for p in table["place"].to_pylist())
        state, links = _Window(cosine, window), []
        ids, passes, vectors = table["rep"].to_numpy(), table["pass"].to_numpy(), table["vector"].to_pylist()
        for a, b in ((0, first), (first, len(ids))):
            links += state.add(ids[a:b], passes[a:b], vectors[a:b])
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    ends = found.where("part is not null").groupBy("part").applyInArrow(seam, "a bigint, b bigint")
    return stage(found.where("part is null").select("a", "b").union(ends).distinct(), "links")


def _run_links(nodes: DataFrame, owner: DataFrame, passes: int, bits: int, cosine: float, window: int) -> tuple[DataFrame, dict]:
    """Staged ``a, b`` that tie components in runs equal in ``bits`` signs and longer than a window, and ``n``, how many."""
    own = nodes.select("rep", "vector").join(owner, nodes.rep == owner.node, "left").select("rep", F.coalesce("component", "rep").alias("component"))
    keyed = _keyed(nodes, passes).withColumn("run", F.shiftright("key", BITS - bits)).drop("key")
    placed = keyed.drop("vector").join(own, "rep")
    long = (placed.groupBy("pass", "run").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
            .where((F.col("n") > window + 1) & (F.col("low") < F.col("high")))
            .select("pass", "run", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    long, seen = stage_observed(long, "runs", n=F.count(F.lit(1)))
    if not seen["n"]:
        return nodes.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0), {"n": 0}
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = (keyed.join(long, ["pass", "run"]).join(own, "rep").withColumn("own", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("pass", "run", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "rep", "component", "vector"))

    def tie(key: tuple, table: pa.Table) -> pa.Table:
        packed, ids, links = table["vector"].to_pylist(), table["rep"].to_numpy(), []
        _, label = np.unique(table["component"].to_numpy(), return_inverse=True)
        for at in _by_dimension(packed):
            rows = _units([packed[k] for k in at])
            for a in range(0, len(at), CHUNK):
                near = rows[a:a + CHUNK] @ rows.T >= cosine
                near &= label[at[a:a + CHUNK]][:, None] != label[at][None, :]
                for k in np.flatnonzero(near.any(axis=1)).tolist():
                    one, others = at[a + k], at[near[k]]
                    labels, first = np.unique(label[others], return_index=True)
                    links += [(int(ids[one]), int(ids[others[f]])) for f, name in zip(first, labels) if name != label[one]]
                    label[np.isin(label, labels)] = label[one]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return stage_observed(dealt.groupBy("pass", "run", "p", "q").applyInArrow(tie, "a bigint, b bigint").distinct(), "run-links", n=F.count(F.lit(1)))


def _counted(members: DataFrame, cosine: float) -> DataFrame:
    """``rep, n``: vectors linked with each, copies counted, over all pairs of each component, by pairs of blocks."""
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = (members.join(sizes, "component").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("component", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "rep", "copies", "vector"))

    def count(key: tuple, table: pa.Table) -> pa.Table:
        packed, ids, copies, own = table["vector"].to_pylist(), table["rep"].to_numpy(), table["copies"].to_numpy(), table["own"].to_numpy()
        total = np.zeros(len(ids), np.int64)
        for at in _by_dimension(packed):
            rows = _units([packed[k] for k in at])
            near = rows @ rows.T >= cosine
            if key[1].as_py() != key[2].as_py():
                near &= own[at][:, None] != own[at][None, :]
            np.fill_diagonal(near, False)
            total[at] = near @ copies[at]
        return pa.table({"rep": ids, "n": total})

    return dealt.groupBy("component", "p", "q").applyInArrow(count, "rep bigint, n bigint").groupBy("rep").agg(F.sum("n").alias("n"))


def near_vectors(vectors: DataFrame, *, id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE,
                 window: int = WINDOW, missed: float = MISSED) -> DataFrame:
    """Links of vectors with a cosine of ``cosine`` or more, in double precision, and the components they form.

    Returns ``vec_id, n_links, component_id, kept`` for each row.  Null, empty and zero vectors, those with a null or
    non-finite component and those whose length under- or overflows link with nothing, nor do vectors of different
    dimension; equal vectors are links of each other.  A row without id counts for nothing and has no component.  Rows
    that share an id are counted as vectors of their own.  Other columns are ignored.
    """
    ship_package(vectors.sparkSession)
    packed = stage(_packed(vectors, id, embedding), "vectors")
    usable = packed.where("vector is not null and vec_id is not null")
    # Equal vectors are one node with a number of copies.
    nodes, seen = stage_observed(usable.groupBy("high", "low").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                                                   F.first("vector").alias("vector")), "nodes", n=F.count(F.lit(1)))
    bits = _bits_for(nodes, seen["n"], cosine, window, missed)
    passes = passes_for(seen["n"], cosine, window, missed, bits)
    partitions = max(1, min(seen["n"] * passes // (8 * window), 100 * vectors.sparkSession.sparkContext.defaultParallelism))
    links = _links(_sorted_passes(nodes, passes, partitions), cosine, window)
    owner = components(links)
    if bits:
        more, found = _run_links(nodes, owner, passes, bits, cosine, window)
        owner = components(links.union(more)) if found["n"] else owner
    members = stage(nodes.join(owner, nodes.rep == owner.node).select("component", "rep", "copies", "vector"), "members")
    counted = _counted(members, cosine).groupBy("rep").agg(F.max("n").alias("n"))
    placed = stage(nodes.select("high", "low", "rep", "copies").join(owner, nodes.rep == owner.node, "left").join(counted, "rep", "left")
                   .select("high", "low", F.coalesce("component", "rep").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")), "placed")
    usable_row = F.col("vector").isNotNull() & F.col("vec_id").isNotNull()
    return (packed.select("vec_id", F.when(usable_row, F.col("high")).alias("high"), F.when(usable_row, F.col("low")).alias("low"))
            .join(placed, ["high", "low"], "left")
            .select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
                    F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept")))
