"""Incremental maintenance of a cover relation.

Vectors arrive in batches; a batch touches only edges that involve a new vector or that a new one now passes between.  The
state is an append-only bitmap index of all vectors (``operators.dominance``) and deltas of edges added and bypassed, all in
the shared folder.  A batch asks the index for the neighbours of its new vectors and reads neither old edges nor old
vectors otherwise.  Vectors are never taken back, so a bypassed edge never returns and the current edges are all added ones
minus all bypassed ones.  A replayed batch overwrites its own delta only.  A marker is written after a delta, so an instance
on the same folder goes on where the last complete batch ended.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradelattice.functions import kernels, masks
from gradelattice.operators.closure import map_batches
from gradelattice.operators.containment import cover_edges
from gradelattice.operators.dominance import DominanceIndex
from gradelattice.session import stage_observed

COMPACT_EVERY = 16  # epochs between merged snapshots, so a read opens a bounded number of deltas
PAIR = "kind int, grades array<int>, sup_grades array<int>"
EDGE, BYPASSED = 0, 1


class IncrementalCovers:
    """Cover relation of level vectors (``grades``) under a shared folder, fed by ``foreachBatch``.

    The folder outlives the instance: a new one continues with the state found there.
    """

    def __init__(self, spark: SparkSession, m: int, scale: int, folder: str):
        self.spark, self.m, self.scale, self.folder = spark, m, scale, folder
        self.version = self._last_complete()
        self._sizes: dict[int, int] = {}

    def _last_complete(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.folder, "complete"))
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return -1
        return max((int(s.getPath().getName()[1:]) for s in files.listStatus(path)
                    if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))), default=-1)

    def _paths(self, kind: str, version: int) -> list[str]:
        """Folders that together hold the state after epoch ``version``."""
        start = (version + 1) // COMPACT_EVERY * COMPACT_EVERY
        paths = [os.path.join(self.folder, kind, f"upto{start - 1}")] if start else []
        return paths + [os.path.join(self.folder, kind, f"v{v}") for v in range(start, version + 1)]

    def _size(self, version: int) -> int:
        if version >= 0 and version not in self._sizes:
            self._sizes[version] = self.spark.read.parquet(os.path.join(self.folder, "complete", f"v{version}")).first().size
        return self._sizes.get(version, 0)

    def _vectors(self, paths: list[str]) -> DataFrame:
        """``grades`` of all vertices, unpacked from parts of the index."""
        m = self.m
        if not paths:
            return self.spark.createDataFrame([], "grades array<int>")
        def fn(batch):
            for cells in batch.column(0).to_pylist():
                yield kernels.batch_of({"grades": kernels.grades_array(np.frombuffer(cells, np.int16).reshape(-1, m))})
        return map_batches(self.spark.read.schema("cells binary").parquet(*paths), fn, "grades array<int>")

    def _pairs(self, paths: list[str]) -> DataFrame:
        """Edges added and not bypassed in the deltas of ``paths``."""
        if not paths:
            return self.spark.createDataFrame([], "grades array<int>, sup_grades array<int>")
        every = self.spark.read.schema(PAIR).parquet(*paths)
        edges, gone = (every.where(F.col("kind") == kind).drop("kind") for kind in (EDGE, BYPASSED))
        return edges.join(gone, ["grades", "sup_grades"], "left_anti")

    @property
    def grades(self) -> DataFrame:
        return self._vectors(self._paths("index", self.version))

    @property
    def covers(self) -> DataFrame:
        """(grades, sup_grades), child below parent."""
        return self._pairs(self._paths("pairs", self.version))

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """Add one batch as delta ``epoch``, on top of the deltas before it."""
        size = self._size(epoch - 1)
        index = DominanceIndex(self.spark, self.m, self.scale, self._paths("index", epoch - 1))
        asked, seen = stage_observed(batch.select("grades").distinct(), "batch", n=F.count(F.lit(1)))
        fresh, seen = stage_observed(index.missing(asked, seen["n"] or 0, size), "new-vectors", n=F.count(F.lit(1)))
        count = seen["n"] or 0
        index.append(fresh, count, os.path.join(self.folder, "index", f"v{epoch}"), epoch)
        found = index.neighbours(fresh, count, size + count, epoch)
        found.write.mode("overwrite").parquet(os.path.join(self.folder, "pairs", f"v{epoch}"))
        if (epoch + 1) % COMPACT_EVERY == 0:
            self._compact(epoch, size + count)
        marker = self.spark.createDataFrame([(epoch, self.m, size + count)], "epoch bigint, m int, size bigint").coalesce(1)
        marker.write.mode("overwrite").parquet(os.path.join(self.folder, "complete", f"v{epoch}"))
        self.version, self._sizes[epoch] = epoch, size + count

    def _compact(self, epoch: int, size: int) -> None:
        """Merge the deltas since the last compaction with what it left; later versions start from there."""
        older = [[*self._paths(kind, epoch - 1), os.path.join(self.folder, kind, f"v{epoch}")] for kind in ("index", "pairs")]
        every = self._vectors(older[0])
        DominanceIndex(self.spark, self.m, self.scale).append(every, size, os.path.join(self.folder, "index", f"upto{epoch}"), epoch=-1)
        kept = self._pairs(older[1]).select(F.lit(EDGE).alias("kind"), "grades", "sup_grades")
        kept.write.mode("overwrite").parquet(os.path.join(self.folder, "pairs", f"upto{epoch}"))

    def _incoming(self, stream: DataFrame) -> DataFrame:
        return stream.select("grades")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Consume a stream; ``trigger`` as for ``DataStreamWriter.trigger``."""
        return (self._incoming(stream).writeStream.foreachBatch(self.apply)
                .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


class IncrementalLattice(IncrementalCovers):
    """The same for attribute sets given as masks: vectors of the levels 0 and 1."""

    def __init__(self, spark: SparkSession, m: int, folder: str):
        super().__init__(spark, m, 1, folder)
        self.cols = masks.mask_cols(m)

    def _incoming(self, stream: DataFrame) -> DataFrame:
        return stream.select(*self.cols)

    def _masks(self, grades: Column, stem: str) -> list[Column]:
        return masks.mask_where(grades, self.m, lambda g: g > 0, stem)

    @property
    def vertices(self) -> DataFrame:
        return self.grades.select(*self._masks(F.col("grades"), "mask"))

    @property
    def edges(self) -> DataFrame:
        return self.covers.select(*self._masks(F.col("grades"), "mask"), *self._masks(F.col("sup_grades"), "sup_mask"))

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """Add one batch of masks as delta ``epoch``."""
        words = [F.col(c) for c in self.cols]
        bits = [F.shiftright(words[j // masks.WORD_BITS], j % masks.WORD_BITS).bitwiseAND(F.lit(1)).cast("int") for j in range(self.m)]
        super().apply(batch.select(F.array(*bits).alias("grades")), epoch)


def batch_covers(sets: DataFrame, m: int) -> DataFrame:
    """What the incremental state must equal after all batches."""
    return cover_edges(sets.distinct(), masks.mask_cols(m))
