"""Contexts over event-time windows, kept by Structured Streaming.

Counts per window, object and attribute are streaming state; the watermark tells when a window is final and its state goes.
Every micro-batch writes the counts it has changed under its epoch, so a replayed one overwrites its own rows only, and a
reader takes the latest counts of each window and object.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradelattice.operators.context import Context


def window_counts(events: DataFrame, time: str, window: str, obj: Column, attr: Column, m: int, slide: str | None = None) -> DataFrame:
    """(start, obj, counts): occurrences of the attributes 0..m-1 per window and object, for a batch or a stream.

    Rows without a time belong to no window; a null attribute counts nowhere; one out of range fails the job.
    """
    message = F.format_string("attribute %s of object %s is not among the %d expected", attr.cast("string"), obj.cast("string"), F.lit(m))
    known = F.when(attr.isNull() | ((attr >= 0) & (attr < m)), attr).otherwise(F.raise_error(message).cast("int"))
    hits = events.where(F.col(time).isNotNull()).select(F.col(time).alias("time"), obj.alias("obj"), known.alias("attr"))
    of = F.window("time", window, slide) if slide else F.window("time", window)
    counted = hits.groupBy(of.alias("window"), "obj").agg(*[F.count_if(F.col("attr") == j).alias(f"c{j}") for j in range(m)])
    return counted.select(F.col("window.start").alias("start"), "obj", F.array(*[f"c{j}" for j in range(m)]).alias("counts"))


def graded(counts: DataFrame, m: int, scale: int = 10) -> DataFrame:
    """(start, obj, grades): scale * count // largest count of the object in the window."""
    top = F.greatest(F.array_max("counts"), F.lit(1))
    cells = F.transform(F.col("counts"), lambda c: F.floor(scale * c / F.col("top")).cast("int"))
    return counts.select("start", "obj", "counts", top.cast("decimal(19,0)").alias("top")).select("start", "obj", cells.alias("grades"))


class WindowedContexts:
    """One context for each event-time window, under a shared folder that outlives the instance."""

    def __init__(self, spark: SparkSession, m: int, folder: str, obj_type: str = "bigint", scale: int = 10):
        self.spark, self.m, self.scale, self.folder = spark, m, scale, folder
        self.schema = f"start timestamp, obj {obj_type}, counts array<bigint>, epoch bigint"

    def _write(self, batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(os.path.join(self.folder, f"epoch={epoch:09d}"))

    def start(self, events: DataFrame, checkpoint: str, *, time: str, window: str, late: str, obj: Column, attr: Column,
              slide: str | None = None, **trigger) -> StreamingQuery:
        """Consume a stream of events; ``late`` is how far behind the latest event one may come and still count."""
        counts = window_counts(events.withWatermark(time, late), time, window, obj, attr, self.m, slide)
        return (counts.writeStream.outputMode("update").foreachBatch(self._write).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())

    @property
    def counts(self) -> DataFrame:
        """Latest counts of every window and object."""
        written = self.spark.read.schema(self.schema).parquet(os.path.join(self.folder, "epoch=*"))
        return written.groupBy("start", "obj").agg(F.max_by("counts", "epoch").alias("counts"))

    @property
    def grades(self) -> DataFrame:
        """(start, obj, grades) of all windows."""
        return graded(self.counts, self.m, self.scale)

    def context(self, start) -> Context:
        """The context of one window."""
        return Context(self.grades.where(F.col("start") == F.lit(start)).select("obj", "grades"), self.m, self.scale)
