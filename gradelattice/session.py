"""Session defaults and staged tables.

Iterative operators cut their lineage by writing each round as a parquet table
under the shared folder the cluster names in ``spark.checkpoint.dir``.  Any
executor can read such a table back, so losing one never loses a round.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from urllib.parse import unquote, urlparse

import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_roots: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(name: str = "gradelattice", cpus: str | int = "*", shuffle_partitions: int = 8,
                  **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster a
    machine-local path would be invisible to the other machines.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            base = tempfile.mkdtemp(prefix="gradelattice-")
        root = os.path.join(base, f"gradelattice-{app}-{uuid.uuid4().hex[:8]}")
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        _roots[app] = root
    return _roots[app]


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    The archive is built on the driver and Spark distributes it, so jobs do not
    depend on the working directory or on an installation on each machine.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="gradelattice-code-"), "gradelattice.zip")
    with zipfile.ZipFile(archive, "w") as bundle:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    bundle.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def stage_path(spark: SparkSession, label: str) -> str:
    return os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex[:12]}")


def stage(df: DataFrame, label: str, partition: str | None = None) -> DataFrame:
    """Write ``df`` as a shared parquet table and read it back: a durable lineage cut."""
    path = stage_path(df.sparkSession, label)
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_observed(df: DataFrame, label: str, **values: Column) -> tuple[DataFrame, dict]:
    """``stage``, with aggregates observed while writing, so no second pass is needed to decide what follows."""
    path, seen = stage_path(df.sparkSession, label), Observation()
    df.observe(seen, *[v.alias(k) for k, v in values.items()]).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def staged_batches(paths: list[str], rows: int, where: ds.Expression | None = None):
    """Record batches of staged tables, read inside a task; ``where`` also skips row groups by their statistics."""
    for path in paths:
        parsed = urlparse(path)
        if parsed.scheme in ("", "file"):
            files, name = fs.LocalFileSystem(), unquote(parsed.path)
        else:
            files, name = fs.FileSystem.from_uri(path)
        yield from ds.dataset(name, filesystem=files, format="parquet").to_batches(filter=where, batch_size=rows, batch_readahead=1, fragment_readahead=1)


class Pile:
    """A staged table that grows by parts and reads back as one scan, however many parts it has."""

    def __init__(self, spark: SparkSession, label: str, schema):
        self.spark, self.schema, self.base, self.paths = spark, schema, stage_path(spark, label), []

    def add(self, part: DataFrame, **values: Column) -> tuple[DataFrame, dict]:
        """Append ``part``; returns it read back, and what was observed while writing."""
        path, seen = os.path.join(self.base, f"part-{len(self.paths)}"), Observation()
        values = values or {"n": F.count(F.lit(1))}
        part.observe(seen, *[v.alias(k) for k, v in values.items()]).write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(self.schema).parquet(path), seen.get

    @property
    def all(self) -> DataFrame:
        if not self.paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*self.paths)
