"""Contexts with real grades, by order coding.

The modal calculus only compares grades of one object with each other, so an object's distinct positive values can stand as
levels 1, 2, ... in their order.  ``RealContext.coded`` is such a context, and the operators for levels run on it exactly;
a dictionary per object, in the same row, gives the values back.  Grades that are not positive are level 0, the floor every
extent starts from.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelattice.operators.closure import ModalClosure
from gradelattice.operators.context import Context
from gradelattice.operators.derivation import concept_extents
from gradelattice.session import stage

# Fixed value: grades up to here count as absent when a real context is scaled.
ABSENT = 1e-9


@dataclass(frozen=True)
class RealContext:
    """``frame`` has columns ``obj`` and ``values`` (ARRAY<DOUBLE> of ``m`` grades, none null or NaN)."""

    frame: DataFrame
    m: int

    @classmethod
    def of_vectors(cls, vectors: DataFrame, obj: Column, values: Column, m: int) -> RealContext:
        """A row for each vector; one of another length, or with a null or NaN in it, fails the job."""
        fit = (F.size(values) == m) & ~F.exists(values, lambda v: v.isNull() | F.isnan(v))
        message = F.format_string("vector of object %s has not %d numbers", obj.cast("string"), F.lit(m))
        checked = F.when(fit, values.cast("array<double>")).otherwise(F.raise_error(message).cast("array<double>"))
        return cls(vectors.select(obj.alias("obj"), checked.alias("values")), m)

    @classmethod
    def of_cells(cls, cells: DataFrame, m: int) -> RealContext:
        """From (obj, attr, v) rows, as ``scan_cells`` gives them; absent cells are 0."""
        wide = cells.groupBy("obj").agg(*[F.coalesce(F.max(F.when(F.col("attr") == j, F.col("v"))), F.lit(0.0)).alias(f"v{j}") for j in range(m)])
        return cls(wide.select("obj", F.array(*[f"v{j}" for j in range(m)]).alias("values")), m)

    def staged(self) -> RealContext:
        return RealContext(stage(self.frame, "real-context"), self.m)

    def _levels(self) -> Column:
        return F.array_sort(F.array_distinct(F.filter("values", lambda v: v > 0)))

    def coded(self) -> Context:
        """Levels 0..m by the order of each object's values; row-local."""
        ranked = self.frame.select("obj", "values", self._levels().alias("levels"))
        code = F.transform("values", lambda v: F.when(v > 0, F.array_position("levels", v)).otherwise(0).cast("int"))
        return Context(ranked.select("obj", code.alias("grades")), self.m, self.m)

    def dictionary(self) -> DataFrame:
        """(obj, levels): the values that levels 1, 2, ... of an object stand for."""
        return self.frame.select("obj", self._levels().alias("levels"))

    def alpha_cut(self, threshold: float) -> Context:
        """1 where the grade reaches ``threshold`` (inclusive), else 0."""
        return Context(self.frame.select("obj", F.transform("values", lambda v: (v >= threshold).cast("int")).alias("grades")), self.m, 1)

    def scaling_map(self) -> DataFrame:
        """(crisp_attr, fuzzy_attr, value): the distinct values of each attribute that are not absent, ascending.

        Numbered in parallel: per attribute, then by how many values the earlier attributes have.
        """
        seen = self.frame.select(F.posexplode("values").alias("fuzzy_attr", "value")).where(F.col("value") > ABSENT).distinct()
        per = seen.groupBy("fuzzy_attr").agg(F.count(F.lit(1)).alias("n"))  # m rows
        before = F.coalesce(F.sum("n").over(Window.orderBy("fuzzy_attr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rank = F.row_number().over(Window.partitionBy("fuzzy_attr").orderBy("value")) - 1
        placed = seen.withColumn("rank", rank).join(F.broadcast(per.select("fuzzy_attr", before.alias("before"))), "fuzzy_attr")
        return placed.select((F.col("before") + F.col("rank")).cast("bigint").alias("crisp_attr"), "fuzzy_attr", "value")

    def scaled_cells(self) -> DataFrame:
        """Sparse long form (obj, crisp_attr) of nominal scaling; an equi-join on the attribute and its value."""
        ctx = self.staged()
        cells = ctx.frame.select("obj", F.posexplode("values").alias("fuzzy_attr", "value"))
        return cells.join(ctx.scaling_map(), ["fuzzy_attr", "value"]).select("obj", "crisp_attr")


def real_extents(concepts: DataFrame, ctx: RealContext) -> DataFrame:
    """(mask.., obj, ext DOUBLE): the largest grade of each object over each concept, at least 0."""
    coded = concept_extents(concepts, ctx.coded())
    value = F.when(F.col("ext") > 0, F.element_at("levels", F.col("ext"))).otherwise(0.0)
    return coded.join(ctx.dictionary(), "obj").select(*concepts.columns, "obj", value.alias("ext"))


def real_closure(ctx: RealContext, **limits) -> ModalClosure:
    """The modal closure of a real context."""
    return ModalClosure(ctx.coded(), **limits)
