"""Graded contexts and their transforms.

A context is one row per object with all its grades in one array.  Building it
is a single shuffle on the object key, pre-aggregated map-side, and the row is
dense by construction, so no objects x attributes product is ever joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelattice.functions import fuzzy, masks
from gradelattice.session import stage

UNROLL_LIMIT = 256


@dataclass(frozen=True)
class Context:
    """``frame`` has columns ``obj`` and ``grades`` (ARRAY<INT> of ``m`` levels 0..scale)."""

    frame: DataFrame
    m: int
    scale: int = 10

    def long(self) -> DataFrame:
        """One row per cell: obj, attr, q."""
        return self.frame.select("obj", F.posexplode("grades").alias("attr", "q"))

    def staged(self) -> Context:
        """The same context as a shared table, for use by several passes: the facts are then read once."""
        return Context(stage(self.frame, "context"), self.m, self.scale)

    def clarified(self) -> DataFrame:
        """Distinct grade rows with the number of objects sharing each."""
        return self.frame.groupBy("grades").agg(F.count(F.lit(1)).alias("n_objects"))

    def map_cells(self, fn, scale: int) -> Context:
        """Apply ``fn(grade)`` to every cell."""
        if self.m <= UNROLL_LIMIT:
            cells = F.array(*[fn(g) for g in fuzzy.levels(F.col("grades"), self.m)])
        else:
            cells = F.transform("grades", fn)
        return Context(self.frame.select("obj", cells.alias("grades")), self.m, scale)


def grade_counts(facts: DataFrame, obj: Column, attr: Column, m: int, scale: int = 10) -> Context:
    """Grade = scale * count // largest count of the object, per (obj, attr) cell.

    An attribute outside 0..m-1 fails the job; a null one counts nowhere, and an object with no other has all grades 0.
    """
    message = F.format_string("attribute %s of object %s is not among the %d expected", attr.cast("string"), obj.cast("string"), F.lit(m))
    known = F.when(attr.isNull() | ((attr >= 0) & (attr < m)), attr).otherwise(F.raise_error(message))
    hits = facts.select(obj.alias("obj"), known.alias("attr"))
    counts = hits.groupBy("obj").agg(*[F.count_if(F.col("attr") == j).alias(f"c{j}") for j in range(m)])
    cells = [F.col(f"c{j}") for j in range(m)]
    top = F.greatest(*cells) if m > 1 else cells[0]
    counted = counts.select("obj", F.greatest(top, F.lit(1)).alias("top"), *cells)
    grades = F.array(*[F.expr(f"cast(({scale} * c{j}) div top as int)") for j in range(m)])
    return Context(counted.select("obj", grades.alias("grades")), m, scale)


def grade_vectors(vectors: DataFrame, obj: Column, vector: Column, m: int, scale: int = 10) -> Context:
    """Grade each vector by min-max scaling within the row; row-local, no shuffle.

    A constant vector has all grades 0; one of another length than ``m`` fails the job.
    """
    message = F.format_string("vector of object %s has %d components, not %d", obj.cast("string"), F.size(vector), F.lit(m))
    sized = F.when(F.size(vector) == m, vector).otherwise(F.raise_error(message))
    rows = vectors.select(obj.alias("obj"), sized.alias("v"), F.array_min(vector).cast("double").alias("lo"),
                          F.array_max(vector).cast("double").alias("hi"))
    spread = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    cells = F.transform("v", lambda x: F.floor(scale * (x.cast("double") - F.col("lo")) / spread).cast("int"))
    return Context(rows.select("obj", cells.alias("grades")), m, scale)


def from_long(cells: DataFrame, m: int, scale: int = 10) -> Context:
    """Context from (obj, attr, q) rows; absent cells are 0."""
    wide = cells.groupBy("obj").agg(
        *[F.coalesce(F.max(F.when(F.col("attr") == j, F.col("q"))), F.lit(0)).cast("int").alias(f"g{j}") for j in range(m)])
    return Context(wide.select("obj", F.array(*[f"g{j}" for j in range(m)]).alias("grades")), m, scale)


def alpha_cut(ctx: Context, level: int) -> Context:
    """1 where the grade reaches ``level`` (inclusive), else 0."""
    return ctx.map_cells(lambda g: (g >= level).cast("int"), scale=1)


def scaling_map(ctx: Context) -> DataFrame:
    """(crisp_attr, fuzzy_attr, value): the distinct positive values per attribute, ascending.

    At most ``m * scale`` rows, whatever the number of objects.
    """
    seen = ctx.long().where("q > 0").select(F.col("attr").alias("fuzzy_attr"), F.col("q").alias("value")).distinct()
    rank = F.row_number().over(Window.orderBy("fuzzy_attr", "value")) - 1
    return seen.select(rank.cast("int").alias("crisp_attr"), "fuzzy_attr", "value")


def _scaled(ctx: Context, mapping: Sequence[tuple[int, int]], ordinal: bool) -> Context:
    if len(mapping) > 64 * UNROLL_LIMIT:
        raise ValueError("scaled context too wide; use scaled_cells, which stays in long form")
    if len(mapping) <= UNROLL_LIMIT:
        tests = [F.col("grades")[a] >= v if ordinal else F.col("grades")[a] == v for a, v in mapping]
        cells = F.array(*[t.cast("int") for t in tests])
    else:
        pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(v).alias("v")) for a, v in mapping])
        def test(p: Column) -> Column:
            grade = F.get("grades", p["a"])
            return ((grade >= p["v"]) if ordinal else (grade == p["v"])).cast("int")
        cells = F.transform(pairs, test)
    return Context(ctx.frame.select("obj", cells.alias("grades")), len(mapping), 1)


def _mapping_rows(ctx: Context) -> list[tuple[int, int]]:
    # bounded: at most m * scale (attribute, level) pairs
    return [(r.fuzzy_attr, r.value) for r in scaling_map(ctx).orderBy("crisp_attr").collect()]


def nominal_scaling(ctx: Context) -> Context:
    """One crisp attribute per distinct positive (attribute, value); held iff equal."""
    ctx = ctx.staged()
    return _scaled(ctx, _mapping_rows(ctx), ordinal=False)


def ordinal_scaling(ctx: Context) -> Context:
    """Same columns as nominal scaling; held iff the grade reaches the value."""
    ctx = ctx.staged()
    return _scaled(ctx, _mapping_rows(ctx), ordinal=True)


def scaled_cells(ctx: Context, ordinal: bool = False) -> DataFrame:
    """Sparse long form (obj, crisp_attr) of the ones; the map is broadcast (<= m * scale rows)."""
    ctx = ctx.staged()
    mapping = F.broadcast(scaling_map(ctx))
    held = F.col("q") >= F.col("value") if ordinal else F.col("q") == F.col("value")
    return (ctx.long().join(mapping, (F.col("attr") == F.col("fuzzy_attr")) & held)
            .select("obj", "crisp_attr"))


def context_stats(ctx: Context) -> DataFrame:
    """n, m, mean grade, density, number of ones, and the width after nominal scaling."""
    hist = ctx.long().groupBy("attr", "q").agg(F.count(F.lit(1)).alias("n"))  # <= m * (scale + 1) rows
    positive = F.col("q") > 0
    zero = F.lit(0).cast("bigint")
    base = hist.agg(
        F.sum("n").alias("cells"), F.sum(F.col("q") * F.col("n")).alias("total"),
        F.sum(F.when(positive, F.col("n")).otherwise(zero)).alias("n_positive"),
        F.sum(F.when(F.col("q") == ctx.scale, F.col("n")).otherwise(zero)).alias("n_ones"),
        F.count_if(positive).alias("scaled_attrs"))
    n_objects = F.expr(f"cells div {ctx.m}")
    return base.select(
        n_objects.alias("n_objects"), F.lit(ctx.m).cast("bigint").alias("n_attrs"),
        F.round(F.col("total") / (F.col("cells") * ctx.scale), 6).alias("avg_grade"),
        F.round(F.col("n_positive") / F.col("cells"), 6).alias("density"), "n_ones", "scaled_attrs",
        F.round(F.col("n_positive") / (n_objects * F.col("scaled_attrs")), 6).alias("scaled_density"),
        F.round(F.col("scaled_attrs") / F.lit(ctx.m), 6).alias("expansion"))


def explain_scaling(ctx: Context, obj=None) -> DataFrame:
    """Per object (or for one): each scaled attribute, the value it stands for, and whether it holds."""
    ctx = ctx.staged()
    cells = ctx.long() if obj is None else Context(ctx.frame.where(F.col("obj") == obj), ctx.m, ctx.scale).long()
    mapping = F.broadcast(scaling_map(ctx))  # <= m * scale rows
    return cells.join(mapping, F.col("attr") == F.col("fuzzy_attr")).select(
        "obj", "crisp_attr", "fuzzy_attr", "value", "q", (F.col("q") == F.col("value")).alias("held"))


def object_sets(ctx: Context, level: int) -> DataFrame:
    """Per object, the mask of attributes graded at least ``level``."""
    return ctx.frame.select("obj", *masks.mask_where(F.col("grades"), ctx.m, lambda g: g >= level))
