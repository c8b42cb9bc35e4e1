"""Derivation operators as quantified aggregations.

Extents need every (set, object) pair, which is the size of their result.  The
pairs come from an equi-join on the attribute: with few sets the members are
broadcast and the rows never leave their partition; with many, both sides are
salted on the attribute so that the handful of attribute keys does not pin the
work to a handful of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelattice.functions import fuzzy, masks
from gradelattice.functions.fuzzy import Implication, Rounding
from gradelattice.operators.closure import ModalClosure
from gradelattice.operators.context import Context
from gradelattice.session import stage_observed

BROADCAST_MEMBERS = 1 << 20  # (set, attribute) rows
FLOOR_ATTR = -1              # stands for the grade 0 every extent starts from


def _on_attribute(cells: DataFrame, members: DataFrame, max_broadcast: int) -> DataFrame:
    """Equi-join cells (obj, attr, q) with members (set_id, attr, ...) on the attribute."""
    members, seen = stage_observed(members, "set-members", n=F.count(F.lit(1)))
    if seen["n"] <= max_broadcast:
        return cells.join(F.broadcast(members), "attr")
    salts = max(64, 4 * cells.sparkSession.sparkContext.defaultParallelism)
    salted = cells.withColumn("salt", F.pmod(F.xxhash64("obj"), F.lit(salts)).cast("int"))
    copies = members.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, ["attr", "salt"])


def set_members(sets: DataFrame, m: int) -> DataFrame:
    """(set_id, attr) rows of masks, plus the floor row of each set."""
    attrs = masks.members([F.col(c) for c in masks.mask_cols(m)], m)
    return sets.select("set_id", F.explode(F.concat(F.array(F.lit(FLOOR_ATTR)), attrs)).alias("attr"))


def modal_extents(sets: DataFrame, ctx: Context, max_broadcast: int = BROADCAST_MEMBERS) -> DataFrame:
    """(set_id, obj, ext): largest grade of the object over the set, at least 0."""
    cells = ctx.frame.select("obj", F.explode(F.concat(
        F.array(F.struct(F.lit(FLOOR_ATTR).alias("attr"), F.lit(0).alias("q"))),
        F.transform("grades", lambda g, j: F.struct(j.alias("attr"), g.alias("q"))))).alias("c")).select("obj", "c.*")
    pairs = _on_attribute(cells, set_members(sets, ctx.m), max_broadcast)
    return pairs.groupBy("set_id", "obj").agg(F.max("q").alias("ext"))


def modal_intents(extents: DataFrame, ctx: Context) -> DataFrame:
    """(set_id, mask): attributes no object grades above its extent.

    Each (set, object) row folds its violations into one mask, OR-ed map-side.
    """
    cols = masks.mask_cols(ctx.m)
    rows = extents.join(ctx.frame, "obj")
    above = masks.mask_where(F.col("grades"), ctx.m, lambda g: g > F.col("ext"))
    broken = rows.select("set_id", *above).groupBy("set_id").agg(*[F.bit_or(c).alias(c) for c in cols])
    full = masks.full_words(ctx.m)
    return broken.select("set_id", *[F.lit(int(f)).bitwiseAND(F.bitwise_not(F.col(c))).alias(c) for f, c in zip(full, cols)])


def modal_closures(sets: DataFrame, ctx: Context) -> DataFrame:
    """Append the closure of each set's mask."""
    return ModalClosure(ctx).close(sets)


def concept_extents(concepts: DataFrame, ctx: Context) -> DataFrame:
    """(mask.., obj, ext) of every concept."""
    cols = masks.mask_cols(ctx.m)
    keyed = concepts.select(F.struct(*cols).alias("set_id"), *cols)
    return modal_extents(keyed, ctx).select("set_id.*", "obj", "ext")


def _cell_value(a: Column, b: Column, kind: Implication, scale: int, rounding: Rounding) -> Column:
    if rounding is Rounding.NONE:
        return fuzzy.implies_real(a / F.lit(float(scale)), b / F.lit(float(scale)), kind)
    return fuzzy.implies_level(a, b, kind, scale, rounding)


def derive_down(sets: DataFrame, ctx: Context, kind: Implication = Implication.LUKASIEWICZ,
                rounding: Rounding = Rounding.FLOOR, max_broadcast: int = BROADCAST_MEMBERS) -> DataFrame:
    """(set_id, obj, ext): min over attributes of set grade -> context grade."""
    members = sets.select("set_id", F.posexplode("grades").alias("attr", "level"))
    pairs = _on_attribute(ctx.long(), members, max_broadcast)
    value = _cell_value(F.col("level"), F.col("q"), kind, ctx.scale, rounding)
    return pairs.groupBy("set_id", "obj").agg(F.min(value).alias("ext"))


def derive_up(extents: DataFrame, ctx: Context, kind: Implication = Implication.LUKASIEWICZ,
              rounding: Rounding = Rounding.FLOOR) -> DataFrame:
    """(set_id, grades): min over objects of extent grade -> context grade.

    All attributes are folded in one aggregation, so a (set, object) row is
    never multiplied by the attributes.  Objects absent from an extent grade 0
    there and impose nothing.
    """
    rows = extents.join(ctx.frame, "obj")
    mins = rows.groupBy("set_id").agg(*[
        F.min(_cell_value(F.col("ext"), F.col("grades")[j], kind, ctx.scale, rounding)).alias(f"g{j}")
        for j in range(ctx.m)])
    return mins.select("set_id", F.array(*[f"g{j}" for j in range(ctx.m)]).alias("grades"))
