"""Lattice metrics from a vertex frame and a cover relation.

Vertices are ``id`` (any type), edges ``child`` and ``parent``.  Iterations walk
along edges with joins on the child; they are bounded by the height of the
lattice and cut by staged tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradelattice.operators.enumerate import ordered_rank
from gradelattice.session import Observation, Pile, stage_observed, stage_path


def _key(cols: list[str], name: str) -> Column:
    """One key column as it is; several become one struct."""
    return (F.col(cols[0]) if len(cols) == 1 else F.struct(*[F.col(c).alias(f"w{i}") for i, c in enumerate(cols)])).alias(name)


def vertex_frame(sets: DataFrame, cols: list[str]) -> DataFrame:
    """id column, of the same type as the ends of ``edge_frame``."""
    return sets.select(_key(cols, "id"))


def edge_frame(covers: DataFrame, child: list[str], parent: list[str]) -> DataFrame:
    """child/parent columns; several key columns become one struct."""
    return covers.select(_key(child, "child"), _key(parent, "parent"))


def _stage_counted(frame: DataFrame, label: str) -> tuple[DataFrame, int]:
    written, seen = stage_observed(frame, label, n=F.count(F.lit(1)))
    return written, seen["n"]


HOPS = 6                # relaxation rounds chained in one job
MANY_EDGES = 1 << 20    # from here on edges are kept partitioned in memory and on disk


def levels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): length of the longest chain of edges below each vertex.

    After k rounds of ``level(parent) = max(level, level(child) + 1)`` a level is
    the smaller of k and its final value, so the walk is over once no level has
    reached the number of rounds.  A vertex keeps its level through an edge of
    step 0 to itself, so a round uses the last one only once.  Many edges are
    kept partitioned by child: a round joins in place and shuffles once, on the
    parent.  Few are left to Catalyst, which broadcasts them while they are small.
    """
    spark = edges.sparkSession
    stay = vertices.select(F.col("id").alias("child"), F.col("id").alias("parent"), F.lit(0).alias("step"))
    steps, n = _stage_counted(edges.select("child", "parent", F.lit(1).alias("step")).unionByName(stay), "edges")
    many = n > MANY_EDGES
    if many:
        steps = steps.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "child").persist()
    state, rounds = vertices.select("id", F.lit(0).alias("level")), 0
    while True:
        for _ in range(HOPS):
            raised = steps.join(state.hint("shuffle_hash") if many else state, F.col("child") == F.col("id"))
            state = raised.groupBy(F.col("parent").alias("id")).agg(F.max(F.col("level") + F.col("step")).alias("level"))
        rounds += HOPS
        state, seen = stage_observed(state, "levels", top=F.max("level"))
        if (seen["top"] or 0) < rounds:
            steps.unpersist()
            return state


def topological_levels(vertices: DataFrame, edges: DataFrame, rank) -> tuple[DataFrame, int]:
    """(id, level) as by ``levels``, and how many edge rows were read: each edge once.

    ``rank`` gives an integer column of a vertex that grows along every edge, such as the size of a set.  Vertices and edges
    are laid out by the rank of the vertex and of the child.  Ranks are finished from the lowest on: a vertex is freed with
    the largest level its children have sent it, and only the edges of freed vertices are read, to send levels on to
    tables laid out by the rank of the parent.  To the driver come the distinct ranks only.
    """
    spark = edges.sparkSession
    root = stage_path(spark, "topological")
    vertices.select("id", rank(F.col("id")).cast("int").alias("r")).write.partitionBy("r").parquet(f"{root}/vertices")
    laid = edges.select("child", "parent", rank(F.col("child")).cast("int").alias("r"), rank(F.col("parent")).cast("int").alias("p"))
    bad = F.when(F.col("p") <= F.col("r"), F.raise_error("an edge does not go up in rank").cast("int")).otherwise(F.col("r"))
    laid.withColumn("r", bad).write.partitionBy("r").parquet(f"{root}/edges")
    ranks, sources = ({x.r for x in spark.read.parquet(f"{root}/{kind}").select("r").distinct().collect()} if some else set()
                      for kind, some in (("vertices", not vertices.isEmpty()), ("edges", not edges.isEmpty())))
    vertex, edge = vertices.select("id").schema, edges.select("child", "parent").schema.add("p", T.IntegerType())
    sent = edges.select(F.col("parent").alias("id"), F.lit(0).alias("level")).schema
    done, read, targets = Pile(spark, "topological-levels", vertices.select("id", F.lit(0).alias("level")).schema), 0, {}
    for r in sorted(ranks):
        freed = spark.read.schema(vertex).parquet(f"{root}/vertices/r={r}")
        inbox = [f"{root}/sent/{q}/p={r}" for q, to in targets.items() if r in to]
        level = F.lit(0)
        if inbox:
            most = spark.read.schema(sent).parquet(*inbox).groupBy("id").agg(F.max("level").alias("most"))
            freed, level = freed.join(most, "id", "left"), F.coalesce("most", F.lit(0))
        known, _ = done.add(freed.select("id", level.alias("level")))
        if r in sources:
            out = spark.read.schema(edge).parquet(f"{root}/edges/r={r}").join(known, F.col("child") == F.col("id"))
            seen = Observation()
            out.select(F.col("parent").alias("id"), (F.col("level") + 1).alias("level"), "p").observe(
                seen, F.count(F.lit(1)).alias("n"), F.collect_set("p").alias("to")).write.partitionBy("p").parquet(f"{root}/sent/{r}")
            targets[r], read = set(seen.get["to"]), read + seen.get["n"]
    return done.all, read


def topological_order(vertices: DataFrame, edges: DataFrame, rank) -> DataFrame:
    """(id, level, position): positions in which every child comes before its parents, by level and then by id."""
    return ordered_rank(topological_levels(vertices, edges, rank)[0], ["level", "id"], "position")


def height(levels_: DataFrame) -> DataFrame:
    """Vertices on the longest chain; 0 when there are none."""
    return levels_.agg(F.coalesce(F.max("level") + 1, F.lit(0)).cast("bigint").alias("height"))


def level_sizes(levels_: DataFrame) -> DataFrame:
    return levels_.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def width_levels(levels_: DataFrame) -> DataFrame:
    """Size of the largest longest-path level: a lower bound on the width."""
    return level_sizes(levels_).agg(F.coalesce(F.max("n"), F.lit(0)).alias("width_levels"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree): parents and children per vertex, in one aggregation."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    ends = (vertices.select("id", none.alias("o"), none.alias("i"))
            .unionByName(edges.select(F.col("child").alias("id"), one.alias("o"), none.alias("i")))
            .unionByName(edges.select(F.col("parent").alias("id"), none.alias("o"), one.alias("i"))))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def degree_stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean, upper median and maximum of both degrees.

    The median comes from a cumulated histogram with one row per distinct
    degree, so no global sort of the vertices is needed.
    """
    per = degrees(vertices, edges)
    both = per.select(F.explode(F.array(
        F.struct(F.lit("out").alias("side"), F.col("out_degree").alias("d")),
        F.struct(F.lit("in").alias("side"), F.col("in_degree").alias("d")))).alias("s")).select("s.*")
    hist = both.groupBy("side", "d").agg(F.count(F.lit(1)).alias("n"))
    side = Window.partitionBy("side")
    upto = F.sum("n").over(side.orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    ranked = hist.select("side", "d", "n", upto.alias("upto"), F.sum("n").over(side).alias("total"))
    middle = F.when(F.col("upto") > F.expr("total div 2"), F.col("d"))
    return ranked.groupBy("side").agg(
        F.round(F.sum(F.col("d") * F.col("n")) / F.max("total"), 6).alias("avg_degree"),
        F.min(middle).alias("median_degree"), F.max("d").alias("max_degree"))


def lattice_metrics(vertices: DataFrame, edges: DataFrame, levels_: DataFrame | None = None) -> DataFrame:
    """One row: vertices, edges, edges per vertex, height and level width."""
    lv = levels_ if levels_ is not None else levels(vertices, edges)
    sizes = level_sizes(lv).select(F.col("level"), F.col("n"), F.lit(0).cast("bigint").alias("e"))
    rows = sizes.unionByName(edges.agg(F.count(F.lit(1)).alias("e")).select(
        F.lit(None).cast("int").alias("level"), F.lit(0).cast("bigint").alias("n"), "e"))
    return rows.agg(
        F.sum("n").alias("n_vertices"), F.sum("e").alias("n_edges"),
        F.round(F.sum("e") / F.sum("n"), 6).alias("avg_degree"),
        F.coalesce(F.max("level") + 1, F.lit(0)).cast("bigint").alias("height"),
        F.max("n").alias("width_levels"))


def metrics_log(vertices: DataFrame, edges: DataFrame, counters: DataFrame | None = None) -> DataFrame:
    """(metric, value) rows: size, height, level width, degree figures and, if given, the counters of the enumeration."""
    def rows(frame: DataFrame, prefix: str = "") -> DataFrame:
        pairs = [F.struct(F.lit(prefix + c).alias("metric"), F.col(c).cast("double").alias("value")) for c in frame.columns]
        return frame.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    stats = degree_stats(vertices, edges)
    named = [rows(stats.where(F.col("side") == side).drop("side"), f"{side}_") for side in ("out", "in")]
    out = rows(lattice_metrics(vertices, edges)).where("metric <> 'avg_degree'")
    for more in [*named, *([rows(counters)] if counters is not None else [])]:
        out = out.unionByName(more)
    return out


def width_exact(vertices: DataFrame, edges: DataFrame, levels_: DataFrame | None = None) -> DataFrame:
    """Largest antichain: vertices minus a maximum matching of the strict order.

    The order itself is never built.  A vertex is split into a left copy (the
    lower end of a chain link) and a right copy (the upper end); a left copy
    reaches every right copy above it by walking cover edges.  Each phase grows
    disjoint search trees from all unmatched left copies, every right copy being
    claimed by one tree, and flips the path of each tree that meets an unmatched
    right copy.  The matching is maximum once no tree does, or once the bound it
    gives meets the largest level, which is an antichain.
    """
    edges, _ = _stage_counted(edges.select("child", "parent"), "width-edges")
    lv = levels_ if levels_ is not None else levels(vertices, edges)
    known = level_sizes(lv).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("size"), F.coalesce(F.max("n"), F.lit(0)).alias("floor")).first()
    matched, pairs = _greedy_links(edges)
    while known["size"] - pairs > known["floor"]:
        flipped, gained = _augment(vertices, edges, matched)
        if gained == 0:
            break
        kept = matched.join(flipped.select("lower"), "lower", "left_anti").join(flipped.select("upper"), "upper", "left_anti")
        matched, pairs = _stage_counted(kept.unionByName(flipped), "matching")
    return vertices.sparkSession.range(1).select(F.lit(known["size"] - pairs).cast("bigint").alias("width_exact"))


def _greedy_links(edges: DataFrame) -> tuple[DataFrame, int]:
    """Maximal matching along cover edges by mutual proposals, scarcest neighbours first."""
    free = edges.select(F.col("child").alias("lower"), F.col("parent").alias("upper"))
    links, total = Pile(edges.sparkSession, "links", free.schema), 0
    while True:
        rest = free
        if links.paths:
            rest = rest.join(links.all.select("lower"), "lower", "left_anti").join(links.all.select("upper"), "upper", "left_anti")
        ups = rest.groupBy("upper").agg(F.count(F.lit(1)).alias("up_degree"))
        downs = rest.groupBy("lower").agg(F.count(F.lit(1)).alias("low_degree"))
        scored = rest.join(ups, "upper").join(downs, "lower")
        spread = F.xxhash64("lower", "upper", F.lit(len(links.paths)))
        offer = scored.groupBy("lower").agg(F.min(F.struct("up_degree", spread.alias("h"), "upper")).alias("o"), F.first("low_degree").alias("low_degree"))
        taken = offer.select("lower", "low_degree", "o.upper", "o.h").groupBy("upper").agg(
            F.min(F.struct("low_degree", "h", "lower")).alias("t"))
        _, seen = links.add(taken.select(F.col("t.lower").alias("lower"), "upper"))
        if seen["n"] == 0:
            return links.all, total
        total += seen["n"]


def _augment(vertices: DataFrame, edges: DataFrame, matched: DataFrame) -> tuple[DataFrame, int]:
    """Links of the flipped paths of one phase, and how many paths there were.

    Tree rows are right copies: ``upper``, the left copy ``via`` they hang on,
    the tree's ``root`` and the matched left copy ``mate``, if any.  A tree stops
    growing once it has met an unmatched right copy.
    """
    spark = edges.sparkSession
    roots = vertices.select("id").join(matched, F.col("id") == F.col("lower"), "left_anti").select("id")
    front = roots.select(F.col("id").alias("at"), F.col("id").alias("via"), F.col("id").alias("root"))
    mates = matched.select("upper", F.col("lower").alias("mate"))
    tree = None
    while True:
        steps = front.join(edges, F.col("at") == F.col("child")).select(F.col("parent").alias("upper"), "via", "root")
        if tree is not None:
            steps = steps.join(tree.all.select("upper"), "upper", "left_anti").join(
                tree.all.where("mate is null").select("root"), "root", "left_anti")
        claim = steps.groupBy("upper").agg(F.min(F.struct("root", "via")).alias("c"))
        fresh = claim.select("upper", "c.via", "c.root").join(mates, "upper", "left").select("upper", "via", "root", "mate")
        if tree is None:
            tree = Pile(spark, "tree", fresh.schema)
        part, seen = tree.add(fresh)
        if seen["n"] == 0:
            break
        # on from a right copy: past it along covers (same left copy), or into its mate
        front = part.select(F.col("upper").alias("at"), "via", "root").unionByName(
            part.where("mate is not null").select(F.col("mate").alias("at"), F.col("mate").alias("via"), "root"))
    ends = tree.all.where("mate is null").groupBy("root").agg(F.min("upper").alias("upper"))
    step, gained = _stage_counted(ends.select("root", "upper"), "ends")
    if gained == 0:
        return matched, 0
    # walk all found paths back to their roots in lock step, mate by mate
    flips = Pile(spark, "flips", matched.select(F.col("lower").alias("root"), "lower", "upper").schema)
    while True:
        hop = step.join(tree.all, ["root", "upper"]).select("root", F.col("via").alias("lower"), "upper")
        part, seen = flips.add(hop, more=F.count_if(F.col("lower") != F.col("root")))
        if not seen["more"]:
            return flips.all.select("lower", "upper"), gained
        back = part.where("lower != root").select("root", "lower").join(mates.withColumnRenamed("mate", "lower"), "lower")
        step = back.select("root", "upper")
