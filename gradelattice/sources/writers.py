"""Text sinks: every writer builds ordered lines and writes them in parallel.

A frame of lines has ``pos`` (sort columns) and ``value``.  It is range
partitioned on its order and written as numbered part files, whose
concatenation is the document; nothing is gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelattice.functions import masks
from gradelattice.operators.context import Context
from gradelattice.operators.derivation import concept_extents
from gradelattice.operators.enumerate import ordered_rank
from gradelattice.operators.real import RealContext

# Words of the text formats.
CONCEPT_WORD = "FDMConcept"
DOT_UNDIRECTED = ("graph Hasse {", "rankdir=BT;", "node [shape=box];")
DOT_DIRECTED = ("digraph fuzzy_lattice {", "    rankdir=BT;", "    node [shape=circle];")
INDEX_HEADER = ("# index -> fuzzy intent", "# format: idx  val/attr val/attr ...")
DOT_EDGE_WARNING = 100_000


def write_lines(lines: DataFrame, path: str) -> None:
    order = [c for c in lines.columns if c != "value"]
    parts = max(1, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged.select("value").write.text(path)


def _fixed(frame: DataFrame, texts, section: int) -> DataFrame:
    """Constant lines at the head or foot of a document."""
    spark = frame.sparkSession
    return spark.range(len(texts)).select(
        F.lit(section).alias("section"), F.col("id").alias("pos"), F.lit(0).cast("bigint").alias("sub"),
        F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("id") + 1).cast("int")).alias("value"))


def _grade(q: Column, scale: int) -> Column:
    digits = len(str(scale)) - 1
    if scale == 1:
        return q.cast("string")
    return F.format_string(f"%.{digits}f", q.cast("double") / scale)


def real_lines(ctx: RealContext) -> DataFrame:
    """Header ``n m`` and one row of real grades per object, each with all its digits."""
    header = ctx.frame.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("pos"), F.concat_ws(" ", F.col("n").cast("string"), F.lit(str(ctx.m))).alias("value"))
    rows = ordered_rank(ctx.frame, ["obj"], "pos").select(
        F.lit(1).alias("section"), "pos", F.array_join(F.transform("values", lambda v: v.cast("string")), " ").alias("value"))
    return header.unionByName(rows)


def context_lines(ctx: Context) -> DataFrame:
    """Header ``n m`` and one row of values per object, in object order."""
    ctx = ctx.staged()  # read by the count, the range sampling and the sort
    header = ctx.frame.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("pos"),
        F.concat_ws(" ", F.col("n").cast("string"), F.lit(str(ctx.m))).alias("value"))
    rows = ordered_rank(ctx.frame, ["obj"], "pos").select(
        F.lit(1).alias("section"), "pos",
        F.array_join(F.transform("grades", lambda q: _grade(q, ctx.scale)), " ").alias("value"))
    return header.unionByName(rows)


def ranked_concepts(concepts: DataFrame, m: int) -> DataFrame:
    """Masks with ``attrs`` (ascending ids) and their 0-based lexicographic ``rank``."""
    cols = masks.mask_cols(m)
    listed = concepts.select(*cols, masks.members([F.col(c) for c in cols], m).alias("attrs"))
    return ordered_rank(listed, ["attrs"], "rank")


def set_text(attrs: Column) -> Column:
    """``{a1, a3}`` from 0-based ids."""
    return F.concat(F.lit("{"), F.array_join(F.transform(attrs, lambda a: F.concat(F.lit("a"), (a + 1).cast("string"))), ", "),
                    F.lit("}"))


def hasse_lines(ranked: DataFrame) -> DataFrame:
    """One ``{a1, a3},`` line per concept, in lexicographic order."""
    return ranked.select(F.col("rank").alias("pos"), F.concat(set_text(F.col("attrs")), F.lit(",")).alias("value"))


def concept_lines(ranked: DataFrame, ctx: Context) -> DataFrame:
    """Full listing: number, attributes, and the extent grade of every object (integer object ids)."""
    cols = masks.mask_cols(ctx.m)
    def part(sub: int, value: Column) -> DataFrame:
        return ranked.select(F.col("rank").alias("pos"), F.lit(sub).cast("bigint").alias("sub"), value.alias("value"))
    number = F.concat(F.lit(f"{CONCEPT_WORD} "), (F.col("rank") + 1).cast("string"), F.lit(":"))
    head = part(-3, number).unionByName(part(-2, F.concat(F.lit("Attributes: "), set_text(F.col("attrs")))))
    head = head.unionByName(part(-1, F.lit("Objects:"))).unionByName(part(1 << 62, F.lit("")))
    extents = concept_extents(ranked, ctx).join(ranked.select(*cols, "rank"), cols)
    body = extents.select(
        F.col("rank").alias("pos"), F.col("obj").cast("bigint").alias("sub"),
        F.concat(F.lit("  o"), (F.col("obj") + 1).cast("string"), F.lit(": "), _grade(F.col("ext"), ctx.scale)).alias("value"))
    return head.unionByName(body)


def intent_text(grades: Column, scale: int, sep: str = " ") -> Column:
    """``0.800/0 0.300/2``: positive grades with their 0-based attribute."""
    pairs = F.transform(grades, lambda q, a: F.when(q > 0, F.concat(
        F.format_string("%.3f", q.cast("double") / scale), F.lit("/"), a.cast("string"))))
    return F.array_join(F.array_compact(pairs), sep)


def intent_lines(intents: DataFrame, n_objects: int, m: int, scale: int = 10) -> DataFrame:
    """Header ``n m count`` and ``I v/a ...`` per intent, in lectic order."""
    header = intents.agg(F.count(F.lit(1)).alias("c")).select(
        F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("pos"),
        F.concat_ws(" ", F.lit(str(n_objects)), F.lit(str(m)), F.col("c").cast("string")).alias("value"))
    text = intent_text(F.col("grades"), scale)
    rows = ordered_rank(intents.select("grades"), ["grades"], "pos").select(
        F.lit(1).alias("section"), "pos", F.concat(F.lit("I"), F.when(text != "", F.lit(" ")).otherwise(F.lit("")), text).alias("value"))
    return header.unionByName(rows)


def edge_lines(edges: DataFrame) -> DataFrame:
    """``from to`` per edge of (child, parent) ids."""
    return edges.select(F.col("child").alias("pos"), F.col("parent").alias("sub"),
                        F.concat_ws(" ", F.col("child").cast("string"), F.col("parent").cast("string")).alias("value"))


def dot_undirected(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """Labelled nodes (1-based attribute ids) and undirected edges between ranks."""
    label = F.array_join(F.transform("attrs", lambda a: (a + 1).cast("string")), ",")
    nodes = ranked.select(F.lit(1).alias("section"), F.col("rank").alias("pos"), F.lit(0).cast("bigint").alias("sub"),
                          F.concat(F.col("rank").cast("string"), F.lit(' [label="{'), label, F.lit('}"];')).alias("value"))
    links = edges.select(F.lit(2).alias("section"), F.col("child").alias("pos"), F.col("parent").alias("sub"),
                         F.concat(F.col("child").cast("string"), F.lit(" -- "), F.col("parent").cast("string"), F.lit(";")).alias("value"))
    return _fixed(ranked, DOT_UNDIRECTED, 0).unionByName(nodes).unionByName(links).unionByName(_fixed(ranked, ("}",), 3))


def dot_directed(edges: DataFrame) -> DataFrame:
    """Unlabelled ``child -> parent`` edges."""
    links = edges.select(F.lit(1).alias("section"), F.col("child").alias("pos"), F.col("parent").alias("sub"),
                         F.concat(F.lit("    "), F.col("child").cast("string"), F.lit(" -> "), F.col("parent").cast("string"),
                                  F.lit(";")).alias("value"))
    return _fixed(edges, DOT_DIRECTED, 0).unionByName(links).unionByName(_fixed(edges, ("}",), 2))


def index_lines(intents: DataFrame, scale: int = 10) -> DataFrame:
    """Two comment lines, then id and positive grades of each intent (``id``, ``grades``)."""
    pairs = F.transform("grades", lambda q, a: F.when(q > 0, F.concat(
        F.lit("  "), F.regexp_replace((q.cast("double") / scale).cast("string"), r"\.0$", ""), F.lit("/"), a.cast("string"))))
    rows = intents.select(F.lit(1).alias("section"), F.col("id").alias("pos"), F.lit(0).cast("bigint").alias("sub"),
                          F.concat(F.col("id").cast("string"), F.array_join(F.array_compact(pairs), "")).alias("value"))
    return _fixed(intents, INDEX_HEADER, 0).unionByName(rows)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The one-row metrics frame as JSON."""
    metrics.write.json(path)
