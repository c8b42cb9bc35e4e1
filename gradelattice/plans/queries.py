"""The registered queries: every operator over contexts of the star tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelattice.functions import fuzzy, masks
from gradelattice.functions.fuzzy import Implication, Rounding
from gradelattice.operators import containment, derivation, metrics, sampling
from gradelattice.operators import context as cx
from gradelattice.operators import enumerate as en
from gradelattice.operators.closure import FuzzyClosure, ModalClosure
from gradelattice.operators.context import Context
from gradelattice.operators.dominance import DominanceIndex
from gradelattice.operators.real import RealContext, real_closure, real_extents
from gradelattice.session import stage, stage_observed, stage_path
from gradelattice.sources import tables, text, writers
from gradelattice.streaming.incremental import IncrementalCovers, IncrementalLattice
from gradelattice.streaming.windowed import WindowedContexts

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

ALPHA = 7           # cut of the crisp brand context
TOP_LEVEL = 9       # grades counted as characteristic of an object
SAMPLE_BUDGET = 120
SAMPLE_LINES = 20
QUOTA = 200


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def joined(grades: Column | str) -> Column:
    return F.array_join(F.transform(grades, lambda g: g.cast("string")), ",")


def crisp_brands(spark: SparkSession, sf: str) -> Context:
    return cx.alpha_cut(tables.brand_size(spark, sf), ALPHA)


def nation_sets(spark: SparkSession, sf: str) -> DataFrame:
    """(set_id, grades): one fuzzy set of months per supplier nation."""
    return tables.nation_month(spark, sf).frame.select(F.col("obj").alias("set_id"), "grades")


# ---------------------------------------------------------------- contexts


@query
def context_long(spark, sf):
    return tables.supplier_month(spark, sf).long()


@query
def context_alpha_cut(spark, sf):
    return cx.alpha_cut(tables.supplier_month(spark, sf), ALPHA).long()


@query
def context_nominal_scaling(spark, sf):
    return cx.nominal_scaling(tables.customer_priority(spark, sf)).long()


@query
def context_ordinal_scaling(spark, sf):
    return cx.ordinal_scaling(tables.user_event(spark, sf)).long()


@query
def context_scaled_cells(spark, sf):
    return cx.scaled_cells(tables.supplier_month(spark, sf))


@query
def scaling_map(spark, sf):
    return cx.scaling_map(tables.customer_priority(spark, sf))


@query
def scaling_explain(spark, sf):
    return cx.explain_scaling(tables.brand_size(spark, sf))


@query
def context_stats(spark, sf):
    return cx.context_stats(tables.supplier_month(spark, sf))


@query
def context_clarified(spark, sf):
    rows = tables.customer_priority(spark, sf).clarified()
    return rows.select(joined("grades").alias("grades"), "n_objects")


@query
def context_embedding(spark, sf):
    return tables.embedding_dims(spark, sf).long()


@query
def context_documents(spark, sf):
    return tables.source_lang(spark, sf).long()


# ---------------------------------------------------------------- scalar functions


def _neighbours(spark, sf) -> DataFrame:
    """Each supplier's grades of one month (a) and the next (b)."""
    ctx = tables.supplier_month(spark, sf)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(ctx.m - 2)), lambda j: F.struct(
        j.alias("attr"), F.get("grades", j).alias("a"), F.get("grades", j + 1).alias("b")))
    return ctx.frame.select("obj", F.explode(pairs).alias("p")).select("obj", "p.*")


@query
def implication_luk(spark, sf):
    value = fuzzy.implies_level(F.col("a"), F.col("b"), Implication.LUKASIEWICZ, 10)
    return _neighbours(spark, sf).select("obj", "attr", value.alias("grade"))


@query
def implication_goguen(spark, sf):
    a, b = F.col("a"), F.col("b")
    real = fuzzy.implies_real(a / F.lit(10.0), b / F.lit(10.0), Implication.GOGUEN)
    return _neighbours(spark, sf).select(
        "obj", "attr", fuzzy.implies_level(a, b, Implication.GOGUEN, 10, Rounding.FLOOR).alias("floor_grade"),
        fuzzy.implies_level(a, b, Implication.GOGUEN, 10, Rounding.NEAREST).alias("nearest_grade"),
        F.round(real, 6).alias("real_grade"))


@query
def quantize_levels(spark, sf):
    value = F.col("l_discount") * 10
    names = {s: f"level_{n.lower()}" for n, s in fuzzy.LEVEL_SCALES.items()}
    rows = tables.table(spark, sf, "lineitem").select(*[fuzzy.quantize(value, s).alias(n) for s, n in names.items()])
    return rows.groupBy(*names.values()).agg(F.count(F.lit(1)).alias("n"))


@query
def pack_tenths(spark, sf):
    rows = tables.table(spark, sf, "lineitem").select(fuzzy.pack_tenths(F.col("l_quantity") / 50).alias("tenths"))
    return rows.groupBy("tenths").agg(F.count(F.lit(1)).alias("n"))


def _supplier_and_nation(spark, sf) -> DataFrame:
    """Each supplier's grades beside those of its nation."""
    own = tables.supplier_month(spark, sf).frame.select("obj", F.col("grades").alias("a"))
    home = tables.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation = tables.nation_month(spark, sf).frame.select(F.col("obj").alias("nation"), F.col("grades").alias("b"))
    return own.join(home, own.obj == home.s_suppkey).join(nation, F.col("nation") == F.col("s_nationkey")).select("obj", "a", "b")


@query
def fuzzy_intersection(spark, sf):
    return _supplier_and_nation(spark, sf).select("obj", joined(fuzzy.intersection(F.col("a"), F.col("b"))).alias("grades"))


@query
def fuzzy_union(spark, sf):
    return _supplier_and_nation(spark, sf).select("obj", joined(fuzzy.union(F.col("a"), F.col("b"))).alias("grades"))


@query
def fuzzy_compare(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _supplier_and_nation(spark, sf).select(
        "obj", fuzzy.equal(a, b).alias("same"), fuzzy.subset(a, b).alias("inside"),
        fuzzy.strict_subset(fuzzy.intersection(a, b), b).alias("meet_below"),
        fuzzy.set_size(a).alias("total"), fuzzy.support_card(a).alias("card"))


@query
def direct_sum(spark, sf):
    ctx = tables.nation_month(spark, sf)
    sums = F.array(*[F.struct(F.lit(j).alias("attr"), fuzzy.direct_sum(F.col("grades"), j, TOP_LEVEL, ctx.m).alias("g"))
                     for j in range(ctx.m)])
    return ctx.frame.select("obj", F.explode(sums).alias("s")).select(
        "obj", "s.attr", F.coalesce(joined("s.g"), F.lit("none")).alias("grades"))


@query
def lectic_order(spark, sf):
    ctx = tables.supplier_month(spark, sf)
    ceiling = F.array(*[F.lit(10)] * ctx.m)
    tests = F.array(*[F.struct(F.lit(j).alias("attr"), fuzzy.lectic_before(
        F.col("grades"), F.concat(F.slice("grades", 1, j), F.slice(ceiling, j + 1, ctx.m)), j).alias("before"))
        for j in range(ctx.m)])
    return ctx.frame.select("obj", F.explode(tests).alias("t")).select("obj", "t.*")


@query
def intent_text(spark, sf):
    return tables.supplier_month(spark, sf).frame.select("obj", writers.intent_text(F.col("grades"), 10).alias("intent"))


# ---------------------------------------------------------------- derivations and closures


def _nation_masks(spark, sf) -> DataFrame:
    return cx.object_sets(tables.nation_month(spark, sf), TOP_LEVEL).withColumnRenamed("obj", "set_id")


@query
def modal_extent(spark, sf):
    return derivation.modal_extents(_nation_masks(spark, sf), tables.supplier_month(spark, sf))


@query
def modal_intent(spark, sf):
    ctx = tables.supplier_month(spark, sf).staged()
    return derivation.modal_intents(derivation.modal_extents(_nation_masks(spark, sf), ctx), ctx)


@query
def modal_closure(spark, sf):
    ctx = tables.seg_month(spark, sf).staged()
    return ModalClosure(ctx).close(cx.object_sets(ctx, TOP_LEVEL))


@query
def modal_closure_suppliers(spark, sf):
    ctx = tables.supplier_month(spark, sf).staged()
    return ModalClosure(ctx).close(cx.object_sets(ctx, TOP_LEVEL))


@query
def closure_large(spark, sf):
    """As for suppliers above, with the object rows streamed past the candidate sets instead of broadcast."""
    ctx = tables.supplier_month(spark, sf).staged()
    return ModalClosure(ctx, resident_bytes=0).close(cx.object_sets(ctx, TOP_LEVEL))


@query
def fuzzy_closure_large(spark, sf):
    """Closure of each nation's months against all suppliers, whose rows are streamed past."""
    ctx = tables.supplier_month(spark, sf).staged()
    closed = FuzzyClosure(ctx, resident_bytes=0).close(nation_sets(spark, sf))
    return closed.select("set_id", joined("closure").alias("closure"))


@query
def dm_closure_crisp(spark, sf):
    sets = cx.object_sets(tables.brand_size(spark, sf), TOP_LEVEL)
    return ModalClosure(crisp_brands(spark, sf)).close(sets)


@query
def modal_closure_wide(spark, sf):
    """64 attributes: two mask words."""
    ctx = tables.embedding_dims(spark, sf).staged()
    closed = ModalClosure(ctx).close(cx.object_sets(ctx, 8))
    outs = [F.col(c) for c in masks.mask_cols(ctx.m, "closure")]
    return closed.select("obj", joined(masks.members(outs, ctx.m)).alias("attrs"), masks.card(outs).alias("card"))


@query
def derive_down_luk(spark, sf):
    return derivation.derive_down(nation_sets(spark, sf), tables.supplier_month(spark, sf))


def _up(spark, sf, kind, rounding) -> DataFrame:
    ctx = tables.supplier_month(spark, sf)
    extents = tables.supplier_flag(spark, sf).frame.select(
        F.col("obj"), F.posexplode("grades").alias("set_id", "ext"))
    return derivation.derive_up(extents, ctx, kind, rounding)


@query
def derive_up_luk(spark, sf):
    up = _up(spark, sf, Implication.LUKASIEWICZ, Rounding.FLOOR)
    return up.select("set_id", joined("grades").alias("grades"))


@query
def derive_down_goguen(spark, sf):
    return derivation.derive_down(nation_sets(spark, sf), tables.supplier_month(spark, sf), Implication.GOGUEN)


@query
def derive_up_goguen(spark, sf):
    up = _up(spark, sf, Implication.GOGUEN, Rounding.FLOOR)
    return up.select("set_id", joined("grades").alias("grades"))


@query
def derive_down_goguen_nearest(spark, sf):
    return derivation.derive_down(nation_sets(spark, sf), tables.supplier_month(spark, sf), Implication.GOGUEN, Rounding.NEAREST)


@query
def derive_down_goguen_real(spark, sf):
    down = derivation.derive_down(nation_sets(spark, sf), tables.supplier_month(spark, sf), Implication.GOGUEN, Rounding.NONE)
    return down.select("set_id", "obj", F.round("ext", 6).alias("ext"))


def _fuzzy_closures(spark, sf, kind) -> DataFrame:
    """Closure of each supplier's characteristic months, as a full-grade fuzzy set."""
    ctx = tables.supplier_month(spark, sf).staged()
    sharp = ctx.map_cells(lambda g: F.when(g >= TOP_LEVEL, 10).otherwise(0), 10)
    return FuzzyClosure(ctx, kind).close(sharp.frame).select("obj", joined("closure").alias("closure"))


@query
def closure_luk(spark, sf):
    return _fuzzy_closures(spark, sf, Implication.LUKASIEWICZ)


@query
def closure_goguen(spark, sf):
    return _fuzzy_closures(spark, sf, Implication.GOGUEN)


@query
def concept_join(spark, sf):
    """Join of the closures of an object's top months and its wider months."""
    ctx = tables.seg_month(spark, sf).staged()
    closure = ModalClosure(ctx)
    a = closure.close(cx.object_sets(ctx, 10)).select("obj", F.col("closure").alias("a"))
    b = closure.close(cx.object_sets(ctx, 8)).select("obj", F.col("closure").alias("b"))
    both = a.join(b, "obj").select("obj", "a", "b", F.col("a").bitwiseOR(F.col("b")).alias("mask"))
    return closure.close(both).select("obj", "a", "b", F.col("closure").alias("joined"))


# ---------------------------------------------------------------- enumeration


def _sized(concepts: DataFrame) -> DataFrame:
    return concepts.select("mask", masks.card([F.col("mask")]).alias("card"))


@query
def concepts_powerset(spark, sf):
    return _sized(en.powerset_concepts(tables.seg_month(spark, sf)))


@query
def concepts_cbo(spark, sf):
    return _sized(en.concepts(tables.seg_month(spark, sf)))


@query
def concepts_region(spark, sf):
    return _sized(en.concepts(tables.region_bucket(spark, sf)))


@query
def concepts_crisp(spark, sf):
    return _sized(en.concepts(crisp_brands(spark, sf)))


@query
def concepts_suppliers(spark, sf):
    return _sized(en.concepts(tables.supplier_month(spark, sf)))


@query
def concepts_types(spark, sf):
    """Fifty attributes, tens of thousands of concepts."""
    return _sized(en.concepts(tables.type_size(spark, sf)))


@query
def enumeration_counters(spark, sf):
    """Concepts found, closures computed for them, and closures the canonicity test turned down."""
    ctx = tables.seg_month(spark, sf)
    return en.enumeration_counters(en.concept_tree(ctx), ctx.m)


@query
def concepts_scaled(spark, sf):
    """Concepts of a nominally scaled context."""
    return _sized(en.concepts(cx.nominal_scaling(tables.region_bucket(spark, sf))))


@query
def concepts_with_bottom(spark, sf):
    ctx = crisp_brands(spark, sf)
    return _sized(en.with_bottom(en.concepts(ctx), ctx.m))


@query
def canonical_generator(spark, sf):
    return en.concept_tree(tables.seg_month(spark, sf))


@query
def concept_extents(spark, sf):
    ctx = tables.seg_month(spark, sf).staged()
    return derivation.concept_extents(en.concepts(ctx), ctx)


@query
def card_histogram(spark, sf):
    ctx = tables.seg_month(spark, sf)
    return sampling.card_histogram(en.concepts(ctx), ctx.m)


@query
def concept_order(spark, sf):
    ctx = tables.seg_month(spark, sf)
    return writers.ranked_concepts(en.concepts(ctx), ctx.m).select("mask", "rank")


@query
def fuzzy_concepts_luk(spark, sf):
    return en.fuzzy_concepts(tables.customer_status(spark, sf)).select(joined("grades").alias("grades"))


@query
def fuzzy_concepts_goguen(spark, sf):
    found = en.fuzzy_concepts(tables.customer_status(spark, sf), Implication.GOGUEN)
    return found.select(joined("grades").alias("grades"))


@query
def fuzzy_concepts_flags(spark, sf):
    return en.fuzzy_concepts(tables.supplier_flag(spark, sf)).select(joined("grades").alias("grades"))


@query
def fuzzy_concepts_users(spark, sf):
    """Five attributes at eleven levels."""
    return en.fuzzy_concepts(tables.user_event(spark, sf)).select(joined("grades").alias("grades"))


@query
def fuzzy_fixpoints_nearest(spark, sf):
    found = en.fuzzy_fixpoints(tables.nation_status(spark, sf), Implication.GOGUEN, Rounding.NEAREST)
    return found.select(joined("grades").alias("grades"))


@query
def next_closure_order(spark, sf):
    ranked = en.next_closure_order(en.fuzzy_concepts(tables.nation_status(spark, sf)))
    return ranked.select(joined("grades").alias("grades"), "position")


@query
def fuzzy_concepts_quota(spark, sf):
    """The first 200 intents of all users' in lectic order."""
    found = en.bounded_concepts(tables.user_event(spark, sf).staged(), QUOTA)
    return found.select(joined("grades").alias("grades"))


@query
def fuzzy_quota_work(spark, sf):
    """Whether the first 200 intents took less than a twentieth of the closures that all of them take."""
    closure = FuzzyClosure(tables.user_event(spark, sf).staged())
    found, few = en.lectic_prefix(closure.ctx, QUOTA, closure)
    _, every = en.fuzzy_enumeration(closure.ctx, closure=closure)
    return found.agg(F.count(F.lit(1)).alias("intents")).withColumn("few_closures", F.lit(20 * few["closures"] < every["closures"]))


@query
def fuzzy_counters(spark, sf):
    """Intents of all nations, raises tried for them, and those that led to no new one."""
    return en.fuzzy_counters(*en.fuzzy_enumeration(tables.nation_status(spark, sf)))


@query
def metrics_log(spark, sf):
    """Figures of the nations' fuzzy lattice and of its enumeration."""
    closure = FuzzyClosure(tables.nation_status(spark, sf).staged())
    intents, counts = en.fuzzy_enumeration(closure.ctx, closure=closure)
    covers = stage(containment.fuzzy_covers(intents, closure), "cover-edges")
    return metrics.metrics_log(intents.select(F.col("grades").alias("id")), metrics.edge_frame(covers, ["grades"], ["sup_grades"]),
                               en.fuzzy_counters(intents, counts))


@query
def forced_bounds(spark, sf):
    return en.forced_bounds(tables.supplier_flag(spark, sf)).select("bound", joined("grades").alias("grades"))


def _real_vectors(spark, sf, m: int) -> RealContext:
    """Vectors x their first ``m`` components, as they are."""
    return RealContext.of_vectors(tables.table(spark, sf, "embeddings"), F.col("vec_id"), F.slice("embedding", 1, m), m)


@query
def concepts_real(spark, sf):
    """Concepts of real grades, without rounding."""
    ctx = _real_vectors(spark, sf, 10).coded().staged()
    return _sized(en.concepts(ctx))


@query
def closure_real(spark, sf):
    """Closure of the components at which each vector has its largest grades."""
    real = _real_vectors(spark, sf, 10).staged()
    sets = real.alpha_cut(0.1).frame.select("obj", *masks.mask_where(F.col("grades"), 10, lambda g: g > 0))
    return real_closure(real).close(sets)


@query
def extents_real(spark, sf):
    real = _real_vectors(spark, sf, 4).staged()
    return real_extents(en.concepts(real.coded()), real)


@query
def scaling_map_real(spark, sf):
    return _real_vectors(spark, sf, 4).scaling_map()


@query
def scan_real(spark, sf):
    """A text file of real grades, cut at a threshold that is on no level grid."""
    path, real = stage_path(spark, "real-text"), _real_vectors(spark, sf, 6)
    numbered = stage(en.ordered_rank(real.frame, ["obj"], "position"), "numbered").select(F.col("position").alias("obj"), "values")
    writers.write_lines(writers.real_lines(RealContext(numbered, real.m)), path)
    cells, _, m = text.scan_cells(spark, path)
    return RealContext.of_cells(cells, m).alpha_cut(0.0625).long()


def _wide_lattice(spark, sf) -> tuple[DataFrame, DataFrame, int]:
    """Concepts and covers of a scaled context of more attributes than one mask word holds."""
    closure = ModalClosure(cx.nominal_scaling(tables.type_size(spark, sf)).staged())
    concepts = stage(en.concepts(closure.ctx, closure), "concepts")
    return concepts, stage(containment.modal_covers(concepts, closure), "cover-edges"), closure.m


def _attrs(m: int, stem: str = "mask") -> Column:
    return joined(masks.members([F.col(c) for c in masks.mask_cols(m, stem)], m))


@query
def concepts_wide(spark, sf):
    concepts, _, m = _wide_lattice(spark, sf)
    return concepts.select(_attrs(m).alias("attrs"), masks.card([F.col(c) for c in concepts.columns]).alias("card"))


@query
def hasse_edges_wide(spark, sf):
    _, covers, m = _wide_lattice(spark, sf)
    return covers.select(_attrs(m).alias("child"), _attrs(m, "sup_mask").alias("parent"))


@query
def lattice_metrics_wide(spark, sf):
    concepts, covers, m = _wide_lattice(spark, sf)
    cols = masks.mask_cols(m)
    return metrics.lattice_metrics(metrics.vertex_frame(concepts, cols), metrics.edge_frame(covers, cols, masks.mask_cols(m, "sup_mask")))


# ---------------------------------------------------------------- containment and lattices


def _crisp_lattice(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Vertices (mask) and cover edges (mask, sup_mask) of the crisp brand context."""
    closure = ModalClosure(crisp_brands(spark, sf))
    concepts = en.concepts(closure.ctx, closure)
    return concepts, containment.modal_covers(concepts, closure)


def _graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    concepts, covers = _crisp_lattice(spark, sf)
    covers = stage(covers, "cover-edges")  # walked over and over
    return concepts.withColumnRenamed("mask", "id"), metrics.edge_frame(covers, ["mask"], ["sup_mask"])


@query
def crisp_subset_pairs(spark, sf):
    concepts = en.concepts(crisp_brands(spark, sf))
    return containment.subset_pairs(concepts, concepts, ["mask"])


def _user_steps(spark, sf) -> DataFrame:
    """Distinct user rows as thermometer masks."""
    ctx = tables.user_event(spark, sf)
    return ctx.clarified().select(*containment.thermometer(F.col("grades"), ctx.m, ctx.scale))


@query
def fuzzy_subset_pairs(spark, sf):
    rows = stage(_user_steps(spark, sf), "rows")
    return containment.subset_pairs(rows, rows, ["mask"])


@query
def hasse_edges_crisp(spark, sf):
    return _crisp_lattice(spark, sf)[1]


@query
def hasse_edges_modal(spark, sf):
    closure = ModalClosure(tables.seg_month(spark, sf))
    return containment.modal_covers(en.concepts(closure.ctx, closure), closure)


def _type_lattice(spark, sf) -> tuple[DataFrame, DataFrame]:
    closure = ModalClosure(tables.type_size(spark, sf))
    concepts = en.concepts(closure.ctx, closure)
    return concepts, containment.modal_covers(concepts, closure)


@query
def hasse_edges_types(spark, sf):
    return _type_lattice(spark, sf)[1]


@query
def lattice_metrics_types(spark, sf):
    concepts, covers = _type_lattice(spark, sf)
    covers = stage(covers, "cover-edges")
    return metrics.lattice_metrics(concepts.withColumnRenamed("mask", "id"), metrics.edge_frame(covers, ["mask"], ["sup_mask"]))


@query
def hasse_edges_family(spark, sf):
    """Cover relation of sets that are no closure system: suppliers' characteristic months."""
    sets = cx.object_sets(tables.supplier_month(spark, sf), ALPHA).select("mask").distinct()
    return containment.cover_edges(stage(sets, "family"), ["mask"])


@query
def hasse_edges_fuzzy(spark, sf):
    closure = FuzzyClosure(tables.nation_status(spark, sf))
    covers = containment.fuzzy_covers(en.fuzzy_concepts(closure.ctx, closure=closure), closure)
    return covers.select(joined("grades").alias("child"), joined("sup_grades").alias("parent"))


@query
def hasse_rows_fuzzy(spark, sf):
    return containment.cover_edges(stage(_user_steps(spark, sf), "rows"), ["mask"])


@query
def degree_stats(spark, sf):
    return metrics.degree_stats(*_graph(spark, sf))


@query
def lattice_levels(spark, sf):
    return metrics.levels(*_graph(spark, sf))


@query
def topological_order(spark, sf):
    return metrics.topological_order(*_graph(spark, sf), F.bit_count)


@query
def topological_order_types(spark, sf):
    """Tens of thousands of vertices, each edge read once."""
    concepts, covers = _type_lattice(spark, sf)
    covers, seen = stage_observed(covers, "cover-edges", n=F.count(F.lit(1)))
    edges = metrics.edge_frame(covers, ["mask"], ["sup_mask"])
    levels, read = metrics.topological_levels(concepts.withColumnRenamed("mask", "id"), edges, F.bit_count)
    return levels.groupBy("level").agg(F.count(F.lit(1)).alias("n")).withColumn("each_edge_once", F.lit(read == seen["n"]))


@query
def lattice_height(spark, sf):
    return metrics.height(metrics.levels(*_graph(spark, sf)))


@query
def width_levels(spark, sf):
    return metrics.width_levels(metrics.levels(*_graph(spark, sf)))


@query
def lattice_metrics(spark, sf):
    return metrics.lattice_metrics(*_graph(spark, sf))


@query
def width_exact(spark, sf):
    return metrics.width_exact(*_graph(spark, sf))


@query
def join_closure(spark, sf):
    ctx = tables.seg_month(spark, sf).staged()
    closure = ModalClosure(ctx)
    gens = closure.close(cx.object_sets(ctx, TOP_LEVEL)).select(F.col("closure").alias("mask"))
    return containment.join_closure(gens, closure)


@query
def width_exact_languages(spark, sf):
    """The largest antichain of a lattice of at most sixteen concepts, which SQL can find by trying all subsets."""
    ctx = tables.source_lang(spark, sf)
    concepts = en.concepts(ctx)
    edges = metrics.edge_frame(containment.cover_edges(concepts, ["mask"]), ["mask"], ["sup_mask"])
    return metrics.width_exact(concepts.withColumnRenamed("mask", "id"), edges)


@query
def fuzzy_join_closure(spark, sf):
    """Joins of the intents that the nations generate."""
    ctx = tables.nation_status(spark, sf).staged()
    closure = FuzzyClosure(ctx)
    gens = closure.close(ctx.frame).select(F.col("closure").alias("grades"))
    return containment.fuzzy_join_closure(gens, closure).select(joined("grades").alias("grades"))


@query
def fuzzy_concept_join(spark, sf):
    """Join of the intents of each nation and of the next one."""
    ctx = tables.nation_status(spark, sf).staged()
    closure = FuzzyClosure(ctx)
    closed = stage(closure.close(ctx.frame).select("obj", F.col("closure").alias("a")), "nation-intents")
    pairs = closed.join(closed.select((F.col("obj") - 1).alias("obj"), F.col("a").alias("b")), "obj")
    found = containment.fuzzy_join(pairs, "a", "b", closure)
    return found.select("obj", *[joined(c).alias(c) for c in ("a", "b", "joined")])


@query
def incremental_hasse(spark, sf):
    """Concepts streamed in file by file; the maintained edges after the last batch."""
    ctx = tables.seg_month(spark, sf)
    folder = stage_path(spark, "concept-stream")
    sized = _sized(en.concepts(ctx))
    sized.repartition(3, "card").select("mask").write.parquet(folder)
    lattice = IncrementalLattice(spark, ctx.m, stage_path(spark, "incremental-lattice"))
    stream = spark.readStream.schema("mask bigint").option("maxFilesPerTrigger", 1).parquet(folder)
    lattice.start(stream, stage_path(spark, "stream-progress")).awaitTermination()
    return lattice.edges


@query
def incremental_hasse_fuzzy(spark, sf):
    """The nations' intents streamed in file by file; the maintained edges after the last batch."""
    ctx = tables.nation_status(spark, sf)
    folder = stage_path(spark, "intent-stream")
    en.fuzzy_concepts(ctx).repartition(3, "grades").write.parquet(folder)
    lattice = IncrementalCovers(spark, ctx.m, ctx.scale, stage_path(spark, "incremental-lattice"))
    stream = spark.readStream.schema("grades array<int>").option("maxFilesPerTrigger", 1).parquet(folder)
    lattice.start(stream, stage_path(spark, "stream-progress")).awaitTermination()
    return lattice.covers.select(joined("grades").alias("child"), joined("sup_grades").alias("parent"))


@query
def dominance_lookup(spark, sf):
    """The distinct user rows strictly above each customer's row of five grades."""
    ctx = tables.user_event(spark, sf)
    rows, seen = stage_observed(ctx.clarified().select("grades"), "user-rows", n=F.count(F.lit(1)))
    asked, customers = stage_observed(tables.customer_priority(spark, sf).frame, "customer-rows", n=F.count(F.lit(1)))
    index = DominanceIndex(spark, ctx.m, ctx.scale)
    index.append(rows, seen["n"])
    found = index.lookup(asked, customers["n"], seen["n"], out="parent", of=joined)
    return found.select("obj", "parent")


@query
def incremental_hasse_restart(spark, sf):
    """Half of the concepts, a restart on the same state without new data, then the rest."""
    ctx = tables.seg_month(spark, sf)
    folder, state, progress = (stage_path(spark, name) for name in ("concept-stream", "incremental-lattice", "stream-progress"))
    halves = _sized(en.concepts(ctx)).withColumn("half", F.pmod(F.xxhash64("mask"), F.lit(2)))
    halves = stage(halves, "halves")
    for part in (0, None, 1):
        if part is not None:
            halves.where(F.col("half") == part).select("mask").write.mode("append").parquet(folder)
        lattice = IncrementalLattice(spark, ctx.m, state)
        stream = spark.readStream.schema("mask bigint").parquet(folder)
        lattice.start(stream, progress).awaitTermination()
    return IncrementalLattice(spark, ctx.m, state).edges


@query
def windowed_context(spark, sf):
    """Users x event type for each week of the events, streamed in file by file in order of time."""
    folder, events = stage_path(spark, "event-stream"), tables.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    events.repartitionByRange(3, "ts").write.parquet(folder)
    weeks = WindowedContexts(spark, len(tables.EVENT_TYPES), stage_path(spark, "windowed-context"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    # The files may be picked up in any order, so events may come as late as the whole table is long.
    weeks.start(stream, stage_path(spark, "stream-progress"), time="ts", window="7 days", late="36500 days", obj=F.col("user_id"),
                attr=tables.rank_of("event_type", tables.EVENT_TYPES)).awaitTermination()
    return weeks.grades.select(F.unix_timestamp("start").alias("start"), "obj", joined("grades").alias("grades"))


# ---------------------------------------------------------------- sampling


@query
def sqrt_quota(spark, sf):
    ctx = tables.seg_month(spark, sf)
    histogram = sampling.card_histogram(en.concepts(ctx), ctx.m)
    return sampling.quota_shares(histogram, SAMPLE_BUDGET)


@query
def link_score(spark, sf):
    ctx = tables.seg_month(spark, sf)
    concepts = en.concepts(ctx)
    return sampling.link_scores(concepts, concepts, ctx.m)


@query
def link_score_types(spark, sf):
    concepts = en.concepts(tables.type_size(spark, sf))
    return sampling.link_scores(concepts, concepts, 50)


@query
def quota_sample_types(spark, sf):
    return sampling.quota_sample(en.concepts(tables.type_size(spark, sf)), 50, 5000)


@query
def quota_sample(spark, sf):
    ctx = tables.seg_month(spark, sf)
    return sampling.quota_sample(en.concepts(ctx), ctx.m, SAMPLE_BUDGET)


@query
def sample_lines(spark, sf):
    """Lines of an intent file, sampled by their supports; lines of one support stay apart."""
    rows = text.scan_sample_input(spark, _intent_file(spark, sf))
    return sampling.quota_sample(rows, 3, SAMPLE_LINES, key="line").select("line", "value", "mask", "card", "links")


# ---------------------------------------------------------------- text formats


def _ranked_lattice(spark, sf) -> tuple[DataFrame, DataFrame]:
    concepts, covers = _crisp_lattice(spark, sf)
    ranked = stage(writers.ranked_concepts(concepts, 10), "ranked-concepts")
    ids = ranked.select("mask", "rank")
    edges = covers.join(ids.withColumnRenamed("rank", "child"), "mask").join(
        ids.select(F.col("mask").alias("sup_mask"), F.col("rank").alias("parent")), "sup_mask")
    return ranked, edges.select("child", "parent")


@query
def dot_lines(spark, sf):
    return writers.dot_undirected(*_ranked_lattice(spark, sf))


@query
def dot_directed_lines(spark, sf):
    return writers.dot_directed(_ranked_lattice(spark, sf)[1])


@query
def edge_list(spark, sf):
    return writers.edge_lines(_ranked_lattice(spark, sf)[1])


@query
def hasse_input_lines(spark, sf):
    ctx = tables.seg_month(spark, sf)
    return writers.hasse_lines(writers.ranked_concepts(en.concepts(ctx), ctx.m))


def _numbered_objects(ctx: Context) -> Context:
    """Objects renamed to their 0-based position."""
    ctx = ctx.staged()
    ranked = stage(en.ordered_rank(ctx.frame, ["obj"], "position"), "numbered")
    return Context(ranked.select(F.col("position").alias("obj"), "grades"), ctx.m, ctx.scale)


@query
def concept_listing(spark, sf):
    ctx = _numbered_objects(tables.seg_month(spark, sf))
    return writers.concept_lines(stage(writers.ranked_concepts(en.concepts(ctx), ctx.m), "ranked-concepts"), ctx)


@query
def intent_lines(spark, sf):
    ctx = tables.nation_status(spark, sf).staged()
    return writers.intent_lines(stage(en.fuzzy_concepts(ctx), "intents"), ctx.frame.count(), ctx.m)


@query
def index_lines(spark, sf):
    ranked = en.next_closure_order(en.fuzzy_concepts(tables.nation_status(spark, sf)), "id")
    return writers.index_lines(ranked)


@query
def context_lines(spark, sf):
    return writers.context_lines(tables.supplier_month(spark, sf))


@query
def scan_context(spark, sf):
    path = stage_path(spark, "context-text")
    writers.write_lines(writers.context_lines(tables.supplier_month(spark, sf)), path)
    return text.scan_context(spark, path).long()


@query
def scan_context_lenient(spark, sf):
    """A file that stops early and has a word among its numbers: every announced object, 0 where there is no number."""
    path = stage_path(spark, "lenient-text")
    lines = stage(writers.context_lines(tables.supplier_month(spark, sf)), "context-lines")
    last = lines.agg(F.max("pos")).first()[0]
    spoilt = F.when((F.col("section") == 1) & (F.col("pos") % 7 == 3), F.regexp_replace("value", r"^\S+", "none")).otherwise(F.col("value"))
    writers.write_lines(lines.where(F.col("pos") <= last - 3).withColumn("value", spoilt), path)
    return text.scan_context(spark, path, strict=False).long()


@query
def scan_crisp_context(spark, sf):
    path = stage_path(spark, "crisp-text")
    ctx = crisp_brands(spark, sf)
    writers.write_lines(writers.context_lines(ctx), path)
    return text.scan_aligned_context(spark, path, ctx.m, scale=1).long()


@query
def scan_concept_sets(spark, sf):
    path = stage_path(spark, "concept-text")
    ctx = tables.seg_month(spark, sf)
    writers.write_lines(writers.hasse_lines(writers.ranked_concepts(en.concepts(ctx), ctx.m)), path)
    return text.scan_sets(spark, path, ctx.m)


def _intent_file(spark, sf) -> str:
    path = stage_path(spark, "intent-text")
    ctx = tables.nation_status(spark, sf).staged()
    writers.write_lines(writers.intent_lines(stage(en.fuzzy_concepts(ctx), "intents"), ctx.frame.count(), ctx.m), path)
    return path


@query
def scan_intents(spark, sf):
    found = text.scan_intents(spark, _intent_file(spark, sf))
    return found.select("id", joined("grades").alias("grades"), "card")


@query
def scan_sample_input(spark, sf):
    return text.scan_sample_input(spark, _intent_file(spark, sf))
