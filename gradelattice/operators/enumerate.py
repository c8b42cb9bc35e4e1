"""Enumeration of all closed sets.

Each closed set has exactly one generating step (its canonical parent, the
attribute added and, for fuzzy sets, the level), so the search is a tree and no
global duplicate removal or seen-set join is needed.

The tree is walked in rounds.  A task expands the nodes it holds until its work
budget is spent and hands the rest back as open nodes; the next round spreads
those over the cluster again.  Subtrees differ wildly in size, and the budget is
what keeps a heavy one from staying in a single task.  Each round is written to
the shared folder, which cuts lineage and bounds what a lost executor costs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradelattice.functions import fuzzy, kernels, masks
from gradelattice.functions.fuzzy import Implication, Rounding
from gradelattice.operators.closure import FuzzyClosure, ModalClosure, ddl
from gradelattice.operators.context import Context
from gradelattice.session import Pile, ship_package, stage, stage_observed

FIRST_BUDGET = 3 * 10**8   # closure cells of the single-task first round
ROUND_BUDGET = 4 * 10**9   # closure cells per task and later round
NODE_BATCH = 2048
TOP_ROWS = 10_000          # top-k sizes gathered by a single task
RAW, ROOT = -2, -1         # generating attribute of the seed before and after closing it


def _rounds(spark, seed: DataFrame, expand, key: list[str], first_budget: int, round_budget: int,
            counters: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, int]]:
    """Run expansion rounds until no node is open; every node once, and the sums of the counter columns."""
    ship_package(spark)
    schema = ddl(seed, [*key, "y"]) + ", open boolean" + "".join(f", {c} bigint" for c in counters)
    tasks = max(8, 4 * spark.sparkContext.defaultParallelism)
    pile, frontier, budget = Pile(spark, "closed-sets", StructType.fromDDL(schema)), seed.coalesce(1), first_budget
    totals = dict.fromkeys(counters, 0)
    while True:
        written, seen = pile.add(frontier.mapInArrow(expand(budget), schema), open=F.count_if("open"), **{c: F.sum(c) for c in counters})
        totals = {c: n + (seen[c] or 0) for c, n in totals.items()}
        if not seen["open"]:
            return pile.all.where("not open").select(*key, "y"), totals
        frontier = written.where("open").select(*key, "y").repartition(tasks, *key)
        budget = round_budget


def _walk(batches, take, emit, step, budget: int, node_cells: int):
    """Depth-first over stacks of node matrices until ``budget`` cells are spent.

    ``node_cells`` is what one node may cost; a step takes only as many as an
    eighth of the budget allows, since the budget is looked at between steps.
    """
    spent, size = 0, max(1, min(NODE_BATCH, budget // (8 * max(1, node_cells))))
    for batch in batches:
        stack = [take(batch)] if batch.num_rows else []
        while stack:
            sets, y = stack.pop()
            if spent >= budget:
                yield emit(sets, y, True)
                continue
            if len(sets) > size:
                stack.append((sets[size:], y[size:]))
                sets, y = sets[:size], y[:size]
            sets, y, children, child_y, cost = step(sets, y)
            spent += cost
            yield emit(sets, y, False)
            if len(children):
                stack.append((children, child_y))


# ---------------------------------------------------------------- modal concepts


def _modal_expander(closure: ModalClosure):
    bc, m, cols = closure.broadcast, closure.m, closure.cols
    full, bits = masks.full_words(m), masks.bit_words(m)
    below = np.cumsum(bits, axis=0) - bits  # below[j]: the attributes before j
    def expand(budget: int):
        def run(batches):
            need, attrs = bc.value
            def close(sets):
                return full & ~kernels.modal_open(sets, need, attrs)
            def take(batch):
                return kernels.words_of(batch, cols), batch.column("y").to_numpy().astype(np.int32)
            def emit(sets, y, is_open):
                return kernels.batch_of(kernels.word_dict(sets, cols) | {"y": y, "open": np.full(len(y), is_open)})
            def step(sets, y):
                raw = y == RAW
                if raw.any():
                    sets, y = np.where(raw[:, None], close(sets), sets), np.where(raw, ROOT, y).astype(np.int32)
                free = ((sets[:, None, :] & bits[None, :, :]) == 0).all(axis=2)
                row, attr = np.nonzero(free & (np.arange(m)[None, :] > y[:, None]))
                base = sets[row]
                closed = close(base | bits[attr])
                own = ((closed & ~base & below[attr]) == 0).all(axis=1)
                return sets, y, closed[own], attr[own].astype(np.int32), len(row) * max(1, len(need))
            yield from _walk(batches, take, emit, step, budget, m * max(1, len(need)))
        return run
    return expand


def concepts(ctx: Context, closure: ModalClosure | None = None, first_budget: int = FIRST_BUDGET,
             round_budget: int = ROUND_BUDGET) -> DataFrame:
    """All closed attribute sets of the modal calculus, one mask each."""
    return concept_tree(ctx, closure, first_budget, round_budget).drop("y")


def concept_tree(ctx: Context, closure: ModalClosure | None = None, first_budget: int = FIRST_BUDGET,
                 round_budget: int = ROUND_BUDGET) -> DataFrame:
    """All concepts with ``y``, the attribute their one canonical generation step adds (-1 for the least)."""
    closure = closure or ModalClosure(ctx)
    spark = ctx.frame.sparkSession
    seed = spark.range(1).select(*[F.lit(0).cast("bigint").alias(c) for c in closure.cols], F.lit(RAW).alias("y"))
    if closure.broadcast is not None:
        return _rounds(spark, seed, _modal_expander(closure), closure.cols, first_budget, round_budget)[0]
    return reduce(DataFrame.unionByName, list(modal_levels(closure)))


def modal_levels(closure: ModalClosure):
    """Closed sets level by level (generation depth), for contexts too large to broadcast.

    Candidates are closed by fragments, so neither side of the work is ever held
    whole anywhere; at most ``m + 1`` levels.
    """
    spark, cols, m = closure.ctx.frame.sparkSession, closure.cols, closure.m
    empty = spark.range(1).select(*[F.lit(0).cast("bigint").alias(c) for c in cols])
    closed_cols = masks.mask_cols(m, "closure")
    frontier = stage(closure.close(empty).select(
        *[F.col(c).alias(d) for c, d in zip(closed_cols, cols)], F.lit(ROOT).alias("y")), "level")
    below = (np.cumsum(masks.bit_words(m), axis=0) - masks.bit_words(m)).tolist()
    while not frontier.isEmpty():
        yield frontier
        old = masks.mask_cols(m, "base")
        base = frontier.select(*[F.col(c).alias(o) for c, o in zip(cols, old)], "y",
                               F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
        base = base.where("j > y").where(~masks.contains_attr([F.col(o) for o in old], F.col("j"), m))
        grown = masks.with_attr([F.col(o) for o in old], F.col("j"), m)
        candidates = base.select(*old, "j", *[g.alias(c) for g, c in zip(grown, cols)])
        closed = closure.close(stage(candidates, "candidates"))
        own = F.lit(True)
        for w, (o, c) in enumerate(zip(old, closed_cols)):
            prefix = F.element_at(F.array(*[F.lit(b[w]).cast("bigint") for b in below]), F.col("j") + 1)
            own = own & (F.col(c).bitwiseAND(F.bitwise_not(F.col(o))).bitwiseAND(prefix) == 0)
        frontier = stage(closed.where(own).select(
            *[F.col(c).alias(d) for c, d in zip(closed_cols, cols)], F.col("j").alias("y")), "level")


def enumeration_counters(tree: DataFrame, m: int) -> DataFrame:
    """Concepts, closures tried and closures rejected as not canonical, from the generation tree.

    A concept tries every attribute after its own generating one that it does
    not hold yet; all tries but one per further concept are rejected.
    """
    cols = [F.col(c) for c in masks.mask_cols(m)]
    after = np.cumsum(masks.bit_words(m)[::-1], axis=0)[::-1] - masks.bit_words(m)  # after[j]: attributes beyond j
    words = [F.element_at(F.array(*[F.lit(int(x)).cast("bigint") for x in [full, *after[:, w]]]), F.col("y") + 2)
             for w, full in enumerate(masks.full_words(m))]
    free = masks.card([w.bitwiseAND(F.bitwise_not(c)) for w, c in zip(words, cols)])
    sums = tree.agg(F.count(F.lit(1)).alias("concepts"), F.coalesce(F.sum(free), F.lit(0)).cast("bigint").alias("closures"))
    return sums.select("concepts", "closures", (F.col("closures") - F.col("concepts") + 1).alias("rejected"))


def powerset_concepts(ctx: Context, closure: ModalClosure | None = None) -> DataFrame:
    """Closed sets by testing all ``2^m`` subsets; for small ``m`` and as a check."""
    if ctx.m > 30:
        raise ValueError("power-set enumeration is limited to 30 attributes")
    closure = closure or ModalClosure(ctx)
    every = ctx.frame.sparkSession.range(1 << ctx.m).select(F.col("id").alias("mask"))
    return closure.close(every).where("closure = mask").select("mask")


def with_bottom(concepts_: DataFrame, m: int) -> DataFrame:
    """Add the empty set where it is not closed (an attribute no object has at all)."""
    cols = masks.mask_cols(m)
    empty = concepts_.sparkSession.range(1).select(*[F.lit(0).cast("bigint").alias(c) for c in cols])
    return concepts_.unionByName(empty).distinct()


# ---------------------------------------------------------------- fuzzy intents


COUNTERS = ("closures", "rejected", "skipped")


@dataclass
class _Nodes:
    """Open nodes of the fuzzy search, with the failed tests they inherit.

    ``failed[o, j]`` is a closure that changed an attribute before ``j`` when ``j`` was raised to ``level[o, j]`` in an
    ancestor.  Closures only grow down the tree, so the same raise fails again while the node is still below it there.
    """

    sets: np.ndarray
    y: np.ndarray
    owner: np.ndarray
    failed: np.ndarray
    level: np.ndarray

    @classmethod
    def fresh(cls, sets: np.ndarray, y: np.ndarray, scale: int) -> _Nodes:
        m = sets.shape[1]
        return cls(sets, y, np.zeros(len(sets), np.int64), np.zeros((1, m, m), sets.dtype), np.full((1, m), scale + 1, sets.dtype))

    def __len__(self) -> int:
        return len(self.sets)

    def take(self, part) -> _Nodes:
        return _Nodes(self.sets[part], self.y[part], self.owner[part], self.failed, self.level)

    def sorted(self) -> _Nodes:
        return self.take(np.lexsort(self.sets.T[::-1]))


def _fuzzy_step(nodes: _Nodes, rows: np.ndarray, table: np.ndarray) -> tuple[_Nodes, _Nodes, dict[str, int]]:
    """The nodes (a raw root closed), their children, and how many closures were computed, failed, and known to fail."""
    m, scale = nodes.sets.shape[1], len(table) - 1
    sets, y = nodes.sets, nodes.y
    counts = dict.fromkeys(COUNTERS, 0)
    raw = y == RAW
    if raw.any():
        sets = np.where(raw[:, None], kernels.fuzzy_close(sets, rows, table), sets)
        y = np.where(raw, ROOT, y).astype(np.int32)
        counts["closures"] += int(raw.sum())
    failed, known = nodes.failed[nodes.owner], nodes.level[nodes.owner]
    row, attr = np.nonzero((sets < scale) & (np.arange(m)[None, :] > y[:, None]))
    before = np.arange(m)[None, :] < attr[:, None]
    again = ((failed[row, attr] > sets[row]) & before).any(axis=1)
    top = np.where(again, known[row, attr] - 1, scale)  # the raises beyond fail again
    level = sets[row, attr] + 1
    counts["skipped"] += int((level > top).sum())
    go = level <= top
    row, attr, level, top = row[go], attr[go], level[go], top[go]
    found, found_y, found_row = [], [], []
    while len(row):
        # each closure is either the child of the level it reaches, or, when it
        # changes an earlier attribute, rules out every higher level as well
        raised = sets[row]
        raised[np.arange(len(row)), attr] = level
        closed = kernels.fuzzy_close(raised, rows, table)
        counts["closures"] += len(row)
        own = (closed != sets[row]).argmax(axis=1) == attr
        lost = ~own
        counts["rejected"] += int(lost.sum())
        failed[row[lost], attr[lost]], known[row[lost], attr[lost]] = closed[lost], level[lost]
        row, attr, closed, top = row[own], attr[own], closed[own], top[own]
        found.append(closed)
        found_y.append(attr)
        found_row.append(row)
        level = closed[np.arange(len(row)), attr] + 1
        counts["skipped"] += int(((level > top) & (level <= scale)).sum())
        more = level <= top
        row, attr, level, top = row[more], attr[more], level[more], top[more]
    nodes = _Nodes(sets, y, nodes.owner, nodes.failed, nodes.level)
    if not found:
        return nodes, nodes.take(slice(0, 0)), counts
    children = _Nodes(np.concatenate(found), np.concatenate(found_y).astype(np.int32), np.concatenate(found_row), failed, known)
    return nodes, children, counts


def _fuzzy_batch(nodes: _Nodes, is_open: bool, counts: dict[str, int] | None = None):
    """Record batch of nodes; the counts stand in its first row."""
    columns = {"grades": kernels.grades_array(nodes.sets), "y": nodes.y, "open": np.full(len(nodes), is_open)}
    for c in COUNTERS:
        columns[c] = np.zeros(len(nodes), np.int64)
        if counts and len(nodes):
            columns[c][0] = counts[c]
    return kernels.batch_of(columns)


def _fuzzy_expander(closure: FuzzyClosure):
    bc, m, scale = closure.broadcast, closure.m, closure.scale
    def expand(budget: int):
        def run(batches):
            rows, table = bc.value
            size, spent = max(1, min(NODE_BATCH, budget // (16 * m * m * max(1, len(rows))))), 0
            for batch in batches:
                stack = [_Nodes.fresh(kernels.grades_of(batch, "grades", m), batch.column("y").to_numpy().astype(np.int32), scale)] if batch.num_rows else []
                while stack:
                    nodes = stack.pop()
                    if spent >= budget:
                        yield _fuzzy_batch(nodes, True)
                        continue
                    if len(nodes) > size:
                        stack.append(nodes.take(slice(size, None)))
                        nodes = nodes.take(slice(0, size))
                    nodes, children, counts = _fuzzy_step(nodes, rows, table)
                    spent += 2 * m * counts["closures"] * max(1, len(rows))
                    yield _fuzzy_batch(nodes, False, counts)
                    if len(children):
                        stack.append(children)
        return run
    return expand


def fuzzy_enumeration(ctx: Context, kind: Implication = Implication.LUKASIEWICZ, closure: FuzzyClosure | None = None,
                      first_budget: int = FIRST_BUDGET, round_budget: int = ROUND_BUDGET) -> tuple[DataFrame, dict[str, int]]:
    """(``grades``, ``y``) of all closed fuzzy intents, and what finding them took.

    ``y`` is the attribute of the one canonical step that makes an intent (-1 for the least).  Counted are ``closures``
    computed, those ``rejected`` as not canonical, and raises ``skipped`` because the test failed in an ancestor already.
    Derivations are floored onto the grid: nearest rounding is not extensive under Goguen, so it is only offered by
    ``fuzzy_fixpoints``.
    """
    closure = closure or FuzzyClosure(ctx, kind)
    if closure.rounding is not Rounding.FLOOR and closure.kind is Implication.GOGUEN:
        raise ValueError("Goguen enumeration needs floored derivations; see fuzzy_fixpoints")
    spark = ctx.frame.sparkSession
    seed = spark.range(1).select(F.array_repeat(F.lit(0), ctx.m).alias("grades"), F.lit(RAW).alias("y"))
    if closure.broadcast is not None:
        return _rounds(spark, seed, _fuzzy_expander(closure), ["grades"], first_budget, round_budget, COUNTERS)
    counts = dict.fromkeys(COUNTERS, 0)
    return reduce(DataFrame.unionByName, list(fuzzy_levels(closure, counts))), counts


def fuzzy_concepts(ctx: Context, kind: Implication = Implication.LUKASIEWICZ, closure: FuzzyClosure | None = None,
                   first_budget: int = FIRST_BUDGET, round_budget: int = ROUND_BUDGET) -> DataFrame:
    """All closed fuzzy intents (``grades`` ARRAY<INT>) of the residuated calculus."""
    return fuzzy_enumeration(ctx, kind, closure, first_budget, round_budget)[0].select("grades")


def fuzzy_counters(intents: DataFrame, counts: dict[str, int]) -> DataFrame:
    """One row: concepts, raises tried (closed, or skipped as their test is known to fail), and those that made no new intent."""
    return intents.agg(F.count(F.lit(1)).alias("concepts")).select(
        "concepts", F.lit(counts["closures"] + counts["skipped"]).cast("bigint").alias("tried"),
        F.lit(counts["rejected"] + counts["skipped"]).cast("bigint").alias("rejected"))


def _fuzzy_children(closure: FuzzyClosure, frontier: DataFrame, label: str) -> tuple[DataFrame, dict]:
    """Children (``grades``, ``y``) of staged nodes, closing candidates by fragments; and how many were closed."""
    scale = closure.scale
    cells = frontier.select(F.col("grades").alias("base"), "y", F.posexplode("grades").alias("j", "old")).where("j > y")
    steps = cells.where(F.col("old") < scale).select(
        "base", "j", F.explode(F.sequence(F.col("old") + 1, F.lit(scale))).alias("l"))
    raised = F.transform("base", lambda g, i: F.when(i == F.col("j"), F.col("l")).otherwise(g))
    tried, seen = stage_observed(steps.select("base", "j", "l", raised.alias("grades")), "fuzzy-candidates", n=F.count(F.lit(1)))
    own = ((F.slice("closure", F.lit(1), F.col("j")) == F.slice("base", F.lit(1), F.col("j")))
           & (F.get("closure", F.col("j")) == F.col("l")))
    made = closure.close(tried).where(own).select(F.col("closure").alias("grades"), F.col("j").alias("y"))
    children, kept = stage_observed(made, label, n=F.count(F.lit(1)))
    n, k = seen["n"] or 0, kept["n"] or 0
    return children, {"closures": n, "rejected": n - k, "children": k}


def _fuzzy_root(closure: FuzzyClosure) -> DataFrame:
    zero = closure.ctx.frame.sparkSession.range(1).select(F.array_repeat(F.lit(0), closure.m).alias("grades"))
    return closure.close(zero).select(F.col("closure").alias("grades"), F.lit(ROOT).alias("y"))


def fuzzy_levels(closure: FuzzyClosure, counts: dict[str, int] | None = None):
    """Closed intents (``grades``, ``y``) level by level, closing candidates by fragments."""
    frontier, more = stage(_fuzzy_root(closure), "fuzzy-level"), 1
    while more:
        yield frontier
        frontier, seen = _fuzzy_children(closure, frontier, "fuzzy-level")
        more = seen["children"]
        if counts is not None:
            counts["closures"] += seen["closures"]
            counts["rejected"] += seen["rejected"]


def fuzzy_fixpoints(ctx: Context, kind: Implication, rounding: Rounding) -> DataFrame:
    """Every level vector equal to its own closure, by testing all of them; tiny ``m`` only."""
    base = ctx.scale + 1
    if base ** ctx.m > 1 << 30:
        raise ValueError("too many level vectors to test one by one")
    digits = F.array(*[F.expr(f"cast((id div {base ** (ctx.m - 1 - j)}) % {base} as int)") for j in range(ctx.m)])
    every = ctx.frame.sparkSession.range(base ** ctx.m).select(digits.alias("grades"))
    return FuzzyClosure(ctx, kind, rounding).close(every, distinct=True).where("closure = grades").select("grades")


def _first_before(sets: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Which rows come before ``bound`` in lectic order."""
    differs = sets != bound
    at = differs.argmax(axis=1)
    return differs.any(axis=1) & (sets[np.arange(len(sets)), at] < bound[at])


def _prefix_expander(closure: FuzzyClosure, budget: int):
    """Expand nodes in lectic order until ``limit`` intents lie before the first open one.

    A node's subtree is an interval of the lectic order that starts with the node, and the intervals of its children
    follow in the order of their grades.  So the stack is kept sorted, and only its head is expanded.
    """
    bc, m, scale = closure.broadcast, closure.m, closure.scale
    def expand(limit: int):
        def run(batches):
            rows, table = bc.value
            parts = [(kernels.grades_of(b, "grades", m), b.column("y").to_numpy().astype(np.int32)) for b in batches if b.num_rows]
            stack = [_Nodes.fresh(*map(np.concatenate, zip(*parts)), scale).sorted()] if parts else []
            done, found, spent, look = [], 0, 0, limit
            while stack and spent < budget:
                nodes = stack.pop()
                size = min(NODE_BATCH, max(1, (limit - found) // 16))
                if len(nodes) > size:
                    stack.append(nodes.take(slice(size, None)))
                    nodes = nodes.take(slice(0, size))
                nodes, children, counts = _fuzzy_step(nodes, rows, table)
                spent += 2 * m * counts["closures"] * max(1, len(rows))
                done.append(nodes.sets)
                found += len(nodes)
                yield _fuzzy_batch(nodes, False, counts)
                if len(children):
                    stack.append(children.sorted())
                if found >= look and stack:
                    before = int(_first_before(np.concatenate(done), stack[-1].sets[0]).sum())
                    if before >= limit:
                        break
                    look = found + max(1, (limit - before) // 2)
            for nodes in stack:
                yield _fuzzy_batch(nodes, True)
        return run
    return expand


PREFIX_WIDTH = 4  # ranges of the lectic order expanded at a time, for each core


def lectic_prefix(ctx: Context, quota: int, closure: FuzzyClosure | None = None, kind: Implication = Implication.LUKASIEWICZ,
                  first_budget: int = FIRST_BUDGET, round_budget: int = ROUND_BUDGET) -> tuple[DataFrame, dict[str, int]]:
    """``grades`` of the first ``quota`` closed intents in lectic order (that of their arrays), and what finding them took.

    The frontier is a table of open nodes, each the head of a range of the order.  A round expands the first ranges, in
    parallel once one task has spent its budget, and hands what is left of them back.  The search is over as soon as
    ``quota`` intents lie before the first open node, so what comes later is hardly touched.  To the driver come only the
    heads of the ranges that a round expands.
    """
    closure = closure or FuzzyClosure(ctx, kind)
    spark, cores = ctx.frame.sparkSession, ctx.frame.sparkSession.sparkContext.defaultParallelism
    counts = dict.fromkeys([*COUNTERS, "rounds"], 0)
    schema = "grades array<int>, y int, open boolean" + "".join(f", {c} bigint" for c in COUNTERS)
    pile = Pile(spark, "lectic", StructType.fromDDL(schema))
    resident = closure.broadcast is not None
    frontier = spark.range(1).select(F.array_repeat(F.lit(0), ctx.m).alias("grades"), F.lit(RAW).alias("y")) if resident else stage(_fuzzy_root(closure), "frontier")
    ship_package(spark)
    done, width = 0, 1
    closed = pile.all.where("not open")
    while quota > 0:
        width = width if resident else max(width, (quota - done) // 8)
        heads = frontier.orderBy("grades").limit(width).collect()
        if not heads:
            break
        first = spark.createDataFrame(heads, "grades array<int>, y int")
        share = quota - done if width == 1 else max(1, -(-2 * (quota - done) // width))
        if resident:
            expand = _prefix_expander(closure, first_budget if width == 1 else round_budget)(share)
            nodes = first.repartitionByRange(width, "grades") if width > 1 else first.coalesce(1)
            written, seen = pile.add(nodes.mapInArrow(expand, schema), **{c: F.sum(c) for c in COUNTERS})
            opened = written.where("open").select("grades", "y")
        else:
            opened, seen = _fuzzy_children(closure, stage(first, "heads"), "frontier")
            zero = F.lit(0).cast("bigint")
            pile.add(first.select("grades", "y", F.lit(False).alias("open"), *[zero.alias(c) for c in COUNTERS]))
        for c in COUNTERS:
            counts[c] += seen.get(c) or 0
        counts["rounds"] += 1
        last = F.array(*[F.lit(g) for g in heads[-1].grades])
        rest = frontier.where(F.col("grades") > last)
        frontier, left = stage_observed(rest.unionByName(opened), "frontier", first=F.min("grades"))
        closed = pile.all.where("not open")
        if left["first"] is not None:
            closed = closed.where(F.col("grades") < F.array(*[F.lit(g) for g in left["first"]]))
        done = closed.count()
        if left["first"] is None or done >= quota:
            break
        width = PREFIX_WIDTH * cores
    return first_rows(closed.select("grades"), ["grades"], quota), counts


def bounded_concepts(ctx: Context, quota: int, closure: FuzzyClosure | None = None,
                     kind: Implication = Implication.LUKASIEWICZ) -> DataFrame:
    """The first ``quota`` closed intents in lectic order, which is the lexicographic order of their grades."""
    return lectic_prefix(ctx, quota, closure, kind)[0]


def forced_bounds(ctx: Context, kind: Implication = Implication.LUKASIEWICZ) -> DataFrame:
    """The smallest and the largest intent: grades shared by all objects, and the closure of all ones."""
    mins = ctx.frame.agg(*[F.min(F.col("grades")[j]).alias(f"g{j}") for j in range(ctx.m)])
    smallest = mins.select(F.lit("min_intent").alias("bound"), F.array(*[f"g{j}" for j in range(ctx.m)]).alias("grades"))
    down = fuzzy.fold_min([F.col("grades")[j] for j in range(ctx.m)])  # 1 -> g is g
    ups = ctx.frame.select(down.alias("x"), "grades").agg(
        *[F.min(fuzzy.implies_level(F.col("x"), F.col("grades")[j], kind, ctx.scale)).alias(f"g{j}") for j in range(ctx.m)])
    largest = ups.select(F.lit("max_intent").alias("bound"), F.array(*[f"g{j}" for j in range(ctx.m)]).alias("grades"))
    return smallest.unionByName(largest)


def first_rows(frame: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows under a total order; a large ``k`` is cut by rank, without gathering the rows."""
    if k <= TOP_ROWS:
        return frame.orderBy(*by).limit(k)
    return ordered_rank(frame, by, "_rank").where(F.col("_rank") < k).drop("_rank")


def next_closure_order(intents: DataFrame, label: str = "position") -> DataFrame:
    """Rank intents as NextClosure lists them: lexicographic order of the grade arrays.

    Ranks come from a range sort plus per-partition offsets, not one global window.
    """
    return ordered_rank(intents, ["grades"], label)


def ordered_rank(frame: DataFrame, by: list[str], label: str) -> DataFrame:
    """0-based rank under a total order, computed in parallel.

    The sorted rows are staged with the id of their range partition; a second
    pass adds the sizes of the earlier partitions (one small row each).
    """
    spark = frame.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = frame.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    serial = F.monotonically_increasing_id()  # partition id in the high 31 bits, row number below
    tagged = stage(ranged.withColumn("_serial", serial), "ranked")
    part, row = F.shiftright("_serial", 33), F.col("_serial").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # one row per partition
    return (tagged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(label, (F.col("_before") + row).cast("bigint")).drop("_serial", "_part", "_before"))
