"""Quota-stratified, link-aware sampling of concept collections.

Strata are cardinalities.  Quotas come from a histogram of at most ``m + 1``
rows; each stratum is then a top-k over scores counted by containment against
what the strata below have already selected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradelattice.functions import kernels, masks
from gradelattice.operators.closure import ddl
from gradelattice.operators.containment import subset_counts
from gradelattice.operators.enumerate import first_rows
from gradelattice.session import ship_package, stage, stage_path, staged_batches

# Defaults of the sampler and the widest parent pool.
DEFAULT_MAXN = 200_000
DEFAULT_SEED = 42
MAX_PARENT_LEVELS = 3

POOL_ROWS = 1 << 12  # sets of a pool that a task reads at a time


def card_histogram(sets: DataFrame, m: int) -> DataFrame:
    """(card, n) over mask columns."""
    size = masks.card([F.col(c) for c in masks.mask_cols(m)])
    return sets.groupBy(size.alias("card")).agg(F.count(F.lit(1)).alias("n"))


def quota_shares(histogram: DataFrame, maxn: int) -> DataFrame:
    """(card, n, quota) before any trimming: share of the budget by square root of the stratum size.

    The empty set reserves one place; every other stratum gets at least one and
    at most its size.
    """
    everything = Window.partitionBy(F.lit(0))  # at most m + 1 rows
    root = F.when(F.col("card") > 0, F.sqrt(F.col("n").cast("double"))).otherwise(0.0)
    base = histogram.withColumn("total", F.sum(root).over(everything))
    used = F.max(F.when((F.col("card") == 0) & (F.col("n") > 0), 1).otherwise(0)).over(everything)
    base = base.withColumn("budget", F.greatest(F.lit(0), F.lit(maxn) - used))
    share = F.floor(F.sqrt(F.col("n").cast("double")) / F.col("total") * F.col("budget"))
    quota = (F.when(F.lit(maxn) == 0, 0).when(F.col("card") == 0, F.least(F.col("n"), F.lit(1)))
             .when(F.col("budget") == 0, 0)
             .otherwise(F.least(F.col("n"), F.greatest(F.lit(1), share))))
    return base.select("card", "n", quota.cast("bigint").alias("quota"))


def trim_quotas(quotas: dict[int, int], maxn: int) -> dict[int, int]:
    """Take places from the largest quota (smallest card on ties, never the last place) until they fit."""
    quotas = dict(quotas)
    surplus = sum(quotas.values()) - maxn
    while surplus > 0:
        open_ = [(-q, c) for c, q in quotas.items() if c > 0 and q > 1]
        if not open_:
            break
        _, card = min(open_)
        # level the largest down to the runner-up in one go
        second = max((q for c, q in quotas.items() if c > 0 and c != card), default=1)
        tied = any(q == quotas[card] for c, q in quotas.items() if c > 0 and c != card)
        cut = 1 if tied else min(surplus, quotas[card] - max(second, 1))
        cut = max(1, min(cut, quotas[card] - 1))
        quotas[card] -= cut
        surplus -= cut
    return quotas


def sqrt_quota(histogram: DataFrame, maxn: int = DEFAULT_MAXN) -> dict[int, int]:
    """Final quota per cardinality (the histogram has at most m + 1 rows)."""
    rows = quota_shares(histogram, maxn).collect()
    return trim_quotas({r.card: r.quota for r in rows}, maxn)


def shuffle_key(m: int, seed: int = DEFAULT_SEED):
    """Seeded pseudo-random order inside a stratum, the same on every run and engine."""
    cols = masks.mask_cols(m)
    size = masks.card([F.col(c) for c in cols])
    return F.md5(F.concat_ws(":", F.lit(str(seed)), size.cast("string"), *[F.col(c).cast("string") for c in cols]))


def link_scores(candidates: DataFrame, pool: DataFrame, m: int, label: str = "links",
                max_parents: int = -1) -> DataFrame:
    """Append to each candidate how many pool members it contains.

    ``max_parents > 0`` makes the scores approximate: only the first so many pool members are tested, in pool order
    (nearest stratum first, each in the order it was selected).  It is off unless asked for.
    """
    if max_parents > 0:
        pool = pool.orderBy(F.desc("card"), "tier", F.desc("links"), "ord").limit(max_parents)
    return subset_counts(pool, candidates, masks.mask_cols(m), label)


def _scored(stratum: DataFrame, pools: list[list[str]], cols: list[str], quota: int) -> DataFrame:
    """The best ``quota`` rows of each task with ``links`` and ``tier``: the first pool with a set below the row, and how many are.

    Each task reads the pools, which are sets selected before, from their tables.
    """
    keep, width = list(stratum.columns), len(cols)
    schema = ddl(stratum, keep) + ", links bigint, tier int"
    def run(batches):
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = kernels.words_of(batch, cols)
            links, tier = np.zeros(len(sets), np.int64), np.full(len(sets), len(pools), np.int32)
            counted: dict[str, np.ndarray] = {}
            for k, paths in enumerate(pools):
                for path in paths:
                    if path not in counted:
                        n = counted[path] = np.zeros(len(sets), np.int64)
                        for pool in staged_batches([path], POOL_ROWS):
                            words = kernels.words_of(pool, cols)
                            for part in kernels.chunks(len(sets), max(1, len(words))):
                                inside = (words[:, None, 0] & ~sets[None, part, 0]) == 0
                                for w in range(1, width):
                                    inside &= (words[:, None, w] & ~sets[None, part, w]) == 0
                                n[part] += inside.sum(axis=0)
                total = sum((counted[path] for path in paths), np.zeros(len(sets), np.int64))
                new = (tier == len(pools)) & (total > 0)
                links[new], tier[new] = total[new], k
            rows = pa.Table.from_batches([batch.append_column("links", pa.array(links)).append_column("tier", pa.array(tier))])
            best = rows if best is None else pa.concat_tables([best, rows])
            if best.num_rows > 2 * quota + kernels.CELLS // 8:
                best = _best(best, cols, quota)
        if best is not None:
            yield from _best(best, cols, quota).to_batches()
    ship_package(stratum.sparkSession)
    return stratum.mapInArrow(run, schema)


def _best(rows: pa.Table, cols: list[str], quota: int) -> pa.Table:
    by = [("tier", "ascending"), ("links", "descending"), ("ord", "ascending"), *[(c, "ascending") for c in cols]]
    return rows.take(pc.sort_indices(rows, by)[:quota])


def quota_sample(sets: DataFrame, m: int, maxn: int = DEFAULT_MAXN, seed: int = DEFAULT_SEED,
                 parent_levels: int = 1, max_parents: int = -1, key: str | None = None) -> DataFrame:
    """The selected rows of ``sets`` with ``card``, ``ord`` (shuffle key) and ``links`` (score when chosen).

    Within a stratum, sets linked to the nearest selected strata come first, by score and then shuffled order; places still
    free go to sets linked only to a pool widened level by level up to three, and last to any set.  A row is taken at most
    once and a stratum never exceeds its quota.  Without ``key``, rows are masks, and only those are returned.  With it,
    that column tells rows apart: rows with the same mask stay separate and bring all their columns along.

    The strata come one after another, as each is scored by what the ones below have selected; a stratum is one job, in
    which every task keeps its best rows only.
    """
    cols = masks.mask_cols(m)
    if not 1 <= parent_levels <= MAX_PARENT_LEVELS:
        raise ValueError(f"parent_levels is 1 to {MAX_PARENT_LEVELS}, not {parent_levels}")
    spark = sets.sparkSession
    extra = [c for c in sets.columns if c not in {*cols, "card", "ord", "links", "tier"}] if key else []
    size = masks.card([F.col(c) for c in cols])
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), size.cast("string"), F.col(key).cast("string"))) if key else shuffle_key(m, seed)
    keyed = sets.select(*cols, *extra, size.alias("card"), order.alias("ord"))
    keyed = stage(keyed, "sample-input", partition="card")  # a stratum then reads only its own files
    quotas = sqrt_quota(keyed.groupBy("card").agg(F.count(F.lit(1)).alias("n")), maxn)
    chosen: dict[int, str] = {}
    schema = keyed.withColumn("links", F.lit(0).cast("bigint")).withColumn("tier", F.lit(0)).schema
    last, total = -1, 0
    for card in sorted(c for c, q in quotas.items() if q > 0):
        near = [c for c in range(last, last - MAX_PARENT_LEVELS, -1) if c in chosen] if card > 0 else []
        pools = []
        for k in range(parent_levels, MAX_PARENT_LEVELS + 1) if near else ():
            pools.append([chosen[c] for c in near if c > last - k])
            if max_parents > 0 and pools[-1]:
                pool = spark.read.schema(schema).parquet(*pools[-1])
                pools[-1] = [stage_path(spark, "pool")]
                pool.orderBy(F.desc("card"), "tier", F.desc("links"), "ord").limit(max_parents).write.parquet(pools[-1][0])
        scored = _scored(keyed.where(F.col("card") == card), pools, cols, quotas[card]).withColumn("fewest", -F.col("links"))
        best = first_rows(scored, ["tier", "fewest", "ord", *cols, *([key] if key else [])], quotas[card]).drop("fewest")
        chosen[card] = stage_path(spark, f"stratum-{card}")
        best.select(*schema.names).write.parquet(chosen[card])
        last = card
        total += quotas[card]
        if total >= maxn:
            break
    if not chosen:
        return keyed.limit(0).withColumn("links", F.lit(0).cast("bigint"))
    return spark.read.schema(schema).parquet(*chosen.values()).drop("tier")
