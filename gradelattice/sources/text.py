"""Scans of the text formats, split and parsed in parallel.

Contexts are a token stream (``n m`` then n*m numbers, line breaks irrelevant),
so a token's cell depends on how many tokens come before it in the whole input.
That ordinal is the number of tokens in earlier input blocks plus a running
count inside the block; no file is ever read as one row or by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradelattice.functions import fuzzy, masks
from gradelattice.operators.context import Context, from_long
from gradelattice.operators.enumerate import ordered_rank
from gradelattice.session import stage

# The text grammars.
SET_MEMBER = r"a(\d+)"
INTENT_LINE = r"^I(\s|$)"
GRID_SLACK = 1e-6  # how far from a level a printed grade may lie


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block, serial: ``serial`` grows down the lines of one block."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("serial"))


def running_count(lines: DataFrame, weight: Column, label: str) -> DataFrame:
    """Append how much ``weight`` all earlier lines carry, over files in name order."""
    weighed = lines.withColumn("_w", weight)
    block = ["file", "block"]
    sizes = weighed.groupBy(*block).agg(F.sum("_w").alias("_total"))  # one row per input split
    before = F.coalesce(F.sum("_total").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*block, before.alias("_before"))
    inside = F.coalesce(F.sum("_w").over(Window.partitionBy(*block).orderBy("serial").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    return (weighed.withColumn("_inside", inside).join(offsets, block)
            .withColumn(label, (F.col("_before") + F.col("_inside")).cast("bigint"))
            .drop("_w", "_inside", "_before"))


def _words(line: Column) -> Column:
    return F.filter(F.split(line, r"\s+"), lambda t: t != "")


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, token) of all whitespace-separated tokens."""
    counted = running_count(raw_lines(spark, path).withColumn("words", _words(F.col("value"))), F.size("words"), "start")
    return counted.select("start", F.posexplode("words").alias("at", "token")).select(
        (F.col("start") + F.col("at")).alias("ordinal"), "token")


def context_header(spark: SparkSession, path: str) -> tuple[int, int]:
    """(n, m): the first two tokens, looked for in the first block of the first file only."""
    first = min(spark.read.text(path).inputFiles())
    head = raw_lines(spark, first).where("block = 0 and trim(value) != ''").orderBy("serial").limit(2)
    words = " ".join(r.value for r in head.collect()).split()
    try:
        return int(words[0]), int(words[1])
    except (IndexError, ValueError) as error:
        raise ValueError(f"no 'n m' header in {path}") from error


def _off_grid(value: Column, scale: int) -> Column:
    """Not one of the levels 0, 1/scale, ..., 1."""
    return value.isNull() | (value < 0) | (value > 1) | (F.abs(value * scale - F.round(value * scale)) > GRID_SLACK)


def scan_cells(spark: SparkSession, path: str, strict: bool = True, crisp: bool = False,
               scale: int | None = None) -> tuple[DataFrame, int, int]:
    """((obj, attr, v DOUBLE), n, m).

    Strict scans fail unless there are exactly the announced ``n * m`` values, and on the first malformed one, naming its
    cell; so they do on values outside {0, 1} for crisp contexts, and off the level grid if a ``scale`` is given.
    Lenient ones read 0 for malformed values; missing cells have no row, surplus values are left out.
    """
    n, m = context_header(spark, path)
    if strict:
        found = (raw_lines(spark, path).agg(F.sum(F.size(_words(F.col("value"))))).first()[0] or 0) - 2
        if found < n * m:
            raise ValueError(f"{path}: {found} values where {n} x {m} were announced; "
                             f"first missing is I[{found // m}][{found % m}]")
        if found > n * m:
            raise ValueError(f"{path}: {found} values where {n} x {m} were announced; {found - n * m} too many")
    body = tokens(spark, path).where(f"ordinal >= 2 and ordinal < {2 + n * m}")
    cells = body.select("ordinal", F.expr(f"(ordinal - 2) div {m}").alias("obj"),
                        F.expr(f"cast((ordinal - 2) % {m} as int)").alias("attr"), "token")
    value = F.expr("try_cast(token as double)")
    if not strict:
        return cells.select("obj", "attr", F.coalesce(value, F.lit(0.0)).alias("v")), n, m
    bad = value.isNull()
    if crisp:
        bad = bad | ~value.isin(0.0, 1.0)
    elif scale:
        bad = bad | _off_grid(value, scale)
    where = F.format_string("bad value '%s' at I[%d][%d]", "token", "obj", "attr")
    bad = bad & (F.col("ordinal") >= 2)  # never the header, wherever the optimizer puts the filter
    return cells.select("obj", "attr", F.when(bad, F.raise_error(where)).otherwise(value).alias("v")), n, m


def scan_context(spark: SparkSession, path: str, scale: int = 10, strict: bool = True, snap: bool = False) -> Context:
    """Context from a text file; ``scale=1`` reads a crisp one.

    A strict scan takes grades on the level grid only, unless ``snap`` asks for the nearest level.  A lenient one always
    takes the nearest level, and returns all announced objects, with grade 0 in cells the file lacks.
    """
    cells, n, m = scan_cells(spark, path, strict, crisp=scale == 1 and not snap, scale=None if snap else scale)
    graded = cells.select("obj", "attr", fuzzy.quantize(F.col("v"), scale).alias("q"))
    if not strict:
        graded = graded.unionByName(spark.range(n).select(F.col("id").alias("obj"), F.lit(0).alias("attr"), F.lit(0).alias("q")))
    return from_long(graded, m, scale)


def scan_aligned_context(spark: SparkSession, path: str, m: int, scale: int = 10) -> Context:
    """Context from a file known to hold one object per line: parsed row by row, no token shuffle.

    As strict as ``scan_context``: the header must announce ``m`` attributes and the objects there are, and grades must
    lie on the grid.
    """
    n, announced = context_header(spark, path)
    if announced != m:
        raise ValueError(f"{path}: {announced} attributes announced, not {m}")
    lines = raw_lines(spark, path).where("trim(value) != ''")
    found = lines.count() - 1
    if found != n:
        raise ValueError(f"{path}: {found} objects where {n} were announced")
    numbered = running_count(lines, F.lit(1), "line").where("line > 0")
    parts = F.split(F.trim("value"), r"\s+")
    value = lambda t: t.try_cast("double")
    wrong = F.filter(parts, lambda t: _off_grid(value(t), scale))
    # the header line is excluded here too: the optimizer may move the filter past this expression
    values = (F.when(F.col("line") == 0, F.lit(None))
              .when(F.size(parts) != m, F.raise_error(F.format_string("line %d: %d values, not %d", "line", F.size(parts), F.lit(m))))
              .when(F.size(wrong) > 0, F.raise_error(F.format_string("line %d: bad value '%s'", "line", F.get(wrong, F.lit(0)))))
              .otherwise(parts))
    grades = F.transform(values, lambda t: fuzzy.quantize(value(t), scale))
    return Context(numbered.select((F.col("line") - 1).alias("obj"), grades.alias("grades")), m, scale)


# ---------------------------------------------------------------- concept collections


def _within(attrs: Column, m: int, line: Column) -> Column:
    """``attrs``, failing on one that is not below ``m``."""
    message = F.format_string("attribute beyond the %d announced in '%s'", F.lit(m), line)
    return F.when(F.exists(attrs, lambda a: (a < 0) | (a >= m)), F.raise_error(message)).otherwise(attrs)


def parse_sets(lines: DataFrame, m: int) -> DataFrame:
    """Distinct masks of lines like ``{a1, a3},``; blank lines are skipped, ``{}`` is the empty set; ids beyond ``m`` fail."""
    ids = F.regexp_extract_all("value", F.lit(SET_MEMBER), F.lit(1))
    zero_based = F.transform(ids, lambda t: t.cast("int") - 1)
    named = lines.where("trim(value) != ''").select(_within(zero_based, m, F.col("value")).alias("attrs"))
    flags = [F.array_contains("attrs", j) for j in range(m)]
    return named.select(*masks.mask_of(flags)).distinct()


def scan_sets(spark: SparkSession, path: str, m: int | None = None) -> DataFrame:
    """``parse_sets`` of a file; the format has no header, so without ``m`` the largest id of the file counts."""
    lines = spark.read.text(path)
    if m is None:
        ids = F.transform(F.regexp_extract_all("value", F.lit(SET_MEMBER), F.lit(1)), lambda t: t.cast("int"))
        m = max(1, lines.agg(F.max(F.array_max(ids))).first()[0] or 1)
    return parse_sets(lines, m)


def parse_intent(value: Column, m: int, scale: int) -> Column:
    """ARRAY<INT> levels of a line like ``I 0.800/0 0.300/2``; attributes not listed are 0; off the grid or beyond ``m`` fails."""
    listed = F.filter(F.split(F.trim(value), r"\s+"), lambda t: t.contains("/"))
    number = lambda t: F.split_part(t, F.lit("/"), F.lit(2)).cast("int")
    grade = lambda t: F.split_part(t, F.lit("/"), F.lit(1)).try_cast("double")
    bad = F.exists(listed, lambda t: _off_grid(grade(t), scale) | (number(t) < 0) | (number(t) >= m))
    pairs = F.transform(listed, lambda t: F.struct(number(t).alias("a"), fuzzy.quantize(grade(t), scale).alias("q")))
    table = F.map_from_entries(F.when(bad, F.raise_error(F.format_string("bad grade or attribute in '%s'", value))).otherwise(pairs))
    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: F.coalesce(F.try_element_at(table, j), F.lit(0)))


def _intents(spark: SparkSession, path: str, m: int | None) -> tuple[DataFrame, int]:
    """Numbered intent lines, and the number of attributes: the one given, which the header may not contradict, or the header's."""
    n_attrs = context_header(spark, path)[1]
    if m is not None and m != n_attrs:
        raise ValueError(f"{path}: {n_attrs} attributes announced, not {m}")
    return running_count(raw_lines(spark, path), F.lit(1), "line").where(F.col("value").rlike(INTENT_LINE)), n_attrs


def scan_intents(spark: SparkSession, path: str, m: int | None = None, scale: int = 10, max_intents: int | None = None) -> DataFrame:
    """(id, grades, card) of the distinct intents, numbered by first occurrence; ``max_intents`` keeps the first ones only."""
    lines, m = _intents(spark, path, m)
    first = lines.select("line", parse_intent(F.col("value"), m, scale).alias("grades")).groupBy("grades").agg(
        F.min("line").alias("line"))
    numbered = ordered_rank(first, ["line"], "id")
    if max_intents is not None:
        numbered = numbered.where(F.col("id") < max_intents)
    return numbered.select("id", "grades", fuzzy.support_card(F.col("grades")).alias("card"))


def scan_sample_input(spark: SparkSession, path: str, m: int | None = None) -> DataFrame:
    """(mask.., card, line, value) of intent lines: plain attribute ids or ``v/a`` pairs (support taken)."""
    lines, m = _intents(spark, path, m)
    parts = F.slice(F.split(F.trim("value"), r"\s+"), 2, 1 << 20)
    def attr(token: Column) -> Column:
        pair = token.contains("/")
        listed = F.when(pair, F.split_part(token, F.lit("/"), F.lit(1)).cast("double") > 0).otherwise(True)
        number = F.when(pair, F.split_part(token, F.lit("/"), F.lit(2))).otherwise(token)
        return F.when(listed, number.cast("int"))
    held = lines.select("line", "value", _within(F.array_compact(F.transform(parts, attr)), m, F.col("value")).alias("attrs"))
    words = masks.mask_of([F.array_contains("attrs", j) for j in range(m)])
    with_mask = held.select(*words, "line", "value")
    return with_mask.withColumn("card", masks.card([F.col(c) for c in masks.mask_cols(m)]))


def random_context(spark: SparkSession, n: int, m: int, seed: int, scale: int = 10) -> Context:
    """Uniform grades in [0.1, 0.9], rounded to the grid; seeded, unlike a random device."""
    cells = [F.round(scale * (0.1 + 0.8 * F.rand(seed + j))).cast("int") for j in range(m)]
    return Context(stage(spark.range(n).select(F.col("id").alias("obj"), F.array(*cells).alias("grades")), "random"), m, scale)
