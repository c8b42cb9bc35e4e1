"""Contexts over the star-schema tables: which objects, which attributes.

Grades follow one rule: 10 * count // largest count of the object.  Scans read
only the two or three columns a context needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelattice.operators.context import Context, grade_counts, grade_vectors

# Categorical attributes in ascending order.
ORDER_STATUS = ("F", "O", "P")
RETURN_FLAGS = ("A", "N", "R")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
LANGUAGES = ("de", "en", "es", "fr")
EMBEDDING_DIMS = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rank_of(col: str, values: tuple[str, ...]) -> Column:
    """0-based position of a categorical value; one that is not listed fails the job, null stays null."""
    message = F.format_string("%s '%s' is not among %s", F.lit(col), F.col(col), F.lit(", ".join(values)))
    out = F.when(F.col(col).isNotNull(), F.raise_error(message).cast("int"))
    for i, v in reversed(list(enumerate(values))):
        out = F.when(F.col(col) == v, i).otherwise(out)
    return out


def brand_size(spark: SparkSession, folder: str) -> Context:
    """Brands x ten size bands of parts."""
    return grade_counts(table(spark, folder, "part"), F.col("p_brand"), F.expr("cast((p_size - 1) div 5 as int)"), 10)


def type_brand(spark: SparkSession, folder: str) -> Context:
    """Part types x the 25 brands ``Brand#1`` .. ``Brand#25``."""
    brand = F.substring("p_brand", 7, 2).cast("int") - 1
    return grade_counts(table(spark, folder, "part"), F.col("p_type"), brand, 25)


def type_size(spark: SparkSession, folder: str) -> Context:
    """Part types x the 50 sizes: few objects, many attributes, a large lattice."""
    return grade_counts(table(spark, folder, "part"), F.col("p_type"), F.col("p_size") - 1, 50)


def seg_month(spark: SparkSession, folder: str) -> Context:
    """(market segment, order status) x month of the order."""
    # the join key is the customer; AQE broadcasts the customer side only while it is small
    facts = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    obj = F.concat("c_mktsegment", F.lit("|"), "o_orderstatus")
    return grade_counts(facts, obj, F.month("o_orderdate") - 1, 12)


def region_bucket(spark: SparkSession, folder: str) -> Context:
    """Regions x last digit of the ordering customer's key."""
    facts = (table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
             .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")))
    return grade_counts(facts, F.col("n_regionkey"), F.expr("cast(o_custkey % 10 as int)"), 10)


def supplier_month(spark: SparkSession, folder: str) -> Context:
    """Suppliers x month of shipment; objects grow with the data."""
    return grade_counts(table(spark, folder, "lineitem"), F.col("l_suppkey"), F.month("l_shipdate") - 1, 12)


def nation_month(spark: SparkSession, folder: str) -> Context:
    """Supplier nations x month of shipment."""
    facts = table(spark, folder, "lineitem").join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return grade_counts(facts, F.col("s_nationkey"), F.month("l_shipdate") - 1, 12)


def supplier_flag(spark: SparkSession, folder: str) -> Context:
    """Suppliers x return flag."""
    return grade_counts(table(spark, folder, "lineitem"), F.col("l_suppkey"), rank_of("l_returnflag", RETURN_FLAGS), 3)


def customer_priority(spark: SparkSession, folder: str) -> Context:
    """Customers x order priority; objects grow with the data."""
    return grade_counts(table(spark, folder, "orders"), F.col("o_custkey"), rank_of("o_orderpriority", PRIORITIES), 5)


def user_event(spark: SparkSession, folder: str) -> Context:
    """Users x event type."""
    return grade_counts(table(spark, folder, "events"), F.col("user_id"), rank_of("event_type", EVENT_TYPES), 5)


def nation_status(spark: SparkSession, folder: str) -> Context:
    """Nations x order status: a small residuated context."""
    facts = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return grade_counts(facts, F.col("c_nationkey"), rank_of("o_orderstatus", ORDER_STATUS), 3)


def customer_status(spark: SparkSession, folder: str) -> Context:
    """Customers x order status: a residuated context whose objects grow with the data."""
    return grade_counts(table(spark, folder, "orders"), F.col("o_custkey"), rank_of("o_orderstatus", ORDER_STATUS), 3)


def source_lang(spark: SparkSession, folder: str) -> Context:
    """Document sources x language."""
    return grade_counts(table(spark, folder, "documents"), F.col("source"), rank_of("lang", LANGUAGES), 4)


def embedding_dims(spark: SparkSession, folder: str) -> Context:
    """Vectors x all 64 dimensions, min-max scaled per vector."""
    return grade_vectors(table(spark, folder, "embeddings"), F.col("vec_id"), F.col("embedding"), EMBEDDING_DIMS)
