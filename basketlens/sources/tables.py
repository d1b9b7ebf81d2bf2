"""Purchase logs and embedding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("order_id", T.LongType()),
                           T.StructField("product_id", T.StringType())])


def read_transactions(spark: SparkSession, path: str, user: str = "user_id", order: str = "order_id", item: str = "product_id",
                      schema: T.StructType | None = None) -> DataFrame:
    """`user, order, item` from a CSV file with a header, or from Parquet if the path says so.

    Only the three columns are read; the schema is declared, never inferred.
    """
    if path.rstrip("/").endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        raw = spark.read.schema(schema or LOG_SCHEMA).option("header", True).option("enforceSchema", False).csv(path)
    return raw.select(F.col(user).alias("user"), F.col(order).alias("order"), F.col(item).alias("item"))


def order_lines(orders: DataFrame, lines: DataFrame, item: DataFrame | None = None) -> DataFrame:
    """Log from an orders table and a lines table: the customer's order lines, optionally mapped to a coarser item
    by `item(l_partkey, item)`."""
    log = lines.select("l_orderkey", "l_partkey").join(
        orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"), "l_orderkey")
    log = log.join(item, "l_partkey") if item is not None else log.withColumn("item", F.col("l_partkey"))
    return log.select(F.col("o_custkey").alias("user"), F.col("l_orderkey").alias("order"), "item",
                      F.col("o_orderdate").alias("ordered_at"))


def write_embeddings(vectors: DataFrame, path: str) -> None:
    """`id, vec` as Parquet."""
    vectors.select("id", F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """`id, vec`, from Parquet or from text dumps of one comma-separated vector per line with the id first."""
    if path.rstrip("/").endswith((".csv", ".txt")):
        parts = F.split("value", r",\s*")
        return spark.read.text(path).select(
            parts[0].alias("id"), F.slice(parts, 2, F.size(parts) - 1).cast("array<float>").alias("vec"))
    return spark.read.parquet(path)
