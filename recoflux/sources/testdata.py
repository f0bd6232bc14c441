"""The engine's tables from a star schema with an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRODUCTS = 100  # products that events name: props.k is 0 .. 99


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and product; users whose number ends in 9 are anonymous."""
    events = read(spark, sf_dir, "events")
    user = F.concat(F.when(F.col("user_id") % 10 == 9, "hmrtmp").otherwise("u"), F.col("user_id"))
    product = F.concat(F.lit("p"), F.get_json_object("props", "$.k"))
    return events.select(user.alias("user"), product.alias("product"), F.col("event_type").alias("activity"), F.col("ts").cast("timestamp").alias("created_at"), (F.col("user_id") % 10 == 9).alias("anonymous"), "event_id")


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where(F.col("activity") != "view").drop("event_id")


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where(F.col("activity") == "view").drop("activity")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("user").alias("external_id"), "anonymous").distinct()


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as products; the part of the same number lends title, category and price.

    Dates follow the number: the last 40 days before 2024-01-31, expiring 30 days
    on; each 17th product was deleted on 2024-01-25.
    """
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")
    rows = documents.join(part, documents["doc_id"] == part["p_partkey"], "left")
    date = F.to_timestamp(F.lit("2024-01-31 00:00:00")) - F.make_interval(days=(F.col("doc_id") % 40 + 1).cast("int"))
    return rows.select(
        F.concat(F.lit("p"), "doc_id").alias("external_id"),
        F.col("lang").alias("language"),
        F.col("p_type").alias("category"),
        F.array("source").alias("source"),
        F.coalesce("p_name", F.concat(F.lit("document "), "doc_id")).alias("title"),
        F.col("text").alias("full_content"),
        F.col("p_retailprice").alias("price"),
        date.alias("date"),
        (date + F.make_interval(days=F.lit(30))).alias("expiration_date"),
        F.when(F.col("doc_id") % 17 == 16, F.to_timestamp(F.lit("2024-01-25 00:00:00"))).alias("deleted_on"),
    )


def sparse_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers buy parts: a second, sparser log. The line number orders purchases of a day."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    rows = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return rows.select(F.concat(F.lit("c"), "o_custkey").alias("user"), F.concat(F.lit("p"), "l_partkey").alias("product"), F.lit("purchase").alias("activity"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.lit(False).alias("anonymous"))
