"""Recent products, ranks, numbered rows and fill-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recoflux.config import EngineConfig
from recoflux.functions import scalars

BUCKETS = 256


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt by columns into all shuffle partitions. A self-join makes far more rows than it reads, so
    partitions must not be put together by the size of what is read."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def dealt_anew(union: DataFrame, *columns: str) -> DataFrame:
    """A union dealt by columns. Spark's union of sides that are dealt by the same columns counts as dealt by them, also where the
    sides' partitions have been put together in different ways; another number of partitions makes it shuffle them."""
    return union.repartition(int(union.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, *columns)


def recent_activities(summary: DataFrame, config: EngineConfig) -> DataFrame:
    """Each user's rows of the days up to short_term_window before that user's own last day."""
    last = F.max("day").over(Window.partitionBy("user"))
    rows = summary.withColumn("_last", last)
    return rows.where(F.col("day") >= F.col("_last") - F.make_interval(days=F.lit(config.short_term_window))).drop("_last")


def recent_products(recent: DataFrame, config: EngineConfig) -> DataFrame:
    """(user, base_rank from 0, product): the user's products, newest first, three times recent_products at most."""
    place = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("created_at"), "product")) - 1
    return recent.select("user", "product", place.alias("base_rank")).where(F.col("base_rank") < 3 * config.recent_products)


def template_activities(summary: DataFrame, config: EngineConfig) -> DataFrame:
    """Activities that users' templates lend: of the last short_term_window days before the present, rated well enough."""
    since = F.date_trunc("day", F.lit(config.present)) - F.make_interval(days=F.lit(config.short_term_window))
    rows = summary.where(F.col("day") >= since).withColumn("rating", scalars.rating(F.col("activity"), config))
    return rows.where(F.col("rating") >= config.min_rating_from_user)


def ranked(scored: DataFrame, n: int | None = None, key: str = "user") -> DataFrame:
    """rank by score DESC, product DESC, the first n of each user."""
    rows = scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.desc("product"))))
    return rows.where(F.col("rank") <= n) if n is not None else rows


def numbered(df: DataFrame, column: str, seed: int) -> DataFrame:
    """df with a gapless `position` from 0 in the order of a seeded hash of the column.

    Rows are numbered in hash buckets, whose starts come from at most 256 counts.
    """
    rows = df.withColumn("_hash", scalars.dice(F.lit(seed), F.col(column))).withColumn("_bucket", F.pmod("_hash", F.lit(BUCKETS)))
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", column))
    return rows.withColumn("_place", place).join(F.broadcast(starts), "_bucket").withColumn("position", F.col("_start") + F.col("_place") - 1).drop("_hash", "_bucket", "_place", "_start")
