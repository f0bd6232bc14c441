"""Activity, impression and popularity summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflux.config import EngineConfig
from recoflux.functions import scalars
from recoflux.sources import scans


def activity_summary(activities: DataFrame, config: EngineConfig, after=None, before=None, named_only: bool = True) -> DataFrame:
    """The latest activity of each (user, product), with its day; of several at one time, the last type by name.

    Types go through the aggregation as numbers next to the time, so that it stays a hash aggregation.
    """
    kinds = sorted(config.activities)
    rows = scans.raw_activities(activities if named_only else activities.withColumn("anonymous", F.lit(False)), kinds, after, before)
    code = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("activity")).cast("int")
    rows = rows.select("user", "product", code.alias("code"), "created_at")
    rows = rows.groupBy("user", "product").agg(F.max_by("code", F.unix_micros("created_at") * len(kinds) + F.col("code")).alias("code"), F.max("created_at").alias("created_at"))
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("code"))
    return rows.select("user", "product", kind.alias("activity"), scalars.day(F.col("created_at")).alias("day"), "created_at")


def impression_summary(impressions: DataFrame, activities: DataFrame, config: EngineConfig) -> DataFrame:
    """Impressions of each (user, product) after its last activity, and the first impression of all.

    The order of the two streams matters only through the pair's last
    activity, so the merge is a join with that. At equal times the impression comes
    first and isn't counted. The activities are aggregated before they are joined, and both sides
    are dealt by (user, product), as is the aggregation after the join.
    """
    shown = scans.raw_impressions(impressions).select("user", "product", F.col("created_at").alias("shown"))
    done = scans.raw_activities(activities.withColumn("anonymous", F.lit(False)), sorted(config.activities))
    last = done.groupBy("user", "product").agg(F.max("created_at").alias("done"))
    rows = shown.join(last, ["user", "product"], "left")
    counted = F.col("done").isNull() | (F.col("shown") > F.col("done"))
    return rows.groupBy(F.col("user").alias("u_id"), F.col("product").alias("p_id")).agg(F.sum(F.when(counted, 1).otherwise(0)).cast("long").alias("count"), F.min("shown").alias("first"))


def popularity(summary: DataFrame, config: EngineConfig, since_day=None, before=None) -> DataFrame:
    """Users per active day of each product: users over the days from its first to its latest activity."""
    rows = scans.popularity_rows(summary, popular_kinds(config), since_day, before)
    rows = rows.groupBy(F.col("product").alias("p_id")).agg(F.min("day").alias("first"), F.max("day").alias("latest"), F.count(F.lit(1)).alias("count"))
    return rows.withColumn("popularity", F.col("count") / (F.datediff("latest", "first") + 1))


def popular_kinds(config: EngineConfig) -> list[str]:
    """Activity types that make a product popular: a rating of at least min_rating_conservative."""
    return sorted(k for k, a in config.activities.items() if a.rating >= config.min_rating_conservative)


def by_rating(summary: DataFrame, config: EngineConfig, key: str, other: str) -> DataFrame:
    """(key, rating, others): who is tied to key with each rating."""
    rows = summary.withColumn("rating", scalars.rating(F.col("activity"), config)).where(F.col("rating").isNotNull())
    return rows.groupBy(key, "rating").agg(F.sort_array(F.collect_set(other)).alias(f"{other}s"))


def rating_histogram(summary: DataFrame, config: EngineConfig) -> DataFrame:
    rows = summary.withColumn("rating", scalars.rating(F.col("activity"), config)).where(F.col("rating").isNotNull())
    return rows.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))
