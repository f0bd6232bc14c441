"""A/B-test statistics by simulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def simulated(spark: SparkSession, sessions_per_day: int, buys_per_day: int, days: int, share: float, gain: float, tests: int = 20_000, seed: int = 1) -> DataFrame:
    """One row per simulated test: buys of A and B over all days, days won by each and drawn, and the gain reported.

    Each test draws from a generator seeded by its number, so a lost task draws the same again.
    """
    sessions = round(sessions_per_day * share / 2)
    p = buys_per_day / sessions_per_day

    def run(frames):
        for frame in frames:
            out = []
            for k in frame["id"]:
                random = np.random.default_rng([seed, int(k), int(round(gain * 1e6)) + 10**9])
                a, b = random.binomial(sessions, p, days), random.binomial(sessions, min(1.0, p * (1 + gain)), days)
                out.append((k, int(a.sum()), int(b.sum()), int((a > b).sum()), int((b > a).sum()), int((a == b).sum())))
            yield pd.DataFrame(out, columns=["test", "buys_a", "buys_b", "won_a", "won_b", "drawn"])

    rows = spark.range(tests).mapInPandas(run, "test long, buys_a long, buys_b long, won_a long, won_b long, drawn long")
    return rows.withColumn("gain", F.when(F.col("buys_a") > 0, (F.col("buys_b") - F.col("buys_a")) / F.col("buys_a")))


def reliability(tests: DataFrame, expected: float, accepted: float) -> DataFrame:
    """The share of tests that report a gain of at least expected - accepted; a test without buys of A counts."""
    good = F.col("gain").isNull() | (F.col("gain") >= expected - accepted)
    return tests.agg(F.avg(good.cast("double")).alias("reliability"))


def gain_posterior(spark: SparkSession, sessions_per_day: int, buys_per_day: int, days: int, share: float, reported: float, least: float = -0.3, most: float = 0.5, step: float = 0.01, tests: int = 20_000, seed: int = 1) -> DataFrame:
    """P(actual gain | reported gain) over a grid of gains, with a flat prior, and its running sum."""
    gains = [round(least + k * step, 10) for k in range(int(round((most - least) / step)) + 1)]
    parts = [simulated(spark, sessions_per_day, buys_per_day, days, share, g, tests, seed).select(F.lit(g).alias("actual"), "gain") for g in gains]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    hit = (F.round(F.col("gain"), 2) == round(reported, 2)).cast("double")
    rows = rows.groupBy("actual").agg(F.avg(F.coalesce(hit, F.lit(0.0))).alias("likelihood"))
    whole = Window.partitionBy(F.lit(0))  # a row for each gain of the grid
    rows = rows.withColumn("probability", F.col("likelihood") / F.sum("likelihood").over(whole))
    return rows.withColumn("accrued", F.sum("probability").over(whole.orderBy("actual").rowsBetween(Window.unboundedPreceding, 0)))


def needed_days(spark: SparkSession, sessions_per_day: int, buys_per_day: int, share: float, expected: float, accepted: float, least: float, tests: int = 20_000, most_days: int = 365) -> int | None:
    """The fewest days after which tests are reliable enough."""
    for days in range(1, most_days + 1):
        found = reliability(simulated(spark, sessions_per_day, buys_per_day, days, share, expected, tests), expected, accepted).first()
        if found.reliability >= least:
            return days
    return None
