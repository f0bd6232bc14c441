"""The three-way merge of strength operands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_operands(numerators: DataFrame, denominators: DataFrame, strengths: DataFrame) -> DataFrame:
    """All (entity, template) of any side with nc, na, denominator and strength; what a side lacks is null.

    One aggregation of the sides laid under each other, so all three are
    shuffled once; two outer joins would shuffle the first result again if keys went missing.
    """
    keys = ["entity", "template"]
    blank = lambda kind: F.lit(None).cast(kind)
    parts = [
        numerators.select(*keys, "nc", "na", blank("long").alias("denominator"), blank("double").alias("strength")),
        denominators.select(*keys, blank("long").alias("nc"), blank("long").alias("na"), "denominator", blank("double").alias("strength")),
        strengths.select(*keys, blank("long").alias("nc"), blank("long").alias("na"), blank("long").alias("denominator"), "strength"),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("nc", "na", "denominator", "strength")])
