"""Templates: the strongest neighbours of users and products."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recoflux.config import EngineConfig
from recoflux.sources import scans


def top(strengths: DataFrame, entity: str, k: int) -> DataFrame:
    """The k strongest templates of each entity that aren't 0; ties go to the smaller id. (entity, place, template, strength)

    A rank filter on the window cuts each task's rows to k per entity before the shuffle.
    """
    template = f"template_{entity}"
    place = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("strength"), template))
    rows = strengths.where(F.col("strength") > 0).withColumn("place", place).where(F.col("place") <= k)
    return rows.select(entity, "place", template, "strength")


def user_templates(strengths: DataFrame, config: EngineConfig) -> DataFrame:
    return top(strengths, "user", config.user_templates)


def product_templates(strengths: DataFrame, config: EngineConfig, allowed: DataFrame | None = None, blocked: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Three times the templates asked for, after those not allowed, or blocked, are left out (columns external_id)."""
    rows = strengths
    if allowed is not None:
        rows = rows.join(allowed.select(F.col("external_id").alias("template_product")).distinct(), "template_product", "left_semi")
    if blocked is not None:
        rows = rows.join(blocked.select(F.col("external_id").alias("template_product")).distinct(), "template_product", "left_anti")
    if targets is not None:
        rows = rows.join(targets.select(F.col("external_id").alias("product")).distinct(), "product", "left_semi")
    return top(rows, "product", 3 * config.product_templates)


def allowed_now(products: DataFrame, config: EngineConfig, start_field: str = "date", end_field: str = "expiration_date") -> DataFrame:
    """Products that may be templates: begun and not yet ended."""
    return scans.date_filtered(products, config.present, start_field, end_field)


def cached(templates: DataFrame, entity: str) -> DataFrame:
    """As one row per entity with a list of (strength, id), strongest first; k bounds the list."""
    rows = templates.groupBy(F.col(entity).alias("id")).agg(F.sort_array(F.collect_list(F.struct("place", F.struct("strength", F.col(f"template_{entity}").alias("id")).alias("t")))).alias("rows"))
    return rows.select("id", F.transform("rows", lambda r: r["t"]).alias("templates"))
