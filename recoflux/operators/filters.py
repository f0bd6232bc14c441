"""The context filter language, and blocked products."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoflux.config import EngineConfig
from recoflux.functions import scalars

COMPARISONS = {
    "$ne": lambda a, b: a != b,
    "$lt": lambda a, b: a < b,
    "$lte": lambda a, b: a <= b,
    "$gt": lambda a, b: a > b,
    "$gte": lambda a, b: a >= b,
    "$eq": lambda a, b: a == b,
    "$in": lambda a, b: a.isin(b),
}


def parse(text: str, config: EngineConfig) -> Column:
    """A JSON filter as a condition on product models.

    {attribute: value}, {attribute: {operator: value}}, {"$and": [..]} and
    {"$or": [..]}; several keys are all to hold. On a list attribute a value
    means that the list has it. ValueError for bad JSON, an unknown attribute or
    operator, or a date that can't be read.
    """
    try:
        tree = json.loads(text)
    except ValueError as error:
        raise ValueError(f"not a JSON filter: {text}") from error
    return condition(tree, config)


def canonical(text: str) -> str:
    """Equal filters as equal strings: the key of a cache."""
    return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))


def condition(tree, config: EngineConfig) -> Column:
    if not isinstance(tree, dict):
        raise ValueError(f"a filter is an object, not {tree!r}")
    parts = []
    for key, value in tree.items():
        if key in ("$and", "$or"):
            if not isinstance(value, list) or not value:
                raise ValueError(f"{key} takes a list of filters")
            parts.append(reduce(lambda a, b, k=key: a & b if k == "$and" else a | b, [condition(v, config) for v in value]))
        else:
            parts += compared(key, value, config)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def compared(name: str, value, config: EngineConfig) -> list[Column]:
    try:
        attribute = config.attribute(name)
    except KeyError as error:
        raise ValueError(f"unknown filter attribute {name}") from error
    column = F.col(name)

    def literal(v):
        if attribute.kind != "date" or isinstance(v, list):
            return v
        try:
            return F.lit(scalars.parse_iso(v)).cast("timestamp")
        except (TypeError, ValueError) as error:
            raise ValueError(f"{v!r} is no date") from error

    if not isinstance(value, dict):
        if attribute.kind in ("list", "text") and not isinstance(value, list):
            return [F.array_contains(column, value)]
        return [column == (F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else literal(value))]
    out = []
    for op, v in value.items():
        if op not in COMPARISONS:
            raise ValueError(f"unknown operator {op}")
        out.append(COMPARISONS[op](column, literal(v)))
    return out


def filtered(models: DataFrame, text: str | None, config: EngineConfig) -> DataFrame:
    """Ids of the product models that pass."""
    return (models.where(parse(text, config)) if text else models).select("external_id")


def blocked(recent: DataFrame, config: EngineConfig) -> DataFrame:
    """(user, product) with a recent blocking activity; empty where no type blocks."""
    return recent.where(F.col("activity").isin(config.blocking) if config.blocking else F.lit(False)).select("user", "product").distinct()
