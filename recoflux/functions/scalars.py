"""Decays, similarities, boosts and dates as column expressions."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recoflux.config import Decay, EngineConfig


def linear(x: Column, root: float) -> Column:
    return 1 - F.least(x, F.lit(float(root))) / F.lit(float(root))


def rational(x: Column) -> Column:
    return 1 / (x + F.lit(1.0))


def exponential(x: Column, halflife: float) -> Column:
    return F.pow(F.lit(2.0), -x / F.lit(float(halflife)))


def step(x: Column, high: float, low: float, at: float) -> Column:
    return F.when(x < F.lit(float(at)), F.lit(float(high))).otherwise(F.lit(float(low)))


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days of elapsed time, rounded down also below zero; not a difference of calendar days."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000)).cast("long")


def decayed(x: Column, decay: Decay, low: float = 0.0) -> Column:
    """A decay by its settings; low is what a step falls to."""
    if decay.kind == "none":
        return F.lit(1.0)
    if decay.kind == "linear":
        return linear(x, decay.parameter)
    if decay.kind == "rational":
        return rational(x)
    if decay.kind == "exponential":
        return exponential(x, decay.parameter)
    if decay.kind == "step":
        return step(x, 1.0, low, decay.parameter)
    raise ValueError(f"unknown decay {decay.kind}")


def age_decay(date: Column, config: EngineConfig) -> Column:
    """By age in whole days; a date in the future has a negative age and a factor above 1. No date: 1."""
    return F.coalesce(decayed(whole_days(F.lit(config.present), date), config.age_decay), F.lit(1.0))


def history_decay(impressions: Column, config: EngineConfig) -> Column:
    """By how often the product was shown since; a step falls to -1, so that the product is left out."""
    return decayed(F.coalesce(impressions, F.lit(0)), config.history_decay, low=-1.0)


def by_activity(activity: Column, config: EngineConfig, what: str, default: float = 1.0) -> Column:
    """A setting (rating, in_boost, out_boost, blocking) of an activity type."""
    cases = [(kind, getattr(a, what)) for kind, a in sorted(config.activities.items())]
    out = reduce(lambda c, x: c.when(activity == x[0], F.lit(x[1])), cases[1:], F.when(activity == cases[0][0], F.lit(cases[0][1])))
    return out.otherwise(F.lit(default)) if default is not None else out


def rating(activity: Column, config: EngineConfig) -> Column:
    """The rating of an activity type; null for a type that isn't supported."""
    return by_activity(activity, config, "rating", None)


def post_processed(score: Column, *factors: Column) -> Column:
    """Every number of the score times all factors."""
    return F.transform(score, lambda x: reduce(lambda a, f: a * f, factors, x))


def dice(*parts: Column) -> Column:
    """A number from 0 to 2**32 - 1 by the MD5 hash of the parts: the same on every run and in every engine."""
    text = F.concat_ws("/", *[x.cast("string") for x in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def similar_numeric(a: Column, b: Column) -> Column:
    """min / max, 1 if both are 0; null where max is 0 and min isn't."""
    return F.when((a == 0) & (b == 0), F.lit(1.0)).when(F.greatest(a, b) == 0, F.lit(None).cast("double")).otherwise(F.least(a, b) / F.greatest(a, b))


def similar_date(a: Column, b: Column, halflife: float | None) -> Column:
    """2 ** (-days / halflife); without a halflife always 1."""
    return F.lit(1.0) if halflife is None else exponential(F.abs(whole_days(F.greatest(a, b), F.least(a, b))).cast("double"), halflife)


def similar_fixed(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))


def similar_list(a: Column, b: Column) -> Column:
    """Shared values over the values of a; 1 if a is empty. Not symmetric."""
    n = F.size(F.array_distinct(a))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


def day(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def parse_date(text: Column, pattern: str | None = None) -> Column:
    """Null where it can't be parsed."""
    return F.try_to_timestamp(text, F.lit(pattern)) if pattern else F.try_to_timestamp(text)


def parse_dates(texts: Column, pattern: str | None = None) -> Column:
    return F.transform(texts, lambda x: parse_date(x, pattern))


def date_series(first: Column, last: Column) -> Column:
    """Every day from first to last."""
    return F.sequence(day(first), day(last), F.make_interval(days=F.lit(1)))


def parse_iso(text: str) -> datetime:
    return datetime.fromisoformat(text)


def session_id(text: str | None) -> str:
    """text as a GUID, or a new one where it isn't one."""
    try:
        return str(uuid.UUID(text))
    except (ValueError, TypeError, AttributeError):
        return str(uuid.uuid4())
