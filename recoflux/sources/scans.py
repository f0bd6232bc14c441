"""Scans: predicates that reach the file scan, as plain DataFrame filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recoflux import schema
from recoflux.functions import scalars


def date_range(column: str, least=None, most=None) -> Column:
    """column >= least and <= most, where given; both ends belong to it."""
    out = F.lit(True)
    if least is not None:
        out = out & (F.col(column) >= F.lit(least))
    if most is not None:
        out = out & (F.col(column) <= F.lit(most))
    return out


def among(column: str, values: Sequence | None) -> Column:
    return F.lit(True) if values is None else F.col(column).isin(list(values))


def anonymous(column: str, prefix: str) -> Column:
    return F.col(column).startswith(prefix)


def user_ids(users: DataFrame) -> DataFrame:
    return users.where(~F.col("anonymous")).select("external_id")


def products(table: DataFrame, ids: Sequence | None = None, fields: Sequence | None = None, required: Sequence = (), least=None, most=None, date_field: str = "date", allow_deleted: bool = False) -> DataFrame:
    """Products by id, date and required fields. Deleted ones are left out unless deleted at or after `most`.

    Deliberate: allow_deleted lifts that last condition alone, not the others.
    """
    rows = table.where(among("external_id", ids) & date_range(date_field, least, most))
    if not allow_deleted:
        alive = F.col("deleted_on").isNull()
        rows = rows.where(alive | (F.col("deleted_on") >= F.lit(most)) if most is not None else alive)
    for name in required:
        rows = rows.where(F.col(name).isNotNull())
    return rows.select("external_id", *fields) if fields is not None else rows


def product_ids(table: DataFrame, **conditions) -> DataFrame:
    return products(table, **conditions).select("external_id")


def activity_summaries(summary: DataFrame, users: Sequence | None = None, products: Sequence | None = None, types: Sequence | None = None, least_day=None, limit: int | None = None) -> DataFrame:
    """Summary rows by user or product, newest first in each; the limit is of all rows."""
    if users is None and products is None:
        raise ValueError("users or products must be given")
    rows = summary.where(among("user", users) & among("product", products) & among("activity", types) & date_range("day", least_day))
    rows = rows.orderBy("user" if users is not None else "product", F.desc("created_at"))
    return rows.limit(limit) if limit is not None else rows


def latest_activity_day(summary: DataFrame) -> DataFrame:
    return summary.groupBy("user").agg(F.max("day").alias("day"))


def impression_summaries(table: DataFrame, users: Sequence | None = None, products: Sequence | None = None, by_product: bool = False) -> DataFrame:
    rows = table.where(among("u_id", users) & among("p_id", products))
    return rows.select("p_id", "u_id", "count", "first") if by_product else rows.select("u_id", "p_id", "count", "first")


def impression_pairs(table: DataFrame, column: str, ids: Sequence | None = None) -> DataFrame:
    """Distinct (user, product) pairs with an impression."""
    return table.where(among(column, ids)).select("u_id", "p_id").distinct()


def date_filtered(table: DataFrame, reference, start_field: str, end_field: str | None = None, date_field: str = "date") -> DataFrame:
    """Ids of products that have begun at reference and end no earlier; without an end field, those of that date or later."""
    at = F.lit(reference)
    kept = (F.col(start_field) <= at) & (F.col(end_field or date_field) >= at)
    return table.where(kept).select("external_id")


def checked(rows: DataFrame, limit: int) -> DataFrame:
    """rows, or an error when they are more than limit."""
    n = F.count(F.lit(1)).alias("n")
    ok = rows.limit(limit + 1).agg(n).select(F.assert_true(F.col("n") <= limit, F.lit(f"more than {limit} rows")).alias("ok"))
    return rows.join(F.broadcast(ok), F.col("ok").isNull()).drop("ok")


def models_sharing_terms(models: DataFrame, tfidf: DataFrame, attribute: str, language: str, terms: Sequence) -> DataFrame:
    """Models with any of the terms in the attribute, in the same language (deliberate: the language does count)."""
    hits = tfidf.where((F.col("attribute") == attribute) & (F.col("language") == language) & F.col("term").isin(list(terms))).select("product")
    return models.join(hits.distinct(), "product", "left_semi")


def strengths(table: DataFrame, column: str, targets: Sequence | None = None, templates: Sequence | None = None, keep_zeros: bool = False) -> DataFrame:
    """Strength rows by target and template; zeros are kept for content strengths alone."""
    rows = table.where(among(column, targets) & among(f"template_{column}", templates))
    return rows if keep_zeros else rows.where(F.col("strength") > 0)


def operands(table: DataFrame, column: str, targets: Sequence | None = None, templates: Sequence | None = None) -> DataFrame:
    rows = table.where(among(column, targets) & among(f"template_{column}", templates))
    return rows.select(column, f"template_{column}", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("nc", "na", "denominator")])


def popular(table: DataFrame, n: int | None = None, ids: Sequence | None = None, least_day=None) -> DataFrame:
    """The n most popular products; ties go to the larger id."""
    if n is None and ids is None:
        raise ValueError("n or ids must be given")
    rows = table.where(among("p_id", ids) & date_range("latest", least_day)).orderBy(F.desc("popularity"), F.desc("p_id"))
    return rows.limit(n) if n is not None else rows


def document_frequency(df: DataFrame, language: str, terms: DataFrame) -> DataFrame:
    """df of each term of `terms` (column term); 0 where it isn't known."""
    known = df.where(F.col("language") == language).select("term", "df")
    return terms.join(known, "term", "left").select("term", F.coalesce("df", F.lit(0)).cast("long").alias("df"))


def templates_of(cache: DataFrame, ids: Sequence | None = None) -> DataFrame:
    """Cached templates as rows (id, place, strength, template)."""
    rows = cache.where(among("id", ids)).select("id", F.posexplode("templates").alias("place", "t"))
    return rows.select("id", (F.col("place") + 1).alias("place"), F.col("t.strength").alias("strength"), F.col("t.id").alias("template"))


def counts(users: DataFrame, products: DataFrame, models: DataFrame) -> DataFrame:
    """Rows (name, n): users that aren't anonymous, products, product models."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    return one(users.where(~F.col("anonymous")), "users").unionAll(one(products, "products")).unionAll(one(models, "models"))


def sample_users(users: DataFrame, n: int, seed: int) -> DataFrame:
    """n distinct users, the first by a seeded hash: the same on every run."""
    return users.select("external_id").distinct().orderBy(scalars.dice(F.lit(seed), F.col("external_id")), "external_id").limit(n)


def distinct_sample(table: DataFrame, column: str, n: int = 100) -> DataFrame:
    """Up to n distinct values, for load tests."""
    return table.select(column).distinct().orderBy(column).limit(n)


def latest_runs(log: DataFrame) -> DataFrame:
    """The newest row of each type of the run log."""
    newest = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("timestamp")))
    return log.withColumn("_n", newest).where("_n = 1").drop("_n")


def raw_activities(table: DataFrame, types: Sequence, after=None, before=None) -> DataFrame:
    """Activities of the given types of users that aren't anonymous, strictly between two times; rows without user or product are left out."""
    rows = table.where(F.col("user").isNotNull() & F.col("product").isNotNull() & ~F.col("anonymous") & F.col("activity").isin(list(types)))
    if after is not None:
        rows = rows.where(F.col("created_at") > F.lit(after))
    return rows.where(F.col("created_at") < F.lit(before)) if before is not None else rows


def raw_impressions(table: DataFrame, after_id=None, before=None, id_column: str = "event_id") -> DataFrame:
    rows = table.where(F.col("user").isNotNull() & F.col("product").isNotNull())
    if after_id is not None:
        rows = rows.where(F.col(id_column) > F.lit(after_id))
    return rows.where(F.col("created_at") < F.lit(before)) if before is not None else rows


def popularity_rows(summary: DataFrame, types: Sequence, since_day=None, before=None) -> DataFrame:
    """Summary rows that popularity is made of, from a day on."""
    rows = summary.where(F.col("activity").isin(list(types)) & date_range("day", since_day))
    return rows.where(F.col("created_at") < F.lit(before)) if before is not None else rows


def csv(spark, path: str, columns=schema.CSV_STRENGTHS, header: bool = False) -> DataFrame:
    """A typed CSV file. Deliberate: a row that can't be parsed is dropped and reading goes on."""
    return spark.read.schema(columns).option("header", header).option("mode", "DROPMALFORMED").csv(path).where(F.col("entity").isNotNull())
