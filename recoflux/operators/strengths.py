"""User-user and product-product strengths: one self-join for both."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoflux.config import EngineConfig
from recoflux.functions import scalars
from recoflux.operators.ranking import dealt
from recoflux.sources import sinks

#: Rows of one side of a shared item that meet rows of the other side in one cell.
CELL = 1024
#: Shared items up to which users meet in blocks, as products of matrices: with so few, most pairs of users share one.
ITEMS = 4096
#: Targets of a block at most, and blocks of targets that are made of fewer; templates of a block; numbers of its matrix of items; scores made at once.
TARGETS, BLOCKS, TEMPLATES, NUMBERS, SCORES = 4096, 48, 1 << 17, 1 << 24, 1 << 21
#: What a float32 score may be off, and more: candidates for the best are looked at again as float64.
SLACK = 1e-3


@dataclass(frozen=True)
class Roles:
    """Which column is compared, over which shared column, and the least ratings of both sides.

    na follows the rating of the conservative side: the target of users, the template of products.
    The denominator counts the other side: what the template user, or who the base product, is tied to.
    """

    entity: str
    shared: str
    target_rating: int
    template_rating: int
    conservative: str

    @property
    def template(self) -> str:
        return f"template_{self.entity}"


def user_roles(config: EngineConfig) -> Roles:
    return Roles("user", "product", config.min_rating_conservative, config.min_rating_from_user, "target")


def product_roles(config: EngineConfig) -> Roles:
    return Roles("product", "user", config.min_rating_from_product, config.min_rating_conservative, "template")


def rated(summary: DataFrame, config: EngineConfig, window: int | None) -> DataFrame:
    """(user, product, rating) of supported activities; with a window, of so many days before the present day."""
    rows = summary.withColumn("rating", scalars.rating(F.col("activity"), config)).where(F.col("rating").isNotNull())
    if window is not None:
        rows = rows.where(F.col("day") >= F.date_trunc("day", F.lit(config.present)) - F.make_interval(days=F.lit(window)))
    return rows.select("user", "product", "rating")


def strength(nc: Column, na: Column, denominator: Column, config: EngineConfig) -> Column:
    """(na r + nc (1 - r)) / denominator; 0 if that is 0, if nc is too small or if the value is below the least strength."""
    value = (na * F.lit(config.risk) + nc * F.lit(1 - config.risk)) / denominator
    none = (denominator == 0) | (nc < config.min_numerator)
    return F.when(none, F.lit(0.0)).when(value < config.min_strength, F.lit(0.0)).otherwise(value)


def gridded(left: DataFrame, right: DataFrame, roles: Roles, cell: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the columns to join them by: the shared item and a cell of its grid.

    A side with n rows of an item is split by hash into n / cell parts, each written once for every part of the other side. So
    an item makes as many cells as its pairs need, and any number of tasks can share one that everybody has.
    """
    parts = lambda df, name: df.groupBy(roles.shared).agg(F.ceil(F.count(F.lit(1)) / cell).cast("int").alias(name))
    grid = parts(left, "_rows").join(parts(right, "_columns"), roles.shared)
    part = lambda entity, n: F.pmod(F.xxhash64(entity), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(grid, roles.shared).withColumn("_row", part(roles.entity, "_rows")).withColumn("_column", every("_columns"))
    right = right.join(grid, roles.shared).withColumn("_column", part(roles.template, "_columns")).withColumn("_row", every("_rows"))
    return left.drop("_rows", "_columns"), right.drop("_rows", "_columns"), [roles.shared, "_row", "_column"]


def numerators(rows: DataFrame, roles: Roles, config: EngineConfig, impressions: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """nc (shared items) and na (those rated high by the conservative side) of each pair of different entities.

    With impressions, the target must have been shown the item. `targets` (a
    column of the entity's name) restricts the pairs to those targets.
    Pairs are made cell by cell (see gridded) and summed where they are made, before they are shuffled.
    """
    left = rows.where(F.col("rating") >= roles.target_rating)
    if impressions is not None:
        shown = impressions.select(F.col("u_id").alias("user"), F.col("p_id").alias("product")).distinct()
        left = left.join(shown, ["user", "product"], "left_semi")
    if targets is not None:
        left = left.join(targets.select(roles.entity).distinct(), roles.entity, "left_semi")
    left = left.select(roles.shared, F.col(roles.entity), F.col("rating").alias("_target"))
    right = rows.where(F.col("rating") >= roles.template_rating).select(roles.shared, F.col(roles.entity).alias(roles.template), F.col("rating").alias("_template"))
    left, right, cell = gridded(left, right, roles, CELL)
    pairs = dealt(left, *cell).join(dealt(right, *cell), cell).where(F.col(roles.entity) != F.col(roles.template))
    high = F.col(f"_{roles.conservative}") >= config.min_rating_aggressive
    return pairs.groupBy(roles.entity, roles.template).agg(F.count(F.lit(1)).alias("nc"), F.sum(F.when(high, 1).otherwise(0)).cast("long").alias("na"))


def dense(lists: pa.ListArray, width: int) -> np.ndarray:
    """A row for each list, with how often each number below width is in it."""
    at = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy()) * width
    return np.bincount(at + lists.flatten().to_numpy(), minlength=len(lists) * width).reshape(len(lists), width).astype(np.float32)


def block_strengths(table: pa.Table, items: int, config: EngineConfig, with_shown: bool, best: int | None) -> Iterator[pa.RecordBatch]:
    """Of one block, the pairs that share an item, or the `best` strongest above 0 of each target, ties to the smaller id.

    Rows are targets (_role 0, with the items rated, those rated high and those shown) and templates (_role 1).
    Strips of targets meet all templates; counts are sums of products of 0 and 1, which float32 holds exactly.
    """
    role = table.column("_role").to_numpy()
    mine, others = table.filter(pa.array(role == 0)), table.filter(pa.array(role == 1)).sort_by("user")
    column = lambda side, name: side.column(name).combine_chunks()
    names, templates = column(mine, "user"), column(others, "user")
    if not len(names) or not len(templates):
        return
    given = dense(column(others, "rated"), items)
    counted = given.sum(axis=1)
    across = np.ascontiguousarray(given.T)
    own = {x: k for k, x in enumerate(templates.to_pylist())}
    weighed = across if with_shown else across / np.maximum(counted, 1)

    def exact(nc: np.ndarray, na: np.ndarray, den: np.ndarray) -> np.ndarray:
        nc, na = nc.astype(float), na.astype(float)
        value = (na * config.risk + nc * (1 - config.risk)) / np.maximum(den, 1)
        value[(den == 0) | (nc < config.min_numerator) | (value < config.min_strength)] = 0.0
        return value

    strip = max(1, SCORES // len(templates))
    for low in range(0, len(mine), strip):
        part = mine.slice(low, strip)
        rated, high = dense(column(part, "rated"), items), dense(column(part, "high"), items)
        shown = dense(column(part, "shown"), items) if with_shown else None
        selves = [(i, own[x]) for i, x in enumerate(column(part, "user").to_pylist()) if x in own]
        if best is None:
            nc, na = rated @ across, high @ across
            nc[[i for i, _ in selves], [j for _, j in selves]] = 0
            i, j = np.nonzero(nc)
            nc, na, den = nc[i, j], na[i, j], (shown @ across)[i, j] if with_shown else counted[j]
        else:
            scores = (rated * np.float32(1 - config.risk) + high * np.float32(config.risk)) @ weighed
            if with_shown:
                scores /= np.maximum(shown @ across, 1)
            scores[[i for i, _ in selves], [j for _, j in selves]] = 0
            least = np.partition(scores, -best, axis=1)[:, -best] if best < len(templates) else np.zeros(len(scores), np.float32)
            i, j = np.nonzero((scores >= least[:, None] * (1 - SLACK)) & (scores > 0))
            found = []
            for a in range(0, len(i), step := max(1, SCORES // items)):
                x, y = i[a : a + step], j[a : a + step]
                found.append([np.einsum("ij,ij->i", side[x], given[y]) if side is not None else counted[y] for side in (rated, high, shown)])
            nc, na, den = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0),) * 3
        value = exact(nc, na, den)
        if best is not None:
            i, j, nc, na, den, value = (x[value > 0] for x in (i, j, nc, na, den, value))
            by = np.lexsort((j, -value, i))
            by = by[np.arange(len(by)) - np.searchsorted(i[by], i[by]) < best]
            i, j, nc, na, den, value = (x[by] for x in (i, j, nc, na, den, value))
        take = lambda side, at: side.take(pa.array(at))
        whole = lambda x: pa.array(x.astype(np.int64))
        columns = {"user": take(column(part, "user"), i), "template_user": take(templates, j), "nc": whole(nc), "na": whole(na), "denominator": whole(den), "strength": pa.array(value)}
        yield pa.RecordBatch.from_pydict(columns)


def in_blocks(rows: DataFrame, roles: Roles, config: EngineConfig, items: list[str], impressions: DataFrame | None, targets: DataFrame | None, best: int | None) -> DataFrame:
    """Strengths of users by blocks: a task takes targets and templates as lists of numbers of items, and has all of a pair.

    So pairs aren't shuffled: a block of up to 131,072 templates is sent to each block of targets, as one short row a user. The
    numbers in a task are bounded whatever the number of users; the number of blocks follows that.
    """
    spark = rows.sparkSession
    codes = F.broadcast(spark.createDataFrame([(x, k) for k, x in enumerate(items)], "product string, _code int"))  # at most ITEMS rows
    lists = lambda df, **columns: df.join(codes, "product").groupBy("user").agg(*[F.collect_list(c).alias(name) for name, c in columns.items()])
    left = rows.where(F.col("rating") >= roles.target_rating)
    if impressions is not None:
        shown = impressions.select(F.col("u_id").alias("user"), F.col("p_id").alias("product")).distinct()
        left = left.join(shown, ["user", "product"], "left_semi")
    if targets is not None:
        left = left.join(targets.select("user").distinct(), "user", "left_semi")
    left = lists(left, rated=F.col("_code"), high=F.when(F.col("rating") >= config.min_rating_aggressive, F.col("_code")))
    empty = F.array().cast("array<int>")
    left = left.join(lists(shown, shown=F.col("_code")), "user", "left").withColumn("shown", F.coalesce("shown", empty)) if impressions is not None else left.withColumn("shown", empty)
    right = lists(rows.where(F.col("rating") >= roles.template_rating), rated=F.col("_code")).withColumns({"high": empty, "shown": empty})
    left, right = (sinks.materialized(side.select("user", "rated", "high", "shown")) for side in (left, right))
    n, parts = left.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(1, min(TEMPLATES, NUMBERS // max(1, len(items))))
    across, down = max(1, -(-right.count() // size)), max(1, -(-n // TARGETS), min(parts, BLOCKS, -(-n // 256)))
    dealt_to = lambda k: F.pmod(F.xxhash64("user"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = left.withColumn("_target", dealt_to(down)).withColumn("_template", every(across)).withColumn("_role", F.lit(0))
    right = right.withColumn("_template", dealt_to(across)).withColumn("_target", every(down)).withColumn("_role", F.lit(1))
    with_shown = impressions is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from block_strengths(pa.Table.from_batches(list(batches)), len(items), config, with_shown, best)

    keys = ["_target", "_template"]
    both = left.unionByName(right).repartition(4 * max(parts, min(across * down, BLOCKS)), *keys)  # blocks are few and each is much work
    return both.groupBy(*keys).applyInArrow(run, "user string, template_user string, nc long, na long, denominator long, strength double")


def few_items(rows: DataFrame, roles: Roles) -> list[str] | None:
    """The shared items, where there are at most ITEMS."""
    found = [r[0] for r in rows.select(roles.shared).where(F.col(roles.shared).isNotNull()).distinct().limit(ITEMS + 1).collect()]
    return sorted(found) if len(found) <= ITEMS else None


def strengths(summary: DataFrame, roles: Roles, config: EngineConfig, impressions: DataFrame | None = None, targets: DataFrame | None = None, window: int | None = None, best: int | None = None) -> DataFrame:
    """Numerators, denominator and strength of each pair.

    best: of a target, no more than those among its so many strongest above 0 are needed, ties to the smaller id; there may be others.
    """
    rows = rated(summary, config, window)
    items = few_items(rows, roles) if roles.entity == "user" else None
    if items is not None:
        return in_blocks(rows, roles, config, items, impressions, targets, best)
    pairs = numerators(rows, roles, config, impressions, targets)
    users = roles.entity == "user"
    counted = rows.where(F.col("rating") >= (roles.template_rating if users else roles.target_rating))
    whose = roles.template if users else roles.entity
    counted = counted.select(F.col(roles.entity).alias(whose), roles.shared)
    if impressions is None:
        per = counted.groupBy(whose).agg(F.count(F.lit(1)).alias("denominator"))
        pairs = pairs.join(per, whose, "left")
    else:
        # Items of the one side that the target was shown: users of a base product who saw it, or products of a template that the target saw.
        shown = impressions.select(F.col("u_id").alias("user"), F.col("p_id").alias("product")).distinct()
        if users:
            seen = shown.select(F.col("user"), "product").join(counted, "product").groupBy("user", roles.template).agg(F.count(F.lit(1)).alias("denominator"))
            pairs = pairs.join(seen, ["user", roles.template], "left")
        else:
            seen = counted.join(shown, ["user", "product"], "left_semi").groupBy(whose).agg(F.count(F.lit(1)).alias("denominator"))
            pairs = pairs.join(seen, whose, "left")
    pairs = pairs.withColumn("denominator", F.coalesce("denominator", F.lit(0)).cast("long"))
    return pairs.select(roles.entity, roles.template, "nc", "na", "denominator", strength(F.col("nc"), F.col("na"), F.col("denominator"), config).alias("strength"))


def affected_targets(changed: DataFrame, summary: DataFrame, roles: Roles) -> DataFrame:
    """Entities whose strengths can change when the (user, product) pairs of `changed` do: all that share an item with
    a changed entity, now or through the changed pairs, and the changed entities themselves."""
    entities = changed.select(roles.entity).distinct()
    items = summary.join(entities, roles.entity, "left_semi").select(roles.shared).unionByName(changed.select(roles.shared)).distinct()
    near = summary.join(items, roles.shared, "left_semi").select(roles.entity)
    return near.unionByName(entities).distinct()


def consolidation_needed(old_templates: DataFrame, new: DataFrame, old: DataFrame, roles: Roles, k: int) -> DataFrame:
    """Targets whose list of templates may change, from their strengths before and now.

    Of the strengths that changed, one matters if it is at least the weakest of the list, if its template is in the list, or if the
    list isn't full; one that is gone matters if its template is in the list.
    """
    entity, template = roles.entity, roles.template
    value = lambda df, name: df.where(F.col("strength") > 0).select(entity, template, F.col("strength").alias(name))
    both = value(new, "_new").join(value(old, "_old"), [entity, template], "full").where(~F.col("_new").eqNullSafe(F.col("_old")))
    lists = old_templates.select(F.col("id").alias(entity), "templates", F.size("templates").alias("_n"), F.array_min(F.transform("templates", lambda t: t["strength"])).alias("_weakest"))
    rows = both.join(lists, entity, "left")
    listed = F.coalesce(F.exists("templates", lambda t: t["id"] == F.col(template)), F.lit(False))
    enters = F.col("_new").isNotNull() & ((F.coalesce(F.col("_n"), F.lit(0)) < k) | (F.col("_new") >= F.col("_weakest")))
    return rows.where(listed | enters).select(entity).distinct()
