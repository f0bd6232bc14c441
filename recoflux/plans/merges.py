"""Hybrid merges of ranked lists: all users in one plan, from rows (user, algorithm, rank, product, score)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recoflux.operators.ranking import dealt, dealt_anew

#: Items between bonuses, ranks over which a vote halves, the least value of a first vote.
BONUS_PERIOD = 8
VOTE_HALFLIFE = 4.0
LEAST_VOTE = 1000
#: Votes are rounded before they are ranked, so that ranks don't depend on the order of sums.
VOTE_DIGITS = 9
#: What a merge takes: the number of the algorithm and the place in its list, from 0.
TAKEN = "array<struct<algorithm:int,place:int>>"

Weights = list[tuple[str, float, bool]]


def chunk_sizes(weights: Weights) -> dict[str, int]:
    """Items per round: the weights in hundredths over their greatest common divisor."""
    parts = {a: round(100 * w) for a, w, _ in weights}
    whole = reduce(math.gcd, parts.values())
    return {a: p // whole if whole else 0 for a, p in parts.items()}


def side_by_side(lists: DataFrame, weights: Weights) -> DataFrame:
    """One row per user with `lists`: the array of its lists, best first, by the order of weights. A list's length is bounded by its ranks."""
    item = F.struct(F.col("rank").cast("int").alias("rank"), "product", "score")
    columns = [F.sort_array(F.collect_list(F.when(F.col("algorithm") == a, item))).alias(f"_{k}") for k, (a, *_) in enumerate(weights)]
    return lists.groupBy("user").agg(*columns).select("user", F.array(*[f"_{k}" for k in range(len(weights))]).alias("lists"))


def chunks(user: str, lists: list[list[str]], weights: Weights, n: int, seed: int) -> Iterator[tuple[int, int]]:
    """Rounds in which each algorithm gives its share of items that aren't in yet, until there are n: (algorithm, place in its list).

    A round in which nobody gives anything is the last.
    """
    sizes, taken, at, given = list(chunk_sizes(weights).values()), set(), [0] * len(lists), 1
    while given and len(taken) < n:
        given = 0
        for a, items in enumerate(lists):
            left = sizes[a] if len(taken) < n else 0
            while left and at[a] < len(items):
                x, at[a] = items[at[a]], at[a] + 1
                if x not in taken:
                    taken.add(x)
                    yield a, at[a] - 1
                    left, given = left - 1, 1


def drawn(user: str, lists: list[list[str]], weights: Weights, n: int, seed: int) -> Iterator[tuple[int, int]]:
    """Item by item, each the next new one of an algorithm drawn by weight among those that have one: (algorithm, place in its list).

    Dice are hashes of seed, user and draw, so a repeated task draws the same.
    """
    taken, at = set(), [0] * len(lists)
    for k in range(1, n + 1):
        for a, items in enumerate(lists):
            while at[a] < len(items) and items[at[a]] in taken:
                at[a] += 1
        sums = list(accumulate((w if at[a] < len(lists[a]) else 0.0 for a, (_, w, _) in enumerate(weights)), initial=0.0))
        roll = int(hashlib.md5("/".join(str(x) for x in (seed, user, k) if x is not None).encode()).hexdigest()[:8], 16) / 2.0**32 * sums[-1]
        a = next((a for a, x in enumerate(sums[1:]) if x > roll), None)
        if a is None:
            return
        taken.add(lists[a][at[a]])
        yield a, at[a]
        at[a] += 1


def taken(user: Column, lists: Column, by: Callable, weights: Weights, n: int, seed: int) -> Column:
    """What chunks() or drawn() take of each user's lists, in a loop over the user's items: no more than those of its lists."""

    def run(users: pd.Series, products: pd.Series) -> pd.Series:
        return pd.Series([[{"algorithm": a, "place": k} for a, k in by(u, [[] if x is None else list(x) for x in items], weights, n, seed)] for u, items in zip(users, products)])

    return F.pandas_udf(run, TAKEN)(user, F.transform(lists, lambda items: F.transform(items, lambda x: x["product"])))


def votes(lists: DataFrame, weights: Weights, n: int) -> DataFrame:
    """(user, product, votes): over algorithms, weight times a vote that halves every four ranks, of the first n items."""
    weight = reduce(lambda c, w: c.when(F.col("algorithm") == w[0], F.lit(float(w[1]))), weights, F.when(F.lit(False), F.lit(0.0)))
    vote = weight * max(LEAST_VOTE, n) * F.pow(F.lit(2.0), -(F.col("rank") - 1) / VOTE_HALFLIFE)
    return lists.where((F.col("rank") <= n) & weight.isNotNull()).groupBy("user", "product").agg(F.round(F.sum(vote), VOTE_DIGITS).alias("votes"))


def voted(lists: DataFrame, weights: Weights, n: int) -> DataFrame:
    """By votes; before every eighth item each algorithm that takes bonuses puts in its next one. (user, place, product, score, tags)

    A product comes where it first would. An item's tag is how many items were still to come when it was put in.
    """
    order = Window.partitionBy("user").orderBy(F.desc("votes"), F.desc("product"))
    ranked = votes(lists, weights, n).withColumn("k", F.row_number().over(order) - 1).where(F.col("k") < n)
    ranked = ranked.select("user", "product", "k", F.lit(1).alias("part"), F.lit(0).alias("of"), F.array("votes").alias("score"))
    number = reduce(lambda c, x: c.when(F.col("algorithm") == x[1], F.lit(x[0])), [(k, a) for k, (a, _, takes) in enumerate(weights) if takes], F.when(F.lit(False), F.lit(0)))
    bonus = lists.where(number.isNotNull()).select("user", "product", (BONUS_PERIOD * (F.col("rank") - 1)).cast("int").alias("k"), F.lit(0).alias("part"), number.alias("of"), "score")
    rows = ranked.unionByName(bonus)
    total = F.coalesce(F.max(F.when(F.col("part") == 1, F.col("k"))).over(Window.partitionBy("user")) + 1, F.lit(0))
    rows = rows.withColumn("total", total).where(F.col("k") < F.col("total"))
    first = F.row_number().over(Window.partitionBy("user", "product").orderBy("k", "part", "of"))
    rows = rows.withColumn("first", first).where("first = 1")
    place = F.row_number().over(Window.partitionBy("user").orderBy("k", "part", "of"))
    return rows.select("user", place.alias("place"), "product", "score", F.array((F.col("total") - place + 1).cast("string")).alias("tags"))


def filled(merged: DataFrame, lists: DataFrame, algorithm: str | None, n: int) -> DataFrame:
    """The first n of merged, and up to n the fill-in algorithm's items that aren't in it. (user, rank, product, score, tags)"""
    rows = merged.withColumn("part", F.lit(0))
    if algorithm:
        more = lists.where(F.col("algorithm") == algorithm)
        rows = dealt_anew(rows.unionByName(more.select("user", F.col("rank").cast("int").alias("place"), "product", "score", F.array(F.lit(algorithm)).alias("tags"), F.lit(1).alias("part"))), "user")
    first = F.row_number().over(Window.partitionBy("user", "product").orderBy("part", "place"))
    rank = F.row_number().over(Window.partitionBy("user").orderBy("part", "place"))
    rows = rows.withColumn("first", first).where("first = 1").withColumn("rank", rank).where(F.col("rank") <= n)
    return rows.select("user", F.col("rank").cast("int").alias("rank"), "product", "score", "tags")


def merge(lists: DataFrame, name: str, weights: Weights, n: int, seed: int) -> DataFrame:
    """(user, place, product, score, tags) of a hybrid by name."""
    if name == "HRVoting":
        return voted(lists, weights, n)
    if name not in ("HRChunks", "HRRandom"):
        raise KeyError(f"unknown hybrid {name}")
    rows = side_by_side(dealt(lists, "user"), weights)  # a user's merge is much work for its size
    by = chunks if name == "HRChunks" else drawn
    rows = rows.select("user", "lists", F.posexplode(taken(F.col("user"), F.col("lists"), by, weights, n, seed)).alias("place", "x"))
    rows = rows.withColumn("item", F.get(F.get("lists", F.col("x.algorithm")), F.col("x.place")))
    names = F.array(*[F.lit(a) for a, *_ in weights])
    return rows.select("user", (F.col("place") + 1).alias("place"), F.col("item.product").alias("product"), F.col("item.score").alias("score"), F.array(F.get(names, F.col("x.algorithm"))).alias("tags"))
