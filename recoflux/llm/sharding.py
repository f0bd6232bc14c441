"""Sharding: a Feistel permutation of global row numbers, walked along its cycles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recoflux.llm.common import cut

#: Keys of a bucket, about, and the fewest buckets; a bucket is numbered in one task.
PER_BUCKET, BUCKETS = 1_000_000, 2048
#: Parts that equal rows are dealt into, so that no task numbers all rows of one key.
LANES = 256
ROUNDS = 6


def feistel(x: Column, a: int, b: int, seed: int) -> Column:
    """A keyed permutation of 0 .. a*b-1: six rounds that add a hash of one half to the other, in turn modulo a and b."""
    left, right = x % a, ((x - x % a) / a).cast("long")  # exact: x < 2**53
    for k in range(ROUNDS):
        if k % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed + k), right), F.lit(a)), F.lit(a))
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed + k), left), F.lit(b)), F.lit(b))
    return left + right * F.lit(a)


def permuted(x: Column, n: int, seed: int) -> Column:
    """The place of row x of n in the shuffle.

    The permutation works on a*b >= n numbers with a = ceil(sqrt(n)); a result of
    n or more is permuted again until it is below n. Such a walk passes through
    distinct numbers of n or more, of which there are a*b - n < a, so that many
    steps always suffice; one row in sqrt(n) walks at all.
    """
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    b = max(1, -(-n // a))
    first = feistel(x, a, b, seed)
    if a * b == n:
        return first
    steps = F.sequence(F.lit(1), F.least(F.lit(a * b - n), first))  # first is n or more where steps are taken; not a literal, so the plan stays small
    walk = F.aggregate(steps, first, lambda y, _: F.when(y < n, y).otherwise(feistel(y, a, b, seed)))
    return F.when(first < n, first).otherwise(walk)


def numbered(rows: DataFrame, key: list[str]) -> tuple[DataFrame, int]:
    """rows with a global row number `row` from 0, gapless, and how many rows there are.

    Numbers follow the hash bucket of the key columns and, within it, the order
    of the keys; so a row's number depends on the keys of all rows and not on
    files, partitions or cluster. Rows that are equal in all key columns have
    consecutive numbers, and only which of them has which is up to their
    position. They are counted before they are sent: a key repeated in many rows
    is one row for each lane, and no task numbers more than a lane of it or a bucket of keys.
    Rows are written to the shared folder once, so all passes see the same lanes.
    """
    rows = cut(rows.withColumn("_lane", F.pmod(F.monotonically_increasing_id(), F.lit(LANES)).cast("int")))
    n = rows.count()
    buckets = max(BUCKETS, n // PER_BUCKET)
    of_key = [*key, "_lane"]
    per = rows.groupBy(*of_key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    so_far = F.sum("_n").over(Window.partitionBy("_bucket").orderBy(*of_key).rowsBetween(Window.unboundedPreceding, -1))
    per = cut(per.withColumn("_before", F.coalesce(so_far, F.lit(0))))
    # One row a bucket: at most 2048 rows, or one for a million rows of input.
    first = F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = per.groupBy("_bucket").agg(F.sum("_n").alias("_size")).select("_bucket", F.coalesce(first, F.lit(0)).alias("_first"))
    per = per.join(F.broadcast(starts), "_bucket").select(*[F.col(c).alias(f"_k{j}") for j, c in enumerate(of_key)], (F.col("_first") + F.col("_before")).alias("_start"))
    rank = F.row_number().over(Window.partitionBy(*of_key).orderBy(F.lit(0))).cast("long") - 1
    ranked = rows.withColumn("_rank", rank)
    same = [F.col(c).eqNullSafe(F.col(f"_k{j}")) for j, c in enumerate(of_key)]
    ranked = ranked.join(per.hint("merge"), same).withColumn("row", F.col("_start") + F.col("_rank"))
    return ranked.drop("_lane", "_rank", "_start", *[f"_k{j}" for j in range(len(of_key))]), n


def shard_rows(rows: DataFrame, key: list[str], n_shards: int, seed: int = 7) -> DataFrame:
    """rows with `shard` (0 .. n_shards-1) and `slot` (place in the shard, gapless from 0).

    A row's place p in the shuffle gives shard p mod n_shards and slot
    p div n_shards; so shards' counts are at most one apart, and where a row lies can
    be computed from its number, seed and the count of rows. Rows must hold
    the key columns, by which they are numbered; nulls sort first, repeated rows
    take places of their own next to each other's numbers, an empty table gives an empty table.
    """
    rows, n = numbered(rows, key)
    p = permuted(F.col("row"), n, seed)
    rows = rows.withColumn("_place", p)
    return rows.withColumn("shard", (F.col("_place") % n_shards).cast("int")).withColumn("slot", ((F.col("_place") - F.col("_place") % n_shards) / n_shards).cast("long")).drop("_place")


def op1_sharding(docs: DataFrame, n_shards: int = 24, seed: int = 7) -> DataFrame:
    """All documents in shards of near equal counts (law `rows`).

    A null or empty text has size 8 and text_crc32 0, a long one its whole size; a null doc_id is a key
    like any other. Repeated rows each have a place; which of several equal rows has
    which is up to their position. An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = shard_rows(rows, ["doc_id", "text_crc32", "size"], n_shards, seed)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("row").alias("row_number"))
