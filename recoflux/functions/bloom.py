"""Bloom filters: a set in a fixed number of bits, without false negatives."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_count(n_bits: int, n_elements: int) -> int:
    return max(1, round(math.log(2) * n_bits / max(1, n_elements)))


def false_positive_share(n_bits: int, n_elements: int, domain: int) -> float:
    """The expected share of a domain that is taken for elements by mistake."""
    k = hash_count(n_bits, n_elements)
    return (1 - (1 - 1 / n_bits) ** (n_elements * k)) ** k * (domain - n_elements) / domain


def places(element: Column, n_bits: int, k: int) -> Column:
    """The k bits of an element: double hashing of its text."""
    text = element.cast("string")
    one, two = (F.pmod(h, F.lit(n_bits)) for h in (F.xxhash64(text), F.xxhash64(text, F.lit(1))))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(one + i * two, F.lit(n_bits)))


class BloomFilter:
    """Built by one aggregation into words of 62 bits; n_bits bounds what comes to the driver and is broadcast."""

    WORD = 62
    LIMIT = 1 << 27

    def __init__(self, elements: DataFrame, column: str, n_bits: int, n_elements: int | None = None):
        if not 0 < n_bits <= self.LIMIT:
            raise ValueError(f"a filter has 1 to {self.LIMIT} bits")
        self.n_bits = n_bits
        self.n_elements = elements.select(column).distinct().count() if n_elements is None else n_elements
        self.k = hash_count(n_bits, self.n_elements)
        bits = elements.select(F.explode(places(F.col(column), n_bits, self.k)).alias("bit"))
        word = bits.select((F.col("bit") / self.WORD).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast(bit % {self.WORD} as int))").alias("mask"))
        self.words = word.groupBy("word").agg(F.bit_or("mask").alias("mask"))

    def accepts(self, df: DataFrame, column: str) -> DataFrame:
        """df with `accepted`: false only if the value is no element. The words are sent as one array."""
        packed = self.words.agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("_bloom"))
        rows = df.join(F.broadcast(packed))
        set_ = lambda bit: F.coalesce(F.col("_bloom")[(bit / self.WORD).cast("long")], F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % self.WORD).cast("int"))) != 0
        return rows.withColumn("accepted", F.forall(places(F.col(column), self.n_bits, self.k), set_)).drop("_bloom")
