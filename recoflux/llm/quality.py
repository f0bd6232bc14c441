"""Quality classifier: supervised subword embeddings trained by numpy stochastic gradient descent."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflux.llm.common import RADIX, SPACES, Words, byte_slabs, hold_out, ids_and_texts, map_arrow, mix

#: Rows of the embedding table; features share them by hash.
BITS = 17
#: Labelled texts that a model is fitted on at most, evenly by hash of their id, whatever their length.
SAMPLE = 4000
#: Words and characters of an n-gram.
WORD_GRAMS, CHARACTER_GRAMS = (1, 2), (2, 3, 4)
#: Words of an n-gram that also counts by its form alone: words as numbers in order of first use, so that "no no yes" is 1 1 2.
FORM = 3
#: Zero vectors in each mean, so that a few features alone hardly move a short text from the prior.
NEUTRAL = 10


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, codes): where each character begins, and its bytes as one number."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    sizes = np.diff(np.concatenate([starts, [len(data)]]))
    codes = data[starts].astype(np.uint64)
    for k in range(1, 4):
        more = np.flatnonzero(sizes > k)
        codes[more] |= data[starts[more] + k].astype(np.uint64) << np.uint64(8 * k)
    return starts, codes


def grams(symbols: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive symbols."""
    m = len(symbols) - n + 1
    code = np.full(m, n, np.uint64)
    for k in range(n):
        code = mix(code * np.uint64(RADIX) + symbols[k : k + m])
    return code


def features(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, table rows) of n-grams of words, and of characters within words, of a slab, kind by kind.

    Word n-grams of FORM words come without the words themselves: how words repeat is the same for all words, which
    n-grams of given words can't learn for words that they haven't seen.
    """
    shift = np.uint64(64 - BITS)
    words = Words(data, bounds)
    at, codes = characters(data)
    spaces = np.zeros(len(at) + 1, np.int64)
    np.cumsum(SPACES[data[at]], out=spaces[1:])
    for positions, symbols, sizes, blank in ((words.starts, words.hashes(), WORD_GRAMS, None), (at, codes, CHARACTER_GRAMS, spaces)):
        text = np.searchsorted(bounds, positions, "right")
        for n in sizes:
            m = len(symbols) - n + 1
            if m < 1:
                continue
            inside = text[n - 1 :] == text[:m]
            if blank is not None:
                inside &= blank[n : n + m] == blank[:m]
            inside = np.flatnonzero(inside)
            yield positions[inside], (grams(symbols, n)[inside] >> shift).astype(np.int64)
    text, m = np.searchsorted(bounds, words.starts, "right"), len(words.starts) - FORM + 1
    if m > 0:
        inside = np.flatnonzero(text[FORM - 1 :] == text[:m])
        hashes, form = words.hashes(), np.zeros(m, np.uint64)
        for i in range(1, FORM):
            for j in range(i):
                form = form * np.uint64(2) + (hashes[i : i + m] == hashes[j : j + m])
        yield words.starts[inside], (mix(form[inside] + np.uint64(1 << 60)) >> shift).astype(np.int64)


@dataclass(frozen=True)
class QualityModel:
    """Per table row, its vector's part in the difference of the two outputs; and the outputs' own difference.

    A document's vector is the mean of its features' vectors (and of NEUTRAL zeros) and the outputs are linear in it,
    so the mean of these numbers gives the softmax of the two classes.
    """

    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(bounds) - 1), np.zeros(len(bounds) - 1)
        if len(data):
            for positions, rows in features(data, bounds):
                sums = np.zeros(len(rows) + 1)
                np.cumsum(self.weights[rows], dtype=np.float64, out=sums[1:])
                at = np.searchsorted(positions, bounds)
                total += sums[at[1:]] - sums[at[:-1]]
                count += np.diff(at)
        return 1 / (1 + np.exp(-(total / (count + NEUTRAL) + self.bias)))


def shares(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's table rows and the share of each in its mean: at most 2**BITS numbers, however long the text."""
    found = [rows for _, rows in features(data, np.array([0, len(data)]))] if len(data) else []
    ids, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0))
    return ids.astype(np.int32), (n / (n.sum() + NEUTRAL)).astype(np.float32)


class Examples:
    """Labelled texts as shares(), in a temporary file (at most 8 << BITS bytes each), so that one at a time is in memory."""

    def __init__(self):
        self.file = tempfile.TemporaryFile(buffering=0)
        self.end = 0
        self.found: list[tuple] = []  # (order, offset, table rows, label)

    def add(self, order: tuple, ids: bytes, n: bytes, label: int) -> None:
        self.file.write(bytes(ids) + bytes(n))
        self.found.append((order, self.end, len(ids) // 4, label))
        self.end += len(ids) + len(n)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        _, at, n, _ = self.found[k]
        data = os.pread(self.file.fileno(), 8 * n, at)
        return np.frombuffer(data, np.int32, n), np.frombuffer(data, np.float32, n, 4 * n)


def train(docs: Examples, dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 11) -> QualityModel:
    """Fit the n-grams' vectors and a softmax layer, one document a step, with a falling rate.

    Without labels of both kinds the model returns the share of label 1 (0.5 without any).
    """
    y = np.array([x[-1] for x in docs.found], np.int64)
    share = float(y.mean()) if len(y) else 0.5
    prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros(1 << BITS, np.float32), prior)
    random = np.random.default_rng(seed)
    table = random.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.array([0, prior], np.float32)
    step, steps = 0, epochs * len(y)
    for _ in range(epochs):
        for k in random.permutation(len(y)):
            ids, n = docs[k]
            vector = n @ table[ids]
            z = out @ vector + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            p *= rate * (1 - step / steps)
            step += 1
            back = p @ out
            out -= np.outer(p, vector)
            bias -= 0.1 * p
            table[ids] -= n[:, None] * (back * min(len(ids), 100))
    return QualityModel((table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """At most sample labelled texts (doc_id, h, quality, text) whose id isn't held out, the first by hash of the id.

    They are chosen among the labelled rows that have a document, by ids and hashes of texts; then only their texts move.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & ~hold_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = ids_and_texts(docs).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).withColumn("h", F.xxhash64("text"))
    chosen = texts.select("doc_id", "h").join(known, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(sample).collect()
    chosen = spark.createDataFrame(chosen, "doc_id long, h long, quality int")
    return texts.join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("doc_id", "h", "quality", F.xxhash64("doc_id").alias("place"), "text")


def examples(rows: DataFrame) -> Examples:
    """training_rows() counted where their texts are; they come to the driver by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(4).to_pylist()):
                ids, n = shares(np.frombuffer(text.encode(), np.uint8))
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(k, 1) for j in range(4)), pa.array([ids.tobytes()]), pa.array([n.tobytes()])], names=["doc_id", "h", "quality", "place", "ids", "n"])

    out = Examples()
    for r in map_arrow(rows, run, "doc_id long, h long, quality int, place long, ids binary, n binary").toLocalIterator():
        out.add((r.place, r.doc_id, r.h), r.ids, r.n, r.quality)
    out.found.sort()
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    return train(examples(training_rows(docs, labels, sample)))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """key and score (0 to 1) for each row (key, text) of docs, where it is read; a null text is scored as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.scores(data, bounds) for _, data, bounds in byte_slabs(batch)]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found))], names=["key", "score"])

    return docs.select("key", "text").transform(map_arrow, run, f"key {docs.schema['key'].dataType.simpleString()}, score double")


def op3_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of each document, from its whole text whatever its length.

    A null or empty text has no features and gets the prior; repeated rows are scored each, and alike; equal
    scores need no order; an empty table gives an empty table. Without labels every score is 0.5.
    """
    model = fit_quality(docs, labels)
    rows = score_quality(ids_and_texts(docs).withColumnRenamed("doc_id", "key"), model)
    return rows.select(F.col("key").alias("doc_id"), hold_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least `least`.

    Rows pass through the step that scores them, so nothing is joined or sent twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            row = 0
            for ids, data, bounds in byte_slabs(pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column(at)], names=["id", "text"])):
                yield batch.slice(row, len(ids)).filter(pa.array(model.scores(data, bounds) >= least))
                row += len(ids)

    return docs.transform(map_arrow, run, docs.schema)
