"""Exact top-k search: term-at-a-time accumulation of every candidate's score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recoflux.llm.common import cut, map_arrow

#: Queries of a block at most, and their components; a block is broadcast (at most COMPONENTS * 8 bytes), more queries are more blocks.
QUERIES, COMPONENTS = 32_768, 4_000_000
#: Scores of a dense array at most; candidates are taken in runs that keep to it.
SCORES = 2_000_000


def weights(vectors: pa.ListArray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rows): which vectors take part, and floor(scale * x) of each as a dense row.

    Null vectors and those that hold a null or a non-finite component take no part. Shorter rows end in zeros.
    """
    n = len(vectors)
    sizes = np.zeros(n, np.int64)
    there = np.asarray(vectors.is_valid())
    flat = vectors.flatten().cast(pa.float64())
    sizes[there] = np.asarray(vectors.value_lengths().drop_null())
    values = np.array(flat.to_numpy(zero_copy_only=False), np.float64)  # nulls become nan
    ends = np.cumsum(sizes)
    bad = np.zeros(len(values) + 1, np.int64)
    np.cumsum(~np.isfinite(values), out=bad[1:])
    ok = there & (bad[ends] == bad[ends - sizes])
    rows = np.zeros((n, int(sizes.max(initial=0))))
    rows[np.repeat(np.arange(n), sizes), np.arange(len(values)) - np.repeat(ends - sizes, sizes)] = values
    at = np.flatnonzero(ok)
    return at, np.floor(scale * rows[at])


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf)  # a candidate below this is none of the k best

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Partition selection of a dense score array, then a merge. All candidates tied with the k-th stay in until ids decide."""
        m = min(self.k, scores.shape[1])
        bar = np.maximum(np.partition(scores, scores.shape[1] - m, axis=1)[:, scores.shape[1] - m], self.least)
        query, at = np.nonzero((scores >= bar[:, None]) & (scores > -np.inf))
        query, score, own = np.concatenate([self.query, query]), np.concatenate([self.score, scores[query, at]]), np.concatenate([self.id, ids[at]])
        by = np.lexsort((own, -score, query))
        query, score, own = query[by], score[by], own[by]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        self.query, self.score, self.id = query[keep], score[keep], own[keep]
        last = np.flatnonzero(np.arange(len(query))[keep] - first[keep] == self.k - 1)
        self.least[self.query[last]] = self.score[last]


def postings(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term, the rows that have it and its weight in each."""
    terms, at = np.nonzero(rows.T)
    weight = rows[at, terms]
    bounds = np.searchsorted(terms, np.arange(rows.shape[1] + 1)).tolist()
    return [(at[a:b], weight[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def accumulate(queries: list[tuple[np.ndarray, np.ndarray]], n: int, rows: np.ndarray) -> np.ndarray:
    """The scores of all rows for all n queries, term by term.

    Each query that has a term scatters its weight times the term's postings into its dense score array.
    """
    scores = np.zeros((n, len(rows)))
    for (asking, wanted), (posted, weight) in zip(queries, postings(rows)):
        if len(asking) and len(posted):
            scores[asking[:, None], posted] += np.outer(wanted, weight)
    return scores


def best_of_block(candidates: DataFrame, ids: np.ndarray, rows: np.ndarray, k: int, scale: float) -> DataFrame:
    """Each task's k best per query of a block, one row each; a task's output doesn't grow with its candidates."""
    shared = candidates.sparkSession.sparkContext.broadcast((ids, postings(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, queries = shared.value
        best = Best(len(own), k)
        by = np.argsort(own)
        step = max(64, SCORES // max(1, len(own)))
        for batch in batches:
            at, found = weights(batch.column(1), scale)
            names = np.asarray(batch.column(0))[at]
            for a in range(0, len(at), step):
                part = names[a : a + step]
                scores = accumulate(queries, len(own), found[a : a + step])
                left, right = np.searchsorted(own, part, "left", sorter=by), np.searchsorted(own, part, "right", sorter=by)
                for j in np.flatnonzero(right > left):  # a query is no candidate of its own
                    scores[by[left[j] : right[j]], j] = -np.inf
                best.add(scores, part)
        yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(best.id), pa.array(best.score.astype(np.int64))], names=["query", "vec_id", "score"])

    return candidates.transform(map_arrow, run, "query long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each query its k highest integer inner products.

    vectors and queries hold vec_id and embedding. Queries come to the driver a
    block at a time and each block meets every candidate where that is read;
    only each task's k best per query are shuffled. Beyond the first block, a
    block's results are written before the next is fetched. Rows without vec_id,
    null vectors and those with null or non-finite components take no part;
    candidates with a query's own vec_id are not its candidates; ties go to the
    smaller vec_id. Equal vectors of one vec_id are asked once, different ones are
    all asked and the k best are those of all of them; as candidates, repeats count each.
    Vectors of other lengths meet as if they ended in zeros; sums are exact below 2**53. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    array = F.col("embedding").cast("array<double>").alias("embedding")
    candidates = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), array)
    asked = queries.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), array)
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    asked = asked.where(sound).dropDuplicates(["vec_id", "embedding"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    result, block = None, []

    def searched() -> DataFrame:
        data = pa.array([r.embedding for r in block], pa.list_(pa.float64()))
        at, rows = weights(data, scale)
        ids = np.array([r.vec_id for r in block], np.int64)[at]
        best = best_of_block(candidates, ids, rows, k, scale)
        names = F.broadcast(spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "query long, query_id long"))
        best = best.join(names, "query").withColumn("rank", place).where(F.col("rank") <= k)
        return best.select("query_id", "rank", "vec_id", "score")

    components = 0
    for row in asked.toLocalIterator():
        block.append(row)
        components += len(row.embedding)
        if len(block) == QUERIES or components > COMPONENTS:
            part = cut(searched())
            result = part if result is None else result.unionByName(part)
            block, components = [], 0
    if block or result is None:
        part = searched()
        if result is None:
            return part
        result = result.unionByName(part)
    return result.withColumn("rank", place).where(F.col("rank") <= k)  # an id's vectors may be in several blocks


def op9_topk(vectors: DataFrame) -> DataFrame:
    """The five best of each vector whose id is divisible by 50; nulls, ties, repeats and empty tables as top_k() says."""
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
