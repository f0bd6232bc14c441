"""Benchmark decontamination: documents' token windows against a hash set of benchmark n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoflux.llm.common import ids_and_texts, map_arrow, mix

WINDOW = 13
#: Benchmark text bytes that one hash set may be made of; a worker holds one hash set at a time, and broadcasts are so bounded.
BLOCK_BYTES = 4 << 20
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
STEP = np.uint64(0xD1342543DE82EF95)


def words_of(text: str | None) -> list[bytes]:
    r"""The words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z."""
    return WORD.findall(text.encode().translate(LOWER)) if text else []


class Grams:
    """A hash set of items' distinct windows, made once and broadcast as arrays.

    For each length of windows: their hashes in order, where an example of each lies in the items'
    words (as numbers), and the items that have it, entry by entry (bounds, owners).
    """

    def __init__(self, items: list[tuple], window: int):
        self.names = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        words = [words_of(text) for _, text in items]
        ids = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found] for found in words]
        sizes = np.array([len(x) for x in ids], np.int64)
        first = np.cumsum(sizes) - sizes
        self.words = np.array([w for found in ids for w in found], np.int32)
        length = np.minimum(sizes, window)
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        for n in sorted(set(length[length > 0].tolist())):
            of = np.flatnonzero(length == n)
            count = sizes[of] - n + 1
            owner = np.repeat(of, count)
            start = np.repeat(first[of], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            _, place, which = np.unique(self.rows(start, n), axis=0, return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), owner]), axis=1)
            bounds = np.searchsorted(pairs[0], np.arange(len(place) + 1))
            hashes = self.hash(self.rows(start[place], n))
            by = np.argsort(hashes, kind="stable")
            self.tables[n] = hashes[by], start[place][by], bounds[:-1][by], bounds[1:][by], pairs[1]

    def rows(self, start: np.ndarray, n: int) -> np.ndarray:
        return self.words[start[:, None] + np.arange(n)]

    @staticmethod
    def hash(rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        for k in range(rows.shape[1]):
            out = out * STEP + mix(rows[:, k].astype(np.uint64) + np.uint64(1))
        return out

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words lie inside an occurrence of a window, and the names of the items whose windows occur."""
        get = self.vocabulary.get
        ids = np.fromiter([get(w, -1) for w in words], np.int32, len(words))
        hit, items = np.zeros(len(words) + 1, np.int64), set()
        known = np.zeros(len(words) + 1, np.int64)
        np.cumsum(ids >= 0, out=known[1:])
        for n, (hashes, place, low, high, owners) in self.tables.items():
            if n > len(words):
                continue
            starts = np.flatnonzero(known[n:] - known[:-n] == n)  # all of its words are words of items
            if not len(starts):
                continue
            rows = np.lib.stride_tricks.sliding_window_view(ids, n)[starts]
            h = self.hash(rows)
            a, b = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            at = np.repeat(np.arange(len(starts)), b - a)  # windows that share a hash are few: each is another window
            entry = np.repeat(a, b - a) + np.arange(len(at)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
            same = (rows[at] == self.rows(place[entry], n)).all(axis=1)  # the hit is verified word by word
            at, entry = starts[at[same]], entry[same]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + n, -1)
            for e in set(entry.tolist()):
                items.update(self.names[k] for k in owners[low[e] : high[e]].tolist())
        return np.cumsum(hit[:-1]) > 0, items


def item_blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple]]:
    """The items in blocks of at most limit text bytes, or one item; read one block at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        n = len((row.text or "").encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += n
    if block:
        yield block


def window_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, clean: bool = False) -> DataFrame:
    """docs, which hold a text, with _n_words, _n_hit, _hits (ranges of hit words, [from, to) pairs) and _items (ids as strings, sorted).

    Hash sets of the items' windows are broadcast and every document is scanned
    where it is read: no shuffle, and one pass over the documents. A hash set is of at most
    block_bytes of items' text; where items are more, there are more hash sets, of which a worker
    holds one at a time, and texts are cut into words again for each. Null or empty texts have no words; an item of none has no window; an item without id hits
    words like any other, but has no id to be counted or listed; repeated rows each get their result, repeated items are
    one; long texts are scanned whole; an empty benchmark hits nothing. With clean, hit words are also taken out of the text.
    """
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(Grams(block, window)) for block in item_blocks(benchmark, block_bytes)]
    at = docs.columns.index("text")
    made = docs.withColumns({"_n_words": F.lit(0).cast("long"), "_n_hit": F.lit(0).cast("long"), "_hits": F.array().cast("array<int>"), "_items": F.array().cast("array<string>")})

    names = made.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            masks: list = [None if blocks else np.zeros(len(words_of(t)), bool) for t in texts]
            items: list[set] = [set() for _ in texts]
            for block in blocks:
                grams = block.value
                for k, text in enumerate(texts):
                    mask, found = grams.hits(words_of(text))  # the words of one text are held at a time
                    masks[k] = mask if masks[k] is None else masks[k] | mask
                    items[k] |= found
                if len(blocks) > 1:
                    del grams, block._value  # the next hash set takes its place; the broadcast stays on disk
            edges = [np.flatnonzero(np.diff(np.concatenate([[False], m, [False]]).astype(np.int8))).tolist() for m in masks]
            columns = list(batch.columns)
            if clean:
                columns[at] = pa.array([without_hits(t, e) if e else t for t, e in zip(texts, edges)], columns[at].type)
            ids = [sorted({str(x) for x in found if x is not None}) for found in items]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(m) for m in masks], pa.int64()), pa.array([int(m.sum()) for m in masks], pa.int64()), pa.array(edges, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.string()))], names=names)

    return docs.transform(map_arrow, run, made.schema)


def contaminated() -> Column:
    """Any hit, and at least one word in twenty."""
    return (F.col("_n_hit") > 0) & (20 * F.col("_n_hit") >= F.col("_n_words"))


def without_hits(text: str, hits: list[int]) -> str:
    """text without the words in the ranges hits (over words_of) and what lies between them."""
    data = text.encode()
    at = [m.span() for m in WORD.finditer(data.translate(LOWER))]
    out, last = [], 0
    for a, b in zip(hits[::2], hits[1::2]):
        out.append(data[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, data[last:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without contaminated documents; from the other documents the words inside hits are taken out.

    The columns are those of docs; n_chars, where there is one, becomes that of the new text.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    rows = window_hits(docs, benchmark, window, clean=True).where(~contaminated())
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_n_hit") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def op2_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each document's hit words and items; nulls, empty and long texts, repeats and empty tables as window_hits() says."""
    rows = window_hits(ids_and_texts(docs), benchmark)
    return rows.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


#: The contract over all tables, as SQL: windows are joined as strings.
SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM item_words WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM grams),
windows AS (
  SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM doc_words, sizes WHERE len(w) >= n)
), found AS (SELECT doc_id, item_id, k, n FROM windows JOIN grams USING (n, gram)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, k, n, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM found)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
