"""Substring dedup: 50-word passages of earlier documents, located by sharded automata."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflux.llm.anchors import Context, Windows, earlier_windows, mask_of, numbered, texts_and_ranges, unpacked
from recoflux.llm.common import Rolling, Words, map_arrow, mix

WIDTH, GRAM = 50, 12
#: Phrases of an automaton at most; more phrases are more automata.
SHARD = 5_000


def as_words(data: np.ndarray, bounds: np.ndarray):
    words = Words(data, bounds)
    return words.hashes(), words.bounds, words.starts, words.ends


def settle(contexts: list[Context]) -> Iterator[tuple[int, int, int]]:
    """The windows of contexts whose words also occur in a document with a smaller id.

    Passages whose words, by their hash, are in two documents or more become phrases over word
    numbers. Sharded Aho-Corasick automata then run over every context and locate
    all occurrences of each phrase, word by word; those in later documents than its least are given.
    """
    import ahocorasick

    numbers: dict[bytes, int] = {}
    texts = [[numbers.setdefault(w, len(numbers)) for w in x.content.split(b" ")] for x in contexts]
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.array([w for x in texts for w in x], np.uint64)
    n = np.array([x.n for x in contexts], np.int64)
    of = np.repeat(np.arange(len(contexts)), n)
    at = starts[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    hashes = Rolling(mix(flat + np.uint64(1))).grams(WIDTH)[at]
    docs = np.array([x.doc for x in contexts], np.int64)
    by = np.lexsort((docs[of], hashes))
    h, doc = hashes[by], docs[of][by]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    last = np.concatenate([first[1:], [len(h)]]) - 1
    recurs = at[by][first[doc[first] < doc[last]]]
    words = flat.astype(np.int64).tolist()
    texts = [tuple(x) for x in texts]
    later = [np.zeros((2, 0), np.int64)]  # (context, offset) of occurrences in later documents
    for k in range(0, len(recurs), SHARD):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for number, j in enumerate(recurs[k : k + SHARD].tolist()):
            automaton.add_word(tuple(words[j : j + WIDTH]), number)
        automaton.make_automaton()
        located = array("q")
        for i, text in enumerate(texts):
            for end, phrase in automaton.iter(text):
                located.extend((phrase, i, end - WIDTH + 1))
        del automaton
        phrase, i, offset = np.frombuffer(located, np.int64).reshape(-1, 3).T if located else np.zeros((3, 0), np.int64)
        least = np.full(SHARD, np.iinfo(np.int64).max)
        np.minimum.at(least, phrase, docs[i])
        late = least[phrase] < docs[i]
        later.append(np.stack([i[late], offset[late]]))
    i, offset = np.unique(np.concatenate(later, axis=1), axis=1)
    if len(i):
        new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (offset[1:] != offset[:-1] + 1)]))
        last = np.concatenate([new[1:], [len(i)]]) - 1
        yield from zip(i[new].tolist(), offset[new].tolist(), offset[last].tolist())


PASSAGES = Windows(WIDTH, GRAM, as_words, own=False, settle=settle)


def words_left(text: bytes, ranges) -> tuple[list[bytes], np.ndarray]:
    words = text.split()  # bytes are split at \x20 and \x09-\x0D alone
    return words, mask_of(ranges, len(words))


def op8_substring_dedup(docs: DataFrame) -> DataFrame:
    """Words of each document that 50-word windows of documents with smaller ids cover, and what is left.

    A null or empty text has no words; a row without doc_id is left as it is and removes
    nothing; equal rows that repeat a doc_id count as one document, different ones as several, which remove
    nothing from each other (see numbered). Texts are taken whole, however long; equal windows of one document
    don't remove each other; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            n_words, n_removed, kept = [], [], []
            for text, ranges in zip(*(batch.column(k).to_pylist() for k in (1, 2))):
                words, mask = words_left(text, ranges)
                n_words.append(len(words))
                n_removed.append(int(mask.sum()))
                if n_removed[-1]:
                    words = [w for w, gone in zip(words, mask.tolist()) if not gone]
                kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = texts_and_ranges(numbered(docs), PASSAGES)
    return rows.transform(map_arrow, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_passages(docs: DataFrame) -> DataFrame:
    """docs without the passages of earlier documents; what is left of a text is its words, joined by one space.

    A text that loses nothing stays as it is, and a document that loses all its
    words goes. The columns are those of docs; n_chars, where there is one, is that of the new text.
    """

    @F.pandas_udf("string")
    def left(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        out = []
        for text, r in zip(texts, ranges):
            words, mask = words_left((text or "").encode(), r)
            out.append(b" ".join([w for w, gone in zip(words, mask.tolist()) if not gone]).decode())
        return pd.Series(out, dtype=object)

    marked = numbered(docs, carry=True)
    rows = marked.join(earlier_windows(marked, PASSAGES).hint("merge"), ["doc_id", "row"], "left")
    changed = F.col("ranges").isNotNull()
    rows = rows.withColumn("changed", changed).withColumn("left", F.when(changed, left("text", "ranges")).otherwise(F.col("text")))
    rows = rows.where(~F.col("changed") | (F.col("left") != ""))
    own = lambda c: F.col("_all")[c]
    new = {"text": F.when(~F.col("_null"), F.col("left")), "n_chars": F.when(F.col("changed"), F.length("left").cast("long")).otherwise(own("n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return rows.select(*[new[c].alias(c) if c in new else own(c).alias(c) for c in docs.columns])


#: The contract over all tables, as SQL: every window is a row.
SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, k, hash(array_to_string(w[k : k + 49], ' ')) AS g, md5(array_to_string(w[k : k + 49], ' ')) AS m
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM docs WHERE len(w) >= 50)
), firsts AS (SELECT g, m, min(doc_id) AS first_doc FROM windows GROUP BY g, m),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM windows JOIN firsts USING (g, m) WHERE first_doc < doc_id
), positions AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM positions ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""
