"""Language ID: rank-order profiles of character n-grams and their out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recoflux.llm.common import hold_out, ids_and_texts, map_arrow

#: n-grams that a profile holds.
TOP = 400
#: Documents that profiles are learned from at most (about; chosen by hash, language by language).
SAMPLE = 20_000
#: Documents of one language that are learned from in any case, where there are as many: all of a rare one.
LEAST = 100
UNKNOWN = "und"
#: Stands for a run of non-letters; not 0, so that "a" and " a" have different codes.
BLANK = 1
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once in a process."""
    if not _letters:
        _letters.append(np.array([chr(k).isalpha() for k in range(0x110000)]))
    return _letters[0]


def gram_codes(text: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of the lower-cased text; each run of non-letters is one BLANK.

    A code holds the characters themselves, 21 bits each, so it is exact.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letters()[points], points, BLANK).astype(np.int64)
    if not (points != BLANK).any():
        return np.zeros(0, np.int64)
    points = np.concatenate([[BLANK], points, [BLANK]])
    points = points[np.concatenate([[True], (points[1:] != BLANK) | (points[:-1] != BLANK)])]
    two = points[:-1] << 21 | points[1:]
    three = two[:-1] << 21 | points[2:]
    return np.concatenate([points[points != BLANK], two, three])


def ranked(text: str, top: int = TOP) -> np.ndarray:
    """The text's most frequent n-grams, most frequent first, ties to the smaller code."""
    codes, counts = np.unique(gram_codes(text), return_counts=True)
    return codes[np.argsort(-counts, kind="stable")[:top]]


class Profiles:
    """For each language, n-grams and their ranks, side by side in one sorted table."""

    def __init__(self, ranks: dict[str, list[int]]):
        self.languages = sorted(ranks)
        self.codes = np.unique(np.array([c for v in ranks.values() for c in v], np.int64))
        self.ranks = np.full((len(self.codes) + 1, max(1, len(ranks))), -1, np.int64)
        for k, lang in enumerate(self.languages):
            self.ranks[np.searchsorted(self.codes, np.array(ranks[lang], np.int64)), k] = np.arange(len(ranks[lang]))

    def predict(self, text: str | None, top: int = TOP) -> tuple[str, float]:
        """The language at the least out-of-place distance, and how clearly: 1 less that distance's share of the largest.

        An n-gram that a profile lacks counts as out of place by the profile's
        size. Ties go to the first language by name.
        """
        own = ranked(text, top) if text else ()
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == own, at, len(self.codes))
        theirs = self.ranks[at]
        apart = np.where(theirs < 0, top, np.minimum(np.abs(theirs - np.arange(len(own))[:, None]), top)).sum(axis=0)
        best = int(apart.argmin())
        return self.languages[best], float(1 - apart[best] / (top * len(own)))


def quota(sizes: list[int], sample: int) -> int:
    """The most rows of one language, so that all languages together have about sample; at least LEAST."""
    left = sample
    for k, n in enumerate(sorted(sizes)):
        most = left // (len(sizes) - k)
        if n > most:
            return max(LEAST, most)
        left -= n
    return max([LEAST, *sizes])


def learn_profiles(docs: DataFrame, top: int = TOP, sample: int = SAMPLE) -> dict[str, list[int]]:
    """Ranked n-grams per language from about `sample` rows that have a language and a letter and aren't held out.

    Beyond that, each language gives up to the same number of rows (see quota), chosen by hash
    of id and text and one at least, so each has a profile. Counts are summed by
    task, then by n-gram, and only the top of each language comes to the driver.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("lang").isNotNull() & ~hold_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    known = known.withColumn("place", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).collect()
    if sum(r.n for r in sizes) > sample:
        most = quota([r.n for r in sizes], sample)
        below = [(r.lang, max(r.first + 1, int(min(1.0, most / r.n) * (1 << 30)))) for r in sizes]
        known = known.join(F.broadcast(docs.sparkSession.createDataFrame(below, "lang string, below long")), "lang").where(F.col("place") < F.col("below"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, codes: np.ndarray, counts: np.ndarray) -> None:
            if lang in sums:
                codes, counts = np.concatenate([sums[lang][0], codes]), np.concatenate([sums[lang][1], counts])
            found, where = np.unique(codes, return_inverse=True)
            sums[lang] = found, np.bincount(where, counts, len(found)).astype(np.int64)

        waiting: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                waiting.setdefault(lang, []).append(gram_codes(text or ""))
                if sum(map(len, waiting[lang])) > 2_000_000 or len(waiting[lang]) > 500:
                    codes = np.concatenate(waiting.pop(lang))
                    add(lang, codes, np.ones(len(codes), np.int64))
        for lang, parts in waiting.items():
            codes = np.concatenate(parts)
            add(lang, codes, np.ones(len(codes), np.int64))
        for lang, (codes, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"])

    counts = known.select("lang", "text").transform(map_arrow, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("place", place).where(F.col("place") <= top)
    out: dict[str, list] = {}
    for r in best.collect():
        out.setdefault(r.lang, []).append((r.place, r.gram))
    return {lang: [g for _, g in sorted(v)] for lang, v in out.items()}


def predict_language(docs: DataFrame, ranks: dict[str, list[int]], top: int = TOP) -> DataFrame:
    """doc_id, lang_pred and score for each row, from its whole text, where it is read."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(shared.value)
        for batch in batches:
            found = [profiles.predict(t, top) for t in batch.column(1).to_pylist()]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found]), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return ids_and_texts(docs).transform(map_arrow, run, "doc_id long, lang_pred string, score double")


def op6_language(docs: DataFrame) -> DataFrame:
    """The language of each document, from its whole text whatever its length.

    Null texts, empty ones and those without a letter are `und` with score 0. Repeated rows get a row each, and alike. n-grams
    that are equally frequent rank by their code, languages equally near by name. An empty table gives an empty
    table; where no row can be learned from, all are `und`.
    """
    rows = predict_language(docs, learn_profiles(docs))
    return rows.select("doc_id", hold_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
