"""Best-fit packing: documents into sequences by minimum bin slack over the histogram of lengths."""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recoflux.llm.common import cut, ids_and_texts, keep, map_arrow
from recoflux.llm.tokens import Recent, WordCutter, byte_letters, vocabulary

END = b"\0\0\0\0"


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    Words are cut by WordCutter; the library's model then gives a
    word's ids, which a bounded cache keeps.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.rules = WordCutter(path)
        library = Tokenizer.from_file(path)
        self.model = library.model
        self.ends = {m: library.token_to_id(m).to_bytes(4, "little") for m in self.rules.marks}
        self.bytes = [k.to_bytes(4, "little") for k in range(max(library.get_vocab().values()) + 1)]
        self.letters = dict(enumerate(byte_letters()))
        self.words = Recent(self.word)

    def word(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.bytes[t.id] for t in self.model.tokenize(letters)])

    def plain(self, text: str) -> bytes:
        return b"".join(self.words.of(self.rules.pieces_of(text)))

    def ids(self, text: str) -> bytes:
        if not any(m in text for m in self.rules.marks):
            return self.plain(text)
        between, special = map(self.plain, self.rules.special.split(text)), self.rules.special.findall(text)
        return b"".join([x for pair in zip(between, [*map(self.ends.get, special), b""]) for x in pair])


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return keep(Encoder, path)


def fullest(counts: Counter, capacity: int) -> tuple[int, ...]:
    """Lengths whose sum is as near capacity as can be, each used no more often than counted.

    Subset sums are bits of one integer: taking a length shifts the sums by
    it. Longer lengths come first, as often as they fit, and the search ends when
    capacity itself is reached. The largest sum is then traced back through
    the bits that each step had. The longest length is always in.
    """
    lengths = sorted((n for n, c in counts.items() if c > 0), reverse=True)
    first = lengths[0]
    mask = (1 << (capacity - first + 1)) - 1
    sums, steps = 1, []
    full = capacity - first
    for n in lengths:
        left = counts[n] - (n == first)
        for _ in range(min(left, full // n)):
            grown = (sums | sums << n) & mask
            if grown == sums:
                break
            steps.append((n, sums))
            sums = grown
            if sums >> full & 1:
                break
        if sums >> full & 1:
            break
    rest, taken = sums.bit_length() - 1, [first]
    for n, before in reversed(steps):
        if not before >> rest & 1:
            taken.append(n)
            rest -= n
    return tuple(taken)


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a sequence) and how many sequences have each.

    The fullest feasible combination is found for a bin around the longest length
    left, then removed as often as the counts allow, so a pattern uses up at
    least one length, and their number is bounded by that of lengths times
    its logarithm, whatever the number of pieces.
    """
    left, found = Counter({n: c for n, c in counts.items() if c > 0}), []
    while left:
        pattern = fullest(left, capacity)
        need = Counter(pattern)
        times = min(left[n] // c for n, c in need.items())
        found.append((pattern, times))
        for n, c in need.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
    return found


def layout(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first, last, sequence, offset): pieces of a length with rank first..last
    lie at offset in sequence + (rank - first)."""
    rows, ranks, sequence = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            rows.append((n, ranks[n], ranks[n] + times - 1, sequence, offset))
            ranks[n] += times
            offset += n
        sequence += times
    return rows


def pieces(docs: DataFrame, capacity: int, path: str | None) -> DataFrame:
    """Each document's ids and an end id 0, cut at capacity.

    lane is the task and nth the count of pieces of that length before it in the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lane, nth = encoder(vocabulary(path)).ids, TaskContext.get().partitionId(), Counter()
        size = 4 * capacity
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = ids(text or "") + END
                for k in range(0, len(found), size):
                    part = found[k : k + size]
                    n = len(part) // 4
                    out.append((doc, k // size, k // 4, n, zlib.crc32(part), lane, nth[n]))
                    nth[n] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "piece", "start", "length", "ids_crc32", "lane", "nth"])

    return ids_and_texts(docs).transform(map_arrow, run, "doc_id long, piece long, start long, length long, ids_crc32 long, lane long, nth long", (Encoder,))


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """Pieces of all documents with the sequence and offset where each lies.

    Pieces are written to the shared folder once. Only the histogram of lengths
    (at most capacity rows) comes to the driver, which packs lengths, not
    pieces. A piece gets its rank among those of its length from counts per
    task, then its place from the range of ranks that a pattern was given.
    A null or empty text is one piece of one id; repeated rows are packed each;
    an empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = cut(pieces(docs, capacity, path))
    per = rows.groupBy("length", "lane").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1))
    per = cut(per.withColumn("before", F.coalesce(before, F.lit(0))))
    counts = {r.length: r.n for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.createDataFrame(layout(minimum_bin_slack(counts, capacity)), "length long, first long, last long, sequence long, offset long")
    # Ranges of a length lie in an array sorted by first; at most one row per length, so the side has a bound.
    ranges = places.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "last", "sequence", "offset"))).alias("ranges"))
    rows = rows.join(per.select("length", "lane", "before").hint("merge"), ["length", "lane"])
    rows = rows.withColumn("rank", F.col("before") + F.col("nth")).join(F.broadcast(ranges), "length")
    place = F.filter("ranges", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") <= r["last"]))[0]
    rows = rows.withColumn("place", place)
    return rows.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", (F.col("place.sequence") + F.col("rank") - F.col("place.first")).alias("sequence_id"), F.col("place.offset").alias("offset"))


def op4_packing(docs: DataFrame) -> DataFrame:
    return pack(docs)
