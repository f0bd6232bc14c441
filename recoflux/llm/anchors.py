"""Windows that occur before: what substring dedup by bytes and by words have in common.

A window is W consecutive symbols (bytes or words) of one document. Its anchor is
the k-gram in it with the least hash, the leftmost of equals, so equal windows have
equal anchors, and consecutive windows mostly share one. Rows are made for anchors,
one for about (W - k) / 2 symbols, not for windows. The windows that share an anchor and the
symbols that they cover are a context.

1. Where it is read, a text gives a row per anchor: the gram's hash h and its windows. A
   gram that more than one document of a batch has recurs for certain; it meets other batches as one row.
2. Rows meet by h, and those of recurring grams are asked for: windows elsewhere can't recur.
3. Contexts asked for are cut out of their texts. Of contexts of a batch that agree byte for
   byte, the first goes on; the others occur before. (This is the sum before the shuffle: a text of many
   copies is sent once by each batch.)
4. Contexts meet by h in blocks of bounded size, where an exact method (suffix array,
   automata) finds the windows that occur before. A group larger than a block is taken
   in runs, least documents first; from run to run only contexts that hold the first of some window are kept.
5. If these are too many for one task, the group is split by a second, longer gram of each window, its
   parts meet again as in 4, and so on. At last the gram is the window, of which one is kept.

Hashes h only say who meets whom; which windows are equal is for the exact method to say.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recoflux.llm.common import ARROW_BYTES, Rolling, byte_slabs, cut, forget, map_arrow, mix

#: Bytes of contexts that a block takes, and that a group keeps from run to run before it is split.
BLOCK, GROUP = 1 << 19, 1 << 21
#: Windows of a context at most; a longer run of one gram (of a text that repeats itself) is several contexts.
RUN = 4096
#: Positions hold the number of the text among those of its doc_id above these bits; a text is shorter than 2**32 symbols.
PLACE = 32
INSIDE = (1 << PLACE) - 1


@dataclass(frozen=True)
class Windows:
    """What to look for: W, k, how a slab becomes symbols, and which earlier occurrence counts.

    split(data, bounds) gives (symbols, bounds in symbols, byte starts, byte ends of the symbols or None for bytes).
    own: an earlier start in the same document counts as well, not just a smaller doc_id.
    settle(contexts) yields for a block the windows that occur before, as (index of context, first, last offset).
    """

    width: int
    gram: int
    split: Callable
    own: bool
    settle: Callable


def anchor_ranges(symbols: np.ndarray, bounds: np.ndarray, width: int, gram: int, salt: int = 0) -> tuple[np.ndarray, ...]:
    """(lo, hi, h, several): for each anchor the first and last start of its windows, in slab positions, and its hash.

    Neighbours of one hash are one (several), up to RUN windows.
    """
    n = len(symbols)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none
    grams = Rolling(symbols).grams(gram)
    if salt:
        grams = mix(grams + np.uint64(salt))
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span, have = width - gram + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the anchor of the window that starts here
    starts, ends = bounds[:-1], bounds[1:]
    long = ends - starts >= width
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - width + 1, -1)
    valid = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    valid = valid[valid < len(at)]
    if not len(valid):
        return none, none, none, none
    own = grams[at[valid]]
    text = np.searchsorted(bounds, valid, "right")
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    first = np.flatnonzero((np.arange(len(valid)) - first) % RUN == 0)
    last = np.concatenate([first[1:], [len(valid)]]) - 1
    return valid[first], valid[last], own[first].view(np.int64), at[valid[first]] != at[valid[last]]


#: A row says: the gram h recurs (SURE), it may (MEET), or these n windows from `at` are asked for (ASK).
ROW = "h long, doc_id long, at long, n long, kind int"
SURE, MEET, ASK = range(3)


def row_batch(h, doc, at, n, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (h, doc, at, n)), pa.array(np.full(len(h), kind), pa.int32())], names=["h", "doc_id", "at", "n", "kind"])


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [start, end) of texts with those that touch or overlap made one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    row = start >> PLACE << PLACE
    start, end = start - row, end - row
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])])
    base = np.cumsum(new) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + base)
    first = np.flatnonzero(np.concatenate([[True], new[1:] | (start[1:] + base[1:] > reach[:-1])]))
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], start[first] + row[first], reach[last] - base[last] + row[first]


def extract(what: Windows) -> Callable:
    """Step 1: rows of each batch. Null texts are empty; texts without doc_id must not come here."""

    def slab(ids: list, data: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        symbols, at, _, _ = what.split(data, bounds)
        lo, hi, h, several = anchor_ranges(symbols, at, what.width, what.gram)
        # texts of no symbols share a bound; the last of them is the one that holds the position
        text = np.searchsorted(at, lo, "right") - 1
        return [h, np.array(ids, np.int64)[text], lo - at[text] + (rows[text] << PLACE), hi - lo + 1, several]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, k, parts = batch.column(2).to_numpy(), 0, []
            for ids, data, bounds in byte_slabs(batch):
                parts.append(slab(ids, data, bounds, rows[k : k + len(ids)]))
                k += len(ids)
            if not parts:
                continue
            h, doc, at, n, repeats = (np.concatenate(x) for x in zip(*parts))
            if not len(h):
                continue
            order = np.lexsort((at, doc, h))
            h, doc, at, n = h[order], doc[order], at[order], n[order]
            group, several = recurring_groups(h, doc, what.own)
            if what.own:
                several[group[repeats[order].astype(bool)]] = True
            asked = several[group]
            yield row_batch(h[~asked], doc[~asked], at[~asked], n[~asked], MEET)
            if asked.any():
                yield row_batch(h[asked], doc[asked], at[asked], n[asked], ASK)
                sure = h[np.searchsorted(group, np.flatnonzero(several))]
                yield row_batch(sure, sure * 0, sure * 0, sure * 0, SURE)

    return run


def recurring_groups(h: np.ndarray, doc: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by (h, doc): the number of each row's group by h, and which groups are of several places or documents, as own says."""
    new = np.concatenate([[True], h[1:] != h[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(h)]]) - 1
    return np.cumsum(new) - 1, (first != last) if own else (doc[first] != doc[last])


def recurring(what: Windows) -> Callable:
    """Step 2, over partitions sorted by (h, kind, doc_id, at): the rows asked for (kind ASK).

    Carried from batch to batch are the last h and, until it is known to recur, its rows: those of one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        known = None  # the h at the end of the last batch, if it recurs
        for batch in batches:
            kind = batch.column(4).to_numpy()
            if (kind == ASK).any():
                yield batch.filter(pa.array(kind == ASK))
            rows = [batch.column(k).to_numpy()[kind != ASK] for k in range(4)]
            kind = kind[kind != ASK]
            if not len(kind):
                continue
            if held is not None and held[0][0] == rows[0][0]:
                rows = [np.concatenate([x, y]) for x, y in zip(held, rows)]
                kind = np.concatenate([np.full(len(held[0]), MEET), kind])
            h, doc, at, n = rows
            group, several = recurring_groups(h, doc, what.own)
            several[group[kind == SURE]] = True
            several[0] |= known == h[0]
            out = several[group] & (kind == MEET)
            if out.any():
                yield row_batch(h[out], doc[out], at[out], n[out], ASK)
            known = h[-1] if several[-1] else None
            held = None if several[-1] else [x[group == group[-1]] for x in rows]

    return run


#: A context: its windows (n from `at`, and from each place of `more` in the same document) and its content: symbols as bytes, words joined by a space.
#: Without content, windows that occur before.
CONTEXT = "h long, doc_id long, at long, n long, more array<long>, content binary"


@dataclass
class Context:
    h: int
    doc: int
    at: int
    n: int
    content: bytes
    more: list = field(default_factory=list)


def context_batch(contexts: list[Context]) -> pa.RecordBatch:
    longs = [pa.array([getattr(x, k) for x in contexts], pa.int64()) for k in ("h", "doc", "at", "n")]
    return pa.RecordBatch.from_arrays([*longs, pa.array([x.more or None for x in contexts], pa.list_(pa.int64())), pa.array([x.content for x in contexts], pa.binary())], names=["h", "doc_id", "at", "n", "more", "content"])


def settled_batch(what: Windows, doc, first, last) -> pa.RecordBatch:
    """Windows first..last of documents, which occur before, with ranges that touch or overlap made one."""
    d, a, b = merged(np.array(doc, np.int64), np.array(first, np.int64), np.array(last, np.int64) + what.width)
    size = len(d)
    return pa.RecordBatch.from_arrays([pa.array(d), pa.array(d), pa.array(a), pa.array(b - a - what.width + 1), pa.nulls(size, pa.list_(pa.int64())), pa.nulls(size, pa.binary())], names=["h", "doc_id", "at", "n", "more", "content"])


def context_rows(what: Windows) -> Callable:
    """Step 3. For texts (doc_id, packed text, asked: h, at and n of each) their contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            lists = batch.column(2)
            size = np.asarray(lists.value_lengths())
            flat = lists.flatten()
            hs, ats, ns = (flat.field(k).to_numpy() for k in range(3))
            found: list[Context] = []
            k = j = 0
            for ids, data, bounds in byte_slabs(batch):
                _, begin, starts, ends = what.split(data, bounds)
                raw = data.tobytes()
                for doc, own in zip(ids, begin[:-1].tolist()):
                    last = k + int(size[j])
                    for h, at, n in zip(hs[k:last].tolist(), ats[k:last].tolist(), ns[k:last].tolist()):
                        a = own + (at & INSIDE)
                        b = a + n - 1 + what.width
                        found.append(Context(h, doc, at, n, raw[a:b] if starts is None else b" ".join([raw[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())])))
                    k, j = last, j + 1
            found.sort(key=lambda x: (x.doc, x.at))
            first: dict[tuple, Context] = {}
            before: list[Context] = []
            for x in found:
                y = first.setdefault((x.h, x.content), x)
                if y is x:
                    continue
                if what.own or y.doc < x.doc:
                    before.append(x)
                else:
                    y.more.append(x.at)
            yield context_batch(list(first.values()))
            if before:
                yield settled_batch(what, *zip(*((x.doc, x.at, x.at + x.n - 1) for x in before)))

    return run


def parts(what: Windows, contexts: list[Context], level: int) -> Iterator[Context]:
    """Step 5. Contexts by the gram of a level: halfway from the last level's to the window."""
    gram = what.gram
    for _ in range(level):
        gram = (gram + what.width + 1) // 2
    for x in contexts:
        data = np.frombuffer(x.content, np.uint8)
        symbols, bounds, starts, ends = what.split(data, np.array([0, len(data)]))
        for lo, hi, h, _ in zip(*(v.tolist() for v in anchor_ranges(symbols, bounds, what.width, gram, level))):
            last = hi + what.width
            content = x.content[lo:last] if starts is None else x.content[starts[lo] : ends[last - 1]]
            yield Context(h, x.doc, x.at + lo, hi - lo + 1, content, [a + lo for a in x.more])


def blocks(what: Windows, level: int, block_size: int = BLOCK, group_size: int = GROUP) -> Callable:
    """Steps 4 and 5, over partitions sorted by (h, doc_id, at): windows that occur before, and contexts for another round."""

    def looked_at(contexts: list[Context], old: int = 0) -> tuple[list[Context], list[pa.RecordBatch]]:
        """Those of contexts that hold the first of some window, and what is found of those after the first `old`."""
        doc, first, last, left = [], [], [], [x.n for x in contexts]
        for i, a, b in what.settle(contexts):
            left[i] -= b - a + 1
            if i >= old:
                x = contexts[i]
                for at in (x.at, *x.more):
                    doc.append(x.doc)
                    first.append(at + a)
                    last.append(at + b)
        keep = [x for k, x in enumerate(contexts) if k < old or left[k]]
        return keep, [settled_batch(what, doc, first, last)] if doc else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[Context] = []  # whole groups
        group: list[Context] = []  # the group that is being read: what is kept of it, then what is new
        in_block = in_group = old = kept = 0
        split = None  # the h of a group that goes into another round
        for batch in batches:
            content = batch.column(5)
            done = pa.compute.is_null(content)
            if pa.compute.any(done).as_py():
                yield batch.filter(done)
                batch = batch.filter(pa.compute.invert(done))
            for h, doc, at, n, more, content in zip(*(c.to_pylist() for c in batch.columns)):
                x = Context(h, doc, at, n, content, more or [])
                if group and group[0].h != h:
                    if old:
                        yield from looked_at(group, old)[1]
                    else:
                        block += group
                        in_block += in_group
                    group, in_group, old, kept = [], 0, 0, 0
                    if in_block > block_size:
                        yield from looked_at(block)[1]
                        block, in_block = [], 0
                if h == split:
                    yield context_batch(list(parts(what, [x], level + 1)))
                    continue
                group.append(x)
                in_group += len(content)
                if in_group - kept > max(block_size, kept):
                    group, found = looked_at(group, old)
                    yield from found
                    old, in_group = len(group), sum(len(y.content) for y in group)
                    kept = in_group
                    if kept > group_size and old > 1:
                        split = h
                        for y in group:
                            yield context_batch(list(parts(what, [y], level + 1)))
                        group, in_group, old, kept = [], 0, 0, 0
        if old:
            yield from looked_at(group, old)[1]
        else:
            block += group
        if block:
            yield from looked_at(block)[1]

    return run


def numbered(docs: DataFrame, carry: bool = False) -> DataFrame:
    """(doc_id, text, row): row numbers the different texts of one doc_id from 0, by their hash.

    Equal rows have one number, and so count as one document; different texts are
    sources and targets each. With carry, _all holds all columns of the row, and text is null in it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = F.struct(*[F.lit(None).cast("string").alias(c) if c == "text" else F.col(c) for c in docs.columns]).alias("_all")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *([rest, F.col("text").isNull().alias("_null")] if carry else []))
    repeated = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    if not repeated.limit(1).count():
        return rows.withColumn("row", F.lit(0).cast("long"))
    rows = rows.withColumn("_h", F.xxhash64("text"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("_h")).cast("long") - 1
    places = rows.select("doc_id", "_h").join(repeated, "doc_id").distinct().withColumn("row", place)
    return rows.join(places, ["doc_id", "_h"], "left").drop("_h").withColumn("row", F.coalesce("row", F.lit(0).cast("long")))


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, packed): the texts compressed, for when they are sent to meet what is known of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([press.compress(t) for t in texts], pa.binary())], names=["doc_id", "row", "packed"])

    return docs.select("doc_id", "row", "text").transform(map_arrow, run, "doc_id long, row long, packed binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the packed texts of column 1 as bytes, about ARROW_BYTES of them at a time (or one text)."""
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        texts, size, first = [], 0, 0
        for k, data in enumerate(batch.column(1).to_pylist()):
            texts.append(open_.decompress(data))
            size += len(texts[-1])
            if size > ARROW_BYTES or k == len(batch) - 1:
                part = batch.slice(first, k + 1 - first)
                yield part.set_column(1, "text", pa.array(texts, pa.large_binary()))
                texts, size, first = [], 0, k + 1


def texts_and_ranges(docs: DataFrame, what: Windows) -> DataFrame:
    """(doc_id, packed, ranges) of every row of numbered() docs."""
    return packed(docs).join(earlier_windows(docs, what).hint("merge"), ["doc_id", "row"], "left").select("doc_id", "packed", "ranges")


def asked_contexts(docs: DataFrame, what: Windows) -> DataFrame:
    """Steps 1 to 3."""
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", "row")
    rows = texts.transform(map_arrow, extract(what), ROW)
    rows = rows.repartition(F.when(F.col("kind") == ASK, F.col("doc_id")).otherwise(F.col("h"))).sortWithinPartitions("h", "kind", "doc_id", "at")
    asked = rows.transform(map_arrow, recurring(what), ROW).groupBy("doc_id", F.shiftright("at", PLACE).alias("row")).agg(F.collect_list(F.struct("h", "at", "n")).alias("asked"))
    contexts = packed(texts).join(asked.hint("merge"), ["doc_id", "row"]).select("doc_id", "packed", "asked")
    return contexts.transform(map_arrow, context_rows(what), CONTEXT)


def met_contexts(contexts: DataFrame, what: Windows, level: int) -> DataFrame:
    """Steps 4 and 5, written."""
    met = contexts.repartition(F.when(F.col("content").isNull(), F.col("doc_id")).otherwise(F.col("h"))).sortWithinPartitions("h", "doc_id", "at")
    return cut(met.transform(map_arrow, blocks(what, level), CONTEXT))


def earlier_windows(docs: DataFrame, what: Windows) -> DataFrame:
    """doc_id, row and ranges: array of (at, to) in symbols, which cover exactly the windows that occur before.

    Texts of one doc_id are in order of row; where own is false they remove nothing from each other.
    """
    rounds = [met_contexts(asked_contexts(docs, what), what, 0)]
    while rounds[-1].where("content IS NOT NULL").limit(1).count():
        rounds.append(met_contexts(rounds[-1].where("content IS NOT NULL"), what, len(rounds)))
    forget(rounds[-1])
    found = reduce(DataFrame.unionByName, rounds).where("content IS NULL")
    inside = lambda c, name: c.bitwiseAND(F.lit(INSIDE)).alias(name)
    ranges = F.collect_list(F.struct(inside(F.col("at"), "at"), inside(F.col("at") + F.col("n") - 1 + what.width, "to")))
    return found.groupBy("doc_id", F.shiftright("at", PLACE).alias("row")).agg(ranges.alias("ranges"))


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, packed): the texts compressed, for when they are sent to meet what is known of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([press.compress(t) for t in texts], pa.binary())], names=["doc_id", "row", "packed"])

    return docs.select("doc_id", "row", "text").transform(map_arrow, run, "doc_id long, row long, packed binary")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the packed texts of column 1 as bytes, about ARROW_BYTES of them at a time (or one text)."""
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        texts, size, first = [], 0, 0
        for k, data in enumerate(batch.column(1).to_pylist()):
            texts.append(open_.decompress(data))
            size += len(texts[-1])
            if size > ARROW_BYTES or k == len(batch) - 1:
                part = batch.slice(first, k + 1 - first)
                yield part.set_column(1, "text", pa.array(texts, pa.large_binary()))
                texts, size, first = [], 0, k + 1


def texts_and_ranges(docs: DataFrame, what: Windows) -> DataFrame:
    """(doc_id, packed, ranges) of every row of numbered() docs."""
    return packed(docs).join(earlier_windows(docs, what).hint("merge"), ["doc_id", "row"], "left").select("doc_id", "packed", "ranges")


def earlier_windows(docs: DataFrame, what: Windows) -> DataFrame:
    """doc_id, row and ranges: array of (at, to) in symbols, which cover exactly the windows that occur before.

    Texts of one doc_id are in order of row; where own is false they remove nothing from each other.
    """
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", "row")
    of = F.shiftright("at", PLACE).alias("row")
    rows = texts.transform(map_arrow, extract(what), ROW)
    rows = rows.repartition(F.when(F.col("kind") == ASK, F.col("doc_id")).otherwise(F.col("h"))).sortWithinPartitions("h", "kind", "doc_id", "at")
    asked = rows.transform(map_arrow, recurring(what), ROW).groupBy("doc_id", of).agg(F.collect_list(F.struct("h", "at", "n")).alias("asked"))
    contexts = packed(texts).join(asked.hint("merge"), ["doc_id", "row"]).select("doc_id", "packed", "asked").transform(map_arrow, context_rows(what), CONTEXT)
    found, level = [], 0
    while True:
        met = contexts.repartition(F.when(F.col("content").isNull(), F.col("doc_id")).otherwise(F.col("h"))).sortWithinPartitions("h", "doc_id", "at")
        met = forget(cut(met.transform(map_arrow, blocks(what, level), CONTEXT)))
        found.append(met.where("content IS NULL").select("doc_id", "at", "n"))
        contexts, level = met.where("content IS NOT NULL"), level + 1
        if not contexts.limit(1).count():
            break
    found = reduce(DataFrame.unionByName, found)
    inside = lambda c, name: c.bitwiseAND(F.lit(INSIDE)).alias(name)
    return found.groupBy("doc_id", of).agg(F.collect_list(F.struct(inside(F.col("at"), "at"), inside(F.col("at") + F.col("n") - 1 + what.width, "to"))).alias("ranges"))


def mask_of(ranges, n: int) -> np.ndarray:
    """Which of n symbols the ranges cover."""
    change = np.zeros(n + 1, np.int64)
    if ranges is not None and len(ranges):
        for r in ranges:
            change[min(r["at"], n)] += 1
            change[min(r["to"], n)] -= 1
    return np.cumsum(change[:n]) > 0
