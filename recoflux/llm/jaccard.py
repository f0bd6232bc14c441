"""N-gram Jaccard join: universe partition by the pigeonhole principle, exact.

Sets of distinct 5-word shingles, and links at |A & B| / |A | B| >= 0.8.

Linked sets of sizes a <= b have b <= a / 0.8 and differ in at most
a + b - 2 * ceil(4 (a + b) / 9) shingles. Sizes fall into bands, each a quarter
wider than its least size, so linked sets are of one band or of neighbours, and each set
takes part in the scheme of its own band and of the band below. A scheme deals the
universe of shingles into m segments by hash. If t is the most shingles that linked
sets of the scheme differ in, m = t + 1 + e segments have at least e + 1 in
which the two agree.

Allocation: of its m segment subsets a set indexes the t + 1 of least cost and skips e. What a subset costs is
how many sets share it. A pass over all sets counts subsets by hash in a table of fixed size; one
that is shared far more than the mean costs more, by powers of two. Among equal costs, a
subset of more shingles comes first; an empty one would be shared by most. Since all sets rank equal subsets
equally, the best of the e + 1 agreeing subsets ranks above e others in
both sets, so both index it, unless it is empty. A set with fewer than t + 1
subsets that aren't empty indexes all it has, and their one-deletion neighbourhoods
besides: two such sets differ by at most one shingle in some subset if
two per subset of two or more and one per other subset make t + 1. Sets for which
they don't (of a few shingles) meet in a list of their band.

Sets that share an index entry are candidates. A candidate pair goes on if its sizes and
its sketches (bits of which linked sets can't differ in too many) allow a
link, and is then verified with the whole sets. First each set of an entry
is tried with the entry's smallest id. Then, in entries of three or more, all
pairs are tried whose sets aren't known to be connected yet; pairs within a
known component could add nothing. So no link between components is
lost, and a large group of near copies costs few trials. The sets of a large
entry are dealt into cells, and pairs of cells are tried apart, so that no task holds more than two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflux.llm.common import RADIX, Rolling, Words, byte_slabs, cut, ids_and_texts, lower_ascii, map_arrow, mix

SHINGLE = 5
#: Skipped subsets for each that is indexed.
SLACK = 0.5
#: Bits of a set's sketch.
SKETCH = 1024
#: Bits of a subset's hash by which subsets are counted.
COUNTED = 18
#: Sets of a cell of an entry, about.
CELL = 2048


def bands(largest: int) -> np.ndarray:
    """The least size of each band, from 1 past largest."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * 5 // 4 + 1)
    return np.array(out, np.int64)


def most_apart(least: np.ndarray) -> np.ndarray:
    """For bands by least size: the most shingles in which linked sets of the band's scheme differ."""
    a = least * 5 // 4
    both = a + a * 5 // 4
    return np.array([max(s - 2 * -(-4 * s // 9) for s in range(max(2, n - 8), n + 1)) for n in both.tolist()], np.int64)


class Sets:
    """The distinct shingles of a slab's texts, text by text, ascending: values[bounds[i]:bounds[i + 1]]."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        data = lower_ascii(data)
        words = Words(data, bounds)
        rolling = Rolling(words.hashes())
        ends = words.bounds
        n = np.diff(ends)
        grams = rolling.grams(SHINGLE) if len(words.starts) >= SHINGLE else np.zeros(0, np.uint64)
        short = np.flatnonzero((n > 0) & (n < SHINGLE))
        whole = dict(zip(short.tolist(), rolling.runs(ends[short], ends[short + 1]).tolist()))
        parts = []
        for i in range(len(n)):
            if n[i] >= SHINGLE:
                own = np.sort(grams[ends[i] : ends[i + 1] - SHINGLE + 1])
                parts.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            else:
                parts.append(np.array([whole[i]], np.uint64) if i in whole else np.zeros(0, np.uint64))
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        self.values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def sketches(self) -> np.ndarray:
        """Per set, 16 numbers of 64 bits: whether an odd number of its shingles has each of 1024 hash values.

        Sets that differ in d shingles have sketches that differ in at most d bits.
        """
        bit = (np.repeat(np.arange(len(self.sizes)), self.sizes) * SKETCH) + (mix(self.values + np.uint64(17)) & np.uint64(SKETCH - 1)).astype(np.int64)
        odd = (np.bincount(bit, minlength=len(self.sizes) * SKETCH) & 1).astype(np.uint8)
        return np.packbits(odd).view(np.uint64).reshape(len(self.sizes), SKETCH // 64)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each set."""
        out = []
        for salt in (11, 13):
            sums = np.zeros(len(self.values) + 1, np.uint64)
            np.cumsum(mix(self.values + np.uint64(salt)), dtype=np.uint64, out=sums[1:])
            out.append(mix(sums[self.bounds[1:]] - sums[self.bounds[:-1]] + self.sizes.astype(np.uint64)).view(np.int64))
        return out[0], out[1]


def entries(sets: Sets, chosen: np.ndarray, cost: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, texts): the index entries of the chosen texts, none of which is empty; without cost, all their subsets."""
    keys, owners = [], []
    if not len(chosen):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = bands(int(sets.sizes.max()))
    apart = most_apart(least)
    band = np.searchsorted(least, sets.sizes[chosen], "right") - 1
    for down in (0, 1):
        take = band >= down
        k, o = scheme_entries(sets, chosen[take], band[take] - down, apart, cost)
        keys.append(k)
        owners.append(o)
    return np.concatenate(keys), np.concatenate(owners)


def scheme_entries(sets: Sets, texts: np.ndarray, band: np.ndarray, apart: np.ndarray, cost: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    sizes = sets.sizes[texts]
    need = apart[band] + 1
    m = need + np.ceil(SLACK * need).astype(np.int64)
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start = np.cumsum(sizes) - sizes
    which = np.repeat(np.arange(len(texts)), sizes)
    tokens = sets.values[np.repeat(sets.bounds[texts] - start, sizes) + np.arange(sizes.sum())]
    # The segment of a shingle, and its part in the subset's hash, under the scheme of the band.
    dealt = mix(tokens ^ (band[which].astype(np.uint64) * np.uint64(RADIX)))
    segment = (((dealt >> np.uint64(32)) * m[which].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    part = mix(dealt + np.uint64(1))
    slot = (np.cumsum(m) - m)[which] + segment
    by = np.argsort(slot, kind="stable")
    slot, part = slot[by], part[by]
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    count = np.diff(np.concatenate([first, [len(slot)]]))
    total = np.add.reduceat(part, first)
    owner = which[by][first]
    name = np.uint64(RADIX) * (band[owner].astype(np.uint64) * np.uint64(1 << 32) + segment[by][first].astype(np.uint64))

    def key(sums: np.ndarray, names: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return mix(mix(sums + names) + counts.astype(np.uint64))

    keys = key(total, name, count)
    if cost is None:
        return keys, texts[owner]
    # Rank each text's subsets: cheaper first, then larger, then by content, which all are the same for both of two agreeing sets.
    rank = np.lexsort((keys, -count, cost[(keys >> np.uint64(64 - COUNTED)).astype(np.int64)], owner))
    have = np.bincount(owner, minlength=len(texts))
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank)) - np.repeat(np.cumsum(have) - have, have)
    few = have < need
    kept = (place < need[owner]) | few[owner]
    out_keys, out_texts = [keys[kept]], [texts[owner[kept]]]
    if few.any():
        # One-deletion neighbourhoods of subsets of two or more, for sets with too few subsets.
        at = np.flatnonzero(few[owner] & (count >= 2))
        each = np.repeat(at, count[at])
        token = np.repeat(first[at], count[at]) + np.arange(count[at].sum()) - np.repeat(np.cumsum(count[at]) - count[at], count[at])
        out_keys.append(key(total[each] - part[token], name[each], count[each] - 1))
        out_texts.append(texts[owner[each]])
        credit = np.bincount(owner, np.minimum(count, 2), len(texts)).astype(np.int64)
        rest = np.flatnonzero(few & (credit < need))
        out_keys.append(mix(band[rest].astype(np.uint64) + np.uint64(1 << 60)))
        out_texts.append(texts[rest])
    return np.concatenate(out_keys), np.concatenate(out_texts)


ROW = "key long, more long, doc_id long, n long, kind int, sketch binary"
ENTRY, SET, EDGE, UNNAMED, PAIR, GROUP = range(6)


def rows_of(kind: int, key, more, doc, n=None, sketch=None) -> pa.RecordBatch:
    size = len(key)
    longs = [pa.array(x if x is not None else np.zeros(size, np.int64), pa.int64()) for x in (key, more, doc, n)]
    return pa.RecordBatch.from_arrays([*longs, pa.array(np.full(size, kind), pa.int32()), pa.array(sketch if sketch is not None else [None] * size, pa.binary())], names=["key", "more", "doc_id", "n", "kind", "sketch"])


def leads_of(ids: list, sets: Sets) -> tuple[np.ndarray, ...]:
    """(docs, named, one, two, first, leads): ids, which there are, the sets' digests, for each the first text with an
    equal set, and which texts lead, that is, are the first of a set that isn't empty."""
    docs = np.array([-1 if x is None else x for x in ids], np.int64)
    named = np.array([x is not None for x in ids], bool)
    one, two = sets.digests()
    by = np.lexsort((docs, ~named, two, one))
    new = np.concatenate([[True], (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1])])
    first = np.empty(len(by), np.int64)
    first[by] = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return docs, named, one, two, first, (first == np.arange(len(by))) & named & (sets.sizes > 0)


def shared_subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, n): how many subsets of all sets have each of 2**COUNTED hash values; one row a task and slot."""
    total = np.zeros(1 << COUNTED, np.int64)
    for batch in batches:
        for ids, data, bounds in byte_slabs(batch, 1 << 20):
            sets = Sets(data, bounds)
            keys, _ = entries(sets, np.flatnonzero(leads_of(ids, sets)[-1]), None)
            total += np.bincount((keys >> np.uint64(64 - COUNTED)).astype(np.int64), minlength=len(total))
    slot = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "n"])


def costs(texts: DataFrame) -> np.ndarray:
    """By slot, 0 where it is near the mean, else the power of two by which it is above. Only slots above it come to the driver (at most half of them)."""
    counts = cut(texts.transform(map_arrow, shared_subsets, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")))
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / (1 << COUNTED)
    out = np.zeros(1 << COUNTED, np.int8)
    for r in counts.where(F.col("n") >= 2 * mean).where("n > 0").toLocalIterator():
        out[r.slot] = int(np.log2(r.n / mean))
    return out


def index_rows(cost) -> Callable:
    """For each text its set's size and sketch (SET, under the set's digests, or UNNAMED without doc_id), and index entries (ENTRY).

    Of equal sets in a slab only the smallest doc_id is indexed and meets
    others; the rest are tied to it at once (EDGE, doc_id to more).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data, bounds in byte_slabs(batch, 1 << 20):
                sets = Sets(data, bounds)
                docs, named, one, two, first, leads = leads_of(ids, sets)
                key = np.where(leads, one, mix(docs.view(np.uint64)).view(np.int64))
                sketches = sets.sketches()
                for kind, which in ((SET, np.flatnonzero(named)), (UNNAMED, np.flatnonzero(~named))):
                    yield rows_of(kind, key[which], two[which], docs[which], sets.sizes[which], [sketches[i].tobytes() for i in which])
                tied = np.flatnonzero(~leads & named & (sets.sizes > 0) & (docs[first] != docs))
                yield rows_of(EDGE, mix(docs[tied].view(np.uint64)).view(np.int64), docs[first[tied]], docs[tied])
                keys, texts = entries(sets, np.flatnonzero(leads), cost.value)
                yield rows_of(ENTRY, keys.view(np.int64), None, docs[texts])

    return run


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over partitions sorted by (key, kind, more, doc_id): equal sets give EDGEs, entries of two or more PAIRs
    of each set with the first, and entries of three or more also GROUP rows (key, doc_id).

    Of the entry at a batch's end only the key, the first and the last doc_id and the count are carried on.
    """
    last = None
    for batch in batches:
        key, more, doc, n, kind = (batch.column(k).to_numpy() for k in range(5))
        sets = (kind == SET) | (kind == UNNAMED)
        if sets.any():
            yield batch.filter(pa.array(sets))
        ties = kind == EDGE
        if ties.any():
            yield rows_of(EDGE, np.zeros(int(ties.sum()), np.int64), more[ties], doc[ties])
        use = (kind == ENTRY) | (kind == SET)
        key, more, doc, kind = key[use], more[use], doc[use], kind[use]
        if not len(key):
            continue
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (more[1:] != more[:-1]) | (kind[1:] != kind[:-1])])
        goes_on = last is not None and last[:3] == (key[0], more[0], kind[0])
        start = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        first, place = doc[start][of], np.arange(len(key)) - start[of]
        before = np.concatenate([[0], doc[:-1]])
        if goes_on:
            first[of == 0] = last[3]
            place[of == 0] += last[5]
            before[0] = last[4]
        last = (key[-1], more[-1], kind[-1], first[-1], doc[-1], place[-1] + 1)
        other = (place > 0) & (first != doc)
        for given, found in ((EDGE, other & (kind == SET)), (PAIR, other & (kind == ENTRY))):
            if found.any():
                pairs = np.unique(np.stack([first[found], doc[found]]), axis=1)
                yield rows_of(given, np.zeros(pairs.shape[1], np.int64), pairs[0], pairs[1])
        third = (kind == ENTRY) & (place == 2)
        rest = (kind == ENTRY) & (place >= 2)
        if rest.any():
            yield rows_of(GROUP, np.concatenate([key[rest], key[third], key[third]]), None, np.concatenate([doc[rest], first[third], before[third]]))


def may_link(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sizes and sketches allow a link: linked sets differ in at most n_a + n_b - 2 ceil(4 (n_a + n_b) / 9) shingles."""
    both = n_a + n_b
    apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return (5 * np.minimum(n_a, n_b) >= 4 * np.maximum(n_a, n_b)) & (apart <= both - 2 * -(-4 * both // 9))


def sketch_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), SKETCH // 64)


def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with sizes and sketches (a, b, n_a, n_b, s_a, s_b), those that may be linked."""
    for batch in batches:
        keep = may_link(*(batch.column(k).to_numpy() for k in (2, 3)), *(sketch_rows(batch.column(k)) for k in (4, 5))) if len(batch) else np.zeros(0, bool)
        yield batch.select([0, 1]).filter(pa.array(keep))


def unconnected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over partitions sorted by (key, cells), of (key, cells, cell, doc_id, label, n, sketch): pairs of sets with unlike labels that may be linked.

    A group is a cell of an entry, or two cells of it, of which pairs across are tried, a row of sets at a time. One whose sets have one label gives none.
    """

    def tried(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        _, _, cell, doc, label, n, sketch = rows
        if (label == label[0]).all():
            return
        by = np.argsort(n, kind="stable")
        cell, doc, label, n, sketch = cell[by], doc[by], label[by], n[by], sketch[by]
        across = (cell != cell[0]).any()
        upto = np.searchsorted(n, n * 5 // 4, "right")
        step = max(1, 50_000 // len(doc))
        for i in range(0, len(doc), step):
            rows_ = np.arange(i, min(i + step, len(doc)))
            count = upto[rows_] - rows_ - 1
            a = np.repeat(rows_, count)
            b = a + 1 + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            apart = (label[a] != label[b]) & ((cell[a] != cell[b]) | (not across))
            a, b = a[apart], b[apart]
            ok = may_link(n[a], n[b], sketch[a], sketch[b])
            a, b = doc[a[ok]], doc[b[ok]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not len(batch):
            continue
        rows = [batch.column(k).to_numpy() for k in range(6)] + [sketch_rows(batch.column(6))]
        if held is not None:
            rows = [np.concatenate([x, y]) for x, y in zip(held, rows)]
        cuts = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
        edges = [0, *cuts.tolist()]
        for x, y in zip(edges[:-1], edges[1:]):
            yield from tried([r[x:y] for r in rows])
        held = [r[edges[-1] :] for r in rows]
    if held is not None:
        yield from tried(held)


def in_cells(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """groups (key, doc_id, ...) with cell and cells: each row once for every pair of cells that its own is in. sizes: key and n of each entry."""
    sizes = sizes.select("key", F.ceil(F.col("n") / CELL).cast("long").alias("_cells"))
    rows = groups.join(sizes.hint("merge"), "key").withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.col("_cells")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cells") - 1)))
    return rows.withColumn("cells", F.least("cell", "_other") * F.col("_cells") + F.greatest("cell", "_other")).drop("_cells", "_other")


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, shingles): each text's set as sorted 64-bit hashes."""
    for batch in batches:
        for ids, data, bounds in byte_slabs(batch):
            sets = Sets(data, bounds)
            parts = [sets.values[a:b].tobytes() for a, b in zip(sets.bounds[:-1], sets.bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.binary())], names=["doc_id", "shingles"])


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both sets (a, b, shingles of a, of b), those with 100 |A & B| >= 80 |A | B|."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 80 * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The linked ones of pairs (a, b); only texts that are in a pair become sets."""
    asked = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = texts.join(asked.hint("shuffle_hash"), "doc_id", "left_semi").transform(map_arrow, set_rows, "doc_id long, shingles binary")
    sets = cut(sets)
    rows = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a")).hint("merge"), "a")
    rows = rows.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b")).hint("merge"), "b")
    return rows.select("a", "b", "of_a", "of_b").transform(map_arrow, linked, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """doc_id and label (the least doc_id reachable) of every id that edges (a, b) hold, by alternating stars.

    Each round ties every id's larger neighbours, then its smaller ones and
    itself, to its least neighbour, until nothing changes. A round writes its edges to the
    shared folder; only counts come to the driver.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        # Least neighbours are written before they are joined, so that the join's sides are plain exchanges, of which a large partition (the
        # edges of one id) can be split.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")))
        large = cut(both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least.hint("merge"), "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy(F.col("u").alias("doc_id")).agg(F.min("v").alias("label"))
        state = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs.

    Documents are linked if their sets of distinct 5-word shingles (words
    separated by white space, A-Z lowered) have a Jaccard similarity of 0.8 or more;
    with fewer words the whole sequence is the one shingle. A text without words, or null, is
    empty and linked with nothing. component_id is the least doc_id
    reachable by links, itself included. Rows that repeat a doc_id are one
    document with several sets; a row without doc_id has no component (null). Texts are taken whole, however
    long; an empty table gives an empty table. Shingles are
    64-bit hashes; equal sets are told by 128-bit digests.
    """
    texts = ids_and_texts(docs)
    cost = texts.sparkSession.sparkContext.broadcast(costs(texts))
    rows = texts.transform(map_arrow, index_rows(cost), ROW).repartition("key").sortWithinPartitions("key", "kind", "more", "doc_id")
    met = cut(rows.transform(map_arrow, meet, ROW))
    sets = met.where(F.col("kind") == SET).select("doc_id", "n", "sketch")
    edges = met.where(F.col("kind") == EDGE).select(F.col("doc_id").alias("a"), F.col("more").alias("b"))
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")).hint("merge")
    pairs = met.where(F.col("kind") == PAIR).select(F.least("more", "doc_id").alias("a"), F.greatest("more", "doc_id").alias("b")).distinct()
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").transform(map_arrow, likely, "a long, b long")
    texts = texts.where(F.col("doc_id").isNotNull())
    edges = edges.unionByName(cut(verified(texts, cut(pairs))))
    labels = cut(components(edges))
    groups = met.where(F.col("kind") == GROUP).select("key", "doc_id").join(labels.hint("merge"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    mixed = groups.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y").select("key", "n")
    groups = in_cells(groups, mixed).join(sets.hint("merge"), "doc_id").select("key", "cells", "cell", "doc_id", "label", "n", "sketch")
    more = groups.repartition("key", "cells").sortWithinPartitions("key", "cells").transform(map_arrow, unconnected, "a long, b long").distinct()
    more = cut(verified(texts, cut(more)))
    named = labels.select(F.col("doc_id"), "label")
    again = more.join(named.select(F.col("doc_id").alias("a"), F.col("label").alias("l_a")), "a", "left").join(named.select(F.col("doc_id").alias("b"), F.col("label").alias("l_b")), "b", "left")
    again = again.select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))
    top = cut(components(again).select(F.col("label").alias("top"), F.col("doc_id").alias("label")))
    own = met.where(F.col("kind").isin(SET, UNNAMED)).select(F.when(F.col("kind") == SET, F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"))
    own = own.join(named.hint("merge"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    return own.join(top.hint("merge"), "label", "left").select("doc_id", "n_shingles", F.coalesce("top", "label").alias("component_id"))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are the least doc_id of their component; rows without doc_id stay."""
    found = near_duplicates(docs).select(F.col("doc_id").alias("_id"), "component_id").where("_id <> component_id").select("_id").distinct()
    return docs.join(found.hint("shuffle_hash"), docs["doc_id"] == found["_id"], "left_anti")


def op10_jaccard(docs: DataFrame) -> DataFrame:
    """Components of near duplicates; nulls, empty and long texts, ties, repeats and empty tables as near_duplicates() says."""
    return near_duplicates(docs)


#: The contract over all tables, as SQL: every shared shingle is a row.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, md5_number(array_to_string(w[k : k + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""
