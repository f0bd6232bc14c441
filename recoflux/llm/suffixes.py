"""Suffix-array dedup: bytes covered by a 100-byte string that starts earlier in the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from recoflux.llm.anchors import Context, Windows, mask_of, numbered, texts_and_ranges, unpacked
from recoflux.llm.common import BYTE_SYMBOLS, map_arrow

WIDTH, GRAM = 100, 32


def eight_bytes(text: np.ndarray, more: int) -> np.ndarray:
    """The 8 bytes from each position as one number, most significant first; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(more + 8, np.uint8)])
    n = len(text) + more
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= padded[k : k + n]
    return out


def rising(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors. The last isn't: its successor is empty."""
    ends = np.concatenate([np.flatnonzero(text[1:] != text[:-1]), [len(text) - 1]])
    up = np.zeros(len(ends), bool)
    up[:-1] = text[ends[:-1]] < text[ends[:-1] + 1]
    return np.repeat(up, np.diff(np.concatenate([[-1], ends])))


def sorted_by_prefix(words: np.ndarray, chosen: np.ndarray, depth: int) -> np.ndarray:
    """The chosen suffixes in order of their first depth bytes: by 8 bytes, then ties alone by the next 8, and so on."""
    order = chosen[np.argsort(words[chosen], kind="stable")]
    first = words[order]
    same = first[1:] == first[:-1]
    done = 8
    while done < depth and same.any():
        tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        group = np.cumsum(~np.concatenate([[False], same]))[tied]
        key = words[order[tied] + done]
        by = np.lexsort((key, group))
        order[tied], key = order[tied][by], key[by]
        same[:] = False
        same[tied[np.flatnonzero((group[1:] == group[:-1]) & (key[1:] == key[:-1]))]] = True
        done += 8
    return order


def reached(wanted: np.ndarray, up: np.ndarray) -> np.ndarray:
    """The wanted suffixes and, of those that aren't smaller than their successors, the successors up to the first that is."""
    at = np.arange(len(up))
    last = np.maximum.accumulate(np.where(wanted, at, -1))
    end = np.concatenate([[-1], np.maximum.accumulate(np.where(up, at, -1))[:-1]])
    return last > end


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None, words: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of text in order of at least their first depth bytes, by two-stage sorting.

    Suffixes smaller than their successors are sorted directly. The others are
    induced by one scan of the buckets of first bytes from the smallest: when a suffix is
    met, the one before it, if not sorted directly, comes next in its bucket.
    A bucket takes induced suffixes before sorted ones. Suffixes that a bucket
    induces into itself are met after those that induced them; after depth of such steps, what is left of
    their runs of one byte is met at once, since it has the same first depth bytes.
    With wanted (a mask), the order holds those suffixes and the ones that they are induced from. words: eight_bytes(text, depth + 8).
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    up = rising(text)
    need = reached(wanted, up) if wanted is not None else np.ones(n, bool)
    direct = sorted_by_prefix(eight_bytes(text, depth + 8) if words is None else words, np.flatnonzero(up & need), depth)
    induced = need & ~up
    cuts = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))

    def induce(met: np.ndarray) -> None:
        before = met[met > 0] - 1
        before = before[induced[before]]
        if len(before):
            first = text[before]
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            edges = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1], [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                waiting[first[a]].append(before[a:b])

    runs = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    out = []
    for byte in range(256):
        steps = 0
        while waiting[byte]:
            met = np.concatenate(waiting[byte])
            waiting[byte] = []
            steps += 1
            if steps > depth:
                first = runs[np.searchsorted(runs, met, "right") - 1]
                count = met - first + 1
                met = np.repeat(met, count) - (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
                met = met[need[met]]
                out.append(met)
                induce(met[text[met - 1] != byte])
                continue
            out.append(met)
            induce(met)
        met = direct[cuts[byte] : cuts[byte + 1]]
        if len(met):
            out.append(met)
            induce(met)
    return np.concatenate(out)


def common_prefix_at_least(words: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix of order but the first: whether it shares length bytes with the one before it."""
    same = np.ones(max(0, len(order) - 1), bool)
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        at = np.flatnonzero(same)
        same[at] = words[order[at] + k] == words[order[at + 1] + k]
    return same


def settle(contexts: list[Context]) -> Iterator[tuple[int, int, int]]:
    """The windows of contexts that occur before, by a suffix array of all of them and adjacent common prefixes.

    Contexts come in order of document and place. A content that several have goes into the array once, with its least place; the others occur before.
    """
    found: dict[bytes, int] = {}
    for i, x in enumerate(contexts):
        if found.setdefault(x.content, i) < i:
            yield i, 0, x.n - 1
    chosen = list(found.values())
    contexts = [contexts[i] for i in chosen]
    text = np.frombuffer(b"".join([x.content for x in contexts]), np.uint8)
    sizes = np.array([len(x.content) for x in contexts], np.int64)
    starts = np.cumsum(sizes) - sizes
    n = np.array([x.n for x in contexts], np.int64)
    place = np.full(len(text), -1, np.int64)  # the rank of a window's start among all starts, by document and position
    of = np.repeat(np.arange(len(contexts)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    doc, at = (np.array([getattr(x, k) for x in contexts], np.int64) for k in ("doc", "at"))
    by = np.lexsort((at[of] + offset, doc[of]))
    place[(starts[of] + offset)[by]] = np.arange(len(by))
    words = eight_bytes(text, WIDTH + 8)
    order = suffix_array(text, WIDTH, place >= 0, words)
    order = order[place[order] >= 0]
    same = common_prefix_at_least(words, order, WIDTH)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    ranks = place[order]
    least = np.repeat(np.minimum.reduceat(ranks, first), np.diff(np.concatenate([first, [len(order)]])))
    later = np.sort(order[ranks > least])
    if not len(later):
        return
    context = np.searchsorted(starts, later, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (later[1:] != later[:-1] + 1) | (context[1:] != context[:-1])]))
    last = np.concatenate([new[1:], [len(later)]]) - 1
    yield from zip([chosen[k] for k in context[new].tolist()], (later[new] - starts[context[new]]).tolist(), (later[last] - starts[context[new]]).tolist())


def as_bytes(data: np.ndarray, bounds: np.ndarray):
    return BYTE_SYMBOLS[data], bounds, None, None


REPEATS = Windows(WIDTH, GRAM, as_bytes, own=True, settle=settle)


def op5_suffix_dedup(docs: DataFrame) -> DataFrame:
    """Bytes of each document that 100-byte strings starting earlier cover, and what is left.

    A null text is empty; a row without doc_id is left as it is and removes
    nothing; equal rows that repeat a doc_id count as one document, different ones as several, in order of
    their hash (see numbered). Texts are taken whole, however long; equal starts don't occur, so there are no ties;
    an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for text, ranges in zip(*(batch.column(k).to_pylist() for k in (1, 2))):
                data = np.frombuffer(text, np.uint8)
                mask = mask_of(ranges, len(data))
                n_bytes.append(len(data))
                n_removed.append(int(mask.sum()))
                n_spans.append(int((mask[1:] & ~mask[:-1]).sum() + mask[:1].sum()))
                kept.append(hashlib.sha256(data[~mask].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = texts_and_ranges(numbered(docs), REPEATS)
    return rows.transform(map_arrow, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
