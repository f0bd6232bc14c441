"""Token counts: byte-pair merging by heap and linked list, without making identifiers."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflux.llm.common import ids_and_texts, keep, map_texts

#: Entries of a cache; this bounds a worker's memory.
CACHE = 200_000


class Recent:
    """What make(word) gives for words, kept for the words of late: a young and an old half.

    When the young half is full it becomes the old one, whose words return to
    the young half when they are met again, so frequent words are made once.
    """

    def __init__(self, make, size: int = CACHE):
        self.make, self.half = make, size // 2
        self.young: dict = {}
        self.old: dict = {}

    def of(self, words: list) -> list:
        young = self.young
        try:
            return list(map(young.__getitem__, words))
        except KeyError:
            if len(young) > self.half:
                self.old, self.young = young, {}
                young = self.young
            for word in set(words).difference(young):
                value = self.old.get(word)
                young[word] = self.make(word) if value is None else value
            return list(map(young.__getitem__, words))



def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges byte-pair encoding makes of symbols.

    A heap holds the adjacent pairs that have a rank; the lowest rank, leftmost
    first, is merged, and neighbours are found by links. A pair on the heap
    whose symbols have changed meanwhile is skipped.
    """
    n = len(symbols)
    if n < 2:
        return 0
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    symbols, merges = symbols + [None], 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue
        merges += 1
        symbols[i], symbols[j] = left + right, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (rank, i, symbols[i], symbols[k]))
        if (h := before[i]) >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (rank, h, symbols[h], symbols[i]))
    return merges


def spelled(pattern: str) -> str:
    """pattern with the classes in its brackets as ranges of the first plane's characters, which re looks up in bitmaps."""
    plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def ranges(name: re.Match) -> str:
        return "".join([f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in regex.findall(f"{name[0]}+", plane)])

    return re.sub(r"\[[^]]*\]", lambda b: re.sub(r"\\p\{\w+\}|\\s", ranges, b[0]), pattern)


class WordCutter:
    """Cuts a text into words for a word-end BPE vocabulary file.

    Steps as the file states them: special strings are cut from the raw text;
    NFC; white space; lower case of each character by itself; pieces by the file's pattern.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.read(json.load(f))

    def read(self, spec: dict) -> None:
        steps = spec["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or spec["model"]["type"] != "BPE":
            raise ValueError("only word-end BPE files with NFC and lower case are handled")
        split = next(s for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        near = spelled(split["pattern"]["Regex"])
        self.near = self.pieces if re.search(r"\\[^u]|\(\?", near) else re.compile(near).findall  # what else is in it may differ between re and regex
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.marks = tuple(special)

    def pieces_of(self, text: str) -> list[str]:
        """The words that merging works on, in order, of a text without special strings."""
        if text.isascii():
            return self.near(text.lower())
        text = unicodedata.normalize("NFC", text)
        text = "".join([c.lower() for c in text]) if "\u03a3" in text else text.lower()  # a final capital sigma is no special case here
        beyond = len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text)  # characters outside the first plane
        return self.pieces(text) if beyond else self.near(text)


class WordCounter(WordCutter):
    """Counts the tokens of a text for a word-end BPE vocabulary file.

    Special strings count one each; words become bytes, which are merged with a word
    end on the last symbol. Counts of words are kept in a bounded cache.
    """

    def read(self, spec: dict) -> None:
        super().read(spec)
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(spec["model"]["merges"])}
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.letters = byte_letters()
        self.words = Recent(self.word)

    def word(self, word: str) -> int:
        symbols = [self.letters[b] for b in word.encode()]
        if not symbols:
            return 0
        symbols[-1] += self.end
        return len(symbols) - merge_count(symbols, self.ranks)

    def plain(self, text: str) -> int:
        return sum(self.words.of(self.pieces_of(text)))

    def count(self, text: str) -> int:
        if self.special is not None and any(m in text for m in self.marks):
            return len(self.special.findall(text)) + sum(map(self.plain, self.special.split(text)))
        return self.plain(text)


def counter(path: str) -> WordCounter:
    """One counter for each worker process and file."""
    return keep(WordCounter, path)


def vocabulary(path: str | None) -> str:
    """The given file, or the public word vocabulary; asked on the worker, so no path need be shared."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_counts(docs: DataFrame, limit: int = 2048, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than limit tokens) for each row; a null text is empty.

    No shuffle: each text is counted where it is read.
    """

    def per_batch(ids: list, texts: list) -> dict:
        count = counter(vocabulary(path)).count
        n = [count(t) if t else 0 for t in texts]
        return {"doc_id": ids, "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_texts(ids_and_texts(docs), per_batch, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", (WordCounter,))


def op7_token_counts(docs: DataFrame) -> DataFrame:
    return token_counts(docs)
