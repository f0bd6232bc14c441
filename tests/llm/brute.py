"""Plain restatements of the contracts, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict


def earlier_bytes(docs: list[tuple], width: int = 100) -> dict:
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}"""
    seen, out = {}, {}
    for doc, text in sorted(docs, key=lambda x: x[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - width + 1):
            if seen.setdefault(data[p : p + width], (doc, p)) < (doc, p):
                gone[p : p + width] = b"\1" * width
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def earlier_words(docs: list[tuple], width: int = 50) -> dict:
    """{doc_id: (n_words, n_removed, kept_sha256)}"""
    seen, out = {}, {}
    for doc, text in sorted(docs, key=lambda x: x[0]):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - width + 1):
            if seen.setdefault(tuple(words[p : p + width]), doc) < doc:
                gone[p : p + width] = [True] * width
        out[doc] = (len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest())
    return out


def letter_grams(text: str | None) -> list[str]:
    letters = "".join(c if c.isalpha() else "\x01" for c in (text or "").lower())
    padded = re.sub("\x01+", "\x01", f"\x01{letters}\x01")
    if len(padded) < 2:
        return []
    return [c for c in padded if c != "\x01"] + [padded[k : k + n] for n in (2, 3) for k in range(len(padded) - n + 1)]


def rank_order(counts: Counter, top: int) -> list[str]:
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:top]


def nearest_languages(docs: list[tuple], top: int = 400) -> list[tuple]:
    """[(doc_id, lang_pred, score)] of (doc_id, text, lang), by profiles of those whose id isn't held out"""
    counts = defaultdict(Counter)
    for doc, text, lang in docs:
        if lang is not None and doc is not None and zlib.crc32(str(doc).encode()) % 3 != 1 and letter_grams(text):
            counts[lang].update(letter_grams(text))
    profiles = {lang: {g: k for k, g in enumerate(rank_order(c, top))} for lang, c in sorted(counts.items())}
    out = []
    for doc, text, _ in docs:
        own = rank_order(Counter(letter_grams(text)), top)
        if not own:
            out.append((doc, "und", 0.0))
            continue
        apart = {lang: sum(min(abs(ranks[g] - k), top) if g in ranks else top for k, g in enumerate(own)) for lang, ranks in profiles.items()}
        best = min(apart, key=lambda lang: (apart[lang], lang))
        out.append((doc, best, 1 - apart[best] / (top * len(own))))
    return out
