"""Tokens, stop words, stems and term counts."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recoflux.functions import stemming

#: Characters that are deleted before words are cut, and words of web pages that count as stop words; fixed values.
DELETED = '\n\t.,?!$"'
WEB_WORDS = ["amp", "quot", "href", "http", "://", ".&#"]
MIN_LENGTH, MAX_LENGTH = 3, 30


def tokenize(text: Column) -> Column:
    """Runs of word characters and runs of other visible characters; accents belong to words."""
    cleaned = F.trim(F.translate(text, DELETED, ""))
    return F.regexp_extract_all(cleaned, F.lit(r"(?U)(\w+|[^\w\s]+)"), F.lit(1))


def squeezed(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, " +", " "))


def stop_words(language: str) -> list[str]:
    return sorted({*StopWordsRemover.loadDefaultStopWords(language), *WEB_WORDS})


def by_language(language: Column, per_language) -> Column:
    """when-chain of per_language(name) over supported languages, by code or name."""
    out = None
    for code, name in stemming.LANGUAGES.items():
        is_it = F.lower(language).isin(code, name)
        value = per_language(name)
        out = F.when(is_it, value) if out is None else out.when(is_it, value)
    return out


def remove_stop_words(tokens: Column, language: Column, least: int = 1, most: int = MAX_LENGTH) -> Column:
    """Tokens that are no stop words and of least..most characters; those of an unsupported language stay as they are."""

    def kept(name: str) -> Column:
        words = F.array(*[F.lit(w) for w in stop_words(name)])
        return F.filter(tokens, lambda t: ~F.array_contains(words, t) & F.length(t).between(least, most))

    return by_language(language, kept).otherwise(tokens)


def _stemmed(tokens: pd.Series, language: pd.Series) -> pd.Series:
    out = []
    for words, code in zip(tokens, language):
        name = stemming.name_of(code)
        out.append(None if words is None else [stemming.stem(w, name) for w in words] if name else list(words))
    return pd.Series(out)


def stems(tokens: Column, language: Column) -> Column:
    """Stems of tokens; those of an unsupported language stay as they are."""
    return F.pandas_udf(_stemmed, T.ArrayType(T.StringType()))(tokens, language)


def text_to_stems(text: Column, language: Column, least: int = MIN_LENGTH) -> Column:
    """Words, then stems, then stop words off."""
    return remove_stop_words(stems(tokenize(squeezed(text)), language), language, least)


def terms(text: Column, language: Column, stemmed: bool = True) -> Column:
    """Words, then stop words off, then stems: what frequencies are made of."""
    words = remove_stop_words(tokenize(squeezed(text)), language, MIN_LENGTH)
    return stems(words, language) if stemmed else words


def term_counts(docs: DataFrame, key: str, text: str, language: str, stemmed: bool = True) -> DataFrame:
    """(key, term, count) of each text."""
    rows = docs.select(key, F.explode(terms(F.col(text), F.col(language), stemmed)).alias("term"))
    return rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("count"))


def common_terms(a: Column, b: Column) -> Column:
    """Distinct terms in both; 0 if either is null."""
    return F.coalesce(F.when(a.isNull() | b.isNull(), 0).otherwise(F.size(F.array_intersect(a, b))), F.lit(0))
