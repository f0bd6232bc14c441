"""Registered queries over small made tables."""

import math
from collections import Counter
from datetime import datetime

import pandas as pd
import pytest

from recoflux import queries

WORDS = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(260)]
TEXTS = [
    WORDS[:60] + WORDS[:25],  # the terms shared with the next are those of less weight
    WORDS[30:90] + WORDS[65:90],
    WORDS[100:160],
    WORDS[159:259],
    WORDS[:250],  # more than 200 terms
    ["only"] * 3,
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs = [(k, " ".join(w), "en", "src0") for k, w in enumerate(TEXTS)]
    pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source"]).to_parquet(path / "documents.parquet")
    pd.DataFrame([(k, f"name{chr(97 + k)}", "kind", 100.0) for k in range(len(TEXTS))], columns=["p_partkey", "p_name", "p_type", "p_retailprice"]).to_parquet(path / "part.parquet")
    events = pd.DataFrame([(0, datetime(2024, 1, 30), 1, "click", '{"k": 0}')], columns=["event_id", "ts", "user_id", "event_type", "props"])
    events.astype({"ts": "datetime64[us]"}).to_parquet(path / "events.parquet")
    return str(path)


def weights(k=200):
    """{(product, term): tfidf} of the whole texts"""
    df = Counter(w for words in TEXTS for w in set(words))
    out = {}
    for p, words in enumerate(TEXTS):
        n = Counter(words)
        raw = {w: c / max(n.values()) * math.log(len(TEXTS) / (1 + df[w])) for w, c in n.items()}
        raw = {w: x for w, x in raw.items() if x > 0}
        for w, x in sorted(sorted(raw.items(), reverse=True), key=lambda wx: -wx[1])[:k]:
            out[f"p{p}", w] = x / max(raw.values())
    return out


def test_tfidf_keeps_200_terms(spark, folder):
    rows = queries.queries()["tfidf"](spark, folder).where("attribute = 'full_content'").collect()
    expected = weights()
    assert max(Counter(p for p, _ in expected).values()) == 200
    assert {(r.product, r.term): r.tfidf for r in rows} == pytest.approx(expected, abs=1e-9)


def test_content_strengths_of_all_terms(spark, folder):
    w = weights()
    of = {p: {t: x for (q, t), x in w.items() if q == p} for p, _ in w}
    expected = {}
    for p, a in of.items():
        for q, b in of.items():
            if p != q and a.keys() & b.keys():
                sim = sum(a[t] / sum(a.values()) * (1 - max(0.0, a[t] - b[t])) for t in a.keys() & b.keys())
                expected[p, q] = round(0.6 * sim + 0.3, 6)  # category, source and price are equal, titles differ
    rows = queries.queries()["content_strengths"](spark, folder).collect()
    assert {(r.product, r.template_product): r.strength for r in rows} == pytest.approx(expected, abs=2e-6)
    assert ("p0", "p1") in expected


def test_ab_posterior_over_the_whole_grid(spark):
    rows = queries.queries()["ab_posterior"](spark, "").orderBy("actual").collect()
    assert [r.actual for r in rows] == pytest.approx([k / 100 for k in range(-30, 51)])
    assert sum(r.probability for r in rows) == pytest.approx(1) and rows[-1].accrued == pytest.approx(1)
    assert all(r.likelihood * 20_000 == pytest.approx(round(r.likelihood * 20_000), abs=1e-6) for r in rows)
    assert any(round(r.likelihood * 20_000) % 10 for r in rows)  # finer than 2,000 tests can tell
