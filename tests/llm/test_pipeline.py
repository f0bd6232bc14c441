"""The pipeline, stage by stage, against brute force on a small corpus."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from test_corpus_operators import components_of, prose  # noqa: E402

import corpus_pipeline  # noqa: E402
from recoflux.llm import decontamination, quality, tokens  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """good and bad documents, copies, near copies, shared passages, benchmark passages, nulls and empty texts"""
    r = random.Random(21)
    good = [t for t in prose(31, 90, 260) if len(t.split()) > 90]
    bad = [t.upper() + "!! $$$" for t in prose(32, 60, 120)]
    items = [t for t in prose(33, 6, 40) if t.split()][:4]
    texts = list(good)
    texts += [good[0], good[1]]  # copies
    near = good[2].split()
    near[len(near) // 2] = "neu"
    texts.append(" ".join(near))
    for k in range(6):  # a passage of an earlier document in a later one
        a, b = r.choice(good).split(), prose(60 + k, 1, 400)[0].split()
        texts.append(" ".join(b[: len(b) // 2] + a[:70] + b[len(b) // 2 :]))
    long = (prose(70, 1, 900)[0].split() * 2)[:600]
    texts += [items[0], " ".join(long[:300] + items[1].split()[:14] + long[300:])]
    texts += bad + [None, "", "one"]
    docs = [(k, t, "en", "s", len(t) if t is not None else None) for k, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(k < len(texts) - len(bad) - 3), 0) for k in range(len(texts) - 3)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, dict((a, b) for a, b, _ in labels), items


def test_stages(spark, corpus, tmp_path):
    folder, docs, labels, items = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "best-fit packing"]
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, folder).write.parquet(str(tmp_path / str(k)))
        frame = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(frame.collect())
    as_dict = lambda rows: {r.doc_id: r.text for r in rows}
    first, second, third, fourth = map(as_dict, seen[:4])
    # 1: what op3 predicts, and it tells held-out documents apart
    predicted = {r.doc_id: r.predicted for r in quality.op3_quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert set(first) == {d for d, p in predicted.items() if p} and all(first[d] == t for d, t, *_ in docs if d in first)
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    assert sum(predicted[d] == labels[d] for d in held) >= 0.95 * len(held)
    # 2: the least of each component stays
    assert set(second) == {c for _, c in components_of(list(first.items())).values()} and len(second) < len(first)
    # 3: passages of smaller ids are gone
    words = brute.earlier_words(list(second.items()))
    assert any(0 < v[1] < v[0] for v in words.values())
    for d, (n, gone, sha) in words.items():
        if not gone:
            assert third[d] == second[d]
        elif gone == n:
            assert d not in third
        else:
            assert hashlib.sha256(third[d].encode()).hexdigest() == sha
    # 4: no benchmark window is left, and documents without one are as they were
    windows = set()
    for text in items:
        w = decontamination.words_of(text)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))}
    occurs = lambda t: [k for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows] if (w := decontamination.words_of(t)) else []
    assert not any(occurs(t) for t in fourth.values())
    assert all(fourth.get(d) == t for d, t in third.items() if not occurs(t))
    assert any(occurs(t) and d in fourth for d, t in third.items()) and any(occurs(t) and d not in fourth for d, t in third.items())
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in seen[3])
    # 5: every id of every document, in full sequences
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary(None))
    pieces = defaultdict(list)
    for r in seen[4]:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    expected = {}
    for d, t in fourth.items():
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        expected[d] = [(k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[k : k + 2048]))) for k in range(0, len(ids), 2048)]
    assert {d: sorted(v) for d, v in pieces.items()} == expected
    columns = lambda rows: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert columns(corpus_pipeline.run(spark, folder).collect()) == columns(seen[4])


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
