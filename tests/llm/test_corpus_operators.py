"""Each operator against brute force on small inputs with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from recoflux.llm import anchors, decontamination, jaccard, language, packing, phrases, quality, sharding, suffixes, tokens, topk  # noqa: E402
from recoflux.llm import common  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string, key string, label string, used string, n string, h string, at string"


def frame(spark, rows, parts=3):
    """documents with columns whose names the operators use themselves"""
    full = [(i, t, "en", "s", len(t) if t else None, "x", "x", "x", "x", "x", "x", "x", "x") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def prose(seed, n, size=60):
    r = random.Random(seed)
    lexicon = ["".join(r.choices("abcdeüß", k=r.randint(1, 7))) for _ in range(400)]
    return [" ".join(r.choices(lexicon, k=r.randint(0, size))) for _ in range(n)]


def mutated(texts, seed):
    """texts with copies, near copies, shared passages and repeats mixed in"""
    r = random.Random(seed)
    out = list(texts)
    for _ in range(len(texts)):
        words = r.choice(texts).split()
        kind = r.randint(0, 4)
        if kind == 0:
            out.append(" ".join(words))
        elif kind == 1 and words:
            for _ in range(max(1, len(words) // 40)):
                words[r.randrange(len(words))] = "neu"
            out.append(" ".join(words))
        elif kind == 2:
            other = r.choice(texts).split()
            a = r.randint(0, max(0, len(words) - 1))
            out.append(" ".join(other[: len(other) // 2] + words[a : a + 90] + other[len(other) // 2 :]))
        elif kind == 3:
            out.append(" ".join(words * r.randint(2, 3)))
        else:
            out.append("\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)))
    return out


@pytest.fixture(scope="module")
def corpus():
    texts = mutated(prose(3, 60, 200), 4)
    special = [None, "", "  \n\t ", "a", "aa" * 400, "x " * 300, "é" * 120, "ab" * 200 + " ende", "the end"]
    return list(enumerate(texts + special))


def test_sharding(spark, corpus):
    rows = corpus + corpus[:5] + [(None, "x"), (None, None)]
    for part in (rows, rows[:1], rows[:30], [corpus[0]] * 3000 + rows):
        out = sharding.op1_sharding(frame(spark, part)).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in part)
        slots = defaultdict(list)
        for r in out:
            slots[r.shard].append(r.slot)
            assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 24
        counts = [len(slots[k]) for k in range(24)]
        assert max(counts) - min(counts) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.op1_sharding(frame(spark, [])).count() == 0


def test_sharding_does_not_depend_on_partitions(spark, corpus):
    a, b = (sharding.op1_sharding(frame(spark, corpus, p)).select("doc_id", "shard", "slot") for p in (1, 7))
    assert sorted(a.collect()) == sorted(b.collect())


def test_sharding_with_a_key_of_many_rows_does_not_depend_on_partitions(spark):
    one = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).unionByName(spark.range(4_000).select(F.lit(7_000_000).alias("doc_id"), F.lit("hot").alias("text")))
    found = []
    for parts in (1, 7, 31):
        out = sharding.op1_sharding(one.repartition(parts)).select("doc_id", "row_number", "shard", "slot").collect()
        assert sorted(r.row_number for r in out) == list(range(44_000))
        found.append(sorted(map(tuple, out)))
    assert found[0] == found[1] == found[2]


def test_permutation_against_plain_feistel(spark):
    """round function: the chained 64-bit hash of round key and half, as signed numbers"""
    import math
    import struct

    import xxhash

    def mixed(k, half):
        h = xxhash.xxh64_intdigest(struct.pack("<q", half), xxhash.xxh64_intdigest(struct.pack("<i", k), 42))
        return h - (1 << 64) if h >> 63 else h

    for n in (1, 2, 3, 24, 25, 1000, 1023):
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)

        def once(x):
            left, right = x % a, x // a
            for k in range(sharding.ROUNDS):
                if k % 2 == 0:
                    left = (left + mixed(7 + k, right) % a) % a
                else:
                    right = (right + mixed(7 + k, left) % b) % b
            return left + right * a

        expected = []
        for x in range(n):
            x = once(x)
            while x >= n:
                x = once(x)
            expected.append(x)
        out = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 7).alias("p")).orderBy("id").collect()
        assert [r.p for r in out] == expected and sorted(expected) == list(range(n))


def test_decontamination(spark, corpus):
    words = " ".join(corpus[0][1].split()[:40] or ["w"])
    items = [(1, corpus[10][1]), (2, "a"), (10, words), (3, None), (4, "... !"), (5, "Nie Da Gewesen"), (None, "a"), (7, corpus[10][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_hit", F.lit(1))
    docs = corpus + [(901, "A, A! nie—da gewesen"), (902, "NIE da gewesen x")]
    expected = {}
    windows = defaultdict(set)
    for item, text in items:
        w = decontamination.words_of(text)
        for k in range(len(w) - min(13, len(w)) + 1) if w and item is not None else ():
            windows[tuple(w[k : k + 13])].add(item)
    for doc, text in docs:
        w = decontamination.words_of(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if items_ := windows.get(tuple(w[k : k + n])):
                    found |= items_
                    hit |= set(range(k, k + n))
        ids = sorted(map(str, found))
        expected[doc] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    out = {r[0]: tuple(r)[1:] for r in decontamination.op2_decontamination(frame(spark, docs), bench).collect()}
    assert out == expected
    small = decontamination.window_hits(frame(spark, docs), bench, block_bytes=50).collect()
    assert {r.doc_id: r._n_hit for r in small} == {k: v[1] for k, v in expected.items()}
    assert decontamination.op2_decontamination(frame(spark, docs), bench.limit(0)).where("n_hit > 0").count() == 0
    kept = {r.doc_id: r.text for r in decontamination.decontaminate(frame(spark, docs), bench).collect()}
    assert set(kept) == {d for d, v in expected.items() if not v[4]}
    assert all(kept[d] == t for d, t in docs if d in kept and not expected[d][1])


def test_decontamination_by_items_without_id(spark):
    bench = spark.createDataFrame([(None, "only here and nowhere else"), (1, "and nowhere")], "item_id long, text string")
    docs = [(1, "Only here, and nowhere else!"), (2, "x " * 100 + "only here and nowhere else"), (3, "and nowhere"), (4, "clean")]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = sorted(map(tuple, decontamination.op2_decontamination(frame(spark, docs), bench).collect()))
    assert out == [(1, 5, 5, 1, sha("1"), True), (2, 105, 5, 1, sha("1"), False), (3, 2, 2, 1, sha("1"), True), (4, 1, 0, 0, sha(""), False)]
    kept = {r.doc_id: r.text.split() for r in decontamination.decontaminate(frame(spark, docs), bench).collect()}
    assert kept == {2: ["x"] * 100, 4: ["clean"]}


def test_decontamination_holds_words_of_one_text(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    runs = []
    monkeypatch.setattr(decontamination, "map_arrow", lambda df, fn, schema: runs.append(fn) or df)
    bench = spark.createDataFrame([(k, f"{k} of it") for k in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    texts = [" ".join(f"{j}w{k}" for j in range(200)) for k in range(1000)] + ["so 7 of it", None, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1003)), "text": texts})
    for limit, blocks in ((1 << 20, 1), (100, 5)):
        decontamination.window_hits(docs, bench, block_bytes=limit)
        first = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["7 of it"]})
        assert next(runs[-1](iter([first])))["_n_hit"].to_pylist() == [3], blocks  # hash sets are read
        tracemalloc.start()
        out = next(runs[-1](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert out["_n_words"].to_pylist() == [200] * 1000 + [4, 0, 0]
        assert out["_n_hit"].to_pylist() == [0] * 1000 + [3, 0, 0] and out["_items"].to_pylist()[1000] == ["7"]
        assert peak < 4 * batch.nbytes, (blocks, peak, batch.nbytes)


def test_workers_keep_nothing_of_another_step(spark, corpus):
    import pyarrow as pa

    def alive(batches):
        import gc

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(type(x).__name__ in ("Encoder", "WordCounter") for x in gc.get_objects())]})

    for made in (packing.op4_packing, tokens.op7_token_counts):
        made(frame(spark, corpus)).collect()
        left = frame(spark, corpus, 8).select("doc_id").transform(common.map_arrow, alive, "n long")
        assert {r.n for r in left.collect()} == {0}


def test_quality(spark):
    good, bad = prose(5, 120, 40), [t.upper() + "!!" for t in prose(6, 120, 40)]
    docs = list(enumerate(good + bad)) + [(900, None), (901, ""), (None, "x")]
    labels = spark.createDataFrame([(k, int(k < 120)) for k in range(240)] + [(5, None), (None, 1)], "doc_id long, quality int").withColumn("text", F.lit("x"))
    out = {r.doc_id: r for r in quality.op3_quality(frame(spark, docs), labels).collect()}
    assert len(out) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    held = [k for k in range(240) if out[k].held_out]
    assert held == [k for k in range(240) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum(out[k].predicted == int(k < 120) for k in held) >= 0.9 * len(held)
    assert quality.op3_quality(frame(spark, docs), labels.limit(0)).count() == len(docs)
    assert quality.op3_quality(frame(spark, []), labels).count() == 0
    kept = quality.keep_quality(frame(spark, docs), labels)
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_quality_learns_from_long_texts(spark):
    """one kind is longer than 30,000 bytes throughout"""
    words = lambda seed: prose(seed, 40, 60)
    good, bad = words(7), [f"{t.upper()}!! " * (40_000 // (len(t.encode()) + 3) + 1) for t in words(8)]
    docs = list(enumerate(good + bad))
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(80)] + [(k, 1) for k in range(1000, 6000)], "doc_id long, quality int")
    assert min(len(t) for t in bad) > 30_000
    out = {r.doc_id: r for r in quality.op3_quality(frame(spark, docs), labels).collect()}
    held = [k for k in range(80) if out[k].held_out]
    assert sum(out[k].predicted == int(k < 40) for k in held) >= 0.9 * len(held)
    rows = quality.training_rows(frame(spark, docs + docs[:9]), labels, 30).collect()  # ids without document take no place
    assert len(rows) == len({r.doc_id for r in rows}) == 30 and {r.quality for r in rows} == {0, 1}


def test_packing(spark, corpus):
    docs = corpus + [(800, "wort " * 5000), (801, "w " * 2047), (802, "w " * 2048), (800, "again")]
    out = packing.op4_packing(frame(spark, docs)).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary(None))
    expected = Counter()
    for doc, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            expected[doc, k // 2048, k, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in out) // 2048) + 1
    assert packing.op4_packing(frame(spark, [])).count() == 0


def test_bin_slack_uses_every_piece():
    r = random.Random(2)
    for _ in range(30):
        counts = Counter(r.randint(1, 50) for _ in range(r.randint(1, 200)))
        patterns = packing.minimum_bin_slack(counts, 50)
        used = Counter()
        for pattern, times in patterns:
            assert sum(pattern) <= 50 and times > 0
            for n in pattern:
                used[n] += times
        assert used == counts
        ranks = sorted((n, k) for n, a, b, _, _ in packing.layout(patterns) for k in range(a, b + 1))
        assert ranks == sorted((n, k) for n, c in counts.items() for k in range(c))


def test_suffix_dedup(spark, corpus):
    out = {r[0]: tuple(r)[1:] for r in suffixes.op5_suffix_dedup(frame(spark, corpus)).collect()}
    assert out == brute.earlier_bytes(corpus)
    assert suffixes.op5_suffix_dedup(frame(spark, [])).count() == 0


def test_substring_dedup(spark, corpus):
    out = {r[0]: tuple(r)[1:] for r in phrases.op8_substring_dedup(frame(spark, corpus)).collect()}
    assert out == brute.earlier_words(corpus)
    left = {r.doc_id: r.text for r in phrases.remove_passages(frame(spark, corpus)).collect()}
    for doc, text in corpus:
        if not out[doc][1]:
            assert left[doc] == text
        elif out[doc][1] < out[doc][0]:
            assert hashlib.sha256(left[doc].encode()).hexdigest() == out[doc][2]
        else:
            assert doc not in left
    assert phrases.op8_substring_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("operator, rule", [(suffixes.op5_suffix_dedup, brute.earlier_bytes), (phrases.op8_substring_dedup, brute.earlier_words)])
def test_dedup_of_groups_beyond_a_block(spark, corpus, operator, rule, monkeypatch):
    made = anchors.blocks
    monkeypatch.setattr(anchors, "blocks", lambda w, level: made(w, level, 300, 600))  # runs of a few contexts; several rounds
    out = {r[0]: tuple(r)[1:] for r in operator(frame(spark, corpus)).collect()}
    assert out == rule(corpus)


def test_dedup_of_repeated_ids(spark, corpus):
    rows = corpus[:40] + corpus[:10] + [(None, corpus[3][1]), (corpus[0][0], "another text " * 30)]
    for operator in (suffixes.op5_suffix_dedup, phrases.op8_substring_dedup):
        assert operator(frame(spark, rows)).count() == len(rows)


def test_dedup_of_different_texts_of_one_id(spark):
    made = lambda seed: " ".join(prose(seed, 8, 60))
    a, b, c, d = (made(k) for k in (21, 22, 23, 24))
    rows = [(1, a), (2, b), (2, f"{a} x {c}"), (2, f"y {d} {b}"), (3, c), (4, f"{d} z"), (5, b), (2, b), (None, a)]
    named = spark.createDataFrame([x for x in rows if x[0]], "i long, t string").distinct()
    named = [(r.i, r.t) for r in named.orderBy("i", F.xxhash64("t")).collect()]  # equal rows are one document
    places = brute.earlier_bytes([(k, t) for k, (_, t) in enumerate(named)])
    expected = {x: places[k] for k, x in enumerate(named)}
    for doc, text in rows:
        expected.setdefault((doc, text), brute.earlier_bytes([(0, text)])[0])
    out = suffixes.op5_suffix_dedup(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, *r[1:]) for r in out) == sorted((i or 0, *expected[i, t]) for i, t in rows)
    for doc, text in rows:  # texts of one id leave each other alone
        smaller = [(k, t) for k, (i, t) in enumerate(named) if doc and i < doc]
        expected[doc, text] = brute.earlier_words([*smaller, (len(rows), text)])[len(rows)]
    out = phrases.op8_substring_dedup(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, *r[1:]) for r in out) == sorted((i or 0, *expected[i, t]) for i, t in rows)
    left = sorted((r.doc_id or 0, r.text) for r in phrases.remove_passages(frame(spark, rows)).collect())
    assert [i for i, _ in left] == [0, 1, 2, 2, 2, 2, 4] and (4, "z") in left


def test_suffix_array():
    import numpy as np

    r = random.Random(9)
    for _ in range(200):
        text = bytes(r.choices(b"ab" if r.random() < 0.5 else b"abcd", k=r.randint(1, 60)))
        order = suffixes.suffix_array(np.frombuffer(text, np.uint8), 80)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        wanted = np.array([r.random() < 0.3 for _ in text])
        some = [i for i in suffixes.suffix_array(np.frombuffer(text, np.uint8), 80, wanted).tolist() if wanted[i]]
        assert some == [i for i in order.tolist() if wanted[i]]
    text = np.frombuffer(b"b" + b"a" * 5000 + b"cab" + b"a" * 3000, np.uint8)
    prefix = [text[i : i + 20].tobytes() for i in suffixes.suffix_array(text, 20).tolist()]
    assert prefix == sorted(prefix) and len(prefix) == len(text)


def test_language(spark):
    r = random.Random(1)
    kinds = {"aa": "abcde", "bb": "fghij", "cc": "äöüéè"}
    docs = []
    for k in range(150):
        lang = sorted(kinds)[k % 3]
        docs.append((k, " ".join("".join(r.choices(kinds[lang], k=4)) for _ in range(20)), lang))
    docs += [(900, None, "aa"), (901, "123 !", "bb"), (902, "", None), (None, "fghij", "bb")]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"gram": F.lit(1), "n": F.lit(2)})
    out = {r.doc_id: r for r in language.op6_language(rows).collect()}
    assert len(out) == len(docs)
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (900, 901, 902))
    assert all(out[k].lang_pred == docs[k][2] and 0 <= out[k].score <= 1 for k in range(150))
    assert language.op6_language(rows.limit(0)).count() == 0


def test_language_against_plain_out_of_place(spark):
    """overlapping alphabets, ties, repeated rows, a long text, texts without letters"""
    r = random.Random(8)
    kinds = {"aa": "abcdefg", "bb": "defghij", "cc": "äöüabé", "dd": "жзиабd"}
    made = lambda lang, n: " ".join("".join(r.choices(kinds[lang], k=r.randint(1, 6))) for _ in range(n))
    docs = [(k, made(lang, r.randint(0, 12)), lang) for k, lang in enumerate(r.choices(list(kinds), k=120))]
    docs += docs[:7] + [(500, made("aa", 9000), "bb"), (501, "d", None), (502, "Ab, aB", None), (503, None, "aa"), (504, "12 !", "cc"), (505, "", "dd")]
    found = language.op6_language(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    assert sorted((x.doc_id, x.lang_pred, round(x.score, 9)) for x in found) == sorted((i, lang, round(score, 9)) for i, lang, score in brute.nearest_languages(docs))


def test_language_learns_rare_languages(spark):
    r = random.Random(3)
    made = lambda letters: " ".join("".join(r.choices(letters, k=4)) for _ in range(20))
    own = next(k for k in range(4000, 5000) if zlib.crc32(str(k).encode()) % 3 != 1)  # an id that isn't held out
    docs = [(k, made("abcde"), "aa") for k in range(3000)] + [(k, made("fghij"), "bb") for k in range(3000, 3006)] + [(own, made("klmno"), "cc")] * 150
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    profiles = language.learn_profiles(rows, sample=100)
    assert set(profiles) == {"aa", "bb", "cc"}
    assert language.quota([3000, 6, 150], 100) == 100 and language.quota([5000, 6, 400], 1000) == 594
    out = {x.doc_id: x.lang_pred for x in language.predict_language(rows, profiles).collect()}
    assert all(out[i] == lang for i, _, lang in docs)


def test_token_counts(spark, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary(None))
    docs = corpus + [(700, "don't <|endoftext|>x<|startoftext|> ΑΣ İ é \x1c 　 ٣ ½ 한국 🎉"), (701, "w " * 2049)]
    out = {r.doc_id: r for r in tokens.op7_token_counts(frame(spark, docs)).collect()}
    for doc, text in docs:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (out[doc].n_bytes, out[doc].n_tokens, out[doc].over_limit) == (len((text or "").encode()), n, n > 2048)


def test_words_are_cut_as_the_file_says(monkeypatch):
    """by bitmaps, with the words of the file's own pattern, which only texts beyond the first plane still need"""
    from tokenizers import Tokenizer

    path = tokens.vocabulary(None)
    rules, library = tokens.counter(path), Tokenizer.from_file(path)
    signs = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    text = "".join([f"a{c}'ll{c}{c}9'{c}s x{c}" for c in signs])
    expected, slow = rules.pieces(text.lower()), []
    monkeypatch.setattr(rules, "pieces", lambda t, cut=rules.pieces: slow.append(t) or cut(t))
    assert rules.pieces_of("it's 12 of them.") == ["it", "'s", "1", "2", "of", "them", "."] and not slow
    assert rules.near(text.lower()) == expected
    for odd in ("x\x1cy\x85z\u3000w\ufeffv", "ΑΣ'LL İ½Ⅳ e\u0301", "한국 12 '''ve\u2028'd", "😀ab𝐀b 𝟘9'S \U0001d15e"):
        ids = library.encode(odd, add_special_tokens=False).ids
        assert packing.encoder(path).ids(odd) == b"".join([k.to_bytes(4, "little") for k in ids])
        assert bool(slow) == (max(odd) > "\uffff")


def test_topk(spark, monkeypatch):
    r = random.Random(4)
    rows = [(k, [r.choice([0.0, 0.1, -0.3, 0.5]) for _ in range(8)]) for k in range(400)]
    rows += [(500, None), (550, [None, 1.0]), (600, [float("nan")]), (650, [float("inf"), 1.0]), (700, [0.5]), (701, []), (None, [1.0]), (100, rows[100][1])]
    vectors = spark.createDataFrame([(a, b, 0, 0) for a, b in rows], "vec_id long, embedding array<float>, score int, query int").repartition(5)
    import math
    import struct

    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    valid = [(i, [math.floor(256 * single(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = {}
    for q, v in {i: v for i, v in valid if i % 50 == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in valid if i != q)
        expected[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    for size in (4096, 3):
        monkeypatch.setattr(topk, "QUERIES", size)
        found = defaultdict(list)
        for x in topk.op9_topk(vectors).collect():
            found[x.query_id].append((x.rank, x.vec_id, x.score))
        assert {q: sorted(v) for q, v in found.items()} == expected
    assert topk.op9_topk(vectors.limit(0)).count() == 0


def test_topk_of_repeated_ids(spark, monkeypatch):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [None, 9.0]), (50, [float("nan"), 0.0]), (50, [1.0, 0.0]), (1, [4.0, 0.0]), (2, [0.0, 5.0]), (3, [1.0, 1.0]), (4, [0.0, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    expected = [(50, k + 1, i, 65536 * s) for k, (s, i) in enumerate([(5, 2), (4, 1), (3, 4), (1, 3), (1, 3)])]
    for size in (4096, 1):
        monkeypatch.setattr(topk, "QUERIES", size)
        assert sorted(map(tuple, topk.op9_topk(vectors).collect())) == expected


def components_of(docs):
    sets = {}
    for doc, text in docs:
        words = (text or "").encode().translate(decontamination.LOWER).split()
        sets[doc] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    least = {d: d for d in sets}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("seed, cell", [(1, 2048), (2, 3)])
def test_jaccard(spark, seed, cell, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL", cell)
    r = random.Random(seed)
    texts = mutated(prose(seed, 40, 120), seed) + [None, "", "one", "ONE", "one two", "one  Two"]
    base = prose(seed + 50, 1, 300)[0].split() + ["w"] * 3
    for _ in range(60):  # a group of near copies at all distances
        words = list(base)
        for _ in range(r.randint(1, 6)):
            words[r.randrange(len(words))] = "neu" + str(r.randint(0, 9))
        texts.append(" ".join(words))
    for _ in range(150):  # a few shingles
        words = "a b c d e f g h i j k".split()[: r.randint(5, 11)]
        if r.random() < 0.5:
            words[r.randrange(len(words))] = r.choice("xyz")
        texts.append(" ".join(words))
    docs = list(enumerate(texts))
    out = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.op10_jaccard(frame(spark, docs)).collect()}
    assert out == components_of(docs)
    kept = {x.doc_id for x in jaccard.keep_one_each(frame(spark, docs)).collect()}
    assert kept == {c for _, c in out.values()}


def test_jaccard_odd_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e f"), (2, "d e f"), (None, "d e f"), (None, None), (3, None)]
    out = sorted((x.doc_id or 0, x.n_shingles, x.component_id or 0) for x in jaccard.op10_jaccard(frame(spark, rows)).collect())
    assert out == [(0, 0, 0), (0, 1, 0), (1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]
    assert jaccard.op10_jaccard(frame(spark, [])).count() == 0


def test_cut_writes_to_the_sessions_folder(spark):
    rows = common.cut(spark.range(5))
    assert rows.count() == 5 and all(spark.conf.get("spark.checkpoint.dir") in f for f in rows.inputFiles())
