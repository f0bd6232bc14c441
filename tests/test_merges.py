"""Hybrid merges against plain loops over one user's lists."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from recoflux.config import EngineConfig
from recoflux.plans import merges

WEIGHTS = EngineConfig().weights


def rows_of(spark, by_user):
    rows = [(u, a, k + 1, p, [float(90 - k)]) for u, lists in by_user.items() for a, items in lists.items() for k, p in enumerate(items)]
    return spark.createDataFrame(rows, "user string, algorithm string, rank int, product string, score array<double>").repartition(3)


def merged(spark, by_user, name, n, weights=None, fill_in=None, seed=7):
    lists = rows_of(spark, by_user)
    out = merges.filled(merges.merge(lists, name, weights or WEIGHTS[name], n, seed), lists, fill_in, n).orderBy("user", "rank").collect()
    found = {}
    for r in out:
        found.setdefault(r.user, []).append((r.product, r.tags[0], r.score[0]))
        assert r["rank"] == len(found[r.user])
    return found


def plain_chunks(lists, weights, n):
    out, sizes = [], merges.chunk_sizes(weights)
    while len(out) < n:
        before = len(out)
        for a, size in sizes.items():
            out += [(p, a) for p in lists.get(a, ()) if p not in {q for q, _ in out}][:size]
        if len(out) == before:
            break
    return out[:n]


def plain_votes(lists, weights, n):
    value = {}
    for a, w, _ in weights:
        for k, p in enumerate(lists.get(a, ())[:n]):
            value[p] = value.get(p, 0) + max(1000, n) * w * 2 ** (-k / 4)
    order, out = sorted(value, key=lambda p: (round(value[p], 9), p), reverse=True)[:n], []
    for k, p in enumerate(order):
        if k % 8 == 0:
            for a, _, takes in weights:
                if takes and k // 8 < len(lists.get(a, ())) and lists[a][k // 8] not in out:
                    out.append(lists[a][k // 8])
        if p not in out:
            out.append(p)
    return [(p, str(len(order) - k)) for k, p in enumerate(out)][:n]


def plain_draws(user, lists, weights, n, seed):
    out = []
    for k in range(1, n + 1):
        left = [next((p for p in lists.get(a, ()) if p not in {q for q, _ in out}), None) for a, *_ in weights]
        parts = [w if p else 0.0 for (_, w, _), p in zip(weights, left)]
        roll, so_far = int(hashlib.md5(f"{seed}/{user}/{k}".encode()).hexdigest()[:8], 16) / 2**32 * sum(parts), 0.0
        for (a, *_), part, p in zip(weights, parts, left):
            so_far += part
            if so_far > roll:
                out.append((p, a))
                break
    return out


@pytest.fixture(scope="module")
def users():
    r = random.Random(12)
    names = [f"p{k}" for k in range(40)]
    made = lambda: r.sample(names, r.choice([0, 1, 5, 12, 25]))
    return {f"u{k}": {a: made() for a in ("UBCF", "PBCF", "CB", "POP")} for k in range(25)}


@pytest.mark.parametrize("name, plain", [("HRChunks", lambda u, x, n: plain_chunks(x, WEIGHTS["HRChunks"], n)), ("HRVoting", lambda u, x, n: plain_votes(x, WEIGHTS["HRVoting"], n)), ("HRRandom", lambda u, x, n: plain_draws(u, x, WEIGHTS["HRRandom"], n, 7))])
def test_merges_and_fill_in(spark, users, name, plain):
    for n in (6, 30):
        out = merged(spark, users, name, n, fill_in="POP")
        for u, lists in users.items():
            expected = plain(u, lists, n)
            expected += [(p, "POP") for p in lists["POP"] if p not in {q for q, _ in expected}][: max(0, n - len(expected))]
            assert [(p, t) for p, t, _ in out.get(u, [])] == expected[:n]


def test_fixed_orders(spark):
    """fixed values: the two published orders of merges with these weights"""
    lists = {"a": {"UBCF": [f"U{k}" for k in range(1, 6)], "PBCF": [f"P{k}" for k in range(1, 5)], "CB": [f"C{k}" for k in range(1, 10)]}}
    assert [p for p, *_ in merged(spark, lists, "HRChunks", 20)["a"]] == "U1 P1 C1 C2 U2 P2 C3 C4 U3 P3 C5 C6 U4 P4 C7 C8 U5 C9".split()
    lists = {"a": {"UBCF": list("abcde"), "PBCF": list("fbdg"), "CB": list("ghcdijklm")}}
    assert [p for p, *_ in merged(spark, lists, "HRVoting", 20)["a"]] == list("fgdchbiajklme")


def test_weights_and_scores(spark):
    assert merges.chunk_sizes([("a", 0.3, True), ("b", 0.45, True)]) == {"a": 2, "b": 3}
    lists = {"u": {"x": ["p", "q"], "y": ["q", "r", "s"]}}
    weights = [("x", 0.6, False), ("y", 0.4, True)]
    assert merged(spark, lists, "HRChunks", 4, weights)["u"] == [("p", "x", 90.0), ("q", "x", 89.0), ("r", "y", 89.0), ("s", "y", 88.0)]
    first, *rest = merged(spark, lists, "HRVoting", 4, weights)["u"]
    assert first == ("q", "4", 90.0) and [p for p, *_ in rest] == ["p", "r", "s"]
    with pytest.raises(KeyError):
        merges.merge(rows_of(spark, lists), "HRUnheard", weights, 4, 1)


def test_draws_follow_the_weights(spark):
    lists = {f"u{k}": {"UBCF": ["a"], "PBCF": ["b"], "CB": ["c"]} for k in range(2000)}
    first = [v[0][0] for v in merged(spark, lists, "HRRandom", 1).values()]
    assert abs(first.count("c") / 2000 - 0.5) < 0.05 and abs(first.count("a") / 2000 - 0.25) < 0.05
    assert rows_of(spark, lists).where(F.col("algorithm") == "POP").count() == 0
