"""Periodic runs against brute force."""

import hashlib
import random
import time
import zlib

import pytest
from fractions import Fraction

from repolith.llm import periodic_runs as R


def brute(words):
    """All maximal stretches of a smallest period q, of max(6, 4q) words or more, by comparing every word with the one q before it."""
    out = set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(all(words[k] == words[k + d] for k in range(i, i + n - d)) for d in range(1, q)):
                out.add((i, n, q))
            i = j + 1
    return sorted(out)


@pytest.mark.parametrize("seed", range(5))
def test_runs_of_odd_texts(seed):
    rng = random.Random(seed)
    for _ in range(400):
        few = rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(few) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            if len(words) > 4:
                a, p = rng.randrange(len(words)), rng.randrange(1, 8)
                words[a:a] = (words[a : a + p] * 9)[: rng.randrange(4, 40)]
        assert sorted(R.stretch_runs(words)) == brute(words)
        assert R.runs_of([str(w).encode() for w in words]) == brute(words)


def test_hard_texts_take_near_linear_time():
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    rng = random.Random(3)
    for words in ([1] * 20_000, b, [rng.randrange(2) for _ in range(20_000)], [rng.randrange(3000) for _ in range(2000)] * 10, list(range(7)) * 3000):
        began = time.process_time()
        R.runs_of([str(w).encode() for w in words])
        assert time.process_time() - began < 5


def test_filter_by_itself(monkeypatch):
    """One round of the filter, or hashes that all collide, change nothing."""
    rng = random.Random(9)
    texts = [[str(rng.randrange(4)).encode() for _ in range(50)] + [b"x", b"y"] * rng.randrange(6) for _ in range(50)]
    want = [R.runs_of(t) for t in texts]
    monkeypatch.setattr(R, "ROUNDS", 1)
    assert [R.runs_of(t) for t in texts] == want
    monkeypatch.setattr(R, "_nearest", lambda keys, places: keys * 0)
    assert [R.runs_of(t) for t in texts] == want == [brute(t) for t in texts]


def test_documents(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b " * 5), (4, "a b " * 5), (None, "z" * 10), (None, "x\u00a0 x\u00a0\tx\u00a0 x\u00a0 x\u00a0 x\u00a0 end"), (7, "no runs here at all, none"), (8, "\u3000 " * 300_000)]
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, n_words int, runs string")
    out = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed_text"]) for r in R.find_runs(docs).collect()), key=str)
    assert out == sorted([(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 10, [(0, 10, 2)], "a b"), (4, 10, [(0, 10, 2)], "a b"), (0, 1, [], "z" * 10), (0, 7, [(0, 6, 1)], "x\u00a0 end"), (7, 6, [], rows[7][1]), (8, 300_000, [(0, 300_000, 1)], "\u3000")], key=str)
    assert R.find_runs(docs.limit(0)).count() == 0


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words) if n < 1500 else R.runs_of(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query(spark, sf):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = {r["doc_id"]: tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in R.op12_periodic_runs(spark, sf).collect()}
    want = {i: expected(i, t) for i, t in docs}
    assert out == want and sum(v[0] for v in want.values()) > 5
