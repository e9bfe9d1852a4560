"""Substring and suffix-array dedup against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolith.llm import superkmers as S
from repolith.llm import suffix_dedup as D
from repolith.llm.substring_dedup import dedup_substrings, op1_substring_dedup
from repolith.llm.suffix_dedup import collection_bwt, dedup_suffixes, op8_suffix_dedup

SCHEMA = "doc_id long, text string, row int, spans string, bucket int"


def brute_words(docs, width=50):
    least = {}
    words = {i: (t or "").encode().split() for i, t in docs}
    for i, w in words.items():
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - width + 1):
            if least[tuple(w[p : p + width])] < i:
                gone |= set(range(p, p + width))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest())
    return out


def brute_bytes(docs, width=100):
    least, body = {}, {i: (t or "").encode() for i, t in docs}
    for i, b in body.items():
        for p in range(len(b) - width + 1):
            key = b[p : p + width]
            least[key] = min(least.get(key, (i, p)), (i, p))
    out = {}
    for i, b in body.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if least[b[p : p + width]] < (i, p):
                gone[p : p + width] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture(scope="module")
def awkward():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randint(1, 4)))
    passage = " ".join(word() for _ in range(90))
    docs = [(0, None), (1, ""), (2, "one"), (3, "aa " * 900), (4, "aa  aa\t" * 300), (5, "x" * 2000), (6, "x" * 99)]
    docs += [(10 + i, " ".join(word() for _ in range(r.randint(0, 120))) + " " + passage[: r.randint(100, len(passage))] + " " + " ".join(word() for _ in range(r.randint(0, 70)))) for i in range(25)]
    docs += [(50 + i, docs[9 + i][1]) for i in range(5)] + [(70, docs[8][1] + "\n" + docs[9][1])]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 7, "x", 9) for i, t in docs], SCHEMA).repartition(3)


@pytest.mark.parametrize("block", [500, S.BLOCK])
def test_brute_force(spark, awkward, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    out = dedup_substrings(frame(spark, awkward)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert {r[0]: tuple(r[1:]) for r in out} == brute_words(awkward)
    out = dedup_suffixes(frame(spark, awkward)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r[1:]) for r in out} == brute_bytes(awkward)


def test_given_table(spark, sf):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {r[0]: tuple(r[1:]) for r in op1_substring_dedup(spark, sf).collect()} == brute_words(docs)
    assert {r[0]: tuple(r[1:]) for r in op8_suffix_dedup(spark, sf).collect()} == brute_bytes(docs)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long), (1, long), (None, long), (None, None), (2, long)]
    out = sorted((r["doc_id"] or -1, r["n_removed"]) for r in dedup_substrings(frame(spark, rows)).collect())
    assert out == [(-1, 0), (-1, 200), (1, 0), (1, 0), (2, 200)]
    out = sorted((r["doc_id"] or -1, r["n_removed"]) for r in dedup_suffixes(frame(spark, rows)).collect())
    assert out == [(-1, 0), (-1, len(long)), (1, 0), (1, 0), (2, len(long))]
    assert dedup_substrings(frame(spark, [])).count() == dedup_suffixes(frame(spark, [])).count() == 0


@pytest.mark.parametrize("ids", [(None, None), (5, 5)])
def test_texts_of_one_checksum_keep_their_own_words(spark, ids):
    """Rows that no doc_id tells apart, whose texts have one CRC32: only the one that repeats an earlier document loses words."""
    shared, own = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    word = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    seen = {zlib.crc32(f"{shared} {word(i)}".encode()): word(i) for i in range(100_000)}
    a, b = next((seen[c], word(i)) for i in range(1_000_000) if (c := zlib.crc32(f"{own} {word(i)}".encode())) in seen)
    rows = [(1, shared), (ids[0], f"{shared} {a}"), (ids[1], f"{own} {b}"), (7, "else")]
    assert zlib.crc32(rows[1][1].encode()) == zlib.crc32(rows[2][1].encode())
    out = {r["kept_text"]: r["n_removed"] for r in dedup_substrings(frame(spark, rows)).collect()}
    assert out == {shared: 0, a: 60, rows[2][1]: 0, "else": 0}
    out = {bytes(r["kept"]).decode(): r["n_removed"] for r in dedup_suffixes(frame(spark, rows)).collect()}
    assert out == {shared: 0, f" {a}": len(shared), rows[2][1]: 0, "else": 0}


def test_one_key_for_different_windows(monkeypatch):
    from repolith.llm import substring_dedup as D

    monkeypatch.setattr(D.S, "spread", lambda codes, width: np.zeros(max(0, len(codes) - width + 1), np.uint64))
    tokens = np.array([1, 2, 3, 1, 2, 4, 1, 2, 3])
    z = np.zeros(3, np.int64)
    strings = S.Strings(3, tokens, np.array([0, 3, 6]), z + 1, np.array([5, 6, 7]), z, z, z.astype(np.uint64), z, z > 0)
    assert D.repeats(strings).tolist() == [False, False, True]


def test_transform_and_prefixes():
    r = random.Random(1)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 12))) for _ in range(20)]
    length = np.array([len(t) for t in texts])
    bwt, lcp = collection_bwt(np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16), np.cumsum(length) - length, length, 200)
    rows = sorted((t[p:], i, t[p - 1] if p else 0) for i, t in enumerate(texts) for p in range(len(t) + 1))
    assert bwt.tolist() == [c for _, _, c in rows]
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert lcp.tolist() == [0, *(common(a[0], b[0]) for a, b in zip(rows, rows[1:]))]


@pytest.mark.parametrize("seed", range(5))
def test_once_against_marked_twice(seed):
    """Copies that one block has settled, and one copy with another lead-in in the next block."""
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)).encode()
    passage = word(260)

    def block(many, doc):
        texts = [word(150) + passage + word(150) for _ in range(many)]
        tokens, none = np.frombuffer(b"".join(texts), np.uint8), np.zeros(many, np.int64)
        strings = S.cut(tokens, D._CODE[tokens], none + len(texts[0]), np.arange(many) + doc, none, 100, D.K)
        return S.settle(strings, D.repeats, S.CROWD)[1]

    a, b = block(24, 0), block(1, 100)
    windows = lambda x: [x[p : p + 100].tobytes() for p in range(len(x) - 99)]
    earlier = set(windows(a.tokens))
    want = {p for p, x in enumerate(windows(b.tokens)) if x in earlier}
    b.at = b.at + len(a.tokens)
    both = S.Strings(100, np.concatenate([a.tokens, b.tokens]), *(np.concatenate(x) for x in zip(a.columns(), b.columns())))
    gone = {p for doc, _, lo, hi in zip(*S.settle(both, D.repeats)[0]) if doc == 100 for p in range(lo, hi)}
    assert gone == want and want >= set(range(150, 150 + 161))


def test_repeats_come_from_the_transform(monkeypatch):
    """Every window that is flagged has a row of the transform whose common prefix, or weight, says so."""
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n)).encode()
    passage = word(300)
    texts = [word(120) + passage + word(120) for _ in range(6)] + [passage] * 4 + [word(400)]
    tokens, none = np.frombuffer(b"".join(texts), np.uint8), np.zeros(len(texts), np.int64)
    strings = S.cut(tokens, D._CODE[tokens], np.array([len(t) for t in texts]), np.arange(len(texts)), none, 100, D.K)
    inserted, own = [], D._equal_windows
    monkeypatch.setattr(D, "_equal_windows", lambda few, weight: inserted.append((few, weight)) or own(few, weight))
    flag = D.repeats(strings)
    body = lambda s, i: s.tokens[s.at[i] : s.at[i] + s.n[i] + 99].tobytes()
    weights = {}
    for few, weight in inserted:
        for i, w in enumerate(weight):
            weights[body(few, i)] = weights.get(body(few, i), 0) + w
    flagged = [body(strings, i) for i, part in enumerate(np.split(flag, np.cumsum(strings.n)[:-1])) if part.any()]
    assert set(flagged) <= set(weights) and max(weights.values()) >= 4 and 0 < len(weights) < len(strings)


def test_symbols_that_share_a_hash(monkeypatch):
    tokens = np.frombuffer(b"abcdefghijabcdefghikabcdefghij", np.uint8)
    at = np.array([0, 10, 20])
    assert D._numbered(tokens, at, 10).tolist() in ([1, 2, 1], [2, 1, 2])
    monkeypatch.setattr(D.S, "mix", lambda h: h * np.uint64(0))
    assert D._numbered(tokens, at, 10).tolist() == [1, 2, 1]
    wide = np.array([70_000, 5, 65_536 + 5, 70_000, 0], np.uint32)
    assert D._order(wide).tolist() == [4, 1, 2, 0, 3]


@pytest.mark.parametrize("width", [64, 101, 130])
def test_other_widths(spark, awkward, width):
    out = dedup_suffixes(frame(spark, awkward), width).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert {r[0]: tuple(r[1:]) for r in out} == brute_bytes(awkward, width)


@pytest.mark.parametrize("carried", [1 << 20, 3000])
def test_crowded_minimisers_are_carried(spark, monkeypatch, carried):
    """A passage in every document, in many blocks of one task: later blocks settle theirs against what was carried."""
    monkeypatch.setattr(S, "BLOCK", 20_000)
    monkeypatch.setattr(S, "CARRY", carried)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7)))
    passage = [word() for _ in range(80)]
    docs = [(i, " ".join([word() for _ in range(40)] + passage[r.randint(0, 10) :] + [word() for _ in range(30)])) for i in r.sample(range(10**6), 300)]
    sent = []
    for f, g, brute in ((dedup_substrings, "kept_text", brute_words), (dedup_suffixes, "kept", brute_bytes)):
        one = spark.createDataFrame([(i, t, 7, "x", 9) for i, t in docs], SCHEMA).coalesce(1)
        out = f(one).drop("n_spans")
        own = {i: (x[0], x[1], x[-1]) for i, x in brute(docs).items()}
        assert {x["doc_id"]: (x[[c for c in out.columns if c.startswith("n_")][0]], x["n_removed"], x["sha"]) for x in out.withColumn("sha", F.sha2(g, 256)).collect()} == own
    for k in range(2):  # strings of the passage that are sent by 20 blocks: with carrying, hardly more than by the first
        carry, kept = None, 0
        for lo in range(0, 300, 30):
            texts = [t.encode() for _, t in docs[lo : lo + 30]]
            tokens, none = np.frombuffer(b"".join(texts), np.uint8), np.zeros(len(texts), np.int64)
            strings = S.cut(tokens, D._CODE[tokens], np.array([len(t) for t in texts]), np.array([i for i, _ in docs[lo : lo + 30]]), none, 100, D.K)
            _, left, carry = S.settle(strings, D.repeats, S.CROWD, carry if k else None)
            kept += int(left.n.sum())
        sent.append(kept)
    assert carried < 10_000 or sent[1] < sent[0] - 9 * 150
