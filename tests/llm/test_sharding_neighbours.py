"""Sharding and nearest neighbours: exact sizes, uniform draws, recall against brute force."""

import random
import zlib

import numpy as np
import pytest
import xxhash

from repolith.llm import neighbours as N
from repolith.llm import sharding as H


def test_matrix():
    sizes = [0, 5, 1, 100, 17, 30]
    m = H.draw_matrix(sizes, 4, 1)
    assert m.sum(axis=1).tolist() == sizes and sorted(m.sum(axis=0).tolist()) == [38, 38, 38, 39]
    # The mean over draws is the uniform one.
    mean = np.mean([H.draw_matrix(sizes, 4, s)[3] for s in range(400)], axis=0)
    assert np.allclose(mean, 25, atol=0.6)
    big = H.draw_matrix([10, 10**9, 2 * 10**9][:1] + [20], 3, 1)
    assert big.sum() == 30
    got = H._distinct(np.random.default_rng(1), 50, 50)
    assert got.tolist() == list(range(50))


def check(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))
    sizes = [len(by.get(s, ())) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shards(spark):
    rows = [(i % 40 if i % 7 else None, "same" if i % 3 else None, i % 2, 5) for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard int, part int")
    out = H.shuffle_into_shards(frame, 7, 3).collect()
    assert len(out) == 500 and sorted(map(str, ((r["doc_id"], r["text"], r["part"]) for r in out))) == sorted(map(str, ((a, b, d) for a, b, _, d in rows)))
    check(out, 7)
    assert sorted(map(str, out)) == sorted(map(str, H.shuffle_into_shards(frame.repartition(5), 7, 3).collect()))
    assert H.shuffle_into_shards(frame.limit(0), 7).count() == 0
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    place = {r["doc_id"]: (r["shard"], r["slot"]) for r in H.shuffle_into_shards(ids, 4, 9).collect()}
    # No trace of the old order in the new one.
    order = np.array([i for i, _ in sorted(place.items(), key=lambda x: x[1])])
    assert abs(np.corrcoef(order, np.arange(4000))[0, 1]) < 0.06


def test_query(spark, sf):
    docs = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = H.op7_uniform_shards(spark, sf).collect()
    check(out, 16)
    assert len(out) == len(docs) and all(r["law"] == "rows" and r["grown_shard"] is None for r in out)
    for r in out:
        body = docs[r["doc_id"]].encode()
        assert r["size"] == len(body) + 1 and r["text_crc32"] == zlib.crc32(body)


def brute(vectors, k):
    ids = sorted(i for i, v in vectors.items())
    m = np.array([vectors[i] for i in ids], np.float64)
    out = {}
    for i in ids:
        if i % 20 == 0:
            s = m @ m[ids.index(i)]
            out[i] = [ids[j] for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


def test_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r[0]: np.array(r[1], np.float64) for r in rows.collect()}
    want = brute(vectors, 20)
    got = {}
    for r in N.op9_one_bit_neighbours(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21)) and q not in [r["vec_id"] for r in rows]
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        assert all(abs(r["score"] - vectors[q] @ vectors[r["vec_id"]]) < 1e-12 for r in rows)
        hits += len({r["vec_id"] for r in rows} & set(want[q]))
    assert hits >= 0.99 * 20 * len(want)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(3)]) for i in range(1, 12)]
    rows += [(0, [1.0, 2.0, 3.0]), (20, [0.0, 0.0, 0.0]), (40, None), (60, [1.0, None, 2.0]), (80, [nan, 1.0, 1.0]), (100, [inf, 1.0, 1.0]), (120, [1.0, 2.0]), (121, [3.0, 1.0]), (140, []), (None, [1.0, 1.0, 1.0])]
    rows += [(13, [5.0, 5.0, 5.0]), (12, [5.0, 5.0, 5.0]), (12, [5.0, 5.0, 5.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "id long, vector array<double>, block int")
    out = N.search(frame, frame.where("id % 20 = 0"), 20).orderBy("query_id", "rank").collect()
    assert [x["query_id"] for x in out] == [0] * 13 + [120] and [x["vec_id"] for x in out[:2]] == [12, 13] and out[-1]["vec_id"] == 121
    assert N.search(frame.limit(0), frame).count() == N.search(frame, frame.limit(0)).count() == 0
    few = N.search(frame, frame.where("id = 3"), 2).collect()
    assert [x["rank"] for x in few] == [1, 2]


def test_codes_bound_the_error():
    rng = np.random.default_rng(3)
    v, q = rng.standard_normal((2000, 32)), rng.standard_normal((20, 32))
    turn = N.rotation(32)
    codes, scales = N.encode(v, turn)
    guess, error = N.estimate(codes, scales, q, turn, 3.0)
    off = np.abs(guess - q @ v.T) / np.linalg.norm(q, axis=1)[:, None]
    assert codes.shape == (2000, 4) and (off <= error[None, :]).mean() > 0.99
    assert abs((guess - q @ v.T).mean()) < 0.1


def test_query_shuffles_whole_documents(spark, sf, monkeypatch):
    seen, own = [], H.shuffle_into_shards
    monkeypatch.setattr(H, "shuffle_into_shards", lambda rows, *a, **k: seen.append(rows.columns) or own(rows, *a, **k))
    H.op7_uniform_shards(spark, sf)
    assert seen == [spark.read.parquet(f"{sf}/documents.parquet").columns]


def test_groups_of_blocks_and_queries(spark, monkeypatch):
    """Many small blocks of both sides, ties and copies: as good as brute force where the bound is wide."""
    monkeypatch.setattr(N, "FIRST", 3)
    rng = np.random.default_rng(5)
    vectors = {i: rng.standard_normal(16).round(2) for i in range(400)}
    for i in range(100, 140):
        vectors[i] = vectors[100]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "id long, vector array<double>")
    got = {}
    for r in N.search(frame, frame.where("id % 20 = 0"), 20, epsilon=9.0, block_rows=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    for q, found in got.items():
        want = sorted(((-round(float(vectors[q] @ v), 9), i) for i, v in vectors.items() if i != q))[:20]
        assert [s for _, s in found] == [-s for s, _ in want] and len(found) == 20
    assert len(got) == 20


def test_long_vectors_make_small_blocks(spark, monkeypatch):
    """1,536 dimensions: no packed block outgrows its bytes by much, and at least 0.9 of the nearest are found."""
    rng = np.random.default_rng(5)
    middle = rng.standard_normal((40, 1536))
    rows = [(i, (middle[i % 40] + 0.7 * rng.standard_normal(1536)).round(3).tolist()) for i in range(2000)]
    frame = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    made, own = [], N.build_index
    monkeypatch.setattr(N, "build_index", lambda *a: made.append(own(*a)) or made[-1])
    got = N.search(frame, frame.where("id % 20 = 0")).collect()
    assert made[0].selectExpr("max(length(vectors))").first()[0] < 2 * N.BYTES
    vectors = np.array([v for _, v in rows])
    hit = 0
    for q in range(0, 2000, 20):
        score = vectors @ vectors[q]
        score[q] = -np.inf
        hit += len({int(i) for i in np.argsort(-score, kind="stable")[:20]} & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hit >= 0.9 * 20 * 100 and len(got) == 2000


def plain_shards(rows, n, shards=H.SHARDS, seed=H.SEED):
    """shard and slot of each row, row by row: parts by one hash, the drawn matrix dealt out by a second, cells by a third."""
    long = lambda h: h - (1 << 64) if h >> 63 else h

    def hashed(*values):
        h = 42
        for v in values:
            if v is not None:
                h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, h)
        return long(h)

    number = lambda v: None if v is None else v.to_bytes(8, "little", signed=True)
    keys = [[hashed((seed + i).to_bytes(4, "little"), *(number(v) if isinstance(v, int) else v for v in r)) for i in range(3)] for r in rows]
    of = {}
    for i, (h0, _, _) in enumerate(keys):
        of.setdefault(h0 % n, []).append(i)
    groups = {}
    for p in sorted(of):
        groups.setdefault(p // H.GROUP, []).append(p)
    drawn = H.draw_matrix([sum(len(of[p]) for p in ps) for ps in groups.values()], shards, seed)
    matrix = [row for (g, ps), places in zip(groups.items(), drawn, strict=True) for row in H.draw_group(g, [len(of[p]) for p in ps], places.tolist(), seed)]
    held = [[] for _ in range(shards)]
    for p, to in zip(sorted(of), matrix, strict=True):
        mine = iter(sorted(of[p], key=lambda i: (keys[i][1], keys[i][0])))
        for shard, count in enumerate(to):
            held[shard] += [next(mine) for _ in range(count)]
    cells = max(1, n // shards)
    cell = lambda i: hashed((seed + 3).to_bytes(4, "little"), number(keys[i][2])) % cells
    return {i: (shard, slot) for shard, some in enumerate(held) for slot, i in enumerate(sorted(some, key=lambda i: (cell(i), keys[i][2])))}


@pytest.mark.parametrize("part,group", [(50_000, 1024), (7, 1024), (7, 4)])
def test_query_against_a_plain_version(spark, sf, monkeypatch, part, group):
    monkeypatch.setattr(H, "PART", part)
    monkeypatch.setattr(H, "GROUP", group)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain_shards(rows, max(4, -(-len(rows) // part)))
    out = {r["doc_id"]: r for r in H.op7_uniform_shards(spark, sf).collect()}
    assert len(out) == len(rows)
    for i, (doc_id, text, *_) in enumerate(rows):
        r, body = out[doc_id], (text or "").encode()
        assert (r["shard"], r["slot"]) == want[i] and (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 1, zlib.crc32(body), "rows", None)
