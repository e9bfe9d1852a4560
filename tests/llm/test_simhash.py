"""SimHash near-dedup against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from repolith.llm import simhash as H


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, radius=4):
    """rows: (id, fp) -> smallest reachable id of each row."""
    root = {fp: fp for _, fp in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    prints = list(root)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for d, fp in rows:
        least[find(fp)] = min(d, least.get(find(fp), d))
    return [(d, f"{fp:016x}", least[find(fp)]) for d, fp in rows]


@pytest.mark.parametrize("radius", [1, 3, 4, 6])
def test_close_pairs(radius):
    r = random.Random(radius)
    centres = [r.getrandbits(64) for _ in range(40)]
    fp = sorted({c ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 9))) & (1 << 64) - 1 for c in centres for _ in range(8)})
    group = np.sort(np.array([r.randrange(1 + len(fp) // 20) for _ in fp]))
    found = {(int(i), int(j)) for a, b in H.close_pairs(np.array(fp, np.uint64).view(np.int64), group, radius) for i, j in zip(a, b)}
    assert found == {(i, j) for j in range(len(fp)) for i in range(j) if group[i] == group[j] and (fp[i] ^ fp[j]).bit_count() <= radius}


def test_tables_bring_close_prints_together():
    for n in (10, 10**7, 10**9):
        masks = H.tables(n, 4)
        r = random.Random(n)
        for _ in range(300):
            a = r.getrandbits(64)
            b = a
            for _ in range(4):
                b ^= 1 << r.randrange(64)
            assert any(a & m == b & m for m in masks)


@pytest.mark.parametrize("tile,rows", [(H.TILE, H.ROWS), (5, 16)])
def test_brute_force(spark, monkeypatch, tile, rows):
    monkeypatch.setattr(H, "TILE", tile)
    monkeypatch.setattr(H, "ROWS", rows)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcÉ") for _ in range(3))
    base = [[word() for _ in range(300)] for _ in range(6)]
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one  TWO"), (5, "É A b c d"), (5, "É A b c d"), (6, "é a b c d")]
    for i in range(60):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(300)] = word()
        docs.append((100 + i, " ".join(w)))
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, fp int, component int").repartition(3)
    out = sorted((x[0], f"{x[1] & (1 << 64) - 1:016x}", x[2]) for x in H.near_duplicates(frame).collect())
    assert out == sorted(brute_groups([(d, brute_print(t)) for d, t in docs]))


def test_chain_star_and_edges(spark):
    pairs = [(i + 1, i) for i in range(40)] + [(i, 100) for i in range(101, 160)]
    out = {r[0]: r[1] for r in H.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert H.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a"), (None, "b b b b b"), (3, "a")], "doc_id long, text string")
    assert sorted((r[0] or -1, r[2] or -1) for r in H.near_duplicates(rows).collect()) == [(-1, -1), (-1, 3), (3, 3)]


def test_given_table(spark, sf):
    docs = [(r[0], brute_print(r[1])) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, H.op2_simhash_near_dedup(spark, sf).collect())) == sorted(brute_groups(docs))
