"""Near copies by similarity against brute force."""

import random

import pytest

import corpus_pipeline as C
from repolith.llm import near_texts as N

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_sets(texts, k=5):
    words = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)} for w in words]


def brute_kept(docs):
    ids, sets = [d for d, _ in docs], brute_sets([t for _, t in docs])
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return {min(g) for g in groups.values()}


@pytest.fixture(scope="module")
def edited():
    """Pairs at similarities on both sides of 0.8, as fingerprints cannot tell them."""
    r = random.Random(4)
    docs = []
    for i in range(60):
        w = [f"w{r.randrange(10**6)}" for _ in range(120)]
        other = list(w)
        for p in range(10, 120, 110 // (1 + i % 6) + 1):
            other[p] = f"v{r.randrange(10**6)}"
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    return docs


def test_stage_keeps_and_drops_by_similarity(spark, sf, edited):
    frame = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in edited], SCHEMA).repartition(3)
    assert {r["doc_id"] for r in C.drop_near_duplicates(spark, frame, sf).collect()} == brute_kept(edited)
    assert 60 < len(brute_kept(edited)) < 120


def test_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in C.drop_near_duplicates(spark, docs, sf).collect()}
    assert kept == brute_kept([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_tiles(spark, edited, monkeypatch):
    """A crowd larger than a tile: copies of one text with one word changed, all candidates of each other."""
    monkeypatch.setattr(N, "TILE", 3000)
    w = edited[0][1].split()
    docs = [(i, " ".join([*w[:i], "x", *w[i + 1 :]])) for i in range(30)] + [(None, edited[0][1]), (40, None), (41, " ")]
    out = {(r["doc_id"], r["component_id"]) for r in N.near_texts(spark.createDataFrame(docs, "doc_id long, text string"), 5, 6).collect()}
    assert out == {(i, 0) for i in range(30)} | {(None, 0), (40, 40), (41, 40)}


def test_exact_bound():
    sets = brute_sets(["a b c d e f g h"])
    assert len(sets[0]) == 4
    import numpy as np

    a = np.arange(9, dtype=np.uint64)
    assert N.similar([a, a[:7]]) == [] and N.similar([a[:5], a[:4]]) == [(0, 1)]

def test_hot_keys_are_dealt_out(spark):
    """A text with half of all rows: its rows and its root lie in several partitions, and nothing is lost or doubled."""
    from pyspark.sql import functions as F

    from repolith.llm.common import join_dealt

    rows = spark.range(2000).select(F.col("id").alias("doc"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("node"))
    few = rows.select("node").distinct().where("node != 9").withColumn("v", F.col("node") * 2)
    for how in ("left", "inner"):
        out = join_dealt(rows, few, "node", "doc", how)
        want = {(d, 7 if d % 2 == 0 else d) for d in range(2000)}
        want = {(d, n, None if n == 9 else 2 * n) for d, n in want if how == "left" or n != 9}
        got = [tuple(r) for r in out.select("doc", "node", "v").collect()]
        assert len(got) == len(want) and set(got) == want
    assert join_dealt(rows.limit(0), few, "node", "doc").count() == 0


def test_copies_of_one_text(spark, edited):
    """Half of all rows are one text: all get its component, ids repeated and missing too."""
    base = edited[0][1]
    docs = [(i, base) for i in range(300, 600)] + [(None, base), (300, base), (7, base + " tail")] + [(1000 + i, t) for i, t in edited[2:]]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    out = {}
    for r in N.near_texts(frame, 5, 6).collect():
        out.setdefault(r["doc_id"], []).append(r["component_id"])
    assert all(out[i] == [7] * (2 if i == 300 else 1) for i in range(300, 600)) and out[None] == [7] and out[7] == [7]
    assert {d for d, c in out.items() if d is not None and d >= 1000 and d in c} == {1000 + d for d in brute_kept(edited[2:])}


@pytest.mark.parametrize("level", [0.8, 0.85, 0.9])
def test_planted_edits_are_found(spark, sf, level):
    """Copies of the given texts with words replaced until their similarity is just above the level: all must meet."""
    r = random.Random(9)
    given = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    long = [(d, t.encode().lower().split()) for d, t in given if t and len(t.split()) >= 60]
    pairs, planted = [], []
    for i, (d, w) in enumerate(r.sample(long, min(len(long), 40))):
        w = [x.decode() for x in w]
        whole, other = brute_sets([" ".join(w)])[0], list(w)
        for p in r.sample(range(len(w)), len(w)):
            old, other[p] = other[p], f"edit{r.randrange(10**6)}"
            b = brute_sets([" ".join(other)])[0]
            if len(whole & b) < level * len(whole | b):
                other[p] = old
                break
        pairs.append((d, 10**9 + i))
        planted.append((10**9 + i, " ".join(other)))
    found = N.near_texts(spark.createDataFrame(given + planted, "doc_id long, text string"), 5, 6).collect()
    group = {x["doc_id"]: x["component_id"] for x in found}
    assert len(pairs) == 40 and sum(group[a] == group[b] for a, b in pairs) >= 0.97 * len(pairs)
