"""The pipeline's stages on small tables: what goes, what stays, and what the packed ids say."""

import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


def brute_groups(rows):
    """The smallest id of each group that links of a five-word similarity of 0.8 or more join, as the stage's contract says."""
    rows, root = list(rows), {}
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in words]

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return {min(g) for g in groups.values()}


def test_whole(spark, sf, docs):
    left = docs
    for name, stage in C.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in left.collect()}
        left = stage(spark, left, sf)
        assert left.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in left.collect()}
        assert set(after) <= set(before)
        if name == "language_id":
            assert set(after) == {d for d, t in before.items() if t and any(map(str.isalpha, t))}
        if name == "simhash_near_dedup":
            assert set(after) == brute_groups(before.items())
        if name in ("language_id", "simhash_near_dedup"):
            assert all(after[d] == before[d] for d in after)
        if name == "pii":
            assert set(after) == set(before) and len("".join(after.values())) > 0
            found = re.findall(r"\+1 \(\d{3}\) 555-\d{4}", "\n".join(before.values()))
            assert not [x for x in found if x in "\n".join(after.values())]
        left = spark.createDataFrame(left.collect(), left.schema)
    model, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for d, t in after.items():
        want[d] = [*model.encode(t, add_special_tokens=False).ids, 0]
    got: dict[int, list] = {}
    for x in sorted(C.run(spark, sf).collect(), key=lambda x: (x["doc_id"], x["start"])):
        got.setdefault(x["doc_id"], []).extend(np.frombuffer(x["ids"], "<u4").tolist())
    assert got == want


def test_edges(spark, sf):
    rows = [(1, "a b c d e f g", None, "s", 1), (1, "a b c d e f g", None, "s", 1), (2, "a b c d e f g", "en", None, None), (3, None, "en", "s", 0), (4, "12 34", "en", "s", 0), (5, "", "en", "s", 0), (None, "x y z", "en", "s", 0), (None, "a b c d e f g", "en", "s", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = C.identify_language(spark, frame, sf)
    assert sorted((r["doc_id"] or -1) for r in found.collect()) == [-1, -1, 1, 1, 2]
    one = C.drop_near_duplicates(spark, found, sf)
    assert sorted(((r["doc_id"] or -1), r["text"]) for r in one.collect()) == [(-1, "a b c d e f g"), (-1, "x y z"), (1, "a b c d e f g"), (1, "a b c d e f g")]
    for _, stage in C.STAGES:
        assert stage(spark, frame.limit(0), sf).count() == 0
    assert set(C.decontaminate_benchmark(spark, frame, sf).columns) == set(frame.columns)
    assert C.mask_private_data(spark, frame, sf).count() == len(rows)


def test_predicted_language_takes_effect(spark, sf, docs):
    known = [r for r in docs.collect() if r["text"] and len(r["text"]) > 400 and r["lang"]]
    one = known[0]
    other = next(r["lang"] for r in known if r["lang"] != one["lang"])
    wrong = spark.createDataFrame([*known, (10**6, one["text"], other, "s", 1)], SCHEMA)
    found = {r["doc_id"]: r["lang"] for r in C.identify_language(spark, wrong, sf).collect()}
    assert found[10**6] == one["lang"]
