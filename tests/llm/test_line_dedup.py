"""Line dedup against brute force."""

import hashlib
import random
import string

import pytest
from pyspark.sql import functions as F

from repolith.llm import line_dedup as D

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(docs):
    key = lambda line: line.strip(D.BLANK).translate(LOW)
    at = lambda i: (1 << 63) - 1 if i is None else i
    owner = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                owner[key(line)] = min(owner.get(key(line), at(i)), at(i))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if owner.get(key(x), at(i)) >= at(i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], "doc_id long, text string, pos int, gone string, owner string").repartition(3)


def found(docs, batches=D.BATCHES):
    return sorted((tuple(r) for r in D.dedup_lines(docs, batches).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()), key=str)


ODD = [
    (5, "A shared line of text\nown line of five here\n\nshort\nshort"), (2, "  a SHARED line of text\t\r\nshort\n"), (9, "a shared line of text\na shared line of text"),
    (7, None), (8, ""), (3, "Ééééééééé\nééééééééé1"), (4, "Ééééééééé0\nééééééééé1\néééééééé 1"), (None, "a shared line of text\nonly without a number"), (None, "only without a number\nelse"), (None, None),
    (11, "two rows, one number\nfirst of them"), (11, "two rows, one number\nsecond"), (11, "two rows, one number\nsecond"), (12, "two rows, one number\x0b\nx\r\n"), (13, "a b c d e f \na b c d e f"), (14, "a b c d e f "),
]


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_odd_rows(spark, batches):
    assert found(frame(spark, ODD), batches) == brute(ODD)


def test_edges(spark):
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(None, None)] * 3)) == brute([(None, None)] * 3)
    long = "\n".join(f"line number {i % 70_000}" for i in range(100_000))
    docs = [(1, long), (2, long), (3, "line number 5\n" * 50_000)]
    assert found(frame(spark, docs)) == brute(docs)


def test_random_batches_with_a_line_that_most_documents_hold(spark):
    rng = random.Random(4)
    docs = [(rng.randrange(10**6), "\n".join(rng.choice(["a line that most hold", f"line {rng.randrange(400):09d}", "no", ""]) for _ in range(rng.randrange(9)))) for _ in range(1500)]
    assert found(frame(spark, docs), 9) == brute(docs)


def test_runs_are_levelled_and_not_moved(spark):
    runs = D.LineRuns(spark)
    lines = lambda a, b: spark.range(a, b).select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"), F.col("id").alias("doc"))
    for i in range(7):
        runs.add(lines(50 * i, 50 * i + 100))
        assert all(len(level) < D.FAN for level in runs.levels)
    assert [len(level) for level in runs.levels] == [1, 1, 1] and runs.owners().count() == runs.owners().select("h1", "h2").distinct().count() == 400
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = runs.unknown(lines(0, 10))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange") == 1 and "hashpartitioning(h1" in plan


def test_query(spark, sf):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in D.op13_line_dedup(spark, sf).collect()), key=str)
    assert got == brute(docs) and sum(r[2] for r in got) > 5
