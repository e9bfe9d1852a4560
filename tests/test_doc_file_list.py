"""A repository's list of documenting files: each once, in order, whole, with its first three, however long it is."""

import itertools

from pyspark.sql import functions as F

from repolith.operators import summary
from repolith.plans.queries import QUERIES
from repolith.sources.lens import Lens


def plain(entries):
    """(repo_key, path, type, place, preview) of (repo_key, path, type), by a plain sort."""
    out = []
    key = lambda e: (e[1] is None, (e[1] or "").lower(), e[2], e[1] or "")
    for repo, group in itertools.groupby(sorted(set(entries), key=lambda e: (e[0] is None, e[0] or "")), key=lambda e: e[0]):
        listed = sorted(group, key=key)
        preview = ", ".join(p for _, p, _ in listed[:3] if p is not None)
        out += [(repo, path, kind, place, preview) for place, (_, path, kind) in enumerate(listed, 1)]
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.select("repo_key", "path", "type", "place", "preview").collect()), key=str)


def test_the_query_lists_every_file_in_order(spark, sf):
    files = Lens(spark, sf).files.select("repo_key", "path", "seq").collect()
    want = plain([(r["repo_key"], r["path"], "a" if r["seq"] % 2 == 0 else "b") for r in files])
    assert found(QUERIES["w11_doc_file_list"](spark, sf)) == want
    assert len(want) == len(files) and any(path.startswith("src/") for _, path, *_ in want)


def test_odd_entries(spark):
    entries = [("r", "b", "y"), ("r", "B", "x"), ("r", "b", "x"), ("r", "b", "x"), ("r", "A", "z"), ("r", "a", "z"), ("r", None, "a"), ("r", "é", "a"), ("r", "", "a"), ("one", None, "a"), (None, "q", "a"), (None, "p", "a")]
    assert found(summary.doc_file_list(spark.createDataFrame(entries * 2, "repo_key string, path string, type string"))) == plain(entries)


def test_a_long_list_is_numbered_in_parts(spark):
    """A hundred thousand files of one repository and of none, each twice, among small ones: places of a plain sort, and no part is most of a list."""
    rows = spark.range(220_000).selectExpr("CASE WHEN id < 100000 THEN 'o/hot' WHEN id >= 120000 THEN NULL ELSE concat('o/r', id % 7000) END AS repo_key", "concat(CASE WHEN id % 2 = 0 THEN 'P' ELSE 'p' END, id % 50000 * 7919 % 50021, '/x') AS path", "CASE id % 3 WHEN 0 THEN 'a' ELSE 'b' END AS type")
    entries = rows.union(rows.orderBy(F.desc("path")))
    assert found(summary.doc_file_list(entries)) == plain([tuple(r) for r in rows.collect()])
    order = F.struct(F.lower("path").alias("low"), F.col("type"), F.col("path"))
    cut = summary.cut_in_parts(summary.doc_file_rows(entries), "repo_key", order)
    sizes = {}
    for r in cut.groupBy("repo_key", "part").count().collect():
        sizes.setdefault(r["repo_key"], []).append(r["count"])
    for repo in ("o/hot", None):
        assert len(sizes[repo]) > 8 and max(sizes[repo]) < sum(sizes[repo]) / 3
