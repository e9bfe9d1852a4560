"""What the physical plans of the jobs must and must not hold."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from repolith.operators import activity, files as fl, summary
from repolith.plans import jobs
from repolith.plans.queries import QUERIES
from repolith.sources.lens import Lens
from repolith.sources.snapshot import SETTINGS, write_snapshot

CHECKS = ("preprocessing", "install", "usage", "api_docs", "comments")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan()


def walk(node):
    yield node
    children = node.children()
    for i in range(children.size()):
        yield from walk(children.apply(i))
    if "AdaptiveSparkPlan" in node.nodeName():
        yield from walk(node.initialPlan())


def named(frame, *names):
    return [n for n in walk(plan(frame)) if n.nodeName() in names]


def columns(node):
    out = node.output()
    return [out.apply(i).name() for i in range(out.size())]


@pytest.fixture(scope="module")
def snapshot(spark, sf):
    """The lens's files as a snapshot on disk, in a session that has its settings."""
    t = Lens(spark, sf)
    for k, v in (SETTINGS | {"spark.sql.autoBroadcastJoinThreshold": "-1"}).items():
        spark.conf.set(k, v)
    yield write_snapshot(f"snap_{uuid.uuid4().hex}", t.files, t.files, 4)
    for k in (*SETTINGS, "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.unset(k)


JOBS = [n for n in QUERIES if re.match(r"b\d+_", n)]


@pytest.mark.parametrize("name", JOBS)
def test_jobs_stay_in_the_engine(spark, sf, name):
    """No Python but the docstrings' parser, no product of tables, no generated code that grew past its limit."""
    frame = QUERIES[name](spark, sf)
    text = plan(frame).toString()
    python = re.findall(r"(?:ArrowEvalPython|BatchEvalPython|MapInPandas|MapInArrow|FlatMapGroupsInPandas)[^\n]*", text)
    assert all("ArrowEvalPython" in p for p in python) and len(python) <= (1 if name.startswith("b1_") else 0)
    # The lens itself multiplies labels by three models, and nothing else is multiplied.
    assert "CartesianProduct" not in text and text.count("BroadcastNestedLoopJoin") == text.count("/labels.parquet]")


@pytest.mark.parametrize("check", CHECKS)
def test_texts_are_below_no_window(spark, sf, check):
    """Budgets are windows over sizes: nothing that a window reads has a column of text."""
    t = Lens(spark, sf)
    windows = named(jobs.build_payloads(t.files.drop("content"), t.files, check), "Window")
    assert windows and not any({"content", "text", "_book"} & set(columns(w)) for w in windows)


@pytest.mark.parametrize("check", CHECKS)
def test_contents_of_a_snapshot_are_not_moved(spark, sf, snapshot, check):
    t = Lens(spark, sf)
    plain = jobs.build_payloads(t.files.drop("content"), t.files, check)
    assert any({"content", "_chars"} & set(columns(e)) for e in named(plain, "Exchange"))  # of tables that lie anyhow they are
    frame = jobs.build_payloads(snapshot.files, snapshot.contents, check)
    moved = named(frame, "Exchange", "BroadcastExchange")
    assert not any({"content", "text", "_book", "n_chars", "_chars"} & set(columns(e)) for e in moved)
    assert check == "install" or not [e for e in moved if "path" in columns(e)]


def test_contents_of_the_flagship_are_not_moved(snapshot):
    frame = jobs.api_docs_verdicts(snapshot.files, snapshot.contents)
    assert not any({"content", "d"} & set(columns(e)) for e in named(frame, "Exchange", "BroadcastExchange"))


@pytest.mark.parametrize("check", CHECKS)
def test_rows_of_a_snapshot(spark, sf, snapshot, check):
    """As without one; with every repository of some size among the large ones, too."""
    t = Lens(spark, sf)
    want = sorted(map(tuple, jobs.build_payloads(t.files.drop("content"), t.files, check).select("repo_key", "payload", "n_files", "n_chars").collect()))
    assert sorted(map(tuple, snapshot.each(lambda f, c: jobs.build_payloads(f, c, check)).select("repo_key", "payload", "n_files", "n_chars").collect())) == want


def test_large_repositories_have_tables_of_their_own(spark, sf, snapshot):
    t = Lens(spark, sf)
    split = write_snapshot(f"snap_{uuid.uuid4().hex}", t.files, t.files, 4, large=30_000)
    assert split.large_contents.count() > 0 and split.contents.count() > 0
    verdicts = lambda s: sorted(map(str, s.each(jobs.api_docs_verdicts).collect()))
    assert verdicts(split) == verdicts(snapshot) != []


def test_activity_is_read_and_moved_once(spark, sf):
    t = Lens(spark, sf)
    frame = jobs.audit_maintenance(t.papers, t.meta, t.files.drop("content"), t.activity, "2024-01-31")
    assert plan(frame).toString().count("/events.parquet]") == 1
    board = activity.scoreboard(t.activity, "2024-01-31")
    rows = [e for e in named(board, "Exchange") if "event_id" in columns(e)]
    assert len(rows) == 1


def tasks_of(frame, key):
    """Rows in each task of what ``frame``'s last exchange of rows deals out."""
    return sorted(r["n"] for r in frame.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())


def test_a_hot_repository_is_many_tasks(spark):
    """A million issues of one repository: each share is a small part, and the answer is that of a plain sort."""
    rows = spark.range(1_050_000, numPartitions=8).selectExpr("CASE WHEN id < 1000000 THEN 'hot' ELSE concat('r', id % 5000) END AS repo_key", "timestamp_seconds(1700000000 + (id * 7919) % 1048576) AS ts", "id AS event_id", "CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS comments")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        got = {r["repo_key"]: r["event_id"] for r in fl.latest_n(rows, 1, F.desc("ts"), F.desc("event_id")).collect()}
        shares = rows.where("repo_key = 'hot'").withColumn("s", F.pmod(F.xxhash64(*rows.columns), F.lit(fl.SHARES))).groupBy("s").count().collect()
        issue = {r["repo_key"]: r["detail"] for r in activity.issue_responses(rows).where("repo_key in ('hot', 'r7')").collect()}
        board = {r["repo_key"]: r["issue_detail"] for r in activity.scoreboard(activity.together(issue=rows), "2024-01-31").where("repo_key in ('hot', 'r7')").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    counts = sorted(r["count"] for r in shares)
    assert len(counts) == fl.SHARES and counts[-1] < 2 * counts[len(counts) // 2]
    best = {r["repo_key"]: r["m"]["event_id"] for r in rows.groupBy("repo_key").agg(F.max(F.struct("ts", "event_id")).alias("m")).collect()}
    assert got == best
    top = rows.where("repo_key = 'hot'").orderBy(F.desc("ts"), F.desc("event_id")).limit(30).agg(F.count_if(F.col("comments") > 0).alias("n")).first()["n"]
    assert issue["hot"] == board["hot"] == f"{top}/30 issues have responses" and issue["r7"] == board["r7"]


def test_bounded_actors(spark):
    """Exact below the cap, the cap beyond it, however many rows there are."""
    rows = spark.range(300_000).selectExpr("concat('r', id % 3) AS repo_key", "CASE id % 3 WHEN 0 THEN id ELSE id % 300 END AS actor", "id AS event_id", "timestamp_seconds(id) AS ts").union(spark.sql("SELECT 'none', CAST(NULL AS BIGINT), 1L, timestamp_seconds(1)"))
    want = {"r0": 100, "r1": 100, "r2": 100, "none": 0}
    assert {r["repo_key"]: r["n"] for r in activity.multi_contributors(rows).collect()} == want
    few = rows.where("actor % 10 = 1 or actor is null")
    exact = {r["repo_key"]: min(r["n"], 100) for r in few.groupBy("repo_key").agg(F.countDistinct("actor").alias("n")).collect()}
    assert {r["repo_key"]: r["n"] for r in activity.multi_contributors(few).collect()} == exact
    assert {r["repo_key"]: r["n_contributors"] for r in activity.scoreboard(activity.together(contributor=few), "2024-01-31").collect()} == exact


def test_evidence_of_one_repository_has_a_fixed_size(spark):
    """A hundred thousand configuration files of one repository: the verdict's row holds counts and three paths."""
    paths = spark.range(100_000).selectExpr("'o/r' AS repo_key", "id AS seq", "concat('p', id, '/pyproject.toml') AS path")
    contents = paths.selectExpr("repo_key", "path", "'[tool.poetry]\nsphinx = 1\n' AS content")
    out = jobs.api_docs_verdicts(paths, contents)
    row = out.first()
    assert row["n_doc_files"] == 100_000 and row["preview"] == "p0/pyproject.toml, p1/pyproject.toml, p10/pyproject.toml"
    assert len(str(row)) < 600 and jobs.api_doc_files(paths, contents).count() == 100_000
    entries = paths.select("repo_key", "path", F.lit("a").alias("type"))
    twice = summary.doc_file_preview(entries.union(entries)).first()
    assert (twice["n_doc_files"], twice["preview"]) == (100_000, row["preview"])
    assert summary.doc_file_preview(entries).first()["preview"] == row["preview"]
    widest = out._jdf.queryExecution().optimizedPlan().toString()
    assert widest.count("collect_list") == 1
