"""Snapshots whose files and contents lie together, so that jobs join them where they are.

Listings and contents are written in as many buckets by repository, sorted by path within. Windows by repository, the join
of chosen paths to contents and the gathering by repository then need no exchange: a snapshot is dealt out once and read by
every check. Contents carry n_chars, so that budgets read lengths and not texts.

A bucket is read by one task. Repositories with more than ``LARGE`` characters are therefore kept apart, as plain tables that
Spark deals out by path; ``each`` runs a job on both and puts the rows together, as no job looks across repositories.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 200
#: Characters of contents from which a repository has tables of its own.
LARGE = 1 << 30
#: What a session needs so that rows dealt out by repository count as dealt out by repository and path.
SETTINGS = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


@dataclass(frozen=True)
class Snapshot:
    files: DataFrame
    contents: DataFrame
    large_files: DataFrame | None = None
    large_contents: DataFrame | None = None

    def each(self, job: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """The rows of ``job(files, contents)``, which has a row or rows for each repository."""
        rows = job(self.files, self.contents)
        return rows if self.large_files is None else rows.unionByName(job(self.large_files, self.large_contents))


def write_snapshot(name: str, files: DataFrame, contents: DataFrame, buckets: int = BUCKETS, large: int = LARGE) -> Snapshot:
    """``files`` (repo_key, path, seq, ...) and ``contents`` (repo_key, path, content) as tables ``name``_files, ``name``_contents and ``name``_large_...

    A missing repo_key is no repository's: such rows are left out. Tables of that name are replaced.
    """
    spark = files.sparkSession
    texts = contents.where("repo_key is not null").select("repo_key", "path", "content", F.length("content").alias("n_chars"))
    big = texts.groupBy("repo_key").agg(F.sum("n_chars").alias("n")).where(F.col("n") > large).select("repo_key")
    big.write.mode("overwrite").saveAsTable(f"{name}_large")
    big = spark.table(f"{name}_large")
    for part, rows in (("files", files.drop("content").where("repo_key is not null")), ("contents", texts)):
        dealt = rows.join(big, "repo_key", "left_anti").repartition(buckets, "repo_key").sortWithinPartitions("repo_key", "path")
        dealt.write.mode("overwrite").bucketBy(buckets, "repo_key").sortBy("repo_key", "path").saveAsTable(f"{name}_{part}")
        rows.join(big, "repo_key", "left_semi").write.mode("overwrite").saveAsTable(f"{name}_large_{part}")
    return read_snapshot(spark, name)


def read_snapshot(spark: SparkSession, name: str) -> Snapshot:
    """The tables of write_snapshot(). The session needs SETTINGS; without them the rows are right, and moved once more."""
    files, contents = spark.table(f"{name}_files"), spark.table(f"{name}_contents")
    if spark.table(f"{name}_large").isEmpty():
        return Snapshot(files, contents)
    return Snapshot(files, contents, spark.table(f"{name}_large_files"), spark.table(f"{name}_large_contents"))
