"""Line dedup (13): levelled sorted runs of line hashes.

Who holds a line first is kept in *runs*: tables of (hash, owner), dealt to a fixed number of buckets by hash and sorted
in each. Documents arrive in batches. A batch's lines become one row a hash (its smallest document), which a merge
anti-join with every run rids of what is known; the rest is a new run of level 0. ``FAN`` runs of a level are compacted to
one of the next, so a table of n batches has O(log n) runs and moves each hash O(log n) times; a batch itself is dealt to
the buckets once, and the runs it meets are not moved at all. A line stays if its hash is owned by its own document.

Hashes have 128 bits. DataFrame functions only; every run is written to the shared folder, so lost executors cost one
step at most.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import identified, join_dealt, own_id, parts, shared_folder, table, written

#: Keys of fewer code points are never looked for.
LEAST = 10
#: Runs of one level that are compacted to one of the next.
FAN = 2
#: Deliveries that a whole table is taken in, by ranges of doc_id.
BATCHES = 4
BLANK = " \t\n\x0b\f\r"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), string.ascii_uppercase, string.ascii_lowercase)


class LineRuns:
    """The runs of one corpus, by level; batches are to be added in the order in which documents own lines."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.buckets, self.levels = spark, parts(spark), []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run, _ in level]

    def unknown(self, lines: DataFrame) -> DataFrame:
        """h1, h2, owner: of ``lines`` (h1, h2, doc), each hash that no run holds, with its smallest doc."""
        fresh = lines.groupBy(*KEY).agg(F.min("doc").alias("owner"))
        for run in self.runs():
            fresh = fresh.join(run.hint("merge"), KEY, "left_anti")
        return fresh

    def add(self, lines: DataFrame) -> None:
        self._push(0, self._run(self.unknown(lines)))

    def owners(self) -> DataFrame:
        """h1, h2, owner of every hash: no two runs share one."""
        found = self.spark.createDataFrame([], "h1 long, h2 long, owner long")
        for run in self.runs():
            found = found.unionByName(run)
        return found

    def _push(self, level: int, run: tuple[DataFrame, str]) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == FAN:
            old, self.levels[level] = self.levels[level], []
            merged = old[0][0]
            for more, _ in old[1:]:
                merged = merged.unionByName(more)
            self._push(level + 1, self._run(merged))
            for _, path in old:
                there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                there.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(there, True)

    def _run(self, frame: DataFrame) -> tuple[DataFrame, str]:
        """``frame`` as a written run: a file a bucket, sorted. The catalogue forgets it at once, the frame keeps its layout."""
        name = f"repolith_{uuid.uuid4().hex}"
        path = f"{shared_folder(self.spark)}/{name}"
        dealt = frame.repartition(self.buckets, *KEY).sortWithinPartitions(*KEY)
        dealt.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).format("parquet").saveAsTable(name)
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(there)
        run = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return run, path


def lines_of(rows: DataFrame) -> DataFrame:
    """doc, row, pos (from 0), h1, h2 of each line of rows of identified() whose key has ``LEAST`` code points or more."""
    each = rows.select("doc", "row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    keyed = each.select("doc", "row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= LEAST)
    return keyed.select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(13), "key").alias("h2"))


def dedup_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped for every row of ``docs`` (doc_id, text; other columns are ignored).

    Lines end at a line feed only. Lines whose key has ``LEAST`` code points or more stay in the document of the smallest
    doc_id that holds the key, however often it does, and go from all others; other lines stay as they are. A null text
    is one empty line, like an empty one. Rows with one doc_id are one document: what is theirs stays in all of them.
    Rows without a doc_id are one document too, after all others. An empty table gives none.

    The table is taken in ``batches`` deliveries by doc_id, each against the runs of those before it.
    """
    rows = identified(docs)
    share = [i / batches for i in range(1, batches)]
    bounds = rows.agg(F.percentile_approx("doc", share).alias("b")).first()["b"] if batches > 1 else []
    batch = sum((F.when(F.col("doc") > b, 1).otherwise(0) for b in bounds or []), F.lit(0))
    lines = written(lines_of(rows).withColumn("batch", batch), "batch")
    known = LineRuns(docs.sparkSession)
    for i in range(len(bounds or []) + 1):
        known.add(lines.where(F.col("batch") == i))
    key = F.struct(*KEY).alias("key")
    held = join_dealt(lines.select("doc", "row", "pos", key), known.owners().select(key, "owner"), "key", "doc")
    gone = written(held.where("doc > owner").groupBy("doc", "row").agg(F.array_sort(F.collect_set("pos")).alias("gone")))
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)

    def kept(x: Column) -> Column:
        """Lines between those that go, stretch by stretch: each line is copied once."""
        begin = lambda i: F.when(i == 0, 0).otherwise(F.get(x["gone"], i - 1) + 1)
        end = lambda i: F.coalesce(F.get(x["gone"], i), F.size(x["lines"]))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["gone"])), lambda i: F.slice(x["lines"], begin(i) + 1, end(i) - begin(i))))

    # An element of a one-element array has a name in what follows, and is made once.
    left = F.get(F.transform(F.array(F.struct(split.alias("lines"), "gone")), kept), F.lit(0))
    n = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    # Merged at every size: a broadcast for small tables alone would only put off what large ones cost.
    found = rows.join(gone.hint("merge"), ["doc", "row"], "left").select(
        "doc",
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(left, "\n")).alias("kept_text"),
        F.coalesce(n, F.lit(1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return own_id(found)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_TRIMMED = "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
OP13_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS doc, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
l AS (SELECT r, doc, unnest(range(len(s))) AS i, unnest(s) AS line FROM d),
k AS (SELECT *, translate({_TRIMMED}, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM l),
o AS (SELECT key, min(doc) AS owner FROM k WHERE length(key) >= {LEAST} GROUP BY key),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE owner < doc) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE owner IS NULL OR owner >= doc) AS kept FROM k LEFT JOIN o ON o.key = k.key GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN g ON g.r = d.r"""
