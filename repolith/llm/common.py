"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a missing doc_id inside the operators: such rows order after every other row.
NO_ID = (1 << 63) - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    A session without one may only be local, where driver and executors are one process (tests): it gets a folder of its
    own. On a cluster, executors would each write to their own disk and rows would be lost, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def written(frame: DataFrame, *by: str) -> DataFrame:
    """The rows as a table in the shared folder, split by the columns ``by``: computed once, and lost executors take nothing with them. It goes when the driver ends."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/repolith-{uuid.uuid4().hex}"
    (frame.write.partitionBy(*by) if by else frame.write).parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(frame.schema).parquet(path)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts: one pass over one column, one number to the driver."""
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identified(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc (``NO_ID``: none), row, text: ``row`` tells rows of one doc_id apart by the text's digest, so that they keep results of their own.

    It is empty where the doc_id alone tells them apart: for every row with an id, if no id is repeated.
    """
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    alone = F.col("doc_id").isNotNull() & F.lit(again)
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.when(alone, "").otherwise(digest).alias("row"), F.col(text).alias("text"))


def own_id(found: DataFrame) -> DataFrame:
    """``doc`` of identified() as doc_id again."""
    return found.withColumn("doc", F.when(F.col("doc") != NO_ID, F.col("doc"))).withColumnRenamed("doc", "doc_id")


def map_batches(frame: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``frame`` through a function of Arrow batches that gives columns by name. Its workers load no pandas, a third of their memory."""
    empty = frame.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in f(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[x.name], x.type) for x in empty], schema=empty)

    return frame.mapInArrow(run, schema)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_dealt(rows: DataFrame, few: DataFrame, key: str, spread: str, how: str = "left", counted: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to ``few`` (one row a key) by ``key``, with no task for the rows of one key.

    A key that has more than a small share of all rows is crowded; there are at most four of those for each partition, so
    they may be broadcast. Its rows are dealt out by a hash of ``spread``, a column of theirs that tells them apart, and
    its row of ``few`` is repeated once for each number. ``counted`` holds the same keys where ``rows`` are dear to read.
    """
    counted = (rows if counted is None else counted).select(key)
    share = counted.count() // (4 * parts(rows.sparkSession)) + 1
    crowded = counted.groupBy(key).count().where(F.col("count") > share).select(key, (F.col("count") / share + 1).cast("int").alias("_numbers"))
    crowded = written(crowded)
    if crowded.isEmpty():
        return rows.join(few, key, how)
    numbers = F.coalesce("_numbers", F.lit(1))
    dealt = rows.join(F.broadcast(crowded), key, "left").withColumn("_number", F.pmod(F.xxhash64(spread), numbers).cast("int")).drop("_numbers")
    repeated = few.join(F.broadcast(crowded), key, "left").withColumn("_number", F.explode(F.sequence(F.lit(0), numbers - 1))).drop("_numbers")
    return dealt.join(written(repeated), [key, "_number"], how).drop("_number")
