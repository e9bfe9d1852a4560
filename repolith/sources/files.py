"""Reading papers and repository files, writing reports."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAPER = "struct<title:string,repo:string,semanticscholarid:string,ground_truth:string>"


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own for a table that is written to be read again, where driver and executors share one (spark.checkpoint.dir);
    only a local session, whose driver and executors are one process, may lack that. It goes when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    path = f"{shared}/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """pos (from 0, the file's order), title, repo, semanticscholarid, ground_truth, has_repo of a JSON list or single object.

    ``has_repo`` tells a record without the key from one with a blank. Anything but a list or an object, or a list with
    anything but objects, is an error.
    """
    text = spark.read.text(path, wholetext=True).select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("value"))
    kind = F.substring("value", 1, 1)
    listed = F.when(kind == "[", F.from_json("value", "array<string>")).when(kind == "{", F.array("value"))
    rows = text.select(F.posexplode(F.coalesce(listed, F.array(F.raise_error(F.lit("papers: not a JSON list or object")).cast("string")))).alias("pos", "raw"))
    raw = F.when(F.substring(F.ltrim("raw"), 1, 1) == "{", F.col("raw")).otherwise(F.raise_error(F.lit("papers: a record is not an object")).cast("string"))
    has = F.array_contains(F.json_object_keys("raw"), "repo")
    return rows.withColumn("raw", raw).select(F.col("pos").cast("long").alias("pos"), F.from_json("raw", PAPER).alias("p"), has.alias("has_repo")).select("pos", "p.*", "has_repo")


def repo_blobs(tree: DataFrame) -> DataFrame:
    """Files only: folders and submodules of the listing go."""
    return tree.where(F.col("type") == "blob")


def decode_content(b64: Column) -> Column:
    """Base64 (line breaks allowed) to text; bytes that are not UTF-8 are dropped, a U+FFFD that was sent stays."""
    # What was sent steps aside under two private characters, the first of which is doubled for itself.
    aside = (("\ue000", "\ue000\ue001"), ("\ufffd", "\ue000\ue002"))
    text = F.unbase64(b64).cast("string")
    for a, b in aside:
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    for a, b in reversed(aside):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def write_report(path: str, results: DataFrame, detail: DataFrame | None = None, summary: DataFrame | None = None, comparison: DataFrame | None = None, fmt: str = "parquet") -> None:
    """One folder for each part that is given; results and detail are split by model where they have one."""
    for name, frame in (("results", results), ("detail", detail), ("summary", summary), ("comparison", comparison)):
        if frame is None:
            continue
        flat = frame if fmt == "parquet" else frame.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in frame.dtypes))
        writer = flat.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        (writer.partitionBy("model") if "model" in frame.columns and name in ("results", "detail") else writer).save(f"{path}/{name}")
