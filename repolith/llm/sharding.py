"""Sharding (7): a uniform random shuffle into shards of exact sizes.

Rows lie in parts by a keyed hash. How many rows each part sends to each shard is drawn beforehand, from the
multivariate hypergeometric law: that communication matrix has the parts' sizes as row sums and the shards' exact
sizes as column sums, as a uniform permutation's would. Each part permutes its rows and deals them out by its row of
the matrix; after the exchange, each shard permutes again, cell by cell. The matrix is drawn in two levels, groups of
parts and then the parts of each group, which has the same law: the driver sees one number for every ``PART * GROUP`` rows,
and rows meet their part's bounds where they lie, as both are dealt out by part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, table, written

SHARDS, SEED, PART = 16, 20240131, 50_000
#: Parts that are drawn together.
GROUP = 1024


def draw_matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """Exact counts from each part to each shard; shard sizes differ by one at most."""
    total = sum(sizes)
    return deal_out(sizes, np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64), np.random.default_rng(seed))


def deal_out(sizes: list[int], left: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A row for each of ``sizes``: how many of its rows get a place in each shard, of which there are ``left`` places, as many as rows."""
    left, out = left.copy(), np.zeros((len(sizes), len(left)), np.int64)
    for i, n in enumerate(sizes):
        if left.sum() < 10**9:  # as far as the generator goes
            out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        else:  # n distinct places among all that are left, counted by shard
            out[i] = np.bincount(np.searchsorted(np.cumsum(left), _distinct(rng, int(left.sum()), n), side="right"), minlength=len(left))
        left -= out[i]
    return out


def draw_group(group: int, sizes: list[int], places: list[int], seed: int) -> np.ndarray:
    """The rows of the matrix of one group's parts, given what the whole group sends to each shard."""
    return deal_out(sizes, np.array(places, np.int64), np.random.default_rng([seed, group]))


def _distinct(rng: np.random.Generator, total: int, n: int) -> np.ndarray:
    got = np.unique(rng.integers(total, size=n))
    while len(got) < n:
        got = np.union1d(got, rng.integers(total, size=n - len(got)))
    return got


def shuffle_into_shards(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All columns of ``rows``, with shard (0 to ``shards`` - 1) and slot (gapless from 0 in each shard).

    Shard sizes differ by one at most, and every row is as likely to be in any shard and slot. Nulls, repeated rows and
    an empty table are fine; columns named shard or slot are replaced. One seed gives one result for the same rows.
    """
    spark, kept = rows.sparkSession, [c for c in rows.columns if c not in ("shard", "slot")]
    hashed = lambda i: F.xxhash64(F.lit(seed + i), F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.lit(0))
    packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), hashed(0).alias("h0"), hashed(1).alias("h1"), hashed(2).alias("h2"))
    total = rows.count()
    n = max(parts(spark), -(-total // PART))
    dealt = packed.withColumn("part", F.pmod("h0", F.lit(n)))
    # First for groups of parts, of which the driver sees the sizes, then by a task for the parts of each group.
    counts = written(dealt.groupBy("part").count().withColumn("group", F.floor(F.col("part") / GROUP)))
    sizes = [(r["group"], r["n"]) for r in counts.groupBy("group").agg(F.sum("count").alias("n")).orderBy("group").collect()]
    drawn = draw_matrix([c for _, c in sizes], shards, seed)
    groups = spark.createDataFrame([(g, row.tolist()) for (g, _), row in zip(sizes, drawn, strict=True)], "group long, places array<long>")

    def parts_of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        rows = draw_group(int(frame["group"].iloc[0]), frame["count"].tolist(), frame["places"].iloc[0].tolist(), seed)
        return pd.DataFrame({"part": frame["part"], "bounds": np.cumsum(rows, axis=1).tolist()})

    bounds = written(counts.join(groups, "group").groupBy("group").applyInPandas(parts_of, "part long, bounds array<long>"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("h1", "h0"))
    shard = F.size(F.filter("bounds", lambda b: b < F.col("place")))
    # A part of a shard's rows, again by hash: the second permutation runs in cells, each of about PART rows or fewer.
    cells = max(1, n // shards)
    cell = F.pmod(F.xxhash64(F.lit(seed + 3), "h2"), F.lit(cells)).alias("cell")
    to_shard = lambda x: x.withColumn("place", place).join(bounds, "part").withColumn("shard", shard).withColumn("cell", cell)
    # Cells are counted on the hashes alone, so that whole rows are exchanged twice and written nowhere between.
    there = to_shard(dealt)
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = to_shard(dealt.select("part", "h0", "h1", "h2")).groupBy("shard", "cell").count()
    starts = written(counts.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("h2"))
    out = there.withColumn("within", within).join(starts, ["shard", "cell"])
    return out.select("row.*", "shard", (F.col("first") + F.col("within") - 1).cast("long").alias("slot"))


def op7_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = shuffle_into_shards(docs)
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    return out.select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
