"""Approximate nearest neighbours (9): randomly rotated one-bit codes.

A vector is turned by one random rotation and kept as the signs of its coordinates, packed eight a byte, with two
scalars: its norm and how well the signs point its way. From those alone comes an unbiased estimate of its inner
product with a query, and a bound that the error passes with small, known probability. A task holds one block of queries
and meets a group of vector blocks, one after the other: the best scores so far and the bounds say which vectors can
still be among a query's nearest; only those are reranked with the original vectors, in double precision, and only each
group's best leave it. So memory is that of a block and a group, whatever the tables' sizes.

Vectors are not sorted into cells first: where no direction is more common than others, as in the given tables, most
cells of any partition hold neighbours of a query (see the README for figures).
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, table

NEAREST, SEED = 20, 7
#: Standard deviations that the error bound allows: larger ones rerank more and miss less.
EPSILON = 2.5
#: Most rows of a block of vectors or of queries, about, and most bytes of one, and most blocks that one task meets: a task
#: holds some 32 MB of vectors, whatever their length.
BLOCK, BYTES, GROUP = 8192, 4 << 20, 8
#: Vectors of the first block that are reranked by their estimates, to have a score that others must reach.
FIRST = 64
INDEX = "dim int, block long, ids binary, codes binary, scales binary, vectors binary"


@cache
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the turned unit vectors, and per vector (norm, inner product of unit vector and unit code)."""
    norm = np.linalg.norm(vectors, axis=1)
    unit = (vectors / norm[:, None]) @ turn.T
    aligned = np.abs(unit).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(unit > 0, axis=1), np.stack([norm, aligned], axis=1)


def estimate(codes: np.ndarray, scales: np.ndarray, queries: np.ndarray, turn: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products, one row a query, and each vector's error bound for a query of norm 1."""
    dim = queries.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    norm, aligned = scales.T
    guess = (queries @ turn.T).astype(np.float32) @ signs.T
    guess *= (norm / aligned).astype(np.float32)
    return guess, norm * np.sqrt(np.maximum(1 - aligned**2, 0)) / aligned * epsilon / np.sqrt(max(dim - 1, 1))


def _usable(v: Column) -> Column:
    """Not null or zero, and without null or non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def build_index(vectors: DataFrame, seed: int = SEED) -> DataFrame:
    """One row for each dim and block of ``vectors`` (id, vector, dim, block): ids, codes, scales and originals, packed."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(frame["vector"].to_numpy()).astype(np.float64)
        codes, scales = encode(v, rotation(v.shape[1], seed))
        return pd.DataFrame([(v.shape[1], int(frame["block"].iloc[0]), frame["id"].to_numpy(np.int64).tobytes(), codes.tobytes(), scales.tobytes(), v.tobytes())], columns=["dim", "block", "ids", "codes", "scales", "vectors"])

    return vectors.select("dim", "block", "id", "vector").groupBy("dim", "block").applyInPandas(run, INDEX)


def _best(found: list[np.ndarray], nearest: int) -> list[np.ndarray]:
    """(query's place, id, score) of each query's nearest, best first, ties to the smaller id."""
    query, ids, score = found
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    head = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(head, np.diff(np.append(head, len(query))))
    return [x[rank < nearest] for x in (query, ids, score)]


def nearest_in_group(blocks: list[tuple[np.ndarray, ...]], own: np.ndarray, queries: np.ndarray, nearest: int, epsilon: float, turn: np.ndarray) -> list[np.ndarray]:
    """(query_id, vec_id, score): for each of some queries the nearest found in ``blocks`` (ids, codes, scales, vectors)."""
    norms = np.linalg.norm(queries, axis=1)
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    reach = np.full(len(queries), -np.inf)  # what a vector must be able to score
    for ids, codes, scales, vectors in blocks:
        guess, error = estimate(codes, scales, queries, turn, epsilon)
        guess[own[:, None] == ids[None, :]] = -np.inf

        def rerank(query: np.ndarray, at: np.ndarray, ids=ids, vectors=vectors) -> None:
            score = np.concatenate([(vectors[at[i : i + 65536]] * queries[query[i : i + 65536]]).sum(axis=1) for i in range(0, len(at), 65536)] or [np.zeros(0)])
            best[:] = _best([np.concatenate(x) for x in zip(best, (query, ids[at], score), strict=True)], nearest)
            full = np.bincount(best[0], minlength=len(queries)) == nearest
            last = np.cumsum(np.bincount(best[0], minlength=len(queries))) - 1
            reach[full] = best[2][last[full]]

        if not len(best[0]):
            first = np.argpartition(-guess, min(FIRST, len(ids)) - 1, axis=1)[:, :FIRST]
            query, place = np.repeat(np.arange(len(queries)), first.shape[1]), first.ravel()
            known = guess[query, place] > -np.inf
            rerank(query[known], place[known])
            guess[query, place] = -np.inf
        with np.errstate(invalid="ignore"):
            query, at = np.nonzero((guess + norms[:, None].astype(np.float32) * error[None, :].astype(np.float32) >= reach[:, None]) & (guess > -np.inf))
        if len(at):
            rerank(query, at)
    return [own[best[0]], best[1], best[2]]


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, epsilon: float = EPSILON, block_rows: int = BLOCK, seed: int = SEED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``nearest`` rows of ``vectors`` found for each of ``queries`` by inner product.

    Both have id and vector; a row is no candidate for the query of its own id. Vectors that are null, zero, or hold
    null or non-finite components take no part; a query meets the vectors of its own length. Ties go to the smaller id;
    rows that repeat an id count once (the vector that sorts first). Empty tables give none.
    """
    spark = vectors.sparkSession

    def usable(frame: DataFrame) -> DataFrame:
        v = F.col("vector").cast("array<double>")
        return frame.select(F.col("id").cast("long").alias("id"), v.alias("vector")).where("id is not null").where(_usable(v))

    def blocked(frame: DataFrame, blocks: int) -> DataFrame:
        once = frame.groupBy("id").agg(F.min("vector").alias("vector"))
        return build_index(once.withColumn("dim", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), seed)

    found, asked = usable(vectors), usable(queries)
    # Few groups, so that the score to reach rises from block to block; small tables make more tasks by their queries.
    sizes = (F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("vector") * F.lit(8).cast("long")), F.lit(0)).alias("bytes"))
    have, want = found.agg(*sizes).first(), asked.agg(*sizes).first()
    blocks_of = lambda x: max(1, -(-x["rows"] // block_rows), -(-x["bytes"] // BYTES))
    n = blocks_of(have)
    groups = -(-n // GROUP)
    m = max(blocks_of(want), min(-(-parts(spark) // groups), want["rows"] // 256))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    index = blocked(found, n).withColumn("part", F.pmod("block", F.lit(groups))).withColumn("query_block", every(m))
    packed = blocked(asked, m).select("dim", F.col("block").alias("query_block"), "ids", "vectors").withColumn("part", every(groups))

    def run(index: pd.DataFrame, packed: pd.DataFrame) -> pd.DataFrame:
        out = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]]
        if len(index) and len(packed):
            dim, row = int(packed["dim"].iloc[0]), packed.iloc[0]
            of = lambda b, kind, *shape: np.frombuffer(b, kind).reshape(*shape)
            blocks = [(of(r.ids, np.int64, -1), of(r.codes, np.uint8, -1, -(-dim // 8)), of(r.scales, np.float64, -1, 2), of(r.vectors, np.float64, -1, dim)) for r in index.sort_values("block").itertuples()]
            own, asked = of(row["ids"], np.int64, -1), of(row["vectors"], np.float64, -1, dim)
            for lo in range(0, len(own), 256):
                out.append(nearest_in_group(blocks, own[lo : lo + 256], asked[lo : lo + 256], nearest, epsilon, rotation(dim, seed)))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    keys = ("dim", "query_block", "part")
    best = index.groupBy(*keys).cogroup(packed.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op9_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search(rows, rows.where("id % 20 = 0"))
