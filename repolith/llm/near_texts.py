"""Near copies by similarity: documents whose word shingles have a Jaccard similarity of at least ``LEAST`` form groups.

Candidates come from two sides: SimHash fingerprints that differ in few bits, and MinHash bands (``BANDS`` of ``DEPTH``
values), of which a pair at similarity s shares one with probability 1 - (1 - s ** DEPTH) ** BANDS: 0.997 at 0.8.
Candidates only say which texts meet. Each distinct text then travels once to those it may be linked to, where all
shingles are compared: a link holds only if the similarity of the texts reaches the bound, and groups follow links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from . import superkmers as S
from .common import NO_ID, join_dealt, map_batches, parts, written

BANDS, DEPTH = 32, 8
#: The least similarity of a link, as a fraction.
LEAST = (4, 5)
#: Bytes of text from which candidates that hang together are cut into tiles that meet pair by pair.
TILE = 4 << 20
_RNG = np.random.default_rng(42)
_TIMES = _RNG.integers(1 << 31, size=(BANDS * DEPTH, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RNG.integers(1 << 32, size=(BANDS * DEPTH, 1), dtype=np.uint32)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; a text of fewer words is one shingle. Words as in ``simhash.fingerprint``."""
    found = text.lower().split()
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found))], np.uint64)
    return np.unique(S.spread(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)), words))


def bands(hashes: np.ndarray) -> np.ndarray:
    low = (S.mix(hashes) >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * DEPTH, (1 << 32) - 1, np.uint32)
    for lo in range(0, len(low), 1 << 11):
        np.minimum(least, (low[None, lo : lo + (1 << 11)] * _TIMES + _PLUS).min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for value in least.reshape(BANDS, DEPTH).T.astype(np.uint64):
        key = S.mix(key * np.uint64(0x9E3779B97F4A7C15) + value)
    return key.view(np.int64)


def similar(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> list[tuple[int, int]]:
    """Links that join what pairs of sets with at least this similarity join; ends early once all are joined."""
    size = np.array([len(s) for s in sets], np.int64)
    _, shingle, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holder = np.repeat(np.arange(len(sets)), size)[np.argsort(shingle, kind="stable")]
    first, begin = np.cumsum(count) - count, np.cumsum(size) - size
    label, out = np.arange(len(sets)), []
    for i in range(len(sets)):
        mine = shingle[begin[i] : begin[i] + size[i]]
        both = np.bincount(holder[S.ranges(first[mine], count[mine])], minlength=len(sets))
        for j in np.flatnonzero((least[1] * both >= least[0] * (size[i] + size - both)) & (label != label[i])).tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
        if (label == label[0]).all():
            break
    return out


def _prints(docs: DataFrame, words: int) -> DataFrame:
    """(doc, node, fp, bands) of every row; node stands for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [(simhash.fingerprint(b, words), bands(shingles(b, words))) for b in (t.as_py().encode() for t in batch.column("text"))]
            fp = np.array([x for x, _ in found], np.uint64).view(np.int64)
            yield {"doc": batch.column("doc"), "node": batch.column("node"), "fp": fp, "bands": [x for _, x in found]}

    return map_batches(docs.select("doc", "node", "text"), run, "doc long, node long, fp long, bands array<long>")


def _star(keyed: DataFrame) -> DataFrame:
    """(u, v): each node of a key (node, key) with the smallest one."""
    least = keyed.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("most")).where("v < most").select("key", "v")
    return keyed.join(least, "key").where("node > v").select(F.col("node").alias("u"), "v")


def _candidates(nodes: DataFrame, radius: int) -> DataFrame:
    """(node, crowd): nodes that links may join have one crowd; nodes on their own are left out."""
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    close = simhash.links(prints.select("fp"), prints.count(), radius)
    end = lambda c: prints.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node"))
    close = close.join(end("u"), "u").join(end("v"), "v").select(F.greatest("u_node", "v_node").alias("u"), F.least("u_node", "v_node").alias("v"))
    edges = close.unionByName(_star(nodes.select("node", F.col("fp").alias("key")))).unionByName(_star(nodes.select("node", F.explode("bands").alias("key"))))
    found = simhash.components(edges.distinct())
    return written(found.select(F.col("u").alias("node"), F.col("v").alias("crowd")).unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("crowd"))).distinct())


def _links(texts: DataFrame, words: int) -> DataFrame:
    """(u, v) nodes whose texts are similar, among those of one crowd (node, crowd, text)."""
    spark = texts.sparkSession
    crowds = texts.groupBy("crowd").agg(F.sum(F.octet_length("text") + 1).alias("bytes")).where(F.col("bytes") > TILE)
    tiles = F.coalesce(F.ceil(F.col("bytes") / TILE), F.lit(1)).cast("long")
    keyed = join_dealt(texts, written(crowds), "crowd", "node").withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")))
    # Texts of tile i meet tile j in tile pair (i, j): none outgrows two tiles.
    keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    keyed = keyed.withColumn("tile", F.least("own", "other") * F.col("tiles") + F.greatest("own", "other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = (tuple(x.as_py() for x in r) for b in batches for r in zip(*(b.column(c) for c in ("crowd", "tile", "node", "text")), strict=True))
        for _, group in groupby(rows, key=lambda r: r[:2]):
            node, sets = zip(*((r[2], shingles(r[3].encode(), words)) for r in group), strict=True)
            pairs = np.array([(node[i], node[j]) for i, j in similar(list(sets))], np.int64).reshape(-1, 2)
            yield {"u": pairs.max(axis=1), "v": pairs.min(axis=1)}

    dealt = keyed.select("crowd", "tile", "node", "text").repartition(parts(spark), "crowd", "tile").sortWithinPartitions("crowd", "tile", "node")
    return map_batches(dealt, run, "u long, v long").distinct()


def near_texts(docs: DataFrame, words: int, radius: int) -> DataFrame:
    """doc_id, component_id for every row of ``docs`` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id that links reach. A link joins two texts whose shingles of ``words`` words have
    a Jaccard similarity of ``LEAST`` or more; null and blank texts are alike. A null doc_id counts as larger than any
    other and is a component_id only where all ids are null. An empty table gives none.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("node"), text.alias("text"))
    prints = written(_prints(rows, words))
    nodes = written(prints.groupBy("node").agg(F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"), F.min("doc").alias("least")))
    crowd = _candidates(nodes, radius)
    texts = join_dealt(rows, crowd, "node", "doc", "inner", counted=prints)
    texts = written(texts.groupBy("node", "crowd").agg(F.max("text").alias("text")))
    stars = simhash.components(_links(texts, words)).withColumnRenamed("u", "node")
    # Copies of a text are one node until the last join, and each node's root is settled before its rows are named.
    rooted = written(nodes.select("node", "least").join(stars, "node", "left").select("node", "least", F.coalesce("v", "node").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = join_dealt(rooted, smallest, "root", "node").select("node", "component")
    out = join_dealt(prints.select("doc", "node"), named, "node", "doc")
    own = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(own("doc").alias("doc_id"), own("component").alias("component_id"))
