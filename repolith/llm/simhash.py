"""SimHash near-dedup (2): documents whose 64-bit fingerprints differ in few bits form groups.

Copies share a fingerprint, so only distinct fingerprints are compared. With r bits allowed to differ and the 64 bits
cut into b > r blocks, at least b - r blocks agree: one table for each choice of b - r blocks, keyed by their bits,
brings every close pair together somewhere. Within a key the comparison is bit-sliced: bit planes lie vertically,
eight fingerprints a byte, carry-save counters add up the differing planes for all of them at once, and bytes whose
lanes have all passed the radius are abandoned. Links join into groups by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, join_dealt, map_batches, parts, table, written

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Rows compared together, and the size from which one key's rows are cut into tiles that meet pair by pair.
ROWS, TILE = 1 << 17, 1 << 15


def fingerprint(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    parts = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    body = b" ".join(parts)
    n = len(parts) - words + 1
    if n < 2:
        return xxhash.xxh64_intdigest(body, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    begin = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(body[a:b], seed) for a, b in zip(begin, ends[words - 1 :].tolist(), strict=True)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 14):
        ones += np.unpackbits(h[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc, fp) of every row; doc is NO_ID where doc_id is null, fp a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            fp = np.fromiter((fingerprint((t.as_py() or "").encode(), words, seed) for t in batch.column("text")), np.uint64, len(batch))
            yield {"doc": batch.column("doc"), "fp": fp.view(np.int64)}

    return map_batches(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text"), run, "doc long, fp long")


def tables(n: int, radius: int) -> list[int]:
    """Masks of the tables for n fingerprints: more blocks give smaller keys' groups and more copies of each row."""
    best: tuple[float, list[int]] = (float("inf"), [])
    for b in range(radius + 1, radius + 5):
        edge = [64 * i // b for i in range(b + 1)]
        block = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(b)]
        masks = [sum(c) for c in combinations(block, b - radius)]
        cost = sum(200 + n / 2 ** m.bit_count() for m in masks)  # 200 comparisons cost about what moving a row does
        best = min(best, (cost, masks), key=lambda x: x[0])
    return best[1]


def close_pairs(fp: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j in one group (groups lie together) whose fingerprints differ in 1 to ``radius`` bits, by distance in place."""
    start = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    size = np.repeat(np.diff(start), np.diff(start))
    counters = radius.bit_length()
    preset = (1 << counters) - 1 - radius  # radius + 1 more make the counters overflow
    place, d = np.arange(len(fp)), 1
    while len(place) > 1:
        # Groups of d rows or fewer have no pair left at this distance.
        most = int(size[place].max())
        bits = np.ascontiguousarray(np.unpackbits(fp[place].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T)
        g = group[place]
        planes = [np.packbits(bits[:, r:], axis=1) for r in range(8)]
        while d < most:
            n = len(place) - d
            together = g[:n] == g[d:]
            if 2 * np.count_nonzero(together) < n and 2 * np.count_nonzero(size[place] > d) < len(place):
                break
            lanes = np.packbits(together)
            at = np.flatnonzero(lanes)
            q, r = divmod(d, 8)
            a, b, mine = planes[0], planes[r], lanes[at]
            count = [np.full(len(at), 255 * (preset >> c & 1), np.uint8) for c in range(counters)]
            over = ~mine
            for p in range(0, 64, 8):
                x = a[p : p + 8][:, at] ^ b[p : p + 8][:, at + q]
                for y in range(0, 8, 2):  # a full adder takes two planes and the lowest counter at once
                    u, v, low = x[y], x[y + 1], count[0]
                    w = u ^ v
                    count[0] = w ^ low
                    carry = (u & v) | (w & low)
                    for c in range(1, counters):
                        carry, count[c] = count[c] & carry, count[c] ^ carry
                    over |= carry
                if p >= 8:
                    alive = np.flatnonzero(over != 255)
                    if len(alive) < 0.7 * len(at):
                        at, over, count = at[alive], over[alive], [c[alive] for c in count]
                        if not len(at):
                            break
            if len(at):
                lane = np.unpackbits(~over).reshape(-1, 8)
                row, k = np.nonzero(lane)
                i = at[row] * 8 + k
                i = i[i < n]
                if len(i):
                    yield place[i], place[i + d]
            d += 1
        place = place[size[place] > d]
        if d >= most:
            break


def forest(fp: np.ndarray, group: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what close pairs join, at most one fewer than there are rows."""
    label, parent, out = np.arange(len(fp)), list(range(len(fp))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in close_pairs(fp, group, radius):
        new = label[i] != label[j]
        i, j = i[new], j[new]
        if not len(i):
            continue
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            a, b = root(p), root(q)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((p, q))
        up = np.array(parent)
        while (up[up] != up).any():
            up = up[up]
        label, parent = up, up.tolist()
    return out


def links(prints: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(u, v) fingerprints, joined as all pairs of distinct fingerprints (column fp) with at most ``radius`` differing bits."""
    spark = prints.sparkSession
    signed = [m - (1 << 64) if m >> 63 else m for m in tables(n, radius)]
    keyed = prints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed))).alias("t", "key"))
    crowded = written(keyed.groupBy("t", "key").count().where(F.col("count") > TILE))
    if crowded.isEmpty():
        keyed = keyed.withColumn("tile", F.lit(0).cast("long"))
    else:  # rows of tile i meet tile j in tile pair (i, j): no group outgrows two tiles
        tiles = F.coalesce(F.ceil(F.col("count") / TILE), F.lit(1)).cast("long")
        other, own = F.col("other"), F.pmod(F.xxhash64("fp"), F.col("tiles"))
        keyed = keyed.join(crowded, ["t", "key"], "left").withColumn("tiles", tiles).withColumn("own", own)
        keyed = keyed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        keyed = keyed.withColumn("tile", F.least("own", other) * F.col("tiles") + F.greatest("own", other))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[np.ndarray] = []  # a row for each of t, key, tile and fp

        def compare(rows: np.ndarray) -> dict:
            t, key, tile, fp = rows
            new = np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
            pairs = np.array(forest(fp, np.cumsum(new), radius), np.int64).reshape(-1, 2)
            u, v = fp[pairs[:, 0]], fp[pairs[:, 1]]
            return {"u": np.maximum(u, v), "v": np.minimum(u, v)}

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("t", "key", "tile", "fp")]))
            if sum(x.shape[1] for x in held) < ROWS:
                continue
            rows = np.concatenate(held, axis=1)
            open_ = (rows[:3] == rows[:3, -1:]).all(axis=0)
            held = [rows[:, open_]]
            if not open_.all():
                yield compare(rows[:, ~open_])
        if held:
            yield compare(np.concatenate(held, axis=1))

    dealt = keyed.select("t", "key", "tile", "fp").repartition(parts(spark), "t", "key", "tile").sortWithinPartitions("t", "key", "tile", "fp")
    return map_batches(dealt, run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node of ``edges`` (u > v) but the smallest of each component, with that smallest.

    Large-star and small-star steps in turn; each round is a written table, so that a lost executor costs one round.
    """
    edges, before = written(edges), None
    while True:
        count, digest = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not count or (count, digest) == before:
            return edges
        before = (count, digest)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def near_duplicates(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (signed long), component_id for every row of ``docs`` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id that links of at most ``radius`` bits reach. A null, empty or blank text has
    fingerprint zero and is linked like any other. Repeated rows share a fingerprint and so a component. A null
    doc_id counts as larger than any other and is a component_id only where all ids are null. An empty table gives none.
    """
    prints = written(fingerprints(docs, words, seed))
    distinct = prints.groupBy("fp").agg(F.min("doc").alias("least"))
    distinct = written(distinct)
    stars = components(links(distinct, distinct.count(), radius))
    rooted = written(distinct.join(stars.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("v", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = join_dealt(rooted, smallest, "root", "fp").select("fp", "component")
    out = join_dealt(prints, named, "fp", "doc")
    own = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(own("doc").alias("doc_id"), "fp", own("component").alias("component_id"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
