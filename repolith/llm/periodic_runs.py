"""Periodic run detection (12): stretches of words that repeat with a period, from a suffix automaton with link-cut access.

The automaton's suffix links form a tree whose paths to the root are the suffixes of what was read. Each node has a
colour: where its strings ended last. Appending a word at place i recolours the path from the new node to the root, so
the path is cut into segments of one colour each, and a link-cut tree (splay trees over preferred paths, with a
segment's colour at its splay tree's root) finds those segments without walking their nodes. A segment of colour e
whose deepest node has strings of n words says that the last n words at i also ended at e, and nowhere between: with
d = i - e, that is a stretch of period d and length n + d, a square if n >= d. It is the smallest period of the
stretch if n >= 2d, as a smaller one would have ended in between. Stretches are extended both ways to runs.

Only words that can lie in a run are appended: all windows of ``WINDOW`` words inside a run recur one period on or
back, and a period is at most a quarter of the run, so windows whose nearest equal is farther than that from them go
(numpy, with hashes whose collisions only keep more), again and again in what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table
from .superkmers import ranges

#: A run has at least so many words, and so many periods.
LEAST, PERIODS = 6, 4
#: A run of length m >= max(6, 4q) holds m - q >= 5 words before its last period, for every q.
WINDOW = 5
#: Times that what is left is judged again; what stays is appended, so more rounds only spare work.
ROUNDS = 8
#: Documents and characters of text that a task answers at a time.
ROWS, CHARS = 1000, 4 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def stretch_runs(codes: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs among ``codes``: O(n log n) words' worth of amortised work, O(n) memory."""
    n = len(codes)
    size = 2 * n + 2
    length, link, following = [0] * size, [0] * size, [None] * size
    left, right, up, colour = [0] * size, [0] * size, [0] * size, [-1] * size  # of the splay trees; node 0 is none, 1 the root
    following[1] = {}
    last = count = 1
    until: dict[int, int] = {}  # by period: where the newest stretch of it ends
    out = []

    def rotate(x: int, p: int, g: int) -> None:
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def splay(x: int) -> None:
        p = up[x]
        if not p or (left[p] != x and right[p] != x):
            return
        while p and (left[p] == x or right[p] == x):
            g = top = up[p]
            if g and (left[g] == p or right[g] == p):
                if (left[g] == p) == (left[p] == x):
                    rotate(p, g, up[g])
                    rotate(x, p, up[p])
                else:
                    rotate(x, p, g)
                    rotate(x, g, up[g])
            else:
                top = p
                rotate(x, p, g)
            p = up[x]
        colour[x] = colour[top]

    for i, c in enumerate(codes):
        count += 1
        new = count
        length[new], following[new] = i + 1, {}
        p = last
        while p and c not in following[p]:
            following[p][c] = new
            p = link[p]
        parent = 1
        if p:
            parent = q = following[p][c]
            if length[q] != length[p] + 1:
                count += 1
                parent = count
                length[parent], following[parent], link[parent], link[q] = length[p] + 1, following[q].copy(), link[q], parent
                while p and following[p].get(c) == q:
                    following[p][c] = parent
                    p = link[p]
                splay(q)  # the copy comes right above q on q's preferred path, and has its colour
                above = left[parent] = left[q]
                if above:
                    up[above] = parent
                left[q], up[parent] = parent, q
        link[new] = up[new] = parent
        below, x = new, parent
        while x:
            splay(x)
            e = colour[x]
            d = i - e
            if e >= 0 and length[x] >= 2 * d and until.get(d, 0) <= i:
                a, b = i + 1 - length[x] - d, i + 1
                while a and codes[a - 1] == codes[a - 1 + d]:
                    a -= 1
                while b < n and codes[b] == codes[b - d]:
                    b += 1
                until[d] = b
                if b - a >= max(LEAST, PERIODS * d):
                    out.append((a, b - a, d))
            if right[x]:
                colour[right[x]] = e  # what lies deeper on the old path keeps its colour
            right[x] = below
            up[below] = x
            below, x = x, up[x]
        colour[below] = i
        last = new
    return out


def _nearest(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each of ascending ``places``, how far the nearest one with an equal key is."""
    far = np.iinfo(np.int64).max
    order = np.argsort(keys, kind="stable")
    key, place = keys[order], places[order]
    gap = np.where(key[1:] == key[:-1], place[1:] - place[:-1], far)
    out = np.full(len(keys), far)
    out[order[1:]] = gap
    out[order[:-1]] = np.minimum(out[order[:-1]], gap)
    return out


def stretches(codes: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of disjoint stretches, such that every run lies in one."""
    n, odd = len(codes), np.uint64(0x9E3779B97F4A7C15)
    if n < LEAST:
        return []
    m = n - WINDOW + 1
    words, grams = codes.astype(np.uint64), np.zeros(m, np.uint64)
    for j in range(WINDOW):
        grams = (grams ^ (grams >> np.uint64(29))) * odd + words[j : j + m]
    places, reach, keys, before, rounds = np.arange(m), np.full(m, n // PERIODS), grams, n + 1, ROUNDS
    while True:
        rounds -= 1
        good = places[_nearest(keys, places) <= reach]
        step = np.zeros(n + 2, np.int64)
        np.add.at(step, good + 1, 1)
        np.add.at(step, good + 1 + WINDOW, -1)
        edge = np.diff((np.cumsum(step) > 0).astype(np.int8))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = stop - start >= LEAST
        start, stop = start[long], stop[long]
        size = stop - start
        if not len(start) or not rounds or size.sum() == before:
            return list(zip(start.tolist(), stop.tolist(), strict=True))
        before, windows = size.sum(), size - WINDOW + 1
        # What is left is judged again, each stretch by itself.
        places, reach = ranges(start, windows), np.repeat(size // PERIODS, windows)
        keys = grams[places] + np.repeat(np.arange(len(start)), windows).astype(np.uint64) * odd


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``words``, by start, then period."""
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    return sorted((a + s, n, d) for a, b in stretches(codes) for s, n, d in stretch_runs(codes[a:b].tolist()))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that any run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, n, period in runs:
        gone[start + period : start + n] = True
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed_text for every row of ``docs``.

    ``docs`` has doc_id and text (other columns are ignored). Words are runs of anything but ASCII white space, numbered
    from 0; collapsed_text is the words that stay, joined by one space. A null, empty or blank text has no words, no runs
    and an empty collapsed_text. Rows are answered one by one where they lie, so repeated rows and ids, and null ids, have
    results of their own. A text is held whole by its task, with some 600 bytes for each word of its longest stretch that
    may hold runs. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out, chars = ([], [], [], []), 0
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                words = (text.as_py() or "").encode().split()
                runs = runs_of(words)
                kept = b" ".join(collapse(words, runs)).decode()
                for column, value in zip(out, (doc.as_py(), len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], kept), strict=True):
                    column.append(value)
                chars += len(kept)
                if len(out[0]) == ROWS or chars >= CHARS:
                    yield dict(zip(("doc_id", "n_words", "runs", "collapsed_text"), out, strict=True))
                    out, chars = ([], [], [], []), 0
            if out[0]:
                yield dict(zip(("doc_id", "n_words", "runs", "collapsed_text"), out, strict=True))

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, f"doc_id long, n_words long, runs {RUNS}, collapsed_text string")


def _repeated_tail(doc_id: Column, text: Column) -> Column:
    """The texts that op12 is asked about: of one document in ten, words from a place on repeat the first of them."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n = F.size(words).cast("long")

    def again(w: Column) -> Column:  # words, and here they have a name and are made once
        size = F.size(w).cast("long")
        a = g % size
        p = 1 + F.floor((size - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    return F.when((h % 10 == 0) & (n > 0), F.get(F.transform(F.array(words), again), F.lit(0))).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _repeated_tail(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(docs)
    # The greatest length / period, exactly; among equals the first, as runs come by start, then period.
    better = lambda a, b: a["length"] * b["period"] < b["length"] * a["period"]
    best = F.aggregate(F.slice("runs", F.lit(2), F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )
