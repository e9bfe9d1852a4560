"""Super-k-mers: cutting token sequences into runs of windows that share a minimiser, and moving them to buckets.

A *window* is ``width`` consecutive tokens (words or bytes) of one document; its *minimiser* is the smallest hash
of the k-grams inside it. Equal windows have equal minimisers, so a bucket chosen by minimiser sees all copies of
a window. Consecutive windows of one document with the same minimiser travel together as one packed string.

The flow, for a ``marker`` that knows how to find repeated windows among the strings of one bucket:

1. *map*: a block of documents (``BLOCK`` bytes) is cut into super-k-mers. The marker runs on the block first, as a
   combiner: windows repeated inside the block are settled at once and only the first of each goes on. What is left of
   crowded minimisers is also carried on to the task's next block, whose strings are settled against it, so a passage
   that a third of all documents share reaches its bucket once per task and not once per document.
2. *exchange*: the strings of one block for one bucket travel as one compressed row. Each task of the other side reads
   as many buckets as any other, so none grows with the corpus.
3. *bucket*: a minimiser seen once in one string cannot hold a repeat; all other strings go through the marker.
4. spans found in 1 and 3 are gathered per document and joined to its text.

Every bucket holds about ``BUCKET`` bytes of input at any corpus size: their number follows the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

BLOCK = 4 << 20
BUCKET = 8 << 20
#: Most tasks that read buckets: beyond, each reads several, one after the other.
TASKS = 1 << 15
#: Strings of one minimiser in a block from which it is crowded, and the most tokens carried from block to block: more and the carrying starts anew.
CROWD, CARRY = 16, 1 << 20
#: Longest run of windows in one string. Longer runs (periodic texts) are cut, not dropped.
RUN = 85
#: Tokens hashed at a time.
TILE = 1 << 17
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
MOVED = "bucket int, doc long, row string, start int, stop int, blob binary"
#: How a row's key (see identified()) is held: 32 hexadecimal digits or nothing, which compresses to next to nothing.
ROW = "S32"


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= _M2
    h ^= h >> np.uint64(27)
    return h


def spread(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width``-gram, by doubling; position i stands for codes[i:i + width]."""
    h, have = codes.astype(np.uint64), 1
    while have < width:
        step = min(have, width - have)
        h = mix(h[:-step] * _M1 + h[step:]) if len(h) > step else h[:0]
        have += step
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[:-step], h[step:]) if len(h) > step else h[:0]
        have += step
    return h


class Strings:
    """Super-k-mers side by side: token codes in ``tokens``; string i is tokens[at[i]:at[i] + n[i] + width - 1].

    ``pos``: where the string first holds its minimiser. ``twice``: the string holds its minimiser more than once, so that a window can repeat inside it.
    """

    FIELDS = ("at", "n", "doc", "row", "start", "mini", "pos", "twice")

    def __init__(self, width, tokens, at, n, doc, row, start, mini, pos, twice):
        self.width, self.tokens, self.at, self.n = width, tokens, at, n
        self.doc, self.row, self.start, self.mini, self.pos, self.twice = doc, row, start, mini, pos, twice

    def __len__(self) -> int:
        return len(self.n)

    def columns(self) -> list[np.ndarray]:
        return [getattr(self, f) for f in self.FIELDS]

    def pick(self, which: np.ndarray) -> Strings:
        return Strings(self.width, self.tokens, *(x[which] for x in self.columns()))

    def repeated(self, least: int = 2) -> np.ndarray:
        """Strings whose minimiser occurs ``least`` times or, for 2, elsewhere at all; no other string can hold a repeated window."""
        if not len(self):
            return np.zeros(0, bool)
        _, back, count = np.unique(self.mini, return_inverse=True, return_counts=True)
        return (count[back] >= least) | (self.twice & (least == 2))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... lengths[i] of them, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def cut(tokens: np.ndarray, codes: np.ndarray, lengths: np.ndarray, doc: np.ndarray, row: np.ndarray, width: int, k: int) -> Strings:
    """Super-k-mers of a block: documents lie one after the other in ``tokens`` and ``codes``; some at a time, as caches are small."""
    first = np.cumsum(lengths) - lengths
    parts, i = [], 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(first, first[i] + TILE)))
        parts.append(_cut(codes[first[i] : first[j - 1] + lengths[j - 1]], first[i:j], lengths[i:j], doc[i:j], row[i:j], width, k))
        i = j
    if not parts:
        parts = [_cut(codes, first, lengths, doc, row, width, k)]
    return Strings(width, tokens, *(np.concatenate(x) for x in zip(*parts, strict=True)))


def _cut(codes, first, lengths, doc, row, width, k) -> list[np.ndarray]:
    windows = np.maximum(lengths - width + 1, 0)
    base = first[0] if len(first) else 0
    at = ranges(first - base, windows)
    if not len(at):
        none = np.zeros(0, np.int64)
        return [none, none, none, row[:0], none, none.astype(np.uint32), none, none.astype(bool)]
    grams = (spread(codes, k) >> np.uint64(32)).astype(np.uint32)
    mini = sliding_min(grams, width - k + 1)[at]
    of = np.repeat(np.arange(len(lengths)), windows)
    new = np.ones(len(at), bool)
    new[1:] = (mini[1:] != mini[:-1]) | (of[1:] != of[:-1])
    run = np.flatnonzero(new)
    new |= (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % RUN == 0
    run = np.flatnonzero(new)
    n = np.diff(np.append(run, len(at)))
    least, inside = mini[run], n + width - k
    equal = grams[ranges(at[run], inside)] == np.repeat(least, inside)
    begin = np.cumsum(inside) - inside
    twice = np.add.reduceat(equal, begin, dtype=np.int32) > 1
    hits = np.flatnonzero(equal)
    pos = hits[np.searchsorted(hits, begin)] - begin
    return [at[run] + base, n, doc[of[run]], row[of[run]], at[run] + base - first[of[run]], least, pos, twice]


def settle(strings: Strings, repeats: Callable[[Strings], np.ndarray], least: int = 2, carry: Strings | None = None) -> tuple[list, Strings, Strings | None]:
    """Spans of repeated windows, the runs of windows that are the first of their kind here, and what to carry to the next block.

    ``least``: a combiner may leave minimisers with fewer strings to the bucket. ``carry``: strings that have gone on before,
    of crowded minimisers; new ones of those are settled against them, and so may they be, if the new ones are earlier.
    """
    m, join = 0, lambda a, b: np.concatenate([a, b])
    which = strings.repeated(least)
    if carry is not None and len(strings):
        carry = carry.pick(np.isin(carry.mini, strings.mini))
        m = len(carry)
        which = join(np.ones(m, bool), which | np.isin(strings.mini, carry.mini))
        columns = dict(zip(Strings.FIELDS, map(join, carry.columns(), strings.columns()), strict=True))
        columns["at"][m:] += len(carry.tokens)
        strings = Strings(strings.width, join(carry.tokens, strings.tokens), **columns)
    few = strings.pick(which)
    if not len(few):
        return [], strings, None
    flag = repeats(few)
    of = np.repeat(np.arange(len(few)), few.n)
    within = ranges(np.zeros(len(few), np.int64), few.n)
    edge = np.ones(len(flag), bool)
    edge[1:] = (flag[1:] != flag[:-1]) | (of[1:] != of[:-1])
    run = np.flatnonzero(edge)
    n, s, i = np.diff(np.append(run, len(flag))), of[run], within[run]
    gone = flag[run]
    spans = [few.doc[s[gone]], few.row[s[gone]], few.start[s[gone]] + i[gone], few.start[s[gone]] + i[gone] + n[gone]]
    s, i, n = s[~gone], i[~gone], n[~gone]
    rest = Strings(strings.width, strings.tokens, few.at[s] + i, n, few.doc[s], few.row[s], few.start[s] + i, few.mini[s], np.zeros(len(s), np.int64), np.ones(len(s), bool))
    before = s < m
    alone, new = strings.pick(~which), rest.pick(~before)
    kept = Strings(strings.width, strings.tokens, *map(join, alone.columns(), new.columns()))
    _, back, count = np.unique(few.mini, return_inverse=True, return_counts=True)
    crowded = rest.pick(((count[back] >= CROWD) | np.isin(few.mini, few.mini[:m]))[s])
    lengths = crowded.n + strings.width - 1
    if not len(crowded) or lengths.sum() > CARRY:
        return spans, kept, None
    crowded.tokens, crowded.at = strings.tokens[ranges(crowded.at, lengths)], np.cumsum(lengths) - lengths
    return spans, kept, crowded


def blocks(batches: Iterator, limit: int) -> Iterator[tuple[list[bytes], list[int], list[str]]]:
    """Whole documents of about ``limit`` bytes together: (texts, ids, row keys)."""
    texts, ids, rows, size = [], [], [], 0
    for batch in batches:
        for doc, row, text in zip(batch["doc"], batch["row"], batch["text"], strict=True):
            body = text.encode()
            if size and size + len(body) > limit:
                yield texts, ids, rows
                texts, ids, rows, size = [], [], [], 0
            texts.append(body)
            ids.append(doc)
            rows.append(row)
            size += len(body)
    if texts:
        yield texts, ids, rows


def moved(spans: list, packed: list[tuple[int, bytes]]) -> Iterator:
    """Rows of MOVED: spans already settled (dealt by document), and packed strings (dealt by minimiser)."""
    import pandas as pd  # here, as other operators share this module without it

    if spans:
        doc, row, start, stop = spans
        yield pd.DataFrame({"bucket": np.full(len(doc), -1, np.int32), "doc": doc, "row": row.astype(str), "start": start.astype(np.int32), "stop": stop.astype(np.int32), "blob": None})
    for i in range(0, len(packed), 256):
        some = packed[i : i + 256]
        yield pd.DataFrame({"bucket": np.array([b for b, _ in some], np.int32), "doc": 0, "row": "", "start": np.int32(0), "stop": np.int32(0), "blob": [x for _, x in some]})


def pack(columns: list[np.ndarray], body: bytes) -> bytes:
    """Ids and places as differences, then the tokens, compressed together."""
    head = b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=6).compress(np.array([len(columns[0])], "<i8").tobytes() + head + body)


def unpack(blob: bytes, kinds: list[str]) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out, raw[at:]


def by_bucket(strings: Strings, buckets: int) -> Iterator[tuple[int, Strings]]:
    where = (mix(strings.mini.astype(np.uint64) * _M1) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    edges = np.flatnonzero(np.diff(where[order])) + 1
    for group in np.split(order, edges):
        if len(group):
            yield int(where[group[0]]), strings.pick(group)


def spans_of(rows: DataFrame, mapper: Callable, reducer: Callable) -> DataFrame:
    """(doc, row, spans) for rows of identified(): the repeated windows of each as start-stop pairs of window starts.

    ``mapper(buckets)`` and ``reducer`` are functions for mapInPandas and applyInPandas over MOVED rows.
    """
    buckets = max(8, -(-text_bytes(rows) // BUCKET))
    tasks = min(buckets, TASKS)
    sent = rows.where("text is not null").mapInPandas(mapper(buckets), MOVED)
    # Settled spans need no bucket: a negative one spreads them by document.
    key = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("doc"), F.lit(buckets))).otherwise(F.col("bucket")).cast("int")
    dealt = sent.withColumn("bucket", key).withColumn("task", F.pmod(F.col("bucket"), F.lit(tasks)).cast("int"))
    found = dealt.repartitionById(tasks, F.col("task")).groupBy("task", "bucket").applyInPandas(reducer, "doc long, row string, start int, stop int")
    return found.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """doc, text and the spans (null: none) of every row, repeated rows included; own_id() turns doc back to doc_id."""
    return rows.join(spans, ["doc", "row"], "left").select("doc", "text", "spans")


def covered(spans: np.ndarray | None, n: int, width: int) -> np.ndarray:
    """Which of n tokens a repeated window covers."""
    step = np.zeros(n + 1, np.int64)
    if spans is not None and len(spans):
        start, stop = np.array([(x["start"], x["stop"]) for x in spans], np.int64).T
        np.add.at(step, start, 1)
        np.add.at(step, stop + width - 1, -1)
    return np.cumsum(step[:-1]) > 0
