"""Suffix-array dedup (8): bytes covered by a 100-byte string that also starts earlier are removed.

Super-k-mer strings (see ``superkmers``) bring all copies of a window to one bucket. There the collection's
Burrows-Wheeler transform and common prefixes are built column by column: round j inserts, for every string at
once, the symbol before its suffix of length j, at the place that the transform built so far gives it, and updates
the common prefixes of the rows around it. Both columns live in files that every round reads and writes once, from
front to back. Rows whose common prefix reaches ``width`` are equal windows; all but the earliest are removed. Equal
strings are inserted once, with their number as a weight: a row of weight two or more is a repeat like any other.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import superkmers as S
from .common import identified, own_id, table

WIDTH = 100
K = 16
#: Strings of one collection, unless more share one minimiser.
COLLECTION = 450
#: Most bytes in one symbol: of the numbers that divide the width, the largest up to this is the stride. A string becomes as
#: many strings as the stride says, one for each place of its end, and rounds become fewer.
STRIDE = 10
_KINDS = ["<i8", S.ROW, "<i4", "u1", "<u2", "u1", "u1", "?"]
_CODE = S.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Column:
    """One value a row, in an unnamed file that goes when the task ends."""

    def __init__(self, kind: type) -> None:
        self.file, self.kind = tempfile.TemporaryFile(), kind

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.fromfile(self.file, self.kind)

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        values.tofile(self.file)
        self.file.truncate(values.nbytes)
        self.file.flush()

    def close(self) -> None:
        self.file.close()


def _range_mins(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo:hi]) for each range; taken from the back, as reduceat then skips what lies between them."""
    order = np.argsort(lo, kind="stable")[::-1]
    pairs = np.empty(2 * len(lo), np.int64)
    pairs[0::2], pairs[1::2] = lo[order], hi[order]
    out = np.empty(len(lo), np.uint8)
    out[order] = np.minimum.reduceat(values, pairs)[::2]
    return out


def _order(values: np.ndarray) -> np.ndarray:
    """A stable order; wide values go by their halves, as sorts of 16 bits count instead of comparing."""
    if values.dtype == np.uint16:
        return np.argsort(values, kind="stable")
    low = np.argsort(values.astype(np.uint16), kind="stable")
    return low[np.argsort((values >> np.uint32(16)).astype(np.uint16)[low], kind="stable")]


def collection_bwt(symbols: np.ndarray, at: np.ndarray, length: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Transform and common prefixes (up to ``cap``) of all suffixes of the strings symbols[at:at + length] (values from 1).

    Rows 0 to m - 1 are the empty suffixes, in the strings' order, which also orders equal suffixes. A 0 in the
    transform stands before the start of a string.
    """
    m = len(at)
    bwt_file, lcp_file = Column(symbols.dtype.type), Column(np.uint8)
    try:
        end = at + length
        bwt_file.write(symbols[end - 1])
        lcp_file.write(np.zeros(m, np.uint8))
        place, string = np.arange(m), np.arange(m)  # of each string that still grows: its newest row, by row
        for j in range(1, int(length.max()) + 1):
            bwt, lcp = bwt_file.read(), lcp_file.read()
            going = length[string] >= j
            place, string = place[going], string[going]
            order = _order(bwt)
            zeros = int(np.count_nonzero(bwt == 0))
            by_symbol = _order(bwt[place])
            place, string = place[by_symbol], string[by_symbol]
            newest = np.zeros(len(bwt), bool)
            newest[place] = True
            rank = np.flatnonzero(newest[order])  # of the newest rows in the order of their next suffixes
            # Common prefixes change at the new rows and at the rows that follow them.
            touched = np.zeros(len(bwt) + 1, bool)
            touched[rank] = touched[rank + 1] = True
            touched = np.flatnonzero(touched[:-1])
            here, before = order[touched], order[np.maximum(touched - 1, 0)]
            linked = (bwt[here] == bwt[before]) & (touched > 0)
            value = np.zeros(len(touched), np.uint8)
            if linked.any():
                least = _range_mins(np.append(lcp, np.uint8(0)), before[linked] + 1, here[linked] + 1)
                value[linked] = np.minimum(least, cap - 1) + 1
            place = m - zeros + rank
            fresh = np.zeros(len(bwt) + len(place), bool)
            fresh[place] = True
            old = ~fresh
            grown = np.empty(len(fresh), symbols.dtype)
            left = length[string] - j
            grown[place] = np.where(left > 0, symbols[np.maximum(end[string] - j - 1, 0)], 0)
            grown[old] = bwt
            bwt_file.write(grown)
            grown = np.empty(len(fresh), np.uint8)
            grown[old] = lcp
            grown[m - zeros + touched] = value
            lcp_file.write(grown)
        return bwt_file.read(), lcp_file.read()
    finally:
        bwt_file.close()
        lcp_file.close()


def _numbered(tokens: np.ndarray, at: np.ndarray, stride: int) -> np.ndarray:
    """Numbers, from 1, of the symbols of ``stride`` bytes at these places: equal ones for equal symbols, in the order of a hash.

    Any order of symbols makes a transform whose equal rows lie together. Each symbol is compared with the one that gave
    its number; should two share a hash, the bytes themselves are sorted.
    """
    codes = np.zeros(len(at), np.uint64)
    for lo in range(0, stride, 8):
        code = np.zeros(len(at), np.uint64)
        for i in range(lo, min(lo + 8, stride)):
            code = code << np.uint64(8) | tokens[at + i]
        codes = S.mix(codes * np.uint64(0x9E3779B97F4A7C15) + code)
    seen, one, number = np.unique(codes, return_index=True, return_inverse=True)
    if any((tokens[at + i] != tokens[at[one] + i][number]).any() for i in range(stride)):
        wide = np.stack([tokens[at + i] for i in range(stride)], axis=1)
        seen, number = np.unique(wide, axis=0, return_inverse=True)
    return (number.ravel() + 1).astype(np.uint16 if len(seen) < 65_535 else np.uint32)


def _equal_windows(strings: S.Strings, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of one collection: does the same string also start earlier in it, and is it there more than once?

    ``weight``: how many equal strings each one stands for; it is the earliest of them.
    """
    stride = max(d for d in range(1, STRIDE + 1) if strings.width % d == 0)
    width, m = strings.width // stride, len(strings)
    size = strings.n + strings.width - 1
    at, length, end = [], [], []
    for phase in range(stride):
        length.append((size - phase) // stride)
        end.append(strings.at + size - phase)
        at.append(end[-1] - stride * length[-1])
    at, length = np.concatenate(at), np.concatenate(length)
    symbols = _numbered(strings.tokens, np.repeat(at, length) + stride * S.ranges(np.zeros(len(at), np.int64), length), stride)
    bwt, lcp = collection_bwt(symbols, np.cumsum(length) - length, length, width)
    following = np.empty(len(bwt), np.int64)
    following[_order(bwt)] = np.arange(len(bwt))
    first = np.cumsum(strings.n) - strings.n
    row_of = np.empty(int(strings.n.sum()), np.int64)
    rows, string = np.arange(len(at)), np.arange(len(at))
    for j in range(1, int(length.max()) + 1):
        going = length[string] >= j
        rows, string = following[rows[going]], string[going]  # starts sort before all else, as the empty suffixes do
        if j >= width:
            row_of[first[string % m] + size[string % m] - string // m - stride * j] = rows
    same = lcp >= width
    group = np.cumsum(~same)
    of_window = np.repeat(np.arange(m), strings.n)
    many = np.bincount(group[row_of], weight[of_window], minlength=len(lcp) + 1)[group[row_of]] > 1
    flag = np.zeros(len(row_of), bool)
    which = np.flatnonzero(many)
    if len(which):
        of = of_window[which]
        start = strings.start[of] + S.ranges(np.zeros(m, np.int64), strings.n)[which]
        g, doc = group[row_of[which]], strings.doc[of]
        order = np.lexsort((start, doc, g))
        g, doc, start = g[order], doc[order], start[order]
        head = np.maximum.accumulate(np.where(np.concatenate([[True], g[1:] != g[:-1]]), np.arange(len(g)), 0))
        flag[which[order]] = (doc != doc[head]) | (start != start[head])
    return flag, many


def _context_shared(strings: S.Strings) -> np.ndarray:
    """Strings that another shares half a window's context with, left or right of the minimiser, as equal windows must.

    That holds where both have their minimiser once, at ``pos``. A string marked twice may hold it elsewhere too (or its
    place is not known), so it and all strings of its minimiser stay.
    """
    half, n, size = (strings.width - K) // 2, len(strings), strings.n + strings.width - 1
    keys = np.tile(np.arange(n, dtype=np.uint64), (2, 1))  # a side that is too short has a key of its own
    for lo in range(0, n, 1000):
        i = np.arange(lo, min(lo + 1000, n))
        h = S.spread(_CODE[strings.tokens[S.ranges(strings.at[i], size[i])]], half)
        begin = np.cumsum(size[i]) - size[i] + strings.pos[i]
        for side, place, there in ((0, begin - half, strings.pos[i] >= half), (1, begin + K, strings.pos[i] + K + half <= size[i])):
            keys[side, i[there]] = h[place[there]] ^ strings.mini[i[there]]
    shared = np.isin(strings.mini, strings.mini[strings.twice])
    for key in keys:
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        shared |= count[back] > 1
    return shared


def repeats(strings: S.Strings) -> np.ndarray:
    """For each window: does the same string also start earlier (smaller id, or same document and earlier start)?

    Equal packed strings are inserted once, the earliest with the number of all as its weight; only a string that is
    alone in its text, its minimiser or its half-window contexts, and so can't hold a repeat, is not inserted.
    Collections have about ``COLLECTION`` strings; equal windows share a minimiser and so a collection.
    """
    length = strings.n + strings.width - 1
    order = np.lexsort((strings.start, strings.doc))
    least: dict[bytes, int] = {}
    head = np.empty(len(strings), np.int64)
    for i, a, b in zip(order.tolist(), strings.at[order].tolist(), (strings.at + length)[order].tolist(), strict=True):
        head[i] = least.setdefault(strings.tokens[a:b].tobytes(), i)
    del least
    copy = (strings.doc != strings.doc[head]) | (strings.start != strings.start[head])
    weight = 1 + np.bincount(head[copy], minlength=len(strings))
    flag, many = np.zeros(int(strings.n.sum()), bool), np.zeros(int(strings.n.sum()), bool)
    first = np.cumsum(strings.n) - strings.n
    heads = np.flatnonzero(head == np.arange(len(strings)))
    near = strings.pick(heads).repeated()
    near[near] = _context_shared(strings.pick(heads[near]))
    heads = heads[near | (weight[heads] > 1)]
    heads = heads[np.argsort(strings.mini[heads], kind="stable")]
    while len(heads):
        most = min(COLLECTION, len(heads))
        cut = int(np.searchsorted(strings.mini[heads], strings.mini[heads[most - 1]], side="right"))
        some, heads = heads[:cut], heads[cut:]
        few = strings.pick(some)
        few.tokens = strings.tokens[S.ranges(few.at, length[some])]
        few.at = np.cumsum(length[some]) - length[some]
        flag[S.ranges(first[some], few.n)], many[S.ranges(first[some], few.n)] = _equal_windows(few, weight[some])
    later = np.flatnonzero(copy)
    flag[S.ranges(first[later], strings.n[later])] = many[S.ranges(first[head[later]], strings.n[later])]
    return flag


def _mapper(width: int):
    def mapper_for(buckets: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            carry = None
            for texts, ids, rows in S.blocks(batches, S.BLOCK):
                body = b"".join(texts)
                tokens = np.frombuffer(body, np.uint8)
                lengths = np.array([len(t) for t in texts], np.int64)
                strings = S.cut(tokens, _CODE[tokens], lengths, np.array(ids, np.int64), np.array(rows, S.ROW), width, K)
                spans, kept, carry = S.settle(strings, repeats, S.CROWD, carry)
                packed = []
                for bucket, group in S.by_bucket(kept, buckets):
                    columns = [np.diff(group.doc, prepend=0), group.row, group.start.astype("<i4"), group.n.astype("u1"), (group.mini >> 16).astype("<u2"), (group.mini >> 8).astype("u1"), group.pos.astype("u1"), group.twice]
                    packed.append((bucket, S.pack(columns, kept.tokens[S.ranges(group.at, group.n + width - 1)].tobytes())))
                yield from S.moved(spans, packed)

        return run

    return mapper_for


def _reducer(width: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [rows.loc[rows["blob"].isna(), ["doc", "row", "start", "stop"]]]
        heads, bodies = [], []
        for blob in rows["blob"].dropna():
            head, body = S.unpack(blob, _KINDS)
            heads.append([np.cumsum(head[0]), *head[1:]])
            bodies.append(body)
        if heads:
            doc, row, start, n, high, low, pos, twice = (np.concatenate(x) for x in zip(*heads, strict=True))
            n, mini = n.astype(np.int64), high.astype(np.uint32) << 8 | low  # three bytes tell a bucket's minimisers well enough apart
            lengths = n + width - 1
            strings = S.Strings(width, np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(lengths) - lengths, n, doc, row, start.astype(np.int64), mini, pos.astype(np.int64), twice)
            spans = S.settle(strings, repeats)[0]
            if spans:
                doc, row, start, stop = spans
                out.append(pd.DataFrame({"doc": doc, "row": row.astype(str), "start": start, "stop": stop}))
        return pd.concat(out).astype({"doc": "int64", "start": "int32", "stop": "int32"})

    return run


def repeated_strings(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc, row, spans) of rows of identified() with ``width``-byte strings that also start earlier."""
    return S.spans_of(rows, _mapper(width), _reducer(width))


def dedup_suffixes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans for every row of ``docs`` (doc_id, text; other columns are ignored).

    A cut may fall inside a character, so the kept bytes are binary. A null text counts as empty; texts under
    ``width`` bytes stay whole. Rows with one doc_id and one text are one document; with other texts they are two,
    of which the equal strings that start at the same place both stay. A null doc_id counts as larger than any
    other. An empty table gives none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(batch["doc"], batch["text"], batch["spans"], strict=True):
                body = text.encode() if isinstance(text, str) else b""
                gone = S.covered(spans, len(body), width)
                kept = np.frombuffer(body, np.uint8)[~gone].tobytes() if spans is not None else body
                out.append((doc, kept, len(body), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))))
            yield pd.DataFrame(out, columns=["doc", "kept", "n_bytes", "n_removed", "n_spans"])

    rows = identified(docs)
    return own_id(S.with_spans(rows, repeated_strings(rows, width)).mapInPandas(run, "doc long, kept binary, n_bytes long, n_removed long, n_spans long"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_suffixes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as two hexadecimal digits each, as DuckDB cuts texts by characters.
OP8_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, doc_id, 1000 * c AS b, substr(h, 2000 * c + 1, {2 * (1000 + WIDTH - 1)}) AS s FROM d, unnest(range(0, length(h) // 2000 + 1)) AS t(c)),
g AS (SELECT r, doc_id, b + j AS i, md5(substr(s, 2 * j + 1, {2 * WIDTH})) AS g FROM c, unnest(range(0, length(s) // 2 - {WIDTH - 1})) AS t(j)),
again AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
run AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > {WIDTH}, true) AS new FROM again),
span AS (SELECT r, s, min(i) AS a, max(i) + {WIDTH} AS b FROM (SELECT r, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS s FROM run) GROUP BY r, s),
piece AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM span),
k AS (SELECT p.r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last FROM piece AS p JOIN d ON d.r = p.r GROUP BY p.r)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN k ON k.r = d.r"""
