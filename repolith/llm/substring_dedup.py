"""Substring dedup (1): words covered by a 50-word window that an earlier document has too are removed.

Super-k-mer partitioning: consecutive windows that share a minimiser travel as one packed string to its bucket,
where the windows are sorted and equal neighbours counted exactly (a 64-bit key orders them; neighbours with one
key are then compared word by word).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import superkmers as S
from .common import identified, own_id, table

WIDTH = 50
#: Words in a minimiser: so many that few are frequent but those in passages that repeat, which settle on the way.
K = 8
#: Different words that a task numbers before it starts anew.
WORDS = 1 << 21
_KINDS = ["<i8", S.ROW, "<i4", "<u2", "<u4", "<u4"]


def repeats(strings: S.Strings) -> np.ndarray:
    """For each window: does the same word sequence start in a document with a smaller id?"""
    width, ids = strings.width, strings.tokens
    at = S.ranges(strings.at, strings.n)
    doc = np.repeat(strings.doc, strings.n)
    flag = np.zeros(len(at), bool)
    key = S.spread(S.mix(ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)), width)[at]
    order = np.lexsort((doc, key))
    same = key[order[1:]] == key[order[:-1]]
    # Only runs of one key need a look at the words themselves.
    runs = np.flatnonzero(np.concatenate([[True], ~same]))
    size = np.diff(np.append(runs, len(order)))
    runs, size = runs[size > 1], size[size > 1]
    if not len(runs):
        return flag
    head, member = np.repeat(order[runs], size), order[S.ranges(runs, size)]
    equal = np.ones(len(member), bool)
    for lo in range(0, len(member), 1 << 16):
        a, b = at[head[lo : lo + (1 << 16)]], at[member[lo : lo + (1 << 16)]]
        for j in range(width):
            equal[lo : lo + (1 << 16)] &= ids[a + j] == ids[b + j]
    flag[member] = doc[member] > doc[head]
    for r in np.unique(np.repeat(np.arange(len(runs)), size)[~equal]):  # different windows under one key
        least: dict[bytes, int] = {}
        for i in order[runs[r] : runs[r] + size[r]]:
            words = ids[at[i] : at[i] + width].tobytes()
            flag[i] = doc[i] > least.setdefault(words, doc[i])
    return flag


def _mapper(width: int, k: int):
    def mapper_for(buckets: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            number: dict[bytes, int] = {}
            code, carry = np.zeros(0, np.uint64), None
            for texts, ids, rows in S.blocks(batches, S.BLOCK):
                if len(number) > WORDS:
                    number, code, carry = {}, np.zeros(0, np.uint64), None
                words = [t.split() for t in texts]
                lengths = np.array([len(w) for w in words], np.int64)
                tokens = np.fromiter((number.setdefault(x, len(number)) for w in words for x in w), np.int64, int(lengths.sum()))
                fresh = len(number) - len(code)
                code = np.append(code, np.fromiter(map(xxhash.xxh64_intdigest, islice(reversed(number), fresh)), np.uint64, fresh)[::-1])
                strings = S.cut(tokens, code[tokens], lengths, np.array(ids, np.int64), np.array(rows, S.ROW), width, k)
                spans, kept, carry = S.settle(strings, repeats, 2, carry)
                flat = [x for w in words for x in w]
                kept.at = kept.at - (len(kept.tokens) - len(flat))  # all that is kept lies in this block's own words
                packed = []
                for bucket, group in S.by_bucket(kept, buckets):
                    bodies = [b" ".join(flat[a : a + n + width - 1]) for a, n in zip(group.at.tolist(), group.n.tolist(), strict=True)]
                    columns = [np.diff(group.doc, prepend=0), group.row, group.start.astype("<i4"), group.n.astype("<u2"), group.mini.astype("<u4"), np.array([len(b) for b in bodies], "<u4")]
                    packed.append((bucket, S.pack(columns, b" ".join(bodies))))
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
            doc, row, start, n, mini, size = (np.concatenate(x) for x in zip(*heads, strict=True))
            n = n.astype(np.int64)
            strings = S.Strings(width, None, np.zeros(len(n), np.int64), n, doc, row, start.astype(np.int64), mini, np.zeros(len(n), np.int64), np.zeros(len(n), bool))
            which = np.flatnonzero(strings.repeated())
            few = strings.pick(which)
            if len(few):
                body = b" ".join(bodies)
                ends = np.cumsum(size.astype(np.int64) + 1)
                number: dict[bytes, int] = {}
                words = b" ".join([body[a:b] for a, b in zip((ends - size - 1)[which].tolist(), (ends - 1)[which].tolist(), strict=True)]).split()
                few.tokens = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
                lengths = few.n + width - 1
                few.at = np.cumsum(lengths) - lengths
                spans = S.settle(few, repeats)[0]
                if spans:
                    doc, row, start, stop = spans
                    out.append(pd.DataFrame({"doc": doc, "row": row.astype(str), "start": start, "stop": stop}))
        return pd.concat(out).astype({"doc": "int64", "start": "int32", "stop": "int32"})

    return run


def repeated_windows(rows: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """(doc, row, spans) of rows of identified() with windows that a document with a smaller id has too."""
    return S.spans_of(rows, _mapper(width, k), _reducer(width))


def dedup_substrings(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """doc_id, kept_text, n_words, n_removed for every row of ``docs`` (doc_id, text; other columns are ignored).

    Words are runs of anything but ASCII white space; kept words are joined by one space. A null text has no words
    and gives an empty kept_text. Texts under ``width`` words keep all. Rows with one doc_id are never each other's
    earlier document, whatever their texts; a null doc_id counts as larger than any other. An empty table gives none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(batch["doc"], batch["text"], batch["spans"], strict=True):
                words = text.encode().split() if isinstance(text, str) else []
                gone = S.covered(spans, len(words), width)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if gone.any() else b" ".join(words)
                out.append((doc, kept.decode(), len(words), int(gone.sum())))
            yield pd.DataFrame(out, columns=["doc", "kept_text", "n_words", "n_removed"])

    rows = identified(docs)
    return own_id(S.with_spans(rows, repeated_windows(rows, width, k)).mapInPandas(run, "doc long, kept_text string, n_words long, n_removed long"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS g FROM d, unnest(range(1, len(w) - {WIDTH} + 2)) AS t(i)),
gone AS (SELECT DISTINCT r, p FROM (SELECT g.r, g.i FROM g JOIN (SELECT g, min(doc_id) AS first FROM g GROUP BY g) AS f ON f.g = g.g WHERE f.first < g.doc_id), unnest(range(i, i + {WIDTH})) AS t(p)),
k AS (SELECT x.r, count(gone.r) AS n_removed, string_agg(x.word, ' ' ORDER BY x.p) FILTER (WHERE gone.r IS NULL) AS kept FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) AS x LEFT JOIN gone ON gone.r = x.r AND gone.p = x.p GROUP BY x.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.r = d.r"""
