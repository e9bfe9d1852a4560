"""Packing (6): token sequences cut from the stream of documents, in order, where cuts hurt least.

Documents follow each other in doc_id order; a sequence is a window of that stream. Windows may end at a document's
end (free), at a sentence's end (``SENTENCE`` tokens' worth of harm) or anywhere else (``INSIDE``); a window's other
cost is its padding. Dynamic programming over the places for a cut finds the cheapest set: as padding falls with the
distance between two cuts, the best earlier cut is a sliding minimum, kept in a monotone queue.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, map_batches, parts, table, text_bytes

SIZE, SENTENCE, INSIDE = 1024, 2, 8
#: Tokens planned together; what follows the last cuts of one stretch opens the next.
STRETCH = 1 << 18
#: Parts of the stream hold about so many bytes of text each; a part's last sequence may stay short.
PART = 32 << 20


def choose_cuts(places: np.ndarray, harm: np.ndarray, size: int, open_end: bool = False) -> list[int]:
    """Indices of the cuts, from 0 to the last place, with least padding plus harm; no two chosen neighbours over ``size`` apart.

    ``places`` ascend from 0; neighbours are ``size`` apart at most. cost(j) = min over i of cost(i) + size - (p_j - p_i)
    + harm(j): the minimum of cost(i) + p_i over the places within reach, whatever j is. With ``open_end`` more will
    follow: the last cut is then the cheapest of those within ``size`` of the end, and what is behind it stays open.
    """
    p, h = places.tolist(), harm.tolist()
    came, cost = [0] * len(p), [0] * len(p)
    reach: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + place, index), ascending in both
    for j in range(1, len(p)):
        low = p[j] - size
        while p[reach[0][1]] < low:
            reach.popleft()
        key, came[j] = reach[0]
        key += size + h[j]
        cost[j] = key - p[j]
        while reach and reach[-1][0] >= key:
            reach.pop()
        reach.append((key, j))
    out = [len(p) - 1]
    if open_end:
        near = [j for j in range(1, len(p)) if p[j] > p[-1] - size]
        out = [min(near, key=cost.__getitem__)]
    while out[-1]:
        out.append(came[out[-1]])
    return out[::-1]


def cut_places(lengths: np.ndarray, ends: np.ndarray, size: int, sentence: int, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """Places for cuts and their harm: documents' ends, sentences' ends, and in longer stretches without one every ``size // 32`` tokens."""
    stops = np.cumsum(lengths)
    places = np.unique(np.concatenate([[0], ends, stops]))
    gap = np.diff(places)
    wide = np.flatnonzero(gap > size // 32)
    extra = [np.arange(places[i] + size // 32, places[i + 1], size // 32) for i in wide.tolist()]
    places = np.unique(np.concatenate([places, *extra]))
    harm = np.full(len(places), inside)
    harm[np.isin(places, ends)] = sentence
    harm[np.isin(places, stops)] = 0
    harm[0] = 0
    return places, harm


#: How byte-level vocabularies of this kind cut a text before they merge: fixed by the format.
_CUT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: The faster library keeps a place to go back to for each character of white space that it passes, and fails beyond some
#: hundred thousand. A run that long is looked for only in a text that can hold one, and only from where it begins.
_LONG_BLANK, _BLANK = 1 << 16, re.compile(r"(?<!\s)\s{%d}" % (1 << 16))


class _Tokenizer:
    """Ids of whole texts; sentence ends are ids that stand for a full stop, question or exclamation mark, or a line break.

    A byte-level vocabulary whose ids follow the order of its merges is also a table of ranks: the same merges are then
    made by a faster library. Any other file, and texts that hold one of its added tokens or a very long run of white
    space, go through its own, which gives the same ids.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        self.ranks = self._by_rank(kind)
        words = kind["model"]["vocab"] if self.ranks is not None else self.model.get_vocab()
        words = words | {t["content"]: t["id"] for t in kind["added_tokens"]}
        marks = {c for c in ".?!"} | {"Ċ"}  # as byte-level vocabularies write a line break
        self.stops = np.zeros(max(words.values(), default=0) + 2, bool)
        self.stops[[i for w, i in words.items() if w and w[-1] in marks]] = True

    @cached_property
    def model(self):
        """The file in its own library; a worker that never needs it doesn't hold it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _by_rank(self, kind: dict):
        import tiktoken

        cut, model = kind["pre_tokenizer"] or {}, kind["model"]
        self.added = [t["content"] for t in kind["added_tokens"]]
        merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", ())]
        vocab = {w: i for w, i in model["vocab"].items() if w not in self.added} if model.get("type") == "BPE" else {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not kind["normalizer"] and not kind["post_processor"] and not model.get("ignore_merges")
        if not plain or len(vocab) != 256 + len(merges) or any(vocab.get(m.replace(" ", "")) != 256 + i for i, m in enumerate(merges)):
            return None
        # The format's letters for bytes: printable ones stand for themselves, the others follow from 256.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in own)}
        return tiktoken.Encoding("ranks", pat_str=_CUT, mergeable_ranks={bytes(map(letters.__getitem__, w)): i for w, i in vocab.items()}, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.ranks is None or any(a in text for a in self.added) or (len(text) >= _LONG_BLANK and _BLANK.search(text)):
            return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4")
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4")


@cache
def _tokenizer(path: str) -> _Tokenizer:
    """One for each worker process and file."""
    return _Tokenizer(path)


PIECES = "doc long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _stretch(rows: list[tuple[int, int, np.ndarray, int]], stops: np.ndarray, sequence: int, size: int, sentence: int, inside: int, last: bool):
    """Pieces of the sequences that a stretch of documents (id, start, ids, tokens of the whole) fills, and what stays open."""
    lengths, tokens = np.array([len(x[2]) for x in rows], np.int64), np.concatenate([x[2] for x in rows])
    places, harm = cut_places(lengths, np.flatnonzero(stops[tokens]) + 1, size, sentence, inside)
    cuts = places[choose_cuts(places, harm, size, not last)]
    if not last:
        cuts = cuts[: max(2, len(cuts) - 8)]  # the last ones may change with what follows
    ends = np.cumsum(lengths)
    begins = ends - lengths
    edges = np.unique(np.concatenate([cuts, ends[ends <= cuts[-1]]]))
    at, to = edges[:-1], edges[1:]
    of, window = np.searchsorted(ends, at, side="right"), np.searchsorted(cuts, at, side="right") - 1
    doc, start, whole = (np.array([x[i] for x in rows], np.int64) for i in (0, 1, 3))
    out = {"doc": doc[of], "start": start[of] + at - begins[of], "length": to - at, "ids": [tokens[a:b].tobytes() for a, b in zip(at.tolist(), to.tolist(), strict=True)], "doc_tokens": whole[of], "sequence_id": sequence + window, "offset": at - cuts[window]}
    i = int(np.searchsorted(ends, cuts[-1], side="right"))
    rest = rows[i:]
    if rest and cuts[-1] > begins[i]:
        d, s, ids, w = rest[0]
        rest[0] = (d, s + int(cuts[-1] - begins[i]), ids[cuts[-1] - begins[i] :], w)
    return out, rest, sequence + len(cuts) - 1


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 0, sentence: int = SENTENCE, inside: int = INSIDE, part_bytes: int = PART) -> DataFrame:
    """Pieces of documents in sequences of at most ``size`` tokens: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``docs`` has doc_id and text (other columns are ignored). A document's tokens are its text's ids and then
    ``end_id``; a null text is an empty one, of one token. ids are little-endian unsigned 32-bit numbers.
    ``tokenizer`` is the path of a tokenizers file that every executor has. Documents follow each other by doc_id
    (nulls last, repeated ids in any order) within parts of the stream, each of about ``part_bytes``; only a part's
    last sequence is planned without what comes after it. An empty table gives no pieces.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    total = text_bytes(rows)
    n = max(1, min(parts(spark), -(-total // (1 << 20))), -(-total // part_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        model = _tokenizer(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[int, int, np.ndarray, int]] = []
        tokens = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), (x.as_py() for x in batch.column("text")), strict=True):
                ids = model.ids(text)
                held.append((doc, 0, np.append(ids, np.uint32(end_id)), len(ids) + 1))
                tokens += len(ids) + 1
                if tokens >= STRETCH:
                    out, held, sequence = _stretch(held, model.stops, sequence, size, sentence, inside, False)
                    tokens = sum(len(x[2]) for x in held)
                    yield out
        if held:
            yield _stretch(held, model.stops, sequence, size, sentence, inside, True)[0]

    out = map_batches(rows.repartitionByRange(n, "doc").sortWithinPartitions("doc"), run, PIECES)
    return out.withColumn("doc", F.when(F.col("doc") != NO_ID, F.col("doc"))).withColumnRenamed("doc", "doc_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
