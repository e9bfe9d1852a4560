"""Language ID (10): prediction by partial matching over bytes.

Each language has a context tree: how often each byte followed each context of up to ``ORDER`` bytes. A byte's
probability comes from the longest context in which it was seen, after an escape from each longer one (method C: a
context seen N times with U different successors escapes with probability U / (N + U)); below order 0 every byte is
as likely. Statistics are frozen before any text is scored, so the exact code length of every (context, byte) pair is
a number in a table, and scoring a text adds up what its bytes cost under each language. The trees of all languages
share one trie of byte strings, which is walked for all places of a text at once.

Training uses distinct pieces of labelled texts up to a bound: about ``SAMPLE`` bytes a language, in the order of a hash
of the piece, so that neither copies nor very long texts crowd a language out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, table, written

ORDER = 4
#: Bytes of training text for each language, about.
SAMPLE = 1 << 19
#: Characters in one piece of a text.
PIECE = 4096
#: Pieces are counted in SLOTS slots by hash, each of which has SLOTS slots of its own: where a sample ends is found in two steps.
SLOTS = 1 << 12
UNKNOWN = "und"
#: Bytes before a text's first one, as contexts see them.
_BEFORE = b"\n" * ORDER


def _grams(texts: list[bytes], n: int = ORDER + 1) -> np.ndarray:
    """Codes of all n-byte strings that end inside a text, one for each of its bytes."""
    out = []
    for t in texts:
        b = np.frombuffer(_BEFORE + t, np.uint8).astype(np.int64)
        code = b[: len(b) - n + 1]
        for i in range(1, n):
            code = code << 8 | b[i : len(b) - n + 1 + i]
        out.append(code)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def count_grams(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n): five-byte strings of ``labelled`` (lang, text), counted in each batch before they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text.encode())
            for lang, some in texts.items():
                gram, n = np.unique(_grams(some), return_counts=True)
                yield {"lang": [lang] * len(gram), "gram": gram, "n": n}

    return map_batches(labelled.select("lang", "text"), run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def training_sample(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Distinct pieces of up to ``PIECE`` characters of ``labelled`` (lang, text): for each language about ``sample`` bytes, or all it has.

    Pieces are taken in the order of slots that their hash gives, up to and with the slot in which the bytes of distinct
    pieces reach the bound. So no language with a text is without a piece, and the sample passes the bound by one slot
    at most: a piece, or one part in ``SLOTS`` ** 2 of all that a language has.
    """
    cut = F.when(F.octet_length("text") <= PIECE, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    pieces = labelled.select("lang", F.explode(cut).alias("text"))
    slot = lambda h: F.pmod(h, F.lit(SLOTS * SLOTS)).cast("int")
    sizes = pieces.select("lang", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("bytes")).distinct()
    fine = written(sizes.groupBy("lang", slot(F.col("hash")).alias("slot")).agg(F.sum("bytes").alias("bytes")))
    # Of the coarse slots, then of the fine ones in the last of them: bytes before each. Both windows have SLOTS rows a language.
    coarse = F.floor(F.col("slot") / SLOTS).alias("coarse")
    before = lambda by: F.sum("bytes").over(Window.partitionBy("lang").orderBy(by)) - F.col("bytes")
    steps = fine.groupBy("lang", coarse).agg(F.sum("bytes").alias("bytes")).withColumn("had", before("coarse")).where(F.col("had") < sample)
    last = steps.groupBy("lang").agg(F.max("coarse").alias("coarse"), F.max("had").alias("had"))
    ends = fine.withColumn("coarse", coarse).join(last, ["lang", "coarse"]).withColumn("before", before("slot") + F.col("had"))
    ends = {r["lang"]: r["slot"] for r in ends.where(F.col("before") < sample).groupBy("lang").agg(F.max("slot").alias("slot")).collect()}
    if not ends:
        return labelled.limit(0)
    picked = slot(F.xxhash64("text")) <= F.element_at(F.create_map(*(F.lit(x) for kv in ends.items() for x in kv)), F.col("lang"))
    # The sample has a fixed bound: few partitions mean few partial counts of one string.
    return pieces.where(picked).dropDuplicates(["lang", "text"]).repartition(len(ends))


@dataclass
class Model:
    """Code lengths in bits. ``step[k][node, symbol]``: the trie's node one byte deeper, 0 if no language has it."""

    langs: list[str]
    symbol: np.ndarray  # of each byte; 0 for bytes outside the trie
    step: list[np.ndarray]
    cost: list[np.ndarray]  # cost[k]: of a string of k + 1 bytes, its last byte after the others, by node and language
    escape: list[np.ndarray]  # escape[k]: from a context of k bytes, by node and language
    lowest: float

    @classmethod
    def of(cls, counts) -> Model:
        """Of a pandas frame (lang, gram, n)."""
        langs = sorted(counts["lang"].unique())
        number = counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
        gram, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
        seen = np.unique(gram & 255)
        symbol = np.zeros(256, np.int64)
        symbol[seen] = np.arange(1, len(seen) + 1)
        width, many = len(seen) + 1, len(langs)
        strings = [np.unique(gram & (1 << 8 * (k + 1)) - 1) for k in range(ORDER + 1)]
        # A string's contexts must be nodes too: those that only open a text are.
        for k in range(ORDER, 0, -1):
            strings[k - 1] = np.unique(np.concatenate([strings[k - 1], strings[k] >> 8]))
        extra = np.unique(np.concatenate([s >> 8 * k for k, s in enumerate(strings)]))
        for b in extra:
            if not symbol[b]:
                symbol[b], width = width, width + 1
        step, cost, escape = [], [], []
        lowest = 8.0
        shorter = np.full((1, many), lowest)
        for k in range(ORDER + 1):
            s = strings[k]
            context = np.searchsorted(strings[k - 1], s >> 8) + 1 if k else np.zeros(len(s), np.int64)
            walk = np.zeros((len(strings[k - 1]) + 1 if k else 1, width), np.int32)
            walk[context, symbol[s & 255]] = np.arange(1, len(s) + 1)
            count = np.zeros((len(s) + 1, many))
            np.add.at(count, (np.searchsorted(s, gram & (1 << 8 * (k + 1)) - 1) + 1, number), n)
            # Of each context: bytes seen after it, and how many different ones.
            total, kinds = np.zeros((len(walk), many)), np.zeros((len(walk), many))
            np.add.at(total, context, count[1:])
            np.add.at(kinds, context, count[1:] > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                out = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
                own = np.log2((total + kinds)[context] / count[1:])
            below = shorter[np.searchsorted(strings[k - 1], s & (1 << 8 * k) - 1) + 1] if k else np.full((len(s), many), lowest)
            here = np.where(count[1:] > 0, own, out[context] + below)
            shorter = np.concatenate([np.zeros((1, many)), here])
            step.append(walk)
            cost.append(shorter.astype(np.float32))
            escape.append(out.astype(np.float32))
        return cls(langs, symbol, step, cost, escape, lowest)

    def bits(self, body: bytes) -> np.ndarray:
        """Code length of a text under each language."""
        total = np.zeros(len(self.langs))
        for lo in range(0, len(body), 1 << 18):
            before = (_BEFORE + body[max(0, lo - ORDER) : lo])[-ORDER:]
            total += self._bits(np.frombuffer(before + body[lo : lo + (1 << 18)], np.uint8)).sum(axis=0, dtype=np.float64)
        return total

    def bits_of(self, bodies: list[bytes]) -> np.ndarray:
        """Code lengths of short texts together, a row each."""
        lengths = np.array([len(b) + ORDER for b in bodies], np.int64)
        each = self._bits(np.frombuffer(b"".join(_BEFORE + b for b in bodies), np.uint8))
        each = np.concatenate([np.zeros((ORDER, len(self.langs)), np.float32), each])
        begins = np.cumsum(lengths) - lengths
        each[(begins[:, None] + np.arange(ORDER)).ravel()] = 0
        return np.add.reduceat(each, begins, axis=0, dtype=np.float64)

    def _bits(self, raw: np.ndarray) -> np.ndarray:
        """Of each byte after the first ORDER ones."""
        sym = self.symbol[raw]
        node = [self.step[0][0, sym]]
        for k in range(1, ORDER + 1):
            node.append(np.concatenate([[0], self.step[k][node[-1][:-1], sym[1:]]]))
        out = self.cost[ORDER][node[ORDER][ORDER:]]
        # Where the full string is unknown to all languages: escape to shorter contexts until one is known.
        left = np.flatnonzero(node[ORDER][ORDER:] == 0) + ORDER
        k = ORDER
        while len(left):
            context = node[k - 1][left - 1] if k else np.zeros(len(left), np.int64)
            out[left - ORDER] += self.escape[k][context]
            if not k:
                out[left - ORDER] += self.lowest
                break
            k -= 1
            deep = node[k][left]
            out[left[deep > 0] - ORDER] += self.cost[k][deep[deep > 0]]
            left = left[deep == 0]
        return out


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of ``labelled`` (lang, text); None if no row has both, or all texts are empty."""
    rows = labelled.where("lang is not null and text <> ''").select("lang", "text")
    counts = count_grams(training_sample(rows, sample)).toPandas()
    return Model.of(counts) if len(counts) else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` (text among them; lang_pred and score are replaced), with lang_pred and score.

    lang_pred is the language under which the whole text is coded shortest, ties to the first by name; score its
    posterior probability (0 to 1) if all were as likely before. Null texts and texts without a letter give ``und``
    and 0, as do all texts if there is no model.
    """
    cols = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for array in batches:
            texts = array.to_pylist()
            found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
            waiting: list[int] = []
            bodies: list[bytes] = []

            def settle(i: int, bits: np.ndarray, found=found) -> None:
                found[i] = (model.langs[int(np.argmin(bits))], float(1 / np.exp2(bits.min() - bits).sum()))

            def flush(waiting=waiting, bodies=bodies) -> None:
                for i, bits in zip(waiting, model.bits_of(bodies) if bodies else (), strict=True):
                    settle(i, bits)
                waiting.clear()
                bodies.clear()

            held = 0
            for i, text in enumerate(texts):
                if model is None or not isinstance(text, str) or not any(map(str.isalpha, text)):
                    continue
                body = text.encode()
                if len(body) >= 1 << 16:
                    settle(i, model.bits(body))
                    continue
                waiting.append(i)
                bodies.append(body)
                held += len(body)
                if held >= 1 << 18:
                    flush()
                    held = 0
            flush()
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["lang_pred", "score"])

    predicted = F.arrow_udf(run, "lang_pred string, score double")
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("doc"), predicted("text").alias("found"))
    return out.select("doc.*", "found.*")


def held_out(doc_id: Column) -> Column:
    """One document in five, by a checksum of its id; a null id is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
