"""Benchmark decontamination (5): spans of training documents that benchmark items hold too.

Test items, normalised to words, form one generalised suffix automaton. Training words stream through it while the
length of the longest match that ends at each word is tracked; where it reaches the window's length (or a whole
shorter item ends), the words of that match are hit. Words outside the benchmark's word pairs can't extend a match
and are passed over in bulk. Items are taken in blocks of about ``BLOCK`` bytes of text, by hash, and tasks build a
block's automaton. One block, the usual case, is broadcast, and documents are read once.

Of several blocks none goes to the driver. A map of fixed size tells, while documents are read, which of their windows may
be some item's; the stretches that those cover are written, routed by their windows to the blocks that hold them, and
matched there. So documents are read twice, to be searched and to be given their findings, however many blocks there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_dealt, map_batches, parts, table, text_bytes, written

WINDOW, BLOCK = 10, 2 << 20
#: Size of the map of windows, which is the driver's and broadcast: 16 MB. A fuller map lets more stretches through, and loses none.
MAP_BITS = 1 << 27
_LETTERS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and everything beyond ASCII."""
    return text.encode().translate(_LETTERS).split() if isinstance(text, str) else []


@dataclass
class Automaton:
    """Suffix automaton of the items of one block, over word numbers, with what matching needs at each state."""

    vocab: dict[bytes, int]
    pairs: np.ndarray  # sorted codes of adjacent word pairs
    next: list[dict[int, int]]
    link: list[int]
    length: list[int]
    window: int
    shortest: int
    short: list[tuple[int, ...]]  # items under one window that end here as a whole, longest first
    items: dict[int, frozenset[int]]  # state of a full window -> items that hold it
    full: list[int]  # state of the last window of any longer match
    item_ids: list
    sizes: list[int]

    @classmethod
    def of(cls, items: list[tuple[object, list[bytes]]], window: int) -> Automaton:
        vocab: dict[bytes, int] = {}
        nxt, link, length = [{}], [-1], [0]
        pairs: set[tuple[int, int]] = set()
        coded = [[vocab.setdefault(w, len(vocab)) for w in words] for _, words in items]

        def extend(last: int, c: int) -> int:
            if c in nxt[last]:
                q = nxt[last][c]
                if length[last] + 1 == length[q]:
                    return q
                return split(last, c, q)
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[p] + 1 == length[q] else split(p, c, q)
            return cur

        def split(p: int, c: int, q: int) -> int:
            copy = len(nxt)
            nxt.append(dict(nxt[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            link[q] = copy
            while p != -1 and nxt[p].get(c) == q:
                nxt[p][c] = copy
                p = link[p]
            return copy

        for codes in coded:
            state = 0
            for c in codes:
                state = extend(state, c)
            pairs.update(zip(codes, codes[1:], strict=False))
        made = cls(vocab, np.unique(np.array([a * len(vocab) + b for a, b in pairs], np.int64)), nxt, link, length, window, 0, [()] * len(nxt), {}, [0] * len(nxt), [i for i, _ in items], [len(w) for _, w in items])
        by_length = sorted(range(1, len(nxt)), key=length.__getitem__)
        for s in by_length:
            made.full[s] = s if length[link[s]] < window else made.full[link[s]]
        # Once all items are in, walk each again: where it ends if short, and whose window each window's state is.
        ends: dict[int, list[int]] = {}
        held: dict[int, set[int]] = {}
        for i, codes in enumerate(coded):
            if 0 < len(codes) < window:
                state = 0
                for c in codes:
                    state = nxt[state][c]
                ends.setdefault(state, []).append(i)
            else:
                for state, n, _ in made.walk(codes):
                    if n >= window:
                        held.setdefault(made.full[state], set()).add(i)
        made.items = {s: frozenset(x) for s, x in held.items()}
        for s in by_length:
            made.short[s] = (*ends.get(s, ()), *made.short[link[s]])
        made.shortest = min([n if n < window else window for n in made.sizes if n], default=window)
        return made

    def walk(self, codes: list[int]) -> Iterator[tuple[int, int, int]]:
        """(state, length of the longest match that ends here, place) for every word."""
        nxt, link, length = self.next, self.link, self.length
        state = n = 0
        for at, c in enumerate(codes):
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if c in nxt[state]:
                state, n = nxt[state][c], n + 1
            else:
                n = 0
            yield state, n, at

    def match(self, words: list[bytes], limit: int) -> tuple[np.ndarray, set[int], int]:
        """Which words are hit, the items found, and the longest match. Matches reach over ``limit`` words or a whole short item."""
        get, n = self.vocab.get, len(words)
        code = np.fromiter((get(w, -1) for w in words), np.int64, n)
        step, found, longest = np.zeros(n + 1, np.int64), set(), 0  # where hits begin and end
        # Runs of words in which each adjacent pair is some item's; a match lies inside one run.
        known = code >= 0
        joined = np.zeros(n + 1, bool)
        if n > 1 and len(self.pairs):
            pair = code[:-1] * len(self.vocab) + code[1:]
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[1:n] = known[:-1] & known[1:] & (self.pairs[place] == pair)
        first = np.flatnonzero(known & ~joined[:n])
        last = np.flatnonzero(known & ~joined[1:]) + 1
        long = last - first >= min(self.shortest, limit)
        for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
            for state, m, at in self.walk(code[a:b].tolist()):
                if m >= limit:
                    longest = max(longest, m)
                    step[a + at + 1 - m] += 1
                    step[a + at + 1] -= 1
                    found |= self.items.get(self.full[state], frozenset())
                for i in self.short[state]:
                    if self.sizes[i] <= m:
                        longest = max(longest, self.sizes[i])
                        step[a + at + 1 - self.sizes[i]] += 1
                        step[a + at + 1] -= 1
                        found.add(i)
        return np.cumsum(step[:-1]) > 0, found, longest


FOUND = "n_words long, n_hit long, longest long, items array<string>, hits array<struct<start:long,stop:long>>"
_built: dict[str, Automaton] = {}


def _automaton(name: str, items: list[tuple[object, str]], window: int) -> Automaton:
    """Of one block; a worker process keeps the last."""
    if name not in _built:
        _built.clear()
        _built[name] = Automaton.of([(i, words_of(t)) for i, t in items], window)
    return _built[name]


def _matcher(spark: SparkSession, items: DataFrame, window: int):
    """A function of texts, in the tasks, that tells what the block ``items`` (item_id, text) hits in each."""
    block = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in items.orderBy("item_id", "text").collect()])
    name, kinds = uuid.uuid4().hex, spark.createDataFrame([], FOUND).toArrow().schema

    def some(texts: list, a: Automaton | None) -> list[tuple]:
        out = []
        for text in texts:
            words = words_of(text)
            hit, found, longest = a.match(words, window) if a else (np.zeros(len(words), bool), set(), 0)
            runs = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8))).reshape(-1, 2).tolist()
            ids = sorted({str(a.item_ids[x]) for x in found if a.item_ids[x] is not None}) if found else []
            out.append((len(words), int(hit.sum()), longest, ids, [{"start": s, "stop": e} for s, e in runs]))
        return out

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = _automaton(name, block.value, window) if block.value else None
        for texts in batches:
            rows = some(texts.to_pylist(), a)
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], x.type) for i, x in enumerate(kinds)], fields=list(kinds))

    return F.arrow_udf(run, FOUND)


def _windows(words: list[bytes], lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, a hash of each window of so many words) for the lengths asked for, in one sweep."""
    code = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    rolled = np.zeros(len(words) + 1, np.uint64)
    for m in range(1, min(max(lengths, default=0), len(words)) + 1):
        rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[m - 1 :]
        if m in lengths:
            mixed = (rolled ^ (rolled >> np.uint64(29)) ^ np.uint64(m)) * np.uint64(0xBF58476D1CE4E5B9)
            yield m, (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def _item_windows(blocks: DataFrame, window: int) -> DataFrame:
    """length, key, block: each window of the items once a block; shorter items are one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for block, text in zip(batch["block"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = words_of(text)
                for m, keys in _windows(words, [min(len(words), window)]):
                    keys = np.unique(keys)
                    yield {"length": [m] * len(keys), "key": keys, "block": [block] * len(keys)}

    return written(map_batches(blocks.select("block", "text"), run, "length int, key long, block int").distinct())


def _window_map(windows: DataFrame) -> np.ndarray:
    """A bit for each hash of a window: at most ``MAP_BITS`` of them, whatever the number of windows."""
    bit = (F.col("key").bitwiseAND(F.lit(MAP_BITS - 1)) + 1).alias("bit")
    pages = windows.select(bit).groupBy(F.bitmap_bucket_number("bit").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for r in pages.toLocalIterator():
        page = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["page"] - 1) * len(page) : r["page"] * len(page)] = page
    return out


STRETCHES = "keys array<long>, stretches array<struct<start:long,words:string>>"


def _searcher(spark: SparkSession, windows: DataFrame):
    """A function of texts, in the tasks, that gives the windows the map knows and the stretches of words they cover."""
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # 1 to the window's length
    bits = spark.sparkContext.broadcast(_window_map(windows))
    kinds = spark.createDataFrame([], STRETCHES).toArrow().schema

    def one(text: str) -> tuple[list, list]:
        words, known = words_of(text), []
        step = np.zeros(len(words) + 1, np.int64)
        for m, keys in _windows(words, lengths):
            place = keys & np.int64(MAP_BITS - 1)
            at = np.flatnonzero(bits.value[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            np.add.at(step, at, 1)
            np.add.at(step, at + m, -1)
            known.append(keys[at])
        covered = np.cumsum(step[:-1]) > 0
        runs = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]]).astype(np.int8))).reshape(-1, 2).tolist()
        keys = np.unique(np.concatenate(known)).tolist() if known else []
        return keys, [{"start": a, "words": b" ".join(words[a:b]).decode()} for a, b in runs]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [one(t) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], x.type) for i, x in enumerate(kinds)], fields=list(kinds))

    return F.arrow_udf(run, STRETCHES), bits


HITS = "digest string, longest long, items array<string>, hits array<struct<start:long,stop:long>>"


def _match_blocks(rows: DataFrame, window: int) -> DataFrame:
    """What the stretches of each text hit in a block. ``rows`` are sorted: a block's items, then the texts routed to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        here, items, a = None, [], None
        for batch in batches:
            out: dict[str, list] = {"digest": [], "longest": [], "items": [], "hits": []}
            for r in batch.to_pylist():
                if r["block"] != here:
                    here, items, a = r["block"], [], None
                if r["stretches"] is None:
                    if a is None:  # else they are the same block's once more, for its next share of texts
                        items.append((r["id"], words_of(r["text"])))
                    continue
                if a is None:
                    a, items = Automaton.of(items, window), []
                found, longest, hits = set(), 0, []
                for s in r["stretches"]:
                    hit, some, m = a.match(s["words"].encode().split(), window)
                    found, longest = found | some, max(longest, m)
                    edges = (np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]).astype(np.int8))) + s["start"]).reshape(-1, 2)
                    hits += [{"start": x, "stop": y} for x, y in edges.tolist()]
                if hits:
                    out["digest"].append(r["id"])
                    out["longest"].append(longest)
                    out["items"].append(sorted({a.item_ids[x] for x in found if a.item_ids[x] is not None}))
                    out["hits"].append(hits)
            yield out

    return map_batches(rows, run, HITS)


def _united(hits: pa.Array) -> pa.Array:
    """Sorted runs of each row; those that touch or overlap made one."""
    out = []
    for runs in hits.to_pylist():
        one: list[dict] = []
        for r in runs:
            if one and r["start"] <= one[-1]["stop"]:
                one[-1]["stop"] = max(one[-1]["stop"], r["stop"])
            else:
                one.append(r)
        out.append(one)
    return pa.array(out, hits.type)


def _findings(texts: DataFrame, blocks: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The digests of all ``texts`` (digest, text), and what each distinct text that is hit hits in any of the ``blocks``.

    A block that more than a small share of the stretches is routed to is dealt out: its items are repeated for each share.
    """
    spark = texts.sparkSession
    windows = _item_windows(blocks, window)
    search, bits = _searcher(spark, windows)
    searched = written(texts.select("digest", search("text").alias("found")).select("digest", "found.*"))
    bits.destroy()
    known = written(searched.where("size(keys) > 0").dropDuplicates(["digest"]))
    holders = windows.groupBy("key").agg(F.collect_set("block").alias("blocks"))  # at most all blocks
    wanted = known.select("digest", F.explode("keys").alias("key"))
    routed = written(join_dealt(wanted, holders, "key", "digest", "inner").select("digest", F.explode("blocks").alias("block")).distinct())
    share = routed.count() // (4 * parts(spark)) + 1
    shares = written(routed.groupBy("block").agg((F.count(F.lit(1)) / share + 1).cast("int").alias("shares")))
    crowded = F.broadcast(shares.where("shares > 1"))  # at most four for each partition
    mine = routed.join(crowded, "block", "left").withColumn("share", F.pmod(F.xxhash64("digest"), F.coalesce("shares", F.lit(1))).cast("int"))
    stretches = mine.join(known, "digest").select("block", "share", F.lit(1).alias("kind"), F.col("digest").alias("id"), F.lit(None).cast("string").alias("text"), "stretches")
    dealt = blocks.join(shares, "block").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    items = dealt.select("block", "share", F.lit(0).alias("kind"), F.col("item_id").cast("string").alias("id"), "text", F.lit(None).cast("array<struct<start:long,words:string>>").alias("stretches"))
    rows = items.unionByName(stretches).repartition(parts(spark), "block", "share").sortWithinPartitions("block", "share", "kind", "id", "text")
    found = _match_blocks(rows, window).groupBy("digest").agg(F.max("longest").alias("longest"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    return searched.select("digest"), written(found.withColumn("hits", F.arrow_udf(_united, "array<struct<start:long,stop:long>>")("hits")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """All columns of ``docs`` (text among them; columns named as those below are replaced), with n_words, n_hit, longest
    (words of the longest match that counts, else 0), items (sorted item_ids as strings), and hits (array of start, stop: runs of hit words).

    A word is hit if it lies in an occurrence of ``window`` consecutive words of an item, or of a whole shorter item.
    Null or wordless texts have no words, null or wordless items no windows; an empty benchmark hits nothing. Repeated
    items are found together. Null item_ids count for hits but are not listed. ``block``: bytes of items taken together.
    """
    spark = docs.sparkSession
    added = ("n_words", "n_hit", "longest", "items", "hits")
    cols = [c for c in docs.columns if c not in added]
    items = benchmark.select("item_id", "text").where("text is not null")
    n = max(1, -(-text_bytes(items) // block))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("doc"), "text")
    if n == 1:
        matched = _matcher(spark, items, window)
        return whole.select("doc", matched("text").alias("found")).select("doc.*", "found.*")
    # What a text hits depends on the text alone: findings meet it by its digest.
    digest = F.sha2("text", 256).alias("digest")
    blocks = items.withColumn("block", F.pmod(F.xxhash64(F.col("item_id").cast("string"), "text"), F.lit(n)).cast("int"))
    texts, both = _findings(whole.where("text is not null").select(digest, "text"), blocks, window)
    n_words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), lambda w: w != "")).cast("long")
    # A missing text has a key of its own, and copies of a text that is hit are dealt out.
    keyed = whole.withColumn("digest", F.coalesce(digest, F.concat(F.lit("-"), F.hex(F.xxhash64("doc")))))
    out = join_dealt(keyed, both, "digest", "doc", counted=texts)
    zero = F.lit(0).cast("long")
    n_hit = F.aggregate("hits", zero, lambda acc, x: acc + x["stop"] - x["start"])
    return out.select("doc.*", n_words.alias("n_words"), F.coalesce(n_hit, zero).alias("n_hit"), F.coalesce("longest", zero).alias("longest"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("hits", F.array().cast("array<struct<start:long,stop:long>>")).alias("hits"))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """``docs`` without hit spans; documents of which more than ``coverage`` of the words are hit go as a whole.

    A text that is hit loses its hit words with what stands between them; all other text stays as it is, and
    documents without a hit keep their text to the byte. Columns stay those of ``docs``.
    """
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "text")
    found = contamination(whole, benchmark, window)
    kept = found.where((F.col("n_hit") == 0) | (F.col("n_hit") <= coverage * F.col("n_words")))
    # Each piece ends with one word, whose number is the piece's.
    pieces = F.split("text", "(?<=[0-9A-Za-z[^\\x00-\\x7F]])(?![0-9A-Za-z[^\\x00-\\x7F]])", -1)
    cut = F.array_join(F.filter(pieces, lambda piece, i: ~F.exists("hits", lambda h: (h["start"] <= i) & (i < h["stop"]))), "")
    text = F.when(F.col("n_hit") > 0, cut).otherwise(F.col("text"))
    return kept.select(*((text if c == "text" else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
OP5_SQL = f"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS g FROM b, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS t(i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
h AS (SELECT DISTINCT x.r, x.i, x.n, bg.item_id FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM bg) AS ns, unnest(range(1, len(w) - n + 2)) AS t(i)) AS x JOIN bg ON bg.n = x.n AND bg.g = x.g),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT DISTINCT r, i, n FROM h), unnest(range(i, i + n)) AS t(p) GROUP BY r),
ids AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated FROM d LEFT JOIN hit ON hit.r = d.r LEFT JOIN ids ON ids.r = d.r"""
