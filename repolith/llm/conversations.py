"""Conversation structure repair (11): the cheapest edits that make a conversation read ``(s?(ua)+)?``.

Messages are kept (0), given the role user or assistant (1), deleted (2; blank and repeated ones must be) or inserted
without text (5); an unfinished message that stays costs 5. The cost of what is left to do, by the state of the pattern
(nothing yet, after a system message, after a user's, after an assistant's), is found backwards. Those vectors are held
only at checkpoints, one every square root of the messages; walking forward, a block's vectors are made again from the
next checkpoint, and each step takes the ASCII-least edit that is tight.

A conversation may hold a large part of all messages. Messages are therefore sorted by range, and the part of a
conversation that lies in one range is a *segment*. For conversations of several segments, each segment first gives its
costs from any state to any other; folding those backwards, one small matrix a segment, gives the checkpoint at the end of
each segment; then the state that each segment is left in, for any state it may be entered in; then all segments are
walked at once. Messages travel as digests: texts are joined to the edits at the end, once.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, join_dealt, map_batches, parts, table, text_bytes, written

BLANK = " \t\n\x0b\f\r"
DELETE, REROLE, INSERT, UNFINISHED = 2, 1, 5, 5
#: Bytes of text to a range of messages, on average.
PART = 16 << 20
#: Messages' order: by turn, then, where turns are equal, by role and text, of which the first characters decide, then a digest.
ORDER = ["conv", "turn", "role", "head", "i1", "i2"]
HEAD = 64
#: What a digest reads as one row: so many neighbouring messages, at most so many characters.
CHUNK, PIECE = 64, 8192

#: States: nothing yet, after system, after user, after assistant. What inserting leads to, and what it costs to end well.
INSERTED, END = (2, 2, 3, 2), (0.0, 10.0, 5.0, 0.0)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
NOTHING = (None, None, None, None)
NAMES = {2: "user", 3: "assistant"}


def before(v: tuple, initial: str, harm: float) -> tuple:
    """Costs before a message, by state, from those after it."""
    to = [min(DELETE + v[s], REROLE + harm + v[INSERTED[s]]) for s in range(4)]
    for s, kept in enumerate(KEPT.get(initial, NOTHING)):
        if kept is not None:
            to[s] = min(to[s], harm + v[kept])
    user, assistant = min(to[2], INSERT + to[3]), min(to[3], INSERT + to[2])
    return (min(to[0], INSERT + user), min(to[1], INSERT + user), user, assistant)


def fold(messages: list[tuple[str, float]], v: tuple) -> tuple:
    for initial, harm in reversed(messages):
        v = before(v, initial, harm)
    return v


def walk(messages: list[tuple[str, float]], state: int, end: tuple) -> Iterator[tuple[list[int], str, int]]:
    """For each message (initial, harm) the states of what is inserted before it, its edit's initial, and the state after it."""
    m = len(messages)
    size = max(1, isqrt(m))
    checks, v = [end], end
    for i in range(m - 1, -1, -1):
        v = before(v, *messages[i])
        if i % size == 0:
            checks.append(v)
    for b in range(0, m, size):
        checks.pop()
        block = messages[b : b + size]
        after = [checks[-1]]
        for x in reversed(block[1:]):
            after.append(before(after[-1], *x))
        for initial, harm in block:
            v = after.pop()
            now, inserted = before(v, initial, harm), []
            while True:
                if now[state] == DELETE + v[state]:
                    edit = "D"
                elif now[state] == INSERT + now[INSERTED[state]]:
                    state = INSERTED[state]
                    inserted.append(state)
                    continue
                else:
                    kept = KEPT.get(initial, NOTHING)[state]
                    edit = "K" if kept is not None and now[state] == harm + v[kept] else "R"
                    state = kept if edit == "K" else INSERTED[state]
                break
            yield inserted, edit, state


def closing(state: int) -> list[int]:
    """States of what is inserted after the last message."""
    return {1: [2, 3], 2: [3]}.get(state, [])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one segment after the other; a segment may begin in one batch and end in the next."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for _, segment in groupby(rows, key=lambda r: r[:2]):
        yield list(segment)


def _live(segment: list[tuple]) -> list[tuple[str, float]]:
    return [(initial, harm) for _, _, _, initial, harm, gone, *_ in segment if not gone]


def _by_segment(rows: DataFrame, f, schema: str, *more: str) -> DataFrame:
    """``f`` of each segment's rows (conv, part, seq, initial, harm, gone, n, ...), in order; many columns a row of its output."""
    n = parts(rows.sparkSession)
    dealt = rows.select("conv", "part", "seq", "initial", "harm", "gone", "n", *more).repartition(n, "conv", "part").sortWithinPartitions("conv", "part", "seq")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out: list[tuple] = []
        for segment in _segments(batches):
            out += f(segment)
            if len(out) >= 2000:
                yield dict(zip(names, map(list, zip(*out, strict=True)), strict=True))
                out = []
        if out:
            yield dict(zip(names, map(list, zip(*out, strict=True)), strict=True))

    return map_batches(dealt, run, schema)


def _crossings(segment: list[tuple]) -> list[tuple]:
    live, none = _live(segment), float("inf")
    ways = [fold(live, tuple(0.0 if s == e else none for s in range(4))) for e in range(4)]
    return [(*segment[0][:2], [ways[e][s] for s in range(4) for e in range(4)])]


def _exits(segment: list[tuple]) -> list[tuple]:
    live, end, out = _live(segment), tuple(segment[0][7]), []
    for state in range(4):
        out.append(state)
        for *_, left in walk(live, state, end):
            out[-1] = left
    return [(*segment[0][:2], out)]


EDITS = "conv long, part long, seq long, i1 long, i2 long, initial string, illegal long, cost long, inserted array<string>, role string, edits string"


def _edits(segment: list[tuple]) -> list[tuple]:
    """A row for each message, with its copies, and one for what comes after the last."""
    conv, part, last = *segment[0][:2], segment[0][8]
    end, state = tuple(segment[0][7]), segment[0][9]
    steps, out, came = walk(_live(segment), state, end), [], None
    for _, _, seq, initial, harm, gone, n, _, _, _, i1, i2, role in segment:
        inserted, edit, cost, new = [], "D", DELETE, None
        if not gone:
            inserted, edit, state = next(steps)
            cost = DELETE if edit == "D" else harm + (edit == "R")
            new = {"K": role, "R": NAMES.get(state)}.get(edit)
        illegal = n - 1 + (came is not None and came + initial not in ("su", "ua", "au"))
        cost = int(cost) + DELETE * (n - 1) + INSERT * len(inserted)
        out.append((conv, part, seq, i1, i2, initial, illegal, cost, [NAMES[s] for s in inserted], new, "I" * len(inserted) + edit + "D" * (n - 1)))
        came = initial
    if last and closing(state):
        names = [NAMES[s] for s in closing(state)]
        out.append((conv, part, segment[-1][2] + 1, None, None, None, 0, INSERT * len(names), names, None, "I" * len(names)))
    return out


def _checkpoints(rows: DataFrame, spread: DataFrame) -> DataFrame:
    """conv, part, end, entry, last of each segment of the conversations ``spread`` over several: a row for each end of a range at most."""
    some = rows.join(F.broadcast(spread.select("conv")), "conv", "left_semi")
    crossed = _by_segment(some, _crossings, "conv long, part long, ways array<double>")
    lists = crossed.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "ways"))).alias("s"))

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out = {"conv": [], "part": [], "end": [], "last": []}
            for conv, segments in zip(b.column("conv").to_pylist(), b.column("s").to_pylist(), strict=True):
                v = END
                for x in reversed(segments):
                    for c, value in zip(out, (conv, x["part"], list(v), x is segments[-1]), strict=True):
                        out[c].append(value)
                    v = tuple(min(x["ways"][4 * s + e] + v[e] for e in range(4)) for s in range(4))
            yield out

    ends = written(map_batches(lists, backwards, "conv long, part long, end array<double>, last boolean"))
    left = _by_segment(some.join(F.broadcast(ends), ["conv", "part"]), _exits, "conv long, part long, exits array<int>", "end")
    lists = left.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "exits"))).alias("s"))

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out = {"conv": [], "part": [], "entry": []}
            for conv, segments in zip(b.column("conv").to_pylist(), b.column("s").to_pylist(), strict=True):
                state = 0
                for x in segments:
                    for c, value in zip(out, (conv, x["part"], state), strict=True):
                        out[c].append(value)
                    state = x["exits"][state]
            yield out

    return ends.join(map_batches(lists, forwards, "conv long, part long, entry int"), ["conv", "part"])


def _id(*columns: Column | str) -> tuple[Column, Column]:
    return F.xxhash64(*columns), F.xxhash64(F.lit(11), *columns)


def repair(conversations: DataFrame, part_bytes: int = PART) -> tuple[DataFrame, DataFrame]:
    """(messages, report) of ``conversations`` (conv_id, turn, role, text, and copies: how often a row counts, if it is there).

    messages: conv_id, part, seq, lines: what stands in the repaired conversation at part, seq (ascending), as role:text lines.
    report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Messages go by turn (nulls first), where turns are equal by role and text (its first 64 characters, then a digest),
    and rows that are equal in all four are copies, one after the other. A null role or text is one space. A message's
    first fault counts: blank (only ASCII white space), duplicate (role and text seen earlier in the conversation),
    truncated (last character that is no such space not one of ``.!?``). A null conv_id is a conversation of its own. Texts
    of any length count whole. Conversations without rows don't appear, and an empty table gives none.
    """
    spark = conversations.sparkSession
    given = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.col("copies") if "copies" in conversations.columns else F.lit(1)).cast("long").alias("copies"),
    )
    one, two = _id("conv", "turn", "role", "text")
    same = F.struct(*(c.alias(n) for n, c in zip(("s1", "s2"), _id("conv", "role", "text"), strict=True)))
    bare = F.rtrim("text", F.lit(BLANK))
    harm = F.when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0.0).otherwise(float(UNFINISHED))
    texts = given.select(one.alias("i1"), two.alias("i2"), "text")
    slim = given.select("conv", "turn", "role", F.substring("text", 1, HEAD).alias("head"), one.alias("i1"), two.alias("i2"), same.alias("same"), (F.length(bare) == 0).alias("blank"), harm.alias("harm"), "copies")
    slim = written(slim.groupBy(*(c for c in slim.columns if c != "copies")).agg(F.sum("copies").alias("n")))
    # The first turn of what a conversation says more than once.
    again = slim.where("not blank").groupBy("same").agg(F.count(F.lit(1)).alias("k"), F.when(F.count_if(F.col("turn").isNull()) == 0, F.min("turn")).alias("first")).where("k > 1")
    later = F.col("k").isNotNull() & F.col("turn").isNotNull() & ((F.col("turn") > F.col("first")) | F.col("first").isNull())
    rows = join_dealt(slim, again, "same", "turn").withColumn("dup", ~F.col("blank") & later).drop("k", "first", "same")
    total = text_bytes(given)
    n = max(1, min(parts(spark), -(-total // (1 << 20))), -(-total // part_bytes))
    dealt = rows.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER)
    rows = written(dealt.select("*", F.substring("role", 1, 1).alias("initial"), (F.col("blank") | F.col("dup")).alias("gone"), F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("seq")))

    # Each conversation that is spread goes over an end of a range, so there are fewer of them than ranges.
    spread = written(rows.groupBy("conv").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b"))
    known = rows.withColumns({"end": F.array(*map(F.lit, END)), "last": F.lit(True), "entry": F.lit(0)})
    if not spread.isEmpty():
        at = written(_checkpoints(rows, spread))  # two segments a range at most
        known = rows.join(F.broadcast(at), ["conv", "part"], "left").withColumns({"end": F.coalesce("end", F.array(*map(F.lit, END))), "last": F.coalesce("last", F.lit(True)), "entry": F.coalesce("entry", F.lit(0))})
    edits = written(_by_segment(known, _edits, EDITS, "end", "last", "entry", "i1", "i2", "role"))

    stands = edits.where("role is not null or size(inserted) > 0").join(texts.dropDuplicates(["i1", "i2"]), ["i1", "i2"], "left")
    said = F.transform("inserted", lambda r: F.concat(r, F.lit(":")))
    lines = F.when(F.col("role").isNull(), said).otherwise(F.concat(said, F.array(F.concat("role", F.lit(":"), "text"))))
    messages = stands.select("conv", "part", "seq", F.array_join(lines, "\n").alias("lines"))

    turns = rows.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("_")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    count = lambda c, n: F.sum(F.when(c, n).otherwise(0))
    blank, dup = F.col("blank"), F.col("dup")
    faults = rows.groupBy("conv").agg(count(blank, F.col("n")).alias("blank"), count(~blank, F.col("n") - F.when(dup, 0).otherwise(1)).alias("duplicate"), count(~blank & ~dup & (F.col("harm") > 0), 1).alias("truncated"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c]), "")
    real = F.col("initial").isNotNull()
    segment = edits.groupBy("conv", "part").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), joined("edits").alias("edits"), F.min_by("initial", F.when(real, F.col("seq"))).alias("opens"), F.max_by("initial", F.when(real, F.col("seq"))).alias("ends"))
    whole = segment.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "illegal", "cost", "edits", "opens", "ends"))).alias("s"))
    meets = F.size(F.filter(F.zip_with("s", F.slice("s", F.lit(2), F.size("s")), lambda x, y: F.concat(x["ends"], y["opens"])), lambda p: p.isNotNull() & ~p.isin("su", "ua", "au")))
    total_of = lambda c: F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x[c])
    whole = whole.select("conv", (total_of("illegal") + meets).alias("illegal"), total_of("cost").alias("cost"), F.array_join(F.transform("s", lambda x: x["edits"]), "").alias("audit"))
    report = faults.join(turns, "conv", "left").join(whole, "conv").select("conv", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    own = F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id")
    return messages.select(own, "part", "seq", "lines"), report.select(own, *report.columns[1:])


def digests(messages: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of messages of repair(). A digest is read in order, by one task; some messages at a time become
    one text, in pieces of at most ``PIECE`` characters, so that this task reads few rows and holds little of them."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lines"))), lambda x: x["lines"]), "\n")
    chunks = messages.groupBy(F.coalesce("conv_id", F.lit(NO_ID)).alias("conv"), "part", F.floor(F.col("seq") / CHUNK).alias("chunk")).agg(joined.alias("lines"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("lines") - 1) / PIECE).cast("int")), lambda i: F.substring(F.col("lines"), i * PIECE + 1, F.lit(PIECE)))
    pieces = chunks.select("conv", "part", "chunk", F.posexplode(cut).alias("piece", "lines"))
    dealt = pieces.repartition(parts(messages.sparkSession), "conv").sortWithinPartitions("conv", "part", "chunk", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        open_, digest = None, None
        for b in batches:
            out: dict[str, list] = {"conv": [], "repaired_sha256": []}
            for conv, piece, lines in zip(b.column("conv").to_pylist(), b.column("piece").to_pylist(), b.column("lines"), strict=True):
                if digest is not None and conv == open_:
                    digest.update(b"\n" * (piece == 0))
                else:
                    if digest is not None:
                        out["conv"].append(open_)
                        out["repaired_sha256"].append(digest.hexdigest())
                    open_, digest = conv, sha256()
                digest.update(lines.as_py().encode())
            yield out
        if digest is not None:
            yield {"conv": [open_], "repaired_sha256": [digest.hexdigest()]}

    return map_batches(dealt.select("conv", "piece", "lines"), run, "conv long, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """The conversations that op11 is asked about: some rows lost, emptied, cut, repeated or given to the user."""
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn")).cast("binary")) % 20
    text = F.when(what == 1, "").when(what == 2, F.translate(spelled("text"), ".!?", "")).otherwise(spelled("text"))
    return conversations.where(what != 0).select("conv_id", "turn", F.when(what == 4, "user").otherwise(spelled("role")).alias("role"), text.alias("text"), F.when(what == 3, 2).otherwise(1).alias("copies"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    messages, report = repair(damage(given))
    key = F.coalesce("conv_id", F.lit(NO_ID)).alias("conv")
    every = given.select(key).distinct().join(report.withColumn("conv", key).drop("conv_id"), "conv", "left").join(digests(messages), "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select(F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
