"""Secret scans (4): an incremental ledger of blobs.

Every version of every file is a blob, named by the SHA-256 of its content. The ledger holds, for each blob, which
rule versions have read it and what each of them found; a scan reads only blobs, and for each blob only rule versions,
that the ledger has not got, once per distinct content. Findings then join back to all paths that hold the blob, for the
rule versions that are asked for. DataFrame functions only: matches come from ``regexp_extract_all``, their places from
a running sum over the lengths of what ``split`` leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, table, written

SPANS = "array<struct<kind:string,version:int,start:bigint,stop:bigint>>"
LEDGER = f"blob string, scanned array<string>, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, left to right, whose ``group`` has ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The first three are the base rules; the order also orders findings that start together.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # A maximal run of the class is one match, so the least length can stand in the pattern.
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    # Only where a run of the class begins, and without giving anything back: linear in any text.
    Rule("jwt", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", 0, 1),
)
BASE = ("assign", "access", "hex")


def _matches(rule: Rule, rank: int) -> Column:
    """array<struct(rank, gap, m, g)> of ``rule``'s matches in text, in order: characters before each since the last one, of it, of its group."""
    due = ~F.array_contains("seen", rule.name)
    of = lambda group: F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(group))
    gaps = F.split("text", rule.pattern, -1)
    sizes = F.zip_with(gaps, F.arrays_zip(of(0).alias("m"), of(rule.group).alias("g")), lambda gap, x: F.struct(F.lit(rank).alias("rank"), F.length(gap).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("m"), F.length(x["g"]).alias("g")))
    found = F.filter(sizes, lambda x: x["m"].isNotNull())  # what follows the last match has none
    return F.when(due & F.col("text").rlike(rule.pattern), found).otherwise(F.array().cast("array<struct<rank:int,gap:bigint,m:bigint,g:int>>"))


def find_secrets(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blobs`` (blob, text, seen: rule names not to apply) without the text, with spans: places of all rules' findings.

    A match begins after all text between matches and all matches before it: one running sum for each blob and rule, over
    rows that lie where the blobs do. ``blob`` tells rows apart. Spans are in the order of their rules, then of the text.
    """
    matches = F.flatten(F.array(*(_matches(r, i) for i, r in enumerate(rules))))
    one = blobs.select("blob", "seen", F.posexplode_outer(matches).alias("at", "x")).select("blob", "seen", "at", "x.*")
    before = Window.partitionBy("blob", "rank").orderBy("at")
    one = one.withColumn("stop", F.sum(F.col("gap") + F.col("m")).over(before))
    kind, version, least = (F.element_at(F.array(*(F.lit(v) for v in values)), F.col("rank") + 1) for values in zip(*((r.kind, r.version, r.least) for r in rules), strict=True))
    span = F.struct("rank", (F.col("stop") - F.col("m")).alias("start"), kind.alias("kind"), version.alias("version"), "stop")
    spans = F.array_sort(F.collect_list(F.when(F.col("g") >= least, span)))
    found = one.groupBy("blob", "seen").agg(spans.alias("s"))
    return found.select("blob", "seen", F.transform("s", lambda s: F.struct(s["kind"].alias("kind"), s["version"].alias("version"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("spans"))


def unseen(paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, seen): each distinct content of ``paths`` once that ``ledger`` lacks, for the rules that are not in seen."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<string>")
    blobs = paths.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    if ledger is None:
        return blobs.dropDuplicates(["blob"]).withColumn("seen", none)
    names = F.array(*(F.lit(r.name) for r in rules))
    known = ledger.select("blob", F.col("scanned").alias("seen"))
    # Each task keeps one row of a content before it is moved: copies don't meet.
    due = blobs.dropDuplicates(["blob"]).join(known, "blob", "left").withColumn("seen", F.coalesce("seen", none))
    return due.where(F.size(F.array_except(names, "seen")) > 0)


def scan(paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger after reading ``paths`` (path, text): blob, scanned (rule names), spans (kind, version, start, stop).

    A null text is the empty blob. Only (blob, rule version) pairs that ``ledger`` lacks are scanned; findings of other
    versions of a rule stay, so that a rule can go back to an earlier version without another scan. Without new pairs
    the result equals ``ledger``. Blobs whose paths are gone stay. Empty tables and repeated paths are fine.
    """
    names = F.array(*(F.lit(r.name) for r in rules))
    found = find_secrets(unseen(paths, ledger, rules), rules)
    if ledger is None:
        return found.select("blob", names.alias("scanned"), "spans")
    none, nothing = F.array().cast("array<string>"), F.array().cast(SPANS)
    fresh = found.select("blob", F.col("spans").alias("new"), F.array_except(names, "seen").alias("read"))
    both = ledger.join(fresh, "blob", "full")
    return both.select("blob", F.array_union(F.coalesce("scanned", none), F.coalesce("read", none)).alias("scanned"), F.concat(F.coalesce("spans", nothing), F.coalesce("new", nothing)).alias("spans"))


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``paths`` (path, text) without the text, with blob and the spans that ``rules`` have in the ledger for it, in text order.

    Spans that start together follow the order of ``rules``. Most blobs hold no secret: only those with findings take
    part in the join. Blobs of which there are more than a small share of all paths, at most four for each partition,
    are dealt out: their paths get one of several numbers, and their findings are repeated once for each number.
    """
    spark = paths.sparkSession
    rank = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)))
    named_rule = lambda s: F.concat_ws("@", s["kind"], s["version"].cast("string"))
    place = lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, named_rule(s)).alias("rank"), s["kind"].alias("kind"), s["version"].alias("version"), s["stop"].alias("stop"))
    own = F.filter("spans", lambda s: named_rule(s).isin(*(r.name for r in rules)))
    held = ledger.withColumn("spans", F.array_sort(F.transform(own, place))).where(F.size("spans") > 0).select("blob", "spans")
    named = paths.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    share = named.count() // (4 * parts(spark)) + 1
    crowded = named.groupBy("blob").count().where(F.col("count") > share).select("blob", (F.col("count") / share + 1).cast("int").alias("numbers"))
    crowded = F.broadcast(written(crowded))  # at most four rows for each partition, as each has more than its share
    numbers = F.coalesce("numbers", F.lit(1))
    named = named.join(crowded, "blob", "left").withColumn("number", F.pmod(F.xxhash64("path"), numbers).cast("int")).drop("numbers")
    held = held.join(crowded, "blob", "left").select("blob", "spans", F.explode(F.sequence(F.lit(0), numbers - 1)).alias("number"))
    spans = F.transform(F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,kind:string,version:int,stop:bigint>>")), lambda s: F.struct(s["kind"].alias("kind"), s["version"].alias("version"), s["start"].alias("start"), s["stop"].alias("stop")))
    return named.join(held, ["blob", "number"], "left").select("path", "blob", spans.alias("spans"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table arrives as two deliveries: contents whose digest has its first bit clear, then all rows, of which the ledger knows the former."""
    paths = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    first = paths.where(F.sha2(F.coalesce("text", F.lit("")), 256) < "8")
    ledger = written(scan(first))
    ledger = written(scan(paths, ledger))
    found = findings(paths, ledger)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("path").alias("doc_id"), *map(n, BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))



def _sql(rule: Rule, rank: int) -> str:
    """DuckDB's patterns look back at nothing and are never possessive: what must stand before a match is a group of its own."""
    pattern, ahead = rule.pattern.replace("}+", "}"), 0
    if pattern.startswith("(?<!["):
        cls, rest = pattern[5:].split("])", 1)
        pattern, ahead = f"(^|[^{cls}])({rest})", 1
    if pattern.startswith("(?i:"):  # by letters, as another engine's ignoring of case knows more of them
        words, rest = pattern[4:].split("))", 1)
        pattern = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words) + ")" + rest
    p = "'" + pattern.replace("'", "''") + "'"
    return f"SELECT r, '{rule.kind}' AS kind, {rank} AS rank, {rule.least} AS least, {ahead} AS ahead, regexp_extract_all(text, {p}, 0) AS m, regexp_extract_all(text, {p}, {rule.group + ahead}) AS g, regexp_split_to_array(text, {p}) AS gap FROM d"


OP4_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
e AS ({' UNION ALL '.join(_sql(r, i) for i, r in enumerate(RULES))}),
u AS (SELECT r, kind, rank, least, ahead, unnest(range(len(m))) AS i, unnest(m) AS m, unnest(g) AS g, unnest(gap[1:len(m)]) AS gap FROM e WHERE len(m) > 0),
v AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS stop FROM u),
w AS (SELECT r, kind, rank, CASE WHEN ahead = 1 AND starts_with(m, 'eyJ') OR ahead = 0 THEN stop - length(m) ELSE stop - length(m) + 1 END AS start, stop FROM v WHERE ahead = 1 OR length(g) >= least),
x AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
 string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) FILTER (WHERE kind IN ('assign', 'access', 'hex')) AS base,
 string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS spans FROM w GROUP BY r)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN x ON x.r = d.r"""
