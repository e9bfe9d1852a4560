"""Counts, scores and comparisons over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R

#: Paths that a preview names, and shares that a large group is ranked in before they are merged.
PREVIEW, SHARES = 3, 16
#: One row in so many, by its hash, is where a long list may be cut, and the cuts of a list at most: what lies between two is numbered together.
CUT, CUTS = 4096, 63


def _filled(counts: DataFrame, names: tuple[str, ...], key: str, more: bool) -> DataFrame:
    """``counts`` (key, n) with each of ``names`` there, zero if need be; others stay if ``more``."""
    spark = counts.sparkSession
    wanted = spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"place long, {key} string")
    out = wanted.join(counts, key, "full" if more else "left")
    return out.select(key, F.coalesce("n", F.lit(0)).alias("n"), "place")


def count_statuses(results: DataFrame) -> DataFrame:
    """status, n: the four statuses, even if no row has one, and any other that is not blank."""
    low = F.lower(F.regexp_replace(F.coalesce("status", F.lit("")), r"(?U)^\s+|\s+$", ""))
    counts = results.groupBy(low.alias("status")).agg(F.count(F.lit(1)).alias("n")).where("status != ''")
    return _filled(counts, R.STATUSES, "status", True).select("status", "n")


def coverage_pct(results: DataFrame) -> DataFrame:
    """yes, total, pct: skipped and failed rows count in the total."""
    yes = F.count_if(F.lower("status") == "yes")
    return results.agg(yes.alias("yes"), F.count(F.lit(1)).alias("total")).withColumn("pct", F.col("yes") / F.greatest("total", F.lit(1)) * 100)


def overall_counts(results: DataFrame) -> DataFrame:
    """overall, n in the report's order, zeros included, and their total."""
    counts = results.groupBy("overall").agg(F.count(F.lit(1)).alias("n"))
    out = _filled(counts, R.OVERALL, "overall", False)
    total = results.agg(F.lit("TOTAL").alias("overall"), F.count(F.lit(1)).alias("n"), F.lit(len(R.OVERALL)).cast("long").alias("place"))
    return out.unionByName(total)


def type_breakdown(results: DataFrame, column: str) -> DataFrame:
    """value, n, place of a list column's values: most common first, ties as first seen."""
    one = results.select("pos", F.posexplode(column).alias("idx", "value"))
    counts = one.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "idx")).alias("first"))
    return counts.orderBy(F.desc("n"), "first").select("value", "n", F.col("first.pos").alias("first_pos"), F.col("first.idx").alias("first_idx"))


def tool_breakdown(results: DataFrame) -> DataFrame:
    return results.where("doc_tool is not null and doc_tool != 'none'").groupBy("doc_tool").agg(F.count(F.lit(1)).alias("n"))


def detail_totals(results: DataFrame, column: str) -> DataFrame:
    """entries, yes_repos, average: list entries in all and for each repository with a yes."""
    yes = F.count_if(F.col("status") == "yes")
    total = F.coalesce(F.sum(F.size(F.coalesce(F.col(column), F.array()))), F.lit(0))
    return results.agg(total.alias("entries"), yes.alias("yes_repos")).withColumn("average", F.col("entries") / F.greatest("yes_repos", F.lit(1)))


def api_coverage(hits: DataFrame) -> DataFrame:
    """repo_key, total_public, documented_public, high_quality, coverage_percent of the Python files with a docstring."""
    sums = hits.groupBy("repo_key").agg(F.sum("public_total").alias("total_public"), F.sum("public_documented").alias("documented_public"), F.sum("high_quality_documented").alias("high_quality"))
    return sums.withColumn("coverage_percent", F.when(F.col("total_public") > 0, F.bround(F.col("documented_public") * 100 / F.col("total_public"), 1)))


def source_evidence(hits: DataFrame) -> DataFrame:
    """repo_key, enough, n: one strong hit or two of any kind are evidence."""
    return hits.groupBy("repo_key").agg((F.bool_or("strong") | (F.count(F.lit(1)) >= 2)).alias("enough"), F.count(F.lit(1)).alias("n"))


def collect_evidence(hits: DataFrame) -> DataFrame:
    """repo_key, path, type, doc_type, tool of configuration, pages and sources (bucket, strong) together; sources only of
    repositories where they are enough.

    A repository's sources, of which candidates have a limit, meet; its other files, which may be many, are dealt out.
    """
    source = F.col("bucket") == "source"
    place = F.when(source, -1).otherwise(F.pmod(F.xxhash64("path"), F.lit(SHARES)))
    together = Window.partitionBy("repo_key", "place")
    enough = F.bool_or(F.coalesce("strong", F.lit(False))).over(together) | (F.count(F.lit(1)).over(together) >= 2)
    return hits.withColumn("place", place).withColumn("enough", enough).where(~source | F.col("enough")).select("repo_key", "path", "type", "doc_type", "tool")


def first_of_shares(frame: DataFrame, keys: list[str], order: list[str], n: int = PREVIEW) -> DataFrame:
    """``frame``, a row for each ``order`` of a group, with early: one of the first ``n`` of its group's share, a hash of ``order``
    away from the others.

    The first ``n`` of a group are among the early rows, at most n * SHARES of them; no task sorts more than a share of it.
    """
    share = F.pmod(F.xxhash64(*order), F.lit(SHARES))
    within = Window.partitionBy(*keys, "_share").orderBy(*order)
    ranked = frame.withColumn("_share", share).withColumns({"early": F.dense_rank().over(within) <= n, "_before": F.lag(F.struct(*order)).over(within)})
    return ranked.where(~F.struct(*order).eqNullSafe(F.col("_before"))).drop("_share", "_before")


def ordered_doc_types(types: Column) -> Column:
    """Distinct types, known ones in reporting order, then others by name."""
    place = F.array(*map(F.lit, R.DOC_TYPE_ORDER))
    keyed = F.transform(F.array_distinct(types), lambda x: F.struct(F.coalesce(F.nullif(F.array_position(place, x), F.lit(0)), F.lit(len(R.DOC_TYPE_ORDER) + 1)).alias("p"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def primary_tool(tools: Column) -> Column:
    place = F.array(*map(F.lit, R.TOOL_ORDER))
    best = F.array_min(F.transform(tools, lambda x: F.struct(F.coalesce(F.nullif(F.array_position(place, x), F.lit(0)), F.lit(99)).alias("p"), x.alias("x"))))
    return F.coalesce(best["x"], F.lit("none"))


def doc_file_rows(entries: DataFrame) -> DataFrame:
    """repo_key, path, type: each once."""
    return entries.select("repo_key", "path", "type").distinct()


def cut_in_parts(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """``rows`` with part: how many cuts of its group lie at a row or before it, so that parts follow each other by ``order``.

    Cuts are rows of the group, chosen by a hash; a group of some CUT rows or fewer has hardly any. They are few and broadcast.
    """
    place = F.xxhash64(order)
    chosen = F.slice(F.array_sort(F.collect_list(F.struct(place.alias("hash"), order.alias("at")))), 1, CUTS)
    cuts = rows.where(F.pmod(place, F.lit(CUT)) == 0).groupBy(F.col(key).alias("_key")).agg(F.transform(chosen, lambda x: x["at"]).alias("_cuts"))
    passed = F.size(F.filter("_cuts", lambda cut: cut <= F.col("_at")))
    dealt = rows.withColumn("_at", order).join(F.broadcast(cuts), F.col(key).eqNullSafe(F.col("_key")), "left")
    return dealt.withColumn("part", F.when(F.col("_cuts").isNull(), 0).otherwise(passed)).drop("_key", "_cuts", "_at")


def doc_file_list(entries: DataFrame) -> DataFrame:
    """repo_key, path, type, place, preview: each (path, type) once, its place in its repository by path without case, type and
    path (missing paths last), and the repository's first three paths.

    Parts of a list are numbered each by itself; counts and first rows of parts are all that meets of a repository.
    """
    low = F.lower("path")
    order = F.struct(low.isNull().alias("none"), low.alias("low"), F.col("type"), F.col("path"))
    rows = cut_in_parts(doc_file_rows(entries), "repo_key", order)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("repo_key", "part").orderBy(order)))
    firsts = F.collect_list(F.when(F.col("rank") <= PREVIEW, order))
    parts = ranked.groupBy("repo_key", "part").agg(F.count(F.lit(1)).alias("n"), firsts.alias("firsts"))
    repo = Window.partitionBy("repo_key")
    first = F.slice(F.array_sort(F.flatten(F.collect_list("firsts").over(repo))), 1, PREVIEW)
    known = parts.select(
        F.col("repo_key").alias("_repo"), F.col("part").alias("_part"), (F.sum("n").over(repo.orderBy("part")) - F.col("n")).alias("before"),
        F.array_join(F.transform(first, lambda x: x["path"]), ", ").alias("preview"),
    )
    found = ranked.join(known, F.col("repo_key").eqNullSafe(F.col("_repo")) & F.col("part").eqNullSafe(F.col("_part")))
    return found.select("repo_key", "path", "type", (F.col("before") + F.col("rank")).alias("place"), "preview")


def doc_file_preview(entries: DataFrame) -> DataFrame:
    """repo_key, n_doc_files, preview: how many (path, type) there are, and the first three paths, by path without case and type."""
    early = first_of_shares(entries.select("repo_key", "path", "type").withColumn("low", F.lower("path")), ["repo_key"], ["low", "type", "path"])
    firsts = F.array_sort(F.collect_list(F.when(F.col("early"), F.struct("low", "type", "path"))))
    listed = early.groupBy("repo_key").agg(F.count(F.lit(1)).alias("n_doc_files"), firsts.alias("f"))
    return listed.select("repo_key", "n_doc_files", F.array_join(F.slice(F.transform("f", lambda x: x["path"]), 1, PREVIEW), ", ").alias("preview"))


def confusion_metrics(joined: DataFrame) -> DataFrame:
    """One row of scores from rows with status and truth; a status other than yes or no is labelled but not evaluated."""
    said = F.when(F.lower("status") == "yes", True).when(F.lower("status") == "no", False)
    cell = lambda p, t: F.count_if((F.col("said") == p) & (F.col("truth") == t))
    sums = joined.withColumn("said", said).agg(
        F.count(F.lit(1)).alias("labelled"), F.count("said").alias("evaluated"),
        cell(True, True).alias("tp"), cell(True, False).alias("fp"), cell(False, False).alias("tn"), cell(False, True).alias("fn"),
    )
    ratio = lambda a, b: F.when(b != 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)
    c = F.col
    sums = sums.withColumns({"accuracy": ratio(c("tp") + c("tn"), c("evaluated")), "precision": ratio(c("tp"), c("tp") + c("fp")), "recall": ratio(c("tp"), c("tp") + c("fn"))})
    return sums.withColumn("f1", F.when(c("precision") + c("recall") > 0, 2 * c("precision") * c("recall") / (c("precision") + c("recall"))).otherwise(0.0))


def token_usage(responses: DataFrame) -> DataFrame:
    """model, requests, prompt, completion, total, without: answers without a count of their own add up their parts."""
    part = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = part("prompt_tokens") + part("completion_tokens")
    total = F.when(part("total_tokens") > 0, part("total_tokens")).otherwise(both)
    none = F.count_if(F.coalesce("prompt_tokens", "completion_tokens", "total_tokens").isNull())
    return responses.groupBy("model").agg(F.count(F.lit(1)).alias("requests"), F.sum(part("prompt_tokens")).alias("prompt"), F.sum(part("completion_tokens")).alias("completion"), F.sum(total).alias("total"), none.alias("without"))


def model_agreement(results: DataFrame, models: list[str]) -> DataFrame:
    """pos, one column for each model (upper-case status or N/A), agree: all say the same."""
    wide = results.groupBy("pos").pivot("model", models).agg(F.max(F.upper("status")))
    wide = wide.select("pos", *(F.coalesce(F.col(f"`{m}`"), F.lit("N/A")).alias(m) for m in models))
    return wide.withColumn("agree", F.size(F.array_distinct(F.array(*(F.col(f"`{m}`") for m in models)))) == 1)


def agreement_rate(agreement: DataFrame) -> DataFrame:
    return agreement.agg(F.count_if("agree").alias("agreed"), F.count(F.lit(1)).alias("papers")).withColumn("rate", F.col("agreed") / F.greatest("papers", F.lit(1)) * 100)


def categories_of(entries: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(entries, lambda e: e["category"]), lambda c: c != "")))


def top_evidence(entries: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(F.filter(F.transform(entries, lambda e: e["evidence"]), lambda c: c != ""), 1, n), "; ")


def coverage_checked(fetched: Column, total: Column) -> Column:
    """Share of source files that were read, as a whole percentage; blank without any."""
    return F.when(total > 0, F.concat(F.bround(100.0 * fetched / total, 0).cast("long").cast("string"), F.lit("%"))).otherwise("")


def non_target_rows(results: DataFrame) -> DataFrame:
    return results.where(F.col("status").isin("skipped", "error"))
