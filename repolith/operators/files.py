"""Choosing files and cutting them to a budget.

All windows share the partitioning by repository. Ranks are filtered by a constant, so that Spark limits each group
before the exchange and a repository with very many files costs little more than a small one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.notebooks import flatten_notebook, is_notebook, usage_text
from ..functions.paths import path_features, preprocessing_bucket, readme_priority, starts, usage_bucket, with_bucket
from .papers import attach

#: Shares that a large repository's rows are ranked in before they are merged.
SHARES = 16


def _ranked(frame: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_readme(files: DataFrame) -> DataFrame:
    """repo_key, path: of each repository, the first listed path that begins with readme."""
    return files.where(F.lower("path").startswith("readme")).groupBy("repo_key").agg(F.min_by("path", "seq").alias("path"))


def select_install_files(files: DataFrame) -> DataFrame:
    """The files that installation checks read: those of a known name, or else the first readme."""
    low = F.lower("path")
    named = files.where(low.isin(*R.INSTALL_NAMES) | F.substring_index(low, "/", -1).isin(*R.INSTALL_NAMES))
    others = files.join(named.select("repo_key").distinct(), "repo_key", "left_anti")
    readme = others.join(first_readme(others), ["repo_key", "path"], "left_semi")
    return named.unionByName(readme.select(*named.columns))


def root_presence(files: DataFrame) -> DataFrame:
    """repo_key, has_readme, has_setup, from the names at the root."""
    low = F.lower("path")
    root = ~low.contains("/")
    return files.groupBy("repo_key").agg(F.bool_or(root & low.startswith("readme")).alias("has_readme"), F.bool_or(root & low.isin(*R.SETUP_NAMES)).alias("has_setup"))


def top_n_per_bucket(files: DataFrame, caps: dict[str, int], keep_others: bool = False) -> DataFrame:
    """Of path_features rows with a bucket: the first of each repository's bucket, by depth and path; readmes by path alone.

    Buckets without a cap go or, with ``keep_others``, stay whole.
    """
    order = [F.when(F.col("bucket") == "readme", 0).otherwise(F.col("depth")), "path_lower", "seq"]
    within = F.coalesce(*(F.when(F.col("bucket") == b, F.col("rank") <= n) for b, n in caps.items()), F.lit(True))
    if keep_others:
        return _ranked(files.where("bucket is not null"), ["repo_key", "bucket"], order, "rank").where(within)
    ranked = _ranked(files.where(F.col("bucket").isin(*caps)), ["repo_key", "bucket"], order, "rank")
    return ranked.where(F.col("rank") <= max(caps.values())).where(within)


def api_page_order(files: DataFrame, n: int = R.MAX_DOC_PAGES) -> DataFrame:
    """Of path_features rows: the first ``n`` documentation pages, those of reference folders before all others."""
    strong = F.when(starts(F.col("path_lower"), R.STRONG_DOC_FOLDERS), 0).otherwise(1)
    return latest_n(files, n, strong, "path_lower", "seq")


def round_robin_sample(files: DataFrame, n: int) -> DataFrame:
    """Of path_features rows: one file of each top folder in turn, the root's first, then folders by name; rank 1 to ``n``."""
    turns = _ranked(files, ["repo_key", "top"], ["path_lower", "seq"], "round").where(F.col("round") <= n)
    tops = files.groupBy("repo_key", "top").agg(F.min("seq").alias("top_seq"))
    order = ["round", F.col("top") != "", F.lower("top"), "top_seq"]
    return _ranked(turns.join(tops, ["repo_key", "top"]), ["repo_key"], order, "rank").where(F.col("rank") <= n).drop("top_seq")


def attach_contents(candidates: DataFrame, contents: DataFrame) -> DataFrame:
    """Candidates that have contents; missing and empty ones are left out. Select first: contents are the bytes."""
    return candidates.join(contents.select("repo_key", "path", "content").where(F.length("content") > 0), ["repo_key", "path"])


def attach_sizes(candidates: DataFrame, contents: DataFrame, how: str = "inner", as_example: bool = False) -> DataFrame:
    """Candidates with size: how many characters of each there are to read. Missing and empty contents have none (null, with ``how`` left).

    Sizes travel, texts do not: lengths are taken where contents lie (from n_chars, if a snapshot has it). Only notebooks
    are moved, those that were chosen flattened, and dropped again before anything is ranked or summed.
    """
    book = is_notebook(F.col("path"))
    chars = F.col("n_chars") if "n_chars" in contents.columns else F.length("content")
    found = contents.where(chars > 0).select("repo_key", "path", F.when(~book, chars).cast("long").alias("_chars"), F.when(book, F.col("content")).alias("_book"))
    size = F.coalesce("_chars", F.length(_flattened(F.col("_book"), as_example)).cast("long"))
    return candidates.join(found, ["repo_key", "path"], how).withColumn("size", size).drop("_chars", "_book")


def attach_texts(cut: DataFrame, contents: DataFrame, as_example: bool = False) -> DataFrame:
    """``cut`` (repo_key, path, take) with text: the first ``take`` characters of what there is to read, by one join."""
    found = cut.join(contents.where(F.length("content") > 0).select("repo_key", "path", "content"), ["repo_key", "path"])
    text = F.when(is_notebook(F.col("path")), _flattened(F.col("content"), as_example)).otherwise(F.col("content"))
    return found.withColumn("text", F.substring(text, F.lit(1), F.col("take").cast("int"))).drop("content")


def _flattened(raw: Column, as_example: bool) -> Column:
    return usage_text(raw) if as_example else flatten_notebook(raw)


def attach_sites(papers: DataFrame, pages: DataFrame) -> DataFrame:
    return attach(papers, pages.select("repo_key", F.nullif("html_url", F.lit("")).alias("pages_url")))


def char_budget(files: DataFrame, budget: int, cap: Column | None, *order: Column | str, start: Column | int = 0) -> DataFrame:
    """``files`` (repo_key and size, or content) with take: how many characters of each, in order, until ``budget`` is spent.

    ``cap``: most of one file; ``start``: what is spent already. Files that get nothing are left out.
    """
    size = F.col("size") if "size" in files.columns else F.length("content")
    want = size if cap is None else F.least(size, cap)
    before = Window.partitionBy("repo_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("_want").over(before), F.lit(0)) + (F.lit(start) if isinstance(start, int) else start)
    taken = files.withColumn("_want", want.cast("long")).withColumn("take", F.least("_want", F.greatest(F.lit(budget) - spent, F.lit(0))))
    return taken.where("take > 0").drop("_want")


def cascading_budget(files: DataFrame) -> DataFrame:
    """Pre-processing files (path_features, bucket, size) under one budget that flows from named to folder to generic."""
    place = F.coalesce(*(F.when(F.col("bucket") == b, F.lit(i)) for i, b in enumerate(R.PREPROCESSING_BUCKETS)))
    cap = F.coalesce(*(F.when(F.col("bucket") == b, F.lit(c)) for b, (_, c, _) in R.PREPROCESSING_BUCKETS.items()))
    return char_budget(files.withColumn("place", place), R.PREPROCESSING_CHARS, cap, "place", "depth", "path_lower", "seq")


def staged_budget(chosen: DataFrame) -> DataFrame:
    """Usage files (path_features, bucket, rank of top_n_per_bucket, size) with take: documents first, then notebooks in equal
    shares of what is left, then scripts. A notebook's share counts those chosen, readable (size not null) or not; of share 0
    its header stays, unless documents have taken all.

    place and first are the order of the blocks. All sums are windows over one partitioning by repository.
    """
    kind = lambda k: F.col("bucket") == k
    rows = chosen.withColumns(
        {
            "place": F.when(kind("doc"), 0).when(kind("notebook"), 1).otherwise(2),
            "first": F.when(kind("doc"), readme_priority(F.col("path"))).otherwise(F.col("rank")),
        }
    )
    whole = Window.partitionBy("repo_key")
    before = whole.orderBy("place", "first", "seq").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c, w=whole: F.coalesce(F.sum(c).over(w), F.lit(0))
    left = F.lit(R.USAGE_CHARS)
    rows = rows.withColumn("t_doc", F.when(kind("doc"), F.least("size", F.greatest(left - total(F.when(kind("doc"), F.col("size")), before), F.lit(0)))))
    rows = rows.withColumn("doc_chars", total(F.col("t_doc")))
    share = F.floor((left - F.col("doc_chars")) / F.greatest(F.count_if(kind("notebook")).over(whole), F.lit(1)))
    rows = rows.withColumn("t_book", F.when(kind("notebook"), F.least("size", F.least(F.lit(R.NOTEBOOK_CAP), share).cast("long"))))
    rows = rows.withColumn("used", F.col("doc_chars") + total(F.col("t_book")))
    want = F.when(kind("script"), F.least("size", F.lit(R.SCRIPT_CAP)))
    take = F.coalesce("t_doc", "t_book", F.least(want, F.greatest(left - F.col("used") - total(want, before), F.lit(0))))
    rows = rows.withColumn("take", F.when(F.col("size").isNotNull(), take).cast("long"))
    return rows.where((F.col("take") > 0) | (kind("notebook") & F.col("size").isNotNull() & (F.col("doc_chars") < left))).drop("t_doc", "doc_chars", "t_book", "used")


def latest_n(frame: DataFrame, n: int, *order: Column | str, keys: tuple[str, ...] = ("repo_key",)) -> DataFrame:
    """The first ``n`` rows of each repository (or ``keys``) in the given order, with rank.

    In two steps, so that a repository with a large part of all rows is not one task's: first the first ``n`` of each share
    of it (a hash of its rows), which Spark also applies before the rows are moved, then the first ``n`` of those.
    """
    plain = [c for c, t in frame.dtypes if not t.startswith(("map", "variant"))]
    shared = frame.withColumn("_share", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in plain)), F.lit(SHARES)))
    few = _ranked(shared, [*keys, "_share"], list(order), "_rank").where(F.col("_rank") <= n).drop("_share", "_rank")
    return _ranked(few, list(keys), list(order), "rank").where(F.col("rank") <= n)


def link_files(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """Rows with ``entry`` (array of struct with path; owner and name beside it) one by one, trimmed, with a link."""
    one = entries.select("*", F.posexplode(entry).alias("idx", "_e"))
    path = F.regexp_replace(F.coalesce(F.col("_e.path"), F.lit("")), r"(?U)^\s+|\s+$", "")
    fields = [f for f in entries.schema[entry].dataType.elementType.fieldNames() if f != "path"]
    kept = one.withColumns({"path": path, **{f: F.col(f"_e.{f}") for f in fields}}).where("path != ''").drop("_e", entry)
    return kept.withColumn("link", F.concat(F.lit(R.FILE_ADDRESS[0]), "owner", F.lit("/"), "name", F.lit(R.FILE_ADDRESS[1]), "path"))


def example_meta(files: DataFrame) -> DataFrame:
    """repo_key, path, kind, place: all notebooks, then all scripts, whether a budget has room for them or not."""
    found = with_bucket(path_features(files), usage_bucket()).withColumnRenamed("bucket", "kind").where("kind in ('notebook', 'script')")
    return _ranked(found, ["repo_key"], [F.col("kind") != "notebook", "depth", "path_lower", "seq"], "place").select("repo_key", "path", "kind", "place")


def preprocessing_candidates(files: DataFrame) -> DataFrame:
    found = with_bucket(path_features(files), preprocessing_bucket())
    return top_n_per_bucket(found.where("bucket is not null"), {b: n for b, (n, _, _) in R.PREPROCESSING_BUCKETS.items()})
