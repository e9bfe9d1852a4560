"""Operators on the list of papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.answers import truth_label
from ..functions.urls import is_hosted, parse_repo_url, repo_key, strip


def with_keys(papers: DataFrame) -> DataFrame:
    """``papers`` with owner, name and repo_key of their address, null where it has none."""
    found = parse_repo_url(F.col("repo"))
    return papers.withColumns({"owner": found["owner"], "name": found["repo"], "repo_key": repo_key(F.col("repo"))})


def attach(papers: DataFrame, other: DataFrame, key: str = "repo_key", how: str = "left", own: str = "pos") -> DataFrame:
    """``papers`` joined to ``other`` by a key that many papers may lack: each of those has a key of its own, from its
    column ``own``, that matches nothing, so that they spread over all partitions and don't meet in one.

    The expression is the same in every call, so one exchange of the papers serves all joins of a job.
    """
    alone = F.concat(F.lit("\0"), F.coalesce(papers[own].cast("string"), F.lit("")))
    right = other.withColumnRenamed(key, "_other")
    return papers.join(right, F.coalesce(papers[key], alone) == right["_other"], how).drop("_other")


def _later(keys: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """(key, first) - the first place of each key. Blank and null keys, which can be many, take no part."""
    return keys.where(F.coalesce(F.length(key) > 0, F.lit(False))).groupBy(key).agg(F.min(order).alias("first"))


def dedupe_first(papers: DataFrame) -> DataFrame:
    """The first paper of each address, read without case, outer white space and trailing slashes; papers without one all stay."""
    keyed = papers.withColumn("_url", F.lower(F.regexp_replace(strip(F.coalesce("repo", F.lit(""))), "/+$", "")))
    first = _later(keyed, "_url")
    kept = attach(keyed.withColumn("_url", F.nullif("_url", F.lit(""))), first, "_url").where(F.col("first").isNull() | (F.col("first") == F.col("pos")))
    return kept.select(*papers.columns)


def mark_duplicates(papers: DataFrame) -> DataFrame:
    """``papers`` (with_keys) with duplicate: an earlier paper has the same owner and name, on the host itself."""
    hosted = F.when(is_hosted(F.col("repo")), F.col("repo_key"))
    keyed = papers.withColumn("_key", hosted)
    return attach(keyed, _later(keyed, "_key"), "_key").withColumn("duplicate", F.coalesce(F.col("first") < F.col("pos"), F.lit(False))).drop("_key", "first")


def validate_papers(papers: DataFrame) -> DataFrame:
    """``papers`` with flags: what is wrong with each title and address, in words; repo problems exclude each other.

    A column has_repo, if there, tells a record without the field from a blank one.
    """
    marked = mark_duplicates(with_keys(papers))
    url = strip(F.coalesce("repo", F.lit("")))
    absent = ~F.col("has_repo") if "has_repo" in papers.columns else F.lit(False)
    title = F.when(F.coalesce(F.length(strip(F.col("title"))), F.lit(0)) == 0, R.FLAG_NO_TITLE)
    repo = (
        F.when(absent, R.FLAG_NO_REPO)
        .when(url == "", R.FLAG_BLANK_REPO)
        .when(~is_hosted(url), F.concat(F.lit(R.FLAG_NOT_HOSTED), url))
        .when(F.col("repo_key").isNull(), F.concat(F.lit(R.FLAG_NOT_PARSED), url))
        .when(F.col("duplicate"), F.concat(F.lit(R.FLAG_DUPLICATE), F.col("owner"), F.lit("/"), F.col("name")))
    )
    return marked.withColumn("flags", F.array_compact(F.array(title, repo)))


def quality_report(validated: DataFrame) -> DataFrame:
    """pos, title, repo, report: every paper, its flags line by line or OK."""
    text = F.array_join("flags", "\n")
    return validated.select("pos", "title", "repo", F.when(text == "", "OK").otherwise(text).alias("report"))


def quality_counts(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count(F.lit(1)).alias("papers"), F.count_if(F.size("flags") > 0).alias("flagged"))


def flag_dead(validated: DataFrame, liveness: DataFrame) -> DataFrame:
    """Flags from a table of probes (repo_key, status; a null status is a probe that failed) added to those of parseable papers."""
    probes = liveness.select("repo_key", F.col("status").alias("_status"), F.lit(True).alias("_probed"))
    where = F.concat(F.col("owner"), F.lit("/"), F.col("name"))
    more = F.when(F.col("_status") == 404, F.concat(F.lit(R.FLAG_GONE), where)).when(F.col("_probed") & F.col("_status").isNull(), F.concat(F.lit(R.FLAG_UNKNOWN), where))
    more = F.when(is_hosted(F.col("repo")), more)
    joined = attach(validated, probes)
    return joined.withColumn("flags", F.array_compact(F.array_append("flags", more))).drop("_status", "_probed")


def attach_meta(papers: DataFrame, meta: DataFrame) -> DataFrame:
    """``papers`` (with_keys) with the repository's metadata and reachable: it has some."""
    return attach(papers, meta.withColumn("reachable", F.lit(True))).withColumn("reachable", F.coalesce("reachable", F.lit(False)))


def reachability_note(unreachable: str) -> Column:
    """Why a paper of attach_meta has no numbers: no address, none that parses, or no answer (said in the check's own words)."""
    url = F.coalesce("repo", F.lit(""))
    return F.when(url == "", R.NO_URL).when(F.col("repo_key").isNull(), R.NOT_HOSTED).when(~F.col("reachable"), unreachable).otherwise("")


def unreachable(papers: DataFrame, meta: DataFrame) -> DataFrame:
    return papers.where("repo_key is not null").join(meta.select("repo_key"), "repo_key", "left_anti")


def reachable(papers: DataFrame, meta: DataFrame) -> DataFrame:
    return papers.join(meta.select("repo_key"), "repo_key", "left_semi")


def models_cross(papers: DataFrame, models: list[str]) -> DataFrame:
    """Each paper once for each model: keys only go in, texts join later."""
    return papers.withColumn("model", F.explode(F.array(*map(F.lit, models))))


def attach_ground_truth(results: DataFrame, papers: DataFrame) -> DataFrame:
    """``results`` of labelled titles with truth; of papers that share a title, the last that says yes or no decides."""
    labelled = papers.select(F.coalesce("title", F.lit("")).alias("title"), "pos", truth_label(F.col("ground_truth")).alias("truth")).where("truth is not null")
    last = labelled.groupBy("title").agg(F.max_by("truth", "pos").alias("truth"))
    titled = results.withColumn("title", F.coalesce("title", F.lit("")))
    # Results without a title can be many: their one label, a single row, goes to them.
    blank = titled.where("title = ''").join(F.broadcast(last.where("title = ''")), "title")
    return titled.where("title != ''").join(last.where("title != ''"), "title").unionByName(blank)


def first_wins(frame: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
