"""Maintenance indicators from snapshot tables (A7 to A12, J4, J5). Limits are the listing sizes that decide the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from .papers import attach
from .files import SHARES, latest_n


def _newest() -> tuple[Column, Column]:
    return F.desc("ts"), F.desc("event_id")


def recent_commits(commits: DataFrame, as_of: str, days: int = 182, cap: int = 100) -> DataFrame:
    """repo_key, recent, n: commits (ts) not older than ``days`` at ``as_of``, counted up to ``cap``."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    n = F.least(F.count_if(F.col("ts").cast("timestamp_ntz") >= since), F.lit(cap))
    return commits.groupBy("repo_key").agg(n.alias("n")).select("repo_key", (F.col("n") > 0).alias("recent"), "n")


def issue_responses(issues: DataFrame, n: int = 30, order: tuple = ()) -> DataFrame:
    """repo_key, responded, detail: how many of the ``n`` issues updated last have a comment."""
    last = latest_n(issues, n, *(order or _newest())).groupBy("repo_key").agg(F.count_if(F.col("comments") > 0).alias("hit"), F.count(F.lit(1)).alias("n"))
    return last.select("repo_key", (F.col("hit") > 0).alias("responded"), F.concat(F.col("hit"), F.lit("/"), F.col("n"), F.lit(" issues have responses")).alias("detail"))


def multi_contributors(contributors: DataFrame, cap: int = 100) -> DataFrame:
    """repo_key, several, n: distinct contributors (actor), counted up to ``cap``.

    Each actor of a repository once, then no more than ``cap`` of them: a task keeps and sends at most that many of a
    repository, and their count is exact below the cap.
    """
    few = latest_n(contributors.where("actor is not null").select("repo_key", "actor").distinct(), cap, "actor")
    counted = few.groupBy("repo_key").agg(F.count(F.lit(1)).alias("n"))
    known = contributors.select("repo_key").distinct().join(counted, "repo_key", "left").select("repo_key", F.coalesce("n", F.lit(0)).alias("n"))
    return known.select("repo_key", (F.col("n") > 1).alias("several"), "n")


def versioned_releases(releases: DataFrame, tags: DataFrame, n: int = 10, order: tuple = ()) -> DataFrame:
    """repo_key, versioned, detail: version numbers among the ``n`` newest releases or else tags. Repositories with neither are the caller's to fill."""

    def newest(frame: DataFrame, word: str) -> DataFrame:
        named = latest_n(frame, n, *(order or _newest())).where(F.col("tag_name").rlike(R.SEMVER))
        found = named.groupBy("repo_key").agg(F.min_by("tag_name", "rank").alias("tag"), F.count(F.lit(1)).alias("k"))
        return found.select("repo_key", F.concat("tag", F.lit(" ("), "k", F.lit(f" semver {word})")).alias(word))

    known = releases.select("repo_key").unionByName(tags.select("repo_key")).distinct()
    both = known.join(newest(releases, "releases"), "repo_key", "left").join(newest(tags, "tags"), "repo_key", "left")
    detail = F.coalesce("releases", "tags")
    return both.select("repo_key", detail.isNotNull().alias("versioned"), F.coalesce(detail, F.lit("None")).alias("detail"))


def last_activity(meta: DataFrame, releases: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """repo_key, last (timestamp), stale: strictly older than ``days`` at ``as_of``; both null without any date."""
    newest = releases.groupBy("repo_key").agg(F.max(F.col("ts").cast("timestamp_ntz")).alias("released"))
    return with_last(meta.join(newest, "repo_key", "left"), as_of, days).select("repo_key", "last", "stale")


def with_last(rows: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """``rows`` (metadata and released) with last and stale."""
    dates = [F.col(c).cast("timestamp_ntz") for c in ("pushed_at", "updated_at") if c in rows.columns]
    out = rows.withColumn("last", F.greatest(*dates, F.col("released")))
    return out.withColumn("stale", F.col("last") < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def commit_totals(commits: DataFrame) -> DataFrame:
    """repo_key, last_commit_date (day, text), total_commits; the newest commit's date is the committer's or else the author's."""
    cols = [c for c in ("committer_date", "author_date", "ts") if c in commits.columns]
    day = F.date_format(F.coalesce(*cols), "yyyy-MM-dd")
    newest = F.max_by(day, F.struct("ts", "event_id")) if "seq" not in commits.columns else F.min_by(day, "seq")
    return commits.groupBy("repo_key").agg(newest.alias("last_commit_date"), F.count(F.lit(1)).alias("total_commits"))


#: What a scoreboard's rows are.
KINDS = ("commit", "issue", "contributor", "release", "tag")


def together(**tables: DataFrame) -> DataFrame:
    """Rows for scoreboard() from tables of their own, named by kind: commit=..., issue=..., and so on; columns that one lacks are null."""
    columns = {"repo_key": "string", "ts": "timestamp", "event_id": "long", "actor": "string", "comments": "long", "tag_name": "string"}
    rows = [t.select(F.lit(k).alias("kind"), *((F.col(c) if c in t.columns else F.lit(None)).cast(x).alias(c) for c, x in columns.items())) for k, t in tables.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def scoreboard(activity: DataFrame, as_of: str, days: int = 182, cap: int = 100, n_issues: int = 30, n_releases: int = 10) -> DataFrame:
    """All indicators of ``activity`` (repo_key, kind of KINDS, ts, event_id, actor, comments, tag_name) by one scan and one exchange of its rows.

    repo_key; recent, n_commits; responded, issue_detail; several, n_contributors; versioned, release_detail; released (newest
    release); last_commit_date, total_commits: what recent_commits(), issue_responses(), multi_contributors(),
    versioned_releases() and commit_totals() say of it. Null where a repository has no rows of a kind.

    Rows meet by repository, kind and share, contributors' shares by actor, so that a large repository is many tasks'. Each
    share becomes counts and its newest issues, releases and tags, and those merge by repository.
    """
    kind, is_ = F.col("kind"), lambda k: F.col("kind") == k
    rows = activity.select("repo_key", "kind", "ts", "event_id", F.when(is_("contributor"), F.col("actor")).alias("actor"), "comments", "tag_name").where(kind.isin(*KINDS))
    rows = rows.withColumn("share", F.pmod(F.when(is_("contributor"), F.xxhash64("actor")).otherwise(F.xxhash64("event_id")), F.lit(SHARES)))
    newest = Window.partitionBy("repo_key", "kind", "share").orderBy("actor", F.desc("ts"), F.desc("event_id"))
    rows = rows.withColumns({"rank": F.row_number().over(newest), "before": F.lag("actor").over(newest)})
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    row = F.struct(F.col("ts").alias("ts"), F.col("event_id").alias("id"), (F.coalesce("comments", F.lit(0)) > 0).alias("hit"), F.col("tag_name").alias("tag"))
    first = lambda k, n: F.collect_list(F.when(is_(k) & (F.col("rank") <= n), row))
    each = rows.groupBy("repo_key").agg(
        F.count_if(is_("commit")).alias("commits"), F.count_if(is_("commit") & (F.col("ts").cast("timestamp_ntz") >= since)).alias("late"),
        F.max(F.when(is_("commit"), F.struct("ts", "event_id"))).alias("head"), F.max(F.when(is_("release"), F.col("ts").cast("timestamp_ntz"))).alias("released"),
        F.count_if(is_("contributor")).alias("actors_rows"), F.count_if(is_("contributor") & F.col("actor").isNotNull() & ~F.col("actor").eqNullSafe(F.col("before"))).alias("actors"),
        first("issue", n_issues).alias("issues"), first("release", n_releases).alias("releases"), first("tag", n_releases).alias("tags"),
    )
    top = lambda c, n: F.slice(F.sort_array(c, False), 1, n)
    issues = top("issues", n_issues)
    hits = F.size(F.filter(issues, lambda x: x["hit"]))

    def versions(c: str, word: str) -> Column:
        named = F.filter(top(c, n_releases), lambda x: x["tag"].rlike(R.SEMVER))
        return F.when(F.size(named) > 0, F.concat(F.get(named, F.lit(0))["tag"], F.lit(" ("), F.size(named).cast("string"), F.lit(f" semver {word})")))

    detail = F.coalesce(versions("releases", "releases"), versions("tags", "tags"))
    n_commits, n_actors = F.least("late", F.lit(cap)), F.least("actors", F.lit(cap))
    held = lambda c, v: F.when(c, v)
    some, asked, people, tagged = F.col("commits") > 0, F.size("issues") > 0, F.col("actors_rows") > 0, (F.size("releases") > 0) | (F.size("tags") > 0)
    return each.select(
        "repo_key", held(some, n_commits > 0).alias("recent"), held(some, n_commits).alias("n_commits"),
        held(asked, hits > 0).alias("responded"), held(asked, F.concat(hits.cast("string"), F.lit("/"), F.size(issues).cast("string"), F.lit(" issues have responses"))).alias("issue_detail"),
        held(people, n_actors > 1).alias("several"), held(people, n_actors).alias("n_contributors"),
        held(tagged, detail.isNotNull()).alias("versioned"), held(tagged, F.coalesce(detail, F.lit("None"))).alias("release_detail"), "released",
        held(some, F.date_format("head.ts", "yyyy-MM-dd")).alias("last_commit_date"), held(some, F.col("commits")).alias("total_commits"),
    )


def detect_license(papers: DataFrame, licenses: DataFrame, files: DataFrame) -> DataFrame:
    """``papers`` (repo_key) with license_name, spdx_id, license_path, source: the service's verdict, else a licence file at the root, else none."""
    verdicts = licenses.where("coalesce(spdx_id, '') not in ('', 'NOASSERTION')")
    name = F.col("name") if "name" in licenses.columns else F.lit(None).cast("string")
    path = F.col("path") if "path" in licenses.columns else F.lit(None).cast("string")
    verdicts = verdicts.select("repo_key", F.struct(F.coalesce(F.nullif(name, F.lit("")), "spdx_id").alias("name"), F.col("spdx_id").alias("spdx"), F.coalesce(path, F.lit("")).alias("path"), F.lit("service").alias("source")).alias("a"))
    scanned = files.where(~F.col("path").contains("/") & F.lower("path").isin(*R.LICENSE_NAMES)).groupBy("repo_key").agg(F.min_by("path", "seq").alias("p"))
    scanned = scanned.select("repo_key", F.struct(F.lit(R.CUSTOM_LICENSE).alias("name"), F.lit("").alias("spdx"), F.col("p").alias("path"), F.lit("file_scan").alias("source")).alias("b"))
    none = F.struct(F.lit(R.MISSING_LICENSE).alias("name"), F.lit("").alias("spdx"), F.lit("").alias("path"), F.lit("missing").alias("source"))
    found = attach(attach(papers, verdicts), scanned)
    best = found.withColumn("c", F.when(F.col("repo_key").isNotNull(), F.coalesce("a", "b", none)))
    return best.select(*papers.columns, F.col("c.name").alias("license_name"), F.col("c.spdx").alias("spdx_id"), F.col("c.path").alias("license_path"), F.col("c.source").alias("source"))


def attach_downloads(packages: DataFrame, downloads: DataFrame) -> DataFrame:
    """``packages`` (package, ...) with last_month and note, where a package that was found has no numbers."""
    missing = F.concat(F.lit(R.NO_DOWNLOADS[0]), F.col("package"), F.lit(R.NO_DOWNLOADS[1]))
    out = attach(packages, downloads, "package", own="pos" if "pos" in packages.columns else "repo_key")
    return out.withColumn("download_note", F.when(F.col("package").isNotNull() & F.col("last_month").isNull(), missing))


def indicator(value: Column, detail: Column) -> Column:
    return F.struct(value.alias("value"), detail.alias("detail"))
