"""Every operator as a query over the driver's tables, with the SQL that gives the same rows in another engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import notebooks, parsers, paths, urls
from ..functions import rules as R
from ..functions import text as T
from ..operators import activity, files as fl, papers as pp, summary
from ..sources.files import decode_content, read_papers, repo_blobs, scratch, write_report
from ..sources.lens import Lens, with_lenses
from . import jobs

AS_OF, RECENT, STALE = "2024-01-31", 7, 20
MODELS = ["model-a", "model-b", "model-c"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *lenses: str):
    """Registers a function of a Lens under its own name; ``sql`` may use the lenses named, as lens_<name>."""

    def register(f: Callable[[Lens], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Lens(spark, sf_dir))
        if sql is not None:
            joiner = ",\n" if re.match(r"\s*\w+ AS \(", sql) else "\n"
            ORACLES[f.__name__] = (with_lenses(*lenses) + joiner if lenses else "") + sql
        return f

    return register


def _in(names) -> str:
    return "(" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + ")"


def _starts(column: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({column}, '{p}')" for p in prefixes) + ")"


def _holds(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# ---- SQL texts used more than once

KEYED = r"""k AS (SELECT *, CASE WHEN h1 <> '' THEN h1 WHEN g1 <> '' THEN g1 END AS owner, CASE WHEN h1 <> '' THEN h2 WHEN g1 <> '' THEN g2 END AS name,
  lower(CASE WHEN h1 <> '' THEN h1 || '/' || h2 WHEN g1 <> '' THEN g1 || '/' || g2 END) AS repo_key
 FROM (SELECT *, regexp_extract(repo, 'github\.com/([^/]+)/([^/?.#]+)', 1) AS h1, regexp_extract(repo, 'github\.com/([^/]+)/([^/?.#]+)', 2) AS h2,
  regexp_extract(trim(repo), '^https?://([^./]+)\.github\.io/([^/?#]+)', 1) AS g1, regexp_extract(trim(repo), '^https?://([^./]+)\.github\.io/([^/?#]+)', 2) AS g2 FROM lens_papers) u)
"""
FEATS = r"""x AS (SELECT *, CASE WHEN contains(basename, '.') THEN '.' || split_part(basename, '.', -1) ELSE '' END AS ext,
  regexp_extract(path_lower, '(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$', 1) AS ext_os
 FROM (SELECT *, lower(path) AS path_lower, split_part(lower(path), '/', -1) AS basename, length(path) - length(replace(path, '/', '')) AS depth,
  CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS top FROM lens_files) f)
"""
#: What the lens's notebooks say, as the other engine reads them: the code cell's text, unescaped, between what is known of its neighbours.
_CODE_CELL = r"""replace(regexp_extract(content, '"source": (?:\["import a.n", )?"(.*?)"(?:, ""\])?, "id"', 1), chr(92) || 'n', chr(10))"""
FLAT = rf"""CASE WHEN NOT ends_with(path, '.ipynb') OR NOT starts_with(content, '{{"cells": [{{') THEN content
 WHEN contains(content, 'import a') AND contains(content, '"source": ["import a') THEN '# --- Cell 0 (code) ---' || chr(10) || 'import a' || chr(10) || {_CODE_CELL}
 ELSE CASE WHEN regexp_matches({_CODE_CELL}, '\S') THEN '# --- Cell 0 (code) ---' || chr(10) || {_CODE_CELL} || chr(10) || chr(10) ELSE '' END || '# --- Cell 3 (markdown) ---' || chr(10) || '# # Title' || chr(10) || '#   say so' END"""
#: As an example, a notebook without cells shows nothing, but counts as read.
SHOWN = f"CASE WHEN starts_with(content, '{{\"cells\": []') THEN '' ELSE {FLAT} END"


def _read(sql: str, text: str = FLAT) -> str:
    """``sql`` over FEATS, with contents as they are read; raw is what they were."""
    return sql.replace("FROM lens_files) f", f"FROM (SELECT * REPLACE ({text} AS content), content AS raw FROM lens_files) AS raw_files) f", 1)


SOURCE = f"(ext IN {_in(R.API_SOURCE_EXTS)} AND NOT {_starts('path_lower', R.SKIP_FOLDERS)} AND basename NOT IN {_in(R.SKIP_NAMES)})"
API_BUCKET = f"""CASE WHEN starts_with(basename, 'readme') THEN 'readme' WHEN path_lower IN {_in(R.DOC_NAMES)} OR basename IN {_in(R.DOC_NAMES)} THEN 'config'
 WHEN {_starts('path_lower', R.DOC_FOLDERS)} THEN CASE WHEN ext IN {_in(R.DOC_EXTS + R.HTML_EXTS)} THEN 'page' END WHEN {SOURCE} THEN 'source' END"""
PRE_BUCKET = f"""CASE WHEN NOT {_starts('path_lower', R.PREPROCESSING_SKIP)} AND ext_os IN {_in(R.PREPROCESSING_EXTS)} THEN
 CASE WHEN regexp_matches(basename, {_re(R.PREPROCESSING_NAME)}) THEN 'named' WHEN {_starts('path_lower', R.PREPROCESSING_FOLDERS)} THEN 'folder' ELSE 'generic' END END"""
USAGE_BUCKET = f"""CASE WHEN ext = '.ipynb' THEN 'notebook' WHEN path_lower IN {_in(R.USAGE_NAMES)} OR basename IN {_in(R.USAGE_NAMES)} THEN 'doc'
 WHEN {_starts('path_lower', R.EXAMPLE_FOLDERS)} THEN CASE WHEN ext IN {_in(R.DOC_EXTS)} THEN 'doc' WHEN ext IN {_in(R.SCRIPT_EXTS)} THEN 'script' END
 WHEN ext IN {_in(R.SCRIPT_EXTS)} AND {_holds('basename', R.EXAMPLE_WORDS)} THEN 'script' END"""
#: Verdicts of the answers, as the labels' lens writes them: the other engine knows their values by sight, the texts "false" and "0" among the yes.
RESULTS = r"""x AS (SELECT r.pos, r.model, p.title, p.repo, p.ground_truth, r.prompt_tokens, r.completion_tokens, r.total_tokens,
  regexp_extract(r.raw, '"has_usage_examples": (.*?), "evid', 1) AS said,
  CASE WHEN coalesce(p.repo, '') = '' OR NOT contains(p.repo, 'github.com') THEN 'skipped'
   WHEN regexp_extract(p.repo, 'github\.com/([^/]+)/([^/?.#]+)', 1) = '' THEN 'error'
   WHEN r.raw = '' OR contains(r.raw, '{"has": tru') OR contains(r.raw, 'and so on') OR said IN ('', 'null') THEN 'error'
   WHEN said IN ('true', '"false"', '"0"', '-1', '[false]') THEN 'yes' ELSE 'no' END AS status,
  CASE WHEN r.raw = '' OR contains(r.raw, '{"has": tru') OR contains(r.raw, 'and so on') THEN NULL WHEN contains(r.raw, 'CLI usage') THEN ['CLI usage', 'notebook'] ELSE ['notebook'] END AS types
 FROM lens_answers r JOIN lens_papers p ON p.pos = r.pos)
"""

ANSWER_FIELDS = {"has_usage_examples": "truth", "evidence": "string", "example_types": "array<string>", "example_files": "array<string>"}


def results(t: Lens) -> DataFrame:
    return jobs.judge_answers(t.answers, t.papers)


def keyed(t: Lens) -> DataFrame:
    return pp.with_keys(t.papers)


def feats(t: Lens) -> DataFrame:
    return paths.path_features(t.files)


def activity_of(t: Lens, kind: str) -> DataFrame:
    return t.activity.where(F.col("kind") == kind)


# ---- sources


@query("SELECT doc_id, md5('a' || chr(65533) || text) AS back, length(text) + 2 AS n FROM documents WHERE text IS NOT NULL")
def s3_decode_content(t: Lens) -> DataFrame:
    """Each text behind a U+FFFD of its own and between bytes that are no UTF-8."""
    sent = F.base64(F.concat(F.unhex(F.lit("FF61EFBFBDC3")), F.col("text").cast("binary"), F.unhex(F.lit("E282"))))
    back = decode_content(sent)
    return t.table("documents").where("text is not null").select("doc_id", F.md5(back.cast("binary")).alias("back"), F.length(back).cast("long").alias("n"))


@query("SELECT row_number() OVER (PARTITION BY pos // 1000 ORDER BY pos) - 1 AS pos, title, repo, ground_truth, repo IS NOT NULL AS has_repo FROM lens_papers", "papers")
def s1_read_papers(t: Lens) -> DataFrame:
    """The papers as JSON lists of a thousand records, written and read; a record without an address has no such key."""
    record = F.struct("pos", F.to_json(F.struct("title", "repo", "ground_truth")).alias("json"))
    lists = t.papers.groupBy(F.floor(F.col("pos") / 1000).alias("part")).agg(F.array_sort(F.collect_list(record)).alias("l"))
    path = scratch(t.spark, "papers")
    text = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["json"]), ",\n"), F.lit("]"))
    lists.repartition("part").select("part", text.alias("value")).write.partitionBy("part").text(path)
    return read_papers(t.spark, f"{path}/*").select("pos", "title", "repo", "ground_truth", "has_repo")


#: A report's rows, part by part, as text.
REPORTED = RESULTS + """, detail AS (SELECT pos, model, unnest(types) AS type FROM x),
said AS (SELECT pos, coalesce(max(upper(status)) FILTER (WHERE model = 'model-a'), 'N/A') || ' ' || coalesce(max(upper(status)) FILTER (WHERE model = 'model-b'), 'N/A') || ' ' || coalesce(max(upper(status)) FILTER (WHERE model = 'model-c'), 'N/A') AS s FROM x GROUP BY pos)
SELECT 'results' AS part, pos || ' ' || model || ' ' || status || ' ' || coalesce(array_to_string(types, ','), '') AS said FROM x
UNION ALL SELECT 'detail', pos || ' ' || model || ' ' || type FROM detail
UNION ALL SELECT 'summary', s || ' ' || count(x.status) FROM (SELECT unnest(['yes', 'no', 'skipped', 'error']) AS s) LEFT JOIN x ON x.status = s GROUP BY s
UNION ALL SELECT 'summary', 'total ' || count(*) FROM x UNION ALL SELECT 'summary', 'coverage_pct ' || CAST(floor(count(*) FILTER (WHERE status = 'yes') / greatest(count(*), 1) * 100) AS BIGINT) FROM x
UNION ALL SELECT 'comparison', pos || ' ' || s FROM said"""


@query(REPORTED, "papers", "answers")
def s4_write_report(t: Lens) -> DataFrame:
    """A report with all its parts, written and read again, each as it was."""
    path, found = scratch(t.spark, "report"), results(t)
    detail = found.select("pos", "model", F.explode("example_types").alias("type"))
    write_report(path, found, detail, jobs.summarise(found), summary.model_agreement(found, MODELS))
    read = lambda part, *columns: t.spark.read.parquet(f"{path}/{part}").select(F.lit(part).alias("part"), F.concat_ws(" ", *columns).alias("said"))
    out = read("results", F.col("pos"), "model", "status", F.array_join("example_types", ","))
    for more in (read("detail", F.col("pos"), "model", "type"), read("summary", F.col("metric"), F.floor("value")), read("comparison", F.col("pos"), *(F.col(f"`{m}`") for m in MODELS))):
        out = out.unionByName(more)
    return out


@query("SELECT repo_key, count(*) AS n FROM lens_files WHERE seq % 9 <> 0 GROUP BY repo_key", "files")
def s2_repo_blobs(t: Lens) -> DataFrame:
    tree = t.files.withColumn("type", F.when(F.col("seq") % 9 == 0, "tree").otherwise("blob"))
    return repo_blobs(tree).groupBy("repo_key").agg(F.count(F.lit(1)).alias("n"))


# ---- projections and predicates


@query(KEYED + "SELECT pos, owner, name, repo_key FROM k", "papers")
def p1_parse_repo_url(t: Lens) -> DataFrame:
    return keyed(t).select("pos", "owner", "name", "repo_key")


@query("SELECT pos, coalesce(contains(repo, 'github.com'), false) AS hosted FROM lens_papers", "papers")
def p2_is_hosted(t: Lens) -> DataFrame:
    return t.papers.select("pos", urls.is_hosted(F.col("repo")).alias("hosted"))


@query(r"SELECT pos, CASE WHEN len(s) > 1 THEN s[-2] END AS owner, s[-1] AS name FROM (SELECT pos, string_split(regexp_replace(regexp_replace(repo, '/+$', ''), '\.git$', ''), '/') AS s FROM lens_papers)", "papers")
def p3_last_two_segments(t: Lens) -> DataFrame:
    found = urls.last_two_segments(F.col("repo"))
    return t.papers.select("pos", found["owner"].alias("owner"), found["repo"].alias("name"))


VALID = KEYED + r""", v AS (SELECT *, min(pos) OVER (PARTITION BY CASE WHEN contains(repo, 'github.com') THEN repo_key END) AS first FROM k),
w AS (SELECT *, CASE WHEN trim(coalesce(title, '')) = '' THEN 'Missing title.' END AS f1, CASE WHEN trim(coalesce(repo, '')) = '' THEN 'Missing repo URL.'
 WHEN NOT contains(repo, 'github.com') THEN 'Repo is not a GitHub URL (will be skipped): ' || trim(repo) WHEN repo_key IS NULL THEN 'Repo URL not parseable as github.com/owner/repo: ' || trim(repo)
 WHEN first < pos THEN 'Duplicate repo (also appears earlier in the list): ' || owner || '/' || name END AS f2 FROM v)
"""


@query(VALID + "SELECT pos, concat_ws(chr(10), f1, f2) AS flags FROM w", "papers")
def p4_validate_papers(t: Lens) -> DataFrame:
    return pp.validate_papers(t.papers).select("pos", F.array_join("flags", "\n").alias("flags"))


@query(VALID + "SELECT pos, title, repo, CASE WHEN f1 IS NULL AND f2 IS NULL THEN 'OK' ELSE concat_ws(chr(10), f1, f2) END AS report FROM w", "papers")
def p5_quality_report(t: Lens) -> DataFrame:
    return pp.quality_report(pp.validate_papers(t.papers))


@query(VALID + "SELECT count(*) AS papers, count(*) FILTER (WHERE f1 IS NOT NULL OR f2 IS NOT NULL) AS flagged FROM w", "papers")
def p5_quality_counts(t: Lens) -> DataFrame:
    return pp.quality_counts(pp.validate_papers(t.papers))


@query(VALID + r"""SELECT w.pos, concat_ws(chr(10), f1, f2, CASE WHEN contains(w.repo, 'github.com') AND l.repo_key IS NOT NULL THEN CASE WHEN l.status = 404 THEN 'Repo not found on GitHub (404): ' || owner || '/' || name
 WHEN l.status IS NULL THEN 'Repo liveness check could not complete (network): ' || owner || '/' || name END END) AS flags FROM w LEFT JOIN lens_liveness l ON l.repo_key = w.repo_key""", "papers", "liveness")
def p6_flag_dead(t: Lens) -> DataFrame:
    return pp.flag_dead(pp.validate_papers(t.papers), t.liveness).select("pos", F.array_join("flags", "\n").alias("flags"))


@query(FEATS + "SELECT repo_key, path, path_lower, basename, depth, top FROM x", "files")
def p7_path_features(t: Lens) -> DataFrame:
    return feats(t).select("repo_key", "path", "path_lower", "basename", F.col("depth").cast("long").alias("depth"), "top")


@query(FEATS + "SELECT repo_key, path, ext, ext_os FROM x", "files")
def p8_extensions(t: Lens) -> DataFrame:
    return feats(t).select("repo_key", "path", "ext", "ext_os")


@query(f"SELECT repo_key, path, CAST(CASE WHEN lower(path) IN {_in(R.ROOT_README_NAMES)} THEN 0 WHEN NOT contains(path, '/') THEN 1 ELSE 2 END AS BIGINT) AS plain, CAST(CASE WHEN lower(path) IN {_in(R.ROOT_README_NAMES)} THEN 0 WHEN NOT contains(path, '/') THEN 1 WHEN contains(lower(path), 'readme') THEN 3 ELSE 2 END AS BIGINT) AS nested_last FROM lens_files", "files")
def p9_readme_priority(t: Lens) -> DataFrame:
    p = F.col("path")
    return t.files.select("repo_key", "path", paths.readme_priority(p).cast("long").alias("plain"), paths.readme_priority(p, True).cast("long").alias("nested_last"))


@query("SELECT repo_key, arg_min(path, seq) AS path FROM lens_files WHERE starts_with(lower(path), 'readme') GROUP BY repo_key", "files")
def p10_first_readme(t: Lens) -> DataFrame:
    return fl.first_readme(t.files)


@query(FEATS + f"SELECT repo_key, path, {SOURCE} AS source FROM x", "files")
def p11_is_source_file(t: Lens) -> DataFrame:
    return feats(t).select("repo_key", "path", paths.is_source_file(R.API_SOURCE_EXTS).alias("source"))


@query(FEATS + f"SELECT repo_key, path, {PRE_BUCKET} AS bucket FROM x", "files")
def p12_preprocessing_bucket(t: Lens) -> DataFrame:
    return feats(t).select("repo_key", "path", paths.preprocessing_bucket().alias("bucket"))


@query(FEATS + f"SELECT repo_key, path, {API_BUCKET} AS bucket FROM x", "files")
def p13_api_docs_bucket(t: Lens) -> DataFrame:
    return feats(t).select("repo_key", "path", paths.api_docs_bucket().alias("bucket"))


@query(FEATS + f"SELECT repo_key, path, {USAGE_BUCKET} AS bucket FROM x", "files")
def p14_usage_bucket(t: Lens) -> DataFrame:
    return feats(t).select("repo_key", "path", paths.usage_bucket().alias("bucket"))


INSTALL = f"""x AS (SELECT *, lower(path) IN {_in(R.INSTALL_NAMES)} OR split_part(lower(path), '/', -1) IN {_in(R.INSTALL_NAMES)} AS named FROM lens_files),
y AS (SELECT repo_key, bool_or(named) AS any_named, arg_min(path, seq) FILTER (WHERE starts_with(lower(path), 'readme')) AS readme FROM x GROUP BY repo_key)
"""


@query(INSTALL + "SELECT x.repo_key, x.path FROM x JOIN y ON x.repo_key = y.repo_key WHERE x.named OR (NOT any_named AND x.path = readme)", "files")
def p15_select_install_files(t: Lens) -> DataFrame:
    return fl.select_install_files(t.files).select("repo_key", "path")


@query(f"SELECT repo_key, bool_or(NOT contains(path, '/') AND starts_with(lower(path), 'readme')) AS has_readme, bool_or(NOT contains(path, '/') AND lower(path) IN {_in(R.SETUP_NAMES)}) AS has_setup FROM lens_files GROUP BY repo_key", "files")
def p16_root_presence(t: Lens) -> DataFrame:
    return fl.root_presence(t.files)


@query(RESULTS + "SELECT pos, model, status FROM x WHERE status IN ('skipped', 'error')", "papers", "answers")
def p17_non_target_rows(t: Lens) -> DataFrame:
    return summary.non_target_rows(results(t)).select("pos", "model", "status")


# ---- joins


@query(KEYED + "SELECT pos, k.repo_key, stars, forks, m.repo_key IS NOT NULL AS reachable, CASE WHEN coalesce(repo, '') = '' THEN 'No repo URL provided' WHEN k.repo_key IS NULL THEN 'Not a GitHub repo URL' WHEN m.repo_key IS NULL THEN 'gone' ELSE '' END AS note FROM k LEFT JOIN lens_meta m ON m.repo_key = k.repo_key", "papers", "meta")
def j1_attach_meta(t: Lens) -> DataFrame:
    return pp.attach_meta(keyed(t), t.meta).select("pos", "repo_key", "stars", "forks", "reachable", pp.reachability_note("gone").alias("note"))


@query(KEYED + "SELECT pos, repo_key, repo_key IN (SELECT repo_key FROM lens_meta) AS reachable FROM k WHERE repo_key IS NOT NULL", "papers", "meta")
def j2_reachable(t: Lens) -> DataFrame:
    p = keyed(t)
    tag = lambda f, v: f.select("pos", "repo_key", F.lit(v).alias("reachable"))
    return tag(pp.unreachable(p, t.meta), False).unionByName(tag(pp.reachable(p, t.meta), True))


@query(FEATS + f"SELECT repo_key, path, length(content) AS n FROM x WHERE {PRE_BUCKET} IS NOT NULL AND length(content) > 0", "files")
def j3_attach_contents(t: Lens) -> DataFrame:
    some = feats(t).where(paths.preprocessing_bucket().isNotNull()).select("repo_key", "path")
    return fl.attach_contents(some, t.files).select("repo_key", "path", F.length("content").cast("long").alias("n"))


LICENSED = KEYED + f""", l AS (SELECT repo_key, arg_min(path, seq) AS p FROM lens_files WHERE NOT contains(path, '/') AND lower(path) IN {_in(R.LICENSE_NAMES)} GROUP BY repo_key),
v AS (SELECT k.*, CASE WHEN coalesce(m.spdx_id, '') NOT IN ('', 'NOASSERTION') THEN m.spdx_id END AS s, l.p FROM k LEFT JOIN lens_meta m ON m.repo_key = k.repo_key LEFT JOIN l ON l.repo_key = k.repo_key),
w AS (SELECT pos, title, repo, repo_key, CASE WHEN repo_key IS NULL THEN NULL WHEN s IS NOT NULL THEN s WHEN p IS NOT NULL THEN '{R.CUSTOM_LICENSE}' ELSE 'MISSING' END AS license_name, CASE WHEN repo_key IS NOT NULL THEN coalesce(s, '') END AS spdx_id,
 CASE WHEN repo_key IS NULL THEN NULL WHEN s IS NULL AND p IS NOT NULL THEN p ELSE '' END AS license_path, CASE WHEN repo_key IS NULL THEN NULL WHEN s IS NOT NULL THEN 'service' WHEN p IS NOT NULL THEN 'file_scan' ELSE 'missing' END AS source FROM v)
"""


@query(LICENSED + "SELECT pos, license_name, spdx_id, license_path, source FROM w", "papers", "meta", "files")
def j4_detect_license(t: Lens) -> DataFrame:
    return activity.detect_license(keyed(t), t.meta, t.files).select("pos", "license_name", "spdx_id", "license_path", "source")


PACKAGES = r"""x AS (SELECT repo_key, coalesce(max(n) FILTER (WHERE path = 'pyproject.toml'), max(n) FILTER (WHERE path = 'setup.cfg'), max(n) FILTER (WHERE path = 'setup.py')) AS package FROM
 (SELECT repo_key, path, nullif(CASE path WHEN 'pyproject.toml' THEN regexp_extract(content, '(?m)^\s*name\s*=\s*[''"]([A-Za-z0-9_.\-]+)[''"]', 1) WHEN 'setup.cfg' THEN regexp_extract(content, '(?im)^\s*name\s*=\s*([A-Za-z0-9_.\-]+)', 1)
  WHEN 'setup.py' THEN regexp_extract(content, '(?is)setup\s*\([^)]*?\bname\s*=\s*[''"]([A-Za-z0-9_.\-]+)[''"]', 1) END, '') AS n FROM lens_files WHERE path IN ('pyproject.toml', 'setup.cfg', 'setup.py')) GROUP BY repo_key)
"""


def packages(t: Lens) -> DataFrame:
    named = t.files.withColumn("package", T.package_name(F.col("path"), F.col("content"))).where("package is not null")
    return named.groupBy("repo_key").agg(F.min_by("package", T.package_priority(F.col("path"))).alias("package"))


@query(PACKAGES + "SELECT x.repo_key, x.package, last_month, CASE WHEN last_month IS NULL THEN 'Package ''' || x.package || ''' detected from repo but not found on PyPI / pypistats.' END AS download_note FROM x LEFT JOIN lens_downloads d ON d.package = x.package WHERE x.package IS NOT NULL", "files", "downloads")
def j5_attach_downloads(t: Lens) -> DataFrame:
    return activity.attach_downloads(packages(t), t.downloads).select("repo_key", "package", "last_month", "download_note")


@query("SELECT pos, model FROM lens_papers CROSS JOIN (SELECT unnest(['model-a', 'model-b', 'model-c']) AS model)", "papers")
def j6_models_cross(t: Lens) -> DataFrame:
    return pp.models_cross(t.papers.select("pos"), MODELS)


TRUTH = RESULTS + f""", y AS (SELECT coalesce(title, '') AS title, arg_max(l, pos) AS truth FROM (SELECT title, pos, CASE WHEN lower(trim(ground_truth)) IN {_in(R.POSITIVE_LABELS)} THEN true WHEN lower(trim(ground_truth)) IN {_in(R.NEGATIVE_LABELS)} THEN false END AS l FROM lens_papers) WHERE l IS NOT NULL GROUP BY coalesce(title, '')),
z AS (SELECT x.pos, x.model, x.status, y.truth FROM x JOIN y ON y.title = coalesce(x.title, ''))
"""


def truths(t: Lens) -> DataFrame:
    return pp.attach_ground_truth(results(t), t.papers)


@query(TRUTH + "SELECT pos, model, status, truth FROM z", "papers", "answers")
def j7_attach_ground_truth(t: Lens) -> DataFrame:
    return truths(t).select("pos", "model", "status", "truth")


@query(KEYED + "SELECT pos, p AS path, 'https://github.com/' || owner || '/' || name || '/blob/HEAD/' || p AS link FROM (SELECT pos, owner, name, unnest([title, 'a.py']) AS p FROM k) WHERE coalesce(p, '') <> ''", "papers")
def j8_link_files(t: Lens) -> DataFrame:
    entry = F.array(F.struct(F.concat(F.lit(" "), "title").alias("path")), F.struct(F.lit("a.py ").alias("path")))
    return fl.link_files(keyed(t).withColumn("entry", entry)).select("pos", "path", "link")


@query(KEYED + "SELECT pos, nullif(html_url, '') AS pages_url FROM k LEFT JOIN lens_pages p ON p.repo_key = k.repo_key", "papers", "pages")
def j9_attach_sites(t: Lens) -> DataFrame:
    return fl.attach_sites(keyed(t), t.pages).select("pos", "pages_url")


# ---- aggregates


@query(RESULTS + "SELECT s AS status, count(x.status) AS n FROM (SELECT unnest(['yes', 'no', 'skipped', 'error']) AS s) LEFT JOIN x ON x.status = s GROUP BY s", "papers", "answers")
def a1_count_statuses(t: Lens) -> DataFrame:
    return summary.count_statuses(results(t))


@query(RESULTS + "SELECT count(*) FILTER (WHERE status = 'yes') AS yes, count(*) AS total, count(*) FILTER (WHERE status = 'yes') / greatest(count(*), 1) * 100 AS pct FROM x", "papers", "answers")
def a2_coverage_pct(t: Lens) -> DataFrame:
    return summary.coverage_pct(results(t))


@query(RESULTS + "SELECT value, count(*) AS n FROM (SELECT unnest(types) AS value FROM x) GROUP BY value", "papers", "answers")
def a4_type_breakdown(t: Lens) -> DataFrame:
    return summary.type_breakdown(results(t), "example_types").select("value", "n")


@query(RESULTS + "SELECT CAST(coalesce(sum(coalesce(len(types), 0)), 0) AS BIGINT) AS entries, count(*) FILTER (WHERE status = 'yes') AS yes_repos, coalesce(sum(coalesce(len(types), 0)), 0) / greatest(count(*) FILTER (WHERE status = 'yes'), 1) AS average FROM x", "papers", "answers")
def a6_detail_totals(t: Lens) -> DataFrame:
    return summary.detail_totals(results(t), "example_types")




@query(f"SELECT repo_key, least(n, 100) > 0 AS recent, least(n, 100) AS n FROM (SELECT repo_key, count(*) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL {RECENT} DAY) AS n FROM lens_activity WHERE kind = 'commit' GROUP BY repo_key)", "activity")
def a7_recent_commits(t: Lens) -> DataFrame:
    return activity.recent_commits(activity_of(t, "commit"), AS_OF, RECENT).withColumn("n", F.col("n").cast("long"))


ISSUES = """i AS (SELECT repo_key, count(*) FILTER (WHERE comments > 0) AS hit, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY repo_key ORDER BY ts DESC, event_id DESC) AS r FROM lens_activity WHERE kind = 'issue') WHERE r <= 30 GROUP BY repo_key)"""


@query(ISSUES.replace("i AS", "x AS", 1) + " SELECT repo_key, hit > 0 AS responded, hit || '/' || n || ' issues have responses' AS detail FROM x", "activity")
def a8_issue_responses(t: Lens) -> DataFrame:
    return activity.issue_responses(activity_of(t, "issue"))


@query("SELECT repo_key, least(count(DISTINCT actor), 100) > 1 AS several, least(count(DISTINCT actor), 100) AS n FROM lens_activity WHERE kind = 'contributor' GROUP BY repo_key", "activity")
def a9_multi_contributors(t: Lens) -> DataFrame:
    return activity.multi_contributors(activity_of(t, "contributor")).withColumn("n", F.col("n").cast("long"))


RELEASES = r"""r AS (SELECT repo_key, kind, arg_min(tag_name, r) FILTER (WHERE ok) AS tag, count(*) FILTER (WHERE ok) AS k FROM (SELECT *, row_number() OVER (PARTITION BY repo_key, kind ORDER BY ts DESC, event_id DESC) AS r, regexp_matches(tag_name, '^v?\d+\.\d+') AS ok FROM lens_activity WHERE kind IN ('release', 'tag')) WHERE r <= 10 GROUP BY repo_key, kind),
s AS (SELECT repo_key, coalesce(max(tag || ' (' || k || ' semver releases)') FILTER (WHERE kind = 'release'), max(tag || ' (' || k || ' semver tags)') FILTER (WHERE kind = 'tag')) AS d FROM r GROUP BY repo_key)
"""


@query(RELEASES.replace("r AS", "x AS", 1).replace("FROM r GROUP", "FROM x GROUP") + "SELECT repo_key, d IS NOT NULL AS versioned, coalesce(d, 'None') AS detail FROM s", "activity")
def a10_versioned_releases(t: Lens) -> DataFrame:
    return activity.versioned_releases(activity_of(t, "release"), activity_of(t, "tag"))


BOARD = f"""x AS (SELECT repo_key, count(*) FILTER (WHERE kind = 'commit') AS c, count(*) FILTER (WHERE kind = 'commit' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL {RECENT} DAY) AS late, max(ts) FILTER (WHERE kind = 'commit') AS head,
 count(DISTINCT actor) FILTER (WHERE kind = 'contributor') AS actors, count(*) FILTER (WHERE kind IN ('release', 'tag')) AS named, max(ts) FILTER (WHERE kind = 'release') AS released FROM lens_activity GROUP BY repo_key),
""" + ISSUES + ", " + RELEASES


@query(BOARD + """SELECT x.repo_key, CASE WHEN c > 0 THEN late > 0 END AS recent, CASE WHEN c > 0 THEN least(late, 100) END AS n_commits, hit > 0 AS responded, hit || '/' || i.n || ' issues have responses' AS issue_detail,
 CASE WHEN actors > 0 THEN least(actors, 100) > 1 END AS several, CASE WHEN actors > 0 THEN least(actors, 100) END AS n_contributors, CASE WHEN named > 0 THEN d IS NOT NULL END AS versioned, CASE WHEN named > 0 THEN coalesce(d, 'None') END AS release_detail,
 strftime(released, '%Y-%m-%d %H:%M:%S') AS released, strftime(head, '%Y-%m-%d') AS last_commit_date, CASE WHEN c > 0 THEN c END AS total_commits FROM x LEFT JOIN i ON i.repo_key = x.repo_key LEFT JOIN s ON s.repo_key = x.repo_key""", "activity")
def a7_a12_scoreboard(t: Lens) -> DataFrame:
    """All indicators by one scan, against each by its own SQL."""
    out = activity.scoreboard(t.activity, AS_OF, RECENT)
    return out.withColumns({"released": F.date_format("released", "yyyy-MM-dd HH:mm:ss"), "n_commits": F.col("n_commits").cast("long"), "n_contributors": F.col("n_contributors").cast("long")})


LAST = f"""l AS (SELECT m.repo_key, greatest(CAST(pushed_at AS TIMESTAMP), d) AS last FROM lens_meta m LEFT JOIN (SELECT repo_key, max(ts) AS d FROM lens_activity WHERE kind = 'release' GROUP BY repo_key) a ON a.repo_key = m.repo_key)"""
STALE_SQL = f"last < TIMESTAMP '{AS_OF}' - INTERVAL {STALE} DAY"


@query(LAST.replace("l AS", "x AS", 1) + f" SELECT repo_key, strftime(last, '%Y-%m-%d') AS last, {STALE_SQL} AS stale FROM x", "meta", "activity")
def a11_last_activity(t: Lens) -> DataFrame:
    return activity.last_activity(t.meta, activity_of(t, "release"), AS_OF, STALE).withColumn("last", F.date_format("last", "yyyy-MM-dd"))


@query("SELECT repo_key, strftime(max(ts), '%Y-%m-%d') AS last_commit_date, count(*) AS total_commits FROM lens_activity WHERE kind = 'commit' GROUP BY repo_key", "activity")
def a12_commit_totals(t: Lens) -> DataFrame:
    return activity.commit_totals(activity_of(t, "commit"))


@query(TRUTH + """, c AS (SELECT count(*) AS labelled, count(*) FILTER (WHERE status IN ('yes', 'no')) AS evaluated, count(*) FILTER (WHERE status = 'yes' AND truth) AS tp, count(*) FILTER (WHERE status = 'yes' AND NOT truth) AS fp,
 count(*) FILTER (WHERE status = 'no' AND NOT truth) AS tn, count(*) FILTER (WHERE status = 'no' AND truth) AS fn FROM z),
d AS (SELECT *, coalesce((tp + tn) / nullif(evaluated, 0), 0.0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM c)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM d""", "papers", "answers")
def a15_confusion_metrics(t: Lens) -> DataFrame:
    return summary.confusion_metrics(truths(t))


@query("SELECT model, count(*) AS requests, CAST(sum(prompt_tokens) AS BIGINT) AS prompt, CAST(sum(completion_tokens) AS BIGINT) AS completion, CAST(sum(CASE WHEN total_tokens > 0 THEN total_tokens ELSE prompt_tokens + completion_tokens END) AS BIGINT) AS total, count(*) FILTER (WHERE prompt_tokens IS NULL) AS without FROM lens_answers GROUP BY model", "answers")
def a16_token_usage(t: Lens) -> DataFrame:
    return summary.token_usage(t.answers)


AGREE = RESULTS + """, y AS (SELECT pos, coalesce(max(upper(status)) FILTER (WHERE model = 'model-a'), 'N/A') AS "model-a", coalesce(max(upper(status)) FILTER (WHERE model = 'model-b'), 'N/A') AS "model-b", coalesce(max(upper(status)) FILTER (WHERE model = 'model-c'), 'N/A') AS "model-c" FROM x GROUP BY pos),
z AS (SELECT *, "model-a" = "model-b" AND "model-b" = "model-c" AS agree FROM y)
"""


@query(AGREE + "SELECT * FROM z", "papers", "answers")
def a17_model_agreement(t: Lens) -> DataFrame:
    return summary.model_agreement(results(t), MODELS)




# ---- windows


@query("k AS (SELECT *, CASE WHEN u = '' THEN 1 ELSE row_number() OVER (PARTITION BY u ORDER BY pos) END AS r FROM (SELECT *, lower(regexp_replace(trim(coalesce(repo, '')), '/+$', '')) AS u FROM lens_papers)) SELECT pos, title, repo FROM k WHERE r = 1", "papers")
def w1_dedupe_first(t: Lens) -> DataFrame:
    return pp.dedupe_first(t.papers).select("pos", "title", "repo")


@query(VALID + "SELECT pos, coalesce(contains(repo, 'github.com') AND repo_key IS NOT NULL AND first < pos, false) AS duplicate FROM w", "papers")
def w2_mark_duplicates(t: Lens) -> DataFrame:
    return pp.mark_duplicates(keyed(t)).select("pos", "duplicate")


@query(FEATS + f", y AS (SELECT *, {PRE_BUCKET} AS bucket FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY repo_key, bucket ORDER BY depth, path_lower, seq) AS rank FROM y WHERE bucket IS NOT NULL) SELECT repo_key, path, bucket, rank FROM z WHERE rank <= CASE bucket WHEN 'generic' THEN 8 ELSE 12 END", "files")
def w3_top_n_per_bucket(t: Lens) -> DataFrame:
    return fl.preprocessing_candidates(t.files).select("repo_key", "path", "bucket", F.col("rank").cast("long").alias("rank"))


@query(FEATS + f", z AS (SELECT *, row_number() OVER (PARTITION BY repo_key ORDER BY CASE WHEN {_starts('path_lower', R.STRONG_DOC_FOLDERS)} THEN 0 ELSE 1 END, path_lower, seq) AS rank FROM x WHERE {API_BUCKET} = 'page') SELECT repo_key, path, rank FROM z WHERE rank <= 15", "files")
def w4_api_page_order(t: Lens) -> DataFrame:
    return fl.api_page_order(feats(t).where(paths.api_docs_bucket() == "page")).select("repo_key", "path", F.col("rank").cast("long").alias("rank"))


ROBIN = FEATS + f""", y AS (SELECT *, row_number() OVER (PARTITION BY repo_key, top ORDER BY path_lower, seq) AS round, min(seq) OVER (PARTITION BY repo_key, top) AS top_seq FROM x WHERE {API_BUCKET} = 'source'),
z AS (SELECT *, row_number() OVER (PARTITION BY repo_key ORDER BY round, top <> '', lower(top), top_seq) AS rank FROM y)
"""


@query(ROBIN + "SELECT repo_key, path, rank FROM z WHERE rank <= 20", "files")
def w5_round_robin_sample(t: Lens) -> DataFrame:
    return fl.round_robin_sample(feats(t).where(paths.api_docs_bucket() == "source"), 20).select("repo_key", "path", F.col("rank").cast("long").alias("rank"))


BUDGET = """x AS (SELECT repo_key, path, least(length(content), 700) AS want, coalesce(sum(least(length(content), 700)) OVER (PARTITION BY repo_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lens_files)
SELECT repo_key, path, CAST(least(want, greatest(5000 - before, 0)) AS BIGINT) AS take FROM x WHERE least(want, greatest(5000 - before, 0)) > 0"""


@query(BUDGET, "files")
def w6_char_budget(t: Lens) -> DataFrame:
    return fl.char_budget(t.files, 5000, F.lit(700), "seq").select("repo_key", "path", "take")


CASCADE = FEATS + f""", y AS (SELECT *, {PRE_BUCKET} AS bucket FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY repo_key, bucket ORDER BY depth, path_lower, seq) AS rank FROM y WHERE bucket IS NOT NULL),
q AS (SELECT *, CASE bucket WHEN 'named' THEN 0 WHEN 'folder' THEN 1 ELSE 2 END AS place, least(length(content), CASE bucket WHEN 'named' THEN 16000 ELSE 8000 END) AS want FROM z WHERE rank <= CASE bucket WHEN 'generic' THEN 8 ELSE 12 END AND length(content) > 0),
b AS (SELECT *, coalesce(sum(want) OVER (PARTITION BY repo_key ORDER BY place, depth, path_lower, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
c AS (SELECT *, least(want, greatest(80000 - before, 0)) AS take FROM b WHERE least(want, greatest(80000 - before, 0)) > 0)
"""


@query(_read(CASCADE) + "SELECT repo_key, path, CAST(take AS BIGINT) AS take FROM c", "files")
def w7_cascading_budget(t: Lens) -> DataFrame:
    return fl.cascading_budget(fl.attach_sizes(fl.preprocessing_candidates(t.files.drop("content")), t.files)).select("repo_key", "path", "take")


STAGED = FEATS + f""", y AS (SELECT *, {USAGE_BUCKET} AS bucket FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY repo_key, bucket ORDER BY depth, path_lower, seq) AS rank FROM y WHERE bucket IS NOT NULL),
q AS (SELECT * FROM z WHERE bucket = 'doc' OR rank <= CASE bucket WHEN 'notebook' THEN 20 ELSE 15 END),
d AS (SELECT *, least(length(content), greatest(400000 - coalesce(sum(length(content)) OVER (PARTITION BY repo_key ORDER BY CASE WHEN path_lower IN {_in(R.ROOT_README_NAMES)} THEN 0 WHEN NOT contains(path, '/') THEN 1 ELSE 2 END, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS take FROM q WHERE bucket = 'doc' AND length(content) > 0),
ds AS (SELECT repo_key, sum(take) AS doc_chars FROM d GROUP BY repo_key),
ns AS (SELECT n.repo_key, CASE WHEN coalesce(doc_chars, 0) < 400000 THEN least(8000, floor((400000 - coalesce(doc_chars, 0)) / books)) END AS share FROM (SELECT repo_key, count(*) AS books FROM q WHERE bucket = 'notebook' GROUP BY repo_key) n LEFT JOIN ds ON ds.repo_key = n.repo_key),
nb AS (SELECT q.*, least(length(content), share) AS take FROM q JOIN ns ON ns.repo_key = q.repo_key WHERE bucket = 'notebook' AND length(raw) > 0 AND share IS NOT NULL),
us AS (SELECT repo_key, sum(take) AS used FROM (SELECT repo_key, take FROM d UNION ALL SELECT repo_key, take FROM nb) GROUP BY repo_key),
sc AS (SELECT q.*, least(least(length(content), 4000), greatest(400000 - coalesce(used, 0) - coalesce(sum(least(length(content), 4000)) OVER (PARTITION BY q.repo_key ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) AS take FROM q LEFT JOIN us ON us.repo_key = q.repo_key WHERE bucket = 'script' AND length(content) > 0)
SELECT repo_key, path, bucket, CAST(take AS BIGINT) AS take FROM d WHERE take > 0 UNION ALL SELECT repo_key, path, bucket, CAST(take AS BIGINT) FROM nb UNION ALL SELECT repo_key, path, bucket, CAST(take AS BIGINT) FROM sc WHERE take > 0"""


@query(_read(STAGED, SHOWN), "files")
def w8_staged_budget(t: Lens) -> DataFrame:
    found = feats(t).drop("content").withColumn("bucket", paths.usage_bucket()).where("bucket is not null")
    chosen = fl.top_n_per_bucket(found, {"notebook": 20, "script": 15}, keep_others=True)
    return fl.staged_budget(fl.attach_sizes(chosen, t.files, "left", as_example=True)).select("repo_key", "path", "bucket", "take")


@query("SELECT repo_key, event_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY repo_key ORDER BY ts DESC, event_id DESC) AS r FROM lens_activity) WHERE r <= 5", "activity")
def w9_latest_n(t: Lens) -> DataFrame:
    return fl.latest_n(t.activity, 5, F.desc("ts"), F.desc("event_id")).select("repo_key", "event_id", F.col("rank").cast("long").alias("rank"))


@query(f"""SELECT source, array_to_string([x.v FOR x IN list_sort([{{'p': coalesce(nullif(list_position({list(R.DOC_TYPE_ORDER)}, v), 0), 99), 'v': v}} FOR v IN types])], ',') AS types, coalesce([x.v FOR x IN list_sort([{{'p': coalesce(nullif(list_position({list(R.TOOL_ORDER)}, v), 0), 99), 'v': v}} FOR v IN tools])][1], 'none') AS tool
 FROM (SELECT source, list(DISTINCT CASE doc_id % 4 WHEN 0 THEN 'other' WHEN 1 THEN 'sphinx docs' WHEN 2 THEN 'python docstrings' ELSE lang END) AS types, list(DISTINCT CASE doc_id % 5 WHEN 0 THEN 'pdoc' WHEN 1 THEN 'MkDocs' ELSE 'OpenAPI' END) AS tools FROM documents GROUP BY source)""")
def w10_ordered_doc_types(t: Lens) -> DataFrame:
    kind = F.when(F.col("doc_id") % 4 == 0, "other").when(F.col("doc_id") % 4 == 1, "sphinx docs").when(F.col("doc_id") % 4 == 2, "python docstrings").otherwise(F.col("lang"))
    tool = F.when(F.col("doc_id") % 5 == 0, "pdoc").when(F.col("doc_id") % 5 == 1, "MkDocs").otherwise("OpenAPI")
    sets = t.table("documents").groupBy("source").agg(F.collect_set(kind).alias("types"), F.collect_set(tool).alias("tools"))
    return sets.select("source", F.array_join(summary.ordered_doc_types(F.col("types")), ",").alias("types"), summary.primary_tool(F.col("tools")).alias("tool"))


LISTED = "x AS (SELECT DISTINCT repo_key, path, CASE WHEN seq % 2 = 0 THEN 'a' ELSE 'b' END AS type FROM lens_files) "


def _entries_twice(t: Lens) -> DataFrame:
    entries = t.files.select("repo_key", "path", F.when(F.col("seq") % 2 == 0, "a").otherwise("b").alias("type"))
    return entries.unionByName(entries)


@query(LISTED + """, p AS (SELECT repo_key, coalesce(array_to_string(list(path ORDER BY lower(path) NULLS LAST, type, path)[1:3], ', '), '') AS preview FROM x GROUP BY repo_key)
SELECT x.repo_key, path, type, row_number() OVER (PARTITION BY x.repo_key ORDER BY lower(path) NULLS LAST, type, path) AS place, preview FROM x JOIN p ON p.repo_key IS NOT DISTINCT FROM x.repo_key""", "files")
def w11_doc_file_list(t: Lens) -> DataFrame:
    return summary.doc_file_list(_entries_twice(t))


@query(LISTED + "SELECT repo_key, count(*) AS n_doc_files, array_to_string(list(path ORDER BY lower(path), type, path)[1:3], ', ') AS preview FROM x GROUP BY repo_key", "files")
def w11_doc_file_preview(t: Lens) -> DataFrame:
    return summary.doc_file_preview(_entries_twice(t))


# ---- set operations


@query(FEATS + f", z AS (SELECT *, CASE WHEN {USAGE_BUCKET} = 'notebook' THEN 0 ELSE 1 END AS k FROM x WHERE {USAGE_BUCKET} IN ('notebook', 'script')) SELECT repo_key, path, CASE WHEN k = 0 THEN 'notebook' ELSE 'script' END AS kind, row_number() OVER (PARTITION BY repo_key ORDER BY k, depth, path_lower, seq) AS place FROM z", "files")
def u2_example_meta(t: Lens) -> DataFrame:
    return fl.example_meta(t.files).withColumn("place", F.col("place").cast("long"))


# ---- text rules

SECTIONS = r"""x AS (SELECT repo_key, path, string_split(chr(10) || content, chr(10)) AS lines FROM lens_files WHERE starts_with(split_part(lower(path), '/', -1), 'readme')),
y AS (SELECT repo_key, path, l.i AS i, l.s AS s FROM x, unnest([{'i': i, 's': lines[i]} FOR i IN range(1, len(lines) + 1)]) AS t(l)),
h AS (SELECT *, regexp_extract(s, '^(#{1,4})[ \t]+(.+)$', 2) AS heading, sum(CASE WHEN regexp_matches(s, '^(#{1,4})[ \t]+(.+)$') THEN 1 ELSE 0 END) OVER (PARTITION BY repo_key, path ORDER BY i) AS n FROM y),
z AS (SELECT repo_key, path, n - 1 AS idx, trim(max(heading)) AS heading, trim(string_agg(CASE WHEN heading = '' THEN s END, chr(10) ORDER BY i), ' ' || chr(10)) AS content FROM h WHERE n > 0 GROUP BY repo_key, path, n
 UNION ALL SELECT repo_key, path, 0, '', string_agg(s, chr(10) ORDER BY i)[2:] FROM h GROUP BY repo_key, path HAVING max(n) = 0)
"""


def _readmes(t: Lens) -> DataFrame:
    return t.files.where(F.substring_index(F.lower("path"), "/", -1).startswith("readme"))


@query(SECTIONS + "SELECT repo_key, path, CAST(idx AS BIGINT) AS idx, heading, coalesce(content, '') AS content FROM z", "files")
def f1_split_sections(t: Lens) -> DataFrame:
    one = _readmes(t).select("repo_key", "path", F.explode(T.split_sections(F.col("content"))).alias("s"))
    return one.select("repo_key", "path", F.col("s.idx").cast("long").alias("idx"), "s.heading", "s.content")


COMMANDS = "CASE " + " ".join(f"WHEN regexp_matches(lower(content), {_re(p)}) THEN {i}" for i, p in enumerate(R.INSTALL_COMMANDS)) + " END"
SNIPPET = "CASE " + " ".join(f"WHEN regexp_matches(lower(content), {_re(p)}) THEN trim(replace(substr(content, greatest(instr(lower(content), regexp_extract(lower(content), {_re(p)})) - 21, 0) + 1, instr(lower(content), regexp_extract(lower(content), {_re(p)})) - 1 + length(regexp_extract(lower(content), {_re(p)})) + 60 - greatest(instr(lower(content), regexp_extract(lower(content), {_re(p)})) - 21, 0)), chr(10), ' '))" for p in R.INSTALL_COMMANDS) + " END"


@query(f"SELECT repo_key, path, {SNIPPET} AS hit FROM lens_files", "files")
def f2_install_command_hit(t: Lens) -> DataFrame:
    return t.files.select("repo_key", "path", T.install_command_hit(F.col("content")).alias("hit"))


TIER = rf"""CASE WHEN length(content) >= 10 AND {_holds('lower(content)', R.SETUP_WORDS)} THEN CASE WHEN {_holds('c', R.STRONG_HEADINGS)} THEN 'strong' WHEN {_holds('c', R.PARTIAL_HEADINGS)} THEN 'partial' END END"""


@query(SECTIONS + rf", w AS (SELECT *, lower(trim(regexp_replace(heading, '[^\w\s]', '', 'g'))) AS c FROM z) SELECT repo_key, path, CAST(idx AS BIGINT) AS idx, {TIER} AS tier FROM w", "files")
def f3_heading_tiers(t: Lens) -> DataFrame:
    return jobs._sections(_readmes(t)).select("repo_key", "path", F.col("idx").cast("long").alias("idx"), "tier")


CLASSIFIED = SECTIONS + rf""", w AS (SELECT *, lower(trim(regexp_replace(heading, '[^\w\s]', '', 'g'))) AS c FROM z),
s AS (SELECT repo_key, path, arg_min('[heading: ' || heading || '] ' || replace(content[1:100], chr(10), ' '), idx) AS sn FROM w WHERE {TIER} = 'strong' GROUP BY repo_key, path),
r AS (SELECT repo_key, path, seq, {SNIPPET} AS hit FROM lens_files WHERE starts_with(split_part(lower(path), '/', -1), 'readme')),
q AS (SELECT r.repo_key, r.path, r.seq, CASE WHEN hit IS NOT NULL THEN '[command] ...' || hit || '...' ELSE sn END AS snippet, CAST(CASE WHEN hit IS NOT NULL THEN 1 ELSE 2 END AS BIGINT) AS tier FROM r LEFT JOIN s ON s.repo_key = r.repo_key AND s.path = r.path WHERE hit IS NOT NULL OR sn IS NOT NULL)
"""


@query(CLASSIFIED + "SELECT repo_key, path, 'installation guide' AS label, 1.0::DOUBLE AS confidence, snippet, tier FROM q", "files")
def f4_classify_install(t: Lens) -> DataFrame:
    return jobs.classify_install(_readmes(t)).withColumn("tier", F.col("tier").cast("long"))


INPUT = "CASE WHEN heading <> '' THEN heading || ': ' ELSE '' END || substr(trim(regexp_replace(coalesce(content, ''), '[#*`>\\[\\]!]', '', 'g'), ' ' || chr(10) || chr(9) || chr(13)), 1, 1500)"


@query(CLASSIFIED + f"SELECT w.repo_key, w.path, CAST(idx AS BIGINT) AS idx, CASE WHEN {TIER} = 'partial' THEN 'partial' ELSE 'any' END AS kind, {INPUT} AS model_input FROM w ANTI JOIN q ON q.repo_key = w.repo_key AND q.path = w.path WHERE coalesce({TIER} = 'partial', false) OR length(content) >= 50", "files")
def f4_install_candidates(t: Lens) -> DataFrame:
    return jobs.install_candidates(_readmes(t)).withColumn("idx", F.col("idx").cast("long"))


#: Scores as a model might give them, from the section's place and length, the same in both engines.
SCORE, LABEL = "(length(coalesce(content, '')) * 7 + idx * 3) % 100 / 100.0", f"CASE WHEN length(coalesce(content, '')) % 4 = 0 THEN 'other' ELSE '{R.SETUP_LABELS[1]}' END"
SCORED = CLASSIFIED + f""", o AS (SELECT *, coalesce({TIER}, '') AS tier, CAST({SCORE} AS DOUBLE) AS score, {LABEL} AS label FROM w),
m AS (SELECT repo_key, path, 2 AS tier, idx, label, score, '[heading: ' || heading || '] ' || replace(content[1:100], chr(10), ' ') AS snippet FROM o WHERE tier = 'partial' AND score >= 0.7 AND label <> 'other'
 UNION ALL SELECT repo_key, path, 2, idx, '{R.SETUP_LABELS[1]}', 1.0, '[heading: ' || heading || '] ' || replace(content[1:100], chr(10), ' ') FROM o WHERE tier = 'strong'
 UNION ALL SELECT repo_key, path, 4, idx, label, score, '[NLP only: ' || CASE WHEN heading = '' THEN 'no heading' ELSE heading END || '] ' || replace(content[1:100], chr(10), ' ') FROM o WHERE length(content) >= 50 AND score >= 0.85 AND label <> 'other'
 UNION ALL SELECT repo_key, path, 1, -1, '{R.SETUP_LABELS[1]}', 1.0, snippet FROM q WHERE tier = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY repo_key, path ORDER BY tier, idx) AS k FROM m)
"""


@query(SCORED + "SELECT repo_key, path, label, CAST(score AS DOUBLE) AS confidence, snippet, CAST(tier AS BIGINT) AS tier FROM n WHERE k = 1", "files")
def f4_scored_install(t: Lens) -> DataFrame:
    section = jobs._sections(_readmes(t))
    scores = section.select("repo_key", "path", "idx", F.expr(LABEL).alias("label"), F.expr(SCORE).cast("double").alias("score"))
    return jobs.classify_install(_readmes(t), scores).withColumn("tier", F.col("tier").cast("long"))


REPORT = CLASSIFIED + r""", n AS (SELECT repo_key, string_agg(CASE WHEN contains(path, '/') THEN path ELSE 'README' END || ' (installation guide, confidence: 100%) — ' || snippet, ' | ' ORDER BY contains(path, '/'), seq) AS a FROM q GROUP BY repo_key)
SELECT f.repo_key, CASE WHEN a IS NOT NULL THEN 'Yes: ' || a WHEN h THEN 'No' ELSE 'No README found' END AS report FROM (SELECT repo_key, bool_or(starts_with(split_part(lower(path), '/', -1), 'readme')) AS h FROM lens_files GROUP BY repo_key) f LEFT JOIN n ON n.repo_key = f.repo_key"""


@query(REPORT, "files")
def f5_install_report(t: Lens) -> DataFrame:
    return jobs.audit_install(t.files, t.files, all_readmes=True)


TOOL_NAME = "CASE " + " ".join(f"WHEN basename IN {_in(n)} THEN '{tool}:{kind}:{entry}'" for n, (tool, kind, entry) in R.DOC_TOOL_NAMES.items()) + f" WHEN path_lower IN {_in(R.SPHINX_PATHS)} THEN 'Sphinx:sphinx docs:generated_docs_config' END"
TOOL_CONTENT = "CASE " + " ".join(f"WHEN path_lower LIKE '%pyproject.toml' AND regexp_matches(content, {_re(p)}) THEN '{tool}:{kind}:generated_docs_config'" for p, tool, kind in R.PYPROJECT_TOOLS) + f" WHEN (path_lower LIKE '%conf.py' OR path_lower LIKE '%index.rst') AND (regexp_matches(content, {_re(R.AUTODOC)}) OR contains(lower(content), 'sphinx')) THEN 'Sphinx:' || CASE WHEN contains(content, 'myst_parser') OR contains(content, 'myst_nb') THEN 'sphinx docs (myst)' ELSE 'sphinx docs' END || ':generated_docs_config' END"


def _tool_text(t) -> object:
    return F.when(t.isNotNull(), F.concat_ws(":", t["tool"], t["doc_type"], t["entry_type"]))


@query(FEATS + f"SELECT repo_key, path, {TOOL_NAME} AS tool FROM x", "files")
def f6_doc_tool_by_name(t: Lens) -> DataFrame:
    return feats(t).select("repo_key", "path", _tool_text(T.doc_tool_by_name(F.col("path_lower"), F.col("basename"))).alias("tool"))


@query(FEATS + f"SELECT repo_key, path, {TOOL_CONTENT} AS tool FROM x", "files")
def f7_doc_tool_by_content(t: Lens) -> DataFrame:
    return feats(t).select("repo_key", "path", _tool_text(T.doc_tool_by_content(F.col("path_lower"), F.col("content"))).alias("tool"))


PAGE = rf"""(length(content) > 0 AND ({_starts('path_lower', R.STRONG_DOC_FOLDERS)} OR CAST(regexp_matches(content, {_re(R.DOC_VOCABULARY)}) AS INT) + CAST(regexp_matches(content, {_re(R.DOC_HEADING)}) AS INT) + 2 * CAST(regexp_matches(content, {_re(R.AUTODOC)}) OR regexp_matches(content, {_re(R.MYST_AUTODOC)}) AS INT)
 + CAST((path_lower LIKE '%.html' OR path_lower LIKE '%.htm') AND regexp_matches(content, {_re(R.HTML_INDEX)}) AS INT) >= 2))"""


@query(FEATS + f"SELECT repo_key, path, {PAGE} AS page FROM x", "files")
def f8_doc_page_evidence(t: Lens) -> DataFrame:
    return feats(t).select("repo_key", "path", T.doc_page_evidence(F.col("path_lower"), F.col("content")).alias("page"))


def _count(p: str) -> str:
    return f"len(regexp_extract_all(content, {_re(p)}))"


COMMENTS = f"""CASE WHEN ext = '.cs' AND {_count(R.CSHARP_DOC)} > 0 THEN 'c# xml docs:' || {_count(R.CSHARP_DOC)} || ':true' WHEN ext = '.rs' AND {_count(R.RUST_DOC)} >= 2 THEN 'rust doc comments:' || {_count(R.RUST_DOC)} || ':true'
 WHEN ext IN {_in(R.JVM_EXTS)} AND b + d > 0 THEN 'java javadoc:' || CASE WHEN b > 0 THEN b ELSE d END || ':true' WHEN ext IN {_in(R.SCRIPT_DOC_EXTS)} AND b + d > 0 THEN 'jsdoc/typedoc:' || CASE WHEN b > 0 THEN b ELSE d END || ':true'
 WHEN ext IN {_in(R.C_EXTS)} AND b + {_count(R.DOXYGEN_LINE)} > 0 THEN 'c++ doxygen comments:' || (b + {_count(R.DOXYGEN_LINE)}) || ':' || (b > 0) END"""


@query(FEATS + f", y AS (SELECT *, {_count(R.STRUCTURED_BLOCK)} AS b, {_count(R.DECLARED_BLOCK)} AS d FROM x WHERE ext <> '.go' AND ext <> '.py') SELECT repo_key, path, {COMMENTS} AS found FROM y", "files")
def f9_structured_comments(t: Lens) -> DataFrame:
    """All languages but Go, whose rule refers back to a name, which the other engine cannot: see f9_go_comments."""
    c = T.structured_comments(F.col("ext"), F.col("content"))
    said = F.when(c.isNotNull(), F.concat_ws(":", c["doc_type"], c["n"].cast("string"), c["strong"].cast("string")))
    return feats(t).where("ext != '.go' and ext != '.py'").select("repo_key", "path", said.alias("found"))


#: The rule refers back to a name, which the other engine's patterns can't: the lens has one Go text, whose count is known.
GO = "starts_with(content, '// Run starts it' || chr(10) || 'func Run()')"


@query(FEATS + f"SELECT repo_key, path, CASE WHEN {GO} THEN 1 END AS n FROM x WHERE ext = '.go'", "files")
def f9_go_comments(t: Lens) -> DataFrame:
    c = T.structured_comments(F.col("ext"), F.col("content"))
    return feats(t).where("ext = '.go'").select("repo_key", "path", c["n"].alias("n"))


@query(PACKAGES + "SELECT repo_key, package FROM x WHERE package IS NOT NULL", "files")
def f10_package_name(t: Lens) -> DataFrame:
    return packages(t)


REASON = "CASE WHEN archived THEN 'Repository is archived' " + " ".join(f"WHEN contains(lower(description), '{w}') THEN 'Description contains ''{w}'''" for w in R.DEPRECATION_WORDS) + " END"


@query(f"SELECT repo_key, {REASON} AS reason FROM lens_meta", "meta")
def f11_deprecation_reason(t: Lens) -> DataFrame:
    return t.meta.select("repo_key", T.deprecation_reason(F.col("archived"), F.col("description")).alias("reason"))


@query(r"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id END AS pages FROM documents")
def f13_last_page(t: Lens) -> DataFrame:
    link = F.concat(F.lit("<https://h/x?per_page=1&page=2>; rel=\"next\", <https://h/x?per_page=1&page="), F.col("doc_id").cast("string"), F.lit(">; rel=\"last\""))
    docs = t.table("documents").withColumn("link", F.when(F.col("doc_id") % 3 != 0, link))
    return docs.select("doc_id", T.last_page(F.col("link"), F.lit(1)).alias("pages"))


@query(RESULTS + """SELECT pos, model, array_to_string(types, ',') AS types, CASE WHEN said IN ('', 'null') THEN NULL ELSE said IN ('true', '"false"', '"0"', '-1', '[false]') END AS answer FROM x WHERE types IS NOT NULL""", "papers", "answers")
def f14_parse_answer(t: Lens) -> DataFrame:
    a = A.parse_answer(F.col("raw"), ANSWER_FIELDS, ("example_types", "example_files"))
    return t.answers.select("pos", "model", a.alias("a")).where("a.parsed").select("pos", "model", F.array_join("a.example_types", ",").alias("types"), F.col("a.has_usage_examples").alias("answer"))


@query("""SELECT pos, model, 'Parsing failed: ' || raw AS evidence FROM lens_answers WHERE contains(raw, '{"has": tru') AND NOT contains(raw, 'usage') OR contains(raw, 'and so on')""", "answers")
def f14_broken_answers(t: Lens) -> DataFrame:
    a = A.parse_answer(F.col("raw"), ANSWER_FIELDS)
    return t.answers.select("pos", "model", a.alias("a")).where("not a.parsed and a.evidence is not null").select("pos", "model", "a.evidence")


@query(RESULTS + "SELECT pos, model, status FROM x", "papers", "answers")
def f15_verdict(t: Lens) -> DataFrame:
    return results(t).select("pos", "model", "status")


TWO = """x AS (SELECT doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN 'EXISTS' ELSE 'NOT_APPLICABLE' END AS c1, CASE WHEN doc_id % 4 = 0 THEN 'EXISTS' ELSE 'NOT_APPLICABLE' END AS c2, doc_id % 5 < 2 AS named FROM documents)
SELECT pos, CASE WHEN c1 = 'NOT_APPLICABLE' AND named AND c2 = 'EXISTS' THEN c2 ELSE c1 END AS class FROM x"""


@query("WITH " + TWO)
def f16_two_pass_verdict(t: Lens) -> DataFrame:
    docs = t.table("documents").select(F.col("doc_id").cast("string").alias("repo_key"), F.lit("m").alias("model"), "doc_id")
    said = lambda n: docs.withColumn("class", F.when(F.col("doc_id") % n == 0, "EXISTS").otherwise("NOT_APPLICABLE"))
    _, final = jobs.two_pass(said(3), said(4), docs.where("doc_id % 5 < 2"))
    return final.select(F.col("doc_id").alias("pos"), "class")


@query(f"SELECT pos, CASE WHEN lower(trim(ground_truth)) IN {_in(R.POSITIVE_LABELS)} THEN true WHEN lower(trim(ground_truth)) IN {_in(R.NEGATIVE_LABELS)} THEN false END AS truth FROM lens_papers", "papers")
def f17_truth_label(t: Lens) -> DataFrame:
    return t.papers.select("pos", A.truth_label(F.col("ground_truth")).alias("truth"))


@query("SELECT doc_id, 'a.py|' || lang || '|' || source || ',b.py||' AS entries FROM documents")
def f18_normalise_entries(t: Lens) -> DataFrame:
    json = F.concat(F.lit('[{"path": " a.py ", "category": "'), F.upper("lang"), F.lit('", "evidence": "'), F.col("source"), F.lit('"}, "b.py", {"path": ""}, ""]'))
    e = F.transform(A.normalise_entries(json), lambda x: F.concat_ws("|", x["path"], x["category"], x["evidence"]))
    return t.table("documents").select("doc_id", F.array_join(e, ",").alias("entries"))


@query(f"SELECT repo_key, CASE WHEN {REASON} IS NULL THEN 'No' ELSE 'Yes — ' || {REASON} END AS archived FROM lens_meta", "meta")
def f19_indicator_text(t: Lens) -> DataFrame:
    reason = T.deprecation_reason(F.col("archived"), F.col("description"))
    return t.meta.select("repo_key", A.indicator_text(reason.isNotNull(), reason).alias("archived"))


@query(KEYED + "SELECT pos, coalesce(CAST(stars AS VARCHAR), 'NOT STATED') AS stars, coalesce(CAST(forks AS VARCHAR), 'NOT STATED') AS forks FROM k LEFT JOIN lens_meta m ON m.repo_key = k.repo_key", "papers", "meta")
def f20_fill_display(t: Lens) -> DataFrame:
    return A.fill_display(pp.attach_meta(keyed(t), t.meta).select("pos", "stars", "forks"), "NOT STATED", "stars", "forks")


# ---- helpers


DOCUMENTED = r"""x AS (SELECT repo_key, path, seq % 3 AS k, regexp_replace(content, '["\\\\]', ' ', 'g') AS body FROM lens_files WHERE ends_with(lower(path), '.py')),
y AS (SELECT *, regexp_matches(body, '\S') AS said, regexp_matches(body, '(?i)(?:^|[^\w])(args?|parameters?|params?|returns?|yields?|raises?|attributes?)(?:[^\w]|$)') AS sections FROM x)
SELECT repo_key, path, CASE WHEN k = 1 OR body IS NULL THEN NULL WHEN k = 0 THEN 1 ELSE 0 END AS module, CASE WHEN k = 1 OR body IS NULL THEN NULL WHEN k = 0 THEN 1 ELSE 0 END AS class,
 CASE WHEN k = 1 OR body IS NULL THEN NULL WHEN k = 0 AND said THEN 1 ELSE 0 END AS function, CASE WHEN k = 1 OR body IS NULL THEN NULL WHEN k = 0 THEN 1 + CAST(said AND sections AS INT) ELSE 0 END AS param_like,
 CASE WHEN k = 1 OR body IS NULL THEN NULL WHEN k = 0 THEN 1 ELSE 0 END AS public_class_total, CASE WHEN k = 1 OR body IS NULL THEN NULL WHEN k = 0 THEN 1 ELSE 0 END AS public_function_total FROM y"""


@query(DOCUMENTED, "files")
def h1_python_docstrings(t: Lens) -> DataFrame:
    """Each text whole in Python files of three kinds: in a docstring, behind a line that does not parse, in comments."""
    text = F.regexp_replace("content", r'["\\]', " ")
    body = F.concat(F.lit('"""Module."""\n\nclass A:\n    """Args: x"""\n\n    def f(self):\n        """'), text, F.lit('"""\n\n\ndef _g():\n    pass\n'))
    kinds = F.when(F.col("seq") % 3 == 0, body).when(F.col("seq") % 3 == 1, F.concat(F.lit("def broken(:\n"), text)).otherwise(F.concat(F.lit("# "), F.regexp_replace(text, r"[\r\n]", "\n# ")))
    rows = feats(t).where("ext = '.py'").withColumn("content", kinds)
    return rows.select("repo_key", "path", parsers.python_docstrings(F.col("content")).alias("d")).select("repo_key", "path", "d.*")


@query(rf"""SELECT repo_key, path, CASE WHEN regexp_matches(content, '\S') THEN md5('# --- Cell 1 (code) ---' || chr(10) || content) ELSE 'raw' END AS flat,
 md5(CASE WHEN regexp_matches(content, '\S') THEN substr('[CODE]' || chr(10) || content || chr(10) || chr(10) || '[OUTPUT]' || chr(10) || 'out', 1, {R.NOTEBOOK_CAP}) ELSE '' END) AS short FROM lens_files""", "files")
def h2_notebooks(t: Lens) -> DataFrame:
    """Each text as a notebook's code, line by line, behind a cell of another kind and with two outputs, one of them long."""
    outputs = F.array(F.struct(F.array(F.lit("o"), F.lit("ut")).alias("text")), F.struct(F.array(F.lit("x" * R.OUTPUT_CAP)).alias("text")))
    cells = F.array(F.struct(F.lit("raw").alias("cell_type"), F.array(F.lit("r")).alias("source"), F.array().cast("array<struct<text:array<string>>>").alias("outputs")), F.struct(F.lit("code").alias("cell_type"), F.split("content", r"(?<=\n)").alias("source"), outputs.alias("outputs")))
    rows = t.files.withColumn("raw", F.to_json(F.struct(cells.alias("cells"))))
    flat = notebooks.flatten_notebook(F.col("raw"))
    return rows.select("repo_key", "path", F.when(flat == F.col("raw"), "raw").otherwise(F.md5(flat.cast("binary"))).alias("flat"), F.md5(notebooks.summarise_notebook(F.col("raw")).cast("binary")).alias("short"))


# ---- jobs


#: Python's counts are those of the two documented files of the lens; no other one has a docstring.
HITS = FEATS + f""", x1 AS (SELECT *, {API_BUCKET} AS bucket FROM x),
r1 AS (SELECT *, row_number() OVER (PARTITION BY repo_key, bucket ORDER BY CASE WHEN bucket = 'readme' THEN 0 ELSE depth END, path_lower, seq) AS place, row_number() OVER (PARTITION BY repo_key, bucket, top ORDER BY path_lower, seq) AS round, min(seq) OVER (PARTITION BY repo_key, bucket, top) AS top_seq FROM x1 WHERE bucket IS NOT NULL),
r2 AS (SELECT *, row_number() OVER (PARTITION BY repo_key, bucket ORDER BY round, top <> '', lower(top), top_seq) AS turn FROM r1 WHERE bucket <> 'source' OR round <= {R.MAX_API_SOURCES}),
r3 AS (SELECT * REPLACE (CASE WHEN length(content) > 0 THEN content END AS content) FROM r2 WHERE CASE bucket WHEN 'source' THEN turn <= {R.MAX_API_SOURCES} WHEN 'page' THEN place <= {R.MAX_DOC_PAGES} WHEN 'readme' THEN place <= 1 ELSE true END),
r4 AS (SELECT *, {_count(R.STRUCTURED_BLOCK)} AS b, {_count(R.DECLARED_BLOCK)} AS d, bucket = 'source' AND ext = '.py' AS py, CASE WHEN bucket = 'config' THEN coalesce({TOOL_CONTENT}, {TOOL_NAME}) END AS tt FROM r3),
r5 AS (SELECT *, bucket IN ('page', 'readme') AND {PAGE} AS page, CASE WHEN py AND starts_with(content, '\"\"\"Module') THEN 'docstring_function' WHEN py AND starts_with(content, 'class A:') THEN 'docstring_class' END AS pt,
 CASE WHEN bucket = 'source' AND NOT py THEN CASE WHEN ext = '.go' THEN CASE WHEN {GO} THEN 'go doc comments:1:true' END ELSE {COMMENTS} END END AS cc FROM r4),
hits AS (SELECT repo_key, path, bucket, CASE WHEN tt IS NOT NULL THEN split_part(tt, ':', 3) WHEN page THEN 'doc_page' WHEN pt IS NOT NULL THEN pt WHEN cc IS NOT NULL THEN 'other' END AS type,
 CASE WHEN tt IS NOT NULL THEN split_part(tt, ':', 2) WHEN page THEN 'other' WHEN pt IS NOT NULL THEN 'python docstrings' WHEN cc IS NOT NULL THEN split_part(cc, ':', 1) END AS doc_type, CASE WHEN tt IS NOT NULL THEN split_part(tt, ':', 1) END AS tool,
 CASE WHEN pt IS NOT NULL THEN true WHEN cc IS NOT NULL THEN split_part(cc, ':', 3) = 'true' END AS strong, CASE WHEN pt IS NOT NULL THEN 1 + CAST(pt = 'docstring_class' AS INT) END AS total, CASE WHEN pt IS NOT NULL THEN 1 END AS documented FROM r5 WHERE tt IS NOT NULL OR page OR pt IS NOT NULL OR cc IS NOT NULL),
each AS (SELECT repo_key, coalesce(bool_or(bucket = 'source' AND strong), false) OR count(*) FILTER (WHERE bucket = 'source') >= 2 AS enough, sum(total) AS total, sum(documented) AS documented FROM hits GROUP BY repo_key),
kept AS (SELECT hits.* FROM hits JOIN each ON each.repo_key = hits.repo_key WHERE bucket <> 'source' OR enough)
"""
API = HITS + ", " + KEYED + f""", ty AS (SELECT repo_key, string_agg(doc_type, ',' ORDER BY p, doc_type) AS documentation_types FROM (SELECT DISTINCT repo_key, doc_type, coalesce(nullif(list_position({list(R.DOC_TYPE_ORDER)}, doc_type), 0), 99) AS p FROM kept) GROUP BY repo_key),
tl AS (SELECT repo_key, (list(tool ORDER BY coalesce(nullif(list_position({list(R.TOOL_ORDER)}, tool), 0), 99), tool))[1] AS doc_tool FROM kept WHERE tool IS NOT NULL GROUP BY repo_key),
fs AS (SELECT repo_key, count(*) AS n_doc_files, array_to_string((list(path ORDER BY lower(path), type, path))[1:3], ', ') AS preview FROM (SELECT DISTINCT repo_key, path, type FROM kept) GROUP BY repo_key),
api AS (SELECT pos, CASE WHEN coalesce(repo, '') = '' OR NOT contains(repo, 'github.com') THEN 'skipped' WHEN k.repo_key IS NULL THEN 'error' WHEN preview IS NOT NULL THEN 'yes' ELSE 'no' END AS status,
 CASE WHEN coalesce(repo, '') = '' THEN 'No repo URL provided' WHEN NOT contains(repo, 'github.com') THEN 'Not a GitHub repo: ' || repo WHEN k.repo_key IS NULL THEN 'Could not parse GitHub repository URL: ' || repo ELSE '' END AS note,
 CASE WHEN each.repo_key IS NOT NULL THEN coalesce(documentation_types, '') END AS documentation_types, coalesce(doc_tool, 'none') AS doc_tool, preview, CASE WHEN each.repo_key IS NOT NULL THEN coalesce(n_doc_files, 0) END AS n_doc_files, CASE WHEN total > 0 THEN round_even(documented * 100 / total, 1) END AS coverage_percent, k.repo_key
 FROM k LEFT JOIN each ON each.repo_key = k.repo_key LEFT JOIN ty ON ty.repo_key = k.repo_key LEFT JOIN tl ON tl.repo_key = k.repo_key LEFT JOIN fs ON fs.repo_key = k.repo_key)
"""


@query(HITS + """SELECT repo_key, CAST(sum(total) AS BIGINT) AS total_public, CAST(sum(documented) AS BIGINT) AS documented_public, CAST(sum(CAST(type = 'docstring_function' AS INT)) AS BIGINT) AS high_quality, round_even(sum(documented) * 100 / sum(total), 1) AS coverage_percent FROM hits WHERE total IS NOT NULL GROUP BY repo_key""", "files")
def a13_api_coverage(t: Lens) -> DataFrame:
    """Of the evidence in Python files; of the lens's two documented ones, the function's docstring names its arguments."""
    return summary.api_coverage(_evidence(t).where("public_total is not null"))


@query(HITS + "SELECT repo_key, bool_or(strong) OR count(*) >= 2 AS enough, count(*) AS n FROM hits WHERE bucket = 'source' GROUP BY repo_key", "files")
def a14_source_evidence(t: Lens) -> DataFrame:
    return summary.source_evidence(_evidence(t).where("bucket = 'source'"))


def _evidence(t: Lens) -> DataFrame:
    return jobs.api_evidence(jobs.api_docs_candidates(t.files.drop("content")), t.files)


@query(HITS + "SELECT repo_key, path, type, doc_type, tool FROM kept", "files")
def u1_collect_evidence(t: Lens) -> DataFrame:
    return summary.collect_evidence(jobs.api_evidence(jobs.api_docs_candidates(t.files.drop("content")), t.files))


@query(HITS + "SELECT DISTINCT repo_key, path, type FROM kept", "files")
def b1_api_doc_files(t: Lens) -> DataFrame:
    return jobs.api_doc_files(t.files.drop("content"), t.files)


@query(API + "SELECT api.* EXCLUDE (repo_key), nullif(html_url, '') AS pages_url FROM api LEFT JOIN lens_pages p ON p.repo_key = api.repo_key", "papers", "files", "pages")
def b1_audit_api_docs(t: Lens) -> DataFrame:
    out = jobs.audit_api_docs(t.papers, t.files.drop("content"), t.files, t.pages)
    return out.select("pos", "status", "note", F.array_join("documentation_types", ",").alias("documentation_types"), "doc_tool", "preview", "n_doc_files", "coverage_percent", "pages_url")


ONE_README = CLASSIFIED + r""", o AS (SELECT repo_key, arg_min(path, seq) AS path FROM lens_files WHERE starts_with(lower(path), 'readme') GROUP BY repo_key)
SELECT f.repo_key, CASE WHEN o.path IS NULL THEN 'No README found' WHEN snippet IS NULL THEN 'No' ELSE 'Yes: README (installation guide, confidence: 100%) — ' || snippet END AS report
 FROM (SELECT DISTINCT repo_key FROM lens_files) f LEFT JOIN o ON o.repo_key = f.repo_key LEFT JOIN q ON q.repo_key = o.repo_key AND q.path = o.path"""


@query(ONE_README, "files")
def b2_audit_install(t: Lens) -> DataFrame:
    return jobs.audit_install(t.files, t.files)


@query(LICENSED + "SELECT *, CASE WHEN coalesce(repo, '') = '' THEN 'No repo URL provided' WHEN repo_key IS NULL THEN 'Not a GitHub repo URL' ELSE '' END AS note FROM w", "papers", "meta", "files")
def b3_audit_license(t: Lens) -> DataFrame:
    out = jobs.audit_license(t.papers, t.meta, t.files)
    return out.select("pos", "title", "repo", "repo_key", "license_name", "spdx_id", "license_path", "source", "note")


MAINTENANCE = KEYED + f""", {ISSUES}, {RELEASES}, {LAST},
c AS (SELECT repo_key, count(*) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL {RECENT} DAY) > 0 AS recent FROM lens_activity WHERE kind = 'commit' GROUP BY repo_key),
o AS (SELECT repo_key, count(DISTINCT actor) > 1 AS several FROM lens_activity WHERE kind = 'contributor' GROUP BY repo_key),
w AS (SELECT k.pos, m.repo_key IS NOT NULL AS reachable, CASE WHEN m.repo_key IS NOT NULL THEN coalesce({REASON}, '') END AS archived_reason, {STALE_SQL} AS stale,
 CASE WHEN m.repo_key IS NOT NULL THEN coalesce(recent, false) END AS recent, CASE WHEN m.repo_key IS NOT NULL THEN coalesce(hit > 0, false) END AS responded, CASE WHEN m.repo_key IS NOT NULL THEN coalesce(several, false) END AS several,
 CASE WHEN m.repo_key IS NOT NULL THEN coalesce(s.d IS NOT NULL, false) END AS versioned
 FROM k LEFT JOIN lens_meta m ON m.repo_key = k.repo_key LEFT JOIN i ON i.repo_key = k.repo_key LEFT JOIN s ON s.repo_key = k.repo_key LEFT JOIN l ON l.repo_key = k.repo_key LEFT JOIN c ON c.repo_key = k.repo_key LEFT JOIN o ON o.repo_key = k.repo_key),
q AS (SELECT *, CASE WHEN NOT reachable THEN 'NOT_ASSESSABLE' WHEN archived_reason <> '' THEN 'ARCHIVED' WHEN coalesce(stale, false) THEN 'STALE' WHEN CAST(recent AS INT) + CAST(responded AS INT) + CAST(several AS INT) + CAST(versioned AS INT) >= 3 THEN 'ACTIVE' WHEN recent OR responded OR several OR versioned THEN 'MINIMAL' ELSE 'INACTIVE' END AS overall FROM w)
"""


def _maintenance(t: Lens) -> DataFrame:
    return jobs.audit_maintenance(t.papers, t.meta, t.files.drop("content"), t.activity, AS_OF, RECENT, STALE)


@query(MAINTENANCE + "SELECT * FROM q", "papers", "meta", "activity")
def b4_audit_maintenance(t: Lens) -> DataFrame:
    return _maintenance(t).select("pos", "reachable", "archived_reason", "stale", "recent", "responded", "several", "versioned", "overall")


@query(MAINTENANCE + "SELECT pos, overall FROM q", "papers", "meta", "activity")
def f12_overall_status(t: Lens) -> DataFrame:
    return _maintenance(t).select("pos", "overall")


@query(MAINTENANCE + f"SELECT o AS overall, count(q.pos) AS n FROM (SELECT unnest({list(R.OVERALL)}) AS o) LEFT JOIN q ON q.overall = o GROUP BY o UNION ALL SELECT 'TOTAL', count(*) FROM q", "papers", "meta", "activity")
def a3_overall_counts(t: Lens) -> DataFrame:
    return summary.overall_counts(_maintenance(t)).select("overall", "n")


ADOPTION = KEYED + ", " + PACKAGES + """, w AS (SELECT pos, repo, k.repo_key, stars, forks, m.repo_key IS NOT NULL AS reachable, CASE WHEN m.repo_key IS NOT NULL THEN x.package END AS package FROM k LEFT JOIN lens_meta m ON m.repo_key = k.repo_key LEFT JOIN x ON x.repo_key = k.repo_key)
SELECT pos, stars, forks, w.package, last_month, CASE WHEN coalesce(repo, '') = '' THEN 'No repo URL provided' WHEN repo_key IS NULL THEN 'Not a GitHub repo URL' WHEN NOT reachable THEN 'GitHub API call failed (private repo, deleted, or rate-limited?)' WHEN w.package IS NOT NULL AND last_month IS NULL THEN 'Package ''' || w.package || ''' detected from repo but not found on PyPI / pypistats.' ELSE '' END AS note FROM w LEFT JOIN lens_downloads d ON d.package = w.package"""


@query(ADOPTION, "papers", "meta", "files", "downloads")
def b5_audit_adoption(t: Lens) -> DataFrame:
    return jobs.audit_adoption(t.papers, t.meta, t.files, t.downloads).select("pos", "stars", "forks", "package", "last_month", "note")


POST = KEYED + """, c AS (SELECT repo_key, strftime(max(ts), '%Y-%m-%d') AS d, count(*) AS n FROM lens_activity WHERE kind = 'commit' GROUP BY repo_key)
SELECT pos, title, repo, k.repo_key, CASE WHEN m.repo_key IS NOT NULL THEN d END AS last_commit_date, CASE WHEN m.repo_key IS NOT NULL THEN n END AS total_commits, CASE WHEN coalesce(repo, '') = '' THEN 'No repo URL provided' WHEN k.repo_key IS NULL THEN 'Not a GitHub repo URL'
 WHEN m.repo_key IS NULL THEN 'Repo unreachable (deleted, private, or API error)' WHEN n IS NULL THEN 'Repo exists but has no commits on its default branch' ELSE '' END AS note FROM k LEFT JOIN lens_meta m ON m.repo_key = k.repo_key LEFT JOIN c ON c.repo_key = k.repo_key"""


@query(POST, "papers", "meta", "activity")
def b6_audit_post_publication(t: Lens) -> DataFrame:
    return jobs.audit_post_publication(t.papers, t.meta, activity_of(t, "commit"))


@query(POST.replace("SELECT pos, title, repo, k.repo_key, CASE WHEN m.repo_key", "SELECT pos, CASE WHEN m.repo_key").split(", CASE WHEN coalesce(repo, '')")[0] + " FROM k LEFT JOIN lens_meta m ON m.repo_key = k.repo_key LEFT JOIN c ON c.repo_key = k.repo_key", "papers", "meta", "activity")
def b6_by_the_maintenance_scan(t: Lens) -> DataFrame:
    """What this check asks for, from the one scan of activity that the maintenance check makes."""
    return _maintenance(t).select("pos", "last_commit_date", "total_commits")


@query(_read(CASCADE) + """, p AS (SELECT repo_key, string_agg(path, '|' ORDER BY place, depth, path_lower, seq) AS paths, string_agg('### ' || CASE bucket WHEN 'named' THEN 'PREPROCESS-NAMED' WHEN 'folder' THEN 'PREPROCESS-FOLDER' ELSE 'GENERIC SOURCE' END || ': ' || path || chr(10) || content[1:take], chr(10) || chr(10) ORDER BY place, depth, path_lower, seq) AS p, count(*) AS n, sum(take) AS t FROM c GROUP BY repo_key)
SELECT r.repo_key, coalesce(p, '[No source code files found in the repository]') AS payload, coalesce(n, 0) AS n_files, CAST(coalesce(t, 0) AS BIGINT) AS n_chars, CAST(CASE WHEN length(p) > 50000 THEN 4000 ELSE 2500 END AS BIGINT) AS max_tokens, coalesce(paths, '') AS paths, total AS n_source
 FROM (SELECT DISTINCT repo_key FROM lens_files) r LEFT JOIN p ON p.repo_key = r.repo_key LEFT JOIN (SELECT repo_key, count(*) AS total FROM z GROUP BY repo_key) n ON n.repo_key = r.repo_key""", "files")
def b7_payloads_preprocessing(t: Lens) -> DataFrame:
    return _shown(t, "preprocessing")


def _shown(t: Lens, check: str) -> DataFrame:
    out = jobs.build_payloads(t.files.drop("content"), t.files, check)
    return out.withColumns({"max_tokens": F.col("max_tokens").cast("long"), "paths": F.array_join("paths", "|")})


def _blocks(order: str, low: int, high: int, nothing: str = "No relevant files") -> str:
    return f"""blocks AS (SELECT repo_key, string_agg(path, '|' ORDER BY {order}) AS paths, string_agg('### ' || label || ': ' || path || chr(10) || content[1:take], chr(10) || chr(10) ORDER BY {order}) AS p, count(*) AS n, sum(take) AS t FROM c GROUP BY repo_key)
SELECT r.repo_key, coalesce(p, '[{nothing} found in the repository]') AS payload, coalesce(n, 0) AS n_files, CAST(coalesce(t, 0) AS BIGINT) AS n_chars, CAST(CASE WHEN length(p) > 50000 THEN {high} ELSE {low} END AS BIGINT) AS max_tokens, coalesce(paths, '') AS paths, CAST(NULL AS BIGINT) AS n_source FROM (SELECT DISTINCT repo_key FROM lens_files) r LEFT JOIN blocks ON blocks.repo_key = r.repo_key"""


def _spent(source: str, order: str, budget: int, cap: str) -> str:
    """s and c: what each file of ``source`` gets of a budget that is spent in order."""
    return f"""s AS (SELECT *, least(length(content), {cap}) AS want, coalesce(sum(least(length(content), {cap})) OVER (PARTITION BY repo_key ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {source} WHERE length(content) > 0),
c AS (SELECT *, CAST(least(want, greatest({budget} - before, 0)) AS BIGINT) AS take FROM s WHERE least(want, greatest({budget} - before, 0)) > 0)"""


ROOT = f"CASE WHEN lower(path) IN {_in(R.ROOT_README_NAMES)} THEN 0 WHEN NOT contains(path, '/') THEN 1"
PAYLOAD_SQL = {
    "install": INSTALL + f", i AS (SELECT x.*, {ROOT} WHEN contains(lower(path), 'readme') THEN 3 ELSE 2 END AS first, 'FILE' AS label FROM x JOIN y ON x.repo_key = y.repo_key WHERE x.named OR (NOT any_named AND x.path = readme)), " + _spent("i", "first, seq", R.INSTALL_CHARS, "length(content)") + ", " + _blocks("first, seq", 1000, 1000),
    "usage": _read(FEATS, SHOWN) + f""", x1 AS (SELECT *, {USAGE_BUCKET} AS bucket FROM x), u1 AS (SELECT *, row_number() OVER (PARTITION BY repo_key, bucket ORDER BY depth, path_lower, seq) AS rank FROM x1 WHERE bucket IS NOT NULL),
u2 AS (SELECT *, CASE bucket WHEN 'doc' THEN 0 WHEN 'notebook' THEN 1 ELSE 2 END AS place, CASE WHEN bucket = 'doc' THEN {ROOT} ELSE 2 END ELSE rank END AS first, CASE WHEN length(raw) > 0 THEN length(content) END AS size FROM u1 WHERE bucket = 'doc' OR rank <= CASE bucket WHEN 'notebook' THEN {R.MAX_NOTEBOOKS} ELSE {R.MAX_SCRIPTS} END),
u3 AS (SELECT *, CASE WHEN bucket = 'doc' AND size IS NOT NULL THEN least(size, greatest({R.USAGE_CHARS} - coalesce(sum(CASE WHEN bucket = 'doc' THEN size END) OVER (PARTITION BY repo_key ORDER BY place, first, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)) END AS t_doc FROM u2),
u4 AS (SELECT *, coalesce(sum(t_doc) OVER (PARTITION BY repo_key), 0) AS docs, count(*) FILTER (WHERE bucket = 'notebook') OVER (PARTITION BY repo_key) AS books FROM u3),
u5 AS (SELECT *, CASE WHEN bucket = 'notebook' AND size IS NOT NULL THEN least(size, {R.NOTEBOOK_CAP}, CAST(floor(({R.USAGE_CHARS} - docs) / greatest(books, 1)) AS BIGINT)) END AS t_book, CASE WHEN bucket = 'script' AND size IS NOT NULL THEN least(size, {R.SCRIPT_CAP}) END AS want FROM u4),
u6 AS (SELECT *, docs + coalesce(sum(t_book) OVER (PARTITION BY repo_key), 0) AS used, coalesce(sum(want) OVER (PARTITION BY repo_key ORDER BY place, first, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u5),
u7 AS (SELECT *, CAST(CASE WHEN size IS NULL THEN NULL WHEN t_doc IS NOT NULL THEN t_doc WHEN t_book IS NOT NULL THEN t_book ELSE least(want, greatest({R.USAGE_CHARS} - used - before, 0)) END AS BIGINT) AS take, CASE WHEN bucket = 'doc' THEN 'FILE' ELSE upper(bucket) END AS label FROM u6),
c AS (SELECT * FROM u7 WHERE take > 0 OR (bucket = 'notebook' AND size IS NOT NULL AND docs < {R.USAGE_CHARS})), """ + _blocks("place, first, seq", 4000, 8000),
    "api_docs": _read(FEATS) + f""", x1 AS (SELECT *, CASE WHEN path_lower IN {_in(R.DOC_NAMES)} OR basename IN {_in(R.DOC_NAMES)} THEN 'config' WHEN {_starts('path_lower', R.DOC_FOLDERS)} THEN CASE WHEN ext IN {_in(R.DOC_EXTS)} THEN 'page' END WHEN {SOURCE} THEN 'source' END AS bucket FROM x),
r1 AS (SELECT *, row_number() OVER (PARTITION BY repo_key, bucket ORDER BY CASE WHEN {_starts('path_lower', R.STRONG_DOC_FOLDERS)} THEN 0 ELSE 1 END, path_lower, seq) AS nth, row_number() OVER (PARTITION BY repo_key, bucket, top ORDER BY path_lower, seq) AS round, min(seq) OVER (PARTITION BY repo_key, bucket, top) AS top_seq FROM x1 WHERE bucket IS NOT NULL),
r2 AS (SELECT *, row_number() OVER (PARTITION BY repo_key, bucket ORDER BY round, top <> '', lower(top), top_seq) AS turn FROM r1 WHERE bucket <> 'source' OR round <= {R.MAX_API_SOURCES}),
r3 AS (SELECT *, CASE bucket WHEN 'config' THEN 0 WHEN 'page' THEN 1 ELSE 2 END AS place, CASE bucket WHEN 'config' THEN {ROOT} ELSE 2 END WHEN 'page' THEN nth ELSE turn END AS first, CASE bucket WHEN 'source' THEN 'SOURCE FILE' WHEN 'page' THEN 'DOC PAGE' ELSE 'DOC CONFIG' END AS label FROM r2 WHERE CASE bucket WHEN 'source' THEN turn <= {R.MAX_API_SOURCES} WHEN 'page' THEN nth <= {R.MAX_DOC_PAGES} ELSE true END),
""" + _spent("r3", "place, first, seq", R.API_CHARS, f"CASE WHEN bucket = 'source' THEN {R.API_SOURCE_CAP} ELSE {R.API_DOC_CAP} END") + ", " + _blocks("place, first, seq", 3000, 6000),
    "comments": _read(FEATS) + f""", r1 AS (SELECT *, row_number() OVER (PARTITION BY repo_key ORDER BY depth, path_lower, seq) AS rank, 'SOURCE FILE' AS label FROM x WHERE ext IN {_in(R.COMMENT_SOURCE_EXTS)} AND NOT {_starts('path_lower', R.SKIP_FOLDERS)} AND basename NOT IN {_in(R.SKIP_NAMES)}),
r2 AS (SELECT * FROM r1 WHERE rank <= {R.MAX_COMMENT_SOURCES}), """ + _spent("r2", "rank", R.COMMENT_CHARS, str(R.COMMENT_CAP)) + ", " + _blocks("rank, seq", 2000, 4000, "No source code files"),
}


def _payload(check: str) -> None:
    def build(t: Lens) -> DataFrame:
        return _shown(t, check)

    build.__name__ = f"b7_payloads_{check}"
    query(PAYLOAD_SQL[check], "files")(build)


for _check in PAYLOAD_SQL:
    _payload(_check)


@query(RESULTS + "SELECT pos, model, title, repo, status, coalesce(array_to_string(types, ','), '') AS types FROM x", "papers", "answers")
def b8_judge_answers(t: Lens) -> DataFrame:
    return results(t).select("pos", "model", "title", "repo", "status", F.array_join("example_types", ",").alias("types"))


#: The answers' lens as answers to the other checks: what stands for what, in the order of replacement.
_ONE, _TWO = '"example_types": ["notebook"]', '"example_types": ["CLI usage", "notebook"]'
ANSWERS_AS = {
    "install": (("has_usage_examples", "has_installation_instructions"), ("example_types", "instruction_types"), ('"example_files": null', '"installation_file": "docs/INSTALL.md"')),
    "api_docs": (
        ("has_usage_examples", "has_api_documentation"),
        ("example_types", "documentation_types"),
        ('"example_files": null', '"doc_tool": "sphinx", "doc_files": [{"path": " docs/conf.py ", "type": "config", "description": "d"}, {"path": " "}, {"path": "b.md"}]'),
    ),
    "comments": (("has_usage_examples", "has_inline_comments"), ("example_types", "comment_types"), ('"example_files": null', '"files_with_comments": [{"path": "a.py", "description": "d"}, {"description": "e"}]')),
    "preprocessing": (
        ('"has_usage_examples": true', '"classification": "EXISTS"'),
        ('"has_usage_examples": false', '"classification": "NOT_APPLICABLE"'),
        ('"evidence": "e"', '"final_reason": "r", "diagnostic_notes": "d"'),
        (_ONE, '"preprocessing_files": ["a.py"]'),
        (_TWO, '"preprocessing_files": [{"path": " b.py", "category": "Tokenize", "evidence": "x"}, {"path": "", "category": "z"}, {"path": "c.py", "category": "clean", "evidence": "y"}]'),
    ),
}
JUDGED = {
    "install": RESULTS + """SELECT x.pos, x.model, x.status, coalesce(array_to_string(types, ','), '') AS types,
 CASE WHEN len(types) = 2 AND owner IS NOT NULL THEN 'https://github.com/' || owner || '/' || name || '/blob/HEAD/docs/INSTALL.md' ELSE '' END AS link FROM x JOIN k ON k.pos = x.pos""",
    "api_docs": RESULTS + """SELECT x.pos, x.model, x.status, coalesce(array_to_string(types, ','), '') AS types, CASE WHEN len(types) = 2 THEN 'sphinx' ELSE 'none' END AS doc_tool,
 CASE WHEN len(types) = 2 THEN 'docs/conf.py config d' || coalesce(' https://github.com/' || owner || '/' || name || '/blob/HEAD/docs/conf.py', '') || ', b.md other ' || coalesce(' https://github.com/' || owner || '/' || name || '/blob/HEAD/b.md', '') ELSE '' END AS files FROM x JOIN k ON k.pos = x.pos""",
    "preprocessing": RESULTS + """SELECT x.pos, x.model, CASE WHEN coalesce(x.repo, '') = '' OR owner IS NULL THEN 'skipped' WHEN coalesce(f.n, 0) = 0 THEN 'no' WHEN types IS NULL OR said NOT IN ('true', 'false') THEN 'error' WHEN said = 'true' THEN 'yes' ELSE 'no' END AS status,
 CASE WHEN coalesce(x.repo, '') = '' THEN 'No repo URL provided' WHEN owner IS NULL THEN 'Not a GitHub repo — manual review needed. URL: ' || x.repo WHEN coalesce(f.n, 0) = 0 THEN 'No source files retrievable from the repo' WHEN types IS NOT NULL AND said IN ('true', 'false') THEN 'r' ELSE 'Empty LLM response — content may be too large for this model' END AS note,
 CASE WHEN said = 'true' AND types IS NOT NULL THEN 'EXISTS' ELSE 'NOT_APPLICABLE' END AS class, CASE len(types) WHEN 2 THEN 'clean,tokenize' ELSE '' END AS categories,
 CASE len(types) WHEN 2 THEN 'x; y' WHEN 1 THEN 'd' ELSE '' END AS evidence, CASE len(types) WHEN 2 THEN 'b.py,c.py' WHEN 1 THEN 'a.py' ELSE '' END AS files,
 coalesce(f.paths, '') AS files_checked, coalesce(f.total, 0) AS total_source_files, CASE WHEN coalesce(f.total, 0) = 0 THEN '' ELSE CAST(round_even(100.0 * coalesce(f.n, 0) / f.total, 0) AS BIGINT) || '%' END AS coverage FROM x JOIN k ON k.pos = x.pos LEFT JOIN f ON f.repo_key = k.repo_key""",
}
#: How many files the comments' payload of a repository holds.
COMMENTED = PAYLOAD_SQL["comments"].split(", blocks AS")[0] + ", n AS (SELECT repo_key, count(*) AS n FROM c GROUP BY repo_key), "
JUDGED["comments"] = COMMENTED + KEYED.rstrip() + ", " + RESULTS.replace("x AS", "w AS", 1) + """SELECT w.pos, w.model, CASE WHEN status IN ('skipped', 'error') AND NOT (status = 'error' AND owner IS NOT NULL) THEN status WHEN n IS NULL THEN 'no' ELSE status END AS status,
 coalesce(array_to_string(types, ','), '') AS types, CASE WHEN len(types) = 2 THEN 'a.py d, e' ELSE '' END AS files FROM w JOIN k ON k.pos = w.pos LEFT JOIN n ON n.repo_key = k.repo_key"""
for _check in ("install", "api_docs"):
    JUDGED[_check] = KEYED.rstrip() + ", " + JUDGED[_check]
#: What the pre-processing payload of a repository read, of how many source files.
READ = """, g AS (SELECT repo_key, count(*) AS n, string_agg(path, '|' ORDER BY place, depth, path_lower, seq) AS paths FROM c GROUP BY repo_key),
f AS (SELECT t.repo_key, total, n, paths FROM (SELECT repo_key, count(*) AS total FROM z GROUP BY repo_key) t LEFT JOIN g ON g.repo_key = t.repo_key), """
JUDGED["preprocessing"] = _read(CASCADE).replace("x AS (SELECT *, CASE WHEN contains(basename", "xf AS (SELECT *, CASE WHEN contains(basename", 1).replace("AS bucket FROM x)", "AS bucket FROM xf)", 1).rstrip() + READ + KEYED.rstrip() + ", " + JUDGED["preprocessing"]


def _judged(check: str) -> None:
    said = lambda entries, *parts: F.array_join(F.transform(entries, lambda e: F.concat_ws(" ", *(e[p] for p in parts))), ", ")

    def build(t: Lens) -> DataFrame:
        raw = F.col("raw")
        for old, new in ANSWERS_AS[check]:
            raw = F.replace(raw, F.lit(old), F.lit(new))
        payloads = jobs.build_payloads(t.files.drop("content"), t.files, check) if check in ("comments", "preprocessing") else None
        out = jobs.judge_answers(t.answers.withColumn("raw", raw), t.papers, check, payloads)
        types = lambda c: F.array_join(c, ",").alias("types")
        if check == "install":
            return out.select("pos", "model", "status", types("instruction_types"), F.col("installation_link").alias("link"))
        if check == "api_docs":
            return out.select("pos", "model", "status", types("documentation_types"), "doc_tool", said("doc_files", "path", "type", "description", "link").alias("files"))
        if check == "comments":
            return out.select("pos", "model", "status", types("comment_types"), F.regexp_replace(said("files_with_comments", "path", "description"), ",  ", ", ").alias("files"))
        return out.select("pos", "model", "status", "note", "class", F.array_join("categories", ",").alias("categories"), "evidence", F.array_join("preprocessing_files.path", ",").alias("files"), F.array_join("files_checked", "|").alias("files_checked"), "total_source_files", "coverage")

    build.__name__ = f"b8_judge_{check}"
    query(JUDGED[check], "papers", "answers", *(["files"] if check in ("comments", "preprocessing") else []))(build)


for _check in JUDGED:
    _judged(_check)


def _files_of_answers(t: Lens) -> DataFrame:
    """Answers to the check of pre-processing, with the entries that each lists."""
    raw = F.col("raw")
    for old, new in ANSWERS_AS["preprocessing"]:
        raw = F.replace(raw, F.lit(old), F.lit(new))
    a = A.parse_answer(raw, {"preprocessing_files": "json"})
    return t.answers.select("pos", "model", a.alias("a")).where("a.parsed").select("pos", "model", A.normalise_entries(F.col("a.preprocessing_files")).alias("entries"))


@query(RESULTS + "SELECT pos, model, CASE len(types) WHEN 2 THEN 'clean,tokenize' ELSE '' END AS categories, CASE len(types) WHEN 2 THEN 'x; y' ELSE '' END AS evidence FROM x WHERE types IS NOT NULL", "papers", "answers")
def a18_categories_and_evidence(t: Lens) -> DataFrame:
    return _files_of_answers(t).select("pos", "model", F.array_join(summary.categories_of(F.col("entries")), ",").alias("categories"), summary.top_evidence(F.col("entries")).alias("evidence"))


@query(RESULTS + "SELECT pos, model, CASE len(types) WHEN 2 THEN 'b.py|tokenize|x,c.py|clean|y' ELSE 'a.py||' END AS entries FROM x WHERE types IS NOT NULL", "papers", "answers")
def f18_normalise_answers(t: Lens) -> DataFrame:
    said = F.transform("entries", lambda x: F.concat_ws("|", x["path"], x["category"], x["evidence"]))
    return _files_of_answers(t).select("pos", "model", F.array_join(said, ",").alias("entries"))


@query(_read(CASCADE).rstrip() + READ.rstrip(" ,\n") + " SELECT repo_key, CAST(round_even(100.0 * coalesce(n, 0) / total, 0) AS BIGINT) || '%' AS coverage FROM f", "files")
def a19_coverage_checked(t: Lens) -> DataFrame:
    read = jobs.build_payloads(t.files.drop("content"), t.files, "preprocessing").where("n_source > 0")
    return read.select("repo_key", summary.coverage_checked(F.col("n_files"), F.col("n_source")).alias("coverage"))


#: The first model's answers as the first reading, the second's as the second; repositories by paper, named where such files are listed.
TWO_READ = _read(CASCADE).replace("x AS (SELECT *, CASE WHEN contains(basename", "xf AS (SELECT *, CASE WHEN contains(basename", 1).replace("AS bucket FROM x)", "AS bucket FROM xf)", 1).rstrip() + ", " + KEYED.rstrip() + ", " + RESULTS + """, w AS (SELECT x.pos, k.repo_key, model, CASE WHEN said = 'true' THEN 'EXISTS' ELSE 'NOT_APPLICABLE' END AS class FROM x JOIN k ON k.pos = x.pos WHERE k.repo_key IS NOT NULL AND types IS NOT NULL)
SELECT a.pos, CASE WHEN a.class = 'NOT_APPLICABLE' AND b.class = 'EXISTS' AND a.repo_key IN (SELECT repo_key FROM z WHERE bucket = 'named') THEN 'EXISTS' ELSE a.class END AS class
 FROM (SELECT * FROM w WHERE model = 'model-a') a LEFT JOIN (SELECT * FROM w WHERE model = 'model-b') b ON b.pos = a.pos"""


@query(TWO_READ, "files", "papers", "answers")
def f16_two_pass_of_answers(t: Lens) -> DataFrame:
    said = _files_of_answers(t).select("pos", "model")
    raw = t.answers.select("pos", "model", F.when(F.col("raw").contains('"has_usage_examples": true'), "EXISTS").otherwise("NOT_APPLICABLE").alias("class"))
    rows = raw.join(said, ["pos", "model"]).join(keyed(t).select("pos", F.col("repo_key").alias("repo")), "pos").where("repo is not null").withColumn("repo_key", F.concat_ws(" ", "repo", "pos"))
    named = fl.preprocessing_candidates(t.files.drop("content")).where("bucket = 'named'").select(F.col("repo_key").alias("repo")).distinct()
    of = lambda m: rows.where(F.col("model") == m).withColumn("model", F.lit("m"))
    _, final = jobs.two_pass(of("model-a"), of("model-b"), rows.join(named, "repo", "left_semi"))
    return final.select("pos", "class")


@query(AGREE + "SELECT count(*) FILTER (WHERE agree) AS agreed, count(*) AS papers, count(*) FILTER (WHERE agree) / greatest(count(*), 1) * 100 AS rate FROM z", "papers", "answers")
def b9_compare_models(t: Lens) -> DataFrame:
    return jobs.compare_models(results(t), MODELS)[1]


@query(RESULTS + "SELECT s AS metric, CAST(count(x.status) AS DOUBLE) AS value FROM (SELECT unnest(['yes', 'no', 'skipped', 'error']) AS s) LEFT JOIN x ON x.status = s GROUP BY s UNION ALL SELECT 'total', CAST(count(*) AS DOUBLE) FROM x UNION ALL SELECT 'coverage_pct', count(*) FILTER (WHERE status = 'yes') / greatest(count(*), 1) * 100 FROM x", "papers", "answers")
def b10_summarise(t: Lens) -> DataFrame:
    return jobs.summarise(results(t))


@query(API + "SELECT doc_tool, count(*) AS n FROM api WHERE doc_tool <> 'none' GROUP BY doc_tool", "papers", "files")
def a5_tool_breakdown(t: Lens) -> DataFrame:
    return summary.tool_breakdown(jobs.audit_api_docs(t.papers, t.files.drop("content"), t.files))
