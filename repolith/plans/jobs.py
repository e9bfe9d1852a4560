"""What a user calls (B1 to B10): each job answers one question for all repositories of a snapshot at once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import rules as R
from ..functions import text as T
from ..functions.parsers import python_docstrings
from ..functions.paths import api_docs_bucket, is_source_file, path_features, preprocessing_bucket, readme_priority, starts, usage_bucket, with_bucket
from ..operators import activity, files as fl, papers as pp, summary


# ---- B1: documentation of the interface


def api_docs_candidates(files: DataFrame, rule_based: bool = True) -> DataFrame:
    """Files that the check reads, with rank: all configuration, 15 pages, one readme, 20 sources spread over top folders.

    One pass over the listing: all ranks are windows over one partitioning by repository.
    """
    found = with_bucket(path_features(files), api_docs_bucket(rule_based))
    strong = F.when(starts(F.col("path_lower"), R.STRONG_DOC_FOLDERS), 0).otherwise(1)
    key = F.when(F.col("bucket") == "readme", 0).otherwise(F.col("depth") if rule_based else strong)
    folder, bucket = Window.partitionBy("repo_key", "bucket", "top"), Window.partitionBy("repo_key", "bucket")
    found = found.withColumns({"round": F.row_number().over(folder.orderBy("path_lower", "seq")), "top_seq": F.min("seq").over(folder), "place": F.row_number().over(bucket.orderBy(key, "path_lower", "seq"))})
    found = found.where((F.col("bucket") != "source") | (F.col("round") <= R.MAX_API_SOURCES))
    turn = F.row_number().over(bucket.orderBy("round", F.col("top") != "", F.lower("top"), "top_seq"))
    found = found.withColumn("rank", F.when(F.col("bucket") == "source", turn).otherwise(F.col("place")))
    most = F.when(F.col("bucket") == "source", R.MAX_API_SOURCES).when(F.col("bucket") == "page", R.MAX_DOC_PAGES).when(F.col("bucket") == "readme", 1)
    return found.where(F.coalesce(F.col("rank") <= most, F.lit(True))).drop("round", "top_seq", "place")


def api_evidence(candidates: DataFrame, contents: DataFrame) -> DataFrame:
    """repo_key, path, bucket, rank, type, doc_type, tool, and for sources strong and Python's coverage counts.

    Contents are joined once; configuration may do without, all else needs some.
    """
    text = contents.select("repo_key", "path", "content").where(F.length("content") > 0)
    rows = candidates.join(text, ["repo_key", "path"], "left")
    python = (F.col("bucket") == "source") & (F.col("ext") == ".py")
    rows = rows.withColumn("d", python_docstrings(F.when(python, F.col("content"))))
    d, low, content = F.col("d"), F.col("path_lower"), F.col("content")
    tool = F.coalesce(T.doc_tool_by_content(low, content), T.doc_tool_by_name(low, F.col("basename")))
    none, null = F.lit(None).cast("long"), F.lit(None).cast("string")
    as_entry = lambda type_, doc_type, tool_=null, strong=F.lit(None).cast("boolean"), total=none, documented=none, good=none: F.struct(type_.alias("type"), doc_type.alias("doc_type"), tool_.alias("tool"), strong.alias("strong"), total.alias("public_total"), documented.alias("public_documented"), good.alias("high_quality_documented"))
    kind = F.when(d["function"] > 0, "docstring_function").when(d["class"] > 0, "docstring_class").otherwise("docstring_module")
    documented = (d["function"] + d["class"]).cast("long")
    hit = as_entry(kind, F.lit("python docstrings"), null, documented + d["param_like"] > 0, (d["public_function_total"] + d["public_class_total"]).cast("long"), documented, d["param_like"].cast("long"))
    comments = T.structured_comments(F.col("ext"), content)
    rows = rows.withColumns({"t": F.when(F.col("bucket") == "config", tool), "c": F.when((F.col("bucket") == "source") & ~python, comments)})
    t, c = F.col("t"), F.col("c")
    page = F.col("bucket").isin("page", "readme") & T.doc_page_evidence(low, content)
    entry = (
        F.when(t.isNotNull(), as_entry(t["entry_type"], t["doc_type"], t["tool"]))
        .when(page, as_entry(F.lit("doc_page"), F.lit("other")))
        .when(documented + d["module"] > 0, hit)
        .when(c.isNotNull(), as_entry(F.lit("other"), c["doc_type"], null, c["strong"]))
    )
    # A generator of one row, into which the optimizer writes no filter: each file is parsed and searched once, not once more to be kept.
    found = rows.select("repo_key", "path", "bucket", "rank", F.inline(F.array(F.struct(entry.alias("e")))))
    return found.where("e is not null").select("repo_key", "path", "bucket", "rank", "e.*")


def api_docs_verdicts(files: DataFrame, contents: DataFrame) -> DataFrame:
    """repo_key, documentation_types, doc_tool, n_doc_files, preview, coverage_percent and its counts, of repositories with evidence.

    All of it is sums, flags, sets of known types and first elements, which merge: a repository's row has a fixed size, and
    none of its evidence meets in one task but three files of each share of it. See api_doc_files() for the files themselves.
    """
    hits = api_evidence(api_docs_candidates(files), contents)
    source = F.col("bucket") == "source"
    ranked = summary.first_of_shares(hits.withColumns({"low": F.lower("path"), "source": source}), ["repo_key", "source"], ["low", "type", "path"])
    known = F.array(*map(F.lit, R.TOOL_ORDER))
    tool = F.when(F.col("tool").isNotNull(), F.struct(F.coalesce(F.nullif(F.array_position(known, F.col("tool")), F.lit(0)), F.lit(99)).alias("p"), "tool"))
    strong = F.coalesce("strong", F.lit(False))
    each = ranked.groupBy("repo_key").agg(
        (F.bool_or(source & strong) | (F.count_if(source) >= 2)).alias("enough"), F.count_if(source).alias("n_source"), F.count_if(~source).alias("n_other"),
        F.collect_set(F.when(source, F.col("doc_type"))).alias("types_source"), F.collect_set(F.when(~source, F.col("doc_type"))).alias("types_other"),
        F.min(tool).alias("tool"), F.collect_list(F.when(F.col("early"), F.struct("low", "type", "path", "source"))).alias("firsts"),
        (F.count("public_total") > 0).alias("python"), *(F.sum(c).alias(n) for c, n in (("public_total", "total_public"), ("public_documented", "documented_public"), ("high_quality_documented", "high_quality"))),
    )
    kept = F.array_sort(F.filter("firsts", lambda e: ~e["source"] | F.col("enough")))
    types = F.when(F.col("enough"), F.concat("types_other", "types_source")).otherwise(F.col("types_other"))
    total = F.when(F.col("python"), F.col("total_public"))
    return each.select(
        "repo_key",
        summary.ordered_doc_types(types).alias("documentation_types"),
        F.coalesce("tool.tool", F.lit("none")).alias("doc_tool"),
        (F.col("n_other") + F.when(F.col("enough"), F.col("n_source")).otherwise(0)).alias("n_doc_files"),
        F.when(F.size(kept) > 0, F.array_join(F.slice(F.transform(kept, lambda e: e["path"]), 1, summary.PREVIEW), ", ")).alias("preview"),
        F.when(total > 0, F.bround(F.col("documented_public") * 100 / F.nullif(total, F.lit(0)), 1)).alias("coverage_percent"),
        total.alias("total_public"), *(F.when(F.col("python"), F.col(c)).alias(c) for c in ("documented_public", "high_quality")),
    )


def api_doc_files(files: DataFrame, contents: DataFrame) -> DataFrame:
    """repo_key, path, type: the files that document a repository's interface, a row each, however many there are."""
    return summary.doc_file_rows(summary.collect_evidence(api_evidence(api_docs_candidates(files), contents)))


def audit_api_docs(papers: DataFrame, files: DataFrame, contents: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row a paper: status, documentation_types, doc_tool, n_doc_files, preview, coverage, pages_url.

    A repository without a listing is a no; an address that cannot be parsed an error, one of another host skipped.
    """
    return judge_api_docs(papers, api_docs_verdicts(files, contents), pages)


def judge_api_docs(papers: DataFrame, verdicts: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """audit_api_docs() from what api_docs_verdicts() found, in one go or in parts."""
    out = pp.attach(pp.with_keys(papers), verdicts)
    if pages is not None:
        out = fl.attach_sites(out, pages)
    verdict = A.verdict(F.col("repo"), F.coalesce(F.col("n_doc_files") > 0, F.lit(False)), review=R.NOT_HOSTED_DOCS, unparsed=F.concat(F.lit(R.NOT_PARSED_DOCS), F.col("repo")))
    return out.withColumn("v", verdict).withColumns({"status": F.col("v.status"), "note": F.col("v.note"), "doc_tool": F.coalesce("doc_tool", F.lit("none"))}).drop("v", "owner", "name")


# ---- B2: installation


def classify_install(readmes: DataFrame, scores: DataFrame | None = None, threshold: float = 0.7) -> DataFrame:
    """repo_key, path, label, confidence, snippet, tier of ``readmes`` (repo_key, path, content): the first reason that holds.

    1: an install command. 2: a section under a set-up heading. 3: under a likely heading, if ``scores`` (repo_key,
    path, idx, label, score) says so. 4: any section that is scored clearly. Without scores, 3 and 4 find nothing;
    install_candidates() has what there is to score.
    """
    texts = readmes.where(F.length(T.strip(F.col("content"))) > 0).select("repo_key", "path", "content")
    if scores is None:
        return _sure_signs(texts)
    command = texts.withColumn("hit", T.install_command_hit(F.col("content"))).where("hit is not null")
    command = command.select("repo_key", "path", F.lit("installation guide").alias("label"), F.lit(1.0).alias("confidence"), F.concat(F.lit("[command] ..."), "hit", F.lit("...")).alias("snippet"), F.lit(1).alias("tier"), F.lit(-1).alias("idx"))
    section = _sections(texts)
    start = F.translate(F.substring("content", 1, 100), "\n", " ")
    headed = F.concat(F.lit("[heading: "), "heading", F.lit("] "), start)
    strong = section.where("tier = 'strong'").select("repo_key", "path", F.lit("installation guide").alias("label"), F.lit(1.0).alias("confidence"), headed.alias("snippet"), F.lit(2).alias("tier"), "idx")
    scored = section.join(scores, ["repo_key", "path", "idx"]).where(F.col("label").isin(*R.SETUP_LABELS))
    likely = scored.where((F.col("tier") == "partial") & (F.col("score") >= threshold)).select("repo_key", "path", "label", F.col("score").alias("confidence"), headed.alias("snippet"), F.lit(2).alias("tier"), "idx")
    plain = F.concat(F.lit("[NLP only: "), F.coalesce(F.nullif("heading", F.lit("")), F.lit("no heading")), F.lit("] "), start)
    ways = [command, strong, likely, scored.where((F.length("content") >= 50) & (F.col("score") >= threshold + 0.15)).select("repo_key", "path", "label", F.col("score").alias("confidence"), plain.alias("snippet"), F.lit(4).alias("tier"), "idx")]
    every = ways[0]
    for w in ways[1:]:
        every = every.unionByName(w)
    # Strong and likely headings are read section by section, whichever comes first.
    best = F.min_by(F.struct("label", "confidence", "snippet", "tier"), F.struct("tier", "idx"))
    return every.groupBy("repo_key", "path").agg(best.alias("b")).select("repo_key", "path", "b.*")


def _sure_signs(texts: DataFrame) -> DataFrame:
    """classify_install() without scores: one pass over each text where it lies, its sections only where it has no command."""

    def reason(snippet: Column, tier: int) -> Column:
        return F.struct(F.lit("installation guide").alias("label"), F.lit(1.0).alias("confidence"), snippet.alias("snippet"), F.lit(tier).alias("tier"))

    strong = F.filter(T.split_sections(F.col("content")), lambda s: T.heading_tier(s["heading"], s["content"]) == "strong")
    headed = T.once(F.get(strong, F.lit(0)), lambda s: F.when(s.isNotNull(), reason(F.concat(F.lit("[heading: "), s["heading"], F.lit("] "), F.translate(F.substring(s["content"], 1, 100), "\n", " ")), 2)))
    best = T.once(T.install_command_hit(F.col("content")), lambda hit: F.when(hit.isNotNull(), reason(F.concat(F.lit("[command] ..."), hit, F.lit("...")), 1)).otherwise(headed))
    # A generator of one row keeps the search from being done once more to see whether it found anything.
    found = texts.select("repo_key", "path", F.inline(F.array(F.struct(best.alias("b")))))
    return found.where("b is not null").select("repo_key", "path", "b.*")


def _sections(texts: DataFrame) -> DataFrame:
    one = texts.select("repo_key", "path", F.explode(T.split_sections(F.col("content"))).alias("s"))
    return one.select("repo_key", "path", "s.*").withColumn("tier", T.heading_tier(F.col("heading"), F.col("content")))


def install_candidates(readmes: DataFrame) -> DataFrame:
    """repo_key, path, idx, kind, model_input: sections that only a score can decide, of readmes without a sure sign."""
    texts = readmes.where(F.length(T.strip(F.col("content"))) > 0)
    open_ = texts.join(classify_install(texts).select("repo_key", "path"), ["repo_key", "path"], "left_anti")
    section = _sections(open_.select("repo_key", "path", "content")).where("tier = 'partial' or length(content) >= 50")
    kind = F.when(F.col("tier") == "partial", "partial").otherwise("any")
    return section.select("repo_key", "path", "idx", kind.alias("kind"), T.model_input(F.col("heading"), F.col("content")).alias("model_input"))


def audit_install(files: DataFrame, contents: DataFrame, all_readmes: bool = False, scores: DataFrame | None = None) -> DataFrame:
    """repo_key, report: Yes with where and why, No, or that there is no readme."""
    low = F.lower("path")
    readme = F.substring_index(low, "/", -1).startswith("readme") if all_readmes else low.startswith("readme")
    found = files.where(readme)
    if not all_readmes:
        found = found.join(fl.first_readme(files), ["repo_key", "path"], "left_semi")
    found = found.select("repo_key", "path", "seq")
    text = found.join(contents.where(readme).select("repo_key", "path", "content"), ["repo_key", "path"])
    hits = classify_install(text, scores).join(found, ["repo_key", "path"])
    where = F.when(F.col("path").contains("/"), F.col("path")).otherwise(F.lit("README"))
    said = F.concat(where, F.lit(" ("), "label", F.lit(", confidence: "), F.bround(F.col("confidence") * 100, 0).cast("long").cast("string"), F.lit("%) — "), "snippet")
    listed = hits.groupBy("repo_key").agg(F.array_sort(F.collect_list(F.struct(F.col("path").contains("/").alias("nested"), "seq", said.alias("said")))).alias("l"))
    report = F.concat(F.lit("Yes: "), F.array_join(F.transform("l", lambda x: x["said"]), " | "))
    repos = files.groupBy("repo_key").agg(F.bool_or(readme).alias("has"))
    out = repos.join(listed, "repo_key", "left")
    return out.select("repo_key", F.coalesce(report, F.when(F.col("has"), "No").otherwise("No README found")).alias("report"))


# ---- B3 to B6: licence, maintenance, adoption, activity after publication


def audit_license(papers: DataFrame, licenses: DataFrame, files: DataFrame) -> DataFrame:
    """Each paper with its licence; without a repository, a note."""
    note = F.when(F.coalesce(F.length("repo"), F.lit(0)) == 0, R.NO_URL).when(F.col("repo_key").isNull(), R.NOT_HOSTED).otherwise("")
    return activity.detect_license(pp.with_keys(papers), licenses, files).withColumn("note", note)


def audit_maintenance(papers: DataFrame, meta: DataFrame, files: DataFrame, activity_rows: DataFrame, as_of: str, recent_days: int = 182, stale_days: int = 365) -> DataFrame:
    """Each paper with its indicators (value, detail) and overall status; without metadata all are null.

    ``activity_rows`` (see activity.scoreboard) are read once; last_commit_date and total_commits, which audit_post_publication()
    asks for, come from the same scan. A repository that has metadata but no activity rows has none: false, not null.
    """
    empty = lambda c, v: F.when(F.col("reachable"), F.coalesce(F.col(c), F.lit(v)))
    known = meta.join(activity.scoreboard(activity_rows, as_of, recent_days), "repo_key", "left").join(fl.root_presence(files), "repo_key", "left")
    out = pp.attach(pp.with_keys(papers), activity.with_last(known, as_of, stale_days).withColumn("reachable", F.lit(True)))
    out = out.withColumn("reachable", F.coalesce("reachable", F.lit(False))).drop("released")
    reason = T.deprecation_reason(F.col("archived"), F.col("description"))
    out = out.withColumns(
        {
            "recent": empty("recent", False), "n_commits": empty("n_commits", 0),
            "responded": empty("responded", False), "issue_detail": empty("issue_detail", "No issues found"),
            "several": empty("several", False), "n_contributors": empty("n_contributors", 0),
            "versioned": empty("versioned", False), "release_detail": empty("release_detail", "None"),
            "archived_reason": F.when(F.col("reachable"), F.coalesce(reason, F.lit(""))),
            "last_activity": F.date_format("last", "yyyy-MM-dd"),
        }
    )
    gone = F.col("archived_reason") != ""
    return out.withColumn("overall", A.overall_status(F.col("reachable"), gone, F.coalesce("stale", F.lit(False)), *(F.col(c) for c in ("recent", "responded", "several", "versioned"))))


def audit_adoption(papers: DataFrame, meta: DataFrame, contents: DataFrame, downloads: DataFrame) -> DataFrame:
    """Each paper with stars, forks, package, last_month and a note on what is missing."""
    named = contents.where(F.col("path").isin("pyproject.toml", "setup.cfg", "setup.py")).withColumn("package", T.package_name(F.col("path"), F.col("content"))).where("package is not null")
    package = named.groupBy("repo_key").agg(F.min_by("package", T.package_priority(F.col("path"))).alias("package"))
    out = pp.attach(pp.attach_meta(pp.with_keys(papers), meta), package).withColumn("package", F.when(F.col("reachable"), F.col("package")))
    out = activity.attach_downloads(out, downloads)
    note = pp.reachability_note(R.META_UNREACHABLE)
    return out.withColumn("note", F.when(note != "", note).otherwise(F.coalesce("download_note", F.lit("")))).drop("download_note")


def audit_post_publication(papers: DataFrame, meta: DataFrame, commits: DataFrame) -> DataFrame:
    """Each paper with last_commit_date, total_commits and a note."""
    out = pp.attach(pp.attach_meta(pp.with_keys(papers), meta.select("repo_key")), activity.commit_totals(commits))
    note = pp.reachability_note(R.REPO_UNREACHABLE)
    none = F.when(F.col("total_commits").isNull(), R.NO_COMMITS).otherwise("")
    shown = lambda c: F.when(F.col("reachable"), F.col(c)).alias(c)
    return out.select("pos", "title", "repo", "repo_key", shown("last_commit_date"), shown("total_commits"), F.when(note != "", note).otherwise(none).alias("note"))


# ---- B7: what models are given


def build_payloads(files: DataFrame, contents: DataFrame, check: str) -> DataFrame:
    """repo_key, payload, n_files, n_chars, max_tokens, paths, n_source for ``check``: preprocessing, install, usage, api_docs or comments.

    What is read is decided on sizes alone; one join then fetches the texts, cut, of the files that get any. Notebooks are
    flattened before they count. Text is cut per file before it is gathered, so a repository's payload stays within the
    check's budget. Blocks read "### LABEL: path" and the text; paths has theirs, in order. Repositories with nothing to read
    get the placeholder that the model expects. n_source: the source files there are to choose from, for pre-processing.
    """
    feats = path_features(files.drop("content"))
    sized = lambda chosen: fl.attach_sizes(chosen, contents)
    total = None
    if check == "preprocessing":
        total = with_bucket(feats, preprocessing_bucket()).groupBy("repo_key").agg(F.count(F.lit(1)).alias("n_source"))
        cut = fl.cascading_budget(sized(fl.preprocessing_candidates(files.drop("content"))))
        label = F.coalesce(*(F.when(F.col("bucket") == b, F.lit(x)) for b, (_, _, x) in R.PREPROCESSING_BUCKETS.items()))
        order, tokens = ("place", "depth", "path_lower", "seq"), (2_500, 4_000)
    elif check == "install":
        chosen = path_features(fl.select_install_files(files.drop("content"))).withColumn("first", readme_priority(F.col("path"), nested_last=True))
        cut, label = fl.char_budget(sized(chosen), R.INSTALL_CHARS, None, "first", "seq"), F.lit("FILE")
        order, tokens = ("first", "seq"), (1_000, 1_000)
    elif check == "usage":
        chosen = fl.top_n_per_bucket(with_bucket(feats, usage_bucket()), {"notebook": R.MAX_NOTEBOOKS, "script": R.MAX_SCRIPTS}, keep_others=True)
        cut = fl.staged_budget(fl.attach_sizes(chosen, contents, "left", as_example=True))
        label = F.when(F.col("bucket") == "doc", "FILE").otherwise(F.upper("bucket"))
        order, tokens = ("place", "first", "seq"), (4_000, 8_000)
    elif check == "api_docs":
        held = sized(api_docs_candidates(files.drop("content"), rule_based=False))
        held = held.withColumn("place", F.when(F.col("bucket") == "config", 0).when(F.col("bucket") == "page", 1).otherwise(2))
        held = held.withColumn("first", F.when(F.col("bucket") == "config", readme_priority(F.col("path"))).otherwise(F.col("rank")))
        cap = F.when(F.col("bucket") == "source", R.API_SOURCE_CAP).otherwise(R.API_DOC_CAP)
        cut = fl.char_budget(held, R.API_CHARS, cap, "place", "first", "seq")
        label = F.when(F.col("bucket") == "source", "SOURCE FILE").when(F.col("bucket") == "page", "DOC PAGE").otherwise("DOC CONFIG")
        order, tokens = ("place", "first", "seq"), (3_000, 6_000)
    else:
        found = feats.where(is_source_file(R.COMMENT_SOURCE_EXTS))
        chosen = fl.latest_n(found, R.MAX_COMMENT_SOURCES, "depth", "path_lower", "seq")
        cut, label = fl.char_budget(sized(chosen), R.COMMENT_CHARS, F.lit(R.COMMENT_CAP), "rank"), F.lit("SOURCE FILE")
        order, tokens = ("rank", "seq"), (2_000, 4_000)
    texts = fl.attach_texts(cut.select("repo_key", "path", "take", label.alias("label"), *order), contents, as_example=check == "usage")
    block = F.concat(F.lit("### "), "label", F.lit(": "), F.col("path"), F.lit("\n"), "text")
    rows = texts.groupBy("repo_key").agg(F.array_sort(F.collect_list(F.struct(*order, block.alias("block"), "path"))).alias("b"), F.count(F.lit(1)).alias("n_files"), F.sum("take").alias("n_chars"))
    text = F.coalesce(F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"), F.lit(f"[{R.NO_SOURCE_FILES if check in ('preprocessing', 'comments') else R.NO_FILES}]"))
    out = files.select("repo_key").distinct().join(rows, "repo_key", "left").withColumn("payload", text)
    out = out.join(total, "repo_key", "left") if total is not None else out.withColumn("n_source", F.lit(None).cast("long"))
    paths = F.coalesce(F.transform("b", lambda x: x["path"]), F.array().cast("array<string>"))
    return out.select("repo_key", "payload", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.when(F.length("payload") > 50_000, tokens[1]).otherwise(tokens[0]).alias("max_tokens"), paths.alias("paths"), "n_source")


# ---- B8 to B10: what models answer


@dataclass(frozen=True)
class Check:
    """What a model's answer to a check holds: the field that decides (a boolean or a class), lists of words, other text
    with what stands for a missing one, and a list of files, each with these parts beside its path."""

    key: str
    lists: tuple[str, ...] = ()
    texts: dict[str, str] = field(default_factory=dict)
    files: str | None = None
    parts: dict[str, str] = field(default_factory=dict)


CHECKS = {
    "preprocessing": Check("classification", texts={"diagnostic_notes": "", "final_reason": ""}, files="preprocessing_files"),
    "install": Check("has_installation_instructions", ("instruction_types",), {"installation_file": ""}),
    "usage": Check("has_usage_examples", ("example_types",), {"example_file": ""}, "example_files", {"type": "other", "description": "", "commands": ""}),
    "api_docs": Check("has_api_documentation", ("documentation_types",), {"doc_tool": "none"}, "doc_files", {"type": "other", "description": ""}),
    "comments": Check("has_inline_comments", ("comment_types",), files="files_with_comments", parts={"description": ""}),
}


def judge_answers(responses: DataFrame, papers: DataFrame, check: str = "usage", payloads: DataFrame | None = None) -> DataFrame:
    """pos, model, title, repo, status, note, evidence and what else ``check`` asks for, for responses (pos, model, raw).

    ``payloads`` (of build_payloads) tells which repositories had no file to read: to the checks of comments and of
    pre-processing that is a no, whatever was answered. A null or missing list is empty. The answer's boolean is judged by
    its type: the text "false" is a yes. Files come as structs with a link, those without a path go; comments' files stay
    as they were answered. Pre-processing gives its class, the files' categories, sorted, and the first three pieces of
    evidence; if the payloads say so, also files_checked, total_source_files and the coverage, the share of them that was read.
    """
    c = CHECKS[check]
    fields = {c.key: "string" if check == "preprocessing" else "truth", "evidence": "string", **dict.fromkeys(c.texts, "string"), **dict.fromkeys(c.lists, "array<string>")}
    read = responses.withColumn("a", A.parse_answer(F.col("raw"), fields | ({c.files: "json"} if c.files else {}), c.lists))
    keyed = pp.with_keys(papers).select("pos", "title", "repo", "owner", "name", "repo_key")
    found = None
    if payloads is not None and check in ("preprocessing", "comments"):
        keyed, found = pp.attach(keyed, payloads.select("repo_key", "n_files", *(x for x in ("paths", "n_source") if x in payloads.columns))), F.coalesce("n_files", F.lit(0))
    both = read.join(keyed, "pos")
    text = {n: F.coalesce(F.nullif(F.col(f"a.{n}"), F.lit("")), F.lit(d)) for n, d in c.texts.items()}
    kept = {n: F.col(f"a.{n}") for n in c.lists}
    evidence, answer = F.coalesce("a.evidence", F.lit("")), F.col(f"a.{c.key}")
    if check == "preprocessing":
        files = A.normalise_entries(F.col(f"a.{c.files}"))
        said = F.filter(F.transform(files, lambda e: e["evidence"]), lambda e: e != "")
        evidence = F.when(F.size(said) > 0, F.array_join(F.slice(said, 1, 3), "; ")).otherwise(text["diagnostic_notes"])
        categories = F.array_sort(F.array_distinct(F.filter(F.transform(files, lambda e: e["category"]), lambda x: x != "")))
        kept = {"class": F.coalesce(F.nullif(answer, F.lit("")), F.lit("NOT_APPLICABLE")), "categories": categories, c.files: files}
        verdict = A.class_verdict(F.col("repo"), answer, text["final_reason"], found)
        if "n_source" in keyed.columns:
            total = F.coalesce("n_source", F.lit(0))
            kept |= {"files_checked": F.coalesce("paths", F.array().cast("array<string>")), "total_source_files": total, "coverage": summary.coverage_checked(found, total)}
    else:
        verdict = A.verdict(F.col("repo"), answer, found, R.NO_SOURCE_FILES)
        if c.files:
            single = text.get("example_file")
            kept[c.files] = A.file_entries(F.col(f"a.{c.files}"), c.parts, single)
            if check != "comments":
                kept[c.files] = A.with_links(kept[c.files], F.col("owner"), F.col("name"))
        if check == "install":
            kept["installation_link"] = F.when((text["installation_file"] != "") & F.col("owner").isNotNull(), A.file_link(F.col("owner"), F.col("name"), text["installation_file"])).otherwise("")
        if check == "api_docs":
            kept["doc_tool"] = text["doc_tool"]
    return both.withColumn("v", verdict).select("pos", "model", "title", "repo", "v.*", evidence.alias("evidence"), *(v.alias(n) for n, v in kept.items()))


def compare_models(results: DataFrame, models: list[str]) -> tuple[DataFrame, DataFrame]:
    """(agreement by paper, its rate)."""
    each = summary.model_agreement(results, models)
    return each, summary.agreement_rate(each)


def summarise(results: DataFrame) -> DataFrame:
    """metric, value: the statuses' counts, the total and the share of yes."""
    counts = summary.count_statuses(results).select(F.col("status").alias("metric"), F.col("n").cast("double").alias("value"))
    pct = summary.coverage_pct(results)
    stack = pct.select(F.explode(F.array(F.struct(F.lit("total").alias("metric"), F.col("total").cast("double").alias("value")), F.struct(F.lit("coverage_pct").alias("metric"), F.col("pct").alias("value")))).alias("x")).select("x.*")
    return counts.unionByName(stack)


def two_pass(first: DataFrame, second: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(work list of the second pass, final classes) of pre-processing answers (repo_key, model, class).

    A repository is read again, by its named files alone, where the first pass found nothing and there are such files.
    """
    again = first.where("class = 'NOT_APPLICABLE'").join(named.select("repo_key").distinct(), "repo_key", "left_semi")
    tried = again.select("repo_key", "model").join(second.select("repo_key", "model", F.col("class").alias("class2")), ["repo_key", "model"], "left")
    out = first.join(tried, ["repo_key", "model"], "left")
    return again, out.withColumn("class", A.keep_second_pass(F.col("class"), F.col("class2"))).drop("class2")


