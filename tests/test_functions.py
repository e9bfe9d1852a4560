"""Known cases of the rules, and the closed forms against the loops that define them."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from repolith.functions import answers as A
from repolith.functions import notebooks, parsers, paths, rules, urls
from repolith.functions import text as T
from repolith.operators import files as fl
from repolith.operators import papers as pp
from repolith.operators import summary
from repolith.plans import jobs
from repolith.sources.files import decode_content, read_papers, write_report


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    "url,want",
    [("https://github.com/o/r", ("o", "r")), ("https://github.com/o/r/", ("o", "r")), ("https://github.com/o/r.git", ("o", "r")), ("https://github.com/o/r/blob/main/x", ("o", "r")), (" https://o.github.io/r ", ("o", "r")), ("https://github.com/o/r.js", ("o", "r")), ("https://huggingface.co/x/y", None), ("", None), (None, None)],
)
def test_addresses(spark, url, want):
    got = one(spark, url, urls.parse_repo_url)
    assert (tuple(got) if got else None) == want


def test_paths(spark):
    for p, plain, last in (("readme.md", 0, 0), ("setup.py", 1, 1), ("docs/x.md", 2, 2), ("a/README.md", 2, 3)):
        assert one(spark, p, paths.readme_priority) == plain and one(spark, p, lambda c: paths.readme_priority(c, True)) == last
    assert one(spark, ".r", paths.ext_rsplit) == ".r" and one(spark, ".r", paths.ext_splitext) == "" and one(spark, "a/b.tar.gz", paths.ext_splitext) == ".gz"


def test_texts(spark):
    assert [tuple(s) for s in one(spark, "pre\n# A \nx\n\n## B\ny", T.split_sections)] == [(0, "A", "x"), (1, "B", "y")]
    assert [tuple(s) for s in one(spark, "no heading", T.split_sections)] == [(0, "", "no heading")]
    assert "pip install flask" in one(spark, "Now pip install flask\nok", T.install_command_hit) and one(spark, "nothing", T.install_command_hit) is None
    assert one(spark, '<https://h/x?per_page=1&page=57>; rel="last"', lambda c: T.last_page(c, F.lit(1))) == 57
    assert one(spark, "// Run starts\nfunc Run() {}\n", lambda c: T.structured_comments(F.lit(".go"), c))["n"] == 1
    assert one(spark, base64.b64encode(b"a\xff\xc3\xa9").decode(), decode_content) == "aé"


ANSWER_FIELDS = {"has_usage_examples": "truth", "evidence": "string", "example_types": "array<string>", "example_files": "array<string>"}


def test_answers(spark):
    read = lambda raw: one(spark, raw, lambda c: A.parse_answer(c, ANSWER_FIELDS, ("example_types", "example_files"), {"example_file": "example_files"}))
    fenced = read('```json\n{"has_usage_examples": true, "evidence": "e", "example_file": "a.py"}\n```')
    assert (fenced["has_usage_examples"], fenced["example_types"], fenced["example_files"], fenced["parsed"]) == (True, [], ["a.py"], True)
    assert read('{"a": tru')["evidence"] == 'Parsing failed: {"a": tru' and read("")["parsed"] is False and read("[1]")["parsed"] is False
    assert [one(spark, v, A.truth_label) for v in ("has examples", " No ", "maybe", None)] == [True, False, None, None]
    got = one(spark, json.dumps([{"path": " p ", "category": "A"}, "q", {"path": ""}]), A.normalise_entries)
    assert [tuple(e) for e in got] == [("p", "a", ""), ("q", "", "")]


def test_install_commands_by_their_words(spark):
    """Against every pattern tried in turn."""
    import re

    r = random.Random(2)
    heads = [re.sub(r"\\s\+\\S\+", r.choice(["", " ", " x", "\n y"]), p).replace("\\.", ".") for p in rules.INSTALL_COMMANDS for _ in range(3)]
    texts = ["".join(r.choice([*heads, " ", "install", "Pip ", "word ", "\n", "/configure", "?/install"]) for _ in range(r.randrange(4))) for _ in range(500)] + [h.upper() for h in heads]

    def plain(text):
        for p in rules.INSTALL_COMMANDS:
            if m := re.search(p, text.lower()):
                return text[max(0, m.start() - 20) : m.end() + 60].replace("\n", " ").strip()
        return None

    got = spark.createDataFrame(list(enumerate(texts)), "i int, v string").select("i", T.install_command_hit(F.col("v")).alias("o")).collect()
    assert {x["i"]: x["o"] for x in got} == {i: plain(t) for i, t in enumerate(texts)}


JUDGED = ["true", "false", '"false"', '"False"', '"0"', '""', '" "', "0", "-0.0", "0.0", "1e-9", "-1", "1e400", "12345678901234567890123", "[]", "[0]", "[[]]", "{}", '{"a": 0}', "null", '"\\u0000"']


def test_truth_is_by_type(spark):
    """Against the language whose truth it is; a missing value and a null say neither."""
    raws = [f'{{"x": {v}, "evidence": "e"}}' for v in JUDGED] + ['{"y": true}', '```json\n{"x": "no"}\n```', '{"x": true} and more', '{"x": true} {"x": false}', '[{"x": true}]', "", None, '{"x": tru']

    def plain(raw):
        try:
            found = json.loads((raw or "").strip().removeprefix("```json").removesuffix("```"))
        except ValueError:
            return None
        value = found.get("x") if isinstance(found, dict) else None
        return None if value is None else bool(value)

    frame = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, v string")
    a = frame.select("i", A.parse_answer(F.col("v"), {"x": "truth"}).alias("a")).select("i", "a.x", "a.evidence", "a.parsed").collect()
    assert {r["i"]: r["x"] for r in a} == {i: plain(r) for i, r in enumerate(raws)}
    assert [r["i"] - len(JUDGED) for r in sorted(a) if r["evidence"] and r["evidence"].startswith("Parsing failed: ")] == [2, 3, 4, 7]


def test_fields_of_answers(spark):
    fields = {"e": "string", "l": "array<string>", "j": "json"}
    read = lambda raw, single=None: one(spark, raw, lambda c: A.parse_answer(c, fields, ("l",), single))
    assert tuple(read('{"e": "x", "l": ["a", {"b": 1}], "j": [{"path": "p"}]}'))[:3] == ("x", ["a", '{"b":1}'], '[{"path":"p"}]')
    assert tuple(read('{"e": null, "l": "text", "j": null}'))[:3] == (None, [], None)
    assert read('{"one": "a"}', {"one": "l"})["l"] == ["a"] and read('{"one": ""}', {"one": "l"})["l"] == [] and read('{"one": "a", "l": null}', {"one": "l"})["l"] == []


def _plain_notebook(raw):
    """What a notebook says, by its parsed JSON."""
    try:
        book = json.loads(raw)
    except ValueError:
        return raw
    if not isinstance(book, dict) or not isinstance(book.get("cells"), list):
        return raw
    blocks = []
    for i, cell in enumerate(book["cells"]):
        source = cell.get("source", "") if isinstance(cell, dict) else ""
        source = "".join(source) if isinstance(source, list) else source
        if isinstance(source, str) and source.strip() and cell.get("cell_type") in ("code", "markdown"):
            prose = "\n".join(f"# {x}" for x in source.strip().splitlines() if x.strip())
            blocks.append(f"# --- Cell {i} ({cell['cell_type']}) ---\n{source if cell['cell_type'] == 'code' else prose}")
    return "\n\n".join(blocks) or raw


def test_notebooks(spark):
    r = random.Random(8)
    pieces = ["a\n", "b", " ", "\n\n", "# T\r\n", "x\u2028y", "é\x85z", "\t", "\x1c", "q\x0bw"]
    source = lambda: r.choice([[r.choice(pieces) for _ in range(r.randrange(5))], "".join(r.choice(pieces) for _ in range(r.randrange(5))), None, 5, [], ""])
    cell = lambda: r.choice([{"cell_type": r.choice(["code", "markdown", "raw"]), "source": source(), "outputs": [{"text": ["1"]}]}, {"cell_type": "code"}, 7, None, {"source": "x"}])
    books = [json.dumps({"cells": [cell() for _ in range(r.randrange(6))], "metadata": {}}) for _ in range(300)] + ["plain", "", "[1]", "{}", '{"cells": {}}', '{"cells": null}', '"s"', json.dumps({"cells": [{"cell_type": "code", "source": "x" * 3_000_000}]})]
    frame = spark.createDataFrame(list(enumerate(books)), "i int, v string")
    out = frame.select("i", notebooks.flatten_notebook(F.col("v")).alias("flat"), notebooks.usage_text(F.col("v")).alias("shown"), notebooks.summarise_notebook(F.col("v"), 40).alias("short"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {x["i"]: x for x in out.collect()}
    assert [got[i]["flat"] for i in range(len(books))] == [_plain_notebook(b) for b in books]
    is_object = lambda b: b.startswith("{")
    assert [got[i]["shown"] for i in range(len(books))] == [("" if _plain_notebook(b) == b and is_object(b) else _plain_notebook(b)) for b in books]
    book = json.dumps({"cells": [{"cell_type": "code", "source": ["a\n", "b"], "outputs": [{"text": ["1"]}, {"text": "z" * 500}, {"data": {}}]}, {"cell_type": "markdown", "source": "m"}]})
    assert one(spark, book, notebooks.summarise_notebook) == "[CODE]\na\nb\n\n[OUTPUT]\n1\n\n[MARKDOWN]\nm" and one(spark, "plain text", lambda c: notebooks.summarise_notebook(c, 5)) == "plain"


def test_status(spark):
    f = lambda *v: spark.range(1).select(A.overall_status(*map(F.lit, v)).alias("o")).first()["o"]
    assert f(True, True, True, True) == "ARCHIVED" and f(True, False, False, True, True, True, False) == "ACTIVE"
    assert f(True, False, False, True, False) == "MINIMAL" and f(True, False, False, False) == "INACTIVE" and f(False, True, True) == "NOT_ASSESSABLE"


def test_parsers(spark):
    code = 'def foo():\n    """Args: a"""\nclass C:\n    def __init__(self): pass\n    def _x(self): pass\n    def __y(self): pass\n'
    assert tuple(one(spark, code, parsers.python_docstrings)) == (0, 0, 1, 1, 1, 2)
    assert one(spark, "def (", parsers.python_docstrings) is None


def test_budget_is_the_loop(spark):
    r = random.Random(3)
    rows = [(f"r{i % 7}", f"p{i}", i, "x" * r.randint(0, 30)) for i in range(90)]
    got = {(x["repo_key"], x["path"]): x["take"] for x in fl.char_budget(spark.createDataFrame(rows, "repo_key string, path string, seq long, content string"), 100, F.lit(20), "seq").collect()}
    want, left = {}, {}
    for repo, path, _, text in rows:
        take = min(len(text), 20, left.setdefault(repo, 100))
        left[repo] -= take
        if take:
            want[(repo, path)] = take
    assert got == want


def test_round_robin_is_the_loop(spark):
    r = random.Random(4)
    names = sorted({r.choice(["", "b/", "A/", "c/d/"]) + r.choice("xyzXY") + str(r.randint(0, 9)) for _ in range(40)})
    frame = spark.createDataFrame([("r", i, p) for i, p in enumerate(names)], "repo_key string, seq long, path string")
    got = [x["path"] for x in fl.round_robin_sample(paths.path_features(frame), 17).orderBy("rank").collect()]
    folders: dict[str, list[str]] = {}
    for p in names:
        folders.setdefault(p.split("/")[0] if "/" in p else "", []).append(p)
    turns = [sorted(folders[k], key=str.lower) for k in sorted(folders, key=lambda k: (k != "", k.lower()))]
    assert got == [t[i] for i in range(40) for t in turns if i < len(t)][:17]


def test_papers(spark, tmp_path):
    listed = tmp_path / "p.json"
    listed.write_text(json.dumps([{"title": "a", "repo": "https://github.com/o/r"}, {"title": " ", "repo": "https://github.com/O/R/"}, {"title": "c"}]))
    papers = read_papers(spark, str(listed))
    assert [(r["pos"], r["has_repo"]) for r in papers.orderBy("pos").collect()] == [(0, True), (1, True), (2, False)]
    flags = {r["pos"]: r["flags"] for r in pp.validate_papers(papers).collect()}
    assert flags[0] == [] and flags[1][0] == "Missing title." and "Duplicate" in flags[1][1] and flags[2] == ["No repo link to validate."]
    assert [r["pos"] for r in pp.dedupe_first(papers).orderBy("pos").collect()] == [0, 2]
    (tmp_path / "q.json").write_text('{"title": "only", "repo": null}')
    assert read_papers(spark, str(tmp_path / "q.json")).count() == 1
    (tmp_path / "bad.json").write_text('"text"')
    with pytest.raises(Exception, match="papers"):
        read_papers(spark, str(tmp_path / "bad.json")).collect()


def test_report_and_counts(spark, tmp_path):
    rows = spark.createDataFrame([(0, "m", " YES ", ["a"]), (1, "m", "odd", [])], "pos long, model string, status string, l array<string>")
    assert {r["status"]: r["n"] for r in summary.count_statuses(rows).collect()} == {"yes": 1, "no": 0, "skipped": 0, "error": 0, "odd": 1}
    for fmt in ("parquet", "csv"):
        write_report(str(tmp_path / fmt), rows, summary=summary.count_statuses(rows), fmt=fmt)
        assert spark.read.format(fmt).option("header", True).load(str(tmp_path / fmt / "results")).count() == 2


def test_notebook_query_has_every_file(spark, sf):
    from repolith.plans import queries as Q
    from repolith.sources.lens import Lens

    files = Lens(spark, sf).files
    assert Q.QUERIES["h2_notebooks"](spark, sf).count() == files.count()


def test_docstring_query_parses_whole_contents(spark, monkeypatch):
    from repolith.plans import queries as Q

    late = "x" * 500 + "\nReturns: y"
    rows = spark.createDataFrame([("r", "a.py", 0, ".py", late)], "repo_key string, path string, seq long, ext string, content string")
    monkeypatch.setattr(Q, "feats", lambda t: rows)
    monkeypatch.setattr(Q.parsers, "python_docstrings", lambda c: F.struct(c.alias("parsed")))
    assert late in Q.h1_python_docstrings(None).first()["parsed"]


def test_papers_without_a_key_spread(spark):
    """Nine in ten papers have no repository: they lie in all partitions of the join, and one exchange serves two joins."""
    from repolith.operators.papers import attach

    papers = spark.range(1000).selectExpr("id AS pos", "CASE WHEN id % 10 = 0 THEN concat('r', id % 7) END AS repo_key")
    meta = spark.range(7).selectExpr("concat('r', id) AS repo_key", "id AS stars")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = attach(attach(papers, meta), meta.withColumnRenamed("stars", "more"))
        sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 400
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(coalesce(repo_key") == 1
        got = {r["pos"]: (r["stars"], r["more"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == {i: (i % 7, i % 7) if i % 10 == 0 else (None, None) for i in range(1000)}


def test_sent_replacement_characters_stay(spark):
    from repolith.sources.files import decode_content

    raw = ["a�b".encode() + b"\xff", " �".encode(), b"\xe2\x82", b"", "é😀".encode() + b"\xc3"]
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(raw)], "i int, raw binary")
    got = {r[0]: r[1] for r in rows.select("i", decode_content(F.base64("raw"))).collect()}
    assert got == {i: x.decode("utf-8", "ignore") for i, x in enumerate(raw)}


def test_files_of_answers(spark):
    """One file on its own, one command on its own, parts that lack, no list at all."""
    parts = {"type": "other", "description": "", "commands": ""}
    rows = [
        (0, '[{"path": " a.py ", "commands": "run a"}, {"path": "b.py", "type": "cli", "commands": ["x", "y"]}, {"path": " "}]', "z.py"),
        (1, "[]", "z.py"),
        (2, None, ""),
        (3, '"none"', ""),
        (4, '[{"path": "c.sh", "commands": "[ -f x ] && y"}]', ""),
    ]
    frame = spark.createDataFrame(rows, "i int, raw string, single string")
    found = A.with_links(A.file_entries(F.col("raw"), parts, F.col("single")), F.lit("o"), F.lit("r"))
    got = {r["i"]: [(e["path"], e["type"], e["description"], list(e["commands"]), e["link"]) for e in r["e"]] for r in frame.select("i", found.alias("e")).collect()}
    link = "https://github.com/o/r/blob/HEAD/"
    assert got[0] == [("a.py", "other", "", ["run a"], link + "a.py"), ("b.py", "cli", "", ["x", "y"], link + "b.py")]
    assert got[1] == [("z.py", "other", "", [], link + "z.py")]
    assert got[2] == got[3] == []
    assert got[4] == [("c.sh", "other", "", ["[ -f x ] && y"], link + "c.sh")]


def test_judged_without_files(spark):
    """No files to read is a no to two checks, whatever was answered; the others don't ask."""
    papers = spark.createDataFrame([(1, "t", "https://github.com/o/r"), (2, "t", "https://github.com/o/s"), (3, "t", None)], "pos long, title string, repo string")
    answers = spark.createDataFrame([(i, "m", '{"has_inline_comments": true, "has_usage_examples": true, "classification": "EXISTS", "example_file": "x.py"}') for i in (1, 2, 3)], "pos long, model string, raw string")
    payloads = spark.createDataFrame([("o/r", 2), ("o/s", 0)], "repo_key string, n_files long")
    status = lambda check: {r["pos"]: r["status"] for r in jobs.judge_answers(answers, papers, check, payloads).collect()}
    assert status("comments") == status("preprocessing") == {1: "yes", 2: "no", 3: "skipped"}
    assert status("usage") == {1: "yes", 2: "yes", 3: "skipped"}
