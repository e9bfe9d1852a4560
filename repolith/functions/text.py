"""Rules over file contents (F1 to F11, F13): headings, install commands, documentation tools, comments, names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .paths import holds, starts
from .urls import strip

def first_of(*cases: tuple[Column, object]) -> Column:
    return F.coalesce(*(F.when(c, v) for c, v in cases))


def split_sections(text: Column) -> Column:
    """array<struct(idx, heading, content)>: what follows each heading of one to four #; a text without one is one nameless section.

    What stands before the first heading is left out.
    """
    heads = F.regexp_extract_all(text, F.lit(R.HEADING), F.lit(2))
    bodies = F.slice(F.split(text, R.HEADING, -1), F.lit(2), F.greatest(F.size(heads), F.lit(1)))
    pairs = F.transform(F.arrays_zip(heads.alias("h"), bodies.alias("b")), lambda x, i: F.struct(i.alias("idx"), strip(x["h"]).alias("heading"), strip(x["b"]).alias("content")))
    return F.when(F.size(heads) > 0, pairs).otherwise(F.array(F.struct(F.lit(0).alias("idx"), F.lit("").alias("heading"), text.alias("content"))))


def once(value: Column, f) -> Column:
    """``f`` of ``value``, which has a name in it and is made once: an element of a one-element array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _literal(pattern: str) -> tuple[str, bool]:
    """The longest run of characters that every match of ``pattern`` holds, and whether holding it is all there is to a match."""
    plain = re.sub(r"\\s\+\\S\+$", "", pattern).replace("\\.", "\0")
    runs = [r.replace("\0", ".") for r in plain.split(".")]
    return max(runs, key=len), len(runs) == 1 and plain == pattern.replace("\\.", "\0")


def install_command_hit(text: Column) -> Column:
    """The snippet around the first command, in the rules' order, that a text holds; null without one.

    A text is searched for the words that commands are made of, and only patterns whose words it holds are tried: most hold
    no "install", which goes before most of the others.
    """
    patterns = F.array(*map(F.lit, R.INSTALL_COMMANDS))

    def first(low: Column, some) -> Column:
        found = []
        for i, p in enumerate(R.INSTALL_COMMANDS, 1):
            head, whole = _literal(p)
            if some(head):
                found.append(F.when(low.contains(head) if whole else low.contains(head) & low.rlike(p), F.lit(i)))
        return F.coalesce(*found)

    def snippet(low: Column, i: Column) -> Column:
        pattern = F.get(patterns, i - 1)
        at = F.regexp_instr(low, pattern) - 1
        begin = F.greatest(at - 20, F.lit(0))
        length = at + F.length(F.regexp_substr(low, pattern)) + 60 - begin
        return strip(F.translate(F.substring(text, begin + 1, length), "\n", " "))

    def search(low: Column) -> Column:
        common = "install"
        rank = F.when(low.contains(common), first(low, lambda head: True)).otherwise(first(low, lambda head: common not in head))
        return once(rank, lambda i: F.when(i.isNotNull(), snippet(low, i)))

    return once(F.lower(text), search)


def heading_tier(heading: Column, content: Column) -> Column:
    """strong or partial, where the heading reads so and the content has a set-up word; contents under ten characters never do."""
    clean = F.lower(strip(F.regexp_replace(heading, r"(?U)[^\w\s]", "")))
    counts = (F.length(content) >= 10) & holds(F.lower(content), R.SETUP_WORDS)
    return F.when(counts, F.when(holds(clean, R.STRONG_HEADINGS), "strong").when(holds(clean, R.PARTIAL_HEADINGS), "partial"))


def model_input(heading: Column, content: Column) -> Column:
    """What a scoring model reads of a section."""
    clean = F.substring(strip(F.regexp_replace(content, r"[#*`>\[\]!]", "")), 1, 1500)
    return F.when(heading != "", F.concat(heading, F.lit(": "), clean)).otherwise(clean)


def _tool(tool, doc_type, entry) -> Column:
    as_ = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_(tool).alias("tool"), as_(doc_type).alias("doc_type"), as_(entry).alias("entry_type"))


def doc_tool_by_name(path_lower: Column, basename: Column) -> Column:
    """struct(tool, doc_type, entry_type) that a configuration file's name gives away."""
    named = [(basename.isin(*names), _tool(*tool)) for names, tool in R.DOC_TOOL_NAMES.items()]
    return first_of(*named, (path_lower.isin(*R.SPHINX_PATHS), _tool("Sphinx", "sphinx docs", "generated_docs_config")))


def doc_tool_by_content(path_lower: Column, content: Column) -> Column:
    """struct(tool, doc_type, entry_type) that a pyproject.toml, conf.py or index.rst shows."""
    project = first_of(*((content.rlike(p), _tool(t, d, "generated_docs_config")) for p, t, d in R.PYPROJECT_TOOLS))
    sphinx = content.rlike(R.AUTODOC) | F.lower(content).contains("sphinx")
    myst = F.when(content.contains("myst_parser") | content.contains("myst_nb"), "sphinx docs (myst)").otherwise("sphinx docs")
    return F.coalesce(
        F.when(path_lower.endswith("pyproject.toml"), project),
        F.when((path_lower.endswith("conf.py") | path_lower.endswith("index.rst")) & sphinx, _tool("Sphinx", myst, "generated_docs_config")),
    )


def doc_page_evidence(path_lower: Column, content: Column) -> Column:
    """Does a page read as reference documentation: by its folder, or by two points of its content?"""
    html = path_lower.endswith(".html") | path_lower.endswith(".htm")
    points = [(content.rlike(R.DOC_VOCABULARY), 1), (content.rlike(R.DOC_HEADING), 1), (content.rlike(R.AUTODOC) | content.rlike(R.MYST_AUTODOC), 2), (html & content.rlike(R.HTML_INDEX), 1)]
    score = reduce(lambda a, b: a + b, (F.when(c, n).otherwise(0) for c, n in points))
    return F.coalesce((F.length(content) > 0) & (starts(path_lower, R.STRONG_DOC_FOLDERS) | (score >= 2)), F.lit(False))


def structured_comments(ext: Column, content: Column) -> Column:
    """struct(doc_type, n, strong) of a source file's documentation comments, by language; null without any. Each pattern is counted once."""
    n = lambda p: F.regexp_count(content, F.lit(p)).cast("long")
    hit = lambda kind, count, strong=True: F.struct(F.lit(kind).alias("doc_type"), count.alias("n"), (strong if isinstance(strong, Column) else F.lit(strong)).alias("strong"))
    marked = ext.isin(*R.JVM_EXTS, *R.SCRIPT_DOC_EXTS)
    own = F.when(ext == ".cs", n(R.CSHARP_DOC)).when(ext == ".go", n(R.GO_DOC)).when(ext == ".rs", n(R.RUST_DOC)).when(ext.isin(*R.C_EXTS), n(R.DOXYGEN_LINE))
    blocks = F.when(marked | ext.isin(*R.C_EXTS), n(R.STRUCTURED_BLOCK))

    def judged(x: Column) -> Column:
        either = F.when(x["blocks"] > 0, x["blocks"]).otherwise(n(R.DECLARED_BLOCK))
        return first_of(
            ((ext == ".cs") & (x["own"] > 0), hit("c# xml docs", x["own"])),
            ((ext == ".go") & (x["own"] > 0), hit("go doc comments", x["own"])),
            ((ext == ".rs") & (x["own"] >= 2), hit("rust doc comments", x["own"])),
            (marked, once(either, lambda e: F.when(e > 0, F.when(ext.isin(*R.JVM_EXTS), hit("java javadoc", e)).otherwise(hit("jsdoc/typedoc", e))))),
            (ext.isin(*R.C_EXTS) & (x["blocks"] + x["own"] > 0), hit("c++ doxygen comments", x["blocks"] + x["own"], x["blocks"] > 0)),
        )

    return once(F.struct(own.alias("own"), blocks.alias("blocks")), judged)


def package_name(path: Column, content: Column) -> Column:
    """The package that a root pyproject.toml, setup.cfg or setup.py declares."""
    names = (("pyproject.toml", R.PYPROJECT_NAME), ("setup.cfg", R.SETUP_CFG_NAME), ("setup.py", R.SETUP_PY_NAME))
    return F.nullif(F.coalesce(*(F.when(path == p, F.regexp_extract(content, x, 1)) for p, x in names)), F.lit(""))


def package_priority(path: Column) -> Column:
    return F.when(path == "pyproject.toml", 0).when(path == "setup.cfg", 1).otherwise(2)


def deprecation_reason(archived: Column, description: Column) -> Column:
    """Why a repository counts as archived; null if it does not."""
    low = F.lower(description)
    words = [(low.contains(w), F.lit(f"Description contains '{w}'")) for w in R.DEPRECATION_WORDS]
    return first_of((archived, F.lit("Repository is archived")), *words)


def last_page(link: Column, page_length: Column) -> Column:
    """How many pages a link header announces; without one, what the page itself holds."""
    return F.coalesce(F.nullif(F.regexp_extract(link, R.LAST_PAGE, 1), F.lit("")).cast("long"), page_length.cast("long"))
