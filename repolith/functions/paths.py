"""What a file's path says about it."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R


def starts(path: Column, prefixes: Iterable[str]) -> Column:
    """One pattern for all of them: a small expression, however many filters and windows repeat it."""
    return path.rlike("^(?:" + "|".join(map(re.escape, prefixes)) + ")")


def holds(text: Column, words: Iterable[str]) -> Column:
    return text.rlike("|".join(map(re.escape, words)))


def ext_rsplit(basename: Column) -> Column:
    """From the last dot of the basename, dot files included; blank without a dot."""
    return F.regexp_extract(basename, r"(\.[^.]*)$", 1)


def ext_splitext(path: Column) -> Column:
    """From the last dot of the basename, unless only dots stand before it."""
    return F.regexp_extract(path, r"(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$", 1)


def path_features(files: DataFrame) -> DataFrame:
    """``files`` with path_lower, basename, ext, ext_os, depth and top (first folder, blank at the root).

    They are made by a generator of one row, into which the optimizer writes no later filter: each is computed once, where
    a projection would be repeated in every condition and window that reads it, until the code is too large to compile.
    """
    low = F.lower("path")
    base = F.substring_index(low, "/", -1)
    made = {
        "path_lower": low,
        "basename": base,
        "ext": ext_rsplit(base),
        "ext_os": ext_splitext(low),
        "depth": F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))),
        "top": F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise(F.lit("")),
    }
    return files.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in made.items())))))


def with_bucket(features: DataFrame, bucket: Column) -> DataFrame:
    """Those files of path_features that have a bucket, computed once in the same way."""
    return features.select("*", F.inline(F.array(F.struct(bucket.alias("bucket"))))).where("bucket is not null")


def readme_priority(path: Column, nested_last: bool = False) -> Column:
    """0: readme at the root; 1: other root file; 3: nested readme, if asked for; 2: other nested file."""
    low = F.lower(path)
    out = F.when(low.isin(*R.ROOT_README_NAMES), 0).when(~low.contains("/"), 1)
    if nested_last:
        out = out.when(low.contains("readme"), 3)
    return out.otherwise(2)


def is_source_file(exts: Iterable[str], skip_folders: Iterable[str] = R.SKIP_FOLDERS, skip_names: Iterable[str] = R.SKIP_NAMES) -> Column:
    """Over the columns of path_features."""
    return F.col("ext").isin(*exts) & ~starts(F.col("path_lower"), skip_folders) & ~F.col("basename").isin(*skip_names)


def preprocessing_bucket() -> Column:
    """named, folder or generic; null where the file does not count."""
    counts = ~starts(F.col("path_lower"), R.PREPROCESSING_SKIP) & F.col("ext_os").isin(*R.PREPROCESSING_EXTS)
    kind = F.when(F.col("basename").rlike(R.PREPROCESSING_NAME), "named").when(starts(F.col("path_lower"), R.PREPROCESSING_FOLDERS), "folder").otherwise("generic")
    return F.when(counts, kind)


def api_docs_bucket(rule_based: bool = True) -> Column:
    """readme (rules only), config, page or source; a documentation folder's other files are none of them."""
    named = F.col("path_lower").isin(*R.DOC_NAMES) | F.col("basename").isin(*R.DOC_NAMES)
    page = F.col("ext").isin(*R.DOC_EXTS, *(R.HTML_EXTS if rule_based else ()))
    first = F.when(F.col("basename").startswith("readme"), "readme") if rule_based else F.when(F.lit(False), "")
    in_folder = F.when(page, "page")
    return first.when(named, "config").when(starts(F.col("path_lower"), R.DOC_FOLDERS), in_folder).when(is_source_file(R.API_SOURCE_EXTS), "source")


def usage_bucket() -> Column:
    """notebook, doc or script."""
    script = F.col("ext").isin(*R.SCRIPT_EXTS)
    folder = F.when(F.col("ext").isin(*R.DOC_EXTS), "doc").when(script, "script")
    kind = F.when(F.col("ext") == ".ipynb", "notebook")
    kind = kind.when(F.col("path_lower").isin(*R.USAGE_NAMES) | F.col("basename").isin(*R.USAGE_NAMES), "doc")
    kind = kind.when(starts(F.col("path_lower"), R.EXAMPLE_FOLDERS), folder)
    return kind.when(script & holds(F.col("basename"), R.EXAMPLE_WORDS), "script")
