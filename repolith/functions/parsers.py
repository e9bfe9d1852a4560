"""The helper that needs a parser: Python syntax (H1). Arrow batches, one small function a row."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

DOCSTRINGS = "module int, class int, function int, param_like int, public_class_total int, public_function_total int"
_SECTIONS = re.compile(R.DOCSTRING_SECTIONS)


def _public(name: str) -> bool:
    return not name.startswith("_") or (name.startswith("__") and name.endswith("__"))


def _docstrings(source: str | None) -> dict[str, int] | None:
    if source is None:
        return None
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out = dict.fromkeys(("module", "class", "function", "param_like", "public_class_total", "public_function_total"), 0)
    for node in ast.walk(tree):
        kind = "module" if node is tree else "class" if isinstance(node, ast.ClassDef) else "function" if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef) else None
        if kind is None or (kind != "module" and not _public(node.name)):
            continue
        if kind != "module":
            out[f"public_{kind}_total"] += 1
        text = ast.get_docstring(node)
        out[kind] += bool(text)
        out["param_like"] += bool(text and _SECTIONS.search(text))
    return out


def python_docstrings(content: Column) -> Column:
    """struct of documented and public names of a Python file; null where it does not parse."""

    @F.pandas_udf(DOCSTRINGS)
    def run(texts: pd.Series) -> pd.DataFrame:
        names = [c.split()[0] for c in DOCSTRINGS.split(", ")]
        found = [_docstrings(t) for t in texts]
        return pd.DataFrame([[(x or {}).get(n) for n in names] for x in found], columns=names).astype("Int32")

    counted = run(content)
    return F.when(counted["module"].isNotNull(), counted)
