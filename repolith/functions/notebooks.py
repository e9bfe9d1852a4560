"""Notebooks as text (H2): cells of their JSON, flattened inside the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

#: Where a dynamic language ends a line, and what it takes for white space.
_LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
_SPACE = r"\s\x1C-\x1F"
_SAID = rf"(?U)[^{_SPACE}]"


def is_notebook(path: Column) -> Column:
    return F.lower(path).endswith(R.NOTEBOOK_EXT)


def _text(cell: Column, field: str) -> Column:
    """A cell's field that is a text or a list of texts, as one text; null for anything else."""
    value = F.try_variant_get(cell, f"$.{field}", "variant")
    kind = F.schema_of_variant(value)
    joined = F.array_join(F.try_variant_get(value, "$", "array<string>"), "")
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind.startswith("ARRAY"), joined)


def _cells(parsed: Column) -> Column:
    """array<struct(i, kind, source)> of the cells whose source says something, i counting all cells; null if there is no list of cells."""
    cells = F.try_variant_get(parsed, "$.cells", "array<variant>")
    each = F.transform(cells, lambda c, i: F.struct(i.alias("i"), F.try_variant_get(c, "$.cell_type", "string").alias("kind"), _text(c, "source").alias("source")))
    return F.filter(each, lambda c: F.coalesce(c["source"].rlike(_SAID), F.lit(False)))


def _flat(parsed: Column) -> Column:
    """Code cells as they are and prose as comments, each under a line with its number; null if there are none."""

    def block(c: Column) -> Column:
        lines = F.filter(F.split(F.regexp_replace(c["source"], rf"(?U)^[{_SPACE}]+|[{_SPACE}]+$", ""), _LINE_END, -1), lambda line: line.rlike(_SAID))
        prose = F.array_join(F.transform(lines, lambda line: F.concat(F.lit("# "), line)), "\n")
        head = F.concat(F.lit(R.CELL_HEAD[0]), c["i"].cast("string"), F.lit(" ("), c["kind"], F.lit(R.CELL_HEAD[1]))
        return F.concat(head, F.lit("\n"), F.when(c["kind"] == "code", c["source"]).otherwise(prose))

    shown = F.transform(F.filter(_cells(parsed), lambda c: c["kind"].isin("code", "markdown")), block)
    # An element of a one-element array has a name in what follows, and is made once.
    return F.get(F.transform(F.array(shown), lambda b: F.when(F.size(b) > 0, F.array_join(b, "\n\n"))), F.lit(0))


def flatten_notebook(raw: Column) -> Column:
    """What a notebook's code and markdown cells say, without its outputs; text that is no notebook, or has no such cell, stays.

    A source may be a text or a list of texts. Cells are numbered from 0, whatever they hold. The words NaN and Infinity,
    which JSON has not, make a file no notebook.
    """
    return F.coalesce(_flat(F.try_parse_json(raw)), raw)


def usage_text(raw: Column) -> Column:
    """flatten_notebook(), but nothing for an object without such cells: what is left to show of a notebook as an example."""
    parsed = F.try_parse_json(raw)
    return F.coalesce(_flat(parsed), F.when(F.schema_of_variant(parsed).startswith("OBJECT"), ""), raw)


def summarise_notebook(raw: Column, limit: int = R.NOTEBOOK_CAP) -> Column:
    """Code, short text outputs and prose of a raw notebook, cut to ``limit`` characters; text that is no JSON object is only cut."""
    parsed = F.try_parse_json(raw)
    cells = F.coalesce(F.try_variant_get(parsed, "$.cells", "array<variant>"), F.array().cast("array<variant>"))

    def blocks(c: Column) -> Column:
        kind, source = F.try_variant_get(c, "$.cell_type", "string"), _text(c, "source")
        outputs = F.transform(F.try_variant_get(c, "$.outputs", "array<variant>"), lambda o: _text(o, "text"))
        short = F.transform(F.filter(outputs, lambda o: (F.length(o) > 0) & (F.length(o) < R.OUTPUT_CAP)), lambda o: F.concat(F.lit("[OUTPUT]\n"), o))
        own = F.array(F.concat(F.lit("["), F.upper(kind), F.lit("]\n"), source))
        more = F.when(kind == "code", F.coalesce(short, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
        return F.when(kind.isin("code", "markdown") & source.rlike(_SAID), F.concat(own, more)).otherwise(F.array().cast("array<string>"))

    said = F.array_join(F.flatten(F.transform(cells, blocks)), "\n\n")
    return F.substring(F.when(F.schema_of_variant(parsed).startswith("OBJECT"), said).otherwise(raw), 1, limit)
