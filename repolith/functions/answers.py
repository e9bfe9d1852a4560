"""Model answers and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R
from .text import first_of
from .urls import is_hosted, parse_repo_url, strip


def overall_status(reachable: Column, archived: Column, stale: Column, *indicators: Column) -> Column:
    """One label from a repository's indicators; null indicators count as not positive."""
    positive = sum((F.when(i, 1).otherwise(0) for i in indicators), F.lit(0))
    return (
        F.when(~reachable, "NOT_ASSESSABLE")
        .when(archived, "ARCHIVED")
        .when(stale, "STALE")
        .when(positive >= 3, "ACTIVE")
        .when(positive >= 1, "MINIMAL")
        .otherwise("INACTIVE")
    )


def unfenced(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def parse_answer(raw: Column, fields: dict[str, str], lists: tuple[str, ...] = (), single: dict[str, str] | None = None) -> Column:
    """struct of ``fields`` from a model's JSON object, with evidence and parsed.

    A field's type is string, array<...>, truth (a boolean: how the value is judged, see truth()) or json (its JSON text).
    Fences go. A blank or null answer gives nulls and empty lists; one that is not an object, or has anything behind it,
    gives evidence "Parsing failed: " and its beginning. ``lists`` that are missing, null or no lists become empty; a field
    of ``single`` (old name: list) becomes a list of one, or none if it is judged no, where the list is missing. An object
    that repeats a key, and the words NaN and Infinity, are not JSON here.
    """
    text = unfenced(raw)
    # In brackets, so that a second value or words behind the first are an error.
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = text.endswith("}") & F.try_variant_get(whole, "$[1]", "variant").isNull()
    is_object = F.coalesce(alone & F.schema_of_variant(F.try_variant_get(whole, "$[0]", "variant")).startswith("OBJECT"), F.lit(False))
    blank = F.coalesce(F.length(raw) == 0, F.lit(True))
    failed = F.when(~blank & ~is_object, F.concat(F.lit(R.PARSING_FAILED), F.substring(text, 1, 200)))

    def member(name: str, as_: str = "variant") -> Column:
        return F.when(is_object, F.try_variant_get(whole, f"$[0].{name}", as_))

    out = []
    for n, t in fields.items():
        if t == "truth":
            value = truth(member(n))
        elif t == "json":
            value = F.when(~F.is_variant_null(member(n)), F.to_json(member(n)))
        else:
            value = member(n, t)
        for old, new in (single or {}).items():
            if new == n:
                value = F.when(member(n).isNull() & truth(member(old)), F.array(member(old, "string")).cast(t)).otherwise(value)
        if n in lists:
            value = F.coalesce(value, F.array().cast(t))
        if n == "evidence":
            value = F.coalesce(failed, value)
        out.append(value.alias(n))
    if "evidence" not in fields:
        out.append(failed.alias("evidence"))
    return F.struct(*out, (is_object & ~blank).alias("parsed"))


def truth(value: Column) -> Column:
    """A VARIANT as a dynamic language judges it: no are false, zero, and an empty text, list or object; null for a null or nothing.

    The type of the value decides, so that the text "false" is a yes and the boolean false a no.
    """
    kind, plain = F.schema_of_variant(value), lambda t: F.try_variant_get(value, "$", t)
    return (
        F.when(value.isNull() | F.is_variant_null(value), F.lit(None).cast("boolean"))
        .when(kind == "BOOLEAN", plain("boolean"))
        .when(kind == "STRING", plain("string") != "")
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~F.to_json(value).isin("[]", "{}"))
        .otherwise(plain("double") != 0)
    )


def verdict(url: Column, answer: Column, files: Column | None = None, none_found: str = R.NO_FILES, review: str = R.NEEDS_REVIEW, unparsed: Column | None = None) -> Column:
    """struct(status, note) of one paper: skipped, error, no (``files`` given and none found), yes or no.

    ``answer`` is what truth() made of the model's boolean.
    """
    reasons = [
        (F.coalesce(F.length(url) == 0, F.lit(True)), "skipped", F.lit(R.NO_URL)),
        (~is_hosted(url), "skipped", F.concat(F.lit(review), url)),
        (parse_repo_url(url).isNull(), "error", F.lit(R.NOT_PARSED) if unparsed is None else unparsed),
        *([(F.coalesce(files, F.lit(0)) == 0, "no", F.lit(none_found))] if files is not None else []),
        (answer.isNull(), "error", F.lit(R.EMPTY_ANSWER)),
        (answer, "yes", F.lit("")),
        (~answer, "no", F.lit("")),
    ]
    return _status(reasons)


def class_verdict(url: Column, found_class: Column, reason: Column, files: Column | None = None) -> Column:
    """verdict() of an answer that names a class: EXISTS is yes, any other no, with the model's reason. An address that
    cannot be read is skipped."""
    return _status(
        [
            (F.coalesce(F.length(url) == 0, F.lit(True)), "skipped", F.lit(R.NO_URL)),
            (parse_repo_url(url).isNull(), "skipped", F.concat(F.lit(R.NEEDS_REVIEW), url)),
            *([(F.coalesce(files, F.lit(0)) == 0, "no", F.lit(R.NO_FILES_RETRIEVABLE))] if files is not None else []),
            (found_class.isNull(), "error", F.lit(R.EMPTY_ANSWER)),
            (found_class == "EXISTS", "yes", reason),
            (F.lit(True), "no", reason),
        ]
    )


def _status(reasons: list[tuple[Column, str, Column]]) -> Column:
    return first_of(*((c, F.struct(F.lit(s).alias("status"), n.alias("note"))) for c, s, n in reasons))


def file_link(owner: Column, name: Column, path: Column) -> Column:
    return F.concat(F.lit(R.FILE_ADDRESS[0]), owner, F.lit("/"), name, F.lit(R.FILE_ADDRESS[1]), path)


def file_entries(json: Column, parts: dict[str, str], single: Column | None = None) -> Column:
    """array<struct(path, ``parts``)> from a JSON list of objects; a part that lacks gets its value in ``parts``.

    Where the list is empty, the path in ``single`` is its only entry. A part named commands is a list; one command may
    stand alone. Anything but a list of objects gives no entries.
    """
    entry = ", ".join(f"`{n}`: string" for n in ("path", *parts))
    listed = F.coalesce(F.from_json(json, f"array<struct<{entry}>>"), F.array().cast(f"array<struct<{entry}>>"))
    if single is not None:
        alone = F.array(F.struct(single.alias("path"), *(F.lit(v).alias(n) for n, v in parts.items())))
        listed = F.when((F.size(listed) == 0) & (single != ""), alone).otherwise(listed)

    def part(e: Column, n: str, lacking: str) -> Column:
        if n != "commands":
            return F.coalesce(e[n], F.lit(lacking))
        alone = F.when(F.coalesce(e[n], F.lit("")) != "", F.array(e[n])).otherwise(F.array().cast("array<string>"))
        return F.coalesce(F.from_json(e[n], "array<string>"), alone)

    whole = F.filter(listed, lambda e: e.isNotNull())
    return F.transform(whole, lambda e: F.struct(F.coalesce(e["path"], F.lit("")).alias("path"), *(part(e, n, v).alias(n) for n, v in parts.items())))


def with_links(entries: Column, owner: Column, name: Column) -> Column:
    """``entries`` of file_entries() whose trimmed path is not blank, with a link."""
    trimmed = F.transform(entries, lambda e: e.withField("path", strip(e["path"])))
    return F.transform(F.filter(trimmed, lambda e: e["path"] != ""), lambda e: e.withField("link", file_link(owner, name, e["path"])))


def truth_label(value: Column) -> Column:
    """A hand-written label as a boolean; null where it says neither."""
    low = F.lower(strip(value))
    return F.when(low.isin(*R.POSITIVE_LABELS), True).when(low.isin(*R.NEGATIVE_LABELS), False)


def normalise_entries(json: Column) -> Column:
    """array<struct(path, category, evidence)> from a JSON list of objects or bare paths; entries without a path go."""
    items = F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))
    entry = "path string, category string, evidence string"

    def one(x: Column) -> Column:
        is_object = F.substring(F.ltrim(x), 1, 1) == "{"
        read = F.from_json(F.when(is_object, x), entry)
        blank = lambda c: F.coalesce(strip(c), F.lit(""))
        return F.struct(F.when(is_object, blank(read["path"])).otherwise(blank(x)).alias("path"), F.lower(blank(read["category"])).alias("category"), blank(read["evidence"]).alias("evidence"))

    return F.filter(F.transform(items, one), lambda e: e["path"] != "")


def indicator_text(value: Column, detail: Column) -> Column:
    """N/A, Yes or No, with the detail if there is one."""
    label = F.when(value, "Yes").otherwise("No")
    return F.when(value.isNull(), "N/A").when(F.coalesce(detail, F.lit("")) != "", F.concat(label, F.lit(" — "), detail)).otherwise(label)


def fill_display(frame: DataFrame, sentinel: str, *columns: str) -> DataFrame:
    """Nulls as the check's own words, in text columns: the last step before people read a table."""
    return frame.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(sentinel)) for c in columns})


def keep_second_pass(first: Column, second: Column) -> Column:
    """A second reading of the named files counts only where the first found nothing and it does."""
    return F.when((first == "NOT_APPLICABLE") & (second == "EXISTS"), second).otherwise(first)
