"""Repository addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import HOST, PAGES_ADDRESS, REPO_ADDRESS


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def parse_repo_url(url: Column) -> Column:
    """struct(owner, repo) of a repository's or its pages' address; null for anything else. A dot ends the name."""
    trimmed = strip(url)

    def part(i: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(url, REPO_ADDRESS, i), F.lit("")), F.nullif(F.regexp_extract(trimmed, PAGES_ADDRESS, i), F.lit("")))

    return F.when(part(1).isNotNull(), F.struct(part(1).alias("owner"), part(2).alias("repo")))


def repo_key(url: Column) -> Column:
    """owner/repo in lower case: the key of all snapshot tables."""
    found = parse_repo_url(url)
    return F.lower(F.concat(found["owner"], F.lit("/"), found["repo"]))


def is_hosted(url: Column) -> Column:
    """Mentions the host at all: a looser question than whether an address can be parsed."""
    return F.coalesce(url.contains(HOST), F.lit(False))


def last_two_segments(url: Column) -> Column:
    """struct(owner, repo) as the last two parts of the path: an older reading, wrong below the repository's root."""
    parts = F.split(F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", ""), "/")
    return F.struct(F.try_element_at(parts, F.lit(-2)).alias("owner"), F.try_element_at(parts, F.lit(-1)).alias("repo"))
