"""Search filters as one predicate over notes; it goes below both rankings, never above their limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.keys import normalize_tag
from ..functions.text import ascii_lower


@dataclass(frozen=True)
class SearchFilters:
    """All conditions must hold; empty ones do not count. Times are unix seconds."""

    tags: tuple[str, ...] = ()
    path_prefix: str | None = None
    status: str | None = None
    include_inbox: bool = True
    modified_after: int | None = None
    modified_before: int | None = None
    inbox: str = "_inbox"


def path_prefix(path: Column, prefix: str | None) -> Column:
    """The path begins with the prefix; A to Z compare without case, nothing is a wildcard, and it need not end at a folder."""
    wanted = (prefix or "").strip().lstrip("/")
    return ascii_lower(path).startswith(ascii_lower(F.lit(wanted))) if wanted else F.lit(True)


def has_tag(tags: Column, tag: str) -> Column:
    """The array of tags holds the tag or one below it (``ops`` is met by ``ops/backup``)."""
    wanted = normalize_tag(F.lit(tag))
    return F.coalesce(F.exists(tags, lambda t: (t == wanted) | t.startswith(F.concat(wanted, F.lit("/")))), F.lit(False))


def predicate(f: SearchFilters) -> Column:
    """The filters over columns path, tags, status and modified; null values meet no condition on them."""
    out = path_prefix(F.col("path"), f.path_prefix)
    for tag in f.tags:
        out &= has_tag(F.col("tags"), tag)
    if f.status:
        out &= F.col("status") == f.status
    if not f.include_inbox:
        out &= ~(path_prefix(F.col("path"), f.inbox + "/") | (F.coalesce(F.col("status"), F.lit("")) == "inbox"))
    if f.modified_after is not None:
        out &= F.col("modified") >= f.modified_after
    if f.modified_before is not None:
        out &= F.col("modified") < f.modified_before
    return out
