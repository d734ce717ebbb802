"""Link keys, path keys and tags as Column expressions (all inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at both ends, Unicode-aware.
ENDS = r"(?U)^\s+|\s+$"


def strip(x: Column) -> Column:
    """``x`` without white space of any kind at its ends."""
    return F.regexp_replace(x, ENDS, "")


def link_key(x: Column) -> Column:
    """The form in which references and paths are compared.

    Trimmed, backslash as slash, all leading dots and slashes cut, lower case, a final ``.md`` cut. Null stays null;
    blank values become the empty string.
    """
    slashed = F.translate(strip(x), "\\", "/")
    return F.regexp_replace(F.lower(F.regexp_replace(slashed, r"^[./]+", "")), r"\.md$", "")


def suffix_keys(key: Column) -> Column:
    """All keys by which a path can be called: the whole key, then without its first segment, and so on to the last one."""
    parts = F.split(key, "/")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "/"))


def normalize_tag(x: Column) -> Column:
    """A tag trimmed, freed of leading ``#``, trimmed again, in lower case."""
    return F.lower(strip(F.regexp_replace(strip(x), r"^#+", "")))
