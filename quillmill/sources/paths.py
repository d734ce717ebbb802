"""Paths and kinds of vault files as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders that are never read, and the kinds of documents by suffix.
IGNORED = (".git", ".obsidian", ".trash")
DOCUMENTS = ("pdf", "docx", "html", "htm")


def suffix(path: Column) -> Column:
    """The suffix in lower case, without its dot; empty where there is none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"[^.]\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def kind_of(path: Column) -> Column:
    """``md``, ``pdf``, ``docx``, ``html`` (also for .htm) or another suffix."""
    end = suffix(path)
    return F.when(end == "htm", "html").otherwise(end)


def is_markdown(path: Column) -> Column:
    return suffix(path) == "md"


def is_document(path: Column) -> Column:
    return suffix(path).isin(*DOCUMENTS)


def is_indexable(path: Column) -> Column:
    """Markdown or a document, with no ignored folder anywhere in its path."""
    return (is_markdown(path) | is_document(path)) & ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in IGNORED]))


def normalize_path(path: Column) -> Column:
    """A relative path with forward slashes and no empty or ``.`` parts; null where it is no valid path.

    Invalid are null, empty, absolute and drive paths, ``..`` parts, NUL characters and ignored root folders.
    """
    slashed = F.translate(path, "\\", "/")
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    bad = slashed.startswith("/") | slashed.rlike("^[A-Za-z]:") | slashed.contains("\x00") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad & ~F.try_element_at(parts, F.lit(1)).isin(*IGNORED), F.array_join(parts, "/"))
