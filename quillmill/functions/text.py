"""Text functions: accent folding, tokens, query terms, slugs, times, hashes. Python only where Spark has no equivalent."""

from __future__ import annotations

import datetime as dt
import unicodedata
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One token of the index, one token of a query, longest slug.
TOKEN = r"[\p{L}\p{N}]+"
QUERY_TOKEN = r"(?U)\w+"
SLUG_CHARS = 60


def _fold(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


@F.arrow_udf(T.StringType())
def strip_accents(column: pa.Array) -> pa.Array:
    """Text without combining marks (canonical decomposition, marks dropped); null stays null. ASCII passes untouched."""
    return pa.array([_fold(x) for x in column.to_pylist()], pa.string())


def tokens(text: Column) -> Column:
    """The index tokens of a text: accents stripped, lower case, runs of letters and digits. Null gives an empty array."""
    return F.regexp_extract_all(F.lower(strip_accents(F.coalesce(text, F.lit("")))), F.lit(TOKEN), F.lit(0))


def query_terms(query: Column) -> Column:
    """Distinct terms of a query in order: lower case, longer than one character or digits; null gives an empty array."""
    words = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(QUERY_TOKEN), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) | w.rlike(r"^\d+$")))


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


@F.arrow_udf(T.StringType())
def _ascii(column: pa.Array) -> pa.Array:
    out = [None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode() for x in column.to_pylist()]
    return pa.array(out, pa.string())


def slugify(title: Column, longest: int = SLUG_CHARS) -> Column:
    """A file name part of a title: umlauts spelt out, ASCII letters and digits joined by ``-``, cut at the last ``-``.

    An empty result becomes ``note``; null counts as empty.
    """
    spelt = F.lower(F.coalesce(title, F.lit("")))
    for letter, two in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        spelt = F.replace(spelt, F.lit(letter), F.lit(two))
    slug = F.regexp_replace(F.regexp_replace(_ascii(spelt), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    head = F.substring(slug, 1, longest)
    cut = F.when(F.instr(head, "-") > 0, F.regexp_replace(head, "-[^-]*$", "")).otherwise(head)
    short = F.when(F.length(slug) > longest, cut).otherwise(slug)
    return F.when(short == "", "note").otherwise(short)


def iso_time(seconds: Column, zone: str) -> Column:
    """Unix seconds as ISO 8601 text in ``zone`` with its offset."""
    local = F.from_utc_timestamp(F.timestamp_seconds(seconds), zone)
    utc = F.timestamp_seconds(seconds)
    minutes = ((F.unix_timestamp(local) - F.unix_timestamp(utc)) / 60).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    offset = F.concat(sign, F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def parse_time(text: str, zone: str) -> int:
    """Unix seconds of an ISO 8601 date or time; one without an offset is in ``zone``. Anything else is a ValueError."""
    at = dt.datetime.fromisoformat(text.strip())
    return int((at if at.tzinfo else at.replace(tzinfo=ZoneInfo(zone))).timestamp())


def content_sha(content: Column) -> Column:
    """SHA-256 of bytes or text, in hex."""
    return F.sha2(content.cast("binary"), 256)


def ascii_lower(x: Column) -> Column:
    """Only A to Z in lower case, as prefix comparisons want it (other letters keep their case)."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
