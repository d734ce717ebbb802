"""Splitting oversized items at natural boundaries, with overlap.

Every possible cut of a text has a strength (paragraph, line, sentence, clause, word). A sparse table over the strengths
answers "the strongest cut in this window, the rightmost of equals" in constant time; the next piece starts ``overlap``
characters before the cut. Null text is no item; an empty text with oversized headings gives one piece.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a text may be cut (at the end of the match), and how strong the cut is.
CUTS = [(re.compile(r"\s"), 1), (re.compile(r"[,;:]\s+"), 2), (re.compile(r"[.!?…]+[\"'»”’)\]]*\s+"), 3), (re.compile(r"\n"), 4), (re.compile(r"\n[ \t]*\n\s*"), 5)]
PIECES = "chunk_id bigint, piece int, start int, stop int, headings array<string>, text string, content string"


class StrongestCut:
    """Range-maximum index over boundary strengths; ties go to the right."""

    def __init__(self, text: str) -> None:
        strength: dict[int, int] = {}
        for pattern, value in CUTS:
            for m in pattern.finditer(text):
                strength[m.end()] = value
        self.at = np.array(sorted(strength), dtype=np.int64)
        # strength first, place second: the maximum is the strongest cut, and of equals the rightmost
        rank = np.array([strength[p] for p in self.at.tolist()], dtype=np.int64) * (len(text) + 1) + self.at
        self.width = len(text) + 1
        self.levels = [rank]
        step = 1
        while 2 * step <= len(rank):
            below = self.levels[-1]
            self.levels.append(np.maximum(below[:-step], below[step:]))
            step *= 2

    def best(self, low: int, high: int) -> int | None:
        """The strongest cut at low <= place <= high, or None."""
        i, j = int(np.searchsorted(self.at, low)), int(np.searchsorted(self.at, high, "right"))
        if i >= j:
            return None
        level = (j - i).bit_length() - 1
        table = self.levels[level]
        return int(max(table[i], table[j - (1 << level)]) % self.width)


def spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, stop) of the pieces of ``text``: each at most ``limit`` long, each after the first repeats ``overlap`` characters.

    The strongest cut in the second half of the window is taken; where that holds none, the strongest of the rest of the
    permissible window; only where there is none at all is a text cut inside a run.
    """
    if not 0 <= 2 * overlap < limit:
        raise ValueError("the limit must be more than twice the overlap")
    if len(text) <= limit:
        return [(0, len(text))]
    index, out, start = StrongestCut(text), [], 0
    while len(text) - start > limit:
        first, low, high = start + overlap + 1, start + max(overlap + 1, limit // 2), start + limit
        cut = index.best(low, high) or index.best(first, low - 1)
        if cut is None:  # no natural boundary: as late as possible, but not before a combining mark
            cut = high
            while cut > first and (unicodedata.combining(text[cut]) or text[cut] in "\u200d\ufe0f" or text[cut - 1] == "\u200d"):
                cut -= 1
        out.append((start, cut))
        start = cut - overlap
    return [*out, (start, len(text))]


def fitting_headings(headings: list[str] | None, room: int) -> list[str]:
    """The headings whose joined form and its two line breaks have at most ``room`` characters.

    Where they have more, the longest are shortened alike, each to its beginning and an ellipsis, so that no level is lost;
    where even the levels' separators do not fit, outer levels go.
    """
    kept = [h for h in headings or [] if h is not None]
    while kept and 5 * len(kept) > room:
        kept = kept[1:]
    free = room - 2 - 3 * (len(kept) - 1)
    if sum(map(len, kept)) <= free:
        return kept
    # the largest length to which all longer headings can be cut
    most, rest = free, sorted(map(len, kept))
    for i, n in enumerate(rest):
        most = free // (len(rest) - i)
        if n > most:
            break
        free -= n
    return [h if len(h) <= most else h[: most - 1] + "…" for h in kept]


def item_size(headings: Column, text: Column) -> Column:
    """Characters of text, plus those of the joined headings and two line breaks where there are headings."""
    return F.length(text) + F.when(F.size(headings) > 0, F.length(F.array_join(headings, " > ")) + 2).otherwise(0)


def split_items(chunks: DataFrame, max_chars: int = 1500, overlap: int = 150, once: bool = True) -> DataFrame:
    """Pieces of every chunk whose headings and text exceed ``max_chars``, and of no other.

    ``content`` (headings, two line breaks, text) has at most ``max_chars`` characters. Headings that leave less than two
    overlaps and a character of room for text are shortened (see fitting_headings). Rows that repeat an id with the same
    headings and text count once, or with ``once=False``, which spares the exchange of the texts, as often as they come.
    Other columns of ``chunks`` are ignored.
    """
    over = chunks.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "headings", "text").filter(F.col("text").isNotNull() & (item_size(F.col("headings"), F.col("text")) > max_chars))
    if once:
        over = over.dropDuplicates(["chunk_id", "headings", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                kept = fitting_headings(row["headings"], max_chars - 2 * overlap - 1)
                head = " > ".join(kept) + "\n\n" if kept else ""
                for i, (a, b) in enumerate(spans(row["text"], max_chars - len(head), overlap)):
                    part = row["text"][a:b]
                    rows.append((row["chunk_id"], i, a, b, kept, part, head + part))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string()))],
                names=["chunk_id", "piece", "start", "stop", "headings", "text", "content"],
            )

    return over.mapInArrow(cut, PIECES)
