"""Encoding of a corpus with a public byte-level BPE, by overlapping chunks.

Every text is cut into overlapping chunks, each pre-tokenised from its own start and apart from the others. The pattern
reads on from a boundary in one way only, and it puts a boundary before every white space that follows something else,
wherever it began to read: at the first such boundary that both neighbours see in their overlap they run in step again.
There the chunks are stitched, and the pre-tokens between are encoded. A chunk whose overlap has no such place is joined
with the next before it is read, so the ids are exact for every text and the work stays linear in its length.

One scan, no exchange: a text is one row before and one row after, so its chunks are read where the text is, and all tasks
read at once.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = "byte_bpe_50k.tiktoken"
#: Where a boundary stands wherever reading began.
STEP = re.compile(r"[^\s\x1c-\x1f][^\S\x1c-\x1f]|[\x1c-\x1f][^\S\x1c-\x1f]")
#: Ids of pre-tokens that a worker remembers before it begins anew.
MOST_CACHED = 300_000


def tokenizer_path(name: str = NAME) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoding(path: str | None = None):
    """The encoder; loaded once in each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path or tokenizer_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def chunk_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, stop) of the chunks of a text: each goes on for ``overlap`` characters into the next.

    A chunk ends only where its overlap holds a place at which both can agree; else it takes the next one in.
    """
    out, start, at = [], 0, size
    while at + overlap < len(text):
        # both must read the character that white space follows
        if STEP.search(text, at, at + overlap):
            out.append((start, at + overlap))
            start = at
        at += size
    return [*out, (start, len(text))]


def _heads(tokens: list[str], at: int, high: int) -> dict[int, int]:
    """Place where a pre-token ends -> how many go before it, for places up to ``high``; the first token begins at ``at``."""
    out = {}
    for i, token in enumerate(tokens, 1):
        at += len(token)
        if at >= high:
            break
        out[at] = i
    return out


def _tails(tokens: list[str], at: int, low: int) -> dict[int, int]:
    """The same for places after ``low``; the last token ends at ``at``."""
    out = {}
    for i in range(len(tokens) - 1, 0, -1):
        at -= len(tokens[i])
        if at <= low:
            break
        out[at] = i
    return out


class Chunked:
    """Encodes texts by overlapping chunks; remembers the ids of pre-tokens between texts."""

    def __init__(self, path: str | None = None, size: int = 1024, overlap: int = 64) -> None:
        if not 2 <= overlap < size:
            raise ValueError("the overlap must be at least 2 and less than the chunk")
        self.encode, self.size, self.overlap = encoding(path).encode_ordinary, size, overlap
        self.known: dict[str, list[int]] = {}

    def pretokens(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of the text, a list for each chunk, stitched where neighbours agree."""
        spans = chunk_spans(text, self.size, self.overlap)
        find = _pattern().findall
        first, tokens = 0, find(text[: spans[0][1]])
        for (_, end), (low, high) in zip(spans, spans[1:], strict=False):
            after = find(text[low:high])
            left, right = _tails(tokens, end, low), _heads(after, low, end)
            cut = min(p for p in left.keys() & right.keys() if STEP.match(text, p - 1))
            yield tokens[first : left[cut]]
            first, tokens = right[cut], after
        yield tokens[first:]

    def ids(self, text: str | None) -> list[int]:
        """Token ids of the text, without special tokens; empty for null and empty texts."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        if len(known) > MOST_CACHED:
            known.clear()
        for tokens in self.pretokens(text):
            for t in tokens:
                if t in known:
                    out += known[t]
                else:
                    found = self.encode(t)
                    # long runs come once
                    if len(t) <= 64:
                        known[t] = found
                    out += found
        return out


def encode_corpus(documents: DataFrame, tokenizer: str | None = None, chunk_chars: int = 1024, overlap: int = 64) -> DataFrame:
    """(doc_id, ids): token ids of each document's text, without special tokens; empty for null and empty texts.

    ``tokenizer`` is the path of the vocabulary file. One row for each row of ``documents``, also of repeated ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunked = Chunked(tokenizer, chunk_chars, overlap)
        for batch in batches:
            ids = pa.array([chunked.ids(x) for x in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(df: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``df`` with its column text replaced by n_tokens (0 for null and empty texts)."""
    names = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunked = Chunked(tokenizer)
        for batch in batches:
            n = [len(chunked.ids(x)) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(n, pa.int64())], names=[*names, "n_tokens"])

    return df.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != "text") + ", n_tokens bigint")


def decode(ids: list[int], tokenizer: str | None = None) -> str:
    """The text of token ids: their bytes are joined, then read as UTF-8."""
    return b"".join(encoding(tokenizer).decode_single_token_bytes(i) for i in ids).decode("utf-8", errors="replace")
