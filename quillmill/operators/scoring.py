"""What BM25 is made of at size: counts of the asked phrases in each chunk as compact rows, and the best of each query.

Texts never go through an exchange: they are tokenised and counted where they are read, and only the counts of asked
phrases go on. Queries are scored in groups, each over a few parts of the counts, and a task keeps no more than the k best of
each query, so that what comes out is bounded by queries times k times parts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

#: Scores that agree to so many digits are ties; the smaller id goes first.
DIGITS, NEAR = 9, 2e-9
#: Chunks and postings that are scored at once, and kept scores of a task.
CHUNKS, POSTED, KEPT = 32_768, 2_000_000, 4_000_000
COUNTS = "size int, ids array<int>, f array<double>"


class Phrases:
    """Asked phrases by number; finds them in token lists."""

    def __init__(self, phrases: list[str]) -> None:
        split = [p.split(" ") for p in phrases]
        self.words = pa.array(sorted({w for ws in split for w in ws}), pa.string())
        number = {w: i for i, w in enumerate(self.words.to_pylist())}
        self.single = np.full(len(number) + 1, -1, np.int64)
        self.several: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
        for i, ws in enumerate(split):
            if len(ws) == 1:
                self.single[number[ws[0]]] = i
            else:
                n = [number[w] for w in ws]
                self.several[n[0] * len(number) + n[1]].append((i, n))
        self.pairs = np.array(sorted(self.several), np.int64)

    def found(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, phrase) of every occurrence in the rows' tokens."""
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        at = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=self.words), -1)).astype(np.int64)
        row = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
        own = self.single[at]
        rows, phrases = [row[own >= 0]], [own[own >= 0]]
        if len(self.pairs) and len(at) > 1:
            pair = np.where((at[:-1] >= 0) & (at[1:] >= 0) & (row[:-1] == row[1:]), at[:-1] * len(self.words) + at[1:], -1)
            starts = np.flatnonzero(np.isin(pair, self.pairs))
            order = np.argsort(pair[starts], kind="stable")
            starts = starts[order]
            keys, first = np.unique(pair[starts], return_index=True)
            for key, s in zip(keys.tolist(), np.split(starts, first[1:]) if len(keys) else [], strict=True):
                for i, words in self.several[key]:
                    here = s[s + len(words) <= len(at)]
                    here = here[row[here] == row[here + len(words) - 1]]
                    for j, w in enumerate(words[2:], 2):
                        here = here[at[here + j] == w]
                    rows.append(row[here])
                    phrases.append(np.full(len(here), i, np.int64))
        return np.concatenate(rows), np.concatenate(phrases)


def _lists(n: int, row: np.ndarray, phrase: np.ndarray, weight: np.ndarray, number: int) -> tuple[pa.Array, pa.Array]:
    """Of each of n rows the phrases in order, and their summed weights."""
    key, at = np.unique(row * number + phrase, return_inverse=True)
    f = np.bincount(at, weight, len(key))
    offsets = pa.array(np.searchsorted(key, np.arange(n + 1) * number).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array((key % number).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(f))


def counted(df: DataFrame, phrases: list[str], columns: dict[str, tuple[Column, float]]) -> DataFrame:
    """``df`` without the text columns but with COUNTS: tokens in all, numbers of asked phrases, weighted counts."""
    keep = [c for c in df.columns if c not in columns]
    shared = df.sparkSession.sparkContext.broadcast(phrases)
    names, weights = [f"tokens_{c}" for c in columns], [w for _, w in columns.values()]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value)
        number = max(1, len(shared.value))
        for b in batches:
            size = np.zeros(b.num_rows, np.int32)
            got: list[tuple[np.ndarray, ...]] = []
            for name, weight in zip(names, weights, strict=True):
                lists = b.column(name)
                size += np.asarray(pc.list_value_length(lists)).astype(np.int32)
                row, phrase = phrases.found(lists)
                got.append((row, phrase, np.full(len(row), weight)))
            ids, f = _lists(b.num_rows, *(np.concatenate(x) for x in zip(*got, strict=True)), number)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(size), ids, f], names=[*keep, "size", "ids", "f"])

    return df.select(*keep, *[tokens(x).alias(n) for n, (x, _) in zip(names, columns.values(), strict=True)]).mapInArrow(run, f"{schema}, {COUNTS}")


def merged(joined: DataFrame, number: int) -> DataFrame:
    """(chunk_id, wanted, size, ids, f): a chunk's own counts and its title's (title_size, title_ids, title_f) as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, phrase, f = (np.concatenate(x) for x in zip(*(_flat(b, i, f) for i, f in (("title_ids", "title_f"), ("ids", "f"))), strict=True))
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), b.column("wanted"), pc.add(b.column("size"), b.column("title_size")), *_lists(b.num_rows, row, phrase, f, max(1, number))], names=["chunk_id", "wanted", "size", "ids", "f"])

    return joined.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "wanted", "size", "ids", "f", "title_size", "title_ids", "title_f").mapInArrow(run, f"chunk_id bigint, wanted boolean, {COUNTS}")


def _flat(b: pa.RecordBatch, ids: str, f: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, phrase, count) of a batch's lists."""
    row = np.repeat(np.arange(b.num_rows), np.asarray(pc.list_value_length(b.column(ids))))
    return row, np.asarray(b.column(ids).flatten()).astype(np.int64), np.asarray(b.column(f).flatten())


def statistics(counts: DataFrame, number: int) -> tuple[int, int, np.ndarray]:
    """(chunks, tokens, chunks with each phrase) of all counts, whatever is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, df = 0, 0, np.zeros(number, np.int64)
        for b in batches:
            n += b.num_rows
            total += pc.sum(b.column("size")).as_py() or 0
            df += np.bincount(_flat(b, "ids", "f")[1], minlength=number)
        here = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, here].astype(np.int64)), pa.array(np.r_[n, total, df[here]].astype(np.int64))], names=["i", "n"])

    got = {r["i"]: r["n"] for r in counts.select("size", "ids", "f").mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    return got.get(-2, 0), got.get(-1, 0), np.array([got.get(i, 0) for i in range(number)], np.int64)


class Best:
    """The k best chunks of each query so far; without k, every chunk with a score comes out at once."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, terms: np.ndarray, k: int | None) -> None:
        """``ids`` of the queries; query i asks ``terms[starts[i]:starts[i + 1]]``."""
        self.ids, self.starts, self.terms, self.k = ids, starts, terms, k
        self.asked = [terms[a:b].tolist() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        if k is not None:
            self.score, self.chunk = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def add(self, chunks: np.ndarray, at: np.ndarray, phrase: np.ndarray, weight: np.ndarray, number: int) -> Iterator[pa.RecordBatch]:
        """Score ``chunks``, of which ``chunks[at]`` holds ``phrase`` with ``weight``."""
        order = np.argsort(phrase, kind="stable")
        at, weight = at[order], weight[order]
        bounds = np.r_[0, np.cumsum(np.bincount(phrase, minlength=number))]
        held: list[tuple[np.ndarray | None, np.ndarray] | None] = [None] * number
        most = np.zeros(number)
        size = len(chunks)
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            a, w = at[bounds[p] : bounds[p + 1]], weight[bounds[p] : bounds[p + 1]]
            most[p] = w.max()
            if len(a) * 8 > size:  # adding in whole is quicker than adding at places
                whole = np.zeros(size)
                whole[a] = w
                held[p] = (None, whole)
            else:
                held[p] = (a, w)
        # no score is above the sum of its terms' greatest parts
        sums = np.r_[0.0, np.cumsum(most[self.terms])]
        above = sums[self.starts[1:]] - sums[self.starts[:-1]]
        tasks = np.flatnonzero(above > 0) if self.k is None else np.flatnonzero((above > 0) & (above * (1 + 1e-9) + NEAR >= self.score[:, -1]))
        score = np.zeros(size)
        groups = size // (4 * self.k) if self.k else 0
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        waiting = 0
        for q in tasks.tolist():
            score[:] = 0
            for t in self.asked[q]:
                if (x := held[t]) is not None:
                    if x[0] is None:
                        score += x[1]
                    else:
                        score[x[0]] += x[1]
            if self.k is None:
                use = np.flatnonzero(score > 0)
                out.append((q, use, score[use]))
                waiting += len(use)
                if waiting >= 1_000_000:
                    yield self._rows(out, chunks)
                    out, waiting = [], 0
                continue
            least = self.score[q, -1]
            if least == -np.inf and groups > 1:  # the k-th of some parts' best is no better than the k-th of all
                parts = score[: groups * 4 * self.k].reshape(4 * self.k, groups).max(1)
                least = np.partition(parts, -self.k)[-self.k]
            near = np.flatnonzero(score >= least - NEAR) if least > NEAR else np.flatnonzero(score > 0)
            if not len(near):
                continue
            found, chunk = np.r_[self.score[q], score[near]], np.r_[self.chunk[q], chunks[near]]
            best = np.lexsort((chunk, -np.round(found, DIGITS)))[: self.k]
            self.score[q], self.chunk[q] = found[best], chunk[best]
        if out:
            yield self._rows(out, chunks)

    def _rows(self, out: list[tuple[int, np.ndarray, np.ndarray]], chunks: np.ndarray) -> pa.RecordBatch:
        qids = np.repeat(self.ids[[q for q, _, _ in out]], [len(u) for _, u, _ in out])
        return pa.RecordBatch.from_arrays([pa.array(qids), pa.array(chunks[np.concatenate([u for _, u, _ in out])]), pa.array(np.concatenate([s for _, _, s in out]))], names=["qid", "chunk_id", "score"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What has been kept, some queries at a time."""
        for i in range(0, len(self.ids) if self.k is not None else 0, 10_000):
            s, c = self.score[i : i + 10_000], self.chunk[i : i + 10_000]
            use = s > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids[i : i + 10_000], use.sum(1))), pa.array(c[use]), pa.array(s[use])], names=["qid", "chunk_id", "score"])


def plan(spark, queries: int, pairs: int, k: int | None, asked: int) -> tuple[int, int]:
    """(groups of queries, parts of the chunks): about two tasks a core, of few parts, as each part gives k rows a query."""
    tasks = 2 * max(1, spark.sparkContext.defaultParallelism)
    groups = min(16, max(1, round(tasks**0.5)), max(1, queries // 1000))
    groups = max(groups, -(-pairs // asked), -(-queries * (k or 1) // KEPT))
    return groups, max(1, -(-tasks // groups))


def best_scores(counts: DataFrame, qid: np.ndarray, term: np.ndarray, idf: np.ndarray, mean: float, k: int | None, k1: float, b: float, groups: int) -> DataFrame:
    """(qid, chunk_id, score) from ``counts`` (chunk_id, size, ids, f), for the (qid, term) pairs given; a repeated pair counts again."""
    number, spark = max(1, len(idf)), counts.sparkSession
    ids, of = np.unique(qid, return_inverse=True)
    order = np.lexsort((term, of))
    of, term = of[order], term[order]
    starts = np.searchsorted(of, np.arange(len(ids) + 1))
    parts = None
    for g in np.array_split(np.arange(len(ids)), min(groups, max(1, len(ids)))):
        low, high = (int(starts[g[0]]), int(starts[g[-1] + 1])) if len(g) else (0, 0)
        mine = starts[g[0] : g[-1] + 2] - low if len(g) else np.zeros(1, np.int64)
        shared = spark.sparkContext.broadcast((ids[g], mine, term[low:high], idf))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, starts, terms, idf = shared.value
            best = Best(own, starts, terms, k)
            asked = np.zeros(number, bool)
            asked[terms] = True
            held: list[tuple[np.ndarray, ...]] = []
            chunks = posted = 0

            def block() -> Iterator[pa.RecordBatch]:
                chunk = np.concatenate([x[0] for x in held])
                at = np.concatenate([x[1] + i for x, i in zip(held, np.cumsum([0, *(len(x[0]) for x in held[:-1])]), strict=True)])
                yield from best.add(chunk, at, np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held]), number)

            for b_ in batches:
                for i in range(0, b_.num_rows, CHUNKS):
                    part = b_.slice(i, CHUNKS)
                    row, phrase, f = _flat(part, "ids", "f")
                    use = asked[phrase]
                    row, phrase, f = row[use], phrase[use], f[use]
                    size = np.asarray(part.column("size"))[row]
                    weight = idf[phrase] * (f * (k1 + 1) / (f + k1 * (1 - b + b * size / mean)))
                    held.append((np.asarray(part.column("chunk_id")), row, phrase, weight))
                    chunks, posted = chunks + part.num_rows, posted + len(row)
                    if chunks >= CHUNKS or posted >= POSTED:
                        yield from block()
                        held.clear()
                        chunks = posted = 0
            if chunks:
                yield from block()
            yield from best.rest()

        one = counts.mapInArrow(run, "qid bigint, chunk_id bigint, score double")
        parts = one if parts is None else parts.unionByName(one)
    return parts
