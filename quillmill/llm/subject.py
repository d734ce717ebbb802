"""The subject areas of each document, from labelling functions whose accuracies a latent model learns.

Four labelling functions vote on every sentence: its words (lexicon), the other sentences and the heading of its section,
the source of the document, and its addresses (words of hosts and paths of the links in the text, and the folders of its
path). Votes are a subject, *none* or *open*. The latent model holds, for each function, how often it gives each vote when
a sentence truly deals with each subject or with none; it is learned by expectation-maximisation from the votes
themselves. A sentence's posterior follows from its four votes; it deals with a subject whose posterior is at least a
half, and a document with those that at least a quarter of its sentences deal with.

The lexicon and the model are fitted on all documents and all labels. Texts are cut into sentences once and written as
blocks; each step of the fit is one pass over the blocks, whose counts are exchanged by key (word, source, address word or
pattern of votes) and filtered there. What comes to the driver are the words, sources and address words that speak for a
subject, and the distinct patterns of votes with their numbers.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .prose import BREAK, END, OVER, WORD, sectioned
from .sample import hashed_sample

#: Tokens or keys that a task holds at once, and texts and characters from which on a block is full.
MOST_CACHED, BLOCK, BLOCK_CHARS = 300_000, 256, 4_000_000
#: A sentence counts if it has this many words.
LEAST_WORDS = 3
#: A label's weight is shared among its document's labels in whole parts of this (the least multiple of 1 to 16), so sums are exact.
WHOLE = 720_720
FUNCTIONS = ("lexicon", "section", "source", "address")
LINKED = re.compile(r"(?:https?://|www\.)(\S+)")


@dataclass
class Model:
    """What the corpus taught: word weights, what sources and folders stand for, and each vote's likelihood."""

    subjects: list[str]
    lexicon: dict[str, np.ndarray]
    source: dict[str, int]
    address: dict[str, int]
    prior: np.ndarray
    votes: list[np.ndarray]  # for each function (true class, vote)
    coverage: list[float]  # of each function, the share of the corpus's sentences on which it votes for a subject

    @property
    def none(self) -> int:
        return len(self.subjects)

    def functions(self) -> list[tuple[str, float, float, float]]:
        """(function, coverage, accuracy of its votes for subjects, accuracy of its votes for none), as the model learned them."""
        n, out = self.none, []
        for name, table, seen in zip(FUNCTIONS, self.votes, self.coverage, strict=True):
            joint = self.prior[:, None] * table
            out.append((name, seen, float(np.trace(joint[:n, :n]) / joint[:, :n].sum()), float(joint[n, n] / joint[:, n].sum())))
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """(sentences, subjects and none) from the (sentences, functions) votes."""
        log = np.log(self.prior)[None, :].repeat(len(votes), 0)
        for i, table in enumerate(self.votes):
            log += np.log(table[:, votes[:, i]]).T
        p = np.exp(log - log.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


@dataclass
class Block:
    """Some texts as the sentences that all passes read in their place."""

    ids: list[int | None]
    sources: list[str | None]
    addresses: list[list[str]]
    labels: list[list[int]]
    words: list[str]  # the distinct words
    word: np.ndarray  # of each occurrence, the number of its word
    span: np.ndarray  # of each sentence, its occurrences, its text, its section, and whether it is a heading
    text: np.ndarray
    section: np.ndarray
    head: np.ndarray

    @property
    def counted(self) -> np.ndarray:
        """The sentences that have a posterior."""
        return ~self.head & (self.span >= LEAST_WORDS)


class Cutter:
    """Cuts texts into sentences; the words of tokens are kept between blocks."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.names: dict[str, int] = {}
        self.flat, self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.end, self.over = np.zeros(0, bool), np.zeros(0, bool)

    def _numbers(self, tokens: list[str]) -> np.ndarray:
        if len(self.ids) > MOST_CACHED:
            self.clear()
        new = list(set(tokens).difference(self.ids))
        if new:
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            found = [WORD.findall(t) for t in new]
            count = np.array([len(x) for x in found], np.int64)
            self.first = np.r_[self.first, len(self.flat) + np.cumsum(count) - count]
            self.flat = np.r_[self.flat, np.array([self.names.setdefault(w, len(self.names)) for x in found for w in x], np.int64)]
            self.count = np.r_[self.count, count]
            self.end = np.r_[self.end, [END.search(w) is not None for w in new]]
            self.over = np.r_[self.over, [w == OVER for w in new]]
        return np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))

    def cut(self, ids: list[int | None], texts: list[str | None], sources: list[str | None], paths: list[str | None], labels: list[list[int]]) -> Block:
        listed = [[*sectioned(t).replace("\n", f" {BREAK} ").split(), BREAK] if t else [BREAK] for t in texts]
        token = self._numbers([w for words in listed for w in words])
        end, over = self.end[token], self.over[token]
        text = np.repeat(np.arange(len(texts)), [len(w) for w in listed])
        sentence = np.cumsum(np.r_[0, end])[:-1]
        heads = np.zeros(len(token) + 1, bool)
        heads[sentence[over]] = True
        full = self.count[token] > 0
        token, text, sentence = token[full], text[full], sentence[full]
        starts = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])[: len(token)]
        head, of = heads[sentence[starts]], text[starts]
        section = np.cumsum(head | np.r_[True, of[1:] != of[:-1]][: len(of)]) - 1
        size = self.count[token]
        word = self.flat[np.repeat(self.first[token] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        used = np.flatnonzero(np.bincount(word, minlength=len(self.names)))
        number = np.zeros(len(self.names), np.int64)
        number[used] = np.arange(len(used))
        names = list(self.names)
        narrow = np.min_scalar_type(max(1, len(used)))
        span = np.add.reduceat(size, starts) if len(starts) else size
        return Block(ids, sources, [addresses(t, p) for t, p in zip(texts, paths, strict=True)], labels, [names[i] for i in used], number[word].astype(narrow), span.astype(np.int32), of.astype(np.int32), section.astype(np.int32), head)


def _cut(batches: Iterator[pa.RecordBatch], number: dict[str, int]) -> Iterator[Block]:
    """Blocks of the rows (doc_id, text, source, path, labels)."""
    cutter = Cutter()
    for batch in batches:
        ids, texts, sources, paths, labels = (batch.column(c).to_pylist() for c in ("doc_id", "text", "source", "path", "labels"))
        labels = [[number[x] for x in own or []] for own in labels]
        start, chars = 0, 0
        for i, t in enumerate(texts, 1):
            chars += len(t or "")
            if i == len(texts) or i - start == BLOCK or chars >= BLOCK_CHARS:
                yield cutter.cut(ids[start:i], texts[start:i], sources[start:i], paths[start:i], labels[start:i])
                start, chars = i, 0


@dataclass
class Weighed:
    """The weights that a lexicon gives a block's sentences, and its occurrences of the lexicon's words."""

    weight: np.ndarray  # (sentences, n)
    use: np.ndarray  # the occurrences
    sentence: np.ndarray  # of every occurrence
    each: np.ndarray  # (occurrences of the lexicon's words, n)


def _weighed(b: Block, lexicon: dict[str, np.ndarray], n: int) -> Weighed:
    table, known = np.zeros((len(b.words), n)), np.zeros(len(b.words), bool)
    for i, w in enumerate(b.words):
        if (x := lexicon.get(w)) is not None:
            table[i], known[i] = x, True
    sentence = np.repeat(np.arange(len(b.span)), b.span)
    use = np.flatnonzero(known[b.word])
    each = table[b.word[use]]
    weight = np.stack([np.bincount(sentence[use], each[:, k], minlength=len(b.span)) for k in range(n)], 1)
    return Weighed(weight, use, sentence, each)


def _lexicon_votes(weight: np.ndarray) -> np.ndarray:
    """The subject with clearly the most weight; n where no word has any (none), n + 1 where it is open."""
    n = weight.shape[1]
    order = np.sort(weight, 1)
    clear = order[:, -1] >= 1.5 * order[:, -2]
    return np.where(order[:, -1] < 0.3, n, np.where(clear, weight.argmax(1), n + 1))


def votes(b: Block, weight: np.ndarray, known_sources: dict[str, int], known_words: dict[str, int], lexicon: dict[str, np.ndarray]) -> np.ndarray:
    """(sentences, 4): votes by words, section, source and address."""
    n = weight.shape[1]
    own = _lexicon_votes(weight)
    one = np.zeros((len(own), n + 2))
    one[np.arange(len(own)), own] = 1
    around = np.bincount(b.section * np.int64(n + 2) + own, minlength=(int(b.section.max()) + 1) * (n + 2) if len(own) else 0).reshape(-1, n + 2)
    others = (around[b.section] - one)[:, :n]
    order = np.sort(others, 1)
    section = np.where(order[:, -1] == 0, n, np.where(order[:, -1] > order[:, -2], others.argmax(1), n + 1))
    source = np.array([known_sources.get(x or "", n) for x in b.sources], np.int64)
    address = np.array([address_vote(x, known_words, lexicon, n) for x in b.addresses], np.int64)
    return np.stack([own, section, source[b.text], address[b.text]], 1)


def addresses(text: str | None, path: str | None) -> list[str]:
    """The address words of a document: those of its path's folders and of the hosts and paths of links in its text."""
    folders = (path or "").replace("\\", "/").lower().rpartition("/")[0]
    linked = LINKED.findall(text.lower()) if text and ("http" in text or "www." in text) else []
    return [w for part in (folders, *linked) for w in WORD.findall(part.partition("?")[0]) if len(w) > 2]


def address_vote(words: list[str], known: dict[str, int], lexicon: dict[str, np.ndarray], n: int) -> int:
    """The subject most address words stand for, by their own learned meaning or else the lexicon's; none, or open if torn."""
    weight = np.zeros(n)
    for w in words:
        if w in known:
            weight[known[w]] += 1
        elif w in lexicon:
            weight += lexicon[w]
    order = np.sort(weight)
    return n if order[-1] == 0 else int(weight.argmax()) if n < 2 or order[-1] >= 1.5 * order[-2] else n + 1


def _learn(seen: np.ndarray, times: np.ndarray, n: int, rounds: int = 30) -> tuple[np.ndarray, list[np.ndarray]]:
    """Prior and vote tables by expectation-maximisation over distinct vote patterns; started with the lexicon's votes."""
    p = np.full((len(seen), n + 1), 0.02)
    lex = seen[:, 0]
    p[np.arange(len(seen)), np.where(lex <= n, lex, np.where(seen[:, 1] < n, seen[:, 1], n))] = 1
    p /= p.sum(1, keepdims=True)
    for _ in range(rounds):
        w = p * times[:, None]
        prior = (w.sum(0) + 1) / (w.sum() + n + 1)
        tables = []
        for i in range(seen.shape[1]):
            t = np.full((n + 1, n + 2), 0.1)
            np.add.at(t.T, seen[:, i], w)
            tables.append(t / t.sum(1, keepdims=True))
        log = np.log(prior)[None, :] + sum(np.log(tables[i][:, seen[:, i]]).T for i in range(seen.shape[1]))
        p = np.exp(log - log.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
    return prior, tables


def _word_weights(counts: np.ndarray, totals: np.ndarray, names: list[str], n: int, least: float, purity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of words whose rates gather in one or two of the n subjects; columns after those stand for no subject."""
    rate = counts / np.maximum(totals, 1)
    share = rate / np.maximum(rate.sum(1), 1e-12)[:, None]
    top = np.sort(share[:, :n], 1)
    one = top[:, -1] >= max(purity, min(0.9, 1.4 / n))
    two = top[:, -1] + top[:, -2] >= purity + 0.2 if n > 3 else one
    long = np.array([len(w) > 2 for w in names], bool)
    at = np.flatnonzero((counts[:, :n].sum(1) >= least) & (one | two) & long)
    return at, np.where(share[at, :n] >= 0.25, share[at, :n], 0)


# The passes of the fit. Each gives, for a block, keys and a row of whole counts for each; the key None is for totals.


def _labelled_words(b: Block, n: int) -> tuple[list[str | None], np.ndarray]:
    """Of each word: the labels of its texts (each text counts once, its labels share WHOLE), and its texts."""
    target = np.zeros((len(b.ids), n + 1), np.int64)
    target[:, n] = 1
    for i, own in enumerate(b.labels):
        if own:
            target[i, own] = round(WHOLE / len(own))
    pairs = np.unique(np.repeat(b.text, b.span) * np.int64(len(b.words)) + b.word)
    text, word = np.divmod(pairs, max(1, len(b.words)))
    counts = np.zeros((len(b.words) + 1, n + 1), np.int64)
    counts[:-1, n] = np.bincount(word, minlength=len(b.words))
    some = target[:, :n].any(1)[text]
    np.add.at(counts[:, :n], word[some], target[text[some], :n])
    counts[-1] = target.sum(0)
    return [*b.words, None], counts


def _voted_words(b: Block, lexicon: dict[str, np.ndarray], n: int) -> tuple[list[str | None], np.ndarray]:
    """Of each word: its occurrences by the vote of their sentences for each subject or none."""
    x = _weighed(b, lexicon, n)
    own = _lexicon_votes(x.weight)
    kind = np.minimum(own, n)
    per_text = np.bincount(b.text * np.int64(n + 1) + kind, minlength=len(b.ids) * (n + 1)).reshape(-1, n + 1)
    vote = kind[x.sentence]
    # a word does not teach itself: without it the sentence votes alike, or the rest of the document decides
    at = x.sentence[x.use]
    rest = per_text[b.text[at]]
    rest[np.arange(len(at)), kind[at]] -= 1
    alike = _lexicon_votes(x.weight[at] - x.each) == own[at]
    vote[x.use] = np.where((kind[at] == n) | alike, kind[at], rest.argmax(1))
    counts = np.bincount(b.word * np.int64(n + 1) + vote, minlength=len(b.words) * (n + 1)).reshape(-1, n + 1)
    return [*b.words, None], np.vstack([counts, np.bincount(kind, minlength=n + 1)])


def _keyed_texts(b: Block, lexicon: dict[str, np.ndarray], n: int) -> tuple[list[str | None], np.ndarray]:
    """Of each source and address word: the voted sentences of its texts by subject, and those of its texts that have any."""
    own = _lexicon_votes(_weighed(b, lexicon, n).weight)
    voted = own < n
    per_text = np.bincount(b.text[voted] * np.int64(n) + own[voted], minlength=len(b.ids) * n).reshape(-1, n)
    per_text = np.c_[per_text, per_text.any(1)]
    names: dict[str, int] = {}
    pairs = [(names.setdefault(k, len(names)), i) for i in np.flatnonzero(per_text[:, n]).tolist() for k in (*(["source " + b.sources[i]] if b.sources[i] else []), *("address " + w for w in set(b.addresses[i])))]
    counts = np.zeros((len(names), n + 1), np.int64)
    if pairs:
        key, text = np.array(pairs).T
        np.add.at(counts, key, per_text[text])
    return list(names), counts


def _patterns(b: Block, lexicon: dict[str, np.ndarray], source: dict[str, int], address: dict[str, int], n: int) -> tuple[list[str | None], np.ndarray]:
    """The distinct patterns of votes of the counted sentences, and their numbers."""
    seen, times = np.unique(votes(b, _weighed(b, lexicon, n).weight, source, address, lexicon)[b.counted], axis=0, return_counts=True)
    return [" ".join(map(str, v)) for v in seen.tolist()], times[:, None]


# What is kept of the sums: the keys' places and a row of values for each.


def _labelled_lexicon(names: list[str], counts: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(totals) - 1
    shared, total = counts[:, :n] / WHOLE, totals[:n] / WHOLE
    at, weight = _word_weights(shared, total, names, n, 2.0, 0.55)
    # everyday words meet a subject only through wrong labels: they are labelled far less often than documents are
    often = shared[at].sum(1) / np.maximum(counts[at, n], 1) >= 0.4 * total.sum() / max(1, totals[n])
    return at[often], weight[often]


def _voted_lexicon(names: list[str], counts: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _word_weights(counts, totals, names, len(totals) - 1, 4, 0.7)


def _speaks_for(names: list[str], counts: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subject that makes up most of the voted sentences of a key's texts, of which there are at least three."""
    n = len(totals) - 1
    order = np.sort(counts[:, :n], 1)
    total = order.sum(1)
    at = np.flatnonzero((counts[:, n] >= 3) & (total >= 20) & (order[:, -1] >= 0.4 * total) & ((order[:, -1] >= 2 * order[:, -2]) if n > 1 else True))
    return at, counts[at, :n].argmax(1)[:, None]


def _all(names: list[str], counts: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(len(names)), counts


Pass = Callable[[Block], tuple[list[str | None], np.ndarray]]
Keep = Callable[[list[str], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Runs a pass of so many counts over all blocks, and gives what is kept of its sums.
Gather = Callable[[Pass, int, Keep], dict[str, np.ndarray]]


class Sums:
    """Counts added up by key."""

    def __init__(self, width: int) -> None:
        self.keys: dict[str | None, int] = {}
        self.counts = np.zeros((1024, width), np.int64)

    def add(self, keys: list[str | None], counts: np.ndarray) -> None:
        at = np.fromiter((self.keys.setdefault(k, len(self.keys)) for k in keys), np.int64, len(keys))
        if len(self.keys) > len(self.counts):
            self.counts = np.vstack([self.counts, np.zeros((len(self.keys), self.counts.shape[1]), np.int64)])
        self.counts[at] += counts

    def take(self) -> tuple[list[str | None], np.ndarray]:
        out = list(self.keys), self.counts[: len(self.keys)]
        self.__init__(self.counts.shape[1])
        return out


def _fitted(subjects: list[str], gather: Gather) -> Model:
    n = len(subjects)
    lexicon = gather(partial(_labelled_words, n=n), n + 1, _labelled_lexicon)
    for _ in range(4):
        lexicon = gather(partial(_voted_words, lexicon=lexicon, n=n), n + 1, _voted_lexicon)
    keyed = {k: int(v[0]) for k, v in gather(partial(_keyed_texts, lexicon=lexicon, n=n), n + 1, _speaks_for).items()}
    source, address = ({k.removeprefix(kind): v for k, v in keyed.items() if k.startswith(kind)} for kind in ("source ", "address "))
    found = sorted(([int(v) for v in k.split()], int(times[0])) for k, times in gather(partial(_patterns, lexicon=lexicon, source=source, address=address, n=n), 1, _all).items())
    seen, times = np.array([v for v, _ in found], np.int64).reshape(-1, len(FUNCTIONS)), np.array([t for _, t in found], np.int64)
    prior, tables = _learn(seen, times, n)
    return Model(subjects, lexicon, source, address, prior, tables, [float(times[seen[:, i] < n].sum() / max(1, times.sum())) for i in range(len(FUNCTIONS))])


def fit(texts: list[str], labels: list[list[int]], sources: list[str], paths: list[str], subjects: list[str]) -> Model:
    """The model of texts at hand; ``labels`` holds each text's hand labels, empty where it has none."""
    block = Cutter().cut(list(range(len(texts))), texts, sources, paths, labels)

    def gather(count: Pass, width: int, keep: Keep) -> dict[str, np.ndarray]:
        keys, counts = count(block)
        totals = counts[keys.index(None)] if None in keys else np.zeros(width, np.int64)
        names = [k for k in keys if k is not None]
        at, values = keep(names, counts[: len(names)], totals)
        return {names[i]: v for i, v in zip(at.tolist(), values, strict=True)}

    return _fitted(subjects, gather)


def fit_blocks(blocks: DataFrame, subjects: list[str]) -> Model:
    """The model of all texts of ``blocks``, by one exchange of counts for each pass."""
    spark = blocks.sparkSession

    def gather(count: Pass, width: int, keep: Keep) -> dict[str, np.ndarray]:
        columns = [f"c{i}" for i in range(width)]
        counting = spark.sparkContext.broadcast(count)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = Sums(width)

            def out() -> pa.RecordBatch:
                keys, counts = sums.take()
                return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(c) for c in counts.T.copy())], names=["key", *columns])

            for batch in batches:
                for x in batch.column(0):
                    sums.add(*counting.value(pickle.loads(x.as_buffer())))
                    if len(sums.keys) > MOST_CACHED:
                        yield out()
            yield out()

        schema = ", ".join(["key string", *(f"{c} bigint" for c in columns)])
        summed = written(blocks.select("block").mapInArrow(run, schema).groupBy("key").agg(*(F.sum(c).alias(c) for c in columns)))
        totals = np.array([list(r)[1:] for r in summed.filter("key is null").collect()], np.int64).reshape(-1, width).sum(0)

        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.column(0).to_pylist()
                at, values = keep(names, np.stack([batch.column(c).to_numpy() for c in columns], 1), totals)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at], pa.string()), pa.array(values.astype(float).tolist(), pa.list_(pa.float64()))], names=["key", "value"])

        rows = summed.filter("key is not null").mapInArrow(kept, "key string, value array<double>").collect()
        counting.unpersist()
        return {r["key"]: np.array(r["value"]) for r in rows}

    return _fitted(subjects, gather)


def allowed(areas: DataFrame) -> list[str]:
    """The allowed subjects of ``areas``, a parameter table."""
    return sorted({r["subject"] for r in areas.select("subject").filter("subject is not null").collect()})


def cut_texts(documents: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(block): all documents as blocks of sentences, with their labels, as a written table that passes read in place of texts.

    Labels outside ``subjects`` are left out, repeated ones count once.
    """
    number = {x: i for i, x in enumerate(subjects)}
    known = _known(labels, subjects)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _cut(batches, number):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], names=["block"])

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "source", "path").join(known, "doc_id", "left")
    return written(docs.mapInArrow(run, "block binary"))


def _known(labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, labels)."""
    return labels.filter(F.col("subject").isin(subjects) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.array_sort(F.collect_set("subject")).alias("labels"))


def training_model(documents: DataFrame, labels: DataFrame, areas: DataFrame, sample_rows: int | None = None) -> Model:
    """The model fitted on all documents.

    Only for trials: with ``sample_rows`` on at most so many labelled and as many unlabelled ones, those of the smallest hashed ids.
    """
    subjects = allowed(areas)
    if sample_rows is not None:
        ids, known = documents.select("doc_id").filter("doc_id is not null"), _known(labels, subjects).select("doc_id")
        labelled = hashed_sample(known, F.col("doc_id"), "subject", sample_rows, known.count())
        others = hashed_sample(ids, F.col("doc_id"), "unlabelled", sample_rows, documents.count()).join(known, "doc_id", "left_anti")
        documents = documents.join(labelled.unionByName(others), "doc_id", "left_semi")
    return fit_blocks(cut_texts(documents, labels, subjects), subjects)


def shares(b: Block, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Of each text of the block its sentences, and the shares of each subject and of none; 0 for a text without sentences."""
    n = model.none
    use = b.counted
    v = votes(b, _weighed(b, model.lexicon, n).weight, model.source, model.address, model.lexicon)[use]
    seen, which = np.unique(v, axis=0, return_inverse=True)
    sentence, subject = np.nonzero((model.posterior(seen) >= 0.5)[which.reshape(-1)])
    text = b.text[use]
    number = np.bincount(text, minlength=len(b.ids))
    total = np.bincount(text[sentence] * np.int64(n + 1) + subject, minlength=len(b.ids) * (n + 1)).reshape(-1, n + 1)
    return number, total / np.maximum(1, number)[:, None]


SHARES = "doc_id bigint, source string, sentences int, shares array<double>"


def _share_rows(b: Block, model: Model) -> pa.RecordBatch:
    number, share = shares(b, model)
    return pa.RecordBatch.from_arrays([pa.array(b.ids, pa.int64()), pa.array(b.sources, pa.string()), pa.array(number, pa.int32()), pa.array(share.tolist(), pa.list_(pa.float64()))], names=["doc_id", "source", "sentences", "shares"])


def block_shares(blocks: DataFrame, model: Model) -> DataFrame:
    """:func:`subject_shares` of documents that are cut already."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield _share_rows(pickle.loads(x.as_buffer()), shared.value)

    return blocks.select("block").mapInArrow(run, SHARES)


def subject_shares(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, sentences, shares array<double>): shares of the model's subjects, and last that of none.

    One row for each row of ``documents``; null and empty texts have no sentences and shares of 0. The model's size is
    bounded by the words, sources and address words that speak for a subject; it goes out as a broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _cut(batches, {}):
            yield _share_rows(block, shared.value)

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text", "path", F.lit(None).cast("array<string>").alias("labels"))
    return docs.mapInArrow(run, SHARES)


def subject_rows(shared: DataFrame, model: Model, least_share: float = 0.25) -> DataFrame:
    """(doc_id, subject, share): the subjects that at least ``least_share`` of a document's sentences deal with."""
    names = F.array(*[F.lit(s) for s in model.subjects])
    pairs = F.arrays_zip(names.alias("subject"), F.slice("shares", 1, len(model.subjects)).alias("share"))
    each = shared.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", F.col("p.subject").alias("subject"), F.col("p.share").alias("share"))
    return each.filter((F.col("share") >= least_share) & (F.col("share") > 0))


def composition(shared: DataFrame, model: Model, least_share: float = 0.25) -> DataFrame:
    """(source, subject, documents, sentences): the make-up of the corpus; the subject null stands for none."""
    names = F.array(*[F.lit(s) for s in model.subjects], F.lit(None).cast("string"))
    each = shared.filter("sentences > 0").select("source", "sentences", F.posexplode("shares").alias("i", "share"), names.alias("names"))
    return each.groupBy("source", F.try_element_at("names", F.col("i") + 1).alias("subject")).agg(F.sum((F.col("share") >= least_share).cast("bigint")).alias("documents"), F.round(F.sum(F.col("share") * F.col("sentences")), 1).alias("sentences"))
