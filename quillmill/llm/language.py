"""The language of each item and of each segment of a mixed item, by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, for each slot, one bit for each language, in as many 64-bit words as the table of
languages needs; looking up an n-gram gives the mask of all languages that contain it. The n-grams are whole words and
four-letter parts of words. Counts of set bits for each language, corrected for the filter's false positives, decide the
language of a sentence; n-grams common to most languages (invented names, numbers' units) are in no filter.

The languages are a parameter: a table of a few function words for each (by default the five of the queries). The filter
is fitted on a sample of documents, bounded by ``sample_rows`` and ``sample_chars``. Function words label its clear
sentences, their n-grams label the rest, and the n-grams of all labelled sentences fill the filter; declared labels are
not used.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prose import BREAK, END, WORD, prose
from .sample import hashed_sample

#: Frequent function words of the five languages; any other table of this form may be given instead.
FUNCTION_WORDS = {
    "en": "the and of to for with that is are was were not this from which what when where who how there it they have has we".split(),
    "de": "der die das und ist sind nicht mit von für auf wir wie ich ein eine werden wurde noch wenn auch im zu den dem".split(),
    "fr": "le les des du est sont une pas pour dans que qui et sur nous avec où comment pourquoi au aux ont il elle".split(),
    "es": "el los las del es son una para con que no por se y sobre qué cómo dónde hay lo en más muy cuando".split(),
    "nl": "het een van en is zijn niet met voor op wij wat hoe waar waarom er nog als ook te naar door worden heeft".split(),
}
#: ISO 639-1.
ISO_CODES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy "
    "ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv "
    "mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss "
    "st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()
HASHES = 3
GRAM = 4
MOST_CACHED = 300_000
#: Texts that are judged at once.
BLOCK = 256
#: A sentence has a language with this much evidence, in words, and this share of its words.
LEAST_EVIDENCE, LEAST_COVER = 1.49, 0.249
SEGMENT = "struct<start:int,stop:int,lang:string,confidence:double,words:bigint>"
DETECTED = f"item_table string, item_id bigint, label string, languages array<struct<lang:string,share:double,confidence:double>>, segments array<{SEGMENT}>"


def grams(word: str) -> list[str]:
    """Parts of four characters of the word between its marked ends."""
    w = f"^{word}$"
    return [w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))]


@dataclass
class Filters:
    """The bit-sliced Bloom filter: (slots, 64-bit words) with a bit for each language; its size is fixed by parameter."""

    slots: np.ndarray
    languages: tuple[str, ...]

    @classmethod
    def build(cls, masks: dict[str, int], bits: int, languages: tuple[str, ...]) -> Filters:
        f = cls(np.zeros((1 << bits, (len(languages) + 63) // 64), np.uint64), languages)
        for gram, mask in masks.items():
            f.slots[f.places(gram)] |= np.array([mask >> (64 * i) & (2**64 - 1) for i in range(f.slots.shape[1])], np.uint64)
        return f

    def places(self, gram: str) -> list[int]:
        h = xxhash.xxh64_intdigest(gram)
        a, b = h & 0xFFFFFFFF, (h >> 32) | 1
        return [(a + i * b) & (len(self.slots) - 1) for i in range(HASHES)]

    def mask(self, gram: str) -> int:
        """Bits of all languages whose filter contains the n-gram."""
        return int.from_bytes(np.bitwise_and.reduce(self.slots[self.places(gram)], axis=0).tobytes(), "little")

    def bits(self, grams: list[str]) -> np.ndarray:
        """(n-grams, languages): which languages contain each."""
        masks = [self.mask(g) for g in grams]
        return np.array([[m >> i & 1 for i in range(len(self.languages))] for m in masks], np.float64).reshape(len(grams), len(self.languages))

    def false_positives(self) -> np.ndarray:
        """The chance, for each language, that an n-gram outside its filter is found in it."""
        return np.array([np.count_nonzero(self.slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / len(self.slots) for i in range(len(self.languages))]) ** HASHES


class Evidence:
    """Evidence of a word for each language, cached; the whole word decides, else its parts do."""

    def __init__(self, filters: Filters) -> None:
        self.filters, self.false, self.n = filters, filters.false_positives(), len(filters.languages)
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.words: dict[str, np.ndarray] = {}
        self.table = np.zeros((0, self.n), np.float32)
        self.count = np.zeros(0, np.int64)
        self.ends = np.zeros(0, bool)

    def of(self, word: str) -> np.ndarray:
        """The evidence of one word: set bits less those to be expected of a word in no filter."""
        whole = self.filters.bits([f"^{word}$"])[0]
        if whole.any():
            return ((whole - self.false) / (1 - self.false)).astype(np.float32)
        parts = grams(word)
        share = (self.filters.bits(["~" + g for g in parts]).mean(0) - self.false) / (1 - self.false)
        # of a word with one or two parts both must speak for a language
        return np.where(share >= (0.5 if len(parts) > 2 else 0.99), share * 0.8, 0).astype(np.float32)

    def lookup(self, tokens: list[str]) -> np.ndarray:
        """Row numbers in ``table`` (evidence), ``count`` (words) and ``ends`` (a sentence ends here) for each token."""
        if len(self.ids) > MOST_CACHED:
            self.clear()
        ids = self.ids
        new = list(set(tokens).difference(ids))
        if new:
            ids.update(zip(new, range(len(ids), len(ids) + len(new)), strict=True))
            rows, count = np.zeros((len(new), self.n), np.float32), np.zeros(len(new), np.int64)
            for i, token in enumerate(new):
                for w in WORD.findall(token):
                    if w not in self.words:
                        self.words[w] = self.of(w)
                    rows[i] += self.words[w]
                    count[i] += 1
            self.table = np.vstack([self.table, rows])
            self.count = np.r_[self.count, count]
            self.ends = np.r_[self.ends, [END.search(w) is not None for w in new]]
        return np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))


@dataclass
class Scan:
    """The sentences of a block of texts: their words' evidence, and which text each sentence belongs to."""

    rows: np.ndarray  # evidence of each token
    ids: np.ndarray  # each token's number
    starts: np.ndarray  # first token of each sentence
    spans: np.ndarray  # tokens of each sentence
    sizes: np.ndarray  # words of each sentence
    text_of: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None], evidence: Evidence) -> Scan:
        listed = [[*prose(t).replace("\n", f" {BREAK} ").split(), BREAK] if t else [BREAK] for t in texts]
        ids = evidence.lookup([w for words in listed for w in words])
        ends = evidence.ends[ids]
        text = np.repeat(np.arange(len(texts)), [len(w) for w in listed])
        sentence = np.r_[0, np.cumsum(ends)[:-1]] if len(ids) else np.zeros(0, np.int64)
        full = evidence.count[ids] > 0
        ids, text, sentence = ids[full], text[full], sentence[full]
        starts = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]]) if len(ids) else np.zeros(0, np.int64)
        sizes = np.add.reduceat(evidence.count[ids], starts) if len(ids) else starts
        return cls(evidence.table[ids], ids, starts, np.diff(np.r_[starts, len(ids)]), sizes, text[starts])

    def scores(self) -> np.ndarray:
        return np.add.reduceat(self.rows.astype(np.float64), self.starts, axis=0) if len(self.starts) else np.zeros((0, self.rows.shape[1]))


def _masks(counts: list[Counter], least: int, share: float) -> dict[str, int]:
    """n-gram -> languages in which it is about as frequent as where it is most frequent; those of most languages left out."""
    out, words = {}, [max(1, c.total()) for c in counts]
    for gram in set().union(*counts):
        times = [c[gram] for c in counts]
        if sum(times) < least:
            continue
        rate = [t / w for t, w in zip(times, words, strict=True)]
        top = max(rate)
        mask = sum(1 << i for i, r in enumerate(rate) if r >= share * top)
        # names occur at like rates everywhere; in small samples they miss some language by chance
        if mask.bit_count() <= 0.6 * len(counts):
            out[gram] = mask
    return out


def fit(texts: list[str], bits: int = 20, least: int = 3, share: float = 0.2, seeds: dict[str, list[str]] | None = None) -> Filters:
    """The filter of a sample of texts for the languages of the table ``seeds`` (language -> function words)."""
    seeds = FUNCTION_WORDS if seeds is None else seeds
    languages = tuple(seeds)
    first: dict[str, int] = {}
    for i, lang in enumerate(languages):
        for w in seeds[lang]:
            first[f"^{w}$"] = first.get(f"^{w}$", 0) | 1 << i
    filters = Filters.build(first, bits, languages)
    for _ in range(3):
        evidence = Evidence(filters)
        seen = Scan.of(texts, evidence)
        names = list(evidence.ids)
        score = seen.scores()
        order = np.sort(score, 1)
        clear = (seen.sizes >= 4) & (order[:, -1] >= 1.99) & (order[:, -1] >= 1.5 * order[:, -2]) if len(score) else np.zeros(0, bool)
        lang_of = np.repeat(np.where(clear, score.argmax(1), -1), seen.spans) if len(score) else np.zeros(0, np.int64)
        counts: list[Counter] = [Counter() for _ in languages]
        for i in range(len(languages)):
            n = np.bincount(seen.ids[lang_of == i], minlength=len(names))
            for j in np.flatnonzero(n).tolist():
                for w in WORD.findall(names[j]):
                    counts[i][f"^{w}$"] += int(n[j])
        whole = _masks(counts, least, share)
        parts: list[Counter] = [Counter() for _ in languages]
        for some, of in zip(parts, counts, strict=True):
            for w, n in of.items():
                # names do not teach word parts
                if w in whole:
                    for g in grams(w[1:-1]):
                        some["~" + g] += n
        filters = Filters.build(whole | _masks(parts, least, share), bits, languages)
    return filters


def _best_split(scores: np.ndarray) -> tuple[int, int, int] | None:
    """(words before the split, language before, language after) of a sentence in two languages, or None."""
    before = np.cumsum(scores, 0)
    after = before[-1] - before
    gain = before.max(1) + after.max(1) - before[-1].max()
    i = int(np.argmax(gain))
    a, b = int(before[i].argmax()), int(after[i].argmax())
    if a == b or before[i, a] < LEAST_EVIDENCE or after[i, b] < LEAST_EVIDENCE or gain[i] < LEAST_EVIDENCE:
        return None
    return i + 1, a, b


def judge(texts: list[str | None], evidence: Evidence) -> list[list[tuple[int, int, str, float, int]]]:
    """For each text (first sentence, last sentence + 1, language, confidence, words) of its runs of one language."""
    found: list[list[list]] = [[] for _ in texts]
    seen = Scan.of(texts, evidence)
    if not len(seen.starts):
        return [[] for _ in texts]
    scores = seen.scores()
    best = scores.argmax(1)
    order = np.sort(scores, 1)
    # evidence for other languages by words that speak against the best one
    against = seen.rows[np.arange(len(seen.rows)), np.repeat(best, seen.spans)] <= 0
    other = np.add.reduceat(seen.rows * against[:, None], seen.starts, axis=0).max(1)
    enough = order[:, -1] >= LEAST_EVIDENCE
    torn = enough & (other >= LEAST_EVIDENCE) & (seen.sizes >= 6)
    sure = enough & (order[:, -1] >= LEAST_COVER * seen.sizes) & (order[:, -1] - order[:, -2] >= 0.49)
    first = np.searchsorted(seen.text_of, np.arange(len(texts)))

    def add(text: int, i: int, lang: int, score: float, rival: float, words: int) -> None:
        runs = found[text]
        if runs and runs[-1][2] == lang:
            last = runs[-1]
            last[1], last[3], last[4], last[5] = i + 1, last[3] + score, last[4] + rival, last[5] + words
        else:
            runs.append([i, i + 1, lang, score, rival, words])

    keep = np.flatnonzero(torn | sure)
    for i, text, at, span, size, lang, a, b in zip(keep.tolist(), seen.text_of[keep].tolist(), seen.starts[keep].tolist(), seen.spans[keep].tolist(), seen.sizes[keep].tolist(), best[keep].tolist(), order[keep, -1].tolist(), order[keep, -2].tolist(), strict=True):
        k = i - int(first[text])
        if torn[i] and (cut := _best_split(rows := seen.rows[at : at + span])):
            for which, some, n in ((cut[1], rows[: cut[0]].sum(0), cut[0]), (cut[2], rows[cut[0] :].sum(0), span - cut[0])):
                add(text, k, which, float(some[which]), float(np.delete(some, which).max()), n)
        elif sure[i]:
            add(text, k, lang, a, b, size)
    return [[(a, b, evidence.filters.languages[lang], score / (score + max(0.0, rival)), words) for a, b, lang, score, rival, words in runs] for runs in found]


def shares(segments: list[tuple[int, int, str, float, int]]) -> list[tuple[str, float, float]]:
    """(language, share of the prose in words, confidence) of a text's segments, the largest share first."""
    total = sum(s[4] for s in segments)
    words: dict[str, int] = {}
    sure: dict[str, float] = {}
    for _, _, lang, confidence, n in segments:
        words[lang] = words.get(lang, 0) + n
        sure[lang] = sure.get(lang, 0.0) + confidence * n
    return sorted(((lang, n / total, sure[lang] / n) for lang, n in words.items()), key=lambda x: (-x[1], x[0]))


def declared(label: Column) -> Column:
    """The declared language: trimmed, lower case, cut before the first - or _; null if no ISO 639-1 code is left."""
    code = F.regexp_extract(F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", "")), r"^([^-_]*)", 1)
    return F.when(code.isin(ISO_CODES), code)


def training_texts(documents: DataFrame, sample_rows: int, sample_chars: int = 32_768) -> list[str]:
    """At most ``sample_rows`` texts, those of the smallest hashed ids, none longer than ``sample_chars`` characters."""
    rows = hashed_sample(documents.select("doc_id", "text"), F.col("doc_id"), "language", sample_rows, documents.count())
    return [r["text"] for r in rows.filter(F.length("text") <= sample_chars).select("text").collect()]


def items(documents: DataFrame, chunks: DataFrame, eval_queries: DataFrame) -> DataFrame:
    """(item_table, item_id, text, label) of documents, chunks and evaluation queries; null texts are left out."""
    def of(df: DataFrame, name: str, key: str, text: str) -> DataFrame:
        return df.select(F.lit(name).alias("item_table"), F.col(key).cast("bigint").alias("item_id"), F.col(text).alias("text"), declared(F.col("lang")).alias("label")).filter("text is not null")

    return of(documents, "documents", "doc_id", "text").unionByName(of(chunks, "chunks", "chunk_id", "text")).unionByName(of(eval_queries, "eval_queries", "qid", "query"))


def detect_languages(listed: DataFrame, filters: Filters) -> DataFrame:
    """Each item with its languages and segments (see DETECTED); start and stop count the sentences of its prose.

    The filter has a fixed size and goes to the executors as a broadcast. Texts that are empty or have no prose get
    empty lists.
    """
    shared = listed.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(shared.value)
        segment = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int64())])
        language = pa.struct([("lang", pa.string()), ("share", pa.float64()), ("confidence", pa.float64())])
        for batch in batches:
            texts = batch.column("text").to_pylist()
            runs = [r for i in range(0, len(texts), BLOCK) for r in judge(texts[i : i + BLOCK], evidence)]
            langs = [[dict(zip(("lang", "share", "confidence"), x, strict=True)) for x in shares(r)] for r in runs]
            segs = [[dict(zip(("start", "stop", "lang", "confidence", "words"), x, strict=True)) for x in r] for r in runs]
            yield pa.RecordBatch.from_arrays([batch.column("item_table"), batch.column("item_id"), batch.column("label"), pa.array(langs, pa.list_(language)), pa.array(segs, pa.list_(segment))], names=["item_table", "item_id", "label", "languages", "segments"])

    return listed.mapInArrow(run, DETECTED)


def label_cases(detected: DataFrame, least_share: float = 0.2) -> DataFrame:
    """(item_table, item_id, lang): languages of items whose declared label is missing, wrong or too narrow."""
    langs = F.transform(F.filter("languages", lambda x: x["share"] >= least_share), lambda x: x["lang"])
    own = detected.select("item_table", "item_id", "label", langs.alias("langs"))
    wrong = (F.size("langs") > 1) | F.col("label").isNull() | (F.col("label") != F.element_at("langs", 1))
    return own.filter((F.size("langs") > 0) & wrong).select("item_table", "item_id", F.explode("langs").alias("lang")).distinct()
