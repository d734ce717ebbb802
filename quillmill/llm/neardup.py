"""Near-duplicates by min-max hashing: candidates by banding, an exact check of every candidate, and their groups.

Each permutation gives two signature values, the smallest and the largest hash of a text's features, so half the hash
evaluations suffice. A bucket key is a 64-bit hash of four whole 64-bit values, so that different values meet by chance
only. Equal texts share one 128-bit content key; buckets hold content keys, and a task puts each of its texts into its
buckets once: a group of copies, however large, is one entry.

One exchange brings buckets together. A bucket that a sample shows to hold more than a thousandth of all texts is spread
over salted blocks before it; any bucket with more than SMALL texts is compared in pairs of blocks after it, each in a
task of its own. Candidates are thinned by the agreement of one bit of each signature value (five standard deviations
below the threshold), the rest are compared exactly on their features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, partitions, written

WORD = re.compile(r"[^\W_]+")
#: Words of a shingle and words a text must have; characters of a title's features and those it must have.
SHINGLE, LEAST_WORDS, GRAM, LEAST_CHARS = 5, 50, 3, 20
ROWS, BANDS = 4, 48
VALUES = ROWS * BANDS
TEXTS, TITLES = 0, 1
#: Feature hashes that are permuted at once; most texts of a bucket that is compared at once; texts of a block of a larger one.
HASHES, SMALL, BLOCK = 32768, 32, 256
#: Rows of the bucket exchange for each of its partitions; texts from which on buckets are sampled for hot ones, and of the sample.
ROWS_A_TASK, MANY, SAMPLE = 300_000, 5_000_000, 65_536
#: Slots of the filter of candidates: 4 MB, whatever the number of texts.
SLOTS = 24
_RNG = np.random.default_rng(20240601)
_MUL = _RNG.integers(0, 2**63, VALUES // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**64, VALUES // 2, dtype=np.uint64)
_PLACE = _RNG.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 2**63, (ROWS, BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: What the exchange carries of an item: its content key in two halves and its sketch in three words.
NAMES = ("kind", "id", "k0", "k1", "s0", "s1", "s2")
ITEM = pa.struct([(n, pa.int64()) for n in NAMES])
ITEM_SQL = f"struct<{', '.join(f'{n}: bigint' for n in NAMES)}>"
SIGNED = f"item {ITEM_SQL}, k0 bigint, buckets array<bigint>"
MET = f"bucket bigint, a bigint, b bigint, block bigint, item {ITEM_SQL}"


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text."""
    return WORD.findall(text.lower())


def features(kind: int, text: str | None) -> frozenset:
    """What is compared exactly; empty where the item takes no part."""
    words = words_of(text or "")
    if kind == TITLES:
        title = " ".join(words)
        return frozenset(title[i : i + GRAM] for i in range(len(title) - GRAM + 1)) if len(title) >= LEAST_CHARS else frozenset()
    return frozenset(zip(*[words[i:] for i in range(SHINGLE)], strict=False)) if len(words) >= LEAST_WORDS else frozenset()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of VALUES values for each run of feature hashes; the least and greatest of each permutation alternate."""
    out = np.empty((len(starts), VALUES), np.uint64)
    scratch = np.empty_like(hashes)
    for i in range(VALUES // 2):
        np.multiply(hashes, _MUL[i], out=scratch)
        np.add(scratch, _ADD[i], out=scratch)
        out[:, 2 * i] = np.minimum.reduceat(scratch, starts)
        out[:, 2 * i + 1] = np.maximum.reduceat(scratch, starts)
    return _mixed(out)


def buckets_of(sig: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """(texts, BANDS): the bucket keys of each signature; those of texts and titles, and of bands, differ."""
    h = kind.astype(np.uint64)[:, None] + np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for r in range(ROWS):
        h = _mixed((h ^ sig[:, r::ROWS]) * _BAND[r])
    return h.view(np.int64)


def content_keys(joined: str, kind: int) -> tuple[int, int]:
    """The two halves of the 128-bit key of a text's words."""
    h = xxhash.xxh128_intdigest(joined.encode("utf-8", "surrogatepass"), kind)
    return (h & (2**64 - 1)) - 2**63, (h >> 64) - 2**63


def _hashed(kind: int, words: list[str], joined: str, cache: dict[str, int]) -> np.ndarray:
    if kind == TITLES:
        c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        return _mixed((c[:-2] << np.uint64(42)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:])
    if len(cache) > 500_000:
        cache.clear()
    for w in set(words).difference(cache):
        cache[w] = xxhash.xxh64_intdigest(w)
    c = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = len(c) - SHINGLE + 1
    h = c[:n] * _PLACE[0]
    for k in range(1, SHINGLE):
        h += c[k : k + n] * _PLACE[k]
    return _mixed(h)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, k0, buckets): each item's ITEM record, and its buckets where the task meets its content for the first time."""
    cache: dict[str, int] = {}
    known: dict[tuple[int, int], tuple[int, int, int]] = {}
    for batch in batches:
        if len(known) > 500_000:
            known.clear()
        listed, fresh, runs, kinds = [], [], [], []
        for kind, i, text in zip(batch.column("kind").to_pylist(), batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = WORD.findall(text.lower())
            joined = " ".join(words)
            if (len(joined) < LEAST_CHARS) if kind == TITLES else (len(words) < LEAST_WORDS):
                continue
            keys = content_keys(joined, kind)
            listed.append((kind, i, keys))
            if keys not in known:
                known[keys] = (0, 0, 0)
                fresh.append(len(listed) - 1)
                kinds.append(kind)
                runs.append(_hashed(kind, words, joined, cache))
        bands: list = [None] * len(listed)
        begin = 0
        while begin < len(runs):
            end, size = begin, 0
            while end < len(runs) and (end == begin or size + len(runs[end]) <= HASHES):
                size += len(runs[end])
                end += 1
            sig = signatures(np.concatenate(runs[begin:end]), np.cumsum([0, *map(len, runs[begin:end])])[:-1])
            keys, bits = buckets_of(sig, np.array(kinds[begin:end])), np.packbits((sig & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
            for row, at in enumerate(fresh[begin:end]):
                bands[at] = keys[row]
                known[listed[at][2]] = tuple(bits[row].tolist())
            begin = end
        rows = np.array([(k, i, *keys, *known[keys]) for k, i, keys in listed], np.int64).reshape(len(listed), len(NAMES))
        item = pa.StructArray.from_arrays([pa.array(rows[:, i].copy()) for i in range(len(NAMES))], fields=list(ITEM))
        yield pa.RecordBatch.from_arrays([item, pa.array(rows[:, 2].copy()), pa.array(bands, pa.list_(pa.int64()))], names=["item", "k0", "buckets"])


def items(chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """(kind, id, text) of everything that can take part; null texts and those too short by their characters are left out."""
    texts = chunks.select(F.lit(TEXTS).alias("kind"), F.col("chunk_id").cast("bigint").alias("id"), "text").filter(F.length("text") >= 2 * LEAST_WORDS - 1)
    titles = notes.select(F.lit(TITLES).alias("kind"), F.col("note_id").cast("bigint").alias("id"), F.col("title").alias("text")).filter(F.length("text") >= LEAST_CHARS)
    return texts.unionByName(titles).filter("id is not null")


def _pairs_within(sizes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of keys inside runs of the given sizes."""
    out_a, out_b = [], []
    starts = np.cumsum(np.r_[0, sizes])[:-1]
    for m in np.unique(sizes[sizes > 1]).tolist():
        i, j = np.triu_indices(m, 1)
        at = starts[sizes == m][:, None]
        out_a.append(keys[at + i].ravel())
        out_b.append(keys[at + j].ravel())
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (keys[:0], keys[:0])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket and key: pairs (a, b) of small buckets, members (bucket, a, block) of large ones, items.

    Only one bucket is open at a time; of a large one no more than a block is held.
    """
    names = ["bucket", "a", "b", "block", "item"]

    def out(bucket, a, b, block, item):
        n = len(item if item is not None else a)
        column = lambda x, t: pa.nulls(n, t) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t)
        return pa.RecordBatch.from_arrays([column(bucket, pa.int64()), column(a, pa.int64()), column(b, pa.int64()), column(block, pa.int64()), column(item, ITEM)], names=names)

    open_keys, open_bucket, seen = np.zeros(0, np.int64), None, 0  # the unfinished bucket at the end of the last batch

    def finish(bucket: np.ndarray, keys: np.ndarray, more: bool) -> Iterator[pa.RecordBatch]:
        """Emits finished buckets; with ``more`` the last one is kept open."""
        nonlocal open_keys, open_bucket, seen
        if open_bucket is not None:
            bucket, keys = np.r_[np.full(len(open_keys), open_bucket), bucket], np.r_[open_keys, keys]
        # repeated content keys lie side by side
        once = np.r_[True, (bucket[1:] != bucket[:-1]) | (keys[1:] != keys[:-1])] if len(keys) else np.zeros(0, bool)
        bucket, keys = bucket[once], keys[once]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(keys)])
        if not len(sizes):
            return
        was = seen if open_bucket is not None and bucket[0] == open_bucket else 0
        large = sizes > SMALL
        large[0] |= was > 0
        last = len(sizes) - 1 if more else len(sizes)
        for k in np.flatnonzero(large).tolist():
            part, first = keys[starts[k] : starts[k] + sizes[k]], was if k == 0 else 0
            if k == last:  # goes on: all but its last key go out now
                part, open_rest = part[:-1], part[-1:]
            block = (first + np.arange(len(part))) // BLOCK
            if len(part):
                yield out(np.full(len(part), bucket[starts[k]]), part, None, block, None)
            if k == last:
                open_keys, open_bucket, seen = open_rest, bucket[starts[k]], first + len(part)
        if more and not large[-1]:
            open_keys, open_bucket, seen = keys[starts[-1] :], bucket[starts[-1]], 0
        if not more:
            open_keys, open_bucket, seen = keys[:0], None, 0
        small = ~large
        small[last:] = False
        keep = np.repeat(small, sizes)
        a, b = _pairs_within(sizes[small], keys[keep])
        for i in range(0, len(a), 100_000):
            yield out(None, a[i : i + 100_000], b[i : i + 100_000], None, None)

    for batch in batches:
        item = batch.column("item")
        plain = item.is_null().to_numpy(zero_copy_only=False)
        if not plain.all():
            yield out(None, None, None, None, item.filter(pa.array(~plain)))
        if plain.any():
            rest = batch.filter(pa.array(plain))
            yield from finish(rest.column("bucket").to_numpy(zero_copy_only=False), rest.column("k0").to_numpy(zero_copy_only=False), True)
    yield from finish(np.zeros(0, np.int64), np.zeros(0, np.int64), False)


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of two blocks, or of one, whose members do not have the same label; rows come sorted by unit."""
    unit, held = None, []

    def pairs() -> Iterator[pa.RecordBatch]:
        side, key, label = (np.array([r[i] for r in held]) for i in range(3))
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        if len(right):
            i, j = np.repeat(left, len(right)), np.tile(right, len(left))
        else:
            i, j = (left[x] for x in np.triu_indices(len(left), 1))
        use = label[i] != label[j]
        i, j = i[use], j[use]
        for k in range(0, len(i), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(key[i], key[j])[k : k + 100_000]), pa.array(np.maximum(key[i], key[j])[k : k + 100_000])], names=["a", "b"])

    for batch in batches:
        for b, i, j, side, key, label in zip(*[batch.column(c).to_pylist() for c in ("bucket", "i", "j", "side", "key", "label")], strict=True):
            if (b, i, j) != unit:
                if held:
                    yield from pairs()
                unit, held = (b, i, j), []
            held.append((side, key, label))
    if held:
        yield from pairs()


def _block_pairs(members: DataFrame) -> DataFrame:
    """(a, b) of all pairs of members (bucket, a, block, label) of a bucket that differ in their label, block by block."""
    blocks = members.groupBy("bucket").agg(F.max("block").alias("last"))
    listed = members.join(blocks, "bucket")
    unit = lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j"), (F.col("block") > x).cast("int").alias("side"))
    copies = listed.select("bucket", F.col("a").alias("key"), "label", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), "last"), unit)).alias("u"))
    rows = copies.select("bucket", "u.i", "u.j", "u.side", "key", "label")
    return rows.repartition(F.col("bucket"), F.col("i"), F.col("j")).sortWithinPartitions("bucket", "i", "j", "side").mapInArrow(_cross, "a bigint, b bigint")


def _check(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, a, b = (batch.column(c).to_pylist() for c in ("kind", "text_a", "text_b"))
            keep, held = [], {}
            for k, x, y in zip(kind, a, b, strict=True):
                if x not in held:
                    held = {x: features(k, x)}
                f, g = held[x], features(k, y)
                common = len(f & g)
                keep.append(common > 0 and common >= threshold * (len(f) + len(g) - common) - 1e-9)
            yield batch.select(["kind", "a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class NearDuplicates:
    """Classes of equal texts, links between different texts, and what follows from them.

    Similarity is the shared features over all features of both. Chunk texts under 50 words and titles under 20 characters
    take no part, nor do null ids. Banding finds a pair at similarity 0.6 with probability 0.9987 and one at 0.7 with
    0.999997; what is found is checked exactly. An item delivered with two texts takes part with each. Texts with the same
    words in the same order (a 128-bit key) are a class, named by its smallest id.
    """

    def __init__(self, chunks: DataFrame, notes: DataFrame, threshold: float = 0.6) -> None:
        self.source = source = items(chunks, notes)
        self.threshold = threshold
        # the smallest agreement of one-bit values that a pair at the threshold shows, less five standard deviations
        p = (1 + threshold) / 2
        self.least = int(VALUES * p - 5 * (VALUES * p * (1 - p)) ** 0.5)
        spark = source.sparkSession
        number = chunks.count() + notes.count()
        signed = source.mapInArrow(_sign, SIGNED)
        rows = signed.select(F.explode(F.concat(F.array(F.struct("item", F.lit(None).cast("bigint").alias("bucket"), "k0")), F.coalesce(F.transform("buckets", lambda b: F.struct(F.lit(None).cast(ITEM_SQL).alias("item"), b.alias("bucket"), F.col("k0"))), F.array()))).alias("r")).select("r.*")
        if number > MANY:
            rows = self._spread(rows, source, number)
        tasks = max(partitions(spark), -(-number * BANDS // ROWS_A_TASK))
        met = rows.repartition(tasks, F.coalesce("bucket", "k0")).sortWithinPartitions("bucket", "k0").mapInArrow(_meet, MET)
        self.met = met = written(met)
        self.items = met.filter("item is not null").select("item.*").withColumn("kind", F.col("kind").cast("int"))
        self.members = self.items.select("kind", "k0", "k1", "id").distinct()
        self.classes = self.items.groupBy("kind", "k0", "k1").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("n"))

    @staticmethod
    def _spread(rows: DataFrame, source: DataFrame, number: int) -> DataFrame:
        """``rows`` with each hot bucket as pairs of salted blocks; hot ones are found in a sample of at most SAMPLE texts.

        A bucket with 1/1000 of the sample's texts or more is hot, so there are at most 1000 x BANDS of them.
        """
        bound = min(2**63 - 1, int(-(2**63) + 2**64 * SAMPLE / number))
        some = source.filter(F.xxhash64("id", F.lit("hot")) < F.lit(bound)).mapInArrow(_sign, SIGNED)
        counts = some.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().filter(F.col("count") >= SAMPLE // 1000)
        hot = F.broadcast(counts.select("bucket", F.least(F.lit(1024), F.ceil(F.col("count") * 1000 / SAMPLE) * 2).cast("int").alias("salts")))
        joined = rows.join(hot, "bucket", "left")
        mine = F.pmod(F.xxhash64("k0"), F.col("salts")).cast("int")
        units = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda x: F.xxhash64("bucket", F.least(mine, x), F.greatest(mine, x)))
        each = F.explode(F.when(F.col("salts").isNull(), F.array("bucket")).otherwise(units))
        return joined.select("item", each.alias("bucket"), "k0")

    def _texts(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(kind, k0, text) of the classes in some pairs, for either end.

        A filter of fixed size tells most of the other texts before anything is exchanged.
        """
        reps = self.classes.select("kind", "k0", F.col("rep").alias("id"))
        ends = pairs.select("kind", F.explode(F.array("a", "b")).alias("k0")).distinct()
        needed = written(reps.join(ends, ["kind", "k0"]))
        slot = F.shiftrightunsigned(F.xxhash64("kind", "id"), 64 - SLOTS)
        bits = needed.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
        likely = self.source.withColumn("word", F.shiftright(slot, 6)).join(F.broadcast(bits), "word").filter(F.getbit("bits", slot.bitwiseAND(F.lit(63)).cast("int")) == 1)
        text = likely.select("kind", "id", "text").join(needed, ["kind", "id"]).select("kind", "k0", "text")
        return text.select("kind", F.col("k0").alias("a"), F.col("text").alias("text_a")), text.select("kind", F.col("k0").alias("b"), F.col("text").alias("text_b"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(kind, rep_a, rep_b), smaller first: those of the candidates (a, b) that really are similar."""
        one = self.items.groupBy("kind", "k0").agg(*[F.first(c).alias(c) for c in ("s0", "s1", "s2")])
        side = lambda x: one.select("kind" if x == "a" else F.col("kind").alias("kind_b"), F.col("k0").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("s0", "s1", "s2")])
        both = pairs.repartition("a").distinct().join(side("a"), "a").join(side("b"), "b").filter("kind = kind_b")
        differ = sum((F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(1, 3)), F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))))
        likely = written(both.filter(VALUES - differ >= self.least).select("kind", "a", "b"))
        text_a, text_b = self._texts(likely)
        found = likely.join(text_a, ["kind", "a"]).join(text_b, ["kind", "b"]).select("kind", "a", "b", "text_a", "text_b").mapInArrow(_check(self.threshold), "kind int, a bigint, b bigint").distinct()
        name = lambda x: self.classes.select("kind", F.col("k0").alias(x), F.col("rep").alias(f"rep_{x}"))
        named = found.join(name("a"), ["kind", "a"]).join(name("b"), ["kind", "b"])
        return named.select("kind", F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b")).filter("rep_a <> rep_b").distinct()

    def _small(self) -> DataFrame:
        return self.met.filter("b is not null").select("a", "b")

    def _large(self) -> DataFrame:
        return self.met.filter("block is not null").select("bucket", "a", "block")

    def links(self) -> DataFrame:
        """(kind, rep_a, rep_b): every two classes that are similar."""
        return self.verified(self._small().unionByName(_block_pairs(self._large().withColumn("label", F.col("a")))))

    def pairs(self, expand: int | None = None) -> DataFrame:
        """(item_table, id_a, id_b), the smaller id first: every pair, whatever the size of its class.

        With ``expand``, more than so many exact copies (equal to the character) are written as representative plus
        membership: their smallest id takes part in all pairs, and each copy is paired with it alone. Texts of a class that
        differ in case, punctuation or markup are no copies and are paired in full.
        """
        out, tied = self.members.join(self.classes, ["kind", "k0", "k1"]), None
        if expand is not None:
            raw = self.source.select("kind", "id", F.xxhash64("text").alias("r0"), F.xxhash64(F.lit("raw"), "text").alias("r1")).distinct()
            copies = out.join(raw, ["kind", "id"])
            key = ["kind", "k0", "k1", "r0", "r1"]
            sized = copies.join(copies.groupBy(key).agg(F.min("id").alias("first"), F.count("*").alias("copies")), key)
            tied = sized.filter(F.col("copies") > expand).select("kind", F.col("first").alias("id_a"), F.col("id").alias("id_b"))
            out = sized.filter((F.col("copies") <= expand) | (F.col("id") == F.col("first"))).select("kind", "k0", "k1", "rep", "n", "id").distinct()
        side = lambda x: out.select("kind", F.col("rep").alias(f"rep_{x}"), F.col("id").alias(f"id_{x}"))
        across = self.links().join(side("a"), ["kind", "rep_a"]).join(side("b"), ["kind", "rep_b"]).select("kind", "id_a", "id_b")
        own = lambda x: out.filter("n > 1").select("kind", "k0", "k1", F.col("id").alias(f"id_{x}"))
        within = own("a").join(own("b"), ["kind", "k0", "k1"]).filter("id_a < id_b").select("kind", "id_a", "id_b")
        every = across.unionByName(within)
        every = (every if tied is None else every.unionByName(tied)).filter("id_a <> id_b")
        return every.select(F.when(F.col("kind") == TEXTS, "chunks").otherwise("notes").alias("item_table"), F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()

    def groups(self) -> DataFrame:
        """(item_table, id, class_id, group_id): each item with its class of equal texts and its connected group.

        Both are named by their smallest member. Large buckets are not compared in full: each of their texts is first
        compared with one representative, and only texts of a bucket that this leaves in different groups are compared
        with each other, so no link between groups is lost and variants of one template cost a comparison each.
        """
        large = self._large()
        star = large.join(large.groupBy("bucket").agg(F.min("a").alias("r")), "bucket").filter("a <> r").groupBy("a").agg(F.min("r").alias("b"))
        links = cut(self.verified(self._small().unionByName(star)))
        # an item delivered with two texts belongs to two classes: it links them
        classed = self.members.join(self.classes.select("kind", "k0", "k1", "rep"), ["kind", "k0", "k1"]).select("kind", "k0", "id", "rep")
        edges = links.select("kind", F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).unionByName(classed.filter("id <> rep").select("kind", F.col("id").alias("a"), F.col("rep").alias("b")))
        group = components(edges)
        if not large.isEmpty():
            label = classed.join(group, ["kind", "id"], "left").groupBy(F.col("k0").alias("a")).agg(F.min(F.coalesce("component", "id")).alias("label"))
            torn = large.join(label, "a")
            torn = torn.join(torn.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("bucket"), "bucket", "left_semi")
            rest = self.verified(_block_pairs(torn.select("bucket", "a", "block", "label")))
            group = components(edges.unionByName(rest.select("kind", F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))))
        ids = classed.groupBy("kind", "id").agg(F.min("rep").alias("class_id"))
        joined = ids.join(group, ["kind", "id"], "left")
        return joined.select(F.when(F.col("kind") == TEXTS, "chunks").otherwise("notes").alias("item_table"), "id", "class_id", F.coalesce("component", "id").alias("group_id"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(kind, id, component): connected components of the edges (kind, a, b), named by their smallest id.

    Alternates large-star and small-star rounds on the edge table; every round is written to the shared folder, and only a
    checksum comes to the driver.
    """
    e = edges.filter("a <> b").select("kind", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = cut(e), None
    for _ in range(most_rounds):
        twice = e.unionByName(e.select("kind", F.col("v").alias("u"), F.col("u").alias("v")))
        least = twice.groupBy("kind", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = twice.join(least, ["kind", "u"]).filter("v > u").select("kind", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("kind", "u").agg(F.min("v").alias("m"))
        hung = large.join(least, ["kind", "u"])
        small = hung.filter("v <> m").select("kind", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("kind", "u", F.col("m").alias("v")))
        e = cut(small.filter("u <> v").distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("kind", "u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    roots = e.select("kind", F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select("kind", F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
