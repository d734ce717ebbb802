"""Ranked retrieval for one query or many at once: BM25 over weighted columns, exact cosine, reciprocal rank fusion.

A query set is a table (qid, query); all of its queries run in one plan. Keyword search reads stored postings, which are
clustered by term, so a scan fetches the row groups of the asked terms only. Corpus statistics always cover the whole
corpus, whatever the filters. Query sets of any size meet the postings and vectors in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import TOKEN, query_terms, tokens
from ..functions.vectors import cosine_distance
from ..session import cut, written
from . import scoring
from .scoring import DIGITS

FLOOR = 1e-6
#: Rows (query, phrase) and numbers of query vectors that are broadcast at once: at most 64 MB of either.
ASKED, MATRIX = 500_000, 8_000_000
#: Rows (query, phrase) that are held by the driver.
FEW = 1000
#: Postings of a term in a chunk: the places of the term in each column, and the chunk's tokens in all.
POSTINGS = "term string, chunk_id bigint, path_key bigint, size int, title array<int>, headings array<int>, text array<int>"


def current_notes(notes: DataFrame) -> DataFrame:
    """One row for each path: the delivery with the largest modified, then hash. Null paths are left out."""
    rest = [c for c in notes.columns if c != "path"]
    newest = F.max_by(F.struct(*rest), F.struct(F.coalesce("modified", F.lit(-1)), F.coalesce("content_hash", F.lit("")))).alias("n")
    return notes.filter("path is not null").groupBy("path").agg(newest).select("path", "n.*")


def tag_lists(tags: DataFrame, normalise: Column) -> DataFrame:
    """(path, tags): the sorted distinct tags of each path; null and empty tags left out."""
    return tags.select("path", normalise.alias("tag")).filter("tag is not null and tag <> ''").groupBy("path").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def indexed_chunks(chunks: DataFrame, notes: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """What is searched: chunks of known notes with their note's columns; repeated rows count once."""
    own = chunks.select("chunk_id", "path", "ord", "headings", "text").dropDuplicates(["chunk_id"])
    noted = own.join(notes.select("path", "kind", "title", "status", "modified"), "path")
    if tags is None:
        return noted.withColumn("tags", F.array().cast("array<string>"))
    return noted.join(tags, "path", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def tokenised(indexed: DataFrame, *keep: str) -> DataFrame:
    """(chunk_id, title, headings, text as token arrays, size): tokens of each column and of all columns together."""
    parts = indexed.select("chunk_id", *keep, tokens(F.col("title")).alias("title"), tokens(F.array_join("headings", " ")).alias("headings"), tokens(F.col("text")).alias("text"))
    return parts.withColumn("size", F.size("title") + F.size("headings") + F.size("text"))


def query_phrases(queries: DataFrame) -> DataFrame:
    """(qid, phrase, words): the phrases of each query; a term with an underscore is a phrase of several tokens.

    Distinct terms can have one phrase (``que``, ``qué``); it then has a row, and counts, for each of them.
    """
    terms = queries.select("qid", F.explode(query_terms(F.col("query"))).alias("term")).distinct()
    parts = terms.select("qid", tokens(F.col("term")).alias("parts")).filter(F.size("parts") > 0)
    return parts.select("qid", F.array_join("parts", " ").alias("phrase"), F.size("parts").alias("words"))


def postings(indexed: DataFrame) -> DataFrame:
    """The inverted index (see POSTINGS) of chunks with their note's title; a chunk's rows are made where the chunk is.

    Null columns have no tokens; chunks without any token have no rows. ``path_key`` is a hash of the chunk's path.
    """
    docs = tokenised(indexed.withColumn("path_key", F.xxhash64("path") if "path" in indexed.columns else F.lit(None).cast("bigint")), "path_key")
    places = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for chunk, path, size, *columns in zip(*[b.column(c).to_pylist() for c in ("chunk_id", "path_key", "size", "title", "headings", "text")], strict=True):
                found: dict[str, tuple[list, list, list]] = {}
                for c, tokens_ in enumerate(columns):
                    for i, t in enumerate(tokens_):
                        found.setdefault(t, ([], [], []))[c].append(i)
                for t, at in found.items():
                    for values, v in zip(out, (t, chunk, path, size, *at), strict=True):
                        values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.int32(), places, places, places), strict=True)], names=["term", "chunk_id", "path_key", "size", "title", "headings", "text"])

    return docs.select("chunk_id", "path_key", "size", "title", "headings", "text").mapInArrow(run, POSTINGS)


def by_term(stored: DataFrame) -> DataFrame:
    """Postings laid out for storing: in ranges of terms, a hot term over several of them, sorted, so that scans can skip."""
    return stored.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id")


def corpus_statistics(indexed: DataFrame) -> tuple[int, int]:
    """(chunks, tokens) of the whole corpus."""
    r = tokenised(indexed).agg(F.count("*").alias("n"), F.sum("size").alias("t")).first()
    return r["n"], r["t"] or 0


def _frequencies(stored: DataFrame, phrases: DataFrame, config: EngineConfig) -> DataFrame:
    """(phrase, chunk_id, size, f): how often each asked phrase is in each chunk, weighted by columns."""
    weights = (("title", config.title_weight), ("headings", config.headings_weight), ("text", config.text_weight))
    parts = phrases.select("phrase", F.posexplode(F.split("phrase", " ")).alias("i", "term"), "words").distinct()
    weighed = lambda column: sum((F.lit(w) * F.size(column(c)) for c, w in weights[1:]), F.lit(weights[0][1]) * F.size(column(weights[0][0])))
    single = stored.join(parts.filter("words = 1"), "term").select("phrase", "chunk_id", "size", weighed(F.col).alias("f"))
    # the parts of a phrase stand side by side: their places, each less its place in the phrase, agree
    shifted = [F.transform(c, lambda x: x - F.col("i")).alias(c) for c, _ in weights]
    held = stored.join(parts.filter("words > 1"), "term").select("phrase", "words", "chunk_id", "size", "i", F.struct(*shifted).alias("at"))
    met = held.groupBy("phrase", "words", "chunk_id", "size").agg(F.collect_list("at").alias("at")).filter(F.size("at") == F.col("words"))
    common = lambda c: F.reduce(F.slice("at", 2, F.col("words")), F.element_at("at", 1)[c], lambda x, y: F.array_intersect(x, y[c]))
    return single.unionByName(met.select("phrase", "chunk_id", "size", weighed(common).alias("f")).filter("f > 0"))


def bm25_stored(queries: DataFrame, stored: DataFrame, statistics: tuple[int, int], among: DataFrame | None = None, config: EngineConfig = EngineConfig(), k: int | None = None) -> DataFrame:
    """(qid, chunk_id, score) of the chunks that match a query, from stored postings and the (chunks, tokens) of the corpus.

    With ``k`` only rows that can be among the k best of their query are sure to come out. ``among`` (chunk_id) keeps only
    those chunks; it goes below the scoring, and the statistics stay those of the corpus.
    Each distinct query term counts once. Terms in half of the chunks or more weigh next to nothing. Queries without terms have no
    rows. The postings of the asked terms are fetched once; scores are then summed where a chunk's postings lie, so only
    the k best of each part are exchanged.
    """
    phrases = query_phrases(queries)
    rows = phrases.limit(FEW + 1).collect()
    if len(rows) <= FEW:  # few terms reach the scan as a filter, and scans of theirs are cheap enough to be made twice
        phrases = queries.sparkSession.createDataFrame(rows, phrases.schema)
        tf = _frequencies(stored.filter(F.col("term").isin(sorted({t for r in rows for t in r["phrase"].split(" ")}))), phrases.select("phrase", "words").distinct(), config)
    else:
        phrases = cut(phrases)
        terms = phrases.select(F.explode(F.split("phrase", " ")).alias("term")).distinct()
        tf = cut(_frequencies(stored.join(terms, "term", "left_semi"), phrases.select("phrase", "words").distinct(), config))
    n, tokens_ = statistics
    names, qid, term = _asked(phrases)
    held = {r["phrase"]: r["df"] for r in tf.groupBy("phrase").agg(F.count("*").alias("df")).collect()}
    numbers = queries.sparkSession.createDataFrame(pa.table({"phrase": pa.array(names, pa.string()), "id": pa.array(range(len(names)), pa.int32())}))
    if among is not None:
        tf = tf.join(among.select("chunk_id"), "chunk_id", "left_semi")
    groups, parts = scoring.plan(queries.sparkSession, len(np.unique(qid)), len(qid), k, ASKED)
    placed = tf.join(numbers, "phrase").repartition(parts, "chunk_id").groupBy(F.col("chunk_id").cast("bigint").alias("chunk_id")).agg(F.first("size").alias("size"), F.collect_list(F.struct("id", F.col("f").cast("double").alias("f"))).alias("at"))
    counts = placed.select("chunk_id", "size", F.col("at.id").alias("ids"), F.col("at.f").alias("f"))
    counts = counts if groups == 1 else written(counts).coalesce(parts)
    return scoring.best_scores(counts, qid, term, _weights(n, np.array([held.get(x, 0) for x in names], np.int64)), tokens_ / n if n and tokens_ else 1.0, k, config.k1, config.b, groups)


def _asked(phrases: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct phrases in order, and the pairs (qid, number of the phrase): columns, so 12 bytes a pair."""
    got = phrases.select("qid", "phrase").toArrow()
    names = sorted(got.column("phrase").unique().to_pylist())
    number = pc.index_in(got.column("phrase"), value_set=pa.array(names, pa.string())).combine_chunks()
    return names, got.column("qid").combine_chunks().to_numpy().astype(np.int64), number.to_numpy()


def _weights(n: int, df: np.ndarray) -> np.ndarray:
    """The weight of each phrase, of which ``df`` of n chunks hold it."""
    with np.errstate(invalid="ignore", divide="ignore"):
        idf = np.log((float(n) - df + 0.5) / (df + 0.5))
    return np.where(idf > 0, idf, FLOOR)


def bm25_of(queries: DataFrame, chunks: DataFrame, notes: DataFrame, tags: DataFrame | None = None, wanted: Column | None = None, config: EngineConfig = EngineConfig(), k: int | None = None) -> DataFrame:
    """:func:`bm25` of the chunks of ``notes``, of which only counts of the asked phrases are exchanged and never texts.

    ``wanted`` is a predicate over the notes' columns and ``tags``; as everywhere it leaves the statistics as they are.
    """
    names, qid, term = _asked(query_phrases(queries))
    own = scoring.counted(chunks.select("chunk_id", "path", "headings", "text"), names, {"headings": (F.array_join("headings", " "), config.headings_weight), "text": (F.col("text"), config.text_weight)}).dropDuplicates(["chunk_id"])
    noted = notes.select("path", "kind", "title", "status", "modified")
    if wanted is None:
        kept = noted.select("path", "title", F.lit(True).alias("wanted"))
    else:
        tagged = noted.withColumn("tags", F.array().cast("array<string>")) if tags is None else noted.join(tags, "path", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
        kept = tagged.select("path", "title", F.coalesce(wanted, F.lit(False)).alias("wanted"))
    titles = scoring.counted(kept, names, {"title": (F.col("title"), config.title_weight)}).select("path", "wanted", *[F.col(c).alias(f"title_{c}") for c in ("size", "ids", "f")])
    counts = written(scoring.merged(own.join(titles, "path"), len(names)))
    n, tokens_, df = scoring.statistics(counts, len(names))
    groups, parts = scoring.plan(queries.sparkSession, len(np.unique(qid)), len(qid), k, ASKED)
    # one row a chunk: parts are joined files, without an exchange
    scanned = counts.filter("wanted").select("chunk_id", "size", "ids", "f").coalesce(parts)
    return scoring.best_scores(scanned, qid, term, _weights(n, df), tokens_ / n if n and tokens_ else 1.0, k, config.k1, config.b, groups)


def bm25(queries: DataFrame, indexed: DataFrame, wanted: Column | None = None, config: EngineConfig = EngineConfig(), k: int | None = None) -> DataFrame:
    """:func:`bm25_stored` of chunks that have no stored postings; ``wanted`` is a predicate over ``indexed``'s columns."""
    return bm25_stored(queries, postings(indexed), corpus_statistics(indexed), None if wanted is None else indexed.filter(wanted), config, k)


def top(scored: DataFrame, k: int, best_first: bool = True) -> DataFrame:
    """(qid, chunk_id, score, rank): the k best of each query; Spark limits each partition before it shuffles."""
    value = F.round("score", DIGITS)
    order = Window.partitionBy("qid").orderBy(value.desc() if best_first else value.asc_nulls_last(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cosine(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, chunk_id, score): cosine distances of every chunk's ``embedding`` to every query's ``vector``.

    The scan is exact. ``queries`` is a stated query set of bounded size that meets all rows block by block; chunks without
    an embedding are left out; a zero vector or one of another length has the distance null and is ranked last.
    """
    asked = queries.select("qid", "vector").filter("vector is not null")
    return vectors.filter("embedding is not null").join(asked, F.lit(True)).select("qid", "chunk_id", cosine_distance(F.col("embedding"), F.col("vector")).alias("score"))


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, score, rank): the k nearest chunks of each query, as :func:`top` of :func:`cosine` gives them.

    The query vectors are multiplied with each Arrow batch of vectors in matrices of up to MATRIX numbers, one for each
    length of vectors, and each batch only passes on what can still be among the k.
    """
    asked = queries.select("qid", "vector").filter("vector is not null").withColumn("width", F.size("vector"))
    counts = {r["width"]: r["count"] for r in asked.groupBy("width").count().collect()}
    near = None
    for width, number in sorted(counts.items()):
        blocks = max(1, -(-number * width // MATRIX))
        for i in range(blocks):
            mine = asked.filter((F.col("width") == width) & (F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i))
            one = _nearest(vectors, mine.collect(), width, k)
            near = one if near is None else near.unionByName(one)
    return top(near if near is not None else cosine(vectors.limit(0), asked), k, best_first=False)


def _nearest(vectors: DataFrame, rows: list, width: int, k: int) -> DataFrame:
    """(qid, chunk_id, score): of each batch of vectors the k nearest to each query of one block."""
    ids = np.array([r["qid"] for r in rows], np.int64)
    matrix = np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), width)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix, np.sqrt((matrix * matrix).sum(1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, norms = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            chunk = b.column("chunk_id").to_numpy()
            # a vector of another length counts as a zero vector: its score is null
            other = [0.0] * matrix.shape[1]
            block = np.array([x if len(x) == len(other) else other for x in b.column("embedding").to_pylist()], np.float64)
            # the smaller id goes first among equals
            order = np.argsort(chunk, kind="stable")
            chunk, block = chunk[order], block[order]
            length = np.sqrt((block * block).sum(1))
            for i in range(0, len(ids), 512):
                scale = length[:, None] * norms[None, i : i + 512]
                with np.errstate(divide="ignore", invalid="ignore"):
                    far = 1.0 - (block @ matrix[i : i + 512].T) / scale
                far[scale == 0] = np.nan
                best = np.argsort(np.where(np.isnan(far), np.inf, np.round(far, DIGITS)), axis=0, kind="stable")[:k]
                score = np.take_along_axis(far, best, 0).T.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i : i + 512], len(best))), pa.array(chunk[best.T.ravel()]), pa.array(score, mask=np.isnan(score))], names=["qid", "chunk_id", "score"])

    return vectors.select(F.col("chunk_id").cast("bigint").alias("chunk_id"), "embedding").filter("embedding is not null").mapInArrow(run, "qid bigint, chunk_id bigint, score double")


def fuse(keyword: DataFrame, semantic: DataFrame, limit: int, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(qid, chunk_id, score, match, rank) of the best ``limit``: the sum of 1 / (60 + rank) over both rankings.

    Ties go by the keyword rank, then by the semantic one.
    """
    both = keyword.select("qid", "chunk_id", F.col("rank").alias("k"), F.lit(None).cast("int").alias("s")).unionByName(semantic.select("qid", "chunk_id", F.lit(None).cast("int").alias("k"), F.col("rank").alias("s")))
    one = both.groupBy("qid", "chunk_id").agg(F.max("k").alias("k"), F.max("s").alias("s"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(config.rrf_k) + F.col(c)), F.lit(0.0))
    label = F.when(F.col("k").isNotNull() & F.col("s").isNotNull(), "both").when(F.col("k").isNotNull(), "keyword").otherwise("semantic")
    scored = one.withColumn("score", part("k") + part("s")).withColumn("match", label)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("k"), F.asc_nulls_last("s"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("qid", "chunk_id", F.round("score", 6).alias("score"), "match", "rank")


def hits(ranked: DataFrame, indexed: DataFrame) -> DataFrame:
    """Ranked chunks with everything that is shown of a hit."""
    return ranked.join(indexed, "chunk_id").select("qid", "rank", "path", "title", "headings", "text", "score", "match", "kind", "status", "tags", "modified")


def hits_of(ranked: DataFrame, chunks: DataFrame, notes: DataFrame, tags: DataFrame) -> DataFrame:
    """:func:`hits` of many queries: texts are exchanged to find repeated chunks, and those of the hits once more."""
    own = chunks.select("chunk_id", "path", "headings", "text").dropDuplicates(["chunk_id"])
    noted = notes.select("path", "kind", "title", "status", "modified").join(tags, "path", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return ranked.join(own, "chunk_id").join(noted, "path").select("qid", "rank", "path", "title", "headings", "text", "score", "match", "kind", "status", "tags", "modified")


def index_terms(stored: DataFrame) -> DataFrame:
    """(term, chunk_id, column, positions) of postings: a row for each column that holds the term."""
    columns = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("positions")) for c in ("title", "headings", "text")])
    return stored.select("term", "chunk_id", F.inline(columns)).filter(F.size("positions") > 0)


__all__ = ["TOKEN", "bm25", "bm25_of", "bm25_stored", "by_term", "corpus_statistics", "cosine", "cosine_top", "current_notes", "fuse", "hits", "hits_of", "index_terms", "indexed_chunks", "postings", "query_phrases", "tag_lists", "tokenised", "top"]
