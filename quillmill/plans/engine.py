"""The engine: search, notes, links, status and evaluation over a set of tables, as lazy DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.keys import link_key
from ..functions.text import iso_time, parse_time
from ..functions.vectors import Embedder, HashEmbedder, embed
from ..operators import graph, ranking
from ..operators.filters import SearchFilters, path_prefix, predicate
from ..sources import files as sources
from ..streaming.snapshots import Manifest, SnapshotStore
from . import evaluate

MODES = ("keyword", "semantic", "hybrid")
#: Characters of a note's content that are shown.
MOST_SHOWN = 200_000


class Engine:
    """One state of a vault: tables notes, tags, links, chunks (with ``embedding`` for semantic search), postings and files.

    Without stored postings the asked terms are counted on the way. A model that cannot be loaded leaves keyword search;
    ``model_error`` then says why.
    """

    def __init__(self, notes: DataFrame, tags: DataFrame, links: DataFrame, chunks: DataFrame, postings: DataFrame | None = None, files: DataFrame | None = None, embedder: Callable[[], Embedder] | None = HashEmbedder, config: EngineConfig = EngineConfig(), root: str | None = None, manifest: Manifest | None = None) -> None:
        self.notes, self.links, self.chunks, self.postings, self.config, self.root, self.manifest = notes, links, chunks, postings, config, root, manifest
        self.tags = ranking.tag_lists(tags, F.col("tag"))
        self.files = files.select("path") if files is not None else notes.select("path")
        self.model_error: str | None = None
        self.embedder = embedder if embedder and "embedding" in chunks.columns else None
        if self.embedder:
            try:
                self.embedder()
            except Exception as e:  # whatever a model's own loader raises
                self.embedder, self.model_error = None, str(e)
        self.indexed = ranking.indexed_chunks(chunks, notes, self.tags)
        self.spark: SparkSession = notes.sparkSession
        self._resolver: DataFrame | None = None

    @classmethod
    def open(cls, store: SnapshotStore, **given) -> Engine:
        """The engine over a store's current snapshot."""
        base = store.current()
        if base is None:
            raise LookupError("nothing has been indexed yet")
        return cls(*[store.read(t, base) for t in ("notes", "tags", "links", "chunks", "postings", "files")], manifest=base, **given)

    def rank(self, queries: DataFrame, limit: int = 8, filters: SearchFilters = SearchFilters(), mode: str = "hybrid") -> DataFrame:
        """(qid, chunk_id, score, match, rank) for a table of queries (qid, query, [vector])."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        limit = max(1, min(limit, 50))
        depth = max(50, 5 * limit)
        among = None if filters == SearchFilters() else self.indexed.filter(predicate(filters)).select("chunk_id")
        empty = queries.select("qid", F.lit(0).cast("bigint").alias("chunk_id"), F.lit(0).alias("rank")).filter(F.lit(False))
        keyword = semantic = empty
        if mode != "semantic":
            if self.postings is not None and self.manifest is not None:
                held = self.manifest.statistics
                scored = ranking.bm25_stored(queries, self.postings, (held["chunks"], held["tokens"]), among, self.config, depth)
            else:
                scored = ranking.bm25(queries, self.indexed, None if among is None else predicate(filters), self.config, depth)
            keyword = ranking.top(scored, depth)
        if mode != "keyword" and self.embedder:
            asked = queries if "vector" in queries.columns else embed(queries.select("qid", "query"), "query", self.embedder, "vector", queries=True)
            vectors = self.chunks.select("chunk_id", "embedding")
            semantic = ranking.cosine_top(vectors if among is None else vectors.join(among, "chunk_id", "left_semi"), asked, depth)
        return ranking.fuse(keyword, semantic, limit, self.config)

    def filters(self, modified_after: str | None = None, modified_before: str | None = None, **given) -> SearchFilters:
        """Search filters with times as ISO 8601 text; those without an offset are in the configured zone."""
        at = lambda t: None if t is None else parse_time(t, self.config.timezone)
        return SearchFilters(modified_after=at(modified_after), modified_before=at(modified_before), **({"inbox": self.config.inbox} | given))

    def search(self, query: str, limit: int = 8, mode: str = "hybrid", filters: SearchFilters = SearchFilters()) -> DataFrame:
        """The best chunks for one query, best first."""
        if not query.strip():
            raise ValueError("the query is empty")
        one = self.spark.createDataFrame([(0, query)], "qid bigint, query string")
        # at most 50 rows: with them known, the tables they are shown from are read for those chunks only
        best = self.rank(one, limit, filters, mode).collect()
        ranked = self.spark.createDataFrame(best, "qid bigint, chunk_id bigint, score double, match string, rank int")
        chunks = self.chunks.filter(F.col("chunk_id").isin([r["chunk_id"] for r in best]))
        paths = [r["path"] for r in chunks.select("path").distinct().collect()]
        here = lambda df: df.filter(F.col("path").isin(paths))
        return ranking.hits(ranked, ranking.indexed_chunks(chunks, here(self.notes), here(self.tags))).drop("qid").orderBy("rank")

    def path_of(self, name: str) -> str:
        """The path a user means by a path or a name."""
        if self._resolver is None:  # one for each state
            self._resolver = graph.best_files(self.files).persist()
        keys = [r["k"] for r in self.spark.createDataFrame([(0, name), (1, name + ".md")], "i int, target string").orderBy("i").select(link_key(F.col("target")).alias("k")).collect()]
        exact = self.files.filter(F.col("path") == name).first()
        found = {r["key"]: r["path"] for r in self._resolver.filter(F.col("key").isin(keys)).collect()}
        path = exact["path"] if exact else found.get(keys[0]) or found.get(keys[1])
        if path is None:
            raise LookupError(f"nothing is called {name}")
        return path

    def get_note(self, name: str) -> DataFrame:
        """One note by path or name: its fields, tags, resolved links and content; LookupError if there is none.

        With a root folder the file is read and parsed anew, so that edits since the last index run show; else the content
        is put together from the chunks. Longer contents are cut at MOST_SHOWN characters and ``truncated``.
        """
        path = self.path_of(name)
        here = self.spark.createDataFrame([(path,)], "path string")
        known = self.notes.filter(F.col("path") == path)
        if self.root is not None:
            live = sources.scan(self.spark, self.root, [path]).filter(F.col("path") == path)
            parsed = sources.parse_files(live, self.config.max_document_mb, self.config.max_chars, self.config.overlap)
            tags = sources.parsed_tags(parsed)
            links = sources.links_of(parsed)
            fields = parsed.select("path", "kind", "title", "frontmatter", "status", F.col("content_hash").alias("sha"))
            text = F.when(F.col("kind") == "md", F.decode("content", "UTF-8")).otherwise(F.col("extracted"))
            extracted = sources.chunks_of(parsed).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda c: c["text"]), "\n\n").alias("extracted"))
            content = live.select("path", "kind", "content").join(extracted, "path", "left").select("path", text.alias("content"))
            times = known.select("path", "modified")
        else:
            tags, links = self.tags, self.links.filter(F.col("src") == path)
            fields = known.select("path", "kind", "title", "frontmatter", "status", F.col("content_hash").alias("sha"))
            content = self.chunks.filter(F.col("path") == path).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda c: c["text"]), "\n\n").alias("content"))
            times = known.select("path", "modified")
        out = here.join(fields, "path", "left").join(tags, "path", "left").join(graph.outgoing(links, self.files).withColumnRenamed("src", "path"), "path", "left").join(content, "path", "left").join(times, "path", "left")
        shown = out.withColumn("truncated", F.coalesce(F.length("content") > MOST_SHOWN, F.lit(False))).withColumn("content", F.substring("content", 1, MOST_SHOWN))
        return shown.withColumn("modified_at", iso_time(F.col("modified"), self.config.timezone)).withColumn("indexed", F.lit(known.first() is not None))

    def list_notes(self, prefix: str = "", limit: int = 200) -> DataFrame:
        """Notes under a prefix in the order of their paths, with the total of all and whether some are not shown."""
        found = self.notes.filter(path_prefix(F.col("path"), prefix))
        total = found.count()
        limit = max(1, min(limit, 1000))
        return found.select("path", "title", "kind", "status", "modified").orderBy("path").limit(limit).withColumn("total", F.lit(total)).withColumn("truncated", F.lit(total > limit))

    def backlinks(self, name: str) -> DataFrame:
        """Links of other notes to one note, by source and line; only links that could mean it are resolved."""
        path = self.path_of(name)
        keys = graph.file_keys(self.spark.createDataFrame([(path,)], "path string")).select(F.col("key").alias("target_key"))
        could = self.links.join(F.broadcast(keys.distinct()), "target_key", "left_semi")
        return graph.backlinks(could, self.files, self.notes).filter(F.col("path") == path).orderBy("src", "line")

    def status(self) -> DataFrame:
        """One row: notes, chunks, whether vectors are used, why not, and since when and by which model the index is."""
        base = self.manifest
        about = [F.lit(self.embedder is not None).alias("semantic_search"), F.lit(self.model_error).cast("string").alias("model_error"), F.lit(base.model if base else None).cast("string").alias("model"), F.timestamp_seconds(F.lit(base.indexed_at if base else None).cast("double")).alias("indexed_at")]
        counts = self.notes.select(F.lit("notes").alias("what")).unionByName(self.chunks.select(F.lit("chunks").alias("what")))
        return counts.agg(F.count_if(F.col("what") == "notes").alias("notes"), F.count_if(F.col("what") == "chunks").alias("chunks")).select("notes", "chunks", *about)

    def _note_ranks(self, queries: DataFrame, k: int, mode: str) -> DataFrame:
        return evaluate.note_ranks(self.rank(queries, min(50, max(3 * k, 20)), mode=mode), self.chunks, k)

    def evaluate(self, queries: DataFrame, k: int = 5, modes: tuple[str, ...] = MODES) -> dict[str, list]:
        """Metrics for each mode: rows of (grp, n, hit1, recall, mrr)."""
        return {mode: evaluate.report(evaluate.query_rows(queries, self._note_ranks(queries, k, mode))).collect() for mode in modes}

    def misses(self, queries: DataFrame, k: int = 5, mode: str = "hybrid") -> DataFrame:
        """(qid, query) of the queries of which no relevant note is among the first k."""
        return evaluate.not_found(evaluate.query_rows(queries, self._note_ranks(queries, k, mode)), queries)

    def missing_paths(self, queries: DataFrame) -> DataFrame:
        """(path): relevant paths that no note has."""
        return evaluate.missing_relevant(queries, self.notes)

    def latency(self, queries: list[str], mode: str = "hybrid", limit: int = 8) -> dict[str, float]:
        """Nearest-rank p50 and p95 of milliseconds of single searches, one after another."""
        took = []
        for query in queries:
            began = time.time()
            self.search(query, limit, mode).collect()
            took.append((time.time() - began) * 1000)
        values = self.spark.createDataFrame([(took,)], "v array<double>")
        return values.select(*[evaluate.percentile(F.col("v"), p).alias(f"p{p}") for p in (50, 95)]).first().asDict()


def benchmark(spark: SparkSession, root: str, place: str, queries: DataFrame, models: dict[str, Callable[[], Embedder]], k: int = 5) -> dict[str, dict]:
    """For each model an index of its own under ``place``, the seconds to build it and the metrics of semantic and hybrid search."""
    from dataclasses import replace

    from ..streaming.sync import Indexer

    out = {}
    for name, model in models.items():
        config = replace(EngineConfig(), embedding_model=name)
        store = SnapshotStore(spark, f"{place}/{name}")
        stats = Indexer(store, root, model, config).run(True)
        out[name] = {"seconds": stats.seconds, "metrics": Engine.open(store, embedder=model, config=config).evaluate(queries, k, ("semantic", "hybrid"))}
    return out



