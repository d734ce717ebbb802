"""Keeping the index current: an index run over a folder of files, and change feeds as Structured Streaming micro-batches."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig
from ..functions.text import content_sha
from ..functions.vectors import Embedder, HashEmbedder, embed
from ..operators import incremental, ranking
from ..operators.chunking import passage
from ..session import cut
from ..sources import files
from ..sources.paths import is_indexable
from .snapshots import Manifest, SnapshotStore

TABLES = ("notes", "tags", "links", "chunks", "postings", "files")
#: Files that are fetched by name; more are read in a scan of the whole folder.
BY_NAME = 10_000


@dataclass
class IndexStats:
    """What an index run did; ``error`` says why vectors are missing or the source could not be refreshed."""

    mode: str = "none"
    indexed: int = 0
    unchanged: int = 0
    removed: int = 0
    failed: int = 0
    seconds: float = 0.0
    error: str | None = None


class Indexer:
    """Index runs over a folder; each publishes one snapshot with all tables or leaves the old one.

    A run lists the folder without contents and compares (path, time, size) with the files it knows; only files that
    differ, that failed last time or that the caller calls dirty are read and hashed; only those with a new hash are
    parsed, embedded and written, as layers over the old tables. ``refresh`` brings the source up to date before a run; if
    it fails, the run goes on with what is there.
    """

    def __init__(self, store: SnapshotStore, root: str, embedder: Callable[[], Embedder] | None = HashEmbedder, config: EngineConfig = EngineConfig(), refresh: Callable[[], None] | None = None) -> None:
        self.store, self.root, self.embedder, self.config, self.refresh = store, root, embedder, config, refresh

    def run(self, forced: bool = False, dirty: list[str] | None = None) -> IndexStats:
        """Index what changed since the last snapshot; unchanged files only get their new time. Broken files keep their old rows."""
        began, stats = time.time(), IndexStats()
        if self.refresh is not None:
            try:
                self.refresh()
            except Exception as e:  # whatever the source's own tool raises
                stats.error = f"refresh: {e}"
        spark, base = self.store.spark, self.store.current()
        model = self._model(stats)
        rebuild = base is None or base.model != model
        known = None if rebuild else self.store.read("files", base)
        listing = cut(files.scan(spark, self.root).filter(is_indexable(F.col("path"))).select("path", "modified", "size"))
        stamp = lambda df: df.select("path", F.concat_ws(" ", "modified", "size").alias("content_hash"))
        if known is None:
            ops = listing.select("path", F.lit("A").alias("op"))
        else:
            changes = incremental.diff(stamp(known), stamp(listing))
            here = lambda df: df.join(listing, "path", "left_semi")
            named = here(spark.createDataFrame([(p,) for p in dirty or []], "path string"))
            if forced:
                named = listing.select("path")
            ops = incremental.to_recheck(changes, named, here(known.filter("failed").select("path")))
        ops = cut(ops)
        stats.mode = incremental.decide(forced, base is not None and base.model != model, base.snapshot if base else None, known is not None, ops.count())
        if stats.mode != "none":
            self._apply(base if not rebuild else None, base, known, listing, ops, model, stats)
        stats.seconds = round(time.time() - began, 3)
        return stats

    def index_paths(self, paths: list[str]) -> IndexStats:
        """Index just the named files, whatever their times; those that are gone are removed."""
        began, stats = time.time(), IndexStats(mode="incremental")
        base = self.store.current()
        if base is None or base.model != self._model(stats):
            return self.run()
        spark, known = self.store.spark, self.store.read("files", base)
        asked = spark.createDataFrame([(p,) for p in paths], "path string").distinct()
        listing = cut(files.scan(spark, self.root, paths).filter(is_indexable(F.col("path"))).select("path", "modified", "size"))
        gone = incremental.removed(known.join(asked, "path", "left_semi"), listing).select("path", F.lit("D").alias("op"))
        self._apply(base, base, known, listing, cut(listing.select("path", F.lit("M").alias("op")).unionByName(gone)), base.model, stats)
        stats.seconds = round(time.time() - began, 3)
        return stats

    def _model(self, stats: IndexStats) -> str:
        """The name of the model that can be loaded; ``none`` without one, and then ``stats`` says why."""
        if self.embedder is None:
            return "none"
        try:
            self.embedder()
        except Exception as e:  # whatever a model's own loader raises
            stats.error = f"model: {e}"
            return "none"
        return self.config.embedding_model

    def _apply(self, old: Manifest | None, parent: Manifest | None, known: DataFrame | None, listing: DataFrame, ops: DataFrame, model: str, stats: IndexStats) -> None:
        spark, empty = self.store.spark, self.store.spark.createDataFrame([], "path string")
        suspects = ops.filter("op <> 'D'").select("path")
        names = [r["path"] for r in suspects.limit(BY_NAME + 1).collect()]
        live = files.scan(spark, self.root, names if len(names) <= BY_NAME else None).join(suspects, "path", "left_semi")
        hashed = cut(live.select("path", "modified", "size", content_sha(F.col("content")).alias("content_hash")))
        same = empty if known is None else incremental.unchanged(known.filter("not failed"), hashed)
        same = cut(same)
        parsed = cut(files.parse_files(live.join(same, "path", "left_anti"), self.config.max_document_mb, self.config.max_chars, self.config.overlap))
        gone = cut(ops.filter("op = 'D'").select("path") if known is None else incremental.removed(known.join(ops.filter("op = 'D'"), "path", "left_semi"), listing))
        outcomes = parsed.select("path", F.when(F.col("error").isNull(), "indexed").otherwise("failed").alias("outcome")).unionByName(gone.select("path", F.lit("removed").alias("outcome")))
        counts = {r["outcome"]: r["files"] for r in incremental.run_counts(outcomes).collect()}
        stats.indexed, stats.failed, stats.removed = (counts.get(x, 0) for x in ("indexed", "failed", "removed"))
        stats.unchanged = listing.count() - stats.indexed - stats.failed if stats.mode != "incremental" or known is None else same.count()
        touched = parsed.filter("error is null").select("path").unionByName(gone)
        notes, chunks = files.notes_of(parsed), files.chunks_of(parsed)
        titled = chunks.join(notes.select("path", "title"), "path")
        stored = cut(ranking.postings(titled))
        sized = ranking.tokenised(titled, "path").select("chunk_id", F.col("size").alias("tokens"))
        chunks = chunks.join(sized, "chunk_id")
        if model != "none":
            titled = chunks.join(notes.select("path", "title"), "path")
            chunks = embed(titled.withColumn("_passage", passage(F.col("title"), F.col("headings"), F.col("text"))), "_passage", self.embedder).drop("title", "_passage")
        chunks = cut(chunks)
        statistics = self._statistics(old, chunks, touched)
        # files whose content is as before, but not their time: their notes get the new one
        renewed = [] if known is None else [self.store.read("notes", old).drop("modified").join(hashed.join(same, "path", "left_semi").select("path", "modified"), "path").select(notes.columns)]
        for df in renewed:
            notes = notes.unionByName(df)
        current = hashed.join(parsed.select("path", F.col("error").isNotNull().alias("failed")), "path", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
        key = lambda df: df.select(F.xxhash64("path").alias("path_key"))
        layers = {
            "notes": (notes, touched.unionByName(same)), "tags": (files.tags_of(parsed), touched), "links": (files.links_of(parsed), touched.select(F.col("path").alias("src"))),
            "chunks": (chunks, touched), "postings": (ranking.by_term(stored), key(touched)), "files": (current, suspects.unionByName(gone)),
        }
        self.store.publish(layers if old is not None else {name: rows for name, (rows, _) in layers.items()}, parent, model, statistics)

    def _statistics(self, old: Manifest | None, fresh: DataFrame, touched: DataFrame) -> dict[str, int]:
        """Chunks and tokens of the corpus: the old ones, less those of touched files, and the fresh ones."""
        count = lambda df: df.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first().asDict()
        new = count(fresh)
        if old is None:
            return new
        less = count(self.store.read("chunks", old).select("path", "tokens").join(touched, "path", "left_semi"))
        return {k: old.statistics[k] - less[k] + new[k] for k in new}


def stream_states(changes: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Apply a stream of change rows to the table of path states under ``state``, one snapshot for each micro-batch.

    ``changes`` is a streaming DataFrame of (change_id, status, path, changed_at, arrived_at). Late and repeated rows do no
    harm: the last change by changed_at, arrived_at and change_id wins. A micro-batch writes the states of its own paths as
    a layer over the old ones. Runs until all that is there has been read.
    """
    store = SnapshotStore(changes.sparkSession, state)

    def apply(batch: DataFrame, number: int) -> None:
        base = store.current()
        if base is not None and base.batch is not None and number <= base.batch:
            return  # this micro-batch was published before a restart
        keep = ["change_id", "status", "path", "changed_at", "arrived_at"]
        rows = batch.select(*keep).filter("path is not null")
        touched = cut(rows.select("path").distinct())
        old = store.read("states", base)
        both = rows if old is None else old.select(*keep).join(touched, "path", "left_semi").unionByName(rows)
        last = F.max_by(F.struct(*keep), F.struct("changed_at", "arrived_at", "change_id")).alias("c")
        states = both.groupBy("path").agg(last).select("c.*")
        store.publish({"states": states if old is None else (states, touched)}, base, batch=number)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(indexer: Indexer, spark: SparkSession, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Run the indexer every ``seconds`` (by default the configured interval); wake-ups within one run are one run."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    every = seconds or indexer.config.sync_seconds
    return ticks.writeStream.foreachBatch(lambda batch, number: indexer.run() and None).option("checkpointLocation", checkpoint).trigger(processingTime=f"{every} seconds").start()


def pushed(indexer: Indexer, secret: bytes, body: bytes, signature: str) -> IndexStats | None:
    """A push trigger: an index run if ``signature`` is ``sha256=`` and the body's HMAC, else nothing."""
    import hashlib
    import hmac

    wanted = "sha256=" + hmac.new(secret, body, hashlib.sha256).hexdigest()
    return indexer.run() if secret and hmac.compare_digest(wanted, signature) else None
