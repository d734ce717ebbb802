"""Orphan references: rows that name notes which are missing, deleted or came only later.

Parents (every key under which a note or a deleted note can be called) and references meet in ranges of their hashed
keys. Each range holds its parents as sorted arrays; references stream past in Arrow batches and are looked up by
binary search, so the probe is vectorised and never materialises a joined row for a reference that is in order. A key
that alone would fill more than one range is spread over as many neighbouring ranges as it needs, with its one parent
row copied to each: no task ever receives a third of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import link_key, strip, suffix_keys
from ..session import partitions
from ..sources.tables import micros

ALWAYS = -(2**63)
FOUND = "ref_table string, row_id bigint, ref_field string, reason string, at bigint"


def reference_rows(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """References as (ref_table, row_id, ref_field, suffix_ok, raw key, at in microseconds); null and blank ones left out."""
    def of(df: DataFrame, table: str, row: str, at: str, fields: list[tuple[str, bool]]) -> DataFrame:
        items = F.array(*[F.struct(F.lit(f).alias("ref_field"), F.lit(ok).alias("suffix_ok"), link_key(F.col(f)).alias("key"), strip(F.col(f)).alias("raw")) for f, ok in fields])
        return (
            df.select(F.lit(table).alias("ref_table"), F.col(row).cast("bigint").alias("row_id"), micros(df, at).alias("at"), F.explode(items).alias("i"))
            .select("ref_table", "row_id", "at", "i.*")
            .filter("raw is not null and raw <> '' and key <> ''")
            .drop("raw")
        )

    return of(links, "links", "link_id", "seen_at", [("src", False), ("target_key", True)]).unionByName(of(chunks, "chunks", "chunk_id", "indexed_at", [("path", False)]))


def parent_rows(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """One row for each key: since when a note answers to it in full or by its last segments, and whether a deleted path does.

    ``full_at``/``any_at`` are null where no note fits; a note without an A row has always existed. The latest change of a
    path is that of the largest changed_at, then arrived_at, then change_id.
    """
    feed = changes.select(link_key(F.col("path")).alias("key"), F.upper(F.trim("status")).alias("status"), micros(changes, "changed_at").alias("at"), micros(changes, "arrived_at").alias("arrived"), F.col("change_id").alias("change_id"))
    fate = feed.filter("key <> ''").groupBy("key").agg(
        F.min(F.when(F.col("status") == "A", F.col("at"))).alias("added"),
        F.max_by("status", F.struct("at", "arrived", "change_id")).alias("last"),
    )
    known = notes.select(link_key(F.col("path")).alias("key")).filter("key <> ''").distinct().withColumn("note", F.lit(True))
    both = known.join(fate, "key", "full_outer").filter(F.col("note") | (F.col("last") == "D"))
    named = both.select("key", F.coalesce("note", F.lit(False)).alias("note"), F.coalesce("added", F.lit(ALWAYS)).alias("since"), F.posexplode(suffix_keys(F.col("key"))).alias("i", "name"))
    when = lambda c, v: F.when(c, v)
    return named.groupBy(F.col("name").alias("key")).agg(
        F.min(when(F.col("note") & (F.col("i") == 0), F.col("since"))).alias("full_at"),
        F.min(when(F.col("note"), F.col("since"))).alias("any_at"),
        F.coalesce(F.max(when(~F.col("note"), F.col("i") == 0)), F.lit(False)).alias("full_gone"),
        F.coalesce(F.max(when(~F.col("note"), F.lit(True))), F.lit(False)).alias("any_gone"),
    )


def _range_of(h: Column, n: int) -> Column:
    """Which of n equal ranges of the 64-bit space holds h."""
    return F.floor((F.shiftright(h, 32) + F.lit(2**31)) * F.lit(n) / F.lit(2**32)).cast("int")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parents come first and become sorted arrays; each later batch of references is searched in them."""
    held: list[pa.RecordBatch] = []
    parents = hashes = None
    for batch in batches:
        is_ref = batch.column("is_ref").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(is_ref, True))
        if cut:
            held.append(batch.slice(0, cut))
        refs = batch.slice(cut)
        if not refs.num_rows:
            continue
        if parents is None:
            parents = pa.Table.from_batches(held, batch.schema).combine_chunks()
            hashes = parents.column("h").to_numpy()
            names = parents.column("key").combine_chunks()
            number = lambda name, none: pc.fill_null(parents.column(name), none).to_numpy()
            late = 2**63 - 1
            at = {False: number("full_at", late), True: number("any_at", late)}
            there = {False: parents.column("full_at").is_valid().to_numpy(), True: parents.column("any_at").is_valid().to_numpy()}
            gone = {False: number("full_gone", False), True: number("any_gone", False)}
        h = refs.column("h").to_numpy()
        suffix = refs.column("suffix_ok").to_numpy(zero_copy_only=False).astype(bool)
        seen = pc.fill_null(refs.column("at"), 2**63 - 1).to_numpy()
        if len(hashes):
            spot = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[spot] == h
            if same.any():  # equal hashes of different keys lie side by side: walk on while the name differs
                wrong = same & ~np.asarray(pc.equal(pa.array(names).take(pa.array(spot)), refs.column("key")))
                for i in np.flatnonzero(wrong):
                    key, j = refs.column("key")[int(i)].as_py(), int(spot[i])
                    while j < len(hashes) and hashes[j] == h[i] and names[j].as_py() != key:
                        j += 1
                    same[i] = j < len(hashes) and hashes[j] == h[i]
                    spot[i] = min(j, len(hashes) - 1)
            pick = lambda x: np.where(suffix, x[True][spot], x[False][spot])
            fits, since, dead = same & pick(there), pick(at), same & pick(gone)
        else:
            fits = dead = np.zeros(len(h), bool)
            since = np.zeros(len(h), np.int64)
        reason = np.where(fits, np.where(since > seen, 1, 0), np.where(dead, 2, 3))
        miss = np.flatnonzero(reason)
        if len(miss):
            out = refs.take(pa.array(miss))
            named = pa.array(["", "late", "deleted", "missing"]).take(pa.array(reason[miss]))
            yield pa.RecordBatch.from_arrays([out.column("ref_table"), out.column("row_id"), out.column("ref_field"), named, out.column("at")], names=["ref_table", "row_id", "ref_field", "reason", "at"])


def orphan_rows(refs: DataFrame, parents: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each reference that is no good, with its reason: (ref_table, row_id, ref_field, reason, at), repeated rows once.

    ``refs`` and ``parents`` are those of :func:`reference_rows` and :func:`parent_rows`. A reference with a null time is
    never late. Empty inputs give an empty result, or ``missing`` for every reference when only the parents are empty.
    """
    spark = refs.sparkSession
    n = ranges or partitions(spark)
    refs = refs.withColumn("h", F.xxhash64("key"))
    steps = 4 * n
    points = refs.agg(F.percentile_approx("h", [i / steps for i in range(1, steps)], 100 * steps).alias("q")).first()["q"] or []
    hot: dict[int, int] = {}
    for point in points:
        hot[point] = hot.get(point, 0) + 1
    # a key in more than four points fills more than one range; at most n such keys exist
    spread = [(h, min(n, 1 + c // 4)) for h, c in hot.items() if c > 4]
    wide = spark.createDataFrame(spread or [(0, 1)], "h bigint, copies int")
    salted = refs.join(F.broadcast(wide), "h", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("row_id", "ref_field"), F.col("copies")).cast("int"))
    copied = parents.withColumn("h", F.xxhash64("key")).join(F.broadcast(wide), "h", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    copied = copied.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    place = F.pmod(_range_of(F.col("h"), n) + F.col("salt"), F.lit(n)).cast("int").alias("place")
    a = copied.select(place, F.lit(False).alias("is_ref"), "h", "key", "full_at", "any_at", "full_gone", "any_gone", *[F.lit(None).cast(t).alias(c) for c, t in (("ref_table", "string"), ("row_id", "bigint"), ("ref_field", "string"), ("suffix_ok", "boolean"), ("at", "bigint"))])
    b = salted.select(place, F.lit(True).alias("is_ref"), "h", "key", *[F.lit(None).cast(t).alias(c) for c, t in (("full_at", "bigint"), ("any_at", "bigint"), ("full_gone", "boolean"), ("any_gone", "boolean"))], "ref_table", "row_id", "ref_field", "suffix_ok", "at")
    met = a.unionByName(b).repartitionById(n, F.col("place")).sortWithinPartitions("is_ref", "h")
    return met.mapInArrow(_probe, FOUND).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans counted for each table, field, month and reason; rows without a time count under the month null."""
    month = F.date_format(F.timestamp_micros("at"), "yyyy-MM").alias("month")
    return found.groupBy("ref_table", "ref_field", month, "reason").agg(F.count("*").alias("orphans"))
