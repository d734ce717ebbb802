"""Frequency of every distinct value or n-gram, by a distributed suffix array.

Suffixes of all term lists are sorted across the cluster by (suffix, record); nothing is grouped before. Within a range,
neighbours' common prefixes give the interval of each n-gram of any length: the sum of its rows is the number of
occurrences, and the number of records is that of its rows less those whose record occurs earlier in the same interval
(repeated rows of a record lie side by side). Only intervals that touch the edge of a range are settled by a second,
pre-aggregated exchange. A hot term is cut over several ranges by its records, and a record that repeats it without end by
a salt, so neither lies in one task; ranges are sized by rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import normalize_tag
from ..session import partitions

#: Ends each term inside a suffix; sorts before every printable character, so prefixes stay neighbours.
END = "\x01"
#: The term after the last one of a list, where whole lists are counted; stands for an empty term.
STOP, EMPTY = "\x02", "\x03"
PARTIAL = "term string, n int, record string, occurrences bigint, records bigint"
#: Suffixes in a range, about.
RANGE_ROWS = 200_000


def _intervals(max_n: int | None, whole: bool):
    """Lines (term, n, record, occurrences, records) of one sorted range; a record is named where others may hold it too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        suffix = t.column("suffix").combine_chunks().dictionary_encode()
        record = t.column("record").combine_chunks().dictionary_encode()
        code = suffix.indices.to_numpy()
        # rows of no record are occurrences only
        who = pc.fill_null(record.indices, -1).to_numpy().astype(np.int64)
        words = [s.split(END)[:-1] for s in suffix.dictionary.to_pylist()]
        rows, first = len(code), np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        long = np.array([len(w) for w in words])[code]
        # common prefix, in terms, of each row with the row before
        lcp = long.copy()
        last: list[str] = []
        for i in first.tolist():
            now = words[code[i]]
            k = next((k for k, (x, y) in enumerate(zip(last, now, strict=False)) if x != y), min(len(last), len(now)))
            lcp[i], last = k, now
        # the last earlier row of the same record
        order = np.lexsort((np.arange(rows), who))
        before = np.full(rows, -1, np.int64)
        same = who[order][1:] == who[order][:-1]
        before[order[1:][same]] = order[:-1][same]
        named = record.dictionary
        at, n = np.arange(rows), 0
        while len(at := at[long[at] >= n + 1]) and (max_n is None or n < max_n):
            n += 1
            starts = np.flatnonzero((lcp[at] < n) | np.r_[True, np.diff(at) > 1])
            stops = np.r_[starts[1:], len(at)]
            new = (before[at] < np.repeat(at[starts], stops - starts)) & (who[at] >= 0)
            distinct = np.add.reduceat(new.astype(np.int64), starts)
            head, tail = at[starts], at[stops - 1]
            keep = np.array([words[code[a]][n - 1] == STOP for a in head.tolist()], bool) if whole else np.ones(len(head), bool)
            edge = keep & ((head == 0) | (tail == rows - 1))
            plain = np.flatnonzero(keep & ~edge)
            lines: list[tuple] = []
            for i in np.flatnonzero(edge).tolist():
                mine, term = who[at[starts[i] : stops[i]]], END.join(words[code[head[i]]][:n])
                ids, times = np.unique(mine, return_counts=True)
                if whole:
                    # equal rows in the order of their records: only the outer ones may go on in another range
                    inner = ~np.isin(ids, [mine[0], mine[-1]])
                    lines.append((term, None, int(times[inner].sum()), int((inner & (ids >= 0)).sum())))
                    ids, times = ids[~inner], times[~inner]
                lines += [(term, named[r].as_py() if r >= 0 else None, c, int(r >= 0)) for r, c in zip(ids.tolist(), times.tolist(), strict=True)]
            terms = [END.join(words[code[a]][:n]) for a in head[plain].tolist()] + [x[0] for x in lines]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(terms, pa.string()), pa.array(np.full(len(terms), n), pa.int32()), pa.array([None] * len(plain) + [x[1] for x in lines], pa.string()),
                    pa.array((stops - starts)[plain].tolist() + [x[2] for x in lines], pa.int64()), pa.array(distinct[plain].tolist() + [x[3] for x in lines], pa.int64()),
                ],
                names=["term", "n", "record", "occurrences", "records"],
            )

    return run


def term_counts(df: DataFrame, record: Column, terms: Column, max_n: int | None = None, ranges: int | None = None, whole: bool = False) -> DataFrame:
    """(n, term, occurrences, records) of all n-grams of up to ``max_n`` terms (null: of any length), joined by END.

    With ``whole`` only whole lists are counted, from the suffixes that begin at their first terms. ``terms`` is an array
    of strings, ``record`` any value. Null arrays and null terms are left out, empty terms too unless ``whole``; rows whose
    record is null count as occurrences of no record. A list of n terms makes n suffixes of up to max_n terms each, so
    give ``max_n`` for long texts.
    """
    ranges = ranges or max(partitions(df.sparkSession), -(-df.count() // RANGE_ROWS))
    if whole:
        marked = F.transform(F.filter(terms, lambda x: x.isNotNull()), lambda x: F.concat(F.when(x == "", EMPTY).otherwise(x), F.lit(END)))
        listed = df.select(record.cast("string").alias("record"), marked.alias("terms")).filter(F.size("terms") > 0)
        suffixes = listed.select("record", F.concat(F.array_join("terms", ""), F.lit(STOP + END)).alias("suffix"))
    else:
        clean = F.transform(F.filter(terms, lambda x: x.isNotNull() & (x != "")), lambda x: F.concat(x, F.lit(END)))
        listed = df.select(record.cast("string").alias("record"), clean.alias("terms")).filter(F.size("terms") > 0)
        cut = lambda i: F.array_join(F.slice(F.col("terms"), i, F.size("terms") if max_n is None else F.lit(max_n)), "")
        suffixes = listed.select("record", F.explode(F.transform(F.sequence(F.lit(1), F.size("terms")), cut)).alias("suffix"))
    salted = suffixes.withColumn("salt", F.rand(7))
    parts = salted.repartitionByRange(ranges, "suffix", "record", "salt").drop("salt").sortWithinPartitions("suffix", "record").mapInArrow(_intervals(max_n, whole), PARTIAL)
    inner = parts.groupBy("n", "term", "record").agg(F.sum("occurrences").alias("occurrences"), F.max("records").alias("one"), F.sum("records").alias("records"))
    # lines with a record: the same record may have met the n-gram in two ranges and counts once
    total = inner.withColumn("records", F.when(F.col("record").isNull(), F.col("records")).otherwise(F.col("one")))
    out = total.groupBy("n", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    if whole:
        term = F.regexp_replace("term", f"{END}{STOP}$", "")
        out = out.select((F.col("n") - 1).alias("n"), F.translate(term, EMPTY, "").alias("term"), "occurrences", "records")
    return out


def tag_counts(tags: DataFrame, rare_under: int = 3, common_over: float = 0.05, ranges: int | None = None) -> DataFrame:
    """(tag, rows, notes, mark): rows and notes of each normalised tag; mark is rare, common or null.

    A tag is rare with fewer than ``rare_under`` notes, otherwise common with more than ``common_over`` of all distinct
    paths. Null and blank tags are left out, their paths still count among all paths; a null path is no note.
    """
    tag = normalize_tag(F.col("tag"))
    counts = term_counts(tags.filter(tag != ""), F.col("path"), F.split(tag, "/"), None, ranges, whole=True)
    paths = tags.agg(F.count_distinct("path").alias("n")).first()["n"]
    mark = F.when(F.col("records") < rare_under, "rare").when(F.col("records") > common_over * paths, "common")
    return counts.select(F.translate("term", END, "/").alias("tag"), F.col("occurrences").alias("rows"), F.col("records").alias("notes"), mark.alias("mark"))


def tag_part_counts(tags: DataFrame, max_n: int | None = None, ranges: int | None = None) -> DataFrame:
    """(n, part, rows, notes) of each run of levels (at most ``max_n``; null: any) of hierarchical tags such as ``ops/backup``."""
    counts = term_counts(tags, F.col("path"), F.split(normalize_tag(F.col("tag")), "/"), max_n, ranges)
    return counts.select("n", F.translate("term", END, "/").alias("part"), F.col("occurrences").alias("rows"), F.col("records").alias("notes"))
