"""Retrieval quality: all evaluation queries run in one plan; metrics at note level for each mode and language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def note_ranks(ranked: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(qid, path, rank): the first chunk of each note stands for it; the first k notes of each query."""
    found = ranked.select("qid", "chunk_id", "rank").join(chunks.select("chunk_id", "path"), "chunk_id")
    first = found.groupBy("qid", "path").agg(F.min("rank").alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("first"))).filter(F.col("rank") <= k).select("qid", "path", "rank")


def query_rows(queries: DataFrame, ranks: DataFrame) -> DataFrame:
    """(qid, lang, hit1, recall, mrr) of each query with relevant notes; ``ranks`` is cut at k."""
    wanted = queries.filter(F.size("relevant") > 0).select("qid", "lang", F.array_distinct("relevant").alias("relevant"))
    pairs = wanted.select("qid", F.explode("relevant").alias("path"))
    got = pairs.join(ranks, ["qid", "path"]).groupBy("qid").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    out = wanted.join(got, "qid", "left")
    return out.select("qid", "lang", F.coalesce((F.col("first") == 1).cast("double"), F.lit(0.0)).alias("hit1"), (F.coalesce("n", F.lit(0)) / F.size("relevant")).alias("recall"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"))


def report(rows: DataFrame) -> DataFrame:
    """(grp, n, hit1, recall, mrr): means over all queries and for each language; null and blank languages only count in all."""
    both = rows.withColumn("grp", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.trim("lang") != "", F.col("lang"))))))
    return both.groupBy("grp").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 3).alias(c) for c in ("hit1", "recall", "mrr")])


def missing_relevant(queries: DataFrame, notes: DataFrame) -> DataFrame:
    """(path): relevant paths that no note has."""
    return queries.select(F.explode("relevant").alias("path")).distinct().join(notes.select("path"), "path", "left_anti")


def not_found(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, query) of the queries without any relevant note among the first k."""
    return rows.filter("mrr = 0").join(queries.select("qid", "query"), "qid").select("qid", "query")


def percentiles(df: DataFrame, group: str, value: str, percents: tuple[int, ...] = (50, 95)) -> DataFrame:
    """(group, p50, ...): nearest ranks as :func:`percentile` has them, of any number of values, which are counted and not gathered."""
    held = df.filter(F.col(value).isNotNull())
    n = held.groupBy(group).agg(F.count("*").alias("n"))
    counts = held.groupBy(group, value).agg(F.count("*").alias("c")).join(n, group)
    up_to = F.sum("c").over(Window.partitionBy(group).orderBy(value))
    at = lambda p: F.least(F.col("n"), F.bround(F.lit(p / 100) * (F.col("n") - 1)).cast("bigint") + 1)
    pick = lambda p: F.round(F.min(F.when(F.col("up_to") >= at(p), F.col(value))), 1).alias(f"p{p}")
    return counts.withColumn("up_to", up_to).groupBy(group).agg(*[pick(p) for p in percents])


def percentile(values: Column, percent: float) -> Column:
    """Nearest rank of an array, rounded half to even and to one digit; 0 for an empty one."""
    n = F.size(values)
    at = F.bround(F.lit(percent / 100) * (n - 1)).cast("int") + 1
    return F.coalesce(F.round(F.try_element_at(F.sort_array(values), F.greatest(F.lit(1), F.least(n, at))), 1), F.lit(0.0))


def load_queries(text: str) -> list[dict]:
    """Evaluation queries of a YAML list, numbered from 1; each needs ``query`` and ``relevant``."""
    import yaml

    out = []
    for i, entry in enumerate(yaml.safe_load(text) or [], 1):
        relevant = entry.get("relevant") if isinstance(entry, dict) else None
        relevant = [relevant] if isinstance(relevant, str) else relevant
        if not isinstance(entry, dict) or not entry.get("query") or not relevant:
            raise ValueError(f"entry {i} needs query and relevant")
        out.append({"qid": i, "query": str(entry["query"]), "relevant": [str(p) for p in relevant], "lang": entry.get("lang")})
    return out


def format_report(metrics: dict[str, list], seconds: float | None = None, latency: dict[str, dict] | None = None, missed: dict[str, list[str]] | None = None) -> str:
    """Metrics by mode as a text table."""
    lines = ["mode       group   n    hit@1  recall  mrr"]
    for mode, rows in metrics.items():
        lines += [f"{mode:<10} {r['grp']:<7} {r['n']:<4} {r['hit1']:<6} {r['recall']:<7} {r['mrr']}" for r in sorted(rows, key=lambda r: (r["grp"] != "all", r["grp"]))]
    lines += [f"{mode:<10} p50 {x['p50']} ms, p95 {x['p95']} ms" for mode, x in (latency or {}).items()]
    lines += [f"{mode:<10} not found: {q}" for mode, listed in (missed or {}).items() for q in listed]
    return "\n".join(lines + ([f"index built in {seconds:.1f} s"] if seconds is not None else []))
