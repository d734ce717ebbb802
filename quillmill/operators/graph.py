"""The link graph: which file a link means, outgoing links, backlinks, and what a move has to rewrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import link_key, suffix_keys


def file_keys(files: DataFrame) -> DataFrame:
    """(key, path, is_full): every key by which a file can be called."""
    named = files.select("path", F.posexplode(suffix_keys(link_key(F.col("path")))).alias("i", "key"))
    return named.filter("key <> ''").select("key", "path", (F.col("i") == 0).alias("is_full"))


def best_files(files: DataFrame) -> DataFrame:
    """(key, path): the file that each key means.

    A whole path wins (of files that share one, the last by name); else the file in the fewest folders, then of the
    shortest path, then the first by name.
    """
    keys = file_keys(files.select("path").distinct())
    # ties of equal rank are settled by min and max, so the group needs no sort and combines before the shuffle
    rank = F.struct((F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))).alias("d"), F.length("path").alias("n"), F.col("path").alias("path"))
    return keys.groupBy("key").agg(F.max(F.when(F.col("is_full"), F.col("path"))).alias("full"), F.min(rank).alias("near")).select("key", F.coalesce("full", "near.path").alias("path"))


def resolve(links: DataFrame, files: DataFrame, target: str = "target", into: str = "resolved") -> DataFrame:
    """``links`` with the path that ``target`` means, or null."""
    found = best_files(files).select(F.col("key").alias("_key"), F.col("path").alias(into))
    return links.withColumn("_key", link_key(F.col(target))).join(found, "_key", "left").drop("_key")


def unique_names(files: DataFrame) -> DataFrame:
    """(path, bare, is_unique): whether a file's bare name means that file."""
    bare = F.element_at(F.split(link_key(F.col("path")), "/"), -1)
    named = files.select("path").distinct().withColumn("bare", bare)
    return named.join(best_files(files).select(F.col("key").alias("bare"), F.col("path").alias("meant")), "bare", "left").select("path", "bare", (F.col("path") == F.col("meant")).alias("is_unique"))


def shown_target(path: Column, is_unique: Column, full: Column) -> Column:
    """How a link names a path: bare where that is unique and no full path is asked for; ``.md`` is left out."""
    whole = F.regexp_replace(path, r"(?i)\.md$", "")
    return F.when(full | ~is_unique, whole).otherwise(F.element_at(F.split(whole, "/"), -1))


def outgoing(links: DataFrame, files: DataFrame) -> DataFrame:
    """(src, links array<struct<target, resolved, heading, alias, embed>>) in the order of their lines."""
    found = resolve(links, files)
    item = F.struct("line", "target", "resolved", "heading", "alias", "embed")
    return found.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["target"].alias("target"), x["resolved"].alias("resolved"), x["heading"].alias("heading"), x["alias"].alias("alias"), x["embed"].alias("embed"))).alias("links"))


def backlinks(links: DataFrame, files: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, src, title, line, heading, alias, embed, context): links of other notes that mean a path."""
    found = resolve(links, files, into="path").filter("path is not null and path <> src")
    return found.join(notes.select(F.col("path").alias("src"), "title"), "src").select("path", "src", "title", "line", "heading", "alias", "embed", "context")


def linking_notes(links: DataFrame, files: DataFrame) -> DataFrame:
    """(path, src): the distinct other notes that link to each path; what a deletion leaves dangling."""
    return resolve(links, files, into="path").filter("path is not null and path <> src").select("path", "src").distinct()


def move_rewrites(links: DataFrame, files: DataFrame, old: str, new: str) -> DataFrame:
    """(src, target, new_target, links): targets to be replaced so that every link means after the move what it meant before.

    ``src`` is the path after the move. Links that the moved file would attract are pinned to what they meant.
    """
    here = files.select("path").distinct()
    there = here.select(F.when(F.col("path") == old, F.lit(new)).otherwise(F.col("path")).alias("path"))
    seen = links.groupBy("src", "target").agg(F.count("*").alias("links"))
    before = resolve(seen, here, into="meant").filter("meant is not null")
    before = before.withColumn("meant", F.when(F.col("meant") == old, F.lit(new)).otherwise(F.col("meant")))
    changed = resolve(before, there, into="now").filter(~F.col("now").eqNullSafe(F.col("meant")))
    named = changed.join(unique_names(there).select(F.col("path").alias("meant"), "is_unique"), "meant")
    shown = shown_target(F.col("meant"), F.col("is_unique"), F.col("target").contains("/"))
    moved = F.when(F.col("src") == old, F.lit(new)).otherwise(F.col("src"))
    return named.select(moved.alias("src"), "target", shown.alias("new_target"), "links")


def lookup(name: str, files: DataFrame) -> DataFrame:
    """(path): the file a user means by a path or a name; exact path first, then as a link, then with ``.md`` added."""
    asked = files.sparkSession.createDataFrame([(0, name), (1, name + ".md")], "i int, target string")
    exact = files.filter(F.col("path") == name).select(F.lit(-1).alias("i"), "path")
    found = resolve(asked, files, into="path").filter("path is not null").select("i", "path")
    return exact.unionByName(found).groupBy().agg(F.min_by("path", "i").alias("path")).filter("path is not null")


def heading_paths(lines: DataFrame) -> DataFrame:
    """(doc, line, headings): the heading path over each line of (doc, line, level, title); level is null for plain lines.

    Windows carry the last heading of each level forward; it stands while no heading of a smaller level came after it.
    """
    w = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = {i: F.last(F.when(F.col("level") == i, F.struct(F.col("line").alias("at"), F.col("title").alias("title"))), ignorenulls=True).over(w).alias(f"h{i}") for i in range(1, 7)}
    seen = lines.select("doc", "line", *last.values())
    live = []
    for i in range(1, 7):
        above = F.greatest(F.lit(-1), *[F.coalesce(F.col(f"h{j}.at"), F.lit(-1)) for j in range(1, i)]) if i > 1 else F.lit(-1)
        live.append(F.when(F.col(f"h{i}.at") > above, F.col(f"h{i}.title")))
    return seen.select("doc", "line", F.array_compact(F.array(*live)).alias("headings"))
