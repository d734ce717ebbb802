"""From a folder of files to the tables notes, tags, links and chunks, in one pass of Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import link_key, normalize_tag
from ..operators.chunking import chunk_markdown
from . import markdown
from .documents import ExtractionError, extract
from .paths import IGNORED, is_indexable, kind_of, stem

_LINK = "struct<target:string,heading:string,alias:string,embed:boolean,line:int,context:string>"
_CHUNK = "struct<ord:int,headings:array<string>,text:string>"
PARSED = f"path string, kind string, title string, frontmatter string, status string, modified bigint, content_hash string, tags array<string>, links array<{_LINK}>, chunks array<{_CHUNK}>, error string"


def scan(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """Files under ``root``: (path relative to it, kind, modified, size, content); ignored folders are left out at any depth.

    ``only`` names a few files to be read instead of all; those that are not there are left out. Contents are read only
    where they are asked for.
    """
    reader = spark.read.format("binaryFile")
    path = spark._jvm.org.apache.hadoop.fs.Path
    place = path(root)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    # names are no patterns
    plain = lambda p: re.sub(r"([\[\]{}*?\\])", r"\\\1", p.toString())
    if only is None:
        files = reader.option("recursiveFileLookup", "true").load(plain(place))
    else:
        there = [p for p in (path(place, x) for x in only) if fs.exists(p)]
        files = reader.load([plain(p) for p in there]) if there else spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    # the scan names files by their whole address; what follows the root's own is the path
    whole = fs.makeQualified(place).toString().rstrip("/") + "/"
    path = F.substr("path", F.lit(len(whole) + 1))
    listed = files.select(path.alias("path"), F.unix_timestamp("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
    return listed.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in IGNORED]))).withColumn("kind", kind_of(F.col("path")))


def parse_files(files: DataFrame, max_document_mb: int = 25, limit: int = 1500, overlap: int = 150) -> DataFrame:
    """Each indexable file parsed (see PARSED); a file that cannot be read has an ``error`` and nothing else.

    ``files`` has path, modified and content. Documents (not Markdown) over the size limit are errors. A note without
    text is one chunk that holds its title. Null content counts as empty.
    """
    todo = files.filter(is_indexable(F.col("path"))).select("path", kind_of(F.col("path")).alias("kind"), stem(F.col("path")).alias("stem"), "modified", F.coalesce("content", F.lit(b"")).alias("content"))
    # documents over the limit go on without their bytes
    big = (F.col("kind") != "md") & (F.length("content") > max_document_mb * 1024 * 1024)
    todo = todo.withColumn("over", big).withColumn("content", F.when(big, F.lit(b"")).otherwise(F.col("content")))
    links = pa.list_(pa.struct([("target", pa.string()), ("heading", pa.string()), ("alias", pa.string()), ("embed", pa.bool_()), ("line", pa.int32()), ("context", pa.string())]))
    chunks = pa.list_(pa.struct([("ord", pa.int32()), ("headings", pa.list_(pa.string())), ("text", pa.string())]))
    types = [("path", pa.string()), ("kind", pa.string()), ("title", pa.string()), ("frontmatter", pa.string()), ("status", pa.string()), ("modified", pa.int64()), ("content_hash", pa.string()), ("tags", pa.list_(pa.string())), ("links", links), ("chunks", chunks), ("error", pa.string())]

    def one(path: str, kind: str, name: str, modified: int, content: bytes, over: bool) -> dict:
        row = {"path": path, "kind": kind, "modified": modified, "content_hash": hashlib.sha256(content).hexdigest()}
        try:
            if kind == "md":
                note = markdown.parse(path, content.decode("utf-8", "replace"))
            elif over:
                raise ExtractionError(f"larger than {max_document_mb} MB")
            else:
                title, text = extract(kind, content, name)
                note = markdown.Note(title, {}, text)
        except ExtractionError as e:
            return row | {"error": str(e)}
        parts = chunk_markdown(note.body, limit, overlap) or [([], note.title)]
        return row | {
            "title": note.title, "frontmatter": markdown.frontmatter_json(note.frontmatter), "status": note.status, "tags": note.tags,
            "links": [{"target": x.text, "heading": x.heading, "alias": x.alias, "embed": x.embed, "line": x.line, "context": x.context} for x in note.links],
            "chunks": [{"ord": i, "headings": h, "text": t} for i, (h, t) in enumerate(parts)],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(r["path"], r["kind"], r["stem"], r["modified"], r["content"], r["over"]) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in types], names=[n for n, _ in types])

    return todo.mapInArrow(run, PARSED)


def notes_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error is null").select("path", "kind", "title", "frontmatter", "status", "modified", "content_hash")


def tags_of(parsed: DataFrame) -> DataFrame:
    """(path, tag): the distinct tags of each note in normal form; empty ones left out."""
    return parsed.filter("error is null").select("path", F.explode("tags").alias("tag")).select("path", normalize_tag(F.col("tag")).alias("tag")).filter("tag <> ''").distinct()


def parsed_tags(parsed: DataFrame) -> DataFrame:
    """(path, tags): the distinct tags of each note in the order in which they are written."""
    normal = F.array_distinct(F.filter(F.transform("tags", normalize_tag), lambda t: t != ""))
    return parsed.filter("error is null").select("path", normal.alias("tags"))


def links_of(parsed: DataFrame) -> DataFrame:
    flat = parsed.filter("error is null").select(F.col("path").alias("src"), F.inline("links"))
    return flat.select("src", link_key(F.col("target")).alias("target_key"), "target", "heading", "alias", "embed", "line", "context")


def chunks_of(parsed: DataFrame) -> DataFrame:
    """Chunks with an id made of path and place, the same in every run."""
    flat = parsed.filter("error is null").select("path", F.inline("chunks"))
    return flat.select(F.xxhash64("path", "ord").alias("chunk_id"), "path", "ord", "headings", "text")
