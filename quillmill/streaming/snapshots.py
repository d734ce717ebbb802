"""Snapshots of tables as immutable folders under a manifest that is swapped whole.

A table is a list of layers, oldest first. A layer beside its rows names the keys it touched: reading leaves those keys'
rows of older layers out, so a run writes what changed and nothing else; a table with many layers is written anew as one.

A writer names the snapshot it started from; if another one has been published since, publishing fails and nothing of the
old state is lost. Readers keep the snapshot they opened. Manifests are created exclusively (``create`` without overwrite),
which holds on HDFS, local and other file systems with atomic creation; on object stores it needs a connector whose create
is conditional. A manifest that is still being written is passed over by readers.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = "2"
#: Layers of a table from which on it is written anew.
MOST_LAYERS = 8


class Conflict(Exception):
    """The vault changed since the snapshot that was worked on."""


@dataclass
class Manifest:
    """What a snapshot holds."""

    snapshot: str
    parent: str | None
    tables: dict[str, list[list[str | None]]]  # of each layer the folder of its rows, that of its touched keys, their column
    model: str
    indexed_at: float
    schema_version: str = SCHEMA_VERSION
    statistics: dict[str, int] = field(default_factory=dict)
    batch: int | None = None  # the micro-batch that published it


class SnapshotStore:
    """Tables by name under a root folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> Manifest | None:
        """The published manifest; of several the newest number counts. One of another schema version counts as none."""
        for number in sorted(self._numbers(), reverse=True):
            try:
                manifest = Manifest(**json.loads(self._text(number)))
            except (ValueError, TypeError):  # unfinished, or of another version
                continue
            return manifest if manifest.schema_version == SCHEMA_VERSION else None
        return None

    def _text(self, number: int) -> str:
        stream = self._fs.open(self._path(f"{self.root}/manifest-{number:012d}.json"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]

    def read(self, name: str, manifest: Manifest | None = None) -> DataFrame | None:
        manifest = manifest or self.current()
        if manifest is None or name not in manifest.tables:
            return None
        out = later = later_key = None
        for rows, touched, key in reversed(manifest.tables[name]):
            df = self.spark.read.parquet(rows)
            if later is not None:
                df = df.join(later, later_key, "left_anti")
            out = df if out is None else df.unionByName(out, allowMissingColumns=True)
            if touched:
                mine, later_key = self.spark.read.parquet(touched).select(key), key
                later = mine if later is None else later.unionByName(mine)
        return out

    def publish(self, tables: dict[str, DataFrame | tuple[DataFrame, DataFrame]], parent: Manifest | None, model: str = "hash-256", statistics: dict[str, int] | None = None, batch: int | None = None) -> Manifest:
        """Write the tables to new folders, then publish them; tables not given are taken over from ``parent``.

        A table alone replaces the old one; with a second one of a single key column it is a layer: the old rows of those
        keys are gone, the given ones are there. The manifest is created under the next number and never overwritten, so
        of two writers one fails with Conflict.
        """
        snapshot = uuid.uuid4().hex
        places = dict(parent.tables) if parent else {}
        for name, given in tables.items():
            rows, touched = given if isinstance(given, tuple) else (given, None)
            layer: list[str | None] = [f"{self.root}/data/{snapshot}/{name}", None, None]
            old = places.get(name, []) if touched is not None else []
            if len(old) >= MOST_LAYERS:
                key = touched.columns[0]
                rows, touched, old = self.read(name, parent).join(touched, key, "left_anti").unionByName(rows, allowMissingColumns=True), None, []
            rows.write.parquet(layer[0])
            if touched is not None:
                layer[1:] = [f"{self.root}/data/{snapshot}/{name}-touched", touched.columns[0]]
                touched.distinct().write.parquet(layer[1])
            places[name] = [*old, layer]
        now = self.current()
        if (now.snapshot if now else None) != (parent.snapshot if parent else None):
            raise Conflict("another snapshot has been published meanwhile")
        manifest = Manifest(snapshot, parent.snapshot if parent else None, places, model, time.time(), statistics=statistics if statistics is not None else dict(parent.statistics) if parent else {}, batch=batch)
        target = self._path(f"{self.root}/manifest-{max(self._numbers(), default=0) + 1:012d}.json")
        try:
            out = self._fs.create(target, False)
        except Py4JJavaError as e:
            raise Conflict("another snapshot has been published meanwhile") from e
        out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        out.close()
        return manifest

    def prune(self, keep: int) -> int:
        """Delete all but the newest ``keep`` manifests (0 keeps all) and data that none of the kept ones names."""
        numbers = sorted(self._numbers(), reverse=True)
        if not keep or len(numbers) <= keep:
            return 0
        kept = set()
        for n in numbers[:keep]:
            kept |= {place.split("/")[-2] for layers in json.loads(self._text(n))["tables"].values() for layer in layers for place in layer[:2] if place}
        for n in numbers[keep:]:
            self._fs.delete(self._path(f"{self.root}/manifest-{n:012d}.json"), False)
        data = self._path(f"{self.root}/data")
        for s in self._fs.listStatus(data):
            if s.getPath().getName() not in kept:
                self._fs.delete(s.getPath(), True)
        return len(numbers) - keep
