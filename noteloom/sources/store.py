"""Immutable snapshots: each commit writes the tables that changed, side by side, and moves one pointer file.

A table is one path, or several where rows were appended. Postings are only appended: what they hold of former chunks is passed over
by its version until a compaction.
"""

from __future__ import annotations

import json
import socket
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.operators import keyword

TABLES = {
    "documents": "document_id string, path string, content_hash string, modified_at timestamp, title string, resolved_title string, tags array<string>, aliases array<string>, additional string, links array<string>",
    "chunks": "chunk_id string, document_id string, ordinal int, heading_path array<string>, heading string, content string, content_hash string, occurrence int, embedded_hash string, extracted_hash string, length int, posted string",
    "postings": "term string, chunk_id string, tf_heading int, tf_content int, dl int, version string, bucket int",
    "entities": "entity_id string, type string, canonical_name string, normalized_name string",
    "aliases": "entity_id string, name string, normalized_name string",
    "mentions": "entity_id string, chunk_id string, surface_form string, source string",
    "relations": "relation_id string, source_id string, type string, target_id string, supporting_chunk_id string, confidence double",
    "jobs": "kind string, target_id string, state string, attempts int, next_after double, last_error string, created_at double",
    "metadata": "key string, value string",
    "chunk_vectors": "chunk_id string, embedding array<float>",
    "entity_vectors": "entity_id string, embedding array<float>",
}


class Locked(Exception):
    pass


class Store:
    """Tables under a folder of any file system that Hadoop reads. One writer at a time holds its lock file."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only
        jvm = spark._jvm
        self._jpath = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._held = False
        if not read_only:
            self._fs.mkdirs(self._jpath(self.path))
            self._lock()
        self.pointers: dict[str, str] = self._read("CURRENT") or {}

    def _read(self, name: str):
        p = self._jpath(f"{self.path}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, name: str, value, overwrite: bool) -> None:
        stream = self._fs.create(self._jpath(f"{self.path}/{name}"), overwrite)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()

    def _lock(self) -> None:
        try:
            self._write("LOCK", {"holder": f"{socket.gethostname()} since {time.time():.0f}"}, False)
        except Exception as e:
            held = self._read("LOCK")
            if held is None:
                raise
            raise Locked(f"{self.path} is being written by {held['holder']}") from e
        self._held = True

    def close(self) -> None:
        if self._held:
            self._fs.delete(self._jpath(f"{self.path}/LOCK"), False)
            self._held = False

    def paths(self, name: str) -> list[str]:
        at = self.pointers.get(name) or []
        return [f"{self.path}/{x}" for x in ([at] if isinstance(at, str) else at)]

    def table(self, name: str) -> DataFrame:
        at = self.paths(name)
        parts = [self.spark.read.schema(TABLES[name]).parquet(p) for p in at]
        out = parts[0] if parts else self.spark.createDataFrame([], TABLES[name])
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _rows(self, name: str, df: DataFrame) -> DataFrame:
        columns = [c.split(" ")[0] for c in _split(TABLES[name])]
        kinds = {c.split(" ")[0]: c.split(" ", 1)[1] for c in _split(TABLES[name])}
        return df.select(*(F.col(c).cast(kinds[c]).alias(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns))

    def put(self, **tables: DataFrame) -> list[DataFrame]:
        """The tables as they will be after the next commit(), written and read again: what is built on them has short plans and no lineage to lose."""
        if self.read_only:
            raise PermissionError("opened read-only")

        def write(item: tuple[str, DataFrame]) -> DataFrame:
            name, df = item
            at = f"{name}/{uuid.uuid4().hex}"
            if name == "postings":
                keyword.write_index(self._rows(name, df), f"{self.path}/{at}")
            else:
                self._rows(name, df).write.parquet(f"{self.path}/{at}")
            out = self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{at}")
            out._noteloom_at = at
            return out

        with ThreadPoolExecutor(4) as pool:  # small jobs, most of whose time is planning
            return list(pool.map(write, tables.items()))

    def stage(self, *frames: DataFrame) -> list[DataFrame]:
        """Frames written beside the tables until the next commit() and read again."""
        if self.read_only:
            raise PermissionError("opened read-only")

        def write(df: DataFrame) -> DataFrame:
            path = f"{self.path}/stage/{uuid.uuid4().hex}"
            schema = df.schema
            df.write.parquet(path)
            return self.spark.read.schema(schema).parquet(path)

        with ThreadPoolExecutor(4) as pool:
            return list(pool.map(write, frames))

    def commit(self, append: dict[str, DataFrame] | None = None, **tables: DataFrame) -> None:
        """All of the tables become current at once; those to append add their rows to what there is."""
        if self.read_only:
            raise PermissionError("opened read-only")
        append = append or {}
        every = [*tables.items(), *append.items()]
        new = {name: df for name, df in every if not hasattr(df, "_noteloom_at")}
        made = dict(zip(new, (df._noteloom_at for df in self.put(**new)))) | {name: df._noteloom_at for name, df in every if name not in new}
        pointers = dict(self.pointers)
        for name, at in made.items():
            old = pointers.get(name) or []
            pointers[name] = at if name in tables else [*([old] if isinstance(old, str) else old), at]
        self._write("NEXT", pointers, True)
        current = self._jpath(f"{self.path}/CURRENT")
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._jpath(self.path).toUri() if "://" in self.path else jvm.java.io.File(self.path).toURI(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._jpath(f"{self.path}/NEXT"), current, options)
        self.pointers = pointers
        self._fs.delete(self._jpath(f"{self.path}/stage"), True)

    def compact(self) -> None:
        """Rewrite the tables, postings without what is passed over, and delete what is not current."""
        tables = {n: self.table(n) for n in self.pointers}
        if "postings" in tables:
            tables["postings"] = tables["postings"].join(self.table("chunks").select("chunk_id", F.col("posted").alias("version")), ["chunk_id", "version"], "left_semi")
        self.commit(**tables)
        kept = {p for n in self.pointers for p in ([self.pointers[n]] if isinstance(self.pointers[n], str) else self.pointers[n])}
        for name in self.pointers:
            for entry in self._fs.listStatus(self._jpath(f"{self.path}/{name}")):
                if f"{name}/{entry.getPath().getName()}" not in kept:
                    self._fs.delete(entry.getPath(), True)


def _split(schema: str) -> list[str]:
    return [c.strip() for c in schema.split(", ")]
