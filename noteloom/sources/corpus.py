"""Trees of Markdown files, array files and configuration files as sources."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions.ids import content_hash
from noteloom.streaming.watch import accepted


def _real(root: str) -> str:
    return str(Path(root).resolve()) if "://" not in root else root.rstrip("/")


def relative(path: Column, roots: list[str]) -> Column:
    """A path under the longest root that holds it, with the root's number before it if there are several; null outside of all."""
    plain = F.regexp_replace(path, "^file:/+", "/")
    out = F.lit(None).cast("string")
    for i, root in sorted(enumerate(map(_real, roots)), key=lambda x: len(x[1])):
        prefix = root.rstrip("/") + "/"
        rest = F.substring(plain, F.lit(len(prefix) + 1), F.length(plain))
        out = F.when(plain.startswith(prefix), F.concat(F.lit(f"{i}/"), rest) if len(roots) > 1 else rest).otherwise(out)
    return out


def scan(spark: SparkSession, roots: list[str], ignore: list[str] = ()) -> DataFrame:
    """(path, modified_at, text, content_hash) of the Markdown files under the roots that no rule hides."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load([_real(r) for r in roots])
    path = relative(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), roots)
    bare = F.regexp_replace(path, r"^\d+/", "") if len(roots) > 1 else path
    found = files.select(path.alias("path"), bare.alias("bare"), F.col("modificationTime").alias("modified_at"), F.decode("content", "UTF-8").alias("text"))
    found = found.filter(F.col("path").isNotNull() & accepted(F.col("bare"), list(ignore))).drop("bare")
    return found.withColumn("content_hash", content_hash(F.col("text")))


def npy(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, vector) of two-dimensional arrays in .npy files."""
    import io

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if a.ndim != 2 or a.dtype.kind not in "fi":
                    raise ValueError(f"{name}: two dimensions of numbers are needed")
                for start in range(0, len(a), 10_000):
                    part = a[start : start + 10_000].astype(np.float32)
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), a.shape[1]).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(start, start + len(part))), lists], ["file", "row", "vector"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, row long, vector array<float>")


@dataclass
class Config:
    """Tunables; None means not set here."""

    roots: list[str] | None = None
    store: str | None = None
    ignore: list[str] | None = None
    min_tokens: int | None = None
    max_tokens: int | None = None
    dimensions: int | None = None
    graph: bool | None = None
    limit: int | None = None
    hops: int | None = None
    debounce: str | None = None
    burst: int | None = None

    @classmethod
    def defaults(cls) -> Config:
        return cls([], None, [], 64, 512, 768, True, 10, 2, "500 milliseconds", 200)

    def over(self, other: Config) -> Config:
        return Config(*(getattr(self, f.name) if getattr(self, f.name) is not None else getattr(other, f.name) for f in fields(self)))

    @classmethod
    def read(cls, path: Path) -> Config:
        found = json.loads(path.read_text())
        unknown = set(found) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"{path}: unknown keys {sorted(unknown)}")
        return cls(**found)

    @classmethod
    def resolve(cls, flags: Config | None = None, explicit: str | None = None, home: str | None = None, name: str = ".noteloom.json") -> Config:
        """Flags, then the first file of: the explicit one, each root's, home's; then defaults."""
        flags = flags or cls()
        places = [Path(explicit)] if explicit else [Path(d) / name for d in [*(flags.roots or []), home or str(Path.home())]]
        if explicit and not places[0].exists():
            raise FileNotFoundError(explicit)
        found = next((cls.read(p) for p in places if p.exists()), cls())
        return flags.over(found).over(cls.defaults())
