"""The folder that all executors share, and tables in it that are made once for a state of their source."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of keys that are broadcast; more of them are joined by a shuffle.
FEW = 200_000
_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only in local mode, where it is unset, a temporary one."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + _own.setdefault("at", tempfile.mkdtemp(prefix="noteloom-"))


def state(spark: SparkSession, path: str) -> str:
    """A digest of a table's files: names, lengths and times. Another state of the table has another one."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listFiles(at, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:24]


def stored(spark: SparkSession, name: str, source: str, make: Callable[[str], None]) -> str:
    """The path of a derived table of ``source``: made by make(path) unless its state is stored already.

    It is written beside its place and moved there whole, so a run that is cut short leaves nothing that could be taken for it.
    """
    path = f"{folder(spark)}/noteloom-{name}/{state(spark, source)}"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        draft = f"{path}.{hashlib.sha256(str(id(make)).encode()).hexdigest()[:8]}"
        fs.delete(jvm.org.apache.hadoop.fs.Path(draft), True)
        make(draft)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(draft), at) and not fs.exists(at):
            raise OSError(f"{path} can't be moved to its place")
    return path


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def settled(df: DataFrame, most: int | None = None) -> DataFrame:
    """df's rows, of a few narrow columns, worked out once: at hand and for broadcast if they are few, else a table in the shared folder."""
    most, spark = FEW if most is None else most, df.sparkSession
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows <= most:
        return F.broadcast(spark.createDataFrame(rows, df.schema))
    path = f"{folder(spark)}/noteloom-settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
