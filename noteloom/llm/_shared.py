"""What the corpus operators share: tables in the cluster's shared folder, packed exchanges and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import handled, tidy

#: A join side is broadcast when it has no more rows, and its table no more bytes, than this; beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 8 << 20
#: Bytes of one Arrow batch of rows with texts.
BATCH_BYTES = 4 << 20
#: Bytes of one Arrow batch of packed records, apart from longer blobs; records that a Packer collects before it packs them.
PACKED_BYTES, PACKED_RECORDS = 8 << 20, 500_000
_own: dict[str, str] = {}
_made: list[list[DataFrame]] = []


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


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends here and a lost executor costs nothing."""
    path = f"{folder(df.sparkSession)}/noteloom/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._noteloom_path = path
    if _made:
        _made[-1].append(out)
    return out


@contextmanager
def temporary() -> Iterator[list[DataFrame]]:
    """The tables that cut() makes meanwhile, for drop() when nothing reads them any more."""
    _made.append([])
    try:
        yield _made[-1]
    finally:
        _made.pop()


def kept(make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns as a table, without those that it needed."""
    with temporary() as made:
        out = cut(make())
    drop(*(t for t in made if t is not out))
    if _made:
        _made[-1].append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_noteloom_path", None)
        if path:
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def texts(df: DataFrame) -> DataFrame:
    """df, whose rows go to Python in batches of about BATCH_BYTES: rows hold whole texts, and some are very long.

    Spark reads this setting when a plan runs, so it stays in the session; it decides the size of batches, not what they hold. A lower
    setting of the session stays.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")
    return df


def fresh(df: DataFrame, name: str) -> str:
    """A column name like the given one that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is a table of cut() of few enough rows and bytes."""
    return F.broadcast(df) if stored_bytes(df) <= BROADCAST_BYTES and df.count() <= BROADCAST_ROWS else df


def stored_bytes(table: DataFrame) -> int:
    """Bytes of the files of a table of cut()."""
    jvm = table.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(table._noteloom_path)
    return at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def buckets(spark: SparkSession) -> int:
    """Buckets of a packed exchange: several for each shuffle partition, so that they follow the cluster's own sizing."""
    return 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(bucket: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Records as one (bucket, blob) row for each bucket: a most-significant-digit split, moved by Spark as few large rows."""
    if not len(records):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    del order
    starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
    at = np.append(starts, len(records)) * records.itemsize
    names, data = bucket[starts].astype(np.int32), records.view(np.uint8)
    part = at[:-1] // PACKED_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(starts)]
    for a, b in zip(cuts, cuts[1:]):  # the blobs are slices of the sorted records, not copies
        offsets = pa.array(at[a : b + 1] - at[a], pa.int32())
        blobs = pa.Array.from_buffers(pa.binary(), b - a, [None, offsets.buffers()[1], pa.py_buffer(data[at[a] : at[b]])])
        yield pa.RecordBatch.from_arrays([pa.array(names[a:b]), blobs], ["bucket", "blob"])


class Packer:
    """Collects records of one task and packs them when many have come."""

    def __init__(self, n: int, most: int = PACKED_RECORDS):
        self.n, self.most, self.parts, self.size = n, most, [], 0

    def add(self, key: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(((key % np.uint64(self.n)).astype(np.int32), records))
        self.size += len(records)
        if self.size >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        parts, self.parts, self.size = self.parts, [], 0
        if parts:
            key, records = np.concatenate([b for b, _ in parts]), [r for _, r in parts]
            del parts  # nothing is held twice while it is packed
            yield from pack(key, np.concatenate(records) if len(records) > 1 else records.pop())
            tidy()


PACKED = "bucket int, blob binary"


def unpack(t: pa.Table, dtype: np.dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), dtype) for c in t.column("blob").chunks for x in c] or [np.zeros(0, dtype)])


def by_bucket(packed: DataFrame, f: Callable[[np.ndarray], pa.Table | Iterable[pa.RecordBatch]], dtype: np.dtype, schema: str) -> DataFrame:
    """Run f over the records of each bucket."""

    def run(t: pa.Table) -> pa.Table:
        out = f(unpack(t, dtype))
        handled(t.nbytes)
        return out

    return packed.groupBy("bucket").applyInArrow(run, schema)


def groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1])
    return starts, np.diff(np.append(starts, len(sorted_keys)))
