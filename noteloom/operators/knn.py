"""Exact nearest neighbours over a table of vectors."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noteloom.functions.vectors import METRICS

MOST_K = 4096
MOST_DIMS = 8192
DECIMALS = 9


def distance(column: str, query: list[float], metric: str = "l2") -> Column:
    """The distance to one query, unrolled over its parts, so that it is one generated expression and no lambda."""
    v = F.col(column)
    wrong = F.size(v) != len(query)
    if metric == "hamming":
        return METRICS["hamming"](v, F.array(*(F.lit(bool(x)) for x in query)))
    part = [F.get(v, i).cast("double") for i in range(len(query))]
    q = [F.lit(float(x)) for x in query]
    if metric == "l2":
        value = F.sqrt(_total([(a - b) * (a - b) for a, b in zip(part, q)]))
    elif metric == "l1":
        value = _total([F.abs(a - b) for a, b in zip(part, q)])
    elif metric == "cosine":
        size = float(np.sqrt(sum(float(x) ** 2 for x in query)))
        norm = F.sqrt(_total([a * a for a in part])) * F.lit(size)
        value = F.when(norm == 0, F.lit(float("nan"))).otherwise(1 - _total([a * b for a, b in zip(part, q)]) / F.nullif(norm, F.lit(0.0)))
    else:
        raise ValueError(f"no metric {metric}")
    return F.when(wrong, F.raise_error(F.lit("vectors differ in dimension"))).otherwise(value)


def _total(parts: list[Column]) -> Column:
    """A sum as a balanced tree, so that the plan is not as deep as the vector is long."""
    while len(parts) > 1:
        parts = [parts[i] + parts[i + 1] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def knn(vectors: DataFrame, query: list[float], k: int, metric: str = "l2", key: str = "vec_id", column: str = "embedding", where: Column | None = None, ids: DataFrame | None = None, within: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """(key, distance) of the k nearest; filters come before distances, the range of distances before the choice of k."""
    if not 0 <= k <= MOST_K:
        raise ValueError(f"k must be between 0 and {MOST_K}")
    if not 0 < len(query) <= MOST_DIMS:
        raise ValueError(f"vectors have up to {MOST_DIMS} dimensions")
    if where is not None:
        vectors = vectors.filter(where)
    if ids is not None:
        vectors = vectors.join(ids.select(key), key, "left_semi")
    found = vectors.filter(F.col(column).isNotNull()).select(key, F.round(distance(column, query, metric), DECIMALS).alias("distance"))
    low, high = within
    if low is not None:
        found = found.filter(F.col("distance") >= low)
    if high is not None:
        found = found.filter(F.col("distance") <= high)
    return found.orderBy("distance", key).limit(k)


#: Bytes of the queries that one scan of the vectors takes with it.
SHARD_BYTES = 32 << 20


def knn_per_query(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", key: str = "vec_id", query_key: str = "query_id", column: str = "embedding", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(query_id, key, distance, rank): k nearest for each query.

    Queries go round in shards of about shard_bytes, each broadcast to one scan of the vectors. A task meets its
    vectors batch by batch as matrix products and keeps each query's k best; a window settles what the tasks found. No vector is shuffled.
    """
    asked = queries.filter(F.col(column).isNotNull()).select(F.col(query_key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    n, dims = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    shards = max(1, -(-n * dims * 8 // shard_bytes))
    read = vectors.filter(F.col(column).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(column).cast("array<double>").alias("v"))
    every = None
    for shard in range(shards):
        part = asked if shards == 1 else asked.filter(F.pmod(F.xxhash64("id"), F.lit(shards)) == shard)
        best = _best(read, part, k, metric, key, query_key)
        every = best if every is None else every.unionByName(best)
    rank = F.row_number().over(W.partitionBy(query_key).orderBy("distance", key))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k)


def _matrix(ids: pa.ChunkedArray | pa.Array, lists: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, which must be of one dimension."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, size = lists.flatten().to_numpy(zero_copy_only=False), len(lists)
    if size and (len(flat) % size or (np.asarray(lists.value_lengths()) != len(flat) // size).any()):
        raise ValueError("vectors differ in dimension")
    return ids.to_numpy(), flat.reshape(size, -1)


def _best(read: DataFrame, asked: DataFrame, k: int, metric: str, key: str, query_key: str) -> DataFrame:
    """(query_key, key, distance): the k best for each query in each task."""
    t = asked.toArrow()  # one shard
    shared = read.sparkSession.sparkContext.broadcast(_matrix(t.column("id"), t.column("v")))

    def run(batches):
        qi, qm = shared.value
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            if not len(qi) or not len(batch):
                continue
            vi, vm = _matrix(batch.column(key), batch.column("v"))
            if vm.shape[1] != qm.shape[1]:
                raise ValueError("vectors differ in dimension")
            step = max(1, (1 << 22) // len(vi))  # products of a few million numbers at a time
            for a in range(0, len(qi), step):
                row, col, d = nearest(qm[a : a + step], vm, vi, k, metric)
                found = tuple(np.concatenate(x) for x in zip(found, (row + a, vi[col], d)))
            order = np.lexsort((found[1], found[2], found[0]))
            row, ids, d = (x[order] for x in found)
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            found = row[keep], ids[keep], d[keep]
        yield pa.RecordBatch.from_arrays([pa.array(qi[found[0]]), pa.array(found[1]), pa.array(found[2])], [query_key, key, "distance"])

    return read.mapInArrow(run, f"{query_key} long, {key} long, distance double")


def nearest(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded distance) of each query's k best; equal distances go by id."""
    n = min(k, len(v))
    if metric != "l2" or not n or not (np.isfinite(q).all() and np.isfinite(v).all()):
        d = np.round(pairwise(q, v, metric), DECIMALS)
        col = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :n]
        return np.repeat(np.arange(len(q)), n), col.ravel(), np.take_along_axis(d, col, 1).ravel()
    # A matrix product is inexact for near vectors: it only chooses what is then computed from the differences.
    qq, vv = (q * q).sum(1), (v * v).sum(1)
    square = qq[:, None] + vv[None] - 2 * q @ v.T
    slack = 8 * (q.shape[1] + 4) * np.finfo(np.float64).eps * (qq + vv.max())
    most = (np.sqrt(np.maximum(0, np.partition(square, n - 1, axis=1)[:, n - 1] + slack)) + 2 * 10.0**-DECIMALS) ** 2 + slack
    row, col = np.nonzero(square <= most[:, None])
    d = np.concatenate([((q[row[i : i + 65536]] - v[col[i : i + 65536]]) ** 2).sum(1) for i in range(0, len(row), 65536)])
    d = np.round(np.sqrt(d), DECIMALS)
    order = np.lexsort((ids[col], d, row))
    row, col, d = row[order], col[order], d[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < n
    return row[keep], col[keep], d[keep]


def pairwise(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l1":
        return np.stack([np.abs(v - x).sum(1) for x in q]) if len(q) else np.zeros((0, len(v)))
    if metric == "cosine":
        with np.errstate(all="ignore"):
            return 1 - (q @ v.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None])
    if metric == "l2":
        return np.sqrt(np.stack([((v - x) ** 2).sum(1) for x in q])) if len(q) else np.zeros((0, len(v)))
    raise ValueError(f"no metric {metric}")


def similarity(d: Column) -> Column:
    return 1 / (1 + d)


@dataclass
class VectorColumn:
    name: str
    kind: str
    dims: int
    metric: str = "l2"


@dataclass
class TableSpec:
    """The columns of a vector table, read from its definition."""

    key: str = "rowid"
    vectors: list[VectorColumn] = field(default_factory=list)
    partitions: list[str] = field(default_factory=list)
    auxiliary: list[str] = field(default_factory=list)
    metadata: list[tuple[str, str]] = field(default_factory=list)
    chunk_size: int = 1024

    @classmethod
    def parse(cls, text: str) -> TableSpec:
        out = cls()
        kinds = {"float": "float32", "f32": "float32", "int8": "int8", "i8": "int8", "bit": "bit"}
        for part in (p.strip() for p in text.split(",")):
            if m := re.fullmatch(r"(\w+)\s+(float|f32|int8|i8|bit)\s*\[\s*(\d+)\s*\](?:\s+distance_metric\s*=\s*(\w+))?", part, re.I):
                kind, dims = kinds[m[2].lower()], int(m[3])
                metric = (m[4] or ("hamming" if kind == "bit" else "l2")).lower()
                if metric.upper() in ("L2", "L1") or metric == "cosine" or kind == "bit" and not m[4]:
                    pass
                else:
                    raise ValueError(f"no metric {m[4]} for {kind}")
                if kind == "bit" and m[4]:
                    raise ValueError("bit vectors have no choice of metric")
                if not 0 < dims <= MOST_DIMS or kind == "bit" and dims % 8:
                    raise ValueError(f"wrong number of dimensions: {dims}")
                out.vectors.append(VectorColumn(m[1], kind, dims, metric))
            elif m := re.fullmatch(r"(\w+)\s+(text|integer)\s+primary\s+key", part, re.I):
                out.key = m[1]
            elif m := re.fullmatch(r"(\w+)\s+(?:text|integer)\s+partition\s+key", part, re.I):
                out.partitions.append(m[1])
            elif m := re.fullmatch(r"\+\s*(\w+)\s+\w+", part):
                out.auxiliary.append(m[1])
            elif m := re.fullmatch(r"chunk_size\s*=\s*(\d+)", part, re.I):
                out.chunk_size = int(m[1])
                if out.chunk_size % 8 or not 0 < out.chunk_size <= 4096:
                    raise ValueError("chunk_size is a multiple of 8 up to 4096")
            elif m := re.fullmatch(r"(\w+)\s+(bool|boolean|int|integer|int64|float|double|text)", part, re.I):
                out.metadata.append((m[1], m[2].lower()))
            else:
                raise ValueError(f"can't read column: {part}")
        for what, most in ((out.vectors, 16), (out.partitions, 4), (out.auxiliary, 16), (out.metadata, 16)):
            if len(what) > most:
                raise ValueError("too many columns of one kind")
        if not out.vectors:
            raise ValueError("a vector table needs a vector column")
        return out
