"""Embedding near-dedup by binary codes of randomised rotations.

1. A vector is scaled to unit length and turned by random rotations. The signs of its
   turned coordinates are its code; the code's inner product with the vector itself is the
   correction factor stored with it. ``<code(a), b> / factor(a)`` is an unbiased estimate of
   ``<a, b>``, and its error has a known spread (from the factor and the dimension).
2. Candidates: bits of further rotations are cut into ``tables`` keys of ``bits``
   bits; vectors that share a key meet. ``bits`` follows the logarithm of the number of vectors,
   so that chance meetings stay in proportion to it, and ``tables`` is as large as a pair at the
   threshold needs to meet with probability RECALL.
3. A pair is recomputed exactly unless the upper confidence bound of its estimate, averaged over
   ROTATIONS codes, lies below the threshold. Vectors with equal bytes are one representative.
   Among vectors of one key, the first meets all others; then pairs across groups meet.
4. Groups are the connected components; the lowest vec_id stays.

Cases: null, empty or zero vectors and vectors with null, NaN or infinite parts are
in no group; vectors of different dimension are never compared; rows without vec_id are ignored;
of rows that repeat a vec_id, the one with the lowest digest counts. Ties go to the lowest vec_id. An
empty table gives an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S
from ._text import U64, mix
from .near_dedup import DRIVER_EDGES, components, cross_pairs, hub_pairs

THRESHOLD = 0.95
RECALL = 0.98
ROTATIONS = 4
#: Standard deviations of the estimate that its confidence bound takes in.
BOUND = 4.0
#: Bits of a key beyond the logarithm of the number of vectors.
SPARE_BITS = 2

_MEMBER = np.dtype([("v", "u8"), ("doc", "i8")])


@lru_cache(maxsize=64)
def rotation(dim: int, k: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng((dim, k)).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def by_dim(ids: pa.Array, lists: pa.Array):
    """(positions, unit vectors) of the usable vectors of a batch, one dimension at a time."""
    sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    ok = np.asarray(ids.is_valid()) & (sizes > 0)
    flat = lists.flatten()
    flat = np.asarray(flat.cast(pa.float32()).fill_null(float("nan")), np.float32)
    start = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes[ok]):
        at = np.flatnonzero(ok & (sizes == dim))
        x = flat[start[at][:, None] + np.arange(dim)].astype(np.float64)
        with np.errstate(all="ignore"):
            norm = np.sqrt((x * x).sum(1))
        good = np.isfinite(norm) & (norm > 0)
        yield at[good], (x[good] / norm[good, None]).astype(np.float32)


def encoded(vectors: DataFrame, rotations: int = ROTATIONS) -> DataFrame:
    """(vec_id, sig, unit, code, factor): digest, unit vector, sign codes and correction factors of the usable vectors."""

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id")
            for at, x in by_dim(ids, batch.column("embedding")):
                if not len(at):
                    continue
                dim = x.shape[1]
                codes, factors = [], []
                for k in range(rotations):
                    y = x @ rotation(dim, k).T
                    codes.append(np.packbits(y > 0, axis=1))
                    factors.append(np.abs(y).sum(1) / np.sqrt(dim))
                code, factor = np.concatenate(codes, 1), np.stack(factors, 1).astype(np.float32)
                raw = [r.tobytes() for r in x]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array([f.tobytes() for f in factor], pa.binary())],
                    ["vec_id", "sig", "unit", "code", "factor"],
                )

    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    return read.mapInArrow(run, "vec_id long, sig binary, unit binary, code binary, factor binary")


def shape(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = min(60, max(8, math.ceil(math.log2(max(2, n))) + SPARE_BITS))
    p = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return bits, 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - p))


def members(reps: DataFrame, bits: int, tables: int) -> DataFrame:
    """(v, doc, central): vectors that share a key with another."""
    n = S.buckets(reps.sparkSession)

    def keys(batches):
        p = S.Packer(n)
        powers = U64(1) << np.arange(bits, dtype=U64)
        for b in batches:
            ids = b.column("vec_id").to_numpy()
            units = b.column("unit").to_pylist()
            dims = np.array([len(u) // 4 for u in units])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(units[i] for i in at), np.float32).reshape(-1, dim)
                need = bits * tables
                signs = np.concatenate([x @ rotation(int(dim), 1000 + k).T > 0 for k in range(-(-need // int(dim)))], 1)[:, :need]
                key = (signs.reshape(len(at), tables, bits) * powers).sum(2, dtype=U64)
                key = mix(key ^ mix(np.arange(tables, dtype=U64) * U64(1_000_003) + U64(dim)))
                rec = np.empty(key.size, _MEMBER)
                rec["v"], rec["doc"] = key.ravel(), np.repeat(ids[at], tables)
                yield from p.add(rec["v"], rec)
        yield from p.flush()

    def shared(rec):
        rec = rec[np.lexsort((rec["doc"], rec["v"]))]
        _, size = S.groups(rec["v"])
        rec = rec[np.repeat(size, size) > 1]
        return pa.table({"v": rec["v"].view(np.int64), "doc": rec["doc"], "central": np.zeros(len(rec))})

    return S.by_bucket(reps.select("vec_id", "unit").mapInArrow(keys, S.PACKED), shared, _MEMBER, "v long, doc long, central double")


def estimate(code: np.ndarray, factor: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of inner products from codes and factors of one side and unit vectors of the other, and their spread."""
    n, dim = other.shape
    rotations = factor.shape[1]
    width = code.shape[1] // rotations
    total, var = np.zeros(n), np.zeros(n)
    for k in range(rotations):
        signs = np.unpackbits(code[:, k * width : (k + 1) * width], axis=1)[:, :dim].astype(np.float32) * 2 - 1
        f = factor[:, k].astype(np.float64)
        total += (signs * (other @ rotation(dim, k).T)).sum(1) / np.sqrt(dim) / f
        var += np.maximum(0, 1 - f * f) / (f * f) / max(1, dim - 1)
    return total / rotations, np.sqrt(var) / rotations


def verified(pairs: DataFrame, reps: DataFrame, threshold: float, bound: float = BOUND) -> DataFrame:
    """(a, b, similarity) of the pairs that the estimate doesn't rule out and whose exact similarity reaches the threshold."""
    coded = pairs.join(reps.select(F.col("vec_id").alias("a"), "code", "factor"), "a").join(reps.select(F.col("vec_id").alias("b"), F.col("unit").alias("ub")), "b")

    def screen(batches):
        for batch in batches:
            code, factor, ub = (batch.column(x).to_pylist() for x in ("code", "factor", "ub"))
            keep = np.zeros(len(ub), bool)
            shapes = np.array([(len(u) // 4, len(c)) for u, c in zip(ub, code)]).reshape(-1, 2)
            for dim, size in np.unique(shapes, axis=0):
                at = np.flatnonzero((shapes == (dim, size)).all(1))
                f = np.frombuffer(b"".join(factor[i] for i in at), np.float32).reshape(len(at), -1)
                if -(-dim // 8) * f.shape[1] != size:  # another dimension
                    continue
                est, spread = estimate(np.frombuffer(b"".join(code[i] for i in at), np.uint8).reshape(len(at), -1), f, np.frombuffer(b"".join(ub[i] for i in at), np.float32).reshape(len(at), dim))
                keep[at] = est + bound * spread >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = S.cut(coded.mapInArrow(screen, "a long, b long"))
    full = left.join(reps.select(F.col("vec_id").alias("a"), F.col("unit").alias("ua")), "a").join(reps.select(F.col("vec_id").alias("b"), F.col("unit").alias("ub")), "b")

    def exact(batches):
        for batch in batches:
            sim = np.array([float(np.dot(np.frombuffer(x, np.float32).astype(np.float64), np.frombuffer(y, np.float32))) if len(x) == len(y) else -2.0 for x, y in zip(batch.column("ua").to_pylist(), batch.column("ub").to_pylist())])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sim, pa.float64())], ["a", "b", "similarity"]).filter(pa.array(sim >= threshold, pa.bool_()))

    return S.cut(full.mapInArrow(exact, "a long, b long, similarity double"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, rotations: int = ROTATIONS, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(vec_id, group_id, kept) of every vector in a group of two or more; group_id is the lowest vec_id, the one kept."""
    return S.kept(lambda: _groups(vectors, threshold, recall, rotations, driver_edges))


def _groups(vectors: DataFrame, threshold: float, recall: float, rotations: int, driver_edges: int) -> DataFrame:
    coded = encoded(vectors, rotations)
    one = S.cut(coded.groupBy("vec_id").agg(F.min(F.struct("sig", "unit", "code", "factor")).alias("x")).select("vec_id", "x.*"))
    rep = S.cut(one.groupBy("sig").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    reps = S.cut(one.join(rep.select("sig", F.col("rep").alias("vec_id")), ["sig", "vec_id"], "left_semi"))
    bits, tables = shape(reps.count(), threshold, recall)
    met = S.cut(members(reps, bits, tables))
    edges = verified(hub_pairs(met), reps, threshold)
    labels = S.cut(components(edges, driver_edges))
    rest = S.cut(cross_pairs(met, labels))
    if not rest.isEmpty():
        labels = S.cut(components(edges.unionByName(verified(rest, reps, threshold)), driver_edges))
    of_rep = rep.join(labels.withColumnRenamed("id", "rep"), "rep", "left").filter("copies > 1 or label is not null").select("sig", F.coalesce("label", "rep").alias("group_id"))
    return one.select("vec_id", "sig").join(of_rep, "sig").select("vec_id", "group_id", (F.col("vec_id") == F.col("group_id")).alias("kept"))
