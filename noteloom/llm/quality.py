"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

1. Features of a text: hashed byte trigrams (digits as one sign, case and marks kept) and one
   term for the share of distinct words. Document frequencies are counted over all documents.
2. A sample of labelled documents, at most SAMPLE and half of them of each class where there are
   enough (chosen by the hash of doc_id), gives the latent space: the leading RANK right singular
   vectors of their weighted features.
3. The labelled vectors are broadcast; every document's cosine products with all of them are computed exactly,
   block by block, and the NEIGHBOURS largest vote with their similarity. A labelled document doesn't
   vote on itself.

Cases: a text without features (null, empty or under three bytes) has a null score and is
rejected; rows without doc_id are scored like others; rows that repeat a doc_id are scored one by one, and for the
sample the least text speaks. Labels that are null, or contradict one another, are ignored. Without any labels, scores are null and
every document with features is kept. Equal similarities go to the lowest doc_id. Very long texts are read whole. An empty table gives an empty
result. Other columns, whatever their names, are kept by keep_good() and not read otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S
from ._text import STEP, U64, Grid, blocks, large, mix, raw

FEATURES = 2048
SHARES = 8
SAMPLE = 4000
RANK = 64
NEIGHBOURS = 15
LEAST_SCORE = 0.5

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[48:58] = 48


def counts(column: pa.Array, features: int = FEATURES) -> np.ndarray:
    """Feature counts of each text: trigrams, then one of SHARES terms."""
    column = large(column)
    data, at = raw(column)
    n, grams = len(column), features - SHARES
    out = np.zeros((n, features), np.float32)
    folded = _FOLD[data]
    for a in range(0, max(0, len(folded) - 2), STEP):  # in steps, so that one huge text needs no huge arrays
        x = folded[a : a + STEP + 2]
        code = (mix(((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]).astype(U64)) % U64(grams)).astype(np.int64)
        place = np.arange(a, a + len(code))
        row = np.searchsorted(at, place, "right") - 1
        inside = place + 2 < at[row + 1]
        low, high = row[0], row[-1] + 1
        got = np.bincount((row[inside] - low) * grams + code[inside], minlength=(high - low) * grams)
        out[low:high, :grams] += got.reshape(high - low, grams)
    grid = Grid(column)
    row = np.repeat(np.arange(n), np.diff(grid.row))
    order = np.lexsort((grid.hash, row))
    h, r = grid.hash[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    words = np.diff(grid.row)
    share = np.bincount(r[new], minlength=n) / np.maximum(1, words)
    term = np.minimum((share * SHARES).astype(int), SHARES - 1)
    some = words >= 20  # a share of few words says nothing
    out[np.flatnonzero(some), grams + term[some]] = 20
    return out


def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(c) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def document_frequencies(docs: DataFrame, features: int = FEATURES) -> tuple[int, np.ndarray]:
    """The number of documents and, for each feature, of those that have it: over all documents."""

    def run(batches):
        total, n = np.zeros(features, np.int64), 0
        for batch in batches:
            for b in blocks(batch, "text"):
                total += (counts(b.column("text"), features) > 0).sum(0)
                n += len(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, features, dtype=np.int32)), pa.array(np.concatenate([[n], total]))], ["feature", "n"])

    found = S.texts(docs).select(F.col("text").cast("string").alias("text")).mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(features + 1, np.int64)
    df[found.feature.to_numpy() + 1] = found.n.to_numpy()
    return int(df[0]), df[1:]


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, qualities and feature counts of the labelled sample, by doc_id."""
    sure = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("high")).filter("quality = high and quality in (0, 1)")
    ids = S.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct())
    sure = S.cut(sure.join(ids, "doc_id", "left_semi").select("doc_id", "quality"))
    sizes = {r.quality: r["count"] for r in sure.groupBy("quality").count().collect()}
    lesser = min(sizes.get(0, 0), sizes.get(1, 0), most // 2)
    chosen = None
    for q in (0, 1):
        n = min(sizes.get(q, 0), most - lesser if sizes.get(q, 0) > most // 2 else most)
        part = sure.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = S.cut(chosen)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                c = counts(b.column("text"), features)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([x.tobytes() for x in c], pa.binary())], ["doc_id", "quality", "c"])

    t = text.mapInArrow(run, "doc_id long, quality int, c binary").toArrow().sort_by("doc_id")
    S.drop(sure, ids, chosen)
    c = np.frombuffer(b"".join(t.column("c").to_pylist()), np.float32).reshape(-1, features)
    return t.column("doc_id").to_numpy(), t.column("quality").to_numpy(), c


def latent(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(0).standard_normal((x.shape[1], min(x.shape[1], rank + 16))).astype(np.float32)
    for _ in range(8):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank].astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-12)


class Voter:
    def __init__(self, ids: np.ndarray, quality: np.ndarray, c: np.ndarray, n: int, df: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS):
        self.idf = np.log((n + 1) / (df + 1)).astype(np.float32) + 1
        x = weighted(c, self.idf)
        self.v = latent(x, rank) if len(x) else np.zeros((c.shape[1], 1), np.float32)
        self.ids, self.quality, self.z, self.k = ids, quality.astype(np.float64), unit(x @ self.v), neighbours

    def score(self, ids: np.ndarray, c: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """The share of good among the neighbours' votes; NaN where nothing votes. known: which ids there are, if not all."""
        d = unit(weighted(c, self.idf) @ self.v)
        m = len(self.z)
        out = np.full(len(d), np.nan)
        if not m:
            return out
        k = min(self.k, m)
        for a in range(0, len(d), 512):
            sim = np.round(d[a : a + 512] @ self.z.T, 6)
            own = ids[a : a + 512, None] == self.ids[None]
            sim[own if known is None else own & known[a : a + 512, None]] = -1
            order = np.round(sim * 1e6).astype(np.int64) * m - np.arange(m)  # equal similarities: the lower doc_id
            top = np.argpartition(order, m - k, axis=1)[:, m - k :]
            w = np.maximum(np.take_along_axis(sim, top, 1), 0).astype(np.float64)
            total = w.sum(1)
            good = total > 0
            out[a : a + 512][good] = (w * self.quality[top]).sum(1)[good] / total[good]
        return np.round(out, 6)


def fitted(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Voter:
    n, df = document_frequencies(docs)
    return Voter(*sample(docs, labels, most), n, df, rank, neighbours)


def _score(batch: pa.RecordBatch, voter: Voter) -> tuple[pa.Array, pa.Array]:
    """Scores and decisions for a block of rows with doc_id and text."""
    c = counts(batch.column("text"))
    ids = batch.column("doc_id").cast(pa.int64())
    score = voter.score(np.asarray(ids.fill_null(0)), c, np.asarray(ids.is_valid()))
    some = c.any(1)
    keep = some & (score >= LEAST_SCORE if len(voter.z) else True)
    return pa.array(score, mask=np.isnan(score)), pa.array(keep)


def scores(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """(doc_id, score, keep) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, **params))

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_score(b, shared.value)], ["doc_id", "score", "keep"])

    return S.texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """docs without the rows that are rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, **params))

    def run(batches):
        for batch in batches:
            for b in blocks(batch, "text"):
                yield b.filter(_score(b, shared.value)[1])

    return S.texts(docs).mapInArrow(run, docs.schema)
