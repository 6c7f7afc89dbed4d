"""Jobs that once covered only a part of their input."""

import numpy as np
import oracle
import pytest

from noteloom.operators import knn


@pytest.mark.parametrize(("metric", "shard_bytes"), [("l2", 1 << 25), ("l2", 20_000), ("l1", 1 << 25), ("cosine", 50_000)])
def test_every_vector_asks_for_its_neighbours(spark, metric, shard_bytes):
    e = sorted(spark.read.parquet(f"{oracle.SF}/embeddings.parquet").select("vec_id", "embedding").collect())
    ids, v = np.array([r.vec_id for r in e]), np.array([r.embedding for r in e], np.float64)
    want = set()
    for i, x in zip(ids, v):
        d = {"l2": lambda: np.sqrt(((v - x) ** 2).sum(1)), "l1": lambda: np.abs(v - x).sum(1), "cosine": lambda: 1 - (v @ x) / np.sqrt((v * v).sum(1) * (x @ x))}[metric]().round(9)  # noqa: B023
        want |= {(int(i), int(ids[j]), rank + 1) for rank, j in enumerate(np.lexsort((ids, d))[:5])}
    df = spark.read.parquet(f"{oracle.SF}/embeddings.parquet")
    got = {(r.query_id, r.vec_id, r["rank"]) for r in knn.knn_per_query(df, df.select(df.vec_id.alias("query_id"), "embedding"), 5, metric, shard_bytes=shard_bytes).collect()}
    assert len(got ^ want) <= (0 if metric != "cosine" else 4)  # a product may round another way


def test_large_blocks_give_exact_distances():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((700, 64))
    v[600:] = v[:100]
    ids = rng.permutation(700)
    row, col, d = knn.nearest(v, v, ids, 3, "l2")
    for i, x in enumerate(v):
        whole = np.round(np.sqrt(((v - x) ** 2).sum(1)), 9)
        order = np.lexsort((ids, whole))[:3]
        assert list(col[row == i]) == list(order) and list(d[row == i]) == list(whole[order])
    assert (d[np.arange(0, len(d), 3)] == 0).all()
