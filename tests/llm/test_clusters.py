"""Clusters of near copies and of scaled copies: every link is counted, and no two of one leader are compared."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import op10_lattice


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id bigint, embedding array<float>").repartition(8)


def by_force(x, cosine=0.95):
    x = x.astype(np.float32).astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        low = np.minimum(root, np.where(near, root[None, :], len(x)).min(1))
        if (low == root).all():
            return near.sum(1), root
        root = low


@pytest.mark.parametrize("spread", [0.02, 0.2, 0.3])
def test_clusters_beside_others(spark, spread):
    """Some vectors lie in no cluster, some at its rim, where links go by the cosine alone; blocks are small."""
    rng = np.random.default_rng(int(100 * spread))
    centre = rng.standard_normal((3, 16))
    x = np.concatenate([c + spread * rng.standard_normal((n, 16)) * np.linalg.norm(c) / 4 for c, n in zip(centre, (250, 120, 30))] + [rng.standard_normal((200, 16))])
    x = np.concatenate([x, 4 * x[:20], x[300:305]])
    links, root = by_force(x)
    got = {r.vec_id: r for r in op10_lattice.near_duplicates(frame(spark, x), block=40, group_rows=300, recall=0.999).collect()}
    mine = np.array([got[i].n_links for i in range(len(x))])
    assert (mine <= links).all() and mine.sum() >= 0.99 * links.sum()
    if spread == 0.02:
        assert (mine == links).all() and [got[i].component_id for i in range(len(x))] == root.tolist()


@pytest.mark.parametrize("kind", ["scaled", "near"])
def test_large_clusters_end_soon(spark, kind):
    rng, n = np.random.default_rng(1), 12_000
    x = rng.integers(-8, 9, 32).astype(float)
    x = x * np.arange(1, n + 1)[:, None] if kind == "scaled" else x + 0.01 * rng.standard_normal((n, 32))
    began = time.time()
    got = op10_lattice.near_duplicates(frame(spark, x))
    assert {tuple(r) for r in got.select("n_links", "component_id").distinct().collect()} == {(n - 1, 0)} and got.count() == n
    assert time.time() - began < 120 and got.where("kept").select(F.col("vec_id")).collect()[0][0] == 0
