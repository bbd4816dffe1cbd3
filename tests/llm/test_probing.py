"""Which shelves a query is sent to: few where vectors form clusters, as many as the recall asks for elsewhere."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import op4_additive


def clustered(rng, n, dim, size=60):
    centre = rng.standard_normal((n // size, dim))
    return (centre[rng.integers(0, len(centre), n)] + 0.3 * rng.standard_normal((n, dim))).astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(6)


def recall(got, x, queries, k=20):
    x, hits = x.astype(np.float64), 0
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({r.vec_id for r in got if r.query_id == q} & set(np.lexsort((np.arange(len(x)), -s))[:k].tolist()))
    return hits / (k * len(queries))


@pytest.mark.parametrize("kind", ["clusters", "random"])
def test_measured_recall(spark, kind):
    rng = np.random.default_rng(8)
    x = clustered(rng, 6000, 16) if kind == "clusters" else rng.standard_normal((6000, 16)).astype(np.float32)
    got = op4_additive.nearest(frame(spark, x), F.col("vec_id") % 20 == 0, shelf_rows=300, query_block=50, rare_rows=100).collect()
    assert recall(got, x, range(0, 6000, 20)) >= 0.93


def test_a_share_reaches_no_more_shelves():
    rng = np.random.default_rng(3)
    x = clustered(rng, 100_000, 32)
    words = op4_additive.fit_codebooks(x[:16_000], [1024], rounds=4)[0]
    own = np.concatenate([(x[lo : lo + 10_000] @ words.T - 0.5 * (words * words).sum(1)).argmax(1) for lo in range(0, len(x), 10_000)])
    size = np.bincount(own, minlength=1024)
    laid = op4_additive.shelves(words, size, 2048)
    assert sorted(np.concatenate(laid).tolist()) == list(range(1024)) and all(size[s].sum() <= 2048 or len(s) == 1 for s in laid)
    assert len(laid) <= 2.5 * len(x) / 2048
    of = np.empty(1024, int)
    for s, lists in enumerate(laid):
        of[lists] = s
    some = op4_additive.by_weight(x[:200], words, size, laid)[:, : int(0.1 * len(laid))]
    hits = 0
    for q in range(200):
        s = x @ x[q]
        s[q] = -np.inf
        hits += np.isin(of[own[np.argpartition(-s, 20)[:20]]], some[q]).sum()
    assert hits / 4000 >= 0.9


def test_equal_words_and_empty_lists_are_laid_out():
    for words in (np.zeros((5, 3)), np.arange(5.0)[:, None] * np.ones(3)):
        for size in ([0] * 5, [9] * 5, [100, 0, 0, 0, 0]):
            laid = op4_additive.shelves(words, np.array(size), 10)
            assert sorted(np.concatenate(laid).tolist()) == list(range(5))


def test_many_rare_lengths_take_one_plan(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(1 + i % 150).tolist()) for i in range(600)]
    got = op4_additive.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    for q in range(0, 600, 20):
        true = sorted((-float(np.dot(v, rows[q][1])), i) for i, v in rows if i != q and len(v) == len(rows[q][1]))
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [i for _, i, _ in mine] == [i for _, i in true[:20]] and np.allclose([s for *_, s in mine], [-s for s, _ in true[:20]])


def test_too_many_lengths_raise(spark):
    rows = [(i, [1.0 + i] * (1 + i % 3)) for i in range(30)]
    with pytest.raises(ValueError):
        op4_additive.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") < 5, rare_rows=5, max_lengths=2)
