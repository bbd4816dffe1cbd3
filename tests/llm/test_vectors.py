"""Vector operators: recall by length of vectors, each length apart, few and clashing rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import op4_additive, op10_lattice


def unit(rng, n, dim):
    x = rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("dim", [8, 16, 64, 384, 1024])
def test_pairs_at_the_threshold_meet(dim):
    rng, cosine, n = np.random.default_rng(dim), 0.95, 50_000
    a, b = unit(rng, 1500, dim), unit(rng, 1500, dim)
    b -= (a * b).sum(1, keepdims=True) * a
    near = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    blocks, scale, tables = op10_lattice.plan(n, dim, cosine)
    left, right = (op10_lattice.cell_keys(x, blocks, scale, tables, 11) for x in (a, near))
    meet = lambda x, y: np.array([len(np.intersect1d(p, q)) > 0 for p, q in zip(x, y)])
    assert meet(left, right).mean() >= 0.95
    assert meet(left, np.roll(left, 1, 0)).mean() < 0.01


def test_keys_get_sharper_with_more_vectors():
    for dim in (16, 64, 384):
        far = {s: p for s, _, p in op10_lattice.meeting(dim, 0.95)}
        share = [tables * far[scale] ** blocks for blocks, scale, tables in (op10_lattice.plan(n, dim, 0.95) for n in (10**4, 10**6, 10**8))]
        assert share[0] > 5 * share[1] > 25 * share[2]


def test_lengths_are_apart(spark):
    rng = np.random.default_rng(2)
    x, y = unit(rng, 200, 16), unit(rng, 8, 24)
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(1000 + i, v.tolist(), "a") for i, v in enumerate([*y, y[0]])] + [(None, x[0].tolist(), "a"), (1, x[1].tolist(), "a")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, codes string")
    got = op10_lattice.near_duplicates(df).collect()
    by = {r.vec_id: r for r in got}
    assert (by[1000].n_links, by[1008].n_links, by[1008].component_id) == (1, 1, 1000) and by[1000].kept and not by[1008].kept
    assert len(got) == 210 and (by[None].n_links, by[None].component_id, by[None].kept) == (0, None, True)
    near = op4_additive.nearest(df, F.col("vec_id") % 20 == 0, probe_share=1.0, shelf_rows=50, query_block=3).collect()
    for q, n in [*((q, 200) for q in range(0, 200, 20)), (1000, 9)]:
        base, own = (x, 0) if q < 1000 else (np.vstack([y, y[:1]]), 1000)
        base = base.astype(np.float32).astype(np.float64)
        s = base @ base[q - own]
        s[q - own] = -np.inf
        true = [own + int(i) for i in np.lexsort((np.arange(len(s)), -s))[: min(20, n - 1)]]
        mine = sorted((r for r in near if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in mine] == true and np.allclose([r.score for r in mine], s[np.array(true) - own], atol=1e-12)
