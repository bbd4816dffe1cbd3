"""Numbers of links of the n-gram Jaccard join against brute force."""

import random

import numpy as np
import pytest

from logloom.llm import op8_jaccard


def links_by_force(texts, percent=85, words=4):
    sets = {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    near = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    return {i: sum(i != j and bool(near(a, b)) for j, b in sets.items()) for i, a in sets.items()}


@pytest.fixture(scope="module")
def copies():
    """Families of drifting copies of several lengths, cut and extended, with exact copies among them."""
    rng, out = random.Random(21), []
    pool = [f"w{k}" for k in range(300)]
    for size in (12, 40, 90, 150, 400):
        base = rng.choices(pool, k=size)
        for k in range(24):
            own = list(base)
            for _ in range(rng.randrange(1 + size // 40)):
                own[rng.randrange(size)] = rng.choice(pool)
            cut = rng.randrange(1 + size // 8)
            own = own[cut:] if k % 3 == 0 else own + rng.choices(pool, k=cut) if k % 3 == 1 else own
            out.append(" ".join(own))
            if k % 8 == 0:
                base = own
                size = len(own)
        out += [out[-1], out[-1], out[-5]]
    rng.shuffle(out)
    return list(enumerate([*out, "", None, "one two", "one two"]))


@pytest.mark.parametrize("how", [{}, {"block": 3}, {"block": 7, "group_rows": 20}, {"percent": 80, "words": 5}, {"percent": 60, "words": 2, "block": 10}])
def test_links_are_all_counted(spark, copies, how):
    docs = spark.createDataFrame([*copies, copies[0], (None, copies[1][1])], "doc_id bigint, text string").repartition(3)
    got = op8_jaccard.jaccard_components(docs, **how).collect()
    assert len(got) == len(copies) + 2 and [r.n_links for r in got if r.doc_id is None] == [None]
    expected = links_by_force(copies, how.get("percent", 85), how.get("words", 4))
    assert {r.doc_id: r.n_links for r in got if r.doc_id is not None} == expected and sum(expected.values()) > 500


@pytest.mark.parametrize("seed", range(4))
def test_counts_by_difference_from_the_leader(seed):
    """Links of a group's sets, the leader at any place, equal those counted from the whole sets."""
    rng = np.random.default_rng(seed)
    base = rng.choice(10**9, 120, replace=False)
    sets = [np.unique(np.append(rng.permutation(base)[: 120 - rng.integers(0, 25)], rng.choice(10**9, rng.integers(0, 25)))) for _ in range(320)]
    lead = int(rng.integers(len(sets)))
    leader = sets[lead]
    sets = [s for s in sets if s is leader or 100 * len(np.intersect1d(s, leader)) >= 85 * len(np.union1d(s, leader))]
    lead = next(k for k, s in enumerate(sets) if s is leader)
    weight = rng.integers(1, 4, len(sets))
    got, _ = op8_jaccard.answer_group(sets, lead, None, weight, [np.array([], np.int64)] * len(sets), 85)
    for k, s in enumerate(sets):
        others = [j for j, t in enumerate(sets) if j != k and 100 * len(np.intersect1d(s, t)) >= 85 * len(np.union1d(s, t))]
        assert got[k] == (weight[others].sum() if others else -1)
