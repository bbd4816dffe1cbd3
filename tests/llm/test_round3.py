"""Whitening, decontamination and the filter audit against brute force, with nulls, ties, long texts and clashing columns."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import op11_whiten as w11
from logloom.llm import op12_decontaminate as d12
from logloom.llm import queries as registered
from logloom.llm.op13_audit import filter_audit

VECTORS = "vec_id bigint, embedding array<float>, label int, n int, dim string"


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 5, "x") for i, v in rows], VECTORS).repartition(3)


def whitened_by_force(rows):
    """n, x, S, exact deviations, V and its eigenvalues of vectors of one length, in exact fractions."""
    xs = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in rows]
    n, dims = len(xs), len(xs[0])
    total = [sum(x[k] for x in xs) for k in range(dims)]
    ys = [[n * x[k] - total[k] for k in range(dims)] for x in xs]
    v = np.array([[float(Fraction(sum(y[a] * y[b] for y in ys), n**3)) for b in range(dims)] for a in range(dims)])
    return n, xs, total, [sum(c * c for c in y) for y in ys], v


@pytest.mark.parametrize("scale", [1.0, 3e4])  # the larger one takes several limbs
def test_whitening(spark, scale):
    rng = np.random.default_rng(5)
    good = (rng.normal(size=(300, 12)) * np.linspace(0.1, 2, 12) * scale).astype(np.float32).tolist()
    bad = [None, [], [None] * 12, [math.nan] * 12, [math.inf] + [0.0] * 11, [1e30] * 12]
    rows = [*enumerate(good), (7, good[7]), (None, good[8]), *((1000 + k, b) for k, b in enumerate(bad))]
    got = w11.whitened(vectors_frame(spark, rows)).collect()
    kept = [*good, good[7], good[8]]
    n, _, _, deviation, v = whitened_by_force(kept)
    values = np.linalg.eigvalsh(v)[::-1]
    assert len(got) == n == 302 and {r.n for r in got} == {n} and sum(r.vec_id is None for r in got) == 1
    assert Counter((r.vec_id, r.deviation) for r in got) == Counter((i, str(d)) for i, d in zip([*range(300), 7, None], deviation))
    assert np.allclose(got[0].explained, values[:8] / np.trace(v), rtol=1e-9)
    white = np.array([r.whitened for r in got])
    assert white.shape == (302, 8) and np.abs(white.T @ white / n - np.eye(8)).max() < 1e-9 and np.abs(white.mean(0)).max() < 1e-9
    assert {r.identity_error for r in got} == {got[0].identity_error} and 0 <= got[0].identity_error < 1e-9
    one = next(r for r in got if r.vec_id == 0)
    _, xs, total, _, _ = whitened_by_force(kept)
    centred = np.array([float(Fraction(n * x - s, n)) for x, s in zip(xs[0], total)])
    vectors = np.linalg.eigh(v)[1][:, ::-1][:, :8]
    assert np.allclose(np.abs(one.whitened), np.abs(centred @ vectors / np.sqrt(values[:8])), rtol=1e-7, atol=1e-9)


def test_whitening_without_variance_and_mixed_lengths(spark):
    """One vector, dependent dimensions, two lengths and no rows."""
    alone = w11.whitened(vectors_frame(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r.vec_id, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 1, "0", [None, None], [None, None], None)]
    rng = np.random.default_rng(6)
    flat = [[float(np.float32(a)), 2.0, float(np.float32(a))] for a in rng.normal(size=50)]
    two = rng.normal(size=(40, 2)).astype(np.float32).tolist()
    got = w11.whitened(vectors_frame(spark, [*enumerate(flat), *((100 + k, v) for k, v in enumerate(two))])).collect()
    by = {r.vec_id: r for r in got}
    assert all(by[k].n == 50 and by[k].whitened[1:] == [None, None] and by[k].explained == [1.0, 0.0, 0.0] for k in range(50))
    assert all(by[100 + k].n == 40 and len(by[100 + k].whitened) == 2 for k in range(40)) and got[0].identity_error < 1e-9
    assert w11.whitened(vectors_frame(spark, [])).count() == 0


def test_limbs_and_big_integers():
    rng = np.random.default_rng(7)
    d = np.concatenate([rng.integers(-(2**61), 2**61, 200), [0, -1, 2**19, -(2**19), 2**19 - 1]])
    parts = w11.limbs(d)
    assert [sum(int(p[k]) << (w11.LIMB * j) for j, p in enumerate(parts)) for k in range(len(d))] == d.tolist()
    assert all(np.abs(p).max() <= 2 ** (w11.LIMB - 1) for p in parts) and 2 ** (2 * w11.LIMB - 2) * w11.ROWS < 2**53
    wide = np.array([[3**90, -(3**90)], [0, -1]], object)
    assert w11.opened(w11.big(wide)) == [3**90, -(3**90), 0, -1]


def test_deviations_of_many_large_rows():
    """Products beyond long integers take the exact path, whatever n is."""
    rng = np.random.default_rng(8)
    for n, spread in ((10**6, 2000), (10**12 + 7, 2**24), (10**9, 2**50)):
        x = rng.integers(-spread, spread, (5, 6))
        total = [int(v) for v in rng.integers(-(2**40), 2**40, 6)]
        model = w11.Model(n, total, [1.0], [1.0] + [0.0] * 5, 1.0)
        assert model.deviations(x) == [sum((n * int(a) - s) ** 2 for a, s in zip(row, total)) for row in x]


def words_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def hits_by_force(docs, items, length):
    windows = {}
    for i, t in items:
        w = words_of(t)
        n = min(length, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, seen = words_of(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    seen |= own
        out.append((i, len(w), len(hit), ",".join(sorted(str(x) for x in seen if x is not None))))
    return Counter(out)


@pytest.fixture(scope="module")
def passages():
    """Texts over few words, so that windows overlap, repeat and nearly match."""
    rng = random.Random(9)
    words = ["a", "B", "été", "x1", "Ärger", "日本", "zz", "q"]
    text = lambda n: "".join(w + rng.choice([" ", ", ", "\n", "-", "_"]) for w in rng.choices(words, k=n))
    items = [(k, text(rng.choice([0, 1, 2, 4, 9, 10, 11, 40]) if k % 3 else 12)) for k in range(40)]
    items += [(3, text(15)), (None, text(11)), (41, None), (42, items[9][1]), (43, "rare words stand alone in this item and nowhere else here")]
    docs = [(k, text(rng.choice([0, 1, 5, 9, 10, 30, 300]))) for k in range(120)]
    docs += [(k, f"{text(5)}{items[rng.randrange(40)][1]} {text(7)}") for k in range(120, 200)]
    docs += [(5, docs[5][1]), (None, docs[130][1]), (None, None), (300, ""), (301, "rare words stand alone in this item and nowhere else here"), (302, "rare words stand alone in this item and nowhere else there")]
    docs += [(303, "long " * 30_000 + items[0][1] + " word" * 30_000), (304, "é" * 400_000)]
    return docs, items


def test_decontamination(spark, passages, monkeypatch):
    docs, items = passages
    monkeypatch.setattr(d12, "PART", 1 << 15)
    frame = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id bigint, text string, n_words int, items string").repartition(3)
    tests = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, block int")
    for length in (3, 10):
        expected = hits_by_force(docs, items, length)
        # One block, and many small ones.
        for block in (1 << 20, 300):
            got = d12.decontaminated(frame, tests, words=length, block_bytes=block).collect()
            assert Counter((r.doc_id, r.n_words, sum(s.end - s.begin for s in r.spans), ",".join(r["items"])) for r in got) == expected
            assert all(a.end < b.begin for r in got for a, b in itertools.pairwise(r.spans))
    assert d12.decontaminated(frame.limit(0), tests).count() == 0
    assert {(len(r.spans), len(r["items"])) for r in d12.decontaminated(frame, tests.limit(0)).collect()} == {(0, 0)}


def test_shift_table_skips(passages):
    """Most positions of a text that shares no words with the items are never looked at."""
    item = " ".join(f"w{k}" for k in range(30)).encode()
    block = d12.Block([("1", item, False)], 10)
    search = block.searches[0][0]
    assert search.shift.max() == 9 and (search.shift < 9).sum() <= 29 and (search.shift == 0).sum() <= 21
    text = np.frombuffer(" ".join(f"v{k}" for k in range(20_000)).encode(), np.uint8)
    doc, looked = d12.tokenised(text, np.zeros(1, np.int64)), []
    plain = search.blocks
    search.blocks = lambda h, end: looked.append(len(end)) or plain(h, end)
    assert len(search.occurrences(doc, np.zeros(len(doc.hash), np.int64))[0]) == 0 and sum(looked) < 20_000 / 8


def audit_by_force(docs, labels):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > least[t]]
        mine = [x for x in labels if x[0] == i and i is not None]
        rows.append((lang or "", {f for f, bad in zip("ABCDE", fails) if bad}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r[1:] for r in rows if r[0] == part], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                gone = [bool(r[0] & set(order[:k])) for r in own]
                lost = [r for r, g in zip(own, gone) if f in r[0] and not g]
                shapley[f] += len(lost)
                out[part, order, k + 1] = [sum(not g and f not in r[0] for r, g in zip(own, gone)), len(lost), sum(f in r[0] and g for r, g in zip(own, gone)), sum(r[0] == {f} for r in own), sum(r[1] for r in lost), sum(r[2] for r in lost)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def test_audit(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefgé", k=6))
    docs = []
    for k in range(150):
        w = [word() for _ in range(rng.choice([0, 3, 150, 260]))]
        w = w * 3 if rng.random() < 0.3 else w
        w = [x.upper() if rng.random() < 0.2 else x for x in w] if rng.random() < 0.3 else w
        docs.append((k, " ".join(w) + rng.choice(["", "", " #", " |"]), rng.choice(["en", "de", None, ""])))
    docs += [(200 + k, docs[k][1], docs[k][2]) for k in range(0, 150, 3)] + [docs[4], docs[4], (4, docs[9][1], "fr"), (None, docs[6][1], "en"), (None, None, "en"), (500, None, "en"), (501, "", "en"), (502, None, "xx")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 220, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    frame = spark.createDataFrame([(i, t, g, 1, True) for i, t, g in docs], "doc_id bigint, text string, lang string, mask int, good boolean").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit(frame, marks).collect()}
    assert got == audit_by_force(docs, labels) and len(got) == 600 * 5
    assert filter_audit(frame.limit(0), marks).count() == 0
    assert {r.good_lost + r.toxic_lost for r in filter_audit(frame, marks.limit(0)).collect()} == {0}


def test_registered_on_small_tables(spark, tmp_path, passages):
    docs, items = passages
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    rng = np.random.default_rng(1)
    vectors_frame(spark, list(enumerate(rng.normal(size=(60, 5)).tolist()))).write.parquet(f"{d}/embeddings.parquet")
    expected = hits_by_force(docs, items, 10)
    got = registered.QUERIES["op12_decontaminate"](spark, d).collect()
    count = lambda names: len(names.split(",")) if names else 0
    assert Counter(map(tuple, got)) == Counter({(i, n, hit, count(names), hashlib.sha256(names.encode()).hexdigest(), hit > 0): k for (i, n, hit, names), k in expected.items()})
    rows = registered.QUERIES["op11_whiten"](spark, d)
    assert rows.count() == 300 and rows.where(F.col("deviation").cast("string") != F.col("deviation_exact")).count() == 0
