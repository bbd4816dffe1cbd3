"""Fuzzy license spans and the quality classifier against plain versions."""

import math
import random
import time

import numpy as np
import pytest

from logloom.llm import op1_license_scan as l1
from logloom.llm import op7_quality as q7

NOTICE = "released under the mit license"


def spans_by_force(scanner, text):
    """The best match of the whole text, then those in front of it and behind it."""
    out = set()
    for which, (label, notice, _) in enumerate(scanner.notices):
        left = [(0, len(text))]
        while left:
            lo, hi = left.pop()
            for edits, start, end, _, _ in scanner.best(which, text, lo, hi):
                if end == len(text) or text[end] == " ":
                    out.add((label, start, end, edits, len(notice)))
                left += [(lo, start), (end, hi)]
    return out


def damaged(rng, notice, edits):
    chars = list(notice)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        chars[at : at + 1] = rng.choice([[], [rng.choice("abc ")], [chars[at], rng.choice("xyz ")]])
    return "".join(chars)


@pytest.mark.parametrize("seed", range(30))
def test_spans_equal_a_search_of_the_whole_text(seed):
    rng = random.Random(seed)
    scanner = l1.Scanner({"mit": [NOTICE], "gpl": l1.NOTICES["gpl"], "isc": l1.NOTICES["isc"]})
    parts = []
    for _ in range(rng.randrange(1, 25)):
        own = rng.choice([NOTICE, NOTICE, l1.NOTICES["gpl"][0], l1.NOTICES["isc"][0]])
        parts.append(damaged(rng, own, rng.randrange(6)))
        parts += rng.choices(["mit", "the", "license", "under", "words", "released", "x" * 90], k=rng.choice([0, 0, 1, 4]))
    text = " ".join(" ".join(parts).split())
    got = scanner.fuzzy(text)
    # A span that only a window's or part's end cuts short may be lost by either; whole words in between are what is searched.
    assert set(got) == spans_by_force(scanner, text) and got == sorted(got, key=lambda x: (x[1], x[2], x[0], x[3]))


def test_long_texts_take_time_in_proportion():
    rng, scanner = random.Random(1), l1.Scanner({"mit": [NOTICE]})
    took = []
    for n in (2_000, 20_000):
        text = " ".join(" ".join(damaged(rng, NOTICE, 2).split()) for _ in range(n))
        began = time.process_time()
        found = scanner.fuzzy(text)
        took.append(time.process_time() - began)
        assert len(found) > 0.6 * n
    assert took[1] < 30 * took[0]


def features_by_force(text):
    """Distinct numbers of words, shapes and neighbouring pairs of either, with whole integers."""
    grams, words, mask = q7.Grams(), (text or "").split(), (1 << 64) - 1
    codes = [(grams[w] >> 32, grams[w] & 0xFFFFFFFF) for w in words]
    mix = lambda a, b, k: (((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + k) & mask) * 0xD6E8FEB86659FD93 & mask) >> (64 - q7.BITS)
    out = {mix(w, 0, 1) for w, _ in codes} | {mix(s, 0, 2) for _, s in codes}
    for (w1, s1), (w2, s2) in zip(codes, codes[1:]):
        out |= {mix(s1, s2, 3), mix(w1, w2, 4)}
    return sorted(out)


def fitted_by_force(rows, labels, c, epochs, seed):
    """Ratios, scaled unit vectors and the descent over dicts, one coordinate at a time; margins of all rows."""
    y = [1.0 if v > 0 else -1.0 for v in labels]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    own = order[len(y) // 5 :]
    total, count = {1.0: float(q7.SIZE), -1.0: float(q7.SIZE)}, {1.0: {}, -1.0: {}}
    for i in own:
        for f in rows[i]:
            count[y[i]][f] = count[y[i]].get(f, 0) + 1
        total[y[i]] += len(rows[i])
    ratio = lambda f: math.log((1 + count[1.0].get(f, 0)) / total[1.0]) - math.log((1 + count[-1.0].get(f, 0)) / total[-1.0])
    xs = []
    for row in rows:
        v = {int(f): ratio(int(f)) for f in row}
        size = max(math.sqrt(sum(x * x for x in v.values())), 1e-9)
        xs.append({f: x / size for f, x in v.items()})
    good = max(1, sum(y[i] > 0 for i in own))
    top = {1.0: c * len(own) / (2 * good), -1.0: c * len(own) / (2 * max(1, len(own) - good))}
    w, b, alpha = {}, 0.0, [0.0] * len(y)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(own):
            margin = sum(w.get(f, 0.0) * x for f, x in xs[i].items()) + b
            new = min(max(alpha[i] - (y[i] * margin - 1) / 2, 0.0), top[y[i]])
            step, alpha[i] = new - alpha[i], new
            for f, x in xs[i].items():
                w[f] = w.get(f, 0.0) + step * y[i] * x
            b += step * y[i]
            moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return [sum(w.get(f, 0.0) * x for f, x in x.items()) + b for x in xs], (w, b, alpha, xs, y, top, own)


def test_classifier_equals_a_plain_version():
    rng = random.Random(4)
    clean, junk = [f"word{k}" for k in range(60)], [f"JUNK{k}!" for k in range(20)]
    texts, labels = [], []
    for _ in range(120):
        good = rng.random() < 0.6
        words = rng.choices(clean, k=rng.randrange(0, 40)) + rng.choices(junk, k=rng.randrange(2) if good else rng.randrange(1, 12))
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(good if rng.random() < 0.95 else not good))
    rows = [q7.Grams().features(t) for t in texts]
    assert [r.tolist() for r in rows] == [features_by_force(t) for t in texts] and q7.Grams().features(None).tolist() == []
    model = q7.fit(rows, np.array(labels))
    margins, (w, b, alpha, xs, y, top, own) = fitted_by_force(rows, labels, 1.0, 15, 1)
    scores = [q7.score(model, x) for x in rows]
    plain = [1 / (1 + math.exp(-min(max(model[2] * m + model[3], -30.0), 30.0))) for m in margins]
    assert scores == pytest.approx(plain, abs=1e-9) and model[1] == pytest.approx(b, abs=1e-9)
    # The descent ends near the optimum: the gap between the primal and the dual objective is small.
    norm = sum(v * v for v in w.values()) + b * b
    loss = sum(top[y[i]] * max(0.0, 1 - y[i] * margins[i]) for i in own)
    assert 0 <= norm / 2 + loss - (sum(alpha) - norm / 2) <= 0.05 * (norm / 2 + loss) + 0.05
