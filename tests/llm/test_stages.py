"""Stages of the corpus pipeline by themselves."""

import hashlib
import random
import re

import pytest

import corpus_pipeline

WORDS = [f"w{k}" for k in range(4000)]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], COLUMNS).repartition(3)


def kept_by_force(texts, words=5, percent=80):
    """Ids that are the least of their component; texts: (id, text)."""
    sets, root = {}, {i: i for i, _ in texts}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in sets if find(i) == i}


@pytest.fixture(scope="module")
def near_texts():
    """Copies on either side of 0.8: with up to 30 % of words behind them, and with scattered edits."""
    rng, out = random.Random(11), []
    for k in range(12):
        base = rng.choices(WORDS, k=100)
        out += [base, base + rng.choices(WORDS, k=2 * k + 6)]
        edited = list(base)
        for at in range(0, 100, 100 // (k % 4 + 1)):
            edited[at] = "changed"
        out.append(edited)
    return list(enumerate(" ".join(w) for w in out))


def test_near_duplicates_take_five_words(spark, near_texts):
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, near_texts), "").collect()}
    assert got == kept_by_force(near_texts) != kept_by_force(near_texts, 4, 85)


def test_rows_without_id_pass_all_stages(spark, near_texts):
    """A third of the rows has no id: they lose copies like any others and no clean one goes."""
    rng = random.Random(12)
    alone = [" ".join(rng.choices(WORDS, k=60)) for _ in range(10)]
    passage = " ".join(rng.choices(WORDS, k=30))
    nulls = [*alone, alone[0], near_texts[0][1], None, f"{alone[1][:60]} {passage} {' '.join(rng.choices(WORDS, k=40))}"]
    rows = [*near_texts, (9000, f"{passage} {' '.join(rng.choices(WORDS, k=40))}"), *((None, t) for t in nulls)]
    docs = frame(spark, rows)
    near = corpus_pipeline.near_duplicates(spark, docs, "")
    got = near.collect()
    assert near.columns == docs.columns
    numbered = [(i if i is not None else 10_000 + k, t) for k, (i, t) in enumerate(rows)]
    by, least = dict(numbered), kept_by_force(numbered)
    assert {r.doc_id for r in got if r.doc_id is not None} == {i for i in least if i <= 9000}
    assert sorted((r.text or "") for r in got if r.doc_id is None) == sorted(by[i] or "" for i in least if i > 9000)
    rest = corpus_pipeline.repeated_passages(spark, near, "").collect()
    assert len(rest) == len(got) and {r.text for r in rest if r.doc_id is None} >= set(alone[2:])
    assert sum(passage in (r.text or "") for r in rest) == 1 and any(r.doc_id == 9000 and passage in r.text for r in rest)


def test_rows_that_share_an_id(spark, near_texts):
    """Each stage returns at most the rows it gets; of rows with one id, distinct texts stay, and in the same way for any order of rows."""
    rng = random.Random(13)
    one, two, three = (" ".join(rng.choices(WORDS, k=60)) for _ in range(3))
    rows = [(1, one), (1, two), (1, two), (2, three), (2, f"{three} more"), (3, one), (4, " ".join(rng.choices(WORDS, k=60)))]
    for shuffled in (rows, rows[::-1]):
        docs = frame(spark, shuffled)
        near = corpus_pipeline.near_duplicates(spark, docs, "").collect()
        # Ids of single rows come first, so 3 stays and its copy under id 1 goes; two stays once; one of three's two texts stays.
        assert sorted((r.doc_id, r.text) for r in near if r.doc_id != 2) == sorted([(1, two), (3, one), rows[-1]])
        assert [r.text for r in near if r.doc_id == 2] == [min((three, f"{three} more"), key=lambda t: hashlib.sha256(t.encode()).hexdigest())]
        rest = corpus_pipeline.repeated_passages(spark, docs, "").collect()
        assert len(rest) == len(rows) and sorted(r.text for r in rest if r.doc_id == 1) == sorted(["", "", two])
        assert {r.text for r in rest if r.doc_id in (3, 4)} == {one, rows[-1][1]}


def test_cuts_fall_between_characters(spark):
    """Replacement characters of a document stay; of a character that a cut splits nothing is left, also at both ends of a cut."""
    filler = "plain words that are long enough to make up a passage of fifty bytes"
    rows = [(1, f"ä{filler}ö"), (2, f"keep � this ã{filler}õ and � that"), (3, f"�{filler}"), (4, "��")]
    got = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, frame(spark, rows), "").collect()}
    assert got[1].text == rows[0][1] and got[4].text == rows[3][1] and got[3].text == "�"
    # ö is c3 b6 and õ is c3 b5: the shared c3 goes, and the rest of õ with it.
    assert got[2].text == "keep � this ã and � that" and got[2].n_chars == len(got[2].text)
