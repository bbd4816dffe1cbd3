"""Each operator against a brute-force version on small rows that hold nulls, empty, repeated, tied and clashing cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from logloom.llm import op1_license_scan, op2_chat_format, op3_suffix_dedup, op4_additive, op5_sentencepiece, op6_shard, op7_quality, op8_jaccard, op9_pack, op10_lattice

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",", "s", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    passage = prose(rng, 40)
    out = [prose(rng, rng.randint(1, 150)) for _ in range(60)]
    out += [prose(rng, 30) + " " + passage + " " + prose(rng, 30) for _ in range(12)]
    base = prose(rng, 200).split()
    for k in range(10):
        own = list(base)
        own[20 * k] = "changed"
        out.append(" ".join(own))
    out += [out[3], out[3], out[70], "", "   ", None, "a", "aaa" * 200, "é" * 120, "one two three", "tab\there  and\n\nlines ▁ mark <s>", "Licensed under the Apach License, Version 2.0", "cc by cc by; All Rights Reserved", prose(rng, 6000)]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Extra columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in texts], "doc_id bigint, text string, score string, n int, g int").repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def words1(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_license(docs, texts, empty):
    got = {r.doc_id: r for r in op1_license_scan.license_scan(docs).collect()}
    assert len(got) == len(texts) and op1_license_scan.license_scan(empty).count() == 0
    for i, t in texts:
        w, hits = words1(t), []
        for phrase, label in op1_license_scan.BASE.items():
            p = phrase.split()
            hits += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    near = next(r for r in got.values() if "apache" in r.labels)
    assert near.spans[0].edits == 1 and near.spans[0].first_word == 0


def test_license_seeds_lose_nothing():
    rng, scanner = random.Random(1), op1_license_scan.Scanner({"mit": ["released under the mit license"]})
    for _ in range(200):
        chars = list("released under the mit license")
        for _ in range(2):
            chars[rng.randrange(len(chars))] = rng.choice("abcdefghij ")
        flat = " ".join(f"xx {''.join(chars)} yy".split())
        expected = op1_license_scan.regex.search("(?<![^ ])(?:released under the mit license){e<=2}(?![^ ])", flat) is not None
        assert bool(scanner.fuzzy(flat)) == expected


def conversations_by_force(rows):
    by = {}
    for c, t, r, x in set(rows):
        by.setdefault(c, []).append((t, r, x))
    seq = {c: [(r, x) for _, r, x in sorted(v, key=lambda k: (k[0] is not None, k[0] or 0, k[1] or "", k[2] or ""))] for c, v in by.items()}
    return {c for c, s in seq.items() if not any(o != c and t[: len(s)] == s and (len(t) > len(s) or o < c) for o, t in seq.items())}


def test_chat(spark):
    rng, rows = random.Random(3), []
    for c in range(30):
        turns = [("user" if k % 2 == 0 else "assistant", rng.choice(["hi", "yes", "", None, "no"])) for k in range(6)]
        for cut in range(1, 7):
            if rng.random() < 0.5:
                rows += [(100 * c + cut, k, r, x) for k, (r, x) in enumerate(turns[:cut])]
        rows += [(100 * c + 50, k, r, x) for k, (r, x) in enumerate(turns)]
    rows += rows[:5]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, pos int")
    for block in (2, 512):
        got = op2_chat_format.collapse(df, block)
        assert {r.conv_id for r in got.collect()} == conversations_by_force(rows)
    out = op2_chat_format.render(op2_chat_format.collapse(df))
    by = {}
    for c, t, r, x in set(rows):
        by.setdefault(c, []).append((t, r, x))
    expected = {c: "".join(f"<|{r or ''}|>\n{x or ''}<|end|>\n" for _, r, x in sorted(by[c], key=lambda k: (k[0], k[1] or "", k[2] or ""))) for c in conversations_by_force(rows)}
    assert {r.conv_id: r.text for r in out.collect()} == expected
    assert op2_chat_format.render(op2_chat_format.collapse(df.limit(0))).count() == 0


def removed_by_force(texts):
    first, out = {}, {}
    for i, t in sorted(texts, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("how", [{}, {"block_bytes": 4000}, {"block_bytes": 4000, "hot_count": 2}])
def test_suffix_dedup(docs, texts, how):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op3_suffix_dedup.suffix_dedup(docs, **how).collect()}
    assert got == removed_by_force(texts)


def test_suffix_dedup_empty(empty):
    assert op3_suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(0)
    text = np.r_[np.tile(rng.integers(97, 100, 300), 4), rng.integers(97, 99, 500), np.zeros(150, int)].astype(np.uint8)
    places = np.arange(len(text) - 150)
    order, group = op3_suffix_dedup.suffix_classes(text, places)
    raw = text.tobytes()
    heads = [raw[p : p + 50] for p in places[order]]
    assert heads == sorted(heads)
    assert all((heads[k] == heads[k - 1]) == (group[k] == group[k - 1]) for k in range(1, len(heads)))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[100:160] = x[0] + 0.05 * rng.standard_normal((60, 16))
    x[200:230] = x[1]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(9000, None, 1), (9001, [0.0] * 16, 1), (9002, [float("nan")] * 16, 1), (9003, [1.0], 1), (9004, [None] + [1.0] * 15, 1), rows[3]]
    return x, spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, cell int")


def test_nearest(vectors):
    x, df = vectors
    got = op4_additive.nearest(df, F.col("vec_id") % 20 == 0, shelf_rows=300, query_block=20).collect()
    x = x.astype(np.float64)
    hits = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        s[q] = -np.inf
        true = np.lexsort((np.arange(900), -s))[:20].tolist()
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += len({r.vec_id for r in mine} & set(true))
    assert {r.query_id for r in got} == set(range(0, 900, 20)) and hits / (45 * 20) >= 0.9
    assert op4_additive.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("block", [3000, 20])
def test_lattice(vectors, block):
    x, df = vectors
    got = {r.vec_id: r for r in op10_lattice.near_duplicates(df, block=block).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    assert [got[i].n_links for i in range(900)] == near.sum(1).tolist()
    assert all(got[i].component_id == 0 and not got[i].kept for i in range(100, 160)) and all(got[i].component_id == 1 for i in range(200, 230))
    assert all(got[i].n_links == 0 and got[i].kept for i in range(9000, 9005))
    assert op10_lattice.near_duplicates(df.limit(0)).count() == 0


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 8)) * 2
    near, other = op10_lattice.decode_e8(x)
    d = lambda p: ((x - p / 2) ** 2).sum(1)
    assert (d(near) <= d(other) + 1e-12).all() and (d(near) <= 1 + 1e-9).all() and ((near.sum(1) / 2) % 2 == 0).all()


def test_sentencepiece(docs, texts, empty):
    path = P.path("piece_bpe_32k.model")
    sp = op5_sentencepiece.sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in op5_sentencepiece.sentencepiece_codec(docs, path, table_words=50).collect()}
    for i, t in texts:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids and got[i].decoded == sp.decode(ids)
    assert op5_sentencepiece.sentencepiece_codec(empty, path).count() == 0


def test_shard(docs, texts, empty):
    rows = op6_shard.shard(docs.unionByName(docs.where("doc_id < 5")), 7, rows_per_bucket=10).collect()
    n = len(texts) + 5
    assert len(rows) == n and sorted(r.row for r in rows) == list(range(n))
    for s in range(7):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (n // 7, n // 7 + 1)
    by = dict(texts)
    assert all(r["size"] == len((by[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((by[r.doc_id] or "").encode()) for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op6_shard.shard(docs.unionByName(docs.where("doc_id < 5")).repartition(3), 7, rows_per_bucket=10).collect()))
    assert op6_shard.shard(empty, 7).count() == 0


def test_quality(spark, empty):
    rng = random.Random(2)
    good = [(i, prose(rng, 60)) for i in range(200)]
    bad = [(i, " ".join(w.upper() + "!!" for w in prose(rng, 60).split())) for i in range(200, 300)]
    docs = spark.createDataFrame([*good, *bad, (900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(0, 300)] + [(5, None), (77777, 1)], "doc_id bigint, quality int").where("doc_id % 3 <> 0")
    model = op7_quality.train(docs, labels)
    got = {r.doc_id: r.score for r in op7_quality.quality_scored(docs, model).collect()}
    held = [i for i in range(0, 300, 3)]
    assert np.mean([(got[i] >= 0.3) == (i < 200) for i in held]) >= 0.95 and all(0 <= s <= 1 for s in got.values()) and 900 in got
    none = op7_quality.train(docs, labels.limit(0))
    assert {round(r.score, 6) for r in op7_quality.quality_scored(docs, none).collect()} == {0.5} and op7_quality.quality_scored(empty, model).count() == 0


def classes_by_force(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [1500, 3])
def test_jaccard(docs, texts, block):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op8_jaccard.jaccard_components(docs, block=block).collect()}
    assert got == classes_by_force(texts)


def test_jaccard_empty(empty):
    assert op8_jaccard.jaccard_components(empty).count() == 0


def test_pack(docs, texts, empty):
    paths = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
    coder = op9_pack.TextIds(*paths, 1, table_words=50)
    ids = {i: coder.t.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts}
    rows = op9_pack.pack(docs, *paths, block_tokens=3000).collect()
    own, seqs = {i: [] for i in ids}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        piece = np.frombuffer(r["ids"], "<u4").tolist()
        assert r.start == len(own[r.doc_id]) and r.doc_tokens == len(ids[r.doc_id]) and piece
        own[r.doc_id] += piece
        seqs.setdefault(r.sequence_id, []).append((r.offset, len(piece)))
    assert own == ids
    for pieces in seqs.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert op9_pack.pack(empty, *paths).count() == 0


def test_cuts_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(30):
        ends = np.cumsum(rng.integers(1, 30, 6))
        stops = np.unique(rng.integers(1, ends[-1], 8))
        chosen = op9_pack.cuts(ends, stops, 32)
        cost = lambda c: op9_pack.SEQUENCE_PRICE * (len(c) - 1) + sum(0 if (n := b - a) & (n - 1) == 0 else 32 - n for a, b in zip(c, c[1:])) + sum(op9_pack.SENTENCE_PENALTY for x in c[1:-1] if x not in set(ends.tolist()))
        places = sorted({0, *ends.tolist(), *stops.tolist()})
        best = {0: 0}
        for p in places[1:]:
            own = 0 if p in set(ends.tolist()) else op9_pack.SENTENCE_PENALTY
            options = [best[q] + op9_pack.SEQUENCE_PRICE + (0 if (n := p - q) & (n - 1) == 0 else 32 - n) for q in places if q < p and p - q <= 32 and q in best]
            if options:
                best[p] = min(options) + own
        assert all(b - a <= 32 for a, b in zip(chosen, chosen[1:]))
        if ends[-1] in best:
            assert cost(chosen) <= best[ends[-1]]


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = kept.columns
    before = {r.doc_id: r.text for r in kept.collect()}
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == columns
    rows = kept.collect()
    classes = classes_by_force(before.items())
    assert {r.doc_id for r in rows} == {i for i, (_, c) in classes.items() if c == i}
    expected = removed_by_force([(i, t) for i, t in before.items() if classes[i][1] == i])
    assert all(abs(len((r.text or "").encode()) - (expected[r.doc_id][0] - expected[r.doc_id][1])) < 8 for r in rows)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
