"""The registered queries on a small folder with null ids, repeated rows, clashing columns and empty tables, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from logloom.llm import queries as registered

from .test_links import links_by_force
from .test_llm import classes_by_force, prose, removed_by_force, words1

Q = registered.QUERIES


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(17)
    passage = prose(rng, 30)
    out = [prose(rng, rng.randint(30, 120)) for _ in range(40)] + [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(6)]
    base = prose(rng, 150).split()
    out += [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in (10, 60, 120)]
    return list(enumerate([*out, out[2], out[41], "", None, "x", "released undr the mit license and cc by", "é" * 80]))


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [*texts, texts[3], texts[3], (None, texts[5][1]), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 7) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, shard int")
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _ in texts] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs.limit(0).write.parquet(f"{d}/none/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/none/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{d}/none/benchmark.parquet")
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{d}/none/embeddings.parquet")
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{d}/none/conversations.parquet")
    return d


def rows_of(spark, folder, name):
    got = Q[name](spark, folder).collect()
    return got, {r.doc_id: r for r in got if r.doc_id is not None}


def test_empty_tables(spark, folder):
    for name, query in Q.items():
        assert query(spark, f"{folder}/none").count() == 0, name
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def test_op1(spark, folder, texts):
    got, by = rows_of(spark, folder, "op1_license_scan")
    assert len(got) == len(texts) + 4 and all(by[i].n_words == len(words1(t)) for i, t in texts)
    hit = next(r for r in got if r.n_base)
    assert (hit.base_labels, hit.labels, hit.n_base, hit.first_word, hit.last_word) == ("cc-by", "cc-by,mit", 1, 6, 6)
    assert [s.edits for s in hit.spans if s.label == "mit"] == [1]


def test_op3(spark, folder, texts):
    """Rows that repeat an id never remove anything from each other; a null id is larger than all others."""
    got, _ = rows_of(spark, folder, "op3_suffix_dedup")
    expected = removed_by_force(texts)
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id] for r in got if r.doc_id is not None)
    assert sorted((r.n_bytes, r.n_removed) for r in got if r.doc_id is None) == [(0, 0), (len(texts[5][1]), len(texts[5][1]))] and len(got) == len(texts) + 4


def test_op5(spark, folder, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got, by = rows_of(spark, folder, "op5_sentencepiece")
    for i, t in texts:
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        assert (by[i].n_tokens, by[i].ids_sha256, by[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())
    assert len(got) == len(texts) + 4


def test_op6(spark, folder, texts):
    got, by = rows_of(spark, folder, "op6_shard")
    n = len(texts) + 4
    assert len(got) == n and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    for s in range(40):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (n // 40, n // 40 + 1)
    assert all((by[i]["size"], by[i].text_crc32) == (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)


def test_op7(spark, folder, texts):
    got, by = rows_of(spark, folder, "op7_quality")
    assert len(got) == len(texts) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in texts)


def test_op8(spark, folder, texts):
    got, by = rows_of(spark, folder, "op8_jaccard")
    classes, links = classes_by_force(texts), links_by_force(texts)
    assert all((by[i].n_shingles, by[i].component_id, by[i].n_links) == (*classes[i], links[i]) for i, _ in texts)
    assert len(got) == len(texts) + 4 and {r.component_id for r in got if r.doc_id is None} == {None}


def test_op9(spark, folder, texts):
    coder = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got, _ = rows_of(spark, folder, "op9_pack")
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in texts:
        if i == 3:
            continue  # three rows share this id
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()] and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in own)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seqs.values():
        assert [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()] and sum(n for _, n in own) <= 2048


def test_pipeline_rejects_and_keeps(spark, tmp_path):
    """Two classes: rejected documents go and clean ones stay; the text after passages are removed is exact."""
    rng = random.Random(8)
    passage = prose(rng, 25)
    good = [(i, f"{prose(rng, 60)} {passage if i % 9 == 0 else ''} {prose(rng, 40)}") for i in range(200)]
    bad = [(i, " ".join("#" + w.upper() + "!!" for w in prose(rng, 80).split())) for i in range(200, 300)]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in good + bad], columns).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200)) for i in range(300) if i % 2], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & set(range(200))) >= 198 and len(ids & set(range(200, 300))) <= 2
    own = [(i, t) for i, t in good if i in ids]
    rest = corpus_pipeline.repeated_passages(spark, kept.where("doc_id < 200"), str(tmp_path)).collect()
    expected = removed_by_force(own)
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in rest} == {i: x[3] for i, x in expected.items()} and sum(x[1] for x in expected.values()) > 1000
    assert all(re.search(r"\S", r.text) and r.n_chars == len(r.text) for r in rest)
