"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios under a linear hinge-loss model.

Features of a text are indicators of hashed word shapes, words and their bigrams; a shape keeps punctuation and
folds runs of letters and digits, so it carries over to unseen words. Each indicator is scaled by the log ratio of
its smoothed class frequencies, rows are set to unit length, and the weights come from dual coordinate descent for
the hinge loss. A logistic curve fitted on a fifth of the sample kept out of the weights turns margins into scores.

The model is fitted on at most `sample_rows` labelled documents, those with the smallest hash of their id (a documented bound).
One task fits it over that sample and only its weights, of a fixed size, come to the driver; scoring reads every whole
text once without a shuffle.

Edge cases: a row without an id is scored like any other and never a sample; of rows that share an id, one is a sample; a column
named like the score is replaced; a null or empty text has the bias alone and still gets a score; repeated rows each give a row; labels that are null
or belong to no document are ignored; several labels for one id count as the smallest; an empty table gives no rows; with
no label or a single class every score is the share of label 1 (0.5 with none); other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

BITS = 18
SIZE = 1 << BITS
_SHAPE = [(re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[^\W\d_A-ZÀ-ÖØ-ÞA]+"), "a"), (re.compile(r"\d+"), "0")]


class Grams(dict):
    """Word to its (hash of the word, hash of its shape), filled on demand and bounded."""

    def __missing__(self, word: str) -> int:
        shape = word
        for p, x in _SHAPE:
            shape = p.sub(x, shape)
        code = zlib.crc32(word.encode("utf-8", "surrogatepass")) << 32 | zlib.crc32(shape.encode("utf-8", "surrogatepass"))
        if len(self) > 300_000:
            self.clear()
        self[word] = code
        return code

    def features(self, text: str | None) -> np.ndarray:
        """Sorted distinct feature numbers of a text."""
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int64)
        code = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        word, shape = code >> np.uint64(32), code & np.uint64(0xFFFFFFFF)
        mix = lambda a, b, k: (a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)
        zero = np.zeros(1, np.uint64)
        parts = [mix(word, zero, 1), mix(shape, zero, 2), mix(shape[:-1], shape[1:], 3), mix(word[:-1], word[1:], 4)]
        seen = np.zeros(SIZE, bool)
        for p in parts:
            seen[p.astype(np.int64)] = True
        return np.flatnonzero(seen)


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, epochs: int = 15, seed: int = 1) -> tuple:
    """Weights per feature (the ratios multiplied in), bias, slope and intercept of the score curve, and the ratios. Rows stay as they are; values are looked up."""
    y = np.where(labels > 0, 1.0, -1.0)
    share = float((y > 0).mean()) if len(y) else 0.5
    if len(y) < 10 or share in (0.0, 1.0):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return np.zeros(SIZE), 0.0, 0.0, math.log(share / (1 - share)), np.zeros(SIZE)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]

    counts = {s: np.full(SIZE, 1.0) for s in (1.0, -1.0)}
    for i in own:
        counts[y[i]][rows[i]] += 1
    r = np.log(counts[1.0] / counts[1.0].sum()) - np.log(counts[-1.0] / counts[-1.0].sum())
    size = np.array([max(float(np.sqrt((v := r[x]) @ v)), 1e-9) for x in rows])
    # Dual coordinate descent for the hinge loss; the rarer class weighs more.
    w, b, alpha = np.zeros(SIZE), 0.0, np.zeros(len(y))
    n1 = max(1, int((y[own] > 0).sum()))
    n0 = max(1, len(own) - n1)
    top = {1.0: c * len(own) / (2 * n1), -1.0: c * len(own) / (2 * n0)}
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(own):
            x = rows[i]
            v = r[x] / size[i]
            g = y[i] * (w[x] @ v + b) - 1
            new = min(max(alpha[i] - g / 2.0, 0.0), top[y[i]])  # each row has unit length, and the bias adds one
            if d := new - alpha[i]:
                w[x] += d * y[i] * v
                b += d * y[i]
                alpha[i] = new
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    margin = np.array([w[rows[i]] @ r[rows[i]] / size[i] + b for i in held])
    goal = y[held] > 0
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of a two-parameter logistic fit with a small ridge
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        g = np.array([((p - goal) * margin).sum() + 1e-2 * slope, (p - goal).sum()])
        q = p * (1 - p) + 1e-6
        h = np.array([[(q * margin * margin).sum() + 1e-2, (q * margin).sum()], [(q * margin).sum(), q.sum()]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - float(np.clip(step[0], -2, 2)), shift - float(np.clip(step[1], -2, 2))
    return r * w, b, max(slope, 1e-3), shift, r


def score(model: tuple, x: np.ndarray) -> float:
    w, b, slope, shift = model[:4]
    margin = b
    if len(x):
        v = model[4][x]
        margin += float(w[x].sum()) / max(float(np.sqrt(v @ v)), 1e-9)
    return 1 / (1 + math.exp(-min(max(slope * margin + shift, -30.0), 30.0)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 12_000) -> tuple:
    """Fits on a bounded sample of labelled documents; features are made where the texts are, and one task fits the model over them."""
    label = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    sample = F.broadcast(label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).join(sample, "doc_id")

    def features(batches):
        grams = Grams()
        for batch in batches:
            x = [grams.features(t).astype("<u4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], names=["doc_id", "label", "x"])

    def fitted(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("doc_id")
        w, b, slope, shift, r = fit([np.frombuffer(x.as_buffer(), "<u4") for x in t.column("x")], t.column("label").to_numpy())
        return pa.table({"w": [w.astype("<f4").tobytes()], "r": [r.astype("<f4").tobytes()], "b": [b], "slope": [slope], "shift": [shift]})

    found = rows.mapInArrow(features, "doc_id bigint, label int, x binary").groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("s")).select("doc_id", "s.*")
    got = found.groupBy().applyInArrow(fitted, "w binary, r binary, b double, slope double, shift double").first()
    if got is None:
        return fit([], np.zeros(0))
    return np.frombuffer(got.w, "<f4"), got.b, got.slope, got.shift, np.frombuffer(got.r, "<f4")


def quality_scored(docs: DataFrame, model: tuple, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All rows and columns of docs with score_col, 0 to 1, in place of a column of that name."""
    docs = docs.select([c for c in docs.columns if c.lower() != score_col.lower()])
    shared = docs.sparkSession.sparkContext.broadcast(tuple(x.astype(np.float32) if isinstance(x, np.ndarray) else x for x in model))
    at = docs.columns.index(text_col)

    def run(batches):
        grams, own = Grams(), shared.value
        for batch in batches:
            s = [score(own, grams.features(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


THRESHOLD = 0.3


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def trained(spark: SparkSession, sf_dir: str, docs: DataFrame) -> tuple:
    return train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out()))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_scored(docs, trained(spark, sf_dir, docs))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
