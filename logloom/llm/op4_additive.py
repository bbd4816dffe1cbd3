"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one full-dimensional codeword from each codebook. Codebooks are fitted one after another by
k-means on the residuals of a bounded sample; every vector is then encoded by beam search over all codebooks, using the
stored products between codewords, and the norm r of what is left is stored beside the code.

The first codeword of a code names its list; there are about four times the square root of as many lists as vectors. Lists are
put on shelves of about `shelf_rows` vectors by splitting their words again and again across the direction in which they differ
most, so that lists near each other share a shelf; a larger list fills several. A query goes to the shelves that weigh most for it:
a shelf weighs the sum over its lists of their size, times e to the power of three standard scores of the word's product with
the query. How many shelves those are is measured: the true nearest of `trials` of the queries are found among all vectors, in a pass that
multiplies each vector with that stated set, and the least number of shelves is taken that hold `recall` of them. Where vectors
form clusters that is a small share of the shelves; where they are random nothing can be left out, and most shelves are searched.
`probe_share` sets the share of shelves by hand; 1 is exact.

Queries go in blocks of `query_block`, so a vector is sent once for each block that wants its shelf. On a shelf, scores come from
lookup tables of query-codeword products; the best are scored exactly in double precision, and then every other vector whose
bound, lookup + |query| * r, reaches the k-th exact score, so nothing on a shelf is missed.

Every row is indexed; only the fit uses a sample, of about sixteen vectors a list and at most about `sample_rows` and
`sample_bytes`, in one task. Codebooks of at most `book_bytes` and the trials come to the driver. Vectors of each length are a matter of
their own: lengths with at most `rare_rows` vectors and `rare_numbers` numbers are each fitted and searched whole in a task, all in one
plan; others take a plan each, and more than `max_lengths` of those raise an error.

Edge cases: vectors null, empty, zero or with null or non-finite components and rows without an id take no part; repeated rows
count once; several vectors under one id are candidates each, and as queries share one list of k; fewer candidates than k give fewer
rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .vectors import usable


def fit_codebooks(x: np.ndarray, words: list[int], rounds: int = 8, seed: int = 5) -> list[np.ndarray]:
    """A (words, dim) codebook for each number of words, by k-means on residuals."""
    rng = np.random.default_rng(seed)
    rest, out = x.astype(np.float32).copy(), []

    def nearest(c):
        half = 0.5 * (c * c).sum(1)
        return np.concatenate([(rest[lo : lo + 4096] @ c.T - half).argmax(1) for lo in range(0, len(rest), 4096)])

    for n in words:
        c = rest[rng.choice(len(rest), n, replace=len(rest) < n)].copy()
        for _ in range(rounds):
            own = nearest(c)
            total = np.zeros_like(c)
            np.add.at(total, own, rest)
            size = np.bincount(own, minlength=n)
            c[size > 0] = total[size > 0] / size[size > 0, None]
        rest -= c[nearest(c)]
        out.append(c)
    return out


def encode(x: np.ndarray, books: list[np.ndarray], beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Codes (uint16) and residual norms by beam search."""
    x = x.astype(np.float32)
    codes, gain = np.zeros((len(x), 1, 0), np.int64), np.zeros((len(x), 1), np.float32)  # gain: <x, sum> - |sum|^2 / 2
    for j, book in enumerate(books):
        new = gain[:, :, None] + (x @ book.T - 0.5 * (book * book).sum(1))[:, None, :]
        for i in range(j):
            new -= (books[i] @ book.T)[codes[:, :, i]]
        flat = new.reshape(len(x), -1)
        width = min(beam, flat.shape[1])
        best = np.argpartition(-flat, width - 1, 1)[:, :width]
        gain = np.take_along_axis(flat, best, 1)
        from_beam, word = best // len(book), best % len(book)
        codes = np.concatenate([np.take_along_axis(codes, from_beam[:, :, None], 1), word[:, :, None]], 2)
    top = codes[np.arange(len(x)), gain.argmax(1)]
    sums = sum(book[top[:, j]] for j, book in enumerate(books))
    return top.astype("<u2"), np.linalg.norm(x.astype(np.float64) - sums, axis=1)


def search_shelf(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, codes: np.ndarray, residual: np.ndarray, books: list[np.ndarray], k: int) -> pd.DataFrame:
    """The k nearest on a shelf for each query of a block: lookups first, then exact scores wherever the stored norm leaves room."""
    v, q, out = v.astype(np.float64), q.astype(np.float64), []
    columns = [np.ascontiguousarray(codes[:, j]) for j in range(codes.shape[1])]
    first = min(len(vid), 4 * k + 1)
    for lo in range(0, len(qid), 64):
        some = q[lo : lo + 64]
        looked = sum((some.astype(np.float32) @ book.T)[:, column] for book, column in zip(books, columns))
        size = np.linalg.norm(some, axis=1)
        # Lookups are sums of single precision; the margin covers their rounding.
        bound = looked + size[:, None] * (residual[None, :] + 1e-5 * (1 + np.abs(looked) / np.maximum(size[:, None], 1e-30)))
        start = np.argpartition(-looked, first - 1, 1)[:, :first]
        for r, own in enumerate(some):
            near = start[r]
            near = near[vid[near] != qid[lo + r]]
            least = np.sort(v[near] @ own)[-k] if len(near) >= k else -np.inf
            near = np.flatnonzero((bound[r] >= least - 1e-9 * size[r]) & (vid != qid[lo + r]))
            rough = v[near] @ own
            if len(near) > k:
                near = near[rough >= np.partition(rough, len(near) - k)[len(near) - k] - 1e-9 * (1 + np.abs(rough).max())]
            exact = np.einsum("ij,j->i", v[near], own)  # row by row, so that equal vectors tie
            best = np.lexsort((vid[near], -exact))[:k]
            out.append((np.full(len(best), qid[lo + r]), vid[near][best], exact[best]))
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))


SCHEMA = "query_id bigint, vec_id bigint, score double"


@dataclass(frozen=True)
class Plan:
    """Settings of a search; the module's text explains them."""

    k: int = 20
    books: int = 8
    recall: float = 0.97
    probe_share: float | None = None
    trials: int = 128
    shelf_rows: int = 16_384
    query_block: int = 8192
    sample_rows: int = 65_536
    sample_bytes: int = 128 << 20
    book_bytes: int = 64 << 20
    rare_rows: int = 2048
    rare_numbers: int = 1 << 24
    max_lengths: int = 64


def list_count(n: int) -> int:
    return int(min(4096, max(16, 2 ** round(math.log2(4 * math.sqrt(n))))))


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def fitted(good: DataFrame, n: int, dim: int, plan: Plan) -> list[np.ndarray]:
    """Codebooks, fitted in one task on a bounded sample that hashes of whole rows choose."""
    most = plan.book_bytes // (8 * dim)
    lists, words = min(list_count(n), most), min(256, most // plan.books)
    if words < 2:
        raise ValueError(f"codebooks of {plan.books} times two words of {dim} numbers take more than {plan.book_bytes} bytes")
    share = min(plan.sample_rows, max(16 * lists, 8192), plan.sample_bytes // (4 * dim)) / n
    own = F.xxhash64("vec_id", "embedding")
    sample = good if share >= 1 else good.where(own < F.lit(int(-(2**63) + share * 2**64)))

    def fit(frames):
        f = pd.concat(list(frames)).sort_values("h")
        if len(f):
            for j, book in enumerate(fit_codebooks(stacked(f.embedding), [lists, *[words] * (plan.books - 1)])):
                yield pd.DataFrame({"book": [j], "words": [len(book)], "numbers": [book.astype("<f4").tobytes()]})

    rows = sample.select(own.alias("h"), "embedding").repartition(1).mapInPandas(fit, "book int, words int, numbers binary").collect()
    if not rows:
        raise ValueError(f"a sample of {share * n:.1f} rows came out empty; raise sample_rows or sample_bytes")
    return [np.frombuffer(r.numbers, "<f4").reshape(r.words, dim) for r in sorted(rows)]


def shelves(words: np.ndarray, size: np.ndarray, shelf_rows: int) -> list[np.ndarray]:
    """Lists of each shelf: halves by size across the direction in which words differ most, until a shelf is small or one list."""
    todo, out = [np.arange(len(words))], []
    while todo:
        own = todo.pop()
        if len(own) == 1 or size[own].sum() <= shelf_rows:
            out.append(own)
            continue
        x = words[own].astype(np.float64)
        x -= x.mean(0)
        along = x[np.argmax((x * x).sum(1))]
        for _ in range(30):
            step = x.T @ (x @ along)
            length = np.linalg.norm(step)
            if not 0 < length < np.inf:
                break
            along = step / length
        own = own[np.argsort(x @ along, kind="stable")]
        filled = np.cumsum(size[own])
        cut = min(max(1, int(np.searchsorted(filled, filled[-1] / 2))), len(own) - 1)
        todo += [own[cut:], own[:cut]]
    return out


def by_weight(q: np.ndarray, words: np.ndarray, size: np.ndarray, laid: list[np.ndarray]) -> np.ndarray:
    """Shelves of each query, those that weigh most for it first."""
    score = q.astype(np.float64) @ words.T.astype(np.float64)
    score -= score.max(1, keepdims=True)
    weight = np.exp(3 * score / np.maximum(score.std(1, keepdims=True), 1e-30)) * size
    total = np.add.reduceat(weight[:, np.concatenate(laid)], np.cumsum([0] + [len(own) for own in laid[:-1]]), 1)
    return np.argsort(-total, 1, kind="stable")


def lists_of_nearest(index: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(query, list) of the k nearest of each query among all rows of the index; the number of queries is bounded."""

    def top(frames):
        best, where = np.empty((len(q), 0)), np.empty((len(q), 0), np.int64)
        for f in frames:
            for lo in range(0, len(f), 4096):
                part = f.iloc[lo : lo + 4096]
                score = q @ stacked(part.embedding).T.astype(np.float64)
                score[ids[:, None] == part.vec_id.to_numpy()] = -np.inf
                best = np.concatenate([best, score], 1)
                where = np.concatenate([where, np.broadcast_to(part.list.to_numpy(), score.shape)], 1)
                if best.shape[1] > k:
                    kept = np.argpartition(-best, k - 1, 1)[:, :k]
                    best, where = np.take_along_axis(best, kept, 1), np.take_along_axis(where, kept, 1)
        out = pd.DataFrame({"query": np.repeat(np.arange(len(q)), best.shape[1]), "list": where.ravel(), "score": best.ravel()})
        yield out[out.score > -np.inf]

    found = index.select("vec_id", "embedding", "list").mapInPandas(top, "query bigint, list bigint, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "list")
    return [tuple(r) for r in found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "list").collect()]


def probes(index: DataFrame, is_query: Column, words: np.ndarray, size: np.ndarray, laid: list[np.ndarray], plan: Plan) -> int:
    """How many shelves each query is sent to."""
    if plan.probe_share is not None:
        return max(1, math.ceil(plan.probe_share * len(laid)))
    if len(laid) == 1:
        return 1
    asked = index.where(is_query).select("vec_id", "embedding", F.xxhash64("vec_id", "embedding", F.lit(2)).alias("h")).orderBy("h").limit(plan.trials).toPandas()
    if not len(asked):
        return 1
    q = stacked(asked.embedding).astype(np.float64)
    near = lists_of_nearest(index, asked.vec_id.to_numpy(), q, plan.k)
    if not near:
        return 1
    of = np.empty(len(words), np.int64)
    for s, own in enumerate(laid):
        of[own] = s
    order = by_weight(q, words, size, laid)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(laid)), order.shape), 1)
    query, own = np.array(near).T
    held = np.cumsum(np.bincount(place[query, of[own]], minlength=len(laid))) / len(near)
    return int(np.searchsorted(held, plan.recall - 1e-12)) + 1


def no_rows() -> pd.DataFrame:
    return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def found_of_length(good: DataFrame, n: int, dim: int, is_query: Column, plan: Plan) -> DataFrame:
    """Candidates of vectors of one length, at most k of each part of a shelf for each query."""
    shared = good.sparkSession.sparkContext.broadcast(fitted(good, n, dim, plan))

    def coded(frames):
        for f in frames:
            for lo in range(0, len(f), 500):
                part = f.iloc[lo : lo + 500]
                codes, left = encode(stacked(part.embedding), shared.value)
                yield part.assign(codes=[c.tobytes() for c in codes], residual=left, list=codes[:, 0].astype(np.int32))

    kind = good.schema["embedding"].dataType.simpleString()
    index = written(good.mapInPandas(coded, f"vec_id bigint, embedding {kind}, codes binary, residual double, list int"))
    words = shared.value[0]
    size = np.zeros(len(words), np.int64)
    for r in index.groupBy("list").count().collect():
        size[r.list] = r["count"]
    laid = shelves(words, size, plan.shelf_rows)
    some = probes(index, is_query, words, size, laid, plan)
    places = [(int(i), s, max(1, -(-int(size[own].sum()) // plan.shelf_rows))) for s, own in enumerate(laid) for i in own]
    table_ = F.broadcast(index.sparkSession.createDataFrame(places, "list int, shelf int, subs int"))
    own = F.xxhash64("vec_id", "embedding", F.lit(1))
    placed = index.join(table_, "list").withColumn("sub", F.pmod(own, F.col("subs")).cast("int"))

    def wanted(frames):
        for f in frames:
            for lo in range(0, len(f), 1000):
                part = f.iloc[lo : lo + 1000]
                yield part.assign(shelf=by_weight(stacked(part.embedding), shared.value[0], size, laid)[:, :some].tolist())

    asked = index.where(is_query).select("vec_id", "embedding").mapInPandas(wanted, f"vec_id bigint, embedding {kind}, shelf array<int>").withColumn("shelf", F.explode("shelf"))
    asked = written(asked)
    blocks = asked.groupBy("shelf").agg(F.ceil(F.count("*") / plan.query_block).cast("int").alias("blocks"))
    asked = asked.join(blocks, "shelf").join(table_.groupBy("shelf").agg(F.max("subs").alias("subs")), "shelf")
    asked = asked.select("shelf", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.pmod(own, F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("query"), "vec_id", "embedding", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("residual"))
    stored = placed.join(blocks, "shelf").select("shelf", "sub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("query"), "vec_id", "embedding", "codes", "residual")

    def search(f: pd.DataFrame) -> pd.DataFrame:
        q, v = f[f["query"]], f[~f["query"]]
        if not len(q) or not len(v):
            return no_rows()
        codes = np.frombuffer(b"".join(v.codes), "<u2").reshape(len(v), -1)
        return search_shelf(q.vec_id.to_numpy(), stacked(q.embedding), v.vec_id.to_numpy(), stacked(v.embedding), codes, v.residual.to_numpy(), shared.value, plan.k)

    return stored.unionByName(asked).groupBy("shelf", "sub", "block").applyInPandas(search, SCHEMA)


def found_of_rare(good: DataFrame, is_query: Column, plan: Plan) -> DataFrame:
    """The same for all lengths with few vectors: each is fitted, encoded and searched whole in one task."""

    def search(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("vec_id", kind="stable")
        v, asked = stacked(f.embedding), f["query"].to_numpy()
        if not asked.any():
            return no_rows()
        books = fit_codebooks(v, [min(64, len(v))] * plan.books)
        codes, residual = map(np.concatenate, zip(*(encode(v[lo : lo + 500], books) for lo in range(0, len(v), 500))))
        ids = f.vec_id.to_numpy()
        return search_shelf(ids[asked], v[asked], ids, v, codes, residual, books, plan.k)

    own = good.select(F.size("embedding").alias("dim"), "vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("query"))
    return own.groupBy("dim").applyInPandas(search, SCHEMA)


def nearest(rows: DataFrame, is_query: Column, **settings) -> DataFrame:
    """query_id, rank, vec_id and score: the k found candidates with the largest inner product; is_query is a predicate on vec_id, settings are those of Plan."""
    plan, good = Plan(**settings), usable(rows)
    dim = F.size("embedding")
    often = good.groupBy(dim.alias("dim")).count().where((F.col("count") > plan.rare_rows) | (F.col("count") * F.col("dim") > plan.rare_numbers))
    often = {r.dim: r["count"] for r in often.limit(plan.max_lengths + 1).collect()}
    if len(often) > plan.max_lengths:
        raise ValueError(f"more than {plan.max_lengths} lengths of vectors have over {plan.rare_rows} vectors or {plan.rare_numbers} numbers")
    found = found_of_rare(good.where(~dim.isin(list(often))) if often else good, is_query, plan)
    for n, count in sorted(often.items()):
        found = found.unionByName(found_of_length(good.where(dim == n), count, n, is_query, plan))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= plan.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
