"""Embedding whitening with exact sums: integers are split into limbs small enough for exact float64 matrix products.

Vectors become integers x = floor(1024 c) + 100000. Vectors of one length form one fit list with its own n, sums S and components.
1. n and S by length and dimension, exactly: sums of the upper and lower halves of x, added up by Spark.
2. Cross products, centred before multiplying: with m = floor(S / n) and d = x - m, the limbs of d (base 2^LIMB, in the signed
   remainder form) are multiplied as float64 matrices. A block of ROWS vectors keeps each product sum below 2^53, so BLAS is exact.
   Limb products are recombined as big integers, in tiles of TILE x TILE, and tiles of tasks are merged in two steps.
   With r = S - n m, V = (n^2 sum(d d') - n r r') / n^3 is exact, and rounded to double once.
3. One task for each length decomposes V; n, m, r and the leading vectors are broadcast, checked to be below `model_bytes`.
4. The covariance of the whitened values is measured over all rows: blocks are centred by their own mean and merged exactly by
   the formula for means and centred products, so identity_error is a measurement and not an assumption.

Edge cases: rows whose vector is null, or holds null, NaN or infinite entries, are dropped, and so are those with an entry of 2^52 or
more, whose x might not fit a long; a null id is kept as null and repeated rows count one by one; a vector without entries has no components and gives no
rows; vectors of different lengths are whitened apart; a component without variance (n = 1, constant or dependent dimensions) has
whitened null and no part in identity_error, and explained is 0 (null if no dimension varies); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

COMPONENTS = 8
#: Bits of a limb and rows of a block: 2^(2 * (LIMB - 1)) * ROWS < 2^53. A block holds fewer rows of long vectors.
LIMB, ROWS, HELD = 20, 1 << 14, 1 << 26
TILE = 128
#: Bytes of a big integer in a tile.
WIDE = 24
MERGE = 64
MODEL_BYTES = 64 << 20


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dim and embedding (doubles) of the rows that take part."""
    own = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("raw")).where("raw IS NOT NULL")
    # 2^52 is also where 1024 c + 100000 fits a bigint for certain; NaN is larger than any number.
    fine = ~F.exists("raw", lambda c: c.isNull() | ~(F.abs(c.cast("double")) < float(2**52)))
    return own.where(F.coalesce(fine, F.lit(False)) & (F.size("raw") > 0)).select("vec_id", F.size("raw").alias("dim"), F.col("raw").cast("array<double>").alias("embedding"))


def by_length(batch: pa.RecordBatch):
    """(places of the rows, matrix of integers x) for each length in a batch of (vec_id, dim, embedding)."""
    dims, vectors = batch.column(1).to_numpy(), batch.column(2)
    flat, ends = vectors.flatten().to_numpy(), np.cumsum(dims)
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        values = flat.reshape(-1, dim) if len(rows) == len(dims) else flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
        yield rows, np.floor(values * 1024).astype(np.int64) + 100_000


def blocks_of(batches, known: dict):
    """(length, matrix of at most ROWS integer vectors) over batches; at most HELD bytes, or one batch, wait for more rows of their length."""
    waiting: dict[int, list] = {}
    held = 0
    for batch in batches:
        for _, x in by_length(batch):
            dim = x.shape[1]
            if dim not in known:
                continue
            waiting.setdefault(dim, []).append(x)
            held += x.nbytes
            most = min(ROWS, HELD // 8 // dim + 1)
            if sum(map(len, waiting[dim])) >= most:
                every = np.concatenate(waiting.pop(dim))
                held -= every.nbytes
                for lo in range(0, len(every), most):
                    yield dim, every[lo : lo + most]
        if held > HELD:
            for dim, own in waiting.items():
                yield dim, np.concatenate(own)
            waiting, held = {}, 0
    for dim, own in waiting.items():
        yield dim, np.concatenate(own)


def limbs(d: np.ndarray) -> list[np.ndarray]:
    """d = sum of limbs[k] * 2^(LIMB k), each from -2^(LIMB-1) to 2^(LIMB-1) - 1, as float64."""
    out, half = [], 1 << (LIMB - 1)
    while True:
        low = ((d + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        d = (d - low) >> LIMB
        if not d.any():
            return out


def sums(good: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """n and the sums S of x by length; the driver gets one row per length and dimension, whose number is checked."""

    def add(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for rows, x in by_length(batch):
                own = total.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], np.int64)])
                own[0] += len(x)
                own[1] += (x >> 32).sum(0)
                own[2] += (x & 0xFFFFFFFF).sum(0)
        for dim, (n, high, low) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([v] * dim, pa.int64()) if k in (0, 2) else pa.array(v) for k, v in enumerate((dim, np.arange(dim), n, high, low))], names=["dim", "at", "n", "high", "low"])

    parts = good.mapInArrow(add, "dim bigint, at bigint, n bigint, high bigint, low bigint")
    own = parts.groupBy("dim", "at").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")))
    own = written(own)
    if own.count() * COMPONENTS * 8 > MODEL_BYTES:
        raise ValueError(f"lengths of vectors add up to more than {MODEL_BYTES // COMPONENTS // 8}")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in own.orderBy("dim", "at").collect():
        out.setdefault(r.dim, (int(r.n), []))[1].append((int(r.high) << 32) + int(r.low))
    return out


def big(tile: np.ndarray) -> bytes:
    return b"".join(int(v).to_bytes(WIDE, "little", signed=True) for v in tile.ravel())


def opened(data: bytes) -> list[int]:
    return [int.from_bytes(data[k : k + WIDE], "little", signed=True) for k in range(0, len(data), WIDE)]


def products(good: DataFrame, fit: dict[int, tuple[int, list[int]]]) -> DataFrame:
    """dim, i, j and tile: sum over all rows of d_i d_j, exact, for the tiles on and above the diagonal."""
    shared = good.sparkSession.sparkContext.broadcast({dim: np.array([s // n for s in total], np.int64) for dim, (n, total) in fit.items()})

    def multiply(batches):
        held: dict[tuple, list] = {}
        for dim, x in blocks_of(batches, shared.value):
            split = limbs(x - shared.value[dim])
            for a, left in enumerate(split):
                for b in range(a, len(split)):
                    # Exact in float64; as long integers, up to 2^9 blocks add up without overflow.
                    own = held.setdefault((dim, a, b), [0, np.zeros((dim, dim), np.int64), 0])
                    own[1] += (left.T @ split[b]).astype(np.int64)
                    own[2] += 1
                    if own[2] == 1 << 9:
                        own[0], own[1], own[2] = own[0] + own[1].astype(object), np.zeros((dim, dim), np.int64), 0
        for dim in sorted({k[0] for k in held}):
            for i in range(0, dim, TILE):
                for j in range(i, dim, TILE):
                    tile = 0
                    for (own, a, b), (high, low, _) in held.items():
                        if own != dim:
                            continue
                        whole = low if isinstance(high, int) else high + low
                        part = whole[i : i + TILE, j : j + TILE].astype(object)
                        if a != b:  # limb a of the row with limb b of the column, and the other way round
                            part = part + whole[j : j + TILE, i : i + TILE].T.astype(object)
                        tile = tile + (part << (LIMB * (a + b)))
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((dim, i, j, big(tile)), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["dim", "i", "j", "tile"])

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        total = None
        for data in f.tile:
            own = opened(data)
            total = own if total is None else [x + y for x, y in zip(total, own)]
        return pd.DataFrame({"dim": f.dim.iloc[:1], "i": f.i.iloc[:1], "j": f.j.iloc[:1], "tile": [b"".join(v.to_bytes(WIDE, "little", signed=True) for v in total)]})

    kind = "dim bigint, i int, j int, tile binary"
    parts = good.mapInArrow(multiply, kind).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE)))
    some = parts.groupBy("dim", "i", "j", "part").applyInPandas(merge, kind)
    return some.groupBy("dim", "i", "j").applyInPandas(merge, kind)


def fitted(tiles: DataFrame, fit: dict[int, tuple[int, list[int]]], components: int) -> DataFrame:
    """dim, trace, and the values and vectors of the leading components; V is rounded from exact integers by tile."""
    shared = tiles.sparkSession.sparkContext.broadcast({dim: (n, [s % n for s in total]) for dim, (n, total) in fit.items()})

    def centred(batches):
        for batch in batches:
            out = []
            for dim, i, j, data in zip(*(c.to_pylist() for c in batch.columns)):
                n, r = shared.value[dim]
                rows, cols = r[i : i + TILE], r[j : j + TILE]
                exact = iter(opened(data))
                cube = n**3
                out.append(np.array([(n * n * next(exact) - n * a * b) / cube for a in rows for b in cols]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["dim", "i", "j", "tile"])

    def decomposed(f: pd.DataFrame) -> pd.DataFrame:
        dim = int(f.dim.iloc[0])
        v = np.zeros((dim, dim))
        for i, j, data in zip(f.i, f.j, f.tile):
            tile = np.frombuffer(data).reshape(min(TILE, dim - i), min(TILE, dim - j))
            v[i : i + TILE, j : j + TILE] = tile
            v[j : j + TILE, i : i + TILE] = tile.T
        values, vectors = np.linalg.eigh(v)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        # Rounding leaves values of this size where there is no variance.
        none = max(float(values[0]), 0.0) * dim * 16 * np.finfo(float).eps
        return pd.DataFrame({"dim": [dim], "trace": [float(np.trace(v))], "values": [[x if x > none else 0.0 for x in values.tolist()]], "vectors": [vectors.T.ravel().tolist()]})

    kind = "dim bigint, i int, j int, tile binary"
    return tiles.mapInArrow(centred, kind).groupBy("dim").applyInPandas(decomposed, "dim bigint, trace double, values array<double>, vectors array<double>")


class Model:
    """n, m, r, eigenvalues, vectors and trace of one length."""

    def __init__(self, n: int, total: list[int], values: list[float], vectors: list[float], trace: float):
        self.n, self.low, self.rest = n, np.array([s // n for s in total], np.int64), [s % n for s in total]
        self.values, self.trace = np.array(values), trace
        self.vectors = np.array(vectors).reshape(len(values), -1)
        self.share = np.array([s / n for s in self.rest])
        with np.errstate(divide="ignore"):
            self.scale = np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """NaN for components without variance. x - S/n is an integer less a fraction, each exact or rounded once."""
        return ((x - self.low) - self.share) @ self.vectors.T * self.scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """sum over dimensions of (n x - S)^2 = n^2 sum(d d) - 2 n sum(d r) + sum(r r), exactly."""
        d = x - self.low
        most = int(np.abs(d).max()) + 1
        if most * most * len(self.rest) >> 62 or most * len(self.rest) << 24 >> 62:
            return [sum((self.n * int(v) - r) ** 2 for v, r in zip(row, self.rest)) for row in d.tolist()]
        square, across, left, at = (d * d).sum(1).tolist(), [0] * len(d), list(self.rest), 0
        while any(left):
            part = (d * np.array([r & 0xFFFFFF for r in left], np.int64)).sum(1).tolist()
            across = [a + (p << at) for a, p in zip(across, part)]
            left, at = [r >> 24 for r in left], at + 24
        own = sum(r * r for r in self.rest)
        return [self.n * self.n * s - 2 * self.n * a + own for s, a in zip(square, across)]


def joined(a: tuple, b: tuple) -> tuple:
    """n, mean and centred products of two lists together."""
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def identity_error(good: DataFrame, models) -> float | None:
    """The largest absolute entry of the whitened values' covariance minus the identity, of all lengths."""

    def measure(batches):
        held: dict[int, tuple] = {}
        for dim, x in blocks_of(batches, models.value):
            w = models.value[dim].whitened(x)
            mean = w.mean(0)
            own = len(w), mean, (w - mean).T @ (w - mean)
            held[dim] = joined(held[dim], own) if dim in held else own
        for dim, (n, mean, products) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([n]), pa.array([mean.tolist()]), pa.array([products.ravel().tolist()])], names=["dim", "n", "mean", "products"])

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        total = None
        for n, mean, products in zip(f.n, f["mean"], f["products"]):
            own = n, np.array(mean, float), np.array(products, float).reshape(len(mean), -1)
            total = own if total is None else joined(total, own)
        return pd.DataFrame({"dim": f.dim.iloc[:1], "n": [int(total[0])], "mean": [total[1].tolist()], "products": [total[2].ravel().tolist()]})

    kind = "dim bigint, n bigint, mean array<double>, products array<double>"
    parts = good.mapInArrow(measure, kind).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE)))
    every = parts.groupBy("dim", "part").applyInPandas(merge, kind).groupBy("dim").applyInPandas(merge, kind)
    worst = []
    for r in every.collect():  # one row of at most 72 numbers per length
        off = np.array(r["products"], float).reshape(len(r["mean"]), -1) / r.n - np.eye(len(r["mean"]))
        some = ~np.isnan(np.diag(off))
        if some.any():
            worst.append(float(np.abs(off[np.ix_(some, some)]).max()))
    return max(worst, default=None)


def whitened(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n, deviation (an exact integer as a string), whitened and explained (arrays by component) and identity_error."""
    good = usable(rows, id_col, vector_col)
    fit = sums(good)
    own = {r.dim: r for r in fitted(products(good, fit), fit, components).collect()} if fit else {}
    models = rows.sparkSession.sparkContext.broadcast({dim: Model(*fit[dim], r["values"], r["vectors"], r["trace"]) for dim, r in own.items()})
    error = identity_error(good, models) if fit else None

    def project(batches):
        for batch in batches:
            for at, x in by_length(batch):
                model = models.value[x.shape[1]]
                w = model.whitened(x)
                values = pa.array(w.ravel(), mask=np.isnan(w).ravel())
                ends = pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32())
                share = (model.values / model.trace).tolist() if model.trace > 0 else [None] * w.shape[1]
                told = pa.ListArray.from_arrays(ends, pa.array(share * len(x), pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([model.n] * len(x)), pa.array([str(v) for v in model.deviations(x)]), pa.ListArray.from_arrays(ends, values), told], names=["vec_id", "n", "deviation", "whitened", "explained"])

    out = good.mapInArrow(project, "vec_id bigint, n bigint, deviation string, whitened array<double>, explained array<double>")
    return out.withColumn("identity_error", F.lit(error).cast("double"))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where it doesn't fit a long; deviation_exact always holds it."""
    got = whitened(table(spark, sf_dir, "embeddings"))
    own = got.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "own"))
    return own.select("vec_id", (F.col("at") + 1).alias("component"), "n", F.col("deviation").try_cast("bigint").alias("deviation"), F.col("own.whitened"), F.col("own.explained"), "identity_error", F.col("deviation").alias("deviation_exact"))
