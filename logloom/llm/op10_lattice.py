"""Embedding near-duplicates by lattice hashing.

In each table, unit vectors are projected onto eight random orthonormal directions per block, scaled by the square root of
their dimension, shifted, and decoded to the E8 lattice: the nearest points of D8 and of D8 + 1/2 are both computed; the
nearer one is the vector's cell and the other, a neighbouring cell, is probed too. A key joins one cell of each of a table's
blocks, with the neighbours of all blocks probed in every combination. Vectors that meet in a key are verified by cosine in
double precision.

How many blocks a key joins, how fine the lattice is and how many tables there are follow from the number of vectors and
their length: a simulation of pairs at the threshold and of random pairs gives the chance p to meet in a block. Tables are as
many as find a pair at the threshold with a chance of `recall`, and of all choices that do the cheapest in keys and expected
coincidences is taken; more vectors make it sharper. Vectors of each length are a matter of their own.

Vectors of one direction are one class with a weight, so copies, scaled ones too, make no pairs. Near copies in a large cluster
are answered from a leader: where keys are larger than a block, each vector looks for a leader (a key's least id) within half the
angle that links. Any two vectors of one leader are linked then, by the bound on angles, so they are counted by the leader's
number of vectors, are never compared, and a key that holds them alone is left out.

Keys that one vector holds alone leave first, as numbers; then vectors travel. Keys are verified in blocks of at most about `block` vectors: a larger one is dealt into sub-blocks, and
each pair of sub-blocks is a group of its own, so no task holds an unbounded key and no pair is lost. A pair that meets in
several keys counts in its first one. Groups return counts and one link to a local root for each vector, never the pairs;
components follow from those links.

Edge cases: vectors null, empty, zero or with null or non-finite components link with nothing and are their own component;
vectors of different lengths don't link; a null id keeps its row with no links and a null component, and is kept; repeated rows count once;
several vectors under one id share a component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, dropped, table, written
from .vectors import lengths, usable

BLOCK, RECALL = 3000, 0.98
#: Keys of a vector in all its tables.
MOST_KEYS = 512


def decode_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the nearest and the second coset's lattice points of each row of 8, as integers."""

    def d8(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(1).astype(np.int64) % 2)
        e = y[odd] - r[odd]
        worst = np.abs(e).argmax(1)
        r[odd, worst] += np.where(e[np.arange(len(odd)), worst] >= 0, 1, -1)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return (2 * np.where(near[:, None], a, b)).astype(np.int64), (2 * np.where(near[:, None], b, a)).astype(np.int64)


@functools.lru_cache(1000)
def meeting(dim: int, cosine: float, pairs: int = 20_000, seed: int = 3) -> list[tuple[float, float, float]]:
    """(scale, chance that a pair at the threshold meets in a block, chance that a random pair does) for several scales, simulated."""
    rng, dim = np.random.default_rng(seed), max(dim, 8)
    two = []
    for lo in range(0, pairs, 2000):
        a, b = rng.standard_normal((2, min(2000, pairs - lo), dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        near = cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * b
        two.append((a[:, :8], near[:, :8]))
    a, near = (np.concatenate(x) for x in zip(*two))
    far, shift, out = np.roll(a, 1, 0), rng.random(8) * 2, []
    for scale in np.arange(0.3, 1.25, 0.05):
        cells = [decode_e8(x * scale * math.sqrt(dim) + shift) for x in (a, near, far)]
        meet = lambda x, y: float(np.logical_or.reduce([(p == q).all(1) for p in x for q in y]).mean())
        out.append((float(scale), meet(cells[0], cells[1]), max(meet(cells[0], cells[2]), 3 / pairs)))
    return out


def plan(n: int, dim: int, cosine: float, recall: float = RECALL) -> tuple[int, float, int]:
    """Blocks in a key, scale and tables for n vectors."""
    best = None
    for scale, near, far in meeting(dim, cosine):
        for blocks in range(1, 9):
            found = near**blocks
            tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - found))) if found < 1 else 1
            keys = tables << blocks
            if keys <= MOST_KEYS:
                # Bytes moved for a vector: its keys, and vectors at which it meets by chance.
                cost = 48 * keys + n * far**blocks * tables * 2 * (4 * dim + 100)
                best = min(best or (math.inf,), (cost, blocks, scale, tables))
    return best[1:]


def cell_keys(unit: np.ndarray, blocks: int, scale: float, tables: int, seed: int) -> np.ndarray:
    """(vectors, tables << blocks) keys; a key is a hash of its table, its length and a lattice point of each block."""
    dim, out = unit.shape[1], []
    rng = np.random.default_rng((seed, dim))
    mix = lambda h: (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    for t in range(tables):
        keys = [np.full(len(unit), 1 + t * 65_537 + dim, np.uint64)]
        for _ in range(blocks):
            q, _ = np.linalg.qr(rng.standard_normal((max(dim, 8), 8)))
            shift, cells = rng.random(8) * 2, []
            for point in decode_e8(unit @ q[:dim] * (scale * math.sqrt(max(dim, 8))) + shift):
                h = np.zeros(len(unit), np.uint64)
                for c in range(8):
                    h = mix(h + point[:, c].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
                cells.append(h)
            keys = [mix(mix(k) + h) for k in keys for h in cells]
        out += keys
    return np.stack(out, 1).view(np.int64)


def candidates(unit: np.ndarray, cell: np.ndarray, sub: np.ndarray, cross: np.ndarray, cosine: float, small: int = 48):
    """Yields (i, j) arrays of rows that share a cell. Rows are sorted by cell and part; small runs are paired by shifts, large ones by blockwise products."""
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    run = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(cell)]))
    size = np.bincount(run)
    easy = np.flatnonzero((size[run] <= small) & ~cross)
    for shift in range(1, small):
        i = easy[:-shift]
        j = easy[shift:]
        same = run[i] == run[j]
        if not same.any():
            break
        yield i[same], j[same]
    for r in np.unique(run[(size[run] > small) | cross]):
        own = np.flatnonzero(run == r)
        two = bool(cross[own[0]])
        left = own[sub[own] == sub[own].min()] if two else own
        right = own[sub[own] != sub[own].min()] if two else own
        for lo in range(0, len(left), 1000):
            rows = left[lo : lo + 1000]
            i, j = np.nonzero(unit[rows] @ unit[right].T >= cosine - 1e-9)
            i, j = rows[i], right[j]
            yield (i, j) if two else (i[i < j], j[i < j])


def local_links(ids: np.ndarray, unit: np.ndarray, keys: np.ndarray, weight: np.ndarray, leader: np.ndarray, cell: np.ndarray, part: np.ndarray, sub: np.ndarray, cross: np.ndarray, cosine: float) -> pd.DataFrame:
    """Weighted link counts and local roots of the rows of one group, which are sorted by part. A pair counts in the first cell of all it shares.

    Pairs with one leader (ids from 0 on; -1 is none) are left out, since they are counted by it.
    """
    root, count, pairs = np.arange(len(ids)), np.zeros(len(ids), np.int64), []
    for i, j in candidates(unit, part, sub, cross, cosine):
        for at in range(0, len(i), 100_000):
            a, b = i[at : at + 100_000], j[at : at + 100_000]
            apart = (leader[a] != leader[b]) | (leader[a] < 0)
            a, b = a[apart], b[apart]
            exact = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
            a, b = a[exact], b[exact]
            # Keys ascend in each row: a pair is done with where it shares an earlier key, or where earlier ones end.
            own, left = np.zeros(len(a), bool), np.arange(len(a))
            for c in range(keys.shape[1]):
                k = keys[a[left], c]
                own[left[k >= cell[a[left]]]] = True
                left = left[k < cell[a[left]]]
                left = left[~(keys[b[left]] == keys[a[left], c][:, None]).any(1)]
                if not len(left):
                    break
            own[left] = True
            a, b = a[own], b[own]
            np.add.at(count, a, weight[b])
            np.add.at(count, b, weight[a])
            pairs.append((a, b))
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs))
        while len(a):
            before = root.copy()
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if (root == before).all():
                break
    own = np.flatnonzero(count)
    return pd.DataFrame({"vec_id": ids[own], "links": count[own], "root": ids[root[own]]})


def units(x: pd.Series) -> np.ndarray:
    x = np.stack(x.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that squares stay within range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: Leaders that a vector tries, and bytes of leaders' vectors and number of large cells up to which those are broadcast.
TRIED, SHARED_BYTES, SHARED_CELLS = 3, 32 << 20, 1 << 20


def led(entries: DataFrame, large: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """vec_id and leader of vectors at most half the angle of the cosine from a leader, the least one of those tried.

    entries(vec_id, cell), large(cell): cells that hold too many vectors to compare them all.
    """
    half = math.acos(cosine) / 2 * (1 - 1e-9)
    few = lambda cells: F.broadcast(cells) if large.count() <= SHARED_CELLS else cells
    held = entries.join(few(large), "cell")
    heads = written(held.groupBy("cell").agg(F.min("vec_id").alias("leader")))
    tried = held.join(few(heads), "cell").groupBy("vec_id").agg(F.slice(F.sort_array(F.collect_set("leader")), 1, TRIED).alias("leaders"))
    vectors = classes.select(F.col("vec_id").alias("leader"), F.col("embedding").alias("other")).join(heads.select("leader").distinct(), "leader", "left_semi")
    vectors = written(vectors)
    size = vectors.agg(F.sum(8 * F.size("other"))).first()[0] or 0
    own = tried.join(classes.select("vec_id", "embedding"), "vec_id").withColumn("leader", F.explode("leaders")).drop("leaders")
    own = own.join(F.broadcast(vectors) if size <= SHARED_BYTES else vectors, "leader").where(F.size("embedding") == F.size("other"))

    def near(frames):
        for f in frames:
            for _, x in f.groupby(f.embedding.map(len)):
                # The chord gives small angles exactly, where the cosine doesn't.
                chord = np.linalg.norm(units(x.embedding) - units(x.other), axis=1)
                yield x.loc[2 * np.arcsin(np.minimum(chord / 2, 1)) <= half, ["vec_id", "leader"]]

    return own.select("vec_id", "leader", "embedding", "other").mapInPandas(near, "vec_id bigint, leader bigint").groupBy("vec_id").agg(F.min("leader").alias("leader"))


def near_links(classes: DataFrame, cosine: float, recall: float = RECALL, block: int = BLOCK, group_rows: int = 8000, seed: int = 11) -> DataFrame:
    """vec_id, links and root rows from classes(vec_id, embedding, weight) of distinct vectors."""
    plans = {dim: plan(n, dim, cosine, recall) for dim, n in lengths(classes).items()}

    def keyed(frames):
        for f in frames:
            for dim, own in f.groupby(f.embedding.map(len)):
                yield pd.DataFrame({"vec_id": own.vec_id, "cells": list(cell_keys(units(own.embedding), *plans[dim], seed))})

    base = classes.select("vec_id", "embedding").mapInPandas(keyed, "vec_id bigint, cells array<bigint>")
    base = written(base.select("vec_id", F.array_distinct("cells").alias("cells")))
    entries = base.select("vec_id", F.explode("cells").alias("cell"))
    sizes = entries.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    large = sizes.where(F.col("n") > block)
    leaders, own = None, entries.withColumn("leader", F.lit(None).cast("bigint"))
    large = written(large.select("cell"))
    if large.take(1):
        leaders = written(led(entries, large, classes, cosine))
        own = base.join(leaders, "vec_id", "left").select("vec_id", F.explode("cells").alias("cell"), "leader")
        # Of each cell, the vectors of its most frequent leader meet only the others; they are `same`.
        per = own.groupBy("cell", "leader").agg(F.count("*").alias("n")).groupBy("cell").agg(F.sum("n").alias("n"), F.max(F.when(F.col("leader").isNotNull(), F.struct("n", "leader"))).alias("most"))
        sizes = per.where("n > 1").select("cell", "n", F.coalesce("most.n", F.lit(0)).alias("same"), F.col("most.leader").alias("main"))
        sizes = sizes.where("same < n")
    else:
        sizes = sizes.select("cell", "n", F.lit(0).alias("same"), F.lit(None).cast("bigint").alias("main"))
    whole = F.col("n") <= block
    mine = F.coalesce(F.col("leader") == F.col("main"), F.lit(False))
    others = F.ceil((F.col("n") - F.col("same")) / block).cast("int")
    every = others + F.ceil(F.col("same") / block).cast("int")
    # Vectors of the main leader have the numbers behind the others' and meet those alone.
    sub = F.when(whole, 0).when(mine, others + F.pmod(F.xxhash64("vec_id", "cell"), F.greatest(every - others, F.lit(1)))).otherwise(F.pmod(F.xxhash64("vec_id", "cell"), others)).cast("int")
    placed = own.join(sizes, "cell").select("vec_id", "cell", sub.alias("sub"), F.when(whole, 1).when(mine, others).otherwise(every).alias("meets"))
    shared = written(placed.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("cell", "sub", "meets"))).alias("at")))
    dropped(base)
    # A vector goes once to each group, with those of its keys that the group answers.
    groups = max(1, -(-shared.agg(F.sum(F.size("at"))).first()[0] // group_rows)) if shared.take(1) else 1
    parts = shared.select("vec_id", F.transform("at", lambda x: x["cell"]).alias("keys"), F.explode("at").alias("at")).select("vec_id", "keys", "at.*")
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("meets") - 1)))
    parts = parts.select("vec_id", "keys", F.struct("cell", F.least("sub", "other").alias("p"), F.greatest("sub", "other").alias("q"), "sub").alias("at"))
    parts = parts.groupBy("vec_id", F.pmod(F.xxhash64("at.cell", "at.p", "at.q"), F.lit(groups)).alias("g")).agg(F.any_value("keys").alias("keys"), F.collect_list("at").alias("at"))
    rows = parts.join(classes, "vec_id")
    rows = rows.withColumn("leader", F.lit(-1).cast("bigint")) if leaders is None else rows.join(leaders, "vec_id", "left").withColumn("leader", F.coalesce("leader", F.lit(-1)))

    def verify(f: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, own in f.groupby(f.embedding.map(len)):
            at = pd.DataFrame([x.asDict() if hasattr(x, "asDict") else x for xs in own["at"] for x in xs])
            row = np.repeat(np.arange(len(own)), own["at"].map(len))
            by = np.lexsort((row, at.q, at.p, at.cell))
            at, row = at.iloc[by], row[by]
            keys = np.full((len(own), own["keys"].map(len).max()), np.iinfo(np.int64).max)
            for k, x in enumerate(own["keys"]):
                keys[k, : len(x)] = x
            part = at.groupby(["cell", "p", "q"], sort=True).ngroup().to_numpy()
            found.append(local_links(own.vec_id.to_numpy()[row], units(own.embedding)[row], keys[row], own.weight.to_numpy()[row], own.leader.to_numpy()[row], at.cell.to_numpy(), part, at["sub"].to_numpy(), (at.p != at.q).to_numpy(), cosine))
        return pd.concat(found)

    found = rows.groupBy("g").applyInPandas(verify, "vec_id bigint, links bigint, root bigint")
    if leaders is None:
        return found
    cluster = classes.select("vec_id", "weight").join(leaders, "vec_id")
    total = cluster.groupBy("leader").agg(F.sum("weight").alias("all"), F.min("vec_id").alias("root"), F.count("*").alias("n")).where("n > 1")
    sure = cluster.join(total, "leader").select("vec_id", (F.col("all") - F.col("weight")).alias("links"), "root")
    return found.unionByName(sure)


def near_duplicates(rows: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """vec_id, n_links, component_id and kept for every distinct row."""
    good = usable(rows, id_col, vector_col)
    # x / max|x| is the same for scaled copies, to the last bit where their numbers are exact multiples; 0.0 takes the sign off zeros.
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    # As the one element of an array, the largest is found once for a vector and not once for each of its numbers.
    way = F.transform(F.array(F.struct(largest.alias("m"), F.col("embedding").alias("e"))), lambda s: F.transform(s["e"], lambda x: x.cast("double") / s["m"] + F.lit(0.0)))
    good = good.withColumn("way", way[0])
    good = written(good.select("vec_id", "embedding", *(F.xxhash64(F.lit(k), "way").alias(f"w{k}") for k in (1, 2))))
    classes = good.groupBy("w1", "w2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.min_by("embedding", "vec_id").alias("embedding"))
    classes = written(classes)  # read several times; most are a single vector
    found = written(near_links(classes.select("vec_id", "embedding", "weight"), cosine, **how))
    member = good.select("vec_id", "w1", "w2").join(classes.select("w1", "w2", F.col("vec_id").alias("class_id"), "weight"), ["w1", "w2"]).select("vec_id", "class_id", "weight")
    links = found.groupBy(F.col("vec_id").alias("class_id")).agg(F.sum("links").alias("links"))
    edges = found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).unionByName(member.select(F.col("vec_id").alias("a"), F.col("class_id").alias("b")))
    parts = components(edges)
    linked = member.join(links, "class_id", "left").groupBy("vec_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    every = rows.select(F.col(id_col).cast("bigint").alias("vec_id")).distinct()
    out = every.join(linked, "vec_id", "left").join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
