"""Shared helpers: reading tables, shared scratch tables, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir. Where that is unset, a local one if Spark runs in this machine alone (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="logloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as parquet in the shared folder and reads it again."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One link (node, least node of its part) for each node of a partition's edges that isn't the least itself."""
    f = pd.concat(list(frames))
    codes, names = pd.factorize(pd.concat([f.a, f.b]), sort=True)
    a, b, root = codes[: len(f)], codes[len(f) :], np.arange(len(names))
    while len(f):
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(names)))
    yield pd.DataFrame({"a": names[own], "b": names[root[own]]})


def starred(e: DataFrame) -> bool:
    """Whether every node has one link at most and no node with a link is linked to, so that each component is a star."""
    up, down = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), e.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    return not up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").take(1)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest reachable node.

    Each partition of edges is reduced to a forest first. Large-star and small-star passes follow in turn, so a chain of n
    nodes takes about log n rounds. Each pass aggregates by node with a map-side minimum and joins back, and every round is a
    written table. Stops when all components are stars and raises when they aren't within `rounds`. An empty edge table gives
    no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = written(e.mapInPandas(forest, e.schema))
    for _ in range(rounds):
        if starred(e):
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        kept = low.select("a", F.col("m").alias("b"))
        e1 = large.unionByName(kept).where("a <> b").distinct()
        low1 = e1.groupBy("a").agg(F.min("b").alias("m"))
        small = e1.join(low1, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, e = e, written(small.unionByName(low1.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        dropped(last)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
