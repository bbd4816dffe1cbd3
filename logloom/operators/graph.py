"""Connected components and reachability as joins that run to a fixed point."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import stored


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
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").take(1)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node that links reach.

    Each partition of edges is reduced to a forest first. Large-star and small-star passes follow in turn, each a stored table,
    until all components are stars; a chain of n nodes takes about log n rounds.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e.mapInPandas(forest, e.schema))
    for _ in range(rounds):
        if starred(e):
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = stored(small.where("a <> b").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def observed_edges(logs: DataFrame, span: int = 3600) -> DataFrame:
    """(upstream, downstream, calls): a service whose logs come right after another's in a trace, more often than the other way round.

    Logs of a trace are put in order within spans of that many seconds, so a trace that is everywhere isn't sorted in one task; a
    tie between the directions goes to the smaller name as upstream.
    """
    own = logs.where("trace_id IS NOT NULL").select("trace_id", "service", "ts", "id", F.floor(F.col("ts") / span).alias("span"))
    before = F.lag("service").over(Window.partitionBy("trace_id", "span").orderBy("ts", "id"))
    calls = own.withColumn("upstream", before).where("upstream <> service").groupBy("upstream", F.col("service").alias("downstream")).agg(F.count("*").alias("calls"))
    back = calls.select(F.col("downstream").alias("upstream"), F.col("upstream").alias("downstream"), F.col("calls").alias("back"))
    own = calls.join(back, ["upstream", "downstream"], "left")
    more = (F.col("calls") > F.coalesce("back", F.lit(0))) | ((F.col("calls") == F.col("back")) & (F.col("upstream") < F.col("downstream")))
    return own.where(more).select("upstream", "downstream", "calls")


def reachable(edges: DataFrame) -> DataFrame:
    """(upstream, reached) for every pair that edges(upstream, downstream) join by a path of any length, without self pairs.

    Each round doubles the length of the paths; it ends when no pair is new, so cycles end, too.
    """
    found = stored(edges.select("upstream", F.col("downstream").alias("reached")).distinct())
    while True:
        ahead = found.select(F.col("upstream").alias("reached"), F.col("reached").alias("further"))
        more = found.join(ahead, "reached").select("upstream", F.col("further").alias("reached")).distinct()
        new = stored(more.join(found, ["upstream", "reached"], "left_anti"))
        if not new.take(1):
            return found.where("upstream <> reached")
        found = stored(found.unionByName(new))
