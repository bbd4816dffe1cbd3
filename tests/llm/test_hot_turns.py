"""Many turns under one number of one conversation, as rows without a conv_id are."""

import random

import pytest
from pyspark.sql import functions as F

from logloom.llm import op2_chat_format


def placed_by_force(rows):
    """{(conv_id, pos, role, text)} of all distinct turns."""
    by, out = {}, set()
    for c, t, r, x in set(rows):
        by.setdefault(c, []).append((t, r, x))
    first = lambda v: (v is not None, v or "")
    for c, turns in by.items():
        turns.sort(key=lambda k: (k[0] is not None, k[0] or 0, first(k[1]), first(k[2])))
        out |= {(c, i, r, x) for i, (_, r, x) in enumerate(turns, 1)}
    return out


@pytest.mark.parametrize("hot", [1, 7, 4096])
def test_places_of_hot_turns(spark, hot):
    rng = random.Random(hot)
    long = "the same opening of every text " * 8
    rows = [(None, rng.randrange(3), rng.choice(["user", None, ""]), long * (i % 3 == 0) + f"text {i % 150}") for i in range(400)]
    rows += [(7, None, "user", None), (7, None, "user", ""), (7, None, None, "x"), (7, -1, "user", "y"), (7, 2**60, "user", "z"), (7, 2**60, "user", "y")] + rows[:9]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    got = op2_chat_format.collapse(df, 4, hot).select("conv_id", "pos", "role", "text").distinct().collect()
    assert {tuple(r) for r in got} == placed_by_force(rows) and len(got) == len(placed_by_force(rows))


def test_hot_turns_are_numbered_without_gaps(spark):
    """A third of the rows has no conv_id and one of two turn numbers: places have no gaps, and no block grows."""
    df = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("conv_id"), (F.col("id") % 6).alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("turn "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    own = op2_chat_format.numbered(df)
    hot = own.where("conv_id IS NULL").select("conv", "at", "c1", "c2", "role", "text")
    parts = op2_chat_format.tie_order(hot).groupBy("conv", "at").agg(F.min("tie").alias("a"), F.max("tie").alias("b"), F.countDistinct("tie").alias("n")).collect()
    assert len(parts) == 2 and all((r.a, r.b) == (1, r.n) for r in parts) and sum(r.n for r in parts) == 20_000
    blocks = op2_chat_format.positions(own).groupBy("conv", "block").count().agg(F.max("count")).first()[0]
    assert blocks <= op2_chat_format.BLOCK_TURNS
