"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to n - 1 in the order of a hash of their identity, in buckets of that hash whose sizes are
near equal whatever the ids look like. The permutation p of 0..n-1 is a keyed Feistel network over pairs of
digits in base m = ceil(sqrt(n)); a value of n or more is permuted again until it is below n. Row r goes to shard
p(r) mod s, slot p(r) div s, so shard sizes are at most one apart (law `rows`) and both are computable from r, n
and the key alone. Only DataFrame functions are used, and texts are never shuffled: each row is reduced to
(doc_id, size, text_crc32) first, equal ones are counted before the shuffle and dealt out again in pieces of bounded size.

Edge cases: a null text has size 16 and crc32 0; a null id is an id like any other; repeated rows each get a slot of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

ROUNDS = 6
#: Walks this long are an error. A step stays outside with a chance of about 2/sqrt(n), and of 1/2 at most.
WALK = 64
#: Copies of one row that one task makes.
PIECE = 4096


def feistel(x: Column, m: Column, seed: int) -> Column:
    """A permutation of 0..m*m-1."""
    keys = F.array(*(F.lit(seed * 1000 + i) for i in range(ROUNDS)))
    start = F.struct(((x - F.pmod(x, m)) / m).cast("bigint").alias("a"), F.pmod(x, m).alias("b"))
    step = lambda s, k: F.struct(s["b"].alias("a"), F.pmod(s["a"] + F.pmod(F.xxhash64(s["b"], k), m), m).alias("b"))
    return F.aggregate(keys, start, step, lambda s: s["a"] * m + s["b"])


def permuted(row: Column, n: Column, seed: int) -> Column:
    """Place of a row number among n rows: the Feistel value, walked until it is below n."""
    m = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), feistel(row, m, seed), lambda y, _: F.when(y < n, y).otherwise(feistel(y, m, seed)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("bigint"))


def shard(docs: DataFrame, shards: int, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 65_536) -> DataFrame:
    """doc_id, size, text_crc32, row (the global row number), shard and slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    buckets = max(1, -(-docs.count() // rows_per_bucket))
    same = own.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    same = same.withColumn("h", F.xxhash64("doc_id", "size", "text_crc32")).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    totals = same.groupBy("bucket").agg(F.sum("copies").alias("in_bucket"))
    # One row per bucket, so a single partition holds 1 / rows_per_bucket of the input's rows.
    every = Window.partitionBy()
    before = every.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.select("bucket", (F.sum("in_bucket").over(before) - F.col("in_bucket")).alias("offset"), F.sum("in_bucket").over(every).alias("n"))
    inside = Window.partitionBy("bucket").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = same.withColumn("first", F.sum("copies").over(inside) - F.col("copies"))
    # One row may stand for a third of the input, so copies are dealt out in pieces before they become rows again.
    rows = first.join(totals, "bucket").select("doc_id", "size", "text_crc32", "n", (F.col("offset") + F.col("first")).alias("begin"), "copies")
    rows = rows.withColumn("from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(PIECE).cast("bigint")))).repartition(F.col("begin"), F.col("from"))
    rows = rows.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + PIECE, "copies") - 1)))
    rows = rows.withColumn("row", F.col("begin") + F.col("copy")).withColumn("place", permuted(F.col("row"), F.col("n"), seed))
    return rows.select("doc_id", "size", "text_crc32", "row", F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.expr(f"place div {int(shards)}").cast("bigint").alias("slot"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
