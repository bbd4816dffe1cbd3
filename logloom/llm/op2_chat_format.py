"""Chat formatting: cumulative snapshots are collapsed, then the remaining conversations are rendered.

Loggers often store a conversation again after every turn. A conversation is dropped when its turns are a proper
prefix of another one's turns, or when they equal those of one with a smaller id; the maximal ones are rendered.
Prefixes are found by rolling hashes: each turn's 120-bit hash covers its position, role and text, and the hash of a
prefix is the exclusive or of its turns' hashes together with its length. Anti-joins against the distinct prefix
hashes keep the maximal conversations. Only DataFrame functions are used.

Turns are reduced to conversation, turn number and a 120-bit hash of role and text first, and everything up to the choice of
conversations happens on those numbers. Texts are joined to the chosen ones at the end; before that, only turns that share
a number with a different one are looked up, since their texts decide the order.

Turn numbers get their start in the conversation from counts, in windows of `block_turns` turn numbers and of block totals;
hashes roll inside blocks of `block_turns` places. So a conversation of any length never sits in one window, and neither do the
many turns that share one number, as rows without a conv_id do: those are numbered by ranges of their order. A rendered
conversation is one row per part of at most `block_turns` turns.

Edge cases: exact repeats of a turn count once; different rows with one turn number follow in the order of role and text;
null roles and texts render as empty but hash apart from empty ones; a null turn sorts first, and a null conv_id is an
id like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

BLOCK_TURNS = 512
#: A turn number of one conversation with more different turns than this is dealt out over tasks.
HOT_TURNS = 4096
SALTS = 64
PREFIX = 128


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with conv and at, their conversation and number without nulls, and c1 and c2, a hash of role and text."""
    coded = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)))
    low = F.lit(-(2**63))
    own = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    own = own.withColumn("conv", F.coalesce("conv_id", low)).withColumn("at", F.coalesce("turn", low))
    return hashed(own, F.concat(coded("role"), F.lit("|"), coded("text")), "c1", "c2")


def hashed(rows: DataFrame, value: Column, first: str, second: str) -> DataFrame:
    """rows with 120 bits of the value's digest in two columns."""
    digest = F.sha2(value, 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint")
    return rows.withColumn(first, part(1)).withColumn(second, part(16))


def tie_order(rows: DataFrame) -> DataFrame:
    """conv, at, c1, c2 and tie, the place among all rows of one conv and at, for turn numbers of any number of rows.

    Spark deals the rows out by ranges of the order and sorts each range; a row's place is its place in its range and the
    counts of the ranges before. Ranges are cut by the first PREFIX characters, so that the sample that Spark draws for them is
    bounded; rows equal in those are sorted in one task.
    """
    dealt = rows.repartitionByRange("conv", "at", F.substring("role", 1, PREFIX), F.substring("text", 1, PREFIX)).sortWithinPartitions("conv", "at", "role", "text")
    ranked = written(dealt.withColumn("id", F.monotonically_increasing_id()).withColumn("range", F.shiftright("id", 33)).drop("role", "text"))
    ranges = ranked.groupBy("conv", "at", "range").agg(F.min("id").alias("least"), F.count("*").alias("rows"))
    before = Window.partitionBy("conv", "at").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    return ranked.join(ranges, ["conv", "at", "range"]).select("conv", "at", "c1", "c2", (F.col("id") - F.col("least") + F.col("before") + 1).alias("tie"))


def positions(turns: DataFrame, block_turns: int = BLOCK_TURNS, hot_turns: int = HOT_TURNS) -> DataFrame:
    """Distinct turns as conv, at, c1, c2 and block, with pos, their place in the conversation from 1."""
    own = written(turns.groupBy("conv", "at", "c1", "c2").agg(F.lit(1).alias("one")).drop("one"))
    numbers = own.groupBy("conv", "at").agg(F.count("*").alias("n")).withColumn("span", F.floor(F.col("at") / block_turns).cast("bigint"))
    numbers = written(numbers)
    spans = numbers.groupBy("conv", "span").agg(F.sum("n").alias("n"))
    before = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("conv", "span", before(["conv"], "span").alias("offset"))
    starts = written(numbers.withColumn("inner", before(["conv", "span"], "at")).join(spans, ["conv", "span"]).select("conv", "at", "n", (F.col("inner") + F.col("offset")).alias("start")))
    # A turn number with many different turns meets its start in SALTS parts, so no task takes all of them.
    hot = starts.where(F.col("n") > hot_turns).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = own.withColumn("salt", F.pmod("c1", F.lit(SALTS)).cast("int"))
    marked = written(salted.join(hot, ["conv", "at", "salt"], "left").drop("salt"))
    few = marked.where("n IS NULL").drop("n", "start").join(starts, ["conv", "at"])
    placed = written(marked.where("n IS NOT NULL").unionByName(few))
    texts = turns.select("conv", "at", "c1", "c2", "role", "text").join(placed.where("n > 1").select("conv", "at", "c1", "c2", "n"), ["conv", "at", "c1", "c2"]).distinct()
    order = Window.partitionBy("conv", "at").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    tied = written(texts)
    ties = tied.where(F.col("n") <= hot_turns).select("conv", "at", "c1", "c2", F.row_number().over(order).cast("bigint").alias("tie"))
    ties = ties.unionByName(tie_order(tied.where(F.col("n") > hot_turns).drop("n")))
    placed = placed.join(ties, ["conv", "at", "c1", "c2"], "left").withColumn("pos", F.col("start") + F.coalesce("tie", F.lit(1)))
    return placed.select("conv", "at", "c1", "c2", F.floor((F.col("pos") - 1) / block_turns).cast("bigint").alias("block"), "pos")


def rolling(placed: DataFrame) -> DataFrame:
    """Adds h1 and h2, the hash of the conversation's first pos turns."""
    own = hashed(placed, F.concat_ws("|", "pos", "c1", "c2"), "g1", "g2")
    inside = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = own.groupBy("conv", "block").agg(F.bit_xor("g1").alias("x1"), F.bit_xor("g2").alias("x2"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", *(F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"o{c}") for c in ("x1", "x2")))
    inner = own.withColumn("r1", F.bit_xor("g1").over(inside)).withColumn("r2", F.bit_xor("g2").over(inside))
    return inner.join(blocks, ["conv", "block"]).withColumn("h1", F.col("r1").bitwiseXOR(F.col("ox1"))).withColumn("h2", F.col("r2").bitwiseXOR(F.col("ox2")))


def maximal(turns: DataFrame, block_turns: int = BLOCK_TURNS, hot_turns: int = HOT_TURNS) -> DataFrame:
    """conv, at, c1, c2 and pos of the turns of the maximal conversations, without texts."""
    placed = written(positions(turns, block_turns, hot_turns))
    hashes = written(rolling(placed).select("conv", "pos", "h1", "h2"))
    whole = hashes.groupBy("conv").agg(F.max(F.struct("pos", "h1", "h2")).alias("last")).select("conv", "last.*")
    proper = hashes.join(whole.select("conv", F.col("pos").alias("length")), "conv").where("pos < length").select("pos", "h1", "h2").distinct()
    first = whole.groupBy("pos", "h1", "h2").agg(F.min("conv").alias("conv"))
    return placed.drop("block").join(first.join(proper, ["pos", "h1", "h2"], "left_anti").select("conv"), "conv", "left_semi")


def collapse(turns: DataFrame, block_turns: int = BLOCK_TURNS, hot_turns: int = HOT_TURNS) -> DataFrame:
    """Turns of the maximal conversations with pos; a repeated row stays repeated, with one pos."""
    own = numbered(turns)
    return own.join(written(maximal(own, block_turns, hot_turns)), ["conv", "at", "c1", "c2"]).select("conv", "conv_id", "turn", "role", "text", "pos")


def render(placed: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, part, n_turns and text: the turns of each part in order, each between role and end marks."""
    turn = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    parts = placed.withColumn("part", F.floor((F.col("pos") - 1) / block_turns).cast("bigint"))
    gathered = parts.groupBy("conv", "conv_id", "part").agg(F.sort_array(F.collect_set(F.struct("pos", turn.alias("t")))).alias("ts"))
    return gathered.select("conv_id", "part", F.size("ts").cast("bigint").alias("n_turns"), F.concat_ws("", F.transform("ts", lambda s: s["t"])).alias("text"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(collapse(table(spark, sf_dir, "conversations")))


#: The same rows without hashes: prefixes are compared as running strings.
OP2_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM t),
k AS (SELECT *, md5(coalesce(length(role) || ':' || role, '-') || '|' || coalesce(length(text) || ':' || text, '-')) AS m FROM p),
r AS (SELECT conv_id, pos, string_agg(m, ',') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n FROM k),
w AS (SELECT prefix, min(conv_id) AS conv_id FROM r WHERE pos = n GROUP BY prefix),
kept AS (SELECT conv_id FROM w WHERE prefix NOT IN (SELECT prefix FROM r WHERE pos < n)),
parts AS (SELECT conv_id, (pos - 1) // 512 AS part, pos, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS t FROM k WHERE conv_id IN (SELECT conv_id FROM kept))
SELECT conv_id, CAST(part AS BIGINT) AS part, count(*) AS n_turns, string_agg(t, '' ORDER BY pos) AS text FROM parts GROUP BY conv_id, part
"""
