"""Filter interaction audit: what each filter removes in every order of all filters, by Walsh-Hadamard sums.

Each document gets a mask of the filters that it fails. For every part and label class one aggregation adds up the 2^k signed
parities (-1)^popcount(mask AND s), s = 0 .. 2^k - 1; they merge by addition, with a partial sum in each task. Their inverse
gives the number of documents with each mask exactly (each sum of the inverse is a multiple of 2^k). All orders and steps are
read off those 2^k cells. Shapley: of a document that fails j filters, each of them is the first in k!/j of the orders.

A filter for copies compares texts by SHA-256. Texts are read once and reduced to their digest; rows that are equal in
(id, part, digest, mask) are counted before anything is shuffled by a key, so copies of one text or rows of one id are no
hot group: the least id of a digest is an aggregate with partial minima, and it is joined back on (digest, id).

Edge cases: a null text is empty; a null lang is the part ''; a null id is neither smaller than any nor larger than any, so it
never fails the filter for copies, makes no other row fail it, and has no labels; rows that repeat an id count one by one, and
those that have the least id of their text all pass; ids that repeat in labels are good (toxic) if any of their rows says so,
null labels say nothing; an empty table has no parts and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

FILTERS = "ABCDE"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> list[Column]:
    """Filters A to D on a text that isn't null: too short, repetitive, loud, with symbols."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # An array of one element keeps the words from being extracted once for each filter.
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("bigint").alias("all"), F.size(F.array_distinct(w)).cast("bigint").alias("distinct")))[0]
    loud = F.length(text) - F.length(F.translate(text, _LETTERS, ""))
    return [counts["all"] < 200, 100 * counts["distinct"] < 50 * counts["all"], 100 * loud.cast("bigint") > 3 * F.length(text).cast("bigint"), text.rlike("[#$%&*|]")]


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc, part, mask and n: numbers of rows by id, part and the filters that they fail, as bits from A = 1 to E = 16."""
    own = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits = [F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_failures(F.col("text")))]
    own = own.select("doc", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    rows = written(own.groupBy("doc", "part", "digest", "mask").agg(F.count("*").alias("n")))
    least = rows.where("doc IS NOT NULL").groupBy("digest").agg(F.min("doc").alias("doc")).withColumn("first", F.lit(True))
    known = rows.where("doc IS NOT NULL").join(least, ["digest", "doc"], "left")
    known = known.select("doc", "part", F.when(F.col("first").isNull(), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"), "n")
    return known.unionByName(rows.where("doc IS NULL").select("doc", "part", "mask", "n"))


def labelled(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows(doc, …) with good and toxic."""
    own = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("doc"))
    own = own.agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = rows.where("doc IS NOT NULL").join(own.where("good OR toxic"), "doc", "left")
    known = known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    return known.unionByName(rows.where("doc IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))


def parity(a: Column, b: Column) -> Column:
    """(-1) to the number of bits that a and b share."""
    return 1 - 2 * F.bit_count(a.bitwiseAND(b)).bitwiseAND(F.lit(1))


def cells(rows: DataFrame, filters: int, classes: dict[str, Column]) -> DataFrame:
    """part and, for each class of rows(part, mask, n, …), the number of rows with each mask from 0 to 2^filters - 1 as an array.

    Only the 2^filters signed sums of a part and class are shuffled.
    """
    size = 1 << filters
    sums = [F.sum(F.when(inside, F.col("n") * parity(F.col("mask"), F.lit(s))).otherwise(0)).alias(f"{name} {s}") for name, inside in classes.items() for s in range(size)]
    spectra = rows.groupBy("part").agg(*sums).select("part", *(F.array(*(F.col(f"{name} {s}") for s in range(size))).alias(name) for name in classes))
    every = F.sequence(F.lit(0), F.lit(size - 1))

    def inverse(spectrum: Column) -> Column:
        at = lambda mask: F.aggregate(every, F.lit(0).cast("bigint"), lambda acc, s: acc + F.get(spectrum, s) * parity(mask, s))
        return F.transform(every, lambda mask: F.shiftright(at(mask), filters))

    return spectra.select("part", *(inverse(F.col(name)).alias(name) for name in classes))


def orders(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order of the filters and step, from cells with the classes every, good and toxic."""
    k = len(filters)
    permutations = ["".join(p) for p in itertools.permutations(filters)]
    bit_of = F.create_map(*(F.lit(x) for at, name in enumerate(filters) for x in (name, 1 << at)))
    letter = lambda step: bit_of[F.substring(F.col("filter_order"), step, F.lit(1))]
    before = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0), lambda acc, s: acc + F.when(s < F.col("step"), letter(s)).otherwise(0))
    rows = counted.withColumn("filter_order", F.explode(F.array(*map(F.lit, permutations)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    rows = rows.withColumn("bit", letter(F.col("step"))).withColumn("before", before)
    fails, gone = lambda m: m.bitwiseAND(F.col("bit")) != 0, lambda m: m.bitwiseAND(F.col("before")) != 0

    def total(of: str, what) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit((1 << k) - 1)), F.lit(0).cast("bigint"), lambda acc, m: acc + F.get(F.col(of), m) * what(m))

    when = lambda cond: F.when(cond, F.lit(1).cast("bigint")).otherwise(0)
    share = lambda m: F.when(fails(m), F.lit(len(permutations)) / F.bit_count(m)).otherwise(0).cast("bigint")
    return rows.select(
        "part", "filter_order", "step", total("every", lambda m: when(~fails(m) & ~gone(m))).alias("kept"), total("every", lambda m: when(fails(m) & ~gone(m))).alias("removed"),
        total("every", lambda m: when(fails(m) & gone(m))).alias("redundant"), total("every", lambda m: when(m == F.col("bit"))).alias("unique_fails"),
        total("good", lambda m: when(fails(m) & ~gone(m))).alias("good_lost"), total("toxic", lambda m: when(fails(m) & ~gone(m))).alias("toxic_lost"), total("every", share).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley for five filters."""
    rows = labelled(masked(docs, id_col, text_col, part_col), labels, id_col)
    return orders(cells(rows, len(FILTERS), {"every": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# Each document is followed through each order on its own failures; no masks, sums of signs or closed forms.
OP13_SQL = r"""WITH RECURSIVE o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || letter FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter) WHERE strpos(filter_order, letter) = 0),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM d),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS ng, count(*) FILTER (WHERE toxic) AS nt FROM f GROUP BY 1, 2),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step:step] AS letter, left(filter_order, step - 1) AS past FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(filter_order) = 5)),
x AS (SELECT *, strpos(fails, letter) > 0 AS own, len(list_intersect(string_split(fails, ''), string_split(past, ''))) > 0 AND past <> '' AND fails <> '' AS gone FROM g, s),
r AS (SELECT part, filter_order, step, letter, CAST(coalesce(sum(n) FILTER (WHERE NOT own AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE own AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE own AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE fails = letter), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(ng) FILTER (WHERE own AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(nt) FILTER (WHERE own AND NOT gone), 0) AS BIGINT) AS toxic_lost FROM x GROUP BY 1, 2, 3, 4)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r"""
