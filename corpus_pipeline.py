"""Corpus pipeline: quality filter, near-duplicate removal, removal of repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. Every row is a document of its own: one without a doc_id, or with one that other rows have, too,
comes behind all ids of single rows. Such rows are ordered by doc_id (nulls last) and the digests of their text and of their other columns, so
which of them stays doesn't depend on the order of rows, and rows that tie are equal. No stage returns more rows than it gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import table, written
from logloom.llm.op3_suffix_dedup import suffix_dedup
from logloom.llm.op7_quality import THRESHOLD, quality_scored, trained
from logloom.llm.op8_jaccard import jaccard_components
from logloom.llm.op9_pack import packed


KEY = "row key"
_PART = 33


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key that no other row has: doc_id, or for rows without one of their own consecutive numbers behind the largest id."""
    ids = docs.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.count("*").alias("rows"))
    top, found = ids.agg(F.max("doc_id"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull() | (F.col("rows") > 1), F.col("rows"))), F.lit(0))).first()
    plain = docs.withColumn(KEY, F.col("doc_id").cast("bigint"))
    if not found:
        return plain
    top = -1 if top is None else top
    if top + found >= 2**63 - 1:
        raise ValueError(f"no {found} numbers are left after doc_id {top} for the rows without one of their own")
    shared = written(ids.where("doc_id IS NOT NULL AND rows > 1").select(F.col("doc_id").alias(KEY)))
    other = plain.where("doc_id IS NULL").unionByName(plain.join(shared, KEY, "left_semi").select(plain.columns))
    plain = plain.where("doc_id IS NOT NULL").join(shared, KEY, "left_anti").select(plain.columns)
    # Digests keep what the driver samples for ranges small; the last key lets equal rows, whose order doesn't matter, go to several
    # tasks. Written first, since numbers by partition change when rows are read anew.
    rest = F.to_json(F.struct(*(c for c in docs.columns if c not in ("doc_id", "text"))))
    order = [F.col("doc_id").asc_nulls_last(), F.sha2(F.coalesce("text", F.lit("")), 256), F.sha2(rest, 256), F.monotonically_increasing_id()]
    rows = written(other.orderBy(*order).withColumn(KEY, F.monotonically_increasing_id()))
    part, begin, at = F.shiftright(KEY, _PART), [], top + 1
    for p, n in sorted(rows.groupBy(part.alias("p")).count().collect()):
        begin.append((p, at))
        at += n
    begin = docs.sparkSession.createDataFrame(begin, "`row part` bigint, `row begin` bigint")
    own = rows.join(F.broadcast(begin), part == F.col("row part"))
    own = own.withColumn(KEY, F.col("row begin") + F.col(KEY).bitwiseAND((1 << _PART) - 1))
    return plain.unionByName(own.select(plain.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier doesn't reject."""
    scored = quality_scored(docs, trained(spark, sf_dir, docs), score_col="quality score")
    return scored.where(F.col("quality score") >= THRESHOLD).drop("quality score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of linked ones: five-word shingles, similarity of 0.8 or more."""
    own = keyed(docs)
    found = jaccard_components(own, percent=80, words=5, id_col=KEY)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(KEY))
    return own.join(kept, KEY, "left_semi").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every 50-byte string that a document before holds, too; a character cut apart goes whole, all others stay."""
    own = keyed(docs)
    kept = suffix_dedup(own, id_col=KEY, texts=True).select(F.col("doc_id").alias(KEY), F.col("kept_text").alias("text"))
    rest = own.select([c for c in own.columns if c not in ("text", "n_chars")])
    out = rest.join(kept, KEY).withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packed(docs)


STAGES = [("quality", quality), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
