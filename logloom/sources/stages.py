"""Written stage tables: each stage of the chain is stored once and read by the later ones."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


@contextlib.contextmanager
def settings(spark: SparkSession, changed: dict[str, str]) -> Iterator[None]:
    """What is started inside, streams too, takes these settings; the session's own are put back."""
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def folder(spark: SparkSession) -> str:
    """A fresh folder in spark.checkpoint.dir. Where that is unset, a local one if Spark runs in this machine alone (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="logloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    spark = df.sparkSession
    path = path or folder(spark)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by keys to as many tasks as run at once: few bytes can be much work, and Spark would give them to one task."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        removed(t.sparkSession, t.stored_path)
