"""Keyed writes as DataFrame operations: newest row per key, insert where absent, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_first: tuple[str, ...] = ()) -> DataFrame:
    """Rows of new replace those of old with equal keys, but for the columns in keep_first."""
    rest = [c for c in old.columns if c not in keys]
    both = old.select("*", F.lit(0).alias("age")).unionByName(new.select("*", F.lit(1).alias("age")))
    pick = [(F.min_by(c, "age") if c in keep_first else F.max_by(c, "age")).alias(c) for c in rest]
    return both.groupBy(*keys).agg(*pick).select(old.columns)


def append_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with those rows of new whose keys it doesn't have."""
    return old.unionByName(new.join(old.select(keys), keys, "left_anti").select(old.columns))


def reconciled(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new and old by key in one full outer join: new's values (old's where new has none) and state.

    state: inserted, updated (a value differs), kept, or deleted for rows that new doesn't have.
    """
    rest = [c for c in new.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("was"))
    b = new.select(*keys, F.struct(*rest).alias("is"))
    state = F.when(F.col("was").isNull(), "inserted").when(F.col("is").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("is")), "kept").otherwise("updated")
    return a.join(b, keys, "full_outer").select(*keys, *(F.coalesce("is", "was")[c].alias(c) for c in rest), state.alias("state"))


def reconcile(old: DataFrame, new: DataFrame, keys: list[str], path: str) -> tuple[DataFrame, dict[str, int]]:
    """Writes what is to be kept of old and new to path, a fresh folder, in one pass that counts the states on its way."""
    seen = Observation()
    states = ("inserted", "updated", "kept", "deleted")
    rows = reconciled(old, new, keys).observe(seen, *(F.count_if(F.col("state") == s).alias(s) for s in states))
    out = rows.where("state <> 'deleted'").drop("state")
    out.write.mode("errorifexists").parquet(path)
    return out.sparkSession.read.schema(out.schema).parquet(path), {s: seen.get[s] for s in states}
