"""Root-cause features and a logistic ranker."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ("is_earliest", "earliest_seconds_gap", "blast_radius", "upstream_position", "anomaly_magnitude", "alert_count")


def features(members: DataFrame, alerts: DataFrame, reach: DataFrame, anomalies: DataFrame) -> DataFrame:
    """A row per incident and service; reach is the closure (upstream, reached) of the dependency graph."""
    own = members.select("incident_id", "alert_id").join(alerts.select("alert_id", "service", "start", "anomaly_ids"), "alert_id")
    first = own.groupBy("incident_id").agg(F.min(F.struct("start", "alert_id", "service")).alias("f"))
    per = own.groupBy("incident_id", "service").agg(F.count("*").alias("alert_count"), F.min("start").alias("own_start"))
    others = per.join(per.select("incident_id", F.col("service").alias("other"), F.col("own_start").alias("other_start")), "incident_id").where("service <> other")
    gap = others.groupBy("incident_id", "service").agg(F.min("other_start").alias("next_start"))
    hits = own.select("incident_id", "service", F.explode("anomaly_ids").alias("id")).join(anomalies.where("detector = 'mad'").select("id", "score"), "id")
    power = hits.groupBy("incident_id", "service").agg(F.max(F.abs("score")).alias("anomaly_magnitude"))
    blast = reach.groupBy(F.col("upstream").alias("service")).agg(F.count("*").alias("blast_radius"))
    below = per.select("incident_id", "service").join(reach.withColumnRenamed("upstream", "service"), "service").join(per.select("incident_id", F.col("service").alias("reached")), ["incident_id", "reached"])
    below = below.groupBy("incident_id", "service").agg(F.count("*").alias("upstream_position"))
    key = ["incident_id", "service"]
    out = per.join(first, "incident_id").join(gap, key, "left").join(power, key, "left").join(blast, "service", "left").join(below, key, "left")
    earliest = F.col("f.service") == F.col("service")
    out = out.withColumn("is_earliest", F.when(earliest, 1.0).otherwise(0.0)).withColumn("earliest_seconds_gap", F.when(earliest & F.col("next_start").isNotNull(), F.greatest(F.lit(0), F.col("next_start") - F.col("f.start"))).otherwise(0).cast("double"))
    return out.select(*key, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES))


def train(rows: DataFrame, names: tuple[str, ...] = FEATURES, min_rows: int = 10, min_positive: int = 3):
    """Balanced logistic regression with C = 1 on rows with a 0/1 label column."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n, positive = rows.agg(F.count("*"), F.sum("label")).first()
    if n < min_rows or (positive or 0) < min_positive or positive == n:
        raise ValueError(f"training needs at least {min_rows} service candidates, {min_positive} of them causes and not all")
    weight = F.when(F.col("label") == 1, n / (2 * positive)).otherwise(n / (2 * (n - positive)))
    data = VectorAssembler(inputCols=list(names), outputCol="x").transform(rows.withColumn("w", weight).withColumn("label", F.col("label").cast("double")))
    return LogisticRegression(featuresCol="x", weightCol="w", standardization=False, regParam=1 / n, maxIter=1000, tol=1e-10).fit(data)


def labelled(rows: DataFrame, matches: DataFrame, truth: DataFrame) -> DataFrame:
    """Features of matched incidents with truth_id, is_cause and label: whether the service is the labelled root."""
    roots = matches.join(truth.select("truth_id", "root"), "truth_id").select("incident_id", "truth_id", "root")
    cause = F.col("service") == F.col("root")
    return rows.join(roots, "incident_id").withColumn("is_cause", cause).withColumn("label", cause.cast("int")).drop("root")


MODEL = "model string, created string, weights map<string,double>, intercept double"


def register(spark, path: str, name: str, weights: dict[str, float], intercept: float, created: str) -> None:
    """Adds a ranker to the registry, a table of models."""
    spark.createDataFrame([(name, created, weights, intercept)], MODEL).coalesce(1).write.mode("append").parquet(path)


def save(spark, path: str, name: str, model, created: str, names: tuple[str, ...] = FEATURES) -> None:
    """Adds a fitted ranker to the registry."""
    register(spark, path, name, dict(zip(names, map(float, model.coefficients))), float(model.intercept), created)


def load(spark, path: str, name: str) -> tuple[dict[str, float], float]:
    """Weights and intercept of the newest ranker of that name; one that isn't registered is an error."""
    row = spark.read.schema(MODEL).parquet(path).where(F.col("model") == name).orderBy(F.desc("created")).first()
    if row is None:
        raise ValueError(f"no model named {name} is registered")
    return row.weights, row.intercept


def rank(rows: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    """Probability, contributions and rank of each service in its incident."""
    z = F.lit(intercept)
    for n, w in sorted(weights.items()):
        z = z + F.lit(float(w)) * F.col(n)
    parts = F.map_from_arrays(F.array(*map(F.lit, weights)), F.array(*(F.round(F.lit(float(w)) * F.col(n), 6) for n, w in weights.items())))
    own = rows.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("contributions", parts)
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("score"), "service")))


def top_features(contributions, k: int = 3):
    """Names of the k features with the largest absolute contributions."""
    entries = F.transform(F.map_entries(contributions), lambda e: F.struct((-F.abs(e["value"])).alias("v"), e["key"].alias("k")))
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.replace(e["k"], F.lit("_"), F.lit(" ")))
