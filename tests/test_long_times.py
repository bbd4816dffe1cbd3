"""Work that grows with the length of time is dealt out: baselines, short stretches, days of tables, and logs in one pass."""

import statistics

from pyspark.sql import functions as F

from logloom.config import Config
from logloom.functions.scalar import SEVERITIES
from logloom.operators import alerts
from logloom.operators import windows as win
from logloom.sources.days import DAY, DayTable, LogStore

CFG = Config()


def test_baselines_of_one_long_history_are_several_tasks(spark):
    """Values across the borders of blocks are those of a plain version."""
    n, back = 2 * win._BLOCK + 300, CFG.baseline_windows
    count = lambda k: (k * 7919) % 101
    own = spark.createDataFrame([("a", 60, 60 * k, count(k), 0.5 if k % 3 else None, None) for k in range(n)], "service string, size bigint, window_start bigint, request_count bigint, exact_rate double, p95_latency_ms bigint")
    got = win.baselines(own, CFG)
    assert {*own.columns, "history"} < set(got.columns) and not {"place", "block"} & set(got.columns)
    assert got.where("request_count_median IS NOT NULL").groupBy(F.spark_partition_id()).count().count() > 1
    rows = sorted(got.collect(), key=lambda r: r.window_start)
    assert len(rows) == n
    for k, r in enumerate(rows):
        past = [count(j) for j in range(max(0, k - back), k)]
        m = statistics.median(past) if len(past) >= CFG.min_history else None
        mad = max(1.0, statistics.median(abs(v - m) for v in past)) if m is not None else None
        assert (r.window_start, r.history, r.request_count_median, r.request_count_mad) == (60 * k, len(past), m, mad)
        assert r.p95_latency_ms_median is None and (k < 5 or r.error_rate_median == 0.5)


def test_short_stretches_are_folded_together(spark):
    """They make the alerts of a plain fold over all anomalies in order, across the borders of what is folded together, too."""
    n = 2 * alerts._STRETCHES + 50
    rows = [(f"n{k:04}{j}", "a", "x", 5000 * k + 60 * j, 60, SEVERITIES[(k + j) % 3], float(k), 0.0) for k in range(n) for j in range(1 + k % 3)]
    own = spark.createDataFrame(rows, "id string, service string, anomaly_type string, window_start bigint, size bigint, severity string, observed double, baseline double")
    plain = []
    for i, _, _, at, size, severity, observed, _ in rows:
        longer = alerts.extended(plain[-1] if plain else None, i, at, size, severity, CFG)
        if longer is None:
            plain.append({"alert_id": "A|" + i, "start": at, "end": at + size, "rank": SEVERITIES.index(severity), "observed": observed, "anomaly_ids": [i]})
        else:
            plain[-1] = longer
    made = alerts.debounce(own, CFG)
    got = sorted((r.start, r.alert_id, r.end, r.severity, r.observed, r.anomaly_ids) for r in made.collect())
    assert got == [(a["start"], a["alert_id"], a["end"], SEVERITIES[a["rank"]], a["observed"], a["anomaly_ids"]) for a in plain] and len(got) == n


def test_many_days_are_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") * DAY).alias("at"), F.lit("a").alias("v"))
    table = DayTable(spark, f"{tmp_path}/t", rows.schema, "at")
    table.replace(rows)
    assert table.read().count() == 60
    # Listing them is a job of as many tasks as run at once.
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    spark.sparkContext.setJobGroup("listing", "")
    table.read()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("listing")
    stages = [spark.sparkContext.statusTracker().getStageInfo(s) for j in jobs for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert all(s.numTasks <= spark.sparkContext.defaultParallelism for s in stages)
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
    assert len({f.rsplit("/", 1)[1].split("-")[1] for f in table.read().inputFiles()}) > 1


def test_a_batch_of_logs_is_read_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    logs = spark.range(0, 3000, 1, 3).select((F.col("id") * 400).alias("ts"), F.lit("a").alias("service"))
    store = LogStore(spark, f"{tmp_path}/logs", logs.schema)
    store.append(logs.mapInPandas(counted, logs.schema), 0)
    assert seen.value == 3000 and store.read().count() == 3000
    assert len(store.read().inputFiles()) == 14  # a quiet day is one file
