"""Tables by day, pushed ranges of time, and runs of the chain that don't read history."""

import datetime
import shutil

import pytest
from pyspark.sql import functions as F

from logloom.operators import windows as win
from logloom.plans.chain import AGGREGATE, STAGES, Chain
from logloom.sources import logs as src
from logloom.sources.days import DAY, DayTable, LogStore

from .test_chain import CFG, EVENT, events, rows

DAY0 = int(datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc).timestamp())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    """Ten days of logs with quiet nights."""
    path = str(tmp_path_factory.mktemp("events"))
    own = spark.createDataFrame(events(6000, 240), EVENT).where("hour(ts) >= 8")
    own.write.parquet(f"{path}/events.parquet")
    return src.from_events(spark, path)


def test_range_reaches_the_scan(spark, tmp_path):
    """Both bounds are pushed for times with and without a zone, and the rows are those of the computed filter."""
    for kind in ("timestamp_ntz", "timestamp"):
        d = f"{tmp_path}/{kind}"
        spark.createDataFrame(events(500, 48), EVENT).withColumn("ts", F.col("ts").cast(kind)).write.parquet(f"{d}/events.parquet")
        start, end = DAY0 + 7200, DAY0 + 90_001
        got = src.from_events(spark, d, start, end)
        pushed = plan(got).split("PushedFilters: ")[1].split("]")[0]
        assert "GreaterThanOrEqual(ts," in pushed and "LessThan(ts," in pushed
        assert rows(got) == rows(src.filtered(src.from_events(spark, d), start, end)) and 0 < got.count() < 500


def test_store_prunes_days_and_row_groups(spark, logs, tmp_path):
    store = LogStore(spark, f"{tmp_path}/logs", logs.schema)
    assert store.read().count() == 0
    half = logs.where(F.col("ts") < DAY0 + 5 * DAY)
    for _ in range(2):  # the second time replaces the first
        store.append(half, 0)
    store.append(logs.where(F.col("ts") >= DAY0 + 5 * DAY), 1)
    assert rows(store.read()) == rows(logs) and rows(store.read(batch=0)) == rows(half)
    got = store.read(DAY0 + 3 * DAY + 50_000, DAY0 + 4 * DAY + 100)
    text = plan(got)
    assert "day" in text.split("PartitionFilters: ")[1].split("]")[0] and f"GreaterThanOrEqual(ts,{DAY0 + 3 * DAY + 50_000}), LessThanOrEqual(ts,{DAY0 + 4 * DAY + 100})" in text
    assert rows(got) == rows(src.filtered(logs, DAY0 + 3 * DAY + 50_000, DAY0 + 4 * DAY + 100)) and got.count() > 0
    for f in store.read().inputFiles():  # sorted by time inside each file
        ts = [r.ts for r in spark.read.parquet(f).collect()]
        assert ts == sorted(ts)


def test_replacing_from_a_moment(spark, tmp_path):
    frame = lambda ts, v: spark.createDataFrame([(t, v) for t in ts], "at bigint, v string")
    table = DayTable(spark, f"{tmp_path}/t", frame([], "").schema, "at")
    assert table.read().count() == 0
    table.replace(frame([1, DAY + 1, DAY + 5, 2 * DAY, 3 * DAY], "a"))
    for _ in range(2):
        table.replace(frame([DAY + 4, 3 * DAY + 7], "b"), DAY + 3)
        assert sorted((r.at, r.v) for r in table.read().collect()) == [(1, "a"), (DAY + 1, "a"), (DAY + 4, "b"), (3 * DAY + 7, "b")]
    # Rows of the table itself, and none at all.
    table.replace(table.read(DAY).withColumn("v", F.lit("c")), DAY)
    assert sorted((r.at, r.v) for r in table.read(DAY + 2).collect()) == [(DAY + 4, "c"), (3 * DAY + 7, "c")]
    table.replace(frame([], ""), DAY)
    assert [r.at for r in table.read().collect()] == [1]


def test_later_runs_need_no_old_days(spark, logs, tmp_path):
    """With all days gone that lie behind what a run may look back to, it ends and gives the same rows."""
    whole = Chain(spark, f"{tmp_path}/whole", CFG, set(src.EDGES)).run(logs)
    chain = Chain(spark, f"{tmp_path}/parts", CFG, set(src.EDGES))
    for k, end in enumerate((8 * DAY, 9 * DAY)):
        chain.write(logs.where((F.col("ts") < DAY0 + end) & (F.col("ts") >= DAY0 + (end - DAY if k else 0))), k)
    before = {s: rows(chain.table(s)) for s in STAGES}
    for day in range(DAY0 // DAY, DAY0 // DAY + 5):
        for name in ("logs", "windows", "anomalies", "alerts"):
            shutil.rmtree(f"{tmp_path}/parts/{name}/day={day}", ignore_errors=True)
    chain.write(logs.where(F.col("ts") >= DAY0 + 9 * DAY), 2)
    for stage in STAGES:
        time = next((c for c in ("window_start", "start") if c in whole[stage].columns), None)
        late = (lambda df: df.where(F.col(time) >= DAY0 + 5 * DAY)) if time else lambda df: df
        assert rows(late(chain.table(stage))) == rows(late(whole[stage])), stage
    assert rows(chain.table("windows")) != before["windows"]


def test_chain_goes_on_only_when_windows_closed(spark, logs, tmp_path):
    chain = Chain(spark, str(tmp_path), CFG, set(src.EDGES))
    own = logs.where(F.col("ts") < DAY0 + 3 * DAY)
    chain.write(own, 0)
    before = chain._runs().where("stage = 'incidents'").count()
    chain.write(own.where(F.col("ts") >= DAY0 + 3 * DAY - 30), 1)  # nothing new ends
    chain.write(own.limit(0), 2)
    assert chain._runs().where("stage = 'incidents'").count() == before == 1
    assert {r.number for r in chain._runs().where("stage = 'run'").collect()} == {0, 1, 2}


def test_windows_of_a_long_pause_come_in_bounded_runs(spark, logs, tmp_path):
    names = ["service", "size", "window_start", "request_count", "p95_latency_ms"]
    chain, whole = Chain(spark, str(tmp_path), CFG, set(src.EDGES), most=500), win.metric_windows(logs, CFG)
    counts = []
    while True:
        chain.run(logs, AGGREGATE)
        n = chain.table("windows").groupBy("service", "size").count().agg(F.max("count")).first()[0]
        if counts and n == counts[-1]:
            break
        counts.append(n)
    assert counts == [500, 1000, *counts[2:]] and all(b - a <= 500 for a, b in zip(counts, counts[1:])) and len(counts) >= 3
    assert rows(chain.table("windows").select(names)) == rows(whole.select(names))
