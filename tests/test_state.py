"""Keyed state against the batch operators: late and repeated rows, restarts, expiring counts, requests with rejects."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from logloom.config import Config
from logloom.operators import alerts, incidents
from logloom.sources import logs as src
from logloom.streaming import ingest, state

from .test_parallel import by_one_fold, frame, pairs_of, steady

CFG = Config()
ANOMALY = "id string, service string, anomaly_type string, window_start bigint, size bigint, severity string, observed double, baseline double"


def reader(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def fed(spark, path, df):
    df.coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.02)  # files are taken in the order of their times


def test_debounce_takes_late_and_repeated_rows(spark, tmp_path):
    rng, rows, at = random.Random(2), [], 10_000
    for k in range(200):
        at += rng.choice([0, 60, 60, 120, 900])
        rows.append((f"n{k:03}", rng.choice("ab"), rng.choice(["x", "y"]), at, rng.choice([60, 300]), rng.choice(["MEDIUM", "HIGH"]), float(k), 0.0))
    own = spark.createDataFrame(rows, ANOMALY)
    expected = sorted(map(tuple, alerts.debounce(own, CFG).collect()))
    cut, schema = rows[100][3], own.schema
    late = {r[0] for r in rows if cut - 250 <= r[3] < cut and rng.random() < 0.7}
    assert late
    batches = [
        [r for r in rows if r[3] < cut and r[0] not in late],
        [r for r in rows if r[3] < cut and r[3] >= cut - 600] + [r for r in rows if cut <= r[3] < cut + 4000],  # late ones and repeats
        [r for r in rows if r[3] >= cut + 3000],
    ]
    fed(spark, f"{tmp_path}/in", spark.createDataFrame(batches[0], schema))
    stream = reader(spark, f"{tmp_path}/in", schema)
    first = state.run_to_parquet(state.debounced(stream, CFG, 300), f"{tmp_path}/out")
    assert 0 < first.count() < len(expected)
    for batch in (*batches[1:], [(None, None, None, at + 10**6, None, None, None, None)]):
        fed(spark, f"{tmp_path}/in", spark.createDataFrame(batch, schema))
    got = state.run_to_parquet(state.debounced(stream, CFG, 300), f"{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == expected


def test_lifecycle_equals_clustering_after_restarts(spark, tmp_path):
    rng = random.Random(6)
    rows = steady(rng, 60, src.SERVICES, 300) + [(f"z{i}", s, a + 60_000, b + 60_000, v) for i, s, a, b, v in steady(rng, 30, src.SERVICES, 200)]
    plain, pairs = pairs_of(spark, rng, rows)
    groups = incidents.grouped(frame(spark, rows), pairs)
    end = max(r[3] for r in rows)
    part_of = state.parts(spark, set(src.EDGES), list(src.SERVICES))
    assert part_of.select("part").distinct().count() == 1
    seen = []
    for low, high in ((0, 4000), (4000, 60_500), (60_500, end + 1)):  # a restart behind each
        fed(spark, f"{tmp_path}/in", groups.where((F.col("start") >= low) & (F.col("start") < high)))
        stream = reader(spark, f"{tmp_path}/in", groups.schema)
        changes = state.run_to_parquet(state.lifecycle(stream, part_of, set(src.EDGES), CFG, 0), f"{tmp_path}/out")
        seen.append({r.status for r in state.current(changes).collect()})
    assert seen[0] >= {"open"} and seen[1] == {"open", "closed"}
    fed(spark, f"{tmp_path}/in", spark.createDataFrame([(None, end + 10**6, None, None, [], [])], groups.schema))
    changes = state.run_to_parquet(state.lifecycle(stream, part_of, set(src.EDGES), CFG, 0), f"{tmp_path}/out")
    now = state.current(changes)
    names = [x.split()[0] for x in incidents.INCIDENT.split(", ")]
    assert sorted(map(tuple, now.select(names).collect())) == by_one_fold(rows, plain, set(src.EDGES))
    assert now.where((F.col("status") != "closed") | (F.col("closed_at") != F.col("end") + CFG.close_gap)).count() == 0
    # An incident was open before it closed, and each alert closed once.
    assert changes.where("status = 'closed'").groupBy("alert_id").count().where("count > 1").count() == 0 and changes.where("status = 'open'").count() > 0


def test_groups_across_parts_are_refused(spark, tmp_path):
    part_of = state.parts(spark, {("a", "b")}, ["c"])
    assert {r.service: r.part for r in part_of.collect()} == {"a": "a", "b": "a", "c": "c"}
    joined = state.parts(spark, {("a", "b")}, ["c"], {("b", "c")})
    assert {r.part for r in joined.collect()} == {"a"}
    rows = frame(spark, [("x", "a", 0, 60, "HIGH"), ("y", "c", 0, 60, "HIGH")])
    groups = incidents.grouped(rows, spark.createDataFrame([("x", "y", "shared_trace_id")], "canonical string, duplicate string, reason string"))
    fed(spark, f"{tmp_path}/in", groups)
    stream = spark.readStream.schema(groups.schema).parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="several parts"):
        state.run_to_parquet(state.lifecycle(stream, part_of, {("a", "b")}, CFG, 0), f"{tmp_path}/out")


REQUEST = "id bigint, ts bigint, identity string"


def test_limits_of_windows_and_expiry(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, 60 * (k // 40) + rng.randrange(60), rng.choice(["k1", "k1", "k2", None])) for k in range(120)] + [(120, None, "k1")]
    for k in range(3):  # a window spreads over two files
        fed(spark, f"{tmp_path}/in", spark.createDataFrame([r for i, r in enumerate(rows) if min(i // 45, 2) == k], REQUEST))
    stream = reader(spark, f"{tmp_path}/in", REQUEST)
    got = state.run_to_parquet(state.rate_limited(stream, 7), f"{tmp_path}/out", idle=False)
    assert got.count() == 121 and got.where("retry_after = 60").count() == got.where("NOT allowed").count()
    per = got.where("window_start IS NOT NULL").groupBy("window_start", "identity_hash").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("denied"))
    want = state.decisions(spark.createDataFrame(rows, REQUEST), 7)
    assert sorted(map(tuple, per.collect())) == sorted(map(tuple, want.collect())) and want.agg(F.sum("denied")).first()[0] > 10
    # Inside a file, the earlier requests are the ones that pass.
    first = [r for r in rows[:40] if r[2] == "k1"]
    assert {int(r.id) for r in got.where("allowed").collect()} >= {r[0] for r in sorted(first, key=lambda r: (r[1], str(r[0])))[:7]}
    free = state.run_to_parquet(state.rate_limited(stream, 0), f"{tmp_path}/free", idle=False)
    assert free.where("allowed").count() == 121


def test_counts_expire_and_failures_let_through(spark, tmp_path):
    run = lambda: state.run_to_parquet(state.rate_limited(reader(spark, f"{tmp_path}/in", REQUEST), 2, ttl=1), f"{tmp_path}/out", idle=False)
    fed(spark, f"{tmp_path}/in", spark.createDataFrame([(k, 5, "k") for k in range(4)], REQUEST))
    assert sorted(r.allowed for r in run().collect()) == [False, False, True, True]
    time.sleep(1.5)
    fed(spark, f"{tmp_path}/in", spark.createDataFrame([(9, 6, "k")], REQUEST))
    assert [r.allowed for r in run().where("id = '9'").collect()] == [True]  # its count was dropped

    class Down:
        def exists(self):
            raise ConnectionError

    limiter = state._Limit(1, 60, 65)
    limiter.count = Down()
    row = lambda k: type("R", (), {"id": str(k), "at": 5})()
    assert [r.allowed for r in limiter.handleInputRows(("h", 0), [row(1), row(2)], None)] == [True, True]


class Counted:
    """A count as state has it, which notes the calls to it."""

    def __init__(self):
        self.n, self.calls = None, []

    def exists(self):
        self.calls.append("exists")
        return self.n is not None

    def get(self):
        self.calls.append("get")
        return (self.n,)

    def update(self, value):
        self.calls.append("update")
        self.n = value[0]


def test_a_count_is_read_and_written_once_for_many_requests():
    row = lambda k: type("R", (), {"id": str(k), "at": 1000 - k})()
    limiter = state._Limit(700, 60, 65)
    limiter.count = Counted()
    first = list(limiter.handleInputRows(("h", 960), (row(k) for k in range(500)), None))
    second = list(limiter.handleInputRows(("h", 960), (row(k) for k in range(500, 1000)), None))
    assert all(r.allowed for r in first) and sorted(int(r.id) for r in second if r.allowed) == list(range(800, 1000))
    assert limiter.count.n == 1000 and limiter.count.calls == ["exists", "update", "exists", "get", "update"]
    late = list(limiter.handleInputRows(("h", 960), iter([row(0)]), None))
    assert [(r.identity_hash, r.window_start, r.allowed, r.retry_after) for r in late] == [("h", 960, False, 60)]


def event(**changes):
    return {"timestamp": "2026-01-01T00:00:00Z", "service": " api-gateway ", "level": "INFO", "message": "request completed", "latency_ms": 42, "status_code": 200} | changes


def test_requests_and_rejects(spark, tmp_path):
    """Good requests leave logs with their metadata, others nothing but their text; a repeated micro-batch changes nothing."""
    good = {"events": [event(host="api-gateway-pod-1", region="us-west-2"), event(service="new-service", timestamp="2026-01-02T10:00:00+02:00")]}
    bad = ['{"events": [', "[]", '"text"', json.dumps({"events": []}), json.dumps({}), json.dumps({"events": [event()] * 1001}), json.dumps({"events": [event(), event(level="TRACE", status_code=99)]}), json.dumps({"events": [event(latency_ms="x")]})]
    lines = [json.dumps(good), "", *bad, json.dumps({"events": [event()] * 1000})]
    spark.createDataFrame([(x,) for x in lines[:5]], "value string").coalesce(1).write.text(f"{tmp_path}/in/a")
    spark.createDataFrame([(x,) for x in lines[5:]], "value string").coalesce(1).write.text(f"{tmp_path}/in/b")
    ingest.ingest(spark, f"{tmp_path}/in/*", f"{tmp_path}/out").awaitTermination()
    sinks = ingest.Ingest(spark, f"{tmp_path}/out")
    logs = sinks.store.read()
    assert logs.count() == 1002 and {r.service for r in logs.collect()} == {"api-gateway", "new-service"}
    one = logs.where("metadata IS NOT NULL").first()
    assert (one.metadata.host, one.metadata.region, one.service, one.ts) == ("api-gateway-pod-1", "us-west-2", "api-gateway", 1767225600)
    assert logs.where("service = 'new-service'").first().ts == 1767225600 + 86400 + 8 * 3600
    assert sorted(r.name for r in sinks.services().collect()) == ["api-gateway", "new-service"]
    found = {r.value: r.problems for r in sinks.rejects().collect()}
    assert set(found) == set(bad)
    assert [found[b][:2] for b in bad] == [["body"], ["body"], ["body"], ["events"], ["events"], ["events"], ["events.1.level", "events.1.status_code"], ["body"]]
    again = spark.createDataFrame([(x, "f") for x in lines[:2]], "value string, file string")
    for _ in range(2):
        sinks.write(again, 7)
    assert sinks.store.read().count() == 1004 and sinks.services().count() == 2


def test_broken_lines_keep_their_text(spark, tmp_path):
    spark.createDataFrame([(json.dumps(event()),), ('{"timestamp": "2026',), ("",)], "value string").write.text(f"{tmp_path}/x")
    rows = src.read_jsonl(spark, f"{tmp_path}/x")
    good, bad = src.validate(rows)
    assert good.count() == 1 and [(r._corrupt_record, r.problems[0]) for r in bad.collect()] == [('{"timestamp": "2026', "timestamp")]
