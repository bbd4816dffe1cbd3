"""Clustering in parts and segments, and pairs of alerts from classes of traces, against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from logloom.config import Config
from logloom.functions.scalar import SEVERITIES
from logloom.operators import alerts, incidents
from logloom.sources import logs as src

CFG = Config()


def frame(spark, rows):
    return spark.createDataFrame([(i, s, "latency_spike", a, b, sev, 1.0, 0.0, [f"n{i}"]) for i, s, a, b, sev in rows], alerts.ALERT).repartition(3)


def steady(rng, n, services, step):
    """Alerts without a gap in time."""
    out, at = [], 0
    for k in range(n):
        at += rng.randrange(step)
        out.append((f"a{k:04}", rng.choice(services), at, at + rng.randrange(60, 600, 30), rng.choice(SEVERITIES)))
    return out


def pairs_of(spark, rng, rows):
    """Some alerts made duplicates of an earlier one."""
    got, used = [], set()
    for a, b in itertools.pairwise(rows):
        if rng.random() < 0.2 and a[0] not in used:
            got.append((a[0], b[0], "shared_trace_id"))
            used |= {a[0], b[0]}
    return got, spark.createDataFrame(got, "canonical string, duplicate string, reason string")


def by_one_fold(rows, pairs, adjacent):
    head = {b: a for a, b, _ in pairs}
    by, open_ = {r[0]: r for r in rows}, []
    for c in sorted((r for r in rows if r[0] not in head), key=lambda r: (r[2], r[0])):
        mine = sorted((r for r in rows if head.get(r[0], r[0]) == c[0]), key=lambda r: (r[2], r[0]))
        incidents.attach(open_, {"id": c[0], "start": c[2], "end": c[3], "alerts": [(r[0], r[1], r[3], SEVERITIES.index(r[4])) for r in mine]}, incidents.neighbours(adjacent), CFG)
    return sorted((i["id"], a, i["start"], i["end"], SEVERITIES[i["rank"]], sorted(i["services"])) for i in open_ for a in i["alerts"] if by[a])


@pytest.mark.parametrize("segment", [CFG.incident_max, 4 * CFG.incident_max, None])
def test_segments_of_a_stretch_equal_one_fold(spark, segment):
    rng = random.Random(segment)
    rows = steady(rng, 150, src.SERVICES, 120)
    plain, pairs = pairs_of(spark, rng, rows)
    got = incidents.cluster(frame(spark, rows), pairs, set(src.EDGES), CFG, segment)
    assert sorted(map(tuple, got.collect())) == by_one_fold(rows, plain, set(src.EDGES))
    own = incidents.folds(frame(spark, rows), pairs, set(src.EDGES), CFG, CFG.incident_max)
    assert own.select("part", "stretch", "segment").distinct().count() >= 8 > own.select("part", "stretch").distinct().count()


def test_parts_of_the_graph_are_folded_apart(spark):
    """Two pairs of services without an edge between them are two parts even when their alerts overlap in time."""
    rng, adjacent = random.Random(3), {("a", "b"), ("c", "d")}
    rows = steady(rng, 80, "abcd", 100)
    plain, pairs = [], spark.createDataFrame([], "canonical string, duplicate string, reason string")
    own = incidents.folds(frame(spark, rows), pairs, adjacent, CFG, 10**9)
    assert own.select("part").distinct().count() == 2
    got = incidents.cluster(frame(spark, rows), pairs, adjacent, CFG)
    assert sorted(map(tuple, got.collect())) == by_one_fold(rows, plain, adjacent)
    assert incidents.cluster(frame(spark, rows).limit(0), pairs, adjacent, CFG).count() == 0


@pytest.mark.parametrize("lane", [600, 7])
def test_hot_traces_make_few_pairs(spark, monkeypatch, lane):
    """One trace is in every log, many others hold the same alerts; each edge is made once or twice."""
    monkeypatch.setattr(alerts, "_LANE", lane)
    monkeypatch.setattr(alerts, "_BITS", 60 if lane == 600 else 3)
    rng = random.Random(5)
    rows = steady(rng, 60, src.SERVICES, 300)
    logs = [(s, f"t{k}", t) for _, s, a, b, _ in rows for k in (0, *range(10, 40), *rng.sample(range(100, 130), 3)) for t in (a, (a + b) // 2)]
    frames = frame(spark, rows), spark.createDataFrame(logs, "service string, trace_id string, ts bigint").repartition(3)
    held = {r[0]: {t for s, t, at in logs if s == r[1] and r[2] <= at <= r[3]} for r in rows}
    near = lambda a, b: b[2] <= a[3] + CFG.dedup_trace and b[3] >= a[2] - CFG.dedup_trace
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    expected = {(a[0], b[0]) for a, b in itertools.combinations(order, 2) if a[1] != b[1] and near(a, b) and held[a[0]] & held[b[0]]}
    pairs = alerts.shared_trace_pairs(*frames, CFG)
    assert {(r.a, r.b) for r in pairs.collect()} == expected == {(r.a, r.b) for r in alerts.shared_trace_edges(*frames, CFG).collect()}
    if lane == 600:
        assert pairs.count() <= 2 * len(expected)
        assert alerts.alert_traces(*frames, 600).groupBy("trace_id").count().where(F.col("count") > 20).count() > 30
