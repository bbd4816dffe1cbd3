"""Folds over alerts against independent versions that see all alerts at once, in plain Python."""

import random

import pytest

from logloom.config import Config
from logloom.operators import alerts, graph, incidents
from logloom.sources import logs as src

CFG = Config()


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(4), []
    for k in range(260):
        at = rng.choice([0, 4000, 9000]) + rng.randrange(0, 3000, 30)
        out.append((f"a{k:03}", rng.choice(src.SERVICES), rng.choice(["latency_spike", "error_rate_spike"]), at, at + rng.randrange(60, 600, 30), rng.choice(["MEDIUM", "HIGH", "CRITICAL"])))
    return out


@pytest.fixture(scope="module")
def own(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 0.0, [f"n{r[0]}"]) for r in rows], alerts.ALERT).repartition(3)


def joined(rows):
    """canonical of each alert: pairs in order, taken while the joint span allows."""
    order = sorted(rows, key=lambda r: (r[3], r[0]))
    group, links = {r[0]: [r] for r in rows}, []
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if a[1:3] == b[1:3] and b[3] <= a[4] + CFG.dedup_same and b[4] >= a[3] - CFG.dedup_same:
                links.append((a, b))
    for a, b in sorted(links, key=lambda x: (x[0][3], x[0][0], x[1][3], x[1][0])):
        x, y = group[a[0]], group[b[0]]
        both = x + y
        if x is not y and max(r[4] for r in both) - min(r[3] for r in both) <= CFG.dedup_span:
            for r in both:
                group[r[0]] = both
    return {i: min((r[3], r[0]) for r in g)[1] for i, g in group.items()}


def clustered(rows, canonical):
    """Sets of alerts that are one incident, group by group over all open incidents."""
    by, found = {r[0]: r for r in rows}, []
    touch = lambda a, b: a == b or (a, b) in src.EDGES or (b, a) in src.EDGES
    heads = sorted({c for c in canonical.values()}, key=lambda c: (by[c][3], c))
    for c in heads:
        mine = [by[i] for i in canonical if canonical[i] == c]
        s, e = by[c][3], by[c][4]
        fits = [f for f in found if s <= f["end"] + CFG.proximity and s >= f["start"] - CFG.proximity and e <= f["start"] + CFG.incident_max and any(touch(m[1], x) for m in mine for x in f["services"])]
        if not fits:
            fits = [{"id": c, "start": s, "end": e, "services": set(), "alerts": set()}]
            found += fits
        first, *others = sorted(fits, key=lambda f: (f["start"], f["id"]))
        for o in others:
            first["alerts"] |= o["alerts"]
            first["services"] |= o["services"]
            first["start"], first["end"] = min(first["start"], o["start"]), max(first["end"], o["end"])
            found.remove(o)
        first["alerts"] |= {m[0] for m in mine}
        first["services"] |= {m[1] for m in mine}
        first["end"] = max([first["end"], *(m[4] for m in mine)])
    return {(frozenset(f["alerts"]), f["start"], f["end"], tuple(sorted(f["services"]))) for f in found}


def test_duplicates_and_incidents(spark, rows, own):
    pairs = alerts.duplicates(own, alerts.same_service_edges(own, CFG), CFG)
    canonical = joined(rows)
    got = {p.duplicate: p.canonical for p in pairs.collect()}
    assert got == {i: c for i, c in canonical.items() if i != c} and len(got) > 50
    assert {r.alert_id for r in alerts.canonical(own, pairs).collect()} == set(canonical.values())
    parts = {}
    for r in incidents.cluster(own, pairs, set(src.EDGES), CFG).collect():
        parts.setdefault((r.incident_id, r.start, r.end, tuple(r.services)), set()).add(r.alert_id)
    assert {(frozenset(a), s, e, v) for (_, s, e, v), a in parts.items()} == clustered(rows, canonical)


def test_long_paths_and_cycles(spark):
    chain = [(f"n{k:02}", f"n{k + 1:02}") for k in range(40)]
    edges = spark.createDataFrame([*chain, ("x", "y"), ("y", "z"), ("z", "x")], "upstream string, downstream string")
    got = {}
    for r in incidents.closure(edges).collect():
        got.setdefault(r.upstream, set()).add(r.reached)
    assert len(got["n00"]) == 40 and len(got["n39"]) == 1 and got["x"] == {"y", "z"}
    parts = {r.node: r.component for r in graph.components(edges.toDF("a", "b")).collect()}
    assert set(parts.values()) == {"n00", "x"} and len(parts) == 44
    with pytest.raises(ValueError, match="unknown service"):
        src.linked(edges, spark.createDataFrame([("x",)], "name string"), "x", "nobody")


def test_guards_of_dependencies(spark):
    known = src.services(spark)
    edges = spark.createDataFrame(list(src.EDGES), "upstream string, downstream string")
    with pytest.raises(ValueError, match="itself"):
        src.linked(edges, known, "api-gateway", "api-gateway")
    with pytest.raises(ValueError, match="already"):
        src.linked(edges, known, *src.EDGES[0])
    assert src.linked(edges, known, "payment-service", "inventory-service").count() == len(src.EDGES) + 1


def test_every_rule_of_an_event(spark):
    ok = {"timestamp": "2024-01-01T00:00:00Z", "service": "a", "level": " INFO\t", "message": "m", "request_id": None, "trace_id": "00000000-0000-4000-8000-000000000001", "latency_ms": 0, "status_code": 100, "host": "h" + " " * 300, "region": None}
    bad = [("timestamp", "soon"), ("timestamp", None), ("service", " \t\n"), ("service", "s" * 256), ("service", None), ("level", None), ("level", "TRACE"), ("message", "\t\n "), ("message", "m" * 4097), ("request_id", "7"), ("trace_id", "x-1"), ("latency_ms", -1), ("status_code", 99), ("status_code", 600), ("host", "h" * 256), ("region", "r" * 65)]
    rows = spark.createDataFrame([tuple({**ok, f: v}.values()) for f, v in [("region", None), *bad]], src.LOG_SCHEMA)
    good, broken = src.validate(rows)
    assert [(r.level, r.host) for r in good.collect()] == [("INFO", "h")]
    assert sorted(tuple(r.problems) for r in broken.collect()) == sorted((f,) for f, _ in bad)


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_components_of_chains_and_random_edges(spark, coalesced):
    """One partition ends with its forest; several need star passes."""
    rng, name = random.Random(5), "spark.sql.adaptive.coalescePartitions.enabled"
    chain = [(i, i + 1) for i in range(60) if i != 30]
    for links in (chain, [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(50)], []):
        root = {x: x for link in links for x in link if link[0] != link[1]}
        for _ in root:
            for a, b in links:
                if a != b:
                    root[a] = root[b] = min(root[a], root[b])
        spark.conf.set(name, coalesced)
        try:
            got = graph.components(spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in links], "a string, b string")).collect()
        finally:
            spark.conf.unset(name)
        assert sorted(tuple(r) for r in got) == sorted((f"n{x:03}", f"n{r:03}") for x, r in root.items())
