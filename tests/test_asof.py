"""Attributes as of an event: against brute force, and at the edges."""

import random

from tidemark.operators.asof import attributes_as_of, cumulative_versions
from tidemark.operators.running import running, within_spans

EVENTS = "scope string, entity string, p long, event_rec long, key string"
ATTRS = "scope string, entity string, key string, p long, ord long, attr_rec long, event_rec long"


def brute(events, attrs):
    out = set()
    for scope, entity, p, rec in {e[:4] for e in events if None not in e[:3]}:
        best = {}
        for s, e, k, q, o, r in {a[:6] for a in attrs if None not in a[:4]}:
            if (s, e) == (scope, entity) and q <= p:
                best[k] = max(best.get(k, (-1, -1, -1)), (q, -1 if o is None else o, r))
        out |= {(rec, scope, entity, k, b[2]) for k, b in best.items()}
    return out


def test_against_brute_force_with_hot_entity_ties_nulls_and_repeats(spark):
    rnd = random.Random(3)
    some = lambda x: None if rnd.random() < 0.05 else x
    events = [(some("s"), some(rnd.choice(["hot", "hot", "a", "b"])), some(rnd.randrange(400)), i, "clash") for i in range(120)]
    attrs = [(some("s"), some(rnd.choice(["hot", "hot", "a"])), some(rnd.choice("xyz")), some(rnd.randrange(400)), some(rnd.randrange(3)), 1000 + i, -1) for i in range(200)]
    events, attrs = events + events[:10], attrs + attrs[:10]
    for stretch in (7, 1000):
        got = attributes_as_of(spark.createDataFrame(events, EVENTS), spark.createDataFrame(attrs, ATTRS), stretch=stretch).collect()
        assert len(got) == len(set(map(tuple, got)))
        assert set(map(tuple, got)) == brute(events, attrs)


def test_never_later_and_empty_tables(spark):
    events = spark.createDataFrame([("s", "a", 10, 1, "")], EVENTS)
    later = spark.createDataFrame([("s", "a", "k", 11, 0, 5, 0)], ATTRS)
    assert attributes_as_of(events, later).count() == 0
    assert attributes_as_of(events.limit(0), later).count() == 0
    assert attributes_as_of(events, later.limit(0)).count() == 0


def test_versions_count_changes_across_stretches(spark):
    rows = spark.createDataFrame([("e", p, int(p % 3 == 0), p) for p in range(50)], "entity string, p long, change int, rec long")
    got = {r.rec: r.version for r in cumulative_versions(rows, ["entity"], "p", ["rec"], "change", stretch=4).collect()}
    assert got == {p: p // 3 + 1 for p in range(50)}


def test_running_maximum_and_spans(spark):
    values = [5, 1, 7, 2, 9, 3]
    rows = spark.createDataFrame([("e", i, v) for i, v in enumerate(values)], "entity string, i long, v long")
    from pyspark.sql import functions as F

    got = {r.i: r.m for r in running(rows, ["entity"], "i", [], "v", "m", F.max, stretch=2, inclusive=False).collect()}
    assert got == {0: None, 1: 5, 2: 5, 3: 7, 4: 7, 5: 9}
    points = spark.createDataFrame([("b", 0), ("b", 10), ("b", 99), (None, 5), ("b", None)], "scope string, x long")
    spans = spark.createDataFrame([("b", 0, 10, "one"), ("b", 10, 90, "two"), ("b", 20, 20, "empty")], "scope string, s long, e long, name string")
    assert {(r.x, r.name) for r in within_spans(points, spans, "scope", "x", "s", "e", width=8).collect()} == {(0, "one"), (10, "two")}
