"""Operators whose plans avoid one task for a hot key: capacities, running sums, rolling windows, alias chains."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vetspan.operators import correspondents, reputation, retention
from vetspan.operators.slices import Slicing, cut_hot_keys
from vetspan.sources import files


def last_of(rows, limit, weigh):
    """Rows from the end of the sorted list while the weights fit."""
    out, total = [], 0
    for r in sorted(rows, key=lambda r: [(v is not None, v or 0) for v in (*r[:2], weigh(r))], reverse=True):
        total += weigh(r)
        if total > limit:
            break
        out.append(r)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_keep_last(spark, seed):
    rng = random.Random(seed)
    spread = [3, 10**13, 1][seed]
    rows = [(rng.choice([None, 0, 1]), rng.randint(-spread, spread), rng.randint(0, 9), i) for i in range(400)]
    rows += rows[:50]
    table = spark.createDataFrame(rows, "rank int, at long, size int, id long").repartition(3)
    for limit in (0, 57, 200, 450):
        for most in (5, 100_000):
            got = retention.evict(table, limit, [F.col("rank"), F.col("at"), F.col("id")], sorted_rows=most)
            expected = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), r[1], r[3]))[max(len(rows) - limit, 0) :]
            assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected)), (limit, most)
            sized = retention.bytes_until(table, "size", limit, [F.col("rank"), F.col("at")], sorted_rows=most).collect()
            assert sorted((repr(r[0]), r[1], r[2]) for r in sized) == sorted((repr(r[0]), r[1], r[2]) for r in last_of(rows, limit, lambda r: r[2]))


def test_evict_of_equal_keys_ends(spark):
    table = spark.range(200_000).select(F.lit(5).alias("at"), (F.col("id") % 3).alias("id"))
    began = time.perf_counter()
    kept = retention.evict(table, 70_000, [F.col("at"), F.col("id")], sorted_rows=1000)
    assert {r.id: r["count"] for r in kept.groupBy("id").count().collect()} == {1: 3334, 2: 66_666}
    assert time.perf_counter() - began < 30
    assert retention.evict(table.limit(0), 5, [F.col("at")]).count() == 0


def test_no_unbounded_window(spark):
    plan = retention.bytes_until(spark.range(1000).withColumn("size", F.lit(1)), "size", 10, [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_rolling_strikes_of_a_hot_address(spark):
    rng = random.Random(3)
    policy = reputation.ReputationPolicy(window_ms=1000, repeat_strikes=50)
    rows = [(i, "hot" if rng.random() < 0.9 else rng.choice(["a", None]), rng.randint(-3000, 9000)) for i in range(3000)]
    rows += [(3000 + i, "hot", 77) for i in range(20)]
    table = spark.createDataFrame(rows, "id long, ip string, struck_at_ms long")
    expected = {}
    for i, ip, at in rows:
        expected[i] = min(50, sum(1 for j, other, t in rows if other == ip and at - 1000 < t and (t < at or (t == at and j <= i))))
    for width in (None, 1, 137, 10**6):
        got = reputation.rolling_strikes(table, policy, width)
        assert got.columns == [*table.columns, "strikes"]
        assert {r.id: r.strikes for r in got.collect()} == expected
    groups = table.filter("ip = 'hot'").groupBy(F.expr("struck_at_ms DIV 10")).count().agg(F.max("count")).first()[0]
    assert groups < 100  # of 2,700 rows


def test_alias_chains(spark):
    chain = [(f"A{i}", f"a{i + 1}") for i in range(700)]
    cycle = [("c1", "c2"), ("c2", "C3"), ("c3", "c1"), ("into", "c1"), ("self", "self")]
    aliases = spark.createDataFrame([*chain, *cycle, *chain[:5], (None, "x"), ("x", None)], "name string, target string")
    names = spark.createDataFrame([("a0",), ("A350",), ("a700",), ("c2",), ("into",), ("self",), ("free",), ("x",)], "name string")
    got = {r.name: r.owner for r in files.alias_owner(aliases, names).collect()}
    assert got == {"a0": "a700", "A350": "a700", "a700": "a700", "free": "free", "x": "x"}
    assert files.alias_owner(aliases.limit(0), names).count() == 8


ACTIONS = ["outbound", "manual", "delete", "remove", "advance", "refresh", "touch", "other"]


@given(st.lists(st.tuples(st.integers(0, 9), st.sampled_from(ACTIONS)), max_size=30), st.lists(st.integers(0, 30), max_size=4), st.integers(0, 3), st.sampled_from([0, 5, 12]))
@settings(max_examples=400, deadline=None)
def test_summaries_of_slices_equal_the_steps(gaps, cuts, needed, stale):
    policy = correspondents.TrustPolicy(min_messages=needed, stale_ms=stale)
    at, events, row = 0, [], None
    for gap, action in gaps:
        at += gap
        events.append((action, at))
        row = correspondents.step(row, action, at, policy)
    edges = [0, *sorted(cuts), len(events)]
    got = None
    for a, b in zip(edges, edges[1:]):
        part = correspondents.Summary(policy)
        for event in events[a:b]:
            part.add(*event)
        got = correspondents.Summary(policy).apply(part.packed(), got)
    assert got == row


def test_fold_of_a_hot_pair(spark):
    rng = random.Random(8)
    rows = [("l", "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), rng.randint(0, 4000), i, rng.choice(ACTIONS)) for i in range(4000)]
    table = spark.createDataFrame(rows, "local_address string, correspondent string, at_ms long, id long, action string").repartition(3)
    policy = correspondents.TrustPolicy(stale_ms=6)
    whole = correspondents.fold(table, policy)
    cut = correspondents.fold(table, policy, Slicing(least_rows=500, slices=16))
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, whole.collect()))
    assert correspondents.fold(table.limit(0), policy, Slicing(0)).count() == 0
    _, hot = cut_hot_keys(table, ["local_address", "correspondent"], "at_ms", Slicing(least_rows=500, slices=16))
    sizes = [r["count"] for r in hot.groupBy("correspondent", "__slice").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 400 and sum(sizes) == sum(r[1] == "hot" for r in rows)
