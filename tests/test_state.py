"""Keyed state: the batch folds against a plain reading of the rules, and the stream against the batch fold."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vetspan.operators import correspondents, reputation, retention
from vetspan.operators.reputation import DAY, HOUR, AddressState, ReputationPolicy
from vetspan.streaming.reputation import reputation_stream

POLICY = ReputationPolicy(window_ms=5 * DAY, repeat_strikes=2, short_ms=HOUR, repeat_ms=3 * DAY, legitimate_per_strike=2)
EVENTS = [("a", 0, 1, "rejection"), ("a", 2 * HOUR, 2, "rejection"), ("b", 5, 3, "rejection"), ("b", HOUR, 4, "legitimate"), ("b", 2 * HOUR, 5, "legitimate"), ("c", 7, 6, "legitimate"), ("a", 3 * HOUR, 7, "attempt"), ("d", 9, 8, "rejection"), ("d", 9 + 6 * DAY, 9, "rejection")]


def expected(events, policy):
    states = {}
    for ip, at, id_, kind in sorted(events, key=lambda e: (e[1], e[2])):
        states.setdefault(ip, AddressState([])).apply(kind, at, id_, policy)
    return {(ip, s.level, s.until, len(s.strikes), s.legitimate, s.last) for ip, s in states.items() if s.known}


def frame(spark, events):
    return spark.createDataFrame(events, "ip string, at_ms long, id long, kind string")


def test_two_rejections_make_a_repeat_block():
    s = AddressState([])
    s.reject(0, 1, POLICY)
    assert (s.level, s.until) == ("short", HOUR)
    s.reject(2 * HOUR, 2, POLICY)
    assert (s.level, s.until, len(s.strikes)) == ("repeat", 2 * HOUR + 3 * DAY, 2)
    s.attempt(2 * HOUR + 2 * 60_000, POLICY)
    assert s.until == 2 * HOUR + 2 * 60_000 + 3 * DAY


def test_legitimate_evidence_takes_strikes_away():
    s = AddressState([])
    s.reject(0, 1, POLICY)
    s.legitimise(2 * HOUR, POLICY)
    assert (s.legitimate, len(s.strikes)) == (1, 1)
    s.legitimise(3 * HOUR, POLICY)
    assert not s.known


@given(st.lists(st.tuples(st.integers(0, 20), st.sampled_from(["rejection", "legitimate", "attempt"])), max_size=40))
@settings(max_examples=100, deadline=None)
def test_strikes_stay_bounded(steps):
    s, at = AddressState([]), 0
    for i, (gap, kind) in enumerate(steps):
        at += gap * HOUR
        s.apply(kind, at, i, POLICY)
        assert len(s.strikes) <= POLICY.repeat_strikes
        assert (s.level is None) == (s.until is None)
        assert s.strikes == sorted(s.strikes)


def test_batch_fold(spark):
    rows = reputation.fold(frame(spark, EVENTS), POLICY).collect()
    assert {tuple(r) for r in rows} == expected(EVENTS, POLICY)
    assert reputation.fold(frame(spark, []), POLICY).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    for part in (EVENTS[:4], EVENTS[4:]):
        frame(spark, sorted(part, key=lambda e: e[1])).coalesce(1).write.mode("append").json(str(source))
    events = spark.readStream.schema("ip string, at_ms long, id long, kind string").option("maxFilesPerTrigger", 1).json(str(source))
    query = reputation_stream(events, POLICY, late=None).writeStream.outputMode("update").format("memory").queryName("addresses").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    last = {}
    for r in spark.sql("SELECT * FROM addresses").collect():
        if r.ip not in last or r.last_activity_at_ms >= last[r.ip].last_activity_at_ms:
            last[r.ip] = r
    whole = {r.ip: r for r in reputation.fold(frame(spark, EVENTS), POLICY).collect()}
    assert {ip for ip in whole} <= set(last)
    assert last["a"].block_level == whole["a"].block_level == "repeat"
    assert last["a"].strikes == whole["a"].strikes


def test_dead_addresses_leave_the_stream(spark, tmp_path):
    source, rows = tmp_path / "in", []
    parts = [[(f"old{i}", i + 1, i, "rejection") for i in range(40)], [("live", 20 * DAY, 100, "rejection"), ("old7", 20 * DAY, 101, "rejection")], [("live", 20 * DAY + 1, 102, "attempt")], [("live", 21 * DAY, 103, "legitimate")]]
    for part in parts:
        frame(spark, part).coalesce(1).write.mode("append").json(str(source))
    events = spark.readStream.schema("ip string, at_ms long, id long, kind string").option("maxFilesPerTrigger", 1).json(str(source))
    query = reputation_stream(events, POLICY, "1 hour").writeStream.outputMode("update").format("memory").queryName("dying").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    query.stop()
    assert max(rows) >= 40 > 12 >= rows[-1]  # a state and a timer for each address that lives
    assert {r.ip for r in spark.sql("SELECT DISTINCT ip FROM dying").collect()} == {*(f"old{i}" for i in range(40)), "live"}


@pytest.mark.parametrize(
    ("row", "action", "result"),
    [
        (None, "advance", [9, 9, correspondents.INBOUND, 1]),
        ([0, 5, correspondents.INBOUND, 1], "advance", [0, 9, correspondents.INBOUND, 2]),
        ([0, 5, correspondents.INBOUND, 3], "advance", [0, 9, correspondents.INBOUND, 3]),
        ([0, 5, correspondents.INBOUND, 1], "refresh", [0, 5, correspondents.INBOUND, 1]),
        ([0, 5, correspondents.INBOUND, 3], "remove", None),
        ([0, 5, correspondents.MANUAL, 0], "remove", [0, 5, correspondents.MANUAL, 0]),
        ([0, 5, correspondents.INBOUND, 2], "outbound", [0, 9, correspondents.OUTBOUND, 0]),
        ([0, 5, correspondents.MANUAL, 0], "outbound", [0, 9, correspondents.MANUAL, 0]),
        (None, "touch", None),
    ],
)
def test_correspondent_steps(row, action, result):
    assert correspondents.step(row, action, 9, correspondents.TrustPolicy()) == result


def test_correspondent_fold(spark):
    events = [("l", "c", 1, 1, "advance"), ("l", "c", 2, 2, "advance"), ("l", "c", 3, 3, "advance"), ("l", "d", 1, 4, "advance"), ("l", "d", 2, 5, "remove")]
    df = spark.createDataFrame(events, "local_address string, correspondent string, at_ms long, id long, action string")
    assert [tuple(r) for r in correspondents.fold(df).collect()] == [("l", "c", 1, 3, correspondents.INBOUND, 3)]


def test_eviction_and_paging(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, i % 3) for i in range(10)], "id long, at long")
    for capacity in (0, 3, 8, 10, 20):
        left = retention.evict(rows, capacity, [F.col("at"), F.col("id")]).collect()
        assert sorted(r.id for r in left) == sorted(i for _, i in sorted((i % 3, i) for i in range(10))[max(10 - capacity, 0) :])
    page = retention.page(rows, [F.desc("id")], 4).collect()
    assert [r.id for r in page] == [9, 8, 7, 6] and all(r.truncated for r in page)


def test_upsert_takes_the_newest(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, v long, w string")
    new = spark.createDataFrame([("a", 1, "z"), ("b", 4, "q"), ("c", 1, "n")], "k string, v long, w string")
    assert {tuple(r) for r in retention.upsert(old, new, ["k"], "v").collect()} == {("a", 1, "z"), ("b", 5, "y"), ("c", 1, "n")}


def test_bytes_until_sums_per_key(spark):
    """Against a running sum over all rows, in groups, at every limit near an edge; no window stands over unsummed rows."""
    from pyspark.sql import functions as F

    files = [(d, i, (7 * i + (d or 0)) % 13) for d in (1, 2, 3, None, 5) for i in range(20)] + [(5, 99, None)]
    rows = spark.createDataFrame(files, "day long, id long, size long").repartition(3).cache()
    order = sorted(files, key=lambda f: (f[0] is not None, f[0] or 0, f[1]), reverse=True)
    for limit in (-1, 0, 5, 60, 120, 121, 300, 400, 10_000):
        want, total = set(), None
        for day, i, size in order:
            total = total if size is None else (total or 0) + size
            if total is not None and total <= limit:
                want.add((day, i))
        kept = retention.bytes_until(rows, "size", limit, [F.col("day"), F.col("id")])
        assert {(r.day, r.id) for r in kept.collect()} == want, limit
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert all("windowspecdefinition(__key" in w and "DESC" in w.split("windowspecdefinition(__key")[1] and ", day" in w or "sum(__size" in w for w in windows)


def test_first_addresses_hold_one_row_per_role(spark, data):
    from vetspan import plans

    plan = plans.queries()["t10_first_addresses"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "min(struct(turn" in plan and "collect_list(struct(turn" not in plan
