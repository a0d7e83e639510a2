"""Tables that change together: nothing of a change is seen before all of it; the clean-up of all tables; trust and rules."""

import pytest
from pyspark.sql import functions as F

from vetspan.operators import correspondents, maintenance, reputation
from vetspan.sources.tables import Snapshots

NOW, DAY = 1_000 * 86_400_000, 86_400_000


@pytest.fixture
def snapshots(spark, tmp_path):
    made = Snapshots(spark, f"file://{tmp_path}/state")
    made.publish({
        "reputation": spark.createDataFrame([(1, "a", None, None, 0, NOW), (2, "b", "short", NOW - 1, 0, NOW), (3, "c", "repeat", NOW - 1, 0, NOW), (4, "d", "repeat", NOW + 1, 0, NOW)], "id long, ip string, block_level string, blocked_until_ms long, legitimate_count int, last_activity_at_ms long"),
        "strikes": spark.createDataFrame([(1, "b", NOW - DAY), (2, "c", NOW - DAY), (3, "d", NOW - 90 * DAY)], "id long, ip string, struck_at_ms long"),
        "correspondents": spark.createDataFrame([(i, f"l{i % 3}@in", f"c{i}@out", NOW, NOW - i * DAY, "manual", 0) for i in range(6)], "id long, local_address string, correspondent string, learned_at_ms long, last_activity_at_ms long, whitelist_type string, legitimate_email_count int"),
        "rejections": spark.createDataFrame([(1, "s", "x", NOW - 40 * DAY, "r"), (2, "s", "x", NOW, "r")], "id long, sender string, subject string, rejected_at_ms long, reason string"),
        "rejection_recipients": spark.createDataFrame([(1, "p"), (2, "p"), (2, "q")], "rejection_id long, recipient string"),
        "domains": spark.createDataFrame([(i, f"d{i}", NOW, NOW + (i - 35) * DAY) for i in range(10)], "id long, domain string, registered_at_ms long, expires_at_ms long"),
        "blocklist": spark.createDataFrame([(1, "l0@in", 1, "c9@out", NOW + DAY), (2, "*", 2, "out", NOW + DAY), (3, "l1@in", 1, "x@out", NOW - 1)], "id long, recipient string, sender_kind int, sender_value string, expires_at_ms long"),
    })
    return made


def sizes(tables):
    return {n: t.count() for n, t in tables.items()}


def test_clean_up_of_all_tables(snapshots):
    policy = maintenance.Retention(reputation.ReputationPolicy(), correspondents.TrustPolicy(capacity=4))
    counts = maintenance.clean_snapshot(snapshots, policy, NOW)
    assert counts == {"reputation": (2, 2), "strikes": (2, 1), "correspondents": (2, 4), "rejections": (1, 1), "rejection_recipients": (1, 2), "domains": (5, 5), "blocklist": (1, 2)}
    assert {n: left for n, (_, left) in counts.items()} == sizes(snapshots.read())
    assert sizes(snapshots.read(1))["domains"] == 10  # the version before can still be read
    assert {r.ip for r in snapshots.read()["reputation"].collect()} == {"b", "d"}
    assert maintenance.clean_snapshot(snapshots, policy, NOW)["domains"] == (0, 5)


def test_one_failing_part_keeps_no_other_back(snapshots):
    with snapshots.change() as t:
        t["domains"] = t["domains"].drop("expires_at_ms")
    with pytest.raises(RuntimeError, match="domains"):
        maintenance.clean_snapshot(snapshots, maintenance.Retention(), NOW)
    assert sizes(snapshots.read())["blocklist"] == 2 and sizes(snapshots.read())["domains"] == 10


def test_a_job_that_dies_between_two_writes_changes_nothing(snapshots, spark):
    before, version = sizes(snapshots.read()), snapshots.versions()[-1]
    broken = snapshots.read()["rejection_recipients"].withColumn("recipient", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        snapshots.publish({"rejections": snapshots.read()["rejections"].limit(0), "rejection_recipients": broken})
    assert sizes(snapshots.read()) == before and snapshots.versions() == [version]
    with pytest.raises(ZeroDivisionError):
        with snapshots.change() as t:
            t["rejections"] = t["rejections"].limit(0)
            raise ZeroDivisionError
    assert sizes(snapshots.read()) == before
    removed = snapshots.vacuum()
    assert len(removed) >= 1 and sizes(snapshots.read()) == before


def test_two_writers_of_one_version(snapshots):
    table = snapshots.read()["domains"]
    snapshots.publish({"domains": table.limit(1)}, based_on=1)
    with pytest.raises(RuntimeError, match="another writer"):
        snapshots.publish({"domains": table.limit(2)}, based_on=1)
    assert sizes(snapshots.read())["domains"] == 1


def test_rejections_and_recipients_are_added_at_once(snapshots, spark):
    new = spark.createDataFrame([(7, "s", "x", NOW, "r", ["u", "v", "u"]), (8, "s", "x", NOW, "r", [])], "id long, sender string, subject string, rejected_at_ms long, reason string, recipients array<string>")
    version = maintenance.add_rejections(snapshots, new)
    found = snapshots.read(version)
    assert sizes(found)["rejections"] == 4 and found["rejection_recipients"].filter("rejection_id = 7").count() == 2
    assert sizes(snapshots.read(version - 1))["rejections"] == 2


def test_trust_and_rules_take_each_other_away(snapshots, spark):
    kinds = snapshots.read()["blocklist"].schema
    rules = spark.createDataFrame([(10, "l1@in", 1, "c1@out", NOW + DAY), (11, "*", 1, "c2@out", NOW + DAY), (12, "l0@in", 2, "out", NOW + DAY), (13, "l2@in", 1, "c0@out", NOW + DAY)], kinds)
    maintenance.block_senders(snapshots, rules, NOW)
    assert sorted(r.correspondent for r in snapshots.read()["correspondents"].collect()) == ["c0@out", "c3@out", "c4@out", "c5@out"]
    trusted = spark.createDataFrame([(20, "l1@in", "c1@out", NOW, NOW, "manual", 0), (21, "l0@in", "c2@out", NOW, NOW, "manual", 0)], snapshots.read()["correspondents"].schema)
    maintenance.trust_senders(snapshots, trusted)
    left = {(r.recipient, r.sender_kind, r.sender_value) for r in snapshots.read()["blocklist"].collect()}
    assert ("l1@in", 1, "c1@out") not in left and {("*", 1, "c2@out"), ("l0@in", 2, "out"), ("l2@in", 1, "c0@out")} <= left
    assert snapshots.read()["correspondents"].count() == 6
