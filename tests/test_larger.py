"""Queries against their SQL on rows that only larger tables hold."""

import duckdb
import pytest

from vetspan import plans
from vetspan.operators import blocklist

FIRST = "TIMESTAMP '2024-01-02 03:04:05'"
#: Users 64,000 apart share an address; of these pairs one at most is blocked, so no order is left open.
USERS = f"SELECT k AS event_id, {FIRST} AS ts, u AS user_id, 'error' AS event_type, 1.0 AS value, '' AS props FROM (SELECT row_number() OVER () AS k, unnest([24819, 88819, 24837, 88837, 24839, 88839, 17, 64017, 30, 64030]) AS u)"
PARTS = "SELECT CAST(unnest([876919, 577981, 808354, 812284, 72023, 1]) AS BIGINT) AS p_partkey"
LINES = "SELECT 5 AS l_orderkey, k % 5 AS l_partkey, CAST(k AS INT) AS l_linenumber, 30.0 AS l_quantity, 59999.0 + k / 4 AS l_extendedprice, 0.07 AS l_discount FROM range(5, 8) t(k)"
ORDERS = "SELECT 5 AS o_orderkey, 10 AS o_custkey"
#: Messages about the limit of 40,000 bytes.
PAGES = "SELECT 700 * 385 + 2 * k AS page_id, 'http://a.example/' AS url, repeat('x', 39700 + CAST(k AS INT)) AS html FROM range(0, 300) t(k) WHERE (700 * 385 + 2 * k) % 3 = 0 AND (700 * 385 + 2 * k) % 5 = 0"


@pytest.mark.parametrize(
    "name, tables",
    [
        ("c6_ip_listing", {"events": USERS}),
        ("st4_st5_manual_blocks", {"events": USERS}),
        ("h24_h27_colour_distance", {"part": PARTS}),
        ("m16_image_selection", {"lineitem": LINES, "orders": ORDERS}),
        ("src13_m1_m2_archived_messages", {"pages": PAGES}),
    ],
)
def test_query(name, tables, spark, tmp_path):
    con = duckdb.connect()
    for table, rows in tables.items():
        con.sql(f"COPY ({rows}) TO '{tmp_path}/{table}.parquet'")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    found = con.sql(plans.oracle_sql()[name])
    rows = plans.queries()[name](spark, str(tmp_path)).select(found.columns).collect()
    assert len(rows) > 0 and sorted(map(tuple, rows), key=repr) == sorted(found.fetchall(), key=repr)


def test_trust_is_made_once(spark, data):
    """The conflicts read the trust five times; the join and grouping that make it are none of them."""
    files = plans.queries()["st21_conflicts_both_ways"](spark, data).inputFiles()
    assert files and all("/vetspan/trust-" in f for f in files)


def test_only_exact_rules_are_looked_up(spark):
    rules = spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 2, "x"), (3, "a", None, "x"), (4, "b", 1, "x"), (5, None, 1, "x"), (6, "a", 1, "x")], "id long, recipient string, sender_kind int, sender_value string")
    trust = spark.createDataFrame([("a", "x"), ("a", "x"), (None, "x")], "local_address string, correspondent string")
    left = blocklist.without_rules(rules, trust)
    assert left.columns == rules.columns and sorted(r.id for r in left.collect()) == [2, 3, 4, 5]
