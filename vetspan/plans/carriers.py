"""State tables and messages carried by the TPC-H-like driver tables, so that every operator has rows to work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000
#: The clock of the queries: 31 January 2024 for events, 1 January 1999 for orders (Unix milliseconds).
EVENTS_NOW = 1_706_659_200_000
ORDERS_NOW = 915_148_800_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


STEP = "CAST(floor(event_id / 10) AS BIGINT)"
OUTCOME = f"""CASE CAST(1 + event_id % 10 AS INT)
  WHEN 1 THEN 1 + {STEP} % 4
  WHEN 2 THEN 2 + 2 * ({STEP} % 2) WHEN 5 THEN 2 + 2 * ({STEP} % 2) WHEN 6 THEN 2 + 2 * ({STEP} % 2)
  WHEN 3 THEN 1 + 3 * ({STEP} % 2) WHEN 4 THEN 1 + 3 * ({STEP} % 2)
  WHEN 7 THEN 1 + {STEP} % 2
  ELSE CASE {STEP} % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END END"""
#: Columns of `activity` over `events` besides occurred_at_ms, in words that Spark and DuckDB share.
ACTIVITY = {
    "id": "event_id",
    "event_type": "CAST(1 + event_id % 10 AS INT)",
    "outcome": f"CAST({OUTCOME} AS INT)",
    "analysis_failed": f"CASE WHEN event_id % 10 = 0 THEN {STEP} % 7 = 0 END",
    "token_cost": "CASE WHEN event_id % 10 = 0 THEN value / 1000 END",
    "quantity": "CASE WHEN event_id % 10 = 6 THEN 1 + event_id % 3 ELSE 1 END",
}


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(millis("ts").alias("occurred_at_ms"), *[F.expr(e).alias(n) for n, e in ACTIVITY.items()])


def ip_text(column: str) -> str:
    return f"concat('198.51.', CAST(CAST(floor({column} / 250) AS BIGINT) % 256 AS STRING), '.', CAST({column} % 250 AS STRING))"


def ip_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ip, at_ms, id, kind: rejections (events of type error) and legitimate evidence (signup), an address per user."""
    events = table(spark, sf_dir, "events").filter("event_type IN ('error', 'signup')")
    return events.select(F.expr(ip_text("user_id")).alias("ip"), millis("ts").alias("at_ms"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "rejection").otherwise("legitimate").alias("kind"))


def strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ip_events(spark, sf_dir).filter("kind = 'rejection'").select("id", "ip", F.col("at_ms").alias("struck_at_ms"))


def reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per user: level null, short or repeat by turns; blocks end within ten days about the clock."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(millis("ts")).alias("last_activity_at_ms"))
    until = f"CASE WHEN user_id % 3 = 0 THEN NULL ELSE {EVENTS_NOW} + (user_id % 20 - 10) * {DAY} END"
    level = "CASE user_id % 3 WHEN 1 THEN 'short' WHEN 2 THEN 'repeat' END"
    return users.select(F.col("user_id").alias("id"), F.expr(ip_text("user_id")).alias("ip"), F.expr(level).alias("block_level"), F.expr(until).cast("long").alias("blocked_until_ms"), F.expr("CAST(user_id % 4 AS INT)").alias("legitimate_count"), "last_activity_at_ms")


def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return orders.select(F.col("o_orderkey").alias("id"), F.expr("concat('c', CAST(o_custkey AS STRING), '@out.example')").alias("sender"), F.expr("concat('Order ', CAST(o_orderkey AS STRING), ' ', o_orderpriority)").alias("subject"), millis("o_orderdate").alias("rejected_at_ms"), F.col("o_orderpriority").alias("reason"))


def rejection_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rejection_id"), F.expr("concat('s', CAST(l_suppkey AS STRING), '@in.example')").alias("recipient"))
    return lines.distinct()


KINDS = "CASE CAST((o_custkey + l_suppkey) % 3 AS INT) WHEN 0 THEN 'manual' WHEN 1 THEN 'authenticated_outbound' ELSE 'repeated_legitimate_inbound' END"


def correspondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    grouped = joined.groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.max(millis("l_shipdate")).alias("last_activity_at_ms"), F.min(millis("o_orderdate")).alias("learned_at_ms"))
    named = {"local_address": "concat('s', CAST(l_suppkey AS STRING), '@in.example')", "correspondent": "concat('c', CAST(o_custkey AS STRING), '@out.example')", "whitelist_type": KINDS}
    return grouped.select(F.expr("o_custkey * 100000 + l_suppkey").alias("id"), *[F.expr(e).alias(n) for n, e in named.items()], F.col("n").cast("int").alias("legitimate_email_count"), "learned_at_ms", "last_activity_at_ms")


def blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact rules (kind 1) and domain rules (kind 2) of suppliers; every fifth supplier's rule is for all recipients."""
    rows = table(spark, sf_dir, "supplier")
    named = {
        "recipient": "CASE WHEN s_suppkey % 5 = 0 THEN '*' ELSE concat('r', CAST(s_suppkey % 40 AS STRING), '@in.example') END",
        "sender_kind": "CAST(1 + s_suppkey % 2 AS INT)",
        "sender_value": "CASE WHEN s_suppkey % 2 = 0 THEN concat('c', CAST(s_suppkey * 3 AS STRING), '@mail.n', CAST(s_nationkey AS STRING), '.example') ELSE concat('n', CAST(s_nationkey AS STRING), '.example') END",
        "expires_at_ms": f"{ORDERS_NOW} + (s_suppkey % 9 - 3) * {DAY}",
    }
    return rows.select(F.col("s_suppkey").alias("id"), *[F.expr(e).alias(n) for n, e in named.items()])


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message per order: sender at mail.n<nation>.example, two recipients."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    named = {
        "sender": "concat('c', CAST(o_custkey AS STRING), '@mail.n', CAST(c_nationkey AS STRING), '.example')",
        "recipients": "array(concat('r', CAST(o_orderkey % 40 AS STRING), '@in.example'), concat('r', CAST((o_orderkey + 7) % 40 AS STRING), '@in.example'))",
    }
    return joined.select(F.col("o_orderkey").alias("id"), *[F.expr(e).alias(n) for n, e in named.items()], millis("o_orderdate").alias("at_ms"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))


def _duck(text: str) -> str:
    return text.replace("AS STRING", "AS VARCHAR")


def _columns(named: dict[str, str]) -> str:
    return ", ".join(f"{_duck(e)} AS {n}" for n, e in named.items())


#: The same tables as DuckDB subqueries.
SQL = {
    "activity": f"(SELECT epoch_us(ts) // 1000 AS occurred_at_ms, {_columns(ACTIVITY)} FROM events)",
    "ip_events": f"(SELECT {_duck(ip_text('user_id'))} AS ip, epoch_us(ts) // 1000 AS at_ms, event_id AS id, CASE WHEN event_type = 'error' THEN 'rejection' ELSE 'legitimate' END AS kind FROM events WHERE event_type IN ('error', 'signup'))",
    "strikes": f"(SELECT event_id AS id, {_duck(ip_text('user_id'))} AS ip, epoch_us(ts) // 1000 AS struck_at_ms FROM events WHERE event_type = 'error')",
    "reputation": f"(SELECT user_id AS id, {_duck(ip_text('user_id'))} AS ip, CASE user_id % 3 WHEN 1 THEN 'short' WHEN 2 THEN 'repeat' END AS block_level, CASE WHEN user_id % 3 = 0 THEN NULL ELSE {EVENTS_NOW} + (user_id % 20 - 10) * {DAY} END AS blocked_until_ms, CAST(user_id % 4 AS INT) AS legitimate_count, max(epoch_us(ts) // 1000) AS last_activity_at_ms FROM events GROUP BY user_id)",
    "rejections": "(SELECT o_orderkey AS id, concat('c', o_custkey, '@out.example') AS sender, concat('Order ', o_orderkey, ' ', o_orderpriority) AS subject, epoch_us(o_orderdate) // 1000 AS rejected_at_ms, o_orderpriority AS reason FROM orders WHERE o_orderstatus = 'F')",
    "rejection_recipients": "(SELECT DISTINCT l_orderkey AS rejection_id, concat('s', l_suppkey, '@in.example') AS recipient FROM lineitem)",
    "correspondents": f"(SELECT o_custkey * 100000 + l_suppkey AS id, concat('s', l_suppkey, '@in.example') AS local_address, concat('c', o_custkey, '@out.example') AS correspondent, {KINDS} AS whitelist_type, CAST(count(*) AS INT) AS legitimate_email_count, min(epoch_us(o_orderdate) // 1000) AS learned_at_ms, max(epoch_us(l_shipdate) // 1000) AS last_activity_at_ms FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_suppkey)",
    "blocklist": f"(SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN '*' ELSE concat('r', s_suppkey % 40, '@in.example') END AS recipient, CAST(1 + s_suppkey % 2 AS INT) AS sender_kind, CASE WHEN s_suppkey % 2 = 0 THEN concat('c', s_suppkey * 3, '@mail.n', s_nationkey, '.example') ELSE concat('n', s_nationkey, '.example') END AS sender_value, {ORDERS_NOW} + (s_suppkey % 9 - 3) * {DAY} AS expires_at_ms FROM supplier)",
    "messages": "(SELECT o_orderkey AS id, concat('c', o_custkey, '@mail.n', c_nationkey, '.example') AS sender, [concat('r', o_orderkey % 40, '@in.example'), concat('r', (o_orderkey + 7) % 40, '@in.example')] AS recipients, epoch_us(o_orderdate) // 1000 AS at_ms, o_totalprice AS price, o_orderpriority AS priority, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey)",
}


def sql(text: str) -> str:
    """DuckDB SQL with {table} replaced by the subqueries above."""
    return text.format(**SQL, now=EVENTS_NOW, orders_now=ORDERS_NOW, day=DAY)
