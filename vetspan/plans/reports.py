"""Queries on state tables: reports, joins, aggregates, windows, paging and clean-up, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import addresses, numbers
from ..operators import activity as act
from ..operators import blocklist, correspondents, histories, reputation, retention
from . import carriers as c
from .carriers import DAY, EVENTS_NOW, ORDERS_NOW, sql

QUERIES, SQL = {}, {}


def query(name: str, text: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL if there is some."""

    def add(fn):
        QUERIES[name] = fn
        if text:
            SQL[name] = sql(text)
        return fn

    return add


TRUST = correspondents.TrustPolicy(min_messages=2, stale_ms=3 * 365 * DAY, capacity=300)
BLOCKS = reputation.ReputationPolicy(window_ms=5 * DAY, capacity=40)
RETAIN = 3 * 365 * DAY
KINDS = "whitelist_type IN ('authenticated_outbound', 'manual') OR (whitelist_type = 'repeated_legitimate_inbound' AND legitimate_email_count >= 2)"
SINCE = f"{EVENTS_NOW} - 20 * {DAY}"
CASES = ", ".join([
    "count(*) FILTER (WHERE event_type = 1) AS scan_total",
    "count(*) FILTER (WHERE event_type = 1 AND analysis_failed) AS evaluations_failed",
    *[f"count(*) FILTER (WHERE event_type = {k} AND outcome = {o}) AS {n}" for n, (k, o) in act.COUNTED.items()],
    "CAST(coalesce(sum(quantity) FILTER (WHERE event_type = 7 AND outcome = 2), 0) AS BIGINT) AS blocklist_rejections",
    "CAST(coalesce(sum(quantity) FILTER (WHERE event_type = 7 AND outcome = 1), 0) AS BIGINT) AS blocklist_removals",
    "round(coalesce(sum(token_cost) FILTER (WHERE event_type = 1), 0), 4) AS token_cost",
])
SUMMARY = f"SELECT {CASES} FROM {{activity}} WHERE occurred_at_ms >= {SINCE} AND occurred_at_ms < {{now}}"


def _summary(spark, sf_dir):
    since, before = act.window(EVENTS_NOW, 30 * DAY, EVENTS_NOW - 20 * DAY)
    return act.summarise(c.activity(spark, sf_dir), since, before)


@query("a1_activity_summary", SUMMARY)
def a1(spark, sf_dir):
    return _summary(spark, sf_dir).withColumn("token_cost", F.round("token_cost", 4))


@query("a2_activity_report", f"SELECT scan_rejections + ip_rejections + attachment_rejections + protected_rejections + blocklist_rejections + limit_rejections + dos_rejections + incomplete_rejections AS total_rejected, scan_accepted + correspondent_accepts + trusted_domain_accepts + limit_accepted + dos_accepted + incomplete_accepted AS total_accepted, round(token_cost / scan_total, 6) AS average_cost FROM ({SUMMARY.replace('round(coalesce(sum(token_cost) FILTER (WHERE event_type = 1), 0), 4)', 'sum(token_cost) FILTER (WHERE event_type = 1)')})")
def a2(spark, sf_dir):
    return act.report(_summary(spark, sf_dir)).select("total_rejected", "total_accepted", F.round("average_cost", 6).alias("average_cost"))


@query("a3_presence", f"SELECT correspondent, count(DISTINCT local_address) AS local_addresses, max(CASE WHEN whitelist_type = 'manual' THEN 1 ELSE 0 END) AS manual, max(CASE WHEN whitelist_type = 'authenticated_outbound' THEN 1 ELSE 0 END) AS outbound, max(CASE WHEN whitelist_type = 'repeated_legitimate_inbound' THEN 1 ELSE 0 END) AS inbound FROM {{correspondents}} WHERE ({KINDS}) AND last_activity_at_ms >= {{orders_now}} - {RETAIN} GROUP BY correspondent")
def a3(spark, sf_dir):
    return correspondents.presence(c.correspondents(spark, sf_dir), TRUST, ORDERS_NOW)


@query("a4_strike_counts", "SELECT ip, count(*) AS strikes FROM {strikes} GROUP BY ip")
def a4(spark, sf_dir):
    return reputation.strike_counts(c.strikes(spark, sf_dir))


@query("a5_table_counts", "SELECT 'activity' AS name, count(*) AS n FROM {activity} UNION ALL SELECT 'correspondents', count(*) FROM {correspondents} UNION ALL SELECT 'rejections', count(*) FROM {rejections} UNION ALL SELECT 'blocklist', count(*) FROM {blocklist}")
def a5(spark, sf_dir):
    parts = [f(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, f in (("activity", c.activity), ("correspondents", c.correspondents), ("rejections", c.rejections), ("blocklist", c.blocklist))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("a6_capacity_excess", "SELECT greatest(count(*) - 1000, 0) AS excess FROM {rejections}")
def a6(spark, sf_dir):
    return c.rejections(spark, sf_dir).agg(retention.excess(F.count(F.lit(1)), 1000).alias("excess"))


@query("a7_rejections_with_recipients", "SELECT r.id, count(*) AS n, string_agg(recipient, ',' ORDER BY recipient) AS recipients FROM {rejections} r JOIN {rejection_recipients} p ON p.rejection_id = r.id GROUP BY r.id")
def a7(spark, sf_dir):
    rows = c.rejection_recipients(spark, sf_dir).join(c.rejections(spark, sf_dir), F.col("id") == F.col("rejection_id"))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("recipient")), ",").alias("recipients"))


PARENTS = "(SELECT id, sender, recipients, unnest([{'k': 1, 'v': lower(sender)}] || list_transform(range(1, len(string_split(split_part(sender, '@', 2), '.')) + 1), lambda i: {'k': 2, 'v': array_to_string(string_split(split_part(sender, '@', 2), '.')[i:], '.')})) AS c FROM MESSAGES)".replace("{", "{{").replace("}", "}}").replace("MESSAGES", "{messages}")
HITS = f"SELECT m.id, any_value(m.recipients) AS recipients, min(b.sender_kind) AS matched_kind, bool_or(b.recipient = '*') AS everyone, list(b.recipient) AS scopes FROM {PARENTS} m JOIN {{blocklist}} b ON b.sender_kind = m.c.k AND b.sender_value = m.c.v AND b.expires_at_ms > {{orders_now}} GROUP BY m.id"
BLOCKED = f"(SELECT id, matched_kind, list_sort(list_distinct(CASE WHEN everyone THEN recipients ELSE list_filter(recipients, lambda r: list_contains(scopes, r)) END)) AS blocked, recipients FROM ({HITS}))"


@query("a8_j9_blocked_recipients", f"SELECT id, array_to_string(blocked, ',') AS blocked, matched_kind FROM {BLOCKED} WHERE len(blocked) > 0")
def a8(spark, sf_dir):
    found = blocklist.matches(c.messages(spark, sf_dir), c.blocklist(spark, sf_dir), ORDERS_NOW)
    return found.select("id", F.array_join("blocked", ",").alias("blocked"), "matched_kind")


@query("p8_block_outcome", f"SELECT outcome, count(*) AS n, CAST(sum(remaining) AS BIGINT) AS remaining FROM (SELECT len(list_distinct(recipients)) - len(blocked) AS remaining, CASE WHEN len(list_distinct(recipients)) = len(blocked) THEN 'full' ELSE 'partial' END AS outcome FROM {BLOCKED} WHERE len(blocked) > 0) GROUP BY outcome")
def p8(spark, sf_dir):
    found = blocklist.outcome(blocklist.matches(c.messages(spark, sf_dir), c.blocklist(spark, sf_dir), ORDERS_NOW))
    return found.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("remaining")).alias("remaining"))


@query("a9_saturating_usage", "SELECT l_suppkey, least(CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT), 500) AS tokens FROM lineitem GROUP BY l_suppkey")
def a9(spark, sf_dir):
    return c.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(numbers.saturating_sum(F.col("l_quantity").cast("long"), 500).alias("tokens"))


@query("a10_token_cost", "SELECT l_returnflag, round(sum(l_quantity / 1000000 * 3 + l_partkey / 1000000 * 15), 5) AS cost FROM lineitem GROUP BY l_returnflag")
def a10(spark, sf_dir):
    return c.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(act.cost(F.col("l_quantity"), F.col("l_partkey"), 3, 15)), 5).alias("cost"))


@query("a12_label_merge", "SELECT user_id, bit_or(CAST(1 << (event_id % 8) AS INT)) AS bits FROM events WHERE event_type = 'click' GROUP BY user_id")
def a12(spark, sf_dir):
    return c.table(spark, sf_dir, "events").filter("event_type = 'click'").groupBy("user_id").agg(F.bit_or(F.expr("CAST(shiftleft(1, CAST(event_id % 8 AS INT)) AS INT)")).alias("bits"))


@query("a13_comparison", "SELECT source AS method, count(*) AS compared, count(*) FILTER (WHERE (quality = 1) <> (n_chars > 1500)) AS differing, count(*) FILTER (WHERE toxic = 1) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY source")
def a13(spark, sf_dir):
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    both = c.table(spark, sf_dir, "labels").join(docs, "doc_id")
    return both.groupBy(F.col("source").alias("method")).agg(F.count(F.lit(1)).alias("compared"), F.count_if((F.col("quality") == 1) != (F.col("n_chars") > 1500)).alias("differing"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("f1_scope", "SELECT count(*) AS n FROM {rejection_recipients} WHERE recipient = 's7@in.example'")
def f1(spark, sf_dir):
    return correspondents.scoped(c.rejection_recipients(spark, sf_dir), "recipient", "s7@in.example").agg(F.count(F.lit(1)).alias("n"))


@query("f2_qualified", f"SELECT whitelist_type, count(*) AS n FROM {{correspondents}} WHERE {KINDS} GROUP BY whitelist_type")
def f2(spark, sf_dir):
    return c.correspondents(spark, sf_dir).filter(correspondents.qualified(TRUST)).groupBy("whitelist_type").agg(F.count(F.lit(1)).alias("n"))


@query("f3_f4_qualified_active", f"SELECT local_address, correspondent, whitelist_type, legitimate_email_count FROM {{correspondents}} WHERE ({KINDS}) AND last_activity_at_ms >= {{orders_now}} - {RETAIN}")
def f3(spark, sf_dir):
    return c.correspondents(spark, sf_dir).filter(correspondents.qualified_active(TRUST, ORDERS_NOW)).select("local_address", "correspondent", "whitelist_type", "legitimate_email_count")


@query("f5_period_cutoff", "SELECT o_orderkey, epoch_us(o_orderdate - INTERVAL 1 DAY) // 1000 AS day, epoch_us(o_orderdate - INTERVAL 7 DAY) // 1000 AS week, epoch_us(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH + (day(o_orderdate) - 1) * INTERVAL 1 DAY) // 1000 AS month, epoch_us(date_trunc('month', o_orderdate) - INTERVAL 12 MONTH + (day(o_orderdate) - 1) * INTERVAL 1 DAY) // 1000 AS year FROM orders")
def f5(spark, sf_dir):
    at = F.col("o_orderdate").cast("timestamp")
    return c.table(spark, sf_dir, "orders").select("o_orderkey", *[F.unix_millis(act.period_cutoff(at, p)).alias(p) for p in ("day", "week", "month", "year")])


MATRIX = " OR ".join(f"(event_type = {k} AND o IN ({', '.join(map(str, v))}))" for k, v in act.ALLOWED.items())


@query("f6_validity", f"SELECT event_type, o AS outcome, count(*) FILTER (WHERE {MATRIX}) AS valid, count(*) AS n FROM (SELECT event_type, CAST(1 + id % 4 AS INT) AS o FROM {{activity}}) GROUP BY event_type, o")
def f6(spark, sf_dir):
    rows = c.activity(spark, sf_dir).select("event_type", F.expr("CAST(1 + id % 4 AS INT)").alias("outcome"))
    return rows.groupBy("event_type", "outcome").agg(F.count_if(act.is_valid(F.col("event_type"), F.col("outcome"))).alias("valid"), F.count(F.lit(1)).alias("n"))


@query("f7_in_list", "SELECT count(*) AS n FROM {correspondents} WHERE local_address IN ('s1@in.example', 's2@in.example', 's3@in.example')")
def f7(spark, sf_dir):
    return c.correspondents(spark, sf_dir).filter(F.col("local_address").isin("s1@in.example", "s2@in.example", "s3@in.example")).agg(F.count(F.lit(1)).alias("n"))


@query("f9_f11_sender_domain_allowlist", "SELECT id, sender FROM {messages} WHERE regexp_matches(sender, '[@.](n3|n7)\\.example$')")
def f11(spark, sf_dir):
    allowed = spark.createDataFrame([("n3.example",), ("n7.example",)], "domain string")
    rows = c.messages(spark, sf_dir).withColumn("domain", F.explode(addresses.parent_domains(addresses.domain_of(F.col("sender")))))
    return rows.join(F.broadcast(allowed), "domain", "left_semi").select("id", "sender").distinct()


NUMBER = "(CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT))"


@query("f8_allowlist_networks", f"SELECT ip, {NUMBER} BETWEEN 0 AND 63 OR {NUMBER} BETWEEN 128 AND 159 AS allowed FROM (SELECT DISTINCT ip FROM {{strikes}})")
def f8(spark, sf_dir):
    return c.strikes(spark, sf_dir).select("ip").distinct().select("ip", addresses.in_networks(F.col("ip"), ("198.51.0.0/26", "198.51.0.128/27")).alias("allowed"))


@query("f13_routable", "SELECT ip, routable FROM (SELECT ip, NOT (starts_with(ip, '10.') OR starts_with(ip, '192.168.') OR starts_with(ip, '127.')) AS routable FROM (SELECT DISTINCT concat(CASE CAST(user_id % 5 AS INT) WHEN 0 THEN '10.1' WHEN 1 THEN '192.168' WHEN 2 THEN '8.8' WHEN 3 THEN '127.0' ELSE '198.20' END, '.0.', user_id % 250) AS ip FROM events))")
def f13(spark, sf_dir):
    made = "concat(CASE CAST(user_id % 5 AS INT) WHEN 0 THEN '10.1' WHEN 1 THEN '192.168' WHEN 2 THEN '8.8' WHEN 3 THEN '127.0' ELSE '198.20' END, '.0.', CAST(user_id % 250 AS STRING))"
    rows = c.table(spark, sf_dir, "events").select(F.expr(made).alias("ip")).distinct()
    return rows.select("ip", addresses.is_routable(F.col("ip")).alias("routable"))


@query("j1_t1_rejections_of_recipient", f"SELECT id, sender, rejected_at_ms, CAST(row_number() OVER (ORDER BY rejected_at_ms DESC, id DESC) AS INT) AS position, n > 20 AS truncated FROM (SELECT r.*, count(*) OVER () AS n FROM {{rejections}} r JOIN {{rejection_recipients}} p ON p.rejection_id = r.id WHERE p.recipient = 's7@in.example' AND rejected_at_ms >= {{orders_now}} - {RETAIN} ORDER BY rejected_at_ms DESC, id DESC LIMIT 20)")
def j1(spark, sf_dir):
    rows = histories.list_for_recipient(c.rejections(spark, sf_dir), c.rejection_recipients(spark, sf_dir), "s7@in.example", ORDERS_NOW, RETAIN, 20)
    return rows.select("id", "sender", "rejected_at_ms", "position", "truncated")


@query("j2_rejections_page", f"SELECT t.id, t.subject, string_agg(p.recipient, ',' ORDER BY p.recipient) AS recipients FROM (SELECT * FROM {{rejections}} WHERE rejected_at_ms >= {{orders_now}} - {RETAIN} ORDER BY rejected_at_ms DESC, id DESC LIMIT 50) t LEFT JOIN {{rejection_recipients}} p ON p.rejection_id = t.id GROUP BY t.id, t.subject")
def j2(spark, sf_dir):
    rows = histories.list_all(c.rejections(spark, sf_dir), c.rejection_recipients(spark, sf_dir), ORDERS_NOW, RETAIN, 50)
    return rows.select("id", "subject", F.array_join("recipients", ",").alias("recipients"))


@query("j3_t2_rejection_detail", f"SELECT r.id, any_value(r.sender) AS sender, string_agg(p.recipient, ',' ORDER BY p.recipient) AS recipients FROM {{rejections}} r LEFT JOIN {{rejection_recipients}} p ON p.rejection_id = r.id WHERE r.id = 1 AND rejected_at_ms >= {{orders_now}} - {20 * RETAIN} GROUP BY r.id")
def j3(spark, sf_dir):
    return histories.detail(c.rejections(spark, sf_dir), c.rejection_recipients(spark, sf_dir), 1, ORDERS_NOW, 20 * RETAIN).select("id", "sender", F.array_join("recipients", ",").alias("recipients"))


@query("j4_current_strike", "SELECT ip, block_level FROM {reputation} r WHERE EXISTS (SELECT 1 FROM {strikes} s WHERE s.ip = r.ip AND struck_at_ms > {now} - 5 * {day})")
def j4(spark, sf_dir):
    return reputation.with_current_strike(c.reputation(spark, sf_dir), c.strikes(spark, sf_dir), BLOCKS, EVENTS_NOW).select("ip", "block_level")


@query("j6_st2_active_blocks", "SELECT ip, block_level, blocked_until_ms, coalesce(n, 0) AS strike_count FROM {reputation} LEFT JOIN (SELECT ip, count(*) AS n FROM {strikes} GROUP BY ip) USING (ip) WHERE blocked_until_ms > {now}")
def j6(spark, sf_dir):
    return reputation.active_blocks(c.reputation(spark, sf_dir), c.strikes(spark, sf_dir), EVENTS_NOW)


@query("st2_refreshed_blocks", f"SELECT ip, CASE WHEN block_level = 'repeat' AND {{now}} + {BLOCKS.repeat_ms} - blocked_until_ms >= 60000 THEN {{now}} + {BLOCKS.repeat_ms} ELSE blocked_until_ms END AS blocked_until_ms FROM {{reputation}} WHERE blocked_until_ms > {{now}}")
def st2(spark, sf_dir):
    blocks = reputation.active_blocks(c.reputation(spark, sf_dir), c.strikes(spark, sf_dir), EVENTS_NOW)
    return reputation.refreshed(blocks, BLOCKS, EVENTS_NOW).select("ip", "blocked_until_ms")


@query("j7_w1_newest_strikes", "SELECT id, ip, struck_at_ms FROM {strikes} WHERE struck_at_ms > {now} - 5 * {day} QUALIFY row_number() OVER (PARTITION BY ip ORDER BY struck_at_ms DESC, id DESC) <= 3")
def j7(spark, sf_dir):
    return reputation.live_strikes(c.strikes(spark, sf_dir), BLOCKS, EVENTS_NOW).select("id", "ip", "struck_at_ms")


@query("w2_rolling_strikes", f"SELECT a.id, least(count(b.id), 3) AS strikes FROM {{strikes}} a JOIN {{strikes}} b ON a.ip = b.ip AND b.struck_at_ms > a.struck_at_ms - {5 * DAY} AND (b.struck_at_ms < a.struck_at_ms OR (b.struck_at_ms = a.struck_at_ms AND b.id <= a.id)) GROUP BY a.id")
def w2(spark, sf_dir):
    return reputation.rolling_strikes(c.strikes(spark, sf_dir), BLOCKS).select("id", "strikes")


CLEAN = "SELECT r.id, r.ip, CASE WHEN block_level = 'short' AND blocked_until_ms <= {now} THEN NULL ELSE block_level END AS block_level, last_activity_at_ms FROM {reputation} r WHERE NOT coalesce(block_level = 'repeat' AND blocked_until_ms <= {now}, FALSE)"
CLEANED = f"SELECT id, ip, block_level FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN block_level IS NULL THEN 0 WHEN block_level = 'short' THEN 1 ELSE 2 END DESC, last_activity_at_ms DESC, id DESC) AS k FROM ({CLEAN}) WHERE block_level IS NOT NULL OR ip IN (SELECT ip FROM {{strikes}} WHERE struck_at_ms > {{now}} - 5 * {{day}})) WHERE k <= 40"


@query("st6_w3_j5_reputation_cleanup", CLEANED)
def st6(spark, sf_dir):
    return reputation.clean(c.reputation(spark, sf_dir), c.strikes(spark, sf_dir), BLOCKS, EVENTS_NOW)[0].select("id", "ip", "block_level")


@query("j8_cascade", f"SELECT ip, count(*) AS n FROM {{strikes}} WHERE struck_at_ms > {{now}} - 5 * {{day}} AND ip IN (SELECT ip FROM ({CLEANED})) GROUP BY ip")
def j8(spark, sf_dir):
    return reputation.clean(c.reputation(spark, sf_dir), c.strikes(spark, sf_dir), BLOCKS, EVENTS_NOW)[1].groupBy("ip").agg(F.count(F.lit(1)).alias("n"))


@query("j10_parent_domains", "SELECT DISTINCT array_to_string(string_split(split_part(sender, '@', 2), '.')[i:], '.') AS domain FROM {messages}, range(1, 5) t(i) WHERE i <= len(string_split(split_part(sender, '@', 2), '.'))")
def j10(spark, sf_dir):
    return c.messages(spark, sf_dir).select(F.explode(addresses.parent_domains(addresses.domain_of(F.col("sender")))).alias("domain")).distinct()


TO = "(SELECT id, replace(sender, 'mail.n' || split_part(split_part(sender, '.n', 2), '.', 1) || '.example', 'out.example') AS sender, list_transform(recipients, lambda r: concat('s', substr(r, 2))) AS recipients FROM {messages})"


@query("j12_known_correspondents", f"SELECT id, count(hit) AS matched, count(hit) = count(*) AS all_matched FROM (SELECT DISTINCT id, sender, unnest(recipients) AS recipient FROM {TO}) m LEFT JOIN (SELECT DISTINCT local_address, correspondent, 1 AS hit FROM {{correspondents}} WHERE ({KINDS}) AND last_activity_at_ms >= {{orders_now}} - {RETAIN}) k ON k.local_address = recipient AND k.correspondent = sender GROUP BY id")
def j12(spark, sf_dir):
    sent = c.messages(spark, sf_dir).select("id", F.regexp_replace("sender", r"@mail\.n\d+\.example$", "@out.example").alias("sender"), F.transform("recipients", lambda r: F.concat(F.lit("s"), F.substring(r, F.lit(2), F.length(r)))).alias("recipients"))
    return correspondents.match(sent, c.correspondents(spark, sf_dir), TRUST, ORDERS_NOW)


@query("j13_created_flag", "SELECT s_suppkey, NOT EXISTS (SELECT 1 FROM {rejection_recipients} WHERE recipient = concat('s', s_suppkey, '@in.example')) AS created FROM supplier")
def j13(spark, sf_dir):
    known = c.rejection_recipients(spark, sf_dir).select("recipient").distinct().withColumn("known", F.lit(True))
    rows = c.table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("concat('s', CAST(s_suppkey AS STRING), '@in.example')").alias("recipient"))
    return rows.join(known, "recipient", "left").select("s_suppkey", F.col("known").isNull().alias("created"))


@query("t3_correspondent_page", "SELECT local_address, correspondent, last_activity_at_ms FROM {correspondents} ORDER BY last_activity_at_ms DESC, local_address, correspondent LIMIT 100")
def t3(spark, sf_dir):
    return retention.page(c.correspondents(spark, sf_dir), [F.desc("last_activity_at_ms"), F.asc("local_address"), F.asc("correspondent")], 100).select("local_address", "correspondent", "last_activity_at_ms")


@query("t4_blocks_by_ip_text", "SELECT ip, CAST(row_number() OVER (ORDER BY ip) AS INT) AS position, n > 25 AS truncated FROM (SELECT ip, count(*) OVER () AS n FROM {reputation} WHERE blocked_until_ms > {now} ORDER BY ip LIMIT 25)")
def t4(spark, sf_dir):
    blocks = reputation.active_blocks(c.reputation(spark, sf_dir), c.strikes(spark, sf_dir), EVENTS_NOW)
    return retention.page(blocks, [F.asc("ip")], 25).select("ip", "position", "truncated")


@query("t5_rule_page", "SELECT id, sender_value FROM {blocklist} WHERE expires_at_ms > {orders_now} ORDER BY expires_at_ms DESC, id DESC LIMIT 20")
def t5(spark, sf_dir):
    return retention.page(blocklist.live(c.blocklist(spark, sf_dir), ORDERS_NOW), [F.desc("expires_at_ms"), F.desc("id")], 20).select("id", "sender_value")


@query("t7_st25_command_tail", "SELECT CAST(row_number() OVER (ORDER BY event_id) AS INT) AS position, command FROM (SELECT event_id, event_type AS command FROM events ORDER BY event_id DESC LIMIT 10)")
def t7(spark, sf_dir):
    return histories.command_tail(c.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("command")))


@query("t9_bounded_listing", "SELECT o_orderkey, CAST(bytes AS BIGINT) AS bytes FROM (SELECT o_orderkey, sum(strlen(o_orderpriority) + 1) OVER (ORDER BY o_orderkey) AS bytes FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000)) WHERE bytes <= 5000")
def t9(spark, sf_dir):
    return histories.bounded_lines(c.table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", 1000, 5000).select("o_orderkey", F.col("bytes").cast("long").alias("bytes"))


@query("t10_first_addresses", "SELECT conv_id, array_to_string(list_sort(list_distinct(list(role ORDER BY turn))[1:100]), ',') AS roles FROM conversations GROUP BY conv_id")
def t10(spark, sf_dir):
    first = c.table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min(F.struct("turn", "role")).alias("first"))
    seen = F.transform(F.array_sort(F.collect_list("first")), lambda x: x["role"])
    return first.groupBy("conv_id").agg(F.array_join(F.array_sort(F.slice(seen, 1, 100)), ",").alias("roles"))


@query("t11_archive_eviction", "SELECT s_suppkey FROM (SELECT s_suppkey, sum(100 + s_suppkey) OVER (ORDER BY s_nationkey DESC, s_suppkey DESC) AS total FROM supplier) WHERE total <= 3000")
def t11(spark, sf_dir):
    files = c.table(spark, sf_dir, "supplier").withColumn("length", F.lit(100) + F.col("s_suppkey"))
    return retention.bytes_until(files, "length", 3000, [F.col("s_nationkey"), F.col("s_suppkey")]).select("s_suppkey")


@query("u1_u2_u5_recipient_sets", "SELECT id, array_to_string(list_sort(list_filter(list_distinct(recipients), lambda r: r <> 'r7@in.example')), ',') AS remaining, len(list_distinct(recipients)) + 1 AS scopes FROM {messages}")
def u1(spark, sf_dir):
    rows = c.messages(spark, sf_dir)
    return rows.select("id", F.array_join(F.array_sort(F.array_except("recipients", F.array(F.lit("r7@in.example")))), ",").alias("remaining"), F.size(F.array_union(F.array(F.lit("*")), "recipients")).cast("long").alias("scopes"))


@query("st12_correspondent_cleanup", "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY CASE WHEN whitelist_type = 'repeated_legitimate_inbound' AND legitimate_email_count < 2 THEN 0 ELSE 1 END DESC, last_activity_at_ms DESC, id DESC) AS k FROM {correspondents} WHERE last_activity_at_ms >= {orders_now} - " + str(RETAIN) + ") WHERE k <= 300")
def st12(spark, sf_dir):
    return correspondents.clean(c.correspondents(spark, sf_dir), TRUST, ORDERS_NOW).select("id")


@query("st14_rejection_cleanup", f"SELECT p.rejection_id, p.recipient FROM {{rejection_recipients}} p WHERE p.rejection_id IN (SELECT id FROM {{rejections}} WHERE rejected_at_ms >= {{orders_now}} - {RETAIN} ORDER BY rejected_at_ms DESC, id DESC LIMIT 200)")
def st14(spark, sf_dir):
    return histories.clean_rejections(c.rejections(spark, sf_dir), c.rejection_recipients(spark, sf_dir), ORDERS_NOW, RETAIN, 200)[1]


@query("st15_domain_upsert", "SELECT host, max(page_id) AS page_id FROM (SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host FROM pages) GROUP BY host")
def st15(spark, sf_dir):
    rows = c.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/:]+)", 1).alias("host"))
    old, new = rows.filter("page_id % 2 = 0"), rows.filter("page_id % 2 = 1")
    return retention.upsert(old, new, ["host"], "page_id").select("host", "page_id")


@query("st17_st20_rule_cleanup", "SELECT id FROM {blocklist} WHERE expires_at_ms > {orders_now} ORDER BY expires_at_ms DESC, id DESC LIMIT 30")
def st20(spark, sf_dir):
    return histories.clean_rules(c.blocklist(spark, sf_dir), ORDERS_NOW, 30).select("id")


@query("st23_activity_expiry", "SELECT event_type, count(*) AS n FROM {activity} WHERE occurred_at_ms >= {now} - 10 * {day} GROUP BY event_type")
def st23(spark, sf_dir):
    return act.expired(c.activity(spark, sf_dir), EVENTS_NOW, 10 * DAY).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("p14_registration_decision", "SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'lookup' WHEN s_suppkey % 5 - 3 > 0 OR (s_suppkey % 3 = 0 AND s_suppkey % 5 - 3 >= s_suppkey % 4 - 1) OR (s_suppkey % 3 <> 0 AND s_suppkey % 5 - 3 >= 14) THEN 'invalid' WHEN s_suppkey % 3 <> 0 OR s_suppkey % 4 - 1 > 0 THEN 'cached' ELSE 'lookup' END AS decision FROM supplier")
def p14(spark, sf_dir):
    registered = F.expr(f"CASE WHEN s_suppkey % 7 <> 0 THEN {ORDERS_NOW} + (s_suppkey % 5 - 3) * {DAY} END")
    expires = F.expr(f"CASE WHEN s_suppkey % 3 = 0 THEN {ORDERS_NOW} + (s_suppkey % 4 - 1) * {DAY} END")
    return c.table(spark, sf_dir, "supplier").select("s_suppkey", histories.registration_decision(registered, expires, ORDERS_NOW).alias("decision"))


#: Folds as recursions: a step takes each key's next event.
BLOCK_STEPS = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY at_ms, id) AS n FROM {{ip_events}} WHERE ip IS NOT NULL),
s AS (
  SELECT ip, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS strikes, CAST(NULL AS VARCHAR) AS level, CAST(NULL AS BIGINT) AS until, 0 AS legitimate, false AS known, CAST(0 AS BIGINT) AS last FROM e WHERE n = 1
  UNION ALL
  SELECT ip, n,
    CASE WHEN rejected THEN held WHEN unmoved THEN strikes WHEN gone THEN [] ELSE left_over END,
    CASE WHEN rejected THEN CASE WHEN stronger THEN kept_level ELSE new_level END WHEN unmoved OR NOT gone THEN level END,
    CASE WHEN rejected THEN CASE WHEN stronger THEN kept_until ELSE new_until END WHEN unmoved OR NOT gone THEN until END,
    CASE WHEN rejected OR (NOT unmoved AND (gone OR paid)) THEN 0 WHEN unmoved THEN legitimate ELSE legitimate + 1 END,
    rejected OR (known AND (unmoved OR NOT gone)),
    CASE WHEN unmoved THEN last WHEN NOT rejected AND gone THEN 0 ELSE at_ms END
  FROM (SELECT *, coalesce(kept_until > at_ms AND (kept_until > new_until OR (kept_until = new_until AND kept_level = 'repeat' AND new_level <> 'repeat')), false) AS stronger,
      NOT rejected AND len(left_over) = 0 AND NOT coalesce(level IS NOT NULL AND until > at_ms, false) AS gone
    FROM (SELECT *, CASE WHEN len(held) >= {BLOCKS.repeat_strikes} THEN 'repeat' ELSE 'short' END AS new_level,
        at_ms + CASE WHEN len(held) >= {BLOCKS.repeat_strikes} THEN {BLOCKS.repeat_ms} ELSE {BLOCKS.short_ms} END AS new_until,
        CASE WHEN NOT ended THEN level END AS kept_level, CASE WHEN NOT ended THEN until END AS kept_until,
        NOT rejected AND (NOT known OR len(young) = 0) AS unmoved, CASE WHEN paid THEN young[2:] ELSE young END AS left_over
      FROM (SELECT *, list_filter(list_append(CASE WHEN ended THEN CAST([] AS BIGINT[]) ELSE strikes END, at_ms), lambda x: x > at_ms - {BLOCKS.window_ms})[-{BLOCKS.repeat_strikes}:] AS held,
          list_filter(strikes, lambda x: x > at_ms - {BLOCKS.window_ms}) AS young
        FROM (SELECT s.* EXCLUDE (n), e.n, e.at_ms, e.kind = 'rejection' AS rejected, legitimate + 1 >= {BLOCKS.legitimate_per_strike} AS paid,
            coalesce(known AND level = 'repeat' AND until <= at_ms, false) AS ended
          FROM s JOIN e ON e.ip = s.ip AND e.n = s.n + 1))))
)
SELECT ip, level AS block_level, until AS blocked_until_ms, CAST(len(strikes) AS INT) AS strikes, legitimate AS legitimate_count, last AS last_activity_at_ms
FROM s JOIN (SELECT ip, max(n) AS n FROM e GROUP BY ip) USING (ip, n) WHERE known"""
TRUST_STEPS = f"""WITH RECURSIVE e AS (
  SELECT concat('s', l_suppkey, '@in.example') AS a, concat('c', o_custkey, '@out.example') AS c, epoch_us(l_shipdate) // 1000 AS at_ms,
    CASE l_partkey % 6 WHEN 0 THEN 'outbound' WHEN 1 THEN 'refresh' WHEN 2 THEN 'remove' WHEN 3 THEN 'touch' ELSE 'advance' END AS action,
    row_number() OVER (PARTITION BY l_suppkey, o_custkey ORDER BY l_shipdate, l_orderkey * 100 + l_linenumber) AS n
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
), s AS (
  SELECT a, c, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS learned, CAST(NULL AS BIGINT) AS last, CAST(NULL AS VARCHAR) AS kind, 0 AS messages FROM e WHERE n = 1
  UNION ALL
  SELECT a, c, n, CASE WHEN had IS NULL THEN at_ms ELSE learned END,
    CASE WHEN had IS NULL OR action = 'outbound' OR (action <> 'remove' AND (had <> '{correspondents.INBOUND}' OR now >= {TRUST.min_messages})) THEN at_ms ELSE last END,
    CASE WHEN action = 'outbound' THEN '{correspondents.OUTBOUND}' WHEN had IS NULL THEN CASE action WHEN 'advance' THEN '{correspondents.INBOUND}' END
      WHEN action <> 'remove' OR had <> '{correspondents.INBOUND}' THEN had END,
    now
  FROM (SELECT *, CASE WHEN action = 'outbound' THEN 0 WHEN had IS NULL THEN 1 WHEN action = 'advance' AND had = '{correspondents.INBOUND}' AND messages < {TRUST.min_messages} THEN messages + 1 ELSE messages END AS now
    FROM (SELECT s.* EXCLUDE (n), e.n, e.at_ms, e.action, CASE WHEN NOT (last < at_ms - {TRUST.stale_ms} AND action IN ('outbound', 'advance', 'refresh')) THEN kind END AS had
      FROM s JOIN e ON e.a = s.a AND e.c = s.c AND e.n = s.n + 1))
)
SELECT a AS local_address, c AS correspondent, learned AS learned_at_ms, last AS last_activity_at_ms, kind AS whitelist_type, messages AS legitimate_email_count
FROM s JOIN (SELECT a, c, max(n) AS n FROM e GROUP BY a, c) USING (a, c, n) WHERE kind IS NOT NULL"""


@query("st1_st3_reputation_fold", BLOCK_STEPS)
def st1(spark, sf_dir):
    return reputation.fold(c.ip_events(spark, sf_dir), BLOCKS)


@query("st7_st9_correspondent_fold", TRUST_STEPS)
def st9(spark, sf_dir):
    rows = c.table(spark, sf_dir, "orders").join(c.table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    action = F.expr("CASE CAST(l_partkey % 6 AS INT) WHEN 0 THEN 'outbound' WHEN 1 THEN 'refresh' WHEN 2 THEN 'remove' WHEN 3 THEN 'touch' ELSE 'advance' END")
    events = rows.select(F.expr("concat('s', CAST(l_suppkey AS STRING), '@in.example')").alias("local_address"), F.expr("concat('c', CAST(o_custkey AS STRING), '@out.example')").alias("correspondent"), c.millis("l_shipdate").alias("at_ms"), F.expr("l_orderkey * 100 + l_linenumber").alias("id"), action.alias("action"))
    return correspondents.fold(events, TRUST)
