"""The reports that administrators read, as text rows; and mutations by hand of blocks, trust and rules."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from ..functions import text
from ..operators import activity as act
from ..operators import attachments, evidence, headers, histories, replies, reputation, retention
from ..operators.blocklist import live
from . import carriers as c
from .carriers import DAY, EVENTS_NOW, ORDERS_NOW, sql
from .reports import BLOCKS, RETAIN, SUMMARY

QUERIES, SQL = {}, {}


def query(name: str, words: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if words:
            SQL[name] = words
        return fn

    return add


def _when(column: str) -> str:
    return f"strftime(make_timestamp({column} * 1000), '%Y-%m-%d %H:%M:%S UTC')"


def _printed(lines: list[tuple[str, str | None]]) -> str:
    """DuckDB words for lines of text with a value each."""
    return "concat(" + ", ".join(f"'{words}', {value}, chr(10)" if value else f"'{words}', chr(10)" for words, value in lines) + ")"


REPORT = _printed([
    ("Activity: past month", None), ("Service uptime: 2 days, 1 hour", None), ("Retention: 30 days", None), ("", None),
    ("Total rejected: ", "scan_rejections + ip_rejections + attachment_rejections + protected_rejections + blocklist_rejections + limit_rejections + dos_rejections + incomplete_rejections"),
    ("  AI classification: ", "scan_rejections"), ("  IP reputation: ", "ip_rejections"), ("  Attachment policy: ", "attachment_rejections"), ("  Protected sender-domain policy: ", "protected_rejections"),
    ("  Sender blocklist: ", "blocklist_rejections"), ("  Content processing resource limit: ", "limit_rejections"), ("  Content processing DoS protection: ", "dos_rejections"), ("  Incomplete inspection: ", "incomplete_rejections"), ("", None),
    ("Total accepted: ", "scan_accepted + correspondent_accepts + trusted_domain_accepts + limit_accepted + dos_accepted + incomplete_accepted"),
    ("  AI classification: ", "scan_accepted"), ("  Correspondent whitelist: ", "correspondent_accepts"), ("  Trusted sender domain: ", "trusted_domain_accepts"), ("  Content processing resource limit (accept mode): ", "limit_accepted"),
    ("  Content processing DoS protection (accept mode): ", "dos_accepted"), ("  Incomplete inspection (accept mode): ", "incomplete_accepted"), ("", None),
    ("Recipient deliveries removed by sender blocklist: ", "blocklist_removals"), ("", None), ("Total AI scans: ", "scan_total"), ("AI evaluations failed: ", "evaluations_failed"), ("", None),
    ("Token costs are estimates based on endpoint-reported usage and configured prices.", None), ("Total token cost: USD ", "printf('%.4f', token_cost)"), ("Average cost per message scanned: USD ", "printf('%.6f', token_cost / scan_total)"),
])


@query("c1_activity_text", sql(f"SELECT {REPORT} AS reply FROM ({SUMMARY.replace('round(coalesce(sum(token_cost) FILTER (WHERE event_type = 1), 0), 4)', 'sum(token_cost) FILTER (WHERE event_type = 1)')})"))
def c1(spark, sf_dir):
    since, before = act.window(EVENTS_NOW, 30 * DAY, EVENTS_NOW - 20 * DAY)
    report = act.report(act.summarise(c.activity(spark, sf_dir), since, before))
    return replies.activity_reply(report, "month", EVENTS_NOW, 30 * DAY, EVENTS_NOW - 2 * DAY - 3_600_000)


TO = "(SELECT rejection_id, string_agg(recipient, ', ' ORDER BY recipient) AS names FROM {rejection_recipients} GROUP BY rejection_id)"
RECORD = f"concat('From: ', sender, chr(10), 'To: ', names, chr(10), 'Subject: ', subject, chr(10), 'Date: ', {_when('rejected_at_ms')}, chr(10), 'Rejection ID: ', id, chr(10), 'Reason: ', reason, chr(10), chr(10))"


@query("c2_t8_rejection_listing", sql(f"SELECT concat(string_agg({RECORD}, '' ORDER BY rejected_at_ms, id), 'Results were limited to 30 matching records.', chr(10)) AS reply FROM (SELECT * FROM {{rejections}} WHERE rejected_at_ms >= {{orders_now}} - {RETAIN} ORDER BY rejected_at_ms DESC, id DESC LIMIT 30) LEFT JOIN {TO} ON rejection_id = id"))
def c2(spark, sf_dir):
    rows = histories.list_all(c.rejections(spark, sf_dir), c.rejection_recipients(spark, sf_dir), ORDERS_NOW, RETAIN, 31).drop("position", "truncated")
    return replies.listing(rows, [F.desc("rejected_at_ms"), F.desc("id")], replies.rejection_record(F.col("recipients")), "No retained rejected-email records were found.\n", 30, newest_last=True)


DETAIL = f"concat('Rejection ID: ', id, chr(10), 'From: ', sender, chr(10), 'To: ', names, chr(10), 'Subject: ', subject, chr(10), 'Date: ', {_when('rejected_at_ms')}, chr(10), 'Reason for rejection: ', reason, chr(10), chr(10), 'Visible email body text:', chr(10), CASE id % 4 WHEN 0 THEN 'Saved message is not available.' WHEN 1 THEN concat('NOTICE: Saved message was truncated during archiving; some headers or body content may be missing.', chr(10), chr(10), 'Hello ', sender) WHEN 2 THEN 'No readable message text was found.' ELSE concat('Hello ', sender) END, chr(10))"


@query("c3_m19_rejection_detail", sql(f"SELECT id, md5({DETAIL}) AS reply FROM {{rejections}} LEFT JOIN {TO} ON rejection_id = id"))
def c3(spark, sf_dir):
    """Every rejection in full, with the visible text of its archived HTML message."""
    html = F.expr("concat('Content-Type: text/html\\r\\n\\r\\n<title>t</title>', CASE id % 4 WHEN 2 THEN '' ELSE concat('<p>Hello <b>', sender, '</b></p>') END)")
    rows = c.rejections(spark, sf_dir).withColumn("content", F.when(F.col("id") % 4 != 0, F.encode(html, "UTF-8")))
    bodies = evidence.html_text(evidence.chosen_body(evidence.message_parts(rows.filter("content IS NOT NULL").select("id", "content"))).select("id", F.col("text").alias("html")))
    shown = bodies.select("id", text.normalised_space(text.body_text(F.col("visible"))).alias("body"))
    names = c.rejection_recipients(spark, sf_dir).groupBy(F.col("rejection_id").alias("id")).agg(F.sort_array(F.collect_list("recipient")).alias("recipients"))
    whole = rows.join(names, "id", "left").join(shown, "id", "left")
    return whole.select("id", F.md5(replies.rejection_detail(F.col("recipients"), F.col("content"), F.col("body"), F.col("id") % 4 == 1)).alias("reply"))


@query("c4_correspondent_listing", sql("SELECT concat(string_agg(concat('Sender: ', correspondent, chr(10), 'Recipient: ', local_address, chr(10), 'Added: ', CASE whitelist_type WHEN 'manual' THEN 'manually' WHEN 'authenticated_outbound' THEN 'learned from authenticated outbound email' ELSE 'learned from repeated legitimate inbound emails' END, chr(10), chr(10)), '' ORDER BY last_activity_at_ms DESC, local_address, correspondent), 'Results were limited to 40 matching records.', chr(10)) AS reply FROM (SELECT * FROM {correspondents} ORDER BY last_activity_at_ms DESC, local_address, correspondent LIMIT 40)"))
def c4(spark, sf_dir):
    order = [F.desc("last_activity_at_ms"), F.asc("local_address"), F.asc("correspondent")]
    return replies.listing(c.correspondents(spark, sf_dir), order, replies.correspondent_record(True), "No whitelisted correspondent addresses were found.\n", 40)


@query("c5_rule_listing", sql(f"SELECT concat(string_agg(concat('Sender: ', CASE WHEN sender_kind = 2 THEN '*@' ELSE '' END, sender_value, chr(10), 'Recipient: ', recipient, chr(10), 'Expires: ', {_when('expires_at_ms')}, chr(10), chr(10)), '' ORDER BY expires_at_ms DESC, id DESC), CASE WHEN max(n) > 1000 THEN concat('Results were limited to 1000 matching records.', chr(10)) ELSE '' END) AS reply FROM (SELECT *, count(*) OVER () AS n FROM {{blocklist}} WHERE expires_at_ms > {{orders_now}} ORDER BY expires_at_ms DESC, id DESC LIMIT 1000)"))
def c5(spark, sf_dir):
    return replies.listing(live(c.blocklist(spark, sf_dir), ORDERS_NOW), [F.desc("expires_at_ms"), F.desc("id")], replies.rule_record(), "No active sender blocklist entries were found.\n")


@query("c6_ip_listing", sql(f"SELECT concat(string_agg(concat('IP: ', ip, ' (', CASE WHEN id % 5 = 0 THEN 'not found' ELSE concat('h', id, '.example') END, ') Type: ', block_level, ' Expires: ', {_when('blocked_until_ms')}, chr(10)), '' ORDER BY blocked_until_ms, ip), CASE WHEN max(n) > 50 THEN concat('Results were limited to 50 matching records.', chr(10)) ELSE '' END) AS reply FROM (SELECT *, count(*) OVER () AS n FROM {{reputation}} WHERE blocked_until_ms > {{now}} ORDER BY blocked_until_ms DESC, ip DESC LIMIT 50)"))
def c6(spark, sf_dir):
    """A row of the state is a user's: from 64,000 users on some share an address, and rows of equal times and addresses go by id."""
    rows = c.reputation(spark, sf_dir).withColumn("hostname", F.expr("CASE WHEN id % 5 <> 0 THEN concat('h', CAST(id AS STRING), '.example') END"))
    blocks = reputation.active_blocks(rows, c.strikes(spark, sf_dir), EVENTS_NOW, "id", "hostname")
    return replies.listing(blocks, [F.desc("blocked_until_ms"), F.desc("ip"), F.desc("id")], replies.block_record(F.col("hostname")), "No active IP blocks were found.\n", 50, newest_last=True)


@query("st4_st5_manual_blocks", sql("SELECT ip, 'repeat' AS block_level FROM {reputation} WHERE id % 5 = 0 AND id % 7 <> 0 UNION ALL SELECT ip, block_level FROM {reputation} WHERE id % 5 <> 0 AND id % 7 <> 0"))
def st4(spark, sf_dir):
    """A row of the state is a user's: from 64,000 users on some share an address."""
    rows = c.reputation(spark, sf_dir)
    manual = rows.filter("id % 5 = 0").withColumns({"block_level": F.lit("repeat"), "blocked_until_ms": F.lit(EVENTS_NOW + BLOCKS.repeat_ms).cast("long")})
    return retention.upsert(rows, manual, ["id"], "last_activity_at_ms").filter("id % 7 <> 0").select("ip", "block_level")


@query("st10_st11_manual_trust", sql("SELECT id, CASE WHEN id % 4 = 0 THEN 'manual' ELSE whitelist_type END AS whitelist_type FROM {correspondents} WHERE NOT (local_address = 's3@in.example' AND id % 2 = 0)"))
def st10(spark, sf_dir):
    rows = c.correspondents(spark, sf_dir)
    manual = rows.filter("id % 4 = 0").withColumn("whitelist_type", F.lit("manual"))
    return retention.upsert(rows, manual, ["local_address", "correspondent"], "last_activity_at_ms").filter("NOT (local_address = 's3@in.example' AND id % 2 = 0)").select("id", "whitelist_type")


@query("st13_added_rejections", sql("SELECT m.id, count(DISTINCT r) AS recipients FROM (SELECT id, unnest(recipients) AS r FROM {messages}) m GROUP BY m.id"))
def st13(spark, sf_dir):
    parents, children = histories.add_rejections(c.messages(spark, sf_dir).select("id", "sender", "recipients"))
    return children.join(parents, children["rejection_id"] == parents["id"]).groupBy("id").agg(F.count(F.lit(1)).alias("recipients"))


@query("st18_st19_rules", sql("SELECT id, expires_at_ms + CASE WHEN id % 3 = 0 THEN {day} ELSE 0 END AS expires_at_ms FROM {blocklist} WHERE id % 4 <> 1"))
def st18(spark, sf_dir):
    rows = c.blocklist(spark, sf_dir)
    again = rows.filter("id % 3 = 0").withColumn("expires_at_ms", F.col("expires_at_ms") + DAY)
    return retention.upsert(rows, again, ["id"], "expires_at_ms").filter("id % 4 <> 1").select("id", "expires_at_ms")


@query("st24_service_status", "SELECT 1 AS id, 1704067200000 AS started_at_ms, 2 AS mode")
def st24(spark, sf_dir):
    return histories.set_status(1_704_067_200_000, 2, spark)


RAW = "concat('From: \"a@b.test\" <C', CAST(o_custkey AS STRING), '@Mail.Example.>, second@x.example (z@q.test)\\r\\nSubject: one\\r\\n two\\r\\nTo: undisclosed:;\\r\\nX-A: 1\\r\\nx-a: 2\\r\\n\\r\\nbody ', o_orderpriority)"


@query("m1_m2_d1_d10_d13_headers", "SELECT o_orderkey, concat('c', o_custkey, '@mail.example,second@x.example') AS senders, 'one two' AS subject, 2 AS values, TRUE AS empty_to, left(concat('body ', o_orderpriority), 8) AS body, TRUE AS truncated FROM orders WHERE length(o_orderpriority) > 3")
def m1(spark, sf_dir):
    rows = c.table(spark, sf_dir, "orders").filter("length(o_orderpriority) > 3").select("o_orderkey", F.expr(RAW).alias("raw"))
    parsed = rows.select("o_orderkey", headers.fields(F.col("raw")).alias("h"), headers.body(F.col("raw"), 8).alias("b"))
    return parsed.select("o_orderkey", F.array_join(headers.mailboxes(headers.first_value(F.col("h"), "From")), ",").alias("senders"), headers.first_value(F.col("h"), "subject").alias("subject"), headers.occurrences(F.col("h"), "X-A").alias("values"), headers.empty_group(headers.first_value(F.col("h"), "to")).alias("empty_to"), F.col("b.body").alias("body"), F.col("b.truncated").alias("truncated"))


@query("d11_d12_p9_protected_domains", "SELECT o_orderkey, o_custkey % 3 = 0 AS protected FROM orders")
def d11(spark, sf_dir):
    made = F.expr("concat('Bank <x@@', CASE WHEN o_custkey % 3 = 0 THEN 'Mail.Bank.test.' ELSE 'notbank.test' END, '> broken')")
    return c.table(spark, sf_dir, "orders").select("o_orderkey", headers.names_protected_domain(made, ("bank.test",)).alias("protected"))


@query("l9_l10_l13_destinations", "SELECT page_id, [concat('http://h.test/a/', page_id), 'http://h.test/x', 'https://o.test/y', 'mailto:a@b.test'][page_id % 5 + 1] AS target FROM pages")
def l9(spark, sf_dir):
    link = F.expr("CASE CAST(page_id % 5 AS INT) WHEN 0 THEN CAST(page_id AS STRING) WHEN 1 THEN ' /x' WHEN 2 THEN 'https://o.test/y' WHEN 3 THEN 'mailto:a@b.test' ELSE 'javascript:x' END")
    return c.table(spark, sf_dir, "pages").select("page_id", headers.resolved(link, F.lit("http://h.test/a/b.html?q#f")).alias("target"))


def _samples() -> list[tuple[str, bytes]]:
    """File names and contents: blocked names, programs alone and in nested archives, locked and broken archives, and text."""

    def zipped(name: str, data: bytes) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), data)
        return out.getvalue()

    def tarred(name: str, data: bytes) -> bytes:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        return out.getvalue()

    program = b"\x7fELF program"
    locked = bytearray(zipped("a", b"text"))
    locked[6] |= 1
    locked[locked.index(b"PK\x01\x02") + 8] |= 1
    return [("a.E\u200bXE", b"\0"), ("a.bin", b"MZ\x90"), ("a.zip", zipped("b", zipped("c", program))), ("a.tgz", gzip.compress(tarred("d/p", program), mtime=0)), ("a.zip", bytes(locked)), ("a.zip", b"PK\x03\x04\0"), ("a.zip", zipped("dir/x.js", b"text")), ("a.txt", b"text")]


SAMPLES = _samples()
_OF = lambda values: "CASE CAST(doc_id % 8 AS INT) " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
#: What is found in each of SAMPLES.
FOUND = ("'a.EXE: blocked extension .exe'", "'a.bin: program'", "'a.zip/b/c: program'", "'a.tgz/unnamed/p: program'", "NULL", "NULL", "'a.zip/x.js: blocked extension .js'", "NULL")
ERRORS = ("NULL", "NULL", "NULL", "NULL", "'encrypted'", "'unscannable'", "NULL", "NULL")


@query("at1_at8_scans", f"SELECT doc_id AS id, {_OF(FOUND)} AS detection, {_OF(ERRORS)} AS error_kind FROM documents")
def at1(spark, sf_dir):
    name, content = _OF([f"'{n}'" for n, _ in SAMPLES]), _OF([f"unhex('{d.hex()}')" for _, d in SAMPLES])
    rows = c.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("part"), F.expr(name).alias("filename"), F.expr(content).alias("content"))
    return attachments.scan_attachments(rows).select("id", "detection", "error_kind")


MESSAGES = {
    "concat('Content-Type: text/plain\r\n\r\n', text)": ("NULL", "NULL"),
    "concat('Content-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\n\r\nhi\r\n--b\r\nContent-Type: application/x\r\nContent-Transfer-Encoding: base64\r\n\r\n', base64(encode(concat('MZ', text), 'UTF-8')), '\r\n--b--')": ("'message/part-2: program'", "NULL"),
    "concat('Content-Type: multipart/digest; boundary=o\r\n\r\n--o\r\n\r\nContent-Type: multipart/mixed; boundary=i\r\n\r\n--i\r\nContent-Disposition: attachment; filename=run-', doc_id, '.js\r\n\r\n', lang, '\r\n--i--\r\n--o--')": ("concat('message/part-1/run-', doc_id, '.js: blocked extension .js')", "NULL"),
    "concat('Content-Type: application/x\r\nContent-Transfer-Encoding: base64\r\n\r\n', base64(encode(concat('x', lang), 'UTF-8')), '*')": ("NULL", "'unscannable'"),
    "concat('Content-Type: multipart/mixed\r\n\r\n', lang)": ("NULL", "'malformed'"),
    "concat('Content-Type: application/x\r\nContent-Transfer-Encoding: x-', lang, '\r\n\r\nx')": ("NULL", "'unscannable'"),
    "concat('Content-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\n', lang)": ("NULL", "'unscannable'"),
}


def _of_seven(values: list[str]) -> str:
    return "CASE CAST(doc_id % 7 AS INT) " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query("at2_at5_at15_message_scans", f"SELECT doc_id AS id, {_of_seven([d for d, _ in MESSAGES.values()])} AS detection, {_of_seven([e for _, e in MESSAGES.values()])} AS error_kind FROM documents")
def at2(spark, sf_dir):
    rows = c.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode(F.expr(_of_seven(list(MESSAGES))), "UTF-8").alias("content"))
    return attachments.scan_messages(rows)
