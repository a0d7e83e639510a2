"""Queries on message evidence: authentication headers, parts, visible HTML, archive days, aliases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import evidence, policy
from ..sources import files
from ..sources.schemas import migrate_activity
from . import carriers as c
from .carriers import sql

QUERIES, SQL = {}, {}


def query(name: str, words: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if words:
            SQL[name] = words
        return fn

    return add


HEADER = "concat(CASE WHEN o_custkey % 4 = 0 THEN 'other.example' ELSE 'MX.example' END, ' 1; dkim=', CASE WHEN o_custkey % 2 = 0 THEN 'pass' ELSE 'fail' END, ' (2048; \"ok\") header.d=out.example; spf=tempfail smtp.mailfrom=\"c', CAST(o_custkey AS STRING), '@Mail.Example.\"; arc=none; dmarc=pass header.from=a.example header.from=b.example')"


@query("au1_au4_authentication_results", "SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN '' ELSE concat('dkim=', CASE WHEN o_custkey % 2 = 0 THEN 'pass' ELSE 'fail' END, ' out.example,spf=temperror mail.example,dmarc=pass -') END AS results FROM orders")
def au1(spark, sf_dir):
    found = evidence.authentication_results(F.array(F.expr(HEADER)), ("mx.example",))
    told = F.array_join(F.transform(found, lambda r: F.concat(r["method"], F.lit("="), r["outcome"], F.lit(" "), F.coalesce(r["domain"], F.lit("-")))), ",")
    return c.table(spark, sf_dir, "orders").select("o_orderkey", told.alias("results"))


@query("au5_au8_evidence", "SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN CASE WHEN o_custkey % 8 = 0 THEN 'dkim=unavailable -,spf=unavailable -,dmarc=unavailable -' ELSE 'spf=softfail c.example,dkim=unavailable -,dmarc=unavailable -' END ELSE concat('dkim=', CASE WHEN o_custkey % 2 = 0 THEN 'pass' ELSE 'fail' END, ' out.example,spf=temperror mail.example,dmarc=pass -') END AS results, o_custkey % 4 = 2 AS dkim_aligned FROM orders")
def au5(spark, sf_dir):
    receiver = F.when(F.col("o_custkey") % 8 == 0, "other.example").otherwise("MX.example.")
    spf = F.array(F.concat(F.lit("SoftFail (why) client-ip=1.2.3.4; receiver="), receiver, F.lit("; envelope-from=\"<a@C.example>\"; helo=x")))
    rows = c.table(spark, sf_dir, "orders").select("o_orderkey", evidence.evidence(F.array(F.expr(HEADER)), spf, ("mx.example",)).alias("r"))
    told = F.array_join(F.transform("r", lambda r: F.concat(r["method"], F.lit("="), r["outcome"], F.lit(" "), F.coalesce(r["domain"], F.lit("-")))), ",")
    return rows.select("o_orderkey", told.alias("results"), evidence.passes(F.col("r"), "dkim", F.lit("www.out.example")).alias("dkim_aligned"))


@query("h43_h37_visible_html")
def h43(spark, sf_dir):
    rows = evidence.html_text(c.table(spark, sf_dir, "pages").select("page_id", "html"))
    clean = text.normalised_space(text.body_text(F.col("visible")))
    return rows.select("page_id", F.length(clean).alias("characters"), F.md5(clean).alias("visible"), F.size(text.capped_links(F.col("links"))).alias("links"), "incomplete")


MESSAGE = "concat('MIME-Version: 1.0\\r\\nSubject: x\\r\\nContent-Type: multipart/mixed; boundary=b\\r\\n\\r\\n--b\\r\\nContent-Type: text/plain; charset=utf-8\\r\\nContent-Transfer-Encoding: base64\\r\\n\\r\\n', base64(encode(text, 'UTF-8')), '\\r\\n--b\\r\\nContent-Type: application/zip; name=a.zip\\r\\nContent-Disposition: attachment; filename=a.zip\\r\\n\\r\\nPK\\r\\n--b--\\r\\n')"


@query("m4_m7_message_parts", "SELECT doc_id AS id, 'text/plain' AS content_type, md5(text) AS text FROM documents")
def m4(spark, sf_dir):
    sent = c.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode(F.expr(MESSAGE), "UTF-8").alias("content"))
    body = evidence.chosen_body(evidence.message_parts(sent))
    return body.select("id", "content_type", F.md5("text").alias("text"))


@query("m12_attachment_parts", "SELECT 'a.zip' AS filename, count(*) AS n, CAST(2 * count(*) AS BIGINT) AS bytes FROM documents")
def m12(spark, sf_dir):
    sent = c.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode(F.expr(MESSAGE), "UTF-8").alias("content"))
    parts = evidence.message_parts(sent).filter("filename IS NOT NULL")
    return parts.groupBy("filename").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


@query("src10_st27_archive_days", "SELECT strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS m, strftime(o_orderdate, '%d') AS d, count(*) AS n FROM orders WHERE o_orderdate < DATE '1995-06-01' GROUP BY ALL")
def src10(spark, sf_dir):
    rows = c.table(spark, sf_dir, "orders").select(*files.day_parts(c.millis("o_orderdate")))
    return files.expired_days(rows.groupBy("y", "m", "d").agg(F.count(F.lit(1)).alias("n")), 801_964_800_000)


@query("src6_migrated_activity", sql("SELECT event_type, count(*) AS n, sum(CASE WHEN event_type = 1 THEN 1 ELSE 0 END) AS kept, CAST(count(*) AS BIGINT) AS quantity FROM {activity} GROUP BY event_type"))
def src6(spark, sf_dir):
    old = c.activity(spark, sf_dir).drop("quantity").na.fill({"token_cost": 0.0}).na.fill({"analysis_failed": False})
    new = migrate_activity(old, 4)
    return new.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("token_cost").alias("kept"), F.sum("quantity").alias("quantity"))


ALIASES = "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 13 = 6 THEN s_suppkey ELSE s_suppkey * 7 // 10 END AS t FROM supplier WHERE s_suppkey % 5 <> 0"


@query("d16_alias_owner", f"WITH RECURSIVE steps AS ({ALIASES}), walk AS (SELECT s_suppkey AS start, s_suppkey AS k, 0 AS n FROM supplier UNION ALL SELECT start, t, n + 1 FROM walk JOIN steps USING (k) WHERE n < 200) SELECT concat('a', start) AS name, concat('a', k) AS owner FROM walk WHERE k NOT IN (SELECT k FROM steps)")
def d16(spark, sf_dir):
    """Chains that end at every fifth supplier or at 0; every thirteenth is an alias of itself."""
    rows = c.table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("concat('a', CAST(s_suppkey AS STRING))").alias("name"), F.expr("concat('A', CAST(CASE WHEN s_suppkey % 13 = 6 THEN s_suppkey ELSE s_suppkey * 7 DIV 10 END AS STRING))").alias("target"))
    return files.alias_owner(rows.filter("s_suppkey % 5 <> 0"), rows.select("name"))


@query("m18_m20_prompt_sections", "SELECT o_orderkey, concat('From: c', o_custkey, chr(10), 'Priority: ', o_orderpriority, chr(10), chr(10), 'Confidence: ', CASE WHEN o_totalprice / 500000 < 0.8 THEN 'low' ELSE 'high' END) AS prompt FROM orders")
def m18(spark, sf_dir):
    from ..functions.numbers import confidence

    head = F.concat_ws("\n", F.concat(F.lit("From: c"), F.col("o_custkey").cast("string")), F.concat(F.lit("Priority: "), text.header_value(F.col("o_orderpriority"))))
    return c.table(spark, sf_dir, "orders").select("o_orderkey", text.joined_parts(F.array(head, F.lit(""), F.concat(F.lit("Confidence: "), confidence(F.col("o_totalprice") / 500000)))).alias("prompt"))


@query("m16_vision_images", "SELECT doc_id, part FROM (SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id ORDER BY (doc_id + part) % 3 = 0 DESC, part) AS k FROM documents, range(5) t(part) WHERE (doc_id + part) % 2 = 0) WHERE k <= 2")
def m16(spark, sf_dir):
    from ..operators.retention import newest

    rows = c.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.expr("sequence(0L, 4L)")).alias("part")).filter("(doc_id + part) % 2 = 0")
    ranked = rows.withColumn("referenced", F.expr("CASE WHEN (doc_id + part) % 3 = 0 THEN 1 ELSE 0 END")).withColumn("early", -F.col("part"))
    return newest(ranked, ["doc_id"], "referenced", 2, "early").select("doc_id", "part")
