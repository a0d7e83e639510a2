"""Queries on what is told of attachments: metadata, sections, attached headers, charsets, images and serialised messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attached
from ..operators.retention import newest
from . import carriers as c

QUERIES, SQL = {}, {}


def query(name: str, duck: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if duck:
            SQL[name] = duck
        return fn

    return add


def docs(spark, sf_dir):
    return c.table(spark, sf_dir, "documents")


def binary(words: str):
    return F.encode(F.expr(words), "UTF-8")


NAME = "concat('<', source, chr(10), left(regexp_replace(text, '[^ -~]', 'u', 'g'), 1000), '>')"
CLEAN = f"replace(replace(regexp_replace({NAME}, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '<', '&lt;'), '>', '&gt;')"


@query("x27_metadata", f"SELECT doc_id, md5(concat(left({CLEAN}, 1024), CASE WHEN length({CLEAN}) > 1024 THEN ' [metadata truncated]' ELSE '' END)) AS told FROM documents")
def x27(spark, sf_dir):
    name = F.expr("concat('<', source, chr(10), left(regexp_replace(text, '[^ -~]', 'u'), 1000), '>')")
    return docs(spark, sf_dir).select("doc_id", F.md5(attached.metadata_value(name)).alias("told"))


WRAPPED = "concat('<attached-file>', chr(10), 'Filename: ', source, '.txt', chr(10), 'Content-Type: text/plain', chr(10), chr(10), text, chr(10), '</attached-file>')"


@query("m13_m14_sections", f"SELECT doc_id, md5({WRAPPED}) AS text, length({WRAPPED}) AS ends, length(text) AS inside, concat('[attachment: ', source, ' x; type=', lang, '/x]') AS marker FROM documents")
def m13(spark, sf_dir):
    none = F.expr(f"CAST(array() AS {attached.SPANS})")
    rows = docs(spark, sf_dir).select("doc_id", "source", "lang", attached.wrapped(F.col("text"), none, "attached-file", F.concat("source", F.lit(".txt")), F.lit("text/plain"), F.lit(None).cast("string")).alias("w"))
    span = F.get("w.spans", F.lit(0))
    return rows.select("doc_id", F.md5("w.text").alias("text"), span["end"].alias("ends"), (span["close_start"] - span["body_start"]).alias("inside"), attached.marker(F.concat("lang", F.lit("/x")), F.concat("source", F.lit("\nx"))).alias("marker"))


NOTICE = "chr(10) || '[processed email body truncated; the remainder was omitted]'"


@query("x14_cut_sections", f"SELECT doc_id, md5(CASE WHEN length(b) <= 400 THEN b ELSE concat(left(b, 400 - 60 - 17), {NOTICE}, chr(10), '</attached-file>') END) AS body FROM (SELECT doc_id, {WRAPPED} AS b FROM documents)")
def x14(spark, sf_dir):
    none = F.expr(f"CAST(array() AS {attached.SPANS})")
    rows = docs(spark, sf_dir).select("doc_id", attached.wrapped(F.col("text"), none, "attached-file", F.concat("source", F.lit(".txt")), F.lit("text/plain"), F.lit(None).cast("string")).alias("w"))
    return attached.cut_bodies(rows.select("doc_id", "w.text", "w.spans"), "text", "spans", 400).select("doc_id", F.md5("text").alias("body"))


@query("x22_last_index", "SELECT doc_id, CASE WHEN contains(lower(a), 'the') THEN length(a) - strpos(reverse(lower(a)), 'eht') - 2 ELSE -1 END AS at FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '__', 'g') AS a FROM documents)")
def x22(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", attached.last_index(F.expr("regexp_replace(text, '[^ -~]', 'é')"), F.lit("tHe")).alias("at"))


@query("m9_html_charsets", "SELECT doc_id, md5(concat('<p>', source, chr(233), '</p>')) AS html FROM documents")
def m9(spark, sf_dir):
    """The same text in UTF-8 and Latin-1, told by a label, by a byte order mark, by a meta element or not at all."""
    body, k = F.concat(F.lit("<p>"), "source", F.lit("é</p>")), F.col("doc_id") % 4
    latin = F.when(k < 2, F.encode(body, "ISO-8859-1")).when(k == 2, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(body, "UTF-8"))).otherwise(F.encode(body, "UTF-8"))
    label = F.when(k == 0, "iso-8859-1").when(k == 1, "no such").otherwise(None)
    return docs(spark, sf_dir).select("doc_id", F.md5(attached.html_text_of(latin, label)).alias("html"))


RAW = "concat('From: ', source, ' <a@b.test>\\r\\nsubject: one\\r\\n two ', lang, '\\r\\nX-A: no\\r\\nContent-Type: text/', lang, '\\r\\nContent-Type: no/no\\r\\n\\r\\n', text)"


@query("m11_attached_headers", "SELECT doc_id, concat('text/', lang) AS content_type, concat('From: ', source, ' &lt;a@b.test&gt;', chr(10), 'Subject: one two ', lang, chr(10)) AS metadata, md5(text) AS body FROM documents")
def m11(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", binary(RAW).alias("raw")).withColumn("h", attached.attached_message(F.col("raw")))
    body = F.decode(F.substring("raw", F.col("h.body_at") + 1, F.octet_length("raw")), "UTF-8")
    return rows.select("doc_id", "h.content_type", "h.metadata", F.md5(body).alias("body"))


PNG = "concat('89504E470D0A1A0A0000000D49484452', lpad(hex(CAST(1 + doc_id % 50 AS BIGINT)), 8, '0'), lpad(hex(CAST(1 + part * 10 AS BIGINT)), 8, '0'), '080200000000000000')"


@query("m16_m17_vision_images", "SELECT doc_id, part FROM (SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id ORDER BY (doc_id + part) % 3 = 0 DESC, part) AS k FROM documents, range(5) t(part) WHERE (1 + doc_id % 50) * (1 + part * 10) <= 500) WHERE k <= 2")
def m17(spark, sf_dir):
    """Two images of a message, those that its body refers to first, of those that are small enough by their headers."""
    rows = docs(spark, sf_dir).select("doc_id", F.explode(F.expr("sequence(0L, 4L)")).alias("part"))
    images = rows.withColumn("content", F.unhex(F.expr(PNG))).withColumn("media_type", attached.usable_image(F.col("content"), 1 << 20, 500)).filter("media_type IS NOT NULL")
    ranked = images.withColumns({"referenced": F.expr("CASE WHEN (doc_id + part) % 3 = 0 THEN 1 ELSE 0 END"), "early": -F.col("part")})
    return newest(ranked, ["doc_id"], "referenced", 2, "early").select("doc_id", "part")


@query("src14_serialised", "SELECT doc_id, md5(left(concat('A: ', source, chr(13), chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('X-Archive-Truncated: yes', chr(13), chr(10)) ELSE concat('B: ', lang, chr(13), chr(10), ' ', repeat('y', 30), chr(13), chr(10)) END, chr(13), chr(10), regexp_replace(text, '[^ -~]', '_', 'g')), 100)) AS message FROM documents")
def src14(spark, sf_dir):
    """Half of the messages were cut before: their mark takes the place of a folded field that doesn't fit any more."""
    rows = docs(spark, sf_dir)
    headers = binary("concat('A: ', source, '\\r\\nB: ', lang, '\\r\\n ', repeat('y', 30), CASE WHEN doc_id % 2 = 0 THEN repeat('z', 60) ELSE '' END, '\\r\\n')")
    message = attached.serialised(headers, binary("regexp_replace(text, '[^ -~]', '_')"), 100, F.col("doc_id") % 2 == 0)
    return rows.select("doc_id", F.md5(message).alias("message"))


@query("m12_file_parts", "SELECT doc_id, CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE WHEN 3 THEN FALSE WHEN 4 THEN FALSE ELSE FALSE END AS is_file FROM documents")
def m12_file(spark, sf_dir):
    k = F.col("doc_id") % 6
    media = F.when(k == 5, "image/png").otherwise("text/plain")
    disposition = F.when(k == 0, "Attachment").when(k == 1, "inline").when(k == 5, "attachment")
    parent = F.when(k == 3, "multipart/related").otherwise("multipart/mixed")
    return docs(spark, sf_dir).select("doc_id", attached.is_file(media, disposition, F.when(k < 2, F.col("source")), F.when(k != 4, F.concat(F.lit("n"), "source")), parent).alias("is_file"))
