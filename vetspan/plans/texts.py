"""Queries on text, links, addresses, numbers, colours and file signatures, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import addresses, numbers, text
from ..operators import activity as act
from ..operators import correspondents, policy
from . import carriers as c
from .carriers import DAY, EVENTS_NOW, ORDERS_NOW, sql

QUERIES, SQL = {}, {}


def query(name: str, duck: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if duck:
            SQL[name] = duck
        return fn

    return add


def docs(spark, sf_dir, **columns):
    """doc_id and the named columns over `documents`, as md5 for long texts."""
    return c.table(spark, sf_dir, "documents").select("doc_id", *[e.alias(n) for n, e in columns.items()])


#: A text with controls, padding and tags mixed in, the same in Spark and DuckDB.
DIRTY = "concat(text, chr(13), chr(10), ' <Invisible>', lang, '</invisible > ', repeat(chr(8203), 40), chr(9), chr(10), chr(10), chr(10), '*x* [y](z)')"


def words():
    return F.col("text")


def dirty():
    return F.concat(words(), F.lit("\r\n <Invisible>"), F.col("lang"), F.lit("</invisible > " + "\u200b" * 40 + "\t\n\n\n*x* [y](z)"))


WS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


FLAT = sub(sub(DIRTY, r"\p{Cc}", " "), f"[{WS}]+", " ")


@query("x1_single_line", f"SELECT doc_id, md5(CASE WHEN length(t) > 200 THEN concat(left(t, 200), '…') ELSE t END) AS line FROM (SELECT doc_id, trim({FLAT}) AS t FROM documents)")
def x1(spark, sf_dir):
    return docs(spark, sf_dir, line=F.md5(text.single_line(dirty(), 200)))


@query("x2_reasons", f"SELECT doc_id, md5(concat(trim({sub('lang', ' +', ' ')}), '; ', trim({sub('source', ' +', ' ')}))) AS reasons FROM documents")
def x2(spark, sf_dir):
    return docs(spark, sf_dir, reasons=F.md5(text.joined_reasons(F.array(F.col("lang"), F.lit(" "), F.col("source")))))


NL = "chr(10)"
SPACED = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({DIRTY}, '\\r\\n?', {NL}, 'g'), '[ \\t\\f]+', ' ', 'g'), ' ?\\n ?', {NL}, 'g'), '\\n{{3,}}', {NL} || {NL}, 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')".replace("{{", "{").replace("}}", "}")


@query("x3_normalised_space", f"SELECT doc_id, md5({SPACED}) AS t, length({SPACED}) AS n FROM documents")
def x3(spark, sf_dir):
    out = text.normalised_space(dirty())
    return docs(spark, sf_dir, t=F.md5(out), n=F.length(out).cast("long"))


@query("x4_x11_padding_only", "SELECT doc_id, doc_id % 3 = 0 AS only FROM documents")
def x4(spark, sf_dir):
    return docs(spark, sf_dir, only=text.is_padding_only(F.when(F.col("doc_id") % 3 == 0, F.lit("​ ⁠ ")).otherwise(F.concat(F.lit(" x"), F.col("lang")))))


@query("x5_x6_x8_body_text", "SELECT doc_id, md5(concat(text, chr(13), chr(10), ' ', lang, ' ', repeat(chr(8203), 7), '*x* [y](z)')) AS t FROM documents")
def x5(spark, sf_dir):
    return docs(spark, sf_dir, t=F.md5(text.body_text(dirty())))


@query("x9_confident_characters", "SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t\\f]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')) AS n FROM documents")
def x9(spark, sf_dir):
    return docs(spark, sf_dir, n=text.confident_characters(words()))


@query("x10_format_characters", f"SELECT doc_id, md5({sub(sub(DIRTY, chr(92) + 'p{Cf}|' + chr(92) + 'x{034F}', ''), ' {2,}', ' ')}) AS t FROM documents")
def x10(spark, sf_dir):
    return docs(spark, sf_dir, t=F.md5(text.without_format_characters(dirty())))


@query("x12_ascii_space", f"SELECT doc_id, md5({sub(DIRTY, '[ \\t\\n\\f\\r]+', ' ')}) AS t FROM documents")
def x12(spark, sf_dir):
    return docs(spark, sf_dir, t=F.md5(text.ascii_space_folded(dirty())))


@query("x13_x15_truncated", "SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN concat(left(text, 500), chr(10), '[processed email body truncated; the remainder was omitted]') ELSE text END) AS t FROM documents")
def x13(spark, sf_dir):
    return docs(spark, sf_dir, t=F.md5(text.truncated(words(), 500)))


@query("x16_x17_x18_header_values", f"SELECT doc_id, md5(translate({DIRTY}, chr(13) || chr(10), '  ')) AS header, md5(left(trim({sub(DIRTY, chr(92) + 'p{Cc}', '')}), 255)) AS connection FROM documents")
def x16(spark, sf_dir):
    return docs(spark, sf_dir, header=F.md5(text.header_value(dirty())), connection=F.md5(text.connection_value(dirty())))


@query("x19_canonical_header", "SELECT doc_id, concat(upper(left(lang, 1)), substr(lang, 2), '-', upper(left(source, 1)), substr(source, 2), '-Id') AS name FROM documents")
def x19(spark, sf_dir):
    return docs(spark, sf_dir, name=text.canonical_header(F.concat_ws("-", "lang", "source", F.lit("id"))))


@query("x20_l11_markdown", r"SELECT doc_id, md5(regexp_replace(text || '*x* [y](z)', '([\\\[\]])', '\\\1', 'g')) AS label, replace(replace(replace(concat('a b(', lang, ')<'), ' ', '%20'), '(', '%28'), ')', '%29').replace('<', '%3C') AS url FROM documents")
def x20(spark, sf_dir):
    return docs(spark, sf_dir, label=F.md5(text.markdown_escaped(F.concat(words(), F.lit("*x* [y](z)")))), url=text.markdown_url(F.concat(F.lit("a b("), F.col("lang"), F.lit(")<"))))


@query("x21_byte_truncated", "SELECT doc_id, md5(t) AS cut FROM (SELECT doc_id, max_by(left(text, n), n) AS t FROM (SELECT doc_id, text, unnest(range(101)) AS n FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)) WHERE strlen(left(text, n)) <= 100 GROUP BY doc_id)")
def x21(spark, sf_dir):
    return docs(spark, sf_dir, cut=F.md5(text.byte_truncated(F.coalesce(words(), F.lit("")), 100)))


@query("x23_joined_parts", "SELECT doc_id, md5(concat(text, chr(10), chr(10), lang)) AS t FROM documents WHERE text <> '' AND lang <> ''")
def x23(spark, sf_dir):
    return c.table(spark, sf_dir, "documents").filter("text <> '' AND lang <> ''").select("doc_id", F.md5(text.joined_parts(F.array(words(), F.lit(""), F.col("lang")))).alias("t"))


@query("x24_comment_summary", "SELECT page_id, CASE WHEN w > 0 OR (n >= 100 AND n >= b) THEN concat(chr(10), 'EXTRACTOR-GENERATED HTML COMMENT SUMMARY: Omitted HTML comment text', CASE WHEN b > 0 THEN concat(' was ', CAST(round_even(n * 100.0 / b, 0) AS BIGINT), '% of extracted body length') ELSE ' accompanied an empty extracted body' END, CASE WHEN w = 1 THEN '; 1 comment occurred within words' WHEN w > 1 THEN concat('; ', w, ' comments occurred within words') ELSE '' END, '.', chr(10)) ELSE '' END AS t FROM (SELECT page_id, length(html) * (page_id % 4) AS n, page_id % 3 AS w, CASE WHEN page_id % 5 = 0 THEN 0 ELSE length(html) END AS b FROM pages)")
def x24(spark, sf_dir):
    body = F.when(F.col("page_id") % 5 == 0, 0).otherwise(F.length("html"))
    told = text.comment_summary(F.length("html") * (F.col("page_id") % 4), F.col("page_id") % 3, body)
    return c.table(spark, sf_dir, "pages").select("page_id", told.alias("t"))


@query("x25_annotations", "SELECT page_id, page_id % 2 = 0 OR contains(html, '<invisible ') AS invisible, page_id % 3 = 0 OR contains(html, '<quoted-content>') AS quoted_content, contains(html, '<hidden-content-stripped/>') AS hidden_content_stripped FROM pages")
def x25(spark, sf_dir):
    marked = F.concat("html", F.when(F.col("page_id") % 2 == 0, '<invisible reason="opacity">x</invisible>').otherwise("<invisible>"), F.when(F.col("page_id") % 3 == 0, "<quoted-content>").otherwise("<quoted-content "))
    flags = text.annotations(marked)
    return c.table(spark, sf_dir, "pages").select("page_id", *[flags[n].alias(n) for n in ("invisible", "quoted_content", "hidden_content_stripped")])


@query("x26_command_lines", "SELECT doc_id, CAST(len(l) AS BIGINT) AS n, md5(array_to_string(l, '|')) AS t FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)")
def x26(spark, sf_dir):
    found = text.lines(words())
    return docs(spark, sf_dir, n=F.size(found).cast("long"), t=F.md5(F.array_join(found, "|")))


@query("x28_smtp_identity", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE left(concat('<a', doc_id, '@', source, '.example> ', lang, repeat('x', CAST(doc_id % 300 AS INT))), 255) END AS identity FROM documents")
def x28(spark, sf_dir):
    name = F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, " UNKNOWN").otherwise("[Unknown]\n")).otherwise(F.concat(F.lit(" \x07<a"), F.col("doc_id").cast("string"), F.lit("@"), F.col("source"), F.lit(".example> "), F.col("lang"), F.repeat(F.lit("x"), (F.col("doc_id") % 300).cast("int"))))
    return docs(spark, sf_dir, identity=text.smtp_identity(name))


def _balanced(found: str) -> str:
    for opening, closing in ("()", "[]", "{}"):
        count = lambda x: f"(length(u) - length(replace(u, '{x}', '')))"
        found = f"list_transform({found}, lambda u: CASE WHEN ends_with(u, '{closing}') AND {count(closing)} > {count(opening)} THEN regexp_replace(left(u, length(u) - 1), '[.,;:!?]+$', '') ELSE u END)"
    return found


FOUND = _balanced("""list_transform(regexp_extract_all(html, '(?i)https?://[^ \\t\\n\\f\\r<>''\"]+'), lambda u: regexp_replace(u, '[.,;:!?]+$', ''))""".replace("\\\\", "\\"))


@query("l1_l2_l8_page_links", rf"SELECT page_id, array_to_string(list_filter(found, lambda u, i: list_position(found, u) = i), ' ') AS links FROM (SELECT page_id, list_filter({FOUND}, lambda u: regexp_matches(u, '(?i)^https?://[^/?#\s]+')) AS found FROM pages)")
def l1(spark, sf_dir):
    rows = c.table(spark, sf_dir, "pages").select("page_id", text.urls(F.col("html")).alias("found"))
    return rows.select("page_id", F.array_join(text.capped_links(F.col("found"), 100, 1 << 20), " ").alias("links"))


#: Page addresses made long in turn by a segment, a file name, a query and a fragment, with user information.
LONGER = "CASE CAST(page_id % 5 AS INT) WHEN 0 THEN url WHEN 1 THEN concat(url, '/', repeat('segment-', 9), page_id) WHEN 2 THEN concat('HTTP://u:p@h.test/', repeat('file-', 15), page_id, '%2Epdf') WHEN 3 THEN concat('https://h.test/?', repeat('key', 20), '=', repeat('é', 60), '&x=', page_id) ELSE concat('https://h.test/', page_id, '#', repeat('frag', 200)) END"
_PART = lambda i: f"regexp_extract(u, '(?s)^([A-Za-z][A-Za-z0-9+.-]*)://((?:[^/?#]*@)?)([^/?#@]+)([^?#]*)((?:\\?[^#]*)?)((?:#.*)?)$', {i})"
_PATH = "array_to_string(list_transform(string_split(p, '/'), lambda s: CASE WHEN length(s) <= 64 THEN s WHEN regexp_matches(s, '(?s)^.+(\\.|%2[Ee])[A-Za-z0-9]{1,16}$') THEN right(s, 64) ELSE left(s, 64) END), '/')"
_QUERY = "CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_transform(string_split(substr(q, 2), '&'), lambda s: CASE WHEN contains(s, '=') THEN left(split_part(s, '=', 1), 50) || '=' || left(substr(s, strpos(s, '=') + 1), 50) ELSE left(s, 50) END), '&') END"


def _compacted(address: str) -> str:
    """SQL of page_id and short of an address of each page."""
    return f"SELECT page_id, CASE WHEN p <> sp OR q <> sq OR f <> sf OR length(u) > 512 THEN left(lower({_PART(1)}) || '://' || CASE WHEN {_PART(2)} <> '' THEN '[userinfo-omitted]@' ELSE '' END || {_PART(3)} || sp || sq || sf, 512) ELSE u END AS short FROM (SELECT *, {_PATH} AS sp, {_QUERY} AS sq, left(f, 51) AS sf FROM (SELECT *, {_PART(4)} AS p, {_PART(5)} AS q, {_PART(6)} AS f FROM (SELECT page_id, {address} AS u FROM pages)))"


@query("l4_l5_compact_url", _compacted(LONGER))
def l4(spark, sf_dir):
    return c.table(spark, sf_dir, "pages").select("page_id", text.compact_url(F.expr(LONGER)).alias("short"))


@query("l1_l2_l8_all_page_links", SQL["l1_l2_l8_page_links"])
def l1_all(spark, sf_dir):
    """Links of all pages, with those that end in a bracket."""
    links = text.capped_links(text.urls(F.col("html")), 100, 1 << 20)
    return c.table(spark, sf_dir, "pages").select("page_id", F.array_join(links, " ").alias("links"))


WITH_TAIL = f"concat(url, '/{'segment-' * 9}?key={'value' * 11}')"


@query("l4_l5_compact_all_urls", f"SELECT page_id, one.short, two.short AS short_of_longer FROM ({_compacted('url')}) one JOIN ({_compacted(WITH_TAIL)}) two USING (page_id)")
def l4_all(spark, sf_dir):
    """Addresses of all pages, the longest of which are cut, and a long form of each."""
    return c.table(spark, sf_dir, "pages").select("page_id", text.compact_url(F.col("url")).alias("short"), text.compact_url(F.expr(WITH_TAIL)).alias("short_of_longer"))


@query("u3_new_links", "SELECT page_id, CAST(len(list_filter(['http://a.example/', url], lambda u: NOT contains(html, u))) AS BIGINT) AS n FROM pages")
def u3(spark, sf_dir):
    return c.table(spark, sf_dir, "pages").select("page_id", F.size(text.new_links(F.array(F.lit("http://a.example/"), F.col("url")), F.col("html"))).cast("long").alias("n"))


@query("l12_content_id", "SELECT doc_id, concat('part+', lang, '@x y') AS id FROM documents")
def l12(spark, sf_dir):
    return docs(spark, sf_dir, id=text.content_id(F.concat(F.lit("<Part+"), F.col("lang"), F.lit("@X%20y>"))))


@query("d2_d3_normalised_address", "SELECT o_orderkey, concat('user', o_custkey, '@mail.example') AS address, 'mail.example' AS domain FROM orders")
def d2(spark, sf_dir):
    made = addresses.normalised(F.concat(F.lit(" User"), F.col("o_custkey").cast("string"), F.lit("@Mail.EXAMPLE ")))
    return c.table(spark, sf_dir, "orders").select("o_orderkey", made.alias("address"), addresses.domain_of(made).alias("domain"))


@query("d4_dns_names", "SELECT doc_id, regexp_matches(w, '^[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?(\\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$') AS ok FROM (SELECT doc_id, left(string_split(text, ' ')[1], 80) AS w FROM documents WHERE text <> '')")
def d4(spark, sf_dir):
    word = F.left(F.get(F.split(words(), " "), F.lit(0)), F.lit(80))
    return c.table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", addresses.is_dns_name(word).alias("ok"))


@query("d5_d6_alignment", "SELECT o_orderkey, o_custkey % 4 IN (0, 1) AS aligned FROM orders")
def d5(spark, sf_dir):
    other = F.expr("CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 'mail.shop.co.test' WHEN 1 THEN 'x@Shop.CO.test.' WHEN 2 THEN 'co.test' ELSE 'other.co.test' END")
    return c.table(spark, sf_dir, "orders").select("o_orderkey", addresses.aligned(F.lit("www.shop.co.test"), addresses.identity_domain(other), ("test", "co.test")).alias("aligned"))


@query("d8_ip_numbers", "SELECT user_id, CAST(user_id AS BIGINT) * 65536 + 258 AS n FROM (SELECT DISTINCT user_id % 200 AS user_id FROM events)")
def d8(spark, sf_dir):
    rows = c.table(spark, sf_dir, "events").select((F.col("user_id") % 200).alias("user_id")).distinct()
    ip = F.concat(F.lit("::FFFF:0."), F.col("user_id").cast("string"), F.lit(".1.2"))
    return rows.select("user_id", addresses.ip_number(ip).alias("n"))


@query("d14_d15_block_patterns", "SELECT s_suppkey, CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN 1 WHEN 1 THEN 2 END AS kind, CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN concat('a@d', s_nationkey, '.example') WHEN 1 THEN concat('d', s_nationkey, '.example') ELSE 'nothing' END AS value FROM supplier")
def d14(spark, sf_dir):
    from ..operators.blocklist import pattern_kind, pattern_value

    made = F.expr("CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN concat('A@D', CAST(s_nationkey AS STRING), '.example') WHEN 1 THEN concat('*@d', CAST(s_nationkey AS STRING), '.Example') ELSE 'Nothing' END")
    return c.table(spark, sf_dir, "supplier").select("s_suppkey", pattern_kind(made).alias("kind"), pattern_value(made).alias("value"))


@query("n1_n2_utc_text", "SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%d %H:%M:%S UTC') AS t FROM events")
def n1(spark, sf_dir):
    return c.table(spark, sf_dir, "events").select("event_id", numbers.utc_text(c.millis("ts")).alias("t"))


def _part(n: str, unit: str) -> str:
    return f"concat({n}, ' {unit}', CASE WHEN {n} = 1 THEN '' ELSE 's' END)"


@query("n3_duration_text", f"SELECT event_id, CASE WHEN ms < 0 THEN 'unavailable' ELSE concat_ws(', ', CASE WHEN d > 0 THEN {_part('d', 'day')} END, CASE WHEN h > 0 THEN {_part('h', 'hour')} END, CASE WHEN m > 0 OR (d = 0 AND h = 0) THEN {_part('m', 'minute')} END) END AS t FROM (SELECT event_id, ms, ms // {DAY} AS d, ms % {DAY} // 3600000 AS h, ms % 3600000 // 60000 AS m FROM (SELECT event_id, {EVENTS_NOW} - 20 * CAST({DAY} AS BIGINT) - epoch_us(ts) // 1000 AS ms FROM events))")
def n3(spark, sf_dir):
    return c.table(spark, sf_dir, "events").select("event_id", numbers.duration_text(F.lit(EVENTS_NOW - 20 * DAY) - c.millis("ts")).alias("t"))


@query("n4_age_bucket", f"SELECT o_orderkey, CASE WHEN d >= 365 THEN {_part('(d // 365)', 'year')} WHEN d >= 30 THEN {_part('(d // 30)', 'month')} WHEN d >= 7 THEN {_part('(d // 7)', 'week')} WHEN d >= 1 THEN {_part('d', 'day')} ELSE 'less than 1 day' END AS age FROM (SELECT o_orderkey, CAST(floor(({ORDERS_NOW} - epoch_us(o_orderdate) // 1000) / {DAY}.0) AS BIGINT) AS d FROM orders)")
def n4(spark, sf_dir):
    return c.table(spark, sf_dir, "orders").select("o_orderkey", numbers.age_bucket(F.lit(ORDERS_NOW) - c.millis("o_orderdate")).alias("age"))


@query("n5_p2_p3_decisions", "SELECT o_orderkey, CASE WHEN s < 0.8 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN o_orderstatus = 'F' AND s >= 0.5 THEN 'reject' ELSE 'accept' END AS action FROM (SELECT *, o_totalprice / 500000 AS s FROM orders)")
def n5(spark, sf_dir):
    score = F.col("o_totalprice") / 500000
    verdict = F.when(F.col("o_orderstatus") == "F", "unwanted").otherwise("legitimate")
    return c.table(spark, sf_dir, "orders").select("o_orderkey", numbers.confidence(score).alias("confidence"), policy.in_mode(policy.ai_action(verdict, score, 0.5), "enforce").alias("action"))


@query("n6_n7_n8_json_replies", "SELECT event_id, value >= 0.5 AND value <= 1 AS valid, CAST(event_id % 50 AS BIGINT) AS input, CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id END AS output FROM events")
def n6(spark, sf_dir):
    decision = F.concat(F.lit('{"classification": "unwanted", "reasons": ["a"], "score": '), F.col("value").cast("string"), F.lit("}"))
    reply = F.expr("""concat('{"usage": {"prompt_tokens": ', CAST(event_id % 50 AS STRING), ', "completion_tokens": ', CASE WHEN event_id % 2 = 0 THEN '-3' ELSE CAST(event_id AS STRING) END, '}}')""")
    used = numbers.usage(reply)
    return c.table(spark, sf_dir, "events").select("event_id", numbers.valid_decision(decision).alias("valid"), used["input"].alias("input"), used["output"].alias("output"))


HEX = "concat('#', lower(right(concat('00000', to_hex(CAST(p_partkey * 7919 % 16777216 AS BIGINT))), 6)))"
R, G, B = (f"(CAST(floor(p_partkey * 7919 % 16777216 / {d}) AS BIGINT) % 256) / 255.0" for d in (65536, 256, 1))


def _linear(x: str) -> str:
    return f"CASE WHEN {x} <= 0.04045 THEN {x} / 12.92 ELSE pow(({x} + 0.055) / 1.055, 2.4) END"


OKLAB = f"SELECT p_partkey, cbrt(0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b) AS l, cbrt(0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b) AS m, cbrt(0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b) AS s FROM (SELECT p_partkey, {_linear(R)} AS r, {_linear(G)} AS g, {_linear(B)} AS b FROM part)"


@query("h24_h27_colour_distance", f"SELECT p_partkey, round(sqrt((ll - 1) * (ll - 1) + aa * aa + bb * bb), 3) AS distance, sqrt((ll - 1) * (ll - 1) + aa * aa + bb * bb) <= 0.2 AS near FROM (SELECT p_partkey, 0.2104542553 * l + 0.7936177850 * m - 0.0040720468 * s AS ll, 1.9779984951 * l - 2.4285922050 * m + 0.4505937099 * s AS aa, 0.0259040371 * l + 0.7827717662 * m - 0.8086757660 * s AS bb FROM ({OKLAB}))")
def h24(spark, sf_dir):
    code = F.concat(F.lit("#"), F.lpad(F.lower(F.hex((F.col("p_partkey") * 7919 % 16777216).cast("long"))), 6, "0"))
    colour = numbers.hex_colour(code)
    white = F.struct(*[F.lit(x).alias(n) for n, x in (("l", 1.0), ("a", 0.0), ("b", 0.0))])  # by definition; the matrices' ten digits give 1 - 6e-9
    rows = c.table(spark, sf_dir, "part").select("p_partkey", numbers.oklab(colour).alias("lab"), white.alias("white"))
    away = numbers.lab_distance(F.col("lab"), F.col("white"))
    return rows.select("p_partkey", F.round(away, 3).alias("distance"), numbers.colour_concealed(away, 0.2).alias("near"))


@query("h25_compositing", "SELECT p_partkey, round(1.0 * a + (1 - a), 6) AS r, round(1 - a, 6) AS g FROM (SELECT p_partkey, (p_partkey % 256) / 255.0 AS a FROM part)")
def h25(spark, sf_dir):
    code = F.concat(F.lit("#ff0000"), F.lpad(F.lower(F.hex(F.col("p_partkey") % 256)), 2, "0"))
    mixed = numbers.over(numbers.hex_colour(code), numbers.hex_colour(F.lit("#ffffff")))
    return c.table(spark, sf_dir, "part").select("p_partkey", mixed.alias("m")).select("p_partkey", F.round("m.r", 6).alias("r"), F.round("m.g", 6).alias("g"))


@query("h29_h30_h44_visibility", "SELECT p_partkey, CASE WHEN p_size <= 2 OR p_partkey % 11 = 0 THEN 'concealed' WHEN p_partkey % 5 = 0 THEN 'unknown' ELSE 'visible' END AS label, CASE WHEN p_partkey % 5 = 0 THEN 'unknown' WHEN p_partkey % 2 = 0 THEN 'client-dependent' ELSE 'visible' END AS merged, CASE WHEN b % 2 = 1 OR b = 0 THEN 'display:none' WHEN b % 4 = 2 THEN 'visibility:hidden' WHEN b % 8 = 4 THEN 'visibility:collapse' WHEN b % 16 = 8 THEN 'opacity 0.25' WHEN b % 32 = 16 THEN concat('font-size ', p_size, 'px') WHEN b % 64 = 32 THEN 'color-match' WHEN b % 128 = 64 THEN 'empty-clip' ELSE 'content-visibility:hidden' END AS reason FROM (SELECT *, p_partkey * 8 % 256 AS b FROM part)")
def h29(spark, sf_dir):
    key = F.col("p_partkey")
    label = policy.visibility(key % 11 == 0, F.lit(None).cast("double"), F.col("p_size"), F.lit(0.4), key % 5 == 0)
    why = policy.primary_reason((key * 8 % 256).cast("int"), F.lit(0.25), F.concat(F.col("p_size").cast("string"), F.lit("px")))
    cases = F.array(F.lit("visible"), F.when(key % 5 == 0, "unknown").when(key % 2 == 0, "concealed").otherwise("visible"))
    return c.table(spark, sf_dir, "part").select("p_partkey", label.alias("label"), policy.merged_label(cases).alias("merged"), F.trim(F.concat_ws(" ", why["reason"], why["value"])).alias("reason"))


KIND = "CASE CAST(doc_id % 8 AS INT) WHEN 0 THEN '4d5a9000' WHEN 1 THEN '7f454c46' WHEN 2 THEN 'cafebabe' WHEN 3 THEN '504b0304' WHEN 4 THEN '1f8b0800' WHEN 5 THEN '425a6839' WHEN 6 THEN '23212f7573722f62696e2f656e7620707974686f6e330a' ELSE '23212f62696e2f7368202d650a' END"


@query("at9_at12_signatures", "SELECT doc_id, CASE CAST(doc_id % 8 AS INT) WHEN 0 THEN 'pe' WHEN 1 THEN 'elf' WHEN 2 THEN 'mach-o' END AS program, CASE CAST(doc_id % 8 AS INT) WHEN 3 THEN 'zip' WHEN 4 THEN 'gzip' WHEN 5 THEN 'bzip2' ELSE CASE WHEN lang = 'fr' THEN 'tar' END END AS archive, CASE CAST(doc_id % 8 AS INT) WHEN 6 THEN 'python3' WHEN 7 THEN 'sh' END AS script FROM documents")
def at9(spark, sf_dir):
    content = F.concat(F.unhex(F.expr(KIND)), F.encode(F.left(words(), F.lit(50)), "UTF-8"))
    name = F.when(F.col("lang") == "fr", "x.TAR").otherwise("x.txt")
    return docs(spark, sf_dir, program=numbers.executable_format(content), archive=numbers.archive_format(content, name), script=numbers.script_interpreter(content))


@query("f14_at17_attachment_policy", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'exe' END AS extension, CASE WHEN doc_id % 3 = 0 THEN 'reject' WHEN doc_id % 5 = 0 THEN 'tempfail' WHEN doc_id % 7 = 0 THEN 'accept' END AS action FROM documents")
def f14(spark, sf_dir):
    name = F.when(F.col("doc_id") % 3 == 0, "Report.EXE. ").otherwise("report.pdf")
    found = numbers.blocked_extension(name, ("exe", "js"))
    error = F.when(F.col("doc_id") % 5 == 0, "encrypted").when(F.col("doc_id") % 7 == 0, "malformed")
    return docs(spark, sf_dir, extension=found, action=policy.attachment_action(error, found, "accept", "tempfail", "tempfail"))


@query("f10_f12_p6_trust", "SELECT o_orderkey, o_custkey % 2 = 0 OR o_custkey % 3 = 0 AS either, o_custkey % 6 = 0 AS both, o_custkey % 5 <> 0 AND o_custkey % 6 = 0 AS bypass FROM orders")
def f12(spark, sf_dir):
    dkim, spf = F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 3 == 0
    known = policy.knows_sender(F.lit(1), F.lit(True), F.lit(True), True)
    through = policy.bypass(known, F.lit(True), policy.trust_met("both", dkim, spf), F.when(F.col("o_custkey") % 5 == 0, 2).otherwise(1))
    return c.table(spark, sf_dir, "orders").select("o_orderkey", policy.trust_met("either", dkim, spf).alias("either"), policy.trust_met("both", dkim, spf).alias("both"), through.alias("bypass"))


@query("p1_p4_p5_p15_chain", "SELECT o_orderkey, CASE WHEN o_custkey % 13 = 0 THEN 'ip' WHEN o_custkey % 11 = 0 THEN 'attachment' WHEN o_custkey % 7 = 0 THEN 'failure' WHEN o_totalprice >= 250000 THEN 'analysis' ELSE 'none' END AS rule, CASE WHEN o_custkey % 13 = 0 THEN 'reject' WHEN o_custkey % 11 = 0 THEN 'reject' WHEN o_custkey % 7 = 0 THEN 'tempfail' WHEN o_totalprice >= 250000 THEN 'reject' ELSE 'accept' END AS action FROM orders")
def p1(spark, sf_dir):
    key = F.col("o_custkey")
    score = F.col("o_totalprice") / 500000
    rules = [
        ("ip", F.when(key % 13 == 0, "reject")),
        ("attachment", policy.attachment_action(F.lit(None), F.when(key % 11 == 0, "exe"), "accept", "accept", "accept")),
        ("failure", policy.failure_action(key % 7 == 0, "tempfail")),
        ("analysis", F.when(policy.ai_action(F.lit("unwanted"), score, 0.5) == "reject", "reject")),
    ]
    return c.table(spark, sf_dir, "orders").select("o_orderkey", policy.first_terminal(rules).alias("d")).select("o_orderkey", "d.rule", "d.action")


@query("p10_p11_learning_and_outcome", "SELECT doc_id, CASE WHEN toxic = 1 THEN CASE WHEN doc_id % 2 = 0 AND (doc_id % 10) / 10.0 >= 0.5 THEN 'remove' ELSE 'ignore' END ELSE CASE WHEN (doc_id % 10) / 10.0 >= 0.8 AND doc_id % 2 = 0 THEN 'advance' ELSE 'refresh' END END AS action, CASE WHEN doc_id % 9 = 0 THEN 10 WHEN quality = 0 THEN 8 ELSE 1 END AS event_type, CASE WHEN doc_id % 4 = 0 THEN 4 WHEN toxic = 1 THEN 2 ELSE 1 END AS outcome FROM labels")
def p10(spark, sf_dir):
    verdict = F.when(F.col("toxic") == 1, "unwanted").otherwise("legitimate")
    chosen = correspondents.learning_action(verdict, (F.col("doc_id") % 10) / 10, 0.5, F.col("doc_id") % 2 == 0, correspondents.TrustPolicy())
    kind = act.event_type_of(F.col("doc_id") % 9 == 0, F.col("quality") == 0, F.lit("dos-reject"))
    done = act.outcome_of(F.when(F.col("toxic") == 1, "reject").otherwise("accept"), F.col("doc_id") % 4 == 0)
    return c.table(spark, sf_dir, "labels").select("doc_id", chosen.alias("action"), kind.alias("event_type"), done.alias("outcome"))


@query("m21_p12_flags", "SELECT doc_id, quality = 0 OR toxic = 1 AS incomplete, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'not-scanned' WHEN doc_id % 13 = 0 THEN 'unavailable' WHEN toxic = 1 THEN 'unwanted' ELSE 'legitimate' END AS classification, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN '1' ELSE '0.75' END AS score, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'unavailable' WHEN doc_id % 2 = 0 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN doc_id % 7 = 0 THEN 'accepted-bypass' WHEN doc_id % 11 = 0 THEN 'accepted-accept-mode' WHEN doc_id % 13 = 0 THEN 'accepted-ai-error' WHEN doc_id % 17 = 0 THEN 'accepted-accept-mode' WHEN toxic = 1 THEN 'accepted-below-threshold' ELSE 'accepted' END AS action, CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 = 0 THEN 'incomplete-inspection' END AS policy FROM labels")
def m21(spark, sf_dir):
    key = F.col("doc_id")
    verdict, proposed = F.when(F.col("toxic") == 1, "unwanted").otherwise("legitimate"), F.when(key % 17 == 0, "reject").otherwise("accept")
    head = policy.result_headers(key % 7 != 0, key % 11 == 0, key % 13 == 0, F.lit("accept"), proposed, verdict, F.when(key % 2 == 0, 1.0).otherwise(0.75))
    rows = c.table(spark, sf_dir, "labels").select("doc_id", policy.incomplete(F.col("quality") == 0, F.lit(None).cast("boolean"), F.col("toxic") == 1).alias("incomplete"), head.alias("h"))
    return rows.select("doc_id", "incomplete", "h.*")


@query("p7_updates", "SELECT doc_id, toxic = 1 AS rejection, CASE WHEN toxic = 1 THEN CASE WHEN doc_id % 5 = 0 THEN 'incomplete-inspection' ELSE 'ai' END END AS rejection_policy, toxic = 1 AND doc_id % 5 <> 0 AND doc_id % 3 <> 0 AND doc_id % 7 <> 0 AS ip_strike, toxic = 0 AND doc_id % 5 <> 0 AND doc_id % 3 <> 0 AND doc_id % 11 <> 0 AS legitimate_ip, toxic = 0 AND doc_id % 5 <> 0 AND doc_id % 3 = 0 AS learnt_recipients, doc_id % 5 <> 0 AND doc_id % 3 <> 0 AND doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND doc_id % 2 = 0 AS classification FROM labels")
def p7(spark, sf_dir):
    key = F.col("doc_id")
    verdict, action = F.when(F.col("toxic") == 1, "unwanted").otherwise("legitimate"), F.when(F.col("toxic") == 1, "reject").otherwise("accept")
    done = policy.post_decision_updates(key % 5 == 0, action, key % 3 == 0, key % 11 == 0, key % 7 == 0, verdict, F.when(key % 2 == 0, "a@b.test").otherwise(""))
    return c.table(spark, sf_dir, "labels").select("doc_id", done.alias("u")).select("doc_id", "u.*")


@query("a11_x24_page_comments", "SELECT page_id, n AS characters, w AS within_words FROM (SELECT page_id, CAST(CASE WHEN page_id % 3 = 0 THEN 0 ELSE 2 * length(t) + 5 END + CASE WHEN page_id % 4 = 0 THEN 3 ELSE 0 END AS BIGINT) AS n, CAST(CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS w FROM (SELECT page_id, replace(replace(url, '-', ''), '>', '') AS t FROM pages))")
def a11(spark, sf_dir):
    """Comments made from each page's address: one inside a word, one between words, and conditional ones that don't count."""
    made = F.expr("concat('<p>', CASE WHEN page_id % 3 = 0 THEN '' ELSE concat('ab<!--', t, '-->cd <!--', t, ' is x--> e') END, CASE WHEN page_id % 4 = 0 THEN ' f<!-- y --> g' ELSE '<!--[if mso]>h<![endif]-->' END)")
    rows = c.table(spark, sf_dir, "pages").select("page_id", F.expr("replace(replace(url, '-', ''), '>', '')").alias("t"))
    found = rows.select("page_id", text.comment_statistics(made).alias("s"))
    return found.select("page_id", F.col("s.characters").cast("long").alias("characters"), F.col("s.within_words").cast("long").alias("within_words"))


@query("x13_x15_processed_body", "SELECT doc_id, md5(concat(CASE WHEN length(b) > 800 THEN concat(left(b, 800), chr(10), '[processed email body truncated; the remainder was omitted]') ELSE b END, CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), '[Content extraction incomplete; some content may be missing]') ELSE '' END)) AS body, length(b) > 800 AS truncated, gone AS concealed_removed FROM (SELECT *, CASE WHEN gone THEN left(text, 400) ELSE text END AS b FROM (SELECT doc_id, coalesce(text, '') AS text, doc_id % 2 = 0 AND length(coalesce(text, '')) > 800 AS gone FROM documents))")
def x15(spark, sf_dir):
    whole = F.coalesce(words(), F.lit(""))
    done = text.processed_body(whole, F.left(whole, F.lit(400)), F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0, 800)
    rows = docs(spark, sf_dir, d=done)
    return rows.select("doc_id", F.md5("d.body").alias("body"), "d.truncated", "d.concealed_removed")


@query("l6_rewritten_urls", "SELECT page_id, concat('see (', url, '), [', 'http://[userinfo-omitted]@h.test/', repeat('a', 64), '/', page_id, '] and ', url, '!') AS text, CAST(2 AS BIGINT) AS n FROM pages")
def l6(spark, sf_dir):
    made = F.expr("concat('see (', url, '), [', 'HTTP://u:p@h.test/', repeat('a', 70), '/', CAST(page_id AS STRING), '] and ', url, '!')")
    rows = c.table(spark, sf_dir, "pages").select("page_id", text.rewritten_urls(made).alias("r"))
    return rows.select("page_id", "r.text", F.size("r.links").cast("long").alias("n"))


@query("l10_base_addresses", "SELECT page_id, CASE CAST(page_id % 5 AS INT) WHEN 0 THEN concat('https://b', page_id, '.test/x/') WHEN 1 THEN NULL WHEN 2 THEN url WHEN 3 THEN concat('http://c.test/', page_id) END AS base FROM pages")
def l10(spark, sf_dir):
    from ..operators import headers

    made = F.expr("""CASE CAST(page_id % 5 AS INT) WHEN 0 THEN concat('<base target=x><BASE HREF = " https://b', CAST(page_id AS STRING), '.test/x/ "><base href=http://late.test/>') WHEN 1 THEN '<base href="/relative"><base href="http://late.test/">' WHEN 2 THEN '<basefont href="http://no.test/">' WHEN 3 THEN concat("<base href='http://c.test/", CAST(page_id AS STRING), "'>") ELSE '<base href="javascript:x">' END""")
    return c.table(spark, sf_dir, "pages").select("page_id", headers.base_address(made, F.col("url")).alias("base"))


@query("m3_decoded_words", "SELECT doc_id, concat(replace(left(coalesce(text, ''), 30), chr(10), ' '), 'é', doc_id, ' end') AS subject FROM documents")
def m3(spark, sf_dir):
    from ..operators import headers

    part = F.replace(F.left(F.coalesce(words(), F.lit("")), F.lit(30)), F.lit("\n"), F.lit(" "))
    made = F.concat(F.lit("=?UTF-8?B?"), F.base64(F.encode(part, "UTF-8")), F.lit("?=\r\n =?iso-8859-1?q?=E9"), F.col("doc_id").cast("string"), F.lit("?= end"))
    return docs(spark, sf_dir, subject=headers.decoded_value(made))


@query("d8_d9_f13_address_keys", "SELECT user_id, key, shown, NOT local AS routable, local FROM (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN concat(repeat('0', 20), 'ffff0a00', lpad(lower(to_hex(user_id % 65536)), 4, '0')) ELSE concat(CASE WHEN user_id % 3 = 1 THEN '26000000' ELSE 'fd000000' END, repeat('0', 16), lpad(lower(to_hex(1 + user_id % 65535)), 4, '0'), '000a') END AS key, CASE WHEN user_id % 3 = 0 THEN concat('10.0.', user_id % 65536 // 256, '.', user_id % 256) ELSE concat(CASE WHEN user_id % 3 = 1 THEN '2600' ELSE 'fd00' END, '::', lower(to_hex(1 + user_id % 65535)), ':a') END AS shown, user_id % 3 <> 1 AS local FROM (SELECT DISTINCT user_id FROM events))")
def d8_keys(spark, sf_dir):
    made = F.expr("CASE WHEN user_id % 3 = 0 THEN concat('::FFFF:10.0.', CAST(user_id % 65536 DIV 256 AS STRING), '.', CAST(user_id % 256 AS STRING)) ELSE concat(CASE WHEN user_id % 3 = 1 THEN '2600' ELSE 'FD00' END, ':0:0::', hex(1 + user_id % 65535), ':000A%eth0') END")
    rows = c.table(spark, sf_dir, "events").select("user_id", made.alias("ip")).distinct()
    ip = F.col("ip")
    return rows.select("user_id", addresses.ip_key(ip).alias("key"), addresses.canonical_ip(ip).alias("shown"), addresses.is_routable(ip).alias("routable"), addresses.in_networks(ip, ("10.0.0.0/8", "fc00::/7")).alias("local"))


@query("f10_reverse_dns_allowlist", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN concat('mx', s_suppkey, '.good.test') WHEN s_suppkey % 4 = 1 THEN 'good.test' END AS allowed FROM supplier")
def f10(spark, sf_dir):
    name = F.expr("CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN concat('MX', CAST(s_suppkey AS STRING), '.Good.test.') WHEN 1 THEN 'good.test' WHEN 2 THEN 'notgood.test' ELSE 'x.good.test' END")
    pair = lambda host, sure: F.struct(host.alias("hostname"), sure.alias("confirmed"))
    names = F.array(pair(F.lit("other.test"), F.lit(True)), pair(name, F.col("s_suppkey") % 4 != 3))
    return c.table(spark, sf_dir, "supplier").select("s_suppkey", addresses.allowed_by_reverse_dns(names, ("good.test", "fine.test")).alias("allowed"))


@query("st21_trust_conflicts", sql("SELECT k.id FROM {correspondents} k WHERE NOT EXISTS (SELECT 1 FROM {blocklist} b WHERE b.sender_kind = 1 AND b.expires_at_ms > {orders_now} AND b.sender_value = k.correspondent AND b.recipient IN ('*', k.local_address)) AND k.local_address = 's1@in.example'"))
def st21(spark, sf_dir):
    from ..operators.blocklist import without_trust

    return without_trust(c.correspondents(spark, sf_dir).filter("local_address = 's1@in.example'"), c.blocklist(spark, sf_dir), ORDERS_NOW).select("id")
