"""Cases with known results for text, addresses, evidence, decisions and attachments, and hostile inputs."""

import base64
import bz2
import gzip
import io
import ipaddress
import tarfile
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetspan.functions import addresses, numbers, text
from vetspan.operators import attachments, blocklist, correspondents, evidence, headers, policy


def each(spark, values, *columns, kind="string"):
    """The columns over one column v of the values, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    found = rows.select("i", *[x.alias(f"c{n}") for n, x in enumerate(columns)]).orderBy("i").collect()
    return [tuple(r)[1] if len(columns) == 1 else tuple(r)[1:] for r in found]


def test_compact_url(spark):
    cases = [
        ("HTTP://u:p@example.com/a?x=1#b", "HTTP://u:p@example.com/a?x=1#b"),
        ("https://e.com/" + "a" * 80 + "/b", "https://e.com/" + "a" * 64 + "/b"),
        ("https://e.com/" + "a" * 80 + "%2Epdf", "https://e.com/" + "a" * 58 + "%2Epdf"),
        ("https://e.com/?" + "k" * 60 + "=" + "é" * 60 + "&x=y", "https://e.com/?" + "k" * 50 + "=" + "é" * 50 + "&x=y"),
        ("HTTP://u:p@e.com/?x=" + "a" * 60, "http://[userinfo-omitted]@e.com/?x=" + "a" * 50),
        ("https://e.com/#" + "%20" * 30, "https://e.com/#" + "%20" * 16 + "%2"),
        ("%" + "😀" * 600, "%" + "😀" * 511),
        ("https://e.com/?", "https://e.com/?"),
        ("https://e.com/" + "a" * 80 + "." + "x" * 16, "https://e.com/" + "a" * 47 + "." + "x" * 16),
        ("https://e.com/" + "a" * 80 + "." + "x" * 17, "https://e.com/" + "a" * 64),
        ("https://e.com/" + "s/" * 400, ("https://e.com/" + "s/" * 400)[:512]),
    ]
    assert each(spark, [c for c, _ in cases], text.compact_url(F.col("v"))) == [w for _, w in cases]


def test_confident_characters(spark):
    cases = [("  a\t b\n\n\nc \n", 6), (" \t\r\n", 0), ("<invisible>hello</invisible>", 5), ("a<normal>b", 10), ("é😀", 2), ("\u200b" * 40, 0), ("a" + "\u200b" * 40 + "b", 10), ("</ QUOTED-CONTENT x>y", 1), ("<attached-fileſ>", 16), ("<inviſible a<b>c", 1)]
    assert each(spark, [c for c, _ in cases], text.confident_characters(F.col("v"))) == [w for _, w in cases]


def test_text_rules(spark):
    assert each(spark, ["a[b]\\(c)*_"], text.markdown_escaped(F.col("v")), text.markdown_url(F.col("v"))) == [("a\\[b\\]\\\\(c)*_", "a[b]%5C%28c%29*_")]
    assert each(spark, ["x" * 9], text.truncated(F.col("v"), 4)) == ["xxxx\n[processed email body truncated; the remainder was omitted]"]
    assert each(spark, [" a\x07b ", "Unknown", "[UNKNOWN]", "<a@b.test>", "y" * 300, None], text.smtp_identity(F.col("v"))) == ["ab", "", "", "<a@b.test>", "y" * 255, None]
    head = "\nEXTRACTOR-GENERATED HTML COMMENT SUMMARY: Omitted HTML comment text"
    cases = [((50, 0, 10), ""), ((100, 0, 101), ""), ((100, 0, 100), f"{head} was 100% of extracted body length.\n"), ((5, 1, 200), f"{head} was 2% of extracted body length; 1 comment occurred within words.\n"), ((7, 2, 0), f"{head} accompanied an empty extracted body; 2 comments occurred within words.\n")]
    rows = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, c int, w int, b int")
    assert [r.t for r in rows.select("i", text.comment_summary(F.col("c"), F.col("w"), F.col("b")).alias("t")).orderBy("i").collect()] == [w for _, w in cases]


def test_numbers(spark):
    day = 86_400_000
    cases = [(-5, "less than 1 day"), (day - 1, "less than 1 day"), (day, "1 day"), (13 * day, "1 week"), (60 * day, "2 months"), (730 * day, "2 years")]
    assert each(spark, [c for c, _ in cases], numbers.age_bucket(F.col("v")), kind="long") == [w for _, w in cases]
    cases = [('{"classification": "unwanted", "score": 0.5, "reasons": []}', True), ('{"classification": "legitimate", "score": 1}', True), ('{"classification": "spam", "score": 0.9}', False), ('{"classification": "unwanted", "score": 0.49}', False), ("no", False), ('{"classification": "unwanted", "score": 0.9, "reasons": ["' + "x" * 501 + '"]}', False), ('{"classification": "unwanted", "score": 0.9, "reasons": [' + ",".join(['"a"'] * 11) + "]}", False)]
    assert each(spark, [c for c, _ in cases], numbers.valid_decision(F.col("v"))) == [w for _, w in cases]


def test_addresses_against_the_library(spark):
    rnd = np.random.default_rng(1)
    ips = [str(ipaddress.IPv4Address(int(x))) for x in rnd.integers(0, 2**32, 60)]
    for x in rnd.integers(0, 2**16, (80, 8)):
        own = x * (rnd.random(8) < 0.5)
        ips.append(str(ipaddress.IPv6Address(int("".join(f"{g:04x}" for g in own), 16))))
        ips.append(":".join(f"{g:x}".upper() for g in own))
    ips += ["::", "::1", "fe80::1%eth0", "::ffff:8.8.8.8", "::FFFF:808:808", "1::", "2001:db8::5", "2002::1", "fd00::1", "ff02::1", "64:ff9b::192.0.2.33", "2600::1", "10.1.2.3", "100.64.0.1", "255.255.255.255", "8.8.8.8"]
    bad = ["", "1.2.3", "256.1.1.1", "1:2:3", ":::", "1::2::3", "g::", ":1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "12345::", "mail.test", None, "8.8.8.8%x"]
    nets = ("192.0.2.0/24", "2001:db8::/32", "::ffff:10.0.0.0/104", "fe80::/10")
    got = each(spark, ips + bad, addresses.ip_key(F.col("v")), addresses.canonical_ip(F.col("v")), addresses.in_networks(F.col("v"), nets), addresses.is_routable(F.col("v")))
    for ip, (key, shown, inside, routable) in zip(ips, got, strict=False):
        a = ipaddress.ip_address(ip.partition("%")[0])
        a = getattr(a, "ipv4_mapped", None) or a
        number = int(a) + ((0xFFFF << 32) if a.version == 4 else 0)
        assert key == f"{number:032x}" and shown == str(a), ip
        plain = [ipaddress.ip_network(n) for n in ("192.0.2.0/24", "2001:db8::/32", "10.0.0.0/8", "fe80::/10")]
        assert inside == any(a in n for n in plain if n.version == a.version)
        blocked = [ipaddress.ip_network(n) for n in addresses.NOT_ROUTABLE]
        assert routable != any(a in n for n in blocked if n.version == a.version)
    assert got[len(ips) :] == [(None, None, False, False)] * len(bad)
    assert [addresses.canonical_network(x) for x in (" 10.1.2.3/8", "::ffff:10.1.2.3/104", "2001:DB8::9/32", "1.2.3.4", "::1")] == ["10.0.0.0/8", "10.0.0.0/8", "2001:db8::/32", "1.2.3.4/32", "::1/128"]
    with pytest.raises(ValueError):
        addresses.network_keys("::ffff:0.0.0.0/95")


def test_alignment(spark):
    suffixes = ("test", "co.test")
    cases = [("mail.shop.co.test", "www.shop.co.test", True), ("shop.co.test.", "SHOP.co.test", True), ("co.test", "co.test", False), ("a.co.test", "b.co.test", False), ("", "", False), ("test", "test", False), ("bad..test", "bad..test", False), (None, "a.test", False), ("a_b.shop.test", "shop.test", True)]
    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, a string, b string")
    assert [r.x for r in rows.select("i", addresses.aligned(F.col("a"), F.col("b"), suffixes).alias("x")).orderBy("i").collect()] == [c[2] for c in cases]
    names = [("Mail.Good.test.", True), ("good.test", None), ("evilgood.test", True)]
    rows = spark.createDataFrame([(names,), (names[1:],), ([],), (None,)], "v array<struct<hostname:string,confirmed:boolean>>")
    assert [r[0] for r in rows.select(addresses.allowed_by_reverse_dns(F.col("v"), ("good.test",))).collect()] == ["mail.good.test", None, None, None]


RESULTS = [
    ("mx.test; dkim=pass header.d=A.test; spf=tempfail smtp.mailfrom=x@b.test; dmarc=pass header.from=c.test", [("dkim", "pass", "a.test", None), ("spf", "temperror", "b.test", "mailfrom"), ("dmarc", "pass", "c.test", None)]),
    ("MX.Test. 1; dkim=tempfail header.d=a.test", [("dkim", "tempfail", "a.test", None)]),
    ("other.test; dkim=pass header.d=a.test", []),
    ("mx.test; dkim=pass (a (b; c) \\) d) header.d=a.test (x)", [("dkim", "pass", "a.test", None)]),
    ('mx.test; dkim=pass header.d="a(b).example"', [("dkim", "pass", None, None)]),
    ('mx.test; dkim=pass reason="x; spf=pass" header.d="a.test"', [("dkim", "pass", "a.test", None)]),
    ("mx.test; dkim=pass header.i=x@header.d=a.test header.d=b.test", [("dkim", "pass", "b.test", None)]),
    ("mx.test; dkim=pass header.d=a.test header.d=b.test", [("dkim", "pass", None, None)]),
    ("mx.test; spf=permfail smtp.helo=h.test", [("spf", "permfail", "h.test", "helo")]),
    ("mx.test; spf=pass smtp.mailfrom=<> smtp.helo=h_1.test", [("spf", "pass", "h_1.test", "helo")]),
    ("mx.test; spf=pass smtp.mailfrom=<a@b.test>", [("spf", "pass", "b.test", "mailfrom")]),
    ("mx.test; dkim=pass header . d = a.test; dkim=pass header.d=a.test; arc=pass", [("dkim", "pass", "a.test", None)]),
    ("mx.test; dkim=pass (open header.d=a.test", []),
    ("mx.test; dkim=pass ) header.d=a.test", []),
    ('mx.test; dkim=pass header.d="a.test', []),
    ("mx.test", []),
    ("", []),
    (None, []),
]
SPF = [
    ("pass (ok; x) receiver=mx.test; envelope-from=\"a@b.test\"; helo=h.test", [("spf", "pass", "b.test", "mailfrom")]),
    ("Pass receiver=evil.test; envelope-from=a@b.test", []),
    ("pass (receiver=mx.test) envelope-from=a@b.test", []),
    ('pass x="receiver=mx.test"; envelope-from=a@b.test', []),
    ("tempfail receiver=mx.test; identity=HELO; helo=h.test; envelope-from=a@b.test", [("spf", "temperror", "h.test", "helo")]),
    ("neutral receiver=mx.test; envelope-from=<>; helo=h.test", [("spf", "neutral", "h.test", "helo")]),
    ("fail receiver=mx.test", [("spf", "fail", None, None)]),
    ("none (unclosed receiver=mx.test", []),
]


def test_authentication_fields(spark):
    got = each(spark, [[h] for h, _ in RESULTS], evidence.authentication_results(F.col("v"), ("MX.test",)), kind="array<string>")
    for (header, want), found in zip(RESULTS, got, strict=True):
        assert [tuple(r) for r in found] == want, header
    none = F.expr("CAST(array() AS array<string>)")
    got = each(spark, [[h] for h, _ in SPF], evidence.authentication_results(none, ("mx.test",), F.col("v")), kind="array<string>")
    for (header, want), found in zip(SPF, got, strict=True):
        assert [tuple(r) for r in found] == want, header
    both = evidence.authentication_results(F.array(F.lit("mx.test; spf=none")), ("mx.test",), F.col("v"))
    assert [[tuple(r) for r in x] for x in each(spark, [[SPF[0][0]], None], both, kind="array<string>")] == [[("spf", "none", None, None)]] * 2
    told = evidence.evidence(F.array(F.lit("mx.test; dkim=pass header.d=mail.shop.co.test")), none, ("mx.test",))
    suffixes = ("co.test",)
    assert each(spark, ["www.shop.co.test", "other.co.test", "co.test"], evidence.passes(told, "dkim", F.col("v"), suffixes), F.size(told)) == [(True, 3), (False, 3), (False, 3)]


def test_hostile_headers(spark):
    """A megabyte of quotes, brackets, semicolons or escapes takes seconds and crashes nothing."""
    n = 1 << 20
    hostile = ["mx.test; " + x * (n // len(x)) for x in (";", '"a" ', "(", "()", "\\", 'dkim=pass x="', "a.b=c ", '"' + "q" * 5000 + '" ')]
    began = time.time()
    assert len(each(spark, [[h] for h in hostile], evidence.authentication_results(F.col("v"), ("mx.test",), F.col("v")), kind="array<string>")) == len(hostile)
    boxes = ['"' + "n" * 100_000 + '" <a@b.test>', '"' + '\\"' * 100_000 + '" <a@b.test>', "(" * 100_000 + "a@b.test", '"' * 99_999]
    assert each(spark, boxes, headers.mailboxes(F.col("v")))[:2] == [["a@b.test"]] * 2
    assert time.time() - began < 60


def test_encoded_words(spark):
    cases = [("=?UTF-8?B?w6k=?= =?utf-8?q?_x=C3=A9?= end", "é xé end"), ("=?ISO-8859-1?Q?caf=E9?=", "café"), ("=?gb18030?B?1tDOxA==?=", "中文"), ("=?koi8-r?Q?=D0=D2?=", "пр"), ("=?none?B?w6k=?=", "=?none?B?w6k=?="), ("=?utf-8?B?!!?=", "=?utf-8?B?!!?="), ("plain = text", "plain = text"), ("", ""), (None, None)]
    assert each(spark, [c for c, _ in cases], headers.decoded_value(F.col("v"))) == [w for _, w in cases]


@pytest.mark.parametrize(("label", "raw", "want"), [("windows-1252", b"\x80", "€"), ("iso-8859-1", b"\x80", "€"), ("koi8-r", b"\xd0", "п"), ("gb18030", b"\xd6\xd0", "中"), ("us-ascii", b"\xe9", "é"), (None, "é".encode(), "é"), ("nonsense", "é".encode(), "é"), ("base64", b"eA==", "eA=="), ("utf-8", b"\xff", "\ufffd")])
def test_charsets(label, raw, want):
    assert evidence.decoded(raw, label) == want


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def tarred(name, data):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_attachment_scans(spark):
    program, deep = b"\x7fELF" + b"x" * 20, b"ok"
    for _ in range(6):
        deep = zipped(inner=deep)
    locked = bytearray(zipped(a=b"text"))
    locked[6] |= 1
    locked[locked.index(b"PK\x01\x02") + 8] |= 1
    cases = [
        ("a.zip", zipped(**{"x__y.txt": b"text"}), None, None),
        ("a.zip", zipped(**{"x__run.EXE": b"text"}), "a.zip/run.EXE: blocked extension .exe", None),
        ("a.zip", zipped(b=zipped(c=program)), "a.zip/b/c: program", None),
        ("a.tgz", gzip.compress(tarred("d/p", program)), "a.tgz/unnamed/p: program", None),
        ("a.gz", b"\x1f\x8b\x08\x08\0\0\0\0\0\x03run.JS\0" + gzip.compress(b"x")[10:], "a.gz/run.JS: blocked extension .js", None),
        ("a.tar", tarred("dir/p", program), "a.tar/p: program", None),
        ("p.gz", gzip.compress(program), "p.gz/p: program", None),
        ("p.tar.bz2", bz2.compress(tarred("q", program)), "p.tar.bz2/p.tar/q: program", None),
        ("a.zip", deep, None, "limit"),
        ("a.zip", bytes(locked), None, "encrypted"),
        ("a.zip", zipped(a=b"text" * 50)[:40], None, "unscannable"),
        ("a.zip", zipped(a=b"text" * 50, b=program)[:-60], "a.zip/b: program", None),
        ("a.zip", zipped(a=b"text", **{"b.JS": b"x"})[:-80], "a.zip/b.JS: blocked extension .js", None),
        ("a.zip", zipped(**{f"n{i}": b"" for i in range(9)}), None, None),
        ("a.zip", zipped(**{f"n{i}": b"" for i in range(11)}), None, "limit"),
        ("a.zip", zipped(**{f"n{i}": b"" for i in range(5)}, c=zipped(**{f"n{i}": b"" for i in range(6)})), None, "limit"),
        ("a.zip", b"PK\x03\x04\0", None, "unscannable"),
        ("p.gz", gzip.compress(b"text")[:12], None, "unscannable"),
        ("x.e\u200bxe", b"", "x.exe: blocked extension .exe", None),
        ("x.\uff45\uff58\uff45", b"", "x.exe: blocked extension .exe", None),
        ("=?utf-8?B?eC5leGU=?=", b"", "x.exe: blocked extension .exe", None),
        ("C:\\dir\\run.js. ", b"", "run.js.: blocked extension .js", None),
        (None, b"text", None, None),
        ("big.gz", gzip.compress(b"0" * (2 << 20)), None, "limit"),
    ]
    rows = spark.createDataFrame([(i, 0, n, bytearray(d)) for i, (n, d, *_) in enumerate(cases)], "id long, part int, filename string, content binary")
    got = {r.id: (r.detection, r.error_kind) for r in attachments.scan_attachments(rows, attachments.ScanLimits(bytes=1 << 20, files=10)).collect()}
    for i, (name, _, *want) in enumerate(cases):
        assert got[i] == tuple(want), name


def multipart(*parts, kind="mixed", mark="b", end=True):
    return (f"Content-Type: multipart/{kind}; boundary={mark}\r\n\r\npreamble".encode() + b"".join(f"\r\n--{mark}\r\n".encode() + p for p in parts) + (f"\r\n--{mark}--\r\nend".encode() if end else b""))


def test_message_scans(spark):
    encode = lambda data, head=b"Content-Type: a/b": head + b"\r\nContent-Transfer-Encoding: base64\r\n\r\n" + base64.encodebytes(data)
    program, name = b"\x7fELF program", b"Content-Disposition: attachment; filename*=utf-8''r%75n.JS\r\n\r\nx"
    deep = name
    for i in range(20):
        deep = multipart(deep, mark=f"m{i}")
    cases = [
        (b"Content-Type: text/plain\r\n\r\nMZ is text", None, None),
        (b"\r\nMZ is text", None, None),
        (multipart(b"\r\nhello", encode(program)), "message/part-2: program", None),
        (multipart(b"\r\nMZ without a type"), "message/part-1: program", None),
        (multipart(b"Content-Type: text/plain\r\n\r\nMZ concealed"), "message/part-1: program", None),
        (multipart(b"Content-Type: text/plain\r\n\r\n#!/bin/sh sample"), None, None),
        (multipart(b"Content-Type: text/plain\r\nContent-Disposition: attachment\r\n\r\n#!/bin/sh"), "message/part-1: program", None),
        (multipart(name), "message/run.JS: blocked extension .js", None),
        (multipart(encode(multipart(name, mark="c"), b"Content-Type: message/rfc822")), "message/part-1/run.JS: blocked extension .js", None),
        (multipart(multipart(name, mark="c"), kind="digest"), "message/part-1/run.JS: blocked extension .js", None),
        (multipart(encode(multipart(name, mark="c"), b"Content-Disposition: attachment; filename=a.eml")), "message/a.eml/run.JS: blocked extension .js", None),
        (multipart(b"Content-Type: message/rfc822\r\n\r\nno header"), None, "malformed"),
        (deep, None, "limit"),
        (multipart(encode(program)[:-1] + b"*"), "message/part-1: program", None),
        (multipart(encode(b"text")[:-1] + b"*"), None, "unscannable"),
        (multipart(encode(zipped(a=program)) + b"*"), "message/part-1/a: program", None),
        (multipart(b"Content-Type: a/b; =\r\n\r\nx", name), "message/run.JS: blocked extension .js", None),
        (multipart(b"Content-Type: a/b; =\r\n\r\nx", b"\r\nx"), None, "malformed"),
        (multipart(b"\r\nx", end=False), None, "unscannable"),
        (b"Content-Type: multipart/mixed; boundary=b\r\n\r\nnothing", None, "malformed"),
        (b"Content-Type: multipart/mixed\r\n\r\nx", None, "malformed"),
        (b"Content-Type: a/b\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n=4D=5A =\r\nx", "message: program", None),
        (b"Content-Type: a/b\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n=4", None, "unscannable"),
        (b"Content-Type: a/b\r\nContent-Transfer-Encoding: x-own\r\n\r\nx", None, "unscannable"),
        (b"Content-Type: a/b\r\n\r\n" + b"x" * (1 << 21), None, "limit"),
        (b"", None, None),
        (None, None, None),
    ]
    rows = spark.createDataFrame([(i, None if m is None else bytearray(m)) for i, (m, *_) in enumerate(cases)], "id long, content binary")
    got = {r.id: (r.detection, r.error_kind) for r in attachments.scan_messages(rows, attachments.ScanLimits(bytes=1 << 20)).collect()}
    for i, (message, *want) in enumerate(cases):
        assert got[i] == tuple(want), message


def test_modes_and_reasons(spark):
    assert each(spark, ["reject", "accept"], policy.in_mode(F.col("v"), "accept"), policy.in_mode(F.col("v"), "enforce")) == [("accept", "reject"), ("accept", "accept")]
    why = policy.primary_reason(F.col("v"), F.lit(0.25), F.lit("1px"))
    assert [tuple(r) for r in each(spark, [0, 1, 6, 24, 16, 160, 128], why, kind="int")] == [("display:none", ""), ("display:none", ""), ("visibility:hidden", ""), ("opacity", "0.25"), ("font-size", "1px"), ("color-match", ""), ("content-visibility:hidden", "")]


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_rules_of_one_domain_cost_a_message_what_it_asks(spark, monkeypatch, broadcast):
    monkeypatch.setattr(blocklist, "BROADCAST_SCOPES", broadcast)
    messages = spark.createDataFrame([(1, "A@m.x.example", ["r1", "r5000", "r1"]), (2, "b@x.example", ["q"]), (3, "c@other", ["r1"]), (4, None, ["r1"])], "id long, sender string, recipients array<string>")
    many = spark.range(2000).select(F.concat(F.lit("r"), "id").alias("recipient"), F.lit(2).alias("sender_kind"), F.lit("x.example").alias("sender_value"), F.lit(10).alias("expires_at_ms"))
    exact = spark.createDataFrame([("z", 1, "a@m.x.example", 10), ("*", 1, "b@x.example", 10), ("*", 2, "other", 5), (None, 2, "other", 10)], "recipient string, sender_kind int, sender_value string, expires_at_ms int")
    rules = many.union(many).unionByName(exact)
    assert blocklist.hits(messages, rules, 5).groupBy("id").count().orderBy("id").collect() == [(1, 3), (2, 3), (3, 1)]
    found = blocklist.matches(messages, rules, 5).orderBy("id").collect()
    assert [(r.id, r.blocked, r.matched_kind) for r in found] == [(1, ["r1"], 1), (2, ["q"], 1)]


def test_message_parts_come_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    parts = evidence.message_parts(spark.range(3).select("id", F.encode(F.lit("\r\nhello"), "UTF-8").alias("content")))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(8 << 20)
    assert [r.text for r in parts.collect()] == ["hello"] * 3


def test_known_pairs_are_looked_up_without_being_summed_up(spark, capsys):
    rows = spark.createDataFrame([("r1", "a", "manual", 0, 5), ("r1", "a", "manual", 0, 6), ("r2", "a", "manual", 0, 5)], "local_address string, correspondent string, whitelist_type string, legitimate_email_count int, last_activity_at_ms long")
    messages = spark.createDataFrame([(1, "a", ["r1", "r2", "r1"]), (2, "a", ["r1", "q"]), (3, "b", ["r1"]), (4, "a", []), (5, "a", None)], "id long, sender string, recipients array<string>")
    found = correspondents.match(messages, rows, correspondents.TrustPolicy(), 5)
    assert sorted(map(tuple, found.collect())) == [(1, 2, True), (2, 1, False), (3, 0, False)]
    found.explain()
    assert "keys=[recipient" not in capsys.readouterr().out
