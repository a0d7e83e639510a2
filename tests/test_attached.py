"""Sections, metadata, attached headers, charsets, image headers, serialised messages and replies with known results."""

import struct

import pytest
from pyspark.sql import functions as F

from vetspan.operators import attached, replies, retention

NOTICE = "\n[processed email body truncated; the remainder was omitted]"


def column(spark, values, kind, *columns):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    found = rows.select("i", *[x.alias(f"c{n}") for n, x in enumerate(columns)]).orderBy("i").collect()
    return [tuple(r)[1] if len(columns) == 1 else tuple(r)[1:] for r in found]


def test_metadata(spark):
    cases = [("a\x07b<c>", "a b&lt;c&gt;"), ("=?utf-8?B?w6k=?=", "é"), ("x" * 1025, "x" * 1024 + attached.CUT), ("<" * 300, ("&lt;" * 300)[:1024] + attached.CUT), ("é" * 513, "é" * 512 + attached.CUT), ("", ""), (None, None)]
    assert column(spark, [c for c, _ in cases], "string", attached.metadata_value(F.col("v"))) == [w for _, w in cases]
    for given, want in cases[:-1]:
        assert attached._told(given) == want


def test_sections_nest(spark):
    none = F.expr(f"CAST(array() AS {attached.SPANS})")
    inner = attached.wrapped(F.col("v"), none, "attached-file", F.lit("n.txt"), F.lit("text/plain"), F.lit(None).cast("string"))
    rows = spark.createDataFrame([("body",), ("",)], "v string").withColumn("w", inner)
    rows = rows.withColumn("o", attached.wrapped(F.col("w.text"), F.col("w.spans"), "attached-email", F.lit(""), F.lit("message/rfc822"), F.lit("From: a\n")))
    for r in rows.collect():
        text = r.o.text
        assert text == f"<attached-email>\nContent-Type: message/rfc822\nOriginal headers (unverified claims):\nFrom: a\n\n<attached-file>\nFilename: n.txt\nContent-Type: text/plain\n\n{r.v}\n</attached-file>\n</attached-email>"
        assert [s.tag for s in r.o.spans] == ["attached-email", "attached-file"] and r.o.spans[0].end == len(text)
        assert text[r.o.spans[1].body_start : r.o.spans[1].close_start] == r.v


def test_cut_sections(spark):
    text = "before\n<f>\nFilename: x\n\n" + "b" * 100 + "\n</f>" + "after" * 20
    span = (7, 24, 124, 129, "f")
    assert text[24:124] == "b" * 100 and text[124:129] == "\n</f>"
    for limit in range(400):
        cut = attached.cut_sections(text, limit, [span])
        body, _, closing = cut.partition(NOTICE)
        assert text.startswith(body) and (len(cut) <= limit or body == "")
        assert not 7 < len(body) < 24 and not 124 < len(body) < 129
        assert closing == ("\n</f>" if 24 <= len(body) <= 124 else "")
    assert attached.cut_sections(text, 0, [span]) == "" and attached.cut_sections(text, 5, [span]) == NOTICE
    rows = spark.createDataFrame([(i, t) for i, t in enumerate((text, None, "x", text))], "i long, v string").withColumn("n", F.when(F.col("i") == 0, 2**60 + 1))
    spans = F.when(F.col("i") < 3, F.expr(f"CAST(array(struct(7, 24, 124, 129, 'f')) AS {attached.SPANS})"))
    cut = attached.cut_bodies(rows.withColumn("spans", spans), "v", "spans", 150).orderBy("i").collect()
    assert [tuple(r) for r in cut] == [(0, attached.cut_sections(text, 150, [span]), 2**60 + 1), (1, None, None), (2, "x", None), (3, text[:150] + NOTICE, None)]


def test_last_index(spark):
    values = ["aBc abC", "none", "éABCé", "", None]
    assert column(spark, values, "string", attached.last_index(F.col("v"), F.lit("Abc")), attached.last_index(F.col("v"), F.lit(""))) == [(4, 7), (-1, 4), (2, 7), (-1, 0), (None, None)]


def test_file_parts(spark):
    cases = [(("text/plain", "attachment", None, None, None), True), (("text/html", "inline", "a", None, None), False), (("text/plain", None, None, "a", "multipart/mixed"), True), (("text/plain", "", "", "a", "multipart/related"), False), (("text/plain", None, None, "a", "multipart/alternative"), False), (("image/png", "attachment", "a", None, None), False), ((None,) * 5, False)]
    rows = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, a string, b string, c string, d string, e string")
    assert [r.x for r in rows.select("i", attached.is_file(*[F.col(n) for n in "abcde"]).alias("x")).orderBy("i").collect()] == [w for _, w in cases]
    assert column(spark, ["a\r\nb"], "string", attached.marker(F.lit("x/y"), F.col("v"))) == ["[attachment: a  b; type=x/y]"]


def test_attached_headers(spark):
    many = b"".join(b"To: " + bytes([65 + i]) * 1100 + b"\r\n" for i in range(9))
    told = "".join(f"To: {chr(65 + i) * 1024}{attached.CUT}\n" for i in range(6)) + attached.OMITTED
    cases = [
        (b"From: a <b@c.test>\r\nSUBJECT: =?utf-8?q?=C3=A9?=\r\n two\r\nX: y\r\nContent-Type: a/b\r\nContent-Type: c/d\r\nContent-ID: <i>\r\n\r\nbody", ("a/b", None, "<i>", None, "From: a &lt;b@c.test&gt;\nSubject: é two\n"), b"body"),
        (b"From: a\nTo: b\n\nbody", (None, None, None, None, "From: a\nTo: b\n"), b"body"),
        (b"From: a", (None, None, None, None, "From: a\n"), b""),
        (many + b"\r\nbody", (None, None, None, None, told), b"body"),
        (b"\r\nbody", (None, None, None, None, ""), b"body"),
        (b"no field\r\n\r\nbody", None, None), (b" folded: first\r\n\r\n", None, None), (b"", None, None), (b"A: " + b"x" * (1 << 20) + b"\n\n", None, None), (None, None, None),
    ]
    got = column(spark, [None if c is None else bytearray(c) for c, *_ in cases], "binary", attached.attached_message(F.col("v")))
    for (raw, want, body), found in zip(cases, got, strict=True):
        if want is None:
            assert found is None, raw
        else:
            assert tuple(found)[:-1] == want and raw[found.body_at :] == body, raw[:40]


@pytest.mark.parametrize(("raw", "label", "want"), [(b"\xe9", "iso-8859-1", "é"), ("é".encode(), None, "é"), (b"\xe9", None, "é"), (b"\x80", "none such", "€"), (b"\xef\xbb\xbfx", None, "x"), (b"\xff\xfex\0", None, "x"), (b"\xfe\xff\0x", None, "x"), (b"<meta charset=koi8-r>\xd0", None, "<meta charset=koi8-r>п"), (b'<META http-equiv="a" content="text/html; charset=gb18030">\xd6\xd0', "", '<META http-equiv="a" content="text/html; charset=gb18030">中'), (b"<meta charset='utf-16'>x", None, "<meta charset='utf-16'>x"), (b" " * 1024 + b"<meta charset=koi8-r>\xd0", None, " " * 1024 + "<meta charset=koi8-r>Ð"), (b"", None, "")])
def test_html_charsets(raw, label, want):
    assert attached.sniffed_html(raw, label) == want


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 20, 30) + b"\x08\x02\0\0\0" + b"\0" * 4
    gif = b"GIF89a" + struct.pack("<HH", 7, 9) + b"\0\0\0"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xff\xc2\0\x11\x08" + struct.pack(">HH", 5, 6) + b"\0" * 12
    assert [attached.image_size(x) for x in (png, gif, jpeg)] == [("image/png", 20, 30), ("image/gif", 7, 9), ("image/jpeg", 6, 5)]
    broken = [png[:20], gif[:8], jpeg[:12], b"\xff\xd8\xff\xe0\0\x00", b"\xff\xd8\xff\xda\0\x04", b"BM", b"", b"\xff\xd8" + b"\xff" * 1000]
    assert [attached.image_size(x) for x in broken] == [None] * len(broken)
    values = [bytearray(x) for x in (png, gif, jpeg, png.replace(struct.pack(">II", 20, 30), struct.pack(">II", 0, 30)), gif + b"x" * 200)] + [None]
    assert column(spark, values, "binary", attached.usable_image(F.col("v"), 100, 599)) == [None, "image/gif", "image/jpeg", None, None, None]


def test_serialised(spark):
    head, mark = b"A: 1\r\nB: 2\r\n 3\r\nC: 4\r\n", "T: yes\r\n"
    for limit in range(60):
        for truncated in (False, True):
            marked = truncated and limit >= 10
            room = limit - 2 - (8 if marked else 0)
            kept = next(k for k in (head, head[:16], head[:6], b"") if len(k) <= max(room, 0))
            want = ((kept + (mark.encode() if marked else b"") + b"\r\nbody\xff")[:limit]) if limit >= 2 else b""
            found = column(spark, [bytearray(head)], "binary", attached.serialised(F.col("v"), F.unhex(F.lit("626F6479FF")), limit, F.lit(truncated), mark)) if limit in (1, 2, 9, 10, 25, 28, 40) else [want]
            assert bytes(found[0]) == want, (limit, truncated)
    assert [bytes(x) for x in column(spark, [None], "binary", attached.serialised(F.col("v"), F.col("v"), 9, F.lit(None).cast("boolean")))] == [b"\r\n"]


def test_listing(spark):
    rows = spark.createDataFrame([(i, f"r{i}\n") for i in range(5)], "id int, text string")
    reply = lambda *a, **k: replies.listing(rows.filter(F.col("id") < k.pop("below", 5)), [F.asc("id")], F.col("text"), "none\n", *a, **k).collect()
    assert [r.reply for r in reply()] == ["r0\nr1\nr2\nr3\nr4\n"]
    assert [r.reply for r in reply(2)] == ["r0\nr1\nResults were limited to 2 matching records.\n"]
    assert [r.reply for r in reply(2, newest_last=True)] == ["r1\nr0\nResults were limited to 2 matching records.\n"]
    assert [r.reply for r in reply(below=0)] == ["none\n"]
    wide = spark.range(9).select("id", F.repeat(F.lit("é"), 10).alias("text"))
    cut = replies.listing(wide, [F.asc("id")], F.col("text"), "none\n", size=101).collect()[0].reply
    assert cut == "é" * 31 + replies.CUT


def test_evict_narrows_down(spark):
    rows = spark.range(3000).select("id", F.expr("CASE WHEN id % 3 = 0 THEN 5 WHEN id % 50 = 1 THEN NULL ELSE pmod(id * 7919, 1000) END").alias("at"))
    plain = sorted(rows.collect(), key=lambda r: (r.at is not None, r.at or 0, r.id))
    for capacity in (0, 1, 1500, 3000):
        kept = retention.evict(rows, capacity, [F.col("at"), F.col("id")], sorted_rows=400)
        assert sorted(r.id for r in kept.collect()) == sorted(r.id for r in plain[3000 - capacity :]), capacity
