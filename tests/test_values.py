"""Colour values, visibility, signatures, mailboxes, alternatives and archived messages: cases with known results."""

import math

from pyspark.sql import functions as F
from test_rules import each

from vetspan.functions import addresses, colours, numbers, text
from vetspan.operators import assembly, headers, policy


def test_colour_values(spark):
    known = {
        "#123": (17 / 255, 34 / 255, 51 / 255, 1), "#11223344": (17 / 255, 34 / 255, 51 / 255, 68 / 255), " Red\n": (1, 0, 0, 1), "transparent": (0, 0, 0, 0), "rgb(100% 0 0 / 50%)": (1, 0, 0, 0.5), "rgba(255 0 0)": (1, 0, 0, 1), "rgb(255,0,0,.25)": (1, 0, 0, 0.25), "hsl(0 100% 50% / 25%)": (1, 0, 0, 0.25),
        "hsla(120,100%,25%,.5)": (0, 0.5, 0, 0.5), "hsl(.5turn 100 50)": (0, 1, 1, 1), "HSL(-120deg 100% 50%)": (0, 0, 1, 1), "rgb(none 0 0 / none)": (0, 0, 0, 0), "hsl(none none none / none)": (0, 0, 0, 0), "hwb(0 0% 0%)": (1, 0, 0, 1), "hwb(120deg 0% 0% / 50%)": (0, 1, 0, 0.5),
        "hwb(0 20% 30%)": (0.7, 0.2, 0.2, 1), "hwb(240 60% 60%)": (0.5, 0.5, 0.5, 1), "hwb(none none none / none)": (1, 0, 0, 0), "rgba(1e400,-1e400,1e-4000,1e400)": (1, 0, 0, 1), "hsl(0 1e400% 1e400% / -1e400)": (1, 1, 1, 0), "rgb(1\t2\n3)": (1 / 255, 2 / 255, 3 / 255, 1),
    }
    invalid = ["rgb(0, 0%, 0)", "rgb(0, 0, 0 / .5)", "rgb(none, 0, 0)", "rgba(0, 0, 0, none)", "hsl(0, 100, 50%)", "hsl(none, 100%, 50%)", "rgb(0 0 / 1)", "hwb(0, 0%, 0%)", "hwb(0 0 0)", "rgb(1,2,3,4,5)", "rgb(1,2,3,)", "rgb(1 2 3 4)", "rgb(1 2 3 / .5 .5)", "rgb(1 2 3 / .5 / .5)", "#ggg", "#12345", "banana", "", "rgb(255\u00a0255\u00a0255)", "rgb(5. 0 0)", "rgb(NaN 0 0)", "rgb(1d 0 0)", "hsl(Infinity 0% 0%)"]
    unsupported = ["rgb(from red r g b)", "lab(50% 0 0)", "hsl(1e306turn 0% 0%)", "hsl(1e307rad 0% 0%)", "rgb(calc(1) 0 0)", "CanvasText", "f(x"]
    got = each(spark, [*known, *invalid, *unsupported, None], colours.css_colour(F.col("v")))
    for (value, want), found in zip(known.items(), got, strict=False):
        assert found.status == "known" and all(math.isclose(found[c], w, abs_tol=1e-12) for c, w in zip("rgba", want, strict=True)), (value, found)
    rest = got[len(known) :]
    assert [r and r.status for r in rest] == ["invalid"] * len(invalid) + ["unsupported"] * len(unsupported) + [None]
    assert all(r is None or r.r is None for r in rest)


def test_long_colour_values(spark):
    got = each(spark, ["rgb(" + "," * (1 << 20) + ")", "rgb(" + " " * (1 << 20) + ")", "rgb(0 0 0 / " + " " * (1 << 20) + ")", " " * (1 << 20)], colours.css_colour(F.col("v")))
    assert [r.status for r in got] == ["invalid"] * 4


def test_visibility(spark):
    lit, none = F.lit, F.lit(None)
    cases = [
        ({}, "visible", 0), ({"display_none": lit(True)}, "concealed", 1), ({"visibility": lit("collapse")}, "concealed", 4), ({"alpha": lit(0.01)}, "concealed", 8), ({"font_px": lit(2.0)}, "concealed", 16), ({"font_px": lit(2.0), "has_text": lit(False)}, "visible", 0),
        ({"font_px": lit(2.0), "font_uncertain": lit(True)}, "unknown", 0), ({"font_px": lit(0.0), "font_uncertain": lit(True)}, "concealed", 16), ({"colour_distance": lit(0.005)}, "concealed", 32), ({"clipped": lit(True), "uncertain_reasons": lit(64)}, "unknown", 64), ({"clipped": lit(True), "alpha": lit(0.0), "uncertain_reasons": lit(64)}, "concealed", 72),
        ({"content_hidden": lit(True), "animated": lit(True)}, "unknown", 128), ({"animated": lit(True), "surely_none": lit(True)}, "concealed", 0), ({"word_hidden": lit(True)}, "unknown", 0), ({"alpha": none.cast("double")}, "unknown", 0), ({"colour_distance": none.cast("double")}, "unknown", 0), ({"colour_distance": none.cast("double"), "has_text": lit(False)}, "visible", 0), ({"layout_uncertain": lit(True)}, "unknown", 0),
    ]
    row = spark.range(1).select(*[policy.decided_visibility(style).alias(f"c{i}") for i, (style, _, _) in enumerate(cases)]).first()
    assert [(r.label, r.reasons) for r in row] == [(label, bits) for _, label, bits in cases]


def test_signatures(spark):
    all_ = ("lnk", "cab", "chm", "iso", "vhdx", "vhd", "dmg", "one", "apk", "z", "rar", "7z")
    contents = [b"\0" * 32769 + b"CD001", b"\0" * 32768 + b"CD001", b"x" * 9 + b"koly" + b"\0" * 508, b"koly", b"x" + b"conectix" + b"\0" * 504, b"\x1f\x9d\x90", b"\x1f\x9d\x11", b"\x1f\x9d\xb0", b"\x1f\x9d\x09", b"\x1f\x9d", b"Rar!\x1a\x07\x01\x00", b"Rar!\x1a\x07\x01\x01", b"dex\n035\0", b"dex\n035", b"", None]
    want = ["ISO disk image", None, "Apple disk image", None, "VHD disk image", "Unix compress archive", None, None, "Unix compress archive", None, "RAR archive", None, "Android DEX executable", None, None, None]
    got = each(spark, contents, numbers.configured_signature(F.col("v"), all_), numbers.configured_signature(F.col("v"), ("exe",)), kind="binary")
    assert got == [(w and f"{w} signature", None) for w in want]
    kinds = spark.createDataFrame([(b"", "x.bin", "application/X-gzip"), (b"", "x.bzip2", None), (b"BZh9", "x.zip", None), (None, None, None)], "c binary, n string, t string")
    assert [r.k for r in kinds.select(numbers.archive_format(F.col("c"), F.col("n"), F.col("t")).alias("k")).collect()] == ["gzip", "bzip2", "bzip2", None]


def test_mailboxes(spark):
    local, host = "a" * 64, "b" * 63 + "." + "c" * 63 + "." + "d" * 61
    cases = {
        "Malformed [display <Sender@Example.COM>": "sender@example.com", "Malformed <first@example.com> <second@example.com>": "", "Malformed <not-an-address>": "", "Malformed <Name <sender@example.com>": "", "": "", "missing-at.example": "", "a@under_score.example": "", "a@-bad.example": "",
        f"{local}@{host}": f"{local}@{host}", f"{local}@{host}d": "", "x" * 311 + " <a@b.co>": "a@b.co", "x" * 312 + " <a@b.co>": "", "User@Example.COM.": "user@example.com", "User Name <User@Example.COM.>": "user@example.com", "user@example.com..": "", '"a <b@c.d>" <q@h.example>': "q@h.example", "<q@h.example>": "q@h.example", "a@b@c.example": "", " \t": "",
    }
    assert each(spark, [*cases, None], addresses.canonical_mailbox(F.col("v"))) == [*cases.values(), ""]
    assert each(spark, ["Malformed [display <Sender@Example.com>", "<" * 100_000, "a." * 100_000, None], addresses.mailbox(F.col("v"))) == ["Sender@Example.com", None, None, None]


def test_content_ids(spark):
    assert each(spark, [" < A%20+b > ", "<open", "shut>", "<>", "<", "x%zz", None], text.content_id(F.col("v"))) == ["a +b", "<open", "shut>", "", "<", "x%zz", None]


def test_alternatives(spark):
    rows = [
        (1, 1, 7, False, True, False, "plain"), (1, 2, 7, True, False, False, "html"), (1, 3, 7, True, False, False, " "), (1, 4, 7, False, True, True, "file"), (1, 5, None, False, False, False, "outside"),
        (2, 1, 1, False, True, False, "first"), (2, 2, 1, False, True, False, "second"), (2, 3, 2, False, False, False, None), (2, 4, 2, None, None, None, ""),
        (None, 1, 1, True, False, False, "no id"), (None, None, 1, True, False, False, "no place"),
    ]
    parts = spark.createDataFrame(rows, "id int, position int, alternative int, html boolean, plain boolean, attachment boolean, text string").withColumn("__best", F.lit(1))
    kept = assembly.choose_alternatives(parts.drop("__best"))
    assert sorted((str(r.id), str(r.position)) for r in kept.collect()) == [("1", "2"), ("1", "4"), ("1", "5"), ("2", "2"), ("2", "4"), ("None", "1")]
    assert assembly.choose_alternatives(parts.drop("__best").limit(0)).count() == 0


def test_archived_messages(spark):
    many = "".join(f"Authentication-Results: {'r' * 8000}{i}\n" for i in range(6))
    raws = [
        "From: a\r\nFROM: b\r\nContent-Type: text/plain;\r\n charset=x\r\nX-Archive-Truncated: no\nX-Archive-Truncated: Yes \r\n\r\nline\r\n\r\nend", f"{many}Subject: {'é' * 5000}\n\n", "\nSubject: body only", " folded first\n\nx", "", "Subject: x\n\n" + "b" * 60_000, None,
    ]
    got = each(spark, raws, headers.archived(F.col("v"), 60_000, counted=("x-score",)))
    first = got[0].message
    assert got[0].error is None and first.headers == {"from": ["a", "b"], "content-type": ["text/plain; charset=x"]} and first.occurrences == {"from": 2, "x-score": 0}
    assert first.body == "line\n\nend" and first.archive_truncated and not (first.truncated or first.body_truncated)
    second = got[1].message
    assert len(second.headers["authentication-results"]) == 4 and len(second.headers["subject"][0]) == 4096 and second.truncated and not second.structure_truncated and second.body == ""
    assert got[2].message.body == "Subject: body only" and got[2].message.headers == {}
    assert [g and g.error for g in got[3:]] == ["parse archived message", "parse archived message", "archived message exceeds configured size limit", None]


def test_resolved_links(spark):
    """Relative references against the base of the published examples, and links that lead nowhere."""
    base = "http://a/b/c/d;p?q"
    cases = {
        "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", ";x": "http://a/b/c/;x", ".": "http://a/b/c/", "./": "http://a/b/c/",
        "..": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./g/.": "http://a/b/c/g/", "g/../h": "http://a/b/c/h", "g?y/../x": "http://a/b/c/g?y/../x",
        "HTTP://H/x": "http://H/x", "tel:+1": "tel:+1", "g:h": None, "javascript:x": None, "http:///x": None, "http://:80/": None, "http:x": None, ":x": None, "1:2": None, "./1:2": "http://a/b/c/1:2", " \t": None, "a\x01b": "http://a/b/c/a%01b", "http://h\x01/": None, "a%zz": None, "?%zz": "http://a/b/c/d;p?%zz", "/" * 9000: None,
    }
    assert each(spark, [*cases, None], headers.resolved(F.col("v"), F.lit(base))) == [*cases.values(), None]
    assert each(spark, ["/x/../y", "http://h/a/../b", "../" * 2000], headers.resolved(F.col("v"), F.lit(None).cast("string"))) == ["/x/../y", "http://h/a/../b", "../" * 2000]
    assert each(spark, ["../" * 2700 + "x", "a/" * 4000], headers.resolved(F.col("v"), F.lit("https://h.example"))) == ["https://h.example/x", "https://h.example/" + "a/" * 4000]
