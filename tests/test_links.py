"""Links and addresses of whole tables against plain Python."""

import re

from pyspark.sql import functions as F

from vetspan import plans
from vetspan.functions import text


def links(html):
    out = []
    for u in re.findall(r"""(?i)https?://[^ \t\n\f\r<>"']+""", html):
        u = re.sub(r"[.,;:!?]+$", "", u)
        for a, b in ("()", "[]", "{}"):
            if u.endswith(b) and u.count(b) > u.count(a):
                u = re.sub(r"[.,;:!?]+$", "", u[:-1])
        if re.match(r"(?i)https?://[^/?#\s]+", u) and u not in out and len(out) < 100:
            out.append(u)
    return out


def compact(url):
    m = re.fullmatch(r"(?s)([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*@)?([^/?#@\s]+)([^?#]*)(\?[^#]*)?(#.*)?", url)
    if not m:
        return url[:512]
    scheme, user, host, path, query, fragment = (x or "" for x in m.groups())
    short = "/".join((s[-64:] if re.search(r"(?s).\.[A-Za-z0-9]{1,16}$", s) else s[:64]) if len(s) > 64 else s for s in path.split("/"))
    pairs = query and "?" + "&".join("=".join(x[:50] for x in p.split("=", 1)) for p in query[1:].split("&"))
    if (short, pairs, fragment[:51]) == (path, query, fragment) and len(url) <= 512:
        return url
    return (scheme.lower() + "://" + ("[userinfo-omitted]@" if user else "") + host + short + pairs + fragment[:51])[:512]


def test_links_with_brackets(spark):
    pages = ["see (http://a.example/x). and [http://b.example/y_(z)], http://c.example/{q}} http://d.example/[1]", "no", "(https://e.example/a))! http://e.example/ok", "http://] http://f.example/(("]
    rows = spark.createDataFrame(list(enumerate(pages)), "id long, html string").select("id", text.capped_links(text.urls(F.col("html")), 100, 1 << 20).alias("links"))
    got = {r.id: r.links for r in rows.collect()}
    assert got == {i: links(p) for i, p in enumerate(pages)}
    assert got[0] == ["http://a.example/x", "http://b.example/y_(z)", "http://c.example/{q}", "http://d.example/[1]"]


def test_long_addresses(spark):
    urls = [
        "http://e.example/", "http://u:p@e.example/" + "a" * 65, "http://e.example/" + "b" * 70 + ".html", "http://e.example/" + "c" * 64 + "/" + "d" * 65 + "/e",
        "http://e.example/?" + "k" * 51 + "=" + "v" * 51 + "&a=b=" + "w" * 60 + "&" + "x" * 80, "https://e.example/p#" + "f" * 51, "http://e.example" + "/seg" * 300, "not an address " * 60, "http://e.example/?a=1&b=" + "é" * 60 + "#" + "g" * 50,
    ]
    rows = spark.createDataFrame(list(enumerate(urls)), "id long, url string").select("id", text.compact_url(F.col("url")).alias("short"))
    assert {r.id: r.short for r in rows.collect()} == {i: compact(u) for i, u in enumerate(urls)}


def test_all_pages(spark, data):
    pages = {r.page_id: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = {r.page_id: r.links for r in plans.queries()["l1_l2_l8_all_page_links"](spark, data).collect()}
    assert got == {i: " ".join(links(r.html)) for i, r in pages.items()}
    tail = "/" + "segment-" * 9 + "?key=" + "value" * 11
    got = {r.page_id: (r.short, r.short_of_longer) for r in plans.queries()["l4_l5_compact_all_urls"](spark, data).collect()}
    assert got == {i: (compact(r.url), compact(r.url + tail)) for i, r in pages.items()}
