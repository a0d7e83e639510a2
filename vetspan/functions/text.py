"""Text clean-up, compaction and escaping as Column expressions; lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let, through_last, without_end

#: Format characters that pad text invisibly, besides white space.
PADDING_FORMAT = r"\x{00AD}\x{034F}\x{061C}\x{180E}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}"
SPACES = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PADDING = f"[{SPACES}{PADDING_FORMAT}]"
#: Names of the tags that the extractor writes; the same tags in a message are taken out.
RESERVED_TAGS = ("invisible", "visibility-varies-by-viewport-size", "visibility-uncertain", "hidden-content-stripped", "quoted-content", "attached-email", "attached-file")
#: Fixed value: what stands behind a body that was cut.
TRUNCATION_NOTICE = "\n[processed email body truncated; the remainder was omitted]"


def single_line(text: Column, limit: int) -> Column:
    """One line: invalid bytes become U+FFFD, controls and runs of white space one space, over `limit` characters an ellipsis."""
    valid = F.make_valid_utf8(text)
    flat = F.trim(F.regexp_replace(F.regexp_replace(valid, r"\p{Cc}", " "), f"[{SPACES}]+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("…"))).otherwise(flat)


def joined_reasons(reasons: Column, limit: int = 1000) -> Column:
    """Non-empty cleaned reasons with "; " between, cleaned again as a whole."""
    cleaned = F.filter(F.transform(reasons, lambda r: single_line(r, limit)), lambda r: r != "")
    return single_line(F.array_join(cleaned, "; "), limit)


def normalised_space(text: Column) -> Column:
    """Runs of space, tab and form feed become one space, none beside line ends; at most two line ends in a row; ends trimmed."""
    flat = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t\f]+", " ")
    flat = F.regexp_replace(F.regexp_replace(flat, r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(flat, r"^[ \n]+|[ \n]+$", "")


def is_padding_only(text: Column) -> Column:
    """Whether a non-empty text has nothing but white space and invisible padding."""
    return text.rlike(f"^{PADDING}+$")


def compact_padding(text: Column) -> Column:
    """Runs of 32 or more padding characters that hold a format character keep their first eight."""
    return F.regexp_replace(text, f"(?<!{PADDING})(?=[{SPACES}]*+[{PADDING_FORMAT}])({PADDING}{{8}}){PADDING}{{24,}}+", "$1")


def without_reserved_tags(text: Column) -> Column:
    tag = rf"(?iu)</?[ \t\n\r\f]*+(?:{'|'.join(RESERVED_TAGS)})(?![A-Za-z0-9_])[^>]*+>"
    return let(through_last(text, ">"), lambda h: F.concat(F.regexp_replace(h, tag, ""), F.substring(text, F.length(h) + 1, F.length(text))))


def body_text(text: Column) -> Column:
    return compact_padding(without_reserved_tags(text))


def confident_characters(text: Column) -> Column:
    """Characters of the cleaned body, 0 where nothing but padding is left."""
    clean = normalised_space(body_text(text))
    return F.when((clean == "") | is_padding_only(clean), 0).otherwise(F.length(clean)).cast("long")


def without_format_characters(text: Column) -> Column:
    """Format characters and U+034F go, runs of spaces become one."""
    return F.regexp_replace(F.regexp_replace(text, r"[\p{Cf}\x{034F}]", ""), " {2,}", " ")


def ascii_space_folded(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\n\f\r]+", " ")


def truncated(text: Column, limit: int, notice: str = TRUNCATION_NOTICE) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(notice))).otherwise(text)


def one_line(text: Column) -> Column:
    return F.translate(text, "\r\n", "  ")


def header_value(text: Column) -> Column:
    return one_line(F.make_valid_utf8(text))


def connection_value(text: Column) -> Column:
    return F.left(F.trim(F.regexp_replace(text, r"\p{Cc}", "")), F.lit(255))


def canonical_header(name: Column) -> Column:
    """reply-to becomes Reply-To: the first letter of each part in upper case, the rest as it is."""
    return F.array_join(F.transform(F.split(name, "-"), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, F.lit(2), F.length(p)))), "-")


def markdown_escaped(text: Column) -> Column:
    """Text as the label of a Markdown link."""
    return F.regexp_replace(text, r"([\\\[\]])", r"\\$1")


def markdown_url(text: Column) -> Column:
    out = text
    for a in "\\ ()<>":
        out = F.replace(out, F.lit(a), F.lit(f"%{ord(a):02X}"))
    return out


def joined_parts(parts: Column) -> Column:
    """Non-empty parts with a blank line between."""
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def comment_summary(characters: Column, within_words: Column, body_characters: Column) -> Column:
    """A sentence on omitted HTML comments where some split a word, or where they are 100 characters and as many as the body; else empty."""
    share = F.when(body_characters > 0, F.concat(F.lit(" was "), F.bround(characters * 100.0 / body_characters).cast("long").cast("string"), F.lit("% of extracted body length"))).otherwise(" accompanied an empty extracted body")
    words = F.when(within_words > 0, F.concat(F.lit("; "), within_words.cast("string"), F.when(within_words == 1, " comment occurred").otherwise(" comments occurred"), F.lit(" within words"))).otherwise("")
    told = F.concat(F.lit("\nEXTRACTOR-GENERATED HTML COMMENT SUMMARY: Omitted HTML comment text"), share, words, F.lit(".\n"))
    return F.when((within_words > 0) | ((characters >= 100) & (characters >= body_characters)), told).otherwise("")


def annotations(text: Column) -> Column:
    """Which annotations a rendered body uses."""
    marks = {"invisible": "<invisible ", "hidden-content-stripped": "<hidden-content-stripped/>"}
    return F.struct(*[F.contains(text, F.lit(marks.get(t, f"<{t}>"))).alias(t.replace("-", "_")) for t in RESERVED_TAGS])


def lines(text: Column) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def smtp_identity(text: Column) -> Column:
    """Trimmed and without controls, at most 255 characters; "unknown", in brackets or not, is empty."""
    clean = without_end(F.regexp_replace(F.regexp_replace(F.make_valid_utf8(text), r"\p{Cc}", ""), f"^[{SPACES}]+", ""), SPACES)
    return let(clean, lambda c: F.when(F.lower(c).isin("unknown", "[unknown]"), "").otherwise(F.left(c, F.lit(255))))


def byte_truncated(text: Column, limit: int | Column) -> Column:
    """At most `limit` bytes, cut before a character that doesn't fit."""
    raw = F.encode(text, "UTF-8")
    following = F.conv(F.hex(F.substring(raw, limit + 1, 1)), 16, 10).cast("int")
    # the character that holds byte limit + 1 starts at most three bytes before it
    back = F.lit(0)
    for n in (3, 2, 1):
        lead = F.conv(F.hex(F.substring(raw, limit + 1 - n, 1)), 16, 10).cast("int")
        inside = F.lit(True)
        for m in range(n - 1):
            inside = inside & F.conv(F.hex(F.substring(raw, limit - m, 1)), 16, 10).cast("int").between(0x80, 0xBF)
        back = F.when((lead >= 0xC0) & inside, n).otherwise(back)
    cut = F.when(following.between(0x80, 0xBF), F.lit(limit) - back).otherwise(F.lit(limit))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"))


#: What may be an http(s) address in plain text.
PLAIN_URL = r"""(?i)https?://[^ \t\n\f\r<>"']+"""


def _address(found: Column) -> Column:
    """A match of PLAIN_URL without final punctuation and an unopened closing bracket."""
    end = ".,;:!?"

    def balanced(u: Column, pairs: tuple[str, ...]) -> Column:
        if not pairs:
            return u
        opening, closing = pairs[0]

        def of(x: Column) -> Column:
            count = lambda c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
            extra = F.endswith(x, F.lit(closing)) & (count(closing) > count(opening))
            return balanced(F.when(extra, without_end(F.left(x, F.length(x) - 1), end)).otherwise(x), pairs[1:])

        return let(u, of)

    return balanced(without_end(found, end), ("()", "[]", "{}"))


def urls(text: Column) -> Column:
    """http(s) addresses in plain text without final punctuation and an unopened closing bracket."""
    return F.transform(F.regexp_extract_all(text, F.lit(PLAIN_URL), F.lit(0)), _address)


def rewritten_urls(text: Column, count: int = 100, characters: int = 8192) -> Column:
    """struct<text, links>: the text with its addresses in compact form, and the addresses as capped_links has them; null for null."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PLAIN_URL), F.lit(0)), lambda m: F.struct(m.alias("m"), _address(m).alias("u")))
    gaps = F.split(text, PLAIN_URL, -1)

    def of(fs: Column) -> Column:
        shown = F.transform(fs, lambda f: F.concat(compact_url(f["u"]), F.substring(f["m"], F.length(f["u"]) + 1, F.length(f["m"]))))
        joined = F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(fs)), shown, lambda g, x: F.concat(g, x)), ""), F.element_at(gaps, -1))
        return F.struct(joined.alias("text"), capped_links(F.transform(fs, lambda f: f["u"]), count, characters).alias("links"))

    return F.when(text.isNotNull(), let(found, of))


def comment_statistics(html: Column) -> Column:
    """struct<characters, within_words> of the comments of an HTML text, read lexically; conditional comments don't count.

    A comment is within a word where a letter or digit stands right before and right behind it.
    """
    plain = r"(?s)([\p{L}\p{N}]?+)<!--(?!>|->|\s*+\[if\b|\s*+<!\[)(?>(.*?)-->)"

    def of(closed: Column) -> Column:
        before, inner = (F.regexp_extract_all(closed, F.lit(plain), F.lit(i)) for i in (1, 2))
        behind = F.regexp_extract_all(F.left(html, F.length(closed) + 1), F.lit(plain + r"(?=([\p{L}\p{N}]?))"), F.lit(3))
        split = F.size(F.filter(F.zip_with(before, behind, lambda a, b: (a != "") & (b != "")), lambda x: x)).cast("long")
        return F.struct(F.aggregate(inner, F.lit(0), lambda s, x: s + F.length(x)).alias("characters"), split.alias("within_words"))

    return F.when(html.isNotNull(), let(through_last(html, "-->"), of))


def processed_body(body: Column, stripped: Column, concealed: Column, incomplete: Column, limit: int) -> Column:
    """struct<body, truncated, concealed_removed>: over `limit` characters concealed text goes first, then the end; incomplete bodies say so."""
    gone = F.coalesce(concealed, F.lit(False)) & (F.length(body) > limit)
    kept = F.when(gone, stripped).otherwise(body)
    tail = F.when(incomplete, "\n[Content extraction incomplete; some content may be missing]").otherwise("")
    return let(kept, lambda b: F.struct(F.concat(truncated(b, limit), tail).alias("body"), (F.length(b) > limit).alias("truncated"), gone.alias("concealed_removed")))


def new_links(links: Column, body: Column) -> Column:
    return F.filter(links, lambda u: ~F.contains(body, u))


def capped_links(links: Column, count: int = 100, characters: int = 8192) -> Column:
    """Distinct http(s) links in order while there are at most `count` and their lengths add up to at most `characters`."""
    proper = F.array_distinct(F.filter(links, lambda u: u.rlike(r"(?i)^https?://[^/?#\s]+")))

    def add(s: Column, u: Column) -> Column:
        fits = (F.size(s["all"]) < count) & (s["n"] + F.length(u) <= characters)
        return F.struct(F.when(fits, F.concat(s["all"], F.array(u))).otherwise(s["all"]).alias("all"), F.when(fits, s["n"] + F.length(u)).otherwise(s["n"]).alias("n"))

    start = F.struct(F.expr("CAST(array() AS array<string>)").alias("all"), F.lit(0).alias("n"))
    return F.aggregate(proper, start, add, lambda s: s["all"])


def content_id(text: Column) -> Column:
    """Lower-case Content-ID without the angle brackets around it; percent escapes are undone, a plus sign stays."""
    bare = let(F.trim(text), lambda t: F.when(F.startswith(t, F.lit("<")) & F.endswith(t, F.lit(">")), F.trim(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t))
    return F.lower(F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare))


#: A file extension of 1 to 16 letters and digits behind a dot that isn't the first character; all of them may be percent-encoded.
EXTENSION = r"(?s)^.+(?:\.|%2[Ee])(?:[A-Za-z0-9]|%(?:3[0-9]|[46][1-9A-Fa-f]|[57][0-9Aa])){1,16}$"
URL = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://((?:[^/?#]*@)?)([^/?#@\s]+)([^?#]*)((?:\?[^#]*)?)((?:#.*)?)$"
#: What no part of an address may hold: controls, and percent signs without two hexadecimal digits outside the query.
NOT_URL = r"[\x00-\x1f\x7f]|^[^?#]*%(?![0-9A-Fa-f]{2})|#.*%(?![0-9A-Fa-f]{2})"


def compact_url(url: Column, segment: int = 64, value: int = 50, total: int = 512) -> Column:
    """A shorter form of an address: path segments, query keys, values and the fragment are cut, and the whole.

    A long segment that ends in a file extension keeps its end. An address of which nothing is cut stays as
    it is; otherwise user information is left out and the scheme in lower case. Other text is cut only.
    """
    scheme, user, host, path, query, fragment = (F.regexp_extract(url, URL, i) for i in range(1, 7))

    def cut_segment(x: Column) -> Column:
        return F.when(F.length(x) <= segment, x).when(F.regexp_like(x, F.lit(EXTENSION)), F.right(x, F.lit(segment))).otherwise(F.left(x, F.lit(segment)))

    def cut_pairs(q: Column) -> Column:
        pair = lambda p: F.array_join(F.transform(F.split(p, "=", 2), lambda x: F.left(x, F.lit(value))), "=")
        return F.when(q == "", q).otherwise(F.concat(F.lit("?"), F.array_join(F.transform(F.split(F.substring(q, F.lit(2), F.length(q)), "&"), pair), "&")))

    parts = F.struct(
        path.alias("path"), query.alias("query"), fragment.alias("fragment"),
        F.array_join(F.transform(F.split(path, "/"), cut_segment), "/").alias("short_path"),
        cut_pairs(query).alias("short_query"),
        F.when(fragment == "#", "").otherwise(F.left(fragment, F.lit(value + 1))).alias("short_fragment"),
    )

    def built(p: Column) -> Column:
        changed = (p["path"] != p["short_path"]) | (p["query"] != p["short_query"]) | ((p["fragment"] != p["short_fragment"]) & (p["fragment"] != "#")) | (F.length(url) > total)
        whole = F.concat(F.lower(scheme), F.lit("://"), F.when(user != "", "[userinfo-omitted]@").otherwise(""), host, p["short_path"], p["short_query"], p["short_fragment"])
        return F.when(changed, F.left(whole, F.lit(total))).otherwise(url)

    proper = F.regexp_like(url, F.lit(URL)) & ~F.regexp_like(url, F.lit(NOT_URL))
    return F.when(proper, let(parts, built)).otherwise(F.left(url, F.lit(total)))
