"""Header fields and mailbox lists of messages as Column expressions."""

from __future__ import annotations

import base64
import quopri
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.addresses import domain_of, normalised, parent_domains
from ..functions.core import let, through_last, without_end
from ..functions.text import byte_truncated


def head(raw: Column) -> Column:
    """The header block of a message, its folded lines joined."""
    block = F.regexp_replace(F.get(F.split(F.regexp_replace(raw, r"\r\n?", "\n"), "\n\n", 2), F.lit(0)), r"\n[ \t]+", " ")
    return block


def body(raw: Column, limit: int) -> Column:
    """struct<body, truncated>: what follows the first empty line, at most `limit` characters of it."""
    rest = F.get(F.split(F.regexp_replace(raw, r"\r\n?", "\n"), "\n\n", 2), F.lit(1))
    return let(F.coalesce(rest, F.lit("")), lambda b: F.struct(F.left(b, F.lit(limit)).alias("body"), (F.length(b) > limit).alias("truncated")))


def fields(raw: Column, per_name: int = 100) -> Column:
    """map<string, array<string>> of header fields by lower-case name in order, at most `per_name` values of a name."""
    lines = F.filter(F.split(head(raw), "\n"), lambda x: x.rlike(r"^[!-9;-~]+\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))

    def of(all_: Column) -> Column:
        names = F.array_distinct(F.transform(all_, lambda p: p["k"]))
        return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.slice(F.transform(F.filter(all_, lambda p: p["k"] == n), lambda p: p["v"]), 1, per_name))))

    return let(pairs, of)


#: Fields that are kept of a message, those that tell how its parts are written, and the bytes kept of a value and of all values of a name.
KEPT = ("authentication-results", "content-disposition", "content-transfer-encoding", "content-type", "date", "from", "message-id", "received-spf", "reply-to", "return-path", "subject", "to")
STRUCTURE = ("content-disposition", "content-transfer-encoding", "content-type")
VALUE_BYTES, STRUCTURE_BYTES, NAME_BYTES, AUTHENTICATION_BYTES = 8 << 10, 64 << 10, 16 << 10, 32 << 10


def _kept_values(field: Column, values: Column) -> Column:
    """struct<values, cut>: the values of a field in order, each cut at whole characters to field.each bytes, while they fit field.total; larger ones between are left out."""

    def add(s: Column, value: Column) -> Column:
        def of(v: Column) -> Column:
            size = s["n"] + F.octet_length(v) + F.length(field["name"]) + 2
            return F.struct(F.when(size <= field["total"], F.concat(s["all"], F.array(v))).otherwise(s["all"]).alias("all"), F.when(size <= field["total"], size).otherwise(s["n"]).cast("int").alias("n"), (s["cut"] | (F.octet_length(value) > field["each"]) | (size > field["total"])).alias("cut"))

        return let(byte_truncated(value, field["each"]), of)

    start = F.struct(F.expr("CAST(array() AS array<string>)").alias("all"), F.lit(0).alias("n"), F.lit(False).alias("cut"))
    return F.aggregate(values, start, add, lambda s: F.struct(s["all"].alias("values"), s["cut"].alias("cut")))


def _limits(name: str) -> Column:
    structure = name in STRUCTURE
    total = STRUCTURE_BYTES + 256 if structure else AUTHENTICATION_BYTES if name == "authentication-results" else NAME_BYTES
    return F.struct(F.lit(name).alias("name"), F.lit(STRUCTURE_BYTES if structure else VALUE_BYTES).alias("each"), F.lit(total).alias("total"), F.lit(structure).alias("structure"))


def archived(raw: Column, limit: int, cut_mark: str = "x-archive-truncated", counted: tuple[str, ...] = ()) -> Column:
    """struct<error, message> of a message that was kept, message a struct of what follows.

    error says why a message isn't read: it is over `limit` bytes, or its first line is no field; message is null then.
    headers maps the names KEPT and `counted` to their values, as far as they fit (`truncated`, for STRUCTURE also
    structure_truncated); occurrences counts From and `counted` fields, left-out ones too. body is what fits beside the
    header within the limit. archive_truncated: a field cut_mark says yes. Invalid bytes become U+FFFD; null stays null.
    """

    def of(m: Column) -> Column:
        halves = F.split(F.regexp_replace(m, r"\r\n?", "\n"), r"(?<![^\n])\n", 2)
        parsed = let(halves, lambda h: F.struct(fields(F.get(h, F.lit(0)), 1 << 20).alias("f"), F.octet_length(head(F.get(h, F.lit(0)))).alias("h"), F.coalesce(F.get(h, F.lit(1)), F.lit("")).alias("b")))

        def told(p: Column) -> Column:
            values = lambda n: F.coalesce(F.try_element_at(p["f"], n if isinstance(n, Column) else F.lit(n)), F.expr("CAST(array() AS array<string>)"))
            kept = F.transform(F.array(*[_limits(n) for n in (*KEPT, *counted)]), lambda e: F.struct(e["name"].alias("name"), e["structure"].alias("structure"), _kept_values(e, values(e["name"])).alias("v")))

            def built(k: Column) -> Column:
                some = F.filter(k, lambda e: F.size(e["v"]["values"]) > 0)
                room = F.greatest(F.lit(limit) - p["h"] - 2, F.lit(0))
                fits = F.octet_length(p["b"]) <= room
                return F.struct(
                    F.map_from_entries(F.transform(some, lambda e: F.struct(e["name"], e["v"]["values"]))).alias("headers"),
                    F.map_from_arrays(F.array(*[F.lit(n) for n in ("from", *counted)]), F.array(*[F.size(values(n)) for n in ("from", *counted)])).alias("occurrences"),
                    F.when(fits, p["b"]).otherwise(F.make_valid_utf8(F.substring(F.encode(p["b"], "UTF-8"), F.lit(1), room))).alias("body"),
                    (F.exists(k, lambda e: e["v"]["cut"]) | ~fits).alias("truncated"), F.exists(k, lambda e: e["v"]["cut"] & e["structure"]).alias("structure_truncated"), (~fits).alias("body_truncated"),
                    F.exists(values(cut_mark), lambda v: F.lower(v) == "yes").alias("archive_truncated"),
                )

            return let(kept, built)

        return F.when(m.rlike(r"^(?:[!-9;-~]++:|\r?\n)"), let(parsed, told))

    read = F.when(F.octet_length(raw) <= limit, let(F.make_valid_utf8(raw), of))
    why = F.when(F.octet_length(raw) > limit, "archived message exceeds configured size limit").otherwise("parse archived message")
    return F.when(raw.isNotNull(), let(read, lambda r: F.struct(F.when(r.isNull(), why).alias("error"), r.alias("message"))))


def occurrences(headers: Column, name: str) -> Column:
    return F.size(F.coalesce(F.try_element_at(headers, F.lit(name.lower())), F.expr("CAST(array() AS array<string>)")))


def first_value(headers: Column, name: str) -> Column:
    return F.get(F.try_element_at(headers, F.lit(name.lower())), F.lit(0))


def mailboxes(text: Column, limit: int = 100) -> Column:
    """Distinct normalised mailboxes of an address list, the first `limit` in order, sorted.

    Quoted names and comments in brackets don't count, so an address inside them isn't taken.
    """
    bare = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"\([^()]*\)", "")
    found = F.filter(F.split(bare, r"[\s<>,;:\"]++"), lambda t: F.contains(F.substring(t, F.lit(2), F.length(t) - 2), F.lit("@")))
    clean = F.filter(F.transform(found, lambda a: normalised(F.regexp_replace(a, r"\.$", ""))), lambda a: a != "")
    return F.array_sort(F.slice(F.array_distinct(clean), 1, limit))


def names_protected_domain(text: Column, domains: tuple[str, ...]) -> Column:
    """Whether any address in a From value, well formed or not, is of a protected domain or below it."""
    found = F.regexp_extract_all(text, F.lit(r"@([A-Za-z0-9.\-]+)"), F.lit(1))
    return F.exists(found, lambda d: F.arrays_overlap(parent_domains(F.lower(without_end(d, "."))), F.array(*[F.lit(x) for x in domains])))


def empty_group(to: Column) -> Column:
    """Whether To is a group without members, such as "undisclosed-recipients:;"."""
    return to.rlike(r"^[^:;@<>]++:\s*+;\s*+$")


#: Fixed value: links of a message are kept up to so many characters in all, so that longer ones never are.
LINK_CHARACTERS = 8192
#: Characters that are written as percent signs and two digits.
ESCAPED = [chr(c) for c in (*range(1, 0x20), 0x7F)]


def _without_dots(path: Column) -> Column:
    """A path whose . and .. segments are taken; it starts with a slash, and .. at the root is dropped."""

    def step(kept: Column, segment: Column) -> Column:
        return F.when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(segment == ".", kept).otherwise(F.concat(kept, F.array(segment)))

    def of(p: Column) -> Column:
        ended = F.when(p.rlike(r"(?:^|/)\.\.?$"), F.concat(p, F.lit("/"))).otherwise(p)
        kept = F.aggregate(F.split(F.regexp_replace(ended, "^/", ""), "/"), F.expr("CAST(array() AS array<string>)"), step)
        return F.when(p.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).when((p == "") | F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p))

    return let(path, of)


def resolved(link: Column, base: Column) -> Column:
    """Where a link leads: an absolute http, https, mailto or tel address, or, without a base, the relative one; null for others.

    Line ends, tabs and NULs go, other controls are percent-encoded, but rule a link out in its host. A relative
    link takes what it lacks from the base, an absolute http(s) address; its . and .. segments are taken. Links without
    text, with a colon in a relative first segment, with malformed escapes in their path or fragment, and over 8,192 characters
    lead nowhere. Spaces and letters beyond ASCII stay as they are.
    """
    whole = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*+:)?(//[^/?#]*+)?([^?#]*+)(\?[^#]*+)?(#.*+)?$"
    marks = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(f"%{ord(c):02X}").alias("to")) for c in ESCAPED])

    def split(text: Column) -> Column:
        return F.struct(*[F.regexp_extract(text, whole, i + 1).alias(n) for i, n in enumerate(("scheme", "host", "path", "query", "fragment"))])

    def clean(t: Column) -> Column:
        start = F.instr(t, "://")
        authority = F.when(start > 0, F.concat(F.left(t, start + 2), F.regexp_extract(F.substring(t, start + 3, F.length(t)), r"^[^/?#]*+", 0)))
        safe = F.when(t.rlike(r"[\x01-\x1f\x7f]"), F.aggregate(marks, t, lambda s, m: F.replace(s, m["c"], m["to"]))).otherwise(t)
        return F.when((t != "") & ~F.coalesce(authority.rlike(r"[\x01-\x1f\x7f]"), F.lit(False)), safe)

    def lead(t: Column) -> Column:
        def of(x: Column) -> Column:
            u, b, scheme = x["u"], x["b"], F.lower(x["u"]["scheme"])
            rest = F.concat(u["host"], u["path"], u["query"], u["fragment"])
            malformed = F.concat(u["path"], F.lit("#"), u["fragment"]).rlike(r"%(?![0-9A-Fa-f]{2})")
            hosted = u["host"].rlike(r"^//(?:[^@]*+@)?[^@:\s]") & ~malformed
            own = F.when(scheme.isin("http:", "https:"), F.when(hosted, F.concat(scheme, rest))).when(scheme.isin("mailto:", "tel:"), F.concat(scheme, rest))
            folder = F.regexp_replace(b["path"], r"(?<![^/])[^/]*+$", "")
            bare, same = u["path"] == "", (u["path"] == "") & (u["query"] == "")
            path = _without_dots(F.when(bare, b["path"]).when(F.startswith(u["path"], F.lit("/")), u["path"]).otherwise(F.concat(folder, u["path"])))
            local = F.concat(b["scheme"], b["host"], path, F.when(same, b["query"]).otherwise(u["query"]), u["fragment"])
            other = F.concat(b["scheme"], u["host"], _without_dots(u["path"]), u["query"], u["fragment"])
            relative = F.when(x["b"]["host"] == "", rest).when(u["host"] != "", F.when(hosted, other)).otherwise(local)
            return F.when(scheme != "", own).when(~malformed & ~((u["host"] == "") & u["path"].rlike(r"^[^/:]*+:")), relative)

        return let(F.struct(split(t).alias("u"), split(F.coalesce(base, F.lit(""))).alias("b")), of)

    text = F.trim(F.regexp_replace(F.make_valid_utf8(link), r"[\r\n\t\x00]", ""))
    return let(F.when(F.length(text) <= LINK_CHARACTERS, text), lambda t: let(clean(t), lead))


def base_address(html: Column, page: Column) -> Column:
    """What relative links of a page are resolved against: the first <base> with href decides, null if that isn't an absolute http(s) address; without one the page's own address."""
    tags = F.filter(F.regexp_extract_all(through_last(html, ">"), F.lit(r"(?i)<base(?=[\s/>])[^>]*+>"), F.lit(0)), lambda t: F.regexp_like(t, F.lit(r"(?i)[\s/]href\s*=")))
    href = r"""(?i)[\s/]href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""

    def of(first: Column) -> Column:
        value = F.trim(F.concat(*[F.regexp_extract(first, href, i) for i in (1, 2, 3)]))
        return F.when(first.isNull(), page).when(F.regexp_like(value, F.lit(r"(?i)^https?://[^/?#\s]+")), value)

    return let(F.get(tags, F.lit(0)), of)


def sender_domain(text: Column) -> Column:
    return domain_of(F.get(mailboxes(text, 1), F.lit(0)))


ENCODED = re.compile(r"=\?([^?\s]+)\?([BbQq])\?([^?\s]*)\?=")


def decoded_words(text: str) -> str:
    """Encoded words of a header field as the text they stand for; white space between two of them goes, malformed ones stay."""

    def of(m: re.Match) -> str:
        charset, kind, data = m[1].partition("*")[0], m[2].lower(), m[3]
        try:
            raw = base64.b64decode(data + "=" * (-len(data) % 4), validate=True) if kind == "b" else quopri.decodestring(data.replace("_", " "), header=True)
            return raw.decode(charset, "replace")
        except (ValueError, LookupError):
            return m[0]

    return ENCODED.sub(of, re.sub(r"(\?=)\s+(?==\?[^?\s]+\?[BbQq]\?[^?\s]*\?=)", r"\1", text))


def decoded_value(value: Column) -> Column:
    """A header value with its encoded words decoded; null stays null."""

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else decoded_words(v))

    return F.when(F.contains(value, F.lit("=?")), decode(value)).otherwise(value)
