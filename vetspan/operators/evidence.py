"""Evidence from message headers and bodies: authentication results, message parts, and visible text of HTML."""

from __future__ import annotations

import codecs
import email
import email.policy
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..functions.addresses import aligned
from ..functions.core import BATCH_BYTES, let, small_batches

METHODS = ("dkim", "spf", "dmarc")


RESULT = "array<struct<method:string,outcome:string,domain:string,spf_identity:string>>"
QUOTED = r'"(?:[^"\\]|\\.)*"'
OUTSIDE, INSIDE = re.compile(rf'{QUOTED}|[^"();]+|[;(]', re.S), re.compile(r"\\.|[()]|[^()\\]+", re.S)
METHOD = re.compile(r"\s*(dkim|spf|dmarc)\s*=\s*([a-z][a-z0-9_-]{0,31})\b", re.I | re.A)
PROPERTY = re.compile(rf'\s+([\w-]+)(?:\s*\.\s*([\w-]+))?\s*=\s*(?:({QUOTED})|<([^>]*)>|([^\s"<>]+))(?=\s|$)', re.S | re.A)
SPF_OUTCOME = re.compile(r"\s*([a-z][a-z0-9_-]{0,31})\b", re.I | re.A)
SPF_PARAMETER = re.compile(rf'([!#-\'*+\-./0-9A-Z^-~]+)[ \t]*=[ \t]*(?:({QUOTED})|([^ \t;(]+))', re.S)
LABEL = re.compile(r"(?!-)[a-z0-9_-]{1,63}(?<!-)", re.A)


def _unquoted(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text[1:-1], flags=re.S)


def _comment_end(text: str, at: int) -> int:
    """Where the comment that opens at `at` has ended, -1 if it doesn't."""
    depth = 0
    while m := INSIDE.match(text, at):
        depth += (m[0] == "(") - (m[0] == ")")
        at = m.end()
        if not depth:
            return at
    return -1


def _clauses(header: str) -> list[str]:
    """The parts between semicolons, comments of any depth as a space; none where quotes or brackets don't pair."""
    out, at = [""], 0
    pieces: list[str] = []
    while at < len(header):
        m = OUTSIDE.match(header, at)
        if m is None:
            return []
        if m[0] == "(":
            at = _comment_end(header, at)
            if at < 0:
                return []
            pieces.append(" ")
            continue
        if m[0] == ";":
            out[-1] = "".join(pieces)
            out.append("")
            pieces = []
        else:
            pieces.append(m[0])
        at = m.end()
    out[-1] = "".join(pieces)
    return out


def _domain(value: str | None) -> str | None:
    """The value as a DNS name in lower case (underscores too) without its final dot, null if it is none."""
    name = (value or "").strip().lower().removesuffix(".")
    return name if 0 < len(name) <= 253 and all(LABEL.fullmatch(x) for x in name.split(".")) else None


def _identity(value: str | None) -> str | None:
    return _domain((value or "").strip().strip("<>").rpartition("@")[2])


def _properties(text: str) -> dict[str, str]:
    """Assignments of a clause; none at all if one is malformed or stands twice."""
    out: dict[str, str] = {}
    at = 0
    while text[at:].strip():
        m = PROPERTY.match(text, at)
        if m is None:
            return {}
        key = (m[1] + (f".{m[2]}" if m[2] else "")).lower()
        if key in out:
            return {}
        out[key] = _unquoted(m[3]) if m[3] is not None else m[4] if m[4] is not None else m[5]
        at = m.end()
    return out


def _spf_parameters(header: str) -> dict[str, str]:
    """The first value of each parameter up to where the field is malformed."""
    out: dict[str, str] = {}
    at = re.match(r"[ \t]*[^ \t();=]*", header).end()
    while at < len(header):
        if header[at] in " \t;":
            at += 1
        elif header[at] == "(":
            at = _comment_end(header, at)
            if at < 0:
                break
        elif m := SPF_PARAMETER.match(header, at):
            out.setdefault(m[1].lower(), _unquoted(m[2]) if m[2] is not None else m[3])
            at = m.end()
        else:
            break
    return out


def _outcome(method: str, value: str) -> str:
    return "temperror" if (method, value.lower()) == ("spf", "tempfail") else value.lower()


def trusted_results(headers: list[str], spf_headers: list[str], trusted: frozenset[str]) -> list[tuple]:
    """(method, outcome, domain, spf_identity) of trusted fields, distinct in order; Received-SPF counts where no other has spf."""
    id_ = lambda x: x.strip().lower().removesuffix(".")
    out, names = {}, {id_(t) for t in trusted}
    for header in headers:
        clauses = _clauses(header or "")
        if len(clauses) < 2 or id_((clauses[0].split() or [""])[0]) not in names:
            continue
        for clause in clauses[1:]:
            if m := METHOD.match(clause):
                method, given, identity = m[1].lower(), _properties(clause[m.end() :]), None
                if method == "spf":
                    domain = _identity(given.get("smtp.mailfrom"))
                    identity = "mailfrom" if domain else "helo" if "smtp.helo" in given else None
                    domain = domain or _identity(given.get("smtp.helo"))
                else:
                    domain = _domain(given.get("header.d" if method == "dkim" else "header.from"))
                out[(method, _outcome(method, m[2]), domain, identity)] = None
    if any(r[0] == "spf" for r in out):
        return list(out)
    for header in spf_headers:
        given, m = _spf_parameters(header or ""), SPF_OUTCOME.match(header or "")
        if id_(given.get("receiver", "")) not in names or m is None:
            continue
        domain = _identity(given.get("envelope-from"))
        identity = "mailfrom" if domain else None
        empty = "envelope-from" in given and given["envelope-from"].strip() in ("", "<>")
        if given.get("identity", "").lower() == "helo" or ("identity" not in given and empty):
            domain, identity = _identity(given.get("helo")), "helo"
        out[("spf", _outcome("spf", m[1]), domain, identity)] = None
    return list(out)


def authentication_results(headers: Column, trusted: tuple[str, ...], spf_headers: Column | None = None) -> Column:
    """RESULT of the Authentication-Results fields (arrays of strings) whose service is trusted.

    Each field is read once from left to right, so a field of any length takes time in proportion. A result is
    for dkim, spf or dmarc; its domain is header.d, smtp.mailfrom or else smtp.helo, or header.from, null
    where a property of the clause is malformed or given twice. Without any spf result those of Received-SPF
    fields count whose receiver is trusted. Null arrays and fields hold nothing.
    """
    names = frozenset(trusted)

    @F.pandas_udf(RESULT)
    def read(fields: pd.Series, spf: pd.Series) -> pd.Series:
        listed = lambda x: [] if x is None else list(x)
        return pd.Series([[dict(zip(("method", "outcome", "domain", "spf_identity"), r, strict=True)) for r in trusted_results(listed(a), listed(b), names)] for a, b in zip(fields, spf, strict=True)], dtype=object)

    return read(headers, spf_headers if spf_headers is not None else F.expr("CAST(array() AS array<string>)"))


def evidence(headers: Column, spf_headers: Column, trusted: tuple[str, ...]) -> Column:
    """Results of both kinds of fields, and "unavailable" for methods without any result."""
    missing = F.array(*[F.struct(F.lit(m).alias("method"), F.lit("unavailable").alias("outcome"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("spf_identity")) for m in METHODS])
    return let(authentication_results(headers, trusted, spf_headers), lambda rs: F.concat(rs, F.filter(missing, lambda m: ~F.exists(rs, lambda r: r["method"] == m["method"]))))


def passes(results: Column, method: str, from_domain: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """Whether a method passed for a domain of the same organisation as that of From."""
    return F.exists(results, lambda r: (r["method"] == method) & (r["outcome"] == "pass") & aligned(r["domain"], from_domain, suffixes))


class VisibleText(HTMLParser):
    """Text outside omitted elements, links as [label](target); a small lexical reading without style sheets."""

    #: Elements whose text isn't shown.
    OMITTED = frozenset({"head", "style", "script", "title", "template", "iframe"})
    BLOCKS = frozenset({"p", "div", "ul", "ol", "li", "table", "tr", "section", "article", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "br", "hr", "nav", "main", "pre"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.omitted: list[str] = []
        self.targets: list[str | None] = []
        self.links: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.OMITTED:
            self.omitted.append(tag)
        elif not self.omitted:
            if tag in self.BLOCKS:
                self.out.append("\n")
            if tag == "a":
                href = dict(attrs).get("href")
                usable = href is not None and href.lower().startswith(("http://", "https://", "mailto:", "tel:"))
                self.targets.append(href if usable else None)
                self.out.append("[" if usable else "")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.omitted:
            while self.omitted.pop() != tag:
                pass
        elif not self.omitted:
            if tag == "a" and self.targets:
                target = self.targets.pop()
                if target is not None:
                    self.links.append(target)
                    self.out.append(f"]({target})")
            if tag in self.BLOCKS:
                self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.omitted:
            self.out.append(data)


def visible_html(html: str | None) -> tuple[str | None, list[str] | None, bool]:
    """Text, links and whether the document was cut short inside an omitted element."""
    if html is None:
        return None, None, False
    reader = VisibleText()
    reader.feed(html)
    reader.close()
    return "".join(reader.out), reader.links, bool(reader.omitted)


def html_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """`pages` with visible string, links array<string>, incomplete boolean of html_col; clean-up is left to Column functions."""
    names = [*pages.columns, "visible", "links", "incomplete"]
    schema = StructType([*pages.schema.fields, StructField("visible", StringType()), StructField("links", ArrayType(StringType())), StructField("incomplete", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [visible_html(h) for h in batch.column(html_col).to_pylist()]
            new = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.list_(pa.string()), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return small_batches(pages).mapInArrow(run, schema)


def decoded(raw: bytes, label: str | None) -> str:
    """Text in the charset of a label; Latin-1 and ASCII are read as Windows-1252, as browsers do, unknown labels as UTF-8."""
    name = (label or "utf-8").strip().lower()
    try:
        known = codecs.lookup("cp1252" if codecs.lookup(name).name in ("iso8859-1", "ascii") else name)
        return raw.decode(known.name, "replace") if known._is_text_encoding else raw.decode("utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


PART = "id long, part int, content_type string, filename string, size long, text string, content binary"


def message_parts(messages: DataFrame, max_parts: int = 256) -> DataFrame:
    """A row per leaf part of the messages id, content (RFC 5322 bytes): attachments keep their bytes, text parts their text.

    Parts are read by Python's own parser, which mends missing ends and paddings. Parts over max_parts
    are left out, as the limit is part of the feature.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PART.split(", ")]
        for frame in frames:
            rows, size = [], 0
            for id_, content in frame[["id", "content"]].itertuples(index=False):
                leaves = [p for p in email.message_from_bytes(content or b"", policy=email.policy.compat32).walk() if not p.is_multipart()]
                for n, part in enumerate(leaves[:max_parts]):
                    raw = part.get_payload(decode=True) or b""
                    words = part.get_content_maintype() == "text"
                    text = decoded(raw, part.get_content_charset()) if words else None
                    rows.append((id_, n, part.get_content_type(), part.get_filename(), len(raw), text, None if words else raw))
                    size += len(raw)
                if size > BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    return small_batches(messages.select("id", "content")).mapInPandas(run, PART)


def chosen_body(parts: DataFrame) -> DataFrame:
    """The body of each message: its last HTML part without a file name, else its last plain one."""
    rank = F.when(F.col("content_type") == "text/html", 2).when(F.col("content_type") == "text/plain", 1)
    body = parts.filter(F.col("filename").isNull()).withColumn("rank", rank).filter("rank IS NOT NULL")
    best = body.groupBy("id").agg(F.max(F.struct("rank", "part", "content_type", "text")).alias("b"))
    return best.select("id", "b.content_type", "b.text")
