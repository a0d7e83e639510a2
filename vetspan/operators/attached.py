"""What is told of attachments: sections of text with bounds, metadata, attached headers, charsets of HTML and sizes of images."""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let
from ..functions.text import TRUNCATION_NOTICE, byte_truncated, one_line
from .evidence import decoded
from .headers import decoded_value, decoded_words

FIELD_BYTES, METADATA_BYTES, HEADER_BYTES = 1024, 8192, 1 << 20
FIELDS = ("start", "body_start", "close_start", "end", "tag")
SPANS = "array<struct<start:int,body_start:int,close_start:int,end:int,tag:string>>"
#: Header fields of an attached message that are told, and how cut or left out ones are marked.
TOLD = ("From", "To", "Cc", "Date", "Subject")
CUT, OMITTED = " [metadata truncated]", "[additional attachment metadata omitted]\n"


def metadata_value(value: Column) -> Column:
    """A file name or field with encoded words decoded, controls as spaces, angle brackets escaped, and CUT behind what was over FIELD_BYTES.

    The cuts are at whole characters.
    """
    first = byte_truncated(value, FIELD_BYTES)
    clean = F.replace(F.replace(F.regexp_replace(decoded_value(first), r"\p{Cc}", " "), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    over = (F.octet_length(value) > FIELD_BYTES) | (F.octet_length(clean) > FIELD_BYTES)
    return F.concat(byte_truncated(clean, FIELD_BYTES), F.when(over, CUT).otherwise(""))


def is_file(media_type: Column, disposition: Column, disposition_name: Column, type_name: Column, parent: Column) -> Column:
    """Whether a text part is an attached file: said so, or named without disposition outside of alternatives and related parts. Nulls are absent values."""
    empty = lambda x: F.coalesce(x, F.lit(""))
    said = F.lower(empty(disposition))
    named = (empty(disposition_name) != "") | (empty(type_name) != "")
    loose = (said == "") & named & ~empty(parent).isin("multipart/alternative", "multipart/related")
    return empty(media_type).isin("text/plain", "text/html") & ((said == "attachment") | loose)


def marker(media_type: Column, name: Column) -> Column:
    """The line that stands for an attachment whose content isn't shown."""
    return F.concat(F.lit("[attachment: "), one_line(name), F.lit("; type="), media_type, F.lit("]"))


def wrapped(text: Column, spans: Column, tag: str, filename: Column, media_type: Column, headers: Column) -> Column:
    """struct<text, spans>: an attachment's text between tags behind what is known of it, its own span first, inner ones moved.

    Places count characters. Null or empty file names, types and headers aren't told; spans are of type SPANS.
    """
    told = lambda x, line: F.when(F.coalesce(x, F.lit("")) != "", line).otherwise("")
    prefix = F.concat(
        F.lit(f"<{tag}>\n"),
        told(filename, F.concat(F.lit("Filename: "), metadata_value(filename), F.lit("\n"))),
        told(media_type, F.concat(F.lit("Content-Type: "), media_type, F.lit("\n"))),
        told(headers, F.concat(F.lit("Original headers (unverified claims):\n"), headers)),
        F.lit("\n"),
    )
    suffix = f"\n</{tag}>"

    def of(p: Column) -> Column:
        n, m = F.length(p), F.length(text)
        own = F.struct(F.lit(0).alias("start"), n.alias("body_start"), (n + m).alias("close_start"), (n + m + len(suffix)).alias("end"), F.lit(tag).alias("tag"))
        moved = F.transform(spans, lambda s: F.struct(*[(s[c] + n).alias(c) for c in ("start", "body_start", "close_start", "end")], s["tag"].alias("tag")))
        return F.struct(F.concat(p, text, F.lit(suffix)).alias("text"), F.concat(F.array(own), moved).alias("spans"))

    return let(prefix, of)


def cut_sections(body: str, limit: int, spans: list[tuple[int, int, int, int, str]]) -> str:
    """The start of a body over `limit` characters with the notice: sections that are cut are closed, their beginnings stay whole, all in `limit` characters. Without sections the notice stands behind `limit` characters."""
    if limit < 1:
        return ""
    if not spans:
        return body[:limit] + TRUNCATION_NOTICE
    room = limit
    while room > 0:
        at = min(room, len(body))
        for start, body_start, close_start, end, _ in spans:
            if start < at < body_start:
                at = start
            if close_start <= at < end:
                at = close_start
        closing = "".join(f"\n</{tag}>" for _, body_start, close_start, _, tag in reversed(spans) if body_start <= at <= close_start)
        over = at + len(TRUNCATION_NOTICE) + len(closing) - limit
        if over <= 0:
            return body[:at] + TRUNCATION_NOTICE + closing
        room = min(room - 1, at - over)
    return TRUNCATION_NOTICE


def cut_bodies(rows: DataFrame, body: str, spans: str, limit: int) -> DataFrame:
    """`rows` without the column `spans`, bodies over `limit` characters cut without splitting the sections of their spans.

    Null and shorter bodies stay; null spans are none. Other columns pass through unchanged.
    """
    names = [c for c in rows.columns if c != spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(batch.column(body).to_pylist(), batch.column(spans).to_pylist(), strict=True)
            cut = [b if b is None or len(b) <= limit else cut_sections(b, limit, [tuple(s[n] for n in FIELDS) for s in ss or []]) for b, ss in found]
            arrays = [pa.array(cut, batch.schema.field(body).type) if n == body else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(run, rows.select(names).schema)


def last_index(value: Column, found: Column) -> Column:
    """Place in bytes, from 0, of the last occurrence without regard to ASCII case; -1 for none, the value's length for an empty marker."""
    fold = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    at = F.instr(F.reverse(fold(value)), F.reverse(fold(found)))
    before = F.octet_length(F.left(value, F.length(value) - at + 1 - F.length(found)))
    return F.when(found == "", F.octet_length(value)).when(at > 0, before).otherwise(F.when(at == 0, -1)).cast("int")


META = re.compile(rb"<meta(?=[\s/])([^>]*)>", re.I)
CHARSET = re.compile(rb"""(?i)charset\s*=\s*["']?\s*([A-Za-z0-9_:.\-]+)""")
BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_BE, "utf-16-be"), (codecs.BOM_UTF16_LE, "utf-16-le"))


def sniffed_html(raw: bytes, label: str | None) -> str:
    """HTML in the charset of a known label, else of its byte order mark, else of a meta element in its first 1,024 bytes, else UTF-8 where it is valid, else Windows-1252."""
    try:
        known = (label or "").strip()
        codecs.lookup(known)
        return decoded(raw, known).removeprefix("﻿")
    except LookupError:
        pass
    for mark, name in BOMS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace")
    for m in META.finditer(raw[:1024]):
        if (c := CHARSET.search(m[1])) is not None:
            name = c[1].decode("ascii").lower()
            name = "utf-8" if name.startswith("utf-16") else name
            try:
                codecs.lookup(name)
                return decoded(raw, name)
            except LookupError:
                continue
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


def html_text_of(content: Column, label: Column) -> Column:
    """sniffed_html of the bytes of a column; null for null."""

    @F.pandas_udf("string")
    def read(contents: pd.Series, labels: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else sniffed_html(bytes(c), n) for c, n in zip(contents, labels, strict=True)], dtype=object)

    return read(content, label)


ATTACHED = "struct<content_type:string,transfer_encoding:string,content_id:string,disposition:string,metadata:string,body_at:int>"
KEPT = {"content-type": "content_type", "content-transfer-encoding": "transfer_encoding", "content-id": "content_id", "content-disposition": "disposition"}


def _told(value: str) -> str:
    short = value.encode()[:FIELD_BYTES].decode("utf-8", "ignore")
    clean = re.sub(r"[\x00-\x1f\x7f-\x9f]", " ", decoded_words(short)).replace("<", "&lt;").replace(">", "&gt;")
    cut = clean.encode()[:FIELD_BYTES].decode("utf-8", "ignore")
    return cut + (CUT if (short, clean) != (value, cut) else "")


def attached_headers(raw: bytes) -> tuple | None:
    """Fields of ATTACHED of an attached message; null where its header is over HEADER_BYTES, empty or has a line that is no field.

    Of MIME fields the first counts. The fields of TOLD are listed while the list stays below METADATA_BYTES.
    """
    blank = re.compile(rb"(?:\A|\n)\r?(?:\n|\Z)").search(raw, 0, HEADER_BYTES + 2)
    block, body_at = (raw[: blank.start()], blank.end()) if blank else (raw, len(raw))
    if len(block) >= HEADER_BYTES:
        return None
    if not block.strip(b"\r\n"):
        return (None, None, None, None, "", body_at) if blank and blank.end() > blank.start() and raw else None
    kept, lines, full = {}, [], False
    for n, line in enumerate(re.split(r"\r?\n(?![ \t])", block.decode("utf-8", "replace"))):
        name, colon, value = line.partition(":")
        if not colon or (n == 0 and line[0] in " \t") or "\n" in name:
            return None
        value = " ".join(x.strip() for x in re.split(r"\r?\n", value) if x.strip())
        low = name.strip().lower()
        if low in KEPT:
            kept.setdefault(KEPT[low], value)
        elif told := next((t for t in TOLD if t.lower() == low), None):
            full = full or sum(len(x.encode()) for x in lines) + 2 * FIELD_BYTES > METADATA_BYTES
            if not full:
                lines.append(f"{told}: {_told(value)}\n")
    return (*(kept.get(k) for k in KEPT.values()), "".join(lines) + (OMITTED if full else ""), body_at)


def attached_message(content: Column) -> Column:
    """ATTACHED of the bytes of attached messages; null for null and for what is no message."""
    names = [f.split(":")[0] for f in ATTACHED[7:-1].split(",")]

    @F.pandas_udf(ATTACHED)
    def read(contents: pd.Series) -> pd.DataFrame:
        found = [attached_headers(bytes(c)) if c is not None else None for c in contents]
        return pd.DataFrame([f if f is not None else (None,) * len(names) for f in found], columns=names).astype({"body_at": "Int32"})

    return let(read(content), lambda s: F.when(s["body_at"].isNotNull(), s))


def image_size(raw: bytes) -> tuple[str, int, int] | None:
    """Kind, width and height from the header of a PNG, GIF or JPEG image; null for other content."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and raw[12:16] == b"IHDR" and len(raw) >= 33:
        return ("image/png", *struct.unpack_from(">II", raw, 16))
    if raw[:6] in (b"GIF87a", b"GIF89a") and len(raw) >= 13:
        return ("image/gif", *struct.unpack_from("<HH", raw, 6))
    at = 2 if raw[:2] == b"\xff\xd8" else len(raw)
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        kind = raw[at + 1]
        if kind == 0xFF or 0xD0 <= kind <= 0xD7:
            at += 1 if kind == 0xFF else 2
            continue
        if 0xC0 <= kind <= 0xC2 and at + 9 <= len(raw):
            height, width = struct.unpack_from(">HH", raw, at + 5)
            return "image/jpeg", width, height
        if kind in (0xD9, 0xDA):
            break
        at += 2 + struct.unpack_from(">H", raw, at + 2)[0]
    return None


def usable_image(content: Column, max_bytes: int, max_pixels: int) -> Column:
    """Media type of an image that is small enough by its header, read without decoding it; null for others."""

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        found = [image_size(bytes(c)) if c is not None else None for c in contents]
        return pd.Series([f[0] if f and f[1] > 0 and f[2] > 0 and f[1] * f[2] <= max_pixels else None for f in found], dtype=object)

    return F.when(F.octet_length(content) <= max_bytes, read(content))


def serialised(headers: Column, body: Column, limit: int, truncated: Column, mark: str = "X-Archive-Truncated: yes\r\n") -> Column:
    """Bytes of a message for the archive, at most `limit`: whole header fields, a mark if it was cut before, an empty line, the body.

    headers and body are binary, fields end with CRLF; nulls are empty. A field that doesn't fit goes with
    its folded lines and with all that follow it. The mark needs room for itself and the empty line.
    """
    if limit < 2:
        return F.expr("CAST('' AS binary)")

    def fitted(room: int) -> Column:
        if room <= 0:
            return F.lit("")
        latin = F.decode(F.coalesce(headers, F.expr("CAST('' AS binary)")), "ISO-8859-1")
        pieces = F.split(latin, r"(?<=\r\n)(?![ \t])")

        def add(s: Column, x: Column) -> Column:
            fits = s["open"] & (F.length(s["text"]) + F.length(x) <= room) & F.endswith(x, F.lit("\r\n"))
            return F.struct(F.when(fits, F.concat(s["text"], x)).otherwise(s["text"]).alias("text"), fits.alias("open"))

        start = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))
        return F.when(F.length(latin) <= room, latin).otherwise(F.aggregate(pieces, start, add, lambda s: s["text"]))

    marked = F.coalesce(truncated, F.lit(False)) & F.lit(limit >= len(mark) + 2)
    block = F.when(marked, F.concat(fitted(limit - 2 - len(mark)), F.lit(mark))).otherwise(fitted(limit - 2))
    whole = F.concat(F.encode(F.concat(block, F.lit("\r\n")), "ISO-8859-1"), F.coalesce(body, F.expr("CAST('' AS binary)")))
    return F.substring(whole, F.lit(1), F.lit(limit))
