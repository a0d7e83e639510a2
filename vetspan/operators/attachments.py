"""Scan of attachments: blocked names and programs inside files, messages and nested archives, a small helper per row."""

from __future__ import annotations

import base64
import bz2
import gzip
import io
import quopri
import re
import struct
import tarfile
import unicodedata
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from email.message import Message

import pandas as pd
from pyspark.sql import DataFrame

from .headers import decoded_words

PROGRAMS = (b"MZ", b"\x7fELF", b"\xfe\xed\xfa\xce", b"\xfe\xed\xfa\xcf", b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe", b"#!")
MIME_DEPTH, DIRECTORY_BYTES = 16, 1 << 20
#: What strict decoding takes: whole groups with padding at the end; escapes of two digits or line ends.
BASE64 = re.compile(rb"(?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?+")
QUOTED = re.compile(rb"(?:[^=]++|=[0-9A-Fa-f]{2}|=[ \t]*+(?:\r?\n|\Z))*+")
MEDIA_TYPE = re.compile(r"""\s*[^\s/;,"()<>@=]+(?:/[^\s/;,"()<>@=]+)?\s*(?:;\s*[^\s/;,"()<>@=]+\s*=\s*(?:"(?:[^"\\]|\\.)*+"|[^\s;,"()<>@=]+)\s*)*+;?\s*""", re.S)


@dataclass(frozen=True)
class ScanLimits:
    """`bytes` bounds a part's decoded content and what its archives hold in all, `files` the entries of archives."""

    blocked: tuple[str, ...] = ("exe", "js", "scr", "bat", "cmd", "vbs")
    depth: int = 4
    files: int = 1000
    bytes: int = 32 << 20


@dataclass
class Used:
    files: int = 0
    bytes: int = 0
    directory: int = 0


class ScanError(Exception):
    """encrypted; malformed for a broken message; limit; unscannable for other content that can't be read."""


def normalised_name(name: str | None) -> str:
    """A file name as it will be shown: encoded words decoded, compatible characters alike (NFKC), without format characters, variation selectors and folders."""
    flat = unicodedata.normalize("NFKC", decoded_words(name or ""))
    kept = "".join(c for c in flat if unicodedata.category(c) not in ("Cf", "Cc") and not 0xFE00 <= ord(c) <= 0xFE0F and not 0xE0100 <= ord(c) <= 0xE01EF)
    return re.split(r"[/\\]", kept)[-1].strip() or "unnamed"


def _blocked(name: str | None, limits: ScanLimits) -> str | None:
    extensions = [e.strip() for e in normalised_name(name).lower().rstrip(". ").split(".")[1:]]
    return next((f"blocked extension .{e}" for e in reversed(extensions) if e in limits.blocked), None)


def _room(limits: ScanLimits, used: Used, declared: int = 0) -> int:
    left = limits.bytes - used.bytes
    if left <= 0 or declared > left:
        raise ScanError("limit")
    return left


def _next_file(limits: ScanLimits, used: Used) -> None:
    used.files += 1
    if used.files > limits.files:
        raise ScanError("limit")


def _directory(data: bytes, limits: ScanLimits, used: Used) -> bool:
    """Whether data ends in a ZIP directory; its entries are counted before anything is allocated for them.

    The entries that are there count, not the number that the directory tells. Entries of nested archives
    share the limit with those of the outer one that are still to come.
    """
    end = data.rfind(b"PK\x05\x06", max(len(data) - 22 - 0xFFFF, 0))
    if end < 0 or end + 22 > len(data):
        return False
    told, size, offset = struct.unpack_from("<HII", data, end + 10)
    stop = end
    if 0xFFFF in (told, size) or offset == 0xFFFFFFFF:
        if end >= 20 and data[end - 20 : end - 16] == b"PK\x06\x07":
            (at,) = struct.unpack_from("<Q", data, end - 12)
            if at + 56 > len(data) or data[at : at + 4] != b"PK\x06\x06":
                return False
            told, size, offset = struct.unpack_from("<QQQ", data, at + 32)
            stop = at
    if told > limits.files - used.files:
        raise ScanError("limit")
    if size > stop or offset > len(data):
        return False
    counts = []
    for at in {stop - size, offset}:
        first, n = at, 0
        while data[at : at + 4] == b"PK\x01\x02" and at + 46 <= len(data):
            n += 1
            at += 46 + sum(struct.unpack_from("<HHH", data, at + 28))
            if n > limits.files - used.files or at - first > DIRECTORY_BYTES - used.directory:
                raise ScanError("limit")
        counts.append((n, at - first))
    if told > max(n for n, _ in counts):
        return False
    used.files += max(n for n, _ in counts)
    used.directory += max(b for _, b in counts)
    return True


def _whole_zip(path: str, data: bytes, limits: ScanLimits, depth: int, used: Used) -> str | None:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for entry in archive.infolist():
            if entry.is_dir():
                continue
            inner = f"{path}/{normalised_name(entry.filename)}"
            if entry.flag_bits & 1:
                raise ScanError("encrypted")
            if why := _blocked(entry.filename, limits):
                return f"{inner}: {why}"
            left = _room(limits, used, entry.file_size)
            with archive.open(entry) as f:
                content = f.read(left + 1)
            if found := _entry(inner, entry.filename, content, limits, depth, used):
                return found
    return None


def _partial_zip(path: str, data: bytes, limits: ScanLimits, depth: int, used: Used) -> str | None:
    """What the local headers of an archive without a readable directory still show; otherwise it can't be scanned."""
    at = 0
    while data[at : at + 4] == b"PK\x03\x04" and at + 30 <= len(data):
        flags, method, size, full, name_bytes, extra = *struct.unpack_from("<HH", data, at + 6), *struct.unpack_from("<IIHH", data, at + 18)
        start = at + 30 + name_bytes + extra
        if start > len(data):
            break
        name = data[at + 30 : at + 30 + name_bytes].decode("utf-8", "replace")
        inner = f"{path}/{normalised_name(name)}"
        if flags & 1:
            raise ScanError("encrypted")
        if why := _blocked(name, limits):
            return f"{inner}: {why}"
        _next_file(limits, used)
        left = _room(limits, used, full)
        whole = 0 < size <= len(data) - start
        packed = data[start : start + size] if whole else data[start:]
        if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            break
        content, broken = packed[: left + 1], False
        if method == zipfile.ZIP_DEFLATED:
            reader = zlib.decompressobj(-15)
            try:
                content = reader.decompress(packed, left + 1)
                broken = not reader.eof
            except zlib.error:
                content, broken = b"", True
        try:
            if found := _entry(inner, name, content, limits, depth, used):
                return found
        except ScanError:
            break
        if broken or not whole or flags & 8:
            break
        at = start + size
    raise ScanError("unscannable")


def _entry(path: str, name: str | None, content: bytes, limits: ScanLimits, depth: int, used: Used) -> str | None:
    """An entry of an archive: programs are found even in content that goes over the limit."""
    left = limits.bytes - used.bytes
    used.bytes += min(len(content), left)
    if content.startswith(PROGRAMS):
        return f"{path}: program"
    if len(content) > left:
        raise ScanError("limit")
    return _file(path, name, content, limits, depth, used)


#: Archives: first bytes, ends of names, media types.
ARCHIVES = {
    "zip": ((b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"), (".zip",), ("application/zip",)),
    "gzip": ((b"\x1f\x8b",), (".gz", ".gzip"), ("application/gzip", "application/x-gzip")),
    "bzip2": ((b"BZh",), (".bz2", ".bzip2"), ("application/x-bzip2",)),
    "tar": ((), (".tar",), ("application/x-tar",)),
}


def _archive(name: str | None, data: bytes, media_type: str = "") -> str | None:
    """Kind of archive by its first bytes, else by its name or media type."""
    for kind, (magic, _, _) in ARCHIVES.items():
        if data.startswith(magic) or (kind == "tar" and data[257:262] == b"ustar"):
            return kind
    low = normalised_name(name).lower()
    return next((kind for kind, (_, ends, types) in ARCHIVES.items() if low.endswith(ends) or media_type in types), None)


def _unpacked_name(kind: str, name: str | None, data: bytes) -> str:
    """The name that a gzip file stores, else its own without the ending of its kind."""
    if kind == "gzip" and data[3:4] and data[3] & 8:
        at = 10 + (2 + int.from_bytes(data[10:12], "little") if data[3] & 4 else 0)
        if stored := data[at : data.find(b"\0", at)].decode("latin-1").strip():
            return normalised_name(stored)
    shown = normalised_name(name)
    return next((shown[: -len(e)].strip() or "unnamed" for e in ARCHIVES[kind][1] if shown.lower().endswith(e)), "unnamed")


def _file(path: str, name: str | None, data: bytes, limits: ScanLimits, depth: int, used: Used, media_type: str = "") -> str | None:
    if why := _blocked(name, limits):
        return f"{path}: {why}"
    if data.startswith(PROGRAMS):
        return f"{path}: program"
    kind = _archive(name, data, media_type)
    if kind is None:
        return None
    if depth >= limits.depth:
        raise ScanError("limit")
    try:
        if kind == "zip":
            if _directory(data, limits, used):
                return _whole_zip(path, data, limits, depth + 1, used)
            return _partial_zip(path, data, limits, depth + 1, used)
        if kind == "tar":
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as archive:
                for entry in archive:
                    if entry.isfile():
                        _next_file(limits, used)
                        inner, left = f"{path}/{normalised_name(entry.name)}", _room(limits, used, entry.size)
                        if why := _blocked(entry.name, limits):
                            return f"{inner}: {why}"
                        if found := _entry(inner, entry.name, archive.extractfile(entry).read(left + 1), limits, depth + 1, used):
                            return found
            return None
        _next_file(limits, used)
        opened = gzip.open if kind == "gzip" else bz2.open
        with opened(io.BytesIO(data)) as f:
            content = f.read(_room(limits, used) + 1)
        inner = _unpacked_name(kind, name, data)
        return _entry(f"{path}/{inner}", inner, content, limits, depth + 1, used)
    except ScanError:
        raise
    except Exception as error:  # archives can be broken in any way; the kind of error is the result
        raise ScanError("unscannable") from error


def scan(name: str | None, data: bytes, limits: ScanLimits) -> str | None:
    """What was found first in a file, as "path: reason"; ScanError where it can't be read."""
    return _file(normalised_name(name), name, data, limits, 0, Used())


def strictly_decoded(encoding: str | None, data: bytes, limit: int) -> tuple[bytes, str | None]:
    """The content of a transfer encoding as far as it is well formed, and limit or unscannable where that isn't all."""
    kind, error = (encoding or "").strip().lower(), None
    if kind == "base64":
        flat = data.replace(b"\r", b"").replace(b"\n", b"")
        good = BASE64.match(flat)[0]
        error = "unscannable" if len(good) < len(flat) else None
        data = base64.b64decode(good)
    elif kind == "quoted-printable":
        good = QUOTED.match(data)[0]
        error = "unscannable" if len(good) < len(data) else None
        data = quopri.decodestring(good)
    elif kind not in ("", "7bit", "8bit", "binary"):
        return b"", "unscannable"
    return (data[:limit], "limit") if len(data) > limit else (data, error)


def _fields(block: bytes) -> dict[str, str]:
    """First values of a header block's fields by lower-case name, unfolded; a line that is no field is an error."""
    out: dict[str, str] = {}
    for line in re.split(r"\r?\n(?![ \t])", block.decode("latin-1")):
        name, colon, value = line.partition(":")
        if line and (not colon or not name or name[0] in " \t"):
            raise ScanError("malformed")
        out.setdefault(name.strip().lower(), re.sub(r"\r?\n[ \t]+", " ", value).strip())
    return out


def _message(data: bytes) -> tuple[dict[str, str], bytes]:
    if data.startswith((b"\n", b"\r\n")):
        return {}, data.split(b"\n", 1)[1]
    block, body = (re.split(rb"\r?\n\r?\n", data, maxsplit=1) + [b""])[:2]
    return _fields(block), body


def _named(disposition: str, content_type: str) -> Message:
    fields = Message()
    fields["Content-Type"] = content_type
    fields["Content-Disposition"] = disposition
    return fields


def _part(path: str, fields: dict[str, str], data: bytes, limits: ScanLimits, depth: int, used: Used) -> str | None:
    """A MIME entity at a depth of nesting; findings in later parts count before errors of earlier ones."""
    if depth >= MIME_DEPTH:
        raise ScanError("limit")
    content_type, disposition = fields.get("content-type", ""), fields.get("content-disposition", "")
    if content_type and not MEDIA_TYPE.fullmatch(content_type):
        raise ScanError("malformed")
    kind, named = content_type.partition(";")[0].strip().lower() or "text/plain", _named(disposition, content_type)
    if kind.startswith("multipart/"):
        boundary = str(named.get_param("boundary") or "")
        if not boundary:
            raise ScanError("malformed")
        marks = list(re.finditer(rb"(?:\A|\r?\n)--" + re.escape(boundary.encode("latin-1", "replace")) + rb"(--)?[ \t]*+(?=\r?\n|\Z)", data))
        closed = next((i for i, m in enumerate(marks) if m[1]), len(marks))
        ends = [m.start() for m in marks[1:]] + [len(data)]
        error = None
        for n, (mark, end) in enumerate(zip(marks[:closed], ends, strict=False), 1):
            try:
                inner, body = _message(re.sub(rb"\A\r?\n", b"", data[mark.end() : max(end, mark.end())]))
                if kind == "multipart/digest" and not inner.get("content-type"):
                    inner["content-type"] = "message/rfc822"
                if found := _part(f"{path}/part-{n}", inner, body, limits, depth + 1, used):
                    return found
            except ScanError as e:
                error = error or e
        if error is None and closed == len(marks):
            error = ScanError("unscannable" if marks else "malformed")
        if error is not None:
            raise error
        return None
    given = named.get_filename()
    name = normalised_name(str(given)) if given else None
    if name:
        path = f"{path.rpartition('/')[0]}/{name}".lstrip("/")
        if why := _blocked(name, limits):
            return f"{path}: {why}"
    content, broken = strictly_decoded(fields.get("content-transfer-encoding"), data, limits.bytes)
    nested = kind == "message/rfc822" or (name or "").lower().endswith(".eml")
    if broken:
        if content.startswith(PROGRAMS):
            return f"{path}: program"
        if nested:
            if found := _attached(path, content, limits, depth, used):
                return found
        elif _archive(name, content, kind):
            try:
                if found := _file(path, name, content, limits, 0, used, kind):
                    return found
            except ScanError:
                pass
        raise ScanError(broken)
    if nested:
        return _attached(path, content, limits, depth, used)
    inline = not name and kind in ("text/plain", "text/html") and disposition.partition(";")[0].strip().lower() != "attachment"
    binary = content.startswith(PROGRAMS[:-1]) or _archive(None, content) is not None
    if inline and not (depth and (not content_type or binary)):
        return None
    return _file(path, name, content, limits, 0, used, kind)


def _attached(path: str, data: bytes, limits: ScanLimits, depth: int, used: Used) -> str | None:
    fields, body = _message(data)
    if not fields:
        raise ScanError("malformed")
    return _part(path, fields, body, limits, depth + 1, used)


def scan_message(data: bytes, limits: ScanLimits) -> str | None:
    """What was found first in the parts of a message, in attached messages and in archives; ScanError where they can't be read."""
    fields, body = _message(data)
    return _part("message", fields, body, limits, 0, Used())


def _scanned(rows: DataFrame, columns: list[str], schema: str, of) -> DataFrame:  # noqa: ANN001
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame[columns].itertuples(index=False):
                keys = tuple(row)[: len(names) - 2]
                try:
                    out.append((*keys, of(*tuple(row)[len(keys) :]), None))
                except ScanError as error:
                    out.append((*keys, None, str(error)))
            yield pd.DataFrame(out, columns=names)

    return rows.select(*columns).mapInPandas(run, schema)


def scan_attachments(parts: DataFrame, limits: ScanLimits = ScanLimits()) -> DataFrame:  # noqa: B008
    """id, part, detection, error_kind of the rows id, part, filename, content; the first finding of a file counts. Null content is empty."""
    return _scanned(parts, ["id", "part", "filename", "content"], "id long, part int, detection string, error_kind string", lambda name, content: scan(name, content or b"", limits))


def scan_messages(messages: DataFrame, limits: ScanLimits = ScanLimits()) -> DataFrame:  # noqa: B008
    """id, detection, error_kind of the rows id, content (whole messages); the first finding counts before any error. Null content is empty."""
    return _scanned(messages, ["id", "content"], "id long, detection string, error_kind string", lambda content: scan_message(content or b"", limits))
