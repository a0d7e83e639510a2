"""Durations, ages, scores, JSON usage figures, colours and file signatures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let, without_end

DAY = 86_400_000


def utc_text(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss 'UTC'")


def duration_text(ms: Column) -> Column:
    """Days, hours and minutes that aren't 0, at least minutes; "unavailable" for negative durations."""

    def part(n: Column, unit: str, always: Column | None = None) -> Column:
        shown = n > 0 if always is None else (n > 0) | always
        return F.when(shown, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s")))

    days, hours, minutes = F.floor(ms / DAY), F.floor((ms % DAY) / 3_600_000), F.floor((ms % 3_600_000) / 60_000)
    text = F.concat_ws(", ", part(days, "day"), part(hours, "hour"), part(minutes, "minute", (days == 0) & (hours == 0)))
    return F.when(ms < 0, "unavailable").otherwise(text)


def age_bucket(age_ms: Column) -> Column:
    """Age of a domain in whole years (365 days), months (30 days), weeks or days, whichever is the largest that isn't 0."""
    days = F.floor(age_ms / DAY)
    unit = lambda n, name: F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))
    return F.when(days >= 365, unit(F.floor(days / 365), "year")).when(days >= 30, unit(F.floor(days / 30), "month")).when(days >= 7, unit(F.floor(days / 7), "week")).when(days >= 1, unit(days, "day")).otherwise("less than 1 day")


def confidence(score: Column, low_below: float = 0.8) -> Column:
    return F.when(score < low_below, "low").otherwise("high")


def valid_decision(json: Column, classes: tuple[str, ...] = ("legitimate", "unwanted")) -> Column:
    """Whether a JSON decision has a known class, a score from 0.5 to 1, and at most ten reasons of at most 500 bytes."""
    d = F.from_json(json, "classification string, score double, reasons array<string>")
    reasons = F.coalesce(d["reasons"], F.expr("CAST(array() AS array<string>)"))
    ok = d["classification"].isin(*classes) & d["score"].between(0.5, 1) & (F.size(reasons) <= 10) & F.forall(reasons, lambda r: F.octet_length(r) <= 500)
    return F.coalesce(ok, F.lit(False))


def token_count(text: Column) -> Column:
    """A non-negative whole number, else 0."""
    return F.greatest(F.coalesce(text.try_cast("long"), F.lit(0)), F.lit(0)).cast("long")


def usage(envelope: Column) -> Column:
    """struct<input, output> tokens of a JSON reply."""
    field = lambda n: token_count(F.get_json_object(envelope, f"$.usage.{n}"))
    return F.struct(field("prompt_tokens").alias("input"), field("completion_tokens").alias("output"))


def saturating_sum(values: Column, top: int = 2**63 - 1) -> Column:
    return F.least(F.sum(values.cast("decimal(38,0)")), F.lit(top)).cast("long")


def hex_colour(text: Column) -> Column:
    """struct<r, g, b, a> from 0 to 1 of #rgb, #rgba, #rrggbb or #rrggbbaa; null for other text."""
    digits = F.substring(text, F.lit(2), F.length(text))
    wide = F.when(F.length(digits) <= 4, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    full = F.when(F.length(wide) == 6, F.concat(wide, F.lit("ff"))).otherwise(wide)
    ok = text.rlike(r"^#(?:[0-9A-Fa-f]{3,4}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$")
    return F.when(ok, F.struct(*[(F.conv(F.substring(full, 1 + 2 * i, 2), 16, 10).cast("double") / 255).alias(c) for i, c in enumerate("rgba")]))


def over(top: Column, below: Column) -> Column:
    """Source-over compositing of struct<r, g, b, a> colours on an opaque ground."""
    return F.struct(*[(top[c] * top["a"] + below[c] * (1 - top["a"])).alias(c) for c in "rgb"], F.lit(1.0).alias("a"))


def linear(channel: Column) -> Column:
    return F.when(channel <= 0.04045, channel / 12.92).otherwise(F.pow((channel + 0.055) / 1.055, F.lit(2.4)))


def oklab(colour: Column) -> Column:
    """struct<l, a, b> of an opaque sRGB colour; linear channels and cube roots are computed once."""
    # The published matrices of the Oklab colour space.
    mixes = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
    rows = {"l": (0.2104542553, 0.7936177850, -0.0040720468), "a": (1.9779984951, -2.4285922050, 0.4505937099), "b": (0.0259040371, 0.7827717662, -0.8086757660)}
    channels = let(colour, lambda c: F.struct(*[let(c[n], linear).alias(n) for n in "rgb"]))
    roots = let(channels, lambda c: F.struct(*[F.cbrt(m[0] * c["r"] + m[1] * c["g"] + m[2] * c["b"]).alias(f"x{i}") for i, m in enumerate(mixes)]))
    return let(roots, lambda x: F.struct(*[(m[0] * x["x0"] + m[1] * x["x1"] + m[2] * x["x2"]).alias(n) for n, m in rows.items()]))


def lab_distance(one: Column, two: Column) -> Column:
    both = F.struct(one.alias("x"), two.alias("y"))
    return let(both, lambda p: F.sqrt(sum(((p["x"][c] - p["y"][c]) * (p["x"][c] - p["y"][c]) for c in "ab"), (p["x"]["l"] - p["y"]["l"]) * (p["x"]["l"] - p["y"]["l"]))))


def colour_concealed(distance: Column, limit: float = 0.005) -> Column:
    return distance <= limit


def executable_format(content: Column) -> Column:
    """Kind of program by its first bytes; null for none."""
    head = F.hex(F.substring(content, 1, 4))
    macho = ("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE", "BEBAFECA", "CAFEBABF", "BFBAFECA")
    return F.when(F.startswith(head, F.lit("4D5A")), "pe").when(head == "7F454C46", "elf").when(head.isin(*macho), "mach-o")


def archive_format(content: Column, name: Column, media_type: Column | None = None) -> Column:
    """zip, gzip, bzip2 or tar by signature, else by the extension of the name or the media type; null for none."""
    head = F.hex(F.substring(content, 1, 4))
    low = F.lower(name)
    by_head = F.when(head.isin("504B0304", "504B0506", "504B0708"), "zip").when(F.startswith(head, F.lit("1F8B")), "gzip").when(F.startswith(head, F.lit("425A68")), "bzip2").when(F.hex(F.substring(content, 258, 5)) == "7573746172", "tar")
    kind = F.lower(F.coalesce(media_type, F.lit(""))) if media_type is not None else F.lit("")
    ends = lambda *marks: low.rlike(rf"\.(?:{'|'.join(marks)})$")
    by_name = F.when(ends("zip") | (kind == "application/zip"), "zip").when(ends("tar") | (kind == "application/x-tar"), "tar").when(ends("gz", "gzip") | kind.isin("application/gzip", "application/x-gzip"), "gzip").when(ends("bz2", "bzip2") | (kind == "application/x-bzip2"), "bzip2")
    return F.coalesce(by_head, by_name)


#: Extensions that turn a signature on, where it stands (from the end where negative), its bytes, and what it is called.
SIGNATURES = (
    (("lnk",), 1, "4C0000000114020000000000C000000000000046", "Windows shell link signature"),
    (("cab", "onepkg"), 1, b"MSCF".hex().upper(), "Microsoft cabinet signature"),
    (("chm",), 1, b"ITSF".hex().upper(), "compiled HTML Help signature"),
    (("iso", "img"), 32770, b"CD001".hex().upper(), "ISO disk image signature"),
    (("vhdx",), 1, b"vhdxfile".hex().upper(), "VHDX disk image signature"),
    (("vhd",), 1, b"conectix".hex().upper(), "VHD disk image signature"),
    (("vhd",), -512, b"conectix".hex().upper(), "VHD disk image signature"),
    (("dmg",), -512, b"koly".hex().upper(), "Apple disk image signature"),
    (("one", "onepkg"), 1, "E4525C7B8CD8A74DAEB15378D02996D3", "Microsoft OneNote signature"),
    (("apk",), 1, b"dex\n".hex().upper() + "......00", "Android DEX executable signature"),
    (("z",), 1, "1F9D(?:[08][9A-F]|[19]0)", "Unix compress archive signature"),
    (("rar",), 1, "526172211A0700|526172211A070100", "RAR archive signature"),
    (("7z",), 1, "377ABCAF271C", "7z archive signature"),
)


def configured_signature(content: Column, blocked: tuple[str, ...]) -> Column:
    """What the bytes of a file are by the signatures of the blocked extensions, whatever its name; null for none.

    Only the bytes at a signature's place are read. A null or short content has no signature.
    """
    found = F.lit(None).cast("string")
    for extensions, start, pattern, told in reversed(SIGNATURES):
        if set(extensions) & set(blocked):
            there = F.hex(F.substring(content, start, 20))
            hit = F.regexp_like(there, F.lit(f"^(?:{pattern})"))
            found = F.when(hit & (F.octet_length(content) >= abs(start)), told).otherwise(found)
    return found


def script_interpreter(content: Column) -> Column:
    """Name of the program behind #!, behind env where that is used; null without a first line of that form."""
    line = F.regexp_extract(F.decode(F.substring(content, 1, 256), "ISO-8859-1"), r"^#!\s*(\S+(?:[ \t]+\S+)?)", 1)
    words = F.split(line, r"[ \t]+")
    base = F.substring_index(F.get(words, F.lit(0)), "/", -1)
    return F.when(line != "", F.when((base == "env") & (F.size(words) > 1), F.substring_index(F.get(words, F.lit(1)), "/", -1)).otherwise(base))


def blocked_extension(name: Column, blocked: tuple[str, ...]) -> Column:
    """The last extension of a file name that is in the list; earlier ones count too, as in report.exe.txt; null for none."""
    parts = F.split(F.lower(without_end(name, r"\s.")), r"\.")
    found = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda e: F.trim(e).isin(*blocked))
    return F.trim(F.element_at(F.when(F.size(found) > 0, found), -1))
