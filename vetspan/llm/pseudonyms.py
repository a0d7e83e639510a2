"""Format-preserving pseudonyms by keyed Feistel networks, with DataFrame functions only.

A value is taken to its canonical form (digits without separators, lower-case mail address), its free
part is permuted by a keyed Feistel network within the format's own domain, check digits are computed
anew, and the separators return to their places. Equal values get equal pseudonyms in every document,
different values of a kind different ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Values of a text whose places are counted together.
PLACED_AT_ONCE = 128
#: Dates are permuted within the DATE_A * DATE_B days from DATE_FIRST, to 2105-05-05.
DATE_FIRST, DATE_A, DATE_B = "1900-01-01", 300, 250

#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """The length of the country comes first, so that a number behind an IBAN isn't taken for its end; other countries have any length."""
    known = []
    for n, countries in IBAN_LENGTHS.items():
        fours, rest = divmod(n - 4, 4)
        known.append(rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    return rf"(?<!\w)(?:{'|'.join(known)}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?!\w)"


#: Fixed value: country codes of phone numbers; those of one or two digits come first, all others have three.
PHONE_CODE = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

#: The patterns of each kind, in order of preference where several start at one place.
PATTERNS = {
    "email": r"(?<![\w.%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62})\.){1,8}[A-Za-z]{2,24}(?![\w\-])",
    "iban": _iban_pattern(),
    "card": r"(?<![\w.\-])(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5})(?![\w\-])",
    "ssn": r"(?<![\w\-.])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,3}(?!\w)|(?<![\w+\-.])\(?\d{3}\)?[ .\-]\d{3}[.\-]\d{4}(?![\w\-])",
    "date": r"(?<![\w.\-/])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w\-/])",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\w)",
    "secret": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<=password=)[A-Za-z0-9]{6,64}(?![A-Za-z0-9])|(?<=token = \")(?=[a-z]*\d)[A-Za-z0-9]{16,64}(?=\")",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every match of PATTERNS holds one of these.
HINT = r"[0-9@]|AKIA|password="


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once; inside lambdas Spark computes a repeated expression again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digest(key: str, kind: str, i: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel_number(value: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. a*b-1 (a * b under 2**50): the halves are value div b and value mod b."""
    start = F.struct(F.floor(value / F.lit(b)).cast("long").alias("l"), F.pmod(value, F.lit(b)).cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + _number(_digest(key, kind, i, s["r"].cast("string"))), F.lit(a)).cast("long")
        right = F.pmod(s["r"] + _number(_digest(key, kind, i, s["l"].cast("string"))), F.lit(b)).cast("long")
        even = i % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * F.lit(b) + s["r"])


def feistel_text(value: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings of one shape: letters stay letters of their case, ASCII digits digits, the rest stays."""
    n = F.length(value)
    cut = F.floor(n / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("l"), F.substring(value, cut + 1, n).alias("r"))

    def moved(half: Column, digest: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            step = F.conv(F.substring(digest, (2 * (i % 32) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
            code = F.ascii(c)

            def within(first: int, size: int) -> Column:
                return F.chr(F.lit(first) + F.pmod(code - first + step, F.lit(size)))

            return F.when(c.between("0", "9"), within(48, 10)).when(c.between("a", "z"), within(97, 26)).when(c.between("A", "Z"), within(65, 26)).otherwise(c)

        return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), one), "")

    def mixed(half: Column, i: Column, other: Column) -> Column:
        return _let(_digest(key, kind, i, other), lambda digest: moved(half, digest))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, mixed(s["l"], i, s["r"])).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(mixed(s["r"], i, s["l"])).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _luhn_sum(digits: Column, doubled_parity: Column) -> Column:
    """Sum of digits where those whose 0-based place has the given parity count double (less 9 over 9)."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == doubled_parity, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), worth), F.lit(0), lambda s, x: s + x)


def _mod97(text: Column) -> Column:
    """IBAN remainder: letters count as 10 .. 35."""

    def step(s: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _restored(shape: Column, digits: Column) -> Column:
    """`shape` with its ASCII letters and digits replaced in order by the characters of `digits`."""

    def fill(values: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            free = c.rlike("[A-Za-z0-9]")
            return F.struct(F.concat(s["out"], F.when(free, F.substring(values, s["at"], F.lit(1))).otherwise(c)).alias("out"), F.when(free, s["at"] + 1).otherwise(s["at"]).alias("at"))

        return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s["out"])

    return _let(digits, fill)


def _parts(m: Column, year: int, month: int, day: int) -> Column:
    return F.concat_ws("-", F.substring(m, year, 4), F.substring(m, month, 2), F.substring(m, day, 2)).try_cast("date")


def _month_first(m: Column) -> Column:
    """Whether a date with slashes is one only when its month is read first."""
    return (F.substring(m, 3, 1) == "/") & _parts(m, 7, 4, 1).isNull() & _parts(m, 7, 1, 4).isNotNull()


def _valid_date(m: Column) -> Column:
    """The day; with slashes the day of the month is first where that gives a date, else the month."""
    slashes = F.coalesce(_parts(m, 7, 4, 1), _parts(m, 7, 1, 4))
    return F.when(F.substring(m, 5, 1) == "-", m.try_cast("date")).when(F.substring(m, 3, 1) == "/", slashes).otherwise(_parts(m, 7, 4, 1))


def _day(m: Column) -> Column:
    return F.date_diff(_valid_date(m), F.lit(DATE_FIRST).cast("date"))


def kind_of(m: Column) -> Column:
    """The validated kind of a matched string, or null where the numbers don't validate (it stays as it is)."""
    full = {k: F.regexp_like(m, F.lit(f"^(?:{_bare(p)})$")) for k, p in PATTERNS.items() if k != "secret"}
    digits = F.regexp_replace(m, r"\D", "")
    octets = F.split(m, r"\.")
    compact = F.replace(m, F.lit(" "), F.lit(""))
    ssn_ok = ~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 1, 1) != "9") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")
    return (
        F.when(full["email"], F.lit("email"))
        .when(full["iban"] & (_mod97(F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4))) == 1), F.lit("iban"))
        .when(full["card"] & (_luhn_sum(digits, F.length(digits) % 2) % 10 == 0), F.lit("card"))
        .when(full["ssn"] & ssn_ok, F.lit("ssn"))
        .when(full["date"] & _day(m).between(0, DATE_A * DATE_B - 1), F.lit("date"))
        .when(full["ip"] & F.forall(octets, lambda o: o.cast("int") <= 255) & F.forall(octets, lambda o: o == o.cast("int").cast("string")), F.lit("ip"))
        .when(full["phone"], F.lit("phone"))
        .when(~full["iban"] & F.regexp_like(m, F.lit("^[A-Za-z0-9]{6,64}$")) & ~F.regexp_like(m, F.lit(r"^\d+$")), F.lit("secret"))
    )


def _bare(pattern: str) -> str:
    """A pattern without its look-around, for a string that was matched already."""
    out, depth, i = "", 0, 0
    while i < len(pattern):
        if pattern.startswith(("(?<!", "(?!", "(?<=", "(?="), i):
            depth, i = 1, i + 2
            while depth:
                i += 1
                if pattern[i] == "\\":
                    i += 1
                elif pattern[i] == "[":
                    i = pattern.index("]", i + 1) if pattern[i + 1] != "]" else pattern.index("]", i + 2)
                elif pattern[i] == "(":
                    depth += 1
                elif pattern[i] == ")":
                    depth -= 1
            i += 1
        else:
            out, i = out + pattern[i], i + 1
    return out


def _card(m: Column, key: str) -> Column:
    """All digits but the last are permuted; the last is the Luhn digit of the result."""
    digits = F.regexp_replace(m, r"\D", "")
    body = feistel_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    return _restored(m, _let(body, lambda x: F.concat(x, F.pmod(F.lit(10) - _luhn_sum(x, (F.length(x) + 1) % 2), F.lit(10)).cast("string"))))


def _iban(m: Column, key: str) -> Column:
    """The national part is permuted; the check digits are 98 less the remainder of the rest."""
    compact = F.replace(m, F.lit(" "), F.lit(""))
    national = feistel_text(F.substring(compact, F.lit(5), F.length(compact)), key, "iban")
    return _restored(m, _let(national, lambda x: F.concat(F.substring(m, 1, 2), F.lpad((F.lit(98) - _mod97(F.concat(x, F.substring(m, 1, 2), F.lit("00")))).cast("string"), 2, "0"), x)))


def _ssn(m: Column, key: str) -> Column:
    """Valid numbers are areas 001-665 and 667-899, groups 01-99 and serials 0001-9999: 898 * 99 * 9999 in all."""
    area, low = F.substring(m, 1, 3).cast("int"), 99 * 9999
    rank = (area - F.when(area > 666, 2).otherwise(1)).cast("long") * F.lit(low) + (F.substring(m, 5, 2).cast("int") - 1) * 9999 + F.substring(m, 8, 4).cast("int") - 1

    def text(x: Column) -> Column:
        new = F.floor(x / F.lit(low)).cast("int") + 1
        rest = F.pmod(x, F.lit(low))
        return F.format_string("%03d-%02d-%04d", F.when(new >= 666, new + 1).otherwise(new), (F.floor(rest / F.lit(9999)) + 1).cast("int"), (rest % 9999 + 1).cast("int"))

    return _let(feistel_number(rank, 898, low, key, "ssn"), text)


def _date(m: Column, key: str) -> Column:
    """Days are permuted. A month-first date is moved on until its day is over 12 again, so that it can't be read as another's day-first one."""

    def moved(day: Column) -> Column:
        return feistel_number(day, DATE_A, DATE_B, key, "date")

    def as_date(day: Column) -> Column:
        return F.date_add(F.lit(DATE_FIRST).cast("date"), day.cast("int"))

    def walked(first: Column) -> Column:
        # three of five days are over 12, so 64 moves are never used up
        return F.aggregate(F.sequence(F.lit(1), F.lit(63)), first, lambda s, _: F.when(F.dayofmonth(as_date(s)) > 12, s).otherwise(moved(s)))

    def text(d: Column) -> Column:
        return F.when(F.substring(m, 5, 1) == "-", F.date_format(d, "yyyy-MM-dd")).when(F.substring(m, 3, 1) == "/", F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy"))

    once = moved(_day(m).cast("long"))
    return F.when(_month_first(m), _let(as_date(walked(once)), lambda d: F.date_format(d, "MM/dd/yyyy"))).otherwise(_let(as_date(once), text))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o)
    return _let(feistel_number(number, 65536, 65536, key, "ip"), lambda x: F.concat_ws(".", *[F.pmod(F.shiftright(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]))


def _phone(m: Column, key: str) -> Column:
    """The country code behind a plus sign stays, whatever the separators; all other digits are permuted."""
    digits = F.regexp_replace(m, r"\D", "")
    code = F.when(F.startswith(m, F.lit("+")), F.regexp_extract(digits, PHONE_CODE, 0)).otherwise(F.lit(""))
    return _restored(m, F.concat(code, feistel_text(F.substring(digits, F.length(code) + 1, F.length(digits)), key, "phone")))


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(feistel_text(F.lower(F.substring(m, F.lit(1), at - 1)), key, "email"), F.substring(m, at, F.length(m)))


def _secret(m: Column, key: str) -> Column:
    prefix = F.when(F.startswith(m, F.lit("AKIA")), F.lit("AKIA")).otherwise(F.lit(""))
    return F.concat(prefix, feistel_text(F.substring(m, F.length(prefix) + 1, F.length(m)), key, "secret"))


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a validated match; the match itself where kind is null."""
    out = F.when(kind.isNull(), m)
    for name, make in (("email", _email), ("iban", _iban), ("card", _card), ("ssn", _ssn), ("phone", _phone), ("date", _date), ("ip", _ip), ("secret", _secret)):
        out = out.when(kind == name, make(m, key))
    return out


def replaced(text: Column, key: str) -> tuple[Column, Column]:
    """The matches of a text as array<struct<m, kind, p>> with their pseudonyms p, and the texts before, between and after them."""
    matches = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    gaps = F.split(text, ANY, -1)
    pieces = F.transform(matches, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    pieces = F.transform(pieces, lambda p: F.struct(p["m"].alias("m"), p["kind"].alias("kind"), pseudonym(p["m"], p["kind"], key).alias("p")))
    return pieces, gaps


FOUND = "array<struct<kind:string,start:int,length:int,pseudonym:string>>"


def _placed(items: Column) -> Column:
    """FOUND from array<struct<gap, length, kind, p>>, where gap is the number of characters before each value.

    Places are summed up within parts of PLACED_AT_ONCE values and over the parts, so that a text of many
    values isn't copied for each of them.
    """
    none = F.expr(f"cast(array() as {FOUND})")

    def part(all_: Column, i: Column) -> Column:
        return F.slice(all_, i * PLACED_AT_ONCE + 1, F.lit(PLACED_AT_ONCE))

    def one(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        value = F.struct(x["kind"].alias("kind"), start.alias("start"), x["length"].alias("length"), x["p"].alias("pseudonym"))
        return F.struct((start + x["length"]).alias("at"), F.concat(s["all"], F.array(value)).alias("all"))

    def of(all_: Column) -> Column:
        parts = F.sequence(F.lit(0), F.ceil(F.size(all_) / PLACED_AT_ONCE).cast("int") - 1)
        sums = F.transform(parts, lambda i: F.aggregate(part(all_, i), F.lit(0), lambda s, x: s + x["gap"] + x["length"]))
        first = F.aggregate(sums, F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<int>)").alias("all")), lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
        return _let(first, lambda starts: F.flatten(F.transform(parts, lambda i: F.aggregate(part(all_, i), F.struct(F.get(starts, i).alias("at"), none.alias("all")), one, lambda s: s["all"]))))

    return _let(items, of)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = "found") -> DataFrame:
    """`docs` with personal values of `text_col` replaced under `key` (whoever has it can undo them), and `found_col` array<struct<kind, start, length, pseudonym>>.

    Kinds: email, iban (mod 97), card (Luhn), ssn, phone, date (a real day from 1900-01-01 to
    2105-05-05, month first where day first gives no date), ip (four octets), secret (access keys, passwords and tokens behind their marks).
    start is the 1-based code point in the input text. Values that don't validate stay. Null text
    stays null and has null finds; an empty text has none; a text without values is unchanged with an empty list; row count,
    order of columns and repeated rows are kept; a column named like found_col is replaced.
    Whole texts are scanned by two linear regular-expression passes; no row is moved.
    """
    text = F.col(text_col)
    hinted = docs.withColumn("__vs_hit", F.coalesce(F.regexp_like(text, F.lit(HINT)), F.lit(False)))
    pieces, gaps = replaced(F.when(F.col("__vs_hit"), text), key)
    cut = hinted.withColumn("__vs_pieces", pieces).withColumn("__vs_gaps", F.when(F.size("__vs_pieces") > 0, gaps))
    some = F.coalesce(F.size("__vs_pieces") > 0, F.lit(False))
    joined = F.concat(F.array_join(F.zip_with(F.slice("__vs_gaps", 1, F.size("__vs_pieces")), "__vs_pieces", lambda g, p: F.concat(g, p["p"])), ""), F.element_at("__vs_gaps", -1))

    out = cut.withColumn(text_col, F.when(some, joined).otherwise(text))
    if found_col:
        items = F.zip_with(F.slice("__vs_gaps", 1, F.size("__vs_pieces")), "__vs_pieces", lambda g, p: F.struct(F.length(g).alias("gap"), F.length(p["m"]).alias("length"), p["kind"].alias("kind"), p["p"].alias("p")))
        out = out.withColumn(found_col, F.when(some, F.filter(_placed(items), lambda f: f["kind"].isNotNull())).when(text.isNotNull(), F.expr(f"cast(array() as {FOUND})")))
    return out.drop("__vs_hit", "__vs_pieces", "__vs_gaps")
