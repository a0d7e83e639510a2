"""op5 over its whole table against a plain reading of the same rules, text by text."""

import datetime
import hashlib
import ipaddress
import re

from vetspan.llm import pseudonyms
from vetspan.llm.queries import DEMO_KEY, QUERIES

from test_texts import feistel_reference, luhn

KINDS = {name: re.compile(pseudonyms._bare(p), re.ASCII) for name, p in pseudonyms.PATTERNS.items()}
SHAPES = {"-": ("%Y-%m-%d",), "/": ("%d/%m/%Y", "%m/%d/%Y"), ".": ("%d.%m.%Y",)}


def remainder(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def number_reference(value, a, b, kind):
    left, right = divmod(value, b)
    for i in range(pseudonyms.ROUNDS):
        other = right if i % 2 == 0 else left
        step = int(pseudonym_digest(kind, i, other)[:15], 16)
        if i % 2 == 0:
            left = (left + step) % a
        else:
            right = (right + step) % b
    return left * b + right


def pseudonym_digest(kind, i, half):
    return hashlib.sha256(f"{DEMO_KEY}|{kind}|{i}|{half}".encode()).hexdigest()


def day_of(m):
    """(days from 1900, format) of a real date in the domain, else None."""
    for shape in SHAPES[re.search(r"\D", m)[0]]:
        try:
            days = (datetime.datetime.strptime(m, shape).date() - datetime.date(1900, 1, 1)).days
        except ValueError:
            continue
        return (days, shape) if 0 <= days < 75_000 else None
    return None


def put_back(shape, values):
    rest = iter(values)
    return re.sub(r"[A-Za-z0-9]", lambda _: next(rest), shape)


def expected(m):
    """(kind, pseudonym) of a match; (None, the match) where it doesn't validate."""
    full = {k for k, p in KINDS.items() if p.fullmatch(m)}
    digits, compact = re.sub(r"\D", "", m), m.replace(" ", "")
    if "email" in full:
        name, domain = m.split("@")
        return "email", f"{feistel_reference(name.lower(), DEMO_KEY, 'email')}@{domain}"
    if "iban" in full and remainder(compact) == 1:
        national = feistel_reference(compact[4:], DEMO_KEY, "iban")
        return "iban", put_back(m, m[:2] + f"{98 - remainder(m[:2] + '00' + national):02d}" + national)
    if "card" in full and luhn(digits):
        body = feistel_reference(digits[:-1], DEMO_KEY, "card")
        return "card", put_back(m, body + next(c for c in "0123456789" if luhn(body + c)))
    if "ssn" in full and m[:3] not in ("000", "666") and m[0] != "9" and m[4:6] != "00" and m[7:] != "0000":
        area = int(m[:3])
        new = number_reference((area - 1 - (area > 666)) * 99 * 9999 + (int(m[4:6]) - 1) * 9999 + int(m[7:]) - 1, 898, 99 * 9999, "ssn")
        area, low = divmod(new, 99 * 9999)
        return "ssn", f"{area + 1 + (area + 1 >= 666):03d}-{low // 9999 + 1:02d}-{low % 9999 + 1:04d}"
    if "date" in full and (found := day_of(m)):
        new, shape = number_reference(found[0], 300, 250, "date"), found[1]
        date = datetime.date(1900, 1, 1) + datetime.timedelta(new)
        while shape == "%m/%d/%Y" and date.day <= 12:
            new = number_reference(new, 300, 250, "date")
            date = datetime.date(1900, 1, 1) + datetime.timedelta(new)
        return "date", date.strftime(shape)
    if "ip" in full:
        try:
            number = int(ipaddress.IPv4Address(m))
        except ValueError:
            number = None
        if number is not None:
            return "ip", str(ipaddress.IPv4Address(number_reference(number, 65536, 65536, "ip")))
    if "phone" in full:
        code = re.match(pseudonyms.PHONE_CODE, digits)[0] if m[0] == "+" else ""
        return "phone", put_back(m, code + feistel_reference(digits[len(code) :], DEMO_KEY, "phone"))
    if "iban" not in full and re.fullmatch("[A-Za-z0-9]{6,64}", m) and not m.isdigit():
        prefix = "AKIA" if m.startswith("AKIA") else ""
        return "secret", prefix + feistel_reference(m[len(prefix) :], DEMO_KEY, "secret")
    return None, m


def test_query(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op5_pseudonyms"](spark, data).collect()
    assert len(rows) == len(texts)
    pattern, kinds = re.compile(pseudonyms.ANY, re.ASCII), set()
    for r in rows:
        text = texts[r.doc_id]
        if text is None:
            assert r.text is None and r.found is None
            continue
        found, out, last = [], "", 0
        for m in pattern.finditer(text):
            kind, new = expected(m[0])
            out += text[last : m.start()] + new
            last = m.end()
            if kind:
                found.append((kind, m.start() + 1, len(m[0]), new))
        assert r.text == out + text[last:]
        assert [tuple(f) for f in r.found] == found
        kinds |= {f[0] for f in found}
    assert len(kinds) >= 3, kinds
