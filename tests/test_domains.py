"""Suffix rules and networks from tables, against the published cases of the list's format and the standard library."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from vetspan.operators import domains

LIST = """// comment
// ===BEGIN ICANN DOMAINS===
com
biz
jp
ac.jp
kyoto.jp
ide.kyoto.jp
*.kobe.jp
!city.kobe.jp
*.ck
!www.ck
us
ak.us
k12.ak.us
uk with a note
co.uk
*.mm
cn
com.cn
xn--55qx5d.cn
// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
uk.com
blogspot.com
// ===END PRIVATE DOMAINS===
"""
#: Published cases of the suffix list: a domain and its registrable domain.
CASES = """COM -|example.COM example.com|WwW.example.COM example.com|example example.example -|biz -|domain.biz domain.biz|b.domain.biz domain.biz|a.b.domain.biz domain.biz
jp -|test.jp test.jp|www.test.jp test.jp|ac.jp -|test.ac.jp test.ac.jp|www.test.ac.jp test.ac.jp|kyoto.jp -|test.kyoto.jp test.kyoto.jp|ide.kyoto.jp -|b.ide.kyoto.jp b.ide.kyoto.jp
a.b.ide.kyoto.jp b.ide.kyoto.jp|c.kobe.jp -|b.c.kobe.jp b.c.kobe.jp|a.b.c.kobe.jp b.c.kobe.jp|city.kobe.jp city.kobe.jp|www.city.kobe.jp city.kobe.jp|ck -|test.ck -|b.test.ck b.test.ck
a.b.test.ck b.test.ck|www.ck www.ck|www.www.ck www.ck|us -|test.us test.us|www.test.us test.us|ak.us -|test.ak.us test.ak.us|k12.ak.us -|test.k12.ak.us test.k12.ak.us|www.test.k12.ak.us test.k12.ak.us
uk -|co.uk -|example.co.uk example.co.uk|mm -|c.mm -|b.c.mm b.c.mm|a.b.c.mm b.c.mm|cn -|com.cn -|x.com.cn x.com.cn|xn--85x722f.xn--55qx5d.cn xn--85x722f.xn--55qx5d.cn|uk.com uk.com|b.example.uk.com uk.com|local -|b.example.example example.example|-bad.com -|.com -|a..com -"""


@pytest.fixture(scope="module")
def rules(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("list") / "suffixes.dat"
    path.write_text(LIST)
    return domains.read_suffix_rules(spark, str(path)), domains.read_suffix_rules(spark, str(path), private=True)


def test_published_cases(spark, rules):
    cases = dict(x.split(" ")[:2] for x in CASES.replace("\n", "|").split("|") if len(x.split(" ")) == 2)
    rows = spark.createDataFrame([(d,) for d in [*cases, *list(cases)[:3]]] + [(None,), ("",), ("www.example.com.",)], "d string")
    got = {r.domain: r.registrable for r in domains.registrable_domains(rows, rules[0], "d").collect()}
    assert {d: got[d] or "-" for d in cases} == cases
    assert got[None] is None and got[""] is None and got["www.example.com."] == "example.com" and len(got) == len(cases) + 3
    private = {r.domain: r.registrable for r in domains.registrable_domains(rows, rules[1], "d").collect()}
    assert private["uk.com"] is None and private["b.example.uk.com"] == "example.uk.com"


def test_suffixes_of_rules(spark, rules):
    rows = spark.createDataFrame([("a.b.c.kobe.jp", "c.kobe.jp"), ("x.city.kobe.jp", "kobe.jp"), ("a.zz", "zz")], "domain string, suffix string")
    got = {r.domain: r.suffix for r in domains.registrable_domains(rows.select("domain"), rules[0]).collect()}
    assert got == {r.domain: r.suffix for r in rows.collect()}
    assert domains.registrable_domains(rows.limit(0), rules[0]).count() == 0
    assert [r.suffix for r in domains.registrable_domains(rows.limit(1), rules[0].limit(0)).collect()] == ["jp"]


def test_alignment(spark, rules):
    pairs = spark.createDataFrame([("a.example.co.uk", "B.Example.co.uk."), ("a.co.uk", "b.co.uk"), ("co.uk", "co.uk"), (None, "x.com"), ("x.com", "x.com")], "f string, d string")
    got = [r.aligned for r in domains.aligned_domains(pairs.withColumn("domain", F.lit(1)), rules[0], "f", "d").orderBy("f", "d").collect()]
    assert sorted(got) == [False, False, False, True, True]


def test_networks_against_the_standard_library(spark):
    rng = random.Random(9)
    four = lambda: ipaddress.IPv4Address((rng.choice([10, 10, 77, 198]) << 24) | rng.getrandbits(24))
    six = lambda: ipaddress.IPv6Address((0x20010DB8 << 96) | rng.getrandbits(rng.choice([8, 40, 96])))
    made = [f"{four()}/{rng.randint(9, 32)}" for _ in range(3000)] + [f"{six()}/{rng.randint(30, 128)}" for _ in range(3000)] + [str(four()) for _ in range(200)]
    texts = [str(four()) for _ in range(800)] + [str(six()) for _ in range(400)] + [f"::ffff:{four()}" for _ in range(100)] + [made[-1], "nonsense", "", None, "1.2.3"]
    nets = {}
    for t in made:
        n = ipaddress.ip_network(t, strict=False)
        nets.setdefault((n.version, n.prefixlen), set()).add(int(n.network_address))

    def longest(text):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return None
        a = getattr(a, "ipv4_mapped", None) or a
        full = 32 if a.version == 4 else 128
        fits = [n for (v, n), known in nets.items() if v == a.version and (int(a) >> (full - n)) << (full - n) in known]
        return max(fits) + (96 if a.version == 4 else 0) if fits else None

    table = domains.network_rules(spark.createDataFrame([(t,) for t in [*made, "bad", "1.2.3.4/33", "::/129", None, "::ffff:0.0.0.0/90"]], "network string"))
    assert table.filter("prefix IS NULL").count() == 5
    rows = spark.createDataFrame([(t,) for t in texts], "ip string")
    got = {r.ip: r.bits for r in domains.longest_networks(rows, table).collect()}
    assert got == {t: n for t in set(texts) if t is not None and (n := longest(t)) is not None} and len(got) > 100
    flags = domains.in_network_table(rows, table)
    assert flags.count() == len(texts) and flags.filter("allowed").select("ip").distinct().count() == len(got)
    assert domains.longest_networks(rows, table.limit(0)).count() == 0
