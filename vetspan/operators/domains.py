"""Domains and addresses against tables of rules: public suffixes by label, networks by longest prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import ip_key, ip_number, is_dns_name, parent_domains

#: Rules up to this number are sent to every task; more are joined by a shuffle.
BROADCAST_RULES = 200_000
#: Lines of a suffix list between which its private section stands.
PRIVATE_BEGIN, PRIVATE_END = "===BEGIN PRIVATE DOMAINS===", "===END PRIVATE DOMAINS==="


def suffix_rules(lines: DataFrame, private: bool = False) -> DataFrame:
    """name, kind (plain, wildcard, exception) of the rules in the lines (position, value) of a public suffix list.

    A line counts up to its first white space; empty lines and comments (//) don't. The private section is
    left out unless asked for. *.name is a wildcard rule of name, !name an exception.
    """
    marks = lines.filter(F.contains("value", F.lit("DOMAINS===")))
    bounds = marks.agg(F.min(F.when(F.contains("value", F.lit(PRIVATE_BEGIN)), F.col("position"))).alias("__begin"), F.max(F.when(F.contains("value", F.lit(PRIVATE_END)), F.col("position"))).alias("__end"))
    inside = F.coalesce(F.col("position").between(F.col("__begin"), F.coalesce("__end", F.lit((1 << 63) - 1))), F.lit(False))
    public = lines.join(F.broadcast(bounds)).filter(F.lit(private) | ~inside)  # one row of bounds
    rule = F.lower(F.regexp_extract("value", r"^\s*+(\S*)", 1))
    rules = public.select(rule.alias("rule")).filter("rule <> '' AND NOT startswith(rule, '//')")
    kind = F.when(F.startswith("rule", F.lit("*.")), "wildcard").when(F.startswith("rule", F.lit("!")), "exception").otherwise("plain")
    return rules.select(F.regexp_replace("rule", r"^(?:\*\.|!)", "").alias("name"), kind.alias("kind")).distinct()


def read_suffix_rules(spark: SparkSession, path: str, private: bool = False) -> DataFrame:
    """suffix_rules of a text file."""
    lines = spark.read.text(path).withColumn("position", F.monotonically_increasing_id())
    return suffix_rules(lines, private)


def _few(rules: DataFrame) -> DataFrame:
    return F.broadcast(rules) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rules


def registrable_domains(domains: DataFrame, rules: DataFrame, column: str = "domain") -> DataFrame:
    """domain, suffix, registrable of each distinct value of `column`: its public suffix, and that with one more label.

    The parents of a domain are joined with the rules by equality. Of the rules that match, an exception
    prevails, else the one with most labels; without any the last label is the suffix. registrable is null
    where the domain is itself a suffix; both are null for what is no name. Case and a final dot don't count.
    """
    names = domains.select(F.col(column).alias("domain")).distinct()
    clean = F.regexp_replace(F.lower("domain"), r"\.$", "")
    proper = F.coalesce(is_dns_name(clean, underscore=True), F.lit(False))
    split = names.withColumn("__names", F.when(proper, parent_domains(clean)))
    own = split.select("domain", F.posexplode("__names").alias("at", "name"))
    # a plain rule's suffix starts at the parent that it names, a wildcard's one label before, an exception's one after
    place = F.when(F.col("kind") == "exception", F.col("at") + 1).when(F.col("kind") == "wildcard", F.col("at") - 1).otherwise(F.col("at"))
    hits = own.join(_few(rules), "name").select("domain", F.when(F.col("kind") == "exception", place).alias("exception"), F.when((F.col("kind") != "exception") & (place >= 0), place).alias("rule"))
    best = hits.groupBy("domain").agg(F.coalesce(F.max("exception"), F.min("rule")).alias("__at"))
    found = split.join(best, "domain", "left").withColumn("__at", F.coalesce("__at", F.size("__names") - 1))
    return found.select("domain", F.get("__names", F.col("__at")).alias("suffix"), F.when(F.col("__at") > 0, F.get("__names", F.col("__at") - 1)).alias("registrable"))


def aligned_domains(pairs: DataFrame, rules: DataFrame, one: str, two: str, name: str = "aligned") -> DataFrame:
    """The rows with whether two domains are of one organisation, by equal registrable domains; false where either has none."""
    both = pairs.select(F.col(one).alias("domain")).union(pairs.select(F.col(two)))
    known = registrable_domains(both, rules).select("domain", "registrable").filter("registrable IS NOT NULL")
    first, second = (known.select(F.col("domain").alias(f"__{n}"), F.col("registrable").alias(f"__own_{n}")) for n in ("one", "two"))
    joined = pairs.join(first, F.col(one) == F.col("__one"), "left").join(second, F.col(two) == F.col("__two"), "left")
    return joined.withColumn(name, F.coalesce(F.col("__own_one") == F.col("__own_two"), F.lit(False))).drop("__one", "__two", "__own_one", "__own_two")


def masked_key(key: Column, bits: Column) -> Column:
    """The first `bits` bits of a key of 32 hexadecimal digits, the others 0."""
    whole = F.substring(key, F.lit(1), (bits / 4).cast("int"))
    digit = F.conv(F.substring(key, (bits / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
    kept = (bits % 4).cast("int")
    mask = F.when(kept == 0, 0).when(kept == 1, 8).when(kept == 2, 12).otherwise(14)
    part = F.when(kept > 0, F.lower(F.hex(digit.bitwiseAND(mask)))).otherwise("")
    return F.rpad(F.concat(whole, part), 32, "0")


def network_rules(networks: DataFrame, column: str = "network") -> DataFrame:
    """The rows with bits and prefix of their network: an address, or an address and a length, IPv4 or IPv6.

    Bits behind the length don't count. IPv4 networks stand among the mapped IPv6 addresses, 96 bits
    longer. Both are null for text that is no network, and for mapped networks of less than 96 bits.
    """
    text = F.trim(column)
    address, length = F.split_part(text, F.lit("/"), F.lit(1)), F.when(F.contains(text, F.lit("/")), F.regexp_extract(text, r"^[^/]*/(\d{1,3})$", 1).try_cast("int"))
    four = ip_number(address).isNotNull() & ~F.contains(address, F.lit(":"))
    most = F.when(four, 32).otherwise(128)
    size = F.when(F.contains(text, F.lit("/")), length).otherwise(most)
    bits = F.when(size <= most, F.when(four, size + 96).otherwise(size))
    mapped = ~four & F.startswith(ip_key(address), F.lit("0" * 20 + "ffff"))
    made = networks.withColumn("__key", ip_key(address)).withColumn("bits", F.when(F.col("__key").isNotNull() & ~(mapped & (bits < 96)), bits))
    return made.withColumn("prefix", F.when(F.col("bits").isNotNull(), masked_key(F.col("__key"), F.col("bits")))).drop("__key")


def longest_networks(addresses: DataFrame, networks: DataFrame, column: str = "ip") -> DataFrame:
    """Each distinct value of `column` that lies in a network, with bits, prefix and the other columns of the longest one.

    `networks` are rows of network_rules; of equal networks the first by the other columns counts. A task
    masks an address to each length that any network has (129 at most) and joins by equality, so the cost
    follows the number of lengths, not of networks.
    """
    rules = networks.filter("prefix IS NOT NULL")
    rest = [c for c in rules.columns if c not in ("bits", "prefix")]
    one = rules.groupBy("bits", "prefix").agg(F.min(F.struct(*rest)).alias("__rest"))
    lengths = sorted(r.bits for r in rules.select("bits").distinct().collect())  # 129 rows at most
    keys = addresses.select(column).distinct().withColumn("__key", ip_key(F.col(column))).filter("__key IS NOT NULL")
    asked = keys.select(column, "__key", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("bits"))
    asked = asked.withColumn("prefix", masked_key(F.col("__key"), F.col("bits")))
    hits = asked.join(_few(one), ["bits", "prefix"])
    best = hits.groupBy(column).agg(F.max_by(F.struct("bits", "prefix", "__rest"), "bits").alias("__best"))
    return best.select(column, "__best.bits", "__best.prefix", *[F.col(f"__best.__rest.{c}").alias(c) for c in rest])


def in_network_table(rows: DataFrame, networks: DataFrame, column: str = "ip", name: str = "allowed") -> DataFrame:
    """The rows with whether their address lies in any network of the table; false for text that is no address."""
    found = longest_networks(rows, networks, column).select(F.col(column).alias("__ip"), F.lit(True).alias("__in"))
    return rows.join(found, F.col(column) == F.col("__ip"), "left").withColumn(name, F.coalesce("__in", F.lit(False))).drop("__ip", "__in")
