"""Sender blocklist: which recipients of a message are blocked, by exact mailbox and by domain rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import domain_of, parent_domains

EXACT, DOMAIN = 1, 2


def live(rules: DataFrame, now_ms: int) -> DataFrame:
    return rules.filter(F.col("expires_at_ms") > now_ms)


def pattern_kind(pattern: Column) -> Column:
    """EXACT for a@b, DOMAIN for *@b, null for anything else."""
    return F.when(pattern.rlike(r"^\*@[^@*\s]+$"), DOMAIN).when(pattern.rlike(r"^[^@*\s]+@[^@*\s]+$"), EXACT)


def pattern_value(pattern: Column) -> Column:
    return F.lower(F.when(pattern_kind(pattern) == DOMAIN, F.substring(pattern, F.lit(3), F.length(pattern))).otherwise(pattern))


def candidates(messages: DataFrame, include_subdomains: bool = True, *more: str) -> DataFrame:
    """id, sender_kind, sender_value that rules may name (the sender, its domain, and the parents of that), and columns `more`."""
    domain = domain_of(F.col("sender"))
    names = parent_domains(domain) if include_subdomains else F.array(domain)
    both = F.concat(F.array(F.struct(F.lit(EXACT).alias("k"), F.lower("sender").alias("v"))), F.transform(names, lambda d: F.struct(F.lit(DOMAIN).alias("k"), d.alias("v"))))
    return messages.select("id", *more, F.explode(both).alias("c")).select("id", F.col("c.k").alias("sender_kind"), F.col("c.v").alias("sender_value"), *more)


#: So many scopes of live rules, or fewer, are broadcast.
BROADCAST_SCOPES = 200_000


def hits(messages: DataFrame, rules: DataFrame, now_ms: int, include_subdomains: bool = True) -> DataFrame:
    """id, sender_kind, any, scope of what messages ask for and live rules answer.

    A message asks, for each name of its sender, for any rule, for one for "*" and for one for each of its
    recipients, and is joined with distinct rules by all of these: it costs as many rows as that, however many
    rules name its sender. Live rules are counted by a job while the result is declared.
    """
    keys = ["sender_kind", "sender_value", "any", "scope"]
    asks = lambda any_, scope: F.struct(F.lit(any_).alias("any"), scope.alias("scope"))
    named = live(rules, now_ms).select("sender_kind", "sender_value", F.inline(F.array(asks(True, F.lit("")), asks(False, F.col("recipient"))))).distinct()
    if named.limit(BROADCAST_SCOPES + 1).count() <= BROADCAST_SCOPES:
        named = F.broadcast(named)
    own = messages.select("id", F.transform(F.array_distinct("recipients"), lambda r: asks(False, r)).alias("own"), "sender")
    asked = candidates(own, include_subdomains, "own").select("id", "sender_kind", "sender_value", F.inline(F.concat(F.array(asks(True, F.lit("")), asks(False, F.lit("*"))), "own")))
    return asked.join(named, keys).select("id", "sender_kind", "any", "scope")


def matches(messages: DataFrame, rules: DataFrame, now_ms: int, include_subdomains: bool = True) -> DataFrame:
    """id, blocked (sorted recipients), matched_kind, of the messages id, sender, recipients that a live rule meets.

    Ids are unique. A rule for "*" blocks all recipients. An exact rule is reported before a domain rule,
    also where it is for others.
    """
    found = hits(messages, rules, now_ms, include_subdomains)
    scopes = found.groupBy("id").agg(F.collect_set(F.when(~F.col("any"), F.col("scope"))).alias("scopes"), F.min("sender_kind").alias("matched_kind"))
    blocked = F.array_sort(F.array_distinct(F.when(F.array_contains("scopes", "*"), F.col("recipients")).otherwise(F.array_intersect("recipients", "scopes"))))
    met = messages.join(scopes, "id").withColumn("blocked", blocked)
    return met.filter(F.size("blocked") > 0).select("id", "sender", "recipients", "blocked", "matched_kind")


def outcome(blocked: DataFrame) -> DataFrame:
    """matches with remaining recipients and outcome full (none remain) or partial."""
    rest = F.array_sort(F.array_except("recipients", "blocked"))
    return blocked.withColumn("remaining", rest).withColumn("outcome", F.when(F.size("remaining") == 0, "full").otherwise("partial"))


def without_trust(correspondents: DataFrame, rules: DataFrame, now_ms: int) -> DataFrame:
    """Correspondents that no live exact rule contradicts: such a rule removes the recipient's trust in its sender."""
    exact = live(rules, now_ms).filter(F.col("sender_kind") == EXACT)
    pairs = exact.select(F.col("recipient").alias("local_address"), F.col("sender_value").alias("correspondent"))
    everyone = pairs.filter("local_address = '*'").select("correspondent")
    return correspondents.join(pairs, ["local_address", "correspondent"], "left_anti").join(everyone, "correspondent", "left_anti").select(correspondents.columns)


def without_rules(rules: DataFrame, correspondents: DataFrame) -> DataFrame:
    """Rules left when trust is given: it removes the exact rule of the same recipient and sender. Others aren't looked up; both parts read the rules."""
    pairs = correspondents.select(F.col("local_address").alias("recipient"), F.col("correspondent").alias("sender_value"))
    exact = F.coalesce(F.col("sender_kind") == EXACT, F.lit(False))
    left = rules.filter(exact).join(pairs, ["recipient", "sender_value"], "left_anti").select(rules.columns)
    return left.union(rules.filter(~exact))
