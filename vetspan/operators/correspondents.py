"""Known correspondents of local addresses: what qualifies, lookups, learning and clean-up."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retention import evict
from .slices import Slicing, cut_hot_keys

DAY = 86_400_000
INBOUND, OUTBOUND, MANUAL = "repeated_legitimate_inbound", "authenticated_outbound", "manual"


@dataclass(frozen=True)
class TrustPolicy:
    min_messages: int = 3
    min_score: float = 0.80
    stale_ms: int = 365 * DAY
    require_authentication: bool = True
    learn: bool = True
    per_sender: bool = True
    capacity: int = 100_000


def scoped(rows: DataFrame, column: str, address: str | None = None, everyone: bool = False) -> DataFrame:
    """The rows of one address or of everyone; exactly one of the two has to be given."""
    if everyone == (address is not None):
        raise ValueError("give an address or everyone, not both")
    return rows if everyone else rows.filter(F.col(column) == address)


def qualified(policy: TrustPolicy) -> Column:
    return F.col("whitelist_type").isin(OUTBOUND, MANUAL) | ((F.col("whitelist_type") == INBOUND) & (F.col("legitimate_email_count") >= policy.min_messages))


def qualified_active(policy: TrustPolicy, now_ms: int) -> Column:
    fresh = F.col("last_activity_at_ms") >= now_ms - policy.stale_ms if policy.stale_ms > 0 else F.lit(True)
    return qualified(policy) & fresh


def presence(rows: DataFrame, policy: TrustPolicy, now_ms: int) -> DataFrame:
    """For each correspondent the number of local addresses that know it, and by which kinds."""
    known = rows.filter(qualified_active(policy, now_ms))
    flags = [F.max(F.when(F.col("whitelist_type") == k, 1).otherwise(0)).alias(n) for n, k in (("manual", MANUAL), ("outbound", OUTBOUND), ("inbound", INBOUND))]
    return known.groupBy("correspondent").agg(F.countDistinct("local_address").alias("local_addresses"), *flags)


def match(messages: DataFrame, rows: DataFrame, policy: TrustPolicy, now_ms: int) -> DataFrame:
    """id, matched and all_matched of messages id, sender, recipients: how many recipients know the sender.

    Known pairs are only looked up, so repeated ones needn't be summed up before; recipients are counted apart from that.
    """
    known = rows.filter(qualified_active(policy, now_ms)).select(F.col("local_address").alias("recipient"), F.col("correspondent").alias("sender"))
    asked = messages.select("id", "sender", F.explode(F.array_distinct("recipients")).alias("recipient"))
    hits = asked.join(known, ["sender", "recipient"], "left_semi").select("id", F.lit(1).alias("hit"), F.lit(0).alias("asked"))
    all_ = messages.select("id", F.lit(0).alias("hit"), F.size(F.array_distinct("recipients")).alias("asked")).filter("asked > 0")
    return hits.unionByName(all_).groupBy("id").agg(F.sum("hit").alias("matched"), (F.sum("hit") == F.sum("asked")).alias("all_matched"))


def learning_action(verdict: Column, score: Column, unwanted_min: float, authenticated: Column, policy: TrustPolicy) -> Column:
    """ignore, remove, advance or refresh; null for another verdict."""
    advance = F.lit(policy.learn) & (score >= policy.min_score) & (F.lit(not policy.require_authentication) | authenticated)
    unwanted = F.when(authenticated & (score >= unwanted_min), "remove").otherwise("ignore")
    return F.when(verdict == "unwanted", unwanted).when(verdict == "legitimate", F.when(advance, "advance").otherwise("refresh"))


def clean(rows: DataFrame, policy: TrustPolicy, now_ms: int) -> DataFrame:
    """Stale rows go; over the capacity the oldest unqualified inbound rows, then the oldest of all."""
    kept = rows.filter(F.col("last_activity_at_ms") >= now_ms - policy.stale_ms) if policy.stale_ms > 0 else rows
    candidate = (F.col("whitelist_type") == INBOUND) & (F.col("legitimate_email_count") < policy.min_messages)
    return evict(kept, policy.capacity, [F.when(candidate, 0).otherwise(1), F.col("last_activity_at_ms"), F.col("id")])


#: Actions at which a stale row is gone.
STALE_AT = ("outbound", "advance", "refresh")
STATE = "local_address string, correspondent string, learned_at_ms long, last_activity_at_ms long, whitelist_type string, legitimate_email_count int"


def step(row: list | None, action: str, at: int, policy: TrustPolicy) -> list | None:
    """The row [learned, last, kind, count] after an action at a time; None where there is no row.

    outbound promotes all but manual rows, manual makes a manual row, touch and refresh move the
    activity of rows, advance counts an inbound row up to the needed messages or starts one, remove
    takes an inbound row away.
    """
    if row is not None and policy.stale_ms > 0 and row[1] < at - policy.stale_ms and action in STALE_AT:
        row = None
    if action == "outbound":
        if row is None:
            return [at, at, OUTBOUND, 0]
        return [row[0], at, row[2], row[3]] if row[2] == MANUAL else [row[0], at, OUTBOUND, 0]
    if action == "manual":
        return [at if row is None else row[0], at, MANUAL, 0]
    if action == "delete":
        return None
    if action == "remove":
        return None if row is not None and row[2] == INBOUND else row
    if action == "advance" and row is None:
        return [at, at, INBOUND, 1]
    if row is None:
        return None
    if action == "advance" and row[2] == INBOUND and row[3] < policy.min_messages:
        row = [row[0], at, row[2], row[3] + 1]
    if action in ("advance", "refresh", "touch") and (row[2] != INBOUND or row[3] >= policy.min_messages):
        row = [row[0], at, row[2], row[3]]
    return row


#: In a summary: the time at which the row that came in was learned, and that of its last activity.
SAME_LEARNED, SAME_LAST = float("-inf"), float("inf")


class Summary:
    """What a slice of a pair's events makes of any row that comes in; slices are summed up apart and applied in order.

    A row's way through the events depends on its kind and count, of which there are few, and on its
    activity only until an event renews it. Until then the events that leave the row as it is also leave
    no row as it is, and what can take it away is that it is stale at one of them. So for each kind and
    count there is one edge: with an activity before it the outcome is that of no row, otherwise a row
    (or none) that may still hold the times that came in.
    """

    def __init__(self, policy: TrustPolicy):
        self.policy = policy
        kinds = [*((INBOUND, n) for n in range(1, max(policy.min_messages, 1) + 1)), (OUTBOUND, 0), (MANUAL, 0)]
        self.none: list | None = None
        self.rows: list[list | None] = [[SAME_LEARNED, SAME_LAST, *k] for k in kinds]
        self.edges = [SAME_LEARNED] * len(kinds)
        self.place = {k: i for i, k in enumerate(kinds)}

    def add(self, action: str, at: int) -> None:
        self.none = step(self.none, action, at, self.policy)
        judged = self.policy.stale_ms > 0 and action in STALE_AT
        for i, row in enumerate(self.rows):
            if judged and row is not None and row[1] == SAME_LAST:
                self.edges[i] = at - self.policy.stale_ms
            self.rows[i] = step(row, action, at, self.policy)

    def packed(self) -> str:
        return json.dumps([self.none, self.rows, self.edges])

    def apply(self, packed: str, row: list | None) -> list | None:
        """The row after a packed summary's events."""
        none, rows, edges = json.loads(packed)
        if row is None:
            return none
        i = self.place[row[2], row[3]]
        if row[1] < edges[i]:
            return none
        return rows[i] and [row[0] if rows[i][0] == SAME_LEARNED else rows[i][0], row[1] if rows[i][1] == SAME_LAST else rows[i][1], *rows[i][2:]]


def fold(events: DataFrame, policy: TrustPolicy = TrustPolicy(), slicing: Slicing = Slicing()) -> DataFrame:  # noqa: B008
    """The rows left after events local_address, correspondent, at_ms, id, action in order.

    Pairs are dealt by hash and sorted within partitions; a task holds one pair's row at a time. A pair
    with very many events (see Slicing) is cut into slices of time, which tasks sum up apart
    (see Summary); then its summaries, one for each slice, are applied in order. Events of the
    same time go by id; an empty table gives no row, other columns aren't read.
    """
    keys = ["local_address", "correspondent"]
    names = [c.split()[0] for c in STATE.split(", ")]
    cold, hot = cut_hot_keys(events.select(*keys, "at_ms", "id", "action"), keys, "at_ms", slicing)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, row = None, None
        for frame in frames:
            out = []
            for a, b, at, _, action in frame.itertuples(index=False):
                if (a, b) != key:
                    if row is not None:
                        out.append((*key, *row))
                    key, row = (a, b), None
                row = step(row, action, at, policy)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([(*key, *row)] if row is not None else [], columns=names)

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, summary = None, Summary(policy)
        columns = [*keys, "slice", "summary"]
        for frame in frames:
            out = []
            for a, b, at, _, action, part in frame.itertuples(index=False):
                if (a, b, part) != key:
                    if key is not None:
                        out.append((*key, summary.packed()))
                    key, summary = (a, b, part), Summary(policy)
                summary.add(action, at)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([(*key, summary.packed())] if key is not None else [], columns=columns)

    def applied(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, row, summary = None, None, Summary(policy)
        for frame in frames:
            out = []
            for a, b, _, packed in frame.itertuples(index=False):
                if (a, b) != key:
                    if row is not None:
                        out.append((*key, *row))
                    key, row = (a, b), None
                row = summary.apply(packed, row)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([(*key, *row)] if row is not None else [], columns=names)

    rows = cold.repartition(*keys).sortWithinPartitions(*keys, "at_ms", "id").mapInPandas(run, STATE)
    if hot is None:
        return rows
    parts = hot.repartition(*keys, "__slice").sortWithinPartitions(*keys, "__slice", "at_ms", "id")
    summaries = parts.mapInPandas(summed, "local_address string, correspondent string, slice int, summary string")
    return rows.unionByName(summaries.repartition(*keys).sortWithinPartitions(*keys, "slice").mapInPandas(applied, STATE))
