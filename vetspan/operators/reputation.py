"""Reputation of sending addresses: strikes in a rolling window, blocks, legitimate evidence and clean-up."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retention import evict, newest

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000


@dataclass(frozen=True)
class ReputationPolicy:
    """Durations in milliseconds; repeat_strikes or short_ms of 0 turn that kind of block off."""

    short_ms: int = HOUR
    repeat_strikes: int = 3
    window_ms: int = 30 * DAY
    repeat_ms: int = 30 * DAY
    legitimate_per_strike: int = 3
    refresh_on_attempt: bool = True
    refresh_step_ms: int = MINUTE
    capacity: int = 100_000


def live_strikes(strikes: DataFrame, policy: ReputationPolicy, now_ms: int) -> DataFrame:
    """The newest repeat_strikes strikes of each address that are younger than the window."""
    young = strikes.filter(F.col("struck_at_ms") > now_ms - policy.window_ms)
    return newest(young, ["ip"], "struck_at_ms", policy.repeat_strikes)


def strike_counts(strikes: DataFrame) -> DataFrame:
    return strikes.groupBy("ip").agg(F.count(F.lit(1)).alias("strikes"))


def rolling_strikes(strikes: DataFrame, policy: ReputationPolicy, bucket_ms: int | None = None) -> DataFrame:
    """Each strike with the number of strikes of its address in the window that ends with it, at most repeat_strikes.

    A strike counts from its time until window_ms later, so it is +1 in one bucket of time and -1 in
    another. What an address has at the start of a bucket is the running sum of its buckets' totals, of
    which it has at most one for each bucket_ms (by default a 4096th of the window) of its history; within
    a bucket the changes are summed in order. An address with most of all strikes is as many groups as
    it has buckets. Strikes of the same millisecond count in the order of their ids; those of a null
    address are one address, and a null time counts no strike.
    """
    width = bucket_ms or max(policy.window_ms // 4096, 1)
    row = F.struct(*strikes.columns).alias("row")
    bucket = F.expr(f"at DIV {width}L").alias("bucket")
    came = strikes.select("ip", F.col("struck_at_ms").alias("at"), F.lit(1).alias("turn"), "id", F.when(F.col("struck_at_ms").isNotNull(), 1).otherwise(0).cast("long").alias("change"), row)
    gone = strikes.filter("struck_at_ms IS NOT NULL").groupBy("ip", (F.col("struck_at_ms") + policy.window_ms).alias("at")).agg((-F.count(F.lit(1))).alias("change"))
    gone = gone.select("ip", "at", F.lit(0).alias("turn"), F.lit(None).cast(strikes.schema["id"].dataType).alias("id"), "change", F.lit(None).cast(came.schema["row"].dataType).alias("row"))
    changes = came.unionByName(gone).withColumn("bucket", bucket)
    before = F.sum("total").over(Window.partitionBy("ip").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = changes.groupBy("ip", "bucket").agg(F.sum("change").alias("total")).withColumn("start", F.coalesce(before, F.lit(0)))
    starts = starts.select(F.col("ip").alias("__ip"), F.col("bucket").alias("__bucket"), "start")
    inside = F.sum("change").over(Window.partitionBy("ip", "bucket").orderBy("at", "turn", "id").rowsBetween(Window.unboundedPreceding, 0))
    counted = changes.withColumn("inside", inside).filter("row IS NOT NULL")
    counted = counted.join(starts, F.col("ip").eqNullSafe(F.col("__ip")) & F.col("bucket").eqNullSafe(F.col("__bucket")))
    return counted.select("row.*", F.least(F.col("start") + F.col("inside"), F.lit(policy.repeat_strikes)).cast("long").alias("strikes"))


def active_blocks(reputation: DataFrame, strikes: DataFrame, now_ms: int, *more: str) -> DataFrame:
    """ip, block_level, blocked_until_ms, strike_count and columns `more` of the rows blocked at the clock; strikes are summed before the join."""
    blocked = reputation.filter(F.col("blocked_until_ms") > now_ms)
    return blocked.join(strike_counts(strikes), "ip", "left").select("ip", "block_level", "blocked_until_ms", F.coalesce("strikes", F.lit(0)).alias("strike_count"), *more)


def with_current_strike(reputation: DataFrame, strikes: DataFrame, policy: ReputationPolicy, now_ms: int) -> DataFrame:
    return reputation.join(strikes.filter(F.col("struck_at_ms") > now_ms - policy.window_ms), "ip", "left_semi")


def refreshed(blocks: DataFrame, policy: ReputationPolicy, now_ms: int) -> DataFrame:
    """Blocks met by an attempt: a repeat block ends repeat_ms from now if that is at least refresh_step_ms later."""
    later = F.lit(now_ms + policy.repeat_ms)
    due = (F.col("block_level") == "repeat") & F.lit(policy.refresh_on_attempt) & (later - F.col("blocked_until_ms") >= policy.refresh_step_ms)
    return blocks.withColumn("blocked_until_ms", F.when(due, later).otherwise(F.col("blocked_until_ms")))


def clean(reputation: DataFrame, strikes: DataFrame, policy: ReputationPolicy, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Reputation and strikes after clean-up.

    In order: old strikes go, expired repeat rows go with their strikes, expired short blocks are lifted,
    rows without block and strike go, and over the capacity unblocked, then short, then repeat rows go,
    each oldest first.
    """
    young = strikes.filter(F.col("struck_at_ms") > now_ms - policy.window_ms)
    over = F.col("blocked_until_ms") <= now_ms
    rows = reputation.filter(~(F.coalesce(over, F.lit(False)) & (F.col("block_level") == "repeat")) | F.col("block_level").isNull())
    lifted = F.coalesce(over & (F.col("block_level") == "short"), F.lit(False))
    rows = rows.withColumns({"block_level": F.when(~lifted, F.col("block_level")), "blocked_until_ms": F.when(~lifted, F.col("blocked_until_ms"))})
    struck = young.select("ip").distinct().withColumn("__struck", F.lit(True))
    rows = rows.join(struck, "ip", "left").filter(F.col("block_level").isNotNull() | F.col("__struck").isNotNull()).drop("__struck")
    rank = F.when(F.col("block_level").isNull(), 0).when(F.col("block_level") == "short", 1).otherwise(2)
    rows = evict(rows.select(reputation.columns), policy.capacity, [rank, F.col("last_activity_at_ms"), F.col("id")])
    return rows, young.join(rows.select("ip"), "ip", "left_semi")


@dataclass
class AddressState:
    """What is known of one address; strikes are (time, id), oldest first."""

    strikes: list[tuple[int, int]]
    level: str | None = None
    until: int | None = None
    legitimate: int = 0
    known: bool = False
    last: int = 0

    def reject(self, at: int, id_: int, p: ReputationPolicy) -> None:
        if self.known and self.level == "repeat" and self.until is not None and self.until <= at:
            self.strikes, self.level, self.until = [], None, None
        self.known, self.legitimate, self.last = True, 0, at
        if p.repeat_strikes > 0:
            young = [s for s in [*self.strikes, (at, id_)] if s[0] > at - p.window_ms]
            self.strikes = sorted(young)[-p.repeat_strikes :]
        else:
            self.strikes = []
        level, until = None, None
        if 0 < p.repeat_strikes <= len(self.strikes):
            level, until = "repeat", at + p.repeat_ms
        elif p.short_ms > 0:
            level, until = "short", at + p.short_ms
        if self.until is not None and self.until > at:
            stronger = self.until == until and self.level == "repeat" and level != "repeat"
            if until is None or self.until > until or stronger:
                level, until = self.level, self.until
        self.level, self.until = level, until

    def legitimise(self, at: int, p: ReputationPolicy) -> None:
        young = [s for s in self.strikes if s[0] > at - p.window_ms]
        if not self.known or not young or p.legitimate_per_strike <= 0:
            return
        active = self.level is not None and self.until is not None and self.until > at
        self.strikes = young
        self.legitimate += 1
        if self.legitimate >= p.legitimate_per_strike:
            self.strikes, self.legitimate = self.strikes[1:], 0
        if not self.strikes and not active:
            self.__init__([])
        else:
            self.last = at

    def attempt(self, at: int, p: ReputationPolicy) -> None:
        if self.level == "repeat" and p.refresh_on_attempt and self.until is not None and self.until > at and at + p.repeat_ms - self.until >= p.refresh_step_ms:
            self.until = at + p.repeat_ms

    def apply(self, kind: str, at: int, id_: int, p: ReputationPolicy) -> None:
        if kind == "rejection":
            self.reject(at, id_, p)
        elif kind == "legitimate":
            self.legitimise(at, p)
        elif kind == "attempt":
            self.attempt(at, p)


STATE = "ip string, block_level string, blocked_until_ms long, strikes int, legitimate_count int, last_activity_at_ms long"


def fold(events: DataFrame, policy: ReputationPolicy = ReputationPolicy()) -> DataFrame:  # noqa: B008
    """The state of every known address after its events ip, at_ms, id, kind (rejection, legitimate, attempt) in order.

    Addresses are dealt by hash and sorted within partitions; a task streams through its rows and holds
    one address's bounded state at a time, so an address with very many events needs no more memory.
    """
    dealt = events.select("ip", "at_ms", "id", "kind").filter("ip IS NOT NULL").repartition("ip").sortWithinPartitions("ip", "at_ms", "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ip, state = None, AddressState([])

        def row() -> list[tuple]:
            return [(ip, state.level, state.until, len(state.strikes), state.legitimate, state.last)] if ip is not None and state.known else []

        names = [c.split()[0] for c in STATE.split(", ")]
        for frame in frames:
            out = []
            for one, at, id_, kind in frame.itertuples(index=False):
                if one != ip:
                    out += row()
                    ip, state = one, AddressState([])
                state.apply(kind, at, id_, policy)
            yield pd.DataFrame(out, columns=names).astype({"blocked_until_ms": "Int64"})
        yield pd.DataFrame(row(), columns=names).astype({"blocked_until_ms": "Int64"})

    return dealt.mapInPandas(run, STATE)
