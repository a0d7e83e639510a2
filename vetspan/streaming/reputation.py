"""Reputation of sending addresses kept by a stream, with the same steps as the batch fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.reputation import STATE, AddressState, ReputationPolicy

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEPT = "strike_times array<long>, strike_ids array<long>, level string, until long, legitimate int, known boolean, last long, timer long"


class ReputationProcessor(StatefulProcessor):
    """One address's state; events of a batch are applied in the order of time and id.

    With `expire`, an address has one timer, at the first whole step (refresh_step_ms, a minute at least)
    after its last strike has left the window and its block has ended. It is moved at most once a step, and
    when the watermark passes it the state goes: from then on it would decide nothing.
    """

    def __init__(self, policy: ReputationPolicy, expire: bool = False):
        self.policy, self.expire = policy, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("address", KEPT)

    def due(self, held: AddressState) -> int:
        step = max(self.policy.refresh_step_ms, 60_000)
        last = max([t + self.policy.window_ms for t, _ in held.strikes] + [held.until or 0, 0])
        return (last // step + 1) * step

    def kept(self) -> tuple[AddressState, int | None]:
        if not self.state.exists():
            return AddressState([]), None
        times, ids, level, until, legitimate, known, last, timer = self.state.get()
        return AddressState(list(zip(times, ids, strict=True)), level, until, legitimate, known, last), timer

    def keep(self, held: AddressState, timer: int | None) -> None:
        self.state.update(([t for t, _ in held.strikes], [i for _, i in held.strikes], held.level, held.until, held.legitimate, held.known, held.last, timer))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held, timer = self.kept()
        events = pd.concat([frame[["at_ms", "id", "kind"]] for frame in rows]).sort_values(["at_ms", "id"])
        for at, id_, kind in events.itertuples(index=False):
            held.apply(kind, int(at), int(id_), self.policy)
        if self.expire:
            due = max(self.due(held), timerValues.getCurrentWatermarkInMs() + 1)
            if timer != due:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(due)
                timer = due
        self.keep(held, timer)
        row = [(key[0], held.level, held.until, len(held.strikes), held.legitimate, held.last)] if held.known else []
        yield self.frame(row)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held, timer = self.kept()
        if timer is not None and timer <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield self.frame([])

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in STATE.split(", ")]
        return pd.DataFrame(rows, columns=names).astype({"blocked_until_ms": "Int64"})

    def close(self) -> None:
        pass


def reputation_stream(events: DataFrame, policy: ReputationPolicy = ReputationPolicy(), late: str | None = "1 day") -> DataFrame:  # noqa: B008
    """Rows of the state whenever an address has new events ip, at_ms, id, kind; needs the RocksDB state store.

    Clocks are those of the events. Events may come `late` behind the newest one; later ones are dropped,
    and addresses that are dead by then leave the state, so that it holds the live ones. Without `late` all
    events count whenever they come, and the state is kept for ever.
    """
    if late is None:
        return events.groupBy("ip").transformWithStateInPandas(ReputationProcessor(policy), STATE, "Update", "None")
    marked = events.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late)
    return marked.groupBy("ip").transformWithStateInPandas(ReputationProcessor(policy, True), STATE, "Update", "EventTime")


def activity_stream(activity: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """The activity summary per window of a stream of activity rows with a timestamp column occurred_at."""
    from ..operators.activity import summary_columns

    marked = activity.withWatermark("occurred_at", late)
    return marked.groupBy(F.window("occurred_at", width)).agg(*summary_columns())
