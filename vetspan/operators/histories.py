"""Rejection history, domain registrations, service status and command history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retention import cascade, evict, page

DAY = 86_400_000


def live_rejections(rejections: DataFrame, now_ms: int, retention_ms: int, since_ms: int | None = None) -> DataFrame:
    cutoff = now_ms - retention_ms if since_ms is None else max(since_ms, now_ms - retention_ms)
    return rejections.filter(F.col("rejected_at_ms") >= cutoff)


def _newest() -> list[Column]:
    return [F.desc("rejected_at_ms"), F.desc("id")]


def list_for_recipient(rejections: DataFrame, recipients: DataFrame, recipient: str, now_ms: int, retention_ms: int, limit: int) -> DataFrame:
    """Newest rejections of one recipient: the recipient's ids are joined first, then the page is cut."""
    own = recipients.filter(F.col("recipient") == recipient).select(F.col("rejection_id").alias("id"))
    return page(live_rejections(rejections, now_ms, retention_ms).join(own, "id"), _newest(), limit)


def list_all(rejections: DataFrame, recipients: DataFrame, now_ms: int, retention_ms: int, limit: int) -> DataFrame:
    """Newest rejections with their sorted recipients; the limit counts rejections, so it is applied before the join."""
    first = page(live_rejections(rejections, now_ms, retention_ms), _newest(), limit)
    names = recipients.join(F.broadcast(first.select(F.col("id").alias("rejection_id"))), "rejection_id")  # at most limit rows
    sets = names.groupBy(F.col("rejection_id").alias("id")).agg(F.sort_array(F.collect_list("recipient")).alias("recipients"))
    return first.join(sets, "id", "left")


def detail(rejections: DataFrame, recipients: DataFrame, id_: int, now_ms: int, retention_ms: int) -> DataFrame:
    """One rejection, if it is live, with its sorted recipients."""
    one = live_rejections(rejections, now_ms, retention_ms).filter(F.col("id") == id_)
    sets = recipients.filter(F.col("rejection_id") == id_).groupBy(F.col("rejection_id").alias("id")).agg(F.sort_array(F.collect_list("recipient")).alias("recipients"))
    return one.join(sets, "id", "left")


def clean_rejections(rejections: DataFrame, recipients: DataFrame, now_ms: int, retention_ms: int, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Expired rows go, then the oldest over the capacity; recipients go with their rejection."""
    kept = evict(live_rejections(rejections, now_ms, retention_ms), capacity, [F.col("rejected_at_ms"), F.col("id")])
    return kept, cascade(recipients, kept, "rejection_id")


def add_rejections(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parent rows and child rows (distinct recipients) of rejections with an array column recipients."""
    return new.drop("recipients"), new.select(F.col("id").alias("rejection_id"), F.explode(F.array_distinct("recipients")).alias("recipient"))


def clean_domains(domains: DataFrame, now_ms: int, grace_ms: int, capacity: int) -> DataFrame:
    """Rows go when they ended before the grace, then those that end first over the capacity."""
    return evict(domains.filter(F.col("expires_at_ms") >= now_ms - grace_ms), capacity, [F.col("expires_at_ms"), F.col("id")])


def registration_decision(registered: Column, expires: Column, now_ms: int, refresh_ms: int = 14 * DAY) -> Column:
    """cached, lookup or invalid: a row counts while it hasn't ended; without an end it has refresh_ms from now; impossible dates are invalid."""
    end = F.coalesce(expires, F.lit(now_ms + refresh_ms))
    return F.when(registered.isNull(), "lookup").when((registered > now_ms) | (registered >= end), "invalid").when(end > now_ms, "cached").otherwise("lookup")


def clean_rules(rules: DataFrame, now_ms: int, capacity: int) -> DataFrame:
    return evict(rules.filter(F.col("expires_at_ms") > now_ms), capacity, [F.col("expires_at_ms"), F.col("id")])


def command_tail(commands: DataFrame, at: str = "id", keep: int = 10) -> DataFrame:
    """The last `keep` commands with positions 1 to keep, oldest first; empty ones don't count."""
    last = commands.filter(F.trim("command") != "").orderBy(F.desc(at)).limit(keep)
    return last.select(F.row_number().over(Window.orderBy(at)).alias("position"), "command")  # at most `keep` rows


def bounded_lines(lines: DataFrame, line: str, order: str, rows: int = 1000, size: int = 1 << 20) -> DataFrame:
    """The first lines, at most `rows`, whose bytes with line ends add up to `size` at most."""
    first = lines.orderBy(order).limit(rows)
    total = F.sum(F.octet_length(line) + 1).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))  # at most `rows` rows
    return first.withColumn("bytes", total).filter(F.col("bytes") <= size)


def set_status(started_at_ms: int, mode: int, spark) -> DataFrame:  # noqa: ANN001
    return spark.range(1).select(F.lit(1).alias("id"), F.lit(started_at_ms).cast("long").alias("started_at_ms"), F.lit(mode).alias("mode"))
