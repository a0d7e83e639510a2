"""The activity log: valid events, the summary of a period, and the report's derived figures."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCAN, IP, CORRESPONDENT, DOMAIN, ATTACHMENT, PROTECTED, BLOCKLIST, DOS, LIMIT, INCOMPLETE = range(1, 11)
ACCEPTED, REJECTED, TEMPFAILED, RESPONSE_FAILED = range(1, 5)

#: The outcomes that an event of each type may have.
ALLOWED = {
    SCAN: (1, 2, 3, 4),
    IP: (2, 4),
    CORRESPONDENT: (1, 4),
    DOMAIN: (1, 4),
    ATTACHMENT: (2, 4),
    PROTECTED: (2, 4),
    BLOCKLIST: (1, 2),
    DOS: (1, 2, 4),
    LIMIT: (1, 2, 4),
    INCOMPLETE: (1, 2, 4),
}

#: Counted pairs of event type and outcome, by the summary's name; blocklist rows count their quantity.
COUNTED = {
    "scan_rejections": (SCAN, REJECTED),
    "scan_accepted": (SCAN, ACCEPTED),
    "ip_rejections": (IP, REJECTED),
    "correspondent_accepts": (CORRESPONDENT, ACCEPTED),
    "trusted_domain_accepts": (DOMAIN, ACCEPTED),
    "attachment_rejections": (ATTACHMENT, REJECTED),
    "protected_rejections": (PROTECTED, REJECTED),
    "dos_rejections": (DOS, REJECTED),
    "dos_accepted": (DOS, ACCEPTED),
    "limit_rejections": (LIMIT, REJECTED),
    "limit_accepted": (LIMIT, ACCEPTED),
    "incomplete_rejections": (INCOMPLETE, REJECTED),
    "incomplete_accepted": (INCOMPLETE, ACCEPTED),
}


def is_valid(event_type: Column, outcome: Column) -> Column:
    """Whether an event of the type may have the outcome; false for unknown types, null for null."""
    out = F.lit(False)
    for kind, outcomes in ALLOWED.items():
        out = F.when(event_type == kind, outcome.isin(*outcomes)).otherwise(out)
    return F.when(event_type.isNotNull() & outcome.isNotNull(), out)


def window(now_ms: int, retention_ms: int, since_ms: int | None = None, before_ms: int | None = None) -> tuple[int, int]:
    """The half-open period [since, before), within retention and not after the clock."""
    oldest = now_ms - retention_ms
    since = oldest if since_ms is None else max(since_ms, oldest)
    return since, now_ms if before_ms is None else min(before_ms, now_ms)


def in_period(activity: DataFrame, since_ms: int, before_ms: int) -> DataFrame:
    return activity.filter((F.col("occurred_at_ms") >= since_ms) & (F.col("occurred_at_ms") < before_ms))


def summary_columns() -> list[Column]:
    """The summary's aggregates, for one global or any grouped aggregation with map-side sums."""
    kind, outcome = F.col("event_type"), F.col("outcome")
    block = kind == BLOCKLIST
    counts = [F.count_if((kind == k) & (outcome == o)).alias(n) for n, (k, o) in COUNTED.items()]
    return [
        F.count_if(kind == SCAN).alias("scan_total"),
        F.count_if((kind == SCAN) & F.col("analysis_failed")).alias("evaluations_failed"),
        *counts,
        F.coalesce(F.sum(F.when(block & (outcome == REJECTED), F.col("quantity"))), F.lit(0)).cast("long").alias("blocklist_rejections"),
        F.coalesce(F.sum(F.when(block & (outcome == ACCEPTED), F.col("quantity"))), F.lit(0)).cast("long").alias("blocklist_removals"),
        F.coalesce(F.sum(F.when(kind == SCAN, F.col("token_cost"))), F.lit(0.0)).alias("token_cost"),
    ]


def summarise(activity: DataFrame, since_ms: int, before_ms: int) -> DataFrame:
    """One row for the period; zeros where it has no events."""
    return in_period(activity, since_ms, before_ms).agg(*summary_columns())


def report(summary: DataFrame) -> DataFrame:
    """The summary with total_rejected, total_accepted and average_cost (null without scans)."""
    rejected = ["scan_rejections", "ip_rejections", "attachment_rejections", "protected_rejections", "blocklist_rejections", "limit_rejections", "dos_rejections", "incomplete_rejections"]
    accepted = ["scan_accepted", "correspondent_accepts", "trusted_domain_accepts", "limit_accepted", "dos_accepted", "incomplete_accepted"]
    total = lambda names: sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return summary.withColumns({"total_rejected": total(rejected), "total_accepted": total(accepted), "average_cost": F.try_divide("token_cost", "scan_total")})


def expired(activity: DataFrame, now_ms: int, retention_ms: int) -> DataFrame:
    """The rows that stay after expiry; there is no cap on their number."""
    return activity.filter(F.col("occurred_at_ms") >= now_ms - retention_ms)


def period_cutoff(now: Column, period: str) -> Column:
    """Start of a report period as a timestamp: day, week, calendar month or year before `now`; null for "all".

    A month back from a day that the earlier month lacks runs over into the next month (31 March less a
    month is 3 March, or 2 March in a leap year).
    """
    if period == "all":
        return F.lit(None).cast("timestamp")
    if period in ("day", "week"):
        return now - F.expr(f"INTERVAL {1 if period == 'day' else 7} DAYS")
    months = -1 if period == "month" else -12
    first = F.add_months(F.trunc(now.cast("date"), "month"), months)
    day = F.date_add(first, F.dayofmonth(now) - 1).cast("timestamp")
    return day + F.make_dt_interval(hours=F.hour(now), mins=F.minute(now), secs=F.expr("CAST(0 AS DECIMAL(18,6))") + F.date_part(F.lit("SECOND"), now))


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Cost of a call with prices per million tokens."""
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def outcome_of(action: Column, response_failed: Column) -> Column:
    """Outcome of a decision: a failed response counts before accept, reject and tempfail."""
    return F.when(response_failed, RESPONSE_FAILED).when(action == "reject", REJECTED).when(action == "tempfail", TEMPFAILED).otherwise(ACCEPTED)


def event_type_of(incomplete: Column, resource_limited: Column, limit_action: Column) -> Column:
    """Event type of an analysed message: incomplete inspection first, then a resource limit by its action, else a scan."""
    return F.when(incomplete, INCOMPLETE).when(resource_limited & (limit_action == "dos-reject"), DOS).when(resource_limited & (limit_action == "reject"), LIMIT).otherwise(SCAN)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name and n, the number of rows, of each table; each is counted on the map side."""
    parts = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in tables.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def comparison_report(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What two readings of the same messages have in common: totals (one row), by method and by category.

    `records` are category, metadata_complete, error, and methods: a map from method to struct<compared,
    outcome_match, details_match>. A message without an error counts as compared. A compared method whose
    outcomes don't match is different, one whose outcomes match and details don't is different in details,
    and so is a message that has such a method. Null flags are false, empty errors none. Maps are reduced
    within their row, so each report is one grouping with sums on the map side.
    """
    flag = lambda x, name: F.coalesce(x[name], F.lit(False))
    outcomes = lambda m: flag(m, "compared") & ~flag(m, "outcome_match")
    details = lambda m: flag(m, "compared") & flag(m, "outcome_match") & ~flag(m, "details_match")
    any_of = lambda rule: F.coalesce(F.exists(F.map_values("methods"), rule), F.lit(False))
    rows = records.select("category", "methods", F.coalesce("metadata_complete", F.lit(False)).alias("complete"), (F.coalesce("error", F.lit("")) != "").alias("failed"), any_of(outcomes).alias("different"), any_of(details).alias("detail_different"))
    n = F.count(F.lit(1)).alias("messages")
    totals = rows.agg(n, F.count_if(~F.col("failed")).alias("compared"), F.count_if(~F.col("complete")).alias("metadata_incomplete"), F.count_if("failed").alias("errors"), F.count_if("different").alias("different"), F.count_if("detail_different").alias("detail_different"))
    each = rows.select(F.explode("methods").alias("method", "m")).filter(flag(F.col("m"), "compared"))
    methods = each.groupBy("method").agg(F.count(F.lit(1)).alias("compared"), F.count_if(outcomes(F.col("m"))).alias("different"), F.count_if(details(F.col("m"))).alias("detail_different"))
    return totals, methods, rows.groupBy("category").agg(n, F.count_if("different").alias("different"), F.count_if("failed").alias("errors"))
