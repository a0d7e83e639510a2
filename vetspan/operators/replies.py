"""Replies to administrators as text: the activity report, listings with a limit, and one rejection in full."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import duration_text, utc_text
from ..functions.text import byte_truncated
from .retention import page

#: What a period is called.
PERIODS = {"day": "past day", "week": "past week", "month": "past month", "year": "past year", "all": "all retained activity"}
#: Lines of the activity report with the columns that they show.
REJECTED = {
    "AI classification": "scan_rejections",
    "IP reputation": "ip_rejections",
    "Attachment policy": "attachment_rejections",
    "Protected sender-domain policy": "protected_rejections",
    "Sender blocklist": "blocklist_rejections",
    "Content processing resource limit": "limit_rejections",
    "Content processing DoS protection": "dos_rejections",
    "Incomplete inspection": "incomplete_rejections",
}
ACCEPTED = {
    "AI classification": "scan_accepted",
    "Correspondent whitelist": "correspondent_accepts",
    "Trusted sender domain": "trusted_domain_accepts",
    "Content processing resource limit (accept mode)": "limit_accepted",
    "Content processing DoS protection (accept mode)": "dos_accepted",
    "Incomplete inspection (accept mode)": "incomplete_accepted",
}
#: How a correspondent came to be trusted, and what stands behind cut listings.
ADDED = {"manual": "manually", "authenticated_outbound": "learned from authenticated outbound email", "repeated_legitimate_inbound": "learned from repeated legitimate inbound emails"}
LIMITED = "Results were limited to {} matching records.\n"
CUT = "\nCommand reply was truncated at 1 MiB.\n"


def activity_reply(report: DataFrame, period: str, now_ms: int, retention_ms: int, started_at_ms: int | None = None, accept_mode_of: str | None = None) -> DataFrame:
    """`reply` over the row of activity.report. started_at_ms is null without a service status; accept_mode_of names the service while it accepts all."""
    line = lambda words, *values: F.format_string(f"{words}\n", *values)
    counts = [F.col(n) for n in (*REJECTED.values(), *ACCEPTED.values(), "scan_total", "blocklist_removals")]
    rejections = F.greatest(*[F.col(n) for n in REJECTED.values()]) > 0
    parts = []
    if accept_mode_of:
        parts = [
            F.lit(f"{accept_mode_of} is running in accept mode. Scans completed in this mode are accepted even when the AI recommends rejection.\n"),
            F.when(rejections, "This period also contains rejections recorded in enforce mode.\n").otherwise(""),
            F.lit("\n"),
        ]
    known = started_at_ms is not None and started_at_ms <= now_ms
    uptime = duration_text(F.lit(now_ms - started_at_ms)) if known else F.lit("unavailable")
    parts += [line(f"Activity: {PERIODS[period]}"), line("Service uptime: %s", uptime), line("Retention: %s\n", duration_text(F.lit(retention_ms)))]
    parts.append(F.when(F.greatest(*counts) == 0, "No activity was recorded for this period.\n\n").otherwise(""))
    for title, total, lines in (("Total rejected", "total_rejected", REJECTED), ("Total accepted", "total_accepted", ACCEPTED)):
        parts += [line(f"{title}: %d", F.col(total)), *[line(f"  {words}: %d", F.col(n)) for words, n in lines.items()], F.lit("\n")]
    parts += [
        line("Recipient deliveries removed by sender blocklist: %d\n", F.col("blocklist_removals")),
        line("Total AI scans: %d", F.col("scan_total")),
        line("AI evaluations failed: %d\n", F.col("evaluations_failed")),
        F.lit("Token costs are estimates based on endpoint-reported usage and configured prices.\n"),
        line("Total token cost: USD %.4f", F.col("token_cost")),
        F.when(F.col("scan_total") == 0, "Average cost per message scanned: N/A (no scans)\n").otherwise(line("Average cost per message scanned: USD %.6f", F.col("average_cost"))),
    ]
    return report.select(F.concat(*parts).alias("reply"))


def _or(value: Column, other: str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", other).otherwise(value)


def rejection_record(recipients: Column) -> Column:
    """A rejection in a listing, of the columns id, sender, subject, rejected_at_ms, reason and an array of recipients."""
    return F.format_string("From: %s\nTo: %s\nSubject: %s\nDate: %s\nRejection ID: %d\nReason: %s\n\n", "sender", F.coalesce(F.array_join(recipients, ", "), F.lit("")), _or(F.col("subject"), "(no subject)"), utc_text(F.col("rejected_at_ms")), "id", _or(F.col("reason"), "Unavailable"))


def rejection_detail(recipients: Column, content: Column, body: Column, truncated: Column) -> Column:
    """A rejection in full. content is the archived message, null where there is none; body its visible text, null where it can't be read."""
    shown = F.when(F.trim(body) == "", "No readable message text was found.").otherwise(body)
    notice = F.when(F.coalesce(truncated, F.lit(False)), "NOTICE: Saved message was truncated during archiving; some headers or body content may be missing.\n\n").otherwise("")
    told = F.when(content.isNull(), "Saved message is not available.").when(body.isNull(), "Saved message is attached, but its body could not be processed.").otherwise(F.concat(notice, shown))
    return F.format_string("Rejection ID: %d\nFrom: %s\nTo: %s\nSubject: %s\nDate: %s\nReason for rejection: %s\n\nVisible email body text:\n%s\n", "id", "sender", F.coalesce(F.array_join(recipients, ", "), F.lit("")), _or(F.col("subject"), "(no subject)"), utc_text(F.col("rejected_at_ms")), _or(F.col("reason"), "Unavailable"), told)


def correspondent_record(with_recipient: bool) -> Column:
    how = F.lit("unknown")
    for kind, words in ADDED.items():
        how = F.when(F.col("whitelist_type") == kind, words).otherwise(how)
    recipient = F.format_string("Recipient: %s\n", "local_address") if with_recipient else F.lit("")
    return F.concat(F.format_string("Sender: %s\n", "correspondent"), recipient, F.format_string("Added: %s\n\n", how))


def rule_record() -> Column:
    pattern = F.concat(F.when(F.col("sender_kind") == 2, "*@").otherwise(""), "sender_value")
    return F.format_string("Sender: %s\nRecipient: %s\nExpires: %s\n\n", pattern, "recipient", utc_text(F.col("expires_at_ms")))


def block_record(hostname: Column | None = None) -> Column:
    """An active block; with a column of host names (null or empty: not found) where names were looked up."""
    shown = F.lit("") if hostname is None else F.format_string(" (%s)", _or(hostname, "not found"))
    return F.concat(F.format_string("IP: %s", "ip"), shown, F.format_string(" Type: %s Expires: %s\n", "block_level", utc_text(F.col("blocked_until_ms"))))


def listing(rows: DataFrame, order: Sequence[Column], record: Column, empty: str, limit: int = 1000, newest_last: bool = False, size: int = 1 << 20) -> DataFrame:
    """`reply`: one row with the first `limit` records, from the last to the first with newest_last; a notice says if there were more.

    At most `size` bytes: records that don't fit are cut, at whole characters, with a notice. Only limit + 1
    rows come together.
    """
    first = page(rows, order, limit).select("position", "truncated", record.alias("record"))
    ends = F.struct(F.sort_array(F.collect_list(F.struct((-F.col("position") if newest_last else F.col("position")).alias("at"), "record"))).alias("all"), F.coalesce(F.max("truncated"), F.lit(False)).alias("more"))
    joined = first.agg(ends.alias("e")).select(F.array_join(F.transform("e.all", lambda r: r["record"]), "").alias("text"), "e.more")
    text = F.when(F.col("text") == "", empty).otherwise(F.concat("text", F.when(F.col("more"), LIMITED.format(limit)).otherwise("")))
    return joined.select(text.alias("text")).select(_bounded(F.col("text"), size).alias("reply"))


def _bounded(text: Column, size: int) -> Column:
    return F.when(F.octet_length(text) <= size, text).otherwise(F.concat(byte_truncated(text, size - len(CUT)), F.lit(CUT)))
