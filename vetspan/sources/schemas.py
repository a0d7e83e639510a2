"""Schemas of the state tables, by version, and the migration of old activity rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 6


def _table(text: str) -> T.StructType:
    """Columns "name type", with "!" behind the type of a column that is never null."""
    fields = []
    for part in text.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, T._parse_datatype_string(kind.rstrip("!")), not kind.endswith("!")))
    return T.StructType(fields)


TABLES = {
    "ip_reputation": "id bigint!, ip string!, block_level string, blocked_until_ms bigint, legitimate_count int!, last_activity_at_ms bigint!",
    "ip_strikes": "id bigint!, ip_reputation_id bigint!, struck_at_ms bigint!",
    "correspondents": "id bigint!, local_address string!, correspondent string!, learned_at_ms bigint!, last_activity_at_ms bigint!, whitelist_type string!, legitimate_email_count int!",
    "rejections": "id bigint!, sender string!, subject string!, rejected_at_ms bigint!, reason string!",
    "rejection_recipients": "rejection_id bigint!, recipient string!",
    "domain_registrations": "id bigint!, domain string!, registered_at_ms bigint!, expires_at_ms bigint!",
    "activity": "id bigint!, occurred_at_ms bigint!, event_type int!, outcome int!, analysis_failed boolean, token_cost double, quantity bigint!",
    "service_status": "id int!, started_at_ms bigint!, mode int!",
    "command_history": "position int!, command string!",
    "sender_blocklist": "id bigint!, recipient string!, sender_kind int!, sender_value string!, expires_at_ms bigint!",
}


def schema(table: str) -> T.StructType:
    return _table(TABLES[table])


def migrate_activity(rows: DataFrame, version: int) -> DataFrame:
    """Activity rows of version 4 or 5 in the form of version 6; newer versions are an error.

    Version 4 has neither quantity nor nulls: quantity becomes 1, and analysis_failed and token_cost
    are kept for scans only.
    """
    if version > VERSION:
        raise ValueError(f"the tables have version {version}; this library knows {VERSION}")
    have = set(rows.columns)
    scan = F.col("event_type") == 1
    wanted = {
        "quantity": F.col("quantity") if "quantity" in have else F.lit(1),
        "analysis_failed": F.when(scan, F.coalesce(F.col("analysis_failed").cast("boolean"), F.lit(False))),
        "token_cost": F.when(scan, F.coalesce(F.col("token_cost"), F.lit(0.0))),
    }
    return rows.select([wanted.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema("activity")])
