"""Text lists and the archive of messages by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import is_dns_name
from .tables import stored


def read_domain_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case domains of a text file; blank lines and what follows # don't count, other lines are an error."""
    lines = spark.read.text(path).select(F.lower(F.trim(F.regexp_replace("value", "#.*$", ""))).alias("domain")).filter("domain <> ''")
    if wrong := lines.filter(~is_dns_name(F.col("domain"))).limit(1).collect():
        raise ValueError(f"{wrong[0].domain!r} is no domain name")
    return lines.distinct()


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """name, target of the lines "name: target" whose names have one local target in their last definition."""
    rows = spark.read.option("wholetext", False).text(path).withColumn("n", F.monotonically_increasing_id())
    parts = rows.filter(F.col("value").rlike(r"^[^#\s][^:]*:")).select("n", F.lower(F.trim(F.split_part("value", F.lit(":"), F.lit(1)))).alias("name"), F.trim(F.regexp_replace("value", r"^[^:]*:", "")).alias("target"))
    last = parts.groupBy("name").agg(F.max_by("target", "n").alias("target"))
    return last.filter(F.col("target").rlike(r'^[A-Za-z0-9._+\-]+(@[A-Za-z0-9.\-]+)?$'))


def alias_owner(aliases: DataFrame, names: DataFrame) -> DataFrame:
    """name, owner: the end of the chain of aliases from each name, however long; names that run into a cycle have no row.

    Pointers are doubled: a round joins the aliases that haven't reached an end with the aliases they
    point to and takes over where those point, so a chain of n takes about log2(n) rounds. Aliases that
    have reached an end aren't joined again. What is on its way when no chain can be that long is in, or
    leads to, a cycle. `aliases` has one row a name; equal rows count once, null names and targets don't.
    """
    edges = aliases.select(F.lower("name").alias("name"), F.lower("target").alias("owner")).dropna().distinct()
    ends = edges.select(F.col("name").alias("__name"))
    start = edges.join(ends, F.col("owner") == F.col("__name"), "left").select("name", "owner", F.col("__name").isNull().alias("done"))
    pointers = stored(start, "aliases")
    rounds = max(pointers.count() - 1, 1).bit_length() + 1
    for _ in range(rounds):
        open_ = pointers.filter("NOT done")
        if open_.isEmpty():
            break
        there = pointers.select(F.col("name").alias("__at"), F.col("owner").alias("__owner"), F.col("done").alias("__done"))
        moved = open_.join(there, F.col("owner") == F.col("__at")).select("name", F.col("__owner").alias("owner"), F.col("__done").alias("done"))
        pointers = stored(pointers.filter("done").unionByName(moved), "aliases")
    known = pointers.select(F.col("name").alias("__name"), F.col("owner").alias("__owner"), F.col("done").alias("__done"))
    asked = names.select("name", F.lower("name").alias("__asked")).join(known, F.col("__asked") == F.col("__name"), "left")
    return asked.filter(F.coalesce("__done", F.lit(True))).select("name", F.coalesce("__owner", "__asked").alias("owner"))


def day_parts(at_ms: Column) -> list[Column]:
    at = F.timestamp_millis(at_ms)
    return [F.date_format(at, p).alias(n) for n, p in (("y", "yyyy"), ("m", "MM"), ("d", "dd"))]


def write_archive(messages: DataFrame, folder: str) -> None:
    """Append id, at_ms, content (binary) under y=/m=/d= folders, so that reads by time and expiry touch whole folders."""
    messages.select("id", "at_ms", "content", *day_parts(F.col("at_ms"))).write.mode("append").partitionBy("y", "m", "d").parquet(folder)


def read_archived(spark: SparkSession, folder: str, id_: int, at_ms: int, limit: int) -> DataFrame:
    """The archived message of an id and time, at most `limit` bytes of it; only its day's folder is read."""
    rows = spark.read.option("basePath", folder).schema("id long, at_ms long, content binary, y string, m string, d string").parquet(folder)
    y, m, d = spark.range(1).select(*day_parts(F.lit(at_ms))).first()
    own = rows.filter((F.col("y") == y) & (F.col("m") == m) & (F.col("d") == d) & (F.col("id") == id_) & (F.col("at_ms") == at_ms))
    return own.select("id", "at_ms", F.substring("content", 1, limit).alias("content"), (F.octet_length("content") > limit).alias("truncated"))


def archive_size(spark: SparkSession, folder: str) -> DataFrame:
    """Days of the archive with their messages and bytes."""
    rows = spark.read.schema("id long, at_ms long, content binary, y string, m string, d string").parquet(folder)
    return rows.groupBy("y", "m", "d").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.octet_length("content")).alias("bytes"))


def expired_days(days: DataFrame, cutoff_ms: int) -> DataFrame:
    """The day folders whose date is before the cutoff's date."""
    date = F.make_date(F.col("y").cast("int"), F.col("m").cast("int"), F.col("d").cast("int"))
    return days.filter(date < F.timestamp_millis(F.lit(cutoff_ms)).cast("date"))
