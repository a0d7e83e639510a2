"""Changes that belong to several tables at once, and the clean-up of all of them, over snapshots that are published together."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Snapshots, stored
from . import blocklist, correspondents, histories, reputation
from .retention import upsert

DAY = 86_400_000


@dataclass(frozen=True)
class Retention:
    """What the clean-up keeps."""

    reputation: reputation.ReputationPolicy = field(default_factory=reputation.ReputationPolicy)
    trust: correspondents.TrustPolicy = field(default_factory=correspondents.TrustPolicy)
    rejections_ms: int = 30 * DAY
    rejections: int = 100_000
    domains_grace_ms: int = 30 * DAY
    domains: int = 100_000
    rules: int = 100_000


def steps(policy: Retention, now_ms: int) -> dict:
    """The parts of the clean-up in their order: name to a function of all tables that gives those it changes."""

    def addresses(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        rows, strikes = reputation.clean(t["reputation"], t["strikes"], policy.reputation, now_ms)
        return {"reputation": rows, "strikes": strikes}

    def rejections(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        rows, children = histories.clean_rejections(t["rejections"], t["rejection_recipients"], now_ms, policy.rejections_ms, policy.rejections)
        return {"rejections": rows, "rejection_recipients": children}

    return {
        "reputation": addresses,
        "correspondents": lambda t: {"correspondents": correspondents.clean(t["correspondents"], policy.trust, now_ms)},
        "rejections": rejections,
        "domains": lambda t: {"domains": histories.clean_domains(t["domains"], now_ms, policy.domains_grace_ms, policy.domains)},
        "blocklist": lambda t: {"blocklist": histories.clean_rules(t["blocklist"], now_ms, policy.rules)},
    }


def clean_all(tables: dict[str, DataFrame], policy: Retention, now_ms: int) -> tuple[dict[str, DataFrame], dict[str, tuple[int, int]], dict[str, Exception]]:
    """The tables that the clean-up changes, (removed, left) of each, and the errors of parts that failed.

    Parents are cleaned before their children. A part that fails changes none of its tables and doesn't
    keep the others from running. What a part gives is written once, so that rows are counted and published
    from what was decided, not decided again.
    """
    changed, counts, failed = {}, {}, {}
    for name, step in steps(policy, now_ms).items():
        try:
            new = {table: stored(rows, f"clean-{table}") for table, rows in step(tables).items()}
            told = {table: (tables[table].count(), rows.count()) for table, rows in new.items()}
        except Exception as error:  # noqa: BLE001  told to the caller when all parts have run
            failed[name] = error
            continue
        changed |= new
        counts |= {table: (before - left, left) for table, (before, left) in told.items()}
    return changed, counts, failed


def clean_snapshot(snapshots: Snapshots, policy: Retention, now_ms: int) -> dict[str, tuple[int, int]]:
    """Clean all tables of the last version and publish the next one, in which all are clean; gives (removed, left) of each table.

    Where parts fail the others are published all the same, and the first error is raised afterwards.
    """
    base = snapshots.versions()[-1]
    changed, counts, failed = clean_all(snapshots.read(base), policy, now_ms)
    if changed:
        snapshots.publish(changed, based_on=base)
    if failed:
        name, error = next(iter(failed.items()))
        raise RuntimeError(f"clean-up of {', '.join(failed)} failed; of {name}") from error
    return counts


def add_rejections(snapshots: Snapshots, new: DataFrame) -> int:
    """Add rejections (with an array column recipients) and the rows of their recipients in one version; only new rows are written."""
    rows = stored(new, "rejections")
    parents, children = histories.add_rejections(rows)
    return snapshots.publish({}, appended={"rejections": parents, "rejection_recipients": children})


def block_senders(snapshots: Snapshots, rules: DataFrame, now_ms: int) -> int:
    """Add rules, of equal ones the one that ends last, and take away the trust that exact ones contradict, in one version."""
    with_rules = lambda old: upsert(old, rules, ["recipient", "sender_kind", "sender_value"], "expires_at_ms")
    with snapshots.change() as t:
        t["blocklist"] = with_rules(t["blocklist"])
        t["correspondents"] = blocklist.without_trust(t["correspondents"], rules, now_ms)
    return snapshots.versions()[-1]


def trust_senders(snapshots: Snapshots, rows: DataFrame) -> int:
    """Add correspondents, of equal pairs the one last active, and take away exact rules of those recipients against them, in one version.

    Rules for domains and for everyone stay.
    """
    with snapshots.change() as t:
        t["correspondents"] = upsert(t["correspondents"], rows, ["local_address", "correspondent"], "last_activity_at_ms")
        t["blocklist"] = blocklist.without_rules(t["blocklist"], rows.withColumn("local_address", F.lower("local_address")))
    return snapshots.versions()[-1]
