"""Limits, paging and capacity: newest rows, whole parents before joins, and eviction of the oldest by class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first `limit` rows and the column truncated: whether there were more. One row over the limit is read."""
    first = rows.orderBy(*order).limit(limit + 1)
    numbered = first.withColumn("position", F.row_number().over(Window.orderBy(*order)))  # at most limit + 1 rows
    more = F.max("position").over(Window.partitionBy()) > limit
    return numbered.withColumn("truncated", more).filter(F.col("position") <= limit)


def excess(count: Column, capacity: int) -> Column:
    return F.greatest(count - capacity, F.lit(0)).cast("long")


#: Equal-width bins of one pass, each a row for the driver.
BINS = 10_000
#: Stands for null in an order; real values are larger.
NULL_FIRST = -(1 << 62)


def keep_last(rows: DataFrame, order: Sequence[Column], limit: int, weight: Column | None = None, sorted_rows: int = 100_000) -> DataFrame:
    """Rows from the end of `order` while their weights (not negative, null as 0; by default 1) add up to `limit` at most.

    `order` are whole numbers, nulls first. The boundary is found by counting: weights are summed, on the
    map side, in equal-width bins of the leading column; the bin where the sum passes `limit` is divided
    again, or, if it is one value, by the next column, until at most `sorted_rows` rows are left, which one
    task orders. With a leading column of times that is one pass for the range, one for the bins and one
    for the last rows. Jobs run while the result is declared; they read a persisted copy of order and
    weight. Of rows that are equal in all of `order` and weight, so many stay as fit.
    """
    names = [f"__order{i}" for i in range(len(order))]
    whole = [F.coalesce(c.cast("long"), F.lit(NULL_FIRST)) for c in order]
    weighed = F.lit(1).cast("long") if weight is None else F.coalesce(weight.cast("long"), F.lit(0))
    names, whole = [*names, "__weight"], [*whole, weighed]
    keyed = rows.withColumns(dict(zip(names, whole, strict=True)))
    keys = keyed.select(names).persist()
    told = [F.count(F.lit(1)).alias("n"), F.sum("__weight").alias("w"), *[x for c in names for x in (F.min(c).alias(f"low{c}"), F.max(c).alias(f"high{c}"))]]
    above = lambda at, values, strict: _beyond(names[: at + 1], values, strict)
    try:
        pool, prefix, part = keys, [], keys.agg(*told).first()
        for at, name in enumerate(names):
            while True:
                low, high = part[f"low{name}"], part[f"high{name}"]
                if (part["w"] or 0) <= limit:
                    return rows if low is None else keyed.filter(above(at, [*prefix, low], False)).select(rows.columns)
                if part["n"] <= sorted_rows:
                    return _last_of(keyed, pool, names, limit, prefix, high, at).select(rows.columns)
                if low == high:
                    prefix.append(low)
                    break
                width = (high - low) // BINS + 1
                bins = pool.groupBy(F.expr(f"({name} - {low}L) DIV {width}L").alias("bin")).agg(*told).orderBy(F.desc("bin")).collect()
                for part in bins:  # noqa: B007
                    if part["w"] > limit:
                        break
                    limit -= part["w"]
                pool = pool.filter(F.col(name).between(part[f"low{name}"], part[f"high{name}"]))
        return _of_equals(keyed, names, prefix, limit // prefix[-1]).select(rows.columns)  # a weight of 0 would have fitted
    finally:
        keys.unpersist()


def _beyond(names: Sequence[str], values: Sequence[int], strict: bool) -> Column:
    """Whether the columns, compared one after another, are over the values (or equal to them, unless strict)."""
    out = F.lit(not strict)
    for name, value in zip(reversed(names), reversed(values), strict=True):
        out = (F.col(name) > value) | ((F.col(name) == value) & out)
    return out


def _of_equals(keyed: DataFrame, names: Sequence[str], values: Sequence[int], count: int) -> DataFrame:
    """The rows over the values, and `count` of those equal to them."""
    equal = F.lit(True)
    for name, value in zip(names, values, strict=True):
        equal = equal & (F.col(name) == value)
    over = keyed.filter(_beyond(names, values, True))
    return over.unionByName(keyed.filter(equal).limit(count)) if count else over


def _last_of(keyed: DataFrame, pool: DataFrame, names: list[str], limit: int, prefix: list[int], high: int, at: int) -> DataFrame:
    """keep_last where `pool`, a bounded number of rows, holds the boundary."""
    down = Window.orderBy(*[F.desc(n) for n in names]).rowsBetween(Window.unboundedPreceding, 0)
    fit = pool.withColumn("__sum", F.sum("__weight").over(down)).filter(F.col("__sum") <= limit).drop("__sum")
    edge = fit.groupBy(names).count().orderBy(names).first()
    if edge is None:
        return keyed.filter(_beyond(names[: at + 1], [*prefix, high], True))
    values = [edge[n] for n in names]
    same = pool.filter(F.struct(*names) == F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(names, values, strict=True)])).count()
    if same == edge["count"]:
        return keyed.filter(_beyond(names, values, False))
    return _of_equals(keyed, names, values, edge["count"])


def evict(rows: DataFrame, capacity: int, order: Sequence[Column], sorted_rows: int = 100_000) -> DataFrame:
    """The rows that stay when the first in `order` (whole numbers, nulls first) go until `capacity` are left; see keep_last."""
    return keep_last(rows, order, capacity, None, sorted_rows)


def newest(rows: DataFrame, keys: Sequence[str], at: str, count: int, tie: str = "id") -> DataFrame:
    """The newest `count` rows of each key, ties by the larger id."""
    order = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= count).drop("__rank")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """A new snapshot: of the rows of a key in old and new, that with the largest `version`; of equal ones the new.

    max_by runs with map-side partial aggregation, so a hot key is no hot task.
    """
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(old.columns).withColumn("__new", F.lit(1)))
    row = F.struct(*old.columns)
    picked = both.groupBy(*keys).agg(F.max_by(row, F.struct(version, "__new")).alias("__row"))
    return picked.select("__row.*").select(old.columns)


def cascade(children: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """The children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias("__parent")), F.col(key) == F.col("__parent"), "left_semi")


def bytes_until(rows: DataFrame, size: str, limit: int, order: Sequence[Column], sorted_rows: int = 100_000) -> DataFrame:
    """Rows from the end of `order` while their sizes add up to `limit` at most, such as files when the oldest go first; see keep_last.

    A null size adds nothing; before the first row with a size there is no sum, and such rows don't stay.
    """
    names = [f"__by{i}" for i in range(len(order))]
    keyed = rows.withColumns({n: F.coalesce(c.cast("long"), F.lit(NULL_FIRST)) for n, c in zip(names, order, strict=True)})
    unsized, newest = keyed.agg(F.count_if(F.col(size).isNull()), F.max(F.when(F.col(size).isNotNull(), F.struct(*names)))).first()
    if unsized:
        keyed = keyed.filter(~_beyond(names, list(newest), True)) if newest else keyed.limit(0)
    return keep_last(keyed, [F.col(n) for n in names], limit, F.col(size), sorted_rows).select(rows.columns)
