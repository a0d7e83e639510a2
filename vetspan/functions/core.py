"""Building blocks of Column expressions and of Python tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def small_batches(df: DataFrame, limit: int = BATCH_BYTES) -> DataFrame:
    """The same rows; from now on the session sends Python about `limit` bytes (or one row) at once, whatever the lengths of texts."""
    df.sparkSession.conf.set(BATCH_KEY, str(limit))
    return df


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once; inside lambdas Spark computes a repeated expression each time it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def through_last(text: Column, mark: str) -> Column:
    """The text up to the last `mark`, with it; empty where there is none.

    A pattern that starts often and ends with `mark` reads from each start to the end of a text without
    one; inside this part every start has its end, so that all matches together read the text once.
    """
    back = F.instr(F.reverse(text), mark[::-1])
    return F.when(back > 0, F.left(text, F.length(text) - back + 1)).when(text.isNotNull(), "")


def without_end(text: Column, marks: str) -> Column:
    """The text without the characters of the class `marks` at its end; each run is read once."""
    return F.regexp_replace(text, f"(?<![{marks}])[{marks}]++$", "")
