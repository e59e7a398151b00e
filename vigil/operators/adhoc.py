"""SELECT-only SQL with a forced row limit."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_LIMIT = 100
MAX_LIMIT = 1000


def check_select(sql: str, allow_with: bool = False) -> str:
    """The text without a trailing semicolon; anything but a query raises."""
    words = "select|with" if allow_with else "select"
    if not re.match(rf"\s*({words})\s", sql, re.IGNORECASE):
        raise ValueError("Only SELECT statements are allowed")
    return re.sub(r"\s*;\s*\Z", "", sql.strip())


def run_select(
    spark: SparkSession,
    sql: str,
    limit: float | None = DEFAULT_LIMIT,
    max_limit: int | None = MAX_LIMIT,
    allow_with: bool = False,
) -> DataFrame:
    """Run a query over the registered views and cut its result.

    The limit is put around the whole query, so a LIMIT inside a subquery does not lift
    it; with an ORDER BY the plan becomes a per-partition top n. `max_limit=None` is for
    callers that write the result to a table and want all of it.
    """
    result = spark.sql(check_select(sql, allow_with))
    wanted = DEFAULT_LIMIT if limit is None else int(limit)
    return result if max_limit is None else result.limit(max(0, min(wanted, max_limit)))


def envelope(
    spark: SparkSession, sql: str, limit: float | None = DEFAULT_LIMIT, max_limit: int = MAX_LIMIT
) -> DataFrame:
    """One row: the result rows as JSON, their number, and the limit. At most `max_limit` rows."""
    rows = run_select(spark, sql, limit, max_limit)
    applied = min(DEFAULT_LIMIT if limit is None else int(limit), max_limit)
    # the position keeps the order of the result, which a collected list need not
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())
    listed = F.array_sort(F.collect_list(F.struct("_at", F.struct(*rows.columns).alias("row"))))
    return numbered.agg(
        F.to_json(F.transform(listed, lambda r: r["row"])).alias("rows"),
        F.count(F.lit(1)).alias("score"),
        F.lit(applied).alias("limit"),
    )
