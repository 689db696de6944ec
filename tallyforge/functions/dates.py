"""Days as the ledger counts them: the first date that a record has, in Indian time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The zone of the books, and the columns that may date a record, in the order in which they count.
ZONE = "Asia/Kolkata"
DATES = ("captured_at", "created_at", "raised_at", "cycle_end")


def local_day(instant: Column) -> Column:
    """The day of an instant in ZONE, whatever the session's zone."""
    return F.to_date(F.from_utc_timestamp(F.to_utc_timestamp(instant, F.current_timezone()), ZONE))


def with_day(rows: DataFrame) -> DataFrame:
    """rows with day: that of the first of DATES which they have and which isn't null."""
    dated = [F.col(c) for c in DATES if c in rows.columns]
    return rows.withColumn("day", local_day(F.coalesce(*dated)))


def unix_seconds(seconds: Column) -> Column:
    """The instant of seconds since 1970."""
    return F.timestamp_seconds(seconds)
