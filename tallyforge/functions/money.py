"""Money as bigint paise: basis points, rounding modes, parsing, formatting, proportional splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROUNDING = ("half_up", "half_even", "down", "up")


def quotient(a: Column, b: Column | int) -> Column:
    """Integer division that truncates toward zero, as bigint."""
    b = b if isinstance(b, Column) else F.lit(b)
    return ((a - a % b) / b).cast("long")


def apply_bps(paise: Column, bps: Column, mode: str = "half_up") -> Column:
    """bps ten-thousandths of an amount, rounded on the absolute value, so that both signs round alike."""
    if mode not in ROUNDING:
        raise ValueError(mode)
    product = F.abs(paise.cast("long")) * bps.cast("long")
    rest = product % 10_000
    whole = quotient(product, 10_000)
    more = {
        "half_up": rest >= 5_000,
        "half_even": (rest > 5_000) | ((rest == 5_000) & (whole % 2 == 1)),
        "down": F.lit(False),
        "up": rest > 0,
    }[mode]
    return (whole + more.cast("long")) * F.when(paise < 0, -1).otherwise(1)


def from_rupees(text: Column) -> Column:
    """Paise of a decimal string, half up; null if it is no number."""
    return F.round(text.try_cast("decimal(20,4)") * 100).cast("long")


def to_rupees(paise: Column) -> Column:
    magnitude = F.abs(paise)
    return F.concat(F.when(paise < 0, "-").otherwise(""), quotient(magnitude, 100).cast("string"), F.lit("."), F.lpad((magnitude % 100).cast("string"), 2, "0"))


def split_largest_remainder(parts: DataFrame, group: str, order: str, amount: str, weight: str) -> DataFrame:
    """Adds share: each group's amount split by weights, whole paise, leftovers to the largest remainders (ties to the first)."""
    total = F.sum(weight).over(Window.partitionBy(group))
    product = F.col(amount) * F.col(weight)
    rest = F.pmod(product, total)
    rows = parts.withColumn("_rest", rest).withColumn("_floor", ((product - rest) / total).cast("long"))
    left = F.col(amount) - F.sum("_floor").over(Window.partitionBy(group))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_rest"), order))
    return rows.withColumn("share", F.col("_floor") + (rank <= left).cast("long")).drop("_rest", "_floor")
