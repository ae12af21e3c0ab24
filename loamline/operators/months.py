"""Calendars and parts of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_of(year: Column, month: Column) -> Column:
    """The first of the month. Only year and month are used, so days of other calendars never matter."""
    return F.make_date(year.cast("int"), month.cast("int"), F.lit(1))


def month_start(df: DataFrame, time_col: str = "time", out: str = "month") -> DataFrame:
    """Normalise times to month starts. A table without the column stays as it is; two stamps in a month stay two rows."""
    if time_col not in df.columns:
        return df
    t = F.col(time_col)
    return df.withColumn(out, month_of(F.year(t), F.month(t)))


def month_number(df: DataFrame, first_year: int, month_col: str = "month", out: str = "t") -> DataFrame:
    """Months since January of first_year."""
    m = F.col(month_col)
    return df.withColumn(out, ((F.year(m) - first_year) * 12 + F.month(m) - 1).cast("int"))


def between_months(df: DataFrame, first: str, last: str, month_col: str = "month") -> DataFrame:
    """Rows from first to last, both included; reaches the scan as a pushed filter."""
    return df.filter(F.col(month_col).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def first_months(df: DataFrame, n: int) -> DataFrame:
    return df.filter(F.col("t") < n)


def last_months(df: DataFrame, n: int, months: int) -> DataFrame:
    """months comes from the calendar, so that no scan is needed to find the end."""
    return df.filter(F.col("t") >= months - n)


def repair_last_month(df: DataFrame, months: int, keys: tuple[str, ...], value: str = "sm", raw: str | None = None, mode: str = "auto") -> DataFrame:
    """Replace the last month by the one before it.

    always: in every series. auto: only if the last month is missing everywhere (in ``raw``, an array of layers that is
    missing if all its entries are; else in ``value``). off: never.
    """
    if mode == "off":
        return df
    if mode not in ("auto", "always"):
        raise ValueError(f"no such mode: {mode}")
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy("t"))
    last = F.col("t") == months - 1
    if mode == "always":
        return df.withColumn(value, F.when(last, before).otherwise(F.col(value)))
    missing = F.col(value).isNull() if raw is None else ~F.coalesce(F.exists(raw, lambda x: x.isNotNull()), F.lit(False))
    gone = df.filter(last).agg(F.bool_and(missing).alias("_gone")).select(F.lit(months - 1).alias("t"), "_gone")  # one row
    return df.join(F.broadcast(gone), "t", "left").withColumn(value, F.when(F.col("_gone"), before).otherwise(F.col(value))).select(*df.columns)
