"""Scores, sort orders and keyset pages of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timex import london_date

RICH_FROM, RICH_RUN, FULLEST = 5, 2, 15


def richness() -> Column:
    text = F.col("description_length")
    return (
        F.when(F.col("has_thumbnail"), 3).otherwise(0) + F.when(text >= 120, 2).when(text >= 40, 1).otherwise(0) + F.when(F.col("has_note"), 1).otherwise(0)
        + F.when(F.col("hours").isNotNull() | F.col("is_free") | F.col("price_min").isNotNull(), 1).otherwise(0)
    )


def fullness() -> Column:
    place = F.col("venue_id").isNotNull() | (F.col("lat").isNotNull() & F.col("lng").isNotNull())
    return F.when(F.col("has_thumbnail"), 8).otherwise(0) + F.when(F.col("description_length") > 0, 4).otherwise(0) + F.when(F.col("is_free") | F.col("price_min").isNotNull(), 2).otherwise(0) + F.when(place, 1).otherwise(0)


def day_in_window(since: Column) -> Column:
    """The listing's day: of its next session, or its first day, but not before the window's."""
    days = F.filter(F.transform("sessions", lambda s: london_date(s["starts_at"])), lambda d: d >= since)
    return F.coalesce(F.array_min(days), F.greatest(london_date(F.col("starts_at")), since))


def with_slots(df: DataFrame, since: Column) -> DataFrame:
    """Add day and slot of the order that puts two rich listings before each plain one, day by day."""
    df = df.withColumns({"day": day_in_window(since), "rich": richness() >= RICH_FROM})
    n = F.row_number().over(Window.partitionBy("day", "rich").orderBy("starts_at", "id"))
    return df.withColumn("slot", F.when(F.col("rich"), n + F.floor((n - 1) / RICH_RUN)).otherwise(n * (RICH_RUN + 1)).cast("long"))


def shuffled(id_column: str, seed_day: str) -> Column:
    return F.md5(F.concat(F.col(id_column).cast("string"), F.lit(seed_day)))


def after(keys: list[tuple[str, object, bool]]) -> Column:
    """Rows beyond a cursor: (column, value, descending) in order of the sort, spelled out so that it reaches the scan."""
    out, equal = F.lit(False), F.lit(True)
    for name, value, descending in keys:
        value = value if isinstance(value, Column) else F.lit(value)
        out = out | (equal & (F.col(name) < value if descending else F.col(name) > value))
        equal = equal & (F.col(name) == value)
    return out


def page(df: DataFrame, order: list[tuple[str, bool]], limit: int, cursor: list | None = None) -> DataFrame:
    """The next `limit` rows and one more, which tells whether another page follows."""
    if cursor is not None:
        df = df.filter(after([(name, value, descending) for (name, descending), value in zip(order, cursor)]))
    return df.orderBy(*[F.col(n).desc() if d else F.col(n).asc() for n, d in order]).limit(limit + 1)


def first_rows(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows of an order with their position from 1: a top-k, then numbers for its few rows."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))
