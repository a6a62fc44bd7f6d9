"""Rate limits, quotas, budgets and slots over streams of requests, in batch form."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


def tumbling(df: DataFrame, time: str, width: str, *keys: str) -> DataFrame:
    """(window start, keys, n) per fixed window."""
    return df.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def within_last(df: DataFrame, key: str, time: str, seconds: int, name: str) -> DataFrame:
    """Add the number of the key's rows in the last so many seconds, this one included."""
    order = Window.partitionBy(key).orderBy(F.unix_micros(time)).rangeBetween(-seconds * 1_000_000, Window.currentRow)
    return df.withColumn(name, F.count(F.lit(1)).over(order))


def slots(df: DataFrame, key: str, time: str, spacing: int, tie: str) -> DataFrame:
    """Add slot: seconds at which each request of a key may start, `spacing` apart; a running maximum, not a loop."""
    order = Window.partitionBy(key).orderBy(time, tie)
    n = F.row_number().over(order) - 1
    start = F.unix_seconds(time)
    free = F.max(start - n * spacing).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("slot", free + n * spacing)


def daily_quota(df: DataFrame, key: str, time: str, cap: int, tie: str) -> DataFrame:
    """Add allowed: the first `cap` rows of each key and day."""
    order = Window.partitionBy(key, F.to_date(time)).orderBy(time, tie)
    return df.withColumn("allowed", F.row_number().over(order) <= cap)


def budget_gate(df: DataFrame, key: str, time: str, cost: str, cap: int, tie: str) -> DataFrame:
    """Add allowed: rows of a key up to the first that would take the sum over the cap."""
    order = Window.partitionBy(key).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("allowed", F.sum(cost).over(order) <= cap)


def limiter(df: DataFrame, key: str, time: str, seconds: int, most: int, tie: str) -> DataFrame:
    """Add allowed: fewer than `most` requests of the key were allowed in the `seconds` before; denied ones take no place.

    Whether one is allowed depends on those before it, so a key's requests are walked in order, in Arrow batches of sorted
    partitions; what is held in memory is the last `most` allowed times.
    """
    schema = df.schema.add("allowed", BooleanType())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = object(), deque()
        for frame in frames:
            allowed = []
            for name, at in zip(frame[key], frame[time]):
                if name != current:
                    current, held = name, deque()
                while held and held[0] <= at - pd.Timedelta(seconds=seconds):
                    held.popleft()
                allowed.append(len(held) < most)
                if allowed[-1]:
                    held.append(at)
            yield frame.assign(allowed=allowed)

    return df.repartition(key).sortWithinPartitions(key, time, tie).mapInPandas(run, schema)
