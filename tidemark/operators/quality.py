"""Health of sources from their runs, and sanity rules over what a run kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timex import clock, london, london_date

HISTORY, ZERO_AVERAGE, DROP_HISTORY, DROP_AVERAGE, DROP_SHARE = 5, 2, 3, 5, 0.4
JUMP_POINTS, JUMP_HISTORY, JUMP_KEPT = 30, 3, 5
SAME_DATE, EXAMPLES = 5, 5


def with_history(runs: DataFrame) -> DataFrame:
    """Add n_history and average over the last five ok runs before each run; runs that weren't ok take no place.

    The five counts are lags that pass over other runs, so a source is one sort and a row holds five numbers.
    """
    held = [F.expr(f"lag(CASE WHEN ok THEN found END, {n}) IGNORE NULLS OVER (PARTITION BY source_id ORDER BY run_day)") for n in range(1, HISTORY + 1)]
    runs = runs.withColumn("history", F.filter(F.array(*held), lambda x: x.isNotNull())).withColumn("n_history", F.size("history"))
    total = F.aggregate("history", F.lit(0).cast("long"), lambda a, x: a + x)
    return runs.withColumn("average", F.when(F.col("n_history") > 0, total / F.col("n_history"))).drop("history")


def zero_events() -> Column:
    return F.col("ok") & (F.col("found") == 0) & F.coalesce(F.col("average") >= ZERO_AVERAGE, F.lit(False))


def count_drop() -> Column:
    return F.col("ok") & (F.col("found") > 0) & (F.col("n_history") >= DROP_HISTORY) & F.coalesce((F.col("average") >= DROP_AVERAGE) & (F.col("found") < F.col("average") * DROP_SHARE), F.lit(False))


def consecutive_errors(runs: DataFrame) -> DataFrame:
    """Add failing: this run and the one before both weren't ok."""
    order = Window.partitionBy("source_id").orderBy("run_day")
    return runs.withColumn("failing", ~F.col("ok") & F.coalesce(~F.lag("ok").over(order), F.lit(False)))


def health_status(skipped: Column, broken: Column, never_ran: Column, degraded: Column) -> Column:
    return F.when(skipped, "skipped").when(broken, "broken").when(never_ran, "pending").when(degraded, "degraded").otherwise("healthy")


def end_before_start() -> Column:
    return F.coalesce(F.col("ends_at") < F.col("starts_at"), F.lit(False))


def year_out_of_range(now: Column) -> Column:
    return (F.col("starts_at") < now - F.expr("INTERVAL 365 DAYS")) | (F.col("starts_at") > now + F.expr("INTERVAL 1095 DAYS"))


def long_span() -> Column:
    return F.coalesce(F.col("ends_at") > F.col("starts_at") + F.expr("INTERVAL 365 DAYS"), F.lit(False))


def midnight_not_all_day() -> Column:
    return ~F.col("all_day") & (clock(F.col("starts_at")) == "00:00")


def duplicate_titles(df: DataFrame) -> DataFrame:
    """(title, day, n) of titles that start more than once on a London day."""
    return df.groupBy("title", london_date(F.col("starts_at")).alias("day")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def same_date(df: DataFrame, key: str) -> DataFrame:
    """(key, kept) of groups of SAME_DATE events or more that all start on one London day."""
    day = london_date(F.col("starts_at"))
    days = df.groupBy(key).agg(F.count(F.lit(1)).alias("kept"), F.min(day).alias("_first"), F.max(day).alias("_last"))
    return days.filter((F.col("kept") >= SAME_DATE) & (F.col("_first") == F.col("_last"))).select(key, "kept")


def finding_examples(df: DataFrame, rule: Column, order: str, most: int = EXAMPLES) -> DataFrame:
    """(affected, examples) of the rows that break a rule: their number, and of the first by `order` id, title and London
    start and end. One row; only `most` rows are ever gathered."""
    hits = df.filter(rule)
    when = lambda c: F.date_format(london(F.col(c)), "yyyy-MM-dd HH:mm")
    first = hits.orderBy(order).limit(most).agg(F.array_sort(F.collect_list(F.struct(order, "title", when("starts_at").alias("starts_at"), when("ends_at").alias("ends_at")))).alias("examples"))
    return hits.agg(F.count(F.lit(1)).alias("affected")).crossJoin(first)  # one row each


def missing_jump(df: DataFrame, share: str) -> DataFrame:
    """Add jump: a run with enough kept lies 30 points or more above the mean of the last five runs."""
    order = Window.partitionBy("source_id").orderBy("run_day").rowsBetween(-HISTORY, -1)
    enough = (F.col("kept") >= JUMP_KEPT) & (F.count(share).over(order) >= JUMP_HISTORY)
    return df.withColumn("jump", F.coalesce(enough & (F.col(share) - F.avg(share).over(order) >= JUMP_POINTS), F.lit(False)))


def due_reason(now: Column, rules: Column) -> Column:
    """Why a source's check is due: first, code changed, weekly, new rule, or null."""
    new = F.size(F.array_except(rules, F.coalesce("checked_rules", F.array().cast("array<string>")))) > 0
    return (
        F.when(F.col("checked_at").isNull(), "first").when(F.col("checked_version") != F.col("version"), "code changed")
        .when(F.col("checked_at") <= now - F.expr("INTERVAL 7 DAYS"), "weekly").when(new, "new rule")
    )


def issue_actions(latest: DataFrame, open_issues: DataFrame) -> DataFrame:
    """(source_id, action) from each source's latest run (source_id, tripped, clean) and the open issues (source_id): one
    issue a source at most, closed by a clean run."""
    held = open_issues.select("source_id").distinct().withColumn("_open", F.lit(True))
    joined = latest.join(held, "source_id", "left").withColumn("_open", F.coalesce("_open", F.lit(False)))
    action = F.when(F.col("tripped"), F.when(F.col("_open"), "already open").otherwise("open")).when(~F.col("clean"), "degraded").when(F.col("_open"), "close").otherwise("healthy")
    return joined.select("source_id", action.alias("action"))


def alert_latch(state: DataFrame, raised: DataFrame, now: Column) -> DataFrame:
    """(key, active_since): alerts raised anew keep the time at which they first became active, others are cleared."""
    joined = raised.select("key").distinct().withColumn("_raised", F.lit(True)).join(state, "key", "full")
    return joined.select("key", F.when(F.col("_raised"), F.coalesce("active_since", now)).alias("active_since"))
