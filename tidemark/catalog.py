"""Listings, venues, sources and runs as views of the test tables.

A listing is an order, a venue a customer, a source a supplier; instants are UTC timestamps, calendar rules use London
wall-clock time. Money is in whole pence. Everything is a projection of the tables, so scans prune columns and filters
reach them; the lines of an order are joined only where titles, prices, tags or sources are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timex import london, utc

CATEGORIES = ["workshop", "talk", "expo", "exhibition", "community", "music"]
VENUE_TYPES = ["museum", "commercial_gallery", "artist_run", "community", "other"]
MUSIC_TAGS = ["classical", "contemporary", "experimental", "jazz", "sound_art"]
GOOD_FOR = ["dates", "families", "groups"]
SEGMENTS = {"AUTOMOBILE": "museum", "BUILDING": "commercial_gallery", "FURNITURE": "artist_run", "HOUSEHOLD": "community", "MACHINERY": "other"}

#: The instants at which queries over listings and over events look.
NOW, EVENTS_NOW = "1998-06-15 12:00:00", "2024-01-15 12:00:00"


#: No listing ends later after its order's date, in days.
LONGEST = 62


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, with its timestamps as instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def opening_hours() -> Column:
    """One of three schedules or none, by venue."""
    rule = lambda days, opens, closes: F.struct(F.array(*map(F.lit, days)).alias("days"), F.lit(opens).alias("opens"), F.lit(closes).alias("closes"))
    kind = F.col("o_custkey") % 4
    return (
        F.when(kind == 0, F.array(rule([1, 2, 3, 4, 5], "10:00", "18:00"), rule([6, 7], "11:00", "17:00")))
        .when(kind == 1, F.array(rule([3, 4, 5, 6, 7], "12:00", "20:00")))
        .when(kind == 2, F.array(rule([4, 5, 6], "10:00", "21:00")))
    )


def pick(values: list[str], number: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), number.cast("int"))


def order_lines(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """(id, title, price_min, price_max, mediums, formats) of orders that have lines; of these orders only, if given."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    if orders is not None:
        lines = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    pence = F.floor(F.round(F.col("l_extendedprice") * 100) / 1000).cast("long")
    return (
        lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy(F.col("l_orderkey").alias("line_order"))
        .agg(F.min("p_name").alias("title"), F.min(pence).alias("price_min"), F.max(pence).alias("price_max"), F.sort_array(F.collect_set("p_brand")).alias("mediums"), F.sort_array(F.collect_set("p_type")).alias("formats"))
    )


def listings(spark: SparkSession, sf_dir: str, lines: bool = False, since: str | None = None, until: str | None = None) -> DataFrame:
    """One row per listing; with lines also title, prices and tags.

    since and until are days that the caller filters by: orders that can't overlap them are left out by their date, so that
    lines are joined and grouped for the orders at hand only.
    """
    o = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date").cast("timestamp")
    all_day = o % 3 == 0
    start = F.when(all_day, day).otherwise(day + F.make_dt_interval(hours=(F.lit(9) + o % 14).cast("int")))
    end_day = day + F.make_dt_interval(days=(o % 60).cast("int"))
    end = F.when(o % 4 == 0, None).when(all_day, end_day).otherwise(end_day + F.expr("INTERVAL 23 HOURS"))
    many = (o % 7 == 0) & ~all_day
    session = lambda k: F.struct(utc(start + F.make_dt_interval(days=k * 7)).alias("starts_at"), utc(start + F.make_dt_interval(days=k * 7, hours=F.lit(2))).alias("ends_at"))
    sessions = F.when(many, F.transform(F.sequence(F.lit(0), (F.lit(1) + o % 5).cast("int")), session))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    date = F.col("o_orderdate")
    if since:
        orders = orders.filter(date >= F.date_sub(F.lit(since).cast("date"), LONGEST).cast(orders.schema["o_orderdate"].dataType))
    if until:
        orders = orders.filter(date < F.date_add(F.lit(until).cast("date"), 2).cast(orders.schema["o_orderdate"].dataType))
    pruned = orders if since or until else None
    orders = orders.withColumn("o_orderdate", date.cast("timestamp"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    kinds = F.create_map(*[F.lit(x) for pair in SEGMENTS.items() for x in pair])
    df = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    df = df.withColumn("sessions", sessions)
    out = df.select(
        o.alias("id"), F.col("o_custkey").alias("venue_id"), F.col("c_name").alias("venue"),
        F.coalesce(F.get("sessions", F.lit(0))["starts_at"], utc(start)).alias("starts_at"),
        F.coalesce(F.element_at("sessions", -1)["ends_at"], utc(end)).alias("ends_at"),
        all_day.alias("all_day"), "sessions", F.when(all_day, opening_hours()).alias("hours"), pick(CATEGORIES, o % 6).alias("category"),
        (o % 11 == 0).alias("is_free"), F.when(o % 10 == 9, "EUR").when(o % 3 != 1, "GBP").alias("currency"),
        F.col("n_name").alias("borough"), kinds[F.col("c_mktsegment")].alias("venue_type"),
        (F.lit(51.28) + (F.col("o_custkey") % 420) / 1000).alias("lat"), (F.lit(-0.52) + (F.col("o_custkey") * 7 % 860) / 1000).alias("lng"),
        F.filter(F.array(*[F.when(o % (n + 2) == 0, F.lit(g)) for n, g in enumerate(GOOD_FOR)]), lambda x: x.isNotNull()).alias("good_for"),
        F.when(o % 6 == 5, F.array_sort(F.array_distinct(F.array(pick(MUSIC_TAGS, o % 5), pick(MUSIC_TAGS, F.floor(o / 7) % 5))))).otherwise(F.array().cast("array<string>")).alias("music"),
        F.when(F.col("o_custkey") % 9 == 0, F.array(F.lit("art_pass"))).otherwise(F.array().cast("array<string>")).alias("memberships"),
        (o * 37 % 300).alias("description_length"), (o % 2 == 0).alias("has_image"), (o % 4 == 2).alias("has_thumbnail"), (o % 8 == 1).alias("has_note"),
        (o % 13 == 0).alias("late_opening"), (o % 17 == 0).alias("opening_tag"), (o % 19 == 0).alias("workshop_tag"),
    )
    if lines:
        more = order_lines(spark, sf_dir, pruned)
        out = out.join(more, out["id"] == more["line_order"], "left").drop("line_order")
        out = out.withColumns({"title": F.coalesce("title", F.lit("untitled")), **{c: F.coalesce(c, F.array().cast("array<string>")) for c in ("mediums", "formats")}})
    return out


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, source_key, kind) of every source."""
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(s.alias("source_id"), F.concat(F.lit("source-"), s.cast("string")).alias("source_key"), pick(["api", "scraper", "aggregator"], s % 3).alias("kind"))


def event_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source_id, first_seen): which sources list a listing, and since when."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    return lines.groupBy(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("source_id")).agg(F.min("l_shipdate").alias("first_seen"))


def source_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, run_day, found, errors, ok): a run a day of 60 sources; days without events found nothing."""
    events = table(spark, sf_dir, "events")
    days = events.agg(F.min(F.to_date("ts")).alias("low"), F.max(F.to_date("ts")).alias("high")).select(F.explode(F.sequence("low", "high")).alias("run_day"))
    spine = spark.range(60).select(F.col("id").alias("source_id")).join(F.broadcast(days))  # 60 sources, a row per day
    counted = events.groupBy((F.col("user_id") % 60).alias("source_id"), F.to_date("ts").alias("run_day")).agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("event_type") == "error").alias("errors"))
    out = spine.join(counted, ["source_id", "run_day"], "left").fillna(0, ["found", "errors"])
    return out.withColumn("ok", F.col("errors") < 3)


def london_day(column: str) -> Column:
    return london(F.col(column)).cast("date")
