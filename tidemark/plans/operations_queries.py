"""Sources, runs, queues, limits and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import catalog as C
from tidemark.functions.timex import london_date, shown
from tidemark.operators import latest as L
from tidemark.operators import limits as R
from tidemark.operators import predicates as P
from tidemark.operators import quality as Q
from tidemark.operators import ranking, vector
from tidemark.plans import oracle as O

QUERIES, ORACLES = {}, {}


def add(name, sql=None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return keep


NOW, ENOW, W0, W1 = O.NOW_SQL, O.EVENTS_NOW_SQL, "TIMESTAMP '1998-06-14 23:00:00'", "TIMESTAMP '1998-07-14 23:00:00'"
INSIDE = f"{O.END} >= {W0} AND starts_at < {W1}"
inside = lambda df: df.filter(P.from_day("1998-06-15") & P.to_day("1998-07-14"))
day = lambda c: F.date_format(c, "yyyy-MM-dd")

# ---------------------------------------------------------------- joins and aggregates over sources


@add("filter_source_semi", O.query(f"SELECT id, venue_id FROM listing WHERE {INSIDE} AND id IN (SELECT id FROM links WHERE source_id IN (1, 2, 3, 4, 5))", O.LISTING, O.LINKS))
def _(spark, sf):
    return P.listed_by(inside(C.listings(spark, sf)), C.event_sources(spark, sf), [1, 2, 3, 4, 5]).select("id", "venue_id")


FIRST_SEEN = "LEFT JOIN (SELECT id AS lid, min(first_seen) AS seen FROM links GROUP BY 1) ON id = lid"


@add("first_seen", O.query(f"SELECT id, strftime(coalesce(seen, starts_at), '%Y-%m-%d %H:%M:%S') AS first_seen FROM listing {FIRST_SEEN}", O.LISTING, O.LINKS))
def _(spark, sf):
    return L.first_seen(C.listings(spark, sf).select("id", "starts_at"), C.event_sources(spark, sf)).select("id", shown(F.col("first_seen")).alias("first_seen"))


@add("sort_added", O.query(f"SELECT id, row_number() OVER (ORDER BY coalesce(seen, starts_at) DESC, id DESC) AS position FROM listing {FIRST_SEEN} WHERE {INSIDE} ORDER BY position LIMIT 100", O.LISTING, O.LINKS))
def _(spark, sf):
    seen = L.first_seen(inside(C.listings(spark, sf)).select("id", "starts_at"), C.event_sources(spark, sf)).select("id", "first_seen")
    return ranking.first_rows(seen, 100, F.col("first_seen").desc(), F.col("id").desc()).select("id", "position")


@add("due_sources", O.query(f"""SELECT source_key, CAST(source_id % 5 * 720 AS BIGINT) AS run_minutes FROM srcs LEFT JOIN (SELECT l_suppkey, max(l_shipdate) AS ran FROM lineitem WHERE l_shipdate < {NOW} GROUP BY 1) ON source_id = l_suppkey
    WHERE source_id % 7 <> 0 AND (ran IS NULL OR ran + to_minutes(CAST(source_id % 5 * 720 AS INT)) <= {NOW})""", O.SOURCES))
def _(spark, sf):
    ran = C.table(spark, sf, "lineitem").filter(F.col("l_shipdate") < C.instant(C.NOW)).groupBy("l_suppkey").agg(F.max("l_shipdate").alias("ran"))
    src = C.sources(spark, sf).withColumn("run_minutes", (F.col("source_id") % 5 * 720).cast("long")).join(ran, F.col("source_id") == F.col("l_suppkey"), "left")
    due = F.col("ran").isNull() | (F.col("ran") + F.make_dt_interval(mins=F.col("run_minutes").cast("int")) <= C.instant(C.NOW))
    return src.filter((F.col("source_id") % 7 != 0) & due).select("source_key", "run_minutes")


@add("most_common_value", "SELECT o_custkey AS venue_id, o_orderpriority AS value FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS k FROM orders GROUP BY 1, 2) WHERE k = 1")
def _(spark, sf):
    return L.most_common(C.table(spark, sf, "orders").select(F.col("o_custkey").alias("venue_id"), F.col("o_orderpriority").alias("value")), ["venue_id"], "value")


POINT = "lpad(CAST(round(lat * 100000) AS BIGINT)::VARCHAR, 9, '0') || ' ' || lpad(CAST(round((lng + 180) * 100000) AS BIGINT)::VARCHAR, 9, '0')"


@add("most_common_point", O.listing(f"SELECT borough, point FROM (SELECT borough, {POINT} AS point, row_number() OVER (PARTITION BY borough ORDER BY count(*) DESC, {POINT}) AS k FROM listing GROUP BY borough, {POINT}) WHERE k = 1"))
def _(spark, sf):
    number = lambda c: F.lpad(F.round(c * 100000).cast("long").cast("string"), 9, "0")
    df = C.listings(spark, sf).select("borough", F.concat(number(F.col("lat")), F.lit(" "), number(F.col("lng") + 180)).alias("point"))
    return L.most_common(df, ["borough"], "point")


@add("venue_majority_type", O.listing("SELECT borough, venue_type FROM (SELECT borough, venue_type, row_number() OVER (PARTITION BY borough ORDER BY count(*) DESC, venue_type) AS k FROM listing GROUP BY 1, 2) WHERE k = 1"))
def _(spark, sf):
    return L.most_common(C.listings(spark, sf).select("borough", "venue_type"), ["borough"], "venue_type")


@add("default_tags", O.query("SELECT id, array_to_string(list_sort(list(DISTINCT kind)), ',') AS tags FROM links JOIN srcs USING (source_id) GROUP BY id", O.LINKS, O.SOURCES))
def _(spark, sf):
    df = C.event_sources(spark, sf).join(C.sources(spark, sf), "source_id")
    return df.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("tags"))


@add("tag_union", O.listing("SELECT venue_id, array_to_string(list_sort(list(DISTINCT t)), ',') AS tags FROM (SELECT venue_id, unnest(list_concat(good_for, music)) AS t FROM listing) GROUP BY 1"))
def _(spark, sf):
    df = C.listings(spark, sf).select("venue_id", F.explode(F.concat("good_for", "music")).alias("t"))
    return df.groupBy("venue_id").agg(F.array_join(F.sort_array(F.collect_set("t")), ",").alias("tags"))


@add("memberships_agg", O.listing(f"SELECT venue_id, string_agg(m || ':' || id, ';' ORDER BY m, id) AS offers FROM (SELECT venue_id, id, unnest(memberships) AS m FROM listing WHERE {INSIDE}) GROUP BY 1"))
def _(spark, sf):
    df = inside(C.listings(spark, sf)).select("venue_id", "id", F.explode("memberships").alias("m"))
    offers = F.transform(F.array_sort(F.collect_list(F.struct("m", "id"))), lambda x: F.concat(x["m"], F.lit(":"), x["id"].cast("string")))
    return df.groupBy("venue_id").agg(F.array_join(offers, ";").alias("offers"))


CENTS = "CAST(round(value * 100) AS BIGINT)"
cents = lambda: F.round(F.col("value") * 100).cast("long")


@add("spend_since", f"SELECT user_id, CAST(sum({CENTS}) AS BIGINT) AS spent, CAST(coalesce(sum({CENTS}) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS purchases FROM events WHERE ts >= {ENOW} GROUP BY 1")
def _(spark, sf):
    df = C.table(spark, sf, "events").filter(F.col("ts") >= C.instant(C.EVENTS_NOW)).withColumn("c", cents())
    return df.groupBy("user_id").agg(F.sum("c").alias("spent"), F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("c"))), F.lit(0)).alias("purchases"))


@add("rate_counts", f"SELECT user_id, count(*) FILTER (ts > {ENOW} - INTERVAL 1 HOUR) AS in_hour, count(*) FILTER (ts > {ENOW} - INTERVAL 1 DAY) AS in_day FROM events WHERE ts <= {ENOW} AND ts > {ENOW} - INTERVAL 7 DAY GROUP BY 1")
def _(spark, sf):
    now = C.instant(C.EVENTS_NOW)
    df = C.table(spark, sf, "events").filter((F.col("ts") <= now) & (F.col("ts") > now - F.expr("INTERVAL 7 DAYS")))
    return df.groupBy("user_id").agg(F.count_if(F.col("ts") > now - F.expr("INTERVAL 1 HOUR")).alias("in_hour"), F.count_if(F.col("ts") > now - F.expr("INTERVAL 1 DAY")).alias("in_day"))


@add("qa_run_counts", "SELECT user_id % 60 AS source_id, strftime(ts, '%Y-%m-%d') AS run_day, count(*) AS checked, count(*) FILTER (event_type = 'view') AS missing_venue, count(*) FILTER (event_type IN ('view', 'click')) AS missing_coords FROM events GROUP BY 1, 2")
def _(spark, sf):
    kind = F.col("event_type")
    return C.table(spark, sf, "events").groupBy((F.col("user_id") % 60).alias("source_id"), day(F.col("ts")).alias("run_day")).agg(F.count(F.lit(1)).alias("checked"), F.count_if(kind == "view").alias("missing_venue"), F.count_if(kind.isin("view", "click")).alias("missing_coords"))


# ---------------------------------------------------------------- latest per key, queues

LATEST_RUN = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY run_day DESC) AS k FROM runs) WHERE k = 1"


@add("source_statuses", O.query(f"""SELECT r.source_id, strftime(r.run_day, '%Y-%m-%d') AS last_run, r.found, r.ok, coalesce(strftime(b.bad_day, '%Y-%m-%d'), '') AS open_issue
    FROM ({LATEST_RUN}) r LEFT JOIN (SELECT source_id, max(run_day) AS bad_day FROM runs WHERE NOT ok GROUP BY 1) b USING (source_id)""", O.RUNS))
def _(spark, sf):
    runs = C.source_runs(spark, sf)
    bad = runs.filter(~F.col("ok")).groupBy("source_id").agg(F.max("run_day").alias("bad_day"))
    last = L.latest(runs, ["source_id"], F.col("run_day").desc())
    return last.join(bad, "source_id", "left").select("source_id", day(F.col("run_day")).alias("last_run"), "found", "ok", F.coalesce(day(F.col("bad_day")), F.lit("")).alias("open_issue"))


@add("recent_runs", O.query("SELECT source_id, strftime(run_day, '%Y-%m-%d') AS run_day, found, errors FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY run_day DESC) AS k FROM runs) WHERE k <= 10", O.RUNS))
def _(spark, sf):
    return L.latest(C.source_runs(spark, sf), ["source_id"], F.col("run_day").desc(), n=10).select("source_id", day(F.col("run_day")).alias("run_day"), "found", "errors")


@add("latest_check", O.query("SELECT source_id, strftime(run_day, '%Y-%m-%d') AS run_day, errors FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY run_day DESC) AS k FROM runs WHERE errors > 0) WHERE k = 1", O.RUNS))
def _(spark, sf):
    return L.latest(C.source_runs(spark, sf).filter("errors > 0"), ["source_id"], F.col("run_day").desc()).select("source_id", day(F.col("run_day")).alias("run_day"), "errors")


@add("venue_events", O.listing(f"SELECT venue_id, id, k AS position FROM (SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY starts_at, id) AS k FROM listing WHERE {O.END} >= {NOW}) WHERE k <= 3"))
def _(spark, sf):
    df = C.listings(spark, sf).filter(P.whole_end() >= C.instant(C.NOW))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("venue_id").orderBy("starts_at", "id"))
    return df.withColumn("position", rank.cast("long")).filter("position <= 3").select("venue_id", "id", "position")


@add("retry_after", f"SELECT user_id, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS retry_after FROM (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events WHERE ts <= {ENOW}) WHERE k = 5")
def _(spark, sf):
    df = L.latest(C.table(spark, sf, "events").filter(F.col("ts") <= C.instant(C.EVENTS_NOW)).select("user_id", "ts"), ["user_id"], F.col("ts").desc(), n=5)
    return df.groupBy("user_id").agg(F.min("ts").alias("t"), F.count(F.lit(1)).alias("n")).filter("n = 5").select("user_id", shown(F.col("t") + F.expr("INTERVAL 1 DAY")).alias("retry_after"))


@add("enrichment_queue", O.listing(f"SELECT id, row_number() OVER (ORDER BY has_image DESC, starts_at, id) AS position FROM listing WHERE {O.END} >= {NOW} AND NOT has_note AND id % 5 <> 0 ORDER BY position LIMIT 120"))
def _(spark, sf):
    df = C.listings(spark, sf).filter((P.whole_end() >= C.instant(C.NOW)) & ~F.col("has_note") & (F.col("id") % 5 != 0))
    return ranking.first_rows(df.select("id", "starts_at", "has_image"), 120, F.col("has_image").desc(), F.col("starts_at"), F.col("id")).select("id", "position")


@add("thumbnail_jobs", O.query(f"""SELECT id, failures, strftime(next_try, '%Y-%m-%d %H:%M:%S') AS next_try FROM (SELECT id, CAST(id % 6 AS BIGINT) AS failures, starts_at - INTERVAL 30 DAY + to_minutes(CAST(CASE WHEN id % 6 > 0 THEN 15 * power(2, id % 6 - 1) ELSE 0 END AS INT)) AS next_try
    FROM listing WHERE has_image AND NOT has_thumbnail AND id IN (SELECT id FROM links JOIN srcs USING (source_id) WHERE kind <> 'aggregator')) WHERE next_try <= {NOW} ORDER BY thumbnail_order(next_try), id LIMIT 200""".replace("thumbnail_order(next_try)", "next_try DESC"), O.LISTING, O.LINKS, O.SOURCES))
def _(spark, sf):
    allowed = C.event_sources(spark, sf).join(C.sources(spark, sf).filter("kind <> 'aggregator'"), "source_id").select("id")
    df = C.listings(spark, sf).filter(F.col("has_image") & ~F.col("has_thumbnail")).join(allowed, "id", "left_semi").withColumn("failures", (F.col("id") % 6).cast("long"))
    wait = F.make_dt_interval(mins=L.backoff(F.col("failures"), 15).cast("int"))
    df = df.withColumn("next_try", F.col("starts_at") - F.expr("INTERVAL 30 DAYS") + wait).filter(F.col("next_try") <= C.instant(C.NOW))
    return df.orderBy(F.col("next_try").desc(), "id").limit(200).select("id", "failures", shown(F.col("next_try")).alias("next_try"))


@add("priority_union", "SELECT k, origin FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p) AS n FROM (SELECT c_custkey % 200 AS k, 'customer' AS origin, 1 AS p FROM customer WHERE c_acctbal < 0 GROUP BY 1 UNION ALL SELECT s_suppkey::BIGINT, 'supplier', 2 FROM supplier UNION ALL SELECT p_partkey, 'part', 3 FROM part WHERE p_size < 10)) WHERE n = 1")
def _(spark, sf):
    one = C.table(spark, sf, "customer").filter("c_acctbal < 0").select((F.col("c_custkey") % 200).alias("k"), F.lit("customer").alias("origin")).distinct()
    two = C.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.lit("supplier").alias("origin"))
    three = C.table(spark, sf, "part").filter("p_size < 10").select(F.col("p_partkey").alias("k"), F.lit("part").alias("origin"))
    return L.priority_union(one, two, three, key="k")


# ---------------------------------------------------------------- health and sanity rules

HELD = "list(found) FILTER (ok) OVER (PARTITION BY source_id ORDER BY run_day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
HEALTH = f"""{O.RUNS}, history AS (SELECT *, coalesce({HELD}, []) AS h FROM runs),
judged AS (SELECT *, len(h[-5:]) AS n_history, CASE WHEN len(h) > 0 THEN list_sum(h[-5:])::DOUBLE / len(h[-5:]) END AS average, NOT ok AND coalesce(NOT lag(ok) OVER (PARTITION BY source_id ORDER BY run_day), false) AS failing FROM history),
flagged AS (SELECT *, ok AND found = 0 AND coalesce(average >= 2, false) AS zero, ok AND found > 0 AND n_history >= 3 AND coalesce(average >= 5 AND found < average * 0.4, false) AS dropped FROM judged)"""
RUN = "source_id, strftime(run_day, '%Y-%m-%d') AS run_day"
run = lambda: ("source_id", day(F.col("run_day")).alias("run_day"))


@add("health_trailing_avg", O.query(f"SELECT {RUN}, n_history::INT AS n_history, round(average, 6) AS average FROM flagged", HEALTH))
def _(spark, sf):
    return Q.with_history(C.source_runs(spark, sf)).select(*run(), "n_history", F.round("average", 6).alias("average"))


@add("health_zero", O.query(f"SELECT {RUN}, found FROM flagged WHERE zero", HEALTH))
def _(spark, sf):
    return Q.with_history(C.source_runs(spark, sf)).filter(Q.zero_events()).select(*run(), "found")


@add("health_count_drop", O.query(f"SELECT {RUN}, found FROM flagged WHERE dropped", HEALTH))
def _(spark, sf):
    return Q.with_history(C.source_runs(spark, sf)).filter(Q.count_drop()).select(*run(), "found")


@add("health_consecutive_errors", O.query(f"SELECT {RUN}, errors FROM flagged WHERE failing", HEALTH))
def _(spark, sf):
    return Q.consecutive_errors(C.source_runs(spark, sf)).filter("failing").select(*run(), "errors")


@add("health_status", O.query(f"SELECT {RUN}, CASE WHEN source_id % 13 = 0 THEN 'skipped' WHEN failing THEN 'broken' WHEN found = 0 AND n_history = 0 THEN 'pending' WHEN zero OR dropped OR NOT ok THEN 'degraded' ELSE 'healthy' END AS status FROM flagged", HEALTH))
def _(spark, sf):
    df = Q.consecutive_errors(Q.with_history(C.source_runs(spark, sf)))
    status = Q.health_status(F.col("source_id") % 13 == 0, F.col("failing"), (F.col("found") == 0) & (F.col("n_history") == 0), Q.zero_events() | Q.count_drop() | ~F.col("ok"))
    return df.select(*run(), status.alias("status"))


#: Listings with the faults that the rules look for: every 29th ends early, every 31st runs over a year.
FAULTY = "(SELECT id, venue, starts_at, CASE WHEN id % 29 = 0 THEN starts_at - INTERVAL 2 HOUR WHEN id % 31 = 0 THEN starts_at + INTERVAL 400 DAY ELSE ends_at END AS ends_at, all_day AND id % 2 = 0 AS all_day FROM listing)"


def faulty(spark, sf):
    df = C.listings(spark, sf)
    end = F.when(F.col("id") % 29 == 0, F.col("starts_at") - F.expr("INTERVAL 2 HOURS")).when(F.col("id") % 31 == 0, F.col("starts_at") + F.expr("INTERVAL 400 DAYS")).otherwise(F.col("ends_at"))
    return df.select("id", "venue", "starts_at", end.alias("ends_at"), (F.col("all_day") & (F.col("id") % 2 == 0)).alias("all_day"))


def rule(name, test, sql):
    add(name, O.listing(f"SELECT id, venue FROM {FAULTY} WHERE {sql}"))(lambda spark, sf: faulty(spark, sf).filter(test()).select("id", "venue"))


rule("qa_end_before_start", Q.end_before_start, "ends_at < starts_at")
rule("qa_year_range", lambda: Q.year_out_of_range(C.instant(C.NOW)), f"starts_at < {NOW} - INTERVAL 365 DAY OR starts_at > {NOW} + INTERVAL 1095 DAY")
rule("qa_long_span", Q.long_span, "ends_at > starts_at + INTERVAL 365 DAY")
rule("qa_midnight", Q.midnight_not_all_day, f"NOT all_day AND {O.ltime('starts_at')} = '00:00'")


@add("qa_duplicate_title", O.listing(f"SELECT title, strftime({O.ldate('starts_at')}, '%Y-%m-%d') AS day, count(*) AS n FROM full_listing GROUP BY 1, 2 HAVING count(*) > 1", True))
def _(spark, sf):
    return Q.duplicate_titles(C.listings(spark, sf, lines=True)).select("title", day(F.col("day")).alias("day"), "n")


@add("qa_same_date", O.query(f"SELECT venue_id, count(*) AS kept FROM listing WHERE {INSIDE} GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT {O.ldate('starts_at')}) = 1", O.LISTING))
def _(spark, sf):
    return Q.same_date(inside(C.listings(spark, sf)), "venue_id")


SHARES = "shares AS (SELECT user_id % 60 AS source_id, ts::DATE AS run_day, count(*) AS kept, (100 * count(*) FILTER (event_type = 'view'))::DOUBLE / count(*) AS share FROM events GROUP BY 1, 2)"


@add("qa_missing_jump", O.query("SELECT source_id, strftime(run_day, '%Y-%m-%d') AS run_day, kept FROM (SELECT *, count(share) OVER w AS n, avg(share) OVER w AS a FROM shares WINDOW w AS (PARTITION BY source_id ORDER BY run_day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) WHERE kept >= 5 AND n >= 3 AND share - a >= 30", SHARES))
def _(spark, sf):
    df = C.table(spark, sf, "events").groupBy((F.col("user_id") % 60).alias("source_id"), F.to_date("ts").alias("run_day")).agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("event_type") == "view").alias("v"))
    return Q.missing_jump(df.withColumn("share", F.col("v") * 100 / F.col("kept")), "share").filter("jump").select(*run(), "kept")


@add("qa_due_reason", f"""SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 9 = 0 THEN 'first' WHEN s_suppkey % 4 = 0 THEN 'code changed' WHEN {NOW} - to_days(CAST(s_suppkey % 10 AS INT)) <= {NOW} - INTERVAL 7 DAY THEN 'weekly' WHEN s_suppkey % 3 = 0 THEN 'new rule' END AS reason FROM supplier""")
def _(spark, sf):
    s = F.col("s_suppkey")
    now = C.instant(C.NOW)
    df = C.table(spark, sf, "supplier").select(
        s.alias("source_id"), F.when(s % 9 != 0, now - F.make_dt_interval(days=(s % 10).cast("int"))).alias("checked_at"), F.lit(2).alias("version"), F.when(s % 4 == 0, 1).otherwise(2).alias("checked_version"),
        F.when(s % 3 == 0, F.array(F.lit("span"))).otherwise(F.array(F.lit("span"), F.lit("year"))).alias("checked_rules"),
    )
    return df.select("source_id", Q.due_reason(now, F.array(F.lit("span"), F.lit("year"))).alias("reason"))


@add("issue_lifecycle", O.query("SELECT source_id, CASE WHEN failing OR zero OR dropped THEN CASE WHEN source_id % 4 = 0 THEN 'already open' ELSE 'open' END WHEN NOT ok THEN 'degraded' WHEN source_id % 4 = 0 THEN 'close' ELSE 'healthy' END AS action FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY run_day DESC) AS k FROM flagged) WHERE k = 1", HEALTH))
def _(spark, sf):
    runs = Q.consecutive_errors(Q.with_history(C.source_runs(spark, sf)))
    last = L.latest(runs, ["source_id"], F.col("run_day").desc())
    last = last.select("source_id", (F.col("failing") | Q.zero_events() | Q.count_drop()).alias("tripped"), F.col("ok").alias("clean"))
    return Q.issue_actions(last, spark.range(0, 60, 4).select(F.col("id").alias("source_id")))


@add("alert_latch", f"SELECT coalesce(u, k) AS key, CASE WHEN u IS NOT NULL THEN coalesce(s, '2024-01-15 12:00:00') ELSE '' END AS active_since FROM (SELECT DISTINCT user_id AS u FROM events WHERE event_type = 'error' AND ts >= {ENOW} - INTERVAL 1 DAY AND ts < {ENOW}) FULL JOIN (SELECT r AS k, '2024-01-01 00:00:00' AS s FROM range(0, 150, 2) t(r)) ON u = k")
def _(spark, sf):
    now = C.instant(C.EVENTS_NOW)
    raised = C.table(spark, sf, "events").filter((F.col("event_type") == "error") & (F.col("ts") >= now - F.expr("INTERVAL 1 DAY")) & (F.col("ts") < now)).select(F.col("user_id").alias("key"))
    state = spark.range(0, 150, 2).select(F.col("id").alias("key"), C.instant("2024-01-01 00:00:00").alias("active_since"))
    return Q.alert_latch(state, raised, now).select("key", F.coalesce(shown(F.col("active_since")), F.lit("")).alias("active_since"))


@add("thumbnail_save", O.listing("SELECT id, CASE WHEN id % 4 = 0 THEN 0 WHEN id % 4 = 1 THEN id % 6 + 1 ELSE id % 6 END AS failures FROM listing WHERE has_image"))
def _(spark, sf):
    jobs = C.listings(spark, sf).filter("has_image").select("id", (F.col("id") % 6).alias("failures"))
    results = C.listings(spark, sf).filter("id % 4 < 2").select("id", (F.col("id") % 4 == 0).alias("ok"))
    return L.save_attempts(jobs, results)


# ---------------------------------------------------------------- limits over a stream of requests


@add("tumbling_15m", "SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    return R.tumbling(C.table(spark, sf, "events"), "ts", "15 minutes", "event_type").withColumn("window_start", shown(F.col("window_start")))


@add("sliding_rate", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS n FROM events")
def _(spark, sf):
    return R.within_last(C.table(spark, sf, "events"), "user_id", "ts", 3_600, "n").select("event_id", "n")


@add("slot_reservation", "SELECT event_id, CAST(max(t - k * 7200) OVER (PARTITION BY user_id ORDER BY ts, event_id) + k * 7200 AS BIGINT) AS slot FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)")
def _(spark, sf):
    return R.slots(C.table(spark, sf, "events"), "user_id", "ts", 7_200, "event_id").select("event_id", "slot")


@add("daily_quota", "SELECT event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def _(spark, sf):
    return R.daily_quota(C.table(spark, sf, "events"), "user_id", "ts", 2, "event_id").select("event_id", "allowed")


@add("budget_gate", f"SELECT event_id, sum({CENTS}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 200000 AS allowed FROM events")
def _(spark, sf):
    return R.budget_gate(C.table(spark, sf, "events").withColumn("c", cents()), "user_id", "ts", "c", 200_000, "event_id").select("event_id", "allowed")


# ---------------------------------------------------------------- vectors

DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"
COS = f"{DOT.format('e.embedding', 'p.embedding')} / sqrt({DOT.format('e.embedding', 'e.embedding')} * {DOT.format('p.embedding', 'p.embedding')})"


@add("more_like_this", f"SELECT e.vec_id, round({COS}, 6) AS similarity FROM embeddings e, embeddings p WHERE p.vec_id = 7 AND e.vec_id <> 7 ORDER BY {COS} DESC, e.vec_id LIMIT 6")
def _(spark, sf):
    return vector.similar_to(C.table(spark, sf, "embeddings"), 7, 6).select("vec_id", F.round("similarity", 6).alias("similarity"))


@add("knn_filtered", f"SELECT e.vec_id, round({COS}, 6) AS similarity FROM embeddings e, embeddings p WHERE p.vec_id = 11 AND e.label IN (1, 2, 3) AND e.vec_id <> 11 ORDER BY {COS} DESC, e.vec_id LIMIT 20")
def _(spark, sf):
    df = C.table(spark, sf, "embeddings")
    return vector.similar_to(df.filter("label IN (1, 2, 3) OR vec_id = 11"), 11, 20).select("vec_id", F.round("similarity", 6).alias("similarity"))
