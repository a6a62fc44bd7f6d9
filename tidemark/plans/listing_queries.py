"""Filters, time buckets, sorts, counts and places over listings, with their SQL."""

from __future__ import annotations

from tidemark import catalog as C
from tidemark.functions import geo
from tidemark.functions.timex import london, shown
from tidemark.operators import facets, ranking
from tidemark.operators import predicates as P
from tidemark.plans import oracle as O
from pyspark.sql import functions as F

FROM, TO = "1998-06-15", "1998-07-14"
LAT, LNG, RADIUS = 51.5007, -0.1246, 8.0
WHEN = "strftime(starts_at, '%Y-%m-%d %H:%M:%S') AS starts_at"
QUERIES, ORACLES = {}, {}


def add(name, sql, lines=False, since=None, until=None):
    """Register a function of the listings, of those around the days that it filters by."""

    def keep(function):
        QUERIES[name] = lambda spark, sf_dir: function(C.listings(spark, sf_dir, lines, since, until))
        if sql:
            ORACLES[name] = O.listing(sql, lines)
        return function

    return keep


def filters(name, test, sql, lines=False, window=True):
    """Register a filter, on listings of the window; the result is ids and starts."""
    view = "full_listing" if lines else "listing"
    inside = f"{O.END} >= {O.midnight(f"DATE '{FROM}'")} AND starts_at < {O.midnight(f"DATE '{TO}' + 1")}" if window else "true"

    def run(df):
        if window:
            df = df.filter(P.from_day(FROM) & P.to_day(TO))
        return df.filter(test()).select("id", shown(F.col("starts_at")).alias("starts_at"))

    add(name, f"SELECT id, {WHEN} FROM {view} WHERE {inside} AND ({sql})", lines, *((FROM, TO) if window else ()))(run)


now, until = lambda: C.instant(C.NOW), lambda: C.instant("1998-06-15 20:00:00")
since_window = lambda: (C.instant("1998-06-14 23:00:00"), C.instant("1998-07-14 23:00:00"))
NOW, UNTIL, W0, W1 = O.NOW_SQL, "TIMESTAMP '1998-06-15 20:00:00'", "TIMESTAMP '1998-06-14 23:00:00'", "TIMESTAMP '1998-07-14 23:00:00'"
SESSION_IN = f"coalesce(s.ends_at, s.starts_at) >= {W0} AND s.starts_at < {W1}"

filters("filter_date_window", lambda: F.lit(True), "true")
filters("filter_session_window", lambda: P.in_window(*since_window()), f"{O.END} >= {W0} AND starts_at < {W1} AND (sessions IS NULL OR {O.some('sessions', SESSION_IN, 's')})", window=False)
filters("filter_category", lambda: F.col("category").isin("talk", "music"), "category IN ('talk', 'music')")
filters("filter_free", lambda: F.col("is_free"), "is_free")
filters("filter_ids", lambda: F.col("id").isin(list(range(1, 4000, 40))), "id IN (SELECT unnest(range(1, 4000, 40)))", window=False)
filters("filter_tags_any", lambda: P.any_tag("mediums", ["Brand#11", "Brand#12"]) & P.any_tag("good_for", ["families", "dates"]), "list_has_any(mediums, ['Brand#11', 'Brand#12']) AND list_has_any(good_for, ['families', 'dates'])", lines=True)
filters("filter_music", lambda: P.any_tag("music", ["jazz", "sound_art"]), "list_has_any(music, ['jazz', 'sound_art'])")
filters("filter_membership", lambda: P.any_tag("memberships", ["art_pass"]), "list_has_any(memberships, ['art_pass'])")
filters("filter_borough", lambda: F.col("borough").isin("FRANCE", "NATION_3", "NATION_7", "nowhere"), "borough IN ('FRANCE', 'NATION_3', 'NATION_7', 'nowhere')")
filters("filter_venue_type", lambda: F.col("venue_type").isin("museum", "community"), "venue_type IN ('museum', 'community')")
filters("filter_price_max", lambda: P.price_at_most(2_000), "is_free OR coalesce(price_min <= 2000 AND coalesce(currency, 'GBP') = 'GBP', false)", lines=True)

CLOCK = O.ltime("starts_at")
LATE = f"({CLOCK} = '00:00' AND late_opening)"
ISO = lambda x: f"isodow({x})"


def hours_or(rule, plain):
    return f"CASE WHEN hours IS NOT NULL THEN {O.some('hours', rule, 'r')} ELSE {plain} END"


filters("when_evening", P.when_evening, hours_or("r.closes > '18:00'", f"({CLOCK} >= '18:00' OR {LATE})"))
filters("when_after_work", P.when_after_work, hours_or("r.closes > '17:30' AND r.opens <= '20:30' AND len(list_filter(r.days, lambda d: d <= 5)) > 0", f"(({ISO(O.london('starts_at'))} <= 5 AND {CLOCK} BETWEEN '17:30' AND '20:30') OR {LATE})"))
filters("when_daytime", P.when_daytime, hours_or("r.opens < '18:00'", f"{CLOCK} < '18:00'"))


def weekday_sql(days):
    """The filter on weekdays inside the window."""
    low, high = f"greatest({O.ldate('starts_at')}, {O.ldate(W0)})", f"least({O.ldate(O.END)}, {O.ldate(W1)} - 1)"
    day = f"({low} + CAST(k AS INT))"
    held = O.some("hours", f"list_contains(r.days, {ISO(day)})", "r")
    plain = f"coalesce(len(list_filter(range(0, least({high} - {low}, 6) + 1), lambda k: {ISO(day)} IN {days} AND (hours IS NULL OR {held}))) > 0, false)"
    return f"CASE WHEN sessions IS NOT NULL THEN {O.some('sessions', f'{ISO(O.london("s.starts_at"))} IN {days} AND {SESSION_IN}', 's')} ELSE {plain} END"


filters("when_weekend", lambda: P.on_weekdays([6, 7], *since_window()), weekday_sql("(6, 7)"))
filters("open_on_day", lambda: P.on_weekdays([3], *since_window()), weekday_sql("(3)"))


def still_sql(now, until):
    session = O.some("sessions", f"coalesce(s.ends_at, s.starts_at + INTERVAL 60 MINUTE) > {now}" + (f" AND s.starts_at < {until}" if until else ""), "s")
    last = f"{O.ldate(O.END)} + 1"
    return f"CASE WHEN sessions IS NOT NULL THEN {session} WHEN all_day THEN {O.midnight(last)} > {now} WHEN ends_at IS NOT NULL THEN ends_at > {now} ELSE starts_at + INTERVAL 60 MINUTE > {now} END"


def live_sql(now, until):
    rule = f"list_contains(r.days, {ISO(O.london(now))}) AND r.closes > {O.ltime(now)} AND ({O.ldate(until)} > {O.ldate(now)} OR r.opens < {O.ltime(until)})"
    back = f"({now} - INTERVAL 48 HOUR)"
    inside = f"coalesce(s.ends_at, s.starts_at) >= {back} AND s.starts_at < {until}"
    return f"{O.END} >= {back} AND starts_at < {until} AND (sessions IS NULL OR {O.some('sessions', inside, 's')}) AND {still_sql(now, until)} AND (hours IS NULL OR {O.some('hours', rule, 'r')})"


END_OF_DAY = "TIMESTAMP '1998-06-15 23:00:00'"
filters("still_on", lambda: P.still_on(now()), still_sql(NOW, None))
filters("live_at_now", lambda: P.live(now(), until()), live_sql(NOW, UNTIL), window=False)
filters("live_at_today", lambda: P.live(C.instant("1998-06-14 23:00:00"), C.instant("1998-06-15 23:00:00")), live_sql(W0, END_OF_DAY), window=False)
filters("open_at_instant", lambda: P.open_at(now()), live_sql(NOW, f"({NOW} + INTERVAL 1 SECOND)"), window=False)

TODAY = "DATE '1998-06-15'"
today = lambda: P.day_column("1998-06-15")
FIRST, LAST = O.ldate("starts_at"), O.ldate(O.END)
EFFECTIVE = f"CASE WHEN all_day THEN {O.utc(f'{O.london(O.END)} + INTERVAL 1 DAY')} WHEN ends_at IS NOT NULL THEN ends_at ELSE starts_at + INTERVAL 3 HOUR END"
TONIGHT = f"""{FIRST} <= {TODAY} AND {LAST} >= {TODAY} AND CASE WHEN sessions IS NOT NULL THEN {O.some('sessions', f"{O.ldate('s.starts_at')} = {TODAY} AND {O.ltime('s.starts_at')} >= '17:00'", 's')}
    WHEN hours IS NOT NULL THEN {O.some('hours', f"list_contains(r.days, {ISO(TODAY)}) AND r.closes > '18:00'", 'r')} ELSE ({FIRST} = {TODAY} AND {CLOCK} >= '17:00') OR {LATE} END"""
OPENINGS = f"{FIRST} BETWEEN {TODAY} AND {TODAY} + 6 AND (category = 'exhibition' OR opening_tag OR regexp_matches(title, '(?i)\\b(private view|opening reception|opening night|preview evening|launch)\\b') OR regexp_matches(title, '\\bPV\\b'))"
LAST_CHANCE = f"{LAST} > {FIRST} AND {LAST} BETWEEN {TODAY} AND {TODAY} + 6 AND {EFFECTIVE} > {NOW}"
HANDS_ON = "category = 'workshop' OR workshop_tag OR regexp_matches(title, '(?i)\\b(class|classes|course|drop-in|life drawing|masterclass|workshops?)\\b')"
RULE_NOW = f"list_contains(r.days, {ISO(O.london(NOW))}) AND r.opens <= {O.ltime(NOW)} AND r.closes > {O.ltime(NOW)}"
OPEN_NOW = f"starts_at <= {NOW} AND {still_sql(NOW, f'{NOW} + INTERVAL 1 SECOND')} AND {hours_or(RULE_NOW, f"(NOT all_day AND {CLOCK} <> '00:00')")}"
filters("pick_tonight", lambda: P.pick_tonight(today()), TONIGHT, window=False)
filters("pick_openings", lambda: P.pick_openings(today()), OPENINGS, lines=True, window=False)
filters("pick_last_chance", lambda: P.pick_last_chance(today(), now()), LAST_CHANCE, window=False)
filters("pick_hands_on", P.pick_hands_on, HANDS_ON, lines=True)
filters("pick_open_now", lambda: P.pick_open_now(now()), OPEN_NOW, window=False)

HAVERSINE = f"2 * 6371.0088 * asin(least(1.0, sqrt(power(sin(radians(lat - {LAT}) / 2), 2) + cos(radians({LAT})) * cos(radians(lat)) * power(sin(radians(lng - ({LNG})) / 2), 2))))"
away = lambda: geo.distance(F.lit(LAT), F.lit(LNG), F.col("lat"), F.col("lng"))
filters("near_radius", lambda: geo.near(LAT, LNG, RADIUS), f"{HAVERSINE} <= {RADIUS}")
filters("near_walk", lambda: geo.near(LAT, LNG, geo.walk_radius_km(90)), f"{HAVERSINE} <= {geo.walk_radius_km(90)}")

VENUES = "SELECT DISTINCT venue_id, lat, lng FROM listing"
venues = lambda df: df.select("venue_id", "lat", "lng").distinct()
add("haversine", f"SELECT venue_id, round({HAVERSINE}, 3) AS km FROM ({VENUES})")(lambda df: venues(df).select("venue_id", F.round(away(), 3).alias("km")))
add("walk_minutes", f"SELECT venue_id, CAST(greatest(1, round(round({HAVERSINE}, 3) * 1.3 / 5 * 60)) AS BIGINT) AS minutes FROM ({VENUES})")(lambda df: venues(df).select("venue_id", geo.walk_minutes(F.round(away(), 3)).alias("minutes")))
CELL = "CAST(round(round({0} / {1}) * {1}, 4) AS DECIMAL(9, 4))::VARCHAR AS cell_{0}"
add("grid_cell", f"SELECT venue_id, {CELL.format('lat', 0.002)}, {CELL.format('lng', 0.003)} FROM (SELECT venue_id, round(lat + 0.0003, 5) AS lat, round(lng + 0.0004, 5) AS lng FROM ({VENUES}))")(
    lambda df: venues(df).select("venue_id", *[c.cast("decimal(9,4)").cast("string").alias(f"cell_{n}") for n, c in zip(("lat", "lng"), geo.grid_cell(F.round(F.col("lat") + 0.0003, 5), F.round(F.col("lng") + 0.0004, 5)))])
)
add("in_bbox", f"SELECT venue_id, lat BETWEEN 51.4 AND 51.6 AND lng BETWEEN -0.3 AND 0.1 AS inside FROM ({VENUES})")(lambda df: venues(df).select("venue_id", geo.in_box(F.col("lat"), F.col("lng"), (51.4, 51.6, -0.3, 0.1)).alias("inside")))
RINGS = [[(-0.4005, 51.3005), (0.2005, 51.3505), (0.1005, 51.6505), (-0.2005, 51.5005), (-0.3505, 51.6805)], [(-0.1505, 51.4005), (-0.0505, 51.4005), (-0.1005, 51.4805)]]
EDGES = ", ".join(f"({x1}, {y1}, {x2}, {y2})" for ring in RINGS for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]))
add("point_in_polygon", f"SELECT venue_id, count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1) % 2 = 1 AS inside FROM ({VENUES}), (SELECT x1::DOUBLE x1, y1::DOUBLE y1, x2::DOUBLE x2, y2::DOUBLE y2 FROM (VALUES {EDGES}) t(x1, y1, x2, y2)) GROUP BY venue_id")(
    lambda df: venues(df).select("venue_id", geo.in_polygon(F.col("lat"), F.col("lng"), RINGS).alias("inside"))
)

# ---------------------------------------------------------------- sorts: positions of the first rows

INSIDE = f"{O.END} >= {W0} AND starts_at < {W1}"
inside = lambda df: df.filter(P.from_day(FROM) & P.to_day(TO))


def sort(name, order_sql, order, columns, sql_columns, lines=False, extra=None, extra_sql="true", prepare=lambda df: df, prepare_sql="*"):
    view = "full_listing" if lines else "listing"

    def run(df):
        df = prepare(inside(df))
        df = df if extra is None else df.filter(extra())
        return ranking.first_rows(df.select("id", "starts_at", *columns()), 100, *order()).select("id", "position", *[c for c in sql_columns])

    picked = "".join(f", {c}" for c in sql_columns)
    add(name, f"SELECT id, row_number() OVER (ORDER BY {order_sql}) AS position{picked} FROM (SELECT {prepare_sql} FROM {view} WHERE {INSIDE}) WHERE {extra_sql} ORDER BY position LIMIT 100", lines, FROM, TO)(run)


KM = f"round({HAVERSINE}, 6) AS km"
RICH = "(CASE WHEN has_thumbnail THEN 3 ELSE 0 END + CASE WHEN description_length >= 120 THEN 2 WHEN description_length >= 40 THEN 1 ELSE 0 END + CASE WHEN has_note THEN 1 ELSE 0 END + CASE WHEN hours IS NOT NULL OR is_free OR price_min IS NOT NULL THEN 1 ELSE 0 END)"
FULL = "(CASE WHEN has_thumbnail THEN 8 ELSE 0 END + CASE WHEN description_length > 0 THEN 4 ELSE 0 END + CASE WHEN is_free OR price_min IS NOT NULL THEN 2 ELSE 0 END + 1)"
DAY = f"coalesce(list_min(list_filter(list_transform(sessions, lambda s: {O.ldate('s.starts_at')}), lambda d: d >= {TODAY})), greatest({FIRST}, {TODAY}))"
RN = "row_number() OVER (PARTITION BY day, rich ORDER BY starts_at, id)"
sort("sort_soonest", "starts_at, id", lambda: (F.col("starts_at"), F.col("id")), lambda: (), ())
sort("sort_nearest", "km, id", lambda: (F.col("km"), F.col("id")), lambda: (F.round(away(), 6).alias("km"),), (), prepare_sql=f"*, {KM}")
sort("sort_ending", "ends, id", lambda: (F.col("ends"), F.col("id")), lambda: (P.effective_end().alias("ends"),), (), extra=lambda: P.effective_end() > now(), extra_sql=f"ends > {NOW}", prepare_sql=f"*, {EFFECTIVE} AS ends")
sort("sort_surprise", "shuffle, id", lambda: (F.col("shuffle"), F.col("id")), lambda: (ranking.shuffled("id", "1998-06-15").alias("shuffle"),), ("shuffle",), prepare_sql="*, md5(id || '1998-06-15') AS shuffle")
sort("sort_richest", "day, slot, id", lambda: (F.col("day"), F.col("slot"), F.col("id")), lambda: ("day", "slot"), ("slot",), lines=True, prepare=lambda df: ranking.with_slots(df, today()), prepare_sql=f"*, CAST(CASE WHEN rich THEN {RN} + ({RN} - 1) // 2 ELSE {RN} * 3 END AS BIGINT) AS slot FROM (SELECT *, {DAY} AS day, {RICH} >= 5 AS rich")
ORACLES["sort_richest"] = ORACLES["sort_richest"].replace(f"FROM full_listing WHERE {INSIDE})", f"FROM full_listing WHERE {INSIDE}))")
sort("sort_fullest", "day, gap, starts_at, id", lambda: (F.col("day"), F.col("gap"), F.col("starts_at"), F.col("id")), lambda: (ranking.day_in_window(today()).alias("day"), (F.lit(15) - ranking.fullness()).cast("long").alias("gap")), ("gap",), lines=True, prepare_sql=f"*, {DAY} AS day, CAST(15 - {FULL} AS BIGINT) AS gap")
add("richness_score", f"SELECT id, CAST({RICH} AS INT) AS score FROM full_listing", True)(lambda df: df.select("id", ranking.richness().alias("score")))
add("fullness_score", f"SELECT id, CAST({FULL} AS INT) AS score FROM full_listing", True)(lambda df: df.select("id", ranking.fullness().alias("score")))
AFTER = "TIMESTAMP '1998-06-18 10:00:00'"
add("page_after_cursor", f"SELECT id, {WHEN} FROM (SELECT id, starts_at FROM listing WHERE {INSIDE} AND (starts_at > {AFTER} OR (starts_at = {AFTER} AND id > 5000)) ORDER BY listing.starts_at, id LIMIT 51)", False, FROM, TO)(
    lambda df: ranking.page(inside(df).select("id", "starts_at"), [("starts_at", False), ("id", False)], 50, [C.instant("1998-06-18 10:00:00"), 5000]).select("id", shown(F.col("starts_at")).alias("starts_at"))
)

# ---------------------------------------------------------------- counts

FACETS = {
    "medium": ("mediums", "mediums", ["Brand#11", "Brand#12"]), "format": ("formats", "formats", ["Type#1"]), "good_for": ("good_for", "good_for", ["families"]), "music": ("music", "music", ["jazz"]),
    "membership": ("memberships", "memberships", ["art_pass"]), "venue_type": ("venue_type", "venue_type", ["museum", "other"]), "borough": ("borough", "borough", ["FRANCE", "NATION_3"]),
}
CHOSEN = {"good_for": lambda: (F.col("category") == "music") | P.any_tag("good_for", ["families", "dates", "groups"]), "venue_type": lambda: F.col("venue_type").isin("museum", "other", "community")}
CHOSEN_SQL = {"good_for": "(category = 'music' OR list_has_any(good_for, ['families', 'dates', 'groups']))", "venue_type": "venue_type IN ('museum', 'other', 'community')"}
for _name, (_column, _, _) in FACETS.items():
    _tests = " AND ".join(sql for c, sql in CHOSEN_SQL.items() if c != _column)
    _values = f"coalesce({_column}, 'unknown')" if _column in ("venue_type", "borough") else f"unnest({_column})"
    add(f"facet_{_name}", f"SELECT value, count(*) AS n FROM (SELECT {_values} AS value FROM full_listing WHERE {INSIDE} AND {_tests}) GROUP BY 1", True, FROM, TO)(
        lambda df, column=_column: facets.facet(inside(df), column, {c: t() for c, t in CHOSEN.items()})
    )

PRICE10, PRICE20 = (f"(is_free OR coalesce(price_min <= {p} AND coalesce(currency, 'GBP') = 'GBP', false))" for p in (1_000, 2_000))
EVENING, AFTER_WORK, DAYTIME, WEEKEND = hours_or("r.closes > '18:00'", f"({CLOCK} >= '18:00' OR {LATE})"), hours_or("r.closes > '17:30' AND r.opens <= '20:30' AND len(list_filter(r.days, lambda d: d <= 5)) > 0", f"(({ISO(O.london('starts_at'))} <= 5 AND {CLOCK} BETWEEN '17:30' AND '20:30') OR {LATE})"), hours_or("r.opens < '18:00'", f"{CLOCK} < '18:00'"), weekday_sql("(6, 7)")
COUNTS_SQL = {"evening": f"{PRICE20} AND {EVENING}", "after_work": f"{PRICE20} AND {AFTER_WORK}", "daytime": f"{PRICE20} AND {DAYTIME}", "weekend": f"{PRICE20} AND {WEEKEND}", "free": f"is_free AND {EVENING}", "up_to_10": f"{PRICE10} AND {EVENING}", "up_to_20": f"{PRICE20} AND {EVENING}", "unknown_price": f"NOT is_free AND price_min IS NULL AND {EVENING}"}


def listing_counts(df):
    """When-counts under the price filter (at most 20 pounds), price counts under the chosen bucket (evening)."""
    price, evening = P.price_at_most(2_000), P.when_evening()
    tests = {
        "evening": price & evening, "after_work": price & P.when_after_work(), "daytime": price & P.when_daytime(), "weekend": price & P.on_weekdays([6, 7], *since_window()),
        "free": F.col("is_free") & evening, "up_to_10": P.price_at_most(1_000) & evening, "up_to_20": price & evening, "unknown_price": P.price_unknown() & evening,
    }
    return facets.conditional_counts(inside(df), tests)


def counts_sql(tests, where):
    return f"SELECT {', '.join(f'count(*) FILTER (WHERE {t}) AS {n}' for n, t in tests.items())} FROM full_listing WHERE {where}"


add("listing_counts", counts_sql(COUNTS_SQL, INSIDE), True, FROM, TO)(listing_counts)
PICKS_SQL = {"tonight": TONIGHT, "openings": OPENINGS, "last_chance": LAST_CHANCE, "hands_on": HANDS_ON, "open_now": OPEN_NOW, "free": "is_free", "weekend": WEEKEND, "music": "category = 'music'", "all_upcoming": "true"}
add("quick_pick_counts", counts_sql(PICKS_SQL, f"{O.END} >= {W0}"), True, FROM)(
    lambda df: facets.conditional_counts(
        df.filter(P.from_day(FROM)),
        {"tonight": P.pick_tonight(today()), "openings": P.pick_openings(today()), "last_chance": P.pick_last_chance(today(), now()), "hands_on": P.pick_hands_on(), "open_now": P.pick_open_now(now()), "free": F.col("is_free"), "weekend": P.on_weekdays([6, 7], *since_window()), "music": F.col("category") == "music", "all_upcoming": F.lit(True)},
    )
)

# ---------------------------------------------------------------- calendar values of listings

add("london_date", f"SELECT id, strftime({O.ldate('starts_at')}, '%Y-%m-%d') AS first_day, {CLOCK} AS first_time FROM listing")(lambda df: df.select("id", F.date_format(london(F.col("starts_at")), "yyyy-MM-dd").alias("first_day"), F.date_format(london(F.col("starts_at")), "HH:mm").alias("first_time")))
def calendar_span(df):
    days = F.datediff(london(P.whole_end()).cast("date"), london(F.col("starts_at")).cast("date")) + 1
    return df.select("id", days.alias("days"), (days >= 4).alias("long_running"), (F.date_format(london(F.col("starts_at")), "HH:mm") == "00:00").alias("untimed"))


add("calendar_span", f"SELECT id, CAST({LAST} - {FIRST} + 1 AS INT) AS days, {LAST} - {FIRST} + 1 >= 4 AS long_running, {CLOCK} = '00:00' AS untimed FROM listing")(calendar_span)
