"""The views of the catalog in DuckDB SQL, written apart from the engine to check it against."""

from tidemark.catalog import CATEGORIES, EVENTS_NOW, GOOD_FOR, MUSIC_TAGS, NOW, SEGMENTS


def london(x: str) -> str:
    return f"timezone('Europe/London', timezone('UTC', {x}))"


def utc(x: str) -> str:
    return f"timezone('UTC', timezone('Europe/London', {x}))"


def ldate(x: str) -> str:
    return f"CAST({london(x)} AS DATE)"


def ltime(x: str) -> str:
    return f"strftime({london(x)}, '%H:%M')"


def midnight(d: str) -> str:
    return utc(f"CAST({d} AS TIMESTAMP)")


def one_of(values: list[str], number: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({number}) + 1]"


NOW_SQL, EVENTS_NOW_SQL = f"TIMESTAMP '{NOW}'", f"TIMESTAMP '{EVENTS_NOW}'"
END = "coalesce(ends_at, starts_at)"

_SEGMENTS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENTS.items())
_GOOD = ", ".join(f"CASE WHEN o % {n + 2} = 0 THEN '{g}' END" for n, g in enumerate(GOOD_FOR))
_RULE = lambda days, opens, closes: f"{{'days': {days}, 'opens': '{opens}', 'closes': '{closes}'}}"

LISTING = f"""
base AS (SELECT o_orderkey AS o, o_custkey AS c, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS d, c_name, c_mktsegment, n_name
         FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
timed AS (SELECT *, o % 3 = 0 AS all_day, CASE WHEN o % 3 = 0 THEN d ELSE d + to_hours(CAST(9 + o % 14 AS INT)) END AS s0,
                 CASE WHEN o % 4 = 0 THEN NULL WHEN o % 3 = 0 THEN d + to_days(CAST(o % 60 AS INT)) ELSE d + to_days(CAST(o % 60 AS INT)) + INTERVAL 23 HOUR END AS e0 FROM base),
held AS (SELECT *, CASE WHEN o % 7 = 0 AND NOT all_day THEN list_transform(range(0, 2 + o % 5), lambda k: {{'starts_at': {utc('s0 + to_days(CAST(k * 7 AS INT))')}, 'ends_at': {utc('s0 + to_days(CAST(k * 7 AS INT)) + INTERVAL 2 HOUR')}}}) END AS sessions FROM timed),
listing AS (SELECT o AS id, c AS venue_id, c_name AS venue, coalesce(sessions[1].starts_at, {utc('s0')}) AS starts_at, coalesce(sessions[-1].ends_at, {utc('e0')}) AS ends_at, all_day, sessions,
    CASE WHEN NOT all_day THEN NULL WHEN c % 4 = 0 THEN [{_RULE([1, 2, 3, 4, 5], '10:00', '18:00')}, {_RULE([6, 7], '11:00', '17:00')}]
         WHEN c % 4 = 1 THEN [{_RULE([3, 4, 5, 6, 7], '12:00', '20:00')}] WHEN c % 4 = 2 THEN [{_RULE([4, 5, 6], '10:00', '21:00')}] END AS hours,
    {one_of(CATEGORIES, 'o % 6')} AS category, o % 11 = 0 AS is_free, CASE WHEN o % 10 = 9 THEN 'EUR' WHEN o % 3 <> 1 THEN 'GBP' END AS currency, n_name AS borough,
    CASE c_mktsegment {_SEGMENTS} END AS venue_type, 51.28::DOUBLE + (c % 420)::DOUBLE / 1000 AS lat, -0.52::DOUBLE + (c * 7 % 860)::DOUBLE / 1000 AS lng,
    list_filter([{_GOOD}], lambda x: x IS NOT NULL) AS good_for,
    CASE WHEN o % 6 = 5 THEN list_sort(list_distinct([{one_of(MUSIC_TAGS, 'o % 5')}, {one_of(MUSIC_TAGS, '(o // 7) % 5')}])) ELSE [] END AS music,
    CASE WHEN c % 9 = 0 THEN ['art_pass'] ELSE [] END AS memberships, o * 37 % 300 AS description_length, o % 2 = 0 AS has_image, o % 4 = 2 AS has_thumbnail, o % 8 = 1 AS has_note,
    o % 13 = 0 AS late_opening, o % 17 = 0 AS opening_tag, o % 19 = 0 AS workshop_tag FROM held)"""

LINES = """
lines AS (SELECT l_orderkey, min(p_name) AS title, CAST(min(floor(round(l_extendedprice * 100) / 1000)) AS BIGINT) AS price_min, CAST(max(floor(round(l_extendedprice * 100) / 1000)) AS BIGINT) AS price_max,
                 list_sort(list(DISTINCT p_brand)) AS mediums, list_sort(list(DISTINCT p_type)) AS formats FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
full_listing AS (SELECT listing.*, coalesce(title, 'untitled') AS title, price_min, price_max, coalesce(mediums, []) AS mediums, coalesce(formats, []) AS formats FROM listing LEFT JOIN lines ON id = l_orderkey)"""

LINKS = """links AS (SELECT l_orderkey AS id, l_suppkey AS source_id, min(l_shipdate) AS first_seen FROM lineitem GROUP BY 1, 2)"""

SOURCES = """srcs AS (SELECT s_suppkey AS source_id, 'source-' || s_suppkey AS source_key, ['api', 'scraper', 'aggregator'][s_suppkey % 3 + 1] AS kind FROM supplier)"""

RUNS = """
spine AS (SELECT r AS source_id, CAST(d AS DATE) AS run_day FROM range(60) t(r), (SELECT unnest(generate_series(min(ts)::DATE::TIMESTAMP, max(ts)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM events)),
counted AS (SELECT user_id % 60 AS source_id, ts::DATE AS run_day, count(*) AS found, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2),
runs AS (SELECT source_id, run_day, coalesce(found, 0) AS found, coalesce(errors, 0) AS errors, coalesce(errors, 0) < 3 AS ok FROM spine LEFT JOIN counted USING (source_id, run_day))"""


def query(select: str, *views: str) -> str:
    return f"WITH {', '.join(views or (LISTING,))} {select}"


def listing(select: str, lines: bool = False) -> str:
    """A select over `listing`, or over `full_listing` with lines."""
    return query(select, LISTING, LINES) if lines else query(select, LISTING)


def some(array: str, test: str, name: str) -> str:
    return f"coalesce(len(list_filter({array}, lambda {name}: {test})) > 0, false)"
