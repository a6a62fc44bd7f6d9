"""Query strings, cursors and pages; opening hours in prose."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark import catalog as C
from tidemark.functions.hours_text import from_text
from tidemark.plans import query

NOW = dt.datetime(1998, 6, 15, 12)
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("raw", ["x=1", "from=1998-02-01&to=1998-01-01", "at=now&from=1998-01-01", "within_hours=2", "radius_km=3", "near=51.5,0&radius_km=3&within_walk_min=5", "limit=0", "limit=101", "category=party", "open_now=true&when=evening", "open_now=true&open_at=1998-01-01", "cursor=zz", "near=95,0", "q=" + "x" * 201])
def test_errors(raw):
    with pytest.raises(query.QueryError):
        query.parse_query(raw, NOW)


def test_defaults_and_windows():
    assert query.parse_query("", NOW).sort == "fullest" and query.parse_query("q=jazz", NOW).sort == "relevance" and query.parse_query("near=51.5,-0.1", NOW).sort == "nearest"
    q = query.parse_query("sort=nearest&category=talk&category=talk&from=1998-06-15&to=1998-06-15", NOW)
    assert (q.sort, q.fell_back_from, q.chosen) == ("soonest", "nearest", {"category": ["talk"]})
    assert (q.since, q.until) == (dt.datetime(1998, 6, 14, 23), dt.datetime(1998, 6, 15, 23))
    assert query.parse_query("at=today", NOW).until == dt.datetime(1998, 6, 15, 23)


def test_cursors_come_back():
    for sort, position in (("soonest", [dt.datetime(1969, 1, 2, 3, 4, 5, 6)]), ("nearest", [1.25]), ("fullest", [NOW.date(), NOW.date(), 3, NOW]), ("surprise", [NOW.date()])):
        text = query.encode_cursor(sort, position, 77)
        assert query.decode_cursor(sort, text) == (position, 77)
        with pytest.raises(query.QueryError, match="match"):
            query.decode_cursor("richest", text)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("sort", ["soonest", "nearest", "ending", "added", "surprise", "richest", "fullest"])
def test_walk_visits_every_listing_once(spark, sort):
    listings = C.listings(spark, SF, lines=True).withColumn("first_seen", F.col("starts_at")).cache()
    raw = f"from=1998-06-15&to=1998-09-30&sort={sort}&limit=20&near=51.5,-0.1&radius_km=60"
    seen, cursor = [], ""
    while cursor is not None:
        q = query.parse_query(raw + cursor, NOW)
        rows = query.apply(q, listings, NOW).collect()
        seen += [r.id for r in rows[: q.limit]]
        cursor = query.next_cursor(q, rows)
        cursor = cursor and f"&cursor={cursor}"
    whole = query.parse_query(raw.replace("limit=20", "limit=100"), NOW)
    assert len(seen) == len({*seen}) and seen[:100] == [r.id for r in query.apply(whole, listings, NOW).collect()][:100]


@pytest.mark.parametrize("text, rules", [
    ("Wednesdays, Thursdays, Fridays & Sundays from 11am-3pm", [([3, 4, 5, 7], "11:00", "15:00")]), ("Open Tue–Sun, 10:00–17:00.", [([2, 3, 4, 5, 6, 7], "10:00", "17:00")]), ("10am to 5pm daily", [([1, 2, 3, 4, 5, 6, 7], "10:00", "17:00")]),
    ("Mon-Fri 9.30am-6pm; weekends 11-4pm", [([1, 2, 3, 4, 5], "09:30", "18:00"), ([6, 7], "11:00", "16:00")]), ("Friday 10am-5pm", None), ("Mon-Fri 9-5", None), ("Daily 10am-5pm except Mondays", None), ("Closed weekends 10am-5pm", None), ("Mondays 10am-12pm. Mondays 1pm-2pm", None), ("Doors at 7", None), ("Fri to Mon between 2pm and 6pm", [([1, 5, 6, 7], "14:00", "18:00")]),
])
def test_hours_in_prose(text, rules):
    found = from_text(text)
    assert (found and [(r["days"], r["opens"], r["closes"]) for r in found]) == rules


def test_relaxations_drop_one_filter_each():
    from datetime import date

    from tidemark.plans.query import relaxations

    found = relaxations("q=jazz&from=2026-10-01&category=talk&category=music&free=1", date(2026, 10, 1))
    assert found == [("Type: talk, music", "q=jazz&from=2026-10-01&free=1"), ("Free", "q=jazz&from=2026-10-01&category=talk&category=music")]
    assert relaxations("to=2026-10-09", date(2026, 10, 1)) == [("Dates", "")] and relaxations("q=x", date(2026, 10, 1)) == []
