"""Counts equal the lists they describe, pages visit every row once, predicates keep their corner cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import catalog as C
from tidemark.functions import geo, timex
from tidemark.operators import facets, ranking
from tidemark.operators import predicates as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def listings(spark):
    return C.listings(spark, SF, lines=True).cache()


def test_counts_equal_lists(listings):
    tests = {"evening": P.when_evening(), "weekend": P.on_weekdays([6, 7], None, None), "cheap": P.price_at_most(1_000), "unknown": P.price_unknown()}
    counted = facets.conditional_counts(listings, tests).first().asDict()
    assert counted == {name: listings.filter(test).count() for name, test in tests.items()}
    chosen = {"venue_type": F.col("venue_type") == "museum", "borough": F.col("borough") == "NATION_3"}
    for row in facets.facet(listings, "venue_type", chosen).collect():
        assert row.n == listings.filter((F.col("borough") == "NATION_3") & (F.col("venue_type") == row.value)).count()


@pytest.mark.parametrize("order", [[("starts_at", False), ("id", False)], [("starts_at", True), ("id", True)], [("category", False), ("starts_at", False), ("id", False)]])
def test_pages_visit_every_row_once(listings, order):
    rows = listings.select("id", "starts_at", "category").limit(137).cache()
    seen, cursor = [], None
    while True:
        page = ranking.page(rows, order, 25, cursor).collect()
        seen += [r.id for r in page[:25]]
        if len(page) <= 25:
            break
        cursor = [page[24][name] for name, _ in order]
    key = sorted(rows.collect(), key=lambda r: [r[n] for n, _ in order], reverse=order[0][1])
    assert seen == [r.id for r in key]


def test_slots_put_two_rich_before_each_plain(listings):
    by_day = {}
    for r in ranking.with_slots(listings, P.day_column("1998-06-15")).select("day", "slot", "rich").collect():
        by_day.setdefault(r.day, []).append((r.slot, r.rich))
    for slots in by_day.values():
        assert all((slot % 3 == 0) != rich for slot, rich in slots) and len({*slots}) == len(slots)


ROW = "id long, starts_at timestamp, ends_at timestamp, all_day boolean, sessions array<struct<starts_at:timestamp,ends_at:timestamp>>, hours array<struct<days:array<int>,opens:string,closes:string>>"


def at(text):
    return dt.datetime.strptime(text, "%Y-%m-%d %H:%M")


def test_three_graces(spark):
    now = C.instant("2026-10-01 12:00:00")
    rows = [
        (1, at("2026-10-01 11:30"), None, False, None, None), (2, at("2026-10-01 10:30"), None, False, None, None), (3, at("2026-09-30 23:00"), None, True, None, None), (4, at("2026-09-29 23:00"), None, True, None, None),
        (5, at("2026-09-01 09:00"), at("2026-10-01 12:00"), False, None, None), (6, at("2026-10-01 08:00"), at("2026-10-20 10:00"), False, [(at("2026-10-01 08:00"), at("2026-10-01 10:00")), (at("2026-10-20 08:00"), at("2026-10-20 10:00"))], None),
    ]
    df = spark.createDataFrame(rows, ROW)
    assert {r.id for r in df.filter(P.still_on(now, now + F.expr("INTERVAL 1 SECOND"))).collect()} == {1, 3}
    assert {r.id for r in df.filter(P.effective_end() > now).collect()} == {1, 2, 3, 6}


def test_clock_change_days(spark):
    df = spark.createDataFrame([(1, at("2026-10-23 23:00"), at("2026-10-24 23:00"), True, None, None)], ROW)
    assert df.select(timex.shown(P.effective_end()).alias("t")).first().t == "2026-10-26 00:00:00"
    assert df.filter(P.on_weekdays([7], C.instant("2026-12-01 00:00:00"), C.instant("2026-11-01 00:00:00"))).count() == 0


def test_box_holds_the_circle():
    for lat, lng, km in ((51.5, -0.1, 5.0), (-70.0, 179.0, 80.0), (0.0, 0.0, 0.5)):
        low_lat, high_lat, low_lng, high_lng = geo.bounding_box(lat, lng, km)
        assert low_lat < lat < high_lat and low_lng <= lng <= high_lng
