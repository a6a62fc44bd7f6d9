"""Behaviour tables: matching, resolution, search, recurrence, calendars, streams."""

import datetime as dt
import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import timex
from tidemark.operators import calendar, resolve, search
from tidemark.operators.components import components
from tidemark.plans import record_queries, text_queries
from tidemark.sources import html, ical, listings
from tidemark.streaming import streams

words = lambda t: resolve.title_tokens(t.lower().split())


@pytest.mark.parametrize("a, b, same", [
    ("k b c d", "k b c d e", True), ("k b c d e f", "k b c d e g h", False), ("Impressionists", "Impressionist", True), ("Turner 2026", "Turner", True), ("Jazz night", "Folk night", False),
    ("the exhibition", "tickets", False), ("Monet and the Sea", "Monet Sea exhibition", True),
])
def test_titles(a, b, same):
    assert resolve.titles_match(words(a), words(b)) == same == resolve.titles_match(words(b), words(a))


def test_venue_words_stay_when_nothing_else_is_left():
    assert resolve.title_tokens(["barbican"], ["barbican", "centre"]) == ["barbican"]
    assert resolve.title_tokens(["barbican", "jazz"], ["barbican"]) == ["jazz"]


def test_resolution_is_stable(spark):
    day = dt.datetime(2026, 10, 2, 19)
    rows = [(1, "a", "Monet and the Sea", "Tate Modern", day), (2, "b", "Monet Sea exhibition", "The Tate Modern Gallery", day), (3, "c", "Monet, Sea", "Tate Modern", day), (4, "b", "Drawing class", "Tate Modern", day), (5, "a", "Monet and the Sea", "Elsewhere", day), (6, "c", "Monet and the Sea", None, day)]
    frame = lambda r: spark.createDataFrame([(i, s, t, v, None, None, d, None) for i, s, t, v, d in r], "listing long, source string, title string, venue string, lat double, lng double, starts_at timestamp, ends_at timestamp")
    for order in (rows, rows[::-1]):
        got = {r.listing: r.event for r in resolve.resolve_events(frame(order)).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    apart = {r.listing: r.event for r in resolve.resolve_events(frame(rows), [(1, 2)]).collect()}
    assert apart[2] != apart[1] == apart[3]


def test_components(spark):
    nodes = spark.range(30).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(n, n + 1) for n in range(0, 9)] + [(20, n) for n in range(21, 25)], "a long, b long")
    got = {r.node: r.component for r in components(nodes, edges).collect()}
    assert got == {n: 0 if n < 10 else 20 if 20 <= n < 25 else n for n in range(30)}


@pytest.mark.parametrize("word, stem", [("paintings", "paint"), ("painted", "paint"), ("galleries", "galleri"), ("gallery", "galleri"), ("hopping", "hop"), ("relational", "relat"), ("generously", "generous"), ("happiness", "happi"), ("classes", "class"), ("sky", "sky")])
def test_stems(word, stem):
    assert search.stem(word) == stem


def test_search(spark):
    df = spark.createDataFrame([(1, "Paintings by Sámi artists"), (2, "Whitechapel late painting class"), (3, "Class of painting"), (4, "Music")], "id long, title string")
    index = search.index(df, "id", {"A": F.col("title")}).cache()
    found = lambda q: {r.id for r in search.websearch(index, "id", q).collect()}
    assert found("painting") == {1, 2, 3} and found("painting -class") == {1} and found('"painting class"') == {2} and found("music or sami") == {1, 4} and found("xylophonist") == set()
    known = search.lexicon(df, F.col("title"))
    assert [r.correction for r in search.corrections(["whitechaple"], known).collect()] == ["whitechapel"]
    assert [r.word for r in search.unmatched(["whitech", "zebra", "the"], known).collect()] == ["zebra"]
    assert search.damerau("ca", "abc") == 2 and abs(search.jaro_winkler("martha", "marhta") - 0.9611) < 1e-3


@pytest.mark.parametrize("rule", ["FREQ=WEEKLY;BYDAY=TU,SA", "FREQ=DAILY;INTERVAL=3;COUNT=20", "FREQ=WEEKLY;INTERVAL=2;UNTIL=20261101T000000Z", "FREQ=DAILY", "FREQ=WEEKLY;COUNT=3;BYDAY=MO,WE,FR"])
def test_recurrence_equals_the_walk(spark, rule):
    first, now = dt.date(2026, 9, 8), dt.date(2026, 10, 1)
    df = spark.createDataFrame([(1, first, rule, ["20261006"])], "id long, first date, rrule string, exdates array<string>")
    got = sorted(r.day for r in ical.recurrences(df, F.lit("2026-10-01 12:00:00").cast("timestamp")).collect())
    assert got == ical.occurrences_of(first, dict(p.split("=") for p in rule.split(";")), {dt.date(2026, 10, 6)}, now)


def test_every_order_is_resolved(spark):
    sf = "/root/testdata/sf0.001"
    found = [r.listing for r in text_queries.QUERIES["resolve_events"](spark, sf).collect()]
    assert sorted(found) == sorted(r.id for r in catalog.listings(spark, sf, lines=True).select("id").collect())


def test_recurrences_of_all_orders(spark):
    sf, now = "/root/testdata/sf0.001", dt.date(1998, 6, 15)
    rules = ["FREQ=WEEKLY;BYDAY=TU,SA", "FREQ=DAILY;INTERVAL=3;COUNT=90", "FREQ=WEEKLY;INTERVAL=2;UNTIL=19980801"]
    want = set()
    for i, first in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate")).collect():
        days = ical.occurrences_of(first, dict(p.split("=") for p in rules[i % 5].split(";")), {dt.date(1998, 6, 20)}, now) if i % 5 < 3 else [first]
        want |= {(i, str(d)) for d in days if i % 5 > 2 or d >= now - dt.timedelta(1)}
    assert {(r.id, str(r.day)) for r in text_queries.QUERIES["rrule_expand"](spark, sf).collect()} == want


def test_ical_files(spark, tmp_path):
    lines = ["BEGIN:VCALENDAR", "BEGIN:VEVENT", "UID:1", "SUMMARY:Talk\\, with ", " tea", "DTSTART;TZID=Europe/London:20260702T193000", "DTEND:20260702T203000Z", "END:VEVENT", "BEGIN:VEVENT", "UID:2", "DTSTART;VALUE=DATE:20261002", "RRULE:FREQ=WEEKLY", "EXDATE;VALUE=DATE:20261009", "END:VEVENT", "END:VCALENDAR"]
    (tmp_path / "a.ics").write_bytes("\r\n".join(lines).encode())
    rows = {r.uid: r for r in listings.read(spark, "ical", str(tmp_path)).collect()}
    assert rows["1"].summary == "Talk, with tea" and rows["1"].starts_at == dt.datetime(2026, 7, 2, 18, 30) and rows["2"].all_day and rows["2"].exdates == ["20261009"]
    with pytest.raises(ValueError, match="unknown platform"):
        listings.read(spark, "none", str(tmp_path))


def test_pages_and_json(spark, tmp_path):
    graph = {"@graph": [{"@type": "Event", "name": "A", "offers": [{"price": "7"}]}, {"@type": "Place"}, {"@type": ["MusicEvent"], "name": "B"}]}
    page = f'<p>Hi&nbsp;<b>there</b> , you</p><script>x</script><script type="application/ld+json">{json.dumps(graph)}</script><script type="application/ld+json">broken</script>'
    assert html.text_of(page) == "Hi there, you"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [(r.name, r.price) for r in html.jsonld_events(df).orderBy("name").collect()] == [("A", "7"), ("B", None)]
    (tmp_path / "p.json").write_text(json.dumps({"_embedded": {"events": [{"name": "x"}, {"name": "y"}]}}))
    assert {r.name for r in listings.read(spark, "json", str(tmp_path)).collect()} == {"x", "y"}


def test_folding_keeps_lines_short():
    line = "SUMMARY:" + "é" * 200
    parts = calendar.fold(line).split("\r\n")
    assert all(len(p.encode()) <= 75 for p in parts) and "".join(p[1:] if n else p for n, p in enumerate(parts[:-1])) == line


def test_stream_windows_and_limits(spark, tmp_path):
    base = dt.datetime(2026, 1, 1)
    rows = [(n % 2, base + dt.timedelta(seconds=20 * n)) for n in range(30)]
    spark.createDataFrame(rows, "client long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("client long, ts timestamp").parquet(f"{tmp_path}/in")
    for name, df in (("windows", streams.windowed_counts(source, "ts", "5 minutes", "1 minute")), ("limits", streams.limited(source, "client", "ts", 2, 60))):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] in (15, 30)
    got = {(r.client, r.ts): r.allowed for r in spark.table("limits").collect()}
    held: dict = {}
    for client, ts in rows:
        recent = [h for h in held.get(client, []) if h > ts - dt.timedelta(seconds=60)]
        assert got[client, ts] == (len(recent) < 2)
        held[client] = recent + [ts] if len(recent) < 2 else recent
    done = []
    query = streams.start_upserts(source, f"{tmp_path}/upserts", lambda batch, number: done.append((number, batch.count())))
    query.awaitTermination(120)
    assert done == [(0, 30)]


def test_times_of_orders_in_the_repeated_hour_follow_their_sql(spark):
    rows = [("2000-10-29 01:30:00",), ("2000-10-29 00:59:59",), ("2000-10-29 02:00:00",), ("2000-03-26 01:30:00",), ("2000-07-01 12:00:00",)]
    df = spark.createDataFrame(rows, "local string")
    local = F.to_timestamp("local")
    got = [tuple(r) for r in df.select(timex.shown(timex.utc(local)), timex.shown(timex.utc(local, later=True)), timex.shown(timex.parse_wall_clock(F.col("local"), later=True))).collect()]
    later = ["2000-10-29 01:30:00", "2000-10-28 23:59:59", "2000-10-29 02:00:00", "2000-03-26 01:30:00", "2000-07-01 11:00:00"]
    assert [g[0] for g in got] == ["2000-10-29 00:30:00", *later[1:]]
    assert [g[1] for g in got] == later and [g[2] for g in got] == later


@pytest.mark.parametrize("name", ["wall_clock", "london_to_utc_orders"])
def test_queries_in_the_repeated_hour_equal_their_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT CAST(i AS BIGINT) AS o_orderkey, DATE '2000-10-29'::TIMESTAMP AS o_orderdate FROM range(24) t(i) UNION ALL SELECT i + 24, DATE '2000-03-26'::TIMESTAMP FROM range(24) t(i)) TO '{tmp_path}/orders.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    want = con.execute(record_queries.ORACLES[name]).fetchall()
    assert sorted(tuple(r) for r in record_queries.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(want)


def test_clean_text_of_bare_entities_equals_its_sql(spark, tmp_path):
    pages = ["<p>a &amp b &amp; c</p>", "<h1>x&amp</h1>", "&copy 1 &copy; 2", "&ampfoo; &amp;copy; &middot;", "<a href='?a=1&amp=2'>q &</a> &quot;z&quot; AT&T"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(text_queries.ORACLES["clean_text"]).fetchall()
    assert sorted(tuple(r) for r in text_queries.QUERIES["clean_text"](spark, str(tmp_path)).collect()) == sorted(want)
    assert html.text_of("x&amp</h1>") == "x&"
