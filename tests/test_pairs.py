"""Pairs of listings that match, against the rule applied to all pairs."""

import datetime as dt
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import venue_key
from tidemark.operators import resolve

SCHEMA = "id long, title string, venue string, lat double, lng double, starts_at timestamp, ends_at timestamp"
DAY = dt.datetime(2026, 1, 5, 12)


def metres(a, b):
    if None in (a[3], a[4], b[3], b[4]):
        return math.inf
    la, lo, lb, lp = map(math.radians, (a[3], a[4], b[3], b[4]))
    return 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2)))


def brute(rows, keys):
    def venues(v, w):
        x, y = sorted((set(v.split("-")), set(w.split("-"))), key=len)
        return "unknown" not in (v, w) and (v == w or len(x) >= 2 and x <= y)

    split = lambda t: (t or "").lower().split()
    out = []
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[5] and b[5]:
                f, l, g, m = a[5].date(), max(a[5], a[6] or a[5]).date(), b[5].date(), max(b[5], b[6] or b[5]).date()
                if (f == g or l > f and m > g and f <= m and g <= l) and (venues(keys[a[0]], keys[b[0]]) or metres(a, b) <= 150):
                    tokens = lambda t: resolve.title_tokens(split(t), split(a[2]), split(b[2]))  # noqa: B023, E731
                    if resolve.titles_match(tokens(a[1]), tokens(b[1])):
                        out.append((a[0], b[0]))
    return sorted(out)


@pytest.mark.parametrize("whole", [resolve.WHOLE, 0])
def test_pairs_equal_the_rule_on_all_pairs(spark, monkeypatch, whole):
    monkeypatch.setattr(resolve, "WHOLE", whole)
    rng = random.Random(5)
    titles = ["jazz night", "night jazz", "jazz nights", "the exhibition", "monet 2026", "monet", "tate monet", "tate", "k b c d", "k b c d e", "a b", "", None, "impressionists", "impressionist"]
    venues = ["tate modern", "tate modern bankside", "bankside tate", "hall", "barbican", "barbican hall", "", None]
    rows = []
    for i in range(420):
        start = None if i % 40 == 7 else DAY + dt.timedelta(days=rng.randrange(25), hours=rng.randrange(3))
        end = None if start is None or rng.random() < 0.4 else start + dt.timedelta(days=rng.choice([-2, 0, 1, 6, 25]))
        lat, lng = (None, None) if rng.random() < 0.4 else (51.5 + rng.randrange(4) / 1000, -0.1 + rng.randrange(4) / 1000)
        rows.append((i - 210, rng.choice(titles), rng.choice(venues), lat, lng, start, end))
    df = spark.createDataFrame(rows, SCHEMA)
    keys = {r.id: r.v for r in df.select("id", venue_key(F.col("venue")).alias("v")).collect()}
    want = brute(rows, keys)
    assert len(want) > 100 and sorted(tuple(r) for r in resolve.fuzzy_pairs(df).collect()) == want


def test_places_are_near_in_the_north_and_across_the_date_line(spark):
    at = [(70.0, 20.0024), (70.0, 20.0062), (0.0, 179.9995), (0.0, -179.9995), (10.0, 5.0), (10.0, 5.0015)]
    rows = [(i, "jazz night", None, lat, lng, DAY, None) for i, (lat, lng) in enumerate(at)]
    want = brute(rows, {i: "unknown" for i in range(len(at))})
    assert want == [(0, 1), (2, 3)] == sorted(tuple(r) for r in resolve.fuzzy_pairs(spark.createDataFrame(rows, SCHEMA)).collect())


def test_a_busy_venue_is_joined_on_titles(spark):
    """60,000 long runs of 300 titles at one venue are 1.8 billion pairs of dates, of which 1 in 300 has one title."""
    i, n, k = F.col("id"), 60_000, 300
    df = spark.range(n).select("id", F.concat(F.lit("show"), (i % k).cast("string"), F.lit(" with "), F.sha1((i % k).cast("string"))).alias("title"), F.lit("Tate Modern").alias("venue"), *[F.lit(None).cast("double").alias(c) for c in ("lat", "lng")], (F.lit(DAY) + F.make_dt_interval(days=(i % 9).cast("int"))).alias("starts_at"), F.lit(DAY + dt.timedelta(days=20)).alias("ends_at"))
    began = time.monotonic()
    assert resolve.fuzzy_pairs(df).count() == k * (n // k) * (n // k - 1) // 2
    assert time.monotonic() - began < 90
