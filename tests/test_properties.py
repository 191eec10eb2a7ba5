"""Property tests: Spark expressions against plain-Python statements of the
same rules, on random batches (one Spark job per batch)."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from incidentlab.functions import contains_point, day_or_night, street_name, wkt_edges
from incidentlab.operators.split import split_by_key
from incidentlab.plans.queries import _daily, enriched
from incidentlab.sources import testdata as td

from conftest import SF_SMALL

SETTINGS = settings(max_examples=5, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture,
                                           HealthCheck.too_slow, HealthCheck.data_too_large])


def py_street(a):
    m = re.search(r"\d{1,4} Block of (.+)", a)
    if m:
        return m.group(1)
    m = re.search(r"(.+) / (.+)", a)
    if m:
        return min(m.group(1), m.group(2))
    return a


pieces = st.sampled_from(["1", "23", "800", "10000", " Block of ", " / ", "/", "OAK ST", "A", "b",
                          " ", "é", "PIER 39", "of"])
addresses = st.lists(pieces, min_size=1, max_size=7).map("".join)


@SETTINGS
@given(st.lists(addresses, min_size=50, max_size=200))
def test_street_matches_python_rule(spark, batch):
    df = spark.createDataFrame([(a,) for a in batch], "a string")
    got = [r[0] for r in df.select(street_name("a")).collect()]
    assert got == [py_street(a) for a in batch]


def py_day_night(t, r, s):
    if r > s:
        return "Night" if s < t < r else "Day"
    return "Day" if r < t < s else "Night"


times = st.integers(min_value=0, max_value=86399)


@SETTINGS
@given(st.lists(st.tuples(times, times, times), min_size=50, max_size=200))
def test_day_night_matches_python_rule(spark, batch):
    df = spark.createDataFrame(batch, "t int, r int, s int")
    got = [r[0] for r in df.select(day_or_night("t", "r", "s")).collect()]
    assert got == [py_day_night(*b) for b in batch]


def py_contains(rings, x, y):
    inside = False
    for ring in rings:
        pts = ring if ring[0] == ring[-1] else ring + [ring[0]]
        for (x1, y1), (x2, y2) in zip(pts, pts[1:]):
            if (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) == 0 and \
                    min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            if ((y1 > y) != (y2 > y)) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


coord = st.integers(min_value=0, max_value=20).map(float)
rings = st.lists(st.tuples(coord, coord), min_size=3, max_size=8)


@SETTINGS
@given(st.lists(rings, min_size=1, max_size=2),
       st.lists(st.tuples(coord, coord), min_size=50, max_size=150))
def test_containment_matches_ray_casting(spark, polygon, points):
    wkt = "POLYGON (" + ", ".join(
        "(" + ", ".join(f"{x} {y}" for x, y in r) + ")" for r in polygon) + ")"
    df = spark.createDataFrame([(wkt, x, y) for x, y in points], "w string, x double, y double")
    got = [r[0] for r in df.withColumn("e", wkt_edges("w"))
           .select(contains_point("e", "x", "y")).collect()]
    assert got == [py_contains([list(r) for r in polygon], x, y) for x, y in points]


@SETTINGS
@given(st.lists(st.integers(min_value=-10**12, max_value=10**12), min_size=20, max_size=300,
                unique=True), st.integers(min_value=0, max_value=100))
def test_key_split_is_disjoint_and_complete(spark, keys, pct):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    train, test = split_by_key(df, "k", pct)
    a = {r.k for r in train.collect()}
    b = {r.k for r in test.collect()}
    assert not (a & b) and (a | b) == set(keys)


def test_enrichment_keeps_exactly_incidents_with_sun_and_weather(spark):
    from incidentlab.operators.features import time_features
    inc = time_features(td.incidents(spark, SF_SMALL))
    days = td.sun_times(spark, SF_SMALL).select(F.col("date").alias("Date")) \
        .join(_daily(spark, SF_SMALL).select(F.col("date").alias("Date")), "Date")
    expected = inc.join(days, "Date", "left_semi").count()
    assert enriched(spark, SF_SMALL).count() == expected


@SETTINGS
@given(st.lists(st.lists(rings, min_size=1, max_size=2), min_size=1, max_size=3),
       st.lists(st.tuples(coord, coord), min_size=50, max_size=150),
       st.sampled_from([(0.5, None), (1.0, None), (3.0, None), (7.0, None), (1.0, 0)]))
def test_grid_lookup_equals_first_match_ray_casting(spark, polygons, points, grid):
    from incidentlab.operators.geo import with_neighborhood
    cell, max_bytes = grid
    wkts = ["POLYGON (" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in r) + ")" for r in poly)
            + ")" for poly in polygons]
    polys = spark.createDataFrame([(i, f"p{i}", w) for i, w in enumerate(wkts)],
                                  "ord long, name string, polygon string")
    pts = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)],
                                "Id long, X double, Y double")
    # degenerate random rings are invalid polygons: dropped, they contain nothing
    opts = {"cell_size": cell, "on_error": "default"}
    if max_bytes is not None:
        opts["max_broadcast_bytes"] = max_bytes
    got = {r.Id: r.Neighborhood for r in with_neighborhood(pts, polys, **opts).collect()}

    def first(x, y):
        for i, poly in enumerate(polygons):
            if py_contains([list(r) for r in poly], x, y):
                return f"p{i}"
        return "SF"
    assert got == {i: first(x, y) for i, (x, y) in enumerate(points)}


def test_key_split_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([(1,), (None,), (3,), (None,)], "k long")
    train, test = split_by_key(df, "k", 70)
    assert train.count() + test.count() == 4 and train.filter("k IS NULL").count() == 2


@pytest.mark.parametrize("key", [None, "k"])
def test_random_split_does_not_depend_on_layout(spark, key):
    from incidentlab.operators.split import split_random
    df = spark.range(3000).selectExpr("id AS k", "id % 7 AS v").union(spark.createDataFrame([(5, 5)] * 40, "k long, v long"))
    seen = []
    for n in (1, 3, 8):
        train, test = split_random(df.repartition(n), (0.7, 0.3), 42, key=key)
        a, b = sorted(map(tuple, train.collect())), sorted(map(tuple, test.collect()))
        assert sorted(a + b) == sorted(map(tuple, df.collect())) and 0.65 < len(a) / 3040 < 0.75
        seen.append(a)
    assert seen[0] == seen[1] == seen[2]


def test_sub_seconds_survive_the_csv_sink(spark, tmp_dir):
    from incidentlab.sources.files import READ_TS_FORMAT
    from incidentlab.sources.sinks import write_predictions
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 01:02:03.456789' AS Dates")
    write_predictions(df, tmp_dir + "/csv", columns=["Dates"])
    back = spark.read.option("header", True).option("timestampNTZFormat", READ_TS_FORMAT) \
        .schema("Dates timestamp_ntz").csv(tmp_dir + "/csv")
    assert back.collect() == df.collect()


def test_rejected_responses_are_written_and_counted(spark, tmp_dir):
    from incidentlab.plans.tables import build_tables
    from incidentlab.sources import testdata as td
    sun, weather = td.sun_responses(spark, SF_SMALL), td.weather_responses(spark, SF_SMALL)
    counts = build_tables(sun, weather, tmp_dir + "/sun", tmp_dir + "/weather", order="rid")
    assert counts["sun"] == spark.read.json(tmp_dir + "/sun_rejected").count() > 0
    assert counts["weather"] == spark.read.json(tmp_dir + "/weather_rejected").count() > 0
