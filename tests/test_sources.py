"""File sources, sinks and landed-response parsing."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from incidentlab.schemas import PREDICTION_COLUMNS, incident_schema
from incidentlab.sources.files import (read_daily_weather, read_incidents, read_incidents_checked,
                                       read_polygons, read_sun_times)
from incidentlab.sources.responses import parse_sun_responses, parse_weather_responses
from incidentlab.sources.sinks import write_daily_table, write_predictions
from incidentlab.sources.spine import date_spine, sun_requests, weather_requests


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_read_incidents_csv(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "train.csv"),
               "Dates,Category,Descript,DayOfWeek,PdDistrict,Resolution,Address,X,Y\n"
               '2015-05-13 23:53:00,WARRANTS,WARRANT ARREST,Wednesday,NORTHERN,"ARREST, BOOKED",'
               "OAK ST / LAGUNA ST,-122.42,37.77\n"
               "not a time,X,Y,Monday,D,R,A,abc,37.7\n")
    rows = sorted(read_incidents(spark, p).collect(), key=lambda r: r.Dates is None)
    assert rows[0].Dates == dt.datetime(2015, 5, 13, 23, 53) and rows[0].Resolution == "ARREST, BOOKED"
    assert rows[0].X == -122.42
    assert rows[1].Dates is None and rows[1].X is None and rows[1].Y == 37.7
    bad = sorted(read_incidents(spark, p, corrupt_col="_bad").collect(), key=lambda r: r.Dates is None)
    assert bad[0]._bad is None and bad[1]._bad is not None


def test_incident_rows_that_do_not_fit_are_a_second_output(spark, tmp_dir):
    head = "Dates,Category,Descript,DayOfWeek,PdDistrict,Resolution,Address,X,Y\n"
    folder = os.path.join(tmp_dir, "parts")
    os.makedirs(folder)
    _write(os.path.join(folder, "a.csv"), head + '2015-05-13 23:53:00,A,B,Monday,N,"R, S",OAK ST,-122.42,37.77\n'
           "not a time,A,B,Monday,N,R,OAK ST,-122.42,37.77\n2015-05-13 23:53:00,A,B,Monday,N,R,OAK ST,,37.77\n")
    _write(os.path.join(folder, "b.csv"), head + "2015-05-14 00:00:00,A,B\n"
           "2015-05-14 00:00:00,A,B,Monday,N,R,OAK ST,1,2,3\n2015-05-14 00:00:00,A,B,Monday,N,R,OAK ST,abc,37.77\n")
    good, rejected = read_incidents_checked(spark, folder)
    assert good.columns == [f.name for f in incident_schema()]
    assert {(r.Resolution, r.X) for r in good.collect()} == {("R", None), ("R, S", -122.42)}
    got = sorted((os.path.basename(r.file), r.line, r.reason) for r in rejected.collect())
    assert got == [("a.csv", "not a time,A,B,Monday,N,R,OAK ST,-122.42,37.77", "value"),
                   ("b.csv", "2015-05-14 00:00:00,A,B", "fields"),
                   ("b.csv", "2015-05-14 00:00:00,A,B,Monday,N,R,OAK ST,1,2,3", "fields"),
                   ("b.csv", "2015-05-14 00:00:00,A,B,Monday,N,R,OAK ST,abc,37.77", "value")]
    # whatever columns are asked for, the same rows are judged
    assert good.select("Category").count() == 2 and rejected.select("reason").count() == 4
    nothing = _write(os.path.join(tmp_dir, "none.csv"), head)
    assert [f.count() for f in read_incidents_checked(spark, nothing)] == [0, 0]


def test_schema_exclusion():
    assert [f.name for f in incident_schema()][0] == "Dates"
    assert "Id" in [f.name for f in incident_schema(exclude=())]


def test_read_json_arrays(spark, tmp_dir):
    sun = _write(os.path.join(tmp_dir, "sun.json"), json.dumps([
        {"date": "2003-01-01", "sunrise": "3:25:00 PM", "sunset": "1:02:00 AM"},
        {"date": "2003-01-02", "sunrise": "3:25:10 PM"}], indent=2))
    got = [tuple(r) for r in read_sun_times(spark, sun).collect()]
    assert got == [("2003-01-01", "3:25:00 PM", "1:02:00 AM"), ("2003-01-02", "3:25:10 PM", None)]
    wx = _write(os.path.join(tmp_dir, "weather.json"), json.dumps([
        {"date": "2003-01-01", "temp": 10.5, "weather": "Clear"},
        {"date": "2003-01-02", "temperatureC": 11.0, "weather": "Rain"}]))
    got = [tuple(r) for r in read_daily_weather(spark, wx).collect()]
    assert got == [("2003-01-01", 10.5, "Clear"), ("2003-01-02", 11.0, "Rain")]


def test_read_polygons_keeps_file_order(spark, tmp_dir):
    p = _write(os.path.join(tmp_dir, "hoods.json"), json.dumps([
        {"name": "B", "polygon": "POLYGON ((0 0, 1 0, 1 1, 0 0))"},
        {"name": "A", "polygon": "POLYGON ((0 0, 1 0, 1 1, 0 0))"}]))
    rows = read_polygons(spark, p).collect()
    assert [r.name for r in sorted(rows, key=lambda r: (r.ord.file, r.ord.pos))] == ["B", "A"]


def test_write_predictions_three_files_and_no_overwrite(spark, tmp_dir):
    df = spark.range(30).selectExpr(*[f"cast(id as string) as `{c}`" for c in PREDICTION_COLUMNS])
    out = os.path.join(tmp_dir, "pred")
    write_predictions(df, out, files=3)
    parts = [f for f in os.listdir(out) if f.startswith("part-")]
    assert len(parts) == 3
    with open(os.path.join(out, parts[0])) as f:
        assert f.readline().strip().split(",") == PREDICTION_COLUMNS
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        write_predictions(df, out)


def test_daily_table_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([("2024-01-01", 1.5, "Clear")], "date string, temperatureC double, weather string")
    out = os.path.join(tmp_dir, "daily")
    write_daily_table(df, out)
    assert [tuple(r) for r in read_daily_weather(spark, out, layout="lines").collect()] == \
        [("2024-01-01", 1.5, "Clear")]


def test_sun_responses(spark):
    df = spark.createDataFrame([
        ("2003-01-01", '{"results":{"sunrise":"3:25:00 PM","sunset":"1:02:00 AM"},"status":"OK"}'),
        ("2003-01-02", '{"results":{"sunrise":"3:25:10 PM"}}'),
        ("2003-01-03", "<html>rate limited</html>"),
        ("2003-01-04", '{"status":"INVALID_DATE"}'),
    ], "date string, body string")
    good, bad = parse_sun_responses(df)
    assert sorted(tuple(r) for r in good.collect()) == [
        ("2003-01-01", "3:25:00 PM", "1:02:00 AM"), ("2003-01-02", "3:25:10 PM", None)]
    assert sorted(r.date for r in bad.collect()) == ["2003-01-03", "2003-01-04"]


def test_weather_responses_rules(spark):
    head = "h1\nh2\n"
    full = "t,{temp},a,b,c,d,e,f,g,h,i,{cond},z"
    bodies = [
        ("2003-01-01", head + full.format(temp="10.0", cond="Clear") + "\n"
         + full.format(temp="-", cond="Rain") + "\n" + "t,1,2,3\n"
         + "t,12.0,a,b,c,d,e,f,g,h,i,,,,\n"
         + full.format(temp=" 14.0 ", cond="Fog")),
    ]
    df = spark.createDataFrame(bodies, "date string, body string")
    good, bad = parse_weather_responses(df)
    assert [(r.temp, r.weather, r.seq, r.line_no) for r in good.orderBy("seq").collect()] == [
        (10.0, "Clear", 2, 2), (14.0, "Fog", 6, 6)]
    keyed, _ = parse_weather_responses(df.withColumn("rid", F.lit(7)), order="rid")
    assert [int(r.seq) for r in keyed.orderBy("seq").collect()] == [7 * 10 ** 9 + 2, 7 * 10 ** 9 + 6]
    assert [(r.line_no, r.reason) for r in bad.orderBy("line_no").collect()] == [
        (3, "temperature is not a number"), (4, "too few fields"), (5, "too few fields")]


def test_weather_mode_tie_goes_to_first_seen(spark):
    from incidentlab.operators.weather import daily_weather
    readings = spark.createDataFrame(
        [("d", 1.0, "a", 1), ("d", 2.0, "b", 2), ("d", 3.0, "a", 3), ("d", 4.0, "b", 4),
         ("e", 1.0, "x", 9), ("e", 1.0, "y", 8)],
        "date string, temp double, weather string, seq long")
    got = sorted(tuple(r) for r in daily_weather(readings).collect())
    assert got == [("d", 2.5, "a"), ("e", 1.0, "y")]


def test_spine_and_urls(spark):
    d = date_spine(spark, "2003-01-01", "2003-01-03")
    sun = sorted(tuple(r) for r in sun_requests(d).collect())
    assert sun[0] == ("2003-01-01", "http://api.sunrise-sunset.org/json?lat=37.774900&lng=-122.419400&date=2003-01-01")
    wx = sorted(tuple(r) for r in weather_requests(d).collect())
    assert wx[2][1].endswith("/KSFO/2003/1/3/DailyHistory.html?format=1")


def test_tables_cli_builds_both_day_tables(spark, tmp_dir):
    from incidentlab.plans.jobs import main
    from incidentlab.sources import testdata as td
    from conftest import SF_SMALL
    sun_in, wx_in = os.path.join(tmp_dir, "sun_in"), os.path.join(tmp_dir, "wx_in")
    td.sun_responses(spark, SF_SMALL).write.json(sun_in)
    td.weather_responses(spark, SF_SMALL).select("date", "body").write.json(wx_in)
    sun_out, wx_out = os.path.join(tmp_dir, "sun_out"), os.path.join(tmp_dir, "wx_out")
    main(["tables", "--sun-responses", sun_in, "--weather-responses", wx_in,
          "--sun-out", sun_out, "--weather-out", wx_out])
    sun = read_sun_times(spark, sun_out, layout="lines")
    wx = read_daily_weather(spark, wx_out, layout="lines")
    assert sun.count() == td.sun_times(spark, SF_SMALL).count() - 1   # one body is not JSON
    assert wx.count() == td.sun_times(spark, SF_SMALL).count()        # one row per local date
    assert wx.filter("temperatureC IS NULL OR weather IS NULL").count() == 0


def test_request_list_job(spark, tmp_dir):
    from incidentlab.plans import jobs
    jobs.main(["requests", "--start", "2003-01-01", "--end", "2003-01-03", "--out", tmp_dir + "/requests"])
    got = spark.read.json(tmp_dir + "/requests").collect()
    assert sorted({(r.date, r.service) for r in got}) == sorted(
        (f"2003-01-0{d}", s) for d in (1, 2, 3) for s in ("sun", "weather"))
