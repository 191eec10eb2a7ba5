"""Stream-static enrichment gives the batch result."""

import os

from incidentlab.plans.queries import WEATHER_DECIMALS
from incidentlab.operators.weather import daily_weather
from incidentlab.plans.enrich import enrich_incidents
from incidentlab.sources import testdata as td
from incidentlab.streaming.enrich_stream import enrich_stream, read_incident_stream, start_enrichment

from conftest import SF_SMALL


def test_stream_equals_batch(spark, tmp_dir):
    inc = td.incidents(spark, SF_SMALL)
    src = os.path.join(tmp_dir, "incoming")
    inc.repartition(4).write.parquet(src)
    sun = td.sun_times(spark, SF_SMALL)
    wx = daily_weather(td.weather_readings(spark, SF_SMALL), round_to=WEATHER_DECIMALS)
    poly = td.polygons(spark)

    stream = read_incident_stream(spark, src, inc.schema, max_files_per_trigger=1)
    enriched = enrich_stream(stream, sun, wx, poly)
    assert enriched.isStreaming
    out = os.path.join(tmp_dir, "out")
    q = start_enrichment(enriched, out, os.path.join(tmp_dir, "ckpt"))
    q.awaitTermination(300)
    assert q.exception() is None

    got = spark.read.parquet(out)
    want = enrich_incidents(inc, sun, wx, poly)
    cols = sorted(want.columns)
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())
