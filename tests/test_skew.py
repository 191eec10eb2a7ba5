"""A key holding a third of all rows: results stay whole and AQE splits the
hot partition in the shuffle fallbacks (broadcast paths have no shuffle)."""

import pytest
from pyspark.sql import functions as F

from incidentlab.operators.geo import with_neighborhood
from incidentlab.operators.joins import with_weather
from incidentlab.operators.weather import daily_weather

SKEW_CONF = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture()
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_cell_in_shuffle_fallback(skew_conf):
    spark = skew_conf
    polys = spark.createDataFrame(
        [(0, "West", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"),
         (1, "Far", "POLYGON ((50 50, 60 50, 60 60, 50 60, 50 50))")],
        "ord long, name string, polygon string")
    hot = F.col("id") % 3 == 0
    pts = spark.range(30000).select(
        "id", F.when(hot, 1.5).otherwise((F.col("id") % 97) * 0.6).alias("X"),
        F.when(hot, 1.5).otherwise((F.col("id") % 89) * 0.6).alias("Y"))
    out = with_neighborhood(pts, polys, cell_size=1.0, max_broadcast_bytes=0)
    assert "skew=true" in _final_plan(out)
    counts = {r.Neighborhood: r["count"] for r in out.groupBy("Neighborhood").count().collect()}
    assert sum(counts.values()) == 30000 and counts["West"] >= 10000


def test_hot_date_in_shuffle_fallback(skew_conf):
    spark = skew_conf
    inc = spark.range(30000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("2024-01-01"))
        .otherwise(F.date_format(F.date_add(F.lit("2024-01-02").cast("date"),
                                            (F.col("id") % 500).cast("int")), "yyyy-MM-dd"))
        .alias("Date"))
    readings = spark.range(2000).select(
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 501).cast("int")),
                      "yyyy-MM-dd").alias("date"),
        F.col("id").cast("double").alias("temp"), F.lit("Clear").alias("weather"),
        F.col("id").alias("seq"))
    out = with_weather(inc, daily_weather(readings))
    assert "skew=true" in _final_plan(out)
    assert out.count() == 30000


def test_hot_date_rollup_is_whole(spark):
    readings = spark.range(90000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 100).cast("string")).alias("date"),
        (F.col("id") % 7).cast("double").alias("temp"),
        F.when(F.col("id") % 5 == 0, "Rain").otherwise("Clear").alias("weather"), F.col("id").alias("seq"))
    got = {r.date: r for r in daily_weather(readings).collect()}
    hot = readings.filter("date = 'hot'").agg(F.avg("temp")).first()[0]
    assert got["hot"].temperatureC == pytest.approx(hot) and got["hot"].weather == "Clear"
    assert len(got) == 101


def test_hot_row_of_the_keyless_split_is_dealt_over_tasks(skew_conf):
    spark = skew_conf
    from incidentlab.operators.split import numbered_rows
    rows = spark.range(0, 30000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("v"), F.lit(None).cast("string").alias("__n"))
    got = numbered_rows(rows, copies=500).withColumn("task", F.spark_partition_id())
    assert got.count() == 30000 and got.columns[:2] == rows.columns
    assert got.groupBy("v", "__copy").count().where("count > 1").isEmpty()
    hot = got.where("v = -1")
    assert hot.agg(F.min("__copy"), F.max("__copy")).first()[:] == (1, 10000)
    per_task = [r["count"] for r in hot.groupBy("task").count().collect()]
    assert len(per_task) >= 4 and max(per_task) < 6000


def test_keyless_split_is_the_same_on_any_layout(spark):
    from incidentlab.operators.split import split_random
    rows = spark.range(4000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, F.lit(0.5)).alias("b"))

    def halves(df):
        return [sorted(map(str, part.collect())) for part in split_random(df, (0.7, 0.3), 3)]
    want = halves(rows.coalesce(1))
    assert sum(map(len, want)) == 4000 and 2600 < len(want[0]) < 3000
    for n in (2, 5):
        assert halves(rows.repartition(n, "a")) == want
