"""Per-day joins and the polygon lookup, including their fallback plans."""

import pytest
from pyspark.sql import functions as F

from incidentlab.operators.geo import choose_cell_size, polygon_table, with_neighborhood
from incidentlab.operators.joins import with_sun_times, with_weather
from incidentlab.sources import testdata as td

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_inner_joins_drop_missing_dates(spark):
    inc = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "Id long, Date string")
    sun = spark.createDataFrame([("2024-01-01", "6:00:00 AM", "6:00:00 PM")],
                                "date string, sunrise string, sunset string")
    wx = spark.createDataFrame([("2024-01-01", 10.0, "Clear"), ("2024-01-02", 11.0, "Rain")],
                               "Date string, temp double, weather string")
    out = with_weather(with_sun_times(inc, sun), wx)
    assert [tuple(r) for r in out.select("Id", "Date", "sunrise", "temperatureC").collect()] == \
        [(1, "2024-01-01", "6:00:00 AM", 10.0)]
    assert with_sun_times(inc, sun, how="left").count() == 2


def test_duplicate_dates_rejected(spark):
    inc = spark.createDataFrame([(1, "2024-01-01")], "Id long, Date string")
    sun = spark.createDataFrame([("2024-01-01", "a", "b"), ("2024-01-01", "c", "d")],
                                "date string, sunrise string, sunset string")
    with pytest.raises(ValueError, match="repeated"):
        with_sun_times(inc, sun, check_unique=True)


def test_broadcast_only_below_threshold_and_no_job_while_planning(spark, tmp_dir):
    inc = spark.createDataFrame([(1, "2024-01-01")], "Id long, Date string")
    path = tmp_dir + "/weather"
    spark.createDataFrame([("2024-01-01", 1.0, "Clear", "unused")],
                          "date string, temp double, weather string, more string").write.parquet(path)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    wx = spark.read.schema("date string, temp double, weather string, more string").parquet(path)
    joined = with_weather(inc, wx)
    assert "BroadcastHashJoin" in _plan(joined) and "more" not in joined.columns
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == jobs
    assert "InMemoryTableScan" not in _plan(joined)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in _plan(with_weather(inc, wx))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_join_sees_a_replaced_day_file(spark, tmp_dir):
    inc = spark.createDataFrame([(1, "2024-01-01")], "Id long, Date string")
    path = tmp_dir + "/replaced"

    def degrees(value):
        (spark.createDataFrame([("2024-01-01", value, "Clear")], "date string, temp double, weather string")
         .write.mode("overwrite").json(path))
        wx = spark.read.schema("date string, temp double, weather string").json(path)
        return [r.temperatureC for r in with_weather(inc, wx).collect()]
    assert [degrees(1.0), degrees(22.0)] == [[1.0], [22.0]]


def test_points_that_are_no_numbers_lie_nowhere(spark):
    polys = spark.createDataFrame([(0, "Origin", "POLYGON ((-1 -1, 1 -1, 1 1, -1 1, -1 -1))")],
                                  "ord long, name string, polygon string")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, float("nan"), 0.0), (3, 0.0, float("inf")), (4, float("nan"), float("nan"))],
                                "Id long, X double, Y double")
    got = {r.Id: r.Neighborhood for r in with_neighborhood(pts, polys).collect()}
    assert got == {1: "Origin", 2: "SF", 3: "SF", 4: "SF"}


def test_huge_and_many_overlapping_polygons(spark):
    wide = spark.createDataFrame([(0, "Wide", "POLYGON ((-120 -60, 120 -60, 120 60, -120 60, -120 -60))")],
                                 "ord long, name string, polygon string")
    size, fits = choose_cell_size(polygon_table(wide), 0.0025, max_bytes=10)
    assert not fits and size > 1_000
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 130.0, 0.0)], "Id long, X double, Y double")
    got = {r.Id: r.Neighborhood for r in with_neighborhood(pts, wide, max_broadcast_bytes=10).collect()}
    assert got == {1: "Wide", 2: "SF"}
    many = spark.range(10_000).select(
        F.col("id").alias("ord"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("name"),
        F.lit("POLYGON ((0 0, 8 0, 8 8, 0 8, 0 0))").alias("polygon"))
    got = {r.Id: r.Neighborhood for r in with_neighborhood(
        pts.withColumn("X", F.col("X") + 1.5).withColumn("Y", F.col("Y") + 1.5), many, cell_size=1.0).collect()}
    assert got == {1: "p0", 2: "SF"}
    with pytest.raises(ValueError, match="Wild"):
        with_neighborhood(pts, spark.createDataFrame([(0, "Wild", "POLYGON ((0 0, 9e9 0, 9e9 9, 0 9, 0 0))")],
                                                     "ord long, name string, polygon string"))


POLYS = [
    (0, "West", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"),
    (1, "East", "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))"),
    (2, "Box", "POLYGON ((10 0, 20 0, 20 10, 10 10, 10 0), (14 4, 16 4, 16 6, 14 6, 14 4))"),
]
POINTS = [(1, 1.0, 1.0, "West"), (2, 3.0, 3.0, "West"), (3, 15.0, 5.0, "SF"),
          (4, 12.0, 5.0, "Box"), (5, 50.0, 50.0, "SF"), (6, 5.0, 5.0, "East"),
          (7, None, 1.0, "SF"), (8, 4.0, 1.0, "SF")]


@pytest.mark.parametrize("opts", [
    {"cell_size": 1.0},
    {"cell_size": 0.25, "max_broadcast_bytes": 10_000},   # grid gets coarsened
    {"cell_size": 1.0, "max_broadcast_bytes": 0},         # too big: shuffle join on cells
])
def test_neighborhood_rules(spark, opts):
    pts = spark.createDataFrame([p[:3] for p in POINTS], "Id long, X double, Y double")
    out = with_neighborhood(pts, spark.createDataFrame(POLYS, "ord long, name string, polygon string"),
                            **opts)
    assert sorted((r.Id, r.Neighborhood) for r in out.collect()) == [(p[0], p[3]) for p in POINTS]
    assert out.count() == len(POINTS)


def test_grid_coarsening(spark):
    poly = polygon_table(spark.createDataFrame(POLYS, "ord long, name string, polygon string"))
    size, fits = choose_cell_size(poly, 0.001, max_bytes=50_000)
    assert fits and size > 0.001
    assert choose_cell_size(poly, 1.0, max_bytes=0) == (2.0 ** 23, False)     # the coarsest


def test_invalid_polygon(spark):
    polys = spark.createDataFrame([(0, "Bad", "POLYGON ((0 0, x 0, 1 1, 0 0))"), (1, "Ok", POLYS[0][2])],
                                  "ord long, name string, polygon string")
    pts = spark.createDataFrame([(1, 1.0, 1.0)], "Id long, X double, Y double")
    with pytest.raises(ValueError, match="Bad"):
        with_neighborhood(pts, polys)
    assert with_neighborhood(pts, polys, on_error="default").first().Neighborhood == "Ok"


def test_neighborhood_plan_is_broadcast_and_row_preserving(spark):
    inc = td.incidents(spark, SF_SMALL)
    out = with_neighborhood(inc, td.polygons(spark))
    plan = _plan(out)
    assert "BroadcastHashJoin" in plan and "LeftOuter" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert out.count() == inc.count()


@pytest.mark.parametrize("polys,cell", [(POLYS, 0.5), (POLYS, 1.0), (POLYS, 3.0),
                                        (td.TEST_POLYGONS, 0.0025), (td.TEST_POLYGONS, 0.001)])
def test_grid_estimate_is_an_upper_bound(spark, polys, cell):
    from incidentlab.operators import geo
    from incidentlab.operators.geo import polygon_cells
    poly = polygon_table(spark.createDataFrame(polys, "ord long, name string, polygon string"))
    cells = polygon_cells(poly, cell)
    actual = cells.select(F.explode("cands").alias("c")).agg(F.sum(
        geo._CANDIDATE_BYTES + F.size("c.edges") * geo._EDGE_BYTES)).first()[0]
    # a budget one byte below the real size must not accept this grid size
    size, fits = choose_cell_size(poly, cell, max_bytes=actual - 1)
    assert size != cell or not fits
    assert choose_cell_size(poly, cell, max_bytes=10 ** 12) == (cell, True)
