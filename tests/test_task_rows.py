"""Rows per task: few row groups in a file with many splits, and training tables
whose short files Spark would pack into one task."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from incidentlab import session
from incidentlab.operators import model as M
from incidentlab.plans import classify
from incidentlab.sources import testdata as td


def _per_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _events(spark, path, n=4000):
    """A file with one row group; some keys are null, others come twice."""
    k = F.col("id")
    (spark.range(0, n, 1, 1).select(
        F.when(k % 50 != 0, k - (k % 10 == 1).cast("long")).alias("event_id"),
        (F.lit(dt.datetime(2024, 1, 1)) + F.make_interval(mins=(k % 9000).cast("int"))).cast("timestamp").alias("ts"),
        (k % 40).alias("user_id"), F.concat(F.lit("kind"), (k % 3).cast("string")).alias("event_type"),
        (k % 101).cast("double").alias("value"), F.md5(k.cast("string")).alias("props"))
     .write.parquet(f"{path}/events.parquet"))
    spark.range(25).select(F.col("id").cast("int").alias("n_nationkey"), F.concat(F.lit("N"), "id").alias("n_name")) \
        .coalesce(1).write.parquet(f"{path}/nation.parquet")


def test_one_row_group_over_many_splits_is_dealt_to_all_tasks(small_splits, tmp_dir):
    spark = small_splits
    _events(spark, tmp_dir)
    events = td.table(spark, tmp_dir, "events")
    assert events.rdd.getNumPartitions() >= 4 and max(_per_task(events)) == 4000
    for df in (td.incidents(spark, tmp_dir), td.weather_responses(spark, tmp_dir)):
        each = _per_task(df)
        assert sum(each) == 4000 and max(each) <= 1100
    ids = td.incidents(spark, tmp_dir).groupBy("Id").count()
    assert ids.exceptAll(events.groupBy(F.col("event_id").alias("Id")).count()).isEmpty()


def test_spread_leaves_even_and_empty_splits(spark):
    even = spark.range(0, 1000, 1, 6)
    assert session.spread(even, 4, by_rows=True) is even
    none = even.where("id < 0")
    assert session.spread(none, 4, by_rows=True) is none
    lone = even.where("id < 10")       # one split has them all
    assert sorted(_per_task(session.spread(lone, 4, by_rows=True))) == [2, 2, 3, 3]


def test_bounded_tasks_keeps_rows_and_short_partitions(spark):
    df = spark.range(0, 1000, 1, 2).select((F.col("id") % 10).alias("v"))
    assert session.bounded_tasks(df, 500) is df
    assert session.partition_rows(df) == (1000, 500) and session.partition_rows(df.limit(0)) == (0, 0)
    out = session.bounded_tasks(df, 60)
    each = _per_task(out)
    assert max(each) <= 60 and len(each) % spark.sparkContext.defaultParallelism == 0
    assert {r["count"] for r in out.groupBy("v").count().collect()} == {100}


@pytest.mark.parametrize("folds", [0, 2])
def test_training_tasks_get_a_bounded_number_of_rows(spark, monkeypatch, folds):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100, raising=False)
    k = F.col("id")
    rows = spark.range(0, 2000, 1, 2).select(
        k.alias("Id"), *[(k % (3 + j)).cast("string").alias(c) for j, c in enumerate(M.CATEGORY_FEATURES)],
        *[(k % 17).cast("double").alias(c) for c in M.NUMERIC_FEATURES], (k % 4).cast("string").alias(M.LABEL_COL))
    seen = []
    fit = M.DecisionTreeClassifier.fit
    monkeypatch.setattr(M.DecisionTreeClassifier, "fit",
                        lambda self, df, params=None: seen.append(_per_task(df)) or fit(self, df, params))
    classify.fit_models(rows, None, "dt", folds=folds, maxDepth=2)
    assert [sum(each) for each in seen][-1] == 2000
    assert max(max(each) for each in seen) <= 101


@pytest.mark.parametrize("kind, folds", [("rf", 3), ("rf", 0), ("nb", 2)])
def test_dealt_training_rows_are_kept_for_all_fits_and_let_go(spark, monkeypatch, kind, folds):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100, raising=False)
    k = F.col("id")
    rows = spark.range(0, 2000, 1, 2).select(
        k.alias("Id"), *[(k % (3 + j)).cast("string").alias(c) for j, c in enumerate(M.CATEGORY_FEATURES)],
        *[(k % 17).cast("double").alias(c) for c in M.NUMERIC_FEATURES], (k % 4).cast("string").alias(M.LABEL_COL))
    before = set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    est = {"rf": M.RandomForestClassifier, "nb": M.NaiveBayes}[kind]
    plans = []
    fit = est.fit

    def seen(self, df, params=None):
        plans.append(df._jdf.queryExecution().withCachedData().toString())
        return fit(self, df, params)
    monkeypatch.setattr(est, "fit", seen)
    some = {"maxDepth": 1, "numTrees": 2} if kind == "rf" else {}
    classify.fit_models(rows, None, kind, folds=folds, key="Id", **some)
    assert len(plans) == folds + 1 if folds else len(plans) == 1
    # the refit reads kept rows; a fold's own kept rows are taken from them, not dealt again
    for n, plan in enumerate(plans):
        assert plan.count("InMemoryRelation") >= (2 if n < folds else 1)
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keySet()) == before
