"""Plan regressions: the shapes the scale design relies on."""

import re
from pathlib import Path
from urllib.parse import urlparse

import pytest

import __spark_entry__ as E
from incidentlab.session import (ensure_checkpoint_dir, materialize, release_tables, scratch_scope,
                                 tables_written, write_table)

from conftest import SF_SMALL


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def final_part(plan: str) -> str:
    return plan.split("== Initial Plan ==")[0]


def test_flagship_joins_are_all_broadcast(spark):
    plan = final_part(executed(E.queries()["enriched"](spark, SF_SMALL)))
    assert plan.count("BroadcastHashJoin") == 4          # nation, sun, weather, polygon cells
    for bad in ("SortMergeJoin", "ShuffledHashJoin", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan
    # incident rows are never hash-partitioned: the only exchange on their side
    # is the round-robin spread of the single-row-group test file
    incident_side = [l for l in plan.split("\n") if "Exchange" in l and "hashpartitioning" in l
                     and ("event_id" in l or "Id#" in l)]
    assert incident_side == []


def test_weather_rollup_preaggregates_before_exchange(spark):
    plan = final_part(executed(E.queries()["weather_table"](spark, SF_SMALL)))
    lines = plan.split("\n")
    first_exchange = max(i for i, l in enumerate(lines) if "Exchange hashpartitioning" in l)
    below = "\n".join(lines[first_exchange:])
    assert "HashAggregate" in below and "partial_count" in below
    assert "SortAggregate(key=[date" not in below.split("Exchange")[1]


def test_scans_read_only_needed_columns(spark):
    df = E.queries()["time_features"](spark, SF_SMALL)
    plan = executed(df)
    read = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    events_scan = [r for r in read if "event_id" in r]
    assert events_scan and all("props" not in r and "value" not in r for r in events_scan)


def test_training_reads_written_table_columns_only(spark):
    plan = executed(E.queries()["frequency_index"](spark, SF_SMALL))
    read = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert read and all("Timestamp" not in r and "sunrise" not in r for r in read)


def test_day_tables_of_large_readings_are_built_first_and_broadcast(spark):
    """Readings beyond the broadcast limit, a day table far below it: no incident
    is exchanged by date; a day table that is larger itself may be."""
    from pyspark.sql import functions as F
    from incidentlab.operators.joins import broadcast_limit, estimated_bytes, with_weather
    from incidentlab.operators.weather import daily_weather
    from incidentlab.plans.queries import _daily
    from conftest import SF_ORACLE
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100kb")
    try:
        assert estimated_bytes(_daily(spark, SF_ORACLE)) > broadcast_limit(spark.range(1)) == 100 * 1024
        for name in ("weather_join", "enriched"):
            plan = executed(E.queries()[name](spark, SF_ORACLE))
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            assert not [l for l in plan.split("\n") if "hashpartitioning(Date" in l]
        wide = spark.range(5000).select(F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")),
                                                      "yyyy-MM-dd").alias("date"), F.rand(1).alias("temp"),
                                        F.sha2(F.col("id").cast("string"), 512).alias("weather"))
        inc = spark.range(100_000).select(F.concat(F.lit("2003-05-"), (F.col("id") % 20 + 10).cast("string")).alias("Date"),
                                          F.sha2(F.col("id").cast("string"), 256).alias("id"))
        large = with_weather(inc, wide.union(wide.limit(0)).distinct())
        assert large.count() == 100_000 and "SortMergeJoin" in executed(large)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_scratch_scope_leaves_nothing_behind(spark):
    """Tables, landed files and checkpoints of queries are gone once the result is read."""
    root = Path(urlparse(ensure_checkpoint_dir(spark)).path)
    before = set(root.glob("*")) | set(root.glob("incidentlab-scratch/*"))
    for name in ("csv_rejected", "predictions_csv", "neighborhood_from_file"):
        with scratch_scope(spark):
            assert E.queries()[name](spark, SF_SMALL).count() > 0
            cut = materialize(spark.range(5))
            assert cut.count() == 5 and tables_written() > 0
            assert (set(root.glob("rdd-*")) | set(root.glob("incidentlab-scratch/*"))) - before
        left = (set(root.glob("*")) | set(root.glob("incidentlab-scratch/*"))) - before
        assert {p.name for p in left} <= {"incidentlab-scratch"}
    with pytest.raises(ZeroDivisionError), scratch_scope(spark):
        write_table(spark.range(3), "lost")
        1 / 0
    assert not [p for p in root.glob("incidentlab-scratch/lost-*")]


def test_release_keeps_the_newest(spark):
    since = tables_written()
    write_table(spark.range(3), "old")
    new = write_table(spark.range(4), "new")
    assert release_tables(spark, since, keep=1) == 1 and new.count() == 4
    assert release_tables(spark, since) == 1 and release_tables(spark, since) == 0
