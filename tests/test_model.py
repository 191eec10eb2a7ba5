"""ML layer: indexer ordering, pipeline invariants, seed stability."""

import pytest
from pyspark.sql import functions as F

from incidentlab.operators import model as M
from incidentlab.plans.classify import run_classifier
from incidentlab.plans.queries import enriched
from incidentlab.schemas import PREDICTION_COLUMNS

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def data(spark):
    return enriched(spark, SF_SMALL).persist()


def test_indexer_order_frequency_then_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), ("b",), ("a",), ("d",)], "v string")
    feat, lab = M.fit_indexers(df, features=["v"], label=None)
    assert lab is None and feat.labelsArray[0] == ["a", "b", "c", "d"]


def test_indexer_unseen_level_raises_by_default(spark):
    df = spark.createDataFrame([("a",)], "v string")
    feat, _ = M.fit_indexers(df, features=["v"], label=None)
    with pytest.raises(Exception):
        feat.transform(spark.createDataFrame([("z",)], "v string")).collect()
    keep, _ = M.fit_indexers(df, features=["v"], label=None, handle_invalid="keep")
    assert keep.transform(spark.createDataFrame([("z",)], "v string")).first().vIndexed == 1.0


@pytest.mark.parametrize("kind", ["nb", "dt", "rf", "lr"])
def test_pipeline_invariants(spark, data, kind):
    run = run_classifier(data, kind, folds=3)
    pred = run.predictions.select("Id", *PREDICTION_COLUMNS)
    labels = {r.Category for r in data.select("Category").distinct().collect()}
    got = pred.collect()
    assert {r.PredictedCategory for r in got} <= labels
    assert 0.0 <= run.accuracy <= 1.0
    if kind in ("dt", "rf"):
        imp = run.importances.collect()
        assert len(imp) == 14 and abs(sum(r.importance for r in imp) - 1.0) < 1e-9
    else:
        assert run.importances is None


def test_same_seed_same_forest(spark, data):
    a = run_classifier(data, "rf", seed=7).predictions.select("Id", "PredictedCategory")
    b = run_classifier(data, "rf", seed=7).predictions.select("Id", "PredictedCategory")
    assert sorted(a.collect()) == sorted(b.collect())


def test_cross_validation_runs_for_one_map_too(spark, data):
    run = run_classifier(data, "lr", evaluate=False)
    assert run.best_params == {} and len(run.avg_metrics) == 1 and 0 <= run.avg_metrics[0] <= 1
    # the elastic-net penalty leaves no coefficient, which the SQL oracle relies on
    assert abs(run.model.bestModel.stages[3].coefficientMatrix.toArray()).max() == 0.0


def test_cross_validation_with_grid_reports_best(spark, data):
    run = run_classifier(data, "dt", grid=lambda dt: M.param_grid(dt, impurity=["gini", "entropy"]))
    assert len(run.avg_metrics) == 2
    best = run.avg_metrics.index(max(run.avg_metrics))
    assert run.best_params == {"impurity": ["gini", "entropy"][best]}


def test_cross_validated_refit_equals_direct_fit(spark, data):
    a = run_classifier(data, "nb").predictions.select("Id", "prediction")
    b = run_classifier(data, "nb", folds=0).predictions.select("Id", "prediction")
    assert sorted(a.collect()) == sorted(b.collect())


def test_dictionary_leaves_out_only_its_own_nulls(spark):
    df = spark.createDataFrame([(v, w) for v, w in zip(["x", None, None, None, "y", "x"], "aabbbc")], "v string, w string")
    feat, _ = M.fit_indexers(df, features=["v", "w"], label=None)
    assert [list(x) for x in feat.labelsArray] == [["x", "y"], ["b", "a", "c"]]


def test_too_many_levels_fail_by_name_unless_bins_may_grow(spark, data):
    wide = data.withColumn("Street", F.concat(F.lit("s"), F.col("Id").cast("string")))
    with pytest.raises(ValueError, match="'Street' has .* maxBins must be at least"):
        run_classifier(wide, "dt", folds=0, maxBins=50)
    feat, _ = M.fit_indexers(wide)
    M.check_max_bins(feat, M.max_bins_for(feat, floor=50))


def test_run_releases_its_table(spark, data):
    import os
    from incidentlab.session import ensure_checkpoint_dir
    folder = os.path.join(ensure_checkpoint_dir(spark).replace("file:", ""), "incidentlab-scratch")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    run = run_classifier(data, "nb", folds=0)
    assert len(set(os.listdir(folder)) - before) == 1
    run.release()
    assert set(os.listdir(folder)) == before


def test_accuracy_frame_matches_evaluator(spark, data):
    run = run_classifier(data, "nb")
    assert M.accuracy_frame(run.predictions).first().accuracy == pytest.approx(run.accuracy)


def test_classifier_job_from_files(spark, tmp_dir):
    """The file-to-file job: CSV + JSON arrays in, 3 CSV part files out."""
    import json
    import os

    from incidentlab.plans.jobs import classifier_job, report
    from incidentlab.plans.queries import _daily
    from incidentlab.sources import testdata as td
    from pyspark.sql import functions as F
    from incidentlab.schemas import incident_schema
    inc = td.incidents(spark, SF_SMALL).withColumns(
        {"Descript": F.lit("d"), "Resolution": F.lit("r")}).select(*incident_schema().names)
    csv = os.path.join(tmp_dir, "train")
    inc.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(csv)

    def array_file(name, df):
        path = os.path.join(tmp_dir, name)
        with open(path, "w") as f:
            json.dump([r.asDict() for r in df.collect()], f, indent=2)
        return path
    sun = array_file("sun.json", td.sun_times(spark, SF_SMALL))
    wx = array_file("weather.json", _daily(spark, SF_SMALL))
    hoods = array_file("hoods.json", td.polygons(spark).orderBy("ord").select("name", "polygon"))
    out = os.path.join(tmp_dir, "rf_output")
    run = classifier_job(spark, csv, sun, wx, hoods, out, kind="rf", files=3)
    rep = report(run)
    assert 0 <= rep["accuracy"] <= 1 and len(rep["importances"]) == 14
    assert len([f for f in os.listdir(out) if f.startswith("part-")]) == 3
    back = spark.read.option("header", True).csv(out)
    assert back.columns == PREDICTION_COLUMNS and back.count() > 0
    assert rep["accuracy"] == pytest.approx(M.accuracy(run.predictions))


def test_max_bins_grows_only_when_needed(spark):
    many = spark.createDataFrame([(f"s{i}",) for i in range(2100)], "v string")
    feat, _ = M.fit_indexers(many, features=["v"], label=None)
    assert M.max_bins_for(feat) == 2100
    few, _ = M.fit_indexers(many.limit(10), features=["v"], label=None)
    assert M.max_bins_for(few) == 2089
