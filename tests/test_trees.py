"""Trees as tables: routing, node statistics and importances against the model."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from incidentlab.operators import model as M
from incidentlab.operators import trees as T
from incidentlab.plans.classify import run_classifier
from incidentlab.plans.queries import PLAIN_FOREST, enriched
from incidentlab.plans.tree_oracles import few_levels
from incidentlab.session import write_table

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def data(spark):
    return enriched(spark, SF_SMALL).persist()


def vectors(run, rows):
    return M.score(PipelineModel(run.model.stages[:3]), rows)


@pytest.mark.parametrize("kind, options", [("dt", {}), ("dt", {"maxDepth": 2}), ("rf", {}), ("rf", PLAIN_FOREST)])
def test_routed_rows_vote_as_the_model_does(spark, data, kind, options):
    run = run_classifier(data, kind, folds=0, evaluate=False, **options)
    nodes = T.tree_nodes(run.model, spark)
    routed = T.route(vectors(run, data).select("Id", "Features", M.LABEL_INDEXED), nodes)
    trees = nodes.select("tree").distinct().count()
    assert routed.count() == trees * data.count()
    ends = routed.join(nodes, ["tree", "node"])
    assert ends.where("feature is not null").count() == 0
    if kind == "dt":
        got = {r.Id: r.prediction for r in ends.select("Id", "prediction").collect()}
        want = {r.Id: r.prediction for r in M.score(run.model, data).select("Id", "prediction").collect()}
        assert got == want


@pytest.mark.parametrize("kind, options", [("dt", {}), ("rf", PLAIN_FOREST), ("dt", {"maxDepth": 1})])
def test_rows_give_back_the_importances_and_node_statistics(spark, data, kind, options):
    run = run_classifier(data, kind, folds=0, evaluate=False, **options)
    rows = vectors(run, run.train)
    own = {r.feature: r.importance for r in run.importances.collect()}
    again = {r.feature: r.importance for r in T.importance_from_rows(run.model, rows).collect()}
    assert len(own) == 14 and set(own) == set(again)
    assert all(abs(own[f] - again[f]) < 1e-9 for f in own)
    nodes = T.tree_nodes(run.model, spark)
    stats = T.node_statistics(T.node_counts(T.route(rows, nodes)))
    both = nodes.alias("m").join(stats.alias("s"), ["tree", "node"], "full")
    assert both.where("abs(m.n - s.n) > 1e-9 or abs(m.impurity - s.impurity) > 1e-9 "
                      "or m.n is null or s.n is null").count() == 0


def test_bagged_forest_importances_sum_to_one_on_any_rows(spark, data):
    run = run_classifier(data, "rf", folds=0, evaluate=False)
    got = [r.importance for r in T.importance_from_rows(run.model, vectors(run, data)).collect()]
    assert len(got) == 14 and abs(sum(got) - 1) < 1e-9


def test_tree_without_a_split(spark, data):
    run = run_classifier(data, "dt", folds=0, evaluate=False, minInstancesPerNode=10 ** 6)
    nodes = T.tree_nodes(run.model, spark)
    assert nodes.count() == 1 and nodes.first().feature is None
    assert {r.node for r in T.route(vectors(run, data), nodes).select("node").collect()} == {1}
    assert [r.importance for r in T.importance_from_rows(run.model, vectors(run, data)).collect()] == [0.0] * 14


def test_routing_broadcasts_the_model_and_shuffles_no_row(spark, data):
    run = run_classifier(data, "dt", folds=0, evaluate=False, maxDepth=3)
    plan = T.route(write_table(vectors(run, data), "vectors"), T.tree_nodes(run.model, spark))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_levels_that_may_be_cut_into_any_two_sets():
    assert few_levels(2089) == 11 and few_levels(32) == 5


def test_columns_named_like_the_operators_own(spark, data):
    run = run_classifier(data, "dt", folds=0, evaluate=False, maxDepth=2)
    rows = vectors(run, data).withColumns({"depth": F.lit("x"), "feature": F.lit("x"), "n": F.lit(1)})
    assert T.route(rows, T.tree_nodes(run.model, spark)).count() == data.count()
