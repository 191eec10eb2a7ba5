"""Fitted trees as tables: their nodes, the rows' way through them, and what the
rows at each node say about splits and feature importances.

Nodes are numbered per tree, the root 1 and the children of ``k`` at ``2 k`` (rows
that the split sends left) and ``2 k + 1``.  Rows find their leaf by one broadcast
join with the node table per level, so they are never shuffled; the table's size is
the model's (at most 2^(depth + 1) nodes per tree), not the data's.  Class counts
are aggregated per leaf first and then handed up to the leaf's ancestors.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import FEATURES_COL
from .model import LABEL_INDEXED

_NODES = ("tree int, node long, depth int, feature int, name string, threshold double, "
          "left_levels array<int>, gain double, impurity double, n double, prediction double")


def _parts(model) -> tuple[object, list[str]]:
    best = model.bestModel if isinstance(model, CrossValidatorModel) else model
    return best.stages[3], best.stages[2].getInputCols()


def tree_nodes(model, spark: SparkSession | None = None) -> DataFrame:
    """(tree, node, depth, feature, name, threshold, left_levels, gain, impurity, n,
    prediction) of every node of a fitted tree or forest.

    Leaves have no feature; a split has either a ``threshold`` (values up to it go
    left) or ``left_levels`` (indexes of the levels that go left, ascending).
    """
    clf, names = _parts(model)
    spark = spark or SparkSession.getActiveSession()
    rows = []
    trees = clf.trees if hasattr(clf, "trees") else [clf]
    for t, tree in enumerate(trees):
        todo = [(1, 0, tree._java_obj.rootNode())]
        while todo:
            k, depth, node = todo.pop()
            feature = threshold = levels = gain = None
            if node.subtreeDepth() > 0:
                split = node.split()
                feature, gain = split.featureIndex(), node.gain()
                if split.getClass().getSimpleName() == "ContinuousSplit":
                    threshold = split.threshold()
                else:
                    levels = sorted(int(v) for v in split.leftCategories())
                todo += [(2 * k, depth + 1, node.leftChild()), (2 * k + 1, depth + 1, node.rightChild())]
            rows.append((t, k, depth, feature, None if feature is None else names[feature], threshold, levels, gain,
                         node.impurity(), float(node.impurityStats().count()), node.prediction()))
    return spark.createDataFrame(rows, _NODES)


def goes_left(value: Column, threshold: Column, left_levels: Column) -> Column:
    return F.when(threshold.isNotNull(), value <= threshold).otherwise(
        F.array_contains(left_levels, value.cast("int")))


def route(df: DataFrame, nodes: DataFrame, features: str = FEATURES_COL) -> DataFrame:
    """Each row of ``df`` once per tree, with the ``tree`` and the leaf ``node`` it
    comes to.  ``nodes`` is the table of ``tree_nodes``."""
    # the model's own size: its number of trees and levels
    trees, depth = nodes.agg(F.count_distinct("tree"), F.max("depth")).first()
    splits = nodes.where("feature is not null").select(
        F.col("tree"), F.col("node"), F.col("feature").alias("__feature"), F.col("threshold").alias("__cut"),
        F.col("left_levels").alias("__left"))
    at = df.withColumns({"__x": vector_to_array(features), "node": F.lit(1).cast("long"),
                         "tree": F.explode(F.array(*[F.lit(t) for t in range(trees or 0)]))})
    for _ in range(depth or 0):
        value = F.get("__x", F.col("__feature"))
        child = F.when(F.col("__feature").isNull(), F.col("node")).otherwise(
            F.col("node") * 2 + F.when(goes_left(value, F.col("__cut"), F.col("__left")), 0).otherwise(1))
        at = (at.join(F.broadcast(splits), ["tree", "node"], "left").withColumn("node", child)
              .drop("__feature", "__cut", "__left"))
    return at.drop("__x")


def node_counts(routed: DataFrame, label: str = LABEL_INDEXED) -> DataFrame:
    """(tree, node, label, n): the routed rows of each label at every node they pass."""
    leaf = routed.groupBy("tree", "node", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    ups = F.sequence(F.lit(0), F.floor(F.log2("node") + 1e-9).cast("int"))
    return (leaf.select("tree", "label", "n", F.explode(
        F.transform(ups, lambda k: F.floor(F.col("node") / F.pow(F.lit(2.0), k)).cast("long"))).alias("node"))
        .groupBy("tree", "node", "label").agg(F.sum("n").alias("n")))


def node_statistics(counts: DataFrame) -> DataFrame:
    """(tree, node, n, impurity): rows and gini impurity per node of ``node_counts``."""
    total = counts.groupBy("tree", "node").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return total.select("tree", "node", F.col("n"),
                        (1 - F.col("squares") / (F.col("n").cast("double") * F.col("n"))).alias("impurity"))


def gains(nodes: DataFrame, statistics: DataFrame) -> DataFrame:
    """(tree, node, name, n, gain) of every split, from the rows at the node and at
    its two children alone."""
    def side(k: int, name: str) -> DataFrame:
        return (statistics.where(F.col("node") % 2 == k).where("node > 1")
                .select("tree", F.floor(F.col("node") / 2).cast("long").alias("node"),
                        F.col("n").alias(f"{name}_n"), F.col("impurity").alias(f"{name}_impurity")))
    at = (nodes.where("feature is not null").select("tree", "node", "name").join(statistics, ["tree", "node"])
          .join(side(0, "left"), ["tree", "node"], "left").join(side(1, "right"), ["tree", "node"], "left"))

    def part(name: str) -> Column:
        return F.coalesce(F.col(f"{name}_n") / F.col("n") * F.col(f"{name}_impurity"), F.lit(0.0))
    return at.select("tree", "node", "name", "n", (F.col("impurity") - part("left") - part("right")).alias("gain"))


def importance_from_rows(model, df: DataFrame) -> DataFrame:
    """(feature, importance) recomputed from the rows ``df`` routed through the
    model: each split's gain times its rows, summed per feature, to 1 per tree, and
    averaged over the trees.

    On the rows a tree was trained on this is the model's own importance; on others
    it says what the features are worth there.  (A bagged forest's trees were each
    trained on a sample with repeats of their own, so there the two differ.)
    """
    nodes = tree_nodes(model, df.sparkSession)
    worth = (gains(nodes, node_statistics(node_counts(route(df, nodes))))
             .groupBy("tree", "name").agg(F.sum(F.col("gain") * F.col("n")).alias("worth")))
    each = worth.join(worth.groupBy("tree").agg(F.sum("worth").alias("all")), "tree").where(F.col("all") > 0)
    mean = each.groupBy("name").agg(F.sum(F.col("worth") / F.col("all")).alias("share"))
    names = df.sparkSession.createDataFrame([(c,) for c in _parts(model)[1]], "feature string")
    everything = F.sum("share").over(Window.partitionBy(F.lit(1)))     # one row per feature
    return (names.join(mean, names.feature == mean.name, "left")
            .select("feature", F.coalesce(F.col("share") / everything, F.lit(0.0)).alias("importance")))
