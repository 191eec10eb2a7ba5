"""Spark ML wiring for the four multiclass classifiers.

Indexers are fitted once, in a single pass over train and test together, for
all categorical features and the label: one pre-aggregated count of (feature,
value) pairs and a rank per feature.  Each column's own nulls are left out of
its dictionary, whatever the other columns hold.  The pipeline stages are
``[feature indexer, label indexer, assembler, classifier, inverse label]``.
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression, NaiveBayes,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexerModel, VectorAssembler
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import (CATEGORY_FEATURES, DEFAULT_MAX_BINS, FEATURES_COL, INDEXED_SUFFIX,
                       LABEL_COL, NUMERIC_FEATURES, PREDICTED_COL)

LABEL_INDEXED = LABEL_COL + INDEXED_SUFFIX
KINDS = ("rf", "dt", "lr", "nb")

# --- fixed values: classifier settings of the source application ---
CLASSIFIER_PARAMS = {
    "rf": {"maxDepth": 4, "maxBins": DEFAULT_MAX_BINS},
    "dt": {"maxDepth": 10, "maxBins": DEFAULT_MAX_BINS},
    "lr": {"maxIter": 100, "regParam": 0.3, "elasticNetParam": 0.8},
    "nb": {"smoothing": 1.0, "modelType": "multinomial"},
}


# Execution settings (no effect on the fitted model): the depth-10 tree keeps
# each row's node id between levels instead of re-routing it from the root.
EXECUTION_PARAMS = {"dt": {"cacheNodeIds": True}}


def indexed(cols: list[str]) -> list[str]:
    return [c + INDEXED_SUFFIX for c in cols]


def fit_indexers(df: DataFrame, features: list[str] | None = None, label: str | None = LABEL_COL,
                 handle_invalid: str = "error") -> tuple[StringIndexerModel, StringIndexerModel | None]:
    """Frequency dictionaries (most frequent first, ties alphabetical) of the
    categorical features and the label, fitted in one pass over ``df``.

    Numbers are indexed by their text.  ``handle_invalid``: ``error`` (unseen
    or null level fails), ``keep`` (extra index) or ``skip`` (row dropped).
    """
    features = list(features or CATEGORY_FEATURES)
    cols = features + ([label] if label else [])
    found: dict[str, list[str]] = {c: [] for c in cols}
    # what the indexer models hold: the levels, not the rows
    for r in frequency_table(df, cols).orderBy("feature", "idx").toLocalIterator():
        found[r.feature].append(r.value)
    feat = _indexer([found[c] for c in features], features, handle_invalid)
    return feat, _indexer([found[label]], [label], handle_invalid) if label else None


def _indexer(levels: list[list[str]], cols: list[str], handle_invalid: str) -> StringIndexerModel:
    """An indexer with the given levels per column.

    ``from_arrays_of_labels`` fills the shorter dictionaries up with null levels to
    the length of the longest, so the arrays are handed over one by one.
    """
    gateway = SparkContext._active_spark_context._gateway
    text = gateway.jvm.java.lang.String
    arrays = gateway.new_array(text, len(levels), 0)
    for k, column in enumerate(levels):
        one = gateway.new_array(text, len(column))
        for i, level in enumerate(column):
            one[i] = level
        arrays[k] = one
    model = StringIndexerModel._create_from_java_class(
        "org.apache.spark.ml.feature.StringIndexerModel", arrays)
    return model.setInputCols(cols).setOutputCols(indexed(cols)).setHandleInvalid(handle_invalid)


def frequency_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(feature, value, idx)``: the levels of each column by falling count,
    equal counts alphabetically; nulls are no level.

    All columns are counted in one pass, pre-aggregated before the shuffle; the
    ranking sorts levels, never rows.
    """
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    counts = (df.selectExpr(f"stack({len(cols)}, {pairs}) AS (feature, value)")
              .where("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    rank = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), "value"))
    return counts.select("feature", "value", (rank - 1).cast("double").alias("idx"))


def max_bins_for(feature_indexer: StringIndexerModel, floor: int = DEFAULT_MAX_BINS) -> int:
    """``maxBins`` a tree needs: the source setting, or the largest number of
    levels of any indexed feature if that is larger (read from the fitted
    dictionaries, no pass over the data)."""
    return max([floor] + [len(labels) for labels in feature_indexer.labelsArray])


def check_max_bins(feature_indexer: StringIndexerModel, max_bins: int) -> None:
    """Fail when a feature has more levels than a tree has bins, naming the
    feature and the value needed."""
    for col, labels in zip(feature_indexer.getInputCols(), feature_indexer.labelsArray):
        if len(labels) > max_bins:
            raise ValueError(f"column {col!r} has {len(labels)} levels: maxBins must be at least "
                             f"{len(labels)}, it is {max_bins} (set maxBins, or auto_max_bins=True)")


def assembler(numeric: bool = True, features: list[str] | None = None) -> VectorAssembler:
    """Indexed categoricals first, then ``X, Y, temperatureC`` when ``numeric``."""
    cols = indexed(list(features or CATEGORY_FEATURES)) + (NUMERIC_FEATURES if numeric else [])
    return VectorAssembler(inputCols=cols, outputCol=FEATURES_COL)


def classifier(kind: str, seed: int = 42, **overrides):
    """Estimator of ``kind`` (rf, dt, lr, nb) with the source settings."""
    params = {**CLASSIFIER_PARAMS[kind], **EXECUTION_PARAMS.get(kind, {}), **overrides}
    common = {"labelCol": LABEL_INDEXED, "featuresCol": FEATURES_COL}
    if kind == "rf":
        return RandomForestClassifier(seed=seed, **common, **params)
    if kind == "dt":
        return DecisionTreeClassifier(seed=seed, **common, **params)
    if kind == "lr":
        return LogisticRegression(**common, **params)
    if kind == "nb":
        return NaiveBayes(**common, **params)
    raise ValueError(f"unknown classifier {kind!r}; expected one of {KINDS}")


def build_pipeline(kind: str, feature_indexer: StringIndexerModel,
                   label_indexer: StringIndexerModel, seed: int = 42, **overrides) -> Pipeline:
    """``[feature indexer, label indexer, assembler, classifier, inverse label]``.
    Naive Bayes leaves out the numeric inputs (they can be negative)."""
    return Pipeline(stages=[
        feature_indexer, label_indexer, assembler(numeric=kind != "nb"),
        classifier(kind, seed=seed, **overrides),
        IndexToString(inputCol="prediction", outputCol=PREDICTED_COL,
                      labels=label_indexer.labelsArray[0]),
    ])


def build_stages(kind: str, feature_indexer: StringIndexerModel, label_indexer: StringIndexerModel,
                 seed: int = 42, **overrides) -> tuple[PipelineModel, object, IndexToString]:
    """The pipeline of ``build_pipeline`` in its three parts: what is fitted already
    (indexers and assembler), the classifier, and the inverse label."""
    *ready, clf, inverse = build_pipeline(kind, feature_indexer, label_indexer, seed, **overrides).getStages()
    return PipelineModel(ready), clf, inverse


def param_grid(estimator=None, **axes) -> list[dict]:
    """Parameter maps; with no axes one empty map (a single candidate)."""
    b = ParamGridBuilder()
    for name, values in axes.items():
        b = b.addGrid(estimator.getParam(name), list(values))
    return b.build()


def evaluator(metric: str = "accuracy") -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol=LABEL_INDEXED, predictionCol="prediction",
                                             metricName=metric)


def train(df: DataFrame, pipeline: Pipeline | Estimator, folds: int = 3, seed: int = 42,
          grid: list[dict] | None = None, parallelism: int = 1,
          fold_col: str | None = None) -> CrossValidatorModel:
    """``folds``-fold cross validation by accuracy, best map refitted on all of ``df``.

    With ``fold_col`` (values ``0..folds-1``) folds are fixed by the data, so
    a recomputed partition lands in the same fold; otherwise folds come from
    a seeded random column.
    """
    cv = CrossValidator(estimator=pipeline, estimatorParamMaps=grid or param_grid(),
                        evaluator=evaluator(), numFolds=folds, seed=seed,
                        parallelism=parallelism)
    if fold_col:
        cv = cv.setFoldCol(fold_col)
    return cv.fit(df)


def with_stages(before: PipelineModel, model, after: list) -> object:
    """A fitted classifier, or the cross validation of one, between the stages that
    were applied before it and those that come after."""
    def whole(fitted) -> PipelineModel:
        return PipelineModel([*before.stages, fitted, *after])
    if not isinstance(model, CrossValidatorModel):
        return whole(model)
    out = CrossValidatorModel(whole(model.bestModel), model.avgMetrics, stdMetrics=model.stdMetrics)
    return model._copyValues(out)


def score(model, df: DataFrame) -> DataFrame:
    return model.transform(df)


def accuracy(predictions: DataFrame) -> float:
    return evaluator().evaluate(predictions)


def accuracy_frame(predictions: DataFrame) -> DataFrame:
    """One row ``accuracy`` = share of rows whose prediction equals the label."""
    return predictions.agg(
        (F.sum((F.col("prediction") == F.col(LABEL_INDEXED)).cast("long"))
         / F.count(F.lit(1))).alias("accuracy"))


def _best(model) -> PipelineModel:
    return model.bestModel if isinstance(model, CrossValidatorModel) else model


def feature_importance(model, spark=None) -> DataFrame | None:
    """``(feature, importance)`` of a tree model's inputs; None for other kinds."""
    best = _best(model)
    clf, asm = best.stages[3], best.stages[2]
    if not hasattr(clf, "featureImportances"):
        return None
    spark = spark or SparkSession.getActiveSession()
    # one number per assembled input: the model's own size, not the data's
    rows = list(zip(asm.getInputCols(), [float(v) for v in clf.featureImportances.toArray()]))
    return spark.createDataFrame(rows, "feature string, importance double")


def cv_metrics(model: CrossValidatorModel, spark: SparkSession) -> DataFrame:
    """``(map, params, mean_accuracy)``: one row per parameter map, in grid order."""
    rows = [(k, ",".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda x: x[0].name)), float(a))
            for k, (m, a) in enumerate(zip(model.getEstimatorParamMaps(), model.avgMetrics))]
    return spark.createDataFrame(rows, "map int, params string, mean_accuracy double")


def best_params(model: CrossValidatorModel) -> dict[str, object]:
    """Parameter map with the highest mean cross-validated metric (the first on ties)."""
    maps, metrics = model.getEstimatorParamMaps(), model.avgMetrics
    best = max(zip(maps, metrics), key=lambda p: p[1])[0]
    return {p.name: v for p, v in best.items()}
