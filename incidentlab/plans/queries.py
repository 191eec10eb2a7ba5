"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame
computed from the driver's tables at ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import model as M
from ..operators.features import address_features, day_night_feature, time_features, weekend_feature
from ..operators.geo import with_neighborhood
from ..operators.joins import with_weather
from ..operators.split import key_bucket, split_by_key, split_random
from ..operators.trees import importance_from_rows, route, tree_nodes
from ..operators.weather import daily_weather
from ..schemas import (CATEGORY_FEATURES, FEATURES_COL, LABEL_COL, NUMERIC_FEATURES, PREDICTED_COL,
                       PREDICTION_COLUMNS, incident_schema)
from ..session import scratch_path, write_table
from ..sources import testdata as td
from ..sources.files import (read_daily_weather, read_incidents, read_incidents_checked,
                              read_polygons, read_predictions, read_sun_times)
from ..sources.responses import parse_sun_responses, parse_weather_responses
from ..sources.sinks import write_daily_table, write_predictions
from .classify import feature_columns, run_classifier, split
from .enrich import enrich_incidents
from .oracles import ENRICHED_COLUMNS
from .tables import request_list, weather_table

WEATHER_DECIMALS = IMPORTANCE_DECIMALS = 9

Query = Callable[[SparkSession, str], DataFrame]


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return daily_weather(td.weather_readings(spark, sf), round_to=WEATHER_DECIMALS)


def q_time_features(spark: SparkSession, sf: str) -> DataFrame:
    return (time_features(td.incidents(spark, sf))
            .select("Id", "Dates", "HourOfDay", "Month", "Year", "Timestamp", "Date"))


def q_weekend_feature(spark: SparkSession, sf: str) -> DataFrame:
    return weekend_feature(td.incidents(spark, sf)).select("Id", "DayOfWeek", "Weekend")


def q_address_features(spark: SparkSession, sf: str) -> DataFrame:
    return address_features(td.incidents(spark, sf)).select("Id", "Address", "AddressType", "Street")


def q_daily_weather(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf).select("date", "temperatureC", "weather")


def q_weather_join(spark: SparkSession, sf: str) -> DataFrame:
    inc = time_features(td.incidents(spark, sf))
    return with_weather(inc, _daily(spark, sf)).select("Id", "Date", "temperatureC", "weather")


def q_day_night(spark: SparkSession, sf: str) -> DataFrame:
    inc = time_features(td.incidents(spark, sf))
    return (day_night_feature(inc, td.sun_times(spark, sf))
            .select("Id", "Timestamp", "Date", "sunrise", "sunset", "DayOrNight"))


def q_neighborhood(spark: SparkSession, sf: str) -> DataFrame:
    return (with_neighborhood(td.incidents(spark, sf), td.polygons(spark))
            .select("Id", "X", "Y", "Neighborhood"))


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: every feature of the classifiers on every incident."""
    return enrich_incidents(td.incidents(spark, sf), td.sun_times(spark, sf), _daily(spark, sf),
                            td.polygons(spark))


def q_enriched(spark: SparkSession, sf: str) -> DataFrame:
    return enriched(spark, sf).select(*ENRICHED_COLUMNS)


def q_request_list(spark: SparkSession, sf: str) -> DataFrame:
    return request_list(td.local_dates(spark, sf))


def q_sun_responses(spark: SparkSession, sf: str) -> DataFrame:
    return parse_sun_responses(td.sun_responses(spark, sf))[0]


def q_sun_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return parse_sun_responses(td.sun_responses(spark, sf))[1].select("date", "reason")


def _weather_parsed(spark: SparkSession, sf: str):
    return parse_weather_responses(td.weather_responses(spark, sf), order="rid")


def q_weather_readings(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = _weather_parsed(spark, sf)
    return good.select("date", "rid", "line_no", "temp", "weather")


def q_weather_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return _weather_parsed(spark, sf)[1].select("date", "rid", "line_no", "reason")


def q_weather_table(spark: SparkSession, sf: str) -> DataFrame:
    table, _ = weather_table(td.weather_responses(spark, sf), order="rid",
                             round_to=WEATHER_DECIMALS)
    return table.select("date", "temperatureC", "weather")


def q_key_split_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Both parts of the keyed split when every seventh key is missing."""
    inc = td.incidents(spark, sf).select("Id", F.when(F.col("Id") % 7 != 0, F.col("Id").cast("string")).alias("k"))
    train, test = split_by_key(inc, "k")
    return (train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))))


def q_key_split(spark: SparkSession, sf: str) -> DataFrame:
    return td.incidents(spark, sf).select("Id", (key_bucket("Id") < 70).alias("in_train"))


def q_combined_features(spark: SparkSession, sf: str) -> DataFrame:
    train, test = split(enriched(spark, sf))
    return feature_columns(train).unionByName(feature_columns(test))


def q_combined_count(spark: SparkSession, sf: str) -> DataFrame:
    return q_combined_features(spark, sf).agg(F.count(F.lit(1)).alias("n"))


def q_frequency_index(spark: SparkSession, sf: str) -> DataFrame:
    """Every (feature, level, index) that the indexers are made of."""
    # train ∪ test = every enriched row
    return M.frequency_table(enriched(spark, sf), CATEGORY_FEATURES + [LABEL_COL])


def q_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Incidents written as CSV with a header, then read back with the schema."""
    path = scratch_path(spark, "incidents-csv")
    cols = [f.name for f in incident_schema(exclude=())]
    write_predictions(_described(td.incidents(spark, sf)), path, columns=cols)
    return read_incidents(spark, path, schema=incident_schema(exclude=())).select(*cols)


def _described(inc: DataFrame) -> DataFrame:
    """With the two text columns; they hold quotes, commas and missing values."""
    k = F.col("Id")
    return inc.withColumns({
        "Descript": F.concat(F.lit('"'), F.col("Category"), F.lit('", no. '), k.cast("string")),
        "Resolution": F.when(k % 3 != 0, F.concat(F.lit("NONE, "), F.col("DayOfWeek")))})


def q_training_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The training layout (a header, no ``Id``) through its default reader."""
    path = scratch_path(spark, "training-csv")
    cols = [f.name for f in incident_schema()]
    write_predictions(_described(td.incidents(spark, sf)), path, columns=cols)
    return read_incidents(spark, path).select(*cols)


def _faulty_csv(spark: SparkSession, sf: str) -> str:
    """Incident rows as comma-separated files with a header, some with a fault:
    ``Id`` divisible by 7 no time, by 11 (not 7) a field too few, by 13 (neither) one too many."""
    k = F.col("Id")
    when = F.when(k % 7 == 0, "not a time").otherwise(F.date_format("Dates", "yyyy-MM-dd HH:mm:ss"))
    tail = (F.when((k % 7 == 0) | (k % 11 != 0) & (k % 13 != 0), F.concat_ws(",", k % 180, k % 90))
            .when(k % 11 == 0, (k % 180).cast("string")).otherwise(F.concat_ws(",", k % 180, k % 90, F.lit("more"))))
    line = F.concat_ws(",", when, "Category", F.lit("none"), "DayOfWeek", "PdDistrict", F.lit("none"), "Address", tail)
    path = scratch_path(spark, "faulty-csv")
    # one column under the whole header; no value has a tab, so none is quoted
    (td.incidents(spark, sf).select(line.alias(",".join(f.name for f in incident_schema())))
     .write.option("header", True).option("sep", "\t").csv(path))
    return path


def q_csv_accepted(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of files with faults that fit the schema."""
    return read_incidents_checked(spark, _faulty_csv(spark, sf))[0].select(
        "Dates", "Category", "DayOfWeek", "PdDistrict", "Address", "X", "Y")


def q_csv_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """The other rows as text, with the reason (file names differ from run to run)."""
    return read_incidents_checked(spark, _faulty_csv(spark, sf))[1].select("line", "reason")


def _write_array(df: DataFrame, path: str) -> None:
    """One file with one JSON array, as the per-day and polygon files come.  Only
    for such tables: the array is one value."""
    row = F.struct(*df.columns)
    df.agg(F.to_json(F.sort_array(F.collect_list(row))).alias("value")).write.text(path)


def q_sun_json_array(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "sun-array")
    _write_array(td.sun_times(spark, sf), path)
    return read_sun_times(spark, path)


def q_weather_json_array(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "weather-array")
    _write_array(_daily(spark, sf), path)
    return read_daily_weather(spark, path)


def q_neighborhood_json_array(spark: SparkSession, sf: str) -> DataFrame:
    """The polygon lookup with polygons read from one JSON array (array order)."""
    path = scratch_path(spark, "polygons-array")
    (td.polygons(spark).agg(F.to_json(F.transform(
        F.sort_array(F.collect_list(F.struct("ord", "name", "polygon"))),
        lambda p: F.struct(p["name"].alias("name"), p["polygon"].alias("polygon")))).alias("value"))
     .write.text(path))
    return (with_neighborhood(td.incidents(spark, sf), read_polygons(spark, path))
            .select("Id", "X", "Y", "Neighborhood"))


def q_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Daily weather written as JSON lines, then read back."""
    path = scratch_path(spark, "weather-json")
    write_daily_table(_daily(spark, sf), path)
    return read_daily_weather(spark, path, layout="lines")


def q_sun_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Sun times written as JSON lines, then read back with the sun reader."""
    path = scratch_path(spark, "sun-json")
    write_daily_table(td.sun_times(spark, sf), path)
    return read_sun_times(spark, path, layout="lines")


def q_neighborhood_from_file(spark: SparkSession, sf: str) -> DataFrame:
    """The polygon lookup with polygons read from a JSON file (file order)."""
    path = scratch_path(spark, "polygons-json")
    td.polygons(spark).orderBy("ord").select("name", "polygon").coalesce(1).write.json(path)
    polys = read_polygons(spark, path, layout="lines")
    return (with_neighborhood(td.incidents(spark, sf), polys)
            .select("Id", "X", "Y", "Neighborhood"))


def q_predictions_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Naive Bayes predictions through the CSV sink, read back typed."""
    path = scratch_path(spark, "predictions-csv")
    run = run_classifier(enriched(spark, sf), "nb", evaluate=False)
    write_predictions(run.predictions, path, columns=["Id", *PREDICTION_COLUMNS])
    return read_predictions(spark, path, with_id=True)


def q_random_split(spark: SparkSession, sf: str) -> DataFrame:
    """Seeded 70/30 random split of the enriched rows, labelled by part."""
    train, test = split_random(enriched(spark, sf).select("Id", "Category"), (0.7, 0.3), 42, key="Id")
    return (train.withColumn("part", F.lit("train"))
            .unionByName(test.withColumn("part", F.lit("test"))))


def q_random_split_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The random split without a key: every row is in exactly one part."""
    e = enriched(spark, sf).select("Category", "DayOfWeek", "PdDistrict")
    train, test = split_random(e, (0.7, 0.3), 42)
    both = train.withColumn("p", F.lit(1)).unionByName(test.withColumn("p", F.lit(0)))
    return both.groupBy("Category", "DayOfWeek", "PdDistrict").agg(F.count(F.lit(1)).alias("n"))


def nb_grid(classifier) -> list[dict]:
    return M.param_grid(classifier, smoothing=[1.0, 10.0])


def q_nb_cv_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Mean accuracy of naive Bayes over three folds for each of two maps."""
    run = run_classifier(enriched(spark, sf), "nb", evaluate=False, grid=nb_grid)
    return (M.cv_metrics(run.model, spark)
            .select("params", F.round("mean_accuracy", 9).alias("mean_accuracy")))


def q_nb_best_params(spark: SparkSession, sf: str) -> DataFrame:
    run = run_classifier(enriched(spark, sf), "nb", evaluate=False, grid=nb_grid)
    return spark.createDataFrame([(k, float(v)) for k, v in run.best_params.items()],
                                 "param string, value double")


def _known(kind: str):
    """A tree's predictions without the predicted column, and whether that is a
    label of the data."""
    def q(spark: SparkSession, sf: str) -> DataFrame:
        run = run_classifier(enriched(spark, sf), kind, evaluate=False)
        labels = run.model.bestModel.stages[1].labelsArray[0]
        return run.predictions.select("Id", *[c for c in PREDICTION_COLUMNS if c != PREDICTED_COL],
                                      F.col(PREDICTED_COL).isin(labels).alias("known"))
    q.__name__ = f"q_{kind}_scored_rows"
    return q


def _importance_sum(kind: str):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        run = run_classifier(enriched(spark, sf), kind, evaluate=False)
        return run.importances.agg(
            F.count(F.lit(1)).alias("n"), F.min(F.col("importance") >= 0).alias("none_negative"),
            F.round(F.sum("importance"), 9).alias("total"))
    q.__name__ = f"q_{kind}_importance_sum"
    return q


def _predictions(kind: str):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        run = run_classifier(enriched(spark, sf), kind, evaluate=False)
        return run.predictions.select("Id", *PREDICTION_COLUMNS)
    q.__name__ = f"q_{kind}_predictions"
    return q


def _accuracy(kind: str):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        run = run_classifier(enriched(spark, sf), kind, evaluate=False)
        return M.accuracy_frame(run.predictions)
    q.__name__ = f"q_{kind}_accuracy"
    return q


def _importance(kind: str):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        run = run_classifier(enriched(spark, sf), kind, evaluate=False)
        return run.importances.withColumn("importance", F.round("importance", IMPORTANCE_DECIMALS))
    q.__name__ = f"q_{kind}_importance"
    return q


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, object]:
    """The enriched rows indexed and assembled, and the label's indexer."""
    rows = write_table(enriched(spark, sf), "enriched")
    feat, label = M.fit_indexers(rows)
    ready, _, _ = M.build_stages("dt", feat, label)
    return M.score(ready, rows), label


def q_assembled_features(spark: SparkSession, sf: str) -> DataFrame:
    """The tree's input vector, slot by slot in its order, and the label's index."""
    rows, _ = _vectors(spark, sf)
    slots = vector_to_array(FEATURES_COL)
    n = len(CATEGORY_FEATURES + NUMERIC_FEATURES)
    return rows.select("Id", F.col(M.LABEL_INDEXED).alias("label"),
                       *[F.get(slots, F.lit(j)).alias(f"x{j}") for j in range(n)])


#: a forest without chance: every tree sees all rows and all features
PLAIN_FOREST = {"numTrees": 3, "bootstrap": False, "featureSubsetStrategy": "all"}


def _split_rows(nodes: DataFrame) -> DataFrame:
    return nodes.where("feature is not null").select(
        "tree", "node", F.col("name").alias("feature"), "threshold",
        F.concat_ws(",", F.transform("left_levels", lambda v: v.cast("string"))).alias("left_levels"),
        F.round("gain", IMPORTANCE_DECIMALS).alias("gain"), F.col("n").cast("long").alias("n"))


def q_dt_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Every split of the fitted tree: root, second level and all below."""
    run = run_classifier(enriched(spark, sf), "dt", folds=0, evaluate=False)
    return _split_rows(tree_nodes(run.model, spark)).drop("tree")


def q_rf_plain_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Every split of a forest whose trees see all rows and features."""
    run = run_classifier(enriched(spark, sf), "rf", folds=0, evaluate=False, **PLAIN_FOREST)
    return _split_rows(tree_nodes(run.model, spark))


def q_rf_plain_predictions(spark: SparkSession, sf: str) -> DataFrame:
    run = run_classifier(enriched(spark, sf), "rf", evaluate=False, **PLAIN_FOREST)
    return run.predictions.select("Id", *PREDICTION_COLUMNS)


def q_dt_importance_from_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The tree's importances recomputed from the training rows routed through it."""
    run = run_classifier(enriched(spark, sf), "dt", folds=0, evaluate=False)
    rows = M.score(PipelineModel(run.model.stages[:3]), run.train)
    return (importance_from_rows(run.model, rows)
            .withColumn("importance", F.round("importance", IMPORTANCE_DECIMALS)))


def q_dt_leaf_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out rows per leaf of the fitted tree and label."""
    run = run_classifier(enriched(spark, sf), "dt", folds=0, evaluate=False)
    rows = route(run.predictions.drop("tree", "node"), tree_nodes(run.model, spark))
    return rows.groupBy("node", LABEL_COL, PREDICTED_COL).agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    return {
        "time_features": q_time_features,
        "weekend_feature": q_weekend_feature,
        "address_features": q_address_features,
        "daily_weather": q_daily_weather,
        "weather_join": q_weather_join,
        "day_night": q_day_night,
        "neighborhood": q_neighborhood,
        "enriched": q_enriched,
        "request_list": q_request_list,
        "sun_responses": q_sun_responses,
        "sun_rejected": q_sun_rejected,
        "weather_readings": q_weather_readings,
        "weather_rejected": q_weather_rejected,
        "weather_table": q_weather_table,
        "key_split": q_key_split,
        "combined_features": q_combined_features,
        "combined_count": q_combined_count,
        "key_split_with_nulls": q_key_split_with_nulls,
        "training_csv": q_training_csv,
        "sun_json_array": q_sun_json_array,
        "weather_json_array": q_weather_json_array,
        "neighborhood_json_array": q_neighborhood_json_array,
        "random_split_rows": q_random_split_rows,
        "nb_cv_metrics": q_nb_cv_metrics,
        "nb_best_params": q_nb_best_params,
        "dt_scored_rows": _known("dt"),
        "rf_scored_rows": _known("rf"),
        "dt_importance_sum": _importance_sum("dt"),
        "rf_importance_sum": _importance_sum("rf"),
        "frequency_index": q_frequency_index,
        "csv_roundtrip": q_csv_roundtrip,
        "csv_accepted": q_csv_accepted,
        "csv_rejected": q_csv_rejected,
        "json_roundtrip": q_json_roundtrip,
        "sun_json_roundtrip": q_sun_json_roundtrip,
        "random_split": q_random_split,
        "neighborhood_from_file": q_neighborhood_from_file,
        "predictions_csv": q_predictions_csv,
        "nb_predictions": _predictions("nb"),
        "nb_accuracy": _accuracy("nb"),
        "dt_predictions": _predictions("dt"),
        "rf_predictions": _predictions("rf"),
        "lr_predictions": _predictions("lr"),
        "dt_importance": _importance("dt"),
        "rf_importance": _importance("rf"),
        "dt_accuracy": _accuracy("dt"),
        "rf_accuracy": _accuracy("rf"),
        "lr_accuracy": _accuracy("lr"),
        "assembled_features": q_assembled_features,
        "dt_splits": q_dt_splits,
        "dt_leaf_rows": q_dt_leaf_rows,
        "dt_importance_from_rows": q_dt_importance_from_rows,
        "rf_plain_splits": q_rf_plain_splits,
        "rf_plain_predictions": q_rf_plain_predictions,
    }
