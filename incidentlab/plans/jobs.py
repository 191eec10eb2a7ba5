"""File-to-file jobs, the counterparts of the source application's drivers.

    python -m incidentlab.plans.jobs classify --kind rf --incidents train.csv \\
        --sun sunrise_sunset.json --weather weather.json \\
        --neighborhoods neighborhoods.json --out rf_output
    python -m incidentlab.plans.jobs tables --sun-responses sun/ \\
        --weather-responses weather/ --sun-out sun_table --weather-out weather_table
    python -m incidentlab.plans.jobs requests --start 2003-01-01 --end 2003-01-31 --out requests
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.model import LABEL_INDEXED, accuracy, param_grid
from ..schemas import DEFAULT_ZONE, PREDICTION_COLUMNS
from ..session import get_session, spread
from ..sources.files import read_daily_weather, read_incidents, read_polygons, read_sun_times
from ..sources.sinks import write_daily_table, write_predictions
from ..sources.spine import date_spine, sun_requests, weather_requests
from .classify import ClassifierRun, run_classifier
from .enrich import enrich_incidents
from .tables import build_tables


def classifier_job(spark: SparkSession, incidents: str, sun: str, weather: str,
                   neighborhoods: str, out: str | None, kind: str = "rf", folds: int = 3,
                   seed: int = 42, key: str | None = None, files: int | None = None,
                   mode: str = "errorifexists", zone: str = DEFAULT_ZONE,
                   layout: str = "array", grid=None, handle_invalid: str = "error",
                   auto_max_bins: bool = False, parallelism: int = 1) -> ClassifierRun:
    """Read, enrich, train, score, report and write predictions.

    ``key=None`` splits 70/30 at random (seeded by the rows' content); a key
    column gives the hash split.  ``files`` asks for that many part files; by
    default every scoring task writes its own.  The caller releases the run.
    """
    inc = read_incidents(spark, incidents)
    enriched = enrich_incidents(inc, read_sun_times(spark, sun, layout),
                                read_daily_weather(spark, weather, layout),
                                read_polygons(spark, neighborhoods, layout), zone=zone)
    run = run_classifier(enriched, kind, folds=folds, seed=seed, key=key, evaluate=False, grid=grid,
                         handle_invalid=handle_invalid, parallelism=parallelism, auto_max_bins=auto_max_bins)
    if not out:
        run.accuracy = accuracy(run.predictions)
        return run
    # accuracy is observed while the predictions are written: one scoring
    # pass, nothing cached
    obs = Observation("accuracy")
    correct = (F.col("prediction") == F.col(LABEL_INDEXED)).cast("long")
    observed = run.predictions.observe(obs, F.sum(correct).alias("correct"),
                                       F.count(F.lit(1)).alias("n"))
    write_predictions(observed, out, files=files, mode=mode)
    m = obs.get
    run.accuracy = (m["correct"] or 0) / m["n"] if m["n"] else float("nan")
    return run


def report(run: ClassifierRun) -> dict:
    rep = {"kind": run.kind, "accuracy": run.accuracy, "best_params": {
        k: v for k, v in run.best_params.items()}, "mean_metrics": run.avg_metrics,
        "schema": [(f.name, f.dataType.simpleString())
                   for f in run.predictions.select(*PREDICTION_COLUMNS).schema]}
    if run.importances is not None:
        rep["importances"] = {r.feature: r.importance for r in run.importances.collect()}
    return rep


def grid_of(axes: list[str]):
    """Parameter maps of ``name=v1,v2`` texts, as a function of the classifier;
    None without any."""
    if not axes:
        return None

    def value(text: str):
        try:
            return json.loads(text)
        except ValueError:
            return text
    parsed = {a.partition("=")[0]: [value(v) for v in a.partition("=")[2].split(",")] for a in axes}
    return lambda classifier: param_grid(classifier, **parsed)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="incidentlab")
    sub = ap.add_subparsers(dest="cmd", required=True)
    c = sub.add_parser("classify")
    c.add_argument("--kind", choices=["rf", "dt", "lr", "nb"], default="rf")
    for name in ("incidents", "sun", "weather", "neighborhoods"):
        c.add_argument(f"--{name}", required=True)
    c.add_argument("--out")
    c.add_argument("--folds", type=int, default=3)
    c.add_argument("--seed", type=int, default=42)
    c.add_argument("--files", type=int, default=0, help="part files; 0: one per task")
    c.add_argument("--key", help="column whose hash splits train and test")
    c.add_argument("--zone", default=DEFAULT_ZONE)
    c.add_argument("--handle-invalid", choices=["error", "keep", "skip"], default="error")
    c.add_argument("--auto-max-bins", action="store_true")
    c.add_argument("--grid", action="append", default=[], metavar="PARAM=V1,V2",
                   help="values of a classifier parameter to choose from; may be repeated")
    c.add_argument("--layout", choices=["array", "lines"], default="array")
    t = sub.add_parser("tables")
    t.add_argument("--sun-responses", required=True, help="JSON lines of {date, body}")
    t.add_argument("--weather-responses", required=True, help="JSON lines of {date, body}")
    t.add_argument("--sun-out", required=True)
    t.add_argument("--weather-out", required=True)
    r = sub.add_parser("requests", help="write the per-day request list of both services")
    r.add_argument("--start", required=True)
    r.add_argument("--end", required=True)
    r.add_argument("--out", required=True)
    args = ap.parse_args(argv)

    spark = get_session()
    if args.cmd == "classify":
        run = classifier_job(spark, args.incidents, args.sun, args.weather, args.neighborhoods,
                             args.out, kind=args.kind, folds=args.folds, seed=args.seed,
                             files=args.files or None, layout=args.layout, key=args.key,
                             zone=args.zone, handle_invalid=args.handle_invalid,
                             auto_max_bins=args.auto_max_bins, grid=grid_of(args.grid))
        print(json.dumps(report(run), default=str))
        run.release()
    elif args.cmd == "requests":
        days = date_spine(spark, args.start, args.end)
        both = (sun_requests(days).withColumn("service", F.lit("sun"))
                .unionByName(weather_requests(days).withColumn("service", F.lit("weather"))))
        write_daily_table(both, args.out)
    else:
        schema = "date string, body string"
        rejected = build_tables(spread(spark.read.schema(schema).json(args.sun_responses)),
                                spread(spark.read.schema(schema).json(args.weather_responses)),
                                args.sun_out, args.weather_out)
        print(json.dumps({"rejected": rejected}))


if __name__ == "__main__":
    main()
