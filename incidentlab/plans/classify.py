"""Entry A: enrich incidents, train a classifier with cross validation, score
the held-out part, report and write predictions.

Scale notes: the enriched table is written once as parquet into the shared
checkpoint folder (lineage cut; survives executor loss; later passes read
only the columns they use) and both splits are filters over it.  Indexers
take one pass over all rows.  Training passes are Spark ML's own (tree
statistics / gradients aggregate per iteration).  The written table belongs to
the run: ``ClassifierRun.release()`` deletes it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import model as M
from ..operators.split import combine, key_bucket, split_by_key, split_random
from ..schemas import CATEGORY_FEATURES, FEATURES_COL, NUMERIC_FEATURES
from ..session import bounded_tasks, release_tables, tables_written, write_table

FOLD_COL = "__fold"


@dataclass
class ClassifierRun:
    kind: str
    model: object
    predictions: DataFrame
    train: DataFrame | None = None
    accuracy: float | None = None
    importances: DataFrame | None = None
    best_params: dict = field(default_factory=dict)
    avg_metrics: list = field(default_factory=list)
    _mark: tuple | None = None

    def release(self) -> None:
        """Delete the enriched table of this run; predictions can no longer be
        computed afterwards."""
        if self._mark:
            spark, since = self._mark
            release_tables(spark, since)
            self._mark = None


def feature_columns(df: DataFrame) -> DataFrame:
    """The 14 model inputs: numeric first, then categorical."""
    return df.select(*(NUMERIC_FEATURES + CATEGORY_FEATURES))


def split(enriched: DataFrame, key: str | None = "Id", train_pct: int = 70,
          seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Keyed (reproducible) split when ``key`` is given, else a seeded random one."""
    if key:
        return split_by_key(enriched, key, train_pct)
    # drawn from a row's own columns, so a written table may lie in any files
    tr, te = split_random(enriched, (train_pct / 100, 1 - train_pct / 100), seed)
    return tr, te


def fit_models(train: DataFrame, test: DataFrame | None, kind: str, folds: int = 3, seed: int = 42,
               parallelism: int = 1, handle_invalid: str = "error", grid: list[dict] | None = None,
               key: str | None = None, auto_max_bins: bool = False, **overrides):
    """Indexers on train ∪ test, pipeline, cross-validated fit on train.

    Trees need ``maxBins`` at least the largest category count.  A feature with
    more levels fails with an error that names it; ``auto_max_bins`` raises the
    setting instead, which also changes the numeric features' thresholds.

    Every map of ``grid`` (one, the settings as they are, by default) is fitted
    and evaluated on ``folds`` folds, and the best is refitted on all of
    ``train``.  ``grid`` may also be a function of the pipeline's classifier.
    ``folds`` below 2 leaves cross validation out.

    Rows are indexed and assembled once: every fit and evaluation reads a
    written table of vector, label and fold, the folds with ``parallelism`` of them at a time.
    A training task gets a bounded number of rows (``session.bounded_tasks``); rows
    dealt out for that are kept while the models are fitted, not dealt again for every
    fold, its emptiness checks and the refit.
    """
    levels = combine(train, test) if test is not None else train
    feat_idx, label_idx = M.fit_indexers(levels, handle_invalid=handle_invalid)
    if kind in ("rf", "dt"):
        if auto_max_bins and "maxBins" not in overrides:
            overrides["maxBins"] = M.max_bins_for(feat_idx)
        M.check_max_bins(feat_idx, overrides.get("maxBins", M.DEFAULT_MAX_BINS))
    ready, clf, inverse = M.build_stages(kind, feat_idx, label_idx, seed=seed, **overrides)
    grid = (grid(clf) if callable(grid) else grid) or M.param_grid()
    folded = bool(folds and folds > 1)
    fold_col = FOLD_COL if folded and key else None
    if fold_col:
        # folds fixed by a hash of the key (independent of the 70/30 buckets)
        train = train.withColumn(FOLD_COL, (key_bucket(F.concat(F.lit("fold:"), F.col(key)
                                                                 .cast("string")), folds)).cast("int"))
    vectors = M.score(ready, train).select(FEATURES_COL, M.LABEL_INDEXED, *([fold_col] if fold_col else []))
    written = write_table(vectors, "vectors")
    vectors = bounded_tasks(written)
    if vectors is not written:
        vectors = vectors.persist()
    try:
        if folded:
            model = M.train(vectors, clf, folds=folds, seed=seed, grid=grid,
                            parallelism=parallelism, fold_col=fold_col)
        else:
            model = clf.fit(vectors, grid[0])
    finally:
        if vectors is not written:
            vectors.unpersist()
    return M.with_stages(ready, model, [inverse])


def run_classifier(enriched: DataFrame, kind: str, folds: int = 3, seed: int = 42,
                   key: str | None = "Id", train_pct: int = 70, checkpoint: bool = True,
                   evaluate: bool = True, parallelism: int = 1, grid: list[dict] | None = None,
                   **overrides) -> ClassifierRun:
    """The whole classifier job over enriched incidents.

    With ``checkpoint`` the enriched rows are written once as parquet in the
    shared checkpoint folder; the indexer pass, every training pass and the
    scoring pass read that table.
    """
    mark = (enriched.sparkSession, tables_written())
    data = write_table(enriched, "enriched") if checkpoint else enriched
    train, test = split(data, key, train_pct, seed)
    model = fit_models(train, test, kind, folds=folds, seed=seed, parallelism=parallelism,
                       grid=grid, key=key, **overrides)
    scored = M.score(model, test)
    run = ClassifierRun(kind=kind, model=model, predictions=scored, train=train, _mark=mark if checkpoint else None)
    if evaluate:
        run.accuracy = M.accuracy(scored)
    run.importances = M.feature_importance(model, enriched.sparkSession)
    if hasattr(model, "avgMetrics"):
        run.best_params = M.best_params(model)
        run.avg_metrics = list(model.avgMetrics)
    elif grid and not callable(grid):
        run.best_params = {p.name: v for p, v in grid[0].items()}
    return run
