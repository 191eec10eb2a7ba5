"""Language identification with interpolated Kneser-Ney character models.

One model per language (see ``charlm``), learned from the labelled texts; the
language with the lowest cross-entropy per character wins.  The score is the
winner's posterior under a temperature, and the rejection threshold the lowest
one that keeps wrong answers among accepted texts within ``MAX_ERROR``; both
are calibrated on one part of the learning rows with a model of the other part.

Edge cases: null, empty and letterless texts are ``und`` with score 0 and not
accepted; ties go to the language first in order; without a learned language
everything is ``und``; rows without a language are predicted, never learned
from; repeated rows repeat their answer; other columns are never read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .charlm import Model, build, count_windows
from .common import clean_text, map_rows

#: share of wrong answers allowed among accepted texts
MAX_ERROR = 0.01
_TEMPERATURES = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0)
_THRESHOLDS = (0.0, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)
_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-cased letters, everything between them as one space."""
    return _NO_LETTERS.sub(" ", text.lower()).strip()


def _entropies(texts: DataFrame, model: Model) -> DataFrame:
    """``texts`` (id, text, any more columns) with ``h``: nats per character for
    each label, null where the text has no letter."""
    shared = texts.sparkSession.sparkContext.broadcast((model.labels, model.orders))
    rest = [f for f in texts.schema if f.name != "text"]

    def make():
        m = Model(*shared.value)

        def work(*columns):
            named = dict(zip([f.name for f in rest], columns))
            h = []
            for text in map(pa.StringScalar.as_py, columns[-1]):
                clean = letters(text)
                if not m.labels or not any(map(str.isalpha, clean)):
                    h.append(None)
                    continue
                total, n = m.score(clean)
                h.append((-total / n).tolist())
            return named | {"h": h}
        return work

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest)
    return map_rows(texts.select(*[f.name for f in rest], "text"), f"{schema}, h array<double>", make)


def _posterior(h, n, temperature):
    """Winner's share when every language weighs exp(-temperature * excess *
    sqrt(characters)); the excess is over the winner's cross-entropy."""
    excess = F.transform(h, lambda x: F.exp(-temperature * F.sqrt(n) * (x - F.array_min(h))))
    return F.lit(1.0) / F.aggregate(excess, F.lit(0.0), lambda a, x: a + x)


def _calibrate(scored: DataFrame, labels: list[str]) -> tuple[float, float]:
    """(temperature with the least log loss, rejection threshold) from rows
    (label, n, h)."""
    at = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")).cast("int")
    rows = scored.where("h IS NOT NULL").withColumn("at", at).where("at > 0")
    own = F.element_at("h", F.col("at"))
    won = F.array_min("h") == own

    def loss(t):
        share = _posterior(F.col("h"), F.col("n"), F.lit(t)) \
            * F.exp(-F.lit(t) * F.sqrt("n") * (own - F.array_min("h")))
        return F.avg(-F.log(F.greatest(share, F.lit(1e-12))))
    row = rows.agg(*[loss(t).alias(f"t{k}") for k, t in enumerate(_TEMPERATURES)]).first()
    losses = [row[f"t{k}"] for k in range(len(_TEMPERATURES))]
    if losses[0] is None:
        return 1.0, 0.5
    best = _TEMPERATURES[int(np.argmin(losses))]
    score = _posterior(F.col("h"), F.col("n"), F.lit(best))
    row = rows.select(score.alias("s"), won.alias("won")).agg(
        *[x for k, t in enumerate(_THRESHOLDS) for x in (
            F.sum((F.col("s") >= t).cast("long")).alias(f"n{k}"),
            F.sum(((F.col("s") >= t) & ~F.col("won")).cast("long")).alias(f"bad{k}"))]).first()
    for k, t in enumerate(_THRESHOLDS):
        if (row[f"bad{k}"] or 0) <= MAX_ERROR * (row[f"n{k}"] or 0):
            return best, t
    return best, _THRESHOLDS[-1]


def identify(docs: DataFrame, learn: F.Column, calibrate: F.Column, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score`` (0 to 1),
    ``accepted`` and ``cross_entropy``.

    ``learn``: condition on the rows that may be learned from; ``calibrate``:
    those of them that calibration scores with a model of the others.  The
    final model learns from all of them.
    """
    t = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"),
                    clean_text(text_col).alias("text"), learn.alias("learn"), calibrate.alias("cal"))
    teach = t.where(F.col("learn") & F.col("lang").isNotNull())
    # the part (1: calibration) goes before the language in the counted label
    part = F.concat(F.col("cal").cast("int").cast("string"), F.col("lang"))
    counts = write_table(count_windows(teach.select(part.alias("label"), "text"), letters), "lang-counts")
    counts = counts.select(F.substring("label", 1, 1).alias("part"),
                           F.expr("substring(label, 2)").alias("label"), "key", "n")

    def labels_of(c):
        return sorted(r.label for r in c.select("label").distinct().collect())
    first = counts.where("part = '0'")
    trial = build(first, labels_of(first), modified=False)
    cal = _entropies(teach.where("cal").select("lang", F.length("text").cast("double").alias("n"), "text")
                     .withColumnRenamed("lang", "label"), trial)
    temperature, threshold = _calibrate(write_table(cal, "lang-calibration"), trial.labels) \
        if trial.labels else (1.0, 0.5)
    model = build(counts, labels_of(counts), modified=False)
    scored = _entropies(t.select("id", F.length("text").cast("double").alias("n"), "text"), model)
    names = F.array(*[F.lit(x) for x in model.labels]) if model.labels else F.array(F.lit("und"))
    best = F.array_min("h")
    score = F.coalesce(_posterior(F.col("h"), F.col("n"), F.lit(temperature)), F.lit(0.0))
    return scored.select(
        F.col("id").alias(id_col),
        F.when(F.col("h").isNull(), "und").otherwise(
            F.element_at(names, F.greatest(F.array_position("h", best), F.lit(1)).cast("int"))).alias("lang_pred"),
        score.alias("score"),
        (F.col("h").isNotNull() & (score >= threshold)).alias("accepted"), best.alias("cross_entropy"))
