"""Mixing documents to target domain weights by soft membership.

A multinomial regression on word features (see ``labelled``), fitted on the
labelled table, gives every document a posterior over domains.  Each document
gets a rate r >= 0 (how often it is to appear) such that the expected tokens of
every domain, the sum of r * tokens * posterior, meet a target.  The rates solve
the nonnegative least-squares problem by projected gradient: the squared error's
gradient for a document is its posterior's product with the domain residuals, a
step moves all rates along it from 1 and cuts them off at zero.  Rates are thus
max(0, 1 - posterior * step) for one step vector with an entry per domain, which
the passes refine: each pass over the documents' posteriors sums, for a line of
candidate steps at once, the expected tokens and the joint domain token matrix of
the documents not cut off, and this matrix scales the next step.  A small weight on
moving rates from 1 makes the steps unique; it falls from pass to pass until it does
not count, so that the end is the least-squares optimum, met or not.  Targets that
no rates can meet are warned of; to come as near as possible, a few documents
of the purest posteriors then get high rates.

Only sums per domain ever reach the driver.  A document's rate is a function of
its posterior and the step, so no state is stored per pass.

Edge cases: null and empty texts have no tokens and rate 1 moved like any other;
documents without a label are scored, not learned from; with no labelled document
there is one domain and all rates are equal; targets of domains that no document
has are left out and the others scaled up; repeated rows have equal rates; an
empty table gives no rows; other columns are kept as they are.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_table
from .common import clean_text, map_rows
from .labelled import columns_of, reader, sample, vocabulary
from .linear import Rows, fit, softmax

PER_CLASS = 2_000
L2 = 1.0
#: the fit ends when no domain is off its target by more than this share of all tokens
TOLERANCE = 1e-6
#: weights on moving rates from 1, one after the other, as shares of all tokens; the
#: last is too small to count (the distance to the targets is then the least one to
#: within 1e-5 of all tokens).  Passes of each, and the scales tried at once
RIDGES = tuple(10.0 ** -k for k in (*np.arange(-3, 9, 1.5), *np.arange(9, 13.1, 0.5)))
PASSES = 12
SCALES = 0.25 ** np.arange(12)
#: without targets, languages are tempered (their token shares to this power) with
#: none of them thinned out, and low-quality text is to give this part of its tokens
TEMPER = 0.7
LOW, LOW_PART = "low", 0.5


class Classifier:
    def __init__(self, domains: list[str], vocab: dict[str, int], weights: np.ndarray):
        self.domains, self.vocab, self.weights = domains, vocab, weights

    def scorer(self):
        read, w = reader(self.vocab), self.weights

        def posterior(text: str) -> np.ndarray:
            return softmax((w[read(text)].sum(axis=0) + w[0])[None])[0]
        return posterior


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          domain: Column | None = None, quality_col: str = "quality", per_class: int = PER_CLASS) -> Classifier:
    """Classifier of the labelled documents' domains: their ``domain`` column
    (default: language), or ``low`` where the label says low quality."""
    kind = F.coalesce((domain if domain is not None else F.col("lang")).cast("string"), F.lit("none"))
    low = (F.col(quality_col) == 0).cast("int")
    share = labels.where(F.col(quality_col).isin(0, 1)).agg(F.avg(low.cast("double"))).first()[0] or 0.0
    rows = sample(labels.where(F.col(quality_col).isin(0, 1)), docs, per_class, id_col, text_col,
                  low, {"kind": kind})
    names = [LOW if r.y else r.kind for r in rows]
    domains = sorted(set(names)) or ["none"]
    vocab = vocabulary([r.words for r in rows])
    if len(domains) == 1:
        return Classifier(domains, vocab, np.zeros((len(vocab) + 1, 1)))
    x = Rows([columns_of(r.words, vocab) for r in rows], len(vocab) + 1)
    y = np.zeros((len(rows), len(domains)))
    y[np.arange(len(rows)), [domains.index(n) for n in names]] = 1.0
    weights = fit(x, y, l2=L2, steps=40)
    low_share, in_sample = float(np.clip(share, 1e-6, 1 - 1e-6)), y[:, domains.index(LOW)].mean() if LOW in domains else 0
    if 0 < in_sample < 1:
        # the sample holds other shares of low quality than the labels
        weights[0, domains.index(LOW)] += np.log(low_share / (1 - low_share)) - np.log(in_sample / (1 - in_sample))
    return Classifier(domains, vocab, weights)


def posteriors(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, p): words of the text and its posterior over the domains."""
    shared = docs.sparkSession.sparkContext.broadcast((model.domains, model.vocab, model.weights))

    def make():
        posterior = Classifier(*shared.value).scorer()

        def work(ids, texts):
            texts = [t.as_py() for t in texts]
            return {"id": ids, "tokens": [len(t.split()) for t in texts],
                    "p": [posterior(t).tolist() for t in texts]}
        return work

    slim = docs.select(F.col(id_col).cast("long").alias("id"), clean_text(text_col).alias("t"))
    return map_rows(slim, "id long, tokens long, p array<double>", make)


def _rates(p: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Rates one projected step away from 1; a row of steps gives a column of rates each."""
    return np.maximum(0.0, 1.0 - p @ np.asarray(step).T)


def _matrix(column: pa.Array, m: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, m)


def _sums(soft: DataFrame, m: int, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each step: expected tokens per domain, joint token matrix of the documents
    not cut off, and half the sum of tokens times squared rate."""
    n = len(steps)

    def run(batches):
        tokens, joint, square = np.zeros((n, m)), np.zeros((n, m, m)), np.zeros(n)
        for batch in batches:
            p = _matrix(batch.column(1), m)
            t = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            r = _rates(p, steps)
            tokens += (r * t[:, None]).T @ p
            square += 0.5 * t @ (r * r)
            for k in range(n):
                joint[k] += (p * (t * (r[:, k] > 0))[:, None]).T @ p
        flat = np.concatenate((tokens.ravel(), joint.ravel(), square))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["k", "v"])

    rows = (soft.select("tokens", "p").mapInArrow(run, "k int, v double")
            .groupBy("k").agg(F.sum("v").alias("v")).collect())
    flat = np.zeros(n * (m + m * m + 1))
    for r in rows:
        flat[r.k] = r.v
    tokens, joint, square = np.split(flat, (n * m, n * (m + m * m)))
    return tokens.reshape(n, m), joint.reshape(n, m, m), square


def fit_rates(soft: DataFrame, domains: list[str],
              targets: dict[str, float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(step, expected tokens, target tokens): the projected-gradient fit over a
    stored table (tokens, p).  ``targets`` are weights per domain; together
    they ask for as many tokens as the documents have.  Without targets see
    ``TEMPER`` and ``LOW_PART``."""
    m = len(domains)
    step = np.zeros(m)
    (expected,), (joint,), (square,) = _sums(soft, m, step[None])
    total = expected.sum()
    if total <= 0:
        return step, expected, expected
    if targets is None:
        there = expected > 0
        ratio = np.where(there, np.power(np.maximum(expected, 1e-300) / total, TEMPER - 1), 1.0)
        tempered = there & np.array([d != LOW for d in domains])
        goal = expected * np.where(tempered, ratio / ratio[tempered].min(initial=np.inf), LOW_PART)
    else:
        weight = np.array([float(targets.get(d, 0.0)) for d in domains]) * (expected > 0)
        if weight.sum() <= 0:
            return step, expected, expected
        goal = weight / weight.sum() * total

    def met(got):
        return np.abs(got - goal).max() <= TOLERANCE * total

    if met(expected):
        return step, expected, goal
    # where no rate is cut off, one step meets the targets
    plain = np.linalg.pinv(joint, rcond=1e-9, hermitian=True) @ (expected - goal)
    (tried,), _, _ = _sums(soft, m, plain[None])
    if met(tried):
        return plain, tried, goal
    best = np.inf, step, expected
    for ridge in total * np.array(RIDGES):
        # least where the rates minimise squared error / ridge + tokens * (rate - 1)^2
        value = square + ridge / 2 * step @ step + goal @ step
        for _ in range(PASSES):
            slope = goal - expected + ridge * step
            if np.abs(slope).max() <= TOLERANCE / 10 * total:
                break
            move = np.linalg.solve(joint + ridge * np.eye(m), -slope)
            line = step + SCALES[:, None] * move
            tokens, joints, squares = _sums(soft, m, line)
            values = squares + ridge / 2 * (line * line).sum(axis=1) + line @ goal
            k = int(values.argmin())
            rounding = 1e-13 * (square + abs(goal @ step))
            if values[k] >= value - rounding:       # too near to tell by the value: by its slope
                slopes = np.abs(goal - tokens + ridge * line).max(axis=1)
                k = int(np.where(values <= value + rounding, slopes, np.inf).argmin())
                if not (values[k] <= value + rounding and slopes[k] <= 0.5 * np.abs(slope).max()):
                    break
            step, expected, joint, square, value = line[k], tokens[k], joints[k], squares[k], values[k]
            if met(expected):
                return step, expected, goal
        error = float(((expected - goal) ** 2).sum())
        if error < best[0]:
            best = error, step, expected
    _, step, expected = best
    off = unmet(domains, expected, goal)
    if off:
        warnings.warn(f"mixing targets that no rates meet, tokens off: {off}", stacklevel=2)
    return step, expected, goal


def unmet(domains: list[str], expected: np.ndarray, goal: np.ndarray) -> dict[str, float]:
    """Tokens above (or, negative, below) its target, of each domain that is off it."""
    return {d: float(e - g) for d, e, g in zip(domains, expected, goal)
            if abs(e - g) > TOLERANCE * max(goal.sum(), 1e-300)}


def mix(docs: DataFrame, model: Classifier, targets: dict[str, float] | None = None, id_col: str = "doc_id",
        text_col: str = "text", seed: int = 42) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``domain`` (the most likely),
    ``p_domain``, ``rate`` and ``copies`` (the rate, its fraction drawn by the
    id's hash), and the fit's ``target_tokens`` and ``mixed_tokens`` of that
    domain."""
    soft = write_table(posteriors(docs, model, id_col, text_col), "mixing-posteriors")
    step, expected, goal = fit_rates(soft, model.domains, targets)
    m = len(model.domains)

    def make():
        def work(p):
            p = _matrix(p, m)
            best = p.argmax(axis=1)
            return {"rate": _rates(p, step), "best": best.astype(np.int32),
                    "p_domain": p[np.arange(len(p)), best]}
        return work

    def run(batches):
        work = make()
        for batch in batches:
            got = work(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(got[n]) for n in ("best", "p_domain", "rate"))],
                names=["id", "tokens", "best", "p_domain", "rate"])

    rated = soft.select("id", "tokens", "p").mapInArrow(
        run, "id long, tokens long, best int, p_domain double, rate double")

    def of_best(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("best") + 1)
    return rated.select(
        F.col("id").alias(id_col), F.col("tokens").alias("n_tokens"), of_best(model.domains).alias("domain"),
        "p_domain", "rate", copies(F.col("rate"), F.col("id"), seed).alias("copies"),
        of_best([float(g) for g in goal]).alias("target_tokens"),
        of_best([float(e) for e in expected]).alias("mixed_tokens"))


def copies(rate: Column, key: Column, seed: int = 42) -> Column:
    """Whole copies of a rate: its fraction is drawn by the key's hash."""
    drawn = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")).cast("long")


def mixed_documents(docs: DataFrame, model: Classifier, targets: dict[str, float] | None = None,
                    id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as its copies."""
    soft = write_table(posteriors(docs, model, id_col, text_col).select("tokens", "p"), "mixing-posteriors")
    step, _, _ = fit_rates(soft, model.domains, targets)
    shared = docs.sparkSession.sparkContext.broadcast((model.domains, model.vocab, model.weights))
    names = docs.columns
    text_at, id_at = names.index(text_col), names.index(id_col)

    # the draw is done by Spark's hash; the tasks only add the rate
    def run(batches):
        posterior = Classifier(*shared.value).scorer()
        for batch in batches:
            texts = [t or "" for t in map(pa.StringScalar.as_py, batch.column(text_at))]
            rates = _rates(np.array([posterior(t) for t in texts]).reshape(len(texts), -1), step)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates)], names=[*batch.schema.names, mark])

    mark = "mixing_rate"
    while mark in names:
        mark = "_" + mark
    rated = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(mark, T.DoubleType())]))
    times = F.array_repeat(F.lit(0), copies(F.col(mark), F.col(names[id_at]), seed).cast("int"))
    return rated.withColumn(mark, F.explode(times)).select(*names)
