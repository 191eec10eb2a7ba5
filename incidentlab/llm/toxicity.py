"""Toxicity by a classifier chain.

The labels know one category, ``toxic``.  The categories before it, ``kind1`` to
``kind4``, are learned from the labelled documents: the toxic ones are clustered by
the words that go with the label, whatever their language (see ``kinds``), and a
cluster is a category.  The chain predicts them in that order and ``toxic`` last, by
logistic regressions on those word features (see ``labelled``) that go with the label
beyond chance; each later one also gets the earlier categories' probabilities.  In
training these are out-of-fold predictions, so that a later model learns from
probabilities as good as it will see; features are chosen anew inside every fold.

The probability of ``toxic`` decides, from the threshold on that errs least at the
labels' class shares.  It is chosen on documents that had no part in the chain that
scores them: per fold a whole chain (features, kinds, inner folds) is fitted on the rest.

The models are fitted on at most ``PER_CLASS`` labelled documents of either
class; the class shares among all labels correct the intercept for that.

Edge cases: null and empty texts get the probabilities of a text without words
and are not rejected unless no label is 0; without labels of both classes
nothing is toxic; with fewer different toxic texts than kinds the last kinds are
empty; repeated rows repeat their answer; an empty table gives no rows; other columns
are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text, map_rows
from .labelled import columns_of, reader, sample, telling, vocabulary
from .linear import Rows, fit, sigmoid

PER_CLASS = 2_500
FOLDS = 3
KINDS = 4
#: rounds of clustering; assignments settle long before
ROUNDS = 50
_THRESHOLDS = tuple(k / 20 for k in range(2, 19))
L2 = 0.1

#: categories before the label, the kind of most labelled documents first
CATEGORIES = tuple(f"kind{k + 1}" for k in range(KINDS))


class Chain:
    """Vocabulary and, per category, the weights of features, then of the
    earlier categories' probabilities."""

    def __init__(self, names: list[str], vocab: dict[str, int], weights: list[np.ndarray], threshold: float):
        self.names, self.vocab, self.weights, self.threshold = names, vocab, weights, threshold

    def parts(self) -> tuple:
        return self.names, self.vocab, self.weights, self.threshold

    def scorer(self):
        """A function from text to the probabilities of the categories."""
        n = len(self.vocab) + 1
        read, table = reader(self.vocab), np.stack([w[:n] for w in self.weights], axis=1)

        def score(text: str) -> list[float]:
            z = table[read(text)].sum(axis=0) + table[0]
            out: list[float] = []
            for k, w in enumerate(self.weights):
                out.append(float(sigmoid(z[k] + np.dot(w[n:], out))))
            return out
        return score


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", per_class: int = PER_CLASS) -> Chain | None:
    """Chain fitted on labelled documents; None if a class has none."""
    y = F.col(label_col)
    share = labels.where(y.isin(0, 1)).agg(F.avg(y.cast("double"))).first()[0]
    rows = sample(labels.where(y.isin(0, 1)), docs, per_class, id_col, text_col, y, {})
    # copies would make chance words look telling
    rows = list({(r.y, tuple(r.words)): r for r in rows}.values())
    target = np.array([r.y for r in rows], np.float64)
    if not rows or target.min() == target.max():
        return None
    return train_on([r.words for r in rows], target, share, label_col)


def train_on(texts: list[list[str]], target: np.ndarray, share: float, label_col: str = "toxic") -> Chain:
    """Chain of the word lists ``texts`` with 0/1 ``target`` of both values;
    ``share`` is the share of ones among the documents to be judged."""
    features = vocabulary(texts)
    x = _rows(texts, features)
    chosen, weights = links(x, target)
    # the sample has other class shares than the labels
    shift = np.log(share / (1 - share)) - np.log(target.mean() / (1 - target.mean()))
    weights[-1][0] += shift
    unseen = np.full(len(texts), target.mean())
    for inside, outside in _folds(len(texts)):
        if 0 < target[inside].sum() < len(inside):
            own, w = links(x.take(inside), target[inside])
            unseen[outside] = probabilities(x.take(outside).narrow(own), w)[:, -1]
    p = np.clip(unseen, 1e-12, 1 - 1e-12)
    p = sigmoid(np.log(p / (1 - p)) + shift)
    wrong = [share * np.mean(p[target == 1] < t) + (1 - share) * np.mean(p[target == 0] >= t) for t in _THRESHOLDS]
    least = [t for t, w in zip(_THRESHOLDS, wrong) if w <= min(wrong) + 1e-12]
    names = np.array(["", *features])[chosen].tolist()
    vocab = {f: k for k, f in enumerate(names, 1)}
    return Chain([*CATEGORIES, label_col], vocab, weights, least[len(least) // 2])


def _folds(n: int):
    fold = np.arange(n) % FOLDS
    for f in range(FOLDS):
        inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(inside) and len(outside):
            yield inside, outside


def _rows(texts: list[list[str]], vocab: dict[str, int]) -> Rows:
    return Rows([columns_of(words, vocab) for words in texts], len(vocab) + 1)


def links(x: Rows, target: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The columns of ``x`` that the chain reads and its models' weights, in chain order."""
    chosen = telling(x, target)
    parts = []
    for inside, outside in _folds(len(x)):
        view = x.narrow(telling(x.take(inside), target[inside]))
        parts.append((inside, outside, view.take(inside), view.take(outside)))
    x = x.narrow(chosen)
    kind = kinds(x, target)
    earlier = np.zeros((len(x), 0))
    weights = []
    for goal in [*((kind == k).astype(float) for k in range(KINDS)), target]:
        goal = goal[:, None]
        weights.append(fit(x, goal, earlier, L2)[:, 0])
        out_of_fold = np.full(len(x), goal.mean())
        for inside, outside, train_rows, test_rows in parts:
            w = fit(train_rows, goal[inside], earlier[inside], L2)
            n = train_rows.n_cols
            out_of_fold[outside] = sigmoid(test_rows.dot(w[:n]) + earlier[outside] @ w[n:])[:, 0]
        earlier = np.column_stack((earlier, out_of_fold))
    return chosen, weights


def probabilities(x: Rows, weights: list[np.ndarray]) -> np.ndarray:
    """(rows, categories): the chain's probabilities of rows of its own columns."""
    out = np.zeros((len(x), 0))
    for w in weights:
        z = x.dot(w[:x.n_cols, None])[:, 0] + out @ w[x.n_cols:]
        out = np.column_stack((out, sigmoid(z)))
    return out


def kinds(x: Rows, target: np.ndarray) -> np.ndarray:
    """Per row the number of its kind, -1 if it is not toxic or has no feature
    that goes with toxicity.

    The toxic texts are clustered by the direction of their vectors of such features
    (spherical k-means, weights fall with a feature's number of toxic texts).  The
    first centre is the text nearest to the mean, each next one the text farthest from
    its nearest centre; the kind of most texts comes first.  All ties go to the earlier text.
    """
    ones = target > 0
    total = x.t_dot(np.ones((len(x), 1)))[:, 0]
    found = x.t_dot(target[:, None])[:, 0]
    with_label = found * len(x) > total * target.sum()
    with_label[0] = False       # the intercept
    columns = np.flatnonzero(with_label)
    place = np.full(x.n_cols, -1)
    place[columns] = np.arange(len(columns))
    weight = np.log(1 + ones.sum() / found[columns])
    points, members = [], []
    for i in np.flatnonzero(ones):
        own = place[x.cols[x.starts[i]:x.starts[i] + x.sizes[i]]]
        own = own[own >= 0]
        if len(own):
            point = np.zeros(len(columns))
            point[own] = weight[own]
            points.append(point / np.linalg.norm(point))
            members.append(i)
    out = np.full(len(x), -1)
    if not points:
        return out
    v = np.stack(points)
    centres = [v[np.argmax(v @ v.mean(axis=0))]]
    while len(centres) < KINDS:
        nearest = np.max(v @ np.stack(centres).T, axis=1)
        if nearest.min() > 1 - 1e-9:
            break               # no further direction
        centres.append(v[np.argmin(nearest)])
    c = np.stack(centres)
    group = np.argmax(v @ c.T, axis=1)
    for _ in range(ROUNDS):
        sums = np.stack([v[group == k].sum(axis=0) for k in range(len(c))])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
        new = np.argmax(v @ c.T, axis=1)
        if (new == group).all():
            break
        group = new
    order = np.argsort(-np.bincount(group, minlength=KINDS), kind="stable")
    rank = np.empty(KINDS, int)
    rank[order] = np.arange(KINDS)
    out[members] = rank[group]
    return out


def judge(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``p_<category>`` for each category in chain
    order, and ``is_toxic``."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), clean_text(text_col).alias("t"))
    if chain is None:
        return slim.select(F.col("id").alias(id_col), *[F.lit(0.0).alias(f"p_{c}") for c in (*CATEGORIES, "toxic")],
                           F.lit(False).alias("is_toxic"))
    # bounded by the sample: its features and one weight for each and category
    shared = docs.sparkSession.sparkContext.broadcast(chain.parts())

    def make():
        own = Chain(*shared.value)
        score, names, threshold = own.scorer(), own.names, own.threshold

        def work(ids, texts):
            p = [score(t) for t in map(pa.StringScalar.as_py, texts)]
            return {"id": ids, "is_toxic": [x[-1] >= threshold for x in p]} | \
                {f"p_{c}": [x[k] for x in p] for k, c in enumerate(names)}
        return work

    schema = "id long, " + ", ".join(f"p_{c} double" for c in chain.names) + ", is_toxic boolean"
    return map_rows(slim, schema, make).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, chain: Chain | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns as they were."""
    if chain is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(chain.parts())
    place = docs.columns.index(text_col)

    def run(batches):
        own = Chain(*shared.value)
        score, threshold = own.scorer(), own.threshold
        for batch in batches:
            keep = [score(t or "")[-1] < threshold for t in map(pa.StringScalar.as_py, batch.column(place))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
