"""Toxicity, mixing and the pipeline."""

import math
import warnings

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare
from incidentlab.llm import linear, mixing, queries, toxicity
from incidentlab.llm.common import read
from incidentlab.llm.labelled import word_features, words_of
from incidentlab.session import release_tables, tables_written

from conftest import SF_ORACLE, SF_SMALL
from llm_fixtures import awkward, awkward_rows, frame, nothing
from test_llm_dedup import brute_components, brute_fingerprint
from test_llm_tokens import LIBRARY

SF_LARGE = "/root/testdata/sf0.1"


def test_regressions_reach_the_minimum():
    r = np.random.default_rng(1)
    rows = linear.Rows([list(r.choice(np.arange(1, 12), 3, replace=False)) for _ in range(80)], 12)
    y = r.integers(0, 2, (80, 1)).astype(float)
    w = linear.fit(rows, y, l2=0.5, steps=200)
    dense = np.zeros((80, 12))
    for k in range(80):
        dense[k, rows.cols[rows.starts[k]:rows.starts[k] + rows.sizes[k]]] = 1
    pen = w.copy()
    pen[0] = 0
    assert np.abs(dense.T @ (linear.sigmoid(dense @ w) - y) + 0.5 * pen).max() < 1e-2
    many = np.eye(3)[r.integers(0, 3, 80)]
    w = linear.fit(rows, many, l2=0.5, steps=200)
    pen = w.copy()
    pen[0] = 0
    assert np.abs(dense.T @ (linear.softmax(dense @ w) - many) + 0.5 * pen).max() < 1e-2


def test_toxic_documents_are_found_and_others_left(spark):
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, SF_ORACLE).collect()}
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{SF_ORACLE}/labels.parquet'").fetchall()
    assert len(got) == 1000
    assert np.mean([got[i].is_toxic == bool(t) for i, t in labels]) >= 0.96
    # trained without the labels of odd documents, judged on these
    docs, table = read(spark, SF_ORACLE, "documents"), read(spark, SF_ORACLE, "labels")
    chain = toxicity.train(docs, table.where("doc_id % 2 = 0"))
    half = {r.doc_id: r for r in toxicity.judge(docs, chain).collect()}
    odd = [(half[i], bool(t)) for i, t in labels if i % 2]
    assert np.mean([r.is_toxic for r, t in odd if t]) >= 0.7
    assert np.mean([r.is_toxic for r, t in odd if not t]) <= 0.02
    assert all(0 <= p <= 1 for r in half.values() for p in (*(r[f"p_{c}"] for c in toxicity.CATEGORIES), r.p_toxic))


def labelled_words(parity):
    """(words, toxic, lang) of sf0.1's labelled documents of one parity, copies once."""
    found = duckdb.sql(f"""SELECT d.text, l.toxic, d.lang FROM '{SF_LARGE}/labels.parquet' l
        JOIN '{SF_LARGE}/documents.parquet' d USING (doc_id)
        WHERE l.toxic IN (0, 1) AND d.doc_id % 2 = {parity} ORDER BY d.doc_id""").fetchall()
    rows = {(tuple(sorted(words_of(t or ""))), y): lang for t, y, lang in found}
    return [list(w) for w, _ in rows], np.array([float(y) for _, y in rows]), list(rows.values())


@pytest.fixture(scope="module")
def trained():
    texts, y, langs = labelled_words(0)
    return texts, y, langs, toxicity.train_on(texts, y, y.mean())


def test_chain_probabilities_equal_the_formulas(trained):
    """Plain loops over the same weights; every link ends at its minimum."""
    texts, y, _, chain = trained
    score = chain.scorer()
    for words in texts[::40]:
        present = {f for w in words for f in word_features(w)}
        earlier = []
        for weights in chain.weights:
            z = weights[0] + sum(weights[k] for f, k in chain.vocab.items() if f in present)
            z += sum(a * b for a, b in zip(weights[len(chain.vocab) + 1:], earlier))
            earlier.append(1 / (1 + math.exp(-z)))
        assert np.allclose(score(" ".join(words)), earlier, atol=1e-9)
    # first link: no earlier category, so its gradient can be stated from the rows alone
    x = toxicity._rows(texts, chain.vocab)
    goal = (toxicity.kinds(x, y) == 0).astype(float)[:, None]
    w = chain.weights[0][:, None]
    pen = w.copy()
    pen[0] = 0
    assert np.abs(x.t_dot(linear.sigmoid(x.dot(w)) - goal) + toxicity.L2 * pen).max() < 0.05


def test_kinds_cover_every_language(trained):
    texts, y, langs, chain = trained
    kind = toxicity.kinds(toxicity._rows(texts, chain.vocab), y)
    assert not (kind[y == 0] >= 0).any()
    for lang in ("en", "de", "fr", "es"):
        own = [k for k, t, l in zip(kind, y, langs) if t and l == lang]
        assert np.mean([k >= 0 for k in own]) >= 0.8


def test_earlier_categories_change_answers_on_unseen_labels(trained):
    chain = trained[-1]
    texts, y, _ = labelled_words(1)
    x = toxicity._rows(texts, chain.vocab)
    p = toxicity.probabilities(x, chain.weights)[:, -1]
    cut = [w.copy() for w in chain.weights]
    cut[-1][x.n_cols:] = 0
    q = toxicity.probabilities(x, cut)[:, -1]

    def loss(v):
        return -np.mean(np.log(np.clip(np.where(y > 0, v, 1 - v), 1e-12, 1)))
    assert loss(p) < loss(q) and ((p >= chain.threshold) != (q >= chain.threshold)).any()
    assert np.mean(p[y == 1] >= chain.threshold) >= 0.85 and np.mean(p[y == 0] >= chain.threshold) <= 0.01


def test_chance_features_do_not_reach_the_threshold():
    """Labels that no word tells: a chain that chose features before its folds would
    think itself right on them."""
    r = np.random.default_rng(5)
    names = ["".join(r.choice(list("abcdefghij"), 4)) for _ in range(400)]
    texts = [sorted(set(r.choice(names, 30))) for _ in range(300)]
    y = (r.random(300) < 0.3).astype(float)
    chain = toxicity.train_on(texts, y, 0.3)
    fresh = [sorted(set(r.choice(names, 30))) for _ in range(300)]
    p = toxicity.probabilities(toxicity._rows(fresh, chain.vocab), chain.weights)[:, -1]
    assert np.mean(p >= chain.threshold) <= 0.3


def test_kinds_of_few_and_equal_texts():
    texts = [["awfulword", "plain"]] * 6 + [["plain", "quiet"]] * 12
    y = np.array([1.0] * 6 + [0.0] * 12)
    chain = toxicity.train_on(texts, y, 1 / 3)
    kind = toxicity.kinds(toxicity._rows(texts, chain.vocab), y)
    assert set(kind[:6]) == {0} and set(kind[6:]) == {-1}
    score = chain.scorer()
    assert score("awfulword")[-1] >= chain.threshold > score("plain quiet")[-1]


LABELS = "doc_id long, quality int, toxic int, y string, chosen_id string"


def labels_for(spark, toxic=(3, 7)):
    ids = [r[0] for r in awkward_rows() if r[0] is not None]
    return spark.createDataFrame([(i, int(i % 3 != 0), int(i in toxic), "x", "x") for i in ids]
                                 + [(None, 1, 1, "x", "x"), (999, None, None, "x", "x")], LABELS)


def test_toxicity_of_awkward_rows(spark):
    docs = awkward(spark)
    chain = toxicity.train(docs, labels_for(spark))
    assert toxicity.judge(docs, chain).count() == len(awkward_rows())
    kept = toxicity.drop_toxic(docs, chain)
    assert kept.schema == docs.schema and {4, 5, 6} <= {r.doc_id for r in kept.collect()}
    none = toxicity.train(docs, labels_for(spark, toxic=()))
    assert none is None and toxicity.drop_toxic(docs, none).count() == len(awkward_rows())
    assert not any(r.is_toxic for r in toxicity.judge(docs, none).collect())
    assert toxicity.train(nothing(spark), labels_for(spark)) is None
    assert toxicity.judge(nothing(spark), chain).count() == toxicity.drop_toxic(nothing(spark), chain).count() == 0


def least_squares(p, goal):
    """Masses w >= 0 with the least |w p - goal|: exact, by active sets (Lawson and Hanson)."""
    a, w, free = p.T, np.zeros(len(p)), np.zeros(len(p), bool)
    for _ in range(1000):
        slope = a.T @ (goal - a @ w)
        if free.all() or slope[~free].max() <= 1e-10 * goal.sum():
            break
        free[np.where(free, -np.inf, slope).argmax()] = True
        while True:
            z = np.zeros(len(p))
            z[free] = np.linalg.lstsq(a[:, free], goal, rcond=None)[0]
            if z[free].min() > 0:
                break
            cut = free & (z <= 0)
            w = w + (w[cut] / (w[cut] - z[cut])).min() * (z - w)
            free &= w > 1e-12 * goal.sum()
            w[~free] = 0
        w = z
    return w


@pytest.mark.parametrize("targets", [None, {"en": 0.5, "fr": 0.3, "es": 0.1, "de": 0.1, "low": 0.0},
                                     {"es": 0.9, "en": 0.1}, {"low": 1.0}, {"unknown": 1.0}])
def test_rates_meet_the_targets(spark, targets):
    docs, labels = read(spark, SF_ORACLE, "documents"), read(spark, SF_ORACLE, "labels")
    model = mixing.train(docs, labels)
    soft = mixing.write_table(mixing.posteriors(docs, model), "test-posteriors")
    check_rates(soft, model.domains, targets)


@pytest.mark.parametrize("targets", [{"a": 1, "b": 1}, {"a": 9, "b": 1}, {"a": 3, "b": 3, "c": 3, "d": 1}, {"e": 1},
                                     dict.fromkeys("abcde", 1)])
def test_targets_that_push_rates_to_zero(spark, targets):
    r = np.random.default_rng(3)
    p = np.exp(r.normal(0, 2, (1000, 5)))
    p /= p.sum(axis=1, keepdims=True)
    tokens = np.floor(np.exp(r.normal(5, 1, 1000)))
    tokens[:3] = 0
    soft = mixing.write_table(spark.createDataFrame(
        [(int(t), q.tolist()) for t, q in zip(tokens, p)], "tokens long, p array<double>"), "test-posteriors")
    check_rates(soft, list("abcde"), targets)


def check_rates(soft, domains, targets):
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        step, expected, goal = mixing.fit_rates(soft, domains, targets)
    rows = soft.collect()
    p, tokens = np.array([r.p for r in rows]), np.array([r.tokens for r in rows], float)
    rates = mixing._rates(p, step)
    assert (rates >= 0).all()
    assert (tokens * rates) @ p == pytest.approx(expected, rel=1e-6, abs=1e-6 * tokens.sum())
    best = least_squares(p[tokens > 0], goal) @ p[tokens > 0]
    # within 1 % of the least squared error, or of 1e-5 of all tokens
    assert ((expected - goal) ** 2).sum() <= 1.01 * ((best - goal) ** 2).sum() + \
        (1e-5 * tokens.sum()) ** 2
    off = mixing.unmet(domains, expected, goal)
    assert bool(off) == any("mixing targets" in str(w.message) for w in said)
    assert bool(off) == (np.abs(expected - goal).max() > mixing.TOLERANCE * goal.sum())


def test_mixing_result_and_copies_agree(spark):
    docs, labels = read(spark, SF_ORACLE, "documents"), read(spark, SF_ORACLE, "labels")
    model = mixing.train(docs, labels)
    want = {r.doc_id: r for r in mixing.mix(docs, model).collect()}
    assert len(want) == 1000 and {r.domain for r in want.values()} <= set(model.domains)
    got = {r.doc_id: r["count"] for r in mixing.mixed_documents(docs, model).groupBy("doc_id").count().collect()}
    assert got == {i: r.copies for i, r in want.items() if r.copies}
    assert all(abs(r.copies - r.rate) < 1 for r in want.values())
    truth = duckdb.sql(f"SELECT l.doc_id, lang FROM '{SF_ORACLE}/labels.parquet' l JOIN "
                       f"'{SF_ORACLE}/documents.parquet' d USING (doc_id) WHERE quality = 1").fetchall()
    assert np.mean([want[i].domain == lang for i, lang in truth]) >= 0.9


def test_mixing_of_awkward_rows(spark):
    docs = awkward(spark)
    model = mixing.train(docs, labels_for(spark))
    assert mixing.mix(docs, model).count() == len(awkward_rows())
    assert mixing.mixed_documents(docs, model).columns == docs.columns
    unlabelled = mixing.train(docs, labels_for(spark).limit(0))
    assert {round(r.rate, 9) for r in mixing.mix(docs, unlabelled).collect()} == {1.0}
    assert mixing.mix(nothing(spark), model).count() == mixing.mixed_documents(nothing(spark), model).count() == 0


def test_pipeline_against_brute_force(spark):
    docs, sf = read(spark, SF_SMALL, "documents"), SF_SMALL
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "simhash", "mixing", "sentencepiece"]
    rows = [tuple(r) for r in docs.collect()]
    toxic = {r.doc_id for r in queries.op5_toxicity(spark, sf).collect() if r.is_toxic}
    rows = [r for r in rows if r[0] not in toxic]
    best = {}
    for r in rows:
        best[r[1]] = max(best.get(r[1], -1), r[0])
    rows = [r for r in rows if best[r[1]] == r[0]]
    comp = brute_components({r[0]: brute_fingerprint(r[1] or "") for r in rows})
    rows = [r for r in rows if comp[r[0]] == r[0]]
    left = frame_of(spark, rows, docs.schema)
    mixed = mixing.mix(left, mixing.train(left, read(spark, sf, "labels")))
    copies = {r.doc_id: r.copies for r in mixed.collect()}
    want = sorted((r[0], len(LIBRARY.encode(r[1] or "", add_bos=True, add_eos=True)))
                  for r in rows for _ in range(copies[r[0]]))
    since = tables_written()
    got = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want
    # of all that the stages wrote, the table that the last one reads is left
    assert tables_written() == since + 1 and release_tables(spark, since) == 1


def frame_of(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_stages_take_awkward_rows_and_nothing(spark, tmp_dir):
    labels_for(spark).write.parquet(f"{tmp_dir}/labels.parquet")
    for start in (awkward(spark), nothing(spark)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, tmp_dir)
            if name != "sentencepiece":
                assert out.columns == docs.columns
                docs = mixing.write_table(out, "test-stage")
        assert (out.count() == 0) == (start.count() == 0)


def test_entry_lists_all_operators(spark):
    names = set(entry.queries())
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


def test_exact_dedup_oracle(spark):
    ok, message = compare(spark, "op10_exact_dedup", SF_ORACLE, entry.queries()["op10_exact_dedup"],
                          entry.oracle_sql()["op10_exact_dedup"])
    assert ok, message
