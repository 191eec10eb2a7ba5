"""Spelling variants against plain-Python statements of the rules."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from incidentlab.llm import spelling

from llm_fixtures import awkward, awkward_rows, frame, nothing


def one_edit(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    if len(x) == len(y):
        return sum(c != d for c, d in zip(x, y)) == 1
    return any(y[:k] + y[k + 1:] == x for k in range(len(y)))


def brute(vocab):
    near = {w: [v for v in vocab if one_edit(w, v)] for w in vocab}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best is not None and vocab[best] >= 2 * vocab[w] else None
    out = set()
    for w in vocab:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, vocab[w], len(near[w]), vocab.get(form[w])))
    return out


def grouped(spark, vocab, limit=spelling.LIMIT, few=2):
    rows = spark.createDataFrame([(w, n, "x") for w, n in vocab.items()], "word string, n long, m string")
    got = [tuple(r) for r in spelling.variants(rows.select("word", "n"), limit=limit, few=few).collect()]
    assert len(got) == len(vocab)
    return set(got)


def random_vocab(seed, n, letters, shortest, longest):
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randint(shortest, longest))): r.randint(3, 60)
            for _ in range(n)}


@pytest.mark.parametrize("limit", [spelling.LIMIT, 1, 40])
@pytest.mark.parametrize("letters, shortest, longest", [("ab", 1, 7), ("aé\U0001f642b", 2, 5), ("abcde", 5, 6)])
def test_against_the_rule(spark, letters, shortest, longest, limit):
    vocab = random_vocab(7, 150, letters, shortest, longest)
    assert grouped(spark, vocab, limit) == brute(vocab)


@pytest.mark.parametrize("seed", range(40))
def test_composition_of_one_partition(seed):
    r = random.Random(seed)
    m, a = r.randint(1, 6), r.randint(0, 2)
    b = r.randint(0, max(0, m - a))
    a = min(a, m - b)
    head, tail = "ab"[:a], "ba"[:b] + "a" * max(0, b - 2)
    words = sorted({head + "".join(r.choice("ab") for _ in range(m - a - b + r.randint(0, 1))) + tail
                    for _ in range(30)})
    r.shuffle(words)
    got = [frozenset((words[x], words[y])) for x, y in spelling.pairs_of(words, m, a, b, 2 ** 31 - 1)]
    want = {frozenset((x, y)) for x in words for y in words
            if one_edit(x, y) and max(len(x), len(y)) == m + 1}
    assert len(got) == len(set(got)) and set(got) == want


def test_acceptor_is_minimal_and_numbers_its_words():
    words = sorted({p + s for p in ("un", "re", "") for s in ("do", "doing", "made")})
    dfa = spelling.Acceptor(words)
    for k, word in enumerate(words):
        state, at = dfa.start, 0
        for c in word:
            step, state = dfa.arcs[state][c]
            at += step
        assert dfa.final[state] and at == k
    seen = {(dfa.final[q], tuple(dfa.arcs[q].items())) for q in range(len(dfa.final))}
    assert len(seen) == len(dfa.final) and len(dfa.final) < sum(map(len, words)) // 2


def test_very_long_words_and_a_hot_beginning(spark):
    long = "x" * 20_000
    vocab = {long: 5, long + "x": 11, "y" + long[1:]: 3, "abcde" * 2_000: 4}
    assert grouped(spark, vocab, 5_000) == brute(vocab)
    r = random.Random(1)
    vocab = {"prefix" + "".join(r.choice("abc") for _ in range(6)): r.randint(3, 99) for _ in range(300)}
    assert grouped(spark, vocab, 200) == brute(vocab)


def words_of(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = Counter(run.translate(lower) for r in rows for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""))
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def test_counts_over_whole_texts(spark):
    rows = awkward_rows() + [(20, "Straße STRASSE straße Straße strasse strasse ÀÉÎÕÜ àéîõü àéîõü×", "de", "a", 1)]
    words = spelling.runs(frame(spark, rows)).select(F.col("run").alias("word"))
    assert {r.word: r.n for r in spelling.vocabulary(words).collect()} == words_of(rows)
    got = spelling.variants(spelling.vocabulary(words)).collect()
    assert {tuple(r) for r in got} == brute(words_of(rows))


def test_registered_query_deletes_by_hash(spark, tmp_dir):
    from incidentlab.llm import queries
    rows = awkward_rows() + [(k, f"Entry entries entry{chr(97 + k % 26)} Entries", "en", "a", 1) for k in range(100, 400)]
    frame(spark, rows).write.parquet(tmp_dir + "/documents.parquet")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            at = h % len(run)
            count[run[:at] + run[at + 1:] if h % 97 == 0 else run] += 1
    vocab = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    assert {tuple(r) for r in queries.op11_spelling(spark, tmp_dir).collect()} == brute(vocab)


def test_empty_and_awkward_tables(spark):
    assert spelling.runs(nothing(spark)).count() == 0
    assert spelling.variants(spelling.vocabulary(
        spelling.runs(nothing(spark)).select(F.col("run").alias("word")))).count() == 0
    assert spelling.runs(awkward(spark)).where("run is null or run = ''").count() == 0
