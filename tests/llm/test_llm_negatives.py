"""Hard negatives against a plain-Python statement of the rule."""

import math
import random

import pytest
from pyspark.sql import functions as F

from incidentlab.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, cell string, score string, kind string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "x", "x", "x", "x") for i, v, lab in rows], SCHEMA)


def brute(rows, is_anchor, k=5, m=3, low=50, high=95):
    whole = {}
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = (lab, [math.floor(256 * x) for x in v])
        whole[i] = min(whole.get(i, q), q)
    out = set()
    for a in (i for i in whole if is_anchor(i)):
        lab, q = whole[a]
        near = sorted((-sum(x * y for x, y in zip(q, w)), i, other == lab)
                      for i, (other, w) in whole.items() if i != a)
        for s, p, _ in [r for r in near if r[2]][:k]:
            hits = [(n, i) for n, i, same in near if not same and low * -s <= 100 * -n <= high * -s][:m]
            out |= {(a, p, rank, i, -s, -n) for rank, (n, i) in enumerate(hits, 1)}
    return out


def mined(spark, rows, **options):
    got = hard_negatives.mine(frame(spark, rows), is_anchor=F.col("vec_id") % 3 == 0, **options).collect()
    assert len(set(got)) == len(got)
    return {tuple(r) for r in got}


def rows_of(seed, n, values, dims=4, labels=3):
    r = random.Random(seed)
    return [(i - 10, [r.choice(values) for _ in range(dims)], r.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("blocks", [{}, {"row_block": 32 * 7, "anchor_block": 32 * 5}])
@pytest.mark.parametrize("values", [[0.0, 0.25, 0.5], [-1.0, -0.3, 0.1, 0.7, 2.0], [0.0]])
def test_against_the_rule(spark, values, blocks):
    rows = rows_of(3, 60, values)
    assert mined(spark, rows, **blocks) == brute(rows, lambda i: i % 3 == 0)


def test_many_equal_rows_and_ties(spark):
    rows = rows_of(4, 40, [0.5, 1.0]) + [(i, [1.0, 1.0, 0.5, 0.5], i % 2) for i in range(100, 160)]
    got = mined(spark, rows, row_block=32 * 9, anchor_block=32 * 9)
    assert got == brute(rows, lambda i: i % 3 == 0) and got


def test_other_bounds(spark):
    rows = rows_of(5, 50, [0.1, 0.4, 0.9])
    assert mined(spark, rows, positives=2, negatives=7, low=10, high=100) == \
        brute(rows, lambda i: i % 3 == 0, 2, 7, 10, 100)


def test_awkward_rows(spark):
    rows = rows_of(6, 30, [0.2, 0.6]) + [
        (300, None, 1), (303, [None, 1.0, 1.0, 1.0], 1), (306, [float("nan")] * 4, 1), (309, [float("inf")] * 4, 0),
        (312, [0.5] * 4, None), (None, [0.5] * 4, 1), (315, [], 1), (318, [0.9], 2), (321, [0.5] * 6, 0),
        (324, [0.5] * 4, 1), (324, [0.5] * 4, 1), (327, [0.5] * 4, 1), (327, [0.25] * 4, 0)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 3 == 0)


def test_large_components_do_not_round(spark):
    rows = [(i, [float(2 ** 20 + i), float(i % 5)], i % 2) for i in range(40)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 3 == 0)
    rows = [(i, [3e38, 1.0], i % 2) for i in range(10)]
    mined(spark, rows)                      # wraps, but ends


def test_empty_table_and_no_anchors(spark):
    assert mined(spark, []) == set()
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 0), (4, [0.7], 1)]) == set()


def test_windows_hold_one_anchor_only():
    w = hard_negatives.Windows(3, 50, 95)
    keys = ((a, -s, kind, i) for a in range(50) for s, kind, i in [(100, 0, 1)] + [(90 - j, 1, j) for j in range(60)])
    assert len(list(w.emit(keys))) == 150 and len(w.open) == 1
