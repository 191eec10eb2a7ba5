"""DuckDB SQL that grows the decision tree level by level, independently of Spark.

Per level: class counts of every (node, feature, value) of the training rows, all
candidate splits with their gini gain, the best one per node, and the rows' way to
the two children.  The rules are those of the tree trainer, to the tie:

* a number may be cut half way between neighbouring training values, values up to
  the cut going left;
* a category with few levels may be cut into any two sets (numbered by the bits of
  the levels that go left), one with many after any level in order of the levels'
  impurity in the node;
* the largest gain wins, the first feature and the first cut on equal gains; without
  a gain above zero, in a pure node and at the last level a node is a leaf;
* two leaves of one prediction, the most frequent label (the smallest index on
  ties), become one.
"""

from __future__ import annotations

import math

from ..schemas import CATEGORY_FEATURES, LABEL_COL, NUMERIC_FEATURES
from .oracles import IN_TRAIN

#: the labels are the five kinds of events
CLASSES = 5
FEATURES = CATEGORY_FEATURES + NUMERIC_FEATURES


def few_levels(max_bins: int) -> int:
    """The most levels that a category with every two-set cut may have."""
    return math.floor(math.log2(max_bins // 2 + 1) + 1)


def _each(pattern: str) -> str:
    return ", ".join(pattern.format(c=c) for c in range(CLASSES))


def _total(prefix: str) -> str:
    return "(" + " + ".join(f"{prefix}{c}" for c in range(CLASSES)) + ")"


def gini(prefix: str, total: str) -> str:
    return "(1.0::DOUBLE" + "".join(f" - ({prefix}{c} / {total}) * ({prefix}{c} / {total})"
                                    for c in range(CLASSES)) + ")"


def _predicted(prefix: str) -> str:
    most = "greatest(" + _each(prefix + "{c}") + ")"
    return "CASE " + " ".join(f"WHEN {prefix}{c} = {most} THEN {c}" for c in range(CLASSES)) + " END"


def vector_ctes(max_bins: int) -> str:
    """CTEs (after enriched and freq): the rows as vectors, and what the trainer
    knows of the features."""
    n_cat = len(CATEGORY_FEATURES)
    joins = " ".join(f"JOIN freq i{j} ON i{j}.feature = '{c}' AND i{j}.value = CAST(e.\"{c}\" AS VARCHAR)"
                     for j, c in enumerate(CATEGORY_FEATURES))
    xs = ", ".join([f"i{j}.idx" for j in range(n_cat)] + [f'e."{c}"' for c in NUMERIC_FEATURES])
    arity = ", ".join(f"({j}, '{c}')" for j, c in enumerate(CATEGORY_FEATURES))
    return f""",
vec AS MATERIALIZED (
  SELECT e.Id, {IN_TRAIN.replace("Id", "e.Id")} AS in_train, lab.idx AS y, [{xs}] AS x
  FROM enriched e {joins}
  JOIN freq lab ON lab.feature = '{LABEL_COL}' AND lab.value = e.{LABEL_COL}),
long AS MATERIALIZED (
  SELECT Id, y, unnest(range({len(FEATURES)})) AS f, unnest(x) AS v FROM vec WHERE in_train),
arity AS (
  SELECT j AS f, count(*)::INT AS k FROM freq JOIN (VALUES {arity}) AS a(j, name) ON name = feature GROUP BY j),
few AS (SELECT f, k, unnest(range(1, 1 << (k - 1))) AS s FROM arity WHERE k BETWEEN 2 AND {few_levels(max_bins)}),
many AS (SELECT f FROM arity WHERE k > {few_levels(max_bins)}),
halfway AS (
  SELECT f, v, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2.0 AS cut
  FROM (SELECT DISTINCT f, v FROM long WHERE f >= {n_cat}))"""


def _level(d: int, depth: int) -> str:
    """From at{d} (Id, in_train, y, x, node; the open nodes' rows) to best{d} and at{d + 1}."""
    n_cat = len(CATEGORY_FEATURES)
    c = _each("c{c}")
    running = ", ".join(f"sum(c{k}) OVER w AS l{k}" for k in range(CLASSES))
    left = _each("l{c}")
    right = ", ".join(f"t{k} - l{k} AS r{k}" for k in range(CLASSES))
    gain = (f"{gini('t', 'n')} - ({_total('l')} / n) * {gini('l', _total('l'))}"
            f" - ({_total('r')} / n) * {gini('r', _total('r'))}")
    return f""",
bins{d} AS MATERIALIZED (
  SELECT *, {gini('c', _total('c'))} AS impurity FROM (
    SELECT a.node, l.f, l.v, {", ".join(f"sum(CASE WHEN l.y = {k} THEN 1 ELSE 0 END)::DOUBLE AS c{k}" for k in range(CLASSES))}
    FROM at{d} a JOIN long l ON a.Id = l.Id WHERE a.in_train GROUP BY a.node, l.f, l.v)),
totals{d} AS (SELECT node, {", ".join(f"sum(c{k}) AS t{k}" for k in range(CLASSES))} FROM bins{d} WHERE f = 0 GROUP BY node),
ranked{d} AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY node, f ORDER BY impurity, v) AS place FROM bins{d} WHERE f IN (SELECT f FROM many)),
cuts{d} AS (
  SELECT node, f, v AS place, {running} FROM bins{d} WHERE f >= {n_cat} WINDOW w AS (PARTITION BY node, f ORDER BY v)
  UNION ALL SELECT node, f, place, {running} FROM ranked{d} WINDOW w AS (PARTITION BY node, f ORDER BY place)
  UNION ALL SELECT node, f, s, {_each("sum(c{c})")} FROM bins{d} JOIN few USING (f)
            WHERE (s >> v::INT) & 1 = 1 GROUP BY node, f, s),
best{d} AS MATERIALIZED (
  SELECT b.*, h.cut FROM (
    SELECT *, {gain} AS gain FROM (
      SELECT c.*, {_each("t{c}")}, {_total("t")} AS n, {right} FROM cuts{d} c JOIN totals{d} USING (node))
    WHERE {_total("r")} > 0 AND {_total("l")} > 0
    QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, place) = 1) b
  LEFT JOIN halfway h ON b.f = h.f AND b.place = h.v AND b.f >= {n_cat}
  WHERE gain > 0),
moved{d} AS MATERIALIZED (
  SELECT a.Id, a.in_train, a.y, a.x,
         2 * a.node + CASE WHEN CASE WHEN b.f >= {n_cat} THEN a.x[b.f + 1] <= b.cut
                                     WHEN b.f IN (SELECT f FROM many) THEN coalesce(r.place <= b.place, false)
                                     ELSE (b.place::BIGINT >> a.x[b.f + 1]::INT) & 1 = 1 END THEN 0 ELSE 1 END AS node
  FROM at{d} a JOIN best{d} b USING (node)
  LEFT JOIN ranked{d} r ON r.node = a.node AND r.f = b.f AND r.v = a.x[b.f + 1]),
at{d + 1} AS MATERIALIZED (
  SELECT m.* FROM moved{d} m JOIN (
    SELECT 2 * node AS node, {gini('l', _total('l'))} AS impurity FROM best{d}
    UNION ALL SELECT 2 * node + 1, {gini('r', _total('r'))} FROM best{d}) USING (node)
  WHERE impurity > 2.220446049250313e-16 AND {d + 1} < {depth})"""


def tree_ctes(depth: int, max_bins: int) -> str:
    """CTEs ending in ``splits`` (node, f, place, cut, gain, n, l0.., r0..; the tree's
    inner nodes, the root 1, children 2 * node and 2 * node + 1) and ``ends``
    (Id, in_train, y, node, prediction; every row's leaf)."""
    out = vector_ctes(max_bins) + ",\nat0 AS (SELECT *, 1::BIGINT AS node FROM vec)"
    out += "".join(_level(d, depth) for d in range(depth))
    cols = "node, f, place, cut, gain, n, " + _each("t{c}") + ", " + _each("l{c}") + ", " + _each("r{c}")
    grown = " UNION ALL ".join(f"SELECT {cols} FROM best{d}" for d in range(depth))
    # a row ends where no split takes it further: in a child that is not open, or in
    # an open node without a split
    ends = " UNION ALL ".join(
        [f"SELECT Id, in_train, y, node FROM at{d} WHERE node NOT IN (SELECT node FROM best{d})" for d in range(depth)]
        + [f"SELECT Id, in_train, y, node FROM moved{d} WHERE node NOT IN (SELECT node FROM at{d + 1})"
           for d in range(depth)])
    up = f"unnest(range(1, {depth} + 1))"
    return out + f""",
grown AS MATERIALIZED ({grown}),
leaves AS MATERIALIZED (
  SELECT node, {_predicted("c")} AS prediction FROM (
    SELECT 2 * node AS node, {", ".join(f"l{k} AS c{k}" for k in range(CLASSES))} FROM grown
    UNION ALL SELECT 2 * node + 1, {", ".join(f"r{k} AS c{k}" for k in range(CLASSES))} FROM grown
    UNION ALL SELECT 1, {", ".join(f"count(*) FILTER (in_train AND y = {k}) AS c{k}" for k in range(CLASSES))} FROM vec)
  WHERE node NOT IN (SELECT node FROM grown)),
kept AS (
  SELECT node FROM (SELECT node >> up AS node, prediction FROM (SELECT *, {up} AS up FROM leaves))
  WHERE node > 0 GROUP BY node HAVING count(DISTINCT prediction) > 1),
splits AS MATERIALIZED (SELECT * FROM grown WHERE node IN (SELECT node FROM kept)),
ends AS MATERIALIZED (SELECT e.*, prediction FROM ({ends}) e JOIN leaves USING (node))"""


def importance_sql() -> str:
    """(feature, importance) from ``splits``."""
    names = ", ".join(f"({j}, '{c}{'Indexed' if j < len(CATEGORY_FEATURES) else ''}')" for j, c in enumerate(FEATURES))
    return f"""SELECT name AS feature, coalesce(round(sum(gain * n) / (SELECT sum(gain * n) FROM splits), 9), 0.0) AS importance
FROM (VALUES {names}) AS a(j, name) LEFT JOIN splits ON f = j GROUP BY name"""
