"""Hard negatives by a secondary sort.

Pair scores travel as (anchor, descending score, id) keys: they are repartitioned
by anchor and sorted within partitions, and a streaming pass over each partition
opens a window per positive and emits the negatives that fall into it.  It holds
one anchor's open windows, never an anchor's pairs.

Anchors are scored against all rows in blocks: rows and anchors are dealt into
blocks of bounded size by hash, and every pair of blocks is one group of a
co-grouped job, so nothing is broadcast and no task holds more than two blocks.
Before the shuffle a block keeps what can still be among an anchor's first rows:
its first positives in a first pass, and, once the positives are known, the first
negatives of every window in a second one.  Both are exact: an overall first row
is a first row of its block.

Edge cases: rows with a null id, label or vector, or with a null or non-finite
component, take no part; of rows that share an id the first by label, then vector,
stands for it; vectors of unequal length are extended with zeros (an empty one
scores 0); scores are exact up to 64 bits and wrap beyond; an anchor without
positives, or whose windows are empty, gives no rows, nor does an empty table;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import write_table
from .common import map_rows

#: bytes of a block of rows and of a block of anchors, as doubles
ROW_BLOCK, ANCHOR_BLOCK = 8 << 20, 16 << 20
#: scores held at once inside a task
SCORES = 1 << 20

_PAIRS = "anchor long, score long, id long"
_PAIR_ARROW = pa.schema([("anchor", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])
_MINED = ("anchor_id long, positive_id long, rank int, negative_id long, "
          "positive_score long, negative_score long")


def quantized(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """(id, label, v): the rows that take part, components as floor(scale * x)."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    used = (rows.where(v.isNotNull() & whole)
            .select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                    F.transform(v, lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("v"))
            .where("id is not null and label is not null"))
    return used.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def mine(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
         is_anchor: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         scale: int = 256, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Higher scores come first, equal ones by smaller id.  An anchor's positives
    are its first ``positives`` other rows of the same label; a positive's
    negatives are the first ``negatives`` rows of another label whose score is
    ``low`` to ``high`` percent of the positive's.  ``label`` and ``is_anchor``
    are columns of ``rows`` (default: ``label``, and every row).
    """
    label = F.col("label") if label is None else label
    # whether an id is an anchor must not hang on which of its rows stays
    anchor_ids = rows.where(F.lit(True) if is_anchor is None else is_anchor).select(
        F.col(id_col).cast("long").alias("id")).distinct()
    table = write_table(quantized(rows, id_col, vector_col, label, scale), "negatives-rows")
    anchors = write_table(table.join(anchor_ids, "id", "left_semi"), "negatives-anchors")
    n, dims = table.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_anchors = anchors.count()
    width = 8 * max(1, dims)
    row_blocks = -(-n * width // row_block) or 1
    anchor_blocks = -(-n_anchors * width // anchor_block) or 1

    # rows go to every block of anchors, anchors to every block of rows
    def dealt(df: DataFrame, mine: int, others: int, key) -> DataFrame:
        own = F.pmod(F.xxhash64("id"), F.lit(mine))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long")))
        return df.select(own.alias("own"), other.alias("other"), *df.columns).select(
            key(F.col("own"), F.col("other")).alias("cell"), *df.columns)

    cells = dealt(table, row_blocks, anchor_blocks, lambda r, a: r * anchor_blocks + a)

    def score(asked: DataFrame, work) -> DataFrame:
        asked = dealt(asked, anchor_blocks, row_blocks, lambda a, r: r * anchor_blocks + a)
        return cells.groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(work, _PAIRS)

    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    best = write_table(
        score(anchors, lambda x, q: _first_positives(x, q, positives))
        .withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives).drop("place"),
        "negatives-positives")
    # a window below zero holds no score
    windows = best.where("score >= 0").groupBy("anchor").agg(F.collect_set("score").alias("p"))
    asked = anchors.join(windows, F.col("id") == F.col("anchor")).drop("anchor")
    near = score(asked, lambda x, q: _first_negatives(x, q, negatives, low, high))

    pairs = (best.where("score >= 0").select("anchor", "score", F.lit(0).alias("kind"), "id")
             .unionByName(near.select("anchor", "score", F.lit(1).alias("kind"), "id")))
    # the key: anchor, descending score, positives before equal negatives, id
    keyed = (pairs.select("anchor", (-F.col("score")).alias("below"), "kind", "id")
             .repartition("anchor").sortWithinPartitions("anchor", "below", "kind", "id"))
    return map_rows(keyed, _MINED, lambda: Windows(negatives, low, high))


class Windows:
    """One pass over sorted keys; holds the open windows of the anchor at hand."""

    def __init__(self, negatives: int, low: int, high: int):
        self.negatives, self.low, self.high = negatives, low, high
        self.anchor: int | None = None
        self.open: list[list[int]] = []          # [positive id, its score, negatives found]

    def __call__(self, anchor, below, kind, ident) -> dict[str, list]:
        return self.columns(zip(anchor.to_pylist(), below.to_pylist(), kind.to_pylist(), ident.to_pylist()))

    def columns(self, keys: Iterator[tuple[int, int, int, int]]) -> dict[str, list]:
        out = list(self.emit(keys))
        names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        return dict(zip(names, map(list, zip(*out)))) if out else {n: [] for n in names}

    def emit(self, keys: Iterator[tuple[int, int, int, int]]) -> Iterator[tuple]:
        for anchor, below, kind, ident in keys:
            if anchor != self.anchor:
                self.anchor, self.open = anchor, []
            score = -below
            if kind == 0:
                self.open.append([ident, score, 0])
                continue
            for window in self.open:
                positive, p, found = window
                if found < self.negatives and self.low * p <= 100 * score <= self.high * p:
                    window[2] = found + 1
                    yield anchor, positive, found + 1, ident, p, score


def _block(table: pa.Table, dims: int) -> np.ndarray:
    """The vectors of a block, extended with zeros to ``dims`` components."""
    v = table["v"].combine_chunks()
    flat = v.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(v.offsets.to_numpy())
    out = np.zeros((len(v), dims), dtype=np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def _slabs(rows: pa.Table, asked: pa.Table) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Scores of a few anchors at a time against the block's rows, with the
    anchors' and the rows' labels compared."""
    dims = int(max([1, *(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max() for t in (rows, asked))]))
    x, q = _block(rows, dims), _block(asked, dims)
    top = float(np.abs(x, dtype=float).max(initial=0)) * float(np.abs(q, dtype=float).max(initial=0)) * dims
    if top < 2 ** 53:                     # doubles hold every sum
        x, q = x.astype(float), q.astype(float)
    labels = rows["label"].to_numpy()
    own = asked["label"].to_numpy()
    step = max(1, SCORES // max(1, len(x)))
    for k in range(0, len(q), step):
        part = slice(k, k + step)
        yield part, (q[part] @ x.T).astype(np.int64), own[part][:, None] == labels[None, :]


def _sorted(rows: pa.Table) -> pa.Table:
    return rows.sort_by("id")             # equal scores then stand by id


def _pairs(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    if not found:
        return _PAIR_ARROW.empty_table()
    return pa.table({"anchor": np.repeat(np.array([a for a, _, _ in found], dtype=np.int64),
                                         [len(s) for _, s, _ in found]),
                     "score": np.concatenate([s for _, s, _ in found]),
                     "id": np.concatenate([i for _, _, i in found])}, schema=_PAIR_ARROW)


def _first(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``at`` (ascending ids) the first ``k`` by descending score."""
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        above, equal = at[scores[at] > least], at[scores[at] == least]
        at = np.concatenate([above, equal[:k - len(above)]])
    return at[np.lexsort((at, -scores[at]))]


def _first_positives(rows: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    if not rows.num_rows or not asked.num_rows:
        return _PAIR_ARROW.empty_table()
    rows = _sorted(rows)
    ids, anchors = rows["id"].to_numpy(), asked["id"].to_numpy()
    found = []
    for part, scores, same in _slabs(rows, asked):
        for anchor, s, eq in zip(anchors[part], scores, same):
            at = _first(s, np.flatnonzero(eq & (ids != anchor)), k)
            if len(at):
                found.append((anchor, s[at], ids[at]))
    return _pairs(found)


def _first_negatives(rows: pa.Table, asked: pa.Table, k: int, low: int, high: int) -> pa.Table:
    if not rows.num_rows or not asked.num_rows:
        return _PAIR_ARROW.empty_table()
    rows = _sorted(rows)
    ids, anchors, windows = rows["id"].to_numpy(), asked["id"].to_numpy(), asked["p"].to_pylist()
    found = []
    for part, scores, same in _slabs(rows, asked):
        for anchor, s, eq, ps in zip(anchors[part], scores, same, windows[part]):
            # whole scores between the bounds, rounded into the window
            bounds = [(-(-low * p // 100), high * p // 100) for p in ps]
            at = np.flatnonzero(~eq & (s >= min(b[0] for b in bounds)) & (s <= max(b[1] for b in bounds)))
            if not len(at):
                continue
            at = at[np.argsort(-s[at], kind="stable")]
            below = -s[at]
            keep = set()
            for lo, hi in bounds:
                start = np.searchsorted(below, -hi, "left")
                keep.update(range(start, min(start + k, np.searchsorted(below, -lo, "right"))))
            if keep:
                at = at[sorted(keep)]
                found.append((anchor, s[at], ids[at]))
    return _pairs(found)
