"""Interpolated Kneser-Ney character models, counted by Spark, kept as sorted
hash arrays.

One model holds all its labels (languages).  Tasks count the 4-character
windows of their texts per label, Spark sums them; lower orders count the
different windows that end in them (Kneser-Ney), down to single characters.
Each window's fully interpolated log-probability under every label is worked
out by joins on the counted tables.  For scoring, each order becomes an array
of hash slots in ascending order beside a (slots x labels) matrix, and a second
such pair holds the interpolation weights of the contexts, used for windows the
corpus never showed.

Window keys pack four characters of 16 bits (higher code points are folded).
A slot is the whole 64-bit hash of its key.  XXH64 of a long is one-to-one (odd
factors, rotations and shifted xors only), so no two windows share a slot, and
a window the corpus never showed has none.  The arrays, which pass through the
driver, grow with the different windows: 8 bytes and 4 per label for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .common import clean_text

ORDER = 4
SLOT_BITS = 64
#: characters worked on at a time, whatever the text's length
BLOCK = 1 << 20
#: windows a task collects before it merges equal ones, and different ones it holds
_PENDING, _HELD = 1 << 21, 1 << 20
_PAD = 0xFFFF
_UNSEEN = -float(np.log(65536.0))       # every character, a priori

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (      # fixed values: XXH64
    11400714785074694791, 14029467366897019727, 1609587929392839161,
    9650029242287828579, 2870177450012600261))


def xxhash64_longs(keys: np.ndarray, seed: int = 42) -> np.ndarray:
    """What Spark's xxhash64() gives for longs, as unsigned integers."""
    def rotated(x, n):
        return (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = np.uint64(seed) + _P5 + np.uint64(8)
        h = h ^ (rotated(keys.astype(np.uint64) * _P2, 31) * _P1)
        h = rotated(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def _slots(keys: np.ndarray) -> np.ndarray:
    return xxhash64_longs(keys) >> np.uint64(64 - SLOT_BITS)


def windows(text: str) -> Iterator[np.ndarray]:
    """Keys of every character's window of a text, in blocks; pads before it."""
    before = np.full(ORDER - 1, _PAD, np.uint64)
    for lo in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[lo:lo + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        if codes.max(initial=0) > 0xFFFE:
            codes = np.where(codes > 0xFFFE, (codes * np.uint32(40503)) & np.uint32(0x7FFF), codes)
        c = np.concatenate((before, codes.astype(np.uint64)))
        before = c[-(ORDER - 1):]
        n = len(c) - ORDER + 1
        key = c[ORDER - 1:].copy()
        for back in range(1, ORDER):
            key |= c[ORDER - 1 - back:ORDER - 1 - back + n] << np.uint64(16 * back)
        yield key


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in ascending order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def count_windows(texts: DataFrame, clean: Callable[[str], str] | None = None) -> DataFrame:
    """(label, key, n) over all rows of ``texts`` (label, text); rows without a
    label are left out.  Equal windows are merged in the task before Spark sums."""

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def merged(label):
            parts = held[label]
            keys = np.concatenate([k for k, _ in parts])
            n = np.concatenate([n for _, n in parts])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            return keys[first], np.add.reduceat(n, first)

        def out():
            for label in list(held):
                keys, n = merged(label)
                del held[label]
                for lo in range(0, len(keys), 100_000):
                    part = keys[lo:lo + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label] * len(part), pa.string()), pa.array(part.view(np.int64)),
                         pa.array(n[lo:lo + 100_000].astype(np.int64))], names=["label", "key", "n"])

        for batch in batches:
            pending: dict[str, list] = {}
            waiting = 0

            def settle():
                nonlocal waiting, size
                for label, parts in pending.items():
                    keys, n = counted(np.concatenate(parts))
                    held.setdefault(label, []).append((keys, n))
                    size += len(keys)
                    if len(held[label]) > 8:
                        size -= sum(len(k) for k, _ in held[label])
                        held[label] = [merged(label)]
                        size += len(held[label][0][0])
                pending.clear()
                waiting = 0

            for label, text in zip(batch.column(0).to_pylist(), map(pa.StringScalar.as_py, batch.column(1))):
                for keys in windows(clean(text) if clean else text):
                    pending.setdefault(label, []).append(keys)
                    waiting += len(keys)
                    if waiting >= _PENDING:
                        settle()
            settle()
            if size > _HELD:
                yield from out()
                size = 0
        yield from out()

    part = texts.where("label IS NOT NULL").select("label", clean_text("text").alias("text"))
    return (part.mapInArrow(run, "label string, key long, n long")
            .groupBy("label", "key").agg(F.sum("n").alias("n")))


def _each(labels: list[str], make: Callable[[int], Column]) -> Column:
    return F.array(*[make(i) for i in range(len(labels))])


class Model:
    """Arrays per order, highest first: window slots and log-probabilities,
    context slots and log interpolation weights; a column per label."""

    def __init__(self, labels: list[str], orders: list[tuple]):
        self.labels, self.orders = labels, orders

    def score(self, text: str) -> tuple[np.ndarray, int]:
        """(log-probability of the whole text under each label, characters)."""
        total, n = np.zeros(len(self.labels)), 0
        for keys in windows(text):
            n += len(keys)
            total += self._sum(*counted(keys))
        return total, n

    def _sum(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.labels))
        # log weights of the orders that did not know a window; none at first
        weight = np.zeros((len(keys), len(self.labels)), np.float32)
        for order, (slots, logp, contexts, logw) in zip(range(ORDER, 0, -1), self.orders):
            at, hit = _find(slots, _slots(keys))
            known = logp[at[hit]] if order == ORDER else logp[at[hit]] + weight[hit]
            total += counts[hit] @ known.astype(np.float64)
            miss = ~hit
            if not miss.any():
                return total
            keys, counts, weight = keys[miss], counts[miss], weight[miss]
            at, hit = _find(contexts, _slots(keys >> np.uint64(16)))
            weight[hit] += logw[at[hit]]
            keys = keys & np.uint64((1 << 16 * (order - 1)) - 1)
        return total + counts @ (weight.astype(np.float64) + _UNSEEN)


def _find(slots: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search: places of the wanted slots, and whether they are there."""
    if not len(slots):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(slots, wanted), len(slots) - 1)
    return at, slots[at] == wanted


def build(counts: DataFrame, labels: list[str], modified: bool) -> Model:
    """Model of the counted windows (label, key, n).  ``modified``: three
    discounts per label and order (for counts of one, two, more), else one."""
    if not labels:
        return Model(labels, [])
    m = len(labels)
    table = write_table(counts.groupBy("key").agg(_each(labels, lambda i: F.coalesce(
        F.sum(F.when(F.col("label") == labels[i], F.col("n"))), F.lit(0))).alias("c")), "lm-windows")
    tables = {ORDER: table}
    for order in range(ORDER - 1, 0, -1):       # different left neighbours, per label
        mask = F.lit((1 << 16 * order) - 1)
        tables[order] = write_table(
            tables[order + 1].groupBy(F.col("key").bitwiseAND(mask).alias("key"))
            .agg(_each(labels, lambda i: F.sum((F.col("c")[i] > 0).cast("long"))).alias("c")), "lm-windows")

    lower = None
    found = []
    for order in range(1, ORDER + 1):
        t = tables[order]
        of = [[F.sum((F.col("c")[i] == k).cast("long")) for k in (1, 2, 3, 4)] for i in range(m)]
        row = t.agg(*[x.alias(f"n{i}_{k}") for i in range(m) for k, x in enumerate(of[i])]).first()
        discounts = [_discounts(*[row[f"n{i}_{k}"] or 0 for k in range(4)], modified) for i in range(m)]
        t = t.withColumn("ctx", F.shiftrightunsigned("key", 16))
        context = t.groupBy("ctx").agg(*[a.alias(n) for n, a in (
            ("tot", _each(labels, lambda i: F.sum(F.col("c")[i]))),
            ("n1", _each(labels, lambda i: F.sum((F.col("c")[i] == 1).cast("long")))),
            ("n2", _each(labels, lambda i: F.sum((F.col("c")[i] == 2).cast("long")))),
            ("n3", _each(labels, lambda i: F.sum((F.col("c")[i] > 2).cast("long")))))])
        context = context.select("ctx", "tot", _each(labels, lambda i: F.when(
            F.col("tot")[i] > 0, (discounts[i][0] * F.col("n1")[i] + discounts[i][1] * F.col("n2")[i]
                                  + discounts[i][2] * F.col("n3")[i]) / F.col("tot")[i])
            .otherwise(F.lit(1.0))).alias("w"))
        context = write_table(context, "lm-contexts")
        t = t.join(context, "ctx")
        if lower is None:
            t = t.withColumn("low", F.array(*[F.lit(1.0 / 65536)] * m))
        else:
            t = t.join(lower, t["key"].bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1)) == lower["low_key"])

        def p(i):
            c, d = F.col("c")[i], discounts[i]
            cut = F.when(c == 0, 0.0).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])
            own = F.when(F.col("tot")[i] > 0, (c - cut) / F.col("tot")[i]).otherwise(0.0)
            return own + F.col("w")[i] * F.col("low")[i]
        done = write_table(t.select("key", _each(labels, p).alias("p")), "lm-order")
        lower = done.select(F.col("key").alias("low_key"), F.col("p").alias("low"))
        found.append((*_arrays(done, "key", "p", m), *_arrays(context, "ctx", "w", m)))
    return Model(labels, found[::-1])


def _discounts(n1: int, n2: int, n3: int, n4: int, modified: bool) -> tuple[float, float, float]:
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    if not modified:
        return y, y, y
    d = [k - (k + 1) * y * b / a if a and b else min(y * k, k - 0.1)
         for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d))


def _arrays(table: DataFrame, key: str, value: str, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots ascending, logs as a matrix) of a table with an array per key."""
    slot = F.shiftrightunsigned(F.xxhash64(key), 64 - SLOT_BITS)
    logs = F.transform(value, lambda x: F.log(F.greatest(x, F.lit(1e-30))).cast("float"))
    rows = table.select(slot.alias("slot"), logs.alias("v")).toArrow()
    slots = rows["slot"].to_numpy().astype(np.int64).view(np.uint64)
    values = rows["v"].combine_chunks().flatten().to_numpy().reshape(-1, m)
    order = np.argsort(slots)
    return slots[order], np.ascontiguousarray(values[order])
