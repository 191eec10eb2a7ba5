"""Word features and bounded labelled samples for the linear text models."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_text, map_rows
from .linear import Rows

#: remembered words per task; beyond, the memory starts anew
MEMO_ENTRIES = 400_000
#: features must occur in so many sampled texts
MIN_TEXTS = 3

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """Different words of a text, lower-cased, letters only."""
    return set(_WORD.findall(text.lower()))


def word_features(word: str) -> tuple[str, ...]:
    """The word and its beginnings of four and five letters."""
    return (word, f"{word[:4]}>", f"{word[:5]}>") if len(word) > 5 else (word, f"{word[:4]}>")


def sample(labels: DataFrame, docs: DataFrame, per_class: int, id_col: str, text_col: str,
           label: Column, extra: dict[str, Column]) -> list:
    """Rows (y, words, one per ``extra``) of at most ``per_class`` labelled
    documents of either class, those first in hash order of their ids.

    ``label`` is a 0/1 column of ``labels``; ``extra`` are columns of ``docs``.
    The chosen ids (at most twice ``per_class``) are broadcast, so the documents
    are scanned without a shuffle.
    """
    named = labels.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("chosen_id"), label.cast("int").alias("y"))
    ids = None
    for value in (0, 1):
        part = named.where(F.col("y") == value).orderBy(F.xxhash64("chosen_id"), "chosen_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    t = docs.select(F.col(id_col).cast("long").alias("chosen_id"), clean_text(text_col).alias("t"),
                    *[c.alias(n) for n, c in extra.items()])
    names = list(extra)
    rows = t.join(F.broadcast(ids), "chosen_id").select("y", *names, "t", "chosen_id")

    def make():
        def work(y, *columns):
            *rest, texts, ids = columns
            return {"y": y, **dict(zip(names, rest)), "chosen_id": ids,
                    "words": [sorted(words_of(t)) for t in map(pa.StringScalar.as_py, texts)]}
        return work

    types = dict(rows.dtypes)
    schema = "y int, " + "".join(f"{n} {types[n]}, " for n in names) + "chosen_id long, words array<string>"
    found = map_rows(rows, schema, make).collect()
    return sorted(found, key=lambda r: (r.chosen_id, r.y, r.words))


def vocabulary(texts: Iterable[Iterable[str]], min_texts: int = MIN_TEXTS) -> dict[str, int]:
    """Feature to column; column 0 is left for the intercept."""
    seen = Counter(f for words in texts for f in {f for w in words for f in word_features(w)})
    return {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= min_texts), 1)}


def telling(x: Rows, y: np.ndarray) -> np.ndarray:
    """The columns in ``MIN_TEXTS`` rows whose presence goes with the 0/1 label more
    than chance would have it among so many (chi-square with one degree of freedom
    above twice the logarithm of their number)."""
    total = x.t_dot(np.ones((len(x), 1)))[1:, 0]
    a = x.t_dot(y[:, None])[1:, 0]
    n, ones, seen = float(len(x)), y.sum(), total >= MIN_TEXTS
    b, c = total - a, ones - a
    d = n - total - c
    under = total * (n - total) * ones * (n - ones)
    chi2 = np.where(under > 0, n * (a * d - b * c) ** 2 / np.maximum(under, 1e-12), 0)
    return 1 + np.flatnonzero(seen & (chi2 >= 2 * math.log(max(2, seen.sum()))))


def columns_of(words: Iterable[str], vocab: dict[str, int]) -> list[int]:
    return sorted({vocab[f] for w in words for f in word_features(w) if f in vocab})


def reader(vocab: dict[str, int]) -> Callable[[str], list[int]]:
    """A function from text to its feature columns that remembers words."""
    memo: dict[str, tuple[int, ...]] = {}
    none: tuple[int, ...] = ()

    def known(word: str) -> tuple[int, ...]:
        found = tuple(vocab[f] for f in word_features(word) if f in vocab) or none
        if len(memo) >= MEMO_ENTRIES:
            memo.clear()
        memo[word] = found
        return found

    def read(text: str) -> list[int]:
        out: set[int] = set()
        for word in words_of(text):
            found = memo.get(word)
            if found is None:
                found = known(word)
            if found:
                out.update(found)
        return list(out)
    return read
