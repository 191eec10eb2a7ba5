"""Spelling variants by finite-state composition.

Words one edit apart are the pairs that the vocabulary acceptor, composed with a
one-edit transducer and the acceptor again, accepts.  The composition is cut by
initial state.  Two words one edit apart, the shorter of ``m`` code points, share
their first or their last ceil(m / 2); so each word enters, per value of ``m`` it
can take part in, the partition of the forward acceptor's state after its first
half and of the backward acceptor's after its last half, and every accepted pair
has one partition that emits it (the backward one only if the first half differs).
A partition's words form a minimised acceptor of what lies between the shared
ends, and the composed machine is enumerated from its initial state on.

A partition of more than ``limit`` code points and ``few`` words is cut again the same way: half of
what is still open joins the head or the tail.  At the end only one code point is
open, so a partition holds at most as many words as the alphabet has letters; no
pair is lost and none is capped.  Words are counted by a partially aggregated
grouping, and no task, broadcast or driver holds the vocabulary.

Edge cases: null texts and words count as none; a null id is the empty text; words
that occur in no pair stay, with no form; ties go to the smallest word in
code-point order; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .common import clean_text, map_rows

#: code points of one partition's words; beyond, it is cut again
LIMIT = 400_000
#: words that a partition may hold however long they are
FEW = 128
_KEY = ["m", "a", "b", "cap", "head", "tail"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run): every maximal run of Latin letters (to U+00FF), A-Z lower-cased."""
    t = F.translate(clean_text(text_col), _UPPER, _LOWER)
    found = F.regexp_extract_all(t, F.lit("[a-zÀ-ÿ]+"), F.lit(0))
    return docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))


def vocabulary(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of the words in column ``word`` that are long and frequent enough."""
    return (words.select("word").where(F.length("word") >= least_length)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count))


def near_words(vocab: DataFrame, limit: int = LIMIT, few: int = FEW) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair of words of
    ``vocab`` (word, n; words distinct) that differ by one inserted, deleted or
    replaced code point."""
    whole = F.lit(2 ** 31 - 1)
    length = F.length("word")
    roots = (vocab.where("word is not null and word <> ''")
             .select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where("m > 0")
             .withColumn("a", F.lit(0)).withColumn("b", F.lit(0)).withColumn("cap", whole))
    # words of one code point differ from one another, whatever they are
    single = vocab.where(length == 1).select("word", "n", F.lit(0).alias("m"), F.lit(0).alias("a"),
                                             F.lit(0).alias("b"), whole.alias("cap"))
    rows = _halved(roots).unionByName(_keyed(single))
    ready = None
    while True:
        rows = write_table(rows, "spelling-partitions")
        large = write_table(
            rows.groupBy(*_KEY).agg(F.sum(F.length("word")).alias("size"), F.count(F.lit(1)).alias("words"))
            .where((F.col("size") > limit) & (F.col("words") > few) & (F.col("m") > F.col("a") + F.col("b")))
            .select(*_KEY), "spelling-large")
        none = large.isEmpty()
        fits = rows if none else rows.join(large, _KEY, "left_anti")
        ready = fits if ready is None else ready.unionByName(fits.select(*ready.columns))
        if none:
            break
        cut = write_table(_halved(rows.join(large, _KEY, "left_semi")), "spelling-cut")
        # a word alone in its new partition is in no pair there
        shared = cut.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("words")).where("words > 1").select(*_KEY)
        rows = cut.join(shared, _KEY, "left_semi")
    laid = ready.select(*_KEY, "word", "n").repartition(*_KEY).sortWithinPartitions(*_KEY)
    # partition by partition: a task holds the words of one
    return laid.select("m", "a", "b", "cap", "word", "n").mapInArrow(
        _enumerate, "word string, n long, near string, near_n long")


def _keyed(rows: DataFrame) -> DataFrame:
    return (rows.withColumn("head", F.expr("left(word, a)")).withColumn("tail", F.expr("right(word, b)")))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: half of the open part joins the head, or else the tail."""
    half = F.ceil((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    by_head = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"), F.col("cap").alias("cap"))
    by_tail = F.struct(F.col("a").alias("a"), (F.col("b") + half).alias("b"),
                       F.least("cap", F.col("a") + half).alias("cap"))
    return _keyed(rows.select("word", "n", "m", F.explode(F.array(by_head, by_tail)).alias("k"))
                  .select("word", "n", "m", "k.a", "k.b", "k.cap"))


def variants(vocab: DataFrame, limit: int = LIMIT, factor: int = 2, few: int = FEW) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``vocab`` (word, n).

    A word's form is its near word of the largest n, if that is at least
    ``factor`` times the word's; its root is the end of the chain of forms.
    """
    vocab = write_table(vocab, "spelling-words")
    near = near_words(vocab, limit, few).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("below"), "near")).alias("best"))
    best_n = -F.col("best.below")
    chosen = best_n >= F.col("n") * factor
    formed = write_table(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, best_n).alias("form_n")), "spelling-forms")
    roots = _roots(formed.where("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("long").alias("n"),
        F.col("n_near").cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by doubling: each round doubles the steps taken (n grows at
    every step, so chains are short and have no cycles)."""
    at = write_table(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = write_table(at.join(on, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "spelling-roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


class Acceptor:
    """Minimal deterministic acceptor of sorted distinct words.

    States are numbered children first; a state's arcs map a code point to
    (words of the state that come before the arc's, target), so a path's offsets
    add up to the accepted word's place in the sorted list.
    """

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        open_states: list[list] = [[False, []]]       # along the last word: [final, [(char, target)]]
        last = ""

        def close(depth: int) -> None:
            while len(open_states) > depth + 1:
                final, arcs = open_states.pop()
                open_states[-1][1].append((last[len(open_states) - 1], self._state(known, final, arcs)))

        for word in words:
            shared = 0
            for x, y in zip(word, last):
                if x != y:
                    break
                shared += 1
            close(shared)
            open_states.extend([False, []] for _ in range(len(word) - shared))
            open_states[-1][0] = True
            last = word
        close(0)
        self.start = self._state(known, *open_states[0])

    def _state(self, known: dict[tuple, int], final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        state = known.get(key)
        if state is None:
            state = known[key] = len(self.final)
            before, placed = int(final), {}
            for char, target in arcs:
                placed[char] = (before, target)
                before += self.size[target]
            self.final.append(final)
            self.arcs.append(placed)
            self.size.append(before)
        return state

    def both(self, p: int, q: int, but: str = "") -> list[tuple[int, int]]:
        """Places, in p's and in q's list, of the words that both accept (the
        composed machine once its edit is spent); ``but``: no word beginning so."""
        out, todo = [], [(p, q, 0, 0)]
        while todo:
            p, q, i, j = todo.pop()
            if self.final[p] and self.final[q]:
                out.append((i, j))
            left, right = self.arcs[p], self.arcs[q]
            if len(right) < len(left):
                shared = [c for c in right if c in left and c != but]
            else:
                shared = [c for c in left if c in right and c != but]
            but = ""
            for c in shared:
                (di, p2), (dj, q2) = left[c], right[c]
                todo.append((p2, q2, i + di, j + dj))
        return out

    def edits_at(self, q: int) -> list[tuple[int, int]]:
        """Pairs of q's words that the composed machine accepts by an edit of the
        next code point.  A doubled letter is deleted at the end of its run."""
        out = []
        arcs = list(self.arcs[q].items())
        for k, (c, (i, p)) in enumerate(arcs):
            out += [(i + x, y) for x, y in self.both(p, q, but=c)]
            for _, (j, r) in arcs[k + 1:]:
                out += [(i + x, j + y) for x, y in self.both(p, r)]
        return out

    def one_edit_pairs(self, deepest: int) -> Iterator[tuple[int, int]]:
        """Places of all pairs of words one edit apart whose common beginning is
        shorter than ``deepest``."""
        edits: dict[int, list[tuple[int, int]]] = {}
        todo = [(self.start, 0, 0)]
        while todo:
            q, at, depth = todo.pop()
            if depth >= deepest or self.size[q] < 2:
                continue
            found = edits.get(q)
            if found is None:
                found = edits[q] = self.edits_at(q)
            for x, y in found:
                yield at + x, at + y
            for i, p in self.arcs[q].values():
                todo.append((p, at + i, depth + 1))


def pairs_of(words: list[str], m: int, a: int, b: int, cap: int) -> Iterator[tuple[int, int]]:
    """Places of the one-edit pairs of a partition, the longer word of each being
    of ``m`` + 1 code points; the distinct ``words`` (m or m + 1 long) share their
    first ``a`` and last ``b``."""
    middles = sorted((w[a:len(w) - b], k) for k, w in enumerate(words))
    for x, y in Acceptor([w for w, _ in middles]).one_edit_pairs(cap - a):
        x, y = middles[x][1], middles[y][1]
        # a run of one letter may go on into the tail: then more is shared than the middles show
        if (len(words[x]) > m or len(words[y]) > m) and words[x][:cap] != words[y][:cap]:
            yield x, y


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["word", "n", "near", "near_n"]
    out: list[list] = [[], [], [], []]

    def flush() -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.string(), pa.int64())
        batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)
        for v in out:
            v.clear()
        return batch

    def partition(key: tuple, held: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
        m, a, b, cap = key[:4]
        if len(held) < 2:
            return
        words = [w for w, _ in held]
        for x, y in pairs_of(words, m, a, b, cap):
            for v, pair in zip(out, zip(held[x] + held[y], held[y] + held[x])):
                v.extend(pair)
            if len(out[0]) >= 20_000:
                yield flush()

    key, held = None, []
    for batch in batches:
        for m, a, b, cap, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            now = (m, a, b, cap, word[:a], word[len(word) - b:])
            if now != key:
                if key is not None:
                    yield from partition(key, held)
                key, held = now, []
            held.append((word, n))
    if key is not None:
        yield from partition(key, held)
    if out[0]:
        yield flush()
