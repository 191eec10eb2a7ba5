"""Quality rules: fixed counts and n-gram perplexity bands.

A modified Kneser-Ney character model per language, counted over the whole
corpus (see ``charlm``), gives every document its nats per character.
Documents outside their language's band are rejected: below it text that
repeats itself, above it text that is not the language.

The model's windows are counted once per different text of a language, and a
text counts once for its band, so copies move neither.  Bands are fitted on
documents that pass the fixed rules.  With ``labels`` their
ends are quantiles of the language's clean labelled documents, so that
``FALSE_REJECT`` of these fall outside, dealt over the two ends such that most
low-quality labelled documents do.  An end that gets no share, or less than one
clean document, lies a multiple of the language's robust spread (quartile
distance / 1.349) from its median.

Edge cases: null text counts as empty (no words, so the fixed rules fail); a
null language is a language of its own; a language without spread or without a
passing document rejects nothing; repeated rows repeat their answer; an empty
table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .charlm import Model, build, count_windows
from .common import clean_text, map_rows

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: ends that labels do not fit: distance from the median, in robust spreads of the language
LOWER, UPPER = 8.0, 12.0
#: share of the clean labelled documents that may fall outside their language's band
FALSE_REJECT = 0.01
#: parts of that share for the upper end, the first of equally good ones is taken
_UPPER_PARTS = (0.5, 0.75, 0.25, 1.0, 0.0)
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


def text_counts(text: str) -> dict[str, int]:
    """The fixed counts of one text."""
    words = text.encode("utf-8", "surrogatepass").split()      # ASCII white space only
    out = {"n_words": len(words), "word_chars": len(text) - sum(map(text.count, _SPACES)),
           "n_symbols": sum(map(text.count, _SYMBOLS)), "n_dup_lines": 0, "n_repeat_words": 0}
    lines = text.split("\n")
    if len(set(lines)) < len(lines):
        seen = Counter(lines)
        out["n_dup_lines"] = sum(n - 1 for line, n in seen.items() if n > 1 and line.strip(_SPACES))
    triples = list(zip(words, words[1:], words[2:]))
    if len(set(triples)) < len(triples):
        times = Counter(triples)
        end = 0                                                # words before here are counted
        for k, triple in enumerate(triples):
            if times[triple] > 1:
                out["n_repeat_words"] += k + 3 - max(k, end)
                end = k + 3
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          lower: float = LOWER, upper: float = UPPER, labels: DataFrame | None = None,
          quality_col: str = "quality", false_reject: float = FALSE_REJECT) -> DataFrame:
    """One row per document: id, the counts, ``base_failed``, ``kept``,
    ``entropy`` (nats per character; null for an empty text), ``perplexity``
    and the language's ``band_low`` and ``band_high`` of the entropy.  ``labels``
    (id, quality 1 or 0) fit the bands."""
    t = docs.select(F.col(id_col).cast("long").alias("id"),
                    F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                    clean_text(text_col).alias("text"))
    # whole texts are compared; copies meet in the map side first
    texts = t.groupBy(F.col("lang").alias("label"), "text").agg(F.count(F.lit(1)).alias("rows"))
    counts = write_table(count_windows(texts), "quality-counts")
    names_of = sorted(r.label for r in counts.select("label").distinct().collect())
    model = build(counts, names_of, modified=True)
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.orders))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def make():
        m = Model(*shared.value)
        place = {label: i for i, label in enumerate(m.labels)}

        def work(ids, langs, digests, texts):
            out = {"id": ids, "lang": langs, "digest": digests, "entropy": []} | {n: [] for n in names}
            for lang, text in zip(langs.to_pylist(), map(pa.StringScalar.as_py, texts)):
                for name, value in text_counts(text).items():
                    out[name].append(value)
                if not text:
                    out["entropy"].append(None)
                    continue
                total, n = m.score(text)
                out["entropy"].append(float(-total[place[lang]] / n))
            return out
        return work

    scored = write_table(map_rows(
        t.select("id", "lang", F.sha2("text", 256).alias("digest"), "text"),
        "id long, lang string, digest string, entropy double, " + ", ".join(f"{n} long" for n in names), make), "quality-scores")
    failed = (F.col("n_words") < MIN_WORDS) | \
        (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    passing = scored.where("NOT base_failed").select("id", "lang", "digest", "entropy")
    if labels is None:
        passing = passing.withColumn("good", F.lit(None).cast("int"))
    else:
        marks = (labels.where(F.col(quality_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id"))
                 .agg(F.max(F.col(quality_col).cast("int")).alias("good")))
        passing = passing.join(marks, "id", "left")
    passing = passing.groupBy("lang", "digest").agg(F.first("entropy").alias("entropy"), F.max("good").alias("good"))
    bands = _bands(passing, lower, upper, false_reject)
    inside = F.coalesce(F.col("entropy").between(F.col("band_low"), F.col("band_high")), F.lit(True))
    return scored.join(F.broadcast(bands), "lang", "left").select(
        F.col("id").alias(id_col), *names, "base_failed", (~F.col("base_failed") & inside).alias("kept"),
        "entropy", F.exp("entropy").alias("perplexity"), "band_low", "band_high")


def _bands(passing: DataFrame, lower: float, upper: float, false_reject: float) -> DataFrame:
    """(lang, band_low, band_high) from texts (lang, entropy, good) that pass the
    fixed rules; a row per language of the model, so as many as it has columns."""
    def quantiles(value, shares):
        return F.percentile_approx(value, F.array(*[F.lit(q) for q in shares]), 10_000)
    clean = F.when(F.col("good") == 1, F.col("entropy"))
    ups = [false_reject * part for part in _UPPER_PARTS]
    downs = [false_reject - up for up in ups]
    found = passing.groupBy("lang").agg(
        quantiles(F.col("entropy"), (0.25, 0.5, 0.75)).alias("q"), F.count(clean).alias("n"),
        quantiles(clean, downs).alias("down"), quantiles(clean, [1 - up for up in ups]).alias("up"))
    spread = (F.col("q")[2] - F.col("q")[0]) / 1.349
    ends = [F.struct(
        F.when(F.col("n") * down >= 1, F.col("down")[k])
        .when(spread > 0, F.col("q")[1] - lower * spread).alias("low"),
        F.when(F.col("n") * up >= 1, F.col("up")[k])
        .when(spread > 0, F.col("q")[1] + upper * spread).alias("high"))
        for k, (down, up) in enumerate(zip(downs, ups))]
    found = found.select("lang", F.array(*ends).alias("ends"))
    outside = [F.sum((~F.coalesce(F.col("entropy").between(F.col("ends")[k]["low"], F.col("ends")[k]["high"]),
                                  F.lit(True))).cast("long")) for k in range(len(ends))]
    caught = (passing.where("good = 0").join(F.broadcast(found), "lang")
              .groupBy("lang").agg(F.array(*outside).alias("caught")))
    best = F.coalesce(F.array_position("caught", F.array_max("caught")), F.lit(1)).cast("int")
    end = F.element_at("ends", best)
    return found.join(caught, "lang", "left").select(
        "lang", end["low"].alias("band_low"), end["high"].alias("band_high"))
