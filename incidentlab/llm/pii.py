"""Personal data: patterns propose spans, checksums confirm them, nearby words
adjust their scores.  DataFrame operations only.

A text is cut at a kind's matches (``split``) and the matches are taken beside
it (``regexp_extract_all``); a span's position is the running sum of the lengths
of the pieces and matches before it, over a window per document and kind.  Only
lengths, scores and short contexts are shuffled, never texts.

The patterns are written so that any text takes linear time: a run of characters
is tried from its first one alone (or from the end of the match before, ``\\G``),
and loops that need not give back are possessive.  They match what the plain
patterns in ``BASE`` match.

Edge cases: null text counts as empty; every row gives one row, repeated ids too
(they are judged row by row); a null id stays null; an empty table gives no rows;
other columns are ignored, whatever their names.  A kind's context ends at the
neighbouring matches of the same kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import clean_text

#: characters of context looked at before and after a span
BEFORE, AFTER = 48, 24
#: hundredths that a telling or a misleading context word adds or takes
TELLING, MISLEADING = 35, 30
#: spans of the added kinds need this score, in hundredths
LEAST = 50


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str        # Java syntax
    score: int          # before context, in hundredths
    telling: str        # context words that speak for the kind
    misleading: str     # and against it


_DIGIT_RUN = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
_LOCAL = "[A-Za-z0-9._%+-]"

#: the fixed kinds, in the order that breaks ties between equal starts
BASE = [
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 90,
         "mail|contact|write|kontakt|correo|courriel", "example|noreply"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 60,
         "ip|host|server|address|adresse|login", "version|release|section|chapter"),
    Kind("card", _DIGIT_RUN, 70,
         "card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte", "isbn|order|invoice|serial|tracking"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 70,
         "phone|tel|call|mobile|cell|fax|telefon|whatsapp", "version|build|score"),
]
#: kinds the operator adds; they need ``LEAST`` after the context
ADDED = [
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)", 80,
         "iban|account|bank|konto|cuenta|compte", "token|hash|serial"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 30,
         "ssn|social security|tax id|taxpayer", "order|invoice|part|serial"),
    Kind("local_phone", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", 30,
         "phone|tel|call|mobile|cell|fax|telefon|whatsapp", "order|invoice|serial|isbn"),
]
KINDS = BASE + ADDED


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of decimal digits passes the Luhn check."""
    def add(total: Column, place: Column) -> Column:
        digit = F.substring(digits, -place, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(place % 2 == 0, twice).otherwise(digit)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number of capitals and digits leaves 1 modulo 97, its
    first four characters moved to the end and letters read as 10 to 35."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(rest: Column, place: Column) -> Column:
        char = F.substring(moved, place, F.lit(1))
        return F.when(char.between("0", "9"), (rest * 10 + char.cast("int")) % 97) \
            .otherwise((rest * 100 + F.ascii(char) - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def _confirmed(kind: Column, hit: Column, before: Column, after: Column) -> Column:
    """Whether a proposed span holds, by its kind's rule."""
    digits = digits_of(hit)
    clear = ~before.rlike(r"[A-Za-z0-9]\z") & ~after.rlike("^[A-Za-z0-9]")
    rules = {
        "email": F.lit(True),
        # four numbers, each at most 255 whatever zeros lead it
        "ip": hit.rlike(r"^(0*+(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]|)(\.|$)){4}$"),
        "card": F.length(digits).between(14, 19) & luhn(digits),
        "phone": F.length(digits).between(10, 15),
        "iban": clear & mod97(F.regexp_replace(hit, " ", "")),
        "ssn": clear & ~before.rlike(r"-\z") & ~after.rlike("^-")
        & ~hit.rlike("^(000|666|9)") & ~hit.rlike("-00-|-0000$"),
        "local_phone": clear & ~before.rlike(r"[+0-9][\x20().-]*\z") & ~after.rlike("^[.-]?[0-9]"),
    }
    out = None
    for no, k in enumerate(KINDS, 1):
        out = F.when(kind == no, rules[k.name]) if out is None else out.when(kind == no, rules[k.name])
    return out


def _score(kind: Column, before: Column, after: Column) -> Column:
    """The kind's own score, moved by the words around the span, 0 to 100."""
    around = F.concat_ws(" ", before, after)
    out = None
    for no, k in enumerate(KINDS, 1):
        score = (F.lit(k.score)
                 + F.when(around.rlike(_words(k.telling)), TELLING).otherwise(0)
                 - F.when(around.rlike(_words(k.misleading)), MISLEADING).otherwise(0))
        out = F.when(kind == no, score) if out is None else out.when(kind == no, score)
    return F.greatest(F.lit(0), F.least(F.lit(100), out))


def _words(choice: str) -> str:
    return rf"(?i)(^|[^a-z])({choice})"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, id, kind, start, end, score, hit): every confirmed span, and one row
    with kind 0 and no span per document.

    ``uid`` numbers the documents' rows, ``kind`` is the place in ``KINDS`` from 1,
    positions are code points with an exclusive end, ``score`` is in hundredths.
    The rows are laid by ``uid``.
    """
    t = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"),
                    clean_text(text_col).alias("t"))
    none = F.struct(F.lit(0).alias("kind"), F.array(F.lit("")).alias("pieces"), F.array(F.lit("")).alias("hits"))
    cut = [F.struct(F.lit(no).alias("kind"), F.split("t", k.pattern).alias("pieces"),
                    F.regexp_extract_all("t", F.lit(k.pattern), F.lit(0)).alias("hits"))
           for no, k in enumerate(KINDS, 1)]
    kinds = t.select("uid", "id", F.inline(F.array(none, *cut))).where("size(hits) > 0")
    each = kinds.select(
        "uid", "id", "kind",
        F.posexplode(F.arrays_zip(F.col("pieces").alias("piece"), F.col("hits").alias("hit"),
                                  F.expr("slice(pieces, 2, size(pieces))").alias("after"))).alias("no", "m"),
    ).where("m.hit is not null")
    before = F.expr(f"right(m.piece, {BEFORE})")
    after = F.expr(f"left(m.after, {AFTER})")
    hit = F.col("m.hit")
    holds = F.when(F.col("kind") > 0, _confirmed(F.col("kind"), hit, before, after)).otherwise(False)
    score = F.when(F.col("holds"), _score(F.col("kind"), before, after))
    rows = (each.withColumn("holds", holds).withColumn("score", score)
            .select("uid", "id", "kind", "no", F.length("m.piece").alias("gap"), F.length("m.hit").alias("len"),
                    (F.col("holds") & ((F.col("kind") <= len(BASE)) | (F.col("score") >= LEAST))).alias("holds"),
                    "score", F.when(F.col("holds"), hit).alias("hit")))
    so_far = Window.partitionBy("uid", "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    placed = (rows.repartition("uid")
              .withColumn("end", F.sum((F.col("gap") + F.col("len")).cast("long")).over(so_far)))
    return (placed.where("holds or kind = 0")
            .select("uid", "id", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "score", "hit"))


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, counts of the fixed kinds, ``base_sha256``
    over the fixed spans, all ``spans`` as ``kind:start:end`` by start, then kind,
    and ``scores`` in hundredths in the same order."""
    found = find_spans(docs, id_col, text_col)
    name = F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("kind"))
    span = F.when(F.col("kind") > 0, F.struct("start", "kind", F.concat_ws(
        ":", name, F.col("start").cast("string"), F.col("end").cast("string")).alias("said"), "score"))
    per_doc = found.groupBy("uid").agg(
        F.max("id").alias("id"),
        *[F.count(F.when(F.col("kind") == no, 1)).alias(f"n_{k.name}") for no, k in enumerate(BASE, 1)],
        F.sort_array(F.collect_list(span)).alias("spans"))
    base = F.array_join(F.expr(f"transform(filter(spans, s -> s.kind <= {len(BASE)}), s -> s.said)"), ",")
    return per_doc.select(
        F.col("id").alias(id_col), *[f"n_{k.name}" for k in BASE], F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.col("spans.said"), ",").alias("spans"),
        F.array_join(F.expr("transform(spans, s -> cast(s.score as string))"), ",").alias("scores"))
