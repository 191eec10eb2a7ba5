"""URL filter: host and path rules, and a logistic regression on hashed
character n-grams for the urls that no rule fits.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end.  A rule (host and
path in one string, ``example.org/en/``) fits its host and all subdomains when
the url's path starts with the rule's; the longest rule wins, a block before an
allow of equal length.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no
rule, and is judged by the model like any other; very long urls are used whole;
repeated rows repeat their answer; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_table

GRAMS = (3, 4, 5)
FEATURES = 1 << 16
#: urls the model is fitted on at most (the labelled table is small by contract)
MAX_LABELLED = 20_000
THRESHOLD = 0.5

Rule = tuple[str, str]          # (verdict, host and path)


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (length, is_block, rule) of the rule that wins, or null."""
    fits = []
    for verdict, rule in rules:
        name, slash, tail = rule.partition("/")
        here = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        fits.append(F.when(here, F.struct(F.lit(len(rule)).alias("length"),
                                          F.lit(verdict == "block").alias("is_block"),
                                          F.lit(rule).alias("rule"))))
    none = F.lit(None).cast("struct<length:int,is_block:boolean,rule:string>")
    return F.array_max(F.array(none, *fits))


def _grams(text: Column, mark: str) -> Column:
    """All character n-grams of a marked text, ends included."""
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    parts = [F.when(F.length(padded) >= n, F.transform(
        F.sequence(F.lit(1), F.length(padded) - (n - 1)),
        lambda i, n=n: F.concat(F.lit(mark), F.substring(padded, i, F.lit(n)))))
        .otherwise(F.array().cast("array<string>")) for n in GRAMS]
    return F.concat(*parts)


def features(df: DataFrame, url: str, out: str) -> DataFrame:
    host, path = host_and_path(url)
    return df.withColumn(out, F.concat(_grams(host, "h"), _grams(path, "p")))


def _fit(rows: DataFrame) -> PipelineModel:
    # both classes weigh the same
    ones = rows.agg(F.avg("label")).first()[0] or 0.5
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, 0.5 / ones).otherwise(0.5 / max(1 - ones, 1e-9)))
    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)
    lr = LogisticRegression(regParam=0.0001, maxIter=60, standardization=False, weightCol="weight")
    return PipelineModel([hashed, lr.fit(hashed.transform(rows))])


def _labelled(labelled: DataFrame, url_col: str, label_col: str) -> DataFrame:
    """The rows to fit on: labelled, at most ``MAX_LABELLED`` by hash order, written once."""
    rows = (labelled.select(F.col(url_col).cast("string").alias("url"), F.col(label_col).cast("double").alias("label"))
            .where("label IS NOT NULL"))
    return write_table(features(rows, "url", "grams").orderBy(F.xxhash64("url"), "label").limit(MAX_LABELLED), "urls")


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked") -> PipelineModel:
    """Model of a small labelled table: ``blocked`` 1 or 0 per url.  Rows without
    a label are left out; at most ``MAX_LABELLED`` rows, by hash order, are used."""
    return _fit(_labelled(labelled, url_col, label_col))


def held_out(labelled: DataFrame, folds: int = 3, url_col: str = "url", label_col: str = "blocked") -> DataFrame:
    """(url, label, p_block) of every labelled row by a model that saw no url of its
    host (www, m and blog aside)."""
    rows = _labelled(labelled, url_col, label_col)
    host, _ = host_and_path("url")
    site = F.regexp_replace(host, r"^(www|m|blog)\.", "")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(site), F.lit(folds)))
    p = vector_to_array("probability")[1]
    out = None
    for k in range(folds):
        part = _fit(rows.where(F.col("fold") != k)).transform(rows.where(F.col("fold") == k)).select(
            "url", "label", p.alias("p_block"))
        out = part if out is None else out.unionByName(part)
    return out


def held_out_threshold(labelled: DataFrame, wrongly_blocked: float = 0.02, folds: int = 3) -> float:
    """The least threshold at which at most this share of ordinary held-out sites
    would be blocked."""
    if labelled.limit(1).isEmpty():
        return THRESHOLD
    p = held_out(labelled, folds).where("label = 0").agg(F.percentile("p_block", 1 - wrongly_blocked)).first()[0]
    return THRESHOLD if p is None else max(float(p), 1e-9)


def judge(pages: DataFrame, model: PipelineModel, rules: list[Rule], id_col: str = "page_id",
          url_col: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: id, ``host``, ``path``, ``rule`` (the one that won, or
    null), ``verdict`` (allow or block) and the model's ``p_block``."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    rows = features(rows, "url", "grams").withColumns({"host": host, "path": path})
    p = vector_to_array("probability")[1]
    won = best_rule(F.col("host"), F.col("path"), rules)
    scored = model.transform(rows).select("id", "host", "path", won.alias("won"), p.alias("p_block"))
    blocked = F.coalesce(F.col("won.is_block"), F.col("p_block") > threshold)
    return scored.select(F.col("id").alias(id_col), "host", "path", F.col("won.rule").alias("rule"),
                         F.when(blocked, "block").otherwise("allow").alias("verdict"), "p_block")
