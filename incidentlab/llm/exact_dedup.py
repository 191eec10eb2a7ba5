"""Exact duplicates by skew-safe combining, in DataFrame operations only.

Three stages, each comparing whole texts (the text is a grouping key beside its
SHA-256 digest):

1. local: the map side of the first grouping keeps one row per text and task;
2. salted: those rows meet by (digest, salt, text), the salt being the task's
   number modulo ``salts``, so the copies of one text spread over ``salts``
   reducers however many there are;
3. global: at most ``salts`` winners per text meet by (digest, text).

A digest under which the groupings found one text only now names that text, so
the answer goes back to the documents by digest, without their texts.  Digests
that two different texts share (checked, never assumed) go back by full text.
On the way back a digest that many rows share is split over tasks (adaptive skew
join): the join meets a written table, and the rows are laid by (id, digest) after it.

Edge cases: null text counts as empty; a null id never beats another id; of rows
that repeat id and text one is kept; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table
from .common import clean_text, fresh_name

SALTS = 64


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _slim(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    t = docs.select(F.col(id_col).cast("long").alias("id"), clean_text(text_col).alias("t"))
    return t.select("id", "t", digest(F.col("t")).alias("d"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
           digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """(d, t, keep_id, group_size): one row per different text."""
    slim = _slim(docs, id_col, text_col, digest).withColumn(
        "salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = slim.groupBy("d", "salt", "t").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("d", "t").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     salts: int = SALTS, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept`` and the
    text's ``text_sha256``."""
    slim = _slim(docs, id_col, text_col, digest)
    found = groups(docs, id_col, text_col, salts, digest)
    answer = write_table(found.select("d", "keep_id", "group_size"), "exact-groups")
    shared = answer.groupBy("d").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("d")
    if shared.isEmpty():
        rows = slim.select("id", "d", _sha256(F.col("t")).alias("text_sha256")).join(answer, "d")
    else:
        shared = write_table(shared, "exact-shared")
        by_digest = (slim.select("id", "d", _sha256(F.col("t")).alias("text_sha256"))
                     .join(shared, "d", "left_anti").join(answer, "d"))
        by_text = (slim.withColumn("text_sha256", _sha256(F.col("t"))).join(shared, "d", "left_semi")
                   .join(found, ["d", "t"]))
        rows = by_digest.unionByName(by_text.select(*by_digest.columns))
    # laid anew by (id, digest): the join then owes nobody its layout, and adaptive
    # execution may split the digest of a large group of copies
    rows = rows.repartition("id", "d")
    once = Window.partitionBy("text_sha256", "d", "id").orderBy(F.lit(1))
    is_keeper = F.col("id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(once) == 1)
    return rows.select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
                       is_keeper.alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the
    one with the largest id."""
    mark, key = fresh_name(docs, "text_digest"), fresh_name(docs, "keep_key")

    def named(value: Column) -> Column:
        """An id as a join key; a missing one has a name of its own."""
        return F.coalesce(value.cast("long").cast("string"), F.lit(""))
    # groups() compared whole texts; (id, digest) names one of its winners
    keep = groups(docs, id_col, text_col, salts).select(named(F.col("keep_id")).alias(key), F.col("d").alias(mark))
    marked = docs.withColumns({mark: _sha256(clean_text(text_col)), key: named(F.col(id_col))})
    kept = marked.join(keep, [key, mark], "left_semi")
    # the join has laid the rows by these columns already: no further shuffle
    once = Window.partitionBy(key, mark).orderBy(F.lit(1))
    number = fresh_name(kept, "copy_no")
    return kept.withColumn(number, F.row_number().over(once)).where(F.col(number) == 1).select(*docs.columns)
