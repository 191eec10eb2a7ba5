"""Train/test splits and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: copies of one row that a single task numbers
COPIES_PER_TASK = 100_000


def numbered_rows(df: DataFrame, copies: int = COPIES_PER_TASK) -> DataFrame:
    """The rows of ``df`` with ``__row``, a digest of all their columns, and
    ``__copy``, which numbers equal rows from 1.

    Equal rows are interchangeable, so they are counted (before the shuffle, in
    every task) and made anew from the count, ``copies`` of them per task: a row
    that fills a third of the table meets no task whole.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    counts = (df.select(F.md5(F.to_json(whole, {"ignoreNullFields": "false"})).alias("__row"), whole.alias("__whole"))
              .groupBy("__row").agg(F.first("__whole").alias("__whole"), F.count(F.lit(1)).alias("__n")))
    first = F.sequence(F.lit(1).cast("long"), F.col("__n"), F.lit(copies).cast("long"))
    parts = counts.select("__row", "__whole", "__n", F.explode(first).alias("__from"))
    # a large count's parts go to different tasks; the number is named because AQE would
    # join the parts, which are small before they are unrolled
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.repartition(tasks, "__row", "__from")
    last = F.least(F.col("__n"), F.col("__from") + F.lit(copies - 1))
    return parts.select("__whole.*", "__row", F.explode(F.sequence("__from", last)).alias("__copy"))


def split_random(df: DataFrame, weights: tuple[float, ...] = (0.7, 0.3),
                 seed: int = 42, key: str | None = None) -> list[DataFrame]:
    """Seeded random split that depends on the rows alone, never on how they are
    spread over files, partitions or cores.

    A row's draw is a hash of the seed and its ``key``; without a key, of the seed
    and all its columns, equal rows being told apart by a running number.
    """
    if key:
        text = F.coalesce(F.col(key).cast("string"), F.lit(""))
        number = F.lit("")
    else:
        df = numbered_rows(df)
        text, number = F.col("__row"), F.concat(F.lit("#"), F.col("__copy").cast("string"))
    draw = key_bucket(F.concat(F.lit(f"{seed}:"), text, number), 1 << 32) / float(1 << 32)
    total, low, parts = sum(weights), 0.0, []
    for k, w in enumerate(weights):
        high = low + w / total
        part = df.filter((draw >= low) & (draw < high) if k < len(weights) - 1 else draw >= low)
        parts.append(part.drop("__row", "__copy"))
        low = high
    return parts


def key_bucket(key: str | Column, buckets: int = 100) -> Column:
    """Stable bucket ``0..buckets-1`` of a key: first 32 bits of md5 of its text.
    The same number comes out of any engine with md5."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("long") % buckets


def split_by_key(df: DataFrame, key: str, train_pct: int = 70) -> tuple[DataFrame, DataFrame]:
    """Reproducible split: a row is in train when its key bucket < ``train_pct``;
    rows without a key count as bucket 0."""
    in_train = F.coalesce(key_bucket(key), F.lit(0)) < train_pct
    return df.filter(in_train), df.filter(~in_train)


def combine(*frames: DataFrame) -> DataFrame:
    """Bag union by column name (positional union would silently mix columns)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
