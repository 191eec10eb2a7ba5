"""Shared helpers: table access, per-batch Arrow work, loop checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread, write_table

__all__ = ["read", "map_rows", "spread", "write_table", "text_bytes", "clean_text", "fresh_name"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def clean_text(col: str = "text") -> F.Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fresh_name(df: DataFrame, wish: str) -> str:
    """``wish``, or a longer name when a column (in any case) is called so already."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def map_rows(df: DataFrame, schema: T.StructType | str,
             make: Callable[[], Callable[..., dict | None]]) -> DataFrame:
    """Apply a batch function inside tasks through Arrow.

    ``make()`` runs once per task and returns ``work(*columns)``; ``work`` gets
    one Arrow array per column of ``df`` and returns a dict of equally long
    arrays or lists, one per output field.  One batch is in memory at a time.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    names = [f.name for f in schema]
    arrow = {f.name: _arrow_type(f.dataType) for f in schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = work(*batch.columns)
            if out is None:
                continue
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, type=arrow[n])
                 for n, v in ((n, out[n]) for n in names)], names=names)

    return df.mapInArrow(run, schema)


def _arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow_type(t.elementType))
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(),
            T.DoubleType: pa.float64(), T.FloatType: pa.float32(), T.BinaryType: pa.binary(),
            T.BooleanType: pa.bool_()}[type(t)]


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, nulls as empty bytes."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]
