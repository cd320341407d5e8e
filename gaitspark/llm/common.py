"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ensure_importable

#: White space that separates words.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns. Names are matched exactly, so that others differing in case alone don't clash."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names)])


#: Bytes of an Arrow batch that Spark sends to a Python worker, where the session has no other bound than Spark's default.
BATCH_BYTES = 8 << 20
BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with this package importable on the workers, and batches bounded by bytes as well as by rows."""
    spark = df.sparkSession
    ensure_importable(spark)
    if spark.conf.get(BYTES_CONF) == "67108864b":  # Spark's default
        spark.conf.set(BYTES_CONF, BATCH_BYTES)
    return df.mapInArrow(fn, schema)


def slices(batches: Iterable[pa.RecordBatch], text_at: int, most_bytes: int = 1 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Parts of batches with about most_bytes of the column text_at, or one row, so that memory doesn't depend on Spark's batches."""
    for b in batches:
        if not b.num_rows:
            continue
        lengths = pc.binary_length(b.column(text_at)) if not pa.types.is_list(b.schema.field(text_at).type) else pc.multiply(pc.list_value_length(b.column(text_at)), 8)
        ahead, lo = np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while lo < b.num_rows:
            used = int(ahead[lo - 1]) if lo else 0
            hi = max(lo + 1, min(int(np.searchsorted(ahead, used + most_bytes, side="right")), lo + most_rows))
            yield b.slice(lo, hi - lo)
            lo = hi


def utf8_size(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def batch(**columns: pa.Array | list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in columns.values()], names=list(columns))


#: Broadcast no more ids than this to pick rows; more are joined by shuffle.
BROADCAST_IDS = 200_000


def with_ids(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Inner join with a table of ids (in the shared folder, so that it is counted fast): few of them are broadcast, so
    that texts aren't shuffled; more are not."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on)
