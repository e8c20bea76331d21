"""Helpers the operators share: Arrow passes, tables in the shared folder, bounded bitmaps of keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import work_folder

#: Rows handed to Python at once; texts can be long, so far fewer than Spark's 10,000.
BATCH_ROWS = 256
#: Sides of at most this many narrow rows, counted first, are broadcast.
BROADCAST_ROWS = 500_000
#: Spark's setting that deletes what a query has shuffled as soon as the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def arrow_map(df: DataFrame, func: Callable, schema: str | StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` in small batches: ``func(batches)`` yields record batches of ``schema``."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df.mapInArrow(func, schema)


@contextmanager
def unshuffled(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffled data behind; else it lies there until the driver's garbage is collected."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared folder and read back: lineage ends here and nothing is computed twice.

    What was shuffled for it is deleted, as later queries read the folder.
    """
    path = work_folder(df.sparkSession, purpose)
    with unshuffled(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def long_lists(lists: list[np.ndarray | None]) -> pa.Array:
    """Arrays of 64-bit values as one Arrow column of lists; None becomes null."""
    sizes = [0 if x is None else len(x) for x in lists]
    full = [x for x in lists if x is not None and len(x)]
    values = np.concatenate(full).view(np.int64) if full else np.empty(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    mask = pa.array([x is None for x in lists], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values), mask=mask)


def list_parts(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a column of lists, nulls as empty."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    return np.asarray(column.flatten()).view(np.uint64), lengths


def key_bits(keys: DataFrame, column: str, bits: int) -> Broadcast:
    """A bitmap of ``2**bits`` places, set at the keys' low bits, for use in tasks with ``in_bits``.

    Its size is fixed whatever the number of keys: a full one lets every row pass, and every use of it is followed by
    an exact join. The bits are gathered by Spark's bitmap aggregates, so the driver gets 2**bits / 8 bytes at most.
    """
    # Spark counts places from 1.
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    rows = (
        keys.select(place.alias("x"))
        .where("x IS NOT NULL")
        .groupBy(F.bitmap_bucket_number("x").alias("k"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("m"))
    )
    flat = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for k, m in rows.collect():
        part = np.frombuffer(m, np.uint8)
        at = (k - 1) * len(part)
        flat[at : at + len(part)] = part[: len(flat) - at]
    return keys.sparkSession.sparkContext.broadcast(flat)


def in_bits(flat: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """Which 64-bit values may be among the keys of ``key_bits``."""
    x = values.view(np.uint64) & np.uint64((1 << bits) - 1)
    return (flat[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1


def small(df: DataFrame, items: Column | None = None) -> DataFrame:
    """A narrow frame, written to the shared folder and marked for broadcast if it has few rows by an actual count.

    Rows that hold arrays count as many as ``items`` says. A larger frame is left for Spark to join by a shuffle.
    """
    kept = saved(df, "small")
    many = kept.count() if items is None else kept.agg(F.sum(items)).first()[0] or 0
    return F.broadcast(kept) if many <= BROADCAST_ROWS else kept


def text_bytes(column: str | Column) -> Column:
    """A text's UTF-8 bytes, so that Python need not decode it."""
    return (F.col(column) if isinstance(column, str) else column).cast("binary")
