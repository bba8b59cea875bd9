"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import ship
from lexweave.sources.bundle import delete, saved, shared_dir

__all__ = ["WORD", "delete", "fast_lower", "looked_up", "lower_ascii", "release", "saved", "shared_dir", "slices", "small_or_not", "table"]

WORD = r"[^\x20\x09-\x0D]+"
"""A word: a run of anything but ASCII white space."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def fast_lower(col: Column) -> Column:
    """Lower-cases A-Z at the speed of lower(), which also lower-cases letters beyond ASCII; the two of those that become ASCII letters are left as they are."""
    return F.when(col.contains("\u212a") | col.contains("\u0130"), lower_ascii(col)).otherwise(F.lower(col))


def slices(batch, column: str, most: int = 8 << 20, rows: int = 2500) -> Iterator:
    """An Arrow batch in parts of so many bytes or list items in the column (one row at least), and of so many rows."""
    values = batch.column(column)
    size = pc.fill_null(pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    end, at = np.cumsum(size, dtype=np.int64), 0
    while at < batch.num_rows:
        to = int(np.searchsorted(end, (end[at - 1] if at else 0) + most, "right"))
        to = min(max(to, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def release() -> None:
    """Gives what a Python worker has freed back to the system: it stays alive between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another libc than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_or_not(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it counts at most max_rows (narrow) rows; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if len(df.limit(max_rows + 1).groupBy().count().where(F.col("count") <= max_rows).take(1)) else df


def looked_up(rows: DataFrame, lookup: DataFrame, key: str, count: str, total: int, most: int = 1000) -> DataFrame:
    """rows joined with lookup, which has each key once and how many rows it has at most of total.

    Keys that may hold 1/most of all rows or more, `most` at most, are broadcast, so no task gets all rows of a hot key.
    """
    hot = F.col(count) >= max(2, -(-total // most))
    few = rows.join(F.broadcast(lookup.where(hot).select(key)), key, "left_anti").join(lookup.where(~hot), key)
    return few.unionByName(rows.join(F.broadcast(lookup.where(hot)), key))
