"""Helpers shared by the operators: words, stored intermediate tables, Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatio.session import scratch_path

# fixed values: ASCII blanks that separate words
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row (bound as a lambda variable,
    so no optimizer rule can copy it into the places that use it)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of the maximal runs of non-blank characters (null or blank text: empty)."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)),
               lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK_CLASS)))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_slices(batches: Iterator[pa.RecordBatch], max_bytes: int, column: int | str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``max_bytes`` of text (in ``column``), one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.concatenate([[0], np.cumsum(np.asarray(
            pa.compute.fill_null(pa.compute.binary_length(b.column(column)), 0), dtype=np.int64))])
        lo = 0
        while lo < b.num_rows:
            hi = int(np.searchsorted(size, size[lo] + max_bytes, side="right")) - 1
            hi = min(b.num_rows, max(lo + 1, hi))
            yield b.slice(lo, hi - lo)
            lo = hi
