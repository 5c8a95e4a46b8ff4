"""Global / per-group row positions without a one-partition window (§8.8).

``Window.orderBy(...)`` with no ``partitionBy`` pulls every row into one task.
Instead rows are cut into *order-preserving buckets* (a monotone function of the
sort key: a hex prefix of an md5 key, or approximate-quantile ranges of a
numeric key). Per-bucket counts are a small table (≤ buckets × groups rows);
their running sum gives each bucket's offset, and a window partitioned by
bucket numbers the rows inside it. A hot group is spread over many buckets, so
no task holds more than about ``rows / buckets`` rows. Everything is a
deterministic function of the data, so a lost executor recomputes the same
positions (no ``monotonically_increasing_id`` or partition ids involved).
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hex_bucket(c: Column | str, digits: int = 4) -> Column:
    """Monotone bucket of an md5-hex order key (uniform by construction)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.conv(F.substring(c, 1, digits), 16, 10).cast("bigint"), F.lit(-1))   # nulls sort first


def hex_digits(rows: int, per_bucket: int = 50_000) -> int:
    """Digits for ``hex_bucket`` so that a bucket holds about ``per_bucket`` rows at most, however many there are."""
    return max(2, math.ceil(math.log(max(rows / per_bucket, 1), 16)))


def quantile_bucket(df: DataFrame, col: str, buckets: int):
    """Monotone bucket of a numeric order key from approximate quantiles.

    ``approxQuantile`` returns ``buckets - 1`` numbers to the driver (bounded by
    the bucket count, not the data). Rows are placed with ``Bucketizer`` (a JVM
    binary search over the split points; the bucket = number of split points
    ``<=`` the value). Returned as a frame → frame step for ``positions``: with no
    split point every row is in bucket 0, yet the bucket stays a per-row value, so
    the offsets join remains an equi-join and the numbering window stays
    partitioned. (An array ``filter`` lambda over a derived column hit a Spark
    attribute-binding failure in grouped plans; the Bucketizer form does not.)
    """
    from pyspark.ml.feature import Bucketizer
    probs = [i / buckets for i in range(1, buckets)]
    splits = sorted(set(df.approxQuantile(col, probs, 1.0 / (4 * buckets)))) if probs else []
    inner = [float(x) for x in splits if math.isfinite(x)] or [sys.float_info.max]   # ≥ 1 interior split
    edges = [float("-inf")] + inner + [float("inf")]

    def add(frame: DataFrame) -> DataFrame:
        x = frame.withColumn("_qb_in", F.col(col).cast("double"))
        out = Bucketizer(splits=edges, inputCol="_qb_in", outputCol="_qb_out", handleInvalid="keep").transform(x)
        # Null keys sort first, so they get a bucket before all others.
        return out.withColumn("_bucket", F.when(F.col("_qb_in").isNull(), F.lit(-1)).otherwise(
            F.col("_qb_out")).cast("bigint")).drop("_qb_in", "_qb_out")
    return add


def default_buckets(rows: int, per_bucket: int = 200_000) -> int:
    """Buckets of about ``per_bucket`` rows; several at every size, so all sizes take the same path."""
    return max(4, math.ceil(rows / per_bucket))


def positions(df: DataFrame, order: list[str], bucket, group: list[str] | None = None,
              pos_col: str = "pos", size_col: str | None = None) -> DataFrame:
    """Add 0-based ``pos_col`` = rank of the row by ``order`` within ``group``
    (whole frame when ``group`` is empty); ``order`` must be unique within a group
    and ``bucket`` (a Column, or a frame → frame step adding ``_bucket`` such as
    ``quantile_bucket``) non-decreasing in ``order``. ``size_col`` adds the group size."""
    group = list(group or [])
    b = df.withColumn("_bucket", bucket) if isinstance(bucket, Column) else bucket(df)
    counts = b.groupBy(*group, "_bucket").agg(F.count("*").alias("_cnt"))
    w = Window.partitionBy(*group).orderBy("_bucket") if group else Window.orderBy("_bucket")
    offsets = counts.withColumn("_off", F.coalesce(
        F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if size_col:
        wg = Window.partitionBy(*group) if group else Window.partitionBy()
        offsets = offsets.withColumn(size_col, F.sum("_cnt").over(wg))
    offsets = offsets.drop("_cnt")
    # Ungrouped, the offsets table has at most one row per bucket (a proven bound):
    # broadcast it so the data keeps streaming in parallel. Grouped, it can be as
    # large as the number of groups, so force a shuffle join; either way the data
    # ends up partitioned by (group, bucket) for the numbering window, never by
    # the single-partition offsets side.
    keys = [*group, "_bucket"]
    offsets = offsets.withColumnsRenamed({k: f"_o_{k}" for k in keys})
    side = F.broadcast(offsets) if not group else offsets.hint("shuffle_merge")
    inner = Window.partitionBy(*group, "_bucket").orderBy(*order)
    # Null-safe: rows of a null group are numbered like any other group, none is lost.
    same = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    out = b.join(side, same).drop(*[f"_o_{k}" for k in keys]) \
        .withColumn(pos_col, (F.col("_off") + F.row_number().over(inner) - 1).cast("bigint"))
    return out.drop("_bucket", "_off")


def ntile_from_position(pos: Column | str, n: Column | str, k: int) -> Column:
    """``ntile(k)`` (1-based) from a 0-based position in a frame of ``n`` rows:
    contiguous balanced shards, the first ``n % k`` shards one row longer."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    n = F.col(n) if isinstance(n, str) else n
    q = (n / k).cast("bigint")
    r = n % k
    head = r * (q + 1)
    return (F.when(pos < head, (pos / (q + 1)).cast("bigint"))
            .otherwise(r + ((pos - head) / F.greatest(q, F.lit(1))).cast("bigint")) + 1).cast("bigint")
