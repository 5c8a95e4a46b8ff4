"""Small relational operators shared by the stages.

All of them are single declarative plans: aggregations run partial (map-side)
then final, so a hot key is pre-reduced before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A2/A3: one row per ``keys``, the row with the smallest ``order`` wins.

    ``groupBy + min_by`` (partial + final aggregate) instead of a window: each map
    task keeps one candidate per key before the shuffle, so a key holding a third
    of all rows costs one row per task, not a third of the data in one task.
    """
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others]).alias("_row")
    ordering = F.struct(*[F.col(c) for c in order])
    agg = df.groupBy(*keys).agg(F.min_by(packed, ordering).alias("_row"))
    return agg.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*df.columns)


def report(df: DataFrame, stage: str, metrics: dict[str, Column]) -> DataFrame:
    """A1/K4: one aggregate pass, unpivoted to ``(stage, metric, value)`` rows."""
    names = list(metrics)
    wide = df.agg(*[metrics[n].cast("bigint").alias(f"m{i}") for i, n in enumerate(names)])
    stacked = ", ".join(f"'{n}', m{i}" for i, n in enumerate(names))
    return wide.selectExpr(f"stack({len(names)}, {stacked}) as (metric, value)") \
        .select(F.lit(stage).alias("stage"), "metric", "value")


def union_reports(*reports: DataFrame) -> DataFrame:
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


@dataclass
class Split:
    """U4: complementary accept / reject outputs of one predicate."""
    accepted: DataFrame
    rejected: DataFrame


def split(df: DataFrame, cond: Column, reason: str | None = None) -> Split:
    rejected = df.filter(~cond | cond.isNull())
    if reason is not None:
        rejected = rejected.withColumn("reject_reason", F.lit(reason))
    return Split(df.filter(cond), rejected)


def strict_drop(df: DataFrame, cols: list[str], strict: bool = True) -> DataFrame:
    """Drop columns; unlike ``df.drop`` a missing column is an error when strict."""
    if strict:
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise KeyError(f"columns not present: {missing}")
    return df.drop(*cols)


def prefix_columns(df: DataFrame, cols: list[str], prefix: str) -> DataFrame:
    """P5: rename ``cols`` to ``prefix + col`` (we use '_' rather than ':')."""
    return df.select(*[F.col(c).alias(prefix + c) if c in cols else F.col(c) for c in df.columns])


def keep_where(df: DataFrame, cond: Column) -> DataFrame:
    """Filter that stays where it is written.

    ``df.filter`` on a column computed by a large expression is pushed below the
    projections with every alias substituted, duplicating the computation into
    scans and join conditions (and past the 64 KB code-method limit). An
    ``explode`` of a 0/1-element array is not a predicate the optimizer moves, so
    the expression is evaluated once, here. Same rows as ``df.filter(cond)``."""
    tag = "_keep"
    return df.withColumn(tag, F.explode(F.filter(F.array(F.lit(True)), lambda _: F.coalesce(cond, F.lit(False))))) \
        .drop(tag)


def observe_report(df: DataFrame, stage: str, metrics: dict[str, Column]):
    """K4 without an extra pass: metrics ride along the next action on ``df``.

    Returns ``(df_observed, read)``; after an action on ``df_observed`` (e.g. the
    stage's write), ``read()`` gives ``{metric: value}``."""
    from pyspark.sql import Observation
    obs = Observation(stage)
    observed = df.observe(obs, *[m.alias(name) for name, m in metrics.items()])
    return observed, (lambda: dict(obs.get))


def spread_null_key(key: Column, *salt: Column | str) -> Column:
    """A left-join key whose NULLs are replaced by distinct negative values.

    In a shuffle join every NULL key hashes to the same reducer; when most rows have
    no lookup (NULL), that one task gets most of the data. The negatives never
    match a real (non-negative) key, so the join result is unchanged."""
    cols = [F.col(c) if isinstance(c, str) else c for c in salt]
    return F.coalesce(key.cast("bigint"), -1 - F.pmod(F.xxhash64(*cols), F.lit(1 << 40)))


SAMPLE_DIGITS = 4      # hex digits of the order key counted at a time: at most 65,536 counts reach the driver


def sample_n(df: DataFrame, n: int, key: Column, strict: bool = False) -> DataFrame:
    """O3: exactly ``n`` rows (all, if fewer; with ``strict`` too few is an error), those with the smallest ``key``, an
    md5 text (``order_key``). Rows with equal keys are told apart by their columns.

    ``orderBy(key).limit(n)`` gathers n rows in one task. Here rows are counted by the leading digits of the key, a
    few digits more at a time, until the place where the n-th row lies holds few rows; everything before it is one
    filter over the table, and only the rest of that place is ordered."""
    x = df.withColumn("_key", key)
    prefix, need = "", n
    below = F.lit(False)
    while True:
        at = len(prefix) + 1
        here = x if not prefix else x.filter(F.substring("_key", 1, len(prefix)) == prefix)
        counts = here.groupBy(F.substring("_key", at, SAMPLE_DIGITS).alias("d")).count().orderBy("d").collect()
        if not prefix and sum(r["count"] for r in counts) <= n:
            if strict and sum(r["count"] for r in counts) < n:
                raise ValueError(f"a sample of {n} rows from fewer")
            return df
        inside = None
        for r in counts:
            if r["count"] > need:
                inside = r
                break
            need -= r["count"]
        prefix += inside["d"]
        below = F.substring("_key", 1, len(prefix)) < prefix          # fixed width: text order is the order of the keys
        if inside["count"] <= SAMPLE_REST or len(prefix) + SAMPLE_DIGITS > 32:
            break
    rest = x.filter(F.substring("_key", 1, len(prefix)) == prefix).orderBy("_key", *df.columns).limit(need)
    return x.filter(below).unionByName(rest).drop("_key")


SAMPLE_REST = 10_000   # rows that are ordered at the end
