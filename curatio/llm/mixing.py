"""Mixing sources to target weights: tokens per source, repetition rates, copies per document.

Sizes are summed per source (partial sums before the shuffle, so a source with a
third of all rows is one row per task), the sources are ranked and their targets
computed on that small table, and each document gets ``floor(rate)`` copies plus
one more with probability ``rate - floor(rate)``, drawn from a hash of its key:
the same on every run, whatever the partitioning. Documents never pass a window;
they only join their source's row (a hot source is a hot key on the streamed side
of a sort-merge join, which adaptive execution splits).

Cases: null or blank text has size 0; a null source is a source of its own, last in
the order; repeated rows get the same draw (the draw is of the key, or of the text
where the key is null); a source whose documents are all empty gets rate 0; an empty
table gives an empty result; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatio.functions.draws import hash32
from curatio.llm.common import stored

# fixed value: a word
WORD = r"[^\x20\x09-\x0D]+"
DRAWS = 1 << 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    ``weights`` repeat over the sources in code-point order, nulls last. The sources share
    ``share`` times the sum of sizes; a target above ``cap`` times its source's size stops
    there and the excess goes to the others by weight, until none is above. With the level
    L = (share - what the stopped ones take) / (weight of the others), the stopped sources
    are those with cap * size < L * weight; L only rises, so repeating to a fixed point ends.
    Each repetition is one aggregate over the table of sources and returns three numbers.
    """
    ordered = stored(sizes.orderBy(F.col("source").asc_nulls_last())
                     .withColumn("_part", F.spark_partition_id()), "sources")
    # Ranks: row numbers inside the range partitions of the sort, plus the counts of those before.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("_part").agg(F.count("*").alias("_n")) \
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    pos = (F.col("_before") + F.row_number().over(inside) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (pos + 1).cast("int"))
    ranked = ordered.withColumn("_rn", F.row_number().over(inside)).join(offsets, "_part") \
        .select("source", "source_size", weight.alias("weight"))
    ranked = stored(ranked, "ranks")

    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        stops = cap * F.col("source_size") < F.lit(level) * F.col("weight")
        row = ranked.agg(F.sum(F.when(stops, F.col("source_size"))), F.sum(F.when(~stops, F.col("weight")))).first()
        if not row[1]:
            break
        new = (share * total - cap * (row[0] or 0)) / row[1]
        if new <= level:
            break
        level = new
    target = F.when(cap * F.col("source_size") < F.lit(level) * F.col("weight"), cap * F.col("source_size")) \
        .otherwise(F.lit(level) * F.col("weight")).cast("double")
    return ranked.select("source", "source_size", target.alias("target"))


def copies(docs: DataFrame, text_col: str = "text", source_col: str = "source", key_col: str = "doc_id",
           weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 9) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` (its source's) and ``copies`` added."""
    sized = docs.withColumn("size", n_words(F.col(text_col).cast("string")))
    sums = sized.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = source_targets(sums, weights, share, cap)
    out = ["size", "source_size", "target", "copies"]
    side = targets.select(F.col("source").alias("_source"), "source_size", "target")
    joined = sized.drop("source_size", "target").join(
        side, F.col(source_col).cast("string").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = F.coalesce(F.col(key_col).cast("string"), F.col(text_col).cast("string"), F.lit(""))
    extra = (hash32(seed, "mix", key) / F.lit(float(DRAWS)) < rate - F.floor(rate)).cast("int")
    kept = [c for c in docs.columns if c not in out]
    return joined.withColumn("copies", (F.floor(rate).cast("int") + extra)).select(*kept, *out)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's row as often as it has copies, with the columns of ``docs``."""
    return copies(docs, **options).filter("copies > 0") \
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)
