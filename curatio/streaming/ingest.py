"""§2.13: resumable completion ingest with Structured Streaming.

Completion files land in a folder; a file-source stream picks up new files only
(its checkpoint remembers which were processed), each micro-batch is parsed by a
stage's parse function and written with an *overwrite of its own* ``batch_id=<n>``
folder. A crash between the write and the commit replays the same batch into the
same folder, so the output never holds a chunk twice and never loses one — the
save-point file of the source pipeline, written before the data, could lose one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from curatio.operators.core import dedupe_first
from curatio.sources.io import read_or_empty

def _files(spark: SparkSession, in_dir: str, schema: StructType | str, fmt: str, max_files: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(in_dir)


def _run(stream: DataFrame, write_batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _parsed_schema(spark: SparkSession, schema: StructType | str, parse: Callable[[DataFrame], DataFrame]) -> StructType:
    empty = spark.createDataFrame([], StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    return parse(empty).schema


def ingest(spark: SparkSession, in_dir: str, schema: StructType | str, out_dir: str, checkpoint: str,
           parse: Callable[[DataFrame], DataFrame], fmt: str = "json", max_files_per_trigger: int | None = None) -> DataFrame:
    """Process every not-yet-seen file under ``in_dir`` (``availableNow``) and return
    the accumulated parsed output (``batch_id`` column from the folder names); without any file so far, no rows."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        parse(batch).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}")

    _run(_files(spark, in_dir, schema, fmt, max_files_per_trigger), write_batch, checkpoint)
    return read_or_empty(spark, out_dir, _parsed_schema(spark, schema, parse).add("batch_id", IntegerType()))


WINNER_BUCKETS = 1024    # parts of the winners table: a batch rewrites the parts its keys fall into (more for larger tables)


def ingest_unique(spark: SparkSession, in_dir: str, schema: StructType | str, out_dir: str, checkpoint: str,
                  parse: Callable[[DataFrame], DataFrame], keys: list[str], order: list[str],
                  fmt: str = "json", max_files_per_trigger: int | None = None, buckets: int = WINNER_BUCKETS) -> DataFrame:
    """Like ``ingest`` but a key is accepted at most once over all batches (A2/A3): the row
    that is first by ``order`` (e.g. the lowest ``seq``), whichever file brought it.

    The winners so far lie in ``buckets`` parts by key hash. A batch reads the parts of its own keys, merges, and
    writes them anew in its own folder (``batch_id=<n>/bucket=<b>``); which batch wrote a part last stands in a
    small table of its own, at most one row per part and batch. A replayed batch starts from what earlier batches left and writes
    the same again; parts it does not touch are neither read nor written."""
    out = out_dir.rstrip("/")
    rows = _parsed_schema(spark, schema, parse)

    def latest(before: int | None) -> dict[int, int]:
        """Bucket -> the last batch that wrote it (at most ``buckets`` entries)."""
        written = read_or_empty(spark, f"{out}/written", "bucket int, batch_id int")
        if before is not None:
            written = written.filter(F.col("batch_id") < before)
        return {r["bucket"]: r["b"] for r in written.groupBy("bucket").agg(F.max("batch_id").alias("b")).collect()}

    def winners(parts: dict[int, int]) -> DataFrame:
        if not parts:
            return spark.createDataFrame([], rows)
        paths = [f"{out}/rows/batch_id={batch}/bucket={bucket}" for bucket, batch in sorted(parts.items())]
        return spark.read.schema(rows).parquet(*paths)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = dedupe_first(parse(batch), keys, order).withColumn("bucket", bucket)
        path = f"{out}/new/batch_id={batch_id}"
        new.write.mode("overwrite").parquet(path)                              # one parse of the batch
        new = spark.read.schema(new.schema).parquet(path)
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}
        old = winners({b: n for b, n in latest(batch_id).items() if b in touched}).withColumn("bucket", bucket)
        merged = dedupe_first(new.unionByName(old), [*keys, "bucket"], order)
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/rows/batch_id={batch_id}")
        spark.createDataFrame([(b,) for b in sorted(touched)], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{out}/written/batch_id={batch_id}")

    _run(_files(spark, in_dir, schema, fmt, max_files_per_trigger), write_batch, checkpoint)
    return winners(latest(None))
