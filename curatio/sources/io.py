"""S1-S8 readers and K1-K6 writers.

Reads always take an explicit schema (no inference pass over the data); writes
are whole-partition overwrites so a retried task or job leaves no duplicates.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_array(spark: SparkSession, path: str | list[str], schema: StructType | str, strict: bool = True) -> DataFrame:
    """Files holding one JSON array each (one row per element); ``strict`` fails on a malformed document.
    A folder of documents written by ``write_json_documents`` reads with its partition columns in ``schema``."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines; ``strict`` fails on a malformed line like the source does
    (Spark's default would null the row)."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """S3: one row per file with its whole text (``path``, ``value``)."""
    return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The ``(metric, value)`` rows of a report that ``write_report`` left; an absent report is empty."""
    return read_or_empty(spark, path, "metric string, value bigint", "csv", sep="\t", quote="", mode="FAILFAST")


def _partition_int(name: str) -> Column:
    """An int partition value from a path segment ``name:<n>``, ``name%3A<n>`` or ``name=<n>``."""
    return F.regexp_extract(F.col("_metadata.file_path"), rf"{re.escape(name)}(?::|%3A|=)(\d+)", 1).cast("int")


def _files_under(spark: SparkSession, root: str, keep: Column | None) -> list[str]:
    """Paths of the files under ``root`` that ``keep`` (on ``_metadata.file_path``) lets through: a listing, no
    content is read. The driver holds the paths of the kept files."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    if keep is not None:
        listing = listing.filter(keep)
    return [r["path"] for r in listing.select("path").collect()]


def _is_missing(e: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e)


def read_partition_tree(spark: SparkSession, root: str, schema: StructType | str, fmt: str = "json",
                        partitions: tuple[str, ...] = ("persona_seed", "session_num"),
                        only: dict[str, int] | None = None) -> DataFrame:
    """Every file under ``root`` at any depth (globs break on ``:`` paths), partition ints derived from the file
    path. With ``only`` the files are listed first and those of other partitions are never opened. Empty folders
    contribute no files; an absent root or no matching file gives an empty frame (S8)."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    try:
        reader = spark.read.schema(wanted).format(fmt)
        if only:
            keep = F.lit(True)
            for p, v in only.items():
                keep = keep & (_partition_int(p) == v)
            files = _files_under(spark, root, keep)
            df = reader.load(files) if files else None
        else:
            df = reader.option("recursiveFileLookup", True).load(root)
    except Exception as e:  # noqa: BLE001 - Spark raises AnalysisException for a missing path
        if not _is_missing(e):
            raise
        df = None
    if df is None:
        df = spark.createDataFrame([], wanted)
        return df.select("*", *[F.lit(None).cast("int").alias(p) for p in partitions])
    for p in partitions:
        df = df.withColumn(p, _partition_int(p))
    return df


def read_image_db(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """S5 + U1: per-source parquet folders tagged with their source name."""
    out = None
    for name, path in sources.items():
        df = spark.read.parquet(path).withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_caption_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Header-less ``url<TAB>caption``."""
    return spark.read.schema("url string, caption string").option("sep", "\t").option("header", False) \
        .option("quote", "").csv(path)


def list_images(spark: SparkSession, root: str, glob: str = "*.jpg") -> DataFrame:
    """Image file listing (paths only; the bytes column is pruned away)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")


def read_or_empty(spark: SparkSession, path: str | None, schema: StructType | str, fmt: str = "parquet", **options) -> DataFrame:
    """An absent previous-stage output reads as an empty frame."""
    if path:
        try:
            return spark.read.schema(schema).format(fmt).options(**options).load(path)
        except Exception as e:  # noqa: BLE001
            if not _is_missing(e):
                raise
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    return spark.createDataFrame([], schema)


# ---- sinks ------------------------------------------------------------------------------

def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """K1: overwrite; with ``partition_by`` only the partitions present are replaced
    (dynamic partition overwrite), so re-running one seed leaves the others alone."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    w.save(path)


def write_json_documents(df: DataFrame, path: str, by: str = "persona_seed", order: list[str] | None = None) -> None:
    """K2: one JSON-array document per ``by`` value, ``<path>/<by>=<n>/part-*.json``: rows in ``order``, UTF-8 as it
    is, null fields kept as null.

    A document is one task's run of lines, ``[{...}``, ``,{...}`` and the last one closed, so no document is
    ever held whole; Spark's commit publishes a document complete or not at all, and a rerun replaces the
    documents of the values present, no others. Null ``by`` values form a document of their own."""
    rows = [c for c in df.columns if c != by]
    line = F.to_json(F.struct(*rows), {"ignoreNullFields": "false"})
    place = Window.partitionBy(by).orderBy(*(order or rows))
    text = F.concat(F.when(F.row_number().over(place) == 1, "[").otherwise(","), line,
                    F.when(F.lead(F.lit(1)).over(place).isNull(), "]").otherwise(""))
    df.select(by, text.alias("value")).write.mode("overwrite").partitionBy(by).option("partitionOverwriteMode", "dynamic").text(path)


def write_text_files(df: DataFrame, path: str, by: str, order: list[str], value_col: str = "value") -> None:
    """One text file per ``by`` value, ``<path>/<by>=<n>/part-*.txt``: a line per row in ``order``. Rows are dealt by the
    value, so one with many rows is one task's run of lines; a rerun replaces the files of the values present."""
    lines = df.repartition(by).sortWithinPartitions(by, *order).select(by, F.col(value_col).alias("value"))
    lines.write.mode("overwrite").partitionBy(by).option("partitionOverwriteMode", "dynamic").text(path)


def write_rejects(df: DataFrame, path: str, reason_col: str = "reject_reason") -> None:
    """K5: rejected rows partitioned by reason."""
    write_table(df.filter(F.col(reason_col).isNotNull()), path, partition_by=[reason_col])


def write_report(report: DataFrame, path: str) -> None:
    """K4: ``metric<TAB>value`` text, one file."""
    report.select(F.concat_ws("\t", "metric", F.col("value").cast("string")).alias("value")) \
        .coalesce(1).write.mode("overwrite").text(path)


def write_buckets(df: DataFrame, path: str, bucket_col: str = "persona_seed", fmt: str = "json") -> None:
    """K6: fixed-size buckets written one folder per bucket (``persona_seed=<n>``)."""
    write_table(df, path, fmt=fmt, partition_by=[bucket_col])
