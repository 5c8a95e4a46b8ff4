"""C15 backend worklists, C19 completion attach / pending, W1 shards, K6 seed buckets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatio import constants as K
from curatio.operators.core import dedupe_first
from curatio.operators.position import ntile_from_position, positions


def backend_of(module_col: str | Column) -> Column:
    m = F.col(module_col) if isinstance(module_col, str) else module_col
    expr = F.lit(None).cast("string")
    for code, backend in K.BACKENDS.items():
        expr = F.when(m == code, F.lit(backend)).otherwise(expr)
    return expr


def artifact_path(backend: Column | str, seed: Column | str, uuid: Column | str, idx: int = 0,
                  seed_prefix: str = K.ARTIFACT_SEED_PREFIX) -> Column:
    """Where a backend stores the artifact of one request (NULL for the image DB):
    ``<root>/<seed_prefix><seed>/<idx>:<uuid>.png`` (a ``<uuid>`` folder for web search)."""
    backend = F.col(backend) if isinstance(backend, str) else backend
    seed = (F.col(seed) if isinstance(seed, str) else seed).cast("string")
    uuid = F.col(uuid) if isinstance(uuid, str) else uuid
    out = F.lit(None).cast("string")
    for b, root in K.ARTIFACT_ROOTS.items():
        leaf = uuid if b == "bing" else F.concat(F.lit(f"{idx}:"), uuid, F.lit(".png"))
        out = F.when(backend == b, F.concat(F.lit(f"{root}/{seed_prefix}"), seed, F.lit("/"), leaf)).otherwise(out)
    return out


def backend_worklist(requests: DataFrame, done: DataFrame, module_col: str = "image_alignment_module",
                     uuid_col: str = "image_uuid", seed_col: str = "persona_seed") -> DataFrame:
    """C15 for every backend at once: each request gets ``backend``, ``status``
    (``pending`` = its backend has no artifact yet, ``done`` = artifact exists,
    ``untouched`` = handled elsewhere, i.e. retrieval) and ``artifact_path``.

    ``done`` holds ``(backend, image_uuid)`` of finished artifacts. The existence
    test is a left join on the request key (J12 anti / semi in one pass, U2 union
    implicit), so no request is read twice.
    """
    d = done.select(F.col("backend").alias("_done_backend"), F.col(uuid_col).alias("_done_uuid")).distinct() \
        .withColumn("_is_done", F.lit(True))
    r = requests.withColumn("backend", backend_of(module_col))
    j = r.join(d, (r["backend"] == d["_done_backend"]) & (r[uuid_col] == d["_done_uuid"]), "left")
    status = (F.when(F.col("backend") == "image_db", F.lit("untouched"))
              .when(F.col("_is_done"), F.lit("done")).otherwise(F.lit("pending")))
    return j.withColumn("status", status) \
        .withColumn("artifact_path", artifact_path("backend", seed_col, uuid_col)) \
        .drop("_done_backend", "_done_uuid", "_is_done")


def backend_counts(worklist: DataFrame) -> DataFrame:
    """Target / non-target / total per backend, plus an all-backends row."""
    return worklist.rollup("backend").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "pending").alias("target"),
        F.count_if(F.col("status") != "pending").alias("non_target"),
    ).withColumn("backend", F.coalesce(F.col("backend"), F.lit("*")))


@dataclass
class Attached:
    rows: DataFrame       # every request with its first completion, if any, and ``pending``
    attached: DataFrame   # requests with their first completion
    pending: DataFrame    # requests without any completion (still to call)


def attach_completions(requests: DataFrame, completions: DataFrame, key: str = "request_id",
                       seq: str | list[str] = "seq") -> Attached:
    """First completion per request (lowest ``seq``; retries may repeat a
    request) joined onto the requests; requests without one are pending."""
    first = dedupe_first(completions, [key], [seq] if isinstance(seq, str) else list(seq)) \
        .withColumn("_has", F.lit(True))
    # each output that is run on its own runs the join: take ``rows`` where both are wanted
    rows = requests.join(first, key, "left").withColumn("pending", F.col("_has").isNull()).drop("_has")
    return Attached(rows, rows.filter(~F.col("pending")).drop("pending"), rows.filter("pending").select(*requests.columns))


def token_usage(rows: DataFrame, by: list[str]) -> DataFrame:
    """A10 over ``Attached.rows``: requests, attached, pending and token sums per group in one aggregate (the source
    stores tokens per call only)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return rows.groupBy(*by).agg(F.count("*").alias("n_requests"), F.count_if(~F.col("pending")).alias("n_attached"),
                                 F.count_if("pending").alias("n_pending"), total("prompt_tokens"), total("completion_tokens"))


def shard(df: DataFrame, order: list[str], bucket, k: int = K.DEFAULT_SHARDS,
          col: str = "chunk_idx") -> DataFrame:
    """Contiguous balanced shards 0..k-1 by ``order`` (first ``n % k`` one row longer);
    empty shards never appear because only shards with rows exist."""
    p = positions(df, order, bucket, pos_col="_pos", size_col="_n")
    return p.withColumn(col, ntile_from_position("_pos", "_n", k) - 1).drop("_pos", "_n")


def resume_filter(df: DataFrame, last_saved: Column | int, col: str = "chunk_idx") -> DataFrame:
    """keep only shards after the last saved one."""
    last = last_saved if isinstance(last_saved, Column) else F.lit(last_saved)
    return df.filter(F.col(col) > last)


def seed_buckets(df: DataFrame, order: list[str], bucket, size: int = K.PERSONA_SEED_SIZE) -> DataFrame:
    """K6 + O2: seeded shuffle order → global position → ``persona_seed = pos div size``."""
    p = positions(df, order, bucket, pos_col="pos")
    return p.withColumn("persona_seed", (F.col("pos") / size).cast("bigint"))
