"""Worklist queries over ``orders`` / ``lineitem`` / ``part``.

Stand-ins: an order is an image request (``image_uuid = md5(o_orderkey)``, module
by the priority digit, persona seed ``o_custkey div 100``); an order with status
``F`` already has its artifact. Line items are completion attempts of the order's
request (``seq = l_linenumber``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from curatio.functions.draws import order_key, sql_order_key
from curatio.operators.position import default_buckets, hex_bucket, hex_digits, quantile_bucket
from curatio.plans import worklist as W
from curatio.sources.testdata import Tables
from curatio.standins.registry import query

MODULES = ["t2i", "p-t2i", "web", "retrieval", "t2i"]
MODULE_SQL = "['" + "','".join(MODULES) + "'][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)]"


def requests(t):
    o = t.orders
    return o.select(F.md5(F.col("o_orderkey").cast("string")).alias("image_uuid"),
                    F.element_at(F.array(*[F.lit(m) for m in MODULES]),
                                 F.substring("o_orderpriority", 1, 1).cast("int")).alias("image_alignment_module"),
                    (F.col("o_custkey") / 100).cast("bigint").alias("persona_seed"),
                    "o_orderstatus", "o_orderkey")


WORKLIST_SQL = f"""WITH req AS (
  SELECT md5(CAST(o_orderkey AS VARCHAR)) AS image_uuid, {MODULE_SQL} AS image_alignment_module,
         CAST(o_custkey // 100 AS BIGINT) AS persona_seed, o_orderstatus
  FROM orders
), b AS (
  SELECT *, CASE image_alignment_module WHEN 't2i' THEN 'sdxl-lightning' WHEN 'p-t2i' THEN 'photomaker'
            WHEN 'web' THEN 'bing' WHEN 'retrieval' THEN 'image_db' END AS backend FROM req
), w AS (
  SELECT image_uuid, image_alignment_module, persona_seed, backend,
    CASE WHEN backend = 'image_db' THEN 'untouched' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'pending' END AS status,
    CASE backend
      WHEN 'sdxl-lightning' THEN 'generated_image/plan-and-execute/sdxl/seed_' || persona_seed || '/0:' || image_uuid || '.png'
      WHEN 'photomaker' THEN 'generated_image/plan-and-execute/generator/seed_' || persona_seed || '/0:' || image_uuid || '.png'
      WHEN 'bing' THEN 'generated_image/plan-and-execute/web_searcher/seed_' || persona_seed || '/' || image_uuid
    END AS artifact_path
  FROM b
)"""


def _worklist(spark, sf_dir):
    req = requests(Tables(spark, sf_dir))
    done = req.filter(F.col("o_orderstatus") == "F") \
        .select(W.backend_of("image_alignment_module").alias("backend"), "image_uuid")
    return W.backend_worklist(req.drop("o_orderstatus", "o_orderkey"), done)


@query("backend_worklist", WORKLIST_SQL + "\nSELECT * FROM w")
def backend_worklist(spark, sf_dir):
    return _worklist(spark, sf_dir).select("image_uuid", "image_alignment_module", "persona_seed", "backend",
                                           "status", "artifact_path")


@query("backend_counts", WORKLIST_SQL + """
SELECT coalesce(backend, '*') AS backend, count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS target,
       count(*) FILTER (WHERE status <> 'pending') AS non_target
FROM w GROUP BY ROLLUP (backend)""")
def backend_counts(spark, sf_dir):
    return W.backend_counts(_worklist(spark, sf_dir))


@query("completion_attach", """WITH req AS (
  SELECT md5(CAST(o_orderkey AS VARCHAR)) AS request_id, CAST(o_custkey // 100 AS BIGINT) AS persona_seed FROM orders
), comp AS (
  SELECT md5(CAST(l_orderkey AS VARCHAR)) AS request_id, CAST(l_linenumber AS BIGINT) AS seq,
         CAST(floor(l_quantity) AS BIGINT) AS prompt_tokens, CAST(floor(l_extendedprice) AS BIGINT) % 1000 AS completion_tokens
  FROM lineitem
), first AS (
  SELECT request_id, arg_min(prompt_tokens, (seq, prompt_tokens, completion_tokens)) AS prompt_tokens,
         arg_min(completion_tokens, (seq, prompt_tokens, completion_tokens)) AS completion_tokens
  FROM comp GROUP BY request_id
)
SELECT persona_seed, count(*) AS n_requests, count(first.request_id) AS n_attached,
       count(*) - count(first.request_id) AS n_pending,
       CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens,
       CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens
FROM req LEFT JOIN first USING (request_id) GROUP BY persona_seed""")
def completion_attach(spark, sf_dir):
    t = Tables(spark, sf_dir)
    req = t.orders.select(F.md5(F.col("o_orderkey").cast("string")).alias("request_id"),
                          (F.col("o_custkey") / 100).cast("bigint").alias("persona_seed"))
    comp = t.lineitem.select(F.md5(F.col("l_orderkey").cast("string")).alias("request_id"),
                             F.col("l_linenumber").cast("bigint").alias("seq"),
                             F.lit("ok").alias("generation"),
                             F.floor("l_quantity").cast("bigint").alias("prompt_tokens"),
                             (F.floor("l_extendedprice").cast("bigint") % 1000).alias("completion_tokens"))
    # (order, line number) repeats in lineitem: tie-break on the token values
    a = W.attach_completions(req, comp, seq=["seq", "prompt_tokens", "completion_tokens"])
    return W.token_usage(a.rows, ["persona_seed"])


SHARDS = 200


@query("ntile_shards", f"""WITH s AS (
  SELECT o_orderkey, ntile({SHARDS}) OVER (ORDER BY o_orderkey) - 1 AS chunk_idx FROM orders
), lines AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
last AS (SELECT ({SHARDS} * count(*) FILTER (WHERE o_orderstatus = 'F')) // count(*) - 1 AS last_idx FROM orders)
SELECT CAST(chunk_idx AS BIGINT) AS chunk_idx, count(*) AS n_orders, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_lines,
       min(o_orderkey) AS min_orderkey, max(o_orderkey) AS max_orderkey,
       CAST(chunk_idx > (SELECT last_idx FROM last) AS BIGINT) AS pending
FROM s LEFT JOIN lines ON l_orderkey = o_orderkey GROUP BY chunk_idx""")
def ntile_shards(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t.orders.select("o_orderkey")
    nrows = o.count()
    sharded = W.shard(o, ["o_orderkey"], quantile_bucket(o, "o_orderkey", default_buckets(nrows, 20_000)), SHARDS)
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    last = t.orders.agg(((F.count_if(F.col("o_orderstatus") == "F") * SHARDS) / F.count("*")).cast("bigint") - 1) \
        .scalar()
    per = sharded.join(lines, sharded["o_orderkey"] == lines["l_orderkey"], "left").groupBy("chunk_idx").agg(
        F.count("*").alias("n_orders"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.min("o_orderkey").alias("min_orderkey"), F.max("o_orderkey").alias("max_orderkey"))
    todo = W.resume_filter(per, last).select("chunk_idx", F.lit(1).cast("bigint").alias("pending"))
    return per.join(todo, "chunk_idx", "left").withColumn("pending", F.coalesce("pending", F.lit(0).cast("bigint")))


@query("seed_buckets", f"""SELECT p_partkey, pos, pos // 100 AS persona_seed FROM (
  SELECT p_partkey, row_number() OVER (ORDER BY {sql_order_key(42, 'seed', 'p_partkey')}) - 1 AS pos FROM part)""")
def seed_buckets(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select("p_partkey").withColumn("_k", order_key(42, "seed", "p_partkey"))
    out = W.seed_buckets(p, ["_k"], hex_bucket("_k", hex_digits(p.count())))
    return out.select("p_partkey", "pos", "persona_seed")
