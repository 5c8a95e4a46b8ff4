"""Round trips of the readers and writers: a driver table is written the way a stage writes it (in the session's
shared folder) and read back by the source of the same kind; the rows that come back are the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatio.functions.draws import order_key, sql_order_key
from curatio.operators.core import report
from curatio.operators.position import hex_bucket, hex_digits
from curatio.plans import images as I
from curatio.plans import worklist as W
from curatio.session import scratch_path
from curatio.sources import io
from curatio.sources.testdata import Tables
from curatio.standins.registry import query


@query("seed_documents", f"""WITH p AS (
  SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment, row_number() OVER (ORDER BY {sql_order_key(42, 'doc', 'c_custkey')}) - 1 AS pos
  FROM customer
)
SELECT c_custkey, c_name || ' "é\\' || chr(10) || ']' AS text, coalesce(segment, '-') AS segment, CAST(pos AS BIGINT) AS pos, CAST(pos // 100 AS INTEGER) AS persona_seed
FROM p""")
def seed_documents(spark, sf_dir):
    """K6 seeds of 100 rows, each written as one JSON-array document (K2) and read back (S1) with its seed."""
    cust = Tables(spark, sf_dir).customer.withColumn("_k", order_key(42, "doc", "c_custkey"))
    seeds = W.seed_buckets(cust, ["_k"], hex_bucket("_k", hex_digits(cust.count()))).select(
        "c_custkey", F.concat("c_name", F.lit(' "é\\\n]')).alias("text"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"), "pos", "persona_seed")
    path = scratch_path(spark, "documents")
    io.write_json_documents(seeds, path, order=["pos"])
    back = io.read_json_array(spark, path, "c_custkey bigint, text string, segment string, pos bigint, persona_seed int")
    return back.withColumn("segment", F.coalesce("segment", F.lit("-")))


@query("seed_texts", f"""WITH p AS (
  SELECT c_name || ' "é\\' || c_mktsegment AS line, row_number() OVER (ORDER BY {sql_order_key(42, 'text', 'c_custkey')}) - 1 AS pos FROM customer
)
SELECT CAST(pos // 100 AS INTEGER) AS persona_seed, count(*) AS n_lines, string_agg(line || chr(10), '' ORDER BY pos) AS text FROM p GROUP BY 1""")
def seed_texts(spark, sf_dir):
    """Seeds of 100 rows, each the lines of one text file, read back whole (S3): no text is longer than a seed."""
    cust = Tables(spark, sf_dir).customer.withColumn("_k", order_key(42, "text", "c_custkey"))
    seeds = W.seed_buckets(cust, ["_k"], hex_bucket("_k", hex_digits(cust.count())))
    path = scratch_path(spark, "texts")
    io.write_text_files(seeds.withColumn("value", F.concat("c_name", F.lit(' "é\\'), "c_mktsegment")), path, "persona_seed", ["pos"])
    whole = io.read_whole_text(spark, path)
    return whole.select(F.col("persona_seed").cast("int").alias("persona_seed"),
                        F.regexp_count("value", F.lit("\n")).cast("bigint").alias("n_lines"), F.col("value").alias("text"))


@query("report_file", """SELECT metric, CAST(value AS BIGINT) AS value FROM (
  SELECT unnest(['total', 'short', 'not: en', 'characters']) AS metric, unnest([n, short, other, chars]) AS value
  FROM (SELECT count(*) AS n, count(*) FILTER (WHERE length(text) < 200) AS short, count(*) FILTER (WHERE lang <> 'en') AS other,
    coalesce(sum(length(text)), 0) AS chars FROM documents))""")
def report_file(spark, sf_dir):
    """A stage's counts (A1) as a file of ``metric<TAB>value`` lines (K4), written twice and read back."""
    docs = Tables(spark, sf_dir).documents
    counts = report(docs, "documents", {
        "total": F.count("*"), "short": F.count_if(F.length("text") < 200), "not: en": F.count_if(F.col("lang") != "en"),
        "characters": F.coalesce(F.sum(F.length("text")), F.lit(0))})
    path = scratch_path(spark, "report")
    for _ in range(2):                                                                     # a rerun leaves one report
        io.write_report(counts, path)
    return io.read_report(spark, path)


@query("seed_tree","""SELECT c_custkey, c_name, CAST(c_custkey % 7 AS INTEGER) AS persona_seed, CAST(c_custkey % 3 AS INTEGER) AS session_num
FROM customer""")
def seed_tree(spark, sf_dir):
    """A partition tree read seed by seed: for each the files of the others are listed, not opened."""
    cust = Tables(spark, sf_dir).customer.select("c_custkey", "c_name", (F.col("c_custkey") % 7).alias("persona_seed"), (F.col("c_custkey") % 3).alias("session_num"))
    path = scratch_path(spark, "tree")
    io.write_table(cust, path, "json", ["persona_seed", "session_num"])
    out = None
    for seed in range(7):
        one = io.read_partition_tree(spark, path, "c_custkey bigint, c_name string", only={"persona_seed": seed})
        out = one if out is None else out.unionByName(one)
    return out


@query("json_lines", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_lines(spark, sf_dir):
    """Whole documents written as JSON lines (K1) and read strictly."""
    docs = Tables(spark, sf_dir).documents
    path = scratch_path(spark, "lines")
    io.write_table(docs, path, "json")
    return io.read_jsonl(spark, path, docs.schema)


@query("caption_tsv", """SELECT url, translate(html, chr(9) || chr(10) || chr(13) || chr(92), '    ') AS caption FROM pages
WHERE length(trim(translate(html, chr(9) || chr(10) || chr(13) || chr(92), '    '))) > 0""")
def caption_tsv(spark, sf_dir):
    """A header-less table of urls and captions (S6); tabs, line ends and backslashes of a page become blanks."""
    plain = F.translate("html", "\t\n\r\\", "    ")
    pages = Tables(spark, sf_dir).pages.select("url", plain.alias("caption")).filter(F.length(F.trim("caption")) > 0)
    path = scratch_path(spark, "tsv")
    pages.select(F.concat_ws("\t", "url", "caption").alias("value")).write.text(path)
    return io.read_caption_tsv(spark, path)


@query("image_db_parts", """SELECT 'src' || CAST(label AS VARCHAR) AS source, vec_id, CAST(len(embedding) AS BIGINT) AS dims,
  round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings""")
def image_db_parts(spark, sf_dir):
    """Each source's vectors in a folder of parts, read together and tagged."""
    emb = Tables(spark, sf_dir).embeddings
    path = scratch_path(spark, "parts")
    io.write_table(emb.select("vec_id", "embedding", "label"), path, partition_by=["label"])
    labels = [r[0] for r in emb.select("label").distinct().collect()]                      # one per source
    db = io.read_image_db(spark, {f"src{n}": f"{path}/label={n}" for n in labels})
    return db.select("source", "vec_id", F.size("embedding").cast("bigint").alias("dims"),
                     F.round(F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("image_listing", """SELECT DISTINCT 'd' || CAST(doc_id % 40 AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN '.png' ELSE '.jpg' END AS name, 'listed' AS status
FROM documents WHERE doc_id % 3 <> 0""")
def image_listing(spark, sf_dir):
    """Names of image files by listing a tree (S7, F4): one folder a name, as an image store has them."""
    docs = Tables(spark, sf_dir).documents
    name = F.concat(F.lit("d"), (F.col("doc_id") % 40).cast("string"), F.when(F.col("doc_id") % 3 == 0, ".png").otherwise(".jpg"))
    path = scratch_path(spark, "images")
    docs.select(name.alias("name"), F.col("doc_id").cast("string").alias("value")).repartition("name").write.partitionBy("name").text(path)
    listed = io.list_images(spark, path, "*.txt").select(F.regexp_extract("path", "name=([^/]+)", 1).alias("path"))
    return I.image_catalog([listed.distinct()]).select(F.col("path").alias("name"), F.lit("listed").alias("status"))


@query("rejects_by_reason", """SELECT doc_id, text, CASE WHEN length(text) < 200 THEN 'short' WHEN lang <> 'en' THEN 'language: ' || lang END AS reject_reason
FROM documents WHERE length(text) < 200 OR lang <> 'en'""")
def rejects_by_reason(spark, sf_dir):
    """Rejected rows in one folder a reason (K5), read back with it."""
    docs = Tables(spark, sf_dir).documents
    reason = F.when(F.length("text") < 200, "short").when(F.col("lang") != "en", F.concat(F.lit("language: "), "lang"))
    path = scratch_path(spark, "rejects")
    io.write_rejects(docs.select("doc_id", "text", reason.alias("reject_reason")), path)
    return io.read_or_empty(spark, path, "doc_id bigint, text string, reject_reason string")
