"""Scalar text functions, sampling and pairing over ``documents`` / ``part`` /
``customer`` / ``supplier``. Every query reads the whole text column."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatio import constants as K
from curatio.functions import text as T
from curatio.functions.draws import order_key, sql_order_key
from curatio.operators import core
from curatio.operators.core import dedupe_first, prefix_columns
from curatio.sources.testdata import Tables
from curatio.standins import sqlutil as S
from curatio.standins.registry import query


@query("text_primitives", f"""SELECT doc_id,
  lower(text) AS text_lower,
  {S.py_strip('text')} AS text_strip,
  {S.nodot(S.py_strip('text'))} AS text_nodot,
  CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS text_count_the,
  CAST(contains(text, chr(10)) AS BIGINT) AS text_has_newline,
  CAST(starts_with(text, 'The') AS BIGINT) AS text_starts_the,
  replace(text, chr(10), ' ') AS text_one_line
FROM documents""")
def text_primitives(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    out = d.select("doc_id",
                   F.lower("text").alias("lower"),
                   T.py_strip("text").alias("strip"),
                   T.drop_final_dot(T.py_strip("text")).alias("nodot"),
                   T.count_substr("text", "the").alias("count_the"),
                   F.col("text").contains("\n").cast("bigint").alias("has_newline"),
                   F.col("text").startswith("The").cast("bigint").alias("starts_the"),
                   F.replace("text", F.lit("\n"), F.lit(" ")).alias("one_line"))
    return prefix_columns(out, [c for c in out.columns if c != "doc_id"], "text_")


@query("sample_n", f"""SELECT doc_id, n_chars, lang FROM documents
ORDER BY {sql_order_key(42, 'sample', 'doc_id')} LIMIT 100""")
def sample_n(spark, sf_dir):
    """O3: a seeded sample of 100 documents (the limit is the operator)."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "n_chars", "lang")
    return d.orderBy(order_key(42, "sample", "doc_id")).limit(100)


@query("sample_share", f"""SELECT doc_id, n_chars, lang FROM (
  SELECT *, row_number() OVER (ORDER BY {sql_order_key(43, 'share', 'doc_id')}) AS r, count(*) OVER () AS n FROM documents) WHERE r <= n // 10""")
def sample_share(spark, sf_dir):
    """O3 for a large n: a tenth of all documents, by counts per key range and one filter."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "n_chars", "lang")
    return core.sample_n(d, d.count() // 10, order_key(43, "share", "doc_id"))


@query("utf8_repair", "SELECT doc_id, text || chr(65533) || '!' AS text, CAST(0 AS BIGINT) AS was_valid FROM documents")
def utf8_repair(spark, sf_dir):
    """Documents as bytes with a broken byte before the end."""
    raw = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF21")))
    d = Tables(spark, sf_dir).documents.select("doc_id", raw.alias("raw"))
    return d.select("doc_id", T.repair_utf8("raw").alias("text"), T.is_valid_utf8("raw").cast("bigint").alias("was_valid"))


def _tagged(d):
    m = F.col("doc_id") % 3
    return d.select("doc_id", F.when(m == 0, F.concat(F.lit("<RET> <h>"), "text", F.lit("</h> trailing")))
                    .when(m == 1, F.concat(F.lit("prefix <h>a</h> <h>"), "text", F.lit("</h>")))
                    .otherwise(F.concat(F.lit("<RET><h>first</h><h> "), "text", F.lit(" </h> end"))).alias("output"))


@query("ret_tag_extract", f"""WITH t AS (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<RET> <h>' || text || '</h> trailing'
                                 WHEN 1 THEN 'prefix <h>a</h> <h>' || text || '</h>'
                                 ELSE '<RET><h>first</h><h> ' || text || ' </h> end' END AS output FROM documents
)
SELECT doc_id, CASE WHEN contains(output, '<RET>')
                    THEN {S.py_strip(S.first_before(S.last_after('output', "'<h>'"), "'</h>'"))}
                    ELSE output END AS extracted FROM t""")
def ret_tag_extract(spark, sf_dir):
    return _tagged(Tables(spark, sf_dir).documents).select("doc_id", T.ret_tag_extract("output").alias("extracted"))


@query("name_similarity", """SELECT c_custkey, s_suppkey,
  round(1 - CAST(levenshtein(c_name, s_name) AS DOUBLE) / greatest(length(c_name), length(s_name)), 6) AS similarity
FROM customer JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier)""")
def name_similarity(spark, sf_dir):
    """X13 between each customer name and the supplier at ``c_custkey % |supplier|``
    (an equi-join on a computed key, not a pairing of all names)."""
    t = Tables(spark, sf_dir)
    s = t.supplier.select("s_suppkey", "s_name")
    n = s.select(F.count("*")).scalar()
    c = t.customer.select("c_custkey", "c_name").withColumn("_k", F.col("c_custkey") % n)
    j = c.join(s, c["_k"] == s["s_suppkey"])
    return j.select("c_custkey", "s_suppkey", F.round(T.norm_similarity("c_name", "s_name"), 6).alias("similarity"))


@query("nli_pairs", """SELECT CAST(p_partkey // 32 AS BIGINT) AS batch_id, count(*) AS n_items,
  string_agg('I like the ' || p_name || ' from ' || p_brand || ' || This sentence is about ' || lower('Brand') || '.',
             chr(10) ORDER BY p_partkey) AS pairs
FROM part GROUP BY 1""")
def nli_pairs(spark, sf_dir):
    """X21 premise/hypothesis pairs collated into batches of 32."""
    p = Tables(spark, sf_dir).part.select(
        "p_partkey", F.concat(F.lit("I like the "), "p_name", F.lit(" from "), "p_brand").alias("premise"),
        T.render(K.NLI_HYPOTHESIS, key=F.lower(F.lit("Brand"))).alias("hypothesis"))
    b = p.withColumn("batch_id", (F.col("p_partkey") / 32).cast("bigint"))
    return b.groupBy("batch_id").agg(
        F.count("*").alias("n_items"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
            "p_partkey", F.concat_ws(" || ", "premise", "hypothesis").alias("v")))), lambda e: e["v"]), "\n")
        .alias("pairs"))


@query("one_per_category", f"""SELECT p_type, arg_min(p_partkey, {sql_order_key(42, 'pick', 'p_type', 'p_partkey')}) AS p_partkey
FROM part GROUP BY p_type""")
def one_per_category(spark, sf_dir):
    """One seeded-random row per category (partial+final min_by, no window)."""
    p = Tables(spark, sf_dir).part.select("p_type", "p_partkey") \
        .withColumn("_o", order_key(42, "pick", "p_type", "p_partkey"))
    return dedupe_first(p, ["p_type"], ["_o"]).select("p_type", "p_partkey")
