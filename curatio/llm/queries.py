"""Registered queries of the operators, each over its whole table, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatio.llm import (attention_lm, ball_tree, chunk_dedup, fingerprints, kmeans_tree, mixing, quality_classifier, quality_rules,
                         sentencepiece_codec, simhash, spelling_variants, suffix_dedup, url_filter)
from curatio.functions.draws import sql_hash32
from curatio.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


# fixed values: the contract's rules
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]


@query("op2_url_filter")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


MIX_SQL = f"""WITH z AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM z GROUP BY source
), o AS (
  SELECT *, 2.0::DOUBLE * source_size / w AS r, sum(source_size) OVER () AS total,
         coalesce(sum(source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
         sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * CAST(total AS DOUBLE) - 2.0::DOUBLE * CAST(stopped AS DOUBLE)) / CAST(others AS DOUBLE) AS level FROM o
), t AS (
  SELECT source, source_size, CASE WHEN 2.0::DOUBLE * source_size < v * w THEN 2.0::DOUBLE * source_size ELSE v * w END AS target
  FROM s, (SELECT level AS v FROM l WHERE level <= r ORDER BY r, source LIMIT 1)
)
SELECT z.doc_id, z.size, t.source_size, t.target, CAST(z.size * (floor(target / t.source_size)
  + CAST(CAST({sql_hash32(9, 'mix', 'z.doc_id')} AS DOUBLE) / 4294967296.0::DOUBLE < target / t.source_size - floor(target / t.source_size) AS INT)) AS BIGINT) AS taken
FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source"""


@query("op9_mix_sources", MIX_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.copies(docs).select("doc_id", "size", "source_size", "target",
                                      (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))


RULES_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d
), u AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w
), tri AS (SELECT rid, i, x, lead(x, 1) OVER q AS y, lead(x, 2) OVER q AS z FROM u WINDOW q AS (PARTITION BY rid ORDER BY i)
), twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x, y, z) AS n FROM tri WHERE z IS NOT NULL
), cover AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY rid
), c AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words, len(ls) AS n_lines,
         len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in quality_rules.STOP_WORDS)}))) AS n_stop_words,
         length(t) - length(replace(t, '!', '')) AS n_bangs
  FROM w LEFT JOIN cover USING (rid)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND ({quality_rules.compile_rules(quality_rules.THRESHOLDS)}) AS kept FROM f"""


@query("op10_quality_rules", RULES_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs).drop("text", "n_lines", "n_stop_words", "n_bangs").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_imatch")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    terms = fingerprints.lexicon(docs)
    pairs = fingerprints.with_next(fingerprints.imatch(docs, out_col="fp", terms=terms), "doc_id", ["text", "fp"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = pairs.withColumn("n_chars", n.cast("bigint")).withColumn("edited", F.concat(
        F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    both = fingerprints.imatch(edited, "edited", "edited_fp", terms)
    return both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       F.expr(fingerprints.as_text("fp")).alias("fingerprint"),
                       F.expr(fingerprints.as_text("edited_fp")).alias("edited_fingerprint"),
                       F.expr(fingerprints.likeness("fp", "edited_fp")).alias("near_edited"),
                       F.expr(fingerprints.likeness("fp", "next_fp")).alias("near_next"))


def remainder(key: str, n: int):
    """crc32 of the key as text, modulo n (a null key counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_classifier.classify(docs, labels, train_filter=remainder("doc_id", 5) != 0) \
        .select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = sentencepiece_codec.encode(docs, decoded_col="decoded")
    return back.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))


@query("op4_chunk_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_dedup.deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "text")


@query("op6_suffix_repeats")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_attention_lm")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return attention_lm.score(docs, held_out=remainder("doc_id", 7) == 2)


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_variants.group_variants(docs, drop_every=97)


@query("op12_kmeans_tree")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return kmeans_tree.nearest(rows, F.col("vec_id") % 20 == 0, k=20)


TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {TERMS} AS ts FROM documents
), s AS (SELECT CAST(count(*) FILTER (len(ts) > 0) AS BIGINT) AS nd, CAST(sum(len(ts)) AS BIGINT) AS nt FROM d
), m AS (SELECT rid, doc_id, 25 + (75 * CAST(len(ts) AS BIGINT) * nd) // nt AS m FROM d, s WHERE len(ts) > 0
), i AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({TERMS}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL
), f AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY ALL
), w AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, s GROUP BY t, nd
), v AS (SELECT rid, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS v FROM f JOIN m USING (rid) JOIN w USING (t)
), r AS (SELECT item_id, rid, doc_id, CAST(sum(times * v) AS BIGINT) AS score FROM i JOIN v USING (t) GROUP BY ALL
), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, rid) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10"""


@query("op13_ball_tree", SEARCH_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ball_tree.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=10)
