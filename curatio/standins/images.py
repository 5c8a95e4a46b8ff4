"""Image-side queries: router parse over ``documents``, retrieval over
``embeddings``, key resolution and catalogs over ``pages`` / ``customer`` /
``documents`` / ``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from curatio.operators import knn
from curatio.plans import images as I
from curatio.sources.testdata import Tables
from curatio.standins import sqlutil as S
from curatio.standins.registry import query

P = "Personalized Text-to-Image Generator"
MARK = "Modified Image Description:"


def router_outputs(docs):
    """Router completions planted by ``doc_id % 8`` around the whole document text."""
    m, text = F.col("doc_id") % 8, F.col("text")
    gen = (F.when(m == 0, F.concat(F.lit(f"Module: {P}\n{MARK} "), text))
           .when(m == 1, F.concat(F.lit(f"{P}\n{MARK}  A photo of a person [img] "), text))
           .when(m == 2, F.concat(F.lit(f"Module: {P}\n{MARK} x [img] y [img]  "), text, F.lit(" [img] z")))
           .when(m == 3, F.concat(F.lit(f"Module: {P}\nNo description here: "), text))
           .when(m == 4, F.concat(F.lit("Module: Image Database Retrieval\n"), text))
           .when(m == 5, F.concat(F.lit(f"Module: Web Search\n{MARK} "), text))
           .when(m == 6, F.concat(F.lit("Module: Text-to-Image Generator\n"), text))
           .otherwise(F.concat(F.lit("Module: "), text)))
    return docs.select("doc_id", gen.alias("generation"))


_SP = r"[\s\x0B\x1c-\x1f\x85\p{Z}]"
_G = S.py_strip("replace(generation, 'Module:', '')")
_RE = r"(?s)(.*)\nModified Image Description:" + _SP + r"*(.*)"


def _first_module(x: str) -> str:
    return ("CASE " + " ".join(f"WHEN contains({x}, {S.lit(n)}) THEN {S.lit(n)}" for n in
                               ["Personalized Text-to-Image Generator", "Image Database Retrieval", "Web Search"])
            + " END")


def _code(x: str) -> str:
    return ("CASE " + " ".join(f"WHEN {x} = {S.lit(k)} THEN {S.lit(v)}" for k, v in
                               {"Text-to-Image Generator": "t2i", P: "p-t2i", "Web Search": "web",
                                "Image Database Retrieval": "retrieval"}.items()) + " END")


_IMG = f"""CASE WHEN len(string_split(d, '[img]')) = 1 THEN d || ' [img]'
  WHEN len(string_split(d, '[img]')) = 2 THEN d
  ELSE string_split(d, '[img]')[1] || '[img]' || string_split(d, '[img]')[2]
       || array_to_string(list_transform(list_slice(string_split(d, '[img]'), 3, len(string_split(d, '[img]'))),
                                         lambda z: {S.py_strip('z')}), ' ') END"""


@query("route_parse", f"""WITH g0 AS (
  SELECT doc_id, CASE doc_id % 8
    WHEN 0 THEN 'Module: {P}' || chr(10) || '{MARK} ' || text
    WHEN 1 THEN '{P}' || chr(10) || '{MARK}  A photo of a person [img] ' || text
    WHEN 2 THEN 'Module: {P}' || chr(10) || '{MARK} x [img] y [img]  ' || text || ' [img] z'
    WHEN 3 THEN 'Module: {P}' || chr(10) || 'No description here: ' || text
    WHEN 4 THEN 'Module: Image Database Retrieval' || chr(10) || text
    WHEN 5 THEN 'Module: Web Search' || chr(10) || '{MARK} ' || text
    WHEN 6 THEN 'Module: Text-to-Image Generator' || chr(10) || text
    ELSE 'Module: ' || text END AS generation FROM documents
), g1 AS (SELECT doc_id, {_G} AS g FROM g0),
g2 AS (
  SELECT *, contains(g, '{P}') AS pers, regexp_matches(g, '{_RE}') AS matched,
         regexp_extract(g, '{_RE}', 1) AS mod_part, regexp_extract(g, '{_RE}', 2) AS d,
         CASE WHEN contains(g, 'Modified Image Description') THEN {S.py_strip("split_part(g, 'Modified Image Description: ', 1)")} ELSE g END AS cut
  FROM g1
), g3 AS (
  SELECT *, {_first_module('mod_part')} AS p_module, coalesce({_first_module('cut')}, cut) AS plain FROM g2
), g4 AS (
  SELECT doc_id,
    CASE WHEN pers AND NOT matched THEN 'no_description' WHEN pers AND p_module IS NULL THEN 'no_module' END AS reject_reason,
    CASE WHEN pers THEN {_code('p_module')} ELSE coalesce({_code('plain')}, 't2i') END AS module,
    CASE WHEN pers THEN CASE WHEN matched AND p_module IS NOT NULL THEN replace({_IMG}, '[img]', 'img') END ELSE '' END AS modified
  FROM g3
)
SELECT doc_id, CASE WHEN reject_reason IS NULL THEN module END AS image_alignment_module,
       modified AS modified_image_description, reject_reason FROM g4""")
def route_parse(spark, sf_dir):
    r = I.route_parse(router_outputs(Tables(spark, sf_dir).documents))
    return r.select("doc_id", "image_alignment_module", "modified_image_description", "reject_reason")


def _image_db(emb):
    return emb.select(F.concat(F.lit("src"), F.col("label").cast("string")).alias("source"), "vec_id",
                      F.col("embedding").alias("vec"),
                      F.concat(F.lit("img/"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string"),
                               F.lit(".jpg")).alias("image_path"))


@query("retrieve_topk", """WITH q AS (
  SELECT vec_id AS qid, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS qv
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
), d AS (SELECT 'src' || CAST(label AS VARCHAR) AS source, vec_id, CAST(embedding AS DOUBLE[]) AS dv,
                'img/' || CAST(label AS VARCHAR) || '/' || CAST(vec_id AS VARCHAR) || '.jpg' AS image_path FROM embeddings),
s AS (SELECT qid, source, vec_id, image_path, list_dot_product(qv, dv) AS score FROM q, d),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT qid, source, CAST(rank AS BIGINT) AS rank, vec_id, image_path, round(score, 6) AS score FROM r WHERE rank <= 5""")
def retrieve_topk(spark, sf_dir):
    """J10 alone: every image embedding is also a query (normalised, X17); top-5 per source."""
    return _retrieve_all(spark, sf_dir)


def _retrieve_all(spark, sf_dir, **scan):
    emb = Tables(spark, sf_dir).embeddings
    queries = emb.select(F.col("vec_id").alias("qid"), knn.l2_normalise(F.col("embedding")).alias("qvec"))
    top = knn.topk_per_source(queries, _image_db(emb), k=5, carry=("image_path",), **scan)
    return top.select("qid", "source", "rank", "vec_id", "image_path", F.round("score", 6).alias("score"))


MODULES = ["t2i", "p-t2i", "web", "retrieval", "t2i"]


@query("retrieve_images", """WITH req AS (
  SELECT 'img-' || CAST(vec_id AS VARCHAR) AS image_uuid, (['t2i', 'p-t2i', 'web', 'retrieval', 't2i'])[vec_id % 5 + 1] AS image_alignment_module,
         CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), q AS (
  SELECT image_uuid, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS qv
  FROM req WHERE image_alignment_module = 'retrieval'
), d AS (SELECT 'src' || CAST(label AS VARCHAR) AS source, vec_id, CAST(embedding AS DOUBLE[]) AS dv,
                'img/' || CAST(label AS VARCHAR) || '/' || CAST(vec_id AS VARCHAR) || '.jpg' AS image_path FROM embeddings),
s AS (SELECT image_uuid, source, vec_id, image_path, list_dot_product(qv, dv) AS score FROM q, d),
r AS (SELECT *, row_number() OVER (PARTITION BY image_uuid, source ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT req.image_uuid, image_alignment_module, source, CAST(coalesce(rank, 0) AS BIGINT) AS rank, image_path AS image_path_from_db,
       round(score, 6) AS clip_score
FROM req LEFT JOIN (SELECT * FROM r WHERE rank <= 5) r ON r.image_uuid = req.image_uuid""")
def retrieve_images(spark, sf_dir):
    """C14: each embedding is an image request, its module by ``vec_id % 5``; only those routed to the image
    database are searched, the others come back untouched (one row without a source, rank 0)."""
    emb = Tables(spark, sf_dir).embeddings
    uuid = F.concat(F.lit("img-"), F.col("vec_id").cast("string")).alias("image_uuid")
    requests = emb.select(uuid, F.element_at(F.array(*[F.lit(m) for m in MODULES]), (F.col("vec_id") % 5 + 1).cast("int"))
                          .alias("image_alignment_module"))
    out = I.retrieve_images(requests, emb.select(uuid, F.col("embedding").alias("vec")), _image_db(emb))
    per = out.select("image_uuid", "image_alignment_module", F.explode_outer("db_searched_results").alias("source", "hits"))
    rows = per.select("image_uuid", "image_alignment_module", "source", F.posexplode_outer("hits").alias("pos", "hit"))
    return rows.select("image_uuid", "image_alignment_module", "source", F.coalesce(F.col("pos") + 1, F.lit(0)).cast("bigint").alias("rank"),
                       "hit.image_path_from_db", F.round(F.col("hit.clip_score").cast("double"), 6).alias("clip_score"))


def _retrieve_batches(spark, sf_dir):
    """The same rows in several query batches (one scan of the vectors each)."""
    return _retrieve_all(spark, sf_dir, batch_bytes=300_000)


def _keys(conv, sizes: tuple[int, int, int]):
    """Keys over the whole id range of the three tables and a few ids beyond (dangling)."""
    k = F.col("conv_id") * 8 + F.col("turn")
    kind = k % 3
    ident = (k % F.when(kind == 0, sizes[0]).when(kind == 1, sizes[1]).otherwise(sizes[2])).cast("string")
    key = F.when(kind == 0, F.concat(F.lit("url:"), ident)).when(kind == 1, F.concat(F.lit("face:"), ident)) \
        .otherwise(ident)
    return conv.select("conv_id", "turn", key.alias("key"))


@query("resolve_image_keys", """WITH k AS (
  SELECT conv_id, turn, CASE (conv_id * 8 + turn) % 3 WHEN 0 THEN 'url:' || CAST((conv_id * 8 + turn) % (SELECT max(page_id) + 11 FROM pages) AS VARCHAR)
                             WHEN 1 THEN 'face:' || CAST((conv_id * 8 + turn) % (SELECT max(c_custkey) + 11 FROM customer) AS VARCHAR)
                             ELSE CAST((conv_id * 8 + turn) % (SELECT max(vec_id) + 11 FROM embeddings) AS VARCHAR) END AS key FROM conversations
), k2 AS (
  SELECT *, CASE WHEN starts_with(key, 'url:') THEN 'url' WHEN starts_with(key, 'face:') THEN 'face' ELSE 'image' END AS kind,
         TRY_CAST(CASE WHEN starts_with(key, 'url:') THEN substr(key, 5) WHEN starts_with(key, 'face:') THEN substr(key, 6)
                       ELSE key END AS BIGINT) AS id FROM k
)
SELECT conv_id, turn, key, kind,
  CASE kind WHEN 'url' THEN p.url WHEN 'face' THEN f.location ELSE e.location END AS resolved,
  CASE WHEN (CASE kind WHEN 'url' THEN p.url WHEN 'face' THEN f.location ELSE e.location END) IS NULL
       THEN 'dangling' ELSE 'resolved' END AS status
FROM k2
LEFT JOIN pages p ON k2.kind = 'url' AND p.page_id = k2.id
LEFT JOIN (SELECT c_custkey AS id, 'faces/' || CAST(c_custkey AS VARCHAR) || '.png' AS location FROM customer) f
  ON k2.kind = 'face' AND f.id = k2.id
LEFT JOIN (SELECT vec_id AS id, 'img/' || CAST(label AS VARCHAR) || '/' || CAST(vec_id AS VARCHAR) || '.jpg' AS location FROM embeddings) e
  ON k2.kind = 'image' AND e.id = k2.id""")
def resolve_image_keys(spark, sf_dir):
    t = Tables(spark, sf_dir)
    images = _image_db(t.embeddings).select(F.col("vec_id").alias("id"), F.col("image_path").alias("location"))
    pages = t.pages.select(F.col("page_id").alias("id"), F.col("url").alias("location"))
    faces = t.customer.select(F.col("c_custkey").alias("id"),
                              F.concat(F.lit("faces/"), F.col("c_custkey").cast("string"), F.lit(".png")).alias("location"))
    sizes = tuple(df.agg(F.max("id")).first()[0] + 11 for df in (pages, faces, images))
    r = I.resolve_image_keys(_keys(t.conversations, sizes), images, pages, faces)
    return r.select("conv_id", "turn", "key", "kind", "resolved", "status")


@query("catalog_union", """SELECT * FROM (
  SELECT 'web' AS source, url || CASE WHEN page_id % 3 = 0 THEN '/image.jpg' ELSE '/index.html' END AS path,
         CAST(page_id AS VARCHAR) AS key FROM pages
  UNION ALL
  SELECT source, 'images/' || source || '/' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '.jpg' ELSE '.png' END,
         CAST(doc_id AS VARCHAR) FROM documents
  UNION ALL
  SELECT 'src' || CAST(label AS VARCHAR), 'img/' || CAST(label AS VARCHAR) || '/' || CAST(vec_id AS VARCHAR) || '.jpg',
         CAST(vec_id AS VARCHAR) FROM embeddings
) WHERE contains(path, '.jpg')""")
def catalog_union(spark, sf_dir):
    t = Tables(spark, sf_dir)
    web = t.pages.select(F.lit("web").alias("source"),
                         F.concat("url", F.when(F.col("page_id") % 3 == 0, F.lit("/image.jpg"))
                                  .otherwise(F.lit("/index.html"))).alias("path"),
                         F.col("page_id").cast("string").alias("key"))
    docs = t.documents.select("source", F.concat(F.lit("images/"), "source", F.lit("/"), F.col("doc_id").cast("string"),
                                                 F.when(F.col("doc_id") % 2 == 0, F.lit(".jpg")).otherwise(F.lit(".png")))
                              .alias("path"), F.col("doc_id").cast("string").alias("key"))
    emb = _image_db(t.embeddings).select("source", F.col("image_path").alias("path"),
                                         F.col("vec_id").cast("string").alias("key"))
    return I.image_catalog([web, docs, emb])


def _register_batches():
    from curatio.standins.registry import QUERIES
    query("retrieve_topk_ivf", QUERIES["retrieve_topk"][1])(_retrieve_batches)


_register_batches()
