"""C13 router parse, C20 image catalog, C21 image-key resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatio import constants as K
from curatio.functions import text as T


def module_code(name: Column) -> Column:
    """Router label → module code (NULL if unknown)."""
    out = F.lit(None).cast("string")
    for label, code in K.MODULE_CODES.items():
        out = F.when(name == label, F.lit(code)).otherwise(out)
    return out


def first_module_in(text: Column) -> Column:
    """First module name of the fixed search order contained in ``text`` (NULL if none)."""
    out = F.lit(None).cast("string")
    for name in reversed(K.ROUTER_SEARCH_ORDER):
        out = F.when(text.contains(name), F.lit(name)).otherwise(out)
    return out


def repair_img_tags(desc: Column) -> Column:
    """0 ``[img]`` → append one; 1 → keep; >1 → keep the first, strip and join the
    tail pieces; finally ``[img]`` → ``img``."""
    a = F.split(desc, r"\[img\]", -1)
    n = F.size(a)
    many = F.concat(F.get(a, 0), F.lit("[img]"), F.get(a, 1),
                    F.array_join(F.transform(F.slice(a, 3, 1 << 30), lambda z: T.py_strip(z)), " "))
    fixed = F.when(n == 1, F.concat(desc, F.lit(" [img]"))).when(n == 2, desc).otherwise(many)
    return F.replace(fixed, F.lit("[img]"), F.lit("img"))


def route_parse(gen: DataFrame, generation_col: str = "generation") -> DataFrame:
    """C13 parse → ``image_alignment_module``, ``modified_image_description``,
    ``reject_reason`` (``no_description`` / ``no_module`` where the source fails)."""
    g = T.py_strip(F.replace(F.col(generation_col), F.lit("Module:"), F.lit("")))
    x = gen.withColumn("_g", g)
    g = F.col("_g")
    personalised = g.contains("Personalized Text-to-Image Generator")
    # "(.*)\n<marker><spaces>(.*)" over all lines without a backtracking regex (a failing search
    # over a long text is quadratic in java.util.regex): it matches iff the marker occurs;
    # the greedy module group ends at the *last* marker; the description is the rest
    # after leading whitespace.
    marker = "\n" + K.ROUTER_DESCRIPTION_MARK
    matched = g.contains(marker)
    after = F.substring_index(g, marker, -1)
    mod_part = F.substring(g, F.lit(1), F.length(g) - F.length(after) - len(marker))
    desc = F.regexp_replace(after, "^" + T.PY_SPACE + "+", "")
    p_module = first_module_in(mod_part)
    # non-personalised: cut at the marker, then the first known module name, else the text itself
    cut = F.when(g.contains("Modified Image Description"),
                 T.py_strip(F.substring_index(g, "Modified Image Description: ", 1))).otherwise(g)
    plain = F.coalesce(first_module_in(cut), cut)
    module = (F.when(personalised, F.when(matched, module_code(p_module)))
              .otherwise(F.coalesce(module_code(plain), F.lit("t2i"))))
    modified = F.when(personalised, F.when(matched & p_module.isNotNull(), repair_img_tags(desc))).otherwise(F.lit(""))
    reason = F.when(personalised & ~matched, "no_description").when(personalised & p_module.isNull(), "no_module")
    return x.withColumn("image_alignment_module", F.when(reason.isNull(), module)) \
        .withColumn("modified_image_description", modified) \
        .withColumn("reject_reason", reason).drop("_g")


def retrieve_images(requests: DataFrame, vectors: DataFrame, db: DataFrame, k: int = 5, uuid_col: str = "image_uuid",
                    module_col: str = "image_alignment_module", **scan) -> DataFrame:
    """C14: requests of the image database get ``db_searched_results``, a map from source to its k best images
    (``image_path_from_db``, ``clip_score`` as text); all other requests stay as they are (null map), and so does
    a retrieval request without a vector.

    ``vectors``: ``(uuid, vec)``, the text embedding of each request (normalised here, X17); ``db``: ``(source,
    vec_id, vec, image_path)``. Only retrieval requests are searched (F11); queries in bounded batches;
    the k winners per source carry their path (J9) and are nested per request (k and the sources bound the nest)."""
    from curatio.operators import knn
    from curatio.plans.worklist import backend_of
    target = requests.filter(backend_of(module_col) == "image_db").select(F.col(uuid_col).alias("qid"))
    asked = target.join(vectors.select(F.col(uuid_col).alias("qid"), knn.l2_normalise(F.col("vec")).alias("qvec")), "qid").distinct()
    top = knn.topk_per_source(asked, db, k, carry=("image_path",), **scan)
    hit = F.struct("rank", F.col("image_path").alias("image_path_from_db"), F.col("score").cast("string").alias("clip_score"))
    per_source = top.groupBy("qid", "source").agg(F.transform(F.array_sort(F.collect_list(hit)), lambda h: h.dropFields("rank")).alias("hits"))
    found = per_source.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("source", "hits"))).alias("db_searched_results"))
    return requests.join(found.withColumnRenamed("qid", uuid_col), uuid_col, "left")


def resolve_image_keys(keys: DataFrame, images: DataFrame, pages: DataFrame, faces: DataFrame,
                       key_col: str = "key") -> DataFrame:
    """Keys ``url:<id>`` → pages, ``face:<id>`` → faces, plain ``<id>`` → images.

    Each kind is one equi-join on the parsed id (three joins, one union);
    keys with no target come back with ``status = 'dangling'`` (left join)."""
    k = F.col(key_col)
    kind = F.when(k.startswith("url:"), "url").when(k.startswith("face:"), "face").otherwise("image")
    ident = F.when(k.startswith("url:"), F.substring_index(k, "url:", -1)) \
        .when(k.startswith("face:"), F.substring_index(k, "face:", -1)).otherwise(k)
    from curatio.operators.core import spread_null_key
    # unparsable ids (NULL) get spread negative keys: no hot reducer, still no match
    x = keys.withColumn("kind", kind).withColumn("_id", spread_null_key(ident.try_cast("bigint"), key_col))
    parts = []
    for name, target in (("url", pages), ("face", faces), ("image", images)):
        t = target.select(F.col("id").cast("bigint").alias("_id"), F.col("location").alias("resolved"))
        parts.append(x.filter(F.col("kind") == name).join(t, "_id", "left"))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("status", F.when(F.col("resolved").isNull(), "dangling").otherwise("resolved")).drop("_id")


def image_catalog(sources: list[DataFrame], path_col: str = "path", ext: str = ".jpg") -> DataFrame:
    """C20: union of per-source listings, kept to image files."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out.filter(F.col(path_col).contains(ext))
