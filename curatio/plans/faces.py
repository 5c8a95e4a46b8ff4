"""Face attribute sentences (P11) and attaching them to episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatio import constants as K
from curatio.functions import text as T
from curatio.functions.draws import draw, order_key
from curatio.operators.position import hex_bucket, hex_digits, positions

ATTR_MAP_TYPE = "map<string,map<string,string>>"


def attribute_sentence(attr_json: Column, age: Column, gender: Column, birthplace: Column, style: Column,
                       strict: bool = False) -> Column:
    """P11 (second variant): ``A {style} shot, a {age}-years-old {gender} from {birthplace},``
    then per category in the JSON's own key order (skipping face / overall-style and a
    ``hair`` entry that has ``wears``) the non-empty values in the fixed key order, each
    after a space, the category's suffix word and a comma; trailing commas become '.'.

    Pure built-in expressions: ``from_json`` keeps key order in the map, ``map_entries``
    walks it, ``transform``/``filter``/``array_join`` build the text — no UDF."""
    m = F.from_json(attr_json, ATTR_MAP_TYPE)
    order = F.create_map(*[x for cat, keys in K.HUMAN_ATTR_KEY_ORDER.items()
                           for x in (F.lit(cat), F.array(*[F.lit(k) for k in keys]))])
    suffix = F.create_map(*[x for cat, s in K.HUMAN_ATTR_SUFFIX.items() for x in (F.lit(cat), F.lit(s))])
    entries = F.filter(F.map_entries(m), lambda e: ~e["key"].isin(*K.HUMAN_ATTR_SKIPPED)
                       & ~((e["key"] == "hair") & F.map_contains_key(e["value"], "wears")))

    def piece(e):
        keys = F.coalesce(order[e["key"]], F.array().cast("array<string>"))
        vals = F.filter(F.transform(keys, lambda k: e["value"][k]), lambda v: v.isNotNull() & (v != ""))
        return F.concat(F.array_join(F.transform(vals, lambda v: F.concat(F.lit(" "), v)), ""),
                        F.coalesce(suffix[e["key"]], F.lit("")), F.lit(","))
    head = F.concat(F.lit("A "), style, F.lit(" shot, a "), age.cast("string"), F.lit("-years-old "),
                    F.lower(gender), F.lit(" from "), birthplace, F.lit(","))
    body = F.concat(head, F.array_join(F.transform(entries, piece), ""))
    return F.concat(F.regexp_replace(body, ",+\\z", ""), F.lit("."))


def style_draw(seed, *keys) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in K.STYLE_TYPES]),
                        (draw(seed, "style", len(K.STYLE_TYPES), *keys) + 1).cast("int"))


def zip_sample(people: DataFrame, pool: DataFrame, seed: int, people_key: str, pool_key: str,
               strict: bool = True) -> DataFrame:
    """``random.sample(pool, n)`` zipped with the people: both sides are put in a
    seeded order, numbered with skew-safe global positions, and equi-joined on the
    position. With more people than pool rows ``strict`` raises, as the source does (two
    counts, returned as numbers); otherwise the people beyond the pool are kept with null
    pool columns."""
    n_people, n_pool = people.count(), pool.count()
    if strict and n_people > n_pool:
        raise ValueError(f"sample larger than population: {n_people} > {n_pool}")
    pk = people.withColumn("_o", order_key(seed, "zip_people", people_key))
    qk = pool.withColumn("_o", order_key(seed, "zip_pool", pool_key))
    pp = positions(pk, ["_o"], hex_bucket("_o", hex_digits(n_people)), pos_col="_pos").drop("_o")
    qq = positions(qk, ["_o"], hex_bucket("_o", hex_digits(n_pool)), pos_col="_pos").drop("_o")
    return pp.join(qq, "_pos", "left").drop("_pos")


def face_path(root: str, uid: Column) -> Column:
    """``<root>/<unique_id>.png``."""
    return F.concat(F.lit(root.rstrip("/") + "/"), uid, F.lit(".png"))


def attach_faces(episodes: DataFrame, pool: DataFrame, seed: int = 42, id_col: str = "unique_id",
                 pool_key: str = "attr_id", root: str = "faces", strict: bool = True) -> DataFrame:
    """C11: distinct episode ids (A6) ↔ sampled attribute rows (J5) → sentence
    and image path (P9) → joined back to every episode row (J6)."""
    ids = episodes.groupBy(id_col).agg(F.min(F.struct("age", "gender", "birthplace")).alias("_p")).select(id_col, "_p.*")
    z = zip_sample(ids, pool, seed, id_col, pool_key, strict)
    faces = z.select(id_col, attribute_sentence(F.col("attributes"), F.col("age"), F.col("gender"),
                                                F.col("birthplace"), style_draw(seed, id_col))
                     .alias("face_description"), face_path(root, F.col(id_col)).alias("face_image_path"))
    return episodes.join(faces, id_col)


def attribute_sentence_strict(attr_json: Column, age: Column, gender: Column, birthplace: Column,
                              style: Column) -> Column:
    """P11 first variant (C7 face requests): NULL where the source fails (a category
    without a key order, or ``hair`` with ``wears``); present values are kept even
    when empty (``None`` for a JSON null); exactly one trailing character is cut."""
    m = F.from_json(attr_json, ATTR_MAP_TYPE)
    order = F.create_map(*[x for cat, keys in K.HUMAN_ATTR_KEY_ORDER.items()
                           for x in (F.lit(cat), F.array(*[F.lit(k) for k in keys]))])
    suffix = F.create_map(*[x for cat, s in K.HUMAN_ATTR_SUFFIX.items() for x in (F.lit(cat), F.lit(s))])
    entries = F.filter(F.map_entries(m), lambda e: ~e["key"].isin(*K.HUMAN_ATTR_SKIPPED))
    invalid = F.exists(entries, lambda e: ~F.map_contains_key(order, e["key"])
                       | ((e["key"] == "hair") & F.map_contains_key(e["value"], "wears")))

    def piece(e):
        keys = F.filter(F.coalesce(order[e["key"]], F.array().cast("array<string>")),
                        lambda k: F.map_contains_key(e["value"], k))
        vals = F.transform(keys, lambda k: F.concat(F.lit(" "), F.coalesce(e["value"][k], F.lit("None"))))
        return F.concat(F.array_join(vals, ""), F.coalesce(suffix[e["key"]], F.lit("")), F.lit(","))
    head = F.concat(F.lit("A "), style, F.lit(" shot, a "), age.cast("string"), F.lit("-years-old "),
                    F.lower(gender), F.lit(" from "), birthplace, F.lit(","))
    body = F.concat(head, F.array_join(F.transform(entries, piece), ""))
    return F.when(invalid, F.lit(None).cast("string")).otherwise(
        F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(".")))


def face_requests(people: DataFrame, pool: DataFrame, seed: int = 42, id_col: str = "id",
                  pool_key: str = "attr_id", strict: bool = True) -> DataFrame:
    """Each persona row gets a sampled attribute row (J5) and its strict sentence."""
    z = zip_sample(people, pool, seed, id_col, pool_key, strict)
    return z.withColumn("face_prompt", attribute_sentence_strict(
        F.col("attributes"), F.col("age"), F.col("gender"), F.col("birthplace"), style_draw(seed, id_col)))
