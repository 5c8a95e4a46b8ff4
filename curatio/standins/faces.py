"""Face queries: ``part`` rows are the human-attribute pool, customers the people.

Attribute JSON per part (key order face, hair, tops, gloves, belts, shoes): hair gets a
``wears`` key when ``p_size % 4 = 0`` (category skipped), the belt material is empty
when ``p_size % 5 = 0``, shoes exist only when ``p_size % 3 <> 0``, ``gloves`` is a
category with no key order (contributes a bare comma).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from curatio import constants as K
from curatio.functions.draws import sql_draw, sql_order_key
from curatio.plans import faces as FA
from curatio.sources.testdata import Tables
from curatio.standins import sqlutil as S
from curatio.standins.commonsense import PEOPLE_SQL, people
from curatio.standins.registry import query


def attribute_pool(part):
    w1 = F.substring_index("p_name", " ", 1)
    w2 = F.substring_index(F.substring_index("p_name", " ", 2), " ", -1)
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    js = F.concat(
        F.lit('{"face": {"shape": "oval"}, "hair": {"hair color": '), q(w1), F.lit(', "hair style": "short"'),
        F.when(F.col("p_size") % 4 == 0, F.lit(', "wears": "cap"')).otherwise(F.lit("")),
        F.lit('}, "tops": {"type": '), q(F.lower("p_type")), F.lit(', "color": '), q(w1),
        F.lit(', "material": ""}, "gloves": {"type": "wool"}, "belts": {"material": '),
        q(F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.lit("leather"))), F.lit("}"),
        F.when(F.col("p_size") % 3 != 0, F.concat(F.lit(', "shoes": {"type": '), q(w2), F.lit(', "color": '), q(w1),
                                                  F.lit("}"))).otherwise(F.lit("")),
        F.lit("}"))
    return part.select(F.col("p_partkey").alias("attr_id"), js.alias("attributes"))


_W1, _W2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
SENTENCE_SQL = f"""regexp_replace('A ' || style || ' shot, a ' || CAST(age AS VARCHAR) || '-years-old ' || lower(gender)
  || ' from ' || birthplace || ','
  || CASE WHEN p_size % 4 = 0 THEN '' ELSE ' short ' || {_W1} || ' hair,' END
  || ' ' || {_W1} || ' ' || lower(p_type) || ','
  || ','
  || CASE WHEN p_size % 5 = 0 THEN ' belt,' ELSE ' leather belt,' END
  || CASE WHEN p_size % 3 <> 0 THEN ' ' || {_W1} || ' ' || {_W2} || ',' ELSE '' END, ',+\\z', '') || '.'"""


def _zip_sql(ids_cte: str) -> str:
    return f"""pp AS (
  SELECT *, {S.arr(K.STYLE_TYPES)}[{sql_draw(42, 'style', len(K.STYLE_TYPES), 'unique_id')} + 1] AS style,
         row_number() OVER (ORDER BY {sql_order_key(42, 'zip_people', 'unique_id')}) - 1 AS pos FROM {ids_cte}
), qq AS (
  SELECT p_partkey, p_size, p_type, p_name, row_number() OVER (ORDER BY {sql_order_key(42, 'zip_pool', 'p_partkey')}) - 1 AS pos
  FROM part
), z AS (SELECT * FROM pp JOIN qq USING (pos))"""


@query("attribute_sentence", f"""WITH {PEOPLE_SQL},
ids AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS unique_id, age, gender, birthplace FROM people),
{_zip_sql('ids')}
SELECT unique_id, p_partkey AS attr_id, {SENTENCE_SQL} AS face_description FROM z""")
def attribute_sentence(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ids = people(t).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("unique_id"),
                           "age", "gender", "birthplace")
    z = FA.zip_sample(ids, attribute_pool(t.part), 42, "unique_id", "attr_id")
    return z.select("unique_id", "attr_id",
                    FA.attribute_sentence(F.col("attributes"), F.col("age"), F.col("gender"), F.col("birthplace"),
                                          FA.style_draw(42, "unique_id")).alias("face_description"))


@query("attach_faces", f"""WITH {PEOPLE_SQL},
ep AS (
  SELECT o_orderkey, 'c' || CAST(o_custkey AS VARCHAR) AS unique_id, age, gender, birthplace
  FROM orders JOIN people ON c_custkey = o_custkey
), ids AS (SELECT DISTINCT unique_id, age, gender, birthplace FROM ep),
{_zip_sql('ids')}
SELECT ep.o_orderkey, ep.unique_id, 'faces/' || ep.unique_id || '.png' AS face_image_path, f.face_description
FROM ep JOIN (SELECT unique_id, {SENTENCE_SQL} AS face_description FROM z) f USING (unique_id)""")
def attach_faces(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = people(t).select("c_custkey", "age", "gender", "birthplace")
    ep = t.orders.select("o_orderkey", "o_custkey").join(p, F.col("o_custkey") == F.col("c_custkey")) \
        .select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("unique_id"),
                "age", "gender", "birthplace")
    out = FA.attach_faces(ep, attribute_pool(t.part), 42)
    return out.select("o_orderkey", "unique_id", "face_image_path", "face_description")


def attribute_pool_strict(part):
    """Pool for the strict variant: only known categories, no ``wears``; empty belt
    material kept as a value; shoes only when ``p_size % 3 <> 0``."""
    w1 = F.substring_index("p_name", " ", 1)
    w2 = F.substring_index(F.substring_index("p_name", " ", 2), " ", -1)
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    js = F.concat(
        F.lit('{"face": {"shape": "oval"}, "hair": {"hair color": '), q(w1), F.lit(', "hair style": "short"'),
        F.lit('}, "tops": {"type": '), q(F.lower("p_type")), F.lit(', "color": '), q(w1),
        F.lit(', "material": ""}, "belts": {"material": '),
        q(F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.lit("leather"))), F.lit("}"),
        F.when(F.col("p_size") % 3 != 0, F.concat(F.lit(', "shoes": {"type": '), q(w2), F.lit(', "color": '), q(w1),
                                                  F.lit("}"))).otherwise(F.lit("")),
        F.lit("}"))
    return part.select(F.col("p_partkey").alias("attr_id"), js.alias("attributes"))


STRICT_SQL = f"""'A ' || style || ' shot, a ' || CAST(age AS VARCHAR) || '-years-old ' || lower(gender)
  || ' from ' || birthplace || ','
  || ' short ' || {_W1} || ' hair,'
  || ' ' || {_W1} || '  ' || lower(p_type) || ','
  || CASE WHEN p_size % 5 = 0 THEN '  belt,' ELSE ' leather belt,' END
  || CASE WHEN p_size % 3 <> 0 THEN ' ' || {_W1} || ' ' || {_W2} || ',' ELSE '' END"""


@query("face_sentences", f"""WITH {PEOPLE_SQL},
ids AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS unique_id, age, gender, birthplace FROM people),
{_zip_sql('ids')}
SELECT unique_id, p_partkey AS attr_id, left({STRICT_SQL}, length({STRICT_SQL}) - 1) || '.' AS face_prompt FROM z""")
def face_sentences(spark, sf_dir):
    """C7 face requests (strict variant of the attribute sentence)."""
    t = Tables(spark, sf_dir)
    ids = people(t).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("unique_id"),
                           "age", "gender", "birthplace")
    r = FA.face_requests(ids, attribute_pool_strict(t.part), 42, "unique_id")
    return r.select("unique_id", "attr_id", "face_prompt")
