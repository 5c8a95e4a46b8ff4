"""Persona-stage queries over ``part`` (the persona pool stand-in).

Stand-in mapping: a list is 30 consecutive part keys (``p_partkey div 30``), its
item number is ``p_partkey % 30 + 1``; each part renders one list item whose
form (plain / [..] / wrong key / value not in sentence / \\r inside) depends on
``p_size % 10``. Target entity key is ``brand``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.plans.persona import persona_parse
from curatio.sources.testdata import Tables
from curatio.standins.registry import query

LIST_LEN = 30


def _piece() -> F.Column:
    m = F.col("p_size") % 10
    return (F.when(m == 0, F.concat(F.lit("I keep a "), "p_name"))
            .when(m == 1, F.concat(F.lit("I own the "), "p_name", F.lit(" by "), "p_brand",
                                   F.lit(" [Brand: "), "p_brand", F.lit("]")))
            .when(m == 2, F.concat(F.lit("I bought a "), "p_name", F.lit(" (Type: "), "p_type", F.lit(")")))
            .when(m == 3, F.concat(F.lit("I use my "), "p_name", F.lit("\r daily (Brand: "), "p_brand", F.lit(")")))
            .otherwise(F.concat(F.lit("My "), "p_name", F.lit(" is from "), "p_brand", F.lit(" (Brand: "),
                                F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.col("p_brand")),
                                F.lit(")"))))


PIECE_SQL = """CASE p_size % 10
  WHEN 0 THEN 'I keep a ' || p_name
  WHEN 1 THEN 'I own the ' || p_name || ' by ' || p_brand || ' [Brand: ' || p_brand || ']'
  WHEN 2 THEN 'I bought a ' || p_name || ' (Type: ' || p_type || ')'
  WHEN 3 THEN 'I use my ' || p_name || chr(13) || ' daily (Brand: ' || p_brand || ')'
  ELSE 'My ' || p_name || ' is from ' || p_brand || ' (Brand: ' || CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_brand END || ')'
END"""


def persona_generations(part: DataFrame) -> DataFrame:
    """Completion rows ``(seq, persona_entity_key, generation)``; each list ≤ 30 items."""
    items = part.select((F.col("p_partkey") / LIST_LEN).cast("bigint").alias("seq"),
                        (F.col("p_partkey") % LIST_LEN + 1).alias("pos"), _piece().alias("piece"))
    line = F.when(F.col("pos") == 1, F.col("piece")).otherwise(
        F.concat(F.lit("\n"), F.col("pos").cast("string"), F.lit(". "), F.col("piece")))
    return (items.groupBy("seq")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))),
                                          lambda x: x["l"]), "").alias("generation"))
            .withColumn("persona_entity_key", F.lit("brand")))


GEN_SQL = f"""gen AS (
  SELECT CAST(p_partkey // {LIST_LEN} AS BIGINT) AS seq, 'brand' AS persona_entity_key,
         string_agg(CASE WHEN p_partkey % {LIST_LEN} + 1 = 1 THEN piece
                         ELSE chr(10) || CAST(p_partkey % {LIST_LEN} + 1 AS VARCHAR) || '. ' || piece END,
                    '' ORDER BY p_partkey % {LIST_LEN} + 1) AS generation
  FROM (SELECT p_partkey, {PIECE_SQL} AS piece FROM part) GROUP BY 1
)"""

SPLIT_RE_SQL = "|".join([f"\\n{i}. " for i in range(1, LIST_LEN + 1)] + [f"\\n{i}." for i in range(1, LIST_LEN + 1)])
ITEM_RE_SQL = r"^(.*) [\(|\[](.*): (.*)[\)|\]]"

PIECES_SQL = f"""{GEN_SQL},
arr AS (SELECT seq, persona_entity_key, regexp_split_to_array(generation, '{SPLIT_RE_SQL}') AS a FROM gen),
pieces AS (
  SELECT seq, persona_entity_key, CAST(i - 1 AS BIGINT) AS piece_idx, a[i] AS piece
  FROM arr, LATERAL (SELECT unnest(generate_series(1, len(a))) AS i)
),
parsed AS (
  SELECT *, regexp_matches(piece, '{ITEM_RE_SQL}') AS matched,
         regexp_extract(piece, '{ITEM_RE_SQL}', 1) AS sent,
         regexp_extract(piece, '{ITEM_RE_SQL}', 2) AS key,
         regexp_extract(piece, '{ITEM_RE_SQL}', 3) AS value
  FROM pieces
),
exact AS (
  SELECT *, md5(concat_ws('|', CAST(seq AS VARCHAR), CAST(piece_idx AS VARCHAR))) AS id FROM parsed
  WHERE matched AND lower(key) = persona_entity_key AND contains(lower(sent), lower(value))
)"""


def _parse(spark, sf_dir):
    return persona_parse(persona_generations(Tables(spark, sf_dir).part))


@query("numbered_list_parse", f"""WITH {PIECES_SQL}
SELECT seq AS list_id, piece_idx, CAST(matched AS BIGINT) AS matched, piece, sent, key, value FROM parsed""")
def numbered_list_parse(spark, sf_dir):
    p = _parse(spark, sf_dir).pieces
    return p.select(F.col("seq").alias("list_id"), F.col("piece_idx").cast("bigint"),
                    F.col("matched").cast("bigint"), "piece", "sent", "key", "value")


@query("persona_parse_unique", f"""WITH {PIECES_SQL}
SELECT sent, arg_min(key, (seq, piece_idx)) AS key, arg_min(value, (seq, piece_idx)) AS value,
       arg_min(id, (seq, piece_idx)) AS id, min(seq) AS list_id
FROM exact GROUP BY sent""")
def persona_parse_unique(spark, sf_dir):
    u = _parse(spark, sf_dir).unique
    return u.select("sent", "key", "value", "id", F.col("seq").alias("list_id"))


@query("persona_parse_report", f"""WITH {PIECES_SQL}
SELECT 'persona' AS stage, metric, CAST(value AS BIGINT) AS value FROM (
  SELECT 'total_num' AS metric, count(*) * {LIST_LEN} AS value FROM gen
  UNION ALL SELECT 'regex:parsed_result', count(*) FILTER (WHERE matched) FROM parsed
  UNION ALL SELECT 'regex:discard_result', count(*) FILTER (WHERE NOT matched) FROM parsed
  UNION ALL SELECT 'exact:parsed_result', count(*) FROM exact
  UNION ALL SELECT 'exact:discard_result', (SELECT count(*) FILTER (WHERE matched) FROM parsed) - (SELECT count(*) FROM exact)
  UNION ALL SELECT 'duplication:unique_result', count(DISTINCT sent) FROM exact
)""")
def persona_parse_report(spark, sf_dir):
    return _parse(spark, sf_dir).report


# ---- C1 requests / few-shot blocks ------------------------------------------------------
from curatio import constants as K  # noqa: E402
from curatio.functions.draws import sql_draw, sql_order_key  # noqa: E402
from curatio.plans.persona import few_shot_blocks, persona_requests as _persona_requests  # noqa: E402
from curatio.standins import sqlutil as S  # noqa: E402

# stand-in exclusion list: part types play the categories, so the excluded names are part types
EXCLUDED_TYPES = ["PROMO"]


def _countries(t):
    return t.nation.select(F.col("n_nationkey").cast("bigint").alias("country_idx"), F.col("n_name").alias("country"),
                           F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("alpha2"))


_K = ("category", "trial")
_N = "(SELECT count(*) FROM nation)"
_AI = sql_draw(42, "age_range", len(K.AGE_RANGES), *_K)
_LO = [int(r.split("-")[0]) for r in K.AGE_RANGES]
_HI = [int(r.split("-")[1]) for r in K.AGE_RANGES]


@query("persona_requests", f"""WITH cats AS (
  SELECT DISTINCT p_type AS category, 'brand' AS entity_key FROM part WHERE p_type NOT IN ({", ".join(S.lit(x) for x in EXCLUDED_TYPES)})
), tr AS (SELECT c.*, CAST(t AS BIGINT) AS trial FROM cats c, range(0, {K.DEMOGRAPHIC_TRIAL}) r(t)),
d AS (
  SELECT *, CAST({S.arr(_LO)}[{_AI} + 1] + {sql_draw(42, 'age', f'{S.arr(_HI)}[{_AI} + 1] - {S.arr(_LO)}[{_AI} + 1] + 1', *_K)} AS BIGINT) AS age,
    {S.arr(K.GENDERS)}[{sql_draw(42, 'gender', len(K.GENDERS), *_K)} + 1] AS gender,
    {sql_draw(42, 'birthplace', _N, *_K)} AS b,
    CASE WHEN trial > {0.7 * K.DEMOGRAPHIC_TRIAL} THEN ({sql_draw(42, 'birthplace', _N, *_K)} + 1 + {sql_draw(42, 'residence', _N + ' - 1', *_K)}) % {_N}
         ELSE {sql_draw(42, 'birthplace', _N, *_K)} END AS r
  FROM tr
), c AS (SELECT n_nationkey AS idx, n_name AS country, 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS alpha2 FROM nation),
j AS (
  SELECT d.*, cb.country AS birthplace, cb.alpha2 AS birthplace_alpha2, cr.country AS residence, cr.alpha2 AS residence_alpha2
  FROM d JOIN c cb ON cb.idx = d.b JOIN c cr ON cr.idx = d.r
)
SELECT category, entity_key, trial, CAST(p AS BIGINT) AS prompt_idx, age, gender, birthplace, residence,
  birthplace_alpha2, residence_alpha2,
  {S.render(K.PERSONA_TEMPLATE, age='age', gender='gender', birthplace='birthplace', residence='residence', target_persona_category='category', target_persona_entity='entity_key')} AS prompt
FROM j, range(0, {K.PERSONA_RELATIONS_TRIALS}) q(p)""")
def persona_requests(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cats = t.part.select(F.col("p_type").alias("category")).distinct().withColumn("entity_key", F.lit("brand"))
    r = _persona_requests(cats, _countries(t), excluded=EXCLUDED_TYPES)
    return r.select("category", "entity_key", "trial", "prompt_idx", "age", "gender", "birthplace", "residence",
                    "birthplace_alpha2", "residence_alpha2", "prompt")


def _pool(part):
    return part.select(F.col("p_type").alias("category"), F.lit("brand").alias("key"),
                       F.when(F.col("p_size") % 5 == 0, "model").otherwise("Brand").alias("attr"),
                       F.concat(F.lit("I like the "), "p_name", F.lit(" from "), "p_brand").alias("sentence"),
                       F.col("p_brand").alias("value"), F.col("p_partkey").alias("row_id"))


# Python str.title() of the single-token values here ('brand', 'Brand#12') is first letter up, rest down
_TITLE = "upper(substr({x}, 1, 1)) || lower(substr({x}, 2))"


@query("few_shot_block", f"""WITH pool AS (
  SELECT p_type AS category, 'brand' AS key, CASE WHEN p_size % 5 = 0 THEN 'model' ELSE 'Brand' END AS attr,
         'I like the ' || p_name || ' from ' || p_brand AS sentence, p_brand AS value, p_partkey AS row_id FROM part
), x AS (
  SELECT pool.*, CAST(p AS BIGINT) AS prompt_idx FROM pool, range(0, {K.PERSONA_RELATIONS_TRIALS}) q(p)
  WHERE lower(attr) = lower(key)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY category, key, prompt_idx
                               ORDER BY {sql_order_key(42, 'fewshot', 'category', 'key', 'prompt_idx', 'row_id')}) AS i
  FROM x
)
SELECT category, prompt_idx, count(*) AS n_lines,
  {S.render(K.FEW_SHOT_TEMPLATE, persona_category='category', persona_entity_key=_TITLE.format(x='max(key)'),
            persona_sentences="string_agg(CAST(i AS VARCHAR) || '. ' || sentence || ' (' || " + _TITLE.format(x='key') + " || ': ' || " + _TITLE.format(x='value') + " || ')', chr(10) ORDER BY i)")} AS block
FROM r WHERE i <= 30 GROUP BY category, key, prompt_idx""")
def few_shot_block(spark, sf_dir):
    b = few_shot_blocks(_pool(Tables(spark, sf_dir).part))
    return b.select("category", "prompt_idx", "n_lines", "block")


# ---- C6 album lists: 5 consecutive parts form one album list ------------------------------
from curatio.plans.persona import album_parse  # noqa: E402


def _album_gen(part):
    m = F.col("p_size") % 4
    item = (F.when(m == 0, F.concat(F.lit("A photo of a "), "p_name", F.lit(" (Category: "), "p_type", F.lit(")")))
            .when(m == 1, F.concat(F.lit("A picture of "), "p_name", F.lit(" [Category: "), F.lower("p_type"),
                                   F.lit("]")))
            .when(m == 2, F.concat(F.lit("Just "), "p_name"))
            .otherwise(F.concat(F.lit("A "), "p_name", F.lit(" (Type: "), "p_type", F.lit(")"))))
    items = part.select((F.col("p_partkey") / 5).cast("bigint").alias("list_id"),
                        (F.col("p_partkey") % 5 + 1).alias("pos"), item.alias("piece"))
    line = F.when(F.col("pos") == 1, F.col("piece")).otherwise(
        F.concat(F.lit("\n"), F.col("pos").cast("string"), F.lit(". "), F.col("piece")))
    return items.groupBy("list_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"]), "").alias("generation"))


ALBUM_SPLIT_SQL = "|".join([f"\\n{i}. " for i in range(1, 6)] + [f"\\n{i}." for i in range(1, 6)])
ALBUM_RE_SQL = r"^(.*) [\(|\[]Category: (.*)[\)|\]]"
ALBUM_SQL = f"""agen AS (
  SELECT CAST(p_partkey // 5 AS BIGINT) AS list_id,
    string_agg(CASE WHEN p_partkey % 5 = 0 THEN piece ELSE chr(10) || CAST(p_partkey % 5 + 1 AS VARCHAR) || '. ' || piece END,
               '' ORDER BY p_partkey % 5) AS generation
  FROM (SELECT p_partkey, CASE p_size % 4
      WHEN 0 THEN 'A photo of a ' || p_name || ' (Category: ' || p_type || ')'
      WHEN 1 THEN 'A picture of ' || p_name || ' [Category: ' || lower(p_type) || ']'
      WHEN 2 THEN 'Just ' || p_name
      ELSE 'A ' || p_name || ' (Type: ' || p_type || ')' END AS piece FROM part) GROUP BY 1
), aarr AS (SELECT list_id, regexp_split_to_array(generation, '{ALBUM_SPLIT_SQL}') AS a FROM agen),
apieces AS (
  SELECT list_id, CAST(i - 1 AS BIGINT) AS piece_idx, a[i] AS piece,
         regexp_matches(a[i], '{ALBUM_RE_SQL}') AS matched,
         regexp_extract(a[i], '{ALBUM_RE_SQL}', 1) AS image_description,
         regexp_extract(a[i], '{ALBUM_RE_SQL}', 2) AS image_category
  FROM aarr, LATERAL (SELECT unnest(generate_series(1, len(a))) AS i)
), aitems AS (SELECT *, bool_or(matched) OVER (PARTITION BY list_id) AS kept FROM apieces)"""


@query("album_list_parse", f"""WITH {ALBUM_SQL}
SELECT list_id, piece_idx, CAST(matched AS BIGINT) AS matched, image_description, image_category,
       CAST(kept AS BIGINT) AS kept FROM aitems""")
def album_list_parse(spark, sf_dir):
    r = album_parse(_album_gen(Tables(spark, sf_dir).part), ["list_id"])
    return r.items.select("list_id", F.col("piece_idx").cast("bigint"), F.col("matched").cast("bigint"),
                          "image_description", "image_category", F.col("kept").cast("bigint"))


@query("album_report", f"""WITH {ALBUM_SQL}
SELECT 'album' AS stage, metric, CAST(value AS BIGINT) AS value FROM (
  SELECT 'total_num' AS metric, count(DISTINCT list_id) * 5 AS value FROM aitems
  UNION ALL SELECT 'regex:parsed_result', count(*) FILTER (WHERE matched AND kept) FROM aitems
  UNION ALL SELECT 'regex:discard_result', count(*) FILTER (WHERE NOT matched) FROM aitems
  UNION ALL SELECT 'instances_kept', count(DISTINCT list_id) FILTER (WHERE kept) FROM aitems)""")
def album_report(spark, sf_dir):
    return album_parse(_album_gen(Tables(spark, sf_dir).part), ["list_id"]).report


# ---- C1 system messages: few-shot block per request ---------------------------------------
from curatio.plans.persona import attach_system_messages  # noqa: E402

def _blocks_cte() -> str:
    from curatio.standins.registry import QUERIES
    sql = QUERIES["few_shot_block"][1]
    # the few-shot query without its final projection of `key`: re-select with the key kept
    return sql.replace("SELECT category, prompt_idx, count(*) AS n_lines,", "SELECT category, key, prompt_idx, count(*) AS n_lines,")


_RK = ("category", "trial", "prompt_idx")


@query("persona_system_messages", f"""WITH blocks AS ({_blocks_cte()}),
keys AS (
  SELECT category AS fewshot_category, key AS fewshot_key,
         row_number() OVER (ORDER BY {sql_order_key(42, 'fewshot_keys', 'category', 'key')}) - 1 AS kidx
  FROM (SELECT DISTINCT category, key FROM blocks)
), req AS (
  SELECT c.category, CAST(t AS BIGINT) AS trial, CAST(p AS BIGINT) AS prompt_idx
  FROM (SELECT DISTINCT p_type AS category FROM part WHERE p_type NOT IN ({", ".join(S.lit(x) for x in EXCLUDED_TYPES)})) c,
       range(0, {K.DEMOGRAPHIC_TRIAL}) r(t), range(0, {K.PERSONA_RELATIONS_TRIALS}) q(p)
), pick AS (
  SELECT *, {sql_draw(42, 'fewshot_key', '(SELECT count(*) FROM keys)', *_RK)} AS kidx,
         {sql_draw(42, 'fewshot_block', K.PERSONA_RELATIONS_TRIALS, *_RK)} AS fewshot_block FROM req
)
SELECT pick.category, pick.trial, pick.prompt_idx, keys.fewshot_category, keys.fewshot_key, pick.fewshot_block,
       {S.render(K.PERSONA_SYSTEM_MESSAGE, example='blocks.block')} AS system_message
FROM pick JOIN keys ON keys.kidx = pick.kidx
JOIN blocks ON blocks.category = keys.fewshot_category AND blocks.key = keys.fewshot_key AND blocks.prompt_idx = pick.fewshot_block""")
def persona_system_messages(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cats = t.part.select(F.col("p_type").alias("category")).distinct().filter(~F.col("category").isin(*EXCLUDED_TYPES))
    req = cats.withColumn("trial", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(K.DEMOGRAPHIC_TRIAL - 1).cast("bigint")))) \
        .withColumn("prompt_idx", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                       F.lit(K.PERSONA_RELATIONS_TRIALS - 1).cast("bigint"))))
    out = attach_system_messages(req, few_shot_blocks(_pool(t.part)))
    return out.select("category", "trial", "prompt_idx", "fewshot_category", "fewshot_key", "fewshot_block",
                      "system_message")
