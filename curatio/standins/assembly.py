"""Nested sessions of ``conversations`` (as ``dialogue.utterances`` names episodes, sessions and turns) with turns that
share nothing, one image or several: ``k = (7 * conv_id + turn) % 8`` plants the first item's class, a turn is a list
of two when ``(conv_id + 3 * turn) % 5 = 2`` (the second adds an image, or refers to the newest one), and
``other`` when ``(conv_id + turn) % 16 = 15``. Utterances and descriptions are the whole texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from curatio import constants as K
from curatio.plans import assembly as A
from curatio.session import scratch_path
from curatio.sources.io import write_table
from curatio.sources.testdata import Tables
from curatio.standins import sqlutil as S
from curatio.standins.dialogue import ALBUM_SQL, INFER_SQL, SPEAKER_SQL, UTT_SQL, session_date, utterances
from curatio.standins.registry import query

KEYS = ["unique_id", "session_number"]


def sessions(conv):
    utt = utterances(conv)
    k = (F.col("conv_id") * 7 + F.col("turn")) % 8
    text = conv.select("conv_id", "turn", "text")
    x = utt.join(text, ["conv_id", "turn"])
    shape = (F.when(F.col("sh_shape") == "other", "other").when(k == 0, "none")
             .when((F.col("conv_id") + 3 * F.col("turn")) % 5 == 2, "list").otherwise("dict"))

    def item(*fields):
        names = ["rationale", "image_description", "image_source", "keywords", "image_id_from_mobile"]
        return F.struct(*[f.alias(n) for f, n in zip(fields, names, strict=True)])
    one = item(*[F.col(c) for c in ("sh_rationale", "sh_description", "sh_source", "sh_keywords", "sh_id")])
    adds = F.col("turn") % 2 == 0
    two = item(F.lit("again"), F.when(adds, F.concat(F.lit("second "), "text")).otherwise(""), F.lit("mobile"), F.lit(""),
               F.when(adds, K.NEW_ADDED_IMAGE).otherwise("-1"))
    sharing = F.when(shape == "none", F.array().cast("array<struct<rationale:string,image_description:string,image_source:string,keywords:string,image_id_from_mobile:string>>")) \
        .when(shape == "list", F.array(one, two)).otherwise(F.array(one))
    turn = F.struct("utterance_id", F.col("speaker_raw").alias("speaker"), "utterance", shape.alias("shape"), sharing.alias("sharing"))
    s = x.groupBy("unique_id", "session_number", "conv_id", "name").agg(F.array_sort(F.collect_list(turn)).alias("dialogue"))
    cid, n = F.col("conv_id"), F.col("session_number").cast("string")
    photos = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("photo "), i.cast("string"), F.lit(" of "), F.col("name")))
    word = lambda w, c: F.concat(F.lit(w + " "), c.cast("string"))
    return s.select(
        "unique_id", "session_number", "conv_id", "name", (20 + cid % 50).alias("age"),
        F.element_at(F.array(*[F.lit(g) for g in K.GENDERS]), (cid % len(K.GENDERS) + 1).cast("int")).alias("gender"),
        word("NATION", cid % 25).alias("birthplace"), word("NATION", cid % 24).alias("residence"), word("category", cid % 7).alias("persona_category"),
        word("I am", cid).alias("persona_sent"), word("key", cid % 3).alias("persona_key"), word("value", cid).alias("persona_value"),
        word("relation", cid % 5).alias("commonsense_relation"), word("form of", cid).alias("narrative_sentence_form"), word("events of", cid).alias("event_sequence"),
        F.concat(F.lit("history "), n).alias("history_event"), F.concat(F.lit("event "), n).alias("event"), session_date("session_number").alias("date"),
        F.concat(n, F.lit(" day")).alias("time_interval"), F.concat(F.lit("experience "), n).alias("experience"),
        F.slice(photos, F.lit(1), (cid % 4).cast("int")).alias("mobile_device"), "dialogue")


PERSONA_SQL = f"""20 + conv_id % 50 AS age, {S.arr(K.GENDERS)}[conv_id % {len(K.GENDERS)} + 1] AS gender, 'NATION ' || (conv_id % 25) AS birthplace,
  'NATION ' || (conv_id % 24) AS residence, 'category ' || (conv_id % 7) AS persona_category, 'I am ' || conv_id AS persona_sent,
  'key ' || (conv_id % 3) AS persona_key, 'value ' || conv_id AS persona_value, 'relation ' || (conv_id % 5) AS commonsense_relation,
  'form of ' || conv_id AS narrative_sentence_form, 'events of ' || conv_id AS event_sequence"""

LIST_UTT_SQL = UTT_SQL.replace("), utt AS (", "), utt1 AS (") + """,
utt2 AS (
  SELECT u.* EXCLUDE (sh_shape), u0.text, CASE WHEN sh_shape = 'other' THEN 'other' WHEN (u.conv_id * 7 + u.turn) % 8 = 0 THEN 'none'
    WHEN (u.conv_id + 3 * u.turn) % 5 = 2 THEN 'list' ELSE 'dict' END AS sh_shape
  FROM utt1 u JOIN conversations u0 ON u0.conv_id = u.conv_id AND u0.turn = u.turn
), utt AS (
  SELECT conv_id, turn, persona_seed, unique_id, session_number, utterance_id, item_pos, name, speaker_raw, utterance, sh_rationale, sh_description, sh_source, sh_keywords, sh_id, sh_shape FROM utt2
  UNION ALL
  SELECT conv_id, turn, persona_seed, unique_id, session_number, utterance_id, 1, name, speaker_raw, utterance, 'again',
    CASE WHEN turn % 2 = 0 THEN 'second ' || text ELSE '' END, 'mobile', '', CASE WHEN turn % 2 = 0 THEN 'new added image' ELSE '-1' END, sh_shape FROM utt2 WHERE sh_shape = 'list'
)"""
LIST_ALBUM_SQL = ALBUM_SQL.replace(UTT_SQL, LIST_UTT_SQL)
ITEMS_SQL = f"""{LIST_ALBUM_SQL},
done AS (
  SELECT items.*, {SPEAKER_SQL} AS speaker, CASE WHEN sh_shape = 'dict' AND sharing_class IN (1, 2) OR sh_shape = 'none' THEN 'none' ELSE sh_shape END AS shape,
    CASE WHEN sharing_class = 3 THEN coalesce(resolved_description, sh_description) WHEN sharing_class = 4 THEN 'an image of ' || sh_keywords ELSE sh_description END AS text
  FROM items
), firsts AS (SELECT unique_id, session_number, CAST(min(len_before) AS BIGINT) AS n_start FROM done GROUP BY 1, 2
), lasts AS (SELECT unique_id, max(session_number) AS last_session FROM utt GROUP BY 1
), sizes AS (SELECT unique_id, count(*) AS n_album FROM album GROUP BY 1)"""


def _named(x):
    """Answers to the name and description prompts."""
    m = F.col("conv_id") % 4
    name = F.when(m == 0, "User").when(m == 1, "ai assistant").when(m == 2, F.upper("name")).otherwise("Bob")
    people = x.select("unique_id", "conv_id", "name").distinct()
    names = A.name_requests(x).join(people, "unique_id").select("unique_id", "place", F.lit(0).alias("seq"), name.alias("answer"))
    keywords = F.regexp_extract("prompt", r"(?s)^Keywords: (.*)\n\nGiven the keywords, your job", 1)
    texts = A.description_requests(x).select("unique_id", "place", F.lit(0).alias("seq"), F.concat(F.lit("an image of "), keywords).alias("answer"))
    return names, texts


def _episodes(spark, sf_dir):
    x = sessions(Tables(spark, sf_dir).conversations)
    return A.postprocess(A.episodes(x, *_named(x)))


@query("episodes_full", f"""WITH {ITEMS_SQL}
SELECT done.unique_id, name, {PERSONA_SQL}, done.session_number, 'history ' || done.session_number AS history_event, 'event ' || done.session_number AS event,
  '2024.01.' || lpad(CAST(done.session_number AS VARCHAR), 2, '0') AS date, done.session_number || ' day' AS time_interval, 'experience ' || done.session_number AS experience,
  utterance_id AS utter_id, coalesce(speaker, '?') AS speaker, CASE WHEN utterance = '' AND shape = 'none' THEN '<non verbal>' ELSE utterance END AS utter, shape,
  CAST(CASE WHEN shape = 'none' THEN -1 ELSE item_pos END AS BIGINT) AS item_pos, CASE WHEN shape <> 'none' THEN sh_rationale END AS rationale,
  CASE WHEN shape <> 'none' THEN text END AS image_description, CASE WHEN shape <> 'none' THEN sh_source END AS image_source,
  CASE WHEN shape <> 'none' THEN sh_keywords END AS keywords, CASE WHEN shape = 'dict' THEN sh_id END AS image_id_from_mobile,
  n_start, CAST(CASE WHEN done.session_number = last_session THEN coalesce(n_album, 0) ELSE -1 END AS BIGINT) AS n_last,
  coalesce((SELECT string_agg(pos || '. ' || description, chr(10) ORDER BY pos) FROM album WHERE album.unique_id = done.unique_id AND pos < n_start), '') AS device
FROM done JOIN firsts USING (unique_id, session_number) JOIN lasts ON lasts.unique_id = done.unique_id LEFT JOIN sizes ON sizes.unique_id = done.unique_id""")
def episodes_full(spark, sf_dir):
    """C9 + C10, one row per shared item (or silent turn) of the nested result, with every field it holds."""
    ep = _episodes(spark, sf_dir)
    s = ep.select("unique_id", *A.PERSONA, F.explode("episode").alias("s"))
    u = s.select("unique_id", *A.PERSONA, "s.session_number", *[f"s.{c}" for c in A.SLOTS], "s.mobile_device", "s.last_added_mobile_device_image",
                 F.explode("s.dialogue").alias("u"))
    i = u.select("*", F.posexplode_outer("u.sharing").alias("item_pos", "i"))
    device = F.array_join(F.transform("mobile_device", lambda d: F.concat(d["image_id"].cast("string"), F.lit(". "), d["image_description"])), "\n")
    return i.select("unique_id", *A.PERSONA, "session_number", *A.SLOTS, "u.utter_id", F.coalesce("u.speaker", F.lit("?")).alias("speaker"), "u.utter", "u.shape",
                    F.coalesce("item_pos", F.lit(-1)).cast("bigint").alias("item_pos"),
                    *[f"i.{c}" for c in ("rationale", "image_description", "image_source", "keywords", "image_id_from_mobile")],
                    F.size("mobile_device").cast("bigint").alias("n_start"),
                    F.coalesce(F.size("last_added_mobile_device_image"), F.lit(-1)).cast("bigint").alias("n_last"), device.alias("device"))


FACE = dict(face_image_path="'faces/' || unique_id || '.png'", face_description="'A portrait of ' || name")
REQUESTS_SQL = f"""{ITEMS_SQL}, places AS (
  SELECT unique_id, session_number, utterance_id, row_number() OVER (PARTITION BY unique_id, session_number ORDER BY utterance_id) - 1 AS place
  FROM (SELECT DISTINCT unique_id, session_number, utterance_id FROM utt)
), people AS (SELECT DISTINCT unique_id, conv_id, name FROM utt WHERE unique_id IN (SELECT unique_id FROM utt)
), req AS (
  SELECT unique_id, md5(unique_id || '|album|' || CAST(pos AS VARCHAR)) AS image_uuid, description AS image_description FROM album
  UNION ALL
  SELECT unique_id, md5(unique_id || '|' || CAST(session_number AS VARCHAR) || '|' || CAST(place AS VARCHAR) || '|' || CAST(item_pos AS VARCHAR)), text
  FROM done JOIN places USING (unique_id, session_number, utterance_id) WHERE shape = 'list' OR (shape = 'dict' AND text <> '')
), full_req AS (
  SELECT req.*, name, {S.arr(K.GENDERS)}[conv_id % {len(K.GENDERS)} + 1] AS gender, 20 + conv_id % 50 AS age,
    'faces/' || req.unique_id || '.png' AS face_image_path, 'A portrait of ' || name AS face_description
  FROM req JOIN people USING (unique_id)
)"""


def _requests(spark, sf_dir):
    ep = _episodes(spark, sf_dir).withColumn("face_image_path", F.concat(F.lit("faces/"), "unique_id", F.lit(".png"))) \
        .withColumn("face_description", F.concat(F.lit("A portrait of "), "name"))
    return A.image_requests(A.annotate_images(ep))


@query("image_requests_full", f"WITH {REQUESTS_SQL} SELECT unique_id, image_uuid, image_description, name, gender, age, face_image_path, face_description FROM full_req")
def image_requests_full(spark, sf_dir):
    """Every request with the person and the face it is to show."""
    return _requests(spark, sf_dir)


@query("plan_requests", f"""WITH {REQUESTS_SQL}
SELECT image_uuid, {S.render(K.PLAN_TEMPLATE, name='name', gender='gender', age='age', image_description='image_description')} AS prompt FROM full_req""")
def plan_requests(spark, sf_dir):
    """The planner's prompts of all image requests."""
    return A.route_requests(_requests(spark, sf_dir)).select("image_uuid", "prompt")


@query("name_requests", f"""WITH {LIST_UTT_SQL}, one AS (
  SELECT *, string_agg(speaker_raw || ': ' || CASE WHEN sh_shape <> 'none' THEN '[Sharing Image]' ELSE utterance END, chr(10))
    OVER (PARTITION BY unique_id, session_number ORDER BY utterance_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM utt WHERE item_pos = 0
)
SELECT unique_id, session_number, utterance_id,
  {S.render(K.INFER_SPEAKER_TEMPLATE, dialogue="coalesce(before || chr(10), '') || '<SPEAKER>: [Sharing Image]'")} AS prompt
FROM one WHERE speaker_raw = ''""")
def name_requests(spark, sf_dir):
    """C17: the words of the turns before stand in the prompt, an image where a turn shares one."""
    return A.name_requests(sessions(Tables(spark, sf_dir).conversations)).select("unique_id", "session_number", "utterance_id", "prompt")


@query("session_frames", f"""WITH {UTT_SQL}
SELECT DISTINCT CAST(conv_id // 100 AS INTEGER) AS persona_seed, CAST(session_number AS INTEGER) AS session_num, CAST(conv_id AS VARCHAR) || '-' || (turn // 12) AS id,
  'relation ' || (conv_id % 5) AS commonsense_relation, (conv_id // 100) || ':' || conv_id || '-' || (turn // 12) || '-relation ' || (conv_id % 5) AS unique_id,
  session_number FROM utt""")
def session_frames(spark, sf_dir):
    """Session files of a partition tree, read back with their key and without prompt and token columns."""
    utt = utterances(Tables(spark, sf_dir).conversations)
    rows = utt.select("persona_seed", F.col("session_number").alias("session_num"),
                      F.concat(F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") / 12).cast("bigint").cast("string")).alias("id"),
                      F.concat(F.lit("relation "), (F.col("conv_id") % 5).cast("string")).alias("commonsense_relation"), "session_number",
                      *[F.lit("x").alias(c) for c in K.DROPPED_COLUMNS]).distinct()
    path = scratch_path(spark, "sessions")
    write_table(rows, path, "json", ["persona_seed", "session_num"])
    schema = "id string, commonsense_relation string, session_number bigint, " + ", ".join(f"`{c}` string" for c in K.DROPPED_COLUMNS)
    return A.read_sessions(spark, path, schema).select("persona_seed", "session_num", "id", "commonsense_relation", "unique_id", "session_number")


@query("session_summary_requests", f"""WITH {LIST_UTT_SQL}, lines AS (
  SELECT unique_id, session_number, max(name) AS name, string_agg(speaker_raw || ': ' || CASE WHEN sh_shape = 'none' THEN utterance
      ELSE '[Sharing Image of ' || sh_description || ']' END, chr(10) ORDER BY utterance_id, item_pos) FILTER (WHERE sh_shape <> 'other') AS dialogue
  FROM utt GROUP BY 1, 2
)
SELECT unique_id, session_number, {S.render(K.SUMMARY_TEMPLATE, current_date="'2024.01.' || lpad(CAST(session_number AS VARCHAR), 2, '0')", name='name', dialogue="coalesce(dialogue, '')")} AS prompt
FROM lines""")
def session_summary_requests(spark, sf_dir):
    """C16 over whole nested sessions: one line per turn, or per image it shares."""
    return A.summary_requests(sessions(Tables(spark, sf_dir).conversations))
