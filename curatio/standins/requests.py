"""Request (prompt) tables of the generation stages: C5 events, C6 albums,
C8b sessions, C13 router, C17 speaker inference, C18 keyword descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatio import constants as K
from curatio.functions import text as T
from curatio.plans import episodes as E
from curatio.plans import events as EV
from curatio.plans.assembly import route_requests as plan_prompts
from curatio.plans.persona import album_requests as album_list_requests
from curatio.sources.testdata import Tables
from curatio.standins import sqlutil as S
from curatio.standins.dialogue import CLASS_SQL, UTT_SQL, utterances
from curatio.standins.events import NODES_SQL, nodes
from curatio.standins.registry import query

_NARR = "'I work in the ' || lower(c_mktsegment) || ' sector.'"


def _narratives(t):
    return t.customer.select("c_custkey", F.col("c_name").alias("name"),
                             F.concat(F.lit("I work in the "), F.lower("c_mktsegment"), F.lit(" sector."))
                             .alias("narrative"))


@query("event_requests", f"""SELECT c_custkey, {S.render(K.EVENT_TEMPLATE, name='c_name', event=_NARR)} AS prompt
FROM customer""")
def event_requests(spark, sf_dir):
    r = EV.event_requests(_narratives(Tables(spark, sf_dir)))
    return r.select("c_custkey", F.col("event_prompt").alias("prompt"))


@query("album_requests", f"""SELECT c_custkey, {S.render(K.ALBUM_TEMPLATE, sentence=_NARR, name='c_name')} AS prompt
FROM customer""")
def album_requests(spark, sf_dir):
    n = _narratives(Tables(spark, sf_dir))
    return album_list_requests(n).select("c_custkey", F.col("album_prompt").alias("prompt"))


@query("route_requests", f"""SELECT doc_id, {S.render(K.PLAN_TEMPLATE, name="'Person' || CAST(doc_id AS VARCHAR)",
    gender=f"{S.arr(K.GENDERS)}[doc_id % 2 + 1]", age='20 + doc_id % 60', image_description='text')} AS prompt
FROM documents""")
def route_requests(spark, sf_dir):
    """C13 requests: every image request (here: a document's whole text as the description)."""
    d = Tables(spark, sf_dir).documents
    g = F.element_at(F.array(*[F.lit(x) for x in K.GENDERS]), (F.col("doc_id") % 2 + 1).cast("int"))
    requests = d.select("doc_id", F.concat(F.lit("Person"), F.col("doc_id").cast("string")).alias("name"), g.alias("gender"),
                        (20 + F.col("doc_id") % 60).alias("age"), F.col("text").alias("image_description"))
    return plan_prompts(requests).select("doc_id", "prompt")


def _profile(df):
    return (df.withColumn("name", F.concat(F.lit("User"), F.col("user_id").cast("string")))
            .withColumn("age", 20 + F.col("user_id") % 50)
            .withColumn("gender", F.element_at(F.array(*[F.lit(x) for x in K.GENDERS]),
                                               (F.col("user_id") % 2 + 1).cast("int")))
            .withColumn("birthplace", F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string")))
            .withColumn("residence", F.col("birthplace"))
            .withColumn("mobile_device", F.concat(F.lit("photo 0 of "), F.col("name"))))


_COMMON_SQL = dict(name="name", age="age", gender="gender", birthplace="birthplace", residence="residence",
                   mobile_device="mobile_device", date="date", event="event")


SESSION_SQL = f"""WITH {NODES_SQL},
v AS (
  SELECT user_id, graph_idx, node_pos + 1 AS session_number, event, date,
    lag(date) OVER w AS last_date, lag(event) OVER w AS last_event,
    coalesce(string_agg('- ' || date || ': ' || event, chr(10)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history_before
  FROM nodes WINDOW w AS (PARTITION BY user_id, graph_idx ORDER BY node_pos)
), p AS (
  SELECT *, 'User' || CAST(user_id AS VARCHAR) AS name, 20 + user_id % 50 AS age,
    {S.arr(K.GENDERS)}[user_id % 2 + 1] AS gender, 'NATION_' || CAST(user_id % 25 AS VARCHAR) AS birthplace,
    'NATION_' || CAST(user_id % 25 AS VARCHAR) AS residence, 'photo 0 of User' || CAST(user_id AS VARCHAR) AS mobile_device,
    '1 day' AS time_interval, 'after ' || last_event AS experience
  FROM v
)
SELECT user_id, graph_idx, session_number,
  CASE WHEN session_number = 1 THEN {S.render(K.FIRST_DIALOGUE_TEMPLATE, **_COMMON_SQL)}
       ELSE {S.render(K.NEXT_DIALOGUE_TEMPLATE, history_event='history_before', time_interval='time_interval',
                      last_date='last_date', experience='experience', **_COMMON_SQL)} END AS prompt
FROM p"""


def _sessions(spark, sf_dir):
    v = EV.session_views(nodes(Tables(spark, sf_dir).events), ["user_id", "graph_idx"])
    return _profile(v).withColumn("time_interval", F.lit("1 day")) \
        .withColumn("experience", F.concat(F.lit("after "), F.col("last_event")))


@query("session_requests", SESSION_SQL)
def session_requests(spark, sf_dir):
    """Requests for every session of every event graph at once."""
    return EV.session_requests(_sessions(spark, sf_dir)).select("user_id", "graph_idx", "session_number",
                                                                F.col("dialogue_prompt").alias("prompt"))


@query("session_requests_target", f"SELECT * FROM ({SESSION_SQL}) WHERE session_number = 4")
def session_requests_target(spark, sf_dir):
    """C8 for one target session: requests of the graphs that have a fourth event."""
    return EV.session_requests_for(_sessions(spark, sf_dir), ["user_id", "graph_idx"], 4) \
        .select("user_id", "graph_idx", "session_number", F.col("dialogue_prompt").alias("prompt"))


@query("speaker_fix_requests", f"""WITH {UTT_SQL},
l AS (
  SELECT *, string_agg(speaker_raw || ': ' || CASE WHEN sh_shape <> 'none' THEN '[Sharing Image]' ELSE utterance END, chr(10))
              OVER (PARTITION BY unique_id, session_number ORDER BY utterance_id, item_pos
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM utt
)
SELECT unique_id, session_number, utterance_id,
  {S.render(K.INFER_SPEAKER_TEMPLATE, dialogue="coalesce(before || chr(10), '') || '<SPEAKER>: [Sharing Image]'")} AS prompt
FROM l WHERE speaker_raw = ''""")
def speaker_fix_requests(spark, sf_dir):
    r = E.speaker_fix_requests(utterances(Tables(spark, sf_dir).conversations))
    return r.select("unique_id", "session_number", "utterance_id", "prompt")


@query("keyword_description_requests", f"""WITH {UTT_SQL}
SELECT unique_id, session_number, utterance_id, {S.render(K.KEYWORD_DESCRIPTION_TEMPLATE, keywords='sh_keywords')} AS prompt
FROM utt WHERE sh_shape <> 'other' AND ({CLASS_SQL}) = 4""")
def keyword_description_requests(spark, sf_dir):
    utt = utterances(Tables(spark, sf_dir).conversations).filter(F.col("sh_shape") != "other") \
        .withColumn("sharing_class", E.sharing_class())
    return E.keyword_description_requests(utt).select("unique_id", "session_number", "utterance_id", "prompt")
