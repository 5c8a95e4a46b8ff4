"""Stages run through the registry, and session rounds (C8) over ``conversations``.

``stage_chain`` / ``stage_reports``: customers ask for a numbered list of sentences (C2), every new sentence for an
event graph (C5), every graph for its first session (C8). ``session_rounds``: the turns of a conversation are
what the models answered for its sessions; episodes and sessions are those of ``dialogue.utterances``. Answers
carry planted defects (by remainders named at each place); some requests have no answer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from curatio import constants as K
from curatio.operators.core import union_reports
from curatio.plans import stage as ST
from curatio.session import scratch_path
from curatio.sources.testdata import Tables
from curatio.standins import sqlutil as S
from curatio.standins.registry import query


def _answer(rows, text):
    """Completions table: an attempt that comes second never wins."""
    return rows.select("request_id", F.explode(F.array(
        F.struct(F.lit(2).alias("seq"), F.lit("late").alias("generation")), F.struct(F.lit(1).alias("seq"), text.alias("generation")))).alias("a")) \
        .select("request_id", "a.seq", "a.generation", F.lit(11).cast("bigint").alias("prompt_tokens"), F.lit(7).cast("bigint").alias("completion_tokens"))


# ---- C2 -> C5 -> C8 ---------------------------------------------------------------------------

def _digit(c):
    return F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("bigint")


def _sql_digit(c: str) -> str:
    return f"CAST(('0x' || substr(md5({c}), 1, 4)) AS BIGINT)"


def _profile(cust):
    key = F.col("c_custkey")
    return cust.select(
        F.col("c_name").alias("name"), (20 + key % 50).alias("age"),
        F.element_at(F.array(*[F.lit(g) for g in K.GENDERS]), (key % len(K.GENDERS) + 1).cast("int")).alias("gender"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("birthplace"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("residence"))


def _chain_answers(name, rows):
    if name == "persona":
        own, shared = F.col("name"), F.col("nation")
        text = F.concat(F.lit("I travel with "), own, F.lit(" (Movie Title: "), own, F.lit(")\n2. no brackets here\n3. I like blue (Color: blue)\n4. We know "),
                        shared, F.lit(" (Movie Title: "), shared, F.lit(")\n5. It is gone (Movie Title: "), own, F.lit(")"))
        return _answer(rows.filter(F.col("c_custkey") % 7 != 0), text)
    d = _digit("request_id")
    if name == "event":
        second = F.concat(F.lit(", {'id': 2, 'event': 'second for "), F.col("name"), F.lit("'"), F.when(d % 5 == 2, "").otherwise(", 'date': '2024.02.01'"),
                          F.lit(", 'caused_by': {'caused_by:id': 1, 'caused_by:time_interval': '1 month', 'caused_by:experience_op': 'cause', "
                                "'caused_by:experience': 'news'}}"))
        nodes = F.concat(F.lit("[{'id': 1, 'event': 'first for "), F.col("name"), F.lit("', 'date': '2024.01.01', 'caused_by': {}}"), second,
                         F.when(d % 5 == 0, ", true]").otherwise("]"))
        nodes = F.when(d % 5 == 1, F.concat(F.lit("{'graph': "), nodes, F.lit("}"))).otherwise(nodes)
        return _answer(rows.filter(d % 9 != 4), F.concat(F.lit("```json\n"), nodes, F.lit("\n``` done")))
    turn = "{'utterance_id': 1, 'speaker': 'user', 'utterance': 'hello', 'sharing_info': {}}"
    image = ("{'utterance_id': 2, 'speaker': 'user', 'utterance': '', 'sharing_info': {'rationale': 'r', 'image_description': 'a photo', "
             "'image_source': 'mobile', 'keywords': '', 'image_id_from_mobile': 'new added image'}}")
    return _answer(rows, F.when(d % 3 == 0, f"[{turn}]").otherwise(f"[{turn}, {image}]"))


def _chain(spark, sf_dir):
    from curatio.functions.draws import stable_id
    cust = Tables(spark, sf_dir).customer
    requests = cust.select(
        "c_custkey", F.col("c_name").alias("name"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("nation"),
        F.lit("movie_title").alias("persona_entity_key"), (F.col("c_custkey") / 100).cast("bigint").alias("persona_seed"),
        stable_id("c_custkey").alias("request_id"))
    return ST.run("session_1", {"persona_requests": requests, "people": _profile(cust)}, _chain_answers, scratch_path(spark, "stages"))


CHAIN_SQL = f"""cust AS (
  SELECT c_custkey, c_name AS name, 'NATION_' || CAST(c_nationkey AS VARCHAR) AS nation, CAST(c_custkey // 100 AS BIGINT) AS persona_seed,
         md5(CAST(c_custkey AS VARCHAR)) AS request_id, 20 + c_custkey % 50 AS age, {S.arr(K.GENDERS)}[c_custkey % {len(K.GENDERS)} + 1] AS gender
  FROM customer
), piece AS (
  SELECT *, CASE i WHEN 0 THEN 'I travel with ' || name WHEN 3 THEN 'We know ' || nation WHEN 2 THEN 'I like blue' WHEN 4 THEN 'It is gone' END AS sent,
    CASE WHEN i = 1 THEN 'regex:discard' WHEN i = 2 OR i = 4 THEN 'exact:discard' END AS reason
  FROM cust, range(5) r(i) WHERE c_custkey % 7 <> 0
), sent AS (
  SELECT sent, arg_min(name, (request_id, i)) AS name, arg_min(persona_seed, (request_id, i)) AS persona_seed, md5(sent) AS request_id
  FROM piece WHERE reason IS NULL GROUP BY sent
), graph AS (
  SELECT *, {_sql_digit('request_id')} AS d FROM sent
), event AS (
  SELECT *, CASE WHEN d % 9 = 4 THEN 'pending' WHEN d % 5 = 1 THEN 'not_a_list' WHEN d % 5 = 0 THEN 'syntax:fail' WHEN d % 5 = 2 THEN 'key:fail' ELSE 'ok' END AS verdict
  FROM graph
), session AS (
  SELECT e.persona_seed || ':' || e.request_id AS unique_id, e.name, age, gender, nation, '2024.01.01' AS date, 'first for ' || e.name AS event
  FROM event e JOIN cust ON cust.name = e.name WHERE verdict = 'ok'
), asked AS (
  SELECT *, md5(unique_id || '|1') AS request_id, {_sql_digit("md5(unique_id || '|1')")} % 3 = 0 AS bad FROM session
)"""


@query("stage_chain", f"""WITH {CHAIN_SQL}
SELECT unique_id, CASE WHEN bad THEN 'rejected' ELSE 'accepted' END AS outcome, CASE WHEN bad THEN 'parse:fail' END AS reject_reason,
  CASE WHEN bad THEN '' ELSE 'a photo' END AS album,
  {S.render(K.FIRST_DIALOGUE_TEMPLATE, name='name', age='age', gender='gender', birthplace='nation', residence='nation',
            mobile_device="''", date='date', event='event')} AS prompt
FROM asked""")
def stage_chain(spark, sf_dir):
    """Sessions the chain ends with, accepted and rejected."""
    got = _chain(spark, sf_dir)["session_1"]
    both = got.accepted.withColumn("outcome", F.lit("accepted")).unionByName(got.rejected.withColumn("outcome", F.lit("rejected")))
    return both.select("unique_id", "outcome", "reject_reason", F.array_join("album", "; ").alias("album"), F.col("dialogue_prompt").alias("prompt"))


@query("stage_reports", f"""WITH {CHAIN_SQL}
SELECT stage, metric, CAST(value AS BIGINT) AS value FROM (
  SELECT 'persona' AS stage, unnest(['total', 'accepted', 'rejected', 'pending', 'regex:discard', 'exact:discard']) AS metric,
    unnest([(SELECT count(*) FROM piece) + (SELECT count(*) FROM cust WHERE c_custkey % 7 = 0), (SELECT count(*) FROM piece WHERE reason IS NULL),
      (SELECT count(*) FROM piece WHERE reason IS NOT NULL), (SELECT count(*) FROM cust WHERE c_custkey % 7 = 0),
      (SELECT count(*) FROM piece WHERE i = 1), (SELECT count(*) FROM piece WHERE i IN (2, 4))]) AS value
  UNION ALL SELECT 'event', unnest(['total', 'accepted', 'rejected', 'pending', 'syntax:fail', 'not_a_list', 'key:fail']),
    unnest([(SELECT count(*) FROM event), (SELECT count(*) FROM event WHERE verdict = 'ok'), (SELECT count(*) FROM event WHERE verdict NOT IN ('ok', 'pending')),
      (SELECT count(*) FROM event WHERE verdict = 'pending'), (SELECT count(*) FROM event WHERE verdict = 'syntax:fail'),
      (SELECT count(*) FROM event WHERE verdict = 'not_a_list'), (SELECT count(*) FROM event WHERE verdict = 'key:fail')])
  UNION ALL SELECT 'session_1', unnest(['total', 'accepted', 'rejected', 'pending', 'dialogue_syntax:fail', 'dialogue_parse:fail', 'dialogue_key_existence:fail', 'dialogue:total']),
    unnest([(SELECT count(*) FROM asked), (SELECT count(*) FROM asked WHERE NOT bad), (SELECT count(*) FROM asked WHERE bad), 0, 0,
      (SELECT count(*) FROM asked WHERE bad), 0, (SELECT count(*) FROM asked)]))""")
def stage_reports(spark, sf_dir):
    """The reports of all stages of the chain (A1, K4), each counted in its stage's one write."""
    return union_reports(*[got.report for got in _chain(spark, sf_dir).values()])


# ---- C8: six rounds ---------------------------------------------------------------------------

NEW = K.NEW_ADDED_IMAGE


def _turns(conv):
    """Answer text of every turn as a literal; sharing by ``k = (7 * conv_id + turn) % 8``: a new image without and
    with a description (4, 5), an image of the web (6), a list of two new images (7), none."""
    cid, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    k = (cid * 7 + turn) % 8

    def image(source, description, number):
        return F.create_map(*[x if not isinstance(x, str) else F.lit(x) for pair in (
            ("rationale", "to show"), ("image_description", description), ("image_source", source), ("keywords", ""),
            ("image_id_from_mobile", number)) for x in pair])
    one = F.when(k == 4, image("mobile", "", NEW)).when(k == 5, image("mobile", text, NEW)).otherwise(image("internet", text, ""))
    two = F.array(image("mobile", F.concat(F.lit("A "), text), NEW), image("mobile", F.concat(F.lit("B "), text), NEW))
    sharing = F.when(k == 7, F.to_json(two)).when(k.isin(4, 5, 6), F.to_json(one)).otherwise("{}")
    session = ((turn % 12) / 2).cast("bigint") + 1
    bad_keys = (cid + session) % 23 == 7
    head = F.to_json(F.struct((turn % 2).cast("string").alias("utterance_id"), F.col("role").alias("speaker"), text.alias("utterance")))
    head = F.when(bad_keys, F.to_json(F.struct(text.alias("utterance")))).otherwise(head)
    return conv.select(
        F.concat((cid / 100).cast("bigint").cast("string"), F.lit(":"), cid.cast("string"), F.lit("-"), (turn / 12).cast("bigint").cast("string")).alias("unique_id"),
        "conv_id", "turn", session.alias("session_number"),
        F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(', "sharing_info": '), sharing, F.lit("}")).alias("literal"))


def _session_answers(turns):
    """One answer a session (two turns at most); defects by ``g = conv_id + session_number``."""
    g = F.col("conv_id") + F.col("session_number")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "literal"))), lambda t: t["literal"]), ", ")
    s = turns.groupBy("unique_id", "conv_id", "session_number").agg(body.alias("body"))
    text = F.concat(F.lit("["), "body", F.when(g % 17 == 3, ", true]").otherwise("]"))
    text = F.when(g % 19 == 5, F.concat(F.lit('{"items": '), text, F.lit("}"))).otherwise(text)
    return s.filter(g % 29 != 11).select("unique_id", "session_number", F.concat(F.lit("```json\n"), text, F.lit("\n```")).alias("answer"))


def _state(turns):
    ep = turns.groupBy("unique_id", "conv_id").agg(F.max("session_number").cast("int").alias("n"))
    cid = F.col("conv_id")
    name = F.concat(F.lit("Person"), cid.cast("string"))
    nation = F.concat(F.lit("NATION_"), (cid % 25).cast("string"))
    event = lambda i: F.struct(
        F.concat(F.lit("talk "), i.cast("string"), F.lit(" of "), F.col("unique_id")).alias("event"), F.concat(F.lit("2024.01.0"), i.cast("string")).alias("date"),
        F.concat(i.cast("string"), F.lit(" day")).alias("time_interval"), F.concat(F.lit("after talk "), (i - 1).cast("string")).alias("experience"))
    album = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("photo "), i.cast("string"), F.lit(" of "), name))
    return ep.select("unique_id", name.alias("name"), (20 + cid % 50).alias("age"),
                     F.element_at(F.array(*[F.lit(x) for x in K.GENDERS]), (cid % len(K.GENDERS) + 1).cast("int")).alias("gender"),
                     nation.alias("birthplace"), nation.alias("residence"), F.transform(F.sequence(F.lit(1), F.col("n")), event).alias("events"),
                     F.slice(album, F.lit(1), (cid % 4).cast("int")).alias("album"))


_SLOTS = dict(name="name", age="age", gender="gender", birthplace="nation", residence="nation", mobile_device="device", date="date", event="event")

ROUNDS_SQL = f"""WITH turns AS (
  SELECT *, CAST(conv_id // 100 AS VARCHAR) || ':' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn // 12 AS VARCHAR) AS unique_id,
    CAST((turn % 12) // 2 + 1 AS BIGINT) AS session_number, (conv_id * 7 + turn) % 8 AS k FROM conversations
), answered AS (
  SELECT unique_id, session_number, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS dialogue,
    flatten(list(CASE k WHEN 4 THEN [''] WHEN 5 THEN [text] WHEN 7 THEN ['A ' || text, 'B ' || text] ELSE [] END ORDER BY turn)) AS news
  FROM turns GROUP BY ALL
), ep AS (SELECT unique_id, conv_id, max(session_number) AS n FROM turns GROUP BY ALL
), rounds AS (SELECT unique_id, conv_id, n, CAST(r AS BIGINT) AS session_number FROM ep, range(1, 7) t(r) WHERE r <= n
), judged AS (
  SELECT rounds.*, dialogue, coalesce(news, []) AS news, conv_id + session_number AS g,
    CASE WHEN n_turns IS NULL OR (conv_id + session_number) % 29 = 11 THEN 'pending' WHEN (conv_id + session_number) % 17 = 3 THEN 'syntax:fail'
         WHEN (conv_id + session_number) % 19 = 5 OR n_turns = 1 THEN 'parse:fail' WHEN (conv_id + session_number) % 23 = 7 THEN 'key:fail' ELSE 'ok' END AS verdict
  FROM rounds LEFT JOIN answered USING (unique_id, session_number)
), held AS (
  SELECT *, coalesce(bool_and(verdict = 'ok') OVER w, true) AS reached,
    list_concat(list_slice(['photo 0 of Person' || conv_id, 'photo 1 of Person' || conv_id, 'photo 2 of Person' || conv_id], 1, conv_id % 4),
                coalesce(flatten(list(news) OVER w), [])) AS album
  FROM judged WINDOW w AS (PARTITION BY unique_id ORDER BY session_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), slots AS (
  SELECT *, 'Person' || conv_id AS name, 20 + conv_id % 50 AS age, {S.arr(K.GENDERS)}[conv_id % {len(K.GENDERS)} + 1] AS gender,
    'NATION_' || (conv_id % 25) AS nation, 'talk ' || session_number || ' of ' || unique_id AS event, '2024.01.0' || session_number AS date,
    coalesce(array_to_string(list_transform(album, lambda d, i: CAST(i - 1 AS VARCHAR) || '. ' || d), '; '), '') AS device,
    array_to_string(list_transform(range(1, session_number), lambda i: '- 2024.01.0' || CAST(i AS VARCHAR) || ': talk ' || CAST(i AS VARCHAR) || ' of ' || unique_id), chr(10)) AS history
  FROM held WHERE reached
)
SELECT unique_id, session_number, CASE verdict WHEN 'ok' THEN 'accepted' WHEN 'pending' THEN 'pending' ELSE 'rejected' END AS outcome,
  CASE WHEN verdict NOT IN ('ok', 'pending') THEN verdict END AS reject_reason, CAST(len(album) AS BIGINT) AS album_before,
  CAST(len(album) + CASE WHEN verdict = 'ok' THEN len(news) ELSE 0 END AS BIGINT) AS album_after,
  CASE WHEN verdict = 'ok' THEN dialogue END AS dialogue,
  CASE WHEN session_number = 1 THEN {S.render(K.FIRST_DIALOGUE_TEMPLATE, **_SLOTS)}
       ELSE {S.render(K.NEXT_DIALOGUE_TEMPLATE, history_event='history', time_interval="session_number || ' day'",
                      last_date="'2024.01.0' || (session_number - 1)", experience="'after talk ' || (session_number - 1)", **_SLOTS)} END AS prompt
FROM slots"""


@query("session_rounds", ROUNDS_SQL)
def session_rounds(spark, sf_dir):
    """Six rounds, each from what the one before accepted; the album grows with the images shared."""
    turns = _turns(Tables(spark, sf_dir).conversations)
    answers = _session_answers(turns)

    def completions(_name, requests):
        return _answer(requests.join(answers, ["unique_id", "session_number"]), F.col("answer"))
    done = ST.run_rounds(ST.session_round, _state(turns), completions, scratch_path(spark, "rounds"), rounds=6)
    out = None
    for got in done:
        for outcome in (ST.ACCEPTED, ST.REJECTED, ST.PENDING):
            rows = getattr(got, outcome).withColumn("outcome", F.lit(outcome))
            out = rows if out is None else out.unionByName(rows)
    lines = F.array_join(F.transform("utterances", lambda u: F.concat(u["speaker"], F.lit(": "), u["utterance"])), "\n")
    return out.select("unique_id", "session_number", "outcome", "reject_reason", "album_before", F.size("album").cast("bigint").alias("album_after"),
                      F.when(F.col("outcome") == "accepted", lines).alias("dialogue"), F.col("dialogue_prompt").alias("prompt"))
