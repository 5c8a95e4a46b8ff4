"""Dialogue / episode queries over ``conversations``.

Stand-in mapping (identical in Spark and in the SQL below):
- episode ``unique_id = '<conv_id div 100>:<conv_id>-<turn div 12>'`` (P2 form
  ``seed:id-chunk``), so an episode holds ≤ 12 turns whatever a conversation's size;
  session ``(turn % 12) div 2 + 1`` (≤ 6 sessions), utterance id ``turn % 2``;
- owner ``name = 'Person<conv_id>'``; raw speaker by role (user → name / 'user' /
  'User' / '' by ``turn % 4``; assistant → the 18 assistant spellings in turn;
  system → an unknown name);
- utterance text is the whole ``text`` ('' when ``length(text) % 9 = 0``);
- one sharing item per turn whose class is planted by ``k = (7*conv_id + turn) % 8``
  (descriptions and keywords are the whole turn text);
  sharing shape ``other`` when ``(conv_id + turn) % 16 = 15`` (turn dropped);
- initial album: ``conv_id % 4`` entries ``photo <i> of <name>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio import constants as K
from curatio.functions import text as T
from curatio.plans import episodes as E
from curatio.sources.testdata import Tables
from curatio.standins.registry import query

AI_SQL = "[" + ", ".join("'" + s + "'" for s in K.ASSISTANT_SPEAKERS) + "]"


def utterances(conv: DataFrame) -> DataFrame:
    cid, turn, role, text = F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")
    name = F.concat(F.lit("Person"), cid.cast("string"))
    k = (cid * 7 + turn) % 8
    speaker = (F.when(role == "user", F.when(turn % 4 == 0, name).when(turn % 4 == 1, "user")
                      .when(turn % 4 == 2, "User").otherwise(""))
               .when(role == "assistant", F.element_at(F.array(*[F.lit(s) for s in K.ASSISTANT_SPEAKERS]),
                                                       ((cid + turn) % len(K.ASSISTANT_SPEAKERS) + 1).cast("int")))
               .otherwise("Narrator"))
    return conv.select(
        "conv_id", "turn",
        (cid / 100).cast("bigint").alias("persona_seed"),
        F.concat((cid / 100).cast("bigint").cast("string"), F.lit(":"), cid.cast("string"), F.lit("-"),
                 (turn / 12).cast("bigint").cast("string")).alias("unique_id"),
        (((turn % 12) / 2).cast("bigint") + 1).alias("session_number"),
        (turn % 2).cast("bigint").alias("utterance_id"),
        F.lit(0).cast("bigint").alias("item_pos"),
        name.alias("name"),
        speaker.alias("speaker_raw"),
        F.when(F.length(text) % 9 == 0, "").otherwise(text).alias("utterance"),
        F.when(k == 0, "").otherwise(F.concat(F.lit("to show "), role)).alias("sh_rationale"),
        F.when(k == 5, text)
         .when(k == 6, F.concat(F.lit("a photo of "), text)).otherwise("").alias("sh_description"),
        F.when(k.isin(2, 4, 5, 7), "mobile").when(k.isin(3, 6), "internet").otherwise("").alias("sh_source"),
        F.when(k == 3, text).otherwise("").alias("sh_keywords"),
        F.when(k == 2, ((F.length(text) % 7) - 2).cast("string"))
         .when(k.isin(4, 5), K.NEW_ADDED_IMAGE)
         .when(k == 7, F.when(F.length(text) % 3 == 0, "").when(F.length(text) % 3 == 1, K.NEW_IMAGE_ADDED)
               .otherwise("abc"))
         .when(k.isin(0, 1), "").otherwise(F.lit(None).cast("string")).alias("sh_id"),
        F.when((cid + turn) % 16 == 15, "other").otherwise("dict").alias("sh_shape"),
    )


def initial_album(utt: DataFrame) -> DataFrame:
    ep = utt.select("unique_id", "conv_id", "name").distinct()
    n0 = (F.col("conv_id") % 4).cast("int")
    return ep.select("unique_id", "name", F.explode(F.when(n0 > 0, F.sequence(F.lit(0), n0 - 1))
                                                    .otherwise(F.array().cast("array<int>"))).alias("pos")) \
        .select("unique_id", F.col("pos").cast("bigint"),
                F.concat(F.lit("photo "), F.col("pos").cast("string"), F.lit(" of "), F.col("name")).alias("description"))


UTT_SQL = f"""utt0 AS (
  SELECT conv_id, turn, role, text, (conv_id * 7 + turn) % 8 AS k,
    CAST(conv_id // 100 AS BIGINT) AS persona_seed,
    CAST(conv_id // 100 AS VARCHAR) || ':' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn // 12 AS VARCHAR) AS unique_id,
    CAST((turn % 12) // 2 + 1 AS BIGINT) AS session_number,
    CAST(turn % 2 AS BIGINT) AS utterance_id, CAST(0 AS BIGINT) AS item_pos,
    'Person' || CAST(conv_id AS VARCHAR) AS name
  FROM conversations
), utt AS (
  SELECT conv_id, turn, persona_seed, unique_id, session_number, utterance_id, item_pos, name,
    CASE role WHEN 'user' THEN CASE turn % 4 WHEN 0 THEN name WHEN 1 THEN 'user' WHEN 2 THEN 'User' ELSE '' END
              WHEN 'assistant' THEN {AI_SQL}[(conv_id + turn) % {len(K.ASSISTANT_SPEAKERS)} + 1]
              ELSE 'Narrator' END AS speaker_raw,
    CASE WHEN length(text) % 9 = 0 THEN '' ELSE text END AS utterance,
    CASE WHEN k = 0 THEN '' ELSE 'to show ' || role END AS sh_rationale,
    CASE WHEN k = 5 THEN text WHEN k = 6 THEN 'a photo of ' || text ELSE '' END AS sh_description,
    CASE WHEN k IN (2, 4, 5, 7) THEN 'mobile' WHEN k IN (3, 6) THEN 'internet' ELSE '' END AS sh_source,
    CASE WHEN k = 3 THEN text ELSE '' END AS sh_keywords,
    CASE WHEN k = 2 THEN CAST(length(text) % 7 - 2 AS VARCHAR)
         WHEN k IN (4, 5) THEN 'new added image'
         WHEN k = 7 THEN CASE length(text) % 3 WHEN 0 THEN '' WHEN 1 THEN 'new image added' ELSE 'abc' END
         WHEN k IN (0, 1) THEN '' END AS sh_id,
    CASE WHEN (conv_id + turn) % 16 = 15 THEN 'other' ELSE 'dict' END AS sh_shape
  FROM utt0
)"""

CLASS_SQL = """CASE
  WHEN sh_rationale = '' AND sh_description = '' AND sh_source = '' AND sh_keywords = '' AND coalesce(sh_id, '') = '' THEN 1
  WHEN sh_rationale <> '' AND sh_description = '' AND sh_source = '' AND sh_keywords = '' AND coalesce(sh_id, '') = '' THEN 2
  WHEN sh_description = '' AND sh_source = 'mobile' AND sh_id IS NOT NULL AND sh_id <> 'new added image' THEN 3
  WHEN sh_description = '' AND sh_source = 'internet' AND length(sh_keywords) <> 0 THEN 4
  WHEN sh_description = '' AND sh_source = 'mobile' AND coalesce(sh_id, '') = 'new added image' THEN 5
  WHEN sh_description <> '' AND sh_source = 'mobile' AND sh_id = 'new added image' THEN 6
  ELSE 7 END"""

ALBUM_SQL = f"""{UTT_SQL},
items0 AS (SELECT *, {CLASS_SQL} AS sharing_class FROM utt WHERE sh_shape <> 'other'),
init AS (
  SELECT unique_id, CAST(p AS BIGINT) AS pos, 'photo ' || CAST(p AS VARCHAR) || ' of ' || name AS description
  FROM (SELECT DISTINCT unique_id, conv_id, name FROM utt), LATERAL (SELECT unnest(range(0, conv_id % 4)) AS p)
),
n0 AS (SELECT unique_id, count(*) AS n0 FROM init GROUP BY 1),
items1 AS (
  SELECT i.*, CAST(coalesce(n0.n0, 0) AS BIGINT) AS n0,
    CAST(coalesce(n0.n0, 0) + coalesce(sum(CASE WHEN sharing_class = 6 THEN 1 ELSE 0 END) OVER (
      PARTITION BY i.unique_id ORDER BY session_number, utterance_id, item_pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS len_before
  FROM items0 i LEFT JOIN n0 USING (unique_id)
),
album AS (
  SELECT unique_id, pos, description, CAST(0 AS BIGINT) AS session_added FROM init
  UNION ALL SELECT unique_id, len_before, sh_description, session_number FROM items1 WHERE sharing_class = 6
),
items2 AS (
  SELECT *,
    CASE WHEN sharing_class <> 3 THEN NULL WHEN sh_id = '' OR sh_id = 'new image added' THEN 'kept'
         WHEN regexp_matches(sh_id, '^[\\s]*[+-]?[0-9]+[\\s]*$') THEN 'ref' ELSE 'bad_id' END AS kind,
    CASE WHEN sharing_class = 3 AND regexp_matches(sh_id, '^[\\s]*[+-]?[0-9]+[\\s]*$') AND sh_id NOT IN ('', 'new image added')
         THEN CAST(trim(sh_id) AS BIGINT) END AS ref
  FROM items1
),
items3 AS (
  SELECT *, CASE WHEN (CASE WHEN ref < 0 THEN len_before + ref ELSE ref END) >= 0
                  AND (CASE WHEN ref < 0 THEN len_before + ref ELSE ref END) < len_before
                 THEN (CASE WHEN ref < 0 THEN len_before + ref ELSE ref END) END AS ref_idx
  FROM items2
),
items AS (
  SELECT items3.*, a.description AS resolved_description,
    CASE WHEN kind IS NULL THEN NULL WHEN kind <> 'ref' THEN kind
         WHEN ref_idx IS NOT NULL THEN 'resolved' ELSE 'out_of_range' END AS ref_status
  FROM items3 LEFT JOIN album a ON a.unique_id = items3.unique_id AND a.pos = items3.ref_idx
)"""


def _album(spark, sf_dir):
    utt = utterances(Tables(spark, sf_dir).conversations)
    return E.album_state(utt, initial_album(utt))


@query("album_state", f"""WITH {ALBUM_SQL}
SELECT unique_id, session_number, utterance_id, CAST(sharing_class AS BIGINT) AS sharing_class, len_before,
       coalesce(CASE WHEN sharing_class = 6 THEN len_before END, -1) AS album_pos, coalesce(ref_idx, -1) AS ref_idx,
       ref_status, resolved_description
FROM items""")
def album_state(spark, sf_dir):
    x = _album(spark, sf_dir).items
    # -1 = no album position / no valid reference (keeps the integer columns non-null)
    return x.select("unique_id", "session_number", "utterance_id", F.col("sharing_class").cast("bigint"),
                    "len_before", F.coalesce("album_pos", F.lit(-1)).cast("bigint").alias("album_pos"),
                    F.coalesce("ref_idx", F.lit(-1)).cast("bigint").alias("ref_idx"), "ref_status",
                    "resolved_description")


@query("album_sessions", f"""WITH {ALBUM_SQL},
per AS (
  SELECT unique_id, session_number, max(n0) AS n0, sum(CASE WHEN sharing_class = 6 THEN 1 ELSE 0 END) AS added
  FROM items GROUP BY 1, 2
), per2 AS (
  SELECT *, CAST(n0 + coalesce(sum(added) OVER (PARTITION BY unique_id ORDER BY session_number
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_start,
         CAST(session_number = max(session_number) OVER (PARTITION BY unique_id) AS BIGINT) AS is_last
  FROM per
)
SELECT p.unique_id, p.session_number, p.n_start, CAST(p.n_start + p.added AS BIGINT) AS n_end, p.is_last,
       coalesce((SELECT string_agg(CAST(a.pos AS VARCHAR) || '. ' || a.description, chr(10) ORDER BY a.pos)
                 FROM album a WHERE a.unique_id = p.unique_id AND a.pos < p.n_start), '') AS start_album
FROM per2 p""")
def album_sessions(spark, sf_dir):
    return _album(spark, sf_dir).sessions


@query("sharing_class", f"""WITH {UTT_SQL}
SELECT unique_id, session_number, utterance_id, sh_shape,
       CAST(CASE WHEN sh_shape = 'other' THEN 0 ELSE {CLASS_SQL} END AS BIGINT) AS sharing_class
FROM utt""")
def sharing_class(spark, sf_dir):
    utt = utterances(Tables(spark, sf_dir).conversations)
    return utt.select("unique_id", "session_number", "utterance_id", "sh_shape",
                      F.when(F.col("sh_shape") == "other", 0).otherwise(E.sharing_class()).cast("bigint")
                      .alias("sharing_class"))


def _inference_answer() -> F.Column:
    """C17 stand-in completion for turns whose speaker is empty."""
    m = F.col("conv_id") % 4
    return (F.when(m == 0, "User").when(m == 1, "ai assistant").when(m == 2, F.upper("name")).otherwise("Bob"))


INFER_SQL = "CASE conv_id % 4 WHEN 0 THEN 'User' WHEN 1 THEN 'ai assistant' WHEN 2 THEN upper(name) ELSE 'Bob' END"
SPEAKER_SQL = f"""CASE WHEN speaker_raw = name THEN name
  WHEN lower(speaker_raw) = 'user' OR speaker_raw IN ('사용자', '스프재') THEN name
  WHEN speaker_raw IN ({", ".join("'" + s + "'" for s in K.ASSISTANT_SPEAKERS)}) THEN 'AI Assistant'
  WHEN speaker_raw = '' THEN CASE WHEN lower({INFER_SQL}) = 'user' THEN name
                                  WHEN lower({INFER_SQL}) = 'ai assistant' THEN 'AI Assistant'
                                  WHEN lower({INFER_SQL}) = lower(name) THEN name END
  ELSE name END"""
RULE_SQL = f"""CASE WHEN speaker_raw = name THEN 'owner'
  WHEN lower(speaker_raw) = 'user' OR speaker_raw IN ('사용자', '스프재') THEN 'owner_alias'
  WHEN speaker_raw IN ({", ".join("'" + s + "'" for s in K.ASSISTANT_SPEAKERS)}) THEN 'assistant'
  WHEN speaker_raw = '' THEN 'infer' ELSE 'unknown' END"""


def _request_id() -> F.Column:
    from curatio.functions.draws import stable_id
    return stable_id("unique_id", "session_number", "utterance_id", "item_pos")


def _speaker(utt: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """X11 for known spellings; empty speakers go through C17: request rows, a
    completions table keyed by request id (stand-in answers), J13 attach, X12 map.
    ``base`` is the cheap raw utterance table the requests are cut from (so a
    heavier processed ``utt`` is not evaluated twice)."""
    from curatio.plans.worklist import attach_completions
    norm = E.normalise_speaker("speaker_raw", "name")
    x = utt.withColumn("request_id", _request_id())
    src = x if base is None else base.withColumn("request_id", _request_id())
    req = src.filter(F.col("speaker_raw") == "").select("request_id", "name", "conv_id")
    comp = req.select("request_id", F.lit(0).alias("seq"), _inference_answer().alias("generation"))
    answers = attach_completions(req.drop("conv_id"), comp).attached \
        .select("request_id", E.inferred_speaker(F.col("generation"), F.col("name")).alias("_inferred"))
    x = x.join(answers, "request_id", "left")
    return x.withColumn("speaker_rule", E.speaker_rule("speaker_raw", "name")) \
        .withColumn("speaker", F.when(F.col("speaker_raw") == "", F.col("_inferred")).otherwise(norm)) \
        .drop("_inferred", "request_id")


@query("speaker_normalise", f"""WITH {UTT_SQL}
SELECT unique_id, session_number, utterance_id, speaker_raw, {RULE_SQL} AS speaker_rule, {SPEAKER_SQL} AS speaker
FROM utt""")
def speaker_normalise(spark, sf_dir):
    utt = _speaker(utterances(Tables(spark, sf_dir).conversations))
    return utt.select("unique_id", "session_number", "utterance_id", "speaker_raw", "speaker_rule", "speaker")


@query("non_verbal_fill", f"""WITH {UTT_SQL}
SELECT unique_id, session_number, utterance_id,
       CASE WHEN utterance = '' AND ({CLASS_SQL}) IN (1, 2) THEN '<non verbal>' ELSE utterance END AS utterance
FROM utt WHERE sh_shape <> 'other'""")
def non_verbal_fill(spark, sf_dir):
    utt = utterances(Tables(spark, sf_dir).conversations).filter(F.col("sh_shape") != "other")
    has = ~E.sharing_class().isin(1, 2)
    return utt.select("unique_id", "session_number", "utterance_id",
                      E.fill_non_verbal("utterance", has).alias("utterance"))


def _flat_sessions(utt: DataFrame) -> DataFrame:
    """P10 per session over the generation-stage dialogue (raw speakers)."""
    has = ~E.sharing_class().isin(1, 2)
    line = E.flatten_line("speaker_raw", "utterance", "sh_description", has)
    return utt.filter(F.col("sh_shape") != "other").groupBy("unique_id", "session_number").agg(
        F.array_join(E.nest_sorted(["utterance_id", "item_pos"], line), "\n").alias("dialogue"),
        F.max("name").alias("name"))


FLAT_SQL = f"""flat AS (
  SELECT unique_id, session_number, max(name) AS name,
    string_agg(speaker_raw || ': ' || CASE WHEN ({CLASS_SQL}) IN (1, 2) THEN utterance
                                         ELSE '[Sharing Image of ' || sh_description || ']' END,
               chr(10) ORDER BY utterance_id, item_pos) AS dialogue
  FROM utt WHERE sh_shape <> 'other' GROUP BY 1, 2
)"""


@query("dialogue_flatten", f"WITH {UTT_SQL}, {FLAT_SQL} SELECT unique_id, session_number, dialogue FROM flat")
def dialogue_flatten(spark, sf_dir):
    return _flat_sessions(utterances(Tables(spark, sf_dir).conversations)).select("unique_id", "session_number",
                                                                                  "dialogue")


def session_date(session_number) -> F.Column:
    return F.concat(F.lit("2024.01."), F.lpad(T.col_(session_number).cast("string"), 2, "0"))


@query("summary_requests", f"""WITH {UTT_SQL}, {FLAT_SQL}
SELECT unique_id, session_number,
  'The current time and date are ' || ('2024.01.' || lpad(CAST(session_number AS VARCHAR), 2, '0')) || '. ' || name
  || ' and AI assistant talked today and had the following conversation:' || chr(10) || chr(10) || dialogue
  || chr(10) || chr(10) || 'Summarize the conversation between ' || name || ' and AI assistant so far. Include key '
  || 'details and include time references wherever possible.' || chr(10) || chr(10) || 'Summarization: ' AS prompt
FROM flat""")
def summary_requests(spark, sf_dir):
    f = _flat_sessions(utterances(Tables(spark, sf_dir).conversations))
    return f.select("unique_id", "session_number",
                    T.render(K.SUMMARY_TEMPLATE, current_date=session_date("session_number"), name="name",
                             dialogue="dialogue").alias("prompt"))


def _final_items(spark, sf_dir, st=None) -> DataFrame:
    """Items after the cascade: speaker resolved, description resolved (rule 3 via
    the album, rule 4 via a keyword-description completion, C18). Request tables are
    cut from the raw utterances; the album pipeline is evaluated once."""
    from curatio.plans.worklist import attach_completions
    st = st or _album(spark, sf_dir)
    raw = utterances(Tables(spark, sf_dir).conversations).filter(F.col("sh_shape") != "other") \
        .withColumn("sharing_class", E.sharing_class())
    x = _speaker(st.items, base=raw).withColumn("request_id", _request_id())
    # Keyword-description requests answered by a completions table (stand-in answers), J13 attach
    req = E.keyword_description_requests(raw.withColumn("request_id", _request_id())) \
        .select("request_id", "sh_keywords")
    comp = req.select("request_id", F.lit(0).alias("seq"),
                      F.concat(F.lit("an image of "), F.col("sh_keywords")).alias("generation"))
    described = attach_completions(req.select("request_id"), comp).attached \
        .select("request_id", F.col("generation").alias("_generated"))
    x = x.join(described, "request_id", "left")
    desc = (F.when(F.col("sharing_class") == 3, F.coalesce("resolved_description", "sh_description"))
            .when(F.col("sharing_class") == 4, F.col("_generated"))
            .otherwise(F.col("sh_description")))
    return x.withColumn("sh_description", desc).drop("_generated", "request_id") \
        .withColumn("utterance", E.fill_non_verbal("utterance", ~F.col("sharing_class").isin(1, 2)))


FINAL_SQL = f"""final AS (
  SELECT items.*, {SPEAKER_SQL} AS speaker,
    CASE WHEN sharing_class = 3 THEN coalesce(resolved_description, sh_description)
         WHEN sharing_class = 4 THEN 'an image of ' || sh_keywords ELSE sh_description END AS final_description,
    CASE WHEN utterance = '' AND sharing_class IN (1, 2) THEN '<non verbal>' ELSE utterance END AS final_utterance
  FROM items
)"""


@query("episodes_nested", f"""WITH {ALBUM_SQL}, {FINAL_SQL},
turns AS (
  SELECT unique_id, session_number, utterance_id, max(persona_seed) AS persona_seed, max(name) AS name,
    CAST(utterance_id AS VARCHAR) || '|' || coalesce(arg_min(speaker, item_pos), '?') || '|' || arg_min(final_utterance, item_pos)
      || string_agg('|' || CAST(sharing_class AS VARCHAR) || '|' || final_description, '' ORDER BY item_pos) AS line
  FROM final GROUP BY 1, 2, 3
),
sess AS (
  SELECT unique_id, session_number, max(persona_seed) AS persona_seed, max(name) AS name,
    string_agg(line, chr(10) ORDER BY utterance_id) AS d
  FROM turns GROUP BY 1, 2
)
SELECT unique_id, arg_min(persona_seed, session_number) AS persona_seed, arg_min(name, session_number) AS name,
       count(*) AS n_sessions,
       string_agg('S' || CAST(session_number AS VARCHAR) || chr(10) || d, chr(10) || chr(10) ORDER BY session_number) AS episode
FROM sess GROUP BY unique_id""")
def episodes_nested(spark, sf_dir):
    x = _final_items(spark, sf_dir)
    ep = E.assemble_episodes(x, ["persona_seed", "name"])
    item = lambda i: F.concat_ws("|", i["sharing_class"].cast("string"), i["sh_description"])
    line = lambda u: F.concat_ws("|", u["utterance_id"].cast("string"), F.coalesce(u["speaker"], F.lit("?")),
                                 u["utterance"], F.transform(u["sharing"], item))
    text = F.array_join(F.transform("sessions", lambda s: F.concat(
        F.lit("S"), s["session_number"].cast("string"), F.lit("\n"),
        F.array_join(F.transform(s["dialogue"], line), "\n"))), "\n\n")
    return ep.select("unique_id", "persona_seed", "name", F.size("sessions").cast("bigint").alias("n_sessions"),
                     text.alias("episode"))


@query("image_requests", f"""WITH {ALBUM_SQL}, {FINAL_SQL}
SELECT md5(unique_id || '|album|' || CAST(pos AS VARCHAR)) AS image_uuid, 'album' AS origin, unique_id,
       description AS image_description FROM album
UNION ALL
SELECT md5(unique_id || '|' || CAST(session_number AS VARCHAR) || '|' || CAST(utterance_id AS VARCHAR) || '|'
           || CAST(item_pos AS VARCHAR)), 'dialogue', unique_id, final_description
FROM final WHERE sharing_class NOT IN (1, 2) AND final_description <> ''""")
def image_requests(spark, sf_dir):
    st = _album(spark, sf_dir)
    x = _final_items(spark, sf_dir, st)
    album = st.album.select(F.md5(F.concat_ws("|", "unique_id", F.lit("album"), F.col("pos").cast("string")))
                            .alias("image_uuid"), F.lit("album").alias("origin"), "unique_id",
                            F.col("description").alias("image_description"))
    dia = x.filter(~F.col("sharing_class").isin(1, 2) & (F.col("sh_description") != "")).select(
        F.md5(F.concat_ws("|", "unique_id", F.col("session_number").cast("string"),
                          F.col("utterance_id").cast("string"), F.col("item_pos").cast("string"))).alias("image_uuid"),
        F.lit("dialogue").alias("origin"), "unique_id", F.col("sh_description").alias("image_description"))
    return album.unionByName(dia)


# ---- C8 parse: dialogue generations as Python-literal text ------------------------------
from curatio.plans import dialogue as DG  # noqa: E402


def _esc(c):
    """Python single-quoted literal body of a text."""
    c = F.replace(T.col_(c), F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit("'"), F.lit("\\'"))
    return F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def _session_literal(utt, item, wrap):
    g = utt.groupBy("unique_id", "session_number", "conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_join(E.nest_sorted(["utterance_id", "item_pos"], item), ", ").alias("body"))
    lit = wrap(F.col("body"))
    gen = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("```json\n"), lit, F.lit("\n```"))).otherwise(lit)
    return g.withColumn("generation", gen)


def literal_generations(utt):
    d = (F.col("conv_id") + F.col("session_number")) % 6
    item = F.concat(F.lit("{'utterance_id': "), F.col("utterance_id").cast("string"),
                    F.lit(", 'speaker': '"), _esc("speaker_raw"), F.lit("', 'utterance': '"), _esc("utterance"),
                    F.lit("', 'sharing_info': "), F.when(d == 2, F.lit("None")).otherwise(F.lit("{}")), F.lit("}"))
    wrap = lambda b: (F.when(d == 0, F.concat(F.lit("["), b, F.lit(", true]")))
                      .when(d == 1, F.concat(F.lit("["), b, F.lit(",]")))
                      .when(d == 3, F.concat(F.lit("{'dialogue': ["), b, F.lit("]}")))
                      .when(d == 4, F.concat(F.lit("["), b))
                      .otherwise(F.concat(F.lit("["), b, F.lit("]"))))
    return _session_literal(utt, item, wrap)


@query("literal_parse", f"""WITH {UTT_SQL},
s AS (
  SELECT unique_id, session_number, max(conv_id) AS conv_id, count(*) AS n_turns,
    string_agg(CAST(utterance_id AS VARCHAR) || ' ' || speaker_raw || ': ' || utterance, chr(10) ORDER BY utterance_id, item_pos) AS content
  FROM utt GROUP BY 1, 2
)
SELECT unique_id, session_number,
  CASE WHEN (conv_id + session_number) % 6 IN (0, 4) THEN 'syntax:fail'
       WHEN (conv_id + session_number) % 6 = 3 OR n_turns = 1 THEN 'parse:fail' ELSE 'ok' END AS verdict,
  CASE WHEN (conv_id + session_number) % 6 IN (0, 4) THEN NULL
       WHEN (conv_id + session_number) % 6 = 3 THEN 'dict' ELSE 'list' END AS shape,
  CAST(CASE WHEN (conv_id + session_number) % 6 IN (0, 3, 4) THEN -1 ELSE n_turns END AS BIGINT) AS n_items,
  CASE WHEN (conv_id + session_number) % 6 NOT IN (0, 3, 4) THEN content END AS content
FROM s""")
def literal_parse(spark, sf_dir):
    gens = literal_generations(utterances(Tables(spark, sf_dir).conversations))
    r = DG.dialogue_parse(gens).annotated
    return r.select("unique_id", "session_number", "verdict", "shape", F.col("n_items").cast("bigint"), _spoken().alias("content"))


def _spoken(*more) -> F.Column:
    """Whole text of the parsed utterances, each with ``more(utterance)`` behind it."""
    line = lambda u: F.concat(u["utterance_id"], F.lit(" "), u["speaker"], F.lit(": "), u["utterance"], *[m(u) for m in more])
    return F.array_join(F.transform("utterances", line), "\n")


def _full_sharing():
    return F.concat(F.lit("{'rationale': '"), _esc("sh_rationale"), F.lit("', 'image_description': '"),
                    _esc("sh_description"), F.lit("', 'image_source': '"), F.col("sh_source"),
                    F.lit("', 'keywords': '"), _esc("sh_keywords"), F.lit("'"),
                    F.when(F.col("sh_id").isNotNull(),
                           F.concat(F.lit(", 'image_id_from_mobile': '"), _esc("sh_id"), F.lit("'"))).otherwise(""),
                    F.lit("}"))


def validation_generations(utt):
    e = (F.col("conv_id") * 3 + F.col("session_number")) % 5
    no_kw = F.concat(F.lit("{'rationale': '"), _esc("sh_rationale"), F.lit("', 'image_description': '"),
                     _esc("sh_description"), F.lit("', 'image_source': '"), F.col("sh_source"), F.lit("'}"))
    sharing = (F.when(e == 0, F.lit("{}")).when(e == 1, no_kw)
               .when(e == 2, F.concat(F.lit("["), _full_sharing(),
                                      F.lit(", {'rationale': 'r', 'image_description': '', 'image_source': ''}]")))
               .otherwise(_full_sharing()))
    speaker = F.when((e == 3) & (F.col("utterance_id") == 0), F.lit("")) \
        .otherwise(F.concat(F.lit(", 'speaker': '"), _esc("speaker_raw"), F.lit("'")))
    item = F.concat(F.lit("{'utterance_id': "), F.col("utterance_id").cast("string"), speaker,
                    F.lit(", 'utterance': '"), _esc("utterance"), F.lit("', 'sharing_info': "), sharing, F.lit("}"))
    return _session_literal(utt, item, lambda b: F.concat(F.lit("["), b, F.lit("]")))


VALIDATE_SQL = f"""WITH {UTT_SQL},
s AS (
  SELECT unique_id, session_number, max(conv_id) AS conv_id, count(*) AS n_turns,
    sum(CASE WHEN sh_rationale = '' AND sh_description = '' AND sh_source = '' AND sh_keywords = '' AND coalesce(sh_id, '') = '' THEN 1 ELSE 0 END) AS n_empty,
    sum(CASE WHEN sh_rationale <> '' AND sh_description = '' AND sh_source = '' AND sh_keywords = '' AND coalesce(sh_id, '') = '' THEN 1 ELSE 0 END) AS n_rat,
    string_agg(CAST(utterance_id AS VARCHAR) || ' ' || speaker_raw || ': ' || utterance || CASE WHEN (conv_id * 3 + session_number) % 5 = 4
      THEN ' | ' || sh_rationale || ' | ' || sh_description || ' | ' || sh_source || ' | ' || sh_keywords || ' | ' || coalesce(sh_id, '-') ELSE '' END,
      chr(10) ORDER BY utterance_id, item_pos) AS content
  FROM utt GROUP BY 1, 2
), v AS (
  SELECT *, CASE WHEN n_turns = 1 THEN 'parse:fail' WHEN (conv_id * 3 + session_number) % 5 IN (1, 2, 3) THEN 'key:fail'
                 ELSE 'ok' END AS verdict FROM s
)
SELECT unique_id, session_number, verdict, CAST(n_turns AS BIGINT) AS n_items,
  CAST(CASE WHEN verdict = 'ok' AND (conv_id * 3 + session_number) % 5 = 4 THEN n_empty ELSE 0 END AS BIGINT) AS n_all_empty,
  CAST(CASE WHEN verdict = 'ok' AND (conv_id * 3 + session_number) % 5 = 4 THEN n_rat ELSE 0 END AS BIGINT) AS n_only_rationale,
  CASE WHEN verdict = 'ok' THEN content END AS content
FROM v"""


@query("dialogue_validate", VALIDATE_SQL)
def dialogue_validate(spark, sf_dir):
    gens = validation_generations(utterances(Tables(spark, sf_dir).conversations))
    return validated(DG.dialogue_parse(gens).annotated)


def validated(annotated):
    """Verdicts and counts and, of accepted generations, everything that was parsed."""
    def sharing(u):
        m = F.from_json(u["sharing_info"], "map<string,string>")
        return F.when(F.size(m) > 0, F.concat(*[F.concat(F.lit(" | "), F.coalesce(m[k], F.lit("-"))) for k in (
            "rationale", "image_description", "image_source", "keywords", "image_id_from_mobile")])).otherwise("")
    r = DG.sharing_stats(annotated)
    return r.select("unique_id", "session_number", "verdict", F.col("n_items").cast("bigint"),
                    F.col("n_all_empty").cast("bigint"), F.col("n_only_rationale").cast("bigint"),
                    F.when(F.col("verdict") == "ok", _spoken(sharing)).alias("content"))


@query("dialogue_report", f"""WITH v AS ({VALIDATE_SQL})
SELECT 'dialogue' AS stage, metric, CAST(value AS BIGINT) AS value FROM (
  SELECT 'dialogue_syntax:fail' AS metric, 0 AS value
  UNION ALL SELECT 'dialogue_parse:fail', count(*) FILTER (WHERE verdict = 'parse:fail') FROM v
  UNION ALL SELECT 'dialogue_key_existence:fail', count(*) FILTER (WHERE verdict = 'key:fail') FROM v
  UNION ALL SELECT 'dialogue:total', count(*) FROM v)""")
def dialogue_report(spark, sf_dir):
    """A1 under the dialogue stage's metric names."""
    return DG.dialogue_parse(validation_generations(utterances(Tables(spark, sf_dir).conversations))).report


# ---- J7 / W9 / X23 / P6 -------------------------------------------------------------------

@query("session_album_uuids", f"""WITH {ALBUM_SQL},
per AS (
  SELECT unique_id, session_number, max(n0) AS n0, sum(CASE WHEN sharing_class = 6 THEN 1 ELSE 0 END) AS added
  FROM items GROUP BY 1, 2
), per2 AS (
  SELECT *, CAST(n0 + coalesce(sum(added) OVER (PARTITION BY unique_id ORDER BY session_number
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_start FROM per
)
SELECT p.unique_id, p.session_number, a.pos, a.description,
       md5(p.unique_id || '|album|' || CAST(a.pos AS VARCHAR)) AS image_uuid
FROM per2 p JOIN album a ON a.unique_id = p.unique_id AND a.pos < p.n_start""")
def session_album_uuids(spark, sf_dir):
    st = _album(spark, sf_dir)
    return E.session_album_uuids(st.sessions, st.album).select("unique_id", "session_number", "pos", "description",
                                                               "image_uuid")


@query("episodes_export", f"""WITH {ALBUM_SQL}, {FINAL_SQL},
ann AS (
  SELECT *, CASE WHEN sharing_class NOT IN (1, 2) AND final_description <> ''
                 THEN md5(unique_id || '|' || CAST(session_number AS VARCHAR) || '|' || CAST(utterance_id AS VARCHAR)
                          || '|' || CAST(item_pos AS VARCHAR)) ELSE '' END AS image_uuid
  FROM final
), sess AS (
  SELECT unique_id, session_number,
         list({{'utterance_id': utterance_id, 'speaker': coalesce(speaker, '?'), 'utterance': final_utterance,
                'image_description': final_description, 'image_uuid': image_uuid}} ORDER BY utterance_id, item_pos) AS dialogue
  FROM ann GROUP BY 1, 2
)
SELECT unique_id, CAST(to_json(list({{'session_number': session_number, 'dialogue': dialogue}} ORDER BY session_number)) AS VARCHAR) AS episode
FROM sess GROUP BY unique_id""")
def episodes_export(spark, sf_dir):
    """Episodes with per-item image uuids, nested and written as JSON text."""
    x = E.annotate_dialogue(_final_items(spark, sf_dir))
    utt = F.struct("utterance_id", F.coalesce("speaker", F.lit("?")).alias("speaker"), "utterance",
                   F.col("sh_description").alias("image_description"),
                   F.coalesce("image_uuid", F.lit("")).alias("image_uuid"))
    sess = x.groupBy("unique_id", "session_number").agg(
        E.nest_sorted(["utterance_id", "item_pos"], utt).alias("dialogue"))
    ep = sess.groupBy("unique_id").agg(
        E.nest_sorted(["session_number"], F.struct("session_number", "dialogue")).alias("episode"))
    return E.export_episodes(ep, ["episode"])
