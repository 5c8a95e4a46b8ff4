"""C9, C10, C12, C13, C16, C17 on nested sessions: episodes with every persona field, session slot and sharing
shape, their image requests, and the prompts cut from them.

Input (``sessions``) is one row per session::

    unique_id, session_number, PERSONA columns, SLOTS columns,
    mobile_device ARRAY<STRING>   descriptions on the device when the session was generated,
    dialogue ARRAY<STRUCT<utterance_id, speaker, utterance, shape, sharing ARRAY<STRUCT<rationale,
        image_description, image_source, keywords, image_id_from_mobile>>>>

``shape`` is what the model wrote as sharing info: ``none`` (nothing), ``dict`` (one item), ``list``, or ``other``
(a value the rules have no branch for: the turn is dropped).

Sessions of an episode meet once: one exchange by ``unique_id`` (with the answers of models, dealt the same way),
after which everything is an update inside arrays. The album only grows, so the device before an item is a prefix
of one array and a reference is a position in it (J8, W5) - no self-join, no window. An episode is a handful of
generated sessions; its arrays are bounded by that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curatio import constants as K
from curatio.functions import text as T
from curatio.functions.draws import stable_id
from curatio.operators.core import strict_drop
from curatio.plans.episodes import INT_TEXT, enumerate_album, flatten_line, inferred_speaker, normalise_speaker
from curatio.sources.io import read_partition_tree

PERSONA = ["name", "age", "gender", "birthplace", "residence", "persona_category", "persona_sent", "persona_key", "persona_value",
           "commonsense_relation", "narrative_sentence_form", "event_sequence"]
SLOTS = ["history_event", "event", "date", "time_interval", "experience"]
TEXT_LIST = "array<string>"


def read_sessions(spark: SparkSession, root: str, schema: StructType | str, only: dict[str, int] | None = None) -> DataFrame:
    """C9's input: the session files under ``root`` (S4; ``only`` prunes before the scan), with the composite key
    ``<seed>:<id>-<relation>`` (P2), without the prompt and token columns, all of which must be there (P1)."""
    rows = read_partition_tree(spark, root, schema, only=only)
    return strict_drop(rows.withColumn("unique_id", session_key("persona_seed", "id", "commonsense_relation")), K.DROPPED_COLUMNS)


def session_key(seed, ident, relation) -> Column:
    """P2."""
    return F.format_string("%s:%s-%s", *[T.col_(c).cast("string") for c in (seed, ident, relation)])


def classify(s: Column) -> Column:
    """first matching rule 1..7 of the sharing cascade on one sharing item."""
    empty = lambda c: F.coalesce(s[c], F.lit("")) == ""
    others = empty("image_description") & empty("image_source") & empty("keywords") & empty("image_id_from_mobile")
    source, ref = s["image_source"], s["image_id_from_mobile"]
    return (F.when(empty("rationale") & others, 1).when(others, 2)
            .when(empty("image_description") & (source == "mobile") & ref.isNotNull() & (ref != K.NEW_ADDED_IMAGE), 3)
            .when(empty("image_description") & (source == "internet") & ~empty("keywords"), 4)
            .when(empty("image_description") & (source == "mobile") & (ref == K.NEW_ADDED_IMAGE), 5)
            .when(~empty("image_description") & (source == "mobile") & (ref == K.NEW_ADDED_IMAGE), 6)
            .otherwise(7))


def _place(*parts) -> Column:
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def _answers(answers: DataFrame | None, name: str) -> DataFrame | None:
    """Answers ``(unique_id, place, answer)`` as one map per episode; the first by ``seq`` of a place wins."""
    if answers is None:
        return None
    first = answers.groupBy("unique_id", "place").agg(F.min(F.struct("seq", "answer"))["answer"].alias("answer"))
    return first.groupBy("unique_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "answer"))).alias(name))


def _marked(sessions: Column) -> Column:
    """Turns with their place in the dialogue, ``other`` turns dropped, items with their class, counts of new images."""
    def turn(u, i):
        items = F.transform(u["sharing"], lambda s: s.withField("class", classify(s)))
        return u.withField("place", i).withField("sharing", items)

    def counted(u):
        return u.withField("n_new", F.size(F.filter(u["sharing"], lambda s: s["class"] == 6)))

    def session(s):
        turns = F.filter(F.transform(s["dialogue"], turn), lambda u: u["shape"] != "other")
        return s.withField("dialogue", F.transform(turns, counted))

    def with_total(s):
        return s.withField("n_new", F.aggregate(s["dialogue"], F.lit(0), lambda n, u: n + u["n_new"]))
    return F.transform(F.transform(sessions, session), with_total)


def _new_before(rows: Column, i: Column) -> Column:
    """New images of the first ``i`` sessions or turns."""
    return F.aggregate(F.slice(rows, F.lit(1), i), F.lit(0), lambda n, r: n + r["n_new"])


def _resolved(s: Column, album: Column, known: Column) -> Column:
    """Description that a reference to the device stands for (null: none); ``known`` images are on it so far."""
    ref = s["image_id_from_mobile"]
    number = F.when(ref.rlike(INT_TEXT) & (ref != ""), F.trim(ref).try_cast("bigint"))
    at = F.when(number < 0, known + number).otherwise(number)
    return F.when((at >= 0) & (at < known), F.get(album, at.cast("int")))


def episodes(sessions: DataFrame, names: DataFrame | None = None, descriptions: DataFrame | None = None) -> DataFrame:
    """One row per episode: ``unique_id``, the persona fields of its first session, ``episode`` (sessions by
    number with slots, device at the start, processed dialogue, and the final device on the last one).

    ``names`` / ``descriptions``: answers to ``name_requests`` / ``description_requests`` as ``(unique_id, place,
    seq, answer)``. A turn whose speaker stays unknown has a null speaker."""
    row = F.struct("session_number", F.struct(*PERSONA).alias("persona"), *SLOTS, "mobile_device", "dialogue")
    ep = sessions.groupBy("unique_id").agg(F.array_sort(F.collect_list(row)).alias("_s"))
    for answers, name in ((_answers(names, "_names"), "_names"), (_answers(descriptions, "_texts"), "_texts")):
        ep = ep.join(answers, "unique_id", "left") if answers is not None else ep.withColumn(name, F.lit(None).cast("map<string,string>"))
    ep = ep.withColumn("_s", _marked(F.col("_s")))
    first = F.col("_s")[0]
    new = F.flatten(F.transform("_s", lambda s: F.flatten(F.transform(s["dialogue"], lambda u: F.transform(
        F.filter(u["sharing"], lambda x: x["class"] == 6), lambda x: x["image_description"])))))
    ep = ep.withColumn("_start", F.coalesce(first["mobile_device"], F.array().cast(TEXT_LIST))).withColumn("_album", F.concat("_start", new))

    album, texts, known_names, owner = F.col("_album"), F.col("_texts"), F.col("_names"), first["persona"]["name"]

    def item(s, number, place, k, before):
        text = (F.when(s["class"] == 3, F.coalesce(_resolved(s, album, before), s["image_description"]))
                .when(s["class"] == 4, F.coalesce(F.element_at(texts, _place(number, place, k)), s["image_description"]))
                .otherwise(s["image_description"]))
        return F.struct(s["rationale"].alias("rationale"), text.alias("image_description"), s["image_source"].alias("image_source"),
                        s["keywords"].alias("keywords"), s["image_id_from_mobile"].alias("image_id_from_mobile"), s["class"].alias("class"))

    def turn(u, number, before):
        items = F.transform(u["sharing"], lambda s, k: item(
            s, number, u["place"], k, before + F.size(F.filter(F.slice(u["sharing"], F.lit(1), k), lambda x: x["class"] == 6))))
        nothing = (u["shape"] == "none") | ((u["shape"] == "dict") & F.exists(u["sharing"], lambda s: s["class"].isin(1, 2)))
        inferred = inferred_speaker(F.element_at(known_names, _place(number, u["place"])), owner)
        return F.struct(
            u["utterance_id"].alias("utter_id"), F.when(u["speaker"] == "", inferred).otherwise(normalise_speaker(u["speaker"], owner)).alias("speaker"),
            u["utterance"].alias("utter"), F.when(nothing, F.lit("none")).otherwise(u["shape"]).alias("shape"),
            F.when(nothing, F.filter(items, lambda _: F.lit(False))).when(u["shape"] == "list", F.transform(
                items, lambda s: s.withField("image_id_from_mobile", F.lit(None).cast("string")))).otherwise(items).alias("sharing"),
            u["place"].alias("place"))

    def session(s, i):
        before = F.size("_start") + _new_before(F.col("_s"), i)
        device = F.slice(album, F.lit(1), before)
        whole = F.when(i == F.size("_s") - 1, enumerate_album(album))
        return F.struct(
            s["session_number"].alias("session_number"), *[s[c].alias(c) for c in SLOTS], enumerate_album(device).alias("mobile_device"),
            F.transform(s["dialogue"], lambda u, j: turn(u, s["session_number"], before + _new_before(s["dialogue"], j))).alias("dialogue"),
            whole.alias("last_added_mobile_device_image"))

    return ep.select("unique_id", *[first["persona"][c].alias(c) for c in PERSONA], F.transform("_s", session).alias("episode"))


def _rewrite(ep: DataFrame, turn) -> DataFrame:
    """Every turn of every session replaced by ``turn(session, u)``."""
    return ep.withColumn("episode", F.transform("episode", lambda s: s.withField("dialogue", F.transform(s["dialogue"], lambda u: turn(s, u)))))


def postprocess(ep: DataFrame) -> DataFrame:
    """An empty turn that shares nothing becomes ``<non verbal>``."""
    return _rewrite(ep, lambda s, u: u.withField("utter", F.when((u["utter"] == "") & (F.size(u["sharing"]) == 0), F.lit("<non verbal>"))
                                                 .otherwise(u["utter"])))


def _turns(sessions: DataFrame, carry: list[str]) -> DataFrame:
    """One row per turn with its place and the turns of its session."""
    return sessions.select("unique_id", "session_number", *carry, "dialogue", F.posexplode("dialogue").alias("place", "u"))


def name_requests(sessions: DataFrame) -> DataFrame:
    """C17: one prompt per turn without a speaker: the turns before it (``[Sharing Image]`` for a turn that shares
    something, else its words), then ``<SPEAKER>: [Sharing Image]``. No exchange: the session holds its turns, and
    only sessions with such a turn are unnested."""
    asked = _turns(sessions.filter(F.exists("dialogue", lambda u: u["speaker"] == "")), []).filter(F.col("u.speaker") == "")
    line = lambda u: flatten_line(u["speaker"], u["utterance"], F.lit(""), u["shape"] != "none", with_description=False)
    before = F.transform(F.slice("dialogue", F.lit(1), F.col("place")), line)
    text = F.array_join(F.concat(before, F.array(F.lit("<SPEAKER>: [Sharing Image]"))), "\n")
    return asked.select("unique_id", "session_number", F.col("u.utterance_id").alias("utterance_id"),
                        _place(F.col("session_number"), F.col("place")).alias("place"), T.render(K.INFER_SPEAKER_TEMPLATE, dialogue=text).alias("prompt"))


def description_requests(sessions: DataFrame) -> DataFrame:
    """One prompt per internet image with keywords but no description."""
    items = _turns(sessions, []).filter(F.col("u.shape") != "other").select(
        "unique_id", "session_number", "place", F.col("u.utterance_id").alias("utterance_id"), F.posexplode("u.sharing").alias("k", "s"))
    return items.filter(classify(F.col("s")) == 4).select(
        "unique_id", "session_number", "utterance_id", _place(F.col("session_number"), F.col("place"), F.col("k")).alias("place"),
        T.render(K.KEYWORD_DESCRIPTION_TEMPLATE, keywords="s.keywords").alias("prompt"))


def summary_requests(sessions: DataFrame) -> DataFrame:
    """A summary prompt per session; a turn that shares something is one line per item, with its description."""
    def lines(u):
        words = F.array(F.concat(u["speaker"], F.lit(": "), u["utterance"]))
        images = F.transform(u["sharing"], lambda s: F.concat(u["speaker"], F.lit(": [Sharing Image of "), s["image_description"], F.lit("]")))
        return F.when(F.size(u["sharing"]) > 0, images).otherwise(words)
    text = F.array_join(F.flatten(F.transform(F.filter("dialogue", lambda u: u["shape"] != "other"), lines)), "\n")
    return sessions.select("unique_id", "session_number",
                           T.render(K.SUMMARY_TEMPLATE, current_date="date", name="name", dialogue=text).alias("prompt"))


def annotate_images(ep: DataFrame) -> DataFrame:
    """Every image gets its uuid inside the episode: album entries by their id (so all sessions name one image
    alike, J7), list items always, a dict item if it has a description."""
    album = lambda d: F.transform(d, lambda x: x.withField("image_uuid", stable_id(F.col("unique_id"), F.lit("album"), x["image_id"])))

    def turn(s, u):
        def item(x, k):
            own = stable_id(F.col("unique_id"), s["session_number"], u["place"], k)
            return x.withField("image_uuid", F.when((u["shape"] == "list") | (F.coalesce(x["image_description"], F.lit("")) != ""), own))
        return u.withField("sharing", F.transform(u["sharing"], item))
    out = _rewrite(ep, turn)
    return out.withColumn("episode", F.transform("episode", lambda s: s.withField("mobile_device", album(s["mobile_device"])).withField(
        "last_added_mobile_device_image", album(s["last_added_mobile_device_image"]))))


REQUEST = ["name", "gender", "age", "face_image_path", "face_description"]


def image_requests(annotated: DataFrame) -> DataFrame:
    """The flat request table of annotated episodes: the final album, then every image of the dialogues, each with
    the person's name, gender, age, face path and face sentence."""
    last = F.element_at("episode", -1)["last_added_mobile_device_image"]
    one = lambda x: F.struct(x["image_uuid"].alias("image_uuid"), x["image_description"].alias("image_description"))
    shared = F.flatten(F.transform("episode", lambda s: F.flatten(F.transform(s["dialogue"], lambda u: F.transform(
        F.filter(u["sharing"], lambda x: x["image_uuid"].isNotNull()), one)))))
    return annotated.select("unique_id", F.explode(F.concat(F.transform(last, one), shared)).alias("r"), *REQUEST) \
        .select("unique_id", "r.image_uuid", "r.image_description", *REQUEST)


def route_requests(requests: DataFrame) -> DataFrame:
    """The planner's prompt of each image request."""
    return requests.withColumn("prompt", T.render(K.PLAN_TEMPLATE, name="name", gender="gender", age="age", image_description="image_description"))


def export(ep: DataFrame, cols: tuple[str, ...] = ("episode",)) -> DataFrame:
    """Nested columns as JSON text."""
    return ep.select(*[F.to_json(c).alias(c) if c in cols else F.col(c) for c in ep.columns])
