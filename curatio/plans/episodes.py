"""Final episode assembly over the utterance grain.

Input grain is one row per sharing item of an utterance::

    unique_id, session_number, utterance_id, item_pos, speaker, utterance,
    sh_rationale, sh_description, sh_source, sh_keywords, sh_id (NULL = key absent),
    sh_shape ('none' | 'dict' | 'list' | 'other')

The source pipeline walks every episode with a Python loop that threads an
album list through turns and sessions. Here the album is a relation: a running
count of appended images gives each new image its position, and a reference is a
position in the episode's whole album, looked up in the same window. Windows are partitioned by ``unique_id`` (an episode has at most six
sessions of one generated dialogue each, so a partition is small).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatio import constants as K
from curatio.functions import text as T

ITEM_ORDER = ["session_number", "utterance_id", "item_pos"]


# ---- X11 / X12 speakers --------------------------------------------------------------

def normalise_speaker(speaker, owner) -> Column:
    """X11: owner spellings → owner, assistant spellings → 'AI Assistant', '' → NULL
    (to be inferred, C17), anything else → owner (kept quirk)."""
    s, o = T.col_(speaker), T.col_(owner)
    return (F.when(s == o, o)
            .when((F.lower(s) == "user") | s.isin(*K.OWNER_SPEAKERS), o)
            .when(s.isin(*K.ASSISTANT_SPEAKERS), F.lit("AI Assistant"))
            .when(s == "", F.lit(None).cast("string"))
            .otherwise(o))


def speaker_rule(speaker, owner) -> Column:
    s, o = T.col_(speaker), T.col_(owner)
    return (F.when(s == o, "owner").when((F.lower(s) == "user") | s.isin(*K.OWNER_SPEAKERS), "owner_alias")
            .when(s.isin(*K.ASSISTANT_SPEAKERS), "assistant").when(s == "", "infer").otherwise("unknown"))


def inferred_speaker(answer, owner) -> Column:
    """A name-inference completion → speaker; NULL = unusable answer (reject)."""
    a, o = F.lower(T.col_(answer)), T.col_(owner)
    return (F.when(a == "user", o).when(a == "ai assistant", F.lit("AI Assistant"))
            .when(a == F.lower(o), o).otherwise(F.lit(None).cast("string")))


# ---- F10 sharing cascade ---------------------------------------------------------------

def sharing_class() -> Column:
    """first matching rule 1..7 of the sharing cascade on the typed item columns."""
    desc, src, kw, rid, rat = (F.col("sh_description"), F.col("sh_source"), F.col("sh_keywords"),
                               F.col("sh_id"), F.col("sh_rationale"))
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return (F.when(empty(rat) & empty(desc) & empty(src) & empty(kw) & empty(rid), 1)
            .when(~empty(rat) & empty(desc) & empty(src) & empty(kw) & empty(rid), 2)
            .when(empty(desc) & (src == "mobile") & rid.isNotNull() & (rid != K.NEW_ADDED_IMAGE), 3)
            .when(empty(desc) & (src == "internet") & (F.length(F.coalesce(kw, F.lit(""))) != 0), 4)
            .when(empty(desc) & (src == "mobile") & (F.coalesce(rid, F.lit("")) == K.NEW_ADDED_IMAGE), 5)
            .when(~empty(desc) & (src == "mobile") & (rid == K.NEW_ADDED_IMAGE), 6)
            .otherwise(7))


INT_TEXT = r"^[\s]*[+-]?[0-9]+[\s]*$"


def album_reference() -> tuple[Column, Column]:
    """Rule 3 detail: (kind, reference int). kind ∈ kept | ref | bad_id."""
    rid = F.col("sh_id")
    kind = (F.when((rid == "") | (rid == K.NEW_IMAGE_ADDED), "kept")
            .when(rid.rlike(INT_TEXT), "ref").otherwise("bad_id"))
    return kind, F.when(kind == "ref", F.trim(rid).try_cast("bigint"))


# ---- §8.6 album state ------------------------------------------------------------------

@dataclass
class AlbumState:
    items: DataFrame      # item grain + sharing_class, len_before, album_pos, ref_status, resolved_description
    album: DataFrame      # unique_id, pos, description, session_added (0 = initial album)
    sessions: DataFrame   # unique_id, session_number, n_start, n_end, is_last, start_album


def album_state(items: DataFrame, initial: DataFrame) -> AlbumState:
    """``initial``: ``(unique_id, pos, description)`` = first session's mobile device.

    Turns with an ``other`` sharing shape are dropped (the source has no branch
    for them); ``none`` shape items carry no album effect.
    """
    kept = items.filter(F.col("sh_shape") != "other").withColumn("sharing_class", sharing_class())
    first = initial.groupBy("unique_id").agg(nest_sorted(["pos"], F.col("description")).alias("_first"))
    w = Window.partitionBy("unique_id").orderBy(*ITEM_ORDER)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_new = (F.col("sharing_class") == 6).cast("bigint")
    # one exchange by episode: the running count, the whole album (initial entries, then new ones in order) and
    # every lookup in it; an append-only list holds at a smaller position what it held when it was shorter
    x = (kept.join(first, "unique_id", "left")
         .withColumn("_first", F.coalesce("_first", F.array().cast("array<string>")))
         .withColumn("n0", F.size("_first").cast("bigint"))
         .withColumn("_added", F.collect_list(F.when(F.col("sharing_class") == 6, F.struct("sh_description"))).over(whole))
         .withColumn("len_before", F.col("n0") + F.coalesce(
             F.sum(is_new).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("_album", F.concat("_first", F.transform("_added", lambda a: a["sh_description"])))
         .withColumn("album_pos", F.when(F.col("sharing_class") == 6, F.col("len_before"))).drop("_first", "_added"))
    album = initial.select("unique_id", F.col("pos").cast("bigint"), "description",
                           F.lit(0).cast("bigint").alias("session_added")) \
        .unionByName(x.filter(F.col("sharing_class") == 6)
                     .select("unique_id", F.col("album_pos").alias("pos"), F.col("sh_description").alias("description"),
                             F.col("session_number").cast("bigint").alias("session_added")))
    kind, ref = album_reference()
    is3 = F.col("sharing_class") == 3
    x = x.withColumn("_kind", F.when(is3, kind)).withColumn("_ref", F.when(is3, ref))
    idx = F.when(F.col("_ref") < 0, F.col("len_before") + F.col("_ref")).otherwise(F.col("_ref"))
    x = x.withColumn("ref_idx", F.when((idx >= 0) & (idx < F.col("len_before")), idx))
    x = x.withColumn("resolved_description", F.get("_album", F.col("ref_idx").cast("int")))
    status = (F.when(~is3, F.lit(None).cast("string")).when(F.col("_kind") != "ref", F.col("_kind"))
              .when(F.col("ref_idx").isNotNull(), "resolved").otherwise("out_of_range"))
    x = x.withColumn("ref_status", status).drop("_kind", "_ref")

    # per session: album size at start / end, last-session flag, start album text
    per = x.groupBy("unique_id", "session_number").agg(F.sum(is_new).alias("_added"), F.max("n0").alias("n0"), F.first("_album").alias("_album"))
    ws = Window.partitionBy("unique_id").orderBy("session_number")
    per = (per.withColumn("n_start", F.col("n0") + F.coalesce(
        F.sum("_added").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("n_end", F.col("n_start") + F.col("_added"))
        .withColumn("is_last", (F.col("session_number") == F.max("session_number").over(
            Window.partitionBy("unique_id"))).cast("bigint")))
    # start album = the first n_start entries (append-only ⇒ a prefix)
    lines = F.transform("_album", lambda d, i: F.concat(i.cast("string"), F.lit(". "), d))
    sessions = per.select(
        "unique_id", "session_number", F.col("n_start").cast("bigint"), F.col("n_end").cast("bigint"), "is_last",
        F.array_join(F.slice(lines, F.lit(1), F.col("n_start").cast("int")), "\n").alias("start_album"))
    return AlbumState(x.drop("_album"), album, sessions)


# ---- P12 / P10 / A4 --------------------------------------------------------------------

def fill_non_verbal(utterance, has_sharing) -> Column:
    """An empty turn without sharing becomes '<non verbal>'."""
    u = T.col_(utterance)
    return F.when((u == "") & ~T.col_(has_sharing), F.lit("<non verbal>")).otherwise(u)


def flatten_line(speaker, utterance, description, has_sharing, with_description: bool = True) -> Column:
    """P10 line: ``speaker: text`` or an image placeholder."""
    img = (F.concat(F.lit("[Sharing Image of "), T.col_(description), F.lit("]")) if with_description
           else F.lit("[Sharing Image]"))
    return F.concat(T.col_(speaker), F.lit(": "), F.when(T.col_(has_sharing), img).otherwise(T.col_(utterance)))


def nest_sorted(order_cols: list[str], value: Column) -> Column:
    """collect → sort by ``order_cols`` → values (O1 inside a group)."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order_cols], value.alias("_v")))),
                       lambda e: e["_v"])


def assemble_episodes(items: DataFrame, persona_cols: list[str]) -> DataFrame:
    """A4/A5/O1: sharing items → utterances (``sharing``: one struct per item) → sessions
    (dialogue arrays) → one row per episode with sessions sorted by number; persona
    columns taken from the first session (min_by). Three bounded nests (items of one
    turn, turns of one session, ≤ 6 sessions of one episode) over one exchange: rows
    dealt by ``unique_id`` are dealt for the finer keys too."""
    turn = items.repartition("unique_id").groupBy("unique_id", "session_number", "utterance_id").agg(
        *[F.min_by(c, "item_pos").alias(c) for c in ["speaker", "utterance", *persona_cols]],
        nest_sorted(["item_pos"], F.struct("sharing_class", "sh_description")).alias("sharing"))
    sess = turn.groupBy("unique_id", "session_number").agg(
        nest_sorted(["utterance_id"], F.struct("utterance_id", "speaker", "utterance", "sharing")).alias("dialogue"),
        *[F.min_by(c, "utterance_id").alias(c) for c in persona_cols])
    return sess.groupBy("unique_id").agg(
        *[F.min_by(c, "session_number").alias(c) for c in persona_cols],
        nest_sorted(["session_number"], F.struct("session_number", "dialogue")).alias("sessions"))


# ---- C17 / C18 request tables -------------------------------------------------------------

def speaker_fix_requests(utter: DataFrame) -> DataFrame:
    """C17: one name-inference prompt per utterance with an empty speaker: the
    session's earlier turns as ``speaker: text`` (``[Sharing Image]`` when the turn
    carries any sharing value), then ``<SPEAKER>: [Sharing Image]``. A turn with
    several images is one line and one request: only its first item counts. A window
    over one session's earlier turns (a session is one generated dialogue)."""
    from pyspark.sql import Window
    has = F.col("sh_shape") != "none"
    line = F.concat(F.col("speaker_raw"), F.lit(": "),
                    F.when(has, F.lit("[Sharing Image]")).otherwise(F.col("utterance")))
    w = Window.partitionBy("unique_id", "session_number").orderBy(*ITEM_ORDER[1:])
    first = (F.row_number().over(w) == 1) | ~F.lag("utterance_id").over(w).eqNullSafe(F.col("utterance_id"))
    x = utter.withColumn("_first", first)
    x = x.withColumn("_before", F.collect_list(F.when(F.col("_first"), line))
                     .over(w.rowsBetween(Window.unboundedPreceding, -1)))
    dialogue = F.array_join(F.concat(F.col("_before"), F.array(F.lit("<SPEAKER>: [Sharing Image]"))), "\n")
    return x.filter(F.col("_first") & (F.col("speaker_raw") == "")).withColumn(
        "prompt", T.render(K.INFER_SPEAKER_TEMPLATE, dialogue=dialogue)).drop("_before", "_first")


def keyword_description_requests(items: DataFrame) -> DataFrame:
    """Internet images with keywords but no description → description prompt."""
    return items.filter(F.col("sharing_class") == 4) \
        .withColumn("prompt", T.render(K.KEYWORD_DESCRIPTION_TEMPLATE, keywords="sh_keywords"))


# ---- W9 / U3 / J7 / X23 / P6: album ids, uuids and the export form ---------------------

def enumerate_album(album: Column) -> Column:
    """``[{image_id: i, image_description}]`` from a list of descriptions/structs."""
    return F.transform(album, lambda x, i: F.struct(i.alias("image_id"), x.alias("image_description")))


def extend_album(pool: Column, new: Column) -> Column:
    """Album list + newly added images (order kept)."""
    return F.concat(pool, new)


def album_uuids(album: DataFrame) -> DataFrame:
    """X19 for album entries: one uuid per ``(unique_id, pos)``; if the same
    ``(image_id, description)`` key repeats, the later entry's uuid wins (J7)."""
    from curatio.functions.draws import stable_id
    a = album.withColumn("image_uuid", stable_id("unique_id", F.lit("album"), "pos"))
    return a.groupBy("unique_id", "pos", "description").agg(F.max_by("image_uuid", "pos").alias("image_uuid"))


def session_album_uuids(sessions: DataFrame, album: DataFrame) -> DataFrame:
    """Each session's starting album (entries ``pos < n_start``) annotated with the
    album uuid by an equi-join on ``(unique_id, pos)``. The prefix is generated per
    session (``sequence``), the reference's own output size — no session × album pairing."""
    s = sessions.select("unique_id", "session_number",
                        F.explode(F.when(F.col("n_start") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("n_start") - 1))
                                  .otherwise(F.array().cast("array<bigint>"))).alias("pos"))
    return s.join(album_uuids(album), ["unique_id", "pos"])


def annotate_dialogue(items: DataFrame) -> DataFrame:
    """X23 (as rows): each sharing item that becomes an image request gets its own
    ``image_uuid`` — every list item, a dict item only when it has a description
    (rules 1-2 leave no sharing). Album entries are annotated separately (J7)."""
    from curatio.functions.draws import stable_id
    own = stable_id("unique_id", "session_number", "utterance_id", "item_pos")
    is_req = (F.col("sh_shape") == "list") | (~F.col("sharing_class").isin(1, 2) & (F.col("sh_description") != ""))
    return items.withColumn("image_uuid", F.when(is_req, own))


def export_episodes(episodes: DataFrame, cols: list[str]) -> DataFrame:
    """Nested columns as JSON text (typed ``to_json``, not a Python repr)."""
    return episodes.select(*[F.to_json(c).alias(c) if c in cols else F.col(c) for c in episodes.columns])
