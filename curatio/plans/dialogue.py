"""C8 session requests / parse (generation-stage side of the dialogues)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatio import constants as K
from curatio.functions import text as T
from curatio.functions.literal import parse_literal
from curatio.operators.core import report

UTTERANCE_KEYS = ["utterance_id", "speaker", "utterance", "sharing_info"]
SHARING_KEYS = ["rationale", "image_description", "image_source", "keywords"]


def _has_keys(m: Column, keys: list[str]) -> Column:
    return F.forall(F.array(*[F.lit(k) for k in keys]), lambda k: F.map_contains_key(m, k))


def _sharing_items(sh: Column) -> Column:
    """Sharing value (JSON text from the map read) → list of maps: dict → [dict],
    list → items, empty / other text → []."""
    s = F.coalesce(sh, F.lit(""))
    as_list = F.from_json(s, "array<map<string,string>>")
    as_map = F.from_json(s, "map<string,string>")
    return (F.when(s.startswith("["), F.coalesce(as_list, F.array().cast("array<map<string,string>>")))
            .when(s.startswith("{") & (F.size(as_map) > 0), F.array(as_map))
            .otherwise(F.array().cast("array<map<string,string>>")))


def dialogue_keys_ok(utts: Column) -> Column:
    """each utterance has the 4 keys; each non-empty sharing dict, or every
    item of a sharing list, has the 4 sharing keys (``image_id_from_mobile`` optional)."""
    return F.forall(utts, lambda u: _has_keys(u, UTTERANCE_KEYS) & F.forall(
        _sharing_items(u["sharing_info"]), lambda s: _has_keys(s, SHARING_KEYS)))


def all_empty(s: Column) -> Column:
    """every value of a sharing map is '' or []."""
    return F.forall(F.map_values(s), lambda v: (v == "") | (v == "[]"))


def only_rationale(s: Column) -> Column:
    """all values but ``rationale`` empty, rationale non-empty."""
    rest = F.map_filter(s, lambda k, v: k != "rationale")
    return F.forall(F.map_values(rest), lambda v: v == "") & (F.coalesce(s["rationale"], F.lit("")) != "")


def new_album_images(utts: Column) -> Column:
    """U3 (generation side): sharing items with ``new added image`` from the mobile
    source, in turn order — appended to the session's album (even if the description is empty)."""
    items = F.flatten(F.transform(utts, lambda u: _sharing_items(u["sharing_info"])))
    new = F.filter(items, lambda s: (s["image_id_from_mobile"] == K.NEW_ADDED_IMAGE)
                   & (s["image_source"] == "mobile"))
    return F.transform(new, lambda s: s["image_description"])


@dataclass
class DialogueParse:
    annotated: DataFrame   # every generation with ``verdict`` and the parsed utterance maps
    report: DataFrame


def dialogue_parse(gen: DataFrame, generation_col: str = "generation") -> DialogueParse:
    """X5b fence strip → X6 literal parse → F9 syntax reject → F8 low quality
    (dict, or exactly one element) → F7 key check. One parse pass; verdict column."""
    p = gen.withColumn("_lit", parse_literal(T.strip_all_fences(generation_col)))
    utts = F.from_json(F.col("_lit.js"), "array<map<string,string>>")
    p = p.withColumn("utterances", F.when(F.col("_lit.shape") == "list", utts))
    n = F.size("utterances")
    verdict = (F.when(F.col("_lit.err").isNotNull(), F.lit("syntax:fail"))
               .when((F.col("_lit.shape") != "list") | (n == 1), F.lit("parse:fail"))
               .when(~dialogue_keys_ok(F.col("utterances")), F.lit("key:fail"))
               .otherwise(F.lit("ok")))
    p = p.withColumn("verdict", verdict).withColumn("shape", F.col("_lit.shape")) \
        .withColumn("n_items", F.when(F.col("_lit.shape") == "list", n).otherwise(F.lit(-1))).drop("_lit")
    rep = report(p, "dialogue", {
        "dialogue_syntax:fail": F.count_if(F.col("verdict") == "syntax:fail"),
        "dialogue_parse:fail": F.count_if(F.col("verdict") == "parse:fail"),
        "dialogue_key_existence:fail": F.count_if(F.col("verdict") == "key:fail"),
        "dialogue:total": F.count("*"),
    })
    return DialogueParse(p, rep)


def sharing_stats(annotated: DataFrame) -> DataFrame:
    """F13 counts per accepted generation over its non-empty sharing dicts."""
    items = F.flatten(F.transform("utterances", lambda u: _sharing_items(u["sharing_info"])))
    ok = F.col("verdict") == "ok"
    return annotated.withColumn("n_all_empty", F.when(ok, F.size(F.filter(items, all_empty))).otherwise(0)) \
        .withColumn("n_only_rationale", F.when(ok, F.size(F.filter(items, only_rationale))).otherwise(0))
