"""Persona requests and persona-list parsing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.functions import text as T
from curatio.functions.draws import stable_id
from curatio.operators.core import dedupe_first, report, split


@dataclass
class PersonaParse:
    pieces: DataFrame          # every list piece with its regex verdict
    regex_parsed: DataFrame
    regex_discard: DataFrame
    exact: DataFrame
    exact_discard: DataFrame
    unique: DataFrame
    report: DataFrame


def explode_list(gen: DataFrame, generation_col: str, n: int, pos_col: str = "piece_idx") -> DataFrame:
    """X1 + X24: one row per numbered-list piece, parent columns kept; a null completion
    gives one row with a null piece, which no pattern matches (it is rejected, not lost)."""
    return gen.select(*[c for c in gen.columns if c != generation_col],
                      F.posexplode_outer(T.numbered_split(generation_col, n)).alias(pos_col, "piece"))


def parse_pieces(pieces: DataFrame, piece_col: str = "piece") -> DataFrame:
    matched, sent, key, value = T.list_item_fields(piece_col)
    return pieces.withColumn("matched", F.coalesce(matched, F.lit(False))).withColumn("sent", sent) \
        .withColumn("key", key).withColumn("value", value)


def normalise_entity_key(c, strict_keys: bool = False):
    """The reference compares against ``movie_title`` that the model writes as
    ``Movie Title``; we map '_' to ' ' unless ``strict_keys``."""
    c = T.col_(c)
    return c if strict_keys else F.replace(c, F.lit("_"), F.lit(" "))


def persona_parse(gen: DataFrame, generation_col: str = "generation", target_key_col: str = "persona_entity_key",
                  seq_cols: tuple[str, ...] = ("seq",), n: int = 30, strict_keys: bool = False) -> PersonaParse:
    """Split → regex → exact check → first-wins dedupe on ``sent`` → report.

    ``seq_cols`` orders "first" (the reference's arrival order); the piece index
    is appended so first-wins is total.
    """
    pieces = parse_pieces(explode_list(gen, generation_col, n))
    regex = split(pieces, F.col("matched"))
    target = normalise_entity_key(target_key_col, strict_keys)
    parsed = regex.accepted.withColumn("id", stable_id(*seq_cols, "piece_idx"))
    exact_cond = (F.lower("key") == target) & F.lower("sent").contains(F.lower("value"))
    exact = split(parsed, exact_cond)
    unique = dedupe_first(exact.accepted, ["sent"], [*seq_cols, "piece_idx"])
    rep = report(pieces, "persona", {
        "total_num": F.count_distinct(*[F.col(c) for c in seq_cols]) * n,
        "regex:parsed_result": F.count_if(F.col("matched")),
        "regex:discard_result": F.count_if(~F.col("matched")),
        "exact:parsed_result": F.count_if(F.col("matched") & exact_cond),
        "exact:discard_result": F.count_if(F.col("matched") & ~exact_cond),
    }).unionByName(report(unique, "persona", {"duplication:unique_result": F.count("*")}))
    return PersonaParse(pieces, regex.accepted, regex.rejected, exact.accepted, exact.rejected, unique, rep)


# ---- C1 requests ------------------------------------------------------------------------

def _age_columns(seed, keys):
    from curatio import constants as K
    from curatio.functions.draws import draw, draw_range
    lo_arr = F.array(*[F.lit(int(r.split("-")[0])) for r in K.AGE_RANGES])
    hi_arr = F.array(*[F.lit(int(r.split("-")[1])) for r in K.AGE_RANGES])
    ai = (draw(seed, "age_range", len(K.AGE_RANGES), *keys) + 1).cast("int")
    lo, hi = F.element_at(lo_arr, ai), F.element_at(hi_arr, ai)
    return draw_range(seed, "age", lo, hi, *keys).cast("bigint")


def persona_requests(categories: DataFrame, countries: DataFrame, excluded: list[str] | None = None,
                     seed: int = 42, trials: int | None = None, prompts_per_trial: int | None = None) -> DataFrame:
    """(category, entity_key) × demographic trials × few-shot prompts.

    ``countries``: ``(country_idx, country, alpha2)`` with dense ``country_idx``
    0..n-1 (J3 lookup by equi-join). One demographic draw per (category, trial),
    shared by its prompts; trials past 70% draw a residence different from the
    birthplace (O5). Fan-out uses generator columns, not cross joins.
    """
    from curatio import constants as K
    from curatio.functions.draws import draw
    excluded = K.EXCLUDED_CATEGORIES if excluded is None else excluded
    trials = trials or K.DEMOGRAPHIC_TRIAL
    prompts_per_trial = prompts_per_trial or K.PERSONA_RELATIONS_TRIALS
    n = countries.select(F.count("*")).scalar()
    keys = ["category", "trial"]
    x = categories.filter(~F.col("category").isin(*excluded)) \
        .withColumn("trial", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(trials - 1).cast("bigint"))))
    a = draw(seed, "birthplace", n, *keys)
    b = F.when(F.col("trial") > 0.7 * trials, (a + 1 + draw(seed, "residence", n - 1, *keys)) % n).otherwise(a)
    x = x.withColumn("age", _age_columns(seed, keys)) \
        .withColumn("gender", F.element_at(F.array(*[F.lit(g) for g in K.GENDERS]),
                                           (draw(seed, "gender", len(K.GENDERS), *keys) + 1).cast("int"))) \
        .withColumn("_b", a).withColumn("_r", b)
    cb = countries.select(F.col("country_idx").alias("_b"), F.col("country").alias("birthplace"),
                          F.col("alpha2").alias("birthplace_alpha2"))
    cr = countries.select(F.col("country_idx").alias("_r"), F.col("country").alias("residence"),
                          F.col("alpha2").alias("residence_alpha2"))
    x = x.join(cb, "_b").join(cr, "_r").drop("_b", "_r")
    x = x.withColumn("prompt", T.render(K.PERSONA_TEMPLATE, age="age", gender="gender", birthplace="birthplace",
                                        residence="residence", target_persona_category="category",
                                        target_persona_entity="entity_key"))
    return x.withColumn("prompt_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(prompts_per_trial - 1).cast("bigint"))))


TASK_ROWS = 250_000          # rows, one per prompt, that a task sorts


def few_shot_blocks(pool: DataFrame, seed: int = 42, n_prompts: int | None = None, k: int = 30,
                    row_id: str = "row_id") -> DataFrame:
    """F2 + A8 + W6 + O7: per (category, key) and prompt index, a seeded shuffle of
    the key's pool rows cut to ``k`` lines ``i. sentence (Key: Value)``.

    ``row_number() <= k`` compiles to a partial WindowGroupLimit before the
    shuffle, so each map task ships at most ``k`` rows per group. That limit sorts the
    task's rows: they are dealt out first, ``TASK_ROWS`` a task however large the table (several
    tasks at every size, or one partition would leave out the partial limit)."""
    import math

    from pyspark.sql import Window
    from curatio import constants as K
    from curatio.functions.draws import order_key
    n_prompts = n_prompts or K.PERSONA_RELATIONS_TRIALS
    key_norm = normalise_entity_key("key")
    p = pool.filter(F.lower("attr") == F.lower(key_norm))
    p = p.repartition(max(4, math.ceil(p.count() * n_prompts / TASK_ROWS)), *p.columns) \
        .withColumn("prompt_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_prompts - 1).cast("bigint"))))
    p = p.withColumn("_o", order_key(seed, "fewshot", "category", "key", "prompt_idx", row_id))
    w = Window.partitionBy("category", "key", "prompt_idx").orderBy("_o")
    p = p.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= k)
    line = F.concat(F.col("_i").cast("string"), F.lit(". "), F.col("sentence"), F.lit(" ("),
                    T.title_case(key_norm), F.lit(": "), T.title_case("value"), F.lit(")"))
    g = p.groupBy("category", "key", "prompt_idx").agg(
        F.count("*").alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", line.alias("l")))), lambda e: e["l"]),
                     "\n").alias("_lines"))
    return g.withColumn("block", T.render(K.FEW_SHOT_TEMPLATE, persona_category="category",
                                          persona_entity_key=T.title_case(normalise_entity_key("key")),
                                          persona_sentences="_lines")).drop("_lines")


# ---- C6 album list ------------------------------------------------------------------------

ALBUM_ITEM_RE = r"(?d)^(.*) [\(|\[]Category: (.*)[\)|\]]"


@dataclass
class AlbumParse:
    items: DataFrame      # every piece: matched, image_description, image_category, kept (instance has ≥ 1 match)
    albums: DataFrame     # kept instances with ``album ARRAY<STRUCT<image_description, image_category>>``
    report: DataFrame


def album_requests(people: DataFrame, sentence_col: str = "narrative", name_col: str = "name") -> DataFrame:
    """C6 requests (P3): the images a person with this narrative may have on the device."""
    from curatio import constants as K
    return people.withColumn("album_prompt", T.render(K.ALBUM_TEMPLATE, sentence=sentence_col, name=name_col))


def album_parse(gen: DataFrame, key: list[str], generation_col: str = "generation", n: int = 5) -> AlbumParse:
    """C6 parse: split on ``\\n1.``…``\\n5.`` (X1), match ``desc (Category: cat)`` (X3),
    keep an instance iff at least one piece matched; rejects are still reported."""
    from pyspark.sql import Window
    p = explode_list(gen, generation_col, n)
    c = F.col("piece")
    p = p.withColumn("matched", F.coalesce(c.rlike(ALBUM_ITEM_RE), F.lit(False))) \
        .withColumn("image_description", F.regexp_extract(c, ALBUM_ITEM_RE, 1)) \
        .withColumn("image_category", F.regexp_extract(c, ALBUM_ITEM_RE, 2))
    p = p.withColumn("kept", F.max(F.col("matched").cast("int")).over(Window.partitionBy(*key)) == 1)
    albums = p.filter("matched").groupBy(*key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("piece_idx", "image_description", "image_category"))),
        lambda e: F.struct(e["image_description"].alias("image_description"),
                           e["image_category"].alias("image_category"))).alias("album"))
    rep = report(p, "album", {
        "total_num": F.count_distinct(*[F.col(k) for k in key]) * n,
        "regex:parsed_result": F.count_if(F.col("matched") & F.col("kept")),
        "regex:discard_result": F.count_if(~F.col("matched")),
        "instances_kept": F.count_distinct(F.when(F.col("kept"), F.struct(*[F.col(k) for k in key]))),
    })
    return AlbumParse(p, albums, rep)


def attach_system_messages(requests: DataFrame, blocks: DataFrame, seed: int = 42,
                           n_blocks: int | None = None) -> DataFrame:
    """C1 system messages: each request (category, trial, prompt_idx) draws one pool
    key and one of that key's ``n_blocks`` pre-shuffled few-shot blocks, rendered into
    the fixed system-message format. Keys are numbered by a seeded order (skew-safe
    positions); both picks are equi-joins on drawn indexes."""
    from curatio import constants as K
    from curatio.functions.draws import draw, order_key
    from curatio.operators.position import hex_bucket, hex_digits, positions
    n_blocks = n_blocks or K.PERSONA_RELATIONS_TRIALS
    keys = blocks.select(F.col("category").alias("fewshot_category"), F.col("key").alias("fewshot_key")).distinct() \
        .withColumn("_o", order_key(seed, "fewshot_keys", "fewshot_category", "fewshot_key"))
    n_keys = keys.count()
    keys = positions(keys, ["_o"], hex_bucket("_o", hex_digits(n_keys)), pos_col="_kidx").drop("_o")
    r = requests.withColumn("_kidx", draw(seed, "fewshot_key", n_keys, "category", "trial", "prompt_idx")) \
        .withColumn("fewshot_block", draw(seed, "fewshot_block", n_blocks, "category", "trial", "prompt_idx"))
    b = blocks.select(F.col("category").alias("fewshot_category"), F.col("key").alias("fewshot_key"),
                      F.col("prompt_idx").alias("fewshot_block"), "block")
    out = r.join(keys, "_kidx").join(b, ["fewshot_category", "fewshot_key", "fewshot_block"])
    return out.withColumn("system_message", T.render(K.PERSONA_SYSTEM_MESSAGE, example="block")) \
        .drop("_kidx", "block")
