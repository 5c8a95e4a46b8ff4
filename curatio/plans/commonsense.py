"""C3 commonsense requests/parse, C4 narrative requests (name draw J4)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatio import constants as K
from curatio.functions import text as T
from curatio.functions.draws import draw
from curatio.operators.core import dedupe_first, keep_where, report
from curatio.operators.position import positions


def demo_sentence(age="age", gender="gender", birthplace="birthplace", residence="residence") -> Column:
    return T.render(K.DEMO_SENTENCE, age=age, gender=F.lower(T.col_(gender)), birthplace=birthplace,
                    residence=residence)


def by_relation(relation: Column, values: dict[str, Column]) -> Column:
    """Relation-dependent choice as one CASE (no join against a 5-row table)."""
    out = F.lit(None).cast("string")
    for rel, v in values.items():
        out = F.when(relation == rel, v).otherwise(out)
    return out


def commonsense_requests(persona: DataFrame, attr_col: str = "sent") -> DataFrame:
    """C3 requests, J1: every persona row × the 5 relations.

    The relation list is a generator column (``explode`` of a literal array) —
    the fan-out stays inside the scan's stage, no cross join or shuffle."""
    # the demo sentence is its own column: five template branches reference it
    x = persona.withColumn("relation", F.explode(F.array(*[F.lit(r) for r in K.RELATIONS]))) \
        .withColumn("_demo", demo_sentence())
    demo = F.col("_demo")
    rel = F.col("relation")
    prompt = by_relation(rel, {r: T.render(t, demo_sent=demo, persona_attr=attr_col)
                               for r, t in K.COMMONSENSE_TEMPLATES.items()})
    system = by_relation(rel, {r: F.lit(m) for r, m in K.COMMONSENSE_SYSTEM.items()})
    return x.withColumn("commonsense_prompt", prompt).withColumn("commonsense_system_message", system).drop("_demo")


def with_commonsense(df: DataFrame, gen_col: str, rel_col: str, lead_col: str, out_col: str = "parsed") -> DataFrame:
    """Add the parsed fact; NULL where the source would fail (empty text).

    Shared pieces (marker cut, lead removal) are separate columns so each is
    computed once and the generated code stays small enough to compile."""
    gen, relation, lead = F.col(gen_col), F.col(rel_col), F.col(lead_col)
    mark = by_relation(relation, {r: F.lit(m) for r, m in K.COMMONSENSE_MARK.items()})
    after_mark = by_relation(relation, {r: F.substring_index(gen, m, -1) for r, m in K.COMMONSENSE_MARK.items()})
    starts_i = gen.startswith("I ")
    before_now = F.substring_index(gen, " Now, ", 1)
    p = (F.when((relation == "experience") & gen.contains(" Now, "),
                F.when(starts_i, F.substring_index(before_now, "I ", -1)).otherwise(before_now))
         .when(mark.isNotNull() & gen.contains(mark), after_mark)
         .when(starts_i, F.substring_index(gen, "I ", -1)))
    x = df.withColumn("_p", p).withColumn("_r0", F.replace(gen, lead, F.lit("")))
    r0 = F.col("_r0")
    lead_case = (F.when(r0 == "", F.lit(None).cast("string"))
                 .when(relation == "experience", F.substring_index(T.drop_final_dot(r0), "I ", -1))
                 .otherwise(T.drop_final_dot(r0)))
    parsed = (F.when(gen.contains(lead), lead_case).when(gen == "", F.lit(None).cast("string"))
              .otherwise(T.drop_final_dot(F.coalesce(F.nullif(F.col("_p"), F.lit("")), gen))))
    return x.withColumn(out_col, parsed).drop("_p", "_r0")


def lead_text(relation: Column, demo: Column, attr: Column) -> Column:
    return by_relation(relation, {r: T.render(t, demo=demo, attr=attr) for r, t in K.COMMONSENSE_LEAD.items()})


@dataclass
class CommonsenseParse:
    parsed: DataFrame
    rejected: DataFrame
    unique: DataFrame
    report: DataFrame


def commonsense_parse(gen: DataFrame, generation_col: str = "generation", attr_col: str = "sent",
                      order: list[str] | None = None) -> CommonsenseParse:
    """C3 parse: extraction rules per relation, then first-wins dedupe on
    ``(sent, relation, parsed)`` (A3)."""
    x = gen.withColumn("_demo", demo_sentence()) \
        .withColumn("_lead", lead_text(F.col("relation"), F.col("_demo"), F.col(attr_col)))
    x = with_commonsense(x, generation_col, "relation", "_lead").drop("_lead", "_demo")
    ok = keep_where(x, F.col("parsed").isNotNull())
    uniq = dedupe_first(ok, [attr_col, "relation", "parsed"], order or ["seq"])
    rep = report(x, "commonsense", {"total": F.count("*"), "parsed": F.count_if(F.col("parsed").isNotNull()),
                                    "empty": F.count_if(F.col("parsed").isNull())}) \
        .unionByName(report(uniq, "commonsense", {"unique": F.count("*")}))
    return CommonsenseParse(ok, keep_where(x, F.col("parsed").isNull()), uniq, rep)


def pick_names(people: DataFrame, pool: DataFrame, seed: int, key_cols: list[str],
               pool_key: list[str], pool_order: str, pool_bucket, combined: dict[str, list[str]] | None = None) -> DataFrame:
    """A uniform draw from the name pool of the person's (country, gender). ``combined`` names values of the
    last key column whose pool is other pools one behind the other (``Non-binary``: male, then female names).

    Pool members are numbered within their pool by a skew-safe position (a huge
    pool is spread over order-preserving buckets, not ranked in one task); the
    person's draw ``h % pool_size`` is then an equi-join on ``(pool…, idx)``. A combined pool is not copied: the
    draw falls into one of its parts, and the place in that part is looked up.
    People whose pool is empty are returned too, with ``reject_reason`` 'empty_pool' and
    null pool columns (the source raises); everyone else's ``reject_reason`` is null."""
    numbered = positions(pool, [pool_order], pool_bucket, group=pool_key, pos_col="_idx", size_col="_size")
    sizes = numbered.groupBy(*pool_key).agg(F.first("_size").alias("_size"))
    label = pool_key[-1]
    uses = F.array(F.struct(F.col(label).alias("label"), F.lit(0).alias("at")), *[
        F.when(F.col(label) == part, F.struct(F.lit(name).alias("label"), F.lit(i).alias("at")))
        for name, parts in (combined or {}).items() for i, part in enumerate(parts)])
    used = sizes.select(*pool_key[:-1], F.col(label).alias("_part"), "_size", F.explode(F.filter(uses, lambda u: u.isNotNull())).alias("u"))
    pools = used.groupBy(*pool_key[:-1], F.col("u.label").alias(label)).agg(
        F.sum("_size").alias("_total"), F.array_sort(F.collect_list(F.struct("u.at", "_part", "_size"))).alias("_parts"))
    p = people.join(pools, pool_key, "left")
    p = p.withColumn("_idx", draw(seed, "name", F.col("_total"), *key_cols))
    p = p.withColumn("reject_reason", F.when(F.col("_total").isNull(), F.lit("empty_pool")))
    # the part the draw falls into, and the place in it
    start = F.struct(F.lit(None).cast("string").alias("part"), F.lit(None).cast("bigint").alias("idx"), F.col("_idx").alias("left"))
    found = F.aggregate("_parts", start, lambda a, s: F.when(a["part"].isNotNull(), a).when(
        a["left"] < s["_size"], F.struct(s["_part"].cast("string").alias("part"), a["left"].alias("idx"), a["left"].alias("left")))
        .otherwise(F.struct(a["part"].alias("part"), a["idx"].alias("idx"), (a["left"] - s["_size"]).alias("left"))))
    p = p.withColumn("_found", found).withColumn("_part", F.col("_found.part")).withColumn("_idx", F.col("_found.idx"))
    names = numbered.withColumn("_part", F.col(label).cast("string")).drop("_size", label)
    return p.join(names, [*pool_key[:-1], "_part", "_idx"], "left").drop("_idx", "_total", "_parts", "_found", "_part")


def narrative_requests(ck: DataFrame, attr_col: str = "sent") -> DataFrame:
    """C4: relation-dependent sentence form with the drawn name → narrative prompt."""
    ck = ck.withColumn("_demo", demo_sentence())
    form = by_relation(F.col("relation"), {
        r: T.render(t, name="name", demo_sent=F.col("_demo"), persona_attr=attr_col, commonsense="parsed")
        for r, t in K.SENTENCE_FORMS.items()})
    return ck.withColumn("sentence_form", form) \
        .withColumn("narrative_prompt", F.when(F.col("name").isNotNull(), T.render(
            K.NARRATIVE_TEMPLATE, sentence=F.col("sentence_form")))).drop("_demo")
