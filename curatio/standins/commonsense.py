"""Commonsense / narrative queries over ``customer`` (+ ``nation``, ``supplier``).

Stand-in mapping: a customer is a persona row; age, gender by keyed draws on
``c_custkey``; birthplace = residence = the customer's nation name; persona
sentence ``'I work in the <segment> sector.'``. For parsing, the relation is
``RELATIONS[c_custkey % 5]`` and the completion form is planted by
``(c_custkey div 5) % 6``. Name pool = suppliers by (nation, gender by
``s_suppkey % 2``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio import constants as K
from curatio.functions.draws import draw, sql_draw
from curatio.operators.position import default_buckets, quantile_bucket
from curatio.plans import commonsense as C
from curatio.sources.testdata import Tables
from curatio.standins import sqlutil as S
from curatio.standins.registry import query

AGE_LO = [int(r.split("-")[0]) for r in K.AGE_RANGES]
AGE_HI = [int(r.split("-")[1]) for r in K.AGE_RANGES]


def people(t) -> DataFrame:
    c = t.customer.join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    ai = draw(42, "age_range", len(K.AGE_RANGES), "c_custkey")
    lo = F.element_at(F.array(*[F.lit(x) for x in AGE_LO]), (ai + 1).cast("int"))
    hi = F.element_at(F.array(*[F.lit(x) for x in AGE_HI]), (ai + 1).cast("int"))
    return c.select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment",
        (lo + draw(42, "age", hi - lo + 1, "c_custkey")).cast("bigint").alias("age"),
        F.element_at(F.array(*[F.lit(g) for g in K.GENDERS]),
                     (draw(42, "gender", 2, "c_custkey") + 1).cast("int")).alias("gender"),
        F.col("n_name").alias("birthplace"), F.col("n_name").alias("residence"),
        F.concat(F.lit("I work in the "), F.lower("c_mktsegment"), F.lit(" sector.")).alias("sent"))


_AI = sql_draw(42, "age_range", len(K.AGE_RANGES), "c_custkey")
PEOPLE_SQL = f"""people AS (
  SELECT c_custkey, c_name, c_nationkey, c_mktsegment,
    CAST({S.arr(AGE_LO)}[{_AI} + 1] + {sql_draw(42, 'age', f'{S.arr(AGE_HI)}[{_AI} + 1] - {S.arr(AGE_LO)}[{_AI} + 1] + 1', 'c_custkey')} AS BIGINT) AS age,
    {S.arr(K.GENDERS)}[{sql_draw(42, 'gender', 2, 'c_custkey')} + 1] AS gender,
    n_name AS birthplace, n_name AS residence,
    'I work in the ' || lower(c_mktsegment) || ' sector.' AS sent
  FROM customer JOIN nation ON n_nationkey = c_nationkey
)"""
DEMO_SQL = S.render(K.DEMO_SENTENCE, age="age", gender="lower(gender)", birthplace="birthplace", residence="residence")


@query("commonsense_cross", f"""WITH {PEOPLE_SQL}
SELECT c_custkey, relation,
  {S.case('relation', {r: S.render(t, demo_sent=DEMO_SQL, persona_attr='sent') for r, t in K.COMMONSENSE_TEMPLATES.items()})} AS prompt,
  {S.case('relation', {r: S.lit(m) for r, m in K.COMMONSENSE_SYSTEM.items()})} AS system_message
FROM people, (SELECT unnest({S.arr(K.RELATIONS)}) AS relation)""")
def commonsense_cross(spark, sf_dir):
    r = C.commonsense_requests(people(Tables(spark, sf_dir)))
    return r.select("c_custkey", "relation", F.col("commonsense_prompt").alias("prompt"),
                    F.col("commonsense_system_message").alias("system_message"))


def _generations(p: DataFrame) -> DataFrame:
    rel = F.element_at(F.array(*[F.lit(r) for r in K.RELATIONS]), (F.col("c_custkey") % 5 + 1).cast("int"))
    p = p.withColumn("relation", rel) \
        .withColumn("_demo", C.demo_sentence()) \
        .withColumn("_lead", C.lead_text(F.col("relation"), F.col("_demo"), F.col("sent")))
    lead = F.col("_lead")
    mark = C.by_relation(F.col("relation"), {r: F.lit(m) for r, m in K.COMMONSENSE_MARK.items()})
    v = (F.col("c_custkey") / 5).cast("bigint") % 6
    gen = (F.when(v == 0, F.concat(lead, F.lit("enjoy hiking.")))
           .when(v == 1, F.lit("I use AI tools at work."))
           .when(v == 2, F.concat(F.lit("Sure! "), F.coalesce(mark, F.lit("I ")), F.lit("visit my family often."))))
    gen = (gen.when(v == 3, F.lit("I moved abroad. Now, I am settled.")).when(v == 4, F.lit(""))
           .otherwise(F.concat(F.lit("Being "), F.col("c_name"), F.lit("."))))
    return p.withColumn("generation", gen).withColumn("seq", F.col("c_custkey")).drop("_lead", "_demo")


_LEAD_SQL = S.case("relation", {r: S.render(t, demo=DEMO_SQL, attr="sent") for r, t in K.COMMONSENSE_LEAD.items()})
_MARK_SQL = S.case("relation", {r: S.lit(m) for r, m in K.COMMONSENSE_MARK.items()})
GEN_SQL = f"""g0 AS (
  SELECT *, {S.arr(K.RELATIONS)}[c_custkey % 5 + 1] AS relation, (c_custkey // 5) % 6 AS v FROM people
), g1 AS (SELECT *, {_LEAD_SQL} AS lead, {_MARK_SQL} AS mark FROM g0),
gens AS (
  SELECT *, CASE v WHEN 0 THEN lead || 'enjoy hiking.' WHEN 1 THEN 'I use AI tools at work.'
                   WHEN 2 THEN 'Sure! ' || coalesce(mark, 'I ') || 'visit my family often.'
                   WHEN 3 THEN 'I moved abroad. Now, I am settled.' WHEN 4 THEN ''
                   ELSE 'Being ' || c_name || '.' END AS generation
  FROM g1
), ext AS (
  SELECT *,
    CASE WHEN contains(generation, lead) THEN
           CASE WHEN replace(generation, lead, '') = '' THEN NULL
                WHEN relation = 'experience' THEN {S.last_after(S.nodot("replace(generation, lead, '')"), "'I '")}
                ELSE {S.nodot("replace(generation, lead, '')")} END
         WHEN generation = '' THEN NULL
         ELSE {S.nodot(f'''coalesce(nullif(CASE
             WHEN relation = 'experience' AND contains(generation, ' Now, ') THEN
               CASE WHEN starts_with(generation, 'I ') THEN {S.last_after(S.first_before('generation', "' Now, '"), "'I '")}
                    ELSE {S.first_before('generation', "' Now, '")} END
             WHEN mark IS NOT NULL AND contains(generation, mark) THEN {S.last_after('generation', 'mark')}
             WHEN starts_with(generation, 'I ') THEN {S.last_after('generation', "'I '")} END, ''), generation)''')}
    END AS parsed
  FROM gens
)"""


@query("commonsense_parse", f"""WITH {PEOPLE_SQL}, {GEN_SQL}
SELECT sent, relation, parsed, min(c_custkey) AS c_custkey FROM ext WHERE parsed IS NOT NULL GROUP BY 1, 2, 3""")
def commonsense_parse(spark, sf_dir):
    g = _generations(people(Tables(spark, sf_dir)))
    res = C.commonsense_parse(g)
    return res.unique.select("sent", "relation", "parsed", "c_custkey")


@query("commonsense_report", f"""WITH {PEOPLE_SQL}, {GEN_SQL}
SELECT 'commonsense' AS stage, metric, CAST(value AS BIGINT) AS value FROM (
  SELECT 'total' AS metric, count(*) AS value FROM ext
  UNION ALL SELECT 'parsed', count(parsed) FROM ext
  UNION ALL SELECT 'empty', count(*) - count(parsed) FROM ext
  UNION ALL SELECT 'unique', count(*) FROM (SELECT DISTINCT sent, relation, parsed FROM ext WHERE parsed IS NOT NULL))""")
def commonsense_report(spark, sf_dir):
    return C.commonsense_parse(_generations(people(Tables(spark, sf_dir)))).report


@query("narrative_names", f"""WITH {PEOPLE_SQL},
pool AS (
  SELECT s_nationkey, {S.arr(K.GENDERS)}[s_suppkey % 2 + 1] AS gender, s_name,
         row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 2 ORDER BY s_suppkey) - 1 AS idx,
         count(*) OVER (PARTITION BY s_nationkey, s_suppkey % 2) AS size
  FROM supplier
), sizes AS (SELECT DISTINCT s_nationkey, gender, size FROM pool),
ck AS (
  SELECT p.*, {S.arr(K.RELATIONS)}[c_custkey % 5 + 1] AS relation, 'enjoy ' || lower(c_mktsegment) AS parsed,
         {sql_draw(42, 'name', 's.size', 'c_custkey')} AS idx
  FROM people p LEFT JOIN sizes s ON s.s_nationkey = p.c_nationkey AND s.gender = p.gender
), named AS (
  SELECT ck.*, pool.s_name AS name FROM ck
  LEFT JOIN pool ON pool.s_nationkey = ck.c_nationkey AND pool.gender = ck.gender AND pool.idx = ck.idx
)
SELECT c_custkey, name, CASE WHEN idx IS NULL THEN 'empty_pool' END AS reject_reason, CASE WHEN name IS NOT NULL THEN {S.render(K.NARRATIVE_TEMPLATE, sentence=S.case('relation', {r: S.render(t, name='name', demo_sent=DEMO_SQL, persona_attr='sent', commonsense='parsed') for r, t in K.SENTENCE_FORMS.items()}))} END AS prompt
FROM named""")
def narrative_names(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = people(t).withColumn("relation", F.element_at(F.array(*[F.lit(r) for r in K.RELATIONS]),
                                                      (F.col("c_custkey") % 5 + 1).cast("int"))) \
        .withColumn("parsed", F.concat(F.lit("enjoy "), F.lower("c_mktsegment")))
    s = t.supplier
    pool = s.select(F.col("s_nationkey").alias("c_nationkey"),
                    F.element_at(F.array(*[F.lit(g) for g in K.GENDERS]), (F.col("s_suppkey") % 2 + 1).cast("int"))
                    .alias("gender"), "s_suppkey", F.col("s_name").alias("name"))
    bucket = quantile_bucket(pool, "s_suppkey", default_buckets(s.count(), 50_000))
    named = C.pick_names(p, pool, 42, ["c_custkey"], ["c_nationkey", "gender"], "s_suppkey", bucket)
    return C.narrative_requests(named).select(
        "c_custkey", "name", "reject_reason", F.col("narrative_prompt").alias("prompt"))


@query("narrative_names_combined", f"""WITH {PEOPLE_SQL},
pool AS (
  SELECT s_nationkey, s_suppkey % 2 AS g, s_name, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 2 ORDER BY s_suppkey) - 1 AS idx FROM supplier
), sizes AS (SELECT s_nationkey, count(*) FILTER (WHERE g = 0) AS m, count(*) FILTER (WHERE g = 1) AS f FROM pool GROUP BY 1
), who AS (
  SELECT people.*, CASE WHEN c_custkey % 3 = 0 THEN 'Non-binary' ELSE gender END AS label FROM people
), drawn AS (
  SELECT who.*, m, {sql_draw(42, 'name', "nullif(CASE label WHEN 'Non-binary' THEN m + f WHEN 'Male' THEN m ELSE f END, 0)", 'c_custkey')} AS i
  FROM who LEFT JOIN sizes ON s_nationkey = c_nationkey
)
SELECT c_custkey, label AS gender, s_name AS name, CASE WHEN i IS NULL THEN 'empty_pool' END AS reject_reason
FROM drawn LEFT JOIN pool ON pool.s_nationkey = c_nationkey
  AND g = CASE WHEN label = 'Female' OR (label = 'Non-binary' AND i >= m) THEN 1 ELSE 0 END
  AND idx = CASE WHEN label = 'Non-binary' AND i >= m THEN i - m ELSE i END""")
def narrative_names_combined(spark, sf_dir):
    """J4 with every third person drawing from male ++ female names."""
    t = Tables(spark, sf_dir)
    p = people(t).withColumn("gender", F.when(F.col("c_custkey") % 3 == 0, "Non-binary").otherwise(F.col("gender")))
    s = t.supplier
    pool = s.select(F.col("s_nationkey").alias("c_nationkey"),
                    F.element_at(F.array(*[F.lit(g) for g in K.GENDERS]), (F.col("s_suppkey") % 2 + 1).cast("int")).alias("gender"),
                    "s_suppkey", F.col("s_name").alias("name"))
    bucket = quantile_bucket(pool, "s_suppkey", default_buckets(s.count(), 50_000))
    named = C.pick_names(p, pool, 42, ["c_custkey"], ["c_nationkey", "gender"], "s_suppkey", bucket, {"Non-binary": ["Male", "Female"]})
    return named.select("c_custkey", "gender", "name", "reject_reason")
