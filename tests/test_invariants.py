"""SURVEY §5.4 invariants on the stand-in stages (sf0.001 and sf0.01 tables)."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from curatio.plans.persona import persona_parse
from curatio.sources.testdata import Tables
from curatio.standins.persona import persona_generations

SF = "/root/testdata/sf0.01"


def test_persona_accept_reject_partition_input(spark):
    gen = persona_generations(Tables(spark, SF).part)
    r = persona_parse(gen)
    n = r.pieces.count()
    assert r.regex_parsed.count() + r.regex_discard.count() == n
    assert r.exact.count() + r.exact_discard.count() == r.regex_parsed.count()
    rep = {row["metric"]: row["value"] for row in r.report.collect()}
    assert rep["regex:parsed_result"] + rep["regex:discard_result"] == n
    assert rep["duplication:unique_result"] == r.unique.count() == r.exact.select("sent").distinct().count()


def test_persona_same_under_repartition(spark):
    gen = persona_generations(Tables(spark, SF).part)
    base = sorted(persona_parse(gen).unique.select("sent", "id").collect())
    for n in (1, 7, 50):
        assert sorted(persona_parse(gen.repartition(n)).unique.select("sent", "id").collect()) == base


def test_request_uuids_unique_and_dialogue_subset(spark):
    q = E.queries()
    req = q["image_requests"](spark, SF)
    assert req.count() == req.select("image_uuid").distinct().count()
    exp = q["episodes_export"](spark, SF)
    uuids = exp.select(F.explode(F.from_json(
        "episode", "array<struct<dialogue:array<struct<image_uuid:string>>>>")).alias("s")) \
        .select(F.explode("s.dialogue").alias("u")).select("u.image_uuid").filter("image_uuid <> ''")
    assert uuids.join(req, "image_uuid", "left_anti").count() == 0


def test_each_request_in_exactly_one_backend(spark):
    w = E.queries()["backend_worklist"](spark, SF)
    n = Tables(spark, SF).orders.count()
    assert w.count() == n == w.select("image_uuid").distinct().count()
    assert w.filter(F.col("backend").isNull() | F.col("status").isNull()).count() == 0


def test_album_positions_dense(spark):
    a = E.queries()["session_album_uuids"](spark, SF)
    bad = a.groupBy("unique_id", "session_number").agg(F.count("*").alias("n"), F.max("pos").alias("m")) \
        .filter(F.col("m") != F.col("n") - 1)
    assert bad.count() == 0
