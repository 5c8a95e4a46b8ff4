"""Stage values: order, one-pass outcome writes, restart, session rounds."""

import os

import pytest
from pyspark.sql import functions as F

from curatio.plans import stage as ST


def _stage(name, needs, log=None):
    def requests(*inputs):
        if log is not None:
            log.append(name)
        return inputs[0].select("request_id", "prompt")
    return ST.Stage(name, needs, requests, lambda rows: rows.withColumn(
        "reject_reason", F.when(F.length("generation") > 3, "too_long")), {"long": "reject_reason = 'too_long'"})


def test_stages_are_ordered_behind_their_inputs():
    registry = {}
    for name, needs in (("c", ("b", "a")), ("b", ("a", "table")), ("a", ("table",)), ("d", ("c",))):
        ST.register(_stage(name, needs), registry)
    assert [s.name for s in ST.resolve("d", {"table"}, registry)] == ["a", "b", "c", "d"]
    assert [s.name for s in ST.resolve("b", {"table", "a"}, registry)] == ["b"]
    with pytest.raises(KeyError, match="'table' is neither"):
        ST.resolve("a", set(), registry)
    with pytest.raises(KeyError, match="registered already"):
        ST.register(_stage("a", ()), registry)
    ST.register(_stage("x", ("y",)), registry)
    ST.register(_stage("y", ("x",)), registry)
    with pytest.raises(ValueError, match="x -> y"):
        ST.resolve("x", set(), registry)
    assert [s.name for s in ST.resolve("session_1", {"persona_requests", "people"})] == ["persona", "event", "session_1"]


def _completions(name, requests):
    return requests.filter("request_id <> 'r3'").select(
        "request_id", F.lit(1).alias("seq"), F.when(F.col("request_id") == "r2", "long text").otherwise("ok").alias("generation"),
        F.lit(1).cast("bigint").alias("prompt_tokens"), F.lit(2).cast("bigint").alias("completion_tokens"))


def test_outcomes_and_report_come_from_one_write_and_a_run_goes_on(spark, tmp_dir):
    log = []
    registry = {}
    ST.register(_stage("first", ("table",), log), registry)
    ST.register(_stage("second", ("first",), log), registry)
    table = spark.createDataFrame([(f"r{i}", "p", 1) for i in range(5)], "request_id string, prompt string, extra int")
    done = ST.run("second", {"table": table}, _completions, tmp_dir, registry)
    first = done["first"]
    assert sorted(r.request_id for r in first.accepted.collect()) == ["r0", "r1", "r4"]
    assert [(r.request_id, r.reject_reason) for r in first.rejected.collect()] == [("r2", "too_long")]
    assert [(r.request_id, r.reject_reason, r.generation) for r in first.pending.collect()] == [("r3", None, None)]
    assert {r.metric: r.value for r in first.report.collect()} == {"total": 5, "accepted": 3, "rejected": 1, "pending": 1, "long": 1}
    assert {r.metric: r.value for r in done["second"].report.collect()} == {"total": 3, "accepted": 3, "rejected": 0, "pending": 0, "long": 0}
    # complete stages are read, not made again: their files stay
    files = {f for _, _, names in os.walk(tmp_dir) for f in names}
    again = ST.run("second", {"table": table.filter("request_id = 'r0'")}, _completions, tmp_dir, registry)
    assert {f for _, _, names in os.walk(tmp_dir) for f in names} == files
    assert again["second"].accepted.count() == 3
    # a folder without its report (broken off before the end) is written anew
    folder = os.path.join(tmp_dir, "other")
    rows = ST.outcomes(table.select("request_id", "prompt"), _completions("", table), registry["first"].parse)
    rows.limit(1).write.partitionBy("outcome").parquet(f"{folder}/rows")
    assert not ST.is_complete(spark, folder)
    assert ST.run_stage(registry["first"], [table], _completions, folder).accepted.count() == 3


def test_no_rows_and_one_parse(spark, tmp_dir):
    state = spark.createDataFrame([], "unique_id string, name string, age long, gender string, birthplace string, residence string, "
                                  "events array<struct<event:string,date:string,time_interval:string,experience:string>>, album array<string>")
    def none(_name, requests):
        return requests.select("request_id", F.lit(1).alias("seq"), F.lit("[]").alias("generation"))
    done = ST.run_rounds(ST.session_round, state, none, tmp_dir, 6)
    assert len(done) == 1 and done[0].accepted.count() == 0
    requests = ST.session_round_requests(state, 2)
    rows = ST.outcomes(requests, none("", requests), ST.session_round_parse)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_album_grows_and_a_broken_off_run_starts_at_its_round(spark, tmp_dir):
    events = [("e1", "2024.01.01", None, None), ("e2", "2024.01.02", "1 day", "x"), ("e3", "2024.01.03", "1 day", "y")]
    state = spark.createDataFrame(
        [("long", "Ann", 30, "Female", "Peru", "Peru", events, ["cat"]), ("short", "Bob", 30, "Male", "Peru", "Peru", events[:1], []),
         ("bad", "Cid", 30, "Male", "Peru", "Peru", events, [])],
        "unique_id string, name string, age long, gender string, birthplace string, residence string, "
        "events array<struct<event:string,date:string,time_interval:string,experience:string>>, album array<string>")
    asked = []

    def item(d):
        return f"{{'rationale': '', 'image_description': '{d}', 'image_source': 'mobile', 'keywords': '', 'image_id_from_mobile': 'new added image'}}"

    def answers(name, requests):
        asked.append(name)
        n = name[-1]
        turn = "{'utterance_id': 1, 'speaker': 's', 'utterance': 'u', 'sharing_info': %s}"
        text = "[" + turn % "{}" + ", " + turn % item(f"photo {n}") + ", " + turn % ("[" + item(f"one {n}") + ", " + item("") + "]") + "]"
        return requests.select("request_id", F.lit(1).alias("seq"), F.when(F.col("unique_id") == "bad", "[").otherwise(text).alias("generation"))
    done = ST.run_rounds(ST.session_round, state, answers, tmp_dir, 6)
    assert [sorted(r.unique_id for r in d.accepted.collect()) for d in done] == [["long", "short"], ["long"], ["long"], []]
    last = done[2].accepted.first()
    assert last.album == ["cat", "photo 1", "one 1", "", "photo 2", "one 2", "", "photo 3", "one 3", ""] and last.album_before == 7
    assert "0. cat; 1. photo 1; 2. one 1; 3. ; 4. photo 2" in last.dialogue_prompt
    assert "- 2024.01.01: e1\n- 2024.01.02: e2\n" in last.dialogue_prompt and "1 day later from the 2024.01.02, on 2024.01.03" in last.dialogue_prompt
    kept = os.path.join(tmp_dir, "again")
    ST.run_rounds(ST.session_round, state, answers, kept, 2)
    before = {f for _, _, names in os.walk(kept) for f in names}
    resumed = ST.run_rounds(ST.session_round, state, answers, kept, 6)
    assert before <= {f for _, _, names in os.walk(kept) for f in names}
    assert resumed[2].accepted.first().album == last.album
