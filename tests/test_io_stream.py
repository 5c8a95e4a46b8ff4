"""S1-S8 / K1-K6 round trips and §2.13 ingest idempotence."""

import json
import os

from pyspark.sql import functions as F

from curatio.sources import io
from curatio.streaming.ingest import ingest, ingest_unique


def test_partition_tree_with_colon_paths(spark, tmp_dir):
    for seed in (0, 1):
        d = os.path.join(tmp_dir, f"persona_seed:{seed}", "session_num:2")
        os.makedirs(d)
        with open(os.path.join(d, "final_output.jsonl"), "w") as f:
            f.write(json.dumps({"id": f"a{seed}"}) + "\n" + json.dumps({"id": f"b{seed}"}) + "\n")
    os.makedirs(os.path.join(tmp_dir, "persona_seed:7"))          # empty folder is skipped
    df = io.read_partition_tree(spark, tmp_dir, "id string")
    got = sorted((r["id"], r["persona_seed"], r["session_num"]) for r in df.collect())
    assert got == [("a0", 0, 2), ("a1", 1, 2), ("b0", 0, 2), ("b1", 1, 2)]
    only = io.read_partition_tree(spark, tmp_dir, "id string", only={"persona_seed": 1})
    assert sorted(r["id"] for r in only.collect()) == ["a1", "b1"]
    assert len(df.inputFiles()) == 2 and len(only.inputFiles()) == 1       # the other seed's file is never opened
    with open(os.path.join(tmp_dir, "persona_seed:0", "session_num:2", "final_output.jsonl"), "w") as f:
        f.write("not json")
    strict = io.read_partition_tree(spark.newSession(), tmp_dir, "id string", only={"persona_seed": 1, "session_num": 2})
    assert sorted(r["id"] for r in strict.collect()) == ["a1", "b1"]
    none = io.read_partition_tree(spark, tmp_dir, "id string", only={"persona_seed": 5})
    assert none.count() == 0 and none.columns == ["id", "persona_seed", "session_num"]


def test_json_documents_one_array_per_seed(spark, tmp_dir):
    rows = [(7, 0, 'é "x"\n]', None), (3, 0, "", 1.5), (5, 1, None, 2.0), (9, None, "no seed", None)] + [(i, 2, "t" * 50, float(i)) for i in range(10, 700)]
    df = spark.createDataFrame(rows, "id int, persona_seed int, t string, v double").repartition(5)
    out = os.path.join(tmp_dir, "docs")
    io.write_json_documents(df, out, order=["id"])

    def documents():
        found = {}
        for folder in os.listdir(out):
            parts = [f for f in os.listdir(os.path.join(out, folder)) if f.startswith("part-")] if "=" in folder else []
            for part in parts:
                with open(os.path.join(out, folder, part), encoding="utf-8") as f:
                    text = f.read()
                found[folder.split("=")[1]] = json.loads(text), text
            assert len(parts) < 2
        return found
    found = documents()
    assert found["0"][0] == [{"id": 3, "t": "", "v": 1.5}, {"id": 7, "t": 'é "x"\n]', "v": None}] and "é" in found["0"][1]
    assert found["1"][0] == [{"id": 5, "t": None, "v": 2.0}] and found["__HIVE_DEFAULT_PARTITION__"][0][0]["id"] == 9
    assert [r["id"] for r in found["2"][0]] == list(range(10, 700))
    io.write_json_documents(df.filter("id = 5").withColumn("t", F.lit("new")), out)       # one seed again: the others stay
    again = documents()
    assert again["1"][0] == [{"id": 5, "t": "new", "v": 2.0}] and again["2"] == found["2"]
    back = io.read_json_array(spark, out, "id int, t string, v double, persona_seed int")
    assert back.count() == len(rows) and back.filter("persona_seed = 2").count() == 690
    io.write_json_documents(df.filter("false"), os.path.join(tmp_dir, "empty"))


def test_jsonl_is_strict(spark, tmp_dir):
    path = os.path.join(tmp_dir, "x.jsonl")
    with open(path, "w") as f:
        f.write('{"a": 1}\n{"a": \n')
    assert io.read_jsonl(spark, path, "a int", strict=False).count() == 2
    try:
        io.read_jsonl(spark, path, "a int").collect()
    except Exception as e:  # noqa: BLE001
        assert "MALFORMED" in str(e).upper()
    else:
        raise AssertionError("a malformed line was read")


def test_read_or_empty_and_missing_tree(spark, tmp_dir):
    assert io.read_or_empty(spark, os.path.join(tmp_dir, "nope"), "a int").count() == 0
    assert io.read_partition_tree(spark, os.path.join(tmp_dir, "nope"), "id string").count() == 0


def test_json_array_and_tsv(spark, tmp_dir):
    p = os.path.join(tmp_dir, "doc.json")
    with open(p, "w", encoding="utf-8") as f:
        json.dump([{"k": 1, "t": "é"}, {"k": 2, "t": "x"}], f, ensure_ascii=False)
    assert sorted(r["k"] for r in io.read_json_array(spark, p, "k int, t string").collect()) == [1, 2]
    tsv = os.path.join(tmp_dir, "c.tsv")
    with open(tsv, "w") as f:
        f.write('http://a/1.jpg\ta "quoted" caption\nhttp://b/2.jpg\tplain\n')
    rows = io.read_caption_tsv(spark, tsv).collect()
    assert [r["caption"] for r in rows] == ['a "quoted" caption', "plain"]


def test_write_buckets_and_rejects(spark, tmp_dir):
    df = spark.range(250).select(F.col("id"), (F.col("id") / 100).cast("int").alias("persona_seed"))
    out = os.path.join(tmp_dir, "buckets")
    io.write_buckets(df, out)
    io.write_buckets(df.filter("persona_seed = 1"), out)            # re-run of one seed: no duplicates
    back = spark.read.json(out)
    assert back.count() == 250
    assert sorted(r[0] for r in back.select("persona_seed").distinct().collect()) == [0, 1, 2]


def test_report_file(spark, tmp_dir):
    from curatio.operators.core import report
    path = os.path.join(tmp_dir, "report")
    assert io.read_report(spark, path).count() == 0                 # no stage has written one
    df = spark.range(30)
    for n in (30, 7):                                                # a rerun replaces the report
        io.write_report(report(df.filter(F.col("id") < n), "s", {"total": F.count("*"), 'odd "x": y': F.count_if(F.col("id") % 2 == 1)}), path)
    parts = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(parts) == 1
    with open(os.path.join(path, parts[0])) as f:
        assert f.read().splitlines() == ["total\t7", 'odd "x": y\t3']
    assert [tuple(r) for r in io.read_report(spark, path).collect()] == [("total", 7), ('odd "x": y', 3)]


def test_text_files_keep_their_lines_in_order(spark, tmp_dir):
    path = os.path.join(tmp_dir, "texts")
    rows = [(s, n, f"{s}é {n}") for s in (1, 2, 3) for n in range(20)]
    df = spark.createDataFrame(rows, "seed int, pos int, value string").repartition(7)
    io.write_text_files(df, path, "seed", ["pos"])
    io.write_text_files(df.filter("seed = 2").withColumn("value", F.upper("value")), path, "seed", ["pos"])      # one seed again
    got = {r["seed"]: r["value"] for r in io.read_whole_text(spark, path).collect()}
    assert got == {s: "".join((f"{s}é {n}".upper() if s == 2 else f"{s}é {n}") + "\n" for n in range(20)) for s in (1, 2, 3)}


def test_stream_ingest_is_idempotent(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    spark.range(40).select(F.col("id"), (F.col("id") % 3).alias("g")).repartition(4) \
        .write.json(src)

    def parse(b):
        return b.withColumn("double", F.col("id") * 2)
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    first = ingest(spark, src, "id long, g long", out, ck, parse)
    assert first.count() == 40
    again = ingest(spark, src, "id long, g long", out, ck, parse)      # nothing new: unchanged
    assert again.count() == 40
    spark.range(40, 45).select(F.col("id"), (F.col("id") % 3).alias("g")).write.mode("append").json(src)
    third = ingest(spark, src, "id long, g long", out, ck, parse)
    assert third.count() == 45 and third.select("id").distinct().count() == 45


def test_list_images_and_utf8(spark, tmp_dir):
    from curatio.functions.text import is_valid_utf8, repair_utf8
    os.makedirs(os.path.join(tmp_dir, "imgs", "a"))
    for name in ("a/1.jpg", "2.jpg", "3.png"):
        with open(os.path.join(tmp_dir, "imgs", name), "wb") as f:
            f.write(b"\xff\xd8")
    paths = sorted(os.path.basename(r["path"]) for r in io.list_images(spark, os.path.join(tmp_dir, "imgs")).collect())
    assert paths == ["1.jpg", "2.jpg"]
    df = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"bad\xff"),)], "b binary")
    rows = df.select(repair_utf8("b").alias("t"), is_valid_utf8("b").alias("v")).collect()
    assert rows[0]["t"] == "ok" and rows[0]["v"] and not rows[1]["v"] and rows[1]["t"] == "bad�"


def test_observe_report(spark):
    from curatio.operators.core import observe_report
    df = spark.range(10)
    obs_df, read = observe_report(df, "s", {"n": F.count("*"), "odd": F.count_if(F.col("id") % 2 == 1)})
    obs_df.write.format("noop").mode("overwrite").save()
    assert read() == {"n": 10, "odd": 5}


def test_ingest_unique_across_batches(spark, tmp_dir):
    from curatio.streaming.ingest import ingest_unique
    src = os.path.join(tmp_dir, "in")
    spark.range(30).select((F.col("id") % 10).alias("k"), F.col("id").alias("seq")).repartition(3) \
        .write.json(src)
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    first = ingest_unique(spark, src, "k long, seq long", out, ck, lambda b: b, ["k"], ["seq"])
    assert first.count() == 10 and first.select("k").distinct().count() == 10
    spark.range(100, 105).select((F.col("id") % 12).alias("k"), F.col("id").alias("seq")) \
        .write.mode("append").json(src)                     # keys 4..8 repeat, none new below 10
    again = ingest_unique(spark, src, "k long, seq long", out, ck, lambda b: b, ["k"], ["seq"])
    assert again.count() == again.select("k").distinct().count() == 10


def test_whole_text_image_db_and_rejects(spark, tmp_dir):
    t = os.path.join(tmp_dir, "tpl.txt")
    with open(t, "w") as f:
        f.write("line one\nline two {x}\n")
    rows = io.read_whole_text(spark, t).collect()
    assert len(rows) == 1 and rows[0]["value"] == "line one\nline two {x}\n"
    for src, n in (("cc", 3), ("rc", 2)):
        spark.range(n).select(F.col("id").alias("vec_id")).write.parquet(os.path.join(tmp_dir, src))
    db = io.read_image_db(spark, {"cc": os.path.join(tmp_dir, "cc"), "rc": os.path.join(tmp_dir, "rc")})
    assert sorted((r["source"], r["vec_id"]) for r in db.collect()) == \
        [("cc", 0), ("cc", 1), ("cc", 2), ("rc", 0), ("rc", 1)]
    df = spark.createDataFrame([(1, None), (2, "syntax:fail"), (3, "key:fail")], "id int, reject_reason string")
    out = os.path.join(tmp_dir, "rej")
    io.write_rejects(df, out)
    back = spark.read.parquet(out)
    assert sorted((r["id"], r["reject_reason"]) for r in back.collect()) == [(2, "syntax:fail"), (3, "key:fail")]


def test_session_requests_for_target(spark):
    from curatio.plans.events import session_requests_for
    rows = [(g, n, f"e{g}{n}", f"2024.01.0{n}", f"d{n-1}", "", "1 day", "x") for g, m in ((1, 3), (2, 5)) for n in range(1, m + 1)]
    df = spark.createDataFrame(rows, "g int, session_number int, event string, date string, last_date string, "
                                     "history_before string, time_interval string, experience string")
    for c in ("name", "age", "gender", "birthplace", "residence", "mobile_device"):
        df = df.withColumn(c, F.lit("v"))
    got = session_requests_for(df, ["g"], 4).collect()
    assert [(r["g"], r["session_number"]) for r in got] == [(2, 4)]
    assert session_requests_for(df, ["g"], 6).count() == 0


def test_ingest_without_files_is_empty(spark, tmp_dir):
    os.makedirs(os.path.join(tmp_dir, "in"))
    args = (spark, os.path.join(tmp_dir, "in"), "id long, g long")
    got = ingest(*args, os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck"), lambda b: b.withColumn("x", F.col("id")))
    assert got.count() == 0 and got.columns == ["id", "g", "x", "batch_id"]
    got = ingest_unique(*args, os.path.join(tmp_dir, "out2"), os.path.join(tmp_dir, "ck2"), lambda b: b, ["g"], ["id"])
    assert got.count() == 0 and got.columns == ["id", "g"]


def test_unique_ingest_touches_only_its_keys(spark, tmp_dir):
    src, out, ck = (os.path.join(tmp_dir, x) for x in ("in", "out", "ck"))

    def go():
        rows = ingest_unique(spark, src, "k string, seq long, v string", out, ck, lambda b: b, ["k"], ["seq"], buckets=64)
        return sorted(((r["k"], r["seq"], r["v"]) for r in rows.collect()), key=str)

    def add(rows):
        spark.createDataFrame(rows, "k string, seq long, v string").coalesce(1).write.mode("append").json(src)
    add([(f"k{i % 50}", 100 + i, f"a{i}") for i in range(200)])
    first = go()
    assert set(first) == {(f"k{i}", 100 + i, f"a{i}") for i in range(50)} and len(first) == 50
    add([("k3", 5, "earlier"), ("k4", 900, "later"), ("new", 1, "n"), (None, 2, "null key")])
    second = go()
    want = {k: (k, s, v) for k, s, v in first} | {"k3": ("k3", 5, "earlier"), "new": ("new", 1, "n")}
    assert {x for x in second if x[0] is not None} == set(want.values()) and (None, 2, "null key") in second
    batches = sorted(os.listdir(os.path.join(out, "rows")))
    assert len(batches) == 2
    parts = [d for d in os.listdir(os.path.join(out, "rows", batches[1])) if d.startswith("bucket=")]
    assert len(parts) <= 4                                     # four keys, so four parts at most
    assert go() == second                                      # nothing new
