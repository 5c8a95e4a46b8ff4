"""No row is lost: null keys, empty pools, short pools, null completions; strict event keys; out-of-order batches."""

import json

import pytest
from pyspark.sql import functions as F

from curatio.operators.position import default_buckets, hex_bucket, positions, quantile_bucket
from curatio.plans import commonsense as C
from curatio.plans import events as EV
from curatio.plans import faces as FA
from curatio.plans import persona as P
from curatio.streaming.ingest import ingest_unique


def test_positions_keep_null_groups_and_null_keys(spark):
    rows = [(None, 3), ("a", None), ("a", 1), ("a", 2), (None, None), (None, 5)]
    df = spark.createDataFrame(rows, "g string, k long")
    got = positions(df, ["k"], quantile_bucket(df, "k", 4), group=["g"]).collect()
    assert sorted((r.g or "", r.pos) for r in got) == [("", 0), ("", 1), ("", 2), ("a", 0), ("a", 1), ("a", 2)]
    assert all((r.pos == 0) == (r.k is None) for r in got)          # nulls first, as in an ascending sort
    whole = positions(df.select("k"), ["k"], quantile_bucket(df, "k", 4)).collect()
    assert sorted(r.pos for r in whole[2:] + whole[:2]) == list(range(6))
    hexed = spark.createDataFrame([(None,), ("00ff",), ("ff00",)], "h string")
    assert positions(hexed, ["h"], hex_bucket("h", 2)).count() == 3


def test_bucket_count_is_several_at_every_size():
    assert default_buckets(0) == default_buckets(10) == 4 and default_buckets(1 << 40, 1) == 1 << 40


def test_people_with_an_empty_pool_are_rejected_not_lost(spark):
    people = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, country string")
    pool = spark.createDataFrame([("x", 7, "Ann")], "country string, n long, name string")
    got = {r.id: (r.name, r.reject_reason) for r in
           C.pick_names(people, pool, 1, ["id"], ["country"], "n", quantile_bucket(pool, "n", 4)).collect()}
    assert got == {1: ("Ann", None), 2: (None, "empty_pool"), 3: (None, "empty_pool")}


def test_zip_sample_raises_or_keeps_people_beyond_the_pool(spark):
    people = spark.createDataFrame([(i,) for i in range(10)], "uid long")
    pool = spark.createDataFrame([(i,) for i in range(4)], "attr_id long")
    with pytest.raises(ValueError):
        FA.zip_sample(people, pool, 1, "uid", "attr_id")
    got = FA.zip_sample(people, pool, 1, "uid", "attr_id", strict=False).collect()
    assert len(got) == 10 and sorted(r.attr_id for r in got if r.attr_id is not None) == [0, 1, 2, 3]


def test_null_completions_are_counted_and_rejected(spark):
    gen = spark.createDataFrame([(1, None, "movie title"), (2, "1. I like Up. (movie title: Up)\n2. x", "movie title")],
                                "seq long, generation string, persona_entity_key string")
    res = P.persona_parse(gen)
    report = {r.metric: r.value for r in res.report.collect()}
    assert report["total_num"] == 60
    assert res.pieces.filter("seq = 1 AND NOT matched").count() == 1
    albums = P.album_parse(spark.createDataFrame([(1, None)], "k long, generation string"), ["k"])
    assert albums.items.count() == 1 and albums.albums.count() == 0


def _graph(**changes):
    edge = {"caused_by:id": 1, "caused_by:time_interval": "1 day", "caused_by:experience_op": "cause", "caused_by:experience": "e"}
    nodes = [{"id": 1, "event": "a", "date": "2020.01.01", "caused_by": {}},
             {"id": 2, "event": "b", "date": "2020.01.02", "caused_by": edge}]
    for path, value in changes.items():
        node, key = int(path[1]), path[3:]
        if value is None:
            nodes[node].pop(key)
        else:
            nodes[node][key] = value
    return nodes


def test_event_keys_and_root_id_are_strict(spark):
    broken = dict(_graph()[1]["caused_by"])
    broken["caused_by_id"] = broken.pop("caused_by:id")
    colon = _graph()
    colon[1]["caused_by:"] = colon[1].pop("caused_by")
    cases = {"ok": _graph(), "no date": _graph(n1_date=None), "text root": _graph(n0_id="1"), "true root": _graph(n0_id=True),
             "underscore": _graph(n1_caused_by=broken), "colon": colon, "no edge": _graph(n1_caused_by={})}
    gen = spark.createDataFrame([(k, repr(v)) for k, v in cases.items()], "name string, generation string")
    plain = {r.name: r.reject_reason for r in EV.event_parse(gen).annotated.collect()}
    assert plain == {k: None if k == "ok" else "key:fail" for k in cases}
    mended = EV.event_parse(gen, repair=True).annotated.collect()
    assert {r.name for r in mended if r.reject_reason is None} == {"ok", "underscore", "colon"}
    node = next(r.nodes for r in mended if r.name == "underscore")[1]
    assert set(json.loads(node["caused_by"])) == set(EV.EDGE_KEYS)


def test_first_wins_across_batches_is_by_order_not_by_arrival(spark, tmp_dir):
    src = f"{tmp_dir}/in"
    for seq in (9, 1, 5):
        spark.createDataFrame([("k", seq)], "key string, seq long").coalesce(1).write.mode("append").json(src)
    got = ingest_unique(spark, src, "key string, seq long", f"{tmp_dir}/out", f"{tmp_dir}/ck", lambda b: b,
                        ["key"], ["seq"], max_files_per_trigger=1).select("key", F.col("seq")).collect()
    assert [(r.key, r.seq) for r in got] == [("k", 1)]
