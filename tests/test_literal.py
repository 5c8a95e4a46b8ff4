"""X6 literal parsing: FIXTURES §B literal row."""

import json
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from curatio.functions import literal
from curatio.functions.literal import parse_literal, parse_one


def test_parse_one_cases():
    assert parse_one('[{"a": "b"}]')[0] == "list"
    assert parse_one("[{'a': 'b'}]")[0] == "list"
    assert json.loads(parse_one("[{'id': 1,}]")[1]) == [{"id": 1}]
    assert json.loads(parse_one("[None]")[1]) == [None]
    assert parse_one("[true]")[2].startswith("syntax")
    assert parse_one("[1")[2].startswith("syntax")
    assert parse_one("{'a': 1}")[0] == "dict"
    assert parse_one("[{1, 2}]")[2].startswith("syntax")      # a set is not JSON
    assert parse_one("[]")[0] == "list"
    assert parse_one("[1]\n  [2]")[2].startswith("syntax")
    assert parse_one(None)[2] == "null"


def test_udf_matches_python(spark):
    texts = ["[{'id': 1}]", "[true]", "{'a': []}", "broken", "['x', 'y',]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.orderBy("i").select(parse_literal(F.col("t")).alias("r")).select("r.*").collect()
    for t, r in zip(texts, rows):
        exp = parse_one(t)
        assert (r["shape"], r["js"], r["err"]) == exp[:3]


def test_a_batch_is_parsed_in_slices():
    """Python objects of a batch stay a small part of it; the structs are those of each text alone."""
    texts = [f"[{{'id': {i}, 'event': '{'x' * 2000}'}}]" for i in range(3000)] + [None, "[true]", "['x']"]
    batch = pa.array(texts)
    tracemalloc.start()
    got = literal.parse_texts(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < batch.nbytes / 2
    assert [tuple(r.values()) for r in got.to_pylist()] == [parse_one(t) for t in texts]
    assert len(literal.parse_texts(pa.array([], pa.string()))) == 0
