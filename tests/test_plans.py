"""Plan-shape checks over every registered query (sf0.001): no pairwise products,
aggregations split partial/final, skewed keys handled."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF
from curatio.operators.core import dedupe_first

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_products_in_any_query(spark):
    bad = {}
    for name, fn in E.queries().items():
        plan = _plan(fn(spark, SF))
        hits = [f for f in FORBIDDEN if f in plan]
        if hits:
            bad[name] = hits
    assert bad == {}


def test_dedupe_is_partial_then_final_and_correct_under_skew(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randint(0, 500)}", i, f"v{i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, seq long, v string").repartition(8)
    out = dedupe_first(df, ["k"], ["seq"])
    plan = _plan(out)
    assert "partial_min_by" in plan
    got = {r["k"]: r["seq"] for r in out.collect()}
    exp = {}
    for k, s, _ in rows:
        exp[k] = min(s, exp.get(k, s))
    assert got == exp


def test_top_k_uses_partial_group_limit(spark):
    plan = _plan(E.queries()["few_shot_block"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan
