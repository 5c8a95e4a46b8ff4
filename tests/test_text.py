"""X1/X2/X15/X16/P3/title/strip against Python's own string semantics."""

import random
import re

from pyspark.sql import functions as F

from curatio.functions import text as T

STRIP_CASES = ["  a b  ", "\x1c\x1fx\x85\xa0", "　y\x0b", "​z​", "", "\t\n", "a\r\n"]
TITLE_CASES = ["o'neil", "brand#2x", "hello world", "MIXED case", "ñandú río", "a1b2", "", "x-ray_vision"]


def col_values(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("s"))).collect()]


def test_py_strip_matches_python(spark):
    assert col_values(spark, STRIP_CASES, T.py_strip) == [s.strip() for s in STRIP_CASES]


def test_title_case_matches_python(spark):
    assert col_values(spark, TITLE_CASES, T.title_case) == [s.title() for s in TITLE_CASES]


def test_drop_final_dot(spark):
    cases = ["a.", "a..", "a.\n", "a", ""]
    assert col_values(spark, cases, T.drop_final_dot) == [s[:-1] if s.endswith(".") else s for s in cases]


def test_count_substr(spark):
    cases = ["the then the", "", "thethe", "xyz"]
    assert col_values(spark, cases, lambda c: T.count_substr(c, "the")) == [s.count("the") for s in cases]


def py_split(text, n):
    delims = [f"\n{i}. " for i in range(1, n + 1)] + [f"\n{i}." for i in range(1, n + 1)]
    return re.split("|".join(delims), text)


def test_numbered_split_matches_re_split(spark):
    cases = ["I love tea (Drink: Tea)\n2. I like (cold) coffee (Drink: Coffee) ok\n3.none\n31. x (Drink: Z)",
             "a\n11.tight\n2. b", "", "x\r\n2. y", "\n1. lead"]
    rng = random.Random(7)
    for _ in range(50):
        parts = [rng.choice(["a", "b (K: v)", "", "\r", "[K: w]"]) for _ in range(rng.randint(1, 6))]
        cases.append("".join(p + rng.choice(["\n2. ", "\n10.", "\n31. ", "\n3.", " "]) for p in parts))
    got = col_values(spark, cases, lambda c: T.numbered_split(c, 30))
    assert got == [py_split(s, 30) for s in cases]


def test_list_item_regex_matches_python(spark):
    pattern = re.compile(r"(?P<sent>.*) [\(|\[](?P<key>.*): (?P<value>.*)[\)|\]]")
    cases = ["I love tea (Drink: Tea)", "I like (cold) coffee (Drink: Coffee) ok", "none", "x [Drink: Y]",
             "a\rb (K: v)", "q (Q: R: S)", "", "multi\nline (K: v)", "bar |K: v|"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(cases)], "i int, s string")
    m, s_, k, v = T.list_item_fields("s")
    rows = df.orderBy("i").select(m, s_, k, v).collect()
    for case, row in zip(cases, rows):
        mm = pattern.match(case)
        assert bool(row[0]) == bool(mm), case
        if mm:
            assert (row[1], row[2], row[3]) == (mm["sent"], mm["key"], mm["value"]), case


def test_render_matches_format(spark):
    tpl = "Name: {name}\nAge: {age} {name}!"
    df = spark.createDataFrame([("Ann {x}", 3)], "name string, age int")
    out = df.select(T.render(tpl, name="name", age="age")).first()[0]
    assert out == tpl.format(name="Ann {x}", age=3)


def test_ret_tag_extract(spark):
    cases = ["<RET> <h> a </h> b", "no tag <h>x</h>", "<RET><h>1</h><h> 2 </h> end", "<RET> none"]

    def py(o):
        if "<RET>" not in o:
            return o
        return o.split("<h>")[-1].split("</h>")[0].strip()
    assert col_values(spark, cases, T.ret_tag_extract) == [py(c) for c in cases]


def test_norm_similarity(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", "")], "a string, b string")
    r = df.select(T.norm_similarity("a", "b")).collect()
    assert abs(r[0][0] - (1 - 3 / 7)) < 1e-12 and r[1][0] is None
