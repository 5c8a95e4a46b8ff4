"""Independent Python restatements (from the written rules) vs the Spark stages:
commonsense extraction (X8), router parse (X4/X9/X10), speakers (X11)."""

import random

from pyspark.sql import functions as F

from curatio import constants as K
from curatio.plans import commonsense as C
from curatio.plans import episodes as E
from curatio.plans import images as I


# rule table: marker whose last occurrence starts the answer, per relation
_MARK = {"goal": "I plan ", "relationship": "So, I ", "routine": "I regularly "}


def _after_last(text, sep):
    return text.rsplit(sep, 1)[-1]


def py_commonsense(gen, rel, lead):
    """Rule model of the extraction; None marks the rows the source cannot parse."""
    unfinal = (lambda t: t[:-1] if t[-1:] == "." else t)
    if lead in gen:
        rest = "".join(gen.split(lead))
        if not rest:
            return None
        rest = unfinal(rest)
        return _after_last(rest, "I ") if rel == "experience" else rest
    if not gen:
        return None
    cut = None
    if rel == "experience" and " Now, " in gen:
        head = gen.partition(" Now, ")[0]
        cut = _after_last(head, "I ") if gen[:2] == "I " else head
    elif _MARK.get(rel) and _MARK[rel] in gen:
        cut = _after_last(gen, _MARK[rel])
    elif gen[:2] == "I ":
        cut = _after_last(gen, "I ")
    return unfinal(cut if cut else gen)


def test_commonsense_extraction_random(spark):
    rng = random.Random(3)
    words = ["I ", "I plan ", "So, I ", "I regularly ", " Now, ", "AI tools", "run", ".", "x", " "]
    rows = []
    for i in range(600):
        rel = rng.choice(K.RELATIONS)
        lead = rng.choice(["L1 I ", " Now, L2", "L3 So, I "])
        gen = "".join(rng.choice(words) for _ in range(rng.randint(0, 6)))
        if rng.random() < 0.2:
            gen = lead + gen
        rows.append((i, gen, rel, lead))
    df = spark.createDataFrame(rows, "i int, g string, relation string, lead string")
    got = C.with_commonsense(df, "g", "relation", "lead").orderBy("i").select("parsed").collect()
    for (i, g, rel, lead), r in zip(rows, got):
        assert r[0] == py_commonsense(g, rel, lead), (g, rel, lead)


def py_img(text):
    """Rule model of the trigger repair: keep text up to the second tag, squeeze the rest."""
    n = text.count("[img]")
    if n == 0:
        text = text + " [img]"
    elif n > 1:
        first, _, rest = text.partition("[img]")
        second, _, tail = rest.partition("[img]")
        text = first + "[img]" + second + " ".join(piece.strip() for piece in tail.split("[img]"))
    return text.replace("[img]", "img")


def test_img_repair_random(spark):
    rng = random.Random(5)
    cases = ["", "a [img] b", "a", "[img][img]", " x [img]  y [img] z [img]  "]
    for _ in range(200):
        cases.append("".join(rng.choice(["[img]", " ", "a", "　", "b "]) for _ in range(rng.randint(0, 8))))
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, d string")
    got = [r[0] for r in df.orderBy("i").select(I.repair_img_tags(F.col("d"))).collect()]
    assert got == [py_img(c) for c in cases]


def py_route(gen):
    """Rule model of the router parse, via str methods rather than a regex."""
    P = "Personalized Text-to-Image Generator"
    order = [P, "Image Database Retrieval", "Web Search"]
    g = gen.replace("Module:", "").strip()
    mark = "\nModified Image Description:"
    if P in g:
        if mark not in g:
            return None, None, "no_description"
        module_part, _, desc = g.rpartition(mark)
        found = [name for name in order if name in module_part]
        if not found:
            return None, None, "no_module"
        return K.MODULE_CODES[found[0]], py_img(desc.lstrip()), None
    if "Modified Image Description" in g:
        g = g.partition("Modified Image Description: ")[0].strip()
    found = [name for name in order if name in g]
    label = found[0] if found else g
    return K.MODULE_CODES.get(label, "t2i"), "", None


def test_route_parse_cases(spark):
    P = "Personalized Text-to-Image Generator"
    cases = [f"Module: {P}\nModified Image Description: a man [img] smiling",
             f"{P}\nModified Image Description: no tag",
             f"{P}\nModified Image Description: a [img] b [img] c [img] d",
             f"Module: {P}\nModified Image Description: x\nModified Image Description: y",
             f"Module: {P}", "Module: Web Search", "Image Database Retrieval",
             "Text-to-Image Generator", "something else",
             "Web Search\nModified Image Description: z", f"Module: Web Search {P} x"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, generation string")
    got = I.route_parse(df).orderBy("i").select("image_alignment_module", "modified_image_description",
                                                "reject_reason").collect()
    for c, r in zip(cases, got):
        assert tuple(r) == py_route(c), c


def test_speakers(spark):
    cases = [("Tom", "Tom"), ("user", "Tom"), ("User", "Tom"), ("AI_Assistant", "AI Assistant"),
             ("АI assistant", "AI Assistant"), ("", None), ("Bob", "Tom"), ("사용자", "Tom")]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s string") \
        .withColumn("owner", F.lit("Tom"))
    got = [r[0] for r in df.orderBy("i").select(E.normalise_speaker("s", "owner")).collect()]
    assert got == [e for _, e in cases]
    ans = spark.createDataFrame([("User",), ("ai assistant",), ("TOM",), ("x",)], "a string")
    got = [r[0] for r in ans.select(E.inferred_speaker("a", F.lit("Tom"))).collect()]
    assert got == ["Tom", "AI Assistant", "Tom", None]


def test_enumerate_and_extend_album(spark):
    df = spark.createDataFrame([(["a", "b"], ["c"])], "pool array<string>, new array<string>")
    r = df.select(E.enumerate_album(E.extend_album(F.col("pool"), F.col("new"))).alias("x")).first()["x"]
    assert [(e["image_id"], e["image_description"]) for e in r] == [(0, "a"), (1, "b"), (2, "c")]
