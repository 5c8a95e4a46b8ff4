"""Relational operators: positions/ntile (W1), album fold (§8.6), top-k (J10), zip (J5),
attribute sentence (P11), dedupe invariants."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatio import constants as K
from curatio.operators import knn
from curatio.plans import images
from curatio.operators.core import dedupe_first
from curatio.operators.position import hex_bucket, ntile_from_position, positions, quantile_bucket
from curatio.plans import episodes as E
from curatio.plans import faces as FA
from curatio.plans.worklist import shard


def py_sharding(items, k):
    """Balanced contiguous split, independent model: numpy's array_split, empties dropped."""
    return [list(c) for c in np.array_split(np.array(items, dtype=np.int64), k) if len(c)]


def test_shards_match_reference_rule(spark):
    for n, k in [(10, 3), (7, 20), (20, 20), (23, 4), (1, 1), (0, 5), (1003, 20)]:
        df = spark.range(n).withColumnRenamed("id", "key")
        b = quantile_bucket(df, "key", 4) if n else F.lit(0)
        got = sorted((r["key"], r["chunk_idx"]) for r in shard(df, ["key"], b, k).collect())
        exp = sorted((x, ci) for ci, chunk in enumerate(py_sharding(list(range(n)), k)) for x in chunk)
        assert got == exp, (n, k)


def test_positions_grouped_and_skewed(spark):
    rng = random.Random(1)
    rows = [(("hot" if rng.random() < 0.4 else f"g{rng.randint(0, 9)}"), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long").withColumn("o", F.md5(F.col("v").cast("string")))
    got = positions(df, ["o"], hex_bucket("o", 2), group=["g"], pos_col="pos", size_col="n").collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append((r["o"], r["pos"], r["n"]))
    for g, lst in by.items():
        lst.sort()
        assert [p for _, p, _ in lst] == list(range(len(lst)))
        assert all(n == len(lst) for _, _, n in lst)


def fold_album(initial, items):
    """Sequential album: rule-6 appends, rule-3 looks up the album as it is then."""
    album = list(initial)
    out = []
    for cls, desc, ref in items:
        res = None
        if cls == 3 and ref is not None:
            try:
                idx = int(ref)
                if -len(album) <= idx < len(album):
                    res = album[idx]
            except ValueError:
                pass
        out.append(res)
        if cls == 6:
            album.append(desc)
    return out, album


def test_album_state_equals_sequential_fold(spark):
    rng = random.Random(11)
    rows, initial, expected = [], [], {}
    for ep in range(40):
        uid = f"e{ep}"
        init = [f"init{ep}-{i}" for i in range(rng.randint(0, 3))]
        initial += [(uid, i, d) for i, d in enumerate(init)]
        items = []
        for s in range(1, rng.randint(2, 6)):
            for u in range(rng.randint(1, 4)):
                if rng.random() < 0.4:
                    items.append((s, u, 6, f"new{ep}-{s}-{u}", None))
                else:
                    items.append((s, u, 3, "", str(rng.randint(-5, 6))))
        res, _ = fold_album(init, [(c, d, r) for _, _, c, d, r in items])
        for (s, u, c, d, r), x in zip(items, res):
            expected[(uid, s, u)] = x
            desc, src, rid = (d, "mobile", "new added image") if c == 6 else ("", "mobile", r)
            rows.append((uid, s, u, 0, "rat", desc, src, "", rid, "dict"))
    schema = ("unique_id string, session_number long, utterance_id long, item_pos long, sh_rationale string, "
              "sh_description string, sh_source string, sh_keywords string, sh_id string, sh_shape string")
    items_df = spark.createDataFrame(rows, schema)
    init_df = spark.createDataFrame(initial, "unique_id string, pos long, description string")
    st = E.album_state(items_df, init_df)
    got = {(r["unique_id"], r["session_number"], r["utterance_id"]): r["resolved_description"]
           for r in st.items.collect()}
    assert got == expected
    # album positions are dense 0..n-1 per episode
    for uid, ps in st.album.groupBy("unique_id").agg(F.collect_list("pos").alias("p")).collect():
        assert sorted(ps) == list(range(len(ps)))


def test_topk_matches_numpy_bruteforce(spark):
    rng = np.random.default_rng(0)
    d = rng.normal(size=(300, 8)).astype(np.float32)
    d[5] = d[6]                                            # exact tie: lower vec_id first
    src = ["a"] * 150 + ["b"] * 147 + ["c"] * 3            # source with fewer than k vectors
    db = spark.createDataFrame([(src[i], i, d[i].tolist()) for i in range(300)],
                               "source string, vec_id long, vec array<float>")
    q = rng.normal(size=(20, 8))
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    q[0] = d[5] / np.linalg.norm(d[5])
    qs = spark.createDataFrame([(i, q[i].tolist()) for i in range(20)], "qid long, qvec array<double>")
    got = knn.topk_per_source(qs, db.repartition(3), k=5, batch_bytes=7 * 64).collect()
    got = sorted((r["qid"], r["source"], r["rank"], r["vec_id"]) for r in got)
    exp = []
    for qi in range(20):
        for s in "abc":
            ids = [i for i in range(300) if src[i] == s]
            sc = sorted(((-(q[qi] @ d[i].astype(np.float64)), i) for i in ids))[:5]
            exp += [(qi, s, rank + 1, i) for rank, (_, i) in enumerate(sc)]
    assert got == sorted(exp)


def test_zip_sample_is_a_bijection(spark):
    people = spark.range(50).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("uid"))
    pool = spark.range(80).withColumnRenamed("id", "attr_id")
    z = FA.zip_sample(people, pool, 42, "uid", "attr_id").collect()
    assert len(z) == 50 and len({r["attr_id"] for r in z}) == 50


def py_attr_sentence(attr, age, gender, birthplace, style):
    """Rule model (second variant): one segment per kept category, commas squeezed at the end."""
    import re as _re
    keep = [(c, a) for c, a in attr.items()
            if c not in K.HUMAN_ATTR_SKIPPED and not (c == "hair" and "wears" in a)]
    segs = ["".join(" " + a[key] for key in K.HUMAN_ATTR_KEY_ORDER.get(c, []) if a.get(key))
            + K.HUMAN_ATTR_SUFFIX.get(c, "") + "," for c, a in keep]
    head = "A %s shot, a %s-years-old %s from %s," % (style, age, gender.lower(), birthplace)
    return _re.sub(",+$", "", head + "".join(segs)) + "."


def test_attribute_sentence_random(spark):
    rng = random.Random(9)
    cats = list(K.HUMAN_ATTR_KEY_ORDER) + ["face", "overall-style", "gloves"]
    rows = []
    for i in range(300):
        attr = {}
        for cat in rng.sample(cats, rng.randint(0, 6)):
            keys = K.HUMAN_ATTR_KEY_ORDER.get(cat, ["x"]) + (["wears"] if rng.random() < 0.2 else [])
            attr[cat] = {k: rng.choice(["", "red", "long", "silk"]) for k in rng.sample(keys, len(keys))}
        rows.append((i, json.dumps(attr), 30 + i % 7, rng.choice(["Male", "Female"]), "Peru", "portrait"))
    df = spark.createDataFrame(rows, "i int, a string, age int, gender string, bp string, style string")
    got = df.orderBy("i").select(FA.attribute_sentence(F.col("a"), F.col("age"), F.col("gender"), F.col("bp"),
                                                       F.col("style"))).collect()
    for (i, a, age, g, bp, st), r in zip(rows, got):
        assert r[0] == py_attr_sentence(json.loads(a), age, g, bp, st), a


def test_dedupe_first_same_under_repartition(spark):
    rows = [(i % 13, i, f"v{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "k int, seq int, v string")
    a = sorted(dedupe_first(df, ["k"], ["seq"]).collect())
    b = sorted(dedupe_first(df.repartition(7), ["k"], ["seq"]).collect())
    assert a == b and all(r["seq"] == r["k"] for r in a)


def test_retrieve_images_touches_retrieval_requests_only(spark):
    rng = np.random.default_rng(3)
    d = rng.normal(size=(400, 8)).astype(np.float32)
    d[11] = d[13] = d[17]                                  # equal vectors tie: smaller ids first
    db = spark.createDataFrame([("a" if i % 3 else "b", i, d[i].tolist(), f"p/{i}.jpg") for i in range(400)] + [("a", 900, None, "p/900.jpg")],
                               "source string, vec_id long, vec array<float>, image_path string").repartition(3)
    q = rng.normal(size=(30, 8))
    q[3] = d[17]
    modules = ["retrieval" if i % 3 == 0 else "web" for i in range(30)] + ["retrieval"]
    reqs = spark.createDataFrame([(f"r{i}", m, f"text {i}") for i, m in enumerate(modules)],
                                 "image_uuid string, image_alignment_module string, image_description string")
    vecs = spark.createDataFrame([(f"r{i}", q[i].tolist()) for i in range(30)], "image_uuid string, vec array<double>")
    got = {r.image_uuid: r for r in images.retrieve_images(reqs, vecs, db, k=3, batch_bytes=200).collect()}
    assert len(got) == 31 and got["r1"].image_description == "text 1"
    for i, m in enumerate(modules):
        res = got[f"r{i}"].db_searched_results
        if m == "web" or i == 30:                          # r30 has no vector
            assert res is None
            continue
        qn = q[i] / np.linalg.norm(q[i])
        for s in "ab":
            ids = [j for j in range(400) if ("a" if j % 3 else "b") == s]
            want = sorted((-round(float(qn @ d[j].astype(np.float64)), 9), j) for j in ids)[:3]
            assert [h.image_path_from_db for h in res[s]] == [f"p/{j}.jpg" for _, j in want]
            assert [round(float(h.clip_score), 9) for h in res[s]] == [-x for x, _ in want]


def py_attr_strict(attr, age, gender, birthplace, style):
    """Rule model (first variant): None when a category is unknown or hair has 'wears';
    present values kept even if empty; the final character replaced by '.'."""
    cats = {c: a for c, a in attr.items() if c not in K.HUMAN_ATTR_SKIPPED}
    if any(c not in K.HUMAN_ATTR_KEY_ORDER or (c == "hair" and "wears" in a) for c, a in cats.items()):
        return None
    body = "".join("".join(" %s" % (a[key],) for key in K.HUMAN_ATTR_KEY_ORDER[c] if key in a)
                   + K.HUMAN_ATTR_SUFFIX.get(c, "") + "," for c, a in cats.items())
    text = "A %s shot, a %s-years-old %s from %s,%s" % (style, age, gender.lower(), birthplace, body)
    return text[:-1] + "."


def test_attribute_sentence_strict_random(spark):
    rng = random.Random(13)
    cats = list(K.HUMAN_ATTR_KEY_ORDER) + ["face", "overall-style", "gloves"]
    rows = []
    for i in range(300):
        attr = {}
        for cat in rng.sample(cats, rng.randint(0, 5)):
            keys = K.HUMAN_ATTR_KEY_ORDER.get(cat, ["x"]) + (["wears"] if rng.random() < 0.1 else [])
            attr[cat] = {k: rng.choice(["", "red", None]) for k in rng.sample(keys, rng.randint(0, len(keys)))}
        rows.append((i, json.dumps(attr), 40, "Female", "Chile", "headshot"))
    df = spark.createDataFrame(rows, "i int, a string, age int, gender string, bp string, style string")
    got = df.orderBy("i").select(FA.attribute_sentence_strict(F.col("a"), F.col("age"), F.col("gender"),
                                                              F.col("bp"), F.col("style"))).collect()
    for (i, a, age, g, bp, st), r in zip(rows, got):
        assert r[0] == py_attr_strict(json.loads(a), age, g, bp, st), a


def test_topk_many_queries_per_block(spark):
    """More queries in one block than the in-task chunk (256): chunks must agree with brute force."""
    rng = np.random.default_rng(5)
    d = rng.normal(size=(120, 6)).astype(np.float32)
    db = spark.createDataFrame([("s", i, d[i].tolist()) for i in range(120)],
                               "source string, vec_id long, vec array<float>")
    q = rng.normal(size=(700, 6))
    qs = spark.createDataFrame([(i, q[i].tolist()) for i in range(700)], "qid long, qvec array<double>")
    got = sorted((r["qid"], r["rank"], r["vec_id"]) for r in knn.topk_per_source(qs, db, k=3).collect())
    exp = []
    for qi in range(700):
        sc = sorted((-(q[qi] @ d[i].astype(np.float64)), i) for i in range(120))[:3]
        exp += [(qi, rank + 1, i) for rank, (_, i) in enumerate(sc)]
    assert got == sorted(exp)


def test_turn_with_two_images_is_one_utterance(spark):
    """A list-shaped turn: one dialogue entry with both items, one line and one request in the name prompts."""
    rows = [("e", 1, 0, 0, "Ann", "Ann", "hi", "none", 1, "", "p"), ("e", 1, 1, 1, "Bob", "Bob", "see", "list", 5, "cat", "p"),
            ("e", 1, 1, 0, "Bob", "Bob", "see", "list", 5, "dog", "p"), ("e", 1, 2, 0, "Ann", "", "and", "list", 6, "sun", "p"),
            ("e", 1, 2, 1, "Ann", "", "and", "list", 6, "sea", "p"), ("e", 2, 0, 0, None, "Bob", "", "none", 1, "", "q")]
    items = spark.createDataFrame(rows, "unique_id string, session_number long, utterance_id long, item_pos long, speaker string, "
                                  "speaker_raw string, utterance string, sh_shape string, sharing_class int, sh_description string, seed string")
    [ep] = E.assemble_episodes(items, ["seed"]).collect()
    assert ep.seed == "p" and [s.session_number for s in ep.sessions] == [1, 2]
    got = [(u.utterance_id, u.speaker, u.utterance, [i.sh_description for i in u.sharing]) for u in ep.sessions[0].dialogue]
    assert got == [(0, "Ann", "hi", [""]), (1, "Bob", "see", ["dog", "cat"]), (2, "Ann", "and", ["sun", "sea"])]
    [req] = E.speaker_fix_requests(items).collect()
    assert req.utterance_id == 2 and req.item_pos == 0
    assert req.prompt.count("Bob: [Sharing Image]") == 1 and "Ann: hi\nBob: [Sharing Image]\n<SPEAKER>: [Sharing Image]" in req.prompt


def test_sample_n_is_the_prefix_of_the_seeded_order(spark, monkeypatch):
    from curatio.functions.draws import order_key
    from curatio.operators import core
    monkeypatch.setattr(core, "SAMPLE_REST", 3)
    rows = [(i % 900, i % 7) for i in range(1500)]                    # repeated keys, repeated rows
    df = spark.createDataFrame(rows, "id long, v long").repartition(5)
    keys = sorted((r["k"], r["id"], r["v"]) for r in df.select(order_key(1, "s", "id").alias("k"), "id", "v").collect())
    for digits in (1, 4):
        monkeypatch.setattr(core, "SAMPLE_DIGITS", digits)
        for n in (0, 1, 17, 900, 1499, 1500, 2000):
            got = sorted((r["id"], r["v"]) for r in core.sample_n(df, n, order_key(1, "s", "id")).collect())
            assert got == sorted((i, v) for _, i, v in keys[:n]), (digits, n)
    assert core.sample_n(df.filter("false"), 5, order_key(1, "s", "id")).count() == 0
    with pytest.raises(ValueError, match="fewer"):
        core.sample_n(df, 1501, order_key(1, "s", "id"), strict=True)
    assert core.sample_n(df, 1500, order_key(1, "s", "id"), strict=True).count() == 1500


def test_combined_pool_is_male_then_female(spark):
    from hashlib import md5

    from curatio.plans import commonsense as C
    people = spark.createDataFrame([(i, i % 4, ["Male", "Female", "Non-binary"][i % 3]) for i in range(300)], "id long, nation int, gender string")
    rows = [(n, g, f"{n}{g[0]}{i}", i) for n in range(3) for g, k in (("Male", 3 * n), ("Female", 5)) for i in range(k)]      # nation 0: no men; 3: nobody
    pool = spark.createDataFrame(rows, "nation int, gender string, name string, o long")
    got = {r["id"]: r for r in C.pick_names(people, pool, 7, ["id"], ["nation", "gender"], "o", F.lit(0).cast("bigint"), {"Non-binary": ["Male", "Female"]}).collect()}
    assert len(got) == 300
    for i in range(300):
        n, g = i % 4, ["Male", "Female", "Non-binary"][i % 3]
        names = [x[2] for part in (["Male", "Female"] if g == "Non-binary" else [g]) for x in rows if x[0] == n and x[1] == part]
        want = names[int(md5(f"7|name|{i}".encode()).hexdigest()[:8], 16) % len(names)] if names else None
        assert got[i]["name"] == want and got[i]["reject_reason"] == (None if names else "empty_pool") and got[i]["gender"] == g


def test_topk_is_one_pass_whatever_the_batch(spark, monkeypatch):
    """Many query batches add no scan to the plan, and no query reaches the driver."""
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.toArrow", None)
    rng = np.random.default_rng(6)
    d = np.round(rng.normal(size=(90, 4)), 1)
    d[40:] = d[40]                                         # copies: the smaller ids win
    db = spark.createDataFrame([(None if i % 2 else "s", i, d[i].tolist()) for i in range(90)],
                               "source string, vec_id long, vec array<double>")
    qs = spark.createDataFrame([(i, d[i].tolist()) for i in range(60)], "qid long, qvec array<double>")
    top = knn.topk_per_source(qs, db, k=3, batch_bytes=32)          # one query a batch
    assert top._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    exp = []
    for qi in range(60):
        for odd in (0, 1):
            sc = sorted((-sum(x * y for x, y in zip(d[qi], d[i])), i) for i in range(odd, 90, 2))[:3]
            exp += [(qi, odd, rank + 1, i) for rank, (_, i) in enumerate(sc)]
    assert sorted((r["qid"], int(r["source"] is None), r["rank"], r["vec_id"]) for r in top.collect()) == sorted(exp)


def test_topk_cells_stay_bounded():
    """Vectors, queries and winners of a task do not grow with the tables."""
    for n in (1, 2_000, 300_000, 30_000_000):
        blocks, chunks = knn.grid(n, n, 64, 12)
        assert n / chunks * 512 <= knn.CHUNK_BYTES and n / blocks * 512 <= knn.BLOCK_BYTES
    assert knn.grid(50_000, 50_000, 64, 12) == (12, 1) and knn.grid(0, 0, 0, 12) == (1, 1)


def test_topk_chunk_needs_few_copies_of_its_vectors():
    """Also with most vectors in one source: no copy is kept beside Arrow's, and few are made."""
    import tracemalloc

    import pyarrow as pa
    n, dims, k = 40_000, 16, 3
    rng = np.random.default_rng(7)
    flat = rng.normal(size=n * dims)
    flat[:10 * dims] = np.tile(flat[:dims], 10)            # ten copies of one vector: the three smallest ids stay
    held = pa.table({"source": pa.array(["a"] * (n - 5) + [None] * 5), "vec_id": np.arange(n)[::-1].copy(),
                     "vec": pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dims, dims, dtype=np.int32)), pa.array(flat))})
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    chunk = knn._chunk([held.slice(10)], dims, k, [])
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 2.6 * n * dims * 8 and kept + pa.total_allocated_bytes() - arrow < 1.2 * n * dims * 8
    assert [(c[0], len(c[1])) for c in chunk] == [("a", n - 15), (None, 5)]
    copies = knn._chunk([held], dims, k, [])[0]
    assert len(copies[1]) == n - 5 - 10 + k and set(range(n - 10, n - 10 + k)) <= set(copies[2].tolist())
    assert not set(range(n - 10 + k, n)) & set(copies[2].tolist()) and np.array_equal(copies[3]["vec_id"].to_numpy(), copies[2])
    for n in (120_000, 1_200_000):
        assert n / knn.grid(n, n, 64, 12)[1] * 512 <= 32 << 20


def test_few_shot_blocks_sort_bounded_tasks(spark, monkeypatch):
    """Rows are dealt out before the partial limit sorts them; the blocks are those of one whole sort."""
    from curatio.plans import persona
    monkeypatch.setattr(persona, "TASK_ROWS", 100)
    rows = [(f"c{i % 2}", "brand", "Brand" if i % 5 else "model", f"s{i}", f"V{i}", i) for i in range(200)]
    pool = spark.createDataFrame(rows, "category string, key string, attr string, sentence string, value string, row_id long").coalesce(1)
    out = persona.few_shot_blocks(pool, n_prompts=3, k=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan[plan.index("Partial"):] and "WindowGroupLimit" in plan
    got = {(r["category"], r["prompt_idx"]): (r["n_lines"], r["block"]) for r in out.collect()}
    assert len(got) == 6
    for (c, p), (n, block) in got.items():
        own = sorted((hashlib.md5(f"42|fewshot|{c}|brand|{p}|{i}".encode()).hexdigest(), i)
                     for cat, _, attr, _, _, i in rows if cat == c and attr == "Brand")[:4]
        lines = [f"{rank}. s{i} (Brand: V{i})" for rank, (_, i) in enumerate(own, 1)]
        assert n == 4 and "\n".join(lines) in block and "5. " not in block
