"""Spelling variants, nearest neighbours and ranked search against brute force, with odd rows and empty tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from curatio.llm import ball_tree, kmeans_tree, queries, spelling_variants


def _near(u: str, words) -> set:
    """Words of ``words`` one edit away from u, by trying every edit."""
    letters = {c for w in words for c in w}
    made = {u[:i] + u[i + 1:] for i in range(len(u))}
    made |= {u[:i] + c + u[i:] for i in range(len(u) + 1) for c in letters}
    made |= {u[:i] + c + u[i + 1:] for i in range(len(u)) for c in letters}
    return (made - {u}) & set(words)


def _variants(rows, drop_every=97):
    """The contract's rows by brute force."""
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if drop_every and h % drop_every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    form, out = {}, {}
    for w in n:
        near = _near(w, n)
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = (best if best and n[best] >= 2 * n[w] else None, len(near))
    for w in n:
        root = w
        while form[root][0]:
            root = form[root][0]
        f = form[w][0]
        out[w] = (f, root, n[w], form[w][1], n[f] if f else None)
    return out


def _got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def _texts(seed: int):
    r = random.Random(seed)
    words = ["".join(r.choice("abÉé") for _ in range(r.randint(4, 9))) for _ in range(120)] + ["aaaaa", "aaaaaa", "aaaaaaa", "Baaaaa"]
    often = [1 / (1 + i % 9) ** 2 for i in range(len(words))]
    return [(i, " ".join(r.choices(words, often, k=r.randint(0, 80))) + "-") for i in range(90)] + \
        [(90, "stoney " * 3 + "stones " * 7 + "stonen " * 2 + "stonem " * 1 + "tones " * 15)]


def test_spelling_variants_equal_brute_force(spark):
    rows = [*_texts(1), (None, "Wörter wörter wörter " * 3), (5, None), (6, ""), (7, "  \n"), (5, "abaab " * 4), (5, "abaab " * 4), (9, "x" * 3000 + " " + ("y" * 2999 + " ") * 3)]
    docs = spark.createDataFrame([(*x, 1, "x") for x in rows], "doc_id long, text string, n int, word string")
    want = _variants(rows)
    assert _got(spelling_variants.group_variants(docs, drop_every=97)) == want
    assert any(v[0] for v in want.values()) and any(v[0] and v[1] != v[0] for v in want.values())
    # keys far over a shard are cut into blocks of words
    assert _got(spelling_variants.group_variants(docs, drop_every=97, shard_chars=40)) == want
    assert spelling_variants.group_variants(docs.filter("false")).count() == 0


def test_spelling_variants_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert _got(queries.QUERIES["op11_spelling_variants"](spark, SF)) == _variants(rows)


def test_runs_are_never_cut(monkeypatch):
    monkeypatch.setattr(spelling_variants, "PIECE", 3)
    text = "ab cdefgh--i jkl  mnopqr"
    assert [w for part in spelling_variants._runs(text) for w in part] == re.findall("[a-z]+", text)


def test_near_words_in_one_index():
    r = random.Random(4)
    words = sorted({"".join(r.choice("abcé") for _ in range(r.randint(2, 7))) for _ in range(600)})
    index = spelling_variants.Index(words)
    asked = [*words, "zzzz", "abz", "az" * 3]
    got = Counter()
    for side in (1, 0):
        q, v = spelling_variants.near_words(index, asked, side)
        got.update(zip([asked[i] for i in q], [words[i] for i in v], strict=True))
    assert set(got.values()) == {1}
    assert set(got) == {(u, v) for u in asked for v in _near(u, words)}


def _vectors(spark, seed=0, n=1500, dims=16):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dims))
    x = (centres[r.integers(0, 12, n)] + 0.3 * r.normal(size=(n, dims))).astype(np.float32)
    x[1::7] *= 3
    x[n // 2:n // 2 + n // 3] = x[n // 2]     # a third of all rows are copies of one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None), (2020, []), (2040, [0.0] * dims), (2060, [nan] + [1.0] * (dims - 1)), (2080, [inf] + [1.0] * (dims - 1)),
             (2100, [None] + [1.0] * (dims - 1)), (None, x[0].tolist()), (2120, [1.0, 2.0]), (0, x[0].tolist()), (3, x[3].tolist())]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, id int, score double")
    return df, x.astype(float)


def _true(x, ids, q, k):
    s = x @ x[q]
    return [(ids[i], s[i]) for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]


def test_nearest_neighbours_recall_and_odd_vectors(spark):
    df, x = _vectors(spark)
    ids = np.arange(len(x))
    got = defaultdict(list)
    for r in kmeans_tree.nearest(df, F.col("vec_id") % 20 == 0, k=20, region_rows=100, region_queries=10, sample=800).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got) == [i for i in range(len(x)) if i % 20 == 0]
    hits = 0
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21)) and len({v for _, v, _ in own}) == 20
        assert [(-s, v) for _, v, s in own] == sorted((-s, v) for _, v, s in own)
        assert all(abs(s - x[v] @ x[q]) < 1e-9 and v != q for _, v, s in own)
        least = _true(x, ids, q, 20)[-1][1]
        hits += sum(s >= least - 1e-9 for _, _, s in own)
    assert hits / (20 * len(got)) >= 0.9
    # a query among the copies finds the smallest other keys of its copies first
    equal = x[760] @ x[760]
    assert [v for _, v, s in got[760] if abs(s - equal) < 1e-9][:5] == [v for v, s in _true(x, ids, 760, 20) if abs(s - equal) < 1e-9][:5]


def test_all_leaves_visited_equal_brute_force(spark):
    df, x = _vectors(spark, 3, 400)
    ids = np.arange(len(x))
    got = kmeans_tree.nearest(df, F.col("vec_id") % 20 == 0, k=7, target=1.0, calibration=10_000, region_rows=64).collect()
    want = {(q, i + 1): v for q in range(0, len(x), 20) for i, (v, _) in enumerate(_true(x, ids, q, 7))}
    scores = {(q, i + 1): s for q in range(0, len(x), 20) for i, (_, s) in enumerate(_true(x, ids, q, 7))}
    assert len(got) == len(want)
    for r in got:
        assert abs(scores[(r.query_id, r.rank)] - r.score) < 1e-9


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in kmeans_tree.nearest(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 0.5)]
    assert kmeans_tree.nearest(df.filter("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0
    assert kmeans_tree.nearest(df.filter("vec_id = 2"), F.col("vec_id") % 20 == 0).count() == 0
    assert kmeans_tree.nearest(df.filter("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_query_recall_on_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = defaultdict(set)
    for r in queries.QUERIES["op12_kmeans_tree"](spark, SF).collect():
        got[r.query_id].add(r.vec_id)
    want = {ids[q]: {v for v, _ in _true(x, ids, q, 20)} for q in range(len(ids)) if ids[q] % 20 == 0}
    assert sorted(got) == sorted(want)
    assert sum(len(got[q] & want[q]) for q in want) / sum(map(len, want.values())) >= 0.9


def _ranked(docs, items, k=10):
    """The contract's rows by brute force."""
    def terms(t):
        return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m)
                for m in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    bags = [(key, terms(t)) for key, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in set(items):
        scored = []
        for key, b in bags:
            if b:
                m, tf = 100 - 75 + (75 * len(b) * n) // total, Counter(b)
                s = sum(int(np.floor(1000 * np.log((2 * n + 2) / (2 * df[t] + 1)))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
                if s > 0:
                    scored.append((-s, key is None, key or 0, key))
        out += [(item, i + 1, key, -s) for i, (s, _, _, key) in enumerate(sorted(scored)[:k])]
    return Counter(out)


def _search_rows(seed=5):
    r = random.Random(seed)
    words = ["".join(r.choice("abcÉñ7") for _ in range(r.randint(1, 3))) for _ in range(60)]
    docs = [(i, " ".join(r.choice(words[:10 + i % 50]) for _ in range(r.randint(1, 40)))) for i in range(400)]
    docs += [(i, docs[7][1]) for i in range(400, 600)]                         # a third are copies
    docs += [(None, docs[3][1]), (601, None), (602, ""), (603, "-- \n"), (7, docs[7][1]), (604, " ".join(words) * 300)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 9)))) for i in range(25)]
    return docs, [*items, (50, docs[7][1]), (51, None), (52, ""), (53, "unknownterm"), (54, docs[3][1]), (0, items[0][1])]


def test_ranked_search_equals_brute_force(spark, monkeypatch):
    docs, items = _search_rows()
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, query string").repartition(3)
    asked = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, rank int")
    want = _ranked(docs, items)
    assert Counter(tuple(r) for r in ball_tree.search(table, asked).collect()) == want
    # several blocks of queries, small slices
    assert Counter(tuple(r) for r in ball_tree.search(table, asked, block_terms=12).collect()) == want
    assert ball_tree.search(table.filter("false"), asked).count() == 0
    assert ball_tree.search(table, asked.filter("false")).count() == 0
    assert ball_tree.search(table.filter("text is null"), asked).count() == 0


def test_bounds_prune_and_lose_nothing():
    r = np.random.default_rng(2)
    rows = []
    for group in range(40):                     # documents in clusters over their own terms
        for _ in range(30):
            ids = np.sort(r.choice(12, 11, replace=False)) + 12 * group
            rows.append((ids.astype(np.int64), r.integers(800_000, 1_000_000, 11)))
    starts = np.arange(0, 11 * len(rows) + 1, 11)
    ids, values = np.concatenate([x for x, _ in rows]), np.concatenate([v for _, v in rows])
    tree = ball_tree.BallTree(starts, ids, values.astype(float), 480)
    scored = []
    for group in range(0, 40, 7):
        q = np.zeros(480, np.int64)
        q[12 * group:12 * group + 12] = r.integers(1, 5, 12)
        exact = np.array([int((q[x] * v).sum()) for x, v in rows])
        bounds = tree.bounds(np.arange(480), q)
        for node, own in enumerate(tree.rows):
            if own is not None:
                assert (exact[own] <= bounds[node]).all()
        best = ball_tree.Best(10)
        scored.append(tree.search(bounds, lambda leaf: best.add(tree.rows[leaf], exact[tree.rows[leaf]]), best.least))
        assert sorted(best.scores.tolist()) == sorted(exact)[-10:]
    assert max(scored) < len(rows) / 2
