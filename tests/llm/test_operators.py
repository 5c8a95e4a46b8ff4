"""Each operator against brute force on small texts, with odd rows and an empty table."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F

from curatio.llm import (attention_lm, chunk_dedup, fingerprints, mixing, quality_classifier, quality_rules, queries,
                         sentencepiece_codec, simhash, suffix_dedup, url_filter)

from .conftest import prose


def _docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_sentencepiece_equals_the_library_and_round_trips(spark, odd_docs, no_docs):
    import sentencepiece
    path = sentencepiece_codec.default_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = odd_docs.unionByName(_docs(spark).limit(60).select("doc_id", "text", F.lit("a").alias("source"), F.lit(1).alias("size"), F.lit("").alias("fp")))
    got = sentencepiece_codec.encode(docs, decoded_col="decoded").select("text", "ids", "decoded").collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.ids is None) if r.text is None else (list(r.ids) == library.encode(r.text) and r.decoded == r.text)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(odd_docs.select("doc_id", "text"))).collect()
    assert all(r.decoded == r.text for r in back)
    assert sentencepiece_codec.encode(no_docs).count() == 0


def test_streaming_search_finds_the_best_unigram_path():
    rng = random.Random(3)
    pieces = {"a": -2.0, "b": -2.1, "ab": -3.0, "ba": -3.5, "aab": -4.1, "bb": -3.9, "abab": -5.0, sentencepiece_codec.MARK: -1.0}
    v = sentencepiece_codec.Vocabulary(b"\x1a\x02\x20\x00")          # no pieces, extra spaces kept
    v.kind, v.score, v.pieces, v.names = sentencepiece_codec.UNIGRAM, pieces, list(pieces), list(pieces)
    v.ids = {p: i for i, p in enumerate(pieces)}
    v.longest, v.floor, v.unknown = 4, -15.0, 99
    v.suffixes = {}
    for p, i in v.ids.items():
        node = v.suffixes
        for c in reversed(p):
            node = node.setdefault(c, {})
        node[0] = i
    for _ in range(200):
        s = "".join(rng.choice("ab") for _ in range(rng.randint(1, 90)))
        best = [0.0] + [None] * len(s)
        for e in range(1, len(s) + 1):
            best[e] = max(best[b] + pieces[s[b:e]] for b in range(max(0, e - 4), e) if s[b:e] in pieces)
        ids = v._stream(s)
        assert "".join(v.names[i] for i in ids) == s
        assert sum(pieces[v.names[i]] for i in ids) == pytest.approx(best[-1])


def test_url_rules_and_templates(spark):
    urls = ["https://www.example.com/en/1", "http://EXAMPLE.com/en/2?x", "https://a.com/x", "https://com/", "http://x.net/fr/3.html#t",
            "http://x.net/en/4", "nonsense", None, "http://x.net?/fr/5", "http://notcom/x"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(rows, queries.URL_RULES).collect()}
    assert [got[i].rule for i in range(10)] == ["www.example.com/en/", "example.com/en/", "com/", "com/", "net/fr/", None, None, None, None, None]
    assert [got[i].verdict for i in range(5)] == ["allow", "block", "allow", "allow", "block"]
    assert (got[6].host, got[6].path, got[7].host, got[8].host, got[8].path) == ("", "", "", "x.net", "")
    # labelled templates: a branch of bad pages is rejected, its unlabelled page with it, another branch is not
    rows = spark.createDataFrame([(f"http://h/{b}/{i}", None if i == 0 else int(b == "bad")) for b in ("bad", "good", "new") for i in range(60)
                                  if b != "new" or i == 0], "url string, bad int")
    got = {r.url: r.verdict for r in url_filter.filter_urls(rows, [], bad_col="bad").collect()}
    assert got["http://h/bad/0"] == "block" and got["http://h/good/0"] == got["http://h/new/0"] == "allow"
    assert url_filter.filter_urls(rows.filter("false"), queries.URL_RULES).count() == 0


def test_url_branches_merge_at_every_depth_and_lend_their_purity(spark):
    rows = [(f"http://{h}/{b}/{c}{i}/x{i}", bad) for h, b, bad in (("h", "en", 1), ("h", "de", 1), ("g", "fr", 0), ("g", "es", 0))
            for c in "pq" for i in range(10)]
    rows += [("http://h/en/new/page", None), ("http://h/it/new", None), ("http://g/it/new", None), ("http://n/it/new", None)]
    rows += [("http://hot/one/page", 1)] * 2000                                   # lifts the share of all labelled pages over 0.9
    got = {r.url: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "url string, bad int"), [], bad_col="bad").collect()}
    assert got["http://h/en/p1/x1"].template.startswith("/~/") and got["http://h/de/q2/x2"].template.startswith("/~/")
    assert got["http://h/en/new/page"].template == "/~/new/page" and got["http://h/it/new"].template == "/it/new"
    prior = 2040 / 2080
    assert prior > url_filter.REJECT and got["http://n/it/new"].purity == pytest.approx(prior)
    assert got["http://h/it/new"].purity == pytest.approx((40 + 4 * prior) / 44) and got["http://g/it/new"].purity == pytest.approx(4 * prior / 44)
    assert [got[f"http://{u}"].verdict for u in ("h/en/new/page", "h/it/new", "g/it/new", "n/it/new")] == ["block", "block", "allow", "allow"]


def test_fingerprints(spark, odd_docs, no_docs):
    fps = {}
    docs = fingerprints.imatch(_docs(spark).select("doc_id", "text")).collect()
    for r in docs:
        assert len(r.fingerprint) == 64 and fps.setdefault(r.text, r.fingerprint) == r.fingerprint
    got = queries.op3(spark, SF).collect()
    rows = sorted(_docs(spark).select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for r, nxt in zip(rows, rows[1:] + rows[:1]):
        half = len(r.text) // 2
        edited = r.text[:len(r.text) - half] + nxt.text[:half]
        assert by[r.doc_id].n_chars == len(r.text)
        assert by[r.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert np.mean([r.near_edited for r in got]) > 5 * np.mean([r.near_next for r in got])
    odd = fingerprints.imatch(odd_docs, out_col="fp").collect()
    assert len(odd) == 12 and len({tuple(r.fp) for r in odd if r.text == prose(2, 120)}) == 1
    assert fingerprints.with_next(odd_docs.select("doc_id", "text"), "doc_id", ["text"], 4).count() == 12
    assert fingerprints.imatch(no_docs).count() == 0


def test_chunk_dedup(spark, odd_docs, no_docs):
    got = chunk_dedup.deduplicate(odd_docs).collect()
    assert len(got) == 12
    by = Counter((r.doc_id, r.text) for r in got)
    assert by[(1, prose(2, 120))] == 2 and by[(2, "")] == 1 and by[(3, None)] == 1            # a copy goes, a repeated row stays
    nine = next(r for r in got if r.doc_id == 9)
    assert nine.n_removed >= 500 and nine.text.startswith(prose(4, 30)[:100]) and nine.text.endswith(prose(5, 30)[-100:])
    data = np.frombuffer(prose(7, 3000).encode(), dtype=np.uint8)
    slow = [sum(int(chunk_dedup.GEAR[data[e - k]]) << k for k in range(chunk_dedup.WINDOW) if e >= k) & 0xFFFFFFFF for e in range(len(data))]
    assert (chunk_dedup.gear_hash(data) & np.uint64(0xFFFFFFFF)).tolist()[16:] == slow[16:]
    assert chunk_dedup.deduplicate(no_docs).count() == 0


def test_quality_classifier(spark, odd_docs, no_docs):
    got = queries.op5(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9 and all(0 <= r.score <= 1 for r in got)
    labels = spark.createDataFrame([(1, 1), (12, 0), (99, 0), (7, None)], "doc_id long, quality int")
    assert quality_classifier.classify(odd_docs, labels).count() == 12
    assert {r.predicted for r in quality_classifier.classify(odd_docs, labels.filter("false")).collect()} == {1}
    assert quality_classifier.classify(no_docs, labels).count() == 0


def test_quality_threshold_covers_all_labelled_rows(spark):
    docs = _docs(spark).select("doc_id", "text")
    vecs = quality_classifier.vectors(docs, "doc_id", "text")
    labels = docs.select("doc_id", (F.xxhash64("doc_id") % 10 > -3).cast("int").alias("quality"))
    w, threshold = quality_classifier.train(vecs, labels, "doc_id", "quality", max_train=40)
    rows = vecs.join(labels.withColumnRenamed("doc_id", "key"), "key").collect()
    rank, at = np.sort([np.dot(r.x, w) for r in rows]), sum(r.quality == 0 for r in rows)
    assert len(rows) > 80 and 0 < at < len(rows) and np.any(w)
    assert threshold == pytest.approx((rank[at - 1] + rank[at]) / 2, abs=1e-9)
    values = [0.0] * 30 + [1e-9, 2e-9] + [5.0] * 40 + [7.0]
    for bad in (0, 1, 29, 30, 31, 32, 33, 72, 73):
        ranked = spark.createDataFrame([(v, int(i >= bad)) for i, v in enumerate(values)], "rank double, y int")
        k = min(len(values) - 1, max(1, bad))
        assert quality_classifier.cut_point(ranked, 4) == (values[k - 1] + values[k]) / 2


def _removed(rows):
    """Brute force over 100-byte strings: {key: (n_removed, spans, digest)}."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        b, mark = (text or "").encode(), bytearray(len((text or "").encode()))
        for s in range(len(b) - 99):
            if b[s:s + 100] in seen:
                mark[s:s + 100] = b"\1" * 100
            seen.add(b[s:s + 100])
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out[key] = (sum(mark), bytes(mark).count(b"\0\1") + (mark[:1] == b"\1"), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("limit", [2, 20_000])
def test_suffix_repeats_equal_brute_force(spark, odd_docs, no_docs, limit):
    extra = [(100 + i, prose(50 + i % 3, 20) + prose(9, 25) + prose(60 + i, 10)) for i in range(12)]
    rows = [(r.doc_id, r.text) for r in odd_docs.dropDuplicates(["doc_id"]).collect()] + extra
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest())
           for r in suffix_dedup.remove_repeats(docs, group_limit=limit).collect()}
    assert got == _removed(rows)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    assert suffix_dedup.remove_repeats(odd_docs).count() == 12


def test_repeat_groups_list_all_members(spark):
    text = prose(11, 30)
    docs = spark.createDataFrame([(i, prose(70 + i, 15) + text + prose(80 + i, 15)) for i in range(5)], "doc_id long, text string")
    groups = suffix_dedup.repeat_groups(docs).groupBy("group").agg(F.count("*").alias("n")).collect()
    assert groups and max(g.n for g in groups) == 5


@pytest.mark.parametrize("limit", [3, 30_000])
def test_simhash_components_equal_brute_force(spark, no_docs, limit):
    rng = random.Random(5)
    base = [prose(200 + i, 60).split() for i in range(6)]
    rows = []
    for i in range(90):
        w = list(base[i % 6])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = prose(rng.randrange(10 ** 6), 1)
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "x"), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs, list_limit=limit).collect()}

    def fp(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    prints = [(i, fp(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(prints):
        least[find(n)] = min(i, least.get(find(n), i))
    for n, (i, f) in enumerate(prints):
        assert got[(i, f - (1 << 64) if f >> 63 else f)] == least[find(n)]
    assert simhash.near_duplicates(no_docs).count() == 0


def test_attention_model(spark, odd_docs, no_docs):
    m = attention_lm.Model(np.ones(300), lambda slot: np.ones((attention_lm.SLOTS + 1,) * 2), 2)
    rng = np.random.default_rng(1)
    m.embed = rng.standard_normal(m.embed.shape) * 0.5
    for k in m.w:
        m.w[k] = (m.w[k] + rng.standard_normal(m.w[k].shape) * 0.3).astype(np.float64)
    x, y = rng.integers(0, 200, (3, attention_lm.LENGTH)), rng.integers(0, 200, (3, attention_lm.LENGTH))
    valid = np.ones(x.shape, dtype=bool)

    def loss():
        z, _ = m.forward(m.tables(), x, valid)
        z = z - z.max(axis=2, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=2, keepdims=True))
        return -np.take_along_axis(z, m.of[y][:, :, None], axis=2).mean()
    g = m.gradients(x, y, valid)
    for k, at in (("Q", (1, 2)), ("K", (3, 0)), ("V", (5, 1)), ("S", (2, 2)), ("O", (1, 7)), ("B", (4,)), ("D", (1,))):
        keep, e = m.w[k][at], 1e-3
        m.w[k][at] = keep + e
        up = loss()
        m.w[k][at] = keep - e
        assert (up - loss()) / (2 * e) == pytest.approx(g[k][at], abs=2e-4)
        m.w[k][at] = keep
    # a text's score is the same alone and in a batch, and every token counts once
    ids = rng.integers(3, 300, 100).astype(np.int32)
    both = m.score(np.concatenate([ids, ids[:7]]), np.array([0, 100]))
    assert both == pytest.approx([m.score(ids, np.array([0]))[0], m.score(ids[:7], np.array([0]))[0]])
    got = attention_lm.score(odd_docs, held_out=F.col("doc_id") == 8).collect()
    assert len(got) == 12 and all(r.score < 0 and r.base_score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (3, 5, 6)} == {1} and all(r.n_known <= r.n_tokens for r in got)
    assert attention_lm.score(no_docs).count() == 0


def test_attention_steps_and_scores_reuse_their_arrays():
    """Also where class logits are far beyond what exp can take."""
    import tracemalloc
    m = attention_lm.Model(np.arange(1, 301.0), lambda slot: np.ones((attention_lm.SLOTS + 1,) * 2), 2)
    rng = np.random.default_rng(1)
    ids = rng.integers(3, 300, 20).astype(np.int32)
    before, slot = np.append(m.end, ids[:-1]), m.slot[ids]
    x, y = rng.integers(0, 300, (2, attention_lm.BATCH, attention_lm.LENGTH))
    valid = np.arange(attention_lm.LENGTH) < rng.integers(1, attention_lm.LENGTH + 1, (attention_lm.BATCH, 1))
    weight = rng.integers(1, 5, attention_lm.BATCH)
    for size in (0.2, 300):
        m.w["O"], m.w["B"] = [(rng.standard_normal(m.w[k].shape) * size).astype(np.float32) for k in "OB"]

        def chances(x, valid):
            z = m.forward(m.tables(), x, valid)[0].astype(float)
            z = np.exp(z - z.max(axis=2, keepdims=True))
            return z / z.sum(axis=2, keepdims=True)
        p, share = chances(x, valid), valid * weight[:, None]
        want = (share[:, :, None] * (p - (np.arange(attention_lm.CLASSES) == m.of[y][:, :, None]))).sum(axis=(0, 1)) / share.sum()
        m.gradients(x, y, valid, weight)
        tracemalloc.start()
        g = m.gradients(x, y, valid, weight)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert g["B"] == pytest.approx(want, abs=1e-4) and all(np.isfinite(v).all() for v in g.values())
        if size < 1:
            assert peak < x.size * attention_lm.CLASSES                    # bytes: a quarter of the logits; a step makes no array of their size
            p = chances(m.slot[before][None, :], np.ones((1, 20), dtype=bool))[0]
            prev = m.slot[before]
            want = (np.log(p[np.arange(20), m.of[slot]]) + m.follow(prev, slot) - m.prior[prev, m.of[slot]] + m.share[ids]).sum() / np.log(10)
            assert m.score(ids, np.array([0]))[0] == pytest.approx(want, rel=1e-5)
        else:
            assert np.isfinite(m.score(ids, np.array([0]))).all()


def test_attention_windows_hold_every_training_subword_once():
    rng, end = np.random.default_rng(3), 2
    texts = [rng.integers(3, 300, n) for n in (0, 1, 31, 32, 500, 64, 7)]
    ids = np.concatenate([np.append(t, end) for t in texts]).astype(np.int32)
    size = np.array([len(t) + 1 for t in texts])
    learn = np.array([True, True, True, True, True, False, True])
    windows = attention_lm._windows(ids, np.cumsum(size) - size, learn, end, 300)
    slots = attention_lm._slots(windows.slice(0), np.arange(300))
    targets = [int(x) for row in slots for x in row[1:] if x >= 0]
    assert targets == [int(x) for t, ok in zip(texts, learn) if ok for x in [*t, end]]
    before = [int(a) for row in slots for a, b in zip(row, row[1:]) if b >= 0]
    assert before == [int(x) for t, ok in zip(texts, learn) if ok for x in [end, *t]]
    parts = list(attention_lm._parts(iter([slots[:5], slots[5:6], slots[6:]])))
    assert np.array_equal(np.concatenate(parts), slots)


def test_attention_model_tells_all_subwords_apart(monkeypatch):
    rng, size = np.random.default_rng(4), 3000
    counts = rng.integers(1, 50, size).astype(float)
    n = np.zeros((size + 1, size + 1))
    n[rng.integers(0, size, 20000), rng.integers(0, size, 20000)] = rng.integers(1, 9, 20000)

    def pairs(slot):
        x, y = np.nonzero(n)
        return x, y, n[x, y]
    m = attention_lm.Model(counts, pairs, 2)
    assert len(set(m.slot.tolist())) == size and (m.slot < m.slots).all() and not m.share.any()
    x, y = np.divmod(rng.integers(0, size * size, 5000), size)
    mass = np.bincount(m.slot, weights=counts + 0.5, minlength=m.slots + 1)
    want = np.log((n[x, y] + attention_lm.PULL * mass[y] / mass.sum()) / (n.sum(axis=1)[x] + attention_lm.PULL))
    assert m.follow(x, y) == pytest.approx(want, abs=1e-4)
    # the table of small vocabularies gives the same; class probabilities are the sums of their subwords'
    monkeypatch.setattr(attention_lm, "SLOTS", size)
    t = attention_lm.Model(counts, pairs, 2)
    assert t.table is not None and m.table is None and t.follow(x, y) == pytest.approx(m.follow(x, y))
    row = np.exp(m.follow(np.full(size, 7), np.arange(size)).astype(float))
    assert np.bincount(m.of[:size], weights=row, minlength=attention_lm.CLASSES) == pytest.approx(np.exp(m.prior[7].astype(float)), abs=1e-5)


def test_attention_training_spreads_equal_windows(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    windows, weights, part = attention_lm._weighted(pa.array([b"aa", b"bb", *[b"aa"] * 99], pa.binary()))
    total = Counter()
    for w, n in zip(windows.to_pylist(), weights.tolist()):
        total[w] += n
    assert total == {b"aa": 100, b"bb": 1} and max(weights) <= attention_lm.SPREAD
    assert len(set(zip(windows.to_pylist(), part.tolist()))) == len(windows) == 8
    # a weight counts like that many copies
    m = attention_lm.Model(np.ones(300), lambda slot: np.ones((attention_lm.SLOTS + 1,) * 2), 2)
    x = np.random.default_rng(1).integers(0, 200, (2, attention_lm.LENGTH + 1))
    ones = m.gradients(x[[0, 0, 0, 1], :-1], x[[0, 0, 0, 1], 1:], np.ones((4, attention_lm.LENGTH), dtype=bool))
    once = m.gradients(x[:, :-1], x[:, 1:], np.ones((2, attention_lm.LENGTH), dtype=bool), np.array([3, 1]))
    assert all(once[k] == pytest.approx(ones[k], abs=1e-5) for k in ones)
    # copies of one text do not meet in one task
    kept = {}
    store = attention_lm.stored
    monkeypatch.setattr(attention_lm, "stored", lambda df, name: kept.setdefault(name, store(df, name)) if name == "windows" else store(df, name))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the same five words again").alias("text"))
    assert attention_lm.score(docs.repartition(2)).count() == 4000
    rows = kept["windows"].select(F.input_file_name().alias("f"), "n").groupBy("f").agg(F.sum("n").alias("n")).collect()
    assert sum(r.n for r in rows) == 4000 and max(r.n for r in rows) < 2400 and len(rows) > 2


def test_attention_base_columns_equal_brute_force(spark, odd_docs):
    """Also where two slices hold equal rows."""
    import math
    import re
    import zlib
    docs = _docs(spark).limit(40).select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text")).coalesce(1)
    for table in (docs, docs.union(docs)):
        rows = [tuple(r) for r in table.collect()]
        held = {key: zlib.crc32(str("" if key is None else key).encode()) % 7 == 2 for key, _ in rows}
        lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
        tokens = [(key, text, [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower)), None]) for key, text in rows]
        c = Counter(t for key, _, ts in tokens if not held[key] for t in ts)
        n, v = sum(c.values()), len(c)
        want = Counter((key, held[key], len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 6))
                       for key, _, ts in tokens)
        got = attention_lm.score(table, held_out=queries.remainder("doc_id", 7) == 2).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def test_mixing(spark, odd_docs, no_docs):
    rows = mixing.copies(odd_docs).collect()
    sizes = Counter()
    for r in rows:
        assert r.size == len((r.text or "").encode().split()) and r.copies <= 2
        sizes[r.source] += r.size
    assert all(r.source_size == sizes[r.source] and r.target <= 2 * r.source_size for r in rows)
    targets = {r.source: r.target for r in rows}
    total = sum(sizes.values())
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taken, goal = Counter(), {}
    for r in mixing.copies(docs).collect():
        taken[r.source] += r.size * r.copies
        goal[r.source] = r.target
    assert sum(taken.values()) == pytest.approx(sum(goal.values()), rel=0.1)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.copies(no_docs).count() == mixing.mix(no_docs).count() == 0


def test_quality_rules_equal_brute_force(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text").union(_docs(spark).select("doc_id", "text"))
    for r in quality_rules.quality_rules(docs).collect():
        t = r.text or ""
        w = t.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
        w = [x for x in w if x]
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (
            len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(t.count(c) for c in "#*$%&|<>")
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(no_docs).count() == 0


def test_pipeline_stages(spark, odd_docs, no_docs):
    import corpus_pipeline
    docs = odd_docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.lit(0).cast("long").alias("n_chars"))
    for rows in (docs, docs.filter("false")):
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, SF)
            assert out.columns == docs.columns or n == 4
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert [r.doc_id for r in kept].count(1) == 1 and 2 not in [r.doc_id for r in kept]
