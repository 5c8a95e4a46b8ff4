"""Whole results of the URL filter, the fingerprints, the chunk deduplication and the pipeline against plain
restatements of their rules."""

import math
import re
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F

from curatio.llm import chunk_dedup, fingerprints, queries, quality_classifier, sentencepiece_codec, suffix_dedup, url_filter

from .conftest import prose


# ---- chunk deduplication ----------------------------------------------------------------------

def _cut(data: bytes) -> list[bytes]:
    gear, out, at = [int(x) for x in chunk_dedup.GEAR], [], 0
    while len(data) - at > 16:
        end = None
        for e in range(at + 16, min(at + 256, len(data) - 1) + 1):
            h = sum(gear[data[e - 1 - k]] << k for k in range(16) if e - 1 - k >= 0) & 0xFFFFFFFF
            if h < (1 << 32) // 20 and e < len(data) and data[e] & 0xC0 != 0x80:
                end = e
                break
        if end is None:
            if len(data) <= at + 256:
                break
            end = at + 256
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end -= 1
        out.append(data[at:end])
        at = end
    return out + ([data[at:]] if at < len(data) else [])


def deduplicated(rows):
    """{(key, text): (n_bytes, n_removed, n_spans, kept text)} of (key, text) rows."""
    docs = {(key, text) for key, text in rows}
    chunks = {d: _cut((d[1] or "").encode()) for d in docs}
    place = lambda d, n: (d[0] is not None, d[0] or 0, zlib.crc32((d[1] or "").encode()), n)
    first = {}
    for d, own in chunks.items():
        for n, c in enumerate(own):
            first[c] = min(first.get(c, (True, 1 << 62)), place(d, n))
    out = {}
    for d, own in chunks.items():
        again = [first[c] != place(d, n) for n, c in enumerate(own)]
        kept, gone, spans, n = [], 0, 0, 0
        while n < len(own):
            run = n
            while run < len(own) and again[run]:
                run += 1
            size = sum(map(len, own[n:run]))
            if size >= 96:
                gone, spans = gone + size, spans + 1
            else:
                kept += own[n:run]
            if run < len(own):
                kept.append(own[run])
            n = run + 1
        out[d] = sum(map(len, own)), gone, spans, None if d[1] is None else b"".join(kept).decode()
    return out


def test_chunk_dedup_equals_brute_force(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text").unionByName(
        spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    docs = docs.withColumn("n_spans", F.lit("x")).repartition(3).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = deduplicated(rows)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.text) for r in chunk_dedup.deduplicate(docs).collect())
    assert got == Counter((d[0], *want[d]) for d in rows)
    assert sum(w[1] > 0 for w in want.values()) > 5 and sum(w[1] == 0 for w in want.values()) > 20


# ---- I-Match ----------------------------------------------------------------------------------

def _signed(x: int, bits: int = 64) -> int:
    return x - (1 << bits) if x >> (bits - 1) else x


def _hash(*values) -> int:
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else (v[0] & (1 << 32) - 1).to_bytes(4, "little") if isinstance(v, tuple) \
            else (v & (1 << 64) - 1).to_bytes(8, "little")
        h = xxhash.xxh64_intdigest(data, seed=h)
    return _signed(h)


def _ids(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {_hash(x) for x in w}


def _fingerprint(ids, lexicon):
    terms, out = sorted(ids & lexicon or ids), []
    for r in range(8):
        cells = defaultdict(list)
        for x in terms:
            cells[(_hash(x, (r,)) & (1 << 64) - 1) >> 8 & (8 << r) - 1].append(x)
        out += [(_hash(*cells[k]) >> 32 or 1) if cells.get(k) else 0 for k in range(8)]
    return out


def _likeness(a, b):
    if a == b:
        return 1.0
    filled, same = [x != 0 or y != 0 for x, y in zip(a, b)], [x == y != 0 for x, y in zip(a, b)]
    levels = [sum(same[i:i + 8]) / sum(filled[i:i + 8]) for i in range(0, 64, 8) if sum(filled[i:i + 8]) >= 4]
    return max(levels) if levels else sum(same) / sum(filled) if any(filled) else 0.0


def test_fingerprints_equal_brute_force(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {k: _ids(t) for k, t in rows.items()}
    df = Counter(x for own in ids.values() for x in own)
    lexicon = {x for x, n in df.items() if max(2.0, fingerprints.LOW * len(rows)) <= n <= fingerprints.HIGH * len(rows)}
    fps = {k: _fingerprint(own, lexicon) for k, own in ids.items()}
    order = sorted(rows, reverse=True)
    got = {r.doc_id: r for r in queries.QUERIES["op3_imatch"](spark, SF).collect()}
    text = lambda fp: "".join(f"{x & 0xFFFFFFFF:08x}" for x in fp)
    for k, after in zip(order, order[1:] + order[:1]):
        half = len(rows[k]) // 2
        edited = _fingerprint(_ids(rows[k][:len(rows[k]) - half] + rows[after][:half]), lexicon)
        assert got[k].fingerprint == text(fps[k]) and got[k].edited_fingerprint == text(edited)
        assert got[k].near_next == pytest.approx(_likeness(fps[k], fps[after])) and got[k].near_edited == pytest.approx(_likeness(fps[k], edited))


def test_fingerprints_of_a_large_lexicon(spark):
    """A lexicon beyond the hash table is joined: same fingerprints."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame([(None, None), (-1, ""), (-2, "xyzzy plugh")], docs.schema))
    terms = fingerprints.lexicon(docs)
    fps = [sorted((r.doc_id is None, r.doc_id or 0, tuple(r.fp)) for r in fingerprints.imatch(docs, out_col="fp", terms=terms, table_terms=n).collect())
           for n in (0, fingerprints.TABLE_TERMS)]
    assert fps[0] == fps[1] and len(fps[0]) == docs.count()


def test_next_rows_of_hot_and_null_keys(spark):
    """A third of the rows without key, a third under one key, a caller's column named like an added one."""
    rows = [(None if i % 3 == 0 else 500 if i % 3 == 1 else i, f"t{i}", "mine") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, next_text string")
    got = fingerprints.with_next(docs, "doc_id", ["text"], 50)
    assert got.columns == ["doc_id", "text", "next_text"]
    got = got.collect()
    after = {r.text: r.next_text for r in got}
    key = {t: -(1 << 63) if k is None else k for k, t, _ in rows}
    line = [max(key, key=lambda t: (key[t], -((_hash(t) & (1 << 64) - 1) >> 1)))]
    while after[line[-1]] != line[0]:
        line.append(after[line[-1]])
    assert line == sorted(key, key=lambda t: (-key[t], (_hash(t) & (1 << 64) - 1) >> 1)) and len(got) == len(line) == 900


# ---- URL filter -------------------------------------------------------------------------------

def _host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def _judged(pages, rules):
    """Rows (host, path, rule, verdict, template, purity) of urls, by the rules of the module text."""
    cut = [_host_path(u) for u in pages]
    ruled = []
    for host, path in cut:
        fits = [(len(r), r, v) for v, r in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        ruled.append(max(fits)[1:] if fits else (None, None))
    n, labels = Counter(cut), defaultdict(list)
    for place, (_r, v) in zip(cut, ruled):
        if v:
            labels[place].append(v == "block")
    branch, segs = {}, {}
    for host, path in n:
        parts = path.removeprefix("/").split("/")
        parts = parts if len(parts) <= 6 else [*parts[:5], "/".join(parts[5:])]
        segs[host, path] = [re.sub(r"^[0-9]+", "*", s) if re.fullmatch(r"[0-9]+(\.[A-Za-z]+)?", s) else s for s in parts]
        branch[host, path] = ""
    for depth in range(6):
        kids = defaultdict(Counter)
        for place, own in segs.items():
            if depth < len(own):
                kids[place[0], branch[place]][own[depth]] += n[place]
        wide = {k for k, c in kids.items() if len(c) > 32 and sum(c.values()) < 2 * len(c)}
        branch = {place: branch[place] + ("/" + ("*" if (place[0], branch[place]) in wide else own[depth]) if depth < len(own) else "")
                  for place, own in segs.items()}
    cells = lambda b: b.split("/", 6)
    stat = defaultdict(lambda: [0, 0])
    for place, bad in labels.items():
        parts = cells(branch[place])
        for d in range(1, len(parts)):
            s = stat[place[0], d, tuple(parts[:d + 1])]
            s[0], s[1] = s[0] + len(bad), s[1] + sum(bad)
    parents = defaultdict(list)
    for (host, d, prefix), s in stat.items():
        parents[host, d, prefix[:-1]].append((prefix, s))
    alike = set()
    for (host, d, _p), own in parents.items():
        total, bad = sum(s[0] for _, s in own), sum(s[1] for _, s in own)
        for prefix, s in own:
            share = bad / total
            if len(own) > 1 and abs(s[1] / s[0] - share) <= 1.96 * math.sqrt(max(share * (1 - share), 0) / s[0]):
                alike.add((host, d, prefix))
    template = {place: "/".join("~" if (place[0], d, tuple(cells(b)[:d + 1])) in alike else c for d, c in enumerate(cells(b))) for place, b in branch.items()}
    every = [x for own in labels.values() for x in own]
    prior = sum(every) / len(every) if every else 0.0
    pool = defaultdict(list)
    for place, bad in labels.items():
        parts = cells(template[place])
        for d in range(len(parts)):
            pool[place[0], tuple(parts[:d + 1])] += bad
    out = []
    for place, (rule, verdict) in zip(cut, ruled):
        parts, purity, known = cells(template[place]), prior, False
        for d in range(len(parts)):
            bad = pool.get((place[0], tuple(parts[:d + 1])))
            if bad:
                purity, known = (sum(bad) + 4 * prior) / (len(bad) + 4), True
        out.append((*place, rule, verdict or ("block" if known and purity >= 0.9 else "allow"), template[place], round(purity, 9)))
    return out


def test_url_filter_equals_brute_force(spark):
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").select("page_id", "url").collect()]
    rng = np.random.default_rng(6)
    for i in range(1500):                                     # deep, wide, numbered, repeated and labelled paths
        host = rng.choice(["www.example.com", "example.com", "a.net", "x.org", "Big.NET"])
        path = "/".join(str(x) for x in [rng.choice(["en", "es", "fr", "shop"]), *rng.choice(["a", "b", "1", "22.html", "c", f"u{i}"], rng.integers(0, 8))])
        rows.append((10_000 + i, f"http://{host}/{path}{rng.choice(['', '?q', '#t'])}"))
    rows += [(20_000, None), (20_001, "no url"), (20_002, ""), (20_003, "http://"), (20_004, "http://x.org/a//b/"), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows], "page_id long, url string, template string, labelled int")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9)) for r in url_filter.filter_urls(df, queries.URL_RULES).collect())
    want = Counter((key, *w) for (key, _u), w in zip(rows, _judged([u for _, u in rows], queries.URL_RULES)))
    assert got == want
    assert len({w[4] for w in want if w[3] is None}) == 2 and any("~" in w[5] for w in want) and any("*" in w[5] for w in want)


# ---- pipeline ---------------------------------------------------------------------------------

def _simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    s = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_pipeline_equals_brute_force(spark):
    """Decisions of the classifier are taken as given (its test is held-out accuracy); the rest is restated."""
    import sentencepiece

    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality_classifier.classify(docs.select("doc_id", "text"), labels).collect() if r.predicted == 1}
    rows = [r for r in docs.collect() if r.doc_id in good]
    assert 0 < len(rows) < docs.count()
    root = {r.doc_id: r.doc_id for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    fps = {r.doc_id: _simhash(r.text) for r in rows}
    for r in rows:
        for s in rows:
            if s.doc_id < r.doc_id and (fps[r.doc_id] ^ fps[s.doc_id]).bit_count() <= 4:
                a, b = sorted((find(r.doc_id), find(s.doc_id)))
                root[b] = a
    kept = [r for r in rows if find(r.doc_id) == r.doc_id]
    assert len(kept) < len(rows)
    cut = deduplicated([(r.doc_id, r.text) for r in kept])
    texts = {r.doc_id: (cut[r.doc_id, r.text][3], r.lang, r.source) for r in kept}
    size = Counter()
    for t, _l, source in texts.values():
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    target, stopped = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in stopped)
        target = {s: 2 * size[s] if s in stopped else left * weight[s] / sum(weight[x] for x in size if x not in stopped) for s in size}
        over = {s for s in size if target[s] > 2 * size[s] + 1e-9}
        if not over - stopped:
            break
        stopped |= over
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    want = Counter()
    for key, (t, lang, source) in texts.items():
        rate = target[source] / size[source]
        draw = int(md5(f"9|mix|{key}".encode()).hexdigest()[:8], 16) / (1 << 32)
        ids = tuple(library.encode(t))
        times = math.floor(rate) + (draw < rate - math.floor(rate))
        if times:
            want[key, lang, source, ids, len(ids), True] += times
    got = Counter((r.doc_id, r.lang, r.source, tuple(r.ids), r.n_tokens, r.round_trip) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want


# ---- maximal repeat groups --------------------------------------------------------------------

def _maximal_repeats(texts, least):
    """{(length, occurrences)} by sorting all suffixes of all texts (key -> bytes)."""
    suffixes = sorted((t[i:], k, i) for k, t in texts.items() for i in range(len(t) - least + 1))
    shared = []
    for (a, *_), (b, *_) in zip(suffixes, suffixes[1:]):
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        shared.append(n)
    out = set()
    for i, n in enumerate(shared):
        if n >= least:
            lo, hi = i, i + 1
            while lo > 0 and shared[lo - 1] >= n:
                lo -= 1
            while hi < len(shared) and shared[hi] >= n:
                hi += 1
            at = [(k, p) for _, k, p in suffixes[lo:hi + 1]]
            before = {texts[k][p - 1] if p else ("start", k, p) for k, p in at}
            if len(before) > 1 or any(isinstance(x, tuple) for x in before):
                out.add((n, frozenset(at)))
    return out


@pytest.mark.parametrize("limit", [2, 20_000])
def test_repeat_groups_equal_brute_force(spark, limit):
    """Exact copies, a long passage inside a longer one, a copy inside another text, repeats in one text, repeated rows."""
    long, copy, page = prose(301, 70), prose(302, 90), prose(303, 25)
    texts = {1: copy, 2: copy, 3: copy, 4: prose(304, 9) + copy + prose(305, 9),
             5: prose(306, 12) + long + page + prose(307, 12), 6: prose(308, 7) + long + page + prose(309, 8), 7: long + prose(310, 9),
             8: prose(311, 9) + page + page + prose(312, 3) + page, 9: "ab" * 90, 10: "", 11: prose(313, 60), 12: prose(314, 5)}
    docs = spark.createDataFrame([*texts.items(), (1, copy), (13, None)], "doc_id long, text string")
    got = defaultdict(list)
    for r in suffix_dedup.repeat_groups(docs, group_limit=limit).collect():
        got[r.group].append((r.doc_id, r.start, r.n_bytes, r.first))
    found = [(rows[0][2], frozenset((k, s) for k, s, _, _ in rows)) for rows in got.values()]
    assert len(found) == len(set(found)) and all(sum(f for *_, f in rows) == 1 for rows in got.values())
    want = _maximal_repeats({k: t.encode() for k, t in texts.items()}, suffix_dedup.MATCH)
    assert set(found) <= want and len([w for w in want if {k for k, _ in w[1]} != {9}]) == 6
    assert {k for _, at in want - set(found) for k, _ in at} <= {9}          # the stated limit: a run of one short period
    assert max(n for n, _ in found) > 500 and suffix_dedup.repeat_groups(docs.filter("false")).isEmpty()
