"""Spelling variants: words one edit apart, found with bidirectional FM-index search schemes.

A word u is cut in two halves. Any word one edit away keeps one half whole: it starts with u's first half
or ends with its second. So a word is indexed under the prefixes and the suffixes that halves of its
possible partners have (two of each), and asks under its own two halves. Keys are dealt to shards of about
``shard_chars`` letters; a shard is the only thing a task holds. In a shard:

* the text is the sorted words, delimited: ``$w1$w2$...$``; its suffix array and that of the reversed text
  give a bidirectional FM-index (``Index``): a pattern is a pair of suffix-rank intervals of equal size, one in
  each array, and can be extended by a letter on either side;
* the scheme (first half exact, then to the right across the second) and its mirror (second half exact, then to
  the left across the first) extend all searches of the shard at once, branching once over the letters that
  really follow (``_one_error``); ``$v$`` is found as one suffix rank, which is v's place among the words.

A pair is found once: each edit has one normal form (an inserted letter differs from the next one, a deleted
one ends its run), and the mirrored search drops words that start with the whole first half. A key with more
than ``shard_chars`` letters is cut into blocks of words; its searches go to every block.

Defined results: null or empty texts have no runs; equal rows count as often as they stand; a null key is
the empty text; an empty table gives an empty result; ties of ``form`` go to the smaller word in code-point
order; columns other than key and text are not read. Very long texts are read piece by piece, never cut
within a run; a run of any length is one word.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.llm.common import stored, text_slices

# fixed values: the letters of a run
LETTERS = "A-Za-zÀ-ÿ"
RUN, GAP = re.compile(f"[{LETTERS}]+"), re.compile(f"[^{LETTERS}]")

PIECE = 1 << 20              # code points of a text looked at in one go
SLICE = 8 << 20              # bytes of text taken from a batch in one go
HELD = 300_000               # different words a task counts before it hands them on
SHARD_CHARS = 1 << 17        # letters of the words of one shard
AT_ONCE = 1 << 13            # searches extended together
INDEX, FORWARD, BACKWARD = 0, 1, 2


def _runs(text: str) -> Iterator[list[str]]:
    lo = 0
    while lo < len(text):
        hi = lo + PIECE
        if hi < len(text):
            end = GAP.search(text, hi)
            hi = end.start() if end else len(text)
        yield RUN.findall(text, lo, hi)
        lo = hi


def word_counts(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", drop_every: int = 0) -> DataFrame:
    """``(word, n)`` of all runs of letters, A-Z lower-cased. With ``drop_every``, a run whose
    crc32 of ``<key>:<run>`` is a multiple of it loses the code point at crc32 modulo its length."""
    def count(batches):
        seen: Counter[str] = Counter()
        for b in text_slices(batches, SLICE, 1):
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own: Counter[str] = Counter()
                for runs in _runs(text.lower().decode()):
                    own.update(runs)
                if drop_every:
                    start, marked = zlib.crc32(f"{key}:".encode()), []
                    for run in own:
                        h = zlib.crc32(run.encode(), start)
                        if h % drop_every == 0:
                            marked.append((run, h % len(run)))
                    gone = [(run, at, own.pop(run)) for run, at in marked]
                    for run, at, n in gone:
                        own[run[:at] + run[at + 1:]] += n
                seen.update(own)
                if len(seen) > HELD:
                    yield _counted(seen)
                    seen = Counter()
        yield _counted(seen)

    rows = docs.select(F.coalesce(F.col(key_col).cast("string"), F.lit("")).alias("key"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``s`` (numbers from 0), by prefix doubling; a shorter suffix is the smaller."""
    n, k = len(s), 1
    rank = s.astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[:max(n - k, 0)] = rank[k:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class Index:
    """Bidirectional FM-index over sorted, different words. ``below[side][i, c]`` counts the symbols smaller
    than c before row i of that side's last column; side 0 is the text (extends to the left), 1 the reversed text."""

    def __init__(self, words: list[str]):
        self.words = words
        codes = np.frombuffer(f"${'$'.join(words)}$".encode("utf-32-le"), np.uint32)
        self.symbols, s = np.unique(codes, return_inverse=True)           # "$" is the smallest: symbol 0
        self.delimiters = len(words) + 1
        self.below, self.first = [], []
        for side in (s, s[::-1]):
            last = side[suffix_array(side) - 1]
            table = np.zeros((len(self.symbols) + 1, len(s) + 1), np.int32)
            for c in range(len(self.symbols)):
                np.cumsum(last == c, out=table[c + 1, 1:])
                table[c + 1] += table[c]
            self.first.append(table[:, -1].astype(np.int64))
            self.below.append(np.ascontiguousarray(table.T))

    def symbol(self, codes: np.ndarray) -> np.ndarray:
        """Symbols of code points, -1 where the index has none."""
        at = np.minimum(np.searchsorted(self.symbols, codes), len(self.symbols) - 1)
        return np.where(self.symbols[at] == codes, at, -1)

    def extend(self, side: int, own: np.ndarray, other: np.ndarray, size: np.ndarray, c):
        """Intervals after one more symbol on that side; ``own`` starts in its array, ``other`` in the other one."""
        t = self.below[side]
        lo, lo1, hi, hi1 = t[own, c], t[own, c + 1], t[own + size, c], t[own + size, c + 1]
        return self.first[side][c] + (lo1 - lo), other + (hi - lo), (hi1 - hi) - (lo1 - lo)


def _one_error(index: Index, side: int, seq: np.ndarray, start: np.ndarray, total: np.ndarray, exact: np.ndarray):
    """(search, word) pairs: words that are one edit from sequence ``seq[start:start + total]``, read away from
    the delimiter on that side, with the first ``exact`` symbols untouched. Every pair comes once."""
    q = np.arange(len(start))
    own = other = np.zeros(len(q), np.int64)
    size = np.full(len(q), index.delimiters, np.int64)
    pool = [np.zeros(0, np.int64)] * 5                                    # search, own, other, size, position
    found, t = [], 0
    while len(q) or len(pool[0]):
        # searches that have used their error: one more symbol of the sequence, or the closing delimiter
        grown = []
        if len(pool[0]):
            pq, po, pt, ps, pp = pool
            ended = pp == total[pq]
            c = np.where(ended, 0, seq[np.minimum(start[pq] + pp, len(seq) - 1)])
            known = c >= 0
            pq, po, pt, ps, pp, ended, c = (x[known] for x in (pq, po, pt, ps, pp, ended, c))
            po, pt, ps = index.extend(side, po, pt, ps, c)
            alive = ps > 0
            done = alive & ended
            found.append((pq[done], (po if side == 0 else pt)[done] - 1))
            go = alive & ~ended
            grown.append([x[go] for x in (pq, po, pt, ps, pp + 1)])
        # searches without an error so far, all at position t: branch once the exact part is over
        if len(q):
            b = np.nonzero(exact[q] <= t)[0]
            if len(b):
                bq, bo, bt, bs = q[b], own[b], other[b], size[b]
                more = t < total[bq]
                at = start[bq] + t
                here = np.where(more, seq[np.minimum(at, len(seq) - 1)], -2)
                lo, hi = index.below[side][bo], index.below[side][bo + bs]
                counts = (hi[:, 1:] - hi[:, :-1]) - (lo[:, 1:] - lo[:, :-1])
                i, c = np.nonzero(counts)
                keep = (c > 0) & (c != here[i])
                i, c = i[keep], c[keep]
                o, r, s = index.extend(side, bo[i], bt[i], bs[i], c)
                grown.append([bq[i], o, r, s, np.full(len(i), t)])                            # inserted before position t
                j = more[i]
                grown.append([bq[i][j], o[j], r[j], s[j], np.full(int(j.sum()), t + 1)])      # replaced
                last = t + 1 >= total[bq]
                d = more & (last | (here != seq[np.minimum(at + 1, len(seq) - 1)]))
                grown.append([bq[d], bo[d], bt[d], bs[d], np.full(int(d.sum()), t + 1)])      # left out
            go = t < total[q]
            q, own, other, size = q[go], own[go], other[go], size[go]
            c = seq[start[q] + t] if len(q) else np.zeros(0, np.int64)
            go = c >= 0
            q, own, other, size, c = q[go], own[go], other[go], size[go], c[go]
            own, other, size = index.extend(side, own, other, size, c)
            go = size > 0
            q, own, other, size = q[go], own[go], other[go], size[go]
        pool = [np.concatenate(x) for x in zip(*grown, strict=True)] if grown else [np.zeros(0, np.int64)] * 5
        t += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def near_words(index: Index, asked: list[str], side: int) -> tuple[np.ndarray, np.ndarray]:
    """(asked, word) pairs of one edit. Side 1 reads to the right from a whole first half; side 0 reads to the
    left from a whole second half and leaves out words that start with the whole first half."""
    found = []
    for lo in range(0, len(asked), AT_ONCE):
        part = asked[lo:lo + AT_ONCE]
        total = np.array([len(u) for u in part])
        half = total // 2
        seq = index.symbol(np.frombuffer("".join(u if side else u[::-1] for u in part).encode("utf-32-le"), np.uint32))
        start = np.concatenate([[0], np.cumsum(total)[:-1]])
        q, v = _one_error(index, side, seq, start, total, half if side else total - half)
        if not side:
            fits = [not index.words[j].startswith(part[i][:half[i]]) for i, j in zip(q.tolist(), v.tolist(), strict=True)]
            q, v = q[fits], v[fits]
        found.append((q + lo, v))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


SHARD_OUT = "word string, n_near bigint, best_n bigint, best string"


def _shard(t: pa.Table) -> pa.Table:
    """One shard: its index rows searched by its asking rows; one row per asking row with partners."""
    word, n, h, kind = (t[c].to_numpy(zero_copy_only=False) for c in ("word", "n", "h", "kind"))
    blocks, block = (t[c].to_numpy(zero_copy_only=False) for c in ("blocks", "block"))
    at = {w: i for i, w in enumerate(word) if kind[i] == INDEX}
    words = sorted(at)
    out: list[list] = [[], [], [], []]
    if words:
        index = Index(words)
        place = np.array([at[w] for w in words])
        n_of, h_of = n[place], h[place]
        for kind_asked, side in ((FORWARD, 1), (BACKWARD, 0)):
            rows = np.nonzero(kind == kind_asked)[0]
            q, v = near_words(index, [word[i] for i in rows], side)
            mine = h_of[v] % blocks[rows[q]] == block[rows[q]]       # a word of another block is that block's to find
            q, v = q[mine], v[mine]
            order = np.lexsort((v, -n_of[v], q))
            q, v = q[order], v[order]
            head, count = np.unique(q, return_index=True, return_counts=True)[1:]
            out[0] += [word[i] for i in rows[q[head]]]
            out[1] += count.tolist()
            out[2] += n_of[v[head]].tolist()
            out[3] += [words[i] for i in v[head]]
    return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                     pa.array(out[3], pa.string())], names=["word", "n_near", "best_n", "best"])


def neighbours(words: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``(word, n_near, best_n, best)`` of the words with a partner, from ``(word, n)`` with different words of
    two code points or more; ``best`` is the partner of largest n (ties: smallest word)."""
    size = F.char_length("word")
    head, tail = (lambda k: F.xxhash64(F.lit("<"), F.left("word", k))), (lambda k: F.xxhash64(F.lit(">"), F.right("word", k)))
    half = F.floor(size / 2).cast("int")
    base = words.select("word", "n", F.pmod(F.xxhash64("word"), F.lit(1 << 31)).alias("h"))
    index = base.withColumn("key", F.explode(F.array(
        head(F.floor((size - 1) / 2).cast("int")), head(F.floor((size + 1) / 2).cast("int")), tail(half), tail(half + 1))))
    asking = base.withColumn("ask", F.explode(F.array(
        F.struct(head(half).alias("key"), F.lit(FORWARD).alias("kind")), F.struct(tail(size - half).alias("key"), F.lit(BACKWARD).alias("kind")))))
    loads = stored(index.groupBy("key").agg(F.sum(size + 1).alias("load")), "loads")
    total = loads.agg(F.sum("load")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_chars))
    heavy = loads.filter(F.col("load") > shard_chars).select("key", F.ceil(F.col("load") / shard_chars).cast("int").alias("blocks"))

    def dealt(rows, block):
        r = rows.join(heavy, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", block)
        return r.select("kind", "word", "n", "h", "blocks", F.col("block").cast("int"), "key")

    rows = dealt(index.withColumn("kind", F.lit(INDEX)), F.col("h") % F.col("blocks")).unionByName(
        dealt(asking.select("word", "n", "h", "ask.*"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key", "block"), F.lit(shards))).drop("key")
    found = rows.groupBy("shard").applyInArrow(_shard, SHARD_OUT)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")) \
        .select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``root`` for rows ``(word, form, ...)``: the last word of the chain of forms. Every round doubles the
    distance followed; a form is at least twice as frequent as its word, so chains have under 64 links."""
    links = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "links")
    while True:
        ahead = links.filter("root <> word").select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.select("word", "root").join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        if links.filter("moved").isEmpty():
            return forms.join(links.select("word", "root"), "word")


def group_variants(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3,
                   ratio: int = 2, drop_every: int = 0, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of at least ``min_length`` code points and
    ``min_count`` occurrences; the form is its most frequent partner, if ``ratio`` times as frequent."""
    counts = word_counts(docs, key_col, text_col, drop_every)
    words = stored(counts.filter((F.char_length("word") >= max(2, min_length)) & (F.col("n") >= min_count)), "words")
    is_form = F.col("best_n") >= ratio * F.col("n")
    forms = stored(words.join(neighbours(words, shard_chars), "word", "left").select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    return roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
